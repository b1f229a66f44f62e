"""Count-based sliding windows over ordered streams.

Two physical forms: ``windows`` slices each window's rows from sorted blocks of
its stream (one shuffle by stream and block); ``multiplicity`` says how many
windows cover a frame, so statistics over windows need no windows at all: no
30-fold blow-up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framewright.schema import FEATURES

#: Window lengths in a block of a stream: more make fewer copied frames (one in ``BLOCK``), fewer make smaller tasks.
BLOCK = 16


def window_count(n: Column, length: int, step: int) -> Column:
    return F.when(n >= length, F.floor((n - length) / step) + 1).otherwise(0).cast("long")


def blocks(frames: DataFrame, length: int, step: int = 1, features: list[str] | None = None, key: str = "video_id", order: str = "frame_idx") -> DataFrame:
    """Blocks of streams that begin a window: key, rows (i, x, c: the carried columns), _first, _start and _last.

    ``_first`` is the position of the block's first frame, ``_start`` and
    ``_last`` bound those of its windows, which begin ``step`` apart.  ``order``
    holds dense positions from 0, so a window's frames are known by arithmetic.
    A stream is cut into blocks of ``BLOCK`` lengths, each with the
    ``length - 1`` frames that follow it: a long stream is many small tasks and
    an array is sorted once a block.
    """
    features = features or FEATURES
    size = BLOCK * length
    i = F.col(order)
    carried = _carried(frames, key, order)
    block = F.floor(i / size).cast("long")
    shared = (block > 0) & (i % size < length - 1)  # also the end of the block before
    row = F.struct(i.alias("i"), F.array(*[F.col(c).cast("float") for c in features]).alias("x"), F.struct(F.lit(0).alias("_"), *carried).alias("c"))
    dealt = frames.select(key, row.alias("row"), F.explode(F.when(shared, F.array(block - 1, block)).otherwise(F.array(block))).alias("_block"))
    found = dealt.groupBy(key, "_block").agg(F.sort_array(F.collect_list("row")).alias("rows"))
    first = F.col("_block") * size
    start = F.ceil(first / step) * step  # of the block's first window
    last = F.least(first + size - 1, first + F.size("rows") - length)  # no window starts later
    return found.where(last >= start).select(key, "rows", first.alias("_first"), start.alias("_start"), last.alias("_last"))


def _carried(frames: DataFrame, key: str, order: str) -> list[str]:
    return [c for c in frames.columns if c not in (*FEATURES, key, order, "is_padding")]


def windows(frames: DataFrame, length: int, step: int = 1, features: list[str] | None = None, key: str = "video_id", order: str = "frame_idx") -> DataFrame:
    """Full windows: key, window_id, x (array of arrays); carried columns come from the first frame.

    Only the windows of ``step`` are sliced from the :func:`blocks`.
    """
    found = blocks(frames, length, step, features, key, order)
    parts = found.select(key, "rows", F.col("rows.x").alias("x"), "_first", F.explode(F.sequence("_start", "_last", F.lit(step).cast("long"))).alias("_start"))
    at = (F.col("_start") - F.col("_first")).cast("int")
    own = [F.get("rows", at)["c"][c].alias(c) for c in _carried(frames, key, order)]
    return parts.select(key, F.expr(f"_start div {step}").cast("int").alias("window_id"), *own, F.slice("x", at + 1, length).alias("x"))


def with_multiplicity(frames: DataFrame, length: int, step: int = 1, key: str = "video_id", order: str = "frame_idx") -> DataFrame:
    """Frames with ``mult``, the number of windows that hold them."""
    n = F.count(F.lit(1)).over(Window.partitionBy(key))
    last = window_count(n, length, step) - 1
    i = F.col(order)
    mult = F.greatest(F.lit(0), F.least(last, F.floor(i / step)) - F.greatest(F.lit(0), F.ceil((i - (length - 1)) / step)) + 1)
    return frames.withColumn("mult", mult.cast("long"))


def flattened(x: Column) -> Column:
    """Timestep-major vector: element t * features + f."""
    return F.flatten(x)


def projected(x: Column, indices: list[int]) -> Column:
    return F.transform(x, lambda r: F.array(*[r[i] for i in indices]))
