"""Frame streams: sampling, limits, padding.  Order is always an explicit column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framewright.schema import FEATURES, SENTINEL


def sentinel() -> list[Column]:
    return [F.lit(v).cast("float") for v in SENTINEL]


def is_padding() -> Column:
    """Every feature equals the float32 sentinel."""
    out = F.lit(True)
    for c, v in zip(FEATURES, sentinel()):
        out = out & (F.col(c) == v)
    return out


def is_finite(c: Column) -> Column:
    return ~(F.isnan(c) | (F.abs(c) == float("inf")))


def numbered(df: DataFrame, key: list[str] | str, order: list[str], into: str = "frame_idx") -> DataFrame:
    """Positions from 0 in each stream."""
    return df.withColumn(into, (F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1).cast("int"))


def sampled(frames: DataFrame, skip: int, max_frames: int | None = None, raw: str = "frame_idx") -> DataFrame:
    """Every ``skip``-th frame, numbered anew, at most ``max_frames`` a stream (None or <= 0: all).

    Positions are dense, so the new number is the old one divided: no shuffle.
    """
    out = frames.where(F.col(raw) % skip == 0).withColumn(raw, F.expr(f"{raw} div {skip}").cast("int"))
    return out.where(F.col(raw) < max_frames) if max_frames and max_frames > 0 else out


def padded(frames: DataFrame, face: str = "face") -> DataFrame:
    """Features of a nullable struct; the whole sentinel row where there is no face."""
    names = [f"{face}.{c}" for c in FEATURES]
    cols = [F.when(F.col(face).isNull(), v).otherwise(F.col(n)).alias(c) for c, n, v in zip(FEATURES, names, sentinel())]
    return frames.select(*[c for c in frames.columns if c != face], *cols, F.col(face).isNull().alias("is_padding"))
