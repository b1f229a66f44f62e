"""Best-fit packing of tokenised documents by hierarchical residual merging.

1. Every partition tokenises its documents, cuts those over ``capacity`` tokens
   and packs its pieces best-fit, longest first.  Bins that are nearly full
   leave as finished sequences.
2. Underfull bins go on as items.  Each round joins the leftovers of
   ``FAN_IN`` nodes (at first: partitions) and packs them best-fit again, until
   one node is left: a tree over the partitions.
3. Which underfull bins a node must hand on follows from the packing.  Best-fit
   decreasing leaves at most one bin that is at most half full (the first item
   of a second one would have gone into the first); only such bins can still
   move, since two bins over half full never fit together.  A round of ``n``
   nodes so has at most ``n`` bins that move, each into one other bin at most.  A
   node hands on its half-full bin and its ``n`` emptiest others: whatever a mover
   fits into, it fits into an emptier bin as well, and ``n`` movers fill ``n`` bins
   at most.  Fuller bins leave as finished sequences; no sequence is lost by it.

Text of the tokenizer's own special tokens becomes their ids, as the tokenizer
does by default.

Defined results: a null text counts as empty and is one piece, the end id
alone.  Repeated rows are packed as often as they occur.  Null ids are carried.
Texts of any length are cut into full pieces and a last, shorter one.  Pieces of
equal length are packed in the order of their rows.  An empty table gives no
rows.  Columns other than the id and the text are ignored, whatever their names.
"""

from __future__ import annotations

import os
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.llm.common import shared_dir, small_batches, table
from framewright.llm.wordhash import coded, groups

CAPACITY = 4096
END_ID = 1
#: A bin with at most this many free tokens counts as nearly full.
SLACK = 8
#: Pieces that a partition packs at a time.
LOCAL_PIECES = 65_536
#: Nodes whose leftovers meet in one node of the next round.
FAN_IN = 8
#: Bytes of text that are tokenised together; one longer text stands alone.
GROUP_BYTES = 4_000_000
#: Distinct words in a generation of the words whose ids a worker keeps; there are two.
MEMO_WORDS = 200_000

ITEM = "struct<doc_id: bigint, piece: int, start: bigint, length: bigint, ids_crc32: bigint>"
BIN = f"sequence_id bigint, fill bigint, done boolean, node int, items array<{ITEM}>"

_ARROW = pa.schema(
    [
        ("sequence_id", pa.int64()),
        ("fill", pa.int64()),
        ("done", pa.bool_()),
        ("node", pa.int32()),
        ("items", pa.list_(pa.struct([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]))),
    ]
)

_MEMO: dict[str, tuple] = {}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: A control character that no word of a joined batch holds; its id marks where a word ends.
_MARK = b"\x01"


def _ids_of(path: str):
    """A function texts -> ids of each as an array of little-endian unsigned 32-bit numbers.

    This tokenizer never joins across white space, so a text's ids are those of
    its words one after the other, and each worker encodes a word once.  New
    words are encoded together, a marker word between each two.  The tokenizer
    lower-cases, so A-Z are lowered first; to words of ASCII alone the rest of
    its normaliser does nothing, and they skip it.  Its special tokens stand in
    a text as they are written, before all that: such texts are cut at them.
    """
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    if path not in _MEMO:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.encode_special_tokens = True
        raw = Tokenizer.from_file(path)
        raw.encode_special_tokens = True
        raw.normalizer = None
        # The words are encoded as ordinary text: lower-casing must not make a special token.
        special = {t.content.encode(): i for i, t in tokenizer.get_added_tokens_decoder().items()}
        _MEMO[path] = (tokenizer, raw, {}, {}, special)
    tokenizer, raw = _MEMO[path][:2]
    special = _MEMO[path][4]
    cut = re.compile(b"(" + b"|".join(map(re.escape, sorted(special, key=len, reverse=True))) + b")") if special else None
    mark = raw.encode(_MARK.decode(), add_special_tokens=False).ids
    split = f" {_MARK.decode()} "

    def learn(memo: dict[bytes, bytes], new: list[bytes], by) -> None:
        plain = [w for w in new if _MARK not in w]
        groups = [plain[at : at + 1000] for at in range(0, len(plain), 1000)]
        joined = [split.join([w.decode() for w in g]) for g in groups]
        for group, got in zip(groups, by.encode_batch_fast(joined, add_special_tokens=False)):
            found = np.array(got.ids, dtype="<u4")
            ends = [*np.flatnonzero(found == mark[0]).tolist(), len(found)]
            data, at = found.tobytes(), 0
            for word, end in zip(group, ends, strict=True):
                memo[word] = data[4 * at : 4 * end]
                at = end + 1
        odd = [w for w in new if _MARK in w]
        for word, got in zip(odd, by.encode_batch_fast([w.decode() for w in odd], add_special_tokens=False)):
            memo[word] = np.array(got.ids, dtype="<u4").tobytes()

    def ids(texts: pa.Array) -> Iterator[np.ndarray]:
        odd = np.zeros(len(texts), bool)
        for token in special:
            odd |= np.asarray(pc.match_substring(texts, token.decode()))
        if not odd.any():
            yield from plain_ids(texts)
            return
        # Texts with special tokens become several, a token between each two.
        parts, many = [], []
        for text, is_odd in zip(texts.cast(pa.large_binary()).to_pylist(), odd.tolist()):
            found = cut.split(text) if is_odd else [text]
            parts += found[::2]
            many.append(found[1::2])
        got = plain_ids(pa.array(parts, pa.large_binary()).cast(pa.large_string()))
        for between in many:
            out = [next(got)]
            for token in between:
                out += [np.array([special[token]], "<u4"), next(got)]
            yield np.concatenate(out) if between else out[0]

    def plain_ids(texts: pa.Array) -> Iterator[np.ndarray]:
        codes, offsets, distinct = coded(texts, lower=True)
        memo, older = _MEMO[path][2:4]
        if len(memo) > MEMO_WORDS:  # words that come again move on to the next generation, the others go
            memo, older = {}, memo
            _MEMO[path] = (tokenizer, raw, memo, older, special)
        new = []
        for w in distinct:
            if w not in memo:
                if w in older:
                    memo[w] = older[w]
                else:
                    new.append(w)
        learn(memo, [w for w in new if w.isascii()], raw)
        learn(memo, [w for w in new if not w.isascii()], tokenizer)
        found = [memo[w] for w in distinct]
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        starts, flat = np.cumsum(sizes) - sizes, np.frombuffer(b"".join(found), dtype="<u4")
        for first, last in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
            c = codes[first:last]
            n = sizes[c]
            yield flat[np.repeat(starts[c] - np.cumsum(n) + n, n) + np.arange(n.sum())]

    return ids


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Best-fit decreasing: bins as lists of indices into ``sizes``.

    Open bins are stacked by free room; the sorted list of rooms in use has at
    most ``capacity`` entries, so an item costs one bisection.
    """
    bins: list[list[int]] = []
    stacks: dict[int, list[int]] = {}
    rooms: list[int] = []
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        size = sizes[i]
        at = bisect_left(rooms, size)
        if at < len(rooms):
            room = rooms[at]
            stack = stacks[room]
            b = stack.pop()
            if not stack:
                rooms.pop(at)
                del stacks[room]
            bins[b].append(i)
        else:
            room, b = capacity, len(bins)
            bins.append([i])
        if left := room - size:
            if left in stacks:
                stacks[left].append(b)
            else:
                stacks[left] = [b]
                insort(rooms, left)
    return bins


def _packed(bins: list[tuple[int, list]], capacity: int) -> list[tuple[int, list]]:
    """Pack bins (fill, items) into larger ones, emptiest first."""
    found = []
    for members in best_fit([fill for fill, _ in bins], capacity):
        found.append((sum(bins[m][0] for m in members), [x for m in members for x in bins[m][1]]))
    return sorted(found, key=lambda b: b[0])


def _frame(bins: list[tuple[int, list]], first: int, done: list[bool], node: int) -> pd.DataFrame:
    """Rows of ``BIN``; ``first`` is the first sequence number."""
    return pd.DataFrame(
        {
            "sequence_id": [first + n for n in range(len(bins))],
            "fill": [b[0] for b in bins],
            "done": done,
            "node": [node] * len(bins),
            "items": [b[1] for b in bins],
        }
    )


def _handed_on(bins: list[tuple[int, list]], capacity: int, slack: int, nodes: int) -> int:
    """How many of ``bins``, emptiest first, go on to the next round: the movers and ``nodes`` others that are not nearly full."""
    movers = sum(2 * fill <= capacity for fill, _ in bins)
    return min(movers + nodes, sum(fill < capacity - slack for fill, _ in bins))


def _first(level: int, node: int) -> int:
    """Sequence numbers of a round and node start here; they never meet those of others."""
    return (level << 58) | (node << 32)


def pieces_of(texts: pa.Array, ids, capacity: int) -> Iterator[tuple[int, int, int, int, int]]:
    """(row, piece, start, length, crc32) for each piece of each text."""
    end = np.array([END_ID], dtype="<u4")
    for first, part in groups(texts, GROUP_BYTES):
        for row, got in enumerate(ids(part), first):
            data = np.concatenate([got, end]).tobytes()
            for piece, at in enumerate(range(0, len(data), 4 * capacity)):
                cut = data[at : at + 4 * capacity]
                yield row, piece, at // 4, len(cut) // 4, zlib.crc32(cut)


def _round_zero(path: str, capacity: int, slack: int, nodes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        node = context.partitionId() if context else 0
        ids, first, waiting, open_ = _ids_of(path), _first(0, node), [], []

        def flush(last: bool):
            """Pack what waits; the emptiest bins of the partition wait on, the others are finished."""
            nonlocal first, waiting, open_
            found = _packed(waiting, capacity)
            movers = sum(2 * fill <= capacity for fill, _ in found)
            waiting, rest = found[:movers], found[movers:]
            rest = sorted(open_ + rest, key=lambda b: b[0])
            go = _handed_on(rest, capacity, slack, nodes)
            open_, rest = rest[:go], rest[go:]
            if last:
                rest, done = waiting + open_ + rest, [False] * (len(waiting) + len(open_)) + [True] * len(rest)
            else:
                done = [True] * len(rest)
            out = _frame(rest, first, done, node)
            first += len(out)
            return pa.RecordBatch.from_pandas(out, schema=_ARROW, preserve_index=False)

        for batch in batches:
            keys = batch.column("doc_id").to_pylist()
            for row, piece, start, length, crc in pieces_of(batch.column("text"), ids, capacity):
                waiting.append((length, [{"doc_id": keys[row], "piece": piece, "start": start, "length": length, "ids_crc32": crc}]))
                if len(waiting) >= LOCAL_PIECES:
                    yield flush(False)
        if waiting or open_:
            yield flush(True)

    return run


def _round(level: int, capacity: int, slack: int, nodes: int):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        bins = _packed([(int(fill), list(items)) for fill, items in zip(pdf["fill"], pdf["items"])], capacity)
        go = _handed_on(bins, capacity, slack, nodes) if nodes > 1 else 0
        node = int(key[0])
        return _frame(bins, _first(level, node), [False] * go + [True] * (len(bins) - go), node)

    return run


def pack(docs: DataFrame, tokenizer_path: str | None = None, capacity: int = CAPACITY, slack: int = SLACK) -> DataFrame:
    """Sequences ``(sequence_id, fill, items)``; items lie one after the other from offset 0.

    ``docs`` has ``doc_id`` (long) and ``text``.  Every round is written to the
    shared folder, so a lost executor never repeats an earlier round.
    """
    spark = docs.sparkSession
    small_batches(spark)
    root = shared_dir(spark)
    path = tokenizer_path or default_tokenizer()
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    nodes, level, finished = max(source.rdd.getNumPartitions(), 1), 0, []
    source.mapInArrow(_round_zero(path, capacity, slack, nodes), BIN).write.partitionBy("done").parquet(f"{root}/0")
    schema = f"sequence_id bigint, fill bigint, node int, items array<{ITEM}>, done boolean"
    read = lambda level: spark.read.schema(schema).parquet(f"{root}/{level}")
    while True:
        finished.append(read(level).where("done"))
        if nodes == 1 and level:
            break
        left = read(level).where("not done").select(F.expr(f"node div {FAN_IN}").cast("int").alias("parent"), "fill", "items")
        nodes, level = -(-nodes // FAN_IN), level + 1
        run = _round(level, capacity, slack, nodes)
        left.groupBy("parent").applyInPandas(run, BIN).write.partitionBy("done").parquet(f"{root}/{level}")
    out = finished[0]
    for df in finished[1:]:
        out = out.unionByName(df)
    return out.select("sequence_id", "fill", "items")


def placed(sequences: DataFrame) -> DataFrame:
    """One row per piece, with its place in its sequence."""
    return sequences.select("sequence_id", F.posexplode("items").alias("_at", "item"), "items").select(
        "item.*",
        "sequence_id",
        F.expr("aggregate(slice(items, 1, _at), 0L, (s, x) -> s + x.length)").alias("offset"),
    )


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` in sequences of at most 4096 tokens, one row per piece."""
    return placed(pack(table(spark, sf_dir, "documents").select("doc_id", "text")))
