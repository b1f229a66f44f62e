"""Removal of passages that an earlier document holds, by FM-indexes of content shards.

1. A window is ``window`` consecutive words of one document.  Its anchor is
   the three-word run in it with the smallest hash, so equal windows have equal
   anchors wherever they stand.  Neighbouring windows with one anchor form a
   segment; the anchor's hash names its shard.  So all places that could match
   a window are in one shard, and no document meets every shard.
2. A first pass counts the anchors that stand in many documents of a batch.
   Windows of an anchor held by over 1/HOT of all documents go by their own
   hash instead, and equal ones are merged in the batch, smallest id first.
3. Each shard drops segments whose anchor one document alone has, builds a
   compressed FM-index (a wavelet matrix over the BWT) of the others' words, and
   runs every segment's windows through it by backward search.  Where the
   matching statistic reaches the window, the smallest id of its block decides.
4. Intervals to remove are joined to the documents by id.

Defined results: a null or empty text has no words; texts shorter than a window
lose nothing; equal ids never remove from one another; rows that share an id
are taken as one document (each loses what the id's rows lose at those places);
rows with a null id lose nothing and remove nothing.  Texts of any length are
searched whole, one that is longer than a batch alone.  Of places that tie the
smallest id keeps its words; an empty table gives no rows.  Other columns are
carried along by :func:`remove_repeats`; names that begin with ``_fw_`` are reserved.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.llm.common import forget, small_batches, table, written
from framewright.llm.fmindex import FMIndex
from framewright.llm.wordhash import groups, hashes, mix, mix_in_place

WINDOW = 13
ANCHOR_WORDS = 3
#: Words of the corpus to a shard, about; each word stands in about three segments.
SHARD_WORDS = 400_000
#: An anchor in more than 1/HOT of all documents is hot.
HOT = 512
#: Bytes of text whose windows are found together.
BATCH_BYTES = 8_000_000
#: Windows that search the index together.
SEARCH_ROWS = 50_000


class Batch:
    """The windows of some texts: anchors, segments and the bytes of the words."""

    def __init__(self, ids: pa.Array, texts: pa.Array, window: int):
        texts = pc.if_else(pc.is_valid(ids), texts, pa.scalar("", texts.type))
        lists = pc.ascii_split_whitespace(texts)
        flat, offsets = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
        keep = np.asarray(pc.binary_length(flat)) > 0
        offsets = np.concatenate([[0], np.cumsum(keep)])[offsets - offsets[0]]
        flat = flat.filter(pa.array(keep))
        self.n_words = n = len(flat)
        self.ids = np.asarray(pc.fill_null(ids, 0))
        self.row = np.repeat(np.arange(len(texts), dtype=np.int32), np.diff(offsets))
        self.first_word = offsets
        del lists, keep, texts
        one = flat.dictionary_encode()
        h = mix(hashes(one.dictionary.cast(pa.large_binary()).to_pylist()))[one.indices.to_numpy()] if n else np.zeros(0, np.uint64)
        self.h = h
        del one
        spaced = pc.binary_join_element_wise(flat, pa.scalar("", flat.type), pa.scalar(" ", flat.type))
        self.at = np.frombuffer(spaced.buffers()[1], np.int64)[spaced.offset : spaced.offset + n + 1] if n else np.zeros(1, np.int64)
        self.data = memoryview(spaced.buffers()[2]) if n else memoryview(b"")
        del flat
        if n < window:
            self.start = np.zeros(0, np.int64)
            self.anchor = np.zeros(0, np.uint64)
            return
        with np.errstate(over="ignore"):
            m = n - ANCHOR_WORDS + 1
            gram = np.zeros(m, np.uint64)
            for k in range(ANCHOR_WORDS):
                gram *= np.uint64(0x9E3779B97F4A7C15)
                gram += h[k : k + m]
                mix_in_place(gram)
        # Least over the runs of a window, by doubling.
        span, least = window - ANCHOR_WORDS + 1, gram
        reach = 1
        while 2 * reach <= span:
            least = np.minimum(least[:-reach], least[reach:])
            reach *= 2
        if span > reach:
            least = np.minimum(least[: reach - span], least[span - reach :])
        self.start = np.flatnonzero(self.row[: n - window + 1] == self.row[window - 1 :])
        self.anchor = least[self.start]

    def segments(self, hot: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first window, windows, key) of each segment; a hot anchor's windows stand alone."""
        s = self.start
        if not len(s):
            return s, s, self.anchor
        is_hot = np.isin(self.anchor, hot) if len(hot) else np.zeros(len(s), bool)
        row = self.row[s]
        new = np.ones(len(s), bool)
        new[1:] = (np.diff(s) != 1) | (self.anchor[1:] != self.anchor[:-1]) | (row[1:] != row[:-1]) | is_hot[1:] | is_hot[:-1]
        del row
        at = np.flatnonzero(new)
        key = self.anchor[at].copy()
        if is_hot.any():
            own = s[at[is_hot[at]]]
            with np.errstate(over="ignore"):
                finger = np.zeros(len(own), np.uint64)
                for k in range(window):
                    finger = mix(finger * np.uint64(0x9E3779B97F4A7C15) + self.h[own + k])
            key[is_hot[at]] = finger
        return s[at], np.diff(np.append(at, len(s))), key


def _each(work):
    """Map batches by ``work(ids, texts)``; what a group of texts took is free again before the next one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, part in groups(batch.column("text"), BATCH_BYTES):
                yield work(batch.column("doc_id").slice(first, len(part)), part)

    return run


def _counted(window: int):
    """One row a batch for its totals (key null), and one for each anchor that many of its documents hold."""

    def counts(ids: pa.Array, part: pa.Array) -> pa.RecordBatch:
        b = Batch(ids, part, window)
        start, _, key = b.segments(np.zeros(0, np.uint64), window)
        order = np.argsort(key, kind="stable")
        key, row = key[order], b.row[start[order]]
        once = np.ones(len(key), bool)
        once[1:] = (key[1:] != key[:-1]) | (row[1:] != row[:-1])
        anchors, n = np.unique(key[once], return_counts=True)
        many = n >= max(8, len(part) / (2 * HOT))
        keys = [None, *anchors[many].astype(np.int64).tolist()]
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array([len(part), *n[many].tolist()], pa.int64()), pa.array([b.n_words] + [0] * (len(keys) - 1), pa.int64())], names=["key", "docs", "words"])

    return _each(counts)


def _dealt(window: int, shards: int, hot: np.ndarray):
    """Segments of a batch as one compressed row a shard; what a batch settles itself goes along."""

    def deal(ids: pa.Array, part: pa.Array) -> pa.RecordBatch:
        pack = zstandard.ZstdCompressor(level=3)
        b = Batch(ids, part, window)
        start, many, key = b.segments(hot, window)
        doc, pos = b.ids[b.row[start]], start - b.first_word[b.row[start]] if len(start) else start
        low, high = b.at[start], b.at[start + many + window - 1] if len(start) else b.at[start]
        settled = np.zeros(len(start), bool)
        # Equal segments of a batch: the smallest id goes on, larger ids lose those windows to it.
        order = np.lexsort((doc, key))
        again = np.flatnonzero(key[order][1:] == key[order][:-1])
        seen: dict[bytes, int] = {}
        for i in order[np.unique(np.concatenate([again, again + 1]))].tolist():
            text = bytes(b.data[low[i] : high[i]])
            if seen.setdefault(text, int(doc[i])) < doc[i]:
                settled[i] = True
        shard = (key % np.uint64(shards)).astype(np.int64)
        order = np.argsort(shard, kind="stable")
        found, edges = np.unique(shard[order], return_index=True)
        names, blobs = [], []
        for k, own in zip(found.tolist(), np.split(order, edges[1:])):
            go, gone = own[~settled[own]], own[settled[own]]
            text = b"".join([b.data[x:y] for x, y in zip(low[go].tolist(), high[go].tolist())])
            columns = [np.diff(doc[go], prepend=0), pos[go].astype(np.int32), many[go].astype(np.int32), (high - low)[go].astype(np.int32), (key[go] >> np.uint64(32)).astype(np.uint32), doc[gone], pos[gone], many[gone]]
            names.append(k)
            blobs.append(pack.compress(pickle.dumps((columns, text), protocol=5)))
        return pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), pa.array(blobs, pa.binary())], names=["shard", "blob"])

    return _each(deal)


def _searched(window: int):
    """One shard: which words of which documents stand in an earlier document."""

    def run(rows: pa.Table) -> pa.Table:
        unpack = zstandard.ZstdDecompressor()
        parts = [pickle.loads(unpack.decompress(x.as_py())) for x in rows.column("blob")]
        doc = np.concatenate([np.cumsum(p[0][0]) for p in parts])
        pos, many, size, key = (np.concatenate([p[0][k] for p in parts]).astype(np.int64) for k in (1, 2, 3, 4))
        out = [tuple(np.concatenate([p[0][k] for p in parts]).astype(np.int64) for k in (5, 6, 7))]
        out[0] = (out[0][0], out[0][1], out[0][1] + out[0][2] + window - 1)
        texts = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(np.concatenate([[0], np.cumsum(size)]).astype(np.int64)), pa.py_buffer(b"".join(p[1] for p in parts))])
        del parts
        # An anchor that one document alone holds cannot give a match.
        order = np.lexsort((doc, key))
        k, d = key[order], doc[order]
        groups_ = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, np.int64)
        ends = np.append(groups_[1:], len(k))
        alone = d[groups_] == d[ends - 1] if len(k) else np.zeros(0, bool)
        kept = order[~np.repeat(alone, ends - groups_)]
        texts = texts.take(pa.array(kept))
        if len(kept):
            out += _matches(texts, doc[kept], pos[kept], many[kept], window)
        d, a, z = (np.concatenate([x[i] for x in out]) for i in range(3))
        return pa.table({"doc_id": pa.array(d, pa.int64()), "first": pa.array(a, pa.int64()), "stop": pa.array(z, pa.int64())})

    return run


def _matches(texts: pa.Array, doc: np.ndarray, pos: np.ndarray, many: np.ndarray, window: int) -> list[tuple[np.ndarray, ...]]:
    one = texts.dictionary_encode()
    del texts
    which = one.indices.to_numpy().astype(np.int64)
    n_texts = len(one.dictionary)
    windows = np.zeros(n_texts, np.int64)
    windows[which] = many
    owner = np.full(n_texts, np.iinfo(np.int64).max)
    np.minimum.at(owner, which, doc)
    flat = pc.split_pattern(one.dictionary.cast(pa.large_string()), " ").flatten()  # each text ends in a space: an empty word ends it
    words = flat.dictionary_encode()
    empty = pc.index_in(pa.array([""], flat.type), words.dictionary)[0].as_py()
    codes = words.indices.to_numpy().astype(np.int64)
    symbols = np.where(codes == empty, 0, np.where(codes < empty, codes + 1, codes))
    del one, flat, words, codes
    text_of = np.concatenate([[0], np.cumsum(symbols == 0)[:-1]])
    index = FMIndex(symbols, window)
    owners = owner[text_of[index.sa]]
    begin = np.cumsum(windows + window) - windows - window
    at = np.repeat(begin - np.cumsum(windows) + windows, windows) + np.arange(windows.sum())
    first = np.full(len(at), np.iinfo(np.int64).max)
    for k in range(0, len(at), SEARCH_ROWS):
        low, high, length = index.blocks(symbols[at[k : k + SEARCH_ROWS, None] + np.arange(window)])
        full = np.flatnonzero(length == window)
        if len(full):
            block, back = np.unique(low[full], return_inverse=True)
            stop = np.zeros(len(block), np.int64)
            stop[back] = high[full]
            # Blocks are disjoint: minima between borders, of which every other is a block.
            borders = np.stack([block, stop], axis=1).ravel()
            least = np.minimum.reduceat(np.append(owners, np.iinfo(np.int64).max), borders)[::2]
            first[k + full] = least[back]
    # A text that stands in several documents has its own smallest id as well.
    per = np.cumsum(windows) - windows
    base = np.repeat(np.arange(len(which)), many)
    local = np.arange(len(base)) - np.repeat(np.cumsum(many) - many, many)
    w = per[which[base]] + local
    least = np.minimum(first[w], owner[which[base]])
    hit = np.flatnonzero(least < doc[base])
    if not len(hit):
        return []
    b, s = base[hit], local[hit]
    new = np.concatenate([[True], (b[1:] != b[:-1]) | (s[1:] != s[:-1] + 1)])
    x, y = np.flatnonzero(new), np.append(np.flatnonzero(new)[1:], len(hit)) - 1
    return [(doc[b[x]], pos[b[x]] + s[x], pos[b[x]] + s[y] + window)]


def repeated_intervals(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Word intervals [first, stop) of documents whose windows start in a document with a smaller id."""
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    # Read twice below, so written, a file a core at most: the pass over all texts runs once.
    counted = written(source.mapInArrow(_counted(window), "key bigint, docs bigint, words bigint").groupBy("key").agg(F.sum("docs").alias("docs"), F.sum("words").alias("words")).coalesce(docs.sparkSession.sparkContext.defaultParallelism))
    total = counted.where("key is null").first()
    n_docs, n_words = (total["docs"], total["words"]) if total else (0, 0)
    # Counts of anchors add up to at most the anchors of all documents, so at most HOT times those of a mean document are hot.
    hot = np.array([r["key"] for r in counted.where(F.col("key").isNotNull() & (F.col("docs") * HOT > max(n_docs, 8 * HOT))).select("key").collect()], np.int64).astype(np.uint64)
    forget(counted)
    shards = max(8, -(-n_words // SHARD_WORDS))
    dealt = source.mapInArrow(_dealt(window, shards, np.sort(hot)), "shard int, blob binary")
    return dealt.groupBy("shard").applyInArrow(_searched(window), "doc_id bigint, first bigint, stop bigint")


def _squeezed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compress each text: it crosses the network once, by id, and that is most of what moves."""
    pack = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        at = batch.schema.get_field_index("text")
        small = pa.array([None if t is None else pack.compress(t.encode()) for t in batch.column(at).to_pylist()], pa.binary())
        yield pa.RecordBatch.from_arrays([small if i == at else batch.column(i) for i in range(batch.num_columns)], names=batch.schema.names)


def _cut(results: list[str], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Restore each text and take the words of ``_fw_gone`` out of it: n_words, n_removed, kept_text."""
    unpack = zstandard.ZstdDecompressor()
    for batch in batches:
        texts, n, removed, kept = [], [], [], []
        at = batch.schema.get_field_index("text")
        for small, cuts in zip(batch.column(at).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()):
            data = b"" if small is None else unpack.decompress(small)
            texts.append(None if small is None else data)
            words = data.split()
            n.append(len(words))
            if cuts:
                mask = np.ones(len(words), bool)
                for cut in cuts:
                    mask[cut["first"] : cut["stop"]] = False
                words = [words[i] for i in np.flatnonzero(mask)]
            removed.append(n[-1] - len(words))
            kept.append(b" ".join(words))
        columns = [pa.array(texts, pa.binary()).cast(pa.string()) if i == at else batch.column(i) for i in range(batch.num_columns - 1)]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], names=[*batch.schema.names[:-1], *results])


def remove_repeats(docs: DataFrame, window: int = WINDOW, prefix: str = "") -> DataFrame:
    """``docs`` with n_words, n_removed and kept_text, its kept words joined by one space.

    ``prefix`` goes before the three names; columns of ``docs`` of those names are replaced.
    """
    small_batches(docs.sparkSession)
    results = [prefix + n for n in ("n_words", "n_removed", "kept_text")]
    docs = docs.select(*[f"`{c}`" for c in docs.columns if c not in results])
    cuts = repeated_intervals(docs, window).groupBy(F.col("doc_id").alias("_fw_id")).agg(F.collect_list(F.struct("first", "stop")).alias("_fw_gone"))
    docs = docs.withColumn("text", F.col("text").cast("string"))
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    columns = [f"`{c}`" for c in docs.columns]
    squeezed = ", ".join(f"`{k}` {'binary' if k == 'text' else v}" for k, v in kinds.items())
    schema = ", ".join(f"`{k}` {v}" for k, v in kinds.items()) + f", `{results[0]}` bigint, `{results[1]}` bigint, `{results[2]}` string"
    # The filters stand before the mapping, where they reach the scan.
    small = docs.where("doc_id is not null").mapInArrow(_squeezed, squeezed)
    joined = small.join(cuts, F.col("doc_id") == F.col("_fw_id"), "left").select(*columns, "_fw_gone")
    # Rows without an id have nothing to join on: they do not meet in one task.  One mapping
    # for both steps: two in a task hold two workers each, which then live on.
    loose = docs.where("doc_id is null").select(*columns, F.lit(None).cast(joined.schema["_fw_gone"].dataType).alias("_fw_gone"))
    cut = joined.mapInArrow(lambda batches: _cut(results, batches), schema)
    return cut.unionByName(loose.mapInArrow(lambda batches: _cut(results, _squeezed(batches)), schema))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's digest of :func:`remove_repeats` over all ``documents``."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return remove_repeats(docs.select("doc_id", "text")).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


OP4_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
x AS (SELECT doc_id, unnest(range(greatest(len(w) - 12, 0))) AS i, w FROM d),
g AS (SELECT doc_id, i, array_to_string(w[i + 1 : i + 13], ' ') AS t FROM x),
f AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY t) AS first FROM g),
h AS (SELECT doc_id, i + unnest(range(1, 14)) AS i FROM f WHERE first < doc_id),
gone AS (SELECT DISTINCT doc_id, i FROM h),
u AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d),
k AS (SELECT u.doc_id, count(gone.i) AS n_removed, string_agg(CASE WHEN gone.i IS NULL THEN word END, ' ' ORDER BY u.i) AS kept
      FROM u LEFT JOIN gone ON gone.doc_id = u.doc_id AND gone.i = u.i GROUP BY u.doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""
