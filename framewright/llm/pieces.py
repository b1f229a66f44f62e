"""SentencePiece encoding and decoding of whole texts in batched numpy.

A text is cut before each run of spaces; such a unit is coded alone, since no
piece crosses a space after another character.  Arrow finds the distinct units
of a batch; units of equal length advance together; rolling hashes of their
substrings probe the hashes of the pieces.

Two codings share that machinery:

* ``viterbi``: vectorised maxima of score and back-pointers give the best
  segmentation under the file's scores.  It is what SentencePiece does for
  unigram files.
* ``merges``: for files of merges SentencePiece joins, again and again, the
  best-scored adjacent pair of pieces.  The best path by score is another
  segmentation, so for such files the ids come from batched merging: each round
  takes one vectorised maximum over the adjacent pairs of all units.

Units over ``LONG_UNIT`` bytes (a text without spaces is one) are coded alone:
pieces are found by vectorised steps over the begin positions of a stretch of
``STRETCH`` bytes, and the best path takes one stretch after the other, so memory
is a few dozen bytes for each byte of the unit, however long it is.

Decoding looks up the bytes of ids and drops the space put before the text.

Defined results: null texts encode to null ids and decode to null, empty texts
to no ids; characters without a piece become byte pieces, so decoding returns
every text exactly, but for U+2581, which SentencePiece reads as a space.  Paths
of equal score go to the longer last piece, pairs of equal score to the left.
Repeated rows get equal results; an empty table gives no rows; other columns
are carried by :func:`encode` and :func:`decode` (one named like the result is
replaced) and ignored by the query.
"""

from __future__ import annotations

import heapq
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.llm.common import table
from framewright.llm.lattice import Pieces, by_length, viterbi
from framewright.llm.wordhash import groups

#: Distinct units in a generation of those whose ids a worker keeps; there are two.
MEMO_UNITS = 600_000
#: Bytes from which a unit is coded alone.
LONG_UNIT = 48
#: Begin positions of a long unit that are probed together.
STRETCH = 1 << 16

_UNITS = re.compile(rb" *[^ ]+| +$")
_LOADED: dict[str, Codec] = {}


class Codec:
    """Pieces, scores and bytes of one SentencePiece file."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.text: list[bytes] = []
        byte_id, normal = {}, {}
        scores = np.array([model.get_score(i) for i in range(model.get_piece_size())], np.float64)
        for i in range(len(scores)):
            if model.is_byte(i):
                byte_id[int(model.id_to_piece(i)[3:5], 16)] = i
                self.text.append(bytes([int(model.id_to_piece(i)[3:5], 16)]))
            else:
                special = model.is_control(i) or model.is_unknown(i) or model.is_unused(i)
                self.text.append(b"" if special else model.id_to_piece(i).replace("▁", " ").encode())
                if not special:
                    normal.setdefault(self.text[-1], i)
        strings = sorted(normal)
        self.ids = np.array([normal[s] for s in strings], np.int64)
        self.score = scores[self.ids]
        self.of = normal
        #: Place of each piece among all by score, the best first; equal scores share it.
        order = np.unique(-self.score)
        self.rank = dict(zip(self.ids.tolist(), np.searchsorted(order, -self.score).tolist()))
        self.bytes = np.array([byte_id.get(b, model.unk_id()) for b in range(256)], np.int64)
        self.merges = bool((scores[self.ids] < -1000).any())
        # For the best path a missing character costs more than any path of pieces.
        self.floor = float(scores[scores > -1e8].min()) - 10
        covered = set(strings)
        self.with_bytes = strings + [bytes([b]) for b in range(256) if bytes([b]) not in covered]
        self.path_pieces = Pieces(self.with_bytes)
        self.path_ids = np.concatenate([self.ids, [byte_id.get(s[0], model.unk_id()) for s in self.with_bytes[len(strings) :]]]).astype(np.int64)
        self.path_score = np.concatenate([self.score, np.full(len(self.with_bytes) - len(strings), self.floor)])
        self.known: dict[tuple[str, ...], tuple[dict, dict]] = {}

    def coded(self, units: list[bytes], hows: tuple[str, ...]) -> list[tuple[np.ndarray, ...]]:
        """The ids of each unit by each coding; the codings share the probes of an equal-length batch."""
        out: list[tuple[np.ndarray, ...]] = [()] * len(units)
        for rows, matrix in by_length(units, 200_000):
            if matrix.shape[1] > LONG_UNIT:
                alone = {"viterbi": self._path_alone, "merges": self._merge_alone}
                found = [[alone[how](units[i]) for i in rows] for how in hows]
            else:
                spans = list(self.path_pieces.spans(matrix))
                path = lambda: [self.path_ids[p] for p in viterbi(self.path_pieces, self.path_score, matrix, spans)[1]]  # noqa: E731, B023
                found = [path() if how == "viterbi" else self._merge_rounds(matrix, spans) for how in hows]
            for row, *ids in zip(rows.tolist(), *found):
                out[row] = tuple(ids)
        return out

    def _merge_rounds(self, words: np.ndarray, spans: list) -> list[np.ndarray]:
        n, length = words.shape
        longest = min(self.path_pieces.longest, length)
        found = np.full((n, length, longest + 1), -1, np.int32)
        for begin, end, piece in spans:  # bytes that stand in for missing characters are not merged
            found[:, begin, end - begin] = np.where(piece < len(self.ids), piece, -1)
        start = np.ones((n, length + 1), bool)
        start[:, :length] = (words & 0xC0) != 0x80  # characters begin here
        after = np.full((n, length + 1), length, np.int64)  # where the next piece begins
        for j in range(length - 1, -1, -1):
            after[:, j] = np.where(start[:, j + 1], j + 1, after[:, j + 1])
        active, column = np.arange(n), np.arange(length)
        while len(active):
            mid = after[active, :length]
            stop = np.take_along_axis(after[active], mid, axis=1)
            size = stop - column
            ok = start[active, :length] & (mid < length) & (size <= longest)
            piece = np.where(ok, np.take_along_axis(found[active], np.minimum(size, longest)[:, :, None], axis=2)[:, :, 0], -1)
            score = np.where(piece >= 0, self.score[piece], -np.inf)
            best = score.argmax(axis=1)  # ties: the leftmost
            rows = np.arange(len(active))
            go = np.isfinite(score[rows, best])
            active, best, mid, stop = active[go], best[go], mid[go, best[go]], stop[go, best[go]]
            start[active, mid] = False
            after[active, best] = stop
        # Read the pieces off; a lone character without a piece becomes its bytes.
        row, begin = np.nonzero(start[:, :length])
        size = after[row, begin] - begin
        piece = np.where(size <= longest, found[row, begin, np.minimum(size, longest)], -1)
        many = np.where(piece >= 0, 1, size)
        flat_row, offset = np.repeat(row, many), np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        ids = np.where(np.repeat(piece, many) >= 0, self.ids[np.repeat(piece, many)], self.bytes[words[flat_row, np.repeat(begin, many) + offset]])
        return np.split(ids, np.cumsum(np.bincount(flat_row, minlength=n))[:-1])

    def _path_alone(self, unit: bytes) -> np.ndarray:
        """Best path through one long unit, begin by begin: a score is final once all pieces that end there are known."""
        length, score = len(unit), self.path_score.tolist()
        best, used = array("d", [-np.inf]) * (length + 1), array("i", [-1]) * (length + 1)
        best[0] = 0.0
        for begins, ends, pieces in self.path_pieces.hits(unit, STRETCH):
            for b, e, p in zip(begins.tolist(), ends.tolist(), pieces.tolist()):
                s = best[b] + score[p]
                if s > best[e]:
                    best[e], used[e] = s, p
        taken, at = array("i"), length
        while at:
            taken.append(used[at])
            at -= len(self.with_bytes[used[at]])
        return self.path_ids[np.frombuffer(taken, np.int32)[::-1]]

    def _merge_alone(self, unit: bytes) -> np.ndarray:
        """One long unit, n log n steps: the pairs at the start sorted once, those that merging makes in a heap.

        A pair is one whole number, its rank, place and length, so that the
        least of either queue is the next merge.
        """
        data = np.frombuffer(unit, np.uint8)
        length, of, rank = len(unit), self.of, self.rank
        edge = np.append(np.flatnonzero((data & 0xC0) != 0x80), length).astype(np.int32)
        right, left = array("i", bytes(4 * (length + 1))), array("i", bytes(4 * (length + 1)))  # where the next piece begins; where the one before does
        np.frombuffer(right, np.int32)[edge[:-1]] = edge[1:]
        np.frombuffer(left, np.int32)[edge[1:]] = edge[:-1]
        starts = []
        for k in range(0, len(edge) - 2, STRETCH):
            pairs = [(rank[got], b, e - b) for b, e in zip(edge[k : k + STRETCH].tolist(), edge[k + 2 : k + STRETCH + 2].tolist()) if (got := of.get(unit[b:e])) is not None]
            part = np.array(pairs, np.int64).reshape(-1, 3)
            starts.append((part[:, 0] << 40) | part[:, 1])
        first = np.sort(np.concatenate(starts)) if starts else np.zeros(0, np.int64)
        heap: list[int] = []
        least = (1 << 40) - 1
        for k in range(0, len(first), STRETCH):
            for key in first[k : k + STRETCH].tolist() + ([1 << 62] if k + STRETCH >= len(first) else []):
                # What merging made comes first where it is better, or as good and further left.
                while heap and heap[0] >> 16 < key:
                    made = heapq.heappop(heap)
                    b = (made >> 16) & least
                    self._join(unit, b, b + (made & 0xFFFF), left, right, heap)
                if key < 1 << 62:
                    b = key & least
                    end = right[b] and right[right[b]] if right[b] and right[b] < length else 0
                    if end and rank.get(of.get(unit[b:end], -1), -1) == key >> 40:
                        self._join(unit, b, end, left, right, heap)
        ids, at = array("i"), 0
        while at < length:
            piece = unit[at : right[at]]
            if (got := of.get(piece)) is not None:
                ids.append(got)
            else:
                ids.extend(self.bytes[list(piece)].tolist())
            at = right[at]
        return np.frombuffer(ids, np.int32).astype(np.int64)

    def _join(self, unit: bytes, b: int, end: int, left: array, right: array, heap: list[int]) -> None:
        """Join the piece at ``b`` and the next one if they still are two pieces that end at ``end``; offer the new pairs."""
        mid, length = right[b], len(unit)
        if not mid or mid >= length or right[mid] != end:
            return
        right[b], right[mid], left[end] = end, 0, b
        if end < length:
            far = right[end]
            if (got := self.of.get(unit[b:far])) is not None:
                heapq.heappush(heap, (((self.rank[got] << 40) | b) << 16) | (far - b))
        if b:
            near = left[b]
            if (got := self.of.get(unit[near:end])) is not None:
                heapq.heappush(heap, (((self.rank[got] << 40) | near) << 16) | (end - near))

    def _learned(self, units: list[bytes], hows: tuple[str, ...]) -> list[tuple[bytes, ...]]:
        """For each unit its ids by each coding, as little-endian int32."""
        new, old = self.known.setdefault(hows, ({}, {}))
        if len(new) > MEMO_UNITS:
            new, old = {}, new
            self.known[hows] = (new, old)
        miss = []
        for u in units:
            if u not in new:
                if u in old:
                    new[u] = old[u]
                else:
                    miss.append(u)
        for u, ids in zip(miss, self.coded(miss, hows)):
            new[u] = tuple(i.astype("<i4").tobytes() for i in ids)
        return [new[u] for u in units]

    def encode(self, texts: pa.Array, *hows: str) -> Iterator[tuple[np.ndarray, ...]]:
        """The ids (int32) of each text without nulls, by each coding."""
        texts = texts.cast(pa.large_string())
        odd = pc.or_(pc.match_substring_regex(texts, "^ |  | $|\u2581"), pc.equal(pc.binary_length(texts), 0))
        odd_rows = np.asarray(odd)
        lists = pc.split_pattern(texts.filter(pc.invert(odd)), " ")
        flat, offsets = lists.flatten().dictionary_encode(), lists.offsets.to_numpy().astype(np.int64)
        codes, offsets = flat.indices.to_numpy().astype(np.int64), offsets - (offsets[0] if len(offsets) else 0)
        got = self._learned([b" " + w for w in flat.dictionary.cast(pa.large_binary()).to_pylist()], hows)
        tables = []
        for k in range(len(hows)):
            part = [g[k] for g in got]
            sizes = np.fromiter(map(len, part), np.int64, len(part)) // 4
            tables.append((np.frombuffer(b"".join(part), "<i4"), np.cumsum(sizes) - sizes, sizes))
        # Texts with runs of spaces are cut one by one: a run and the word after it are one unit.
        rare = [_UNITS.findall(b" " + t.replace(b"\xe2\x96\x81", b" ")) if t else [] for t in texts.filter(odd).cast(pa.large_binary()).to_pylist()]
        every = list({u for units in rare for u in units})
        known = dict(zip(every, self._learned(every, hows)))
        plain_at, rare_at = 0, 0
        for is_odd in odd_rows.tolist():
            if is_odd:
                units = rare[rare_at]
                rare_at += 1
                yield tuple(np.frombuffer(b"".join([known[u][k] for u in units]), "<i4") for k in range(len(hows)))
            else:
                c = codes[offsets[plain_at] : offsets[plain_at + 1]]
                plain_at += 1
                out = []
                for ids, starts, sizes in tables:
                    n = sizes[c]
                    out.append(ids[np.repeat(starts[c] - np.cumsum(n) + n, n) + np.arange(n.sum())])
                yield tuple(out)

    def decode(self, ids: np.ndarray) -> bytes:
        text = b"".join(map(self.text.__getitem__, ids.tolist()))
        return text[1:] if text[:1] == b" " else text


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def codec(path: str) -> Codec:
    if path not in _LOADED:
        _LOADED[path] = Codec(path)
    return _LOADED[path]


def encode(docs: DataFrame, model_path: str | None = None, how: str | None = None, text: str = "text", into: str = "ids") -> DataFrame:
    """``docs`` with the ids of ``text``; ``how`` defaults to what SentencePiece does for the file."""
    path = model_path or default_model()

    @F.pandas_udf("array<int>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        c = codec(path)
        mode = how or ("merges" if c.merges else "viterbi")
        for texts in parts:
            out: list = []
            for _, part in groups(pa.array(texts, pa.string()), 4_000_000):
                out += [ids for (ids,) in c.encode(part, mode)]
            yield pd.Series([None if t is None else ids for t, ids in zip(texts, out)])

    return docs.withColumn(into, run(F.col(text).cast("string")))


def decode(docs: DataFrame, model_path: str | None = None, ids: str = "ids", into: str = "text") -> DataFrame:
    """``docs`` with the text of ``ids``."""
    path = model_path or default_model()

    @F.pandas_udf("string")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        c = codec(path)
        for part in parts:
            yield pd.Series([None if x is None else c.decode(np.asarray(x)).decode("utf-8", "replace") for x in part])

    return docs.withColumn(into, run(F.col(ids)))


def _digests(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        mode = "merges" if c.merges else "viterbi"
        for batch in batches:
            for first, part in groups(batch.column("text"), 4_000_000):
                valid = np.asarray(batch.column("text").slice(first, len(part)).is_valid())
                rows = []
                for text, (ids, best), ok in zip(part.cast(pa.large_binary()).to_pylist(), c.encode(part, mode, "viterbi"), valid):
                    rows.append((len(ids), zlib.crc32(ids.tobytes()), len(best), zlib.crc32(best.tobytes()), c.decode(ids) == text and c.decode(best) == text) if ok else (None,) * 5)
                cols = [pa.array(x, t) for x, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()))]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, len(part)), *cols], names=["doc_id", "n_ids", "ids_crc32", "n_best_path", "best_path_crc32", "round_trip"])

    return run


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded both ways and decoded: counts and checksums of the ids (little-endian int32), and whether the text came back."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(_digests(default_model()), "doc_id bigint, n_ids bigint, ids_crc32 bigint, n_best_path bigint, best_path_crc32 bigint, round_trip boolean")
