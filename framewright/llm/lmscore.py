"""Language-model scores by subword lattices.

The score of a text is its lattice marginal: the log of the summed probability
of all ways to write its words and an end with the pieces of an existing
vocabulary.  A piece that starts a word stands nowhere else, so the sum over the
document is the product over its words ``w`` of

    (1 - end) * spell(w)

times ``end`` once, the share of ends among the training tokens, (ends + 1/2) /
(N + 1).  ``spell`` is the subword lattice of a word: one piece that starts a
word, then pieces that continue it, then a stop; all segmentations count, by a
forward recursion in log space.  The weights start from the vocabulary's own
scores and are fitted to the training tokens by expected counts (forward and
backward over the same lattice), every round over all words.  The probabilities
of all texts add up to at most one.

The words of the highest counts, ``TOP_WORDS`` at most, are looked up from a
table; all others are joined by word, so no frequent word is a join key.  A
score is a sum over words and is the same whichever way a word's part comes.

Defined results: null and empty texts are the end alone; texts and words of any
length are scored whole, long words a stretch at a time; repeated rows get equal
scores; rows with a null id are scored and trained on; with no training text the
vocabulary's scores and the halves above give all the weight; an empty table
gives no rows.  Words of equal count are taken into the table together or not at
all.  Columns other than the id and the text are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.llm.common import fold, table, written
from framewright.llm.lattice import Pieces, by_length, forward, forward_alone
from framewright.llm.wordhash import coded, groups

#: Words whose scores every worker holds at most.
TOP_WORDS = 65_536
ROUNDS = 5
#: Distinct words, and their bytes, that are spelt together: words of one length share the cost of a step.
SPELL_WORDS, SPELL_BYTES = 100_000, 8_000_000
#: Bytes from which a word's lattice is walked alone.
LONG_WORD = 256
#: Weight of the vocabulary's own scores against the expected counts, in pieces.
PRIOR = 1_000.0


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Speller:
    """Lattice over a vocabulary; index 0 of the weights is the stop."""

    def __init__(self, strings: list[bytes], weight: np.ndarray):
        self.pieces = Pieces(strings)
        self.starts = np.array([s[:1] == b" " for s in strings])
        self.prior = self._normal(weight, weight[~self.starts].sum() / 2)
        self.logp, self.stop = np.log(self.prior[0]), math.log(self.prior[1])

    def _normal(self, weight: np.ndarray, stop: float) -> tuple[np.ndarray, float]:
        """Starting pieces add up to one; continuing pieces and the stop add up to one."""
        rest = weight[~self.starts].sum() + stop
        return np.where(self.starts, weight / weight[self.starts].sum(), weight / rest), stop / rest

    @classmethod
    def load(cls, path: str) -> Speller:
        """The normal and byte pieces of a SentencePiece file; the marker of a word's start is a space.

        Scores of a unigram file are log probabilities.  Those of a file of
        merges are ranks, which Zipf's law turns into probabilities.
        """
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        found: dict[bytes, float] = {}
        scores = [model.get_score(i) for i in range(model.get_piece_size())]
        ranked = min(s for s in scores if s > -1e8) < -1000
        for i, score in enumerate(scores):
            if model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                continue
            piece = bytes([int(model.id_to_piece(i)[3:5], 16)]) if model.is_byte(i) else model.id_to_piece(i).replace("▁", " ").encode()
            if model.is_byte(i) and piece == b" " or b" " in piece[1:]:
                continue  # a space starts a word and stands nowhere else
            weight = 1e-7 if model.is_byte(i) else 1 / (10 - score) if ranked else math.exp(score)
            found[piece] = found.get(piece, 0) + weight
        found.setdefault(b" ", 1e-7)
        strings = sorted(found)
        return cls(strings, np.array([found[s] for s in strings]))

    def fit(self, counts: np.ndarray, words: float) -> None:
        """Weights from expected counts of pieces in ``words`` words and the prior."""
        mass, stop = self._normal(counts + PRIOR * self.prior[0], words + PRIOR * self.prior[1])
        self.logp, self.stop = np.log(mass), math.log(stop)

    def spell(self, words: list[bytes], counts: np.ndarray | None = None, weight: np.ndarray | None = None) -> np.ndarray:
        """Natural log of spell(w) for words without their space."""
        out = np.zeros(len(words))
        short = [k for k, w in enumerate(words) if len(w) <= LONG_WORD]
        for rows, matrix in by_length([b" " + words[k] for k in short]):
            rows = np.array(short)[rows]
            out[rows] = forward(self.pieces, self.logp, matrix, counts, None if weight is None else weight[rows]) + self.stop
        for k in (k for k, w in enumerate(words) if len(w) > LONG_WORD):
            out[k] = forward_alone(self.pieces, self.logp, b" " + words[k], counts, 1.0 if weight is None else float(weight[k])) + self.stop
        return out


def word_counts(docs: DataFrame, trained: F.Column) -> DataFrame:
    """(word binary, c): every distinct word of all texts, with its count in the training texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            use = np.asarray(batch.column("_use").to_pylist(), bool)
            for first, part in groups(batch.column("text")):
                codes, offsets, distinct = coded(part, lower=True)
                weight = np.repeat(use[first : first + len(part)], np.diff(offsets))
                n = np.bincount(codes, weight, len(distinct)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(distinct, pa.binary()), pa.array(n)], names=["word", "c"])

    source = docs.select(F.col("text").cast("string").alias("text"), trained.alias("_use"))
    return source.mapInArrow(run, "word binary, c bigint").groupBy("word").agg(F.sum("c").alias("c"))


class Model:
    """The speller and the share of ends; scores distinct words."""

    def __init__(self, speller: Speller, tokens: int, ends: int, kinds: int):
        self.speller, self.tokens, self.ends, self.kinds = speller, tokens, ends, kinds

    def base(self, c: np.ndarray) -> np.ndarray:
        v = self.kinds + (self.ends > 0)
        return np.log10((c + 0.5) / (self.tokens + 0.5 * (v + 1)))

    def word(self, words: list[bytes]) -> np.ndarray:
        more = math.log((self.tokens - self.ends + 0.5) / (self.tokens + 1))
        return (self.speller.spell(words) + more) / math.log(10)

    def end(self) -> float:
        return math.log10((self.ends + 0.5) / (self.tokens + 1))


def _height() -> F.Column:
    """Class of a word's count, eight to a doubling."""
    return F.floor(F.log2(F.col("c") + 1) * 8).cast("int")


def _cut(counts: DataFrame, most: int) -> int:
    """The lowest class such that it and the higher ones hold at most ``most`` words."""
    sizes, cut, held = counts.groupBy(_height().alias("h")).count().orderBy(F.desc("h")).collect(), 10**6, 0
    for row in sizes:
        held += row["count"]
        if held > most or row["h"] <= 0:
            break
        cut = row["h"]
    return cut


def _together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in larger ones."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= SPELL_WORDS or sum(b.nbytes for b in held) >= SPELL_BYTES:
            yield pa.concat_batches(held)
            held = []
    if held:
        yield pa.concat_batches(held)


def _expected(speller: Speller, types: DataFrame) -> tuple[np.ndarray, float]:
    """Expected uses of each piece over the words of ``types``, ``c`` times each, one row a piece and task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, n = np.zeros(len(speller.logp)), 0
        for batch in _together(batches):
            c = np.asarray(batch.column("c"))
            speller.spell(batch.column("word").to_pylist(), counts, c)
            n += int(c.sum())
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array([*some.tolist(), -1], pa.int32()), pa.array([*counts[some].tolist(), float(n)])], names=["piece", "n"])

    # At most one row for each piece of the vocabulary reaches the driver.
    got = types.mapInArrow(run, "piece int, n double").groupBy("piece").agg(F.sum(F.round("n", 6).cast("decimal(28,6)")).cast("double").alias("n")).collect()
    out, n = np.zeros(len(speller.logp)), 0.0
    for row in got:
        if row["piece"] < 0:
            n = row["n"]
        else:
            out[row["piece"]] = row["n"]
    return out, n


def fit_model(docs: DataFrame, trained: F.Column, model_path: str | None = None) -> tuple[Model, DataFrame]:
    """The model and the table of distinct words ``(word, c)``."""
    counts = written(word_counts(docs, trained))
    totals = counts.agg(*[F.coalesce(F.sum(e), F.lit(0)).alias(k) for k, e in {"n": F.col("c"), "v": (F.col("c") > 0).cast("long")}.items()]).first()
    ends = docs.agg(F.coalesce(F.sum(trained.cast("long")), F.lit(0))).first()[0]
    speller = Speller.load(model_path or default_model())
    known = counts.where("c > 0")
    for _ in range(ROUNDS):
        speller.fit(*_expected(speller, known))
    return Model(speller, totals["n"] + ends, ends, totals["v"]), counts


def _scored(model: Model):
    """Distinct words with their base and model scores."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _together(batches):
            c = np.asarray(batch.column("c"))
            score = model.word(batch.column("word").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("word"), pa.array(c > 0), pa.array(model.base(c)), pa.array(score)], names=["word", "known", "base", "score"])

    return run


def score_texts(docs: DataFrame, model: Model, counts: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id): n_tokens, n_known, base_score, score."""
    spark = docs.sparkSession
    schema = "word binary, known boolean, base double, score double"
    cut, height = _cut(counts, TOP_WORDS), _height()
    top = counts.where(height >= cut)
    best = {bytes(r["word"]): (r["known"], r["base"], r["score"]) for r in top.mapInArrow(_scored(model), schema).collect()}
    table_ = spark.sparkContext.broadcast(best)  # at most TOP_WORDS words
    end = (model.ends > 0, float(model.base(np.array([model.ends]))[0]), model.end())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, serial = table_.value, 0
        task = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 36
        for batch in batches:
            ids = batch.column("doc_id")
            for first, part in groups(batch.column("text")):
                codes, offsets, distinct = coded(part, lower=True)
                got = [known.get(w) for w in distinct]
                rare = np.fromiter((g is None for g in got), bool, len(got))
                values = np.array([(0, 0, 0) if g is None else g for g in got], float).reshape(-1, 3)
                owner = np.repeat(np.arange(len(part)), np.diff(offsets))
                pair = owner * max(len(distinct), 1) + codes
                sums = [np.bincount(owner, values[codes, k], len(part)) + end[k] for k in range(3)]
                pair, many = np.unique(pair[rare[codes]], return_counts=True)
                doc, word = np.divmod(pair, max(len(distinct), 1))
                key = task + serial + np.arange(len(part))
                serial += len(part)
                # A document's own row has a key that is no word, so these rows spread over all partitions.
                words = [b" " + int(k).to_bytes(8, "little") for k in key] + [distinct[w] for w in word.tolist()]
                n, m = len(part), len(pair)
                pad = lambda own, fill: np.concatenate([own, np.full(m, fill)])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate([key, key[doc]]), pa.int64()),
                        pa.array([*ids.slice(first, n).to_pylist(), *[None] * m], pa.int64()),
                        pa.array(words, pa.binary()),
                        pa.array(np.concatenate([np.ones(n, np.int64), many])),
                        pa.array(pad(np.diff(offsets) + 1, 0).astype(np.int64)),
                        *[pa.array(pad(s, 0.0)) for s in sums],
                    ],
                    names=["row", "doc_id", "word", "many", "n_tokens", "k", "b", "s"],
                )

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    parts = source.mapInArrow(run, "row bigint, doc_id bigint, word binary, many bigint, n_tokens bigint, k double, b double, s double")
    rare = counts.where(height < cut).mapInArrow(_scored(model), schema)
    joined = parts.join(rare, "word", "left")
    add = lambda own, other: F.sum(F.col(own) + F.coalesce(F.col("many") * F.col(other), F.lit(0.0)))
    return joined.groupBy("row").agg(
        F.max("doc_id").alias("doc_id"),
        F.sum("n_tokens").alias("n_tokens"),
        F.sum(F.col("k") + F.when(F.col("known"), F.col("many")).otherwise(0)).cast("long").alias("n_known"),
        add("b", "base").alias("base_score"),
        add("s", "score").alias("score"),
    ).drop("row")


def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score all documents; texts of fold 1 are never learned from."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = F.coalesce(fold(F.col("doc_id")) == 1, F.lit(False))
    model, counts = fit_model(docs, ~held)
    return score_texts(docs, model, counts).select("doc_id", held.alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")
