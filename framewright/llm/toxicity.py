"""Toxicity: boosted trees over dense text features, calibrated by isotonic regression.

Features of a text are sums over its words of properties that each distinct
word has once (lexicon weight, second person, capitals, punctuation,
obfuscation), plus how near lexicon words stand to the second person.  So a
worker computes a word's properties once and a text costs one lookup a word.

Training uses at most ``SAMPLE_ROWS`` labelled rows, those with the smallest
hash of their id, one of each set of equal texts.  A hash deals them into three
parts: lexicons of words and word beginnings are learned on the first, trees on
the second, calibration on the third, so no part sees what it has shaped.

Defined results: null and empty texts score by their (empty) features like any
other; texts of any length are scored whole, a group of texts at a time;
repeated rows score alike; an empty table gives no rows.  Where the sample has
labels of one class only, or nothing splits it, every text gets the smoothed
share of toxic labels; with no labels at all it gets ``NO_LABELS``.  A null id
is never held out and never learned from.  Labels that are null are left out;
of several labels of one id the largest counts; of equal texts the one of the
smallest id counts.  Other columns of the input are carried along by
:func:`score_toxicity`; one named like the score is replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.llm.common import fold, small_batches, smallest, table
from framewright.llm.gbt import BoostedTrees, Isotonic
from framewright.llm.wordhash import coded, groups

#: Labelled rows that the model is fitted on at most.
SAMPLE_ROWS = 24_576
#: Lexicon entries that are kept at most, those with the strongest evidence.
LEXICON_ENTRIES = 20_000
#: Texts of a class that a lexicon entry must stand in at least.
LEAST_TEXTS = 6
#: Distinct words whose properties a worker keeps.
MEMO_WORDS = 300_000
#: The score of every text where there are no labels to learn from.
NO_LABELS = 0.25
#: Bytes of text whose features are taken together; a longer text stands alone.
GROUP_BYTES = 3_000_000

# Second-person forms of the four languages.
SECOND_PERSON = "you your yours yourself u ur du dich dir dein deine tu te toi ton ta vous votre usted tus ti eres"
# Common insults, so that a model without labels of them still sees them.
INSULTS = "idiot moron stupid dumb loser scum trash garbage worthless pathetic disgusting clown fool jerk creep"
# Characters that stand in for letters.
LOOKALIKES = str.maketrans("013457@$!|", "oieastasil")

FEATURES = [
    "log_words", "strong", "middle", "weak", "weight", "most", "insults", "second", "near",
    "capitals", "all_caps", "marks", "exclaims", "digits", "obfuscated", "hidden", "hits",
]

_LETTERS = re.compile(r"[^\W\d_]+")
_HIDING = re.compile(r"[^\W\d_][\d@$!|*._-]+[^\W\d_]")


def entries(word: str) -> list[str]:
    """The lexicon entries that a word could match: itself and its beginnings."""
    return ["=" + word, *(word[:n] for n in (4, 5, 6, 7) if len(word) > n)]


def plain(token: str) -> list[str]:
    return _LETTERS.findall(token.lower())


@dataclass
class Toxicity:
    """A fitted model; small enough to travel inside a task."""

    lexicon: dict[str, float] = field(default_factory=dict)
    trees: BoostedTrees = field(default_factory=BoostedTrees)
    calibration: Isotonic | None = None

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "memo"}

    def weight(self, word: str) -> float:
        found = [self.lexicon[e] for e in entries(word) if e in self.lexicon]
        return max(found, default=0.0)

    def properties(self, token: str) -> list[float]:
        """Of one token: strong, middle, weak, weight, insult, second person, characters and obfuscation."""
        words = plain(token)
        weight = max((self.weight(w) for w in words), default=0.0)
        letters = sum(map(str.isalpha, token))
        upper = sum(map(str.isupper, token))
        hides = bool(_HIDING.search(token))
        bare = "".join(plain(token.translate(LOOKALIKES))) if hides else ""
        hidden = hides and (bare in _INSULTS or "=" + bare in self.lexicon)
        insult = any(w in _INSULTS for w in words)
        return [
            weight >= 4, 2 <= weight < 4, 0 < weight < 2, weight, insult, any(w in _SECOND for w in words), upper, letters,
            letters > 1 and upper == letters, len(token) - letters, token.count("!"), sum(map(str.isdigit, token)), hides, hidden, len(token),
        ]

    def features(self, texts: list[str | None] | pa.Array) -> np.ndarray:
        """One row of ``FEATURES`` for each text."""
        if not hasattr(self, "memo"):
            self.memo, self.rows = {}, np.zeros((1024, 15), dtype=np.float32)
        codes, offsets, distinct = coded(pc.fill_null(pa.array(texts, pa.large_string()) if isinstance(texts, list) else texts.cast(pa.large_string()), ""))
        new = [w for w in distinct if w not in self.memo]
        if len(self.memo) + len(new) > MEMO_WORDS:
            self.memo.clear()
            new = distinct
        need = len(self.memo) + len(new)
        if need > len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros((max(need, len(self.rows) * 3 // 2) - len(self.rows), 15), dtype=np.float32)])
        for w in new:
            self.rows[len(self.memo)] = self.properties(w.decode())
            self.memo[w] = len(self.memo)
        place = np.fromiter(map(self.memo.__getitem__, distinct), np.int64, len(distinct))
        out = np.zeros((len(offsets) - 1, len(FEATURES)))
        for i, (first, last) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
            if first == last:
                continue
            n = last - first
            got = self.rows[place[codes[first:last]]]
            total = got.sum(axis=0, dtype=np.float64)
            at, you = np.flatnonzero((got[:, 3] >= 2) | (got[:, 4] > 0)), np.flatnonzero(got[:, 5])
            near = 0
            if len(at) and len(you):
                k = np.searchsorted(you, at)
                gap = np.minimum(np.abs(at - you[np.minimum(k, len(you) - 1)]), np.abs(at - you[np.maximum(k - 1, 0)]))
                near = int((gap <= 4).sum())
            out[i] = [
                np.log1p(n), total[0] / n, total[1] / n, total[2] / n, total[3] / n, got[:, 3].max(), total[4] / n, total[5] / n, near / n,
                total[6] / max(total[7], 1), total[8] / n, total[9] / max(total[14], 1), total[10] / n, total[11] / max(total[14], 1),
                total[12] / n, total[13] / n, np.log1p(total[0]),
            ]
        return out

    def score(self, texts: list[str | None] | pa.Array) -> np.ndarray:
        raw = self.trees.decision(self.features(texts))
        return self.calibration(raw) if self.calibration else 1 / (1 + np.exp(-raw))


_INSULTS, _SECOND = frozenset(INSULTS.split()), frozenset(SECOND_PERSON.split())


def training_rows(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """At most ``rows`` labelled training rows: part (0 to 9), text, toxic.

    The labels' ids alone are ranked; the ids taken are at most ``rows``, so
    sending them to the readers of ``documents`` is bounded and moves no text.
    """
    known = (
        labels.select(F.col("doc_id").alias("_id"), F.col("toxic").cast("int").alias("toxic"))
        .where((fold(F.col("_id")) != 0) & F.col("toxic").isNotNull())
        .groupBy("_id")
        .agg(F.max("toxic").alias("toxic"))
    )
    taken = F.broadcast(smallest(known, F.col("_id"), rows))
    found = docs.select(F.col("doc_id").alias("_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(taken, "_id")
    one = found.groupBy(F.xxhash64("text").alias("_h")).agg(F.min_by(F.struct("text", "toxic", "_id"), "_id").alias("r"))
    return one.select(F.pmod(F.xxhash64(F.lit(8), "r._id"), F.lit(10)).cast("int").alias("part"), "r.text", "r.toxic")


def learn_lexicon(rows: DataFrame) -> dict[str, float]:
    """Words and beginnings of words that stand in toxic texts far more often than in others: entry -> log odds."""

    def seen(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for first in range(0, len(pdf), 200):
                count: dict[str, list[int]] = {}
                for text, toxic in zip(pdf["text"][first : first + 200], pdf["toxic"][first : first + 200]):
                    for e in {e for w in set(plain(text)) for e in entries(w)}:
                        count.setdefault(e, [0, 0])[int(toxic)] += 1
                yield pd.DataFrame([(e, a, b) for e, (a, b) in count.items()], columns=["entry", "clean", "toxic"])

    n = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("bad")).first()
    bad, good = n["bad"], n["n"] - n["bad"]
    if not bad or not good:
        return {}
    found = rows.mapInPandas(seen, "entry string, clean bigint, toxic bigint").groupBy("entry").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    odds = F.log((F.col("toxic") + 0.5) / (bad + 1)) - F.log((F.col("clean") + 0.5) / (good + 1))
    kept = found.where(F.col("toxic") >= LEAST_TEXTS).select("entry", odds.alias("odds")).where("odds > 1")
    return {r["entry"]: float(r["odds"]) for r in kept.orderBy(F.desc("odds"), "entry").limit(LEXICON_ENTRIES).collect()}


def fit_toxicity(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Toxicity:
    """Fit on a bounded sample of the labelled rows outside fold 0."""
    small_batches(docs.sparkSession)
    sample = training_rows(docs, labels, rows).cache()
    n, bad = sample.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    model = Toxicity(lexicon=learn_lexicon(sample.where("part < 5")))

    def measured(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for first, part in groups(pa.array(pdf["text"], pa.string()), GROUP_BYTES):
                own = pdf.iloc[first : first + len(part)]
                yield pd.DataFrame({"part": own["part"], "toxic": own["toxic"], "x": list(model.features(part))})

    got = sample.where("part >= 5").mapInPandas(measured, "part int, toxic int, x array<double>").orderBy("part", "toxic", "x").toPandas()
    sample.unpersist()
    x = np.array(got["x"].tolist()).reshape(-1, len(FEATURES))
    y, part = got["toxic"].to_numpy(dtype=float), got["part"].to_numpy()
    model.trees.fit(x[part < 8], y[part < 8])
    if not any((feature >= 0).any() for feature, _, _ in model.trees.forest):  # nothing was learned from texts
        share = (bad + 0.5) / (n + 1.0) if n else NO_LABELS
        model.trees.forest, model.trees.prior = [], float(np.log(share / (1 - share)))
    held = part >= 8
    if held.any() and model.trees.forest:
        model.calibration = Isotonic().fit(model.trees.decision(x[held]), y[held])
    return model


def score_toxicity(docs: DataFrame, model: Toxicity, text: str = "text", into: str = "score") -> DataFrame:
    """``docs`` with a score from 0 to 1 for the whole of each text, in one pass."""

    @F.arrow_udf("double")
    def score(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in parts:
            found = [model.score(part) for _, part in groups(texts, GROUP_BYTES)]
            yield pa.array(np.concatenate(found) if found else [], pa.float64())

    return docs.withColumn(into, score(F.col(text).cast("string")))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score every document; labels of fold 0 are never read."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_toxicity(docs, table(spark, sf_dir, "labels"))
    return score_toxicity(docs, model).select(
        "doc_id", F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
