"""Language of whole texts by a bidirectional gated recurrent network over bytes.

The lower-cased UTF-8 of a text is walked in segments of ``SEGMENT`` bytes, in
both directions; every byte gets class probabilities, and a document's are
their mean over all of its bytes.  Training takes windows of labelled documents
outside fold 0: of each language up to as many distinct texts as share
``SAMPLE_ROWS`` evenly (``LEAST`` at least), those with the smallest hash, so every
language is learned however rare it is.

Defined results: ``und`` with score 0 for null texts, texts without a letter,
and where no label was learned; texts of any length are walked whole, a group of
texts at a time; repeated rows get equal results; of classes that tie the first
by name is predicted; a null id is never held out and never learned from; an
empty table gives no rows.  Other columns are carried along; those named
``lang_pred`` and ``score`` are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framewright.llm.bigru import ByteGRU
from framewright.llm.common import fold, table, written
from framewright.llm.wordhash import groups

#: Labelled texts that the network is trained on, all languages together, the least of each language, and the characters taken of each.
SAMPLE_ROWS = 4_000
LEAST = 20
WINDOW = 96
WINDOWS = 2
SEGMENT = 256
STEPS = 260


def training_windows(docs: DataFrame, rows: int = SAMPLE_ROWS) -> pd.DataFrame:
    """(lang, cut): windows at places that a hash of the text chooses, of as many distinct texts of each language."""
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold(F.col("doc_id")) != 0))
    labelled = labelled.select("lang", F.lower("text").alias("text")).withColumn("h", F.xxhash64("text"))
    sizes = written(labelled.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")))
    each = max(LEAST, rows // max(sizes.count(), 1))
    # The cut leaves more than ``each`` hashes of every language, and few more, so that little meets in one task.
    below = F.col("h").cast("double") < 1.3 * each / F.col("n") * 2.0**64 - 2.0**63
    near = labelled.join(F.broadcast(sizes), "lang").where((F.col("n") <= 2 * each) | below)  # one row a language
    room = F.greatest(F.length("text") - WINDOW, F.lit(0)) + 1
    cuts = F.array(*[F.substring("text", (F.pmod(F.xxhash64("h", F.lit(k)), room) + 1).cast("int"), F.lit(WINDOW)) for k in range(WINDOWS)])
    one = near.select("lang", "h", cuts.alias("cuts")).groupBy("lang", "h").agg(F.min("cuts").alias("cuts"))
    few = one.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).where(F.col("rank") <= each)
    return few.select("lang", "h", F.posexplode("cuts").alias("k", "cut")).orderBy("h", "k", "lang").select("lang", "cut").toPandas()


def fit_languages(docs: DataFrame, rows: int = SAMPLE_ROWS) -> tuple[list[str], ByteGRU | None]:
    got = training_windows(docs, rows)
    got = got[got["cut"].str.contains(r"[^\W\d_]")] if len(got) else got
    names = sorted(got["lang"].unique()) if len(got) else []
    if not names:
        return [], None
    data = [c.encode()[:WINDOW] for c in got["cut"]]
    x, mask = np.full((WINDOW, len(data)), 32, np.int64), np.zeros((WINDOW, len(data)), np.float32)
    for i, b in enumerate(data):
        x[: len(b), i] = np.frombuffer(b, np.uint8)
        mask[: len(b), i] = 1
    network = ByteGRU(len(names))
    if len(names) > 1:
        network.fit(x, np.array([names.index(v) for v in got["lang"]]), mask, STEPS)
    return names, network


def probabilities(network: ByteGRU, texts: pa.Array) -> np.ndarray:
    """Mean class probabilities over all bytes of each text; zeros for an empty one."""
    lower = pc.utf8_lower(texts)
    size = np.asarray(pc.binary_length(lower)).astype(np.int64)
    data = np.frombuffer(b"".join(lower.cast(pa.large_binary()).to_pylist()) + b" ", np.uint8)
    first = np.cumsum(size) - size
    many = -(-size // SEGMENT)
    owner = np.repeat(np.arange(len(size)), many)
    inside = (np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many)) * SEGMENT
    total = network.pooled(data, first[owner] + inside, np.minimum(size[owner] - inside, SEGMENT))
    out = np.stack([np.bincount(owner, total[:, c], len(size)) for c in range(network.classes)], axis=1)
    return out / np.maximum(out.sum(axis=1, keepdims=True), 1e-30)


def predict_languages(docs: DataFrame, names: list[str], network: ByteGRU | None, text: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score for the whole of each text, in one pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best, score = [], []
            for _, part in groups(batch.column(batch.schema.names.index("_fw_text")), 4_000_000):
                letter = np.asarray(pc.match_substring_regex(part, r"\p{L}"))
                p = probabilities(network, part) if network else np.zeros((len(part), 1))
                best += [names[k] if ok and names else "und" for k, ok in zip(p.argmax(axis=1), letter)]
                score += np.where(letter & bool(names), p.max(axis=1), 0.0).tolist()
            rest = [batch.column(i) for i in range(batch.num_columns) if batch.schema.names[i] != "_fw_text"]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(best, pa.string()), pa.array(score, pa.float64())], names=[*[c for c in batch.schema.names if c != "_fw_text"], "lang_pred", "score"])

    kept = [f for f in docs.schema.fields if f.name not in ("lang_pred", "score")]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + ["lang_pred string", "score double"])
    return docs.select(*[f"`{f.name}`" for f in kept], F.col(text).cast("string").alias("_fw_text")).mapInArrow(run, schema)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document; languages of fold 0 are never read."""
    docs = table(spark, sf_dir, "documents")
    names, network = fit_languages(docs)
    out = predict_languages(docs.select("doc_id", "text").withColumn("held_out", F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False))), names, network)
    return out.select("doc_id", "held_out", "lang_pred", "score")
