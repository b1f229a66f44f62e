"""The corpus pipeline: five stages over ``documents``, each on all that the one before kept.

Each stage is ``(spark, docs, sf_dir) -> DataFrame``; all but the last return the
columns of ``docs``.  :func:`run` writes each stage's result as Parquet in the
shared folder and hands the reread table to the next.

The near-duplicate stage takes five-word shingles and four fifths, as all stages
on word shingles do unless told otherwise.

Defined results: a null or empty text passes every stage unchanged; texts of any
length are taken whole; rows with a null id are never duplicates of anything;
of equal rows and of each group the smallest id stays, rows that share it with
it; an empty table gives an empty result.  Other columns are carried to the last
stage; names that begin with ``_fw_`` are reserved.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.llm.common import table, written
from framewright.llm.minhash import near_duplicates
from framewright.llm.packing import pack, placed
from framewright.llm.pii import query_key, replace_entities
from framewright.llm.substring import remove_repeats
from framewright.llm.toxicity import fit_toxicity, score_toxicity


def _own(docs: DataFrame) -> list[str]:
    return [f"`{c}`" for c in docs.columns]


def _sized(docs: DataFrame) -> DataFrame:
    """Bring ``n_chars`` in line with a changed text, where the table has it."""
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents whose calibrated probability of toxicity is one half or more."""
    model = fit_toxicity(docs, table(spark, sf_dir, "labels"))
    return score_toxicity(docs, model, into="_fw_score").where("_fw_score < 0.5").select(*_own(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the smallest id of each group of documents that share four fifths of their five-word shingles."""
    found = near_duplicates(docs.select("doc_id", "text")).where("not kept").select(F.col("doc_id").alias("_fw_gone")).distinct()
    one = docs.join(found, F.col("doc_id") == F.col("_fw_gone"), "left_anti")
    return one.select(*_own(docs))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut passages of 13 words or more that a document with a smaller id holds."""
    out = remove_repeats(docs, prefix="_fw_").withColumn("text", F.when(F.col("_fw_n_removed") > 0, F.col("_fw_kept_text")).otherwise(F.col("text")))
    return _sized(out.select(*_own(docs)))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data by surrogates under the session's key."""
    return _sized(replace_entities(docs, query_key(spark)).select(*_own(docs)))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the tokens of all documents into sequences; one row per piece."""
    return placed(pack(docs.select("doc_id", "text")))


STAGES = [
    ("toxicity", toxicity),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("pii", pii),
    ("packing", packing),
]

#: SQL cannot express the learned and hashed stages; tests/llm holds each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents`` of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
