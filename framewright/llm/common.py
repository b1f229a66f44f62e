"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The bytes that separate words, U+0020 and U+0009 to U+000D.
SPACES = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table; any store that Spark can read will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder below the shared checkpoint folder that the session names.

    ``spark.checkpoint.dir`` is read from the session.  Only where it is unset
    on one machine (tests) a temporary folder is made and used instead; on a
    cluster that is an error, since machines do not share such folders.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines of the cluster share")
        root = "file://" + tempfile.mkdtemp(prefix="framewright-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(root)
    return os.path.join(root, f"fw-{uuid.uuid4().hex}")


#: Rows of texts that a Python worker is sent at a time.
BATCH_ROWS = 1_500


def small_batches(spark: SparkSession) -> None:
    """Send workers texts in small batches: they and the executor hold several copies of each.

    The setting is the session's (plans are lazy and read it when they run) and
    changes no result; a smaller one stays as it is.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def written(df: DataFrame) -> DataFrame:
    """Cut the lineage: write ``df`` once to the shared folder and read it back.

    Later readers do not repeat the work, and a lost executor costs nothing.
    """
    spark = df.sparkSession
    path = shared_dir(spark)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._fw_folder = path
    return out


def forget(df: DataFrame) -> None:
    """Delete what :func:`written` wrote for ``df``, once nothing will read it again."""
    folder = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._fw_folder)
    folder.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(folder, True)


#: A key that more than 1/HOT_SHARE of the rows hold is hot, so fewer than HOT_SHARE keys are.
HOT_SHARE = 1_000
#: Parts that the rows of a hot key are dealt to.
HOT_PARTS = 64


def salted_join(left: DataFrame, right: DataFrame, keys: list[str], row: list[str], how: str = "inner", total: int | None = None) -> DataFrame:
    """``left`` joined to ``right`` (one row a key) on ``keys``, hot keys of ``left`` dealt to several tasks.

    Keys are counted with partial aggregation.  The rows of a hot key are dealt
    by a hash of their ``row`` columns, and the key's one row of ``right`` is copied
    to each part.  Only the hot keys' hashes are broadcast, fewer than
    ``HOT_SHARE`` longs; a key that shares a hash with a hot one is salted too,
    which changes nothing.  ``total`` spares a count where it is known.
    """
    counts = left.groupBy(F.xxhash64(*keys).alias("k")).agg(F.count("*").alias("n"))
    total = left.count() if total is None else total
    least = max(total // HOT_SHARE, HOT_PARTS)
    hot = [r["k"] for r in counts.where(F.col("n") > least).collect()]  # fewer than HOT_SHARE
    if not hot:
        return left.join(right, keys, how)
    is_hot = F.xxhash64(*keys).isin(hot)
    dealt = left.withColumn("_fw_salt", F.when(is_hot, F.pmod(F.xxhash64(F.lit(7), *row), F.lit(HOT_PARTS))).otherwise(0).cast("int"))
    copies = F.when(is_hot, F.sequence(F.lit(0), F.lit(HOT_PARTS - 1))).otherwise(F.array(F.lit(0)))
    return dealt.join(right.withColumn("_fw_salt", F.explode(copies)), [*keys, "_fw_salt"], how).drop("_fw_salt")


def words_of(text: Column) -> Column:
    r"""Array of the words ``[^\x20\x09-\x0D]+`` of a text; null gives an empty array."""
    flat = F.translate(F.coalesce(text, F.lit("")), "\t\n\x0b\x0c\r", "     ")
    return F.array_remove(F.split(flat, " "), "")


def fold(doc_id: Column, parts: int = 5) -> Column:
    """crc32 of the id as text, modulo ``parts``: the held-out folds of the contracts."""
    return F.crc32(doc_id.cast("string").cast("binary")) % parts


def smallest(df: DataFrame, key: Column, rows: int) -> DataFrame:
    """A bounded, repeatable sample: at most ``rows`` rows, those with the smallest hashes of ``key``.

    A first count sets a cut with about ``rows`` hashes below it and six standard
    deviations to spare, so that what meets in one task at the end is of that
    size and not that many a partition.
    """
    n = df.select(key.alias("k")).count()
    below = rows + 6 * rows**0.5 + 10
    if n > 2 * below:
        df = df.where(F.xxhash64(key) < F.lit(int(below / n * 2**64) - 2**63))
    return df.orderBy(F.xxhash64(key), key).limit(rows)
