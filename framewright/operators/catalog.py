"""Video catalogue: discovery of files and what their paths say."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.functions.scalar import clamp
from framewright.schema import FOLDS, SUBJECTS_PER_FOLD, VIDEO_SUFFIXES


def find_videos(spark: SparkSession, *roots: str) -> DataFrame:
    """Distinct, sorted paths below the roots; suffixes in lower or upper case only.

    An empty result is an error.  Only names are read, never contents.
    """
    glob = "*.{" + ",".join(s[1:] for v in VIDEO_SUFFIXES for s in (v, v.upper())) + "}"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(list(roots))
    found = files.select("path").dropDuplicates(["path"]).orderBy("path")
    if found.isEmpty():
        raise FileNotFoundError(f"no video below {', '.join(roots)}")
    return found


def _stem(path: Column) -> Column:
    return F.lower(F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", ""))


def label_of(path: Column) -> Column:
    """0, 1 or 2 by a leading code in the name, else by a word in it; null: no label."""
    stem = _stem(path)
    code = F.regexp_extract(stem, r"^(10|5|0)(?=$|[._\-\s(])", 1)
    return (
        F.when(code == "0", 0).when(code == "5", 1).when(code == "10", 2)
        .when(stem.contains("alert"), 0)
        .when(stem.contains("low") | stem.contains("vigilant"), 1)
        .when(stem.contains("drowsy"), 2)
    )


def subject_of(path: Column) -> Column:
    """Nearest directory with a number from 1 to 60 that is no fold; else sub<number> in the name."""
    # The first number of every directory whose name does not hold "fold", in one pass over the path.
    numbers = F.regexp_extract_all(path, F.lit(r"(?:^|(?<=/))(?![^/]*(?i:fold)[^/]*/)[^/\d]*(\d+)[^/]*/"), F.lit(1))
    near = F.try_element_at(F.filter(numbers, lambda v: v.try_cast("bigint").between(1, FOLDS * SUBJECTS_PER_FOLD)), F.lit(-1)).try_cast("bigint")
    named = F.regexp_extract(_stem(path), r"sub(?:ject)?[_-]?(\d+)", 1).try_cast("bigint")
    return F.coalesce(near, named).cast("int")


def fold_of(path: Column, subject: Column) -> Column:
    """Leftmost fold<1-5> anywhere in the path, else by the subject's range, clamped."""
    named = F.regexp_extract(F.regexp_replace(path, r"\\", "/"), r"(?i)fold[_-]?([1-5])", 1).try_cast("int")
    return F.coalesce(named, clamp(F.floor((subject - 1) / SUBJECTS_PER_FOLD) + 1, 1, FOLDS).cast("int"))


def parse_paths(paths: DataFrame, path: str = "path") -> DataFrame:
    """Catalogue rows; paths without a label or a subject are dropped.

    ``warnings`` flags a subject that only the name gives and that is out of range.
    """
    p = F.col(path)
    # A generator of one row: label and subject are worked out once, not again in every later expression.
    out = paths.select(F.inline(F.array(F.struct(p.alias("video_path"), label_of(p).alias("label"), subject_of(p).alias("subject_id")))))
    out = out.where("label is not null and subject_id is not null")
    return out.select(
        "label", "subject_id", fold_of(F.col("video_path"), F.col("subject_id")).alias("fold_id"), "video_path",
        F.element_at(F.split("video_path", "/"), -1).alias("filename"),
        F.when(F.col("subject_id") > FOLDS * SUBJECTS_PER_FOLD, "subject out of range").alias("warnings"),
    )


def video_status(videos: DataFrame, frames: DataFrame, length: int, key: str = "video_id") -> DataFrame:
    """``videos`` with ``status``: processed, short (fewer than ``length`` frames) or skipped (none: no label, not opened, failed)."""
    n = frames.groupBy(key).agg(F.count("*").alias("n_frames"))
    out = videos.join(n, key, "left").withColumn("n_frames", F.coalesce("n_frames", F.lit(0)))
    return out.withColumn("status", F.when(F.col("n_frames") == 0, "skipped").when(F.col("n_frames") < length, "short").otherwise("processed"))


def with_fold(df: DataFrame, folds: DataFrame, subject: str = "subject_id") -> DataFrame:
    """Subject to fold as a range join with the five-row table of folds."""
    return df.join(F.broadcast(folds), F.col(subject).between(F.col("lo"), F.col("hi"))).drop("lo", "hi")
