"""Sources and sinks: frames as partitioned Parquet, archives of arrays, JSON summaries."""

from __future__ import annotations

import os
import warnings

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_frames(frames: DataFrame, path: str) -> None:
    """Frames, not windows: a window repeats each frame; folds are partitions, so splits prune."""
    frames.repartition("fold_id", "video_id").write.mode("overwrite").partitionBy("fold_id").parquet(path)


def read_frames(spark: SparkSession, path: str) -> DataFrame:
    """Frames from Parquet; other formats are refused with a reason."""
    check_suffix(path)
    return spark.read.parquet(path)


def check_suffix(path: str) -> None:
    suffix = os.path.splitext(path.rstrip("/"))[1].lower()
    if suffix == ".npy":
        raise ValueError(f"{path}: arrays without subjects and folds cannot support leakage-safe evaluation")
    if suffix not in ("", ".parquet", ".npz"):
        raise ValueError(f"{path}: unknown format {suffix!r}")


def read_archive(spark: SparkSession, path: str, rows: int = 1024) -> DataFrame:
    """Windows of a local ``.npz`` with members X, y, folds, subjects.

    An archive is one file on one machine; it is sent in slices of ``rows``
    windows, and Parquet is the form for anything larger.
    """
    import numpy as np

    check_suffix(path)
    with np.load(path) as data:
        x, y, folds, subjects = (data[k] for k in ("X", "y", "folds", "subjects"))
    if x.ndim != 3:
        raise ValueError("X must have three axes")
    if x.shape[2] != 5:
        raise ValueError("X must have five features")
    if not len(x) == len(y) == len(folds) == len(subjects):
        raise ValueError("X, y, folds and subjects differ in length")
    schema = "window_id int, x array<array<float>>, label int, subject_id int, fold_id int"
    parts = [
        spark.createDataFrame([(k, x[k].tolist(), int(y[k]), int(subjects[k]), int(folds[k])) for k in range(at, min(at + rows, len(x)))], schema)
        for at in range(0, len(x), rows)
    ] or [spark.createDataFrame([], schema)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def write_archive(windows: DataFrame, path: str) -> None:
    """The same archive, written by the driver, which holds all of it: for data of one machine.  Parquet is the form for more."""
    import numpy as np

    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    order = [c for c in ("video_id", "window_id") if c in windows.columns]
    rows = windows.orderBy(*order).select("x", "label", "fold_id", "subject_id").collect()
    np.savez_compressed(
        path, X=np.array([r["x"] for r in rows], np.float32), y=np.array([r["label"] for r in rows], np.int32),
        folds=np.array([r["fold_id"] for r in rows], np.int32), subjects=np.array([r["subject_id"] for r in rows], np.int32),
    )


def read_summaries(spark: SparkSession, folder: str) -> DataFrame:
    """All ``*_cv_summary.json`` of a folder; files that are no JSON are left out with a warning that names them."""
    found = spark.read.option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(f"{folder}/*_cv_summary.json")
    if "_corrupt_record" in found.columns:
        named = found.select("*", F.col("_metadata.file_name").alias("_name")).cache()  # a folder of summaries; Spark asks for it to read the corrupt column alone
        bad = [r["_name"] for r in named.where(F.col("_corrupt_record").isNotNull()).select("_name").distinct().collect()]  # one row a bad file of a folder of summaries
        if bad:
            warnings.warn(f"no JSON, left out: {sorted(bad)}", stacklevel=2)
        found = named.where(F.col("_corrupt_record").isNull()).drop("_corrupt_record", "_name")
    return found


def read_summary(path: str) -> dict:
    """One summary that :func:`write_summary` wrote."""
    import json

    with open(path, encoding="utf-8") as f:
        return json.load(f)


def write_text(text: str, path: str) -> None:
    """A report (Markdown, console table) as a file."""
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)


def write_summary(summary: dict, path: str) -> None:
    """One summary as JSON, indented, not escaped."""
    import json

    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        json.dump(summary, f, indent=4, ensure_ascii=False)
