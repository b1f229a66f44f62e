"""Integrity rules over frames and windows, in one aggregate pass per table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.operators.frames import is_finite, is_padding
from framewright.schema import CLASSES, FEATURES, FOLDS

#: Subjects that an error names; it states the number of all.
LISTED = 20
PADDING_ERROR, PADDING_WARNING, PADDING_ABORT = 0.99, 0.20, 0.50


def feature_ranges(frames: DataFrame) -> DataFrame:
    """One row: minimum and maximum of each feature over frames that a window holds."""
    used = frames.where("mult > 0")
    return used.agg(*[f(c).alias(f"{c}_{n}") for c in FEATURES for n, f in (("min", F.min), ("max", F.max))])


def padding_rate(frames: DataFrame) -> DataFrame:
    """One row: share of padding among frames and among window timesteps."""
    pad = is_padding().cast("int")
    return frames.agg(F.avg(pad).alias("frame_rate"), (F.sum(pad * F.col("mult")) / F.sum("mult")).alias("timestep_rate"))


def label_counts(df: DataFrame, label: str = "label", n: str = "n", classes: int = CLASSES) -> DataFrame:
    """Rows of each class, zero for absent ones, and their percentage."""
    spark = df.sparkSession
    domain = spark.range(classes).select(F.col("id").cast("int").alias(label))
    counts = df.groupBy(label).agg(F.sum(n).alias("count"))
    out = F.broadcast(domain).join(counts, label, "left").select(label, F.coalesce("count", F.lit(0)).cast("long").alias("count"))  # one row a class
    total = out.agg(F.sum("count").alias("total"))
    return out.join(F.broadcast(total)).select(label, "count", F.when(F.col("total") == 0, 0.0).otherwise(100.0 * F.col("count") / F.col("total")).alias("percent"))


def missing_folds(df: DataFrame, fold: str = "fold_id") -> DataFrame:
    spark = df.sparkSession
    return spark.range(1, FOLDS + 1).select(F.col("id").cast("int").alias(fold)).join(df.select(fold).distinct(), fold, "left_anti")


def check(frames: DataFrame, max_padding_rate: float | None = None, length: int = 30) -> dict:
    """Gather every violation, then raise once; returns the summary.

    ``frames`` has features, video_id, label, subject_id, fold_id and ``mult``, the
    number of windows of ``length`` frames that hold a frame; frames of no window
    do not count.  One row of totals reaches the driver, and of subjects in
    several folds their number and the first ``LISTED``.
    """
    if max_padding_rate is not None and not 0 <= max_padding_rate <= 1:
        raise ValueError("max_padding_rate must lie between 0 and 1")
    m = F.col("mult")
    bad = F.lit(False)
    for c in FEATURES:
        bad = bad | F.col(c).isNull() | ~is_finite(F.col(c))
    # A window is ``length`` timesteps, and sums of mult are timesteps.
    used = frames.where("mult > 0")
    windows = lambda c, k: F.coalesce(F.sum(F.when(F.col(c) == k, m)), F.lit(0)) / length
    row = used.agg(
        *[F.coalesce(F.sum(F.col(c).isNull().cast("int")), F.lit(0)).alias(f"no_{c}") for c in ("label", "subject_id", "fold_id")],
        *[windows("label", k).cast("long").alias(f"class_{k}") for k in range(CLASSES)],
        *[windows("fold_id", k).cast("long").alias(f"fold_{k}") for k in range(1, FOLDS + 1)],
        F.coalesce(F.sum(m), F.lit(0)).alias("timesteps"), F.coalesce(F.sum(is_padding().cast("int") * m), F.lit(0)).alias("padding"),
        F.max(bad).alias("bad"), F.min("subject_id").alias("low_subject"), F.count_distinct("subject_id").alias("subjects"),
        F.sort_array(F.collect_set("label")).alias("labels"), F.sort_array(F.collect_set("fold_id")).alias("folds"),
        *[f(c).alias(f"{c}_{n}") for c in FEATURES for n, f in (("min", F.min), ("max", F.max))],
    ).first()
    errors, warnings = [], []
    if not row["timesteps"]:
        errors.append("dataset has no samples")
    wrong = [v for v in row["labels"] if not 0 <= v < CLASSES]
    if wrong:
        errors.append(f"labels out of range: {wrong}")
    if len(row["folds"]) < 3:
        errors.append(f"at least three folds are needed, found {row['folds']}")
    if missing := {c: row[f"no_{c}"] for c in ("label", "subject_id", "fold_id") if row[f"no_{c}"]}:
        errors.append(f"frames without ids: {missing}")
    leaks = used.where("subject_id is not null").groupBy("subject_id").agg(F.count_distinct("fold_id").alias("n")).where("n > 1")
    if found := leaks.count():
        first = [r["subject_id"] for r in leaks.orderBy("subject_id").limit(LISTED).collect()]  # a report
        errors.append(f"{found} subjects in multiple folds, the first: {first}")
    if wrong := [f for f in row["folds"] if not 1 <= f <= FOLDS]:
        errors.append(f"folds out of range: {wrong}")
    if row["low_subject"] is not None and row["low_subject"] < 1:
        errors.append("subject ids must be positive")
    if row["bad"]:
        errors.append("features hold NaN, infinite or missing values")
    constant = [i for i, c in enumerate(FEATURES) if row[f"{c}_min"] == row[f"{c}_max"]]
    if row["timesteps"] and len(constant) == len(FEATURES):
        errors.append("all features are constant")
    elif constant and row["timesteps"]:
        warnings.append(f"constant features: {constant}")
    rate = row["padding"] / row["timesteps"] if row["timesteps"] else 0.0
    if rate >= PADDING_ERROR:
        errors.append(f"padding rate {rate:.3f}")
    elif rate > PADDING_WARNING:
        warnings.append(f"padding rate {rate:.3f} is above {PADDING_WARNING}")
    if max_padding_rate is not None and rate > max_padding_rate:
        errors.append(f"padding rate {rate:.3f} is above the limit {max_padding_rate}")
    if errors:
        raise ValueError("Dataset integrity check failed: " + "; ".join(errors))
    return {
        "num_samples": row["timesteps"] // length, "class_counts": {k: row[f"class_{k}"] for k in range(CLASSES)}, "fold_counts": {k: row[f"fold_{k}"] for k in range(1, FOLDS + 1)},
        "timesteps": row["timesteps"], "num_subjects": row["subjects"], "available_folds": row["folds"], "labels": row["labels"], "padding_rate": rate,
        "feature_min": [row[f"{c}_min"] for c in FEATURES], "feature_max": [row[f"{c}_max"] for c in FEATURES], "warnings": warnings,
    }
