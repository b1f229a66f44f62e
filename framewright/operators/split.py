"""Subject-disjoint folds: split assignment, circular validation fold, leak checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def next_folds(df: DataFrame, fold: str = "fold_id") -> DataFrame:
    """Each fold that is present and the next one present, wrapping to the first."""
    distinct = df.select(fold).distinct()
    order = Window.orderBy(fold)  # a handful of rows: the distinct folds
    following = F.coalesce(F.lead(fold).over(order), F.first(fold).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return distinct.select(fold, following.alias("next_fold"))


def circular_fold(fold: Column, folds: int = 5) -> Column:
    """The next fold of a full set, the first after the last, whether present or not."""
    return fold % folds + 1


def split_column(test_fold: int, val_fold: int, fold: str = "fold_id") -> Column:
    return F.when(F.col(fold) == test_fold, "test").when(F.col(fold) == val_fold, "val").otherwise("train")


def fold_split(df: DataFrame, test_fold: int, val_fold: int | None = None, classes: int = 3, fold: str = "fold_id", label: str = "label") -> DataFrame:
    """``df`` with a ``split`` column; raises where a split could not be evaluated.

    The check runs at once: one row a fold reaches the driver.  Where the folds
    are known, :func:`split_column` alone is lazy.
    """
    present = {r[0]: r[1] for r in df.groupBy(fold).agg(F.sort_array(F.collect_set(label))).collect()}  # one row a fold
    folds = sorted(present)
    if not 1 <= test_fold <= 5:
        raise ValueError(f"test fold {test_fold} is out of range 1 to 5")
    if test_fold not in present:
        raise ValueError(f"test fold {test_fold} is not present; folds: {folds}")
    if len(folds) < 3:
        raise ValueError(f"three folds are needed, found {folds}")
    if val_fold is None:
        val_fold = folds[(folds.index(test_fold) + 1) % len(folds)]
    if val_fold not in present:
        raise ValueError(f"validation fold {val_fold} is not present; folds: {folds}")
    if val_fold == test_fold:
        raise ValueError("validation and test fold are the same")
    for name, mine in (("train", [f for f in folds if f not in (test_fold, val_fold)]), ("val", [val_fold]), ("test", [test_fold])):
        got = sorted({v for f in mine for v in present[f]})
        if got != list(range(classes)):
            raise ValueError(f"{name} split holds labels {got}, not all of 0 to {classes - 1}")
    return df.withColumn("split", split_column(test_fold, val_fold, fold))


def leaking_subjects(df: DataFrame, subject: str = "subject_id", fold: str = "fold_id") -> DataFrame:
    """Subjects in more than one fold: none is right."""
    found = df.groupBy(subject).agg(F.sort_array(F.collect_set(fold)).alias("folds"))  # at most the number of folds each
    return found.where(F.size("folds") != 1)


def overlap(a: DataFrame, b: DataFrame, subject: str = "subject_id") -> DataFrame:
    return a.select(subject).intersect(b.select(subject))


def stratified(df: DataFrame, label: str, key: str, shares: tuple[float, float] = (0.8, 0.1), seed: int = 42) -> DataFrame:
    """Exact shares of each label by a seeded hash order of the key: train, val, test.

    The rank of a row is its rank among those of its label with the same top
    twelve bits of the hash, plus all of the label below them: a label is dealt
    to 4096 windows, and only their counts are summed in order.
    """
    ordered = df.withColumn("_h", F.xxhash64(F.col(key), F.lit(seed))).withColumn("_p", F.shiftright("_h", 52))
    local = ordered.withColumn("_i", F.row_number().over(Window.partitionBy(label, "_p").orderBy("_h", key)))
    sizes = ordered.groupBy(label, "_p").agg(F.count("*").alias("_m"))
    w = Window.partitionBy(label).orderBy("_p")  # at most 4096 rows a label
    before = sizes.select(label, "_p", (F.sum("_m").over(w) - F.col("_m")).alias("_before"), F.sum("_m").over(Window.partitionBy(label)).alias("_n"))
    at = (F.col("_before") + F.col("_i") - 1) / F.col("_n")
    return local.join(before, [label, "_p"]).withColumn("split", F.when(at < shares[0], "train").when(at < shares[0] + shares[1], "val").otherwise("test")).drop("_h", "_p", "_i", "_before", "_n")
