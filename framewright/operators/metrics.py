"""Classification metrics from (y_true, y_pred): one count per pair of classes, the rest is arithmetic on nine rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewright.schema import CLASS_NAMES, CLASSES

EPSILON = 1e-15


def confusion(pred: DataFrame, by: list[str] | None = None, classes: int = CLASSES) -> DataFrame:
    """(by..., y_true, y_pred, n) with every pair of classes, zero-filled."""
    by = by or []
    spark = pred.sparkSession
    grid = spark.range(classes).select(F.col("id").cast("int").alias("y_true")).join(spark.range(classes).select(F.col("id").cast("int").alias("y_pred")))
    counts = pred.groupBy(*by, "y_true", "y_pred").agg(F.count("*").alias("_n"))
    if by:
        grid = pred.select(*by).distinct().join(F.broadcast(grid))  # classes x classes rows
    return grid.join(counts, [*by, "y_true", "y_pred"], "left").select(*by, "y_true", "y_pred", F.coalesce("_n", F.lit(0)).cast("long").alias("n"))


def aligned(truth: DataFrame, pred: DataFrame, keys: list[str]) -> DataFrame:
    """Truth and prediction joined by key; ``side`` says where a row is: both, truth or prediction."""
    out = truth.withColumn("_t", F.lit(True)).join(pred.withColumn("_p", F.lit(True)), keys, "full")
    side = F.when(F.col("_t") & F.col("_p"), "both").when(F.col("_t"), "truth").otherwise("prediction")
    return out.withColumn("side", side).drop("_t", "_p")


def confusion_matrix(pred: DataFrame, classes: int = CLASSES) -> DataFrame:
    """One row a true class, one column a predicted class."""
    table = confusion(pred, classes=classes)
    return table.groupBy("y_true").pivot("y_pred", list(range(classes))).agg(F.first("n")).select("y_true", *[F.col(str(k)).alias(f"pred_{k}") for k in range(classes)])


def row_normalized(table: DataFrame) -> DataFrame:
    """Shares of each true class; the small constant keeps empty rows at zero."""
    total = table.groupBy("y_true").agg(F.sum("n").alias("_s"))
    return table.join(F.broadcast(total), "y_true").select("y_true", "y_pred", (F.col("n") / (F.col("_s") + 1e-8)).alias("share"))  # one row a class


def _safe(a: Column, b: Column) -> Column:
    return F.when(b == 0, F.lit(0.0)).otherwise(a / b)


def per_class(pred: DataFrame, by: list[str] | None = None, classes: int = CLASSES) -> DataFrame:
    """Precision, recall, f1 and support of each class; 0 where undefined.  ``seen``: in truth or prediction."""
    by = by or []
    t = confusion(pred, by, classes)
    cls = F.explode(F.array(F.col("y_true"), F.col("y_pred")))
    hit = F.sum(F.when(F.col("y_true") == F.col("y_pred"), F.col("n")).otherwise(0))
    true = t.groupBy(*by, F.col("y_true").alias("class")).agg(F.sum("n").alias("support"), hit.alias("hits"))
    said = t.groupBy(*by, F.col("y_pred").alias("class")).agg(F.sum("n").alias("predicted"))
    out = true.join(said, [*by, "class"])
    p, r = _safe(F.col("hits"), F.col("predicted")), _safe(F.col("hits"), F.col("support"))
    out = out.withColumn("precision", p).withColumn("recall", r)
    f1 = _safe(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
    return out.select(*by, "class", "precision", "recall", f1.alias("f1"), "support", (F.col("support") + F.col("predicted") > 0).alias("seen"), "hits")


def averages(pred: DataFrame, by: list[str] | None = None, classes: int = CLASSES) -> DataFrame:
    """Accuracy, macro averages over the classes seen, and support-weighted averages."""
    by = by or []
    rows = per_class(pred, by, classes)
    names = ("precision", "recall", "f1")
    macro = [F.avg(F.when(F.col("seen"), F.col(k))).alias(f"{k}_macro") for k in names]
    weighted = [_safe(F.sum(F.col(k) * F.col("support")), F.sum("support")).alias(f"{k}_weighted") for k in names]
    return rows.groupBy(*by).agg(_safe(F.sum("hits"), F.sum("support")).alias("accuracy"), *macro, *weighted, F.sum("support").alias("support"))


def log_loss(pred: DataFrame, probability: str = "probability", classes: int = CLASSES) -> DataFrame:
    """Mean -log p(true class); p is kept within 1e-15 of 0 and 1.  Null for hard predictions (no probabilities)."""
    p = F.get(F.col(probability), F.col("y_true"))
    return pred.agg((-F.avg(F.log(F.least(F.greatest(p, F.lit(EPSILON)), F.lit(1 - EPSILON))))).alias("log_loss"))


def report(pred: DataFrame, names: list[str] = CLASS_NAMES) -> DataFrame:
    """Long report: one row a class, then accuracy, macro and weighted averages."""
    if len(names) != CLASSES:
        raise ValueError("one name for each class is needed")
    label = F.get(F.array(*[F.lit(n) for n in names]), F.col("class"))
    rows = per_class(pred).select(label.alias("row"), "precision", "recall", "f1", "support")
    a = averages(pred)
    acc = a.select(F.lit("accuracy").alias("row"), F.col("accuracy").alias("precision"), F.col("accuracy").alias("recall"), F.col("accuracy").alias("f1"), "support")
    mac = a.select(F.lit("macro avg").alias("row"), *[F.col(f"{k}_macro").alias(k) for k in ("precision", "recall", "f1")], "support")
    wei = a.select(F.lit("weighted avg").alias("row"), *[F.col(f"{k}_weighted").alias(k) for k in ("precision", "recall", "f1")], "support")
    return rows.unionByName(acc).unionByName(mac).unionByName(wei)


def report_text(pred: DataFrame, names: list[str] = CLASS_NAMES) -> str:
    """The report as aligned text; a handful of rows."""
    rows = report(pred, names).collect()
    width = max(len(r["row"]) for r in rows)
    lines = [" " * width + "  precision  recall  f1-score  support"]
    return "\n".join(lines + [f"{r['row']:>{width}}  {r['precision']:9.4f}  {r['recall']:6.4f}  {r['f1']:8.4f}  {r['support']:7d}" for r in rows])
