"""Cross-fold summaries, comparison tables, and their text and chart forms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCORES = ["accuracy", "f1_macro", "precision_macro", "recall_macro"]
TIMES = ["training_time_sec", "inference_latency_ms", "inference_throughput_fps"]


def latency(df: DataFrame, seconds: str, samples: str) -> DataFrame:
    """Milliseconds a sample and samples a second; 0 where there is nothing to divide by."""
    s, n = F.col(seconds), F.col(samples)
    return df.withColumn("inference_latency_ms", F.when(n > 0, s / n * 1000).otherwise(0.0)).withColumn("inference_throughput_fps", F.when(s > 0, n / s).otherwise(0.0))


def cv_summary(results: DataFrame) -> DataFrame:
    """One row a model and subset: means and population deviations over folds, total times, the folds."""
    have = [c for c in (*SCORES, *TIMES) if c in results.columns]
    stats = [f(c).alias(f"{n}_{c}") for c in have for n, f in (("mean", F.avg), ("std", F.stddev_pop))]
    total = [F.sum(c).alias(f"total_{c}") for c in have if c == "training_time_sec"]
    return results.groupBy("model", "feature_subset").agg(F.count_distinct("fold").alias("num_folds_evaluated"), F.sort_array(F.collect_set("fold")).alias("fold_ids"), *stats, *total)


def benchmark_rows(summaries: DataFrame) -> DataFrame:
    """The comparison table: upper-case models, scores in percent, absent fields 0, sorted."""
    def field(name: str):
        return F.coalesce(F.col(name), F.lit(0.0)) if name in summaries.columns else F.lit(0.0)

    scores = [(100 * field(f"{n}_{c}")).alias(f"{n}_{c}") for c in SCORES for n in ("mean", "std")]
    return summaries.select(
        F.upper("model").alias("model"), "feature_subset", *scores,
        field("total_training_time_sec").alias("total_train_time_sec"), field("mean_inference_latency_ms").alias("mean_latency_ms"),
        field("std_inference_latency_ms").alias("std_latency_ms"), field("mean_inference_throughput_fps").alias("mean_throughput_fps"),
        F.coalesce(F.col("num_folds_evaluated"), F.lit(0)).alias("num_folds"),
    ).orderBy("model", "feature_subset")


def as_percent(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Score columns in percent: a column whose largest value is above 0 and at most 1 is a share.  Times are never rescaled."""
    tops = rows.agg(*[F.max(c).alias(f"_{c}") for c in columns])
    share = lambda c: (F.col(f"_{c}") > 0) & (F.col(f"_{c}") <= 1)
    out = rows.join(F.broadcast(tops))  # one row
    return out.select(*[F.when(share(c), 100 * F.col(c)).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in rows.columns])


def has_latency(rows: DataFrame) -> bool:
    """Whether a latency chart has anything to show."""
    return not rows.where("mean_latency_ms > 0").isEmpty()


def console_table(rows: DataFrame) -> str:
    """The comparison table as aligned text; models times subsets rows."""
    cells = [rows.columns, *[["" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v) for v in r] for r in rows.orderBy("model", "feature_subset").collect()]]
    width = [max(len(r[k]) for r in cells) for k in range(len(rows.columns))]
    return "\n".join("  ".join(v.rjust(w) for v, w in zip(r, width)) for r in cells) + "\n"


def pivot_metric(rows: DataFrame, metric: str, subsets: list[str]) -> DataFrame:
    """Models by subsets; a model and subset that occur twice are an error, absent ones null."""
    cell = F.when(F.count(metric) > 1, F.raise_error(F.lit("a model and subset occur twice"))).otherwise(F.first(metric))
    return rows.groupBy("model").pivot("feature_subset", subsets).agg(cell)


def fold_label(rows: DataFrame) -> DataFrame:
    """``k-Fold`` where all rows have k folds, else ``Mixed-Fold``."""
    counts = F.collect_set("num_folds")
    return rows.agg(F.when(F.size(counts) == 1, F.concat(F.element_at(counts, 1).cast("string"), F.lit("-Fold"))).otherwise("Mixed-Fold").alias("label"))


def markdown_rows(rows: DataFrame, names: DataFrame) -> DataFrame:
    """Table lines: mean and deviation with two decimals, latency with three; unknown subsets keep their name."""
    named = rows.join(F.broadcast(names.select(F.col("subset").alias("feature_subset"), "display_name")), "feature_subset", "left")  # the subsets table
    pm = lambda c: F.format_string("%.2f ± %.2f", f"mean_{c}", f"std_{c}")
    cells = ["model", F.coalesce("display_name", "feature_subset"), pm("accuracy"), pm("precision_macro"), pm("recall_macro"), pm("f1_macro"),
             F.format_string("%.2f", "total_train_time_sec"), F.format_string("%.3f ± %.3f", "mean_latency_ms", "std_latency_ms")]
    return named.select("model", "feature_subset", F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))


def markdown_table(rows: DataFrame, names: DataFrame) -> str:
    head = ["Model", "Feature Set", "Accuracy", "Precision", "Recall", "F1-Score", "Train Time (s)", "Latency (ms/seq)"]
    label = fold_label(rows).first()["label"]
    lines = [r["line"] for r in markdown_rows(rows, names).orderBy("model", "feature_subset").collect()]  # models x subsets
    return "\n".join([f"## {label} results", "", "| " + " | ".join(head) + " |", "|" + "---|" * len(head), *lines]) + "\n"


def bar_chart_data(rows: DataFrame, metrics: list[str]) -> DataFrame:
    """Long data of grouped bars; values are never rescaled, the unit is stated."""
    return rows.select("model", "feature_subset", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value"), F.lit("ms" if "latency" in m else "%").alias("unit")) for m in metrics])).alias("b")).select("model", "feature_subset", "b.*")


def learning_curve_data(history: DataFrame) -> DataFrame:
    """Long data of training and validation curves."""
    cols = ["loss", "accuracy", "val_loss", "val_accuracy"]
    return history.select("model", "feature_subset", "fold", "epoch", F.explode(F.array(*[F.struct(F.lit(c).alias("curve"), F.col(c).cast("double").alias("value")) for c in cols])).alias("p")).select("model", "feature_subset", "fold", "epoch", "p.*")


def top_importance(importance: DataFrame, n: int = 20) -> DataFrame:
    """The n largest importances: a top-k report."""
    return importance.orderBy(F.desc("importance"), "feature").limit(n)


def grid(models: DataFrame, subsets: DataFrame, folds: DataFrame) -> DataFrame:
    """Every experiment; all three tables are short dimension tables."""
    return models.select("model").join(subsets.select("subset")).join(folds.select("fold_id"))
