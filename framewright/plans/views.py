"""Views of the star-schema tables as frame streams, predictions, landmarks and paths."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.functions.scalar import arg_max, softmax
from framewright.operators.frames import numbered, sentinel
from framewright.schema import FEATURES


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value", "props")
    lost = F.col("event_type") == "error"
    seen = [F.col("value") / 100, F.get_json_object("props", "$.k").cast("double"), F.minute("ts"), F.hour("ts"), F.dayofmonth("ts")]
    cols = [F.when(lost, v).otherwise(x.cast("float")).alias(c) for c, x, v in zip(FEATURES, seen, sentinel())]
    return e.select(
        "event_id", "ts", "user_id", *cols,
        (F.pmod(F.col("user_id") * 7, F.lit(60)) + 1).cast("int").alias("subject_id"),
        (F.expr("((user_id * 7) % 60) div 12") + 1).cast("int").alias("fold_id"),
    )


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three short videos a user, by label."""
    e = _events(spark, sf_dir).withColumn("label", (F.col("event_id") % 3).cast("int"))
    e = e.withColumn("video_id", F.concat_ws("-", "user_id", "label"))
    return numbered(e, "video_id", ["ts", "event_id"]).select("video_id", "frame_idx", *FEATURES, "label", "subject_id", "fold_id")


def streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One long video a user."""
    e = _events(spark, sf_dir).withColumn("label", (F.col("user_id") % 3).cast("int")).withColumn("video_id", F.col("user_id").cast("string"))
    return numbered(e, "video_id", ["ts", "event_id"]).select("video_id", "frame_idx", *FEATURES, "label", "subject_id", "fold_id")


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, y_true, probabilities and their first maximum."""
    e = table(spark, sf_dir, "embeddings")
    logits = F.transform(F.slice("embedding", 1, 3), lambda v: v.cast("double"))
    return e.select("vec_id", (F.col("label") % 3).cast("int").alias("y_true"), softmax(logits).alias("probability"), arg_max(logits).alias("y_pred"))


def fold_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions of three synthetic models on three subsets, one triple of elements each, by fold."""
    e = table(spark, sf_dir, "embeddings")
    cells = [(m, s, 3 * (3 * i + j)) for i, m in enumerate(("lstm", "bilstm", "xgboost")) for j, s in enumerate(("ear", "ear_mar", "all"))]
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.lit(s).alias("feature_subset"), arg_max(F.slice("embedding", k + 1, 3)).alias("y_pred")) for m, s, k in cells]))
    return e.select((F.col("vec_id") % 5 + 1).cast("int").alias("fold"), (F.col("label") % 3).cast("int").alias("y_true"), each.alias("p")).select("fold", "y_true", "p.*")


def landmarks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id and 32 points; one degenerate row with all points alike."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    none = e.sparkSession.createDataFrame([(-1, [0.5] * 64)], "vec_id bigint, embedding array<float>")
    at = lambda k: F.get("embedding", F.lit(k)).cast("double")
    return e.unionByName(none).select("vec_id", F.array(*[F.struct(at(2 * i).alias("x"), at(2 * i + 1).alias("y")) for i in range(32)]).alias("points"))


def paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id and a path as recorded by cameras of many habits; some carry no label."""
    u, e = F.col("user_id"), F.col("event_id")
    code = F.get(F.array(*[F.lit(c) for c in ("0", "5", "10", "50", "drowsy", "yellow")]), (e % 6).cast("int"))
    suffix = F.get(F.array(F.lit(".mp4"), F.lit("_glasses.MOV"), F.lit(" (1).avi")), (e % 3).cast("int"))
    folder = F.when(u % 2 == 1, "Fold3_part1/").otherwise("")
    subject = F.lpad((F.pmod(u * 7, F.lit(60)) + 1).cast("string"), 2, "0")
    who = F.when(u % 5 == 0, F.lit("x")).otherwise(subject)
    tag = F.when((u % 5 == 0) & (u % 2 == 0), F.concat(F.lit("_sub"), subject)).otherwise("")
    path = F.concat(F.lit("/data/"), folder, who, F.lit("/"), code, tag, suffix)
    return table(spark, sf_dir, "events").select("event_id", path.alias("path"))
