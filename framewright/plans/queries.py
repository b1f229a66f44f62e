"""The engine's queries over the test tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright import schema
from framewright.functions.headpose import MODEL, head_pose
from framewright.functions.scalar import LEFT_EYE, MOUTH, RIGHT_EYE, arg_max, eye_aspect_ratio, landmark_ratios, mouth_aspect_ratio, one_hot, pixel
from framewright.operators import catalog, metrics, models, scale, split, summary, training, validate
from framewright.operators import frames as fr
from framewright.operators import windows as wi
from framewright.plans import views
from framewright.schema import FEATURES

T, STEP = 10, 1
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

_FRAMES = """
ev AS (SELECT event_id, ts, user_id, event_type = 'error' AS lost, value, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k,
  CAST((user_id * 7) % 60 + 1 AS INT) AS subject_id, CAST(((user_id * 7) % 60) // 12 + 1 AS INT) AS fold_id FROM events),
ft AS (SELECT event_id, ts, user_id, subject_id, fold_id, lost,
  CASE WHEN lost THEN CAST(0.3 AS FLOAT) ELSE CAST(value / 100 AS FLOAT) END AS ear, CASE WHEN lost THEN CAST(0 AS FLOAT) ELSE CAST(k AS FLOAT) END AS mar,
  CASE WHEN lost THEN CAST(0 AS FLOAT) ELSE CAST(minute(ts) AS FLOAT) END AS pitch, CASE WHEN lost THEN CAST(0 AS FLOAT) ELSE CAST(hour(ts) AS FLOAT) END AS yaw,
  CASE WHEN lost THEN CAST(0 AS FLOAT) ELSE CAST(day(ts) AS FLOAT) END AS roll FROM ev),
frames AS (SELECT user_id || '-' || (event_id % 3) AS video_id, CAST(event_id % 3 AS INT) AS label, subject_id, fold_id, ear, mar, pitch, yaw, roll,
  CAST(row_number() OVER (PARTITION BY user_id, event_id % 3 ORDER BY ts, event_id) - 1 AS INT) AS frame_idx FROM ft),
streams AS (SELECT CAST(user_id AS VARCHAR) AS video_id, CAST(user_id % 3 AS INT) AS label, subject_id, fold_id, ear, mar, pitch, yaw, roll,
  CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INT) AS frame_idx FROM ft)"""
_PAD = "(ear = CAST(0.3 AS FLOAT) AND mar = 0 AND pitch = 0 AND yaw = 0 AND roll = 0)"
_WIN = """
win AS (SELECT a.video_id, a.frame_idx AS window_id, a.label, a.subject_id, a.fold_id, b.frame_idx - a.frame_idx AS t, b.ear, b.mar, b.pitch, b.yaw, b.roll
  FROM frames a JOIN frames b ON a.video_id = b.video_id AND b.frame_idx BETWEEN a.frame_idx AND a.frame_idx + 9
  JOIN (SELECT video_id, count(*) AS n FROM frames GROUP BY video_id) c ON c.video_id = a.video_id AND a.frame_idx + 10 <= c.n)"""
_PRED = """
lg AS (SELECT vec_id, CAST(label % 3 AS INT) AS y_true, CAST(embedding[1] AS DOUBLE) AS a, CAST(embedding[2] AS DOUBLE) AS b, CAST(embedding[3] AS DOUBLE) AS c FROM embeddings),
pr AS (SELECT vec_id, y_true, CASE WHEN a >= b AND a >= c THEN 0 WHEN b >= c THEN 1 ELSE 2 END AS y_pred,
  exp(a) / (exp(a) + exp(b) + exp(c)) AS p0, exp(b) / (exp(a) + exp(b) + exp(c)) AS p1, exp(c) / (exp(a) + exp(b) + exp(c)) AS p2 FROM lg),
cls AS (SELECT unnest([0, 1, 2]) AS class),
per AS (SELECT class, sum(CASE WHEN y_true = class AND y_pred = class THEN 1 ELSE 0 END) AS hits, sum(CASE WHEN y_true = class THEN 1 ELSE 0 END) AS support,
  sum(CASE WHEN y_pred = class THEN 1 ELSE 0 END) AS predicted FROM pr, cls GROUP BY class),
pc AS (SELECT *, CASE WHEN predicted = 0 THEN 0 ELSE hits / predicted END AS p, CASE WHEN support = 0 THEN 0 ELSE hits / support END AS r FROM per),
prf AS (SELECT *, CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END AS f FROM pc)"""
_TRIPLES = ", ".join(f"('{m}', '{s}', {3 * (3 * i + j)})" for i, m in enumerate(("lstm", "bilstm", "xgboost")) for j, s in enumerate(("ear", "ear_mar", "all")))
_FOLDS = f"""
cells(model, feature_subset, k) AS (VALUES {_TRIPLES}),
fp AS (SELECT CAST(vec_id % 5 + 1 AS INT) AS fold, CAST(label % 3 AS INT) AS y_true, model, feature_subset,
  CASE WHEN embedding[k+1] >= embedding[k+2] AND embedding[k+1] >= embedding[k+3] THEN 0 WHEN embedding[k+2] >= embedding[k+3] THEN 1 ELSE 2 END AS y_pred FROM embeddings, cells),
cls AS (SELECT unnest([0, 1, 2]) AS class),
per AS (SELECT fold, model, feature_subset, class, sum(CASE WHEN y_true = class AND y_pred = class THEN 1 ELSE 0 END) AS hits,
  sum(CASE WHEN y_true = class THEN 1 ELSE 0 END) AS support, sum(CASE WHEN y_pred = class THEN 1 ELSE 0 END) AS predicted FROM fp, cls GROUP BY ALL),
pc AS (SELECT *, CASE WHEN predicted = 0 THEN 0 ELSE hits / predicted END AS p, CASE WHEN support = 0 THEN 0 ELSE hits / support END AS r FROM per),
prf AS (SELECT *, CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END AS f FROM pc),
fr AS (SELECT fold, model, feature_subset, sum(hits) / sum(support) AS accuracy, avg(CASE WHEN support + predicted > 0 THEN p END) AS precision_macro,
  avg(CASE WHEN support + predicted > 0 THEN r END) AS recall_macro, avg(CASE WHEN support + predicted > 0 THEN f END) AS f1_macro FROM prf GROUP BY ALL),
cv AS (SELECT model, feature_subset, count(DISTINCT fold) AS num_folds, avg(accuracy) AS ma, stddev_pop(accuracy) AS sa, avg(f1_macro) AS mf, stddev_pop(f1_macro) AS sf,
  avg(precision_macro) AS mp, stddev_pop(precision_macro) AS sp, avg(recall_macro) AS mr, stddev_pop(recall_macro) AS sr FROM fr GROUP BY ALL)"""


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _r(c, n: int = 6):
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c.cast("double"), n) + F.lit(0.0)


def _mult(spark, sf_dir):
    return wi.with_multiplicity(views.frames(spark, sf_dir), T, STEP)


# Frames

@query(f"WITH {_FRAMES} SELECT video_id, frame_idx, ear, mar, pitch, yaw, roll, label, subject_id, fold_id, {_PAD} AS is_padding FROM frames")
def frames_view(spark, sf_dir):
    return views.frames(spark, sf_dir).withColumn("is_padding", fr.is_padding())


@query(f"WITH {_FRAMES} SELECT video_id, frame_idx // 5 AS frame_idx, ear, mar FROM streams WHERE frame_idx % 5 = 0")
def frame_sample(spark, sf_dir):
    return fr.sampled(views.streams(spark, sf_dir), 5).select("video_id", "frame_idx", "ear", "mar")


@query(f"WITH {_FRAMES} SELECT video_id, frame_idx // 5 AS frame_idx, ear FROM streams WHERE frame_idx % 5 = 0 AND frame_idx // 5 < 8")
def frame_limit(spark, sf_dir):
    return fr.sampled(views.streams(spark, sf_dir), 5, max_frames=8).select("video_id", "frame_idx", "ear")


@query(f"WITH {_FRAMES} SELECT video_id, frame_idx, CASE WHEN yaw < 1 THEN CAST(0.3 AS FLOAT) ELSE ear END AS ear, CASE WHEN yaw < 1 THEN CAST(0 AS FLOAT) ELSE roll END AS roll, yaw < 1 AS is_padding FROM frames")
def pad_missing(spark, sf_dir):
    f = views.frames(spark, sf_dir)
    face = F.when(F.col("yaw") >= 1, F.struct(*FEATURES))
    return fr.padded(f.select("video_id", "frame_idx", face.alias("face"))).select("video_id", "frame_idx", "ear", "roll", "is_padding")


# Windows

def _digest(w: DataFrame, length: int) -> DataFrame:
    x = F.col("x")
    return w.select("video_id", "window_id", "label", "subject_id", "fold_id", F.get(F.get(x, 0), 0).alias("first_ear"), F.get(F.get(x, length - 1), 0).alias("last_ear"),
                    _r(F.aggregate(F.flatten(x), F.lit(0.0), lambda s, v: s + v.cast("double")), 3).alias("total"))


@query(f"""WITH {_FRAMES}, {_WIN} SELECT video_id, window_id, label, subject_id, fold_id, max(CASE WHEN t = 0 THEN ear END) AS first_ear, max(CASE WHEN t = 9 THEN ear END) AS last_ear,
  round(sum(CAST(ear AS DOUBLE) + CAST(mar AS DOUBLE) + CAST(pitch AS DOUBLE) + CAST(yaw AS DOUBLE) + CAST(roll AS DOUBLE)), 3) AS total FROM win GROUP BY ALL""")
def sliding_windows(spark, sf_dir):
    return _digest(wi.windows(views.frames(spark, sf_dir), T, STEP), T)


def _stream_sql(step: int) -> str:
    return f"""WITH {_FRAMES}, n AS (SELECT video_id, count(*) AS n FROM streams GROUP BY video_id)
      SELECT a.video_id, a.frame_idx // {step} AS window_id, a.label, a.subject_id, a.fold_id, a.ear AS first_ear,
        max(CASE WHEN b.frame_idx = a.frame_idx + 29 THEN b.ear END) AS last_ear,
        round(sum(CAST(b.ear AS DOUBLE) + CAST(b.mar AS DOUBLE) + CAST(b.pitch AS DOUBLE) + CAST(b.yaw AS DOUBLE) + CAST(b.roll AS DOUBLE)), 3) AS total
      FROM streams a JOIN n USING (video_id) JOIN streams b ON a.video_id = b.video_id AND b.frame_idx BETWEEN a.frame_idx AND a.frame_idx + 29
      WHERE a.frame_idx % {step} = 0 AND a.frame_idx + 30 <= n.n GROUP BY ALL"""


@query(_stream_sql(7))
def window_step7(spark, sf_dir):
    return _digest(wi.windows(views.streams(spark, sf_dir), 30, 7), 30)


@query(_stream_sql(40))
def window_step40(spark, sf_dir):
    return _digest(wi.windows(views.streams(spark, sf_dir), 30, 40), 30)


@query(f"WITH {_FRAMES} SELECT video_id, count(*) AS n_frames, CASE WHEN count(*) >= 10 THEN count(*) - 9 ELSE 0 END AS n_windows FROM frames GROUP BY video_id")
def window_counts(spark, sf_dir):
    return views.frames(spark, sf_dir).groupBy("video_id").agg(F.count("*").alias("n_frames")).withColumn("n_windows", wi.window_count(F.col("n_frames"), T, STEP))


@query(f"WITH {_FRAMES}, {_WIN} SELECT f.video_id, f.frame_idx, count(w.video_id) AS mult FROM frames f LEFT JOIN win w ON w.video_id = f.video_id AND w.window_id + w.t = f.frame_idx GROUP BY ALL")
def window_multiplicity(spark, sf_dir):
    return _mult(spark, sf_dir).select("video_id", "frame_idx", "mult")


@query(f"WITH {_FRAMES}, {_WIN} SELECT video_id, window_id, max(CASE WHEN t = 0 THEN ear END) AS t0_ear, max(CASE WHEN t = 0 THEN mar END) AS t0_mar, max(CASE WHEN t = 9 THEN mar END) AS t9_mar FROM win GROUP BY ALL")
def subset_projection(spark, sf_dir):
    w = wi.windows(views.frames(spark, sf_dir), T, STEP, schema.subset_columns("ear_mar"))
    at = lambda t, f: F.get(F.get("x", F.lit(t)), F.lit(f))
    return w.select("video_id", "window_id", at(0, 0).alias("t0_ear"), at(0, 1).alias("t0_mar"), at(9, 1).alias("t9_mar"))


@query(f"WITH {_FRAMES}, {_WIN} SELECT video_id, window_id, 50 AS n, max(CASE WHEN t = 1 THEN pitch END) AS at_7, max(CASE WHEN t = 9 THEN roll END) AS at_49 FROM win GROUP BY ALL")
def flatten_windows(spark, sf_dir):
    flat = wi.windows(views.frames(spark, sf_dir), T, STEP).withColumn("v", wi.flattened(F.col("x")))
    return flat.select("video_id", "window_id", F.size("v").alias("n"), F.get("v", 7).alias("at_7"), F.get("v", 49).alias("at_49"))


# Distribution and validation

def _starts(spark, sf_dir):
    n = views.frames(spark, sf_dir).groupBy("video_id", "label", "subject_id", "fold_id").agg(F.count("*").alias("n_frames"))
    return n.withColumn("n", wi.window_count(F.col("n_frames"), T, STEP))


_VID = "vid AS (SELECT video_id, label, subject_id, fold_id, CASE WHEN count(*) >= 10 THEN count(*) - 9 ELSE 0 END AS n FROM frames GROUP BY ALL)"


@query(f"WITH {_FRAMES}, {_VID} SELECT fold_id, label, CAST(sum(n) AS BIGINT) AS windows, count(*) AS videos FROM vid GROUP BY ALL")
def fold_distribution(spark, sf_dir):
    return _starts(spark, sf_dir).groupBy("fold_id", "label").agg(F.sum("n").alias("windows"), F.count("*").alias("videos"))


@query(f"WITH {_FRAMES}, {_VID} SELECT label, CAST(sum(n) AS BIGINT) AS count, round(100.0 * sum(n) / (SELECT sum(n) FROM vid), 6) AS percent FROM vid GROUP BY label")
def class_percent(spark, sf_dir):
    return validate.label_counts(_starts(spark, sf_dir)).withColumn("percent", _r("percent"))


@query(f"WITH {_FRAMES}, {_WIN} SELECT (SELECT round(avg(CASE WHEN {_PAD} THEN 1.0 ELSE 0 END), 6) FROM frames) AS frame_rate, round(avg(CASE WHEN {_PAD} THEN 1.0 ELSE 0 END), 6) AS timestep_rate FROM win")
def padding_rate(spark, sf_dir):
    return validate.padding_rate(_mult(spark, sf_dir)).select(_r("frame_rate").alias("frame_rate"), _r("timestep_rate").alias("timestep_rate"))


@query(f"WITH {_FRAMES}, {_WIN} SELECT {', '.join(f'min({c}) AS {c}_min, max({c}) AS {c}_max' for c in FEATURES)} FROM win")
def feature_min_max(spark, sf_dir):
    return validate.feature_ranges(_mult(spark, sf_dir))


@query(f"WITH {_FRAMES}, {_WIN} SELECT {', '.join(f'min({c}) = max({c}) AS {c}' for c in FEATURES)} FROM win")
def constant_features(spark, sf_dir):
    r = validate.feature_ranges(_mult(spark, sf_dir))
    return r.select(*[(F.col(f"{c}_min") == F.col(f"{c}_max")).alias(c) for c in FEATURES])


@query(f"WITH {_FRAMES} SELECT count(*) AS frames, sum(CASE WHEN {' OR '.join(f'isnan({c}) OR isinf({c})' for c in FEATURES)} THEN 1 ELSE 0 END)::BIGINT AS bad FROM frames")
def finite_check(spark, sf_dir):
    bad = F.lit(False)
    for c in FEATURES:
        bad = bad | ~fr.is_finite(F.col(c))
    return views.frames(spark, sf_dir).agg(F.count("*").alias("frames"), F.sum(bad.cast("long")).alias("bad"))


@query("""SELECT c_custkey AS subject_id, list_sort(list(DISTINCT CAST(o_orderkey % 5 + 1 AS INT)))::VARCHAR AS folds FROM customer JOIN orders ON c_custkey = o_custkey
  GROUP BY c_custkey HAVING count(DISTINCT o_orderkey % 5) <> 1""")
def subject_fold_leak(spark, sf_dir):
    o = views.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("subject_id"), (F.col("o_orderkey") % 5 + 1).cast("int").alias("fold_id"))
    c = views.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("subject_id"))
    return split.leaking_subjects(o.join(c, "subject_id")).select("subject_id", F.concat(F.lit("["), F.concat_ws(", ", F.transform("folds", lambda f: f.cast("string"))), F.lit("]")).alias("folds"))


@query(f"WITH {_FRAMES} SELECT unnest([1, 2, 3, 4, 5]) AS fold_id EXCEPT SELECT fold_id FROM frames WHERE fold_id NOT IN (2, 4)")
def missing_folds(spark, sf_dir):
    return validate.missing_folds(views.frames(spark, sf_dir).where(~F.col("fold_id").isin(2, 4)))


@query(f"WITH {_FRAMES} SELECT 'frames' AS data, count(DISTINCT subject_id) AS subjects, count(DISTINCT fold_id) AS folds, count(DISTINCT label) AS labels, count(*) AS n FROM frames")
def distinct_ids(spark, sf_dir):
    return views.frames(spark, sf_dir).agg(F.count_distinct("subject_id").alias("subjects"), F.count_distinct("fold_id").alias("folds"), F.count_distinct("label").alias("labels"), F.count("*").alias("n")).withColumn("data", F.lit("frames"))


# Splits and scaling

@query(f"WITH {_FRAMES}, d AS (SELECT DISTINCT fold_id FROM frames WHERE fold_id <> 3) SELECT fold_id, coalesce(lead(fold_id) OVER (ORDER BY fold_id), min(fold_id) OVER ()) AS next_fold FROM d")
def next_fold(spark, sf_dir):
    return split.next_folds(views.frames(spark, sf_dir).where("fold_id <> 3"))


@query(f"WITH {_FRAMES} SELECT CASE fold_id WHEN 4 THEN 'test' WHEN 5 THEN 'val' ELSE 'train' END AS split, label, count(*) AS frames, count(DISTINCT subject_id) AS subjects FROM frames GROUP BY ALL")
def split_assign(spark, sf_dir):
    return split.fold_split(views.frames(spark, sf_dir), 4).groupBy("split", "label").agg(F.count("*").alias("frames"), F.count_distinct("subject_id").alias("subjects"))


@query(f"WITH {_FRAMES} SELECT subject_id FROM frames WHERE label = 0 AND frame_idx < 3 AND fold_id < 4 INTERSECT SELECT subject_id FROM frames WHERE label = 1 AND fold_id > 1")
def split_overlap(spark, sf_dir):
    """Subjects that two overlapping splits share."""
    f = views.frames(spark, sf_dir)
    return split.overlap(f.where("label = 0 and frame_idx < 3 and fold_id < 4"), f.where("label = 1 and fold_id > 1"))


@query(f"WITH {_FRAMES} SELECT DISTINCT fold_id, fold_id % 5 + 1 AS val_fold FROM frames")
def circular_folds(spark, sf_dir):
    return views.frames(spark, sf_dir).select("fold_id").distinct().withColumn("val_fold", split.circular_fold(F.col("fold_id")))


@query(f"""WITH {_FRAMES}, {_WIN}, one AS (SELECT * FROM win WHERE t = 0)
  SELECT count(*) AS num_samples, count(DISTINCT subject_id) AS num_subjects, {', '.join(f'sum(CASE WHEN label = {k} THEN 1 ELSE 0 END)::BIGINT AS class_{k}' for k in range(3))},
  {', '.join(f'sum(CASE WHEN fold_id = {k} THEN 1 ELSE 0 END)::BIGINT AS fold_{k}' for k in range(1, 6))},
  (SELECT round(avg(CASE WHEN {_PAD} THEN 1.0 ELSE 0 END), 6) FROM win) AS padding_rate, (SELECT avg(CASE WHEN {_PAD} THEN 1.0 ELSE 0 END) > 0.2 FROM win) AS warned FROM one""")
def validation_summary(spark, sf_dir):
    """The integrity check's summary as one row."""
    s = validate.check(_mult(spark, sf_dir), length=T)
    row = {"num_samples": s["num_samples"], "num_subjects": s["num_subjects"], **{f"class_{k}": v for k, v in s["class_counts"].items()}, **{f"fold_{k}": v for k, v in s["fold_counts"].items()}}
    schema_ = ", ".join(f"{k} long" for k in row) + ", padding_rate double, warned boolean"
    return spark.createDataFrame([(*row.values(), round(s["padding_rate"], 6), bool(s["warnings"]))], schema_)


@query(f"""WITH {_FRAMES}, v AS (SELECT DISTINCT video_id FROM frames UNION SELECT 'none-' || c_custkey FROM customer), n AS (SELECT video_id, count(*) AS n FROM frames WHERE frame_idx < subject_id GROUP BY video_id)
  SELECT CASE WHEN n IS NULL THEN 'skipped' WHEN n < 10 THEN 'short' ELSE 'processed' END AS status, count(*) AS videos FROM v LEFT JOIN n USING (video_id) GROUP BY ALL""")
def run_counters(spark, sf_dir):
    """Processed, short and skipped videos of a run."""
    f = views.frames(spark, sf_dir)
    lost = views.table(spark, sf_dir, "customer").select(F.concat(F.lit("none-"), F.col("c_custkey")).alias("video_id"))
    status = catalog.video_status(f.select("video_id").distinct().union(lost), f.where("frame_idx < subject_id"), T)
    return status.groupBy("status").agg(F.count("*").alias("videos"))


@query("SELECT o_orderstatus AS label, CASE WHEN k < 0.8 THEN 'train' WHEN k < 0.9 THEN 'val' ELSE 'test' END AS split, count(*) AS n FROM (SELECT o_orderstatus, (row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) - 1) / count(*) OVER (PARTITION BY o_orderstatus) AS k FROM orders) GROUP BY ALL")
def stratified_split(spark, sf_dir):
    o = views.table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderstatus").alias("label"))
    return split.stratified(o, "label", "o_orderkey").groupBy("label", "split").agg(F.count("*").alias("n"))


_TRAIN = "fold_id NOT IN (4, 5)"
_PARAMS = ", ".join(f"CAST(avg(CAST({c} AS DOUBLE)) AS FLOAT) AS {c}_mean, CAST(CASE WHEN stddev_pop(CAST({c} AS DOUBLE)) < 1e-8 THEN 1 ELSE stddev_pop(CAST({c} AS DOUBLE)) END AS FLOAT) AS {c}_std" for c in FEATURES)
_NAMES = [f"{c}_{n}" for c in FEATURES for n in ("mean", "std")]


def _params(spark, sf_dir):
    f = split.fold_split(_mult(spark, sf_dir), 4).where("split = 'train'")
    return scale.parameters(f)


@query(f"WITH {_FRAMES}, {_WIN}, p AS (SELECT {_PARAMS} FROM win WHERE {_TRAIN}) SELECT {', '.join(f'round(CAST({c} AS DOUBLE), 3) AS {c}' for c in _NAMES)} FROM p")
def standardize_params(spark, sf_dir):
    return _params(spark, sf_dir).select(*[_r(c, 3).alias(c) for c in _NAMES])


@query(f"WITH {_FRAMES}, {_WIN}, p AS (SELECT {_PARAMS} FROM win WHERE {_TRAIN}) SELECT video_id, frame_idx, {', '.join(f'round(CAST(({c} - {c}_mean) / {c}_std AS DOUBLE), 3) + 0.0 AS {c}' for c in FEATURES)} FROM frames, p")
def standardize_rows(spark, sf_dir):
    out = scale.standardized(views.frames(spark, sf_dir), _params(spark, sf_dir))
    return out.select("video_id", "frame_idx", *[_r(c, 3).alias(c) for c in FEATURES])


# Predictions and metrics

@query(f"WITH {_PRED} SELECT vec_id, y_true, CAST(y_true = 0 AS FLOAT) AS c0, CAST(y_true = 1 AS FLOAT) AS c1, CAST(y_true = 2 AS FLOAT) AS c2 FROM pr")
def one_hot_labels(spark, sf_dir):
    p = views.predictions(spark, sf_dir).withColumn("h", one_hot(F.col("y_true"), 3))
    return p.select("vec_id", "y_true", *[F.get("h", k).alias(f"c{k}") for k in range(3)])


@query(f"WITH {_PRED} SELECT vec_id, y_true, y_pred, round(p0, 6) AS p0, round(p1, 6) AS p1, round(p2, 6) AS p2 FROM pr")
def argmax_pred(spark, sf_dir):
    p = views.predictions(spark, sf_dir)
    return p.select("vec_id", "y_true", arg_max(F.col("probability")).alias("y_pred"), *[_r(F.get("probability", k)).alias(f"p{k}") for k in range(3)])


@query(f"WITH {_PRED}, p AS (SELECT vec_id, y_pred FROM pr WHERE vec_id % 7 <> 0 UNION ALL SELECT -1 - vec_id, y_pred FROM pr WHERE vec_id % 50 = 0) SELECT vec_id, coalesce(pr.y_true, -1) AS y_true, coalesce(p.y_pred, -1) AS y_pred, CASE WHEN pr.y_true IS NOT NULL AND p.y_pred IS NOT NULL THEN 'both' WHEN p.y_pred IS NULL THEN 'truth' ELSE 'prediction' END AS side FROM pr FULL JOIN p USING (vec_id)")
def prediction_alignment(spark, sf_dir):
    """Truth and predictions joined by key, with the rows that lack the other side."""
    all_ = views.predictions(spark, sf_dir)
    pred = all_.where("vec_id % 7 <> 0").select("vec_id", "y_pred").union(all_.where("vec_id % 50 = 0").select(-1 - F.col("vec_id"), "y_pred"))
    both = metrics.aligned(all_.select("vec_id", "y_true"), pred, ["vec_id"])
    return both.select("vec_id", F.coalesce("y_true", F.lit(-1)).alias("y_true"), F.coalesce("y_pred", F.lit(-1)).alias("y_pred"), "side")


@query("SELECT o_orderkey, round(CASE WHEN n > 0 THEN s / n * 1000 ELSE 0 END, 6) AS inference_latency_ms, round(CASE WHEN s > 0 THEN n / s ELSE 0 END, 6) AS inference_throughput_fps FROM (SELECT o_orderkey, o_totalprice / 1000 AS s, o_custkey % 5 AS n FROM orders)")
def inference_latency(spark, sf_dir):
    o = views.table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_totalprice") / 1000).alias("s"), (F.col("o_custkey") % 5).alias("n"))
    out = summary.latency(o, "s", "n")
    return out.select("o_orderkey", _r("inference_latency_ms").alias("inference_latency_ms"), _r("inference_throughput_fps").alias("inference_throughput_fps"))


@query(f"WITH {_PRED} SELECT y_true, {', '.join(f'sum(CASE WHEN y_pred = {k} THEN 1 ELSE 0 END)::BIGINT AS pred_{k}' for k in range(3))} FROM pr GROUP BY y_true")
def confusion_matrix(spark, sf_dir):
    return metrics.confusion_matrix(views.predictions(spark, sf_dir))


@query(f"WITH {_PRED}, g AS (SELECT a.class AS y_true, b.class AS y_pred FROM cls a, cls b), c AS (SELECT g.y_true, g.y_pred, count(pr.vec_id) AS n FROM g LEFT JOIN pr ON pr.y_true = g.y_true AND pr.y_pred = g.y_pred GROUP BY ALL) SELECT y_true, y_pred, round(n / (sum(n) OVER (PARTITION BY y_true) + 1e-8), 6) AS share FROM c")
def confusion_normalized(spark, sf_dir):
    return metrics.row_normalized(metrics.confusion(views.predictions(spark, sf_dir))).withColumn("share", _r("share"))


@query(f"WITH {_PRED} SELECT class, round(p, 6) AS precision, round(r, 6) AS recall, round(f, 6) AS f1, CAST(support AS BIGINT) AS support FROM prf")
def class_prf(spark, sf_dir):
    p = metrics.per_class(views.predictions(spark, sf_dir))
    return p.select("class", _r("precision").alias("precision"), _r("recall").alias("recall"), _r("f1").alias("f1"), "support")


@query(f"WITH {_PRED} SELECT round(sum(hits) / sum(support), 6) AS accuracy, round(avg(CASE WHEN support + predicted > 0 THEN p END), 6) AS precision_macro, round(avg(CASE WHEN support + predicted > 0 THEN r END), 6) AS recall_macro, round(avg(CASE WHEN support + predicted > 0 THEN f END), 6) AS f1_macro FROM prf")
def macro_prf(spark, sf_dir):
    a = metrics.averages(views.predictions(spark, sf_dir))
    return a.select(*[_r(c).alias(c) for c in ("accuracy", "precision_macro", "recall_macro", "f1_macro")])


@query(f"WITH {_PRED} SELECT round(sum(p * support) / sum(support), 6) AS precision_weighted, round(sum(r * support) / sum(support), 6) AS recall_weighted, round(sum(f * support) / sum(support), 6) AS f1_weighted FROM prf")
def weighted_prf(spark, sf_dir):
    a = metrics.averages(views.predictions(spark, sf_dir))
    return a.select(*[_r(c).alias(c) for c in ("precision_weighted", "recall_weighted", "f1_weighted")])


@query(f"WITH {_PRED} SELECT round(-avg(ln(least(greatest(CASE y_true WHEN 0 THEN p0 WHEN 1 THEN p1 ELSE p2 END, 1e-15), 1 - 1e-15))), 6) AS log_loss FROM pr")
def log_loss(spark, sf_dir):
    return metrics.log_loss(views.predictions(spark, sf_dir)).select(_r("log_loss").alias("log_loss"))


@query(f"""WITH {_PRED}, names(class, row) AS (VALUES (0, 'Alert'), (1, 'Low Vigilant'), (2, 'Drowsy')), t AS (SELECT sum(hits) / sum(support) AS a, sum(support) AS s FROM prf)
  SELECT row, round(p, 6) AS precision, round(r, 6) AS recall, round(f, 6) AS f1, CAST(support AS BIGINT) AS support FROM prf JOIN names USING (class)
  UNION ALL SELECT 'accuracy', round(a, 6), round(a, 6), round(a, 6), CAST(s AS BIGINT) FROM t
  UNION ALL SELECT 'macro avg', round(avg(p), 6), round(avg(r), 6), round(avg(f), 6), CAST(sum(support) AS BIGINT) FROM prf WHERE support + predicted > 0
  UNION ALL SELECT 'weighted avg', round(sum(p * support) / sum(support), 6), round(sum(r * support) / sum(support), 6), round(sum(f * support) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM prf""")
def classification_report(spark, sf_dir):
    r = metrics.report(views.predictions(spark, sf_dir))
    return r.select("row", _r("precision").alias("precision"), _r("recall").alias("recall"), _r("f1").alias("f1"), "support")


# Cross-fold summaries

def _results(spark, sf_dir):
    return metrics.averages(views.fold_predictions(spark, sf_dir), ["model", "feature_subset", "fold"])


@query(f"WITH {_FOLDS} SELECT model, feature_subset, fold, round(accuracy, 6) AS accuracy, round(precision_macro, 6) AS precision_macro, round(recall_macro, 6) AS recall_macro, round(f1_macro, 6) AS f1_macro FROM fr")
def fold_results(spark, sf_dir):
    return _results(spark, sf_dir).select("model", "feature_subset", "fold", *[_r(c).alias(c) for c in ("accuracy", "precision_macro", "recall_macro", "f1_macro")])


@query(f"WITH {_FOLDS} SELECT model, feature_subset, num_folds AS num_folds_evaluated, round(ma, 6) AS mean_accuracy, round(sa, 6) AS std_accuracy, round(mf, 6) AS mean_f1_macro, round(sf, 6) AS std_f1_macro FROM cv")
def cv_summary(spark, sf_dir):
    return summary.cv_summary(_results(spark, sf_dir)).select("model", "feature_subset", "num_folds_evaluated", *[_r(c).alias(c) for c in ("mean_accuracy", "std_accuracy", "mean_f1_macro", "std_f1_macro")])


def _bench(spark, sf_dir):
    return summary.benchmark_rows(summary.cv_summary(_results(spark, sf_dir)))


@query(f"""WITH {_FOLDS} SELECT upper(model) AS model, feature_subset, round(100 * ma, 6) AS mean_accuracy, round(100 * sa, 6) AS std_accuracy, round(100 * mf, 6) AS mean_f1_macro, round(100 * sf, 6) AS std_f1_macro,
  round(100 * mp, 6) AS mean_precision_macro, round(100 * sp, 6) AS std_precision_macro, round(100 * mr, 6) AS mean_recall_macro, round(100 * sr, 6) AS std_recall_macro,
  0.0 AS total_train_time_sec, 0.0 AS mean_latency_ms, 0.0 AS std_latency_ms, 0.0 AS mean_throughput_fps, num_folds FROM cv""")
def benchmark_table(spark, sf_dir):
    rows = _bench(spark, sf_dir)
    return rows.select(*[c if c in ("model", "feature_subset", "num_folds") else _r(c).alias(c) for c in rows.columns])


@query(f"WITH {_FOLDS} SELECT upper(model) AS model, {', '.join(f'round(100 * max(CASE WHEN feature_subset = {chr(39)}{s}{chr(39)} THEN ma END), 6) AS {chr(34)}{s}{chr(34)}' for s in ('all', 'ear', 'ear_mar'))} FROM cv GROUP BY ALL")
def pivot_metric(spark, sf_dir):
    p = summary.pivot_metric(_bench(spark, sf_dir), "mean_accuracy", ["all", "ear", "ear_mar"])
    return p.select("model", *[_r(c).alias(c) for c in ("all", "ear", "ear_mar")])


@query(f"WITH {_FOLDS} SELECT CASE WHEN count(DISTINCT num_folds) = 1 THEN min(num_folds) || '-Fold' ELSE 'Mixed-Fold' END AS label FROM cv")
def fold_label(spark, sf_dir):
    return summary.fold_label(_bench(spark, sf_dir))


@query(f"""WITH {_FOLDS}, nm(feature_subset, name) AS (VALUES ('ear', 'EAR Only'), ('ear_mar', 'EAR + MAR'), ('all', 'EAR + MAR + HeadPose (5 Features)'))
  SELECT upper(model) AS model, feature_subset, '| ' || upper(model) || ' | ' || coalesce(name, feature_subset) || printf(' | %.2f ± %.2f', 100 * ma, 100 * sa) || printf(' | %.2f ± %.2f', 100 * mp, 100 * sp)
  || printf(' | %.2f ± %.2f', 100 * mr, 100 * sr) || printf(' | %.2f ± %.2f', 100 * mf, 100 * sf) || ' | 0.00 | 0.000 ± 0.000 |' AS line FROM cv LEFT JOIN nm USING (feature_subset)""")
def markdown_rows(spark, sf_dir):
    return summary.markdown_rows(_bench(spark, sf_dir), schema.subsets(spark))


@query(f"WITH {_FOLDS}, b AS (SELECT model, feature_subset, ma, mf * 90 AS mf FROM cv) SELECT model, feature_subset, round(CASE WHEN (SELECT max(ma) FROM b) <= 1 THEN 100 * ma ELSE ma END, 6) AS accuracy, round(CASE WHEN (SELECT max(mf) FROM b) <= 1 THEN 100 * mf ELSE mf END, 6) AS f1 FROM b")
def percent_rule(spark, sf_dir):
    """Shares become percent, percent stays."""
    cv = summary.cv_summary(_results(spark, sf_dir)).select("model", "feature_subset", F.col("mean_accuracy").alias("accuracy"), (90 * F.col("mean_f1_macro")).alias("f1"))
    return summary.as_percent(cv, ["accuracy", "f1"]).select("model", "feature_subset", _r("accuracy").alias("accuracy"), _r("f1").alias("f1"))


@query(f"WITH {_FOLDS}, b AS (SELECT upper(model) AS model, feature_subset, ma, mf FROM cv) SELECT model, feature_subset, 'mean_accuracy' AS metric, round(100 * ma, 6) AS value, '%' AS unit FROM b UNION ALL SELECT model, feature_subset, 'mean_latency_ms', 0.0, 'ms' FROM b")
def bar_chart(spark, sf_dir):
    return summary.bar_chart_data(_bench(spark, sf_dir), ["mean_accuracy", "mean_latency_ms"]).withColumn("value", _r("value"))


@query("SELECT p_brand AS feature, round(sum(l_extendedprice), 2) AS importance FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand ORDER BY sum(l_extendedprice) DESC, p_brand LIMIT 20")
def top_importance(spark, sf_dir):
    li = views.table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.sum("l_extendedprice").alias("v"))
    part = views.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("feature"))
    total = li.join(part, "l_partkey").groupBy("feature").agg(F.sum("v").alias("importance"))
    return summary.top_importance(total).select("feature", _r("importance", 2).alias("importance"))


# Catalogue, geometry and dimension joins

_PATHS = r"""
pt AS (SELECT event_id, user_id, '/data/' || CASE WHEN user_id % 2 = 1 THEN 'Fold3_part1/' ELSE '' END
  || CASE WHEN user_id % 5 = 0 THEN 'x' ELSE lpad(CAST((user_id * 7) % 60 + 1 AS VARCHAR), 2, '0') END || '/'
  || (['0', '5', '10', '50', 'drowsy', 'yellow'])[event_id % 6 + 1] || CASE WHEN user_id % 10 = 0 THEN '_sub' || lpad(CAST((user_id * 7) % 60 + 1 AS VARCHAR), 2, '0') ELSE '' END
  || (['.mp4', '_glasses.MOV', ' (1).avi'])[event_id % 3 + 1] AS path FROM events),
st AS (SELECT *, lower(regexp_replace(regexp_extract(path, '[^/]*$'), '\.[^.]*$', '')) AS stem FROM pt),
pp AS (SELECT path, event_id, CASE regexp_extract(stem, '^(10|5|0)([._\-\s(]|$)', 1) WHEN '0' THEN 0 WHEN '5' THEN 1 WHEN '10' THEN 2
  ELSE CASE WHEN contains(stem, 'alert') THEN 0 WHEN contains(stem, 'low') OR contains(stem, 'vigilant') THEN 1 WHEN contains(stem, 'drowsy') THEN 2 END END AS label,
  coalesce(TRY_CAST(regexp_extract(path, '/([0-9]+)/[^/]*$', 1) AS INT), TRY_CAST(regexp_extract(stem, 'sub(ject)?[_-]?([0-9]+)', 2) AS INT)) AS subject_id,
  TRY_CAST(regexp_extract(path, '(?i)fold[_-]?([1-5])', 1) AS INT) AS named FROM st)"""


@query(f"WITH {_PATHS} SELECT label, subject_id, coalesce(named, CAST(least(greatest((subject_id - 1) // 12 + 1, 1), 5) AS INT)) AS fold_id, path AS video_path, regexp_extract(path, '[^/]*$') AS filename FROM pp WHERE label IS NOT NULL AND subject_id IS NOT NULL")
def parse_paths(spark, sf_dir):
    return catalog.parse_paths(views.paths(spark, sf_dir)).select("label", "subject_id", "fold_id", "video_path", "filename")


@query(f"WITH {_PATHS} SELECT DISTINCT path FROM pt")
def union_paths(spark, sf_dir):
    p = views.paths(spark, sf_dir)
    return p.where("event_id % 2 = 0").select("path").union(p.where("event_id % 3 <> 1").select("path")).union(p.select("path")).distinct()


_P = lambda i: f"CAST(embedding[{2 * i + 1}] AS DOUBLE), CAST(embedding[{2 * i + 2}] AS DOUBLE)"
_D = lambda i, j: f"sqrt(power(CAST(e[{2 * i + 1}] AS DOUBLE) - CAST(e[{2 * j + 1}] AS DOUBLE), 2) + power(CAST(e[{2 * i + 2}] AS DOUBLE) - CAST(e[{2 * j + 2}] AS DOUBLE), 2))"
_LM = "lm AS (SELECT vec_id, embedding AS e FROM embeddings UNION ALL SELECT -1, list_transform(range(64), lambda i: CAST(0.5 AS FLOAT)))"


@query(f"WITH {_LM} SELECT vec_id, round(CASE WHEN {_D(0, 3)} = 0 THEN 0 ELSE ({_D(1, 5)} + {_D(2, 4)}) / (2 * {_D(0, 3)}) END, 6) AS ear FROM lm")
def ear(spark, sf_dir):
    p = [F.get("points", k) for k in range(6)]
    return views.landmarks(spark, sf_dir).select("vec_id", _r(eye_aspect_ratio(p)).alias("ear"))


@query(f"WITH {_LM} SELECT vec_id, round(CASE WHEN {_D(6, 10)} = 0 THEN 0 ELSE ({_D(7, 13)} + {_D(8, 12)} + {_D(9, 11)}) / (2 * {_D(6, 10)}) END, 6) AS mar FROM lm")
def mar(spark, sf_dir):
    p = [F.get("points", k) for k in range(6, 14)]
    return views.landmarks(spark, sf_dir).select("vec_id", _r(mouth_aspect_ratio(p)).alias("mar"))


@query(f"WITH {_LM} SELECT vec_id, CAST(trunc(CAST(e[1] AS DOUBLE) * 640) AS INT) AS x, CAST(trunc(CAST(e[2] AS DOUBLE) * 480) AS INT) AS y FROM lm")
def pixel_coordinates(spark, sf_dir):
    return views.landmarks(spark, sf_dir).select("vec_id", pixel(F.get("points", 0), 640, 480).alias("p")).select("vec_id", "p.*")


@query("SELECT vec_id, CAST(165 + vec_id % 10 AS DOUBLE) AS pitch, CAST(vec_id * 7 % 21 - 10 AS DOUBLE) AS yaw, CAST(vec_id * 11 % 31 - 15 AS DOUBLE) AS roll FROM embeddings")
def head_pose_angles(spark, sf_dir):
    """The angles that the six model points were turned by before they were projected, found again from their pixels."""
    e = views.table(spark, sf_dir, "embeddings")
    v = F.col("vec_id")
    a, b, c = F.radians(165 + v % 10), F.radians(v * 7 % 21 - 10), F.radians(v * 11 % 31 - 15)
    ca, sa, cb, sb, cc, sc = F.cos(a), F.sin(a), F.cos(b), F.sin(b), F.cos(c), F.sin(c)
    turn = [[cc * cb, cc * sb * sa - sc * ca, cc * sb * ca + sc * sa], [sc * cb, sc * sb * sa + cc * ca, sc * sb * ca - cc * sa], [-sb, cb * sa, cb * ca]]
    move = [v % 50 - 25, v % 30 - 15, 2000 + v % 500]
    points = []
    for m in MODEL.tolist():
        x, y, z = (sum((r[k] * m[k] for k in range(3)), t) for r, t in zip(turn, move))
        points.append(F.struct((640 * x / z + 320).alias("x"), (640 * y / z + 240).alias("y")))
    found = e.select("vec_id", head_pose(F.array(*points), 640, 480).alias("p"))
    return found.select("vec_id", *[_r(f"p.{n}", 3).alias(n) for n in ("pitch", "yaw", "roll")])


_PX = lambda i: (f"CAST(trunc(CAST(e[{2 * (i % 32) + 1}] AS DOUBLE) * 640) AS INT)", f"CAST(trunc(CAST(e[{2 * (i % 32) + 2}] AS DOUBLE) * 480) AS INT)")
_DX = lambda i, j: f"sqrt(power({_PX(i)[0]} - {_PX(j)[0]}, 2) + power({_PX(i)[1]} - {_PX(j)[1]}, 2))"


def _ratio_sql(up: list[tuple[int, int]], across: tuple[int, int]) -> str:
    return f"(CASE WHEN {_DX(*across)} = 0 THEN 0 ELSE ({' + '.join(_DX(*u) for u in up)}) / (2 * {_DX(*across)}) END)"


_EYE = lambda p: _ratio_sql([(p[1], p[5]), (p[2], p[4])], (p[0], p[3]))


@query(f"WITH {_LM} SELECT vec_id, round(({_EYE(LEFT_EYE)} + {_EYE(RIGHT_EYE)}) / 2, 6) AS ear, round({_ratio_sql([(MOUTH[1], MOUTH[7]), (MOUTH[2], MOUTH[6]), (MOUTH[3], MOUTH[5])], (MOUTH[0], MOUTH[4]))}, 6) AS mar FROM lm")
def frame_features(spark, sf_dir):
    """Whole-frame ratios from 478 landmarks in whole pixels: both eyes' mean and the mouth."""
    face = F.transform(F.sequence(F.lit(0), F.lit(477)), lambda i: F.get("points", i % 32))
    ear, mar = landmark_ratios(F.col("face"), 640, 480)
    return views.landmarks(spark, sf_dir).select("vec_id", face.alias("face")).select("vec_id", _r(ear).alias("ear"), _r(mar).alias("mar"))


@query("SELECT o_custkey % 60 + 1 AS subject_id, CAST((o_custkey % 60) // 12 + 1 AS INT) AS fold_id, count(*) AS n FROM orders GROUP BY ALL")
def fold_range_join(spark, sf_dir):
    o = views.table(spark, sf_dir, "orders").groupBy((F.col("o_custkey") % 60 + 1).alias("subject_id")).agg(F.count("*").alias("n"))
    return catalog.with_fold(o, schema.folds(spark)).select("subject_id", "fold_id", "n")


@query("WITH l(code, label, name) AS (VALUES ('0', 0, 'Alert'), ('5', 1, 'Low Vigilant'), ('10', 2, 'Drowsy')) SELECT event_id, label, name FROM events JOIN l ON l.code = CAST(5 * (event_id % 4) AS VARCHAR)")
def label_lookup(spark, sf_dir):
    e = views.table(spark, sf_dir, "events").select("event_id", (F.col("event_id") % 4 * 5).cast("string").alias("code"))
    return e.join(F.broadcast(schema.labels(spark)), "code").select("event_id", "label", "name")  # three rows


@query("WITH n(subset, name) AS (VALUES ('ear', 'EAR Only'), ('ear_mar', 'EAR + MAR'), ('all', 'EAR + MAR + HeadPose (5 Features)')), p AS (SELECT p_partkey, (['ear', 'ear_mar', 'all', 'blink'])[p_partkey % 4 + 1] AS subset FROM part) SELECT p_partkey, subset, coalesce(name, subset) AS display_name FROM p LEFT JOIN n USING (subset)")
def subset_name_join(spark, sf_dir):
    names = F.array(*[F.lit(s) for s in ("ear", "ear_mar", "all", "blink")])
    p = views.table(spark, sf_dir, "part").select("p_partkey", F.get(names, (F.col("p_partkey") % 4).cast("int")).alias("subset"))
    return p.join(F.broadcast(schema.subsets(spark)), "subset", "left").select("p_partkey", "subset", F.coalesce("display_name", "subset").alias("display_name"))


@query(f"WITH m(model) AS (VALUES {', '.join(f'({chr(39)}{m}{chr(39)})' for m in schema.MODELS)}), s(subset) AS (VALUES ('ear'), ('ear_mar'), ('all')), f AS (SELECT unnest([1, 2, 3, 4, 5]) AS fold_id) SELECT * FROM m, s, f")
def experiment_grid(spark, sf_dir):
    m = spark.createDataFrame([(m,) for m in schema.MODELS], "model string")
    return summary.grid(m, schema.subsets(spark), schema.folds(spark))


# Models: no SQL

_TRAINED = "model string, feature_subset string, fold int, accuracy double, f1_macro double, precision_macro double, recall_macro double, log_loss double, epochs int, test_samples long"


def _trained(name: str, **options):
    def run(spark, sf_dir):
        result, _, _ = training.train_fold(views.frames(spark, sf_dir), name, 4, length=T, step=STEP, **options)
        return spark.createDataFrame([tuple(result[c.split()[0]] for c in _TRAINED.split(", "))], _TRAINED)

    run.__name__ = f"train_{name}"
    run.__doc__ = f"{name} trained on folds 1 to 3, stopped on fold 5, tested on all windows of fold 4."
    return run


for _name in ("bilstm", "lstm", "bigru", "cnn1d", "transformer"):
    query()(_trained(_name, epochs=3))
query()(_trained("xgboost", trees=30))


@query()
def learning_curves(spark, sf_dir):
    """The boosted trees' losses by round, as long data."""
    _, history, _ = training.train_fold(views.frames(spark, sf_dir), "xgboost", 4, length=T, step=STEP, trees=10)
    return summary.learning_curve_data(spark.createDataFrame(history))


@query()
def model_importance(spark, sf_dir):
    """The 20 inputs with the largest shares of the boosted trees' gains."""
    _, _, model = training.train_fold(views.frames(spark, sf_dir), "xgboost", 4, length=T, step=STEP, trees=10)
    names = [f"{c}_{t}" for t in range(T) for c in FEATURES]
    return summary.top_importance(spark.createDataFrame(list(zip(names, map(float, model.importances()))), "feature string, importance double"))


@query()
def random_forest_metrics(spark, sf_dir):
    """The boosted-tree stand-in trained on folds 1 to 3, evaluated on fold 4."""
    w = wi.windows(views.frames(spark, sf_dir), T, STEP)
    s = split.fold_split(w, 4)
    model = models.train("xgboost", s.where("split = 'train'"), T * len(FEATURES), stand_in=True)
    return metrics.averages(models.predict(model, s.where("split = 'test'"), ["video_id", "window_id"]))


FLAGSHIP = "fold_distribution"
