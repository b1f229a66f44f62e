"""Behaviours and invariants of the sequence engine."""

import pickle
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from framewright import schema
from framewright.functions import headpose
from framewright.operators import boosting, catalog, metrics, models, nets, scale, split, summary, training, validate
from framewright.operators import windows as wi
from framewright.plans import views
from framewright.schema import FEATURES
from framewright.sources import files, video
from framewright.streaming.windows import streaming_windows

CASES = {
    "/dataset/Fold2_part1/13/10_glasses.mp4": (2, 13, 2),
    "/dataset/Fold2_part1/10.mp4": None,
    "/d/45/10.mov": (2, 45, 4),
    "/d/01/0.mp4": (0, 1, 1),
    "/d/subject_05/5 (1).mp4": (1, 5, 1),
    "/d/x/subject-77_drowsy.avi": (2, 77, 5),
    "/mnt/data-fold-5/60/5.MP4": (1, 60, 5),
    "/d/fold10/07/0.mp4": (0, 7, 1),
    "/d/camera260/part3/0.mp4": (0, 3, 1),
    "/d/9/yellow.mp4": (1, 9, 1),
    "/d/12/50.mp4": None,
    "/d/3/05.mp4": None,
}


def dataset(spark, folds=4, per=6, steps=30):
    rng = np.random.default_rng(42)
    rows = [(f"v{f}-{k}", i, *map(float, rng.standard_normal(5)), k % 3, f, f) for f in range(1, folds + 1) for k in range(per) for i in range(steps)]
    frames = spark.createDataFrame(rows, "video_id string, frame_idx int, ear float, mar float, pitch float, yaw float, roll float, label int, subject_id int, fold_id int")
    return wi.with_multiplicity(frames, 30)


def test_paths(spark):
    got = {r["video_path"]: r for r in catalog.parse_paths(spark.createDataFrame([(p,) for p in CASES], "path string")).collect()}
    for path, want in CASES.items():
        assert (None if want is None else want) == ((got[path]["label"], got[path]["subject_id"], got[path]["fold_id"]) if path in got else None), path
    assert got["/d/x/subject-77_drowsy.avi"]["warnings"]


def test_find_videos(spark, tmp_path):
    (tmp_path / "a").mkdir()
    for name in ("a/0.mp4", "5.MOV", "10.Mp4", "x.txt"):
        (tmp_path / name).write_bytes(b"x")
    found = [r["path"] for r in catalog.find_videos(spark, f"file://{tmp_path}").collect()]
    assert sorted(p.rsplit("/", 1)[1] for p in found) == ["0.mp4", "5.MOV"] and found == sorted(found)
    (tmp_path / "none").mkdir()
    with pytest.raises(FileNotFoundError):
        catalog.find_videos(spark, f"file://{tmp_path}/none")


def test_valid_dataset(spark):
    summary_ = validate.check(dataset(spark))
    assert summary_["available_folds"] == [1, 2, 3, 4] and summary_["num_subjects"] == 4


def test_all_padding_is_constant(spark):
    frames = dataset(spark)
    for c, v in zip(FEATURES, schema.SENTINEL):
        frames = frames.withColumn(c, F.lit(v).cast("float"))
    with pytest.raises(ValueError, match="Dataset integrity check failed.*constant"):
        validate.check(frames)


def test_subject_in_two_folds(spark):
    frames = dataset(spark).withColumn("subject_id", F.when(F.col("fold_id") == 2, 1).otherwise(F.col("subject_id")))
    with pytest.raises(ValueError, match="multiple folds"):
        validate.check(frames)


def test_not_finite_and_labels(spark):
    frames = dataset(spark).withColumn("ear", F.when(F.col("frame_idx") == 3, float("nan")).otherwise(F.col("ear"))).withColumn("label", F.col("label") + 1)
    with pytest.raises(ValueError, match="labels out of range: .3.*NaN"):
        validate.check(frames)


def test_summary_counts_windows(spark):
    got = validate.check(dataset(spark))
    assert got["num_samples"] == 24 and got["class_counts"] == {0: 8, 1: 8, 2: 8} and got["fold_counts"] == {1: 6, 2: 6, 3: 6, 4: 6, 5: 0}


@pytest.mark.parametrize("column", ["label", "subject_id", "fold_id"])
def test_missing_ids(spark, column):
    frames = dataset(spark).withColumn(column, F.when(F.col("video_id") != "v1-0", F.col(column)))
    with pytest.raises(ValueError, match=f"frames without ids.*{column}"):
        validate.check(frames)


def test_leaks_are_counted_in_full(spark):
    frames = dataset(spark, per=30).withColumn("subject_id", F.split("video_id", "-")[1].cast("int") + 1)
    with pytest.raises(ValueError, match="30 subjects in multiple folds, the first: .1, 2,"):
        validate.check(frames)


def test_padding_limits(spark):
    frames = dataset(spark)
    for c, v in zip(FEATURES, schema.SENTINEL):
        frames = frames.withColumn(c, F.when(F.col("frame_idx") < 18, F.lit(v).cast("float")).otherwise(F.col(c)))
    assert any("padding" in w for w in validate.check(frames)["warnings"])
    with pytest.raises(ValueError, match="above the limit"):
        validate.check(frames, max_padding_rate=0.5)
    with pytest.raises(ValueError, match="between 0 and 1"):
        validate.check(frames, max_padding_rate=1.5)


def test_empty_dataset(spark):
    with pytest.raises(ValueError, match="no samples"):
        validate.check(dataset(spark).where("false"))


def test_circular_fold_and_split_errors(spark, sf):
    frames = dataset(spark)
    assert {r["fold_id"] for r in split.fold_split(frames, 4).where("split = 'val'").select("fold_id").distinct().collect()} == {1}
    for args, text in (((9,), "out of range"), ((5,), "not present"), ((1, 1), "same")):
        with pytest.raises(ValueError, match=text):
            split.fold_split(frames, *args)
    with pytest.raises(ValueError, match="split holds labels"):
        split.fold_split(views.streams(spark, sf), 1)


def test_formats(spark, tmp_path):
    with pytest.raises(ValueError, match="cannot support leakage-safe evaluation"):
        files.read_frames(spark, "legacy.npy")
    with pytest.raises(ValueError, match="unknown format"):
        files.read_frames(spark, "x.csv")
    w = wi.windows(dataset(spark), 30).orderBy("video_id")
    files.write_archive(w, str(tmp_path / "a/d.npz"))
    back = files.read_archive(spark, str(tmp_path / "a/d.npz"), rows=5)
    assert back.count() == 24 and back.groupBy("fold_id").count().count() == 4
    files.write_frames(dataset(spark).drop("mult"), f"file://{tmp_path}/frames")
    assert files.read_frames(spark, f"file://{tmp_path}/frames").count() == 24 * 30


def test_summaries(spark, tmp_path):
    files.write_summary({"model": "lstm", "feature_subset": "ear", "mean_accuracy": 0.5, "num_folds_evaluated": 5}, str(tmp_path / "lstm_ear_cv_summary.json"))
    (tmp_path / "bad_cv_summary.json").write_text("{not json")
    with pytest.warns(UserWarning, match="bad_cv_summary"):
        rows = summary.benchmark_rows(files.read_summaries(spark, f"file://{tmp_path}"))
    assert files.read_summary(str(tmp_path / "lstm_ear_cv_summary.json"))["num_folds_evaluated"] == 5
    files.write_text(summary.console_table(rows), str(tmp_path / "out/table.txt"))
    assert "LSTM" in (tmp_path / "out/table.txt").read_text() and not summary.has_latency(rows)
    row = rows.first()
    assert row["model"] == "LSTM" and row["mean_accuracy"] == 50.0 and row["mean_latency_ms"] == 0.0
    text = summary.markdown_table(rows, schema.subsets(spark))
    assert "5-Fold" in text and "EAR Only" in text
    twice = rows.union(rows)
    with pytest.raises(Exception, match="occur twice"):
        summary.pivot_metric(twice, "mean_accuracy", ["ear"]).collect()


def test_unknown_subset_raises():
    with pytest.raises(ValueError):
        schema.subset_columns("blink")


@pytest.mark.parametrize("length,step", [(10, 1), (10, 7), (5, 9)])
def test_weighted_moments_equal_exploded(spark, sf, length, step):
    frames = views.frames(spark, sf)
    fast = scale.parameters(wi.with_multiplicity(frames, length, step)).first()
    rows = wi.windows(frames, length, step).select(F.explode("x").alias("r"))
    slow = rows.agg(*[F.avg(F.col("r")[k].cast("double")).alias(f"m{k}") for k in range(5)], *[F.stddev_pop(F.col("r")[k].cast("double")).alias(f"s{k}") for k in range(5)]).first()
    for k, c in enumerate(FEATURES):
        assert fast[f"{c}_mean"] == pytest.approx(slow[f"m{k}"], rel=1e-6) and fast[f"{c}_std"] == pytest.approx(slow[f"s{k}"], rel=1e-6)


@pytest.mark.parametrize("step", [1, 2, 7, 50, 70])
def test_windows_across_blocks(spark, step):
    length, block = 3, wi.BLOCK * 3
    sizes = [0, 1, 2, 3, block - 1, block, block + 1, block + 2, 2 * block + 1, 3 * block + 2]
    rows = [(str(n), i, i % 5, *[float(i + k) for k in range(5)]) for n in sizes for i in range(n)]
    frames = spark.createDataFrame(rows, "video_id string, frame_idx int, label int, " + ", ".join(f"{c} float" for c in FEATURES))
    got = sorted((r["video_id"], r["window_id"], r["label"], r["x"]) for r in wi.windows(frames.repartition(5), length, step).collect())
    want = sorted((str(n), i // step, i % 5, [[float(j + k) for k in range(5)] for j in range(i, i + length)]) for n in sizes for i in range(0, n - length + 1, step))
    assert got == want


def test_head_pose_recovers_rotations():
    rng = np.random.default_rng(0)
    v = np.stack([np.pi + rng.uniform(-0.3, 0.3, 20), rng.uniform(-0.3, 0.3, 20), rng.uniform(-0.3, 0.3, 20)], 1)
    t = np.stack([rng.uniform(-100, 100, 20), rng.uniform(-100, 100, 20), rng.uniform(1500, 3000, 20)], 1)
    found, ok = headpose.solve(headpose.project(v, t, 640, 480), 640, 480)
    assert ok.all() and np.allclose(headpose.rotation(found), headpose.rotation(v), atol=1e-9)


def test_metrics_invariants(spark, sf):
    pred = views.predictions(spark, sf)
    assert metrics.confusion(pred).agg(F.sum("n")).first()[0] == pred.count()
    only = spark.createDataFrame([(0, 0), (0, 0)], "y_true int, y_pred int")
    assert metrics.averages(only).first()["f1_macro"] == 1.0
    assert "accuracy" in metrics.report_text(pred)


def test_stratified_is_exact_and_repeatable(spark):
    df = spark.range(1000).withColumn("label", (F.col("id") % 4 == 0).cast("int"))
    one = {r["id"]: r["split"] for r in split.stratified(df, "label", "id").collect()}
    two = {r["id"]: r["split"] for r in split.stratified(df.repartition(7), "label", "id").collect()}
    assert one == two and sum(v == "train" for v in one.values()) == 800


def test_model_registry(spark, sf):
    with pytest.raises(KeyError):
        models.builder("bilstm")
    w = wi.windows(views.frames(spark, sf), 10, 5)
    model = models.train("xgboost", w, 50, stand_in=True, trees=3, depth=3)
    assert models.predict(model, w, ["video_id", "window_id"]).where("y_pred between 0 and 2").count() == w.count()
    assert models.importances(model, [f"f{k}" for k in range(50)], spark).count() == 50


@pytest.mark.parametrize("name", ["lstm", "bilstm", "bigru", "cnn1d", "transformer"])
def test_network_gradients_like_finite_differences(name):
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(6, 9, 5)), rng.integers(0, 3, 6)
    net = nets.Network(name, 9, 5, dtype=np.float64)
    for layer in net.layers:
        for one in (layer, *getattr(layer, "inner", ())):
            if isinstance(one, nets.Dropout):
                one.share = 0.0
    net.loss_and_gradients(x, y)
    for layer, grads in zip(net.layers, [dict(v.grads) for v in net.layers]):
        for key, grad in grads.items():
            flat, at = layer.params[key].reshape(-1), int(np.abs(grad).reshape(-1).argmax())
            old, losses = flat[at], []
            for move in (1e-5, -1e-5):
                flat[at] = old + move
                losses.append(net.loss_and_gradients(x, y))
            flat[at] = old
            assert (losses[0] - losses[1]) / 2e-5 == pytest.approx(grad.reshape(-1)[at], rel=1e-4, abs=1e-8), key


def _separable(spark, folds=5, per=6, steps=16):
    rng = np.random.default_rng(1)
    rows = [(f"v{f}-{k}", i, *(float(v) for v in rng.normal(0, 0.4, 5) + (k % 3) * np.array([1, -1, 0.5, 0, 0])), k % 3, f, f) for f in range(1, folds + 1) for k in range(per) for i in range(steps)]
    return spark.createDataFrame(rows, "video_id string, frame_idx int, ear float, mar float, pitch float, yaw float, roll float, label int, subject_id int, fold_id int")


@pytest.mark.parametrize("name", ["bilstm", "lstm", "bigru", "cnn1d", "transformer", "xgboost"])
def test_training_learns_and_reloads(spark, tmp_path, name):
    frames = _separable(spark).cache()
    options = {"trees": 20} if name == "xgboost" else {"epochs": 25}
    result, history, model = training.train_fold(frames, name, 2, length=8, folder=str(tmp_path), **options)
    assert result["accuracy"] > 0.8 and result["test_samples"] == 6 * 9 and sum(map(sum, result["confusion_matrix"])) == 54
    assert len(history) == result["epochs"] and history[-1]["val_loss"] < history[0]["val_loss"]
    x = np.random.default_rng(0).normal(size=(5, 8, 5)).astype(np.float32)
    assert np.allclose(training.load(result["checkpoint_path"]).probabilities(x), model.probabilities(x), atol=1e-6)


def test_trees_stop_early():
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(200, 4)), rng.integers(0, 3, 200)
    model = boosting.SoftmaxTrees(trees=200, rate=0.5).fit(x, y, rng.normal(size=(100, 4)), rng.integers(0, 3, 100))
    best = min(range(len(model.history)), key=lambda k: model.history[k]["val_loss"])
    assert len(model.history) < 200 and len(model.forest) == best + 1 and model.importances().sum() == pytest.approx(1)


def test_extract_with_adapters(spark):
    videos = spark.createDataFrame([("a", "p:12"), ("b", "p:0")], "video_id string, video_path string")
    decode = lambda: lambda path: iter(range(int(path[2:])))
    detect = lambda: lambda frame: None if frame == 5 else (0.2, 0.4, 1.0, 2.0, float(frame))
    rows = video.extract(videos, decode, detect).orderBy("frame_idx").collect()
    assert [(r["video_id"], r["frame_idx"], r["roll"]) for r in rows] == [("a", 0, 0.0), ("a", 1, 0.0), ("a", 2, 10.0)]
    broken = lambda: lambda path: iter(range(int(path[2:]))) if path != "p:0" else (_ for _ in ()).throw(OSError("broken"))
    frames = video.extract(videos, broken, detect)
    status = {r["video_id"]: r["status"] for r in catalog.video_status(videos, frames, 3).collect()}
    assert status == {"a": "processed", "b": "skipped"}


def test_streaming_windows(spark, sf, tmp_path):
    frames = views.frames(spark, sf).select("video_id", "frame_idx", *FEATURES)
    frames.where("frame_idx < 7").coalesce(1).write.parquet(f"{tmp_path}/in/a")
    frames.where("frame_idx >= 7").coalesce(1).write.parquet(f"{tmp_path}/in/b")
    stream = spark.readStream.schema(frames.schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(f"{tmp_path}/in/*")
    q = streaming_windows(stream, 10).writeStream.format("memory").queryName("stream_windows").outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").start()
    q.processAllAvailable()
    q.stop()
    got = {(r["video_id"], r["window_id"]) for r in spark.sql("select * from stream_windows").collect()}
    want = {(r["video_id"], r["window_id"]) for r in wi.windows(frames, 10).collect()}
    assert got == want


@pytest.mark.parametrize("name", ["lstm", "bilstm", "bigru", "cnn1d", "transformer"])
def test_prediction_memory_does_not_grow_with_rows(name):
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(600, 10, 5)).astype(np.float32), rng.integers(0, 3, 600)
    net = nets.Network(name, 10, 5).fit(x[:64], y[:64], x[64:], y[64:], epochs=1)
    weights = sum(v.nbytes for v in net.state().values())
    assert len(pickle.dumps(net)) < 1.2 * weights + 100_000  # executors are sent the weights, no pass over the rows
    peaks = []
    for many in (1, 10):
        rows = np.tile(x, (many, 1, 1))
        tracemalloc.start()
        got = net.probabilities(rows)
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
        assert got.shape == (len(rows), 3) and np.allclose(got, np.tile(got[:600], (many, 1)), atol=1e-6)
    assert peaks[1] < 1.2 * peaks[0] + 200_000


@pytest.mark.parametrize("name", ["bilstm", "cnn1d", "transformer"])
def test_fit_memory_does_not_grow_with_rows(name):
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(512, 10, 5)).astype(np.float32), rng.integers(0, 3, 512)
    peaks = []
    for many in (1, 4):
        rows, labels = np.tile(x, (many, 1, 1)), np.tile(y, many)
        net = nets.Network(name, 10, 5)
        tracemalloc.start()
        net.fit(rows, labels, rows, labels, epochs=1)
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert peaks[1] < 1.2 * peaks[0] + 200_000  # the epoch's losses over all rows are the driver's peak


def test_sampled_windows_as_arrays(spark, sf):
    w = wi.windows(views.frames(spark, sf), 10, 5).cache()
    x, y = training.sampled(w, 50)
    rows = w.orderBy(F.xxhash64("video_id", "window_id"), "video_id", "window_id").limit(50).collect()
    assert x.dtype == np.float32 and np.array_equal(x, np.array([r["x"] for r in rows], np.float32)) and y.tolist() == [r["label"] for r in rows]
    assert training.sampled(w.where("false"))[0].shape[0] == 0


@pytest.mark.parametrize("name", ["bigru", "bilstm", "cnn1d", "lstm", "transformer"])
def test_fit_takes_every_window(spark, name):
    frames = _separable(spark).cache()
    parts = split.fold_split(wi.with_multiplicity(frames, 8), 2)
    parts = scale.standardized(parts, scale.parameters(parts.where("split = 'train'"))).select(*parts.columns)
    rows = wi.windows(parts.drop("mult"), 8).withColumn("hash", F.xxhash64("video_id", F.lit(0).cast("long"))).orderBy("video_id", "window_id").collect()
    x, y = np.array([r["x"] for r in rows], np.float32), np.array([r["label"] for r in rows])
    train, val = (np.array([r["split"] == s for r in rows]) for s in ("train", "val"))
    assert train.sum() == 162 and val.sum() == 54
    for options, shards in (({}, 1), ({"shard": 15}, 11)):
        total = 0.0
        for k in range(shards):  # a copy on all windows of each shard, then their mean
            mine = train & np.array([r["hash"] % shards == k for r in rows])
            one, adam, rng = nets.Network(name, 8, 5), nets.Adam(), np.random.default_rng((42, 0, k))
            if mine.any():
                one.reseed(rng)
                one.epoch(x[mine], y[mine], adam, rng, 1e-3)
                total = total + one.packed(adam) * mine.sum()
        want = nets.Network(name, 8, 5)
        want.unpack(total / train.sum(), nets.Adam())
        _, history, model = training.train_fold(frames, name, 2, length=8, rows=40, epochs=1, **options)
        # Adam makes a whole step of a rounding where a gradient is almost 0: a few weights may differ by some steps of 1e-3.
        apart = np.concatenate([np.abs(model.state()[key] - value).ravel() for key, value in want.state().items()])
        assert (apart < 1e-4).mean() > 0.99 and apart.max() < 0.01
        assert history[0]["accuracy"] == pytest.approx(want.scores(x[train], y[train])[1] / 162, abs=0.02)
        assert history[0]["val_loss"] == pytest.approx(want.scores(x[val], y[val])[0] / 54, rel=1e-3)


def test_dealt_blocks_hold_every_window(spark, sf):
    parts = split.fold_split(wi.with_multiplicity(views.streams(spark, sf).withColumn("label", (F.col("frame_idx") % 3).cast("int")), 3, 2), 4).drop("mult")
    blocks, shards = training.dealt(parts, 3, 2, FEATURES, shard=50)
    got = sorted((k, x.tobytes(), y) for _, kinds, xs, ys in training._windows_of(iter(blocks.toArrow().to_batches()), 3, 2, 5) for k, x, y in zip(kinds.tolist(), xs, ys.tolist()) if k < 2)
    rows = wi.windows(parts, 3, 2).where("split <> 'test'").collect()
    assert shards > 1 and got == sorted((int(r["split"] == "val"), np.array(r["x"], np.float32).tobytes(), r["label"]) for r in rows)
    blocks.unpersist()
