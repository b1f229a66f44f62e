"""Training and evaluation by fold: subject-disjoint splits, scaling fitted on the training split, one result row a fold.

A network is fitted in the executors on all windows of the training split and
stopped by all of the validation split (:func:`fit_network`); the driver holds
its weights alone.  Trees are fitted by the driver on at most ``MAX_WINDOWS``
windows of a split, those with the smallest hash of their key.  All windows of
the test split are predicted, in the executors.
"""

from __future__ import annotations

import copy
import itertools
import os
import time
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright import schema
from framewright.operators import metrics, scale, split
from framewright.operators import windows as wi
from framewright.operators.boosting import SoftmaxTrees
from framewright.operators.nets import Adam, Network

#: Windows of a split that trees are fitted on or stopped by at most.
MAX_WINDOWS = 20_000
#: Training windows that one copy of a network takes in an epoch, about; more make more copies.
SHARD = 20_000
#: Copies of a network that are added up by a task, or by the driver.
FAN = 8
#: Windows that are scored together.
SCORED = 4096
TREES = "xgboost"


def sampled(windows: DataFrame, rows: int = MAX_WINDOWS) -> tuple[np.ndarray, np.ndarray]:
    """(x, y) of at most ``rows`` windows, in the order of their keys' hashes."""
    key = F.xxhash64("video_id", "window_id")
    # A top-k in each task; flat rows reach the driver as one array, not as an object a frame.
    got = windows.orderBy(key, "video_id", "window_id").limit(rows).select(F.flatten("x").alias("x"), F.size("x").alias("steps"), "label").toArrow()
    x = got["x"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float32)
    return x.reshape(got.num_rows, got["steps"][0].as_py() if got.num_rows else 0, -1 if len(x) else 0), got["label"].to_numpy().astype(int)


def predicted(model, windows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, y_true, y_pred and probability of every window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(batch.num_columns - 1)
            steps = len(x[0]) if batch.num_rows else 1
            flat = np.asarray(x.flatten().flatten(), np.float32).reshape(batch.num_rows, steps, -1)
            p = model.probabilities(flat).astype(float) if batch.num_rows else np.zeros((0, schema.CLASSES))
            cols = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(p.argmax(axis=1), pa.int32()), pa.array(p.tolist(), pa.list_(pa.float64()))], names=[*keys, "y_true", "y_pred", "probability"])

    kinds = {f.name: f.dataType.simpleString() for f in windows.schema.fields}
    out = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", y_true int, y_pred int, probability array<double>"
    return windows.select(*keys, F.col("label").cast("int").alias("y_true"), "x").mapInArrow(run, out)


def dealt(frames: DataFrame, length: int, step: int, columns: list[str], shard: int = SHARD) -> tuple[DataFrame, int]:
    """The blocks that begin a window of the splits 'train' and 'val', and the number of shards that they are dealt to.

    A shard has about ``shard`` training windows: a partition, in a fixed order,
    of one row a block on the executors' disks, so a frame is stored about once
    and not once a window.  ``kinds`` says of each frame whether a window that
    begins there is of 'train' (0), of 'val' (1) or of neither (2).
    """
    at = lambda c: (F.col(c) - F.col("_first")).cast("int")
    kind = lambda r: F.when(r["c"]["split"] == "train", 0).when(r["c"]["split"] == "val", 1).otherwise(2).cast("byte")
    flat = wi.blocks(frames, length, step, columns).select("video_id", "_first", at("_start").alias("start"), at("_last").alias("last"), F.flatten("rows.x").alias("x"), F.col("rows.c.label").cast("array<int>").alias("labels"), F.transform("rows", kind).alias("kinds"))
    flat = flat.withColumn("fits", F.size(F.filter(F.sequence("start", "last", F.lit(step)), lambda s: F.get("kinds", s) == 0))).where("exists(kinds, k -> k < 2)").persist(StorageLevel.DISK_ONLY)
    many = flat.agg(F.sum("fits")).first()[0] or 0
    shards = max(1, -(-many // shard))
    out = flat.withColumn("shard", F.pmod(F.xxhash64("video_id", "_first"), F.lit(shards)).cast("int")).repartitionById(shards, "shard").sortWithinPartitions("shard", "video_id", "_first").persist(StorageLevel.DISK_ONLY)
    out.count()
    flat.unpersist()
    return out, shards


def _windows_of(batches: Iterator[pa.RecordBatch], length: int, step: int, features: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(shard, kinds, x, y) of the windows of each block; x is a view of the block's frames."""
    for batch in batches:
        shard, start, last, x, labels, kinds = (batch.column(c) for c in ("shard", "start", "last", "x", "labels", "kinds"))
        for i in range(batch.num_rows):
            own = slice(start[i].as_py(), last[i].as_py() + 1, step)
            values = x[i].values.to_numpy(zero_copy_only=False).astype(np.float32).reshape(-1, features)
            slid = np.lib.stride_tricks.sliding_window_view(values, length, axis=0).transpose(0, 2, 1)[own]
            yield shard[i].as_py(), kinds[i].values.to_numpy(zero_copy_only=False)[own], slid, labels[i].values.to_numpy(zero_copy_only=False)[own].astype(int)


_COPY = {"shard": "int", "windows": "long", "losses": "double", "batches": "long", "steps": "double", "weights": "binary"}
_COPY_TYPES = (pa.int32(), pa.int64(), pa.float64(), pa.int64(), pa.float64(), pa.binary())


def _copied(row: dict) -> pa.RecordBatch:
    row = row | {"weights": row["weights"].tobytes()}
    return pa.RecordBatch.from_arrays([pa.array([row[c]], t) for c, t in zip(_COPY, _COPY_TYPES)], names=list(_COPY))


def _added(batches: Iterator[pa.RecordBatch], by: str) -> Iterator[dict]:
    """The sums of the copies of each value of ``by``, one after the other."""
    rows = (row for batch in batches for i in range(batch.num_rows) for row in batch.slice(i, 1).to_pylist())
    for value, mine in itertools.groupby(rows, lambda r: r[by] if by else 0):
        total: dict = {}
        for row in mine:
            own = row | {"weights": np.frombuffer(row["weights"], float)}
            total = {c: total[c] + own[c] for c in _COPY} if total else own
        yield total | {"shard": value}


def fit_network(model: Network, frames: DataFrame, length: int, step: int, columns: list[str], shard: int = SHARD, batch: int = 64, **options) -> Network:
    """Fit ``model`` on every window of the split 'train', stopped by every one of 'val'; ``options`` are those of ``Network.fit_by``.

    In each epoch a copy of the network takes the windows of each shard, in
    batches of ``batch``; then the copies' weights and moments are averaged, each
    weighted by its windows.  With one shard this is plain stochastic descent.
    Shards and draws depend on the rows alone, not on the cluster.
    """
    blocks, shards = dealt(frames, length, step, columns, shard)
    adam, features = Adam(), len(columns)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from map(_copied, _added(batches, "group"))

    def learn(epoch: int, rate: float) -> float:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for number, rows in itertools.groupby(_windows_of(batches, length, step, features), lambda r: r[0]):
                parts = [(x[kinds == 0], y[kinds == 0]) for _, kinds, x, y in rows]
                x, y = (np.concatenate(p) for p in zip(*parts))
                one, own, rng = copy.deepcopy(model), copy.deepcopy(adam), np.random.default_rng((model.seed, epoch, number))
                one.reseed(rng)
                losses = one.epoch(x, y, own, rng, rate, batch)
                yield _copied({"shard": number, "windows": len(y), "losses": sum(losses), "batches": len(losses), "steps": own.steps * len(y), "weights": one.packed(own) * len(y)})

        kinds = ", ".join(f"{c} {t}" for c, t in _COPY.items())
        copies, left = blocks.where("fits > 0").mapInArrow(run, kinds), shards
        while left > FAN:  # the driver adds up a few copies, however many there are
            left = -(-left // FAN)
            copies = copies.withColumn("group", F.expr(f"shard div {FAN}").cast("int")).repartitionById(left, "group").sortWithinPartitions("group", "shard").mapInArrow(add, kinds)
        total = next(_added(copies.toArrow().sort_by("shard").to_batches(), ""), None)
        if not total:
            return float("nan")
        model.unpack(total["weights"] / total["windows"], adam)
        adam.steps = total["steps"] / total["windows"]
        return total["losses"] / total["batches"]

    def score() -> list[tuple[float, float]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums, held, many = np.zeros((2, 3)), [], 0

            def take() -> None:
                for kind in (0, 1):
                    x, y = (np.concatenate([r[v][r[1] == kind] for r in held]) for v in (2, 3))
                    if len(y):
                        loss, right = model.scores(x, y)
                        sums[kind] += len(y), loss, right

            for row in _windows_of(batches, length, step, features):
                held, many = [*held, row], many + len(row[3])
                if many >= SCORED:
                    take()
                    held, many = [], 0
            if held:
                take()
            yield pa.RecordBatch.from_arrays([pa.array([0, 1], pa.int32()), *(pa.array(sums[:, i]) for i in range(3))], names=["kind", "n", "loss", "hits"])

        got = {r["kind"]: r for r in blocks.mapInArrow(run, "kind int, n double, loss double, hits double").groupBy("kind").agg(*[F.sum(c).alias(c) for c in ("n", "loss", "hits")]).collect()}  # two rows
        return [(got[k]["loss"] / got[k]["n"], got[k]["hits"] / got[k]["n"]) if k in got and got[k]["n"] else (float("nan"), float("nan")) for k in (0, 1)]

    try:
        return model.fit_by(learn, score, **options)
    finally:
        blocks.unpersist()


def train_fold(frames: DataFrame, name: str, test_fold: int, subset: str = "all", length: int = 30, step: int = 1, rows: int = MAX_WINDOWS, folder: str | None = None, **options) -> tuple[dict, list[dict], object]:
    """Train ``name`` with ``test_fold`` left out: its result, its history and the model.

    Networks see standardised features and all windows, trees the features as
    they are and at most ``rows`` windows of a split.  With a ``folder`` the best
    model is written there.  ``options`` go to the trainer.
    """
    columns = schema.subset_columns(subset)
    parts = split.fold_split(wi.with_multiplicity(frames, length, step), test_fold)
    if name != TREES:
        parts = scale.standardized(parts, scale.parameters(parts.where("split = 'train'"), features=columns), columns).select(*parts.columns)
    parts = parts.drop("mult")
    windows = wi.windows(parts, length, step, columns)
    shape = {k: options.pop(k) for k in ("trees", "rate", "depth", "seed", "dropout") if k in options}
    if name == TREES:
        (x, y), (val_x, val_y) = (sampled(windows.where(F.col("split") == s), rows) for s in ("train", "val"))
        model = SoftmaxTrees(**shape)
        began = time.perf_counter()
        model.fit(x, y, val_x, val_y, **options)
    else:
        model = Network(name, length, len(columns), **shape)
        began = time.perf_counter()
        fit_network(model, parts, length, step, columns, **options)
    took = time.perf_counter() - began
    test = windows.where("split = 'test'")
    began = time.perf_counter()
    pred = predicted(model, test, ["video_id", "window_id"]).cache()
    many = pred.count()
    inference = time.perf_counter() - began
    scores = metrics.averages(pred).drop("support").first().asDict()
    table = {(r["y_true"], r["y_pred"]): r["n"] for r in metrics.confusion(pred).collect()}  # a row for each pair of classes
    result = {
        "model": name, "feature_subset": subset, "fold": test_fold, **scores, "log_loss": metrics.log_loss(pred).first()[0],
        "confusion_matrix": [[table[a, b] for b in range(schema.CLASSES)] for a in range(schema.CLASSES)],
        "epochs": len(model.history), "training_time_sec": took, "test_samples": many, "test_inference_time_sec": inference,
        "inference_latency_ms": inference / many * 1000 if many else 0.0, "inference_throughput_fps": many / inference if inference else 0.0,
    }
    pred.unpersist()
    if folder:
        os.makedirs(folder, exist_ok=True)
        result["checkpoint_path"] = os.path.join(folder, f"{name}_{subset}_fold{test_fold}_best.{'json' if name == TREES else 'npz'}")
        model.save(result["checkpoint_path"])
    history = [{"model": name, "feature_subset": subset, "fold": test_fold, **h} for h in model.history]
    return result, history, model


def load(path: str):
    """A model that :func:`train_fold` has written."""
    return SoftmaxTrees.load(path) if path.endswith(".json") else Network.load(path)


def cross_validate(frames: DataFrame, name: str, folds: list[int], **options) -> tuple[DataFrame, DataFrame]:
    """Results and histories, one row a fold and one an epoch."""
    results, histories = [], []
    for fold in folds:
        result, history, _ = train_fold(frames, name, fold, **options)
        results.append({k: v for k, v in result.items() if k != "confusion_matrix"})
        histories += history
    return frames.sparkSession.createDataFrame(results), frames.sparkSession.createDataFrame(histories)
