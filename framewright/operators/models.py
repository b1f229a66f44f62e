"""Model registry of MLlib.  Trainers take a frame of (features vector, label) and return a fitted transformer.

The networks and boosted trees themselves are in ``nets`` and ``boosting`` and run
through ``training``.  Here other libraries' estimators plug in through
:func:`register`, and MLlib stand-ins, named as such, are fitted on all rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

REGISTRY: dict[str, Callable] = {}
#: Names that no MLlib estimator has, and the stand-in that is fitted on all rows.
STAND_INS = {"xgboost": "random_forest", "bilstm": "mlp", "lstm": "mlp", "bigru": "mlp", "cnn1d": "mlp", "transformer": "mlp"}


def register(name: str, build: Callable) -> None:
    REGISTRY[name] = build


register("random_forest", lambda n, seed=42, **p: RandomForestClassifier(numTrees=p.get("trees", 30), maxDepth=p.get("depth", 6), seed=seed))
register("logistic", lambda n, seed=42, **p: LogisticRegression(maxIter=p.get("steps", 50)))
register("mlp", lambda n, seed=42, **p: MultilayerPerceptronClassifier(layers=[n, 32, 3], maxIter=p.get("steps", 40), seed=seed))


def builder(name: str, stand_in: bool = False) -> Callable:
    if name in REGISTRY:
        return REGISTRY[name]
    if stand_in and name in STAND_INS:
        return REGISTRY[STAND_INS[name]]
    raise KeyError(f"model {name!r} is not registered; known: {sorted(REGISTRY)}")


def vectors(windows: DataFrame, size: int, x: str = "x") -> DataFrame:
    """``features``: the flattened window as a vector of ``size`` elements.

    The length is held explicitly: a model's function may run on rows that a
    later part of the same filter drops, short windows at a stream's end.
    """
    flat = F.transform(F.flatten(x), lambda v: v.cast("double"))
    full = F.slice(F.concat(flat, F.array_repeat(F.lit(0.0), size)), 1, size)
    return windows.withColumn("features", array_to_vector(full)).withColumn("label", F.col("label").cast("double"))


def train(name: str, windows: DataFrame, size: int, stand_in: bool = False, **params):
    return builder(name, stand_in)(size, **params).fit(vectors(windows, size))


def predict(model, windows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, y_true, y_pred (first maximum) and probabilities."""
    out = model.transform(vectors(windows, model.numFeatures))
    p = vector_to_array("probability")
    return out.select(*keys, F.col("label").cast("int").alias("y_true"), (F.array_position(p, F.array_max(p)) - 1).cast("int").alias("y_pred"), p.alias("probability"))


def importances(model, names: list[str], spark) -> DataFrame:
    """Feature importances of a tree model: one row an input, a fixed number."""
    return spark.createDataFrame(list(zip(names, map(float, model.featureImportances.toArray()))), "feature string, importance double")
