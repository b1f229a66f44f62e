"""Standardisation fitted on the training split only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.schema import FEATURES


def parameters(frames: DataFrame, weight: str = "mult", features: list[str] | None = None) -> DataFrame:
    """One row: mean and population deviation of each feature over window timesteps, as float32.

    Frames count as often as windows hold them.  Moments are summed about the
    first pass's mean, so a large mean does not cancel the variance; deviations
    below 1e-8 become 1.
    """
    features = features or FEATURES
    used = frames.where(F.col(weight) > 0)
    w = F.col(weight).cast("double")
    mean = used.agg(*[(F.sum(w * F.col(c).cast("double")) / F.sum(w)).alias(f"_{c}") for c in features])
    about = used.join(F.broadcast(mean))  # one row
    dev = about.agg(*[F.any_value(F.col(f"_{c}")).alias(f"{c}_mean") for c in features], *[F.sqrt(F.sum(w * F.pow(F.col(c).cast("double") - F.col(f"_{c}"), 2)) / F.sum(w)).alias(f"{c}_std") for c in features])
    return dev.select(
        *[F.col(f"{c}_mean").cast("float") for c in features],
        *[F.when(F.col(f"{c}_std") < 1e-8, 1.0).otherwise(F.col(f"{c}_std")).cast("float").alias(f"{c}_std") for c in features],
    )


def standardized(frames: DataFrame, params: DataFrame, features: list[str] | None = None) -> DataFrame:
    """(x - mean) / std in float32; ``params`` is one row."""
    features = features or FEATURES
    out = frames.join(F.broadcast(params))
    cols = [((F.col(c) - F.col(f"{c}_mean")).cast("float") / F.col(f"{c}_std")).cast("float").alias(c) if c in features else F.col(c) for c in frames.columns]
    return out.select(*cols)
