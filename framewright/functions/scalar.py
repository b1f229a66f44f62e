"""Scalar and array expressions; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def distance(p: Column, q: Column) -> Column:
    """Euclidean distance of two points with fields x and y."""
    return F.hypot(p["x"] - q["x"], p["y"] - q["y"])


def _ratio(up: list[Column], across: Column) -> Column:
    total = up[0]
    for u in up[1:]:
        total = total + u
    return F.when(across == 0, F.lit(0.0)).otherwise(total / (2.0 * across))


def eye_aspect_ratio(p: list[Column]) -> Column:
    """Six points; 0 where the corners coincide."""
    return _ratio([distance(p[1], p[5]), distance(p[2], p[4])], distance(p[0], p[3]))


def mouth_aspect_ratio(p: list[Column]) -> Column:
    """Eight points, three heights over twice the width; 0 where the corners coincide."""
    return _ratio([distance(p[1], p[7]), distance(p[2], p[6]), distance(p[3], p[5])], distance(p[0], p[4]))


# Landmark indices of the face mesh.
LEFT_EYE = [33, 160, 158, 133, 153, 144]
RIGHT_EYE = [362, 385, 387, 263, 373, 380]
MOUTH = [78, 81, 13, 311, 308, 402, 14, 178]
POSE = [1, 152, 33, 263, 61, 291]


def pixel(point: Column, width: int, height: int) -> Column:
    """A normalised point in whole pixels, cut toward zero."""
    return F.struct((point["x"] * width).cast("int").alias("x"), (point["y"] * height).cast("int").alias("y"))


def landmark_ratios(landmarks: Column, width: int, height: int) -> tuple[Column, Column]:
    """(ear, mar) of an array of normalised landmarks."""
    at = lambda idx: [pixel(F.get(landmarks, F.lit(i)), width, height) for i in idx]
    ear = (eye_aspect_ratio(at(LEFT_EYE)) + eye_aspect_ratio(at(RIGHT_EYE))) / 2.0
    return ear, mouth_aspect_ratio(at(MOUTH))


def one_hot(label: Column, classes: int) -> Column:
    """Float array with a one at the label; null for labels out of range."""
    row = F.transform(F.sequence(F.lit(0), F.lit(classes - 1)), lambda k: (k == label).cast("float"))
    return F.when((label >= 0) & (label < classes), row)


def arg_max(values: Column) -> Column:
    """Index of the first maximum."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def softmax(values: Column) -> Column:
    top = F.array_max(values)
    e = F.transform(values, lambda v: F.exp(v - top))
    total = F.aggregate(e, F.lit(0.0), lambda s, v: s + v)
    return F.transform(e, lambda v: v / total)


def clamp(value: Column, low: int, high: int) -> Column:
    return F.least(F.greatest(value, F.lit(low)), F.lit(high))
