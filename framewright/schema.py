"""Schemas and small dimension tables of the sequence engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Columns, sentinel, classes, folds, subsets and names.
FEATURES = ["ear", "mar", "pitch", "yaw", "roll"]
#: What a frame without a face holds.
SENTINEL = (0.3, 0.0, 0.0, 0.0, 0.0)
CLASSES = 3
CLASS_NAMES = ["Alert", "Low Vigilant", "Drowsy"]
LABEL_CODES = {"0": 0, "5": 1, "10": 2}
FOLDS, SUBJECTS_PER_FOLD = 5, 12
SUBSETS = {"ear": [0], "ear_mar": [0, 1], "all": [0, 1, 2, 3, 4]}
SUBSET_NAMES = {"ear": "EAR Only", "ear_mar": "EAR + MAR", "all": "EAR + MAR + HeadPose (5 Features)"}
MODELS = ["bilstm", "lstm", "bigru", "cnn1d", "transformer", "xgboost"]
VIDEO_SUFFIXES = [".mp4", ".mov", ".avi", ".mkv", ".webm"]

VIDEO = "label int, subject_id int, fold_id int, video_path string, filename string"
FRAME = "video_id string, frame_idx int, ear float, mar float, pitch float, yaw float, roll float"


def labels(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, v, CLASS_NAMES[v]) for k, v in LABEL_CODES.items()], "code string, label int, name string")


def folds(spark: SparkSession) -> DataFrame:
    """Fold ranges: subjects lo to hi belong to the fold."""
    rows = [(f, (f - 1) * SUBJECTS_PER_FOLD + 1, f * SUBJECTS_PER_FOLD) for f in range(1, FOLDS + 1)]
    return spark.createDataFrame(rows, "fold_id int, lo int, hi int")


def subsets(spark: SparkSession) -> DataFrame:
    rows = [(k, v, SUBSET_NAMES[k], len(v)) for k, v in SUBSETS.items()]
    return spark.createDataFrame(rows, "subset string, indices array<int>, display_name string, num_features int")


def subset_columns(subset: str) -> list[str]:
    """Feature columns of a subset; an unknown name is an error."""
    if subset not in SUBSETS:
        raise ValueError(f"unknown feature subset {subset!r}; known: {sorted(SUBSETS)}")
    return [FEATURES[i] for i in SUBSETS[subset]]
