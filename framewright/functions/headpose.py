"""Head pose from six landmarks: the one feature that needs numpy.

Pinhole camera with focal length = frame width and centre (w/2, h/2), no
distortion.  The pose is found by least squares (Gauss-Newton with damping on
the rotation vector and translation) for all rows of a batch at once; the
rotation's RQ angles in degrees are pitch, yaw and roll.  Rows that do not
converge give zeros.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Model points of nose, chin, eye corners and mouth corners.
MODEL = np.array([(0, 0, 0), (0, -330, -65), (-225, 170, -135), (225, 170, -135), (-150, -150, -125), (150, -150, -125)], float)


def rotation(v: np.ndarray) -> np.ndarray:
    """Rotation matrices of rotation vectors (n, 3)."""
    angle = np.linalg.norm(v, axis=1)[:, None, None]
    k = np.zeros((len(v), 3, 3))
    k[:, 0, 1], k[:, 0, 2], k[:, 1, 2] = -v[:, 2], v[:, 1], -v[:, 0]
    k -= np.transpose(k, (0, 2, 1))
    safe = np.where(angle < 1e-12, 1, angle)
    a = np.where(angle < 1e-12, 1.0, np.sin(safe) / safe)
    b = np.where(angle < 1e-12, 0.5, (1 - np.cos(safe)) / safe**2)
    return np.eye(3) + a * k + b * (k @ k)


def project(v: np.ndarray, t: np.ndarray, width: float, height: float) -> np.ndarray:
    """Pixels (n, 6, 2) of the model under poses (rotation vectors, translations)."""
    cam = MODEL @ np.transpose(rotation(v), (0, 2, 1)) + t[:, None, :]
    z = np.where(np.abs(cam[:, :, 2]) < 1e-9, 1e-9, cam[:, :, 2])
    return np.stack([width * cam[:, :, 0] / z + width / 2, width * cam[:, :, 1] / z + height / 2], axis=2)


def rq_angles(r: np.ndarray) -> np.ndarray:
    """Degrees about x, y and z of the rotations that bring R to an upper triangle from the right."""
    x = np.arctan2(r[:, 2, 1], r[:, 2, 2])
    y = np.arctan2(-r[:, 2, 0], np.hypot(r[:, 2, 1], r[:, 2, 2]))
    z = np.arctan2(r[:, 1, 0], r[:, 0, 0])
    return np.degrees(np.stack([x, y, z], axis=1))


def solve(points: np.ndarray, width: float, height: float, steps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """(rotation vectors, ok) for pixels (n, 6, 2), from several starts."""
    n = len(points)
    best, cost = np.zeros((n, 6)), np.full(n, np.inf)
    for start in ((np.pi, 0, 0), (0, 0, 0)):
        p = np.tile(np.array([*start, 0, 0, 3.0 * width]), (n, 1))
        damp, err = np.full(n, 1e-3), np.full(n, np.inf)
        for _ in range(steps):
            base = project(p[:, :3], p[:, 3:], width, height)
            res = (points - base).reshape(n, 12)
            err = (res**2).sum(axis=1)
            jac = np.empty((n, 12, 6))
            for k in range(6):
                q, h = p.copy(), 1e-6 if k < 3 else 1e-3
                q[:, k] += h
                jac[:, :, k] = (project(q[:, :3], q[:, 3:], width, height) - base).reshape(n, 12) / h
            a = np.transpose(jac, (0, 2, 1)) @ jac
            diag = np.einsum("nii->ni", a)
            diag *= 1 + damp[:, None]
            diag += 1e-9
            move = np.linalg.solve(a, (np.transpose(jac, (0, 2, 1)) @ res[:, :, None]))[:, :, 0]
            new = ((points - project(p[:, :3] + move[:, :3], p[:, 3:] + move[:, 3:], width, height)) ** 2).sum(axis=(1, 2))
            good = new < err
            p[good] += move[good]
            damp = np.clip(np.where(good, damp / 4, damp * 6), 1e-9, 1e9)
        final = ((points - project(p[:, :3], p[:, 3:], width, height)) ** 2).sum(axis=(1, 2))
        final = np.where(p[:, 5] > 0, final, np.inf)  # the face is in front of the camera
        take = final < cost
        best[take], cost[take] = p[take], final[take]
    return best[:, :3], np.isfinite(cost)


def head_pose(points: Column, width: int, height: int) -> Column:
    """struct(pitch, yaw, roll) of six (x, y) pixel structs."""

    @F.pandas_udf("pitch double, yaw double, roll double")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in parts:
            raw = np.array([[(q["x"], q["y"]) for q in row] for row in part], float).reshape(-1, 6, 2)
            v, ok = solve(raw, width, height)
            angles = np.where(ok[:, None], rq_angles(rotation(v)), 0.0)
            yield pd.DataFrame(angles, columns=["pitch", "yaw", "roll"])

    return run(points)
