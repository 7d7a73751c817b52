"""Rotations and affine transforms: small driver-side matrices that parametrise resampling."""

from __future__ import annotations

import numpy as np


def rotation_x(t: float) -> np.ndarray:
    c, s = np.cos(t), np.sin(t)
    return np.array([[1, 0, 0], [0, c, -s], [0, s, c]])


def rotation_y(t: float) -> np.ndarray:
    c, s = np.cos(t), np.sin(t)
    return np.array([[c, 0, s], [0, 1, 0], [-s, 0, c]])


def rotation_z(t: float) -> np.ndarray:
    c, s = np.cos(t), np.sin(t)
    return np.array([[c, -s, 0], [s, c, 0], [0, 0, 1]])


def rotation(angles) -> np.ndarray:
    """Euler angles about x, y, z."""
    return rotation_x(angles[0]) @ rotation_y(angles[1]) @ rotation_z(angles[2])


def rotation_angles(r: np.ndarray) -> np.ndarray:
    """Inverse of rotation(); at the gimbal's lock the last angle is 0."""
    y = np.arcsin(np.clip(r[0, 2], -1, 1))
    if abs(np.cos(y)) < 1e-6:
        return np.array([np.arctan2(r[2, 1], r[1, 1]), y, 0.0])
    return np.array([np.arctan2(-r[1, 2], r[2, 2]), y, np.arctan2(-r[0, 1], r[0, 0])])


def axis_rotation(axis, t: float) -> np.ndarray:
    a = np.asarray(axis, float) / np.linalg.norm(axis)
    k = np.array([[0, -a[2], a[1]], [a[2], 0, -a[0]], [-a[1], a[0], 0]])
    return np.eye(3) + np.sin(t) * k + (1 - np.cos(t)) * k @ k


def rotation_between(u, v) -> np.ndarray:
    """Turns unit vector u to v; -I if they are opposite."""
    u, v = np.asarray(u, float), np.asarray(v, float)
    c = u @ v
    return -np.eye(3) if c <= -1 + 1e-12 else np.outer(u + v, u + v) / (c + 1) - np.eye(3)


def affine(shift, angles, scaling, shear=(0, 0, 0)) -> np.ndarray:
    """3x4 from twelve parameters: shear, then scaling, then rotation, then shift."""
    a = np.array([[1, shear[0], shear[1]], [0, 1, shear[2]], [0, 0, 1.0]])
    return np.hstack([rotation(angles) @ np.diag(scaling) @ a, np.asarray(shift, float)[:, None]])


def affine_parameters(m: np.ndarray) -> dict:
    """Inverse of affine()."""
    q, r = np.linalg.qr(m[:, :3])
    s = np.sign(np.diag(r))
    s[s == 0] = 1
    q, r = q * s, r * s[:, None]
    d = np.diag(r)
    return {"shift": m[:, 3], "angles": rotation_angles(q), "scaling": d, "shear": np.array([r[0, 1] / d[0], r[0, 2] / d[0], r[1, 2] / d[1]])}


def full(m: np.ndarray) -> np.ndarray:
    return np.vstack([m, [0, 0, 0, 1]])


def compose(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a after b."""
    return (full(a) @ full(b))[:3]


def inverse(m: np.ndarray) -> np.ndarray:
    return np.linalg.inv(full(m))[:3]


def from_space(origin: np.ndarray, target: np.ndarray) -> np.ndarray:
    return np.linalg.inv(target) @ origin


def voxel_size(m: np.ndarray) -> np.ndarray:
    return np.linalg.norm(m[:3, :3], axis=0)
