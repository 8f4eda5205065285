"""Rigid poses ``tx ty tz qx qy qz qw`` as structs of columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PARTS = ("tx", "ty", "tz", "qx", "qy", "qz", "qw")


def pose(*values: Column) -> Column:
    return F.struct(*(v.alias(k) for k, v in zip(PARTS, values)))


def identity() -> Column:
    return pose(*(F.lit(float(k == "qw")) for k in PARTS))


def rotate(q: Column, x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    a, b, c = 2 * (q.qy * z - q.qz * y), 2 * (q.qz * x - q.qx * z), 2 * (q.qx * y - q.qy * x)
    return x + q.qw * a + q.qy * c - q.qz * b, y + q.qw * b + q.qz * a - q.qx * c, z + q.qw * c + q.qx * b - q.qy * a


def multiply(p: Column, q: Column) -> tuple[Column, ...]:
    """The rotation ``q``, then ``p``."""
    return (
        p.qw * q.qx + p.qx * q.qw + p.qy * q.qz - p.qz * q.qy,
        p.qw * q.qy - p.qx * q.qz + p.qy * q.qw + p.qz * q.qx,
        p.qw * q.qz + p.qx * q.qy - p.qy * q.qx + p.qz * q.qw,
        p.qw * q.qw - p.qx * q.qx - p.qy * q.qy - p.qz * q.qz,
    )


def yaw(qx: Column, qy: Column, qz: Column, qw: Column) -> Column:
    return F.atan2(2 * (qw * qz + qx * qy), 1 - 2 * (qy * qy + qz * qz))


def compose(p: Column, q: Column) -> Column:
    """First ``q``, then ``p``."""
    x, y, z = rotate(p, q.tx, q.ty, q.tz)
    return pose(x + p.tx, y + p.ty, z + p.tz, *multiply(p, q))


def invert(p: Column) -> Column:
    back = pose(F.lit(0.0), F.lit(0.0), F.lit(0.0), -p.qx, -p.qy, -p.qz, p.qw)
    x, y, z = rotate(back, -p.tx, -p.ty, -p.tz)
    return pose(x, y, z, -p.qx, -p.qy, -p.qz, p.qw)


def interpolate(p: Column, q: Column, k: Column) -> Column:
    """Straight between positions, on the shorter arc between rotations."""
    dot = p.qx * q.qx + p.qy * q.qy + p.qz * q.qz + p.qw * q.qw
    sign, cos = F.when(dot < 0, -1.0).otherwise(1.0), F.least(F.abs(dot), F.lit(1.0))
    angle = F.acos(cos)
    near = F.sin(angle) < 1e-9
    a = F.when(near, 1 - k).otherwise(F.sin((1 - k) * angle) / F.sin(angle))
    b = F.when(near, k).otherwise(F.sin(k * angle) / F.sin(angle)) * sign
    flat = [p[c] + k * (q[c] - p[c]) for c in PARTS[:3]]
    return pose(*flat, *(a * p[c] + b * q[c] for c in PARTS[3:]))


def apply_point(p: Column, x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    a, b, c = rotate(p, x, y, z)
    return a + p.tx, b + p.ty, c + p.tz
