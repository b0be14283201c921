"""Scalar functions of images, curves and filters as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def minmax(v: Column, low: Column, high: Column) -> Column:
    """To 0 .. 1 with a small term that keeps flat images finite."""
    return (v - low) / (high - low + 1e-8)


def catmull_rom(t: Column, p: list[Column]) -> Column:
    """The curve through the two inner of four values, at t from 0 to 1 between them."""
    a, b, c, d = p
    return 0.5 * (2 * b + (c - a) * t + (2 * a - 5 * b + 4 * c - d) * t * t + (3 * b - a - 3 * c + d) * t * t * t)


def spline_weights(t: Column) -> list[Column]:
    """Weights of the uniform cubic B-spline."""
    u = 1 - t
    return [u * u * u / 6, (3 * t * t * t - 6 * t * t + 4) / 6, (3 * u * u * u - 6 * u * u + 4) / 6, t * t * t / 6]


def b_spline(t: Column, p: list[Column]) -> Column:
    return sum((w * x for w, x in zip(spline_weights(t), p, strict=True)), F.lit(0.0))


def clamped_byte(v: Column) -> Column:
    """0 to 255, without its fraction."""
    return F.floor(F.greatest(F.lit(0.0), F.least(F.lit(255.0), v))).cast("int")


def rotated(x: Column, y: Column, z: Column, quaternion: tuple[float, float, float, float]) -> list[Column]:
    """The point turned by a quaternion (w, x, y, z), which is made a unit one."""
    n = math.sqrt(sum(q * q for q in quaternion))
    w, a, b, c = (q / n for q in quaternion)
    m = [
        (1 - 2 * (b * b + c * c), 2 * (a * b - w * c), 2 * (a * c + w * b)),
        (2 * (a * b + w * c), 1 - 2 * (a * a + c * c), 2 * (b * c - w * a)),
        (2 * (a * c - w * b), 2 * (b * c + w * a), 1 - 2 * (a * a + b * b)),
    ]
    return [x * r[0] + y * r[1] + z * r[2] for r in m]


def from_euler(rx: float, ry: float, rz: float) -> tuple[float, float, float, float]:
    """The quaternion of turns about x, then y, then z."""
    cx, sx, cy, sy, cz, sz = (f(r / 2) for r in (rx, ry, rz) for f in (math.cos, math.sin))
    return cx * cy * cz + sx * sy * sz, sx * cy * cz - cx * sy * sz, cx * sy * cz + sx * cy * sz, cx * cy * sz - sx * sy * cz


def filter_response(kind: str, frequency: Column) -> Column:
    """Response of a reconstruction filter at a frequency from 0 to 1: ramp, shepp-logan, cosine, hamming or hann."""
    f = F.least(F.abs(frequency), F.lit(1.0))
    half = f * (math.pi / 2)
    return {
        "ramp": f,
        "shepp-logan": F.when(f < 1e-6, F.lit(0.0)).otherwise(f * F.sin(half) / half),
        "cosine": f * F.cos(half),
        "hamming": f * (0.54 + 0.46 * F.cos(2 * half)),
        "hann": f * (0.5 + 0.5 * F.cos(2 * half)),
    }[kind]


def gaussian(v: Column, mean: Column, sd: Column) -> Column:
    return F.exp(-(v - mean) * (v - mean) / (2 * sd * sd)) / (sd * math.sqrt(2 * math.pi))


def edge_weight(a: Column, b: Column, beta: float) -> Column:
    """How freely a walker passes between two values of 16 bits."""
    return F.exp(-beta * (a - b) * (a - b) / 65536.0**2)


def unary_energy(share: Column) -> Column:
    return -F.log(share + 0.01)


def pairwise_energy(a: Column, b: Column, sigma: float) -> Column:
    return F.exp(-(a - b) * (a - b) / (2 * sigma * sigma))


def softmax(scores: Column) -> Column:
    """An array of scores as probabilities."""
    raised = F.transform(scores, lambda s: F.exp(s - F.array_max(scores)))
    return F.transform(raised, lambda e: e / F.aggregate(raised, F.lit(0.0), lambda x, y: x + y))


def argmax(scores: Column) -> Column:
    """Place (from 0) of the largest, the first of equals."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def colour_difference(one: list[Column], other: list[Column]) -> Column:
    """Distance of two Lab colours (1976)."""
    return F.sqrt(sum((F.pow(a - b, F.lit(2.0)) for a, b in zip(one, other, strict=True)), F.lit(0.0)))


def gamma(v: Column, exponent: float) -> Column:
    return F.pow(F.greatest(F.lit(0.0), F.least(F.lit(1.0), v)), F.lit(exponent))


def to_cmyk(r: Column, g: Column, b: Column) -> list[Column]:
    k = 1 - F.greatest(r, g, b)
    ink = lambda c: F.when(k >= 1 - 1e-10, F.lit(0.0)).otherwise((1 - c - k) / (1 - k))
    return [ink(r), ink(g), ink(b), k]


def from_cmyk(c: Column, m: Column, y: Column, k: Column) -> list[Column]:
    return [(1 - x) * (1 - k) for x in (c, m, y)]
