"""Colour spaces as column expressions (channels in 0..1 unless said otherwise)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# sRGB primaries under D65 and the D65 white point.
TO_XYZ = ((0.4124564, 0.3575761, 0.1804375), (0.2126729, 0.7151522, 0.0721750), (0.0193339, 0.1191920, 0.9503041))
WHITE = (0.95047, 1.0, 1.08883)


def linear(c: Column) -> Column:
    """sRGB to linear light."""
    return F.when(c <= 0.04045, c / 12.92).otherwise(F.pow((c + 0.055) / 1.055, F.lit(2.4)))


def companded(c: Column) -> Column:
    """Linear light to sRGB."""
    return F.when(c <= 0.0031308, c * 12.92).otherwise(1.055 * F.pow(c, F.lit(1 / 2.4)) - 0.055)


def xyz(r: Column, g: Column, b: Column) -> tuple[Column, ...]:
    x, y, z = (linear(c) for c in (r, g, b))
    return tuple(a * x + m * y + k * z for a, m, k in TO_XYZ)


def lab(r: Column, g: Column, b: Column) -> tuple[Column, ...]:
    """CIE L*a*b* of sRGB."""

    def f(t: Column) -> Column:
        return F.when(t > (6 / 29) ** 3, F.pow(t, F.lit(1 / 3))).otherwise(t / (3 * (6 / 29) ** 2) + 4 / 29)

    x, y, z = (f(c / w) for c, w in zip(xyz(r, g, b), WHITE, strict=True))
    return 116 * y - 16, 500 * (x - y), 200 * (y - z)


def delta_e(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """CIE76 difference of two Lab colours."""
    return F.sqrt(sum((F.pow(p - q, F.lit(2.0)) for p, q in zip(a, b, strict=True)), F.lit(0.0)))


def cmyk(r: Column, g: Column, b: Column) -> tuple[Column, ...]:
    k = 1 - F.greatest(r, g, b)
    ink = lambda c: F.when(k >= 1, 0.0).otherwise((1 - c - k) / (1 - k))
    return ink(r), ink(g), ink(b), k


def bayer_threshold(x: Column, y: Column, order: int = 2) -> Column:
    """Threshold (0..1) of the ordered-dither matrix of side 2^order, by bit interleaving."""
    total, side = F.lit(0), 1 << order
    for bit in range(order):
        xb, yb = F.shiftright(x, bit).bitwiseAND(1), F.shiftright(y, bit).bitwiseAND(1)
        place = 2 * (order - 1 - bit)
        total = total + xb.bitwiseXOR(yb) * (2 << place) + yb * (1 << place)
    return (total + 0.5) / (side * side)
