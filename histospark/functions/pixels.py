"""Pointwise pixel functions as column expressions; all of them stay in generated code."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Luma weights for red, green, blue.
LUMA = (0.298936021293776, 0.587043074451121, 0.114020904255103)
FLOAT_EPSILON = float(np.finfo(np.float32).eps)


def clamp_round(v: Column) -> Column:
    """0 to 255, rounded half up."""
    return F.floor(F.least(F.greatest(v, F.lit(0.0)), F.lit(255.0)) + 0.5).cast("int")


def invert(v: Column, kind: str = "uchar") -> Column:
    """Unsigned kinds: maximum - v; signed and floating kinds: -v."""
    top = {"uchar": 255, "ushort": 65535}
    if kind in top:
        return F.lit(top[kind]) - v
    if kind in ("short", "int", "float", "double"):
        return -v
    raise ValueError(f"unknown kind {kind}")


def mod(v: Column, m: int) -> Column:
    return v % F.lit(m)


def bgr2gray(b: Column, g: Column, r: Column) -> Column:
    return clamp_round(F.lit(LUMA[0]) * r + F.lit(LUMA[1]) * g + F.lit(LUMA[2]) * b)


def replace(v: Column, old, new) -> Column:
    return F.when(v == F.lit(old), F.lit(new)).otherwise(v)


def in_range(v: Column, lower, upper, lower_inclusive: bool = True, upper_inclusive: bool = True) -> Column:
    """Whether v is between the bounds."""
    return ((v >= lower) if lower_inclusive else (v > lower)) & ((v <= upper) if upper_inclusive else (v < upper))


def threshold(v: Column, lower, upper, lower_inclusive: bool = True, upper_inclusive: bool = True) -> Column:
    """255 between the bounds, else 0."""
    return F.when(in_range(v, lower, upper, lower_inclusive, upper_inclusive), F.lit(255)).otherwise(F.lit(0))


def above(v: Column, k) -> Column:
    """255 above k, else 0."""
    return F.when(v > k, F.lit(255)).otherwise(F.lit(0))


def divide(a: Column, b: Column) -> Column:
    """Quotient in double precision; by zero it is null."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def mask(v: Column, m: Column, background=0) -> Column:
    return F.when(m > 0, v).otherwise(F.lit(background))


def overwrite(target: Column, source: Column, where: Column) -> Column:
    """``source`` where the mask isn't 0, else ``target``."""
    return F.when(where != 0, source).otherwise(target)


def saturating_subtract(a: Column, b: Column) -> Column:
    """Of 8-bit values."""
    return F.greatest(a - b, F.lit(0))


def is_background(b: Column, g: Column, r: Column, level: int = 220) -> Column:
    return (b > level) & (g > level) & (r > level)


def convert(v: Column, kind: str, scale: float = 1.0, offset: float = 0.0) -> Column:
    """scale * v + offset as another kind; integer kinds round half to even and saturate."""
    bounds = {"uchar": (0, 255), "char": (-128, 127), "ushort": (0, 65535), "short": (-32768, 32767), "int": (-(1 << 31), (1 << 31) - 1)}
    out = v.cast("double") * scale + offset
    if kind in ("float", "double"):
        return out.cast(kind)
    low, high = bounds[kind]
    return F.greatest(F.lit(low), F.least(F.lit(high), F.bround(out).cast("long"))).cast("int")


def ordered_bits(v: Column) -> Column:
    """A float as an int of the same order: negative floats have their lower 31 bits flipped. The bits come from the value's sign,
    exponent and fraction, as SQL has no cast of bits; values are finite and normal, or zero."""
    size = F.abs(v.cast("double"))
    power = F.floor(F.log2(size)).cast("int")
    power = F.when(F.pow(F.lit(2.0), power) > size, power - 1).when(F.pow(F.lit(2.0), power + 1) <= size, power + 1).otherwise(power)
    bits = ((power + 127) * (1 << 23) + F.round((size / F.pow(F.lit(2.0), power) - 1) * (1 << 23))).cast("int")
    bits = F.when(size == 0, F.lit(0)).otherwise(bits)
    return F.when(v < 0, -bits - 1).otherwise(bits)


def from_ordered_bits(n: Column) -> Column:
    """The float of ``ordered_bits``."""
    bits = F.when(n < 0, -n - 1).otherwise(n)
    power, fraction = F.floor(bits / (1 << 23)) - 127, bits % (1 << 23)
    size = F.when(bits == 0, F.lit(0.0)).otherwise(F.pow(F.lit(2.0), power) * (F.lit(1.0) + fraction / (1 << 23)))
    return F.when(n < 0, -size).otherwise(size).cast("float")


def unmixing(matrix, keep=(True, True, False)) -> np.ndarray:
    """Rows of the inverse of a stain matrix whose columns are made unit vectors; a third column of zeros is filled with what
    the rows lack to unit length."""
    m = np.array(matrix, float)
    norms = np.linalg.norm(m, axis=0)
    m = np.where(norms > 0, m / np.where(norms > 0, norms, 1), m)
    if norms[2] == 0:
        lack = 1 - (m[:, :2] ** 2).sum(axis=1)
        m[:, 2] = np.sqrt(np.maximum(lack, 0))
        if (n := np.linalg.norm(m[:, 2])) > 0:
            m[:, 2] /= n
    return np.linalg.inv(m)[np.array(keep, bool)]


def color_deconv(b: Column, g: Column, r: Column, matrix, keep=(True, True, False), bgr2rgb: bool = True) -> list[Column]:
    """A column 0 to 255 for each kept stain."""
    per = 255 / math.log(255)
    density = [-F.log((c.cast("double") + 1) / 255) * per for c in (b, g, r)]
    if bgr2rgb:
        density = density[::-1]
    out = []
    for row in unmixing(matrix, keep):
        amount = sum((float(q) * d for q, d in zip(row, density, strict=True)), F.lit(0.0))
        out.append(clamp_round(F.exp(-(amount - 255) / per)))
    return out
