"""Column functions on arrays of doubles; all run in the JVM."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column | str) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column | str) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))


def unit(v: Column | str, floor: float | None = None) -> Column:
    """Rows of unit length; a zero norm divides by 1, or norms are raised to ``floor`` if it is given."""
    n = norm(v)
    n = F.when(n == 0, F.lit(1.0)).otherwise(n) if floor is None else F.greatest(n, F.lit(floor))
    return F.transform(v, lambda x: x / n)


def cosine(a: Column | str, b: Column | str) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def plus(a: Column | str, b: Column | str, scale: Column | float = 1.0) -> Column:
    s = scale if isinstance(scale, Column) else F.lit(float(scale))
    return F.zip_with(a, b, lambda x, y: x + y * s)


def mean_of(*vs: Column | str) -> Column:
    """Element-wise mean of two or more arrays."""
    total = vs[0]
    for v in vs[1:]:
        total = F.zip_with(total, v, lambda x, y: x + y)
    return F.transform(total, lambda x: x / F.lit(float(len(vs))))


def mean(v: Column | str) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x) / F.size(v)


def layer_norm(v: Column | str, eps: float = 1e-5) -> Column:
    """(v - mean) / sqrt(population variance + eps)."""
    m = mean(v)
    variance = F.aggregate(v, F.lit(0.0), lambda s, x: s + (x - m) * (x - m)) / F.size(v)
    return F.transform(v, lambda x: (x - m) / F.sqrt(variance + F.lit(eps)))


def soft_route(raw: Column | str, calibrated: Column | str, alpha: float) -> Column:
    """raw + alpha * layer_norm(calibrated)."""
    return plus(raw, layer_norm(calibrated), alpha)


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def gate(theta: Column, form: str) -> Column:
    """Effective gate: 'raw' theta, 'sigmoid', 'tanh_signed' tanh(theta), 'tanh01' (1 + tanh(theta)) / 2."""
    return {"raw": theta, "sigmoid": sigmoid(theta), "tanh_signed": F.tanh(theta), "tanh01": (1 + F.tanh(theta)) / 2}[form]


def gate_start(value: float, form: str) -> float:
    """The theta at which the gate has ``value``."""
    return {"raw": lambda: value, "sigmoid": lambda: math.log(value / (1 - value)), "tanh_signed": lambda: math.atanh(value), "tanh01": lambda: math.atanh(2 * value - 1)}[form]()


def clipped(x: Column, lo: float, hi: float) -> Column:
    return F.least(F.greatest(x, F.lit(float(lo))), F.lit(float(hi)))


def softmax(v: Column | str, tau: float = 1.0) -> Column:
    top = F.array_max(v)
    e = F.transform(v, lambda x: F.exp((x - top) / F.lit(float(tau))))
    total = F.aggregate(e, F.lit(0.0), lambda s, x: s + x)
    return F.transform(e, lambda x: x / total)


def entropy(p: Column | str) -> Column:
    return -F.aggregate(p, F.lit(0.0), lambda s, x: s + x * F.ln(F.greatest(x, F.lit(1e-12))))


def real_dft(v: Column | str, dim: int, permutation: list[int] | None = None) -> Column:
    """Orthonormal real DFT as an array of dim//2+1 structs (re, im), with cos and sin as literals.

    For the small fixed dimensions of embeddings this stays in the JVM; spectral
    functions on large dimensions are in operators.features.
    """
    order = permutation or list(range(dim))
    scale = 1 / math.sqrt(dim)
    at = F.array(*[F.element_at(v, o + 1) for o in order]) if permutation else v

    def bin_(k: int) -> Column:
        c = F.array(*[F.lit(math.cos(2 * math.pi * k * t / dim) * scale) for t in range(dim)])
        s = F.array(*[F.lit(-math.sin(2 * math.pi * k * t / dim) * scale) for t in range(dim)])
        return F.struct(dot(at, c).alias("re"), dot(at, s).alias("im"))

    return F.array(*[bin_(k) for k in range(dim // 2 + 1)])
