"""Column functions on feature arrays and scores. All are built-in expressions, inside code generation."""

from __future__ import annotations

from math import comb

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def total(values: Column | str) -> Column:
    return F.aggregate(_col(values), F.lit(0.0), lambda a, x: a + x.cast("double"))


def hadamard(a, b) -> Column:
    return F.zip_with(_col(a), _col(b), lambda x, y: x.cast("double") * y.cast("double"))


def difference(a, b) -> Column:
    return F.zip_with(_col(a), _col(b), lambda x, y: x.cast("double") - y.cast("double"))


def added(a, b, scale: float = 1.0) -> Column:
    """a + scale * b."""
    return F.zip_with(_col(a), _col(b), lambda x, y: x.cast("double") + scale * y.cast("double"))


def dot(a, b) -> Column:
    return total(hadamard(a, b))


def l2(a) -> Column:
    return F.sqrt(dot(a, a))


def l1_distance(a, b) -> Column:
    return total(F.transform(difference(a, b), F.abs))


def squared_l2_distance(a, b) -> Column:
    return total(F.transform(difference(a, b), lambda x: x * x))


def cosine_distance(a, b) -> Column:
    return 1 - dot(a, b) / (F.when(l2(a) == 0, 1.0).otherwise(l2(a)) * F.when(l2(b) == 0, 1.0).otherwise(l2(b)))


def l2_normalized(a) -> Column:
    """Divided by its length; a zero vector stays."""
    size = l2(a)
    return F.transform(_col(a), lambda x: x.cast("double") / F.when(size == 0, 1.0).otherwise(size))


def row_normalized(a) -> Column:
    """Shifted to a least value of 0 and divided by its sum, which counts as 1 at least."""
    low = F.array_min(_col(a))
    shifted = F.transform(_col(a), lambda x: (x - low).cast("double"))
    return F.transform(shifted, lambda x: x / F.greatest(total(shifted), F.lit(1.0)))


def sigmoid(x) -> Column:
    return 1 / (1 + F.exp(-_col(x)))


def relu(x) -> Column:
    return F.greatest(_col(x), F.lit(0.0))


def leaky_relu(x, slope: float = 0.01) -> Column:
    return F.when(_col(x) > 0, _col(x)).otherwise(slope * _col(x))


def elu(x) -> Column:
    return F.when(_col(x) > 0, _col(x)).otherwise(F.expm1(_col(x)))


def swish(x) -> Column:
    return _col(x) * sigmoid(x)


def gelu(x) -> Column:
    """The usual tanh form."""
    c = _col(x)
    return 0.5 * c * (1 + F.tanh(0.7978845608028654 * (c + 0.044715 * c * c * c)))


def softmax(scores) -> Column:
    top = F.array_max(_col(scores))
    raised = F.transform(_col(scores), lambda x: F.exp(x - top))
    return F.transform(raised, lambda x: x / total(raised))


def bernstein_theta(d: int) -> list[list[float]]:
    """Ascending coefficients of (x/2)^i (1 - x/2)^(d-i) / B(i + 1, d + 1 - i), for i from 0 to d."""
    return [[(d + 1) * comb(d, i) * comb(d - i, k - i) * (-1.0) ** (k - i) / 2**k if k >= i else 0.0 for k in range(d + 1)] for i in range(d + 1)]


def position_encoding(position, dim: int, base: float = 10000.0, shift: bool = True) -> Column:
    """Sines of the position over b^((i - i mod 2) / dim), odd places a quarter turn later."""
    return F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.sin(_col(position) / F.pow(F.lit(base), (i - i % 2) / F.lit(dim)) + (F.when(i % 2 == 1, F.lit(1.5707963267948966)).otherwise(0.0) if shift else F.lit(0.0))))


def log_variance(x) -> Column:
    """Clamped to [-4, 2]."""
    return F.greatest(F.least(_col(x), F.lit(2.0)), F.lit(-4.0))


def gaussian_nll(x, mean, log_var) -> Column:
    v = log_variance(log_var)
    return 0.5 * (v + (_col(x) - _col(mean)) ** 2 / F.exp(v))


def greedy_mix(p, greed: float) -> Column:
    """p (1 - g) + g [p >= 1/2]."""
    return _col(p) * (1 - greed) + greed * (_col(p) >= 0.5).cast("double")


def weighted_cross_entropy(y, p, weight=1.0) -> Column:
    """Of one row; average it over rows."""
    q = F.least(F.greatest(_col(p), F.lit(1e-12)), F.lit(1 - 1e-12))
    return -(weight * _col(y) * F.log(q) + (1 - _col(y)) * F.log(1 - q))


def bce_with_logits(y, z) -> Column:
    return F.greatest(_col(z), F.lit(0.0)) - _col(z) * _col(y) + F.log1p(F.exp(-F.abs(_col(z))))


def hinge(y, s) -> Column:
    """y in {-1, 1}."""
    return F.greatest(1 - _col(y) * _col(s), F.lit(0.0))


def warmup_cosine(step: int, warmup: int, total_steps: int) -> float:
    """Share of the learning rate: linear up, then half a cosine down to 0.1 at least."""
    from math import cos, pi

    if step < warmup:
        return step / max(1, warmup)
    return max(0.1, 0.5 * (1 + cos(pi * (step - warmup) / max(1, total_steps - warmup))))


def annealed(epoch: int, epochs: int, first: float = 0.0, last: float = 1.0) -> float:
    return first + (last - first) * min(1.0, epoch / max(1, epochs - 1))


def hashed(seed, *columns) -> Column:
    """Hexadecimal MD5 of seed and columns: an order that is random, fixed and equal in other engines."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[_col(c).cast("string") for c in columns]))
