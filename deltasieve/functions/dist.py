"""Distribution functions as Columns: the normal, and Student's t by a fold."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Abramowitz & Stegun 7.1.26.
ERF_P = 0.3275911
ERF_A = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)
# Lanczos approximation of ln gamma, g = 7.
LANCZOS = (
    0.9999999999998099,
    676.5203681218851,
    -1259.1392167224028,
    771.3234287776531,
    -176.6150291621406,
    12.507343278686905,
    -0.1385710952657201,
    9.984369578019572e-6,
    1.5056327351493116e-7,
)


def erf(x: Column) -> Column:
    """Polynomial error function, off by at most 1.5e-7."""
    a = F.abs(x)
    t = 1 / (1 + ERF_P * a)
    poly = F.lit(0.0)
    for c in reversed(ERF_A):
        poly = (poly + c) * t
    return F.when(x < 0, -1.0).otherwise(1.0) * (1 - poly * F.exp(-a * a))


def norm_cdf(x: Column) -> Column:
    return 0.5 * (1 + erf(x / math.sqrt(2)))


def _ln_gamma(z: Column) -> Column:
    shifted = z - 1
    series = F.lit(LANCZOS[0])
    for i, c in enumerate(LANCZOS[1:], 1):
        series = series + c / (shifted + i)
    t = shifted + 7.5
    return 0.5 * math.log(2 * math.pi) + (shifted + 0.5) * F.log(t) - t + F.log(series)


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use of a value that is worked out once, however often it is named."""
    return F.transform(F.array(value), use)[0]


def _continued_fraction(x: Column, a: Column, b: float, steps: int = 200) -> Column:
    """Lentz's continued fraction of the incomplete beta, until it no longer changes: a fold that then passes its value on."""
    tiny = 1e-300
    floor = lambda v: _bound(v, lambda w: F.when(F.abs(w) < tiny, F.lit(tiny)).otherwise(w))

    def half(acc: Column, factor: Column) -> Column:
        both = F.struct((1 / floor(1 + factor * acc["d"])).alias("d"), floor(1 + factor / acc["c"]).alias("c"))
        return _bound(both, lambda n: F.struct(n["c"].alias("c"), n["d"].alias("d"), (acc["h"] * n["d"] * n["c"]).alias("h"), (F.abs(n["d"] * n["c"] - 1) >= 1e-15).alias("going")))

    def step(acc: Column, m: Column) -> Column:
        even = m * (b - m) * x / ((a - 1 + 2 * m) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 1 + 2 * m))
        return F.when(acc["going"], _bound(half(acc, even), lambda once: half(once, odd))).otherwise(acc)

    first = 1 / floor(1 - (a + b) * x / (a + 1))
    start = _bound(first, lambda d: F.struct(F.lit(1.0).alias("c"), d.alias("d"), d.alias("h"), F.lit(True).alias("going")))
    return F.aggregate(F.transform(F.sequence(F.lit(1), F.lit(steps)), lambda m: m.cast("double")), start, step, lambda acc: acc["h"])


def _incomplete_beta(x: Column, a: Column, b: float) -> Column:
    """Regularised incomplete beta for x strictly between 0 and 1."""
    front = F.exp(a * F.log(x) + b * F.log1p(-x) - _ln_gamma(a) - _ln_gamma(F.lit(b)) + _ln_gamma(a + b)) / a
    return front * _continued_fraction(x, a, b)


def student_t_cdf(t: Column | str, df: Column | str) -> Column:
    """P(T <= t) for df degrees of freedom; one half for df <= 0 and for infinite ones. Null in, null out; NaN in, NaN out.

    For t within about 0.05 of 0 the fraction isn't at its limit after its 200 steps, which are part of the definition.
    """
    t, n = (F.col(c).cast("double") if isinstance(c, str) else c.cast("double") for c in (t, df))
    infinite = lambda c: F.abs(c) == float("inf")

    def finite(p: Column) -> Column:
        """Of both, as one value: neither null, NaN nor infinite, and df above 0."""
        x = p["n"] / (p["n"] + p["t"] * p["t"])
        beta = F.when(x >= 1, 1.0).when(x <= 0, 0.0).otherwise(_bound(F.struct(x.alias("x"), (p["n"] / 2).alias("a")), lambda q: _incomplete_beta(q["x"], q["a"], 0.5)))
        return _bound(beta, lambda v: F.when(p["t"] >= 0, 1 - 0.5 * v).otherwise(0.5 * v))

    whole = _bound(F.struct(t.alias("t"), n.alias("n")), finite)
    return F.when(t.isNull() | n.isNull(), None).when(F.isnan(t) | F.isnan(n), float("nan")).when(infinite(t) | infinite(n) | (n <= 0), 0.5).otherwise(whole)
