"""P-values of t and F statistics by the regularised incomplete beta function, as column expressions.

The continued fraction is an aggregate over a sequence of steps whose state is a struct,
so it runs in the JVM wherever the statistic is. On the side of the mean that is used it
converges within 60 steps and six times the square root of the smaller parameter (measured
up to 1e8 for both), so the sequence is as long as that row asks for.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

_TINY = 1e-300
_SHIFT = 10  # Stirling's series is used from here on, where seven terms are exact to the last digit
# Bernoulli numbers over 2k (2k - 1).
_SERIES = (1 / 12, -1 / 360, 1 / 1260, -1 / 1680, 1 / 1188, -691 / 360360, 1 / 156)
_HALF_LOG_TWO_PI = 0.9189385332046727


def _correction(z: Column) -> Column:
    """What Stirling's formula lacks, by powers of 1 / z."""
    inverse = 1.0 / z
    total = F.lit(_SERIES[-1])
    for term in reversed(_SERIES[:-1]):
        total = total * inverse * inverse + term
    return total * inverse


def log_gamma(x: Column) -> Column:
    """ln Γ(x) for x above 0."""
    z = x + _SHIFT
    below = reduce(lambda done, k: done + F.ln(x + k), range(1, _SHIFT), F.ln(x))
    return (z - 0.5) * F.ln(z) - z + _HALF_LOG_TWO_PI + _correction(z) - below


def _log_gamma_gap(a: Column, b: Column) -> Column:
    """ln Γ(a + b) - ln Γ(a), without taking the difference of two large numbers."""
    z = a + _SHIFT
    below = reduce(lambda done, k: done + F.log1p(b / (a + k)), range(1, _SHIFT), F.log1p(b / a))
    return (z - 0.5) * F.log1p(b / z) + b * F.ln(z + b) - b + _correction(z + b) - _correction(z) - below


def _away_from_zero(x: Column) -> Column:
    return F.when(F.abs(x) < _TINY, F.lit(_TINY)).otherwise(x)


def incomplete_beta(a: Column, b: Column, x: Column) -> Column:
    """I_x(a, b); null where a parameter is null, NaN or not above 0."""
    a, b, x = (F.nanvl(c.cast("double"), F.lit(None).cast("double")) for c in (a, b, x))
    bound = F.struct(a.alias("a"), b.alias("b"), F.greatest(F.least(x, F.lit(1.0)), F.lit(0.0)).alias("x"))
    # The fraction converges quickly on the side of the mean that x lies on.
    sides = F.transform(F.array(bound), lambda p: F.when(
        p["x"] > (p["a"] + 1) / (p["a"] + p["b"] + 2),
        F.struct(p["b"].alias("a"), p["a"].alias("b"), (1 - p["x"]).alias("x"), F.lit(True).alias("turned")),
    ).otherwise(F.struct(p["a"].alias("a"), p["b"].alias("b"), p["x"].alias("x"), F.lit(False).alias("turned"))))

    def value(p: Column) -> Column:
        a, b, x = p["a"], p["b"], p["x"]

        def step(state: Column, j: Column) -> Column:
            """One coefficient: of step m the even one at 2m - 1, the odd one at 2m."""
            m = F.floor((j + 1) / 2).cast("double")
            even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
            odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
            k = F.when(j % 2 == 1, even).otherwise(odd)
            return F.struct(_away_from_zero(1 + k / state["c"]).alias("c"), (1 / _away_from_zero(1 + k * state["d"])).alias("d"),
                            (state["h"] * state["c"] * state["d"]).alias("h"))

        begin = F.struct(F.lit(1.0).alias("c"), (1 / _away_from_zero(1 - (a + b) * x / (a + 1))).alias("d"), F.lit(1.0).alias("h"))
        steps = (2 * (60 + F.ceil(6 * F.sqrt(F.least(a, b))))).cast("int")
        fraction = F.aggregate(F.sequence(F.lit(1), steps), begin, step, lambda s: s["h"] * s["c"] * s["d"])
        large, small = F.greatest(a, b), F.least(a, b)
        front = F.exp(_log_gamma_gap(large, small) - log_gamma(small) + a * F.ln(x) + b * F.log1p(-x)) / a
        tail = F.when(x <= 0, F.lit(0.0)).otherwise(front * fraction)
        return F.when(p["turned"], 1 - tail).otherwise(tail)

    defined = (a > 0) & (b > 0) & x.isNotNull()
    return F.when(defined, F.get(F.transform(sides, value), F.lit(0)))


def t_p_value(t: Column, df: Column) -> Column:
    """Two-sided p of a t statistic."""
    t, df = t.cast("double"), df.cast("double")
    return incomplete_beta(df / 2, F.lit(0.5), F.try_divide(df, df + t * t))


def f_p_value(f: Column, df1: Column, df2: Column) -> Column:
    """Upper tail of an F statistic; an infinite F has p 0."""
    f, df1, df2 = f.cast("double"), df1.cast("double"), df2.cast("double")
    infinite = f == F.lit(float("inf"))
    safe = F.when(~infinite, f)
    return F.when(infinite, F.lit(0.0)).otherwise(incomplete_beta(df2 / 2, df1 / 2, F.try_divide(df2, df2 + df1 * safe)))
