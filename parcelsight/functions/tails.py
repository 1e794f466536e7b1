"""Tail probabilities as column expressions, so that a table of tests has its p-values without an action.

Nulls stay null. Sums and fractions are folds of a fixed number of steps over the rows of a result.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, functions as F

from parcelsight.functions.expressions import col

#: Steps of the folds: enough for 15 digits up to 2,000 degrees of freedom of chi-square.
STEPS = 600
#: Degrees of freedom from which Student's t is turned into a normal deviate by its asymptotic series.
MANY_DEGREES = 200

# Cody's rational approximations of the error function (1969), three ranges.
_A = (3.16112374387056560e00, 1.13864154151050156e02, 3.77485237685302021e02, 3.20937758913846947e03,
      1.85777706184603153e-1)
_B = (2.36012909523441209e01, 2.44024637934444173e02, 1.28261652607737228e03, 2.84423683343917062e03)
_C = (5.64188496988670089e-1, 8.88314979438837594e00, 6.61191906371416295e01, 2.98635138197400131e02,
      8.81952221241769090e02, 1.71204761263407058e03, 2.05107837782607147e03, 1.23033935479799725e03,
      2.15311535474403846e-8)
_D = (1.57449261107098347e01, 1.17693950891312499e02, 5.37181101862009858e02, 1.62138957456669019e03,
      3.29079923573345963e03, 4.36261909014324716e03, 3.43936767414372164e03, 1.23033935480374942e03)
_P = (3.05326634961232344e-1, 3.60344899949804439e-1, 1.25781726111229246e-1, 1.60837851487422766e-2,
      6.58749161529837803e-4, 1.63153871373020978e-2)
_Q = (2.56852019228982242e00, 1.87295284992346725e00, 5.27905102951428412e-1, 6.05183413124413191e-2,
      2.33520497626869185e-3)

# Wichura's rational approximations of the normal quantile (AS 241, 1988): the middle, the tails, far out.
_MIDDLE = ((3.3871328727963666080e0, 1.3314166789178437745e2, 1.9715909503065514427e3, 1.3731693765509461125e4,
            4.5921953931549871457e4, 6.7265770927008700853e4, 3.3430575583588128105e4, 2.5090809287301226727e3),
           (1.0, 4.2313330701600911252e1, 6.8718700749205790830e2, 5.3941960214247511077e3, 2.1213794301586595867e4,
            3.9307895800092710610e4, 2.8729085735721942674e4, 5.2264952788528545610e3))
_TAILS = ((1.42343711074968357734e0, 4.63033784615654529590e0, 5.76949722146069140550e0, 3.64784832476320460504e0,
           1.27045825245236838258e0, 2.41780725177450611770e-1, 2.27238449892691845833e-2, 7.74545014278341407640e-4),
          (1.0, 2.05319162663775882187e0, 1.67638483018380384940e0, 6.89767334985100004550e-1, 1.48103976427480074590e-1,
           1.51986665636164571966e-2, 5.47593808499534494600e-4, 1.05075007164441684324e-9))
_FAR_OUT = ((6.65790464350110377720e0, 5.46378491116411436990e0, 1.78482653991729133580e0, 2.96560571828504891230e-1,
             2.65321895265761230930e-2, 1.24266094738807843860e-3, 2.71155556874348757815e-5, 2.01033439929228813265e-7),
            (1.0, 5.99832206555887937690e-1, 1.36929880922735805310e-1, 1.48753612908506148525e-2, 7.86869131145613259100e-4,
             1.84631831751005468180e-5, 1.42151175831644588870e-7, 2.04426310338993978564e-15))


def _let(use: Callable[..., Column], *values: Column) -> Column:
    """What ``use`` makes of values that are computed once; written out again and again they would swell the plan."""
    names = [f"v{i}" for i in range(len(values))]
    bound = F.array(F.struct(*[v.alias(n) for v, n in zip(values, names)]))
    return F.transform(bound, lambda s: use(*[s[n] for n in names]))[0]


def _ratio(x: Column, top: Sequence[float], bottom: Sequence[float]) -> Column:
    """Two polynomials in x divided; the last factor of ``top`` is that of the highest power."""
    over, under = top[-1] * x, x
    for a, b in zip(top[:-2], bottom[:-1]):
        over, under = (over + a) * x, (under + b) * x
    return (over + top[-2]) / (under + bottom[-1])


def erfc(x: str | Column) -> Column:
    """The complementary error function, with 15 digits also far out."""
    def upper(y: Column, square: Column, inverse: Column) -> Column:
        near = 1.0 - y * _ratio(square, _A, _B)
        middle = F.exp(-square) * _ratio(y, _C, _D)
        far = F.exp(-square) * (1.0 / math.sqrt(math.pi) - inverse * _ratio(inverse, _P, _Q)) / y
        return F.when(y <= 0.46875, near).when(y <= 4.0, middle).when(y < 27.5, far).otherwise(F.lit(0.0))

    def both(x: Column) -> Column:
        y = F.abs(x)
        tail = _let(upper, y, y * y, F.try_divide(F.lit(1.0), y * y))
        return F.when(x.isNull() | F.isnan(x), None).when(x < 0, 2.0 - tail).otherwise(tail)

    return _let(both, col(x).cast("double"))


def normal_tail(z: str | Column) -> Column:
    """P(Z > z)."""
    return 0.5 * erfc(col(z) / math.sqrt(2.0))


def _power_sum(x: Column, factors: Sequence[float]) -> Column:
    """A polynomial in x, the constant first."""
    value = F.lit(factors[-1])
    for f in reversed(factors[:-1]):
        value = value * x + f
    return value


def normal_quantile(p: str | Column) -> Column:
    """The standard normal value that a share p lies below, to 15 digits; null unless 0 < p < 1."""
    def divided(x: Column, factors: tuple[Sequence[float], Sequence[float]]) -> Column:
        return _let(lambda x: _power_sum(x, factors[0]) / _power_sum(x, factors[1]), x)

    def both(p: Column, q: Column, out: Column) -> Column:
        tail = F.when(out <= 5.0, divided(out - 1.6, _TAILS)).otherwise(divided(out - 5.0, _FAR_OUT))
        return F.when((p > 0) & (p < 1), F.when(F.abs(q) <= 0.425, q * divided(0.180625 - q * q, _MIDDLE)).otherwise(
            F.signum(q) * tail))

    p = col(p).cast("double")
    return _let(both, p, p - 0.5, F.sqrt(-F.log(F.least(p, 1.0 - p))))


def rank_sum_tail(u: Column, n1: Column, n2: Column) -> Column:
    """P(U >= u) of two untied samples from one distribution, counted out: exact while the counts fit a double.

    How many orders of the pooled sample give each U are the coefficients of a product of (1 - x^(n2+i)) / (1 - x^i); a
    fold multiplies and divides by one factor after the other. Its work is about (n1 n2)^2, so it is for small samples.
    """
    def step(counts: Column, i: Column, n2: Column) -> Column:
        wider = F.transform(counts, lambda c, k: c - F.coalesce(F.when(k >= n2 + i, F.get(counts, k - n2 - i)), F.lit(0.0)))
        return _let(lambda w: F.transform(w, lambda _, k: F.aggregate(
            F.sequence(k % i, k, i), F.lit(0.0), lambda s, j: s + F.get(w, j))), wider)

    def share(u: Column, n1: Column, n2: Column) -> Column:
        start = F.transform(F.sequence(F.lit(0), n1 * n2), lambda k: F.when(k == 0, 1.0).otherwise(0.0))
        counts = F.aggregate(F.sequence(F.lit(1), n1), start, lambda c, i: step(c, i, n2))
        add = lambda s, c: s + c
        return _let(lambda c, first: F.aggregate(F.slice(c, first + 1, F.size(c)), F.lit(0.0), add)
                    / F.aggregate(c, F.lit(0.0), add), counts, F.greatest(F.ceil(u).cast("int"), F.lit(0)))

    return F.when((n1 > 0) & (n2 > 0), _let(share, u.cast("double"), n1.cast("int"), n2.cast("int")))


def log_gamma(x: Column) -> Column:
    """The logarithm of the gamma function for positive numbers, by Stirling's series eight steps up."""
    def stirling(x: Column, y: Column, square: Column) -> Column:
        product = x
        for i in range(1, 8):
            product = product * (x + float(i))
        series = (1.0 / 12 - (1.0 / 360 - (1.0 / 1260 - (1.0 / 1680 - 1.0 / 1188 / square) / square) / square) / square) / y
        return (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + series - F.log(product)

    return _let(stirling, x, x + 8.0, (x + 8.0) * (x + 8.0))


def _counting(down: bool = False) -> Column:
    return F.sequence(F.lit(STEPS), F.lit(1)) if down else F.sequence(F.lit(1), F.lit(STEPS))


def gamma_tail(a: Column, x: Column) -> Column:
    """The upper part of the regularised incomplete gamma function: a series below a + 1, a fraction above."""
    def parts(a: Column, x: Column) -> Column:
        scale = F.exp(a * F.log(x) - x - log_gamma(a))
        series = F.aggregate(
            _counting(), F.struct((1.0 / a).alias("term"), (1.0 / a).alias("sum")),
            lambda s, k: F.struct((s["term"] * x / (a + k)).alias("term"), (s["sum"] + s["term"] * x / (a + k)).alias("sum")))
        fraction = F.aggregate(
            _counting(down=True), x + 2.0 * STEPS + 1.0 - a, lambda t, k: x + 2.0 * k - 1.0 - a - k * (k - a) / t)
        return F.when(x <= 0, 1.0).when(x < a + 1, 1.0 - scale * series["sum"]).otherwise(scale / fraction)

    return _let(parts, a, x)


def chi_square_tail(x: str | Column, degrees: str | Column) -> Column:
    """P(X > x) for any positive number of degrees of freedom."""
    x, degrees = col(x).cast("double"), col(degrees).cast("double")
    return F.when(degrees > 0, gamma_tail(degrees / 2.0, x / 2.0))


def student_two_sided(t: str | Column, degrees: str | Column) -> Column:
    """P(|T| > |t|): an incomplete beta fraction for few degrees of freedom, Hill's series for many."""
    def fraction(p: Column, q: Column, at: Column) -> Column:
        def step(value: Column, k: Column) -> Column:
            even = k * (q - k) * at / ((p + 2.0 * k - 1.0) * (p + 2.0 * k))
            m = k - 1.0
            odd = -(p + m) * (p + q + m) * at / ((p + 2.0 * m) * (p + 2.0 * m + 1.0))
            return 1.0 + odd / (1.0 + even / value)
        return F.aggregate(_counting(down=True), F.lit(1.0), step)

    def few(a: Column, x: Column, rest: Column) -> Column:
        half = F.lit(0.5)
        front = F.exp(log_gamma(a + 0.5) - log_gamma(a) - 0.5 * math.log(math.pi) + a * F.log(x) + 0.5 * F.log(rest))
        return F.when(x < (a + 1.0) / (a + 2.5), front / a / fraction(a, half, x)).otherwise(
            1.0 - front / half / fraction(half, a, rest))

    def deviate(z: Column, z2: Column, b: Column) -> Column:
        return z + (z2 * z + 3.0 * z) / b - (((4.0 * z2 + 33.0) * z2 + 240.0) * z2 + 855.0) * z / (
            10.0 * b * (b + 0.8 * z2 * z2 + 100.0))

    def tail(t: Column, v: Column) -> Column:
        n, square = v - 0.5, (v - 0.5) * F.log1p(t * t / v)
        many = 2.0 * normal_tail(_let(deviate, F.sqrt(square), square, 48.0 * n * n))
        beta = _let(few, v / 2.0, v / (v + t * t), t * t / (v + t * t))
        return F.when(v > 0, F.when(t == float("inf"), 0.0).when(t == 0, 1.0).when(v < MANY_DEGREES, beta).otherwise(many))

    return _let(tail, F.abs(col(t).cast("double")), col(degrees).cast("double"))


def kolmogorov_tail(x: str | Column) -> Column:
    """P(K > x) of the Kolmogorov distribution; below 0.2 it is 1 to twelve digits."""
    def tail(x: Column) -> Column:
        terms = F.aggregate(F.sequence(F.lit(1), F.lit(60)), F.lit(0.0), lambda s, k: s + F.when(
            k % 2 == 1, 2.0).otherwise(-2.0) * F.exp(-2.0 * k * k * x * x))
        return F.when(x < 0.2, 1.0).otherwise(F.least(F.greatest(terms, F.lit(0.0)), F.lit(1.0)))

    return _let(tail, col(x).cast("double"))
