"""Series transformers as column expressions over ARRAY<DOUBLE>: no shuffle, no Python.

A null series gives null, an empty one null where a mean or an extreme is asked and an
empty series elsewhere; divisors of 0 give null but where a function says otherwise.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Standard normal breakpoints by alphabet size, to two decimals. Fixed values.
BREAKPOINTS = {
    2: [0.0], 3: [-0.43, 0.43], 4: [-0.67, 0.0, 0.67], 5: [-0.84, -0.25, 0.25, 0.84], 6: [-0.97, -0.43, 0.0, 0.43, 0.97],
    7: [-1.07, -0.57, -0.18, 0.18, 0.57, 1.07], 8: [-1.15, -0.67, -0.32, 0.0, 0.32, 0.67, 1.15], 9: [-1.22, -0.76, -0.43, -0.14, 0.14, 0.43, 0.76, 1.22], 10: [-1.28, -0.84, -0.52, -0.25, 0.0, 0.25, 0.52, 0.84, 1.28],
}


def total(a: Column, f: Callable[[Column], Column] = lambda x: x) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda t, x: t + f(x))


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with the value computed once, also where f uses it within a lambda."""
    return F.element_at(F.transform(F.array(value), f), 1)


def mean(a: Column) -> Column:
    return F.try_divide(total(a), F.size(a))


def variance(a: Column) -> Column:
    return let(mean(a), lambda m: F.try_divide(total(a, lambda x: (x - m) * (x - m)), F.size(a)))


def indices(n: Column | int) -> Column:
    n = F.lit(n) if isinstance(n, int) else n
    return F.when(n > 0, F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1)).otherwise(F.when(n.isNotNull(), F.array().cast("array<int>")))


def at(a: Column, i: Column) -> Column:
    return F.get(a, i)


def standardise(a: Column) -> Column:
    """Population z-scores; all zero where the variance is under 1e-6."""
    both = F.struct(mean(a).alias("m"), variance(a).alias("v"))
    return let(both, lambda s: F.transform(a, lambda x: F.when(s["v"] < 1e-6, 0.0).otherwise((x - s["m"]) / F.sqrt(s["v"]))))


def centre(a: Column) -> Column:
    return let(mean(a), lambda m: F.transform(a, lambda x: x - m))


def interval(a: Column) -> Column:
    both = F.struct(F.array_min(a).alias("lo"), F.array_max(a).alias("hi"))
    return let(both, lambda s: F.transform(a, lambda x: F.when(s["hi"] - s["lo"] < 1e-6, 0.0).otherwise((x - s["lo"]) / (s["hi"] - s["lo"]))))


def differences(a: Column, lag: int = 1, former: bool = False) -> Column:
    n = F.greatest(F.size(a) - lag, F.lit(0))
    sign = -1.0 if former else 1.0
    return F.zip_with(F.slice(a, F.lit(1), n), F.slice(a, F.lit(lag + 1), n), lambda x, y: (x - y) * sign)


def derivative(a: Column) -> Column:
    """((x[i] - x[i-1]) + (x[i+1] - x[i-1]) / 2) / 2, with the ends copied from their neighbours; zeros for two points, null for one."""
    inner = lambda i: ((at(a, i) - at(a, i - 1)) + (at(a, i + 1) - at(a, i - 1)) / 2) / 2
    last = F.size(a) - 2
    full = F.transform(a, lambda x, i: inner(F.least(F.greatest(i, F.lit(1)), last)))
    return F.when(F.size(a) > 2, full).when(F.size(a) == 1, F.array(F.lit(None).cast("double"))).otherwise(F.transform(a, lambda x: x * 0))


def clip(a: Column) -> Column:
    return let(mean(a), lambda m: F.transform(a, lambda x: F.when(x < m, 0.0).otherwise(1.0)))


def paa(a: Column, frames: int = 8) -> Column:
    """Frame means; a point on a border counts by its overlap with each frame."""
    size = F.size(a) / frames

    def frame(f: Column) -> Column:
        lo, hi = f * size, (f + 1) * size
        first = F.floor(lo).cast("int")
        inside = F.slice(a, first + 1, F.greatest(F.ceil(hi).cast("int") - first, F.lit(0)))
        parts = F.transform(inside, lambda x, i: x * F.greatest(F.lit(0.0), F.least((first + i + 1).cast("double"), hi) - F.greatest((first + i).cast("double"), lo)))
        return F.try_divide(total(parts), size)

    return F.transform(indices(frames), frame)


def sax(a: Column, frames: int = 8, alphabet: int = 4) -> Column:
    """Symbols 0 to alphabet - 1 of the frame means: how many breakpoints lie at or under each."""
    points = F.array(*map(F.lit, BREAKPOINTS[alphabet]))
    return F.transform(let(a, lambda s: paa(s, frames)), lambda x: F.size(F.filter(points, lambda b: x >= b)).cast("double"))


def _against(a: Column, weight: Callable[[Column, Column], Column]) -> Column:
    return F.transform(indices(F.size(a)), lambda k: total(F.transform(a, lambda x, i: x * weight(i, k))))


def cosine(a: Column) -> Column:
    n = F.size(a)
    return _against(a, lambda i, k: F.cos(k * (i + 0.5) * math.pi / n))


def sine(a: Column) -> Column:
    n = F.size(a)
    return _against(a, lambda i, k: F.sin(k * (i + 0.5) * math.pi / n))


def hilbert(a: Column) -> Column:
    return _against(a, lambda i, k: F.when(i == k, 0.0).otherwise(1.0 / (k - i)))


def power_spectrum(a: Column) -> Column:
    """Magnitudes of the first half of the discrete Fourier coefficients."""
    n = F.size(a)
    part = lambda k, f: total(F.transform(a, lambda x, i: x * f(2 * math.pi * i * k / n)))
    return F.transform(indices(F.floor(n / 2).cast("int")), lambda k: F.sqrt(F.pow(part(k, F.cos), 2) + F.pow(part(k, F.sin), 2)))


def autocorrelation(a: Column, lags: int = 10) -> Column:
    """Correlation of the series with itself at lags 1 to lags (its length less 1 at most), with the moments of the overlapping parts; 1 if neither varies, 0 if one does not."""

    def lag(k: Column) -> Column:
        n = F.size(a) - k
        parts = F.struct(F.slice(a, F.lit(1), n).alias("x"), F.slice(a, k + 1, n).alias("y"))

        def of(s: Column) -> Column:
            means = F.struct(mean(s["x"]).alias("x"), mean(s["y"]).alias("y"))
            covariance = let(means, lambda m: F.try_divide(total(F.zip_with(s["x"], s["y"], lambda p, q: (p - m["x"]) * (q - m["y"]))), n))
            return let(F.struct(variance(s["x"]).alias("x"), variance(s["y"]).alias("y"), covariance.alias("c")), scaled)

        def scaled(v: Column) -> Column:
            return F.when((v["x"] == 0) & (v["y"] == 0), 1.0).when((v["x"] == 0) | (v["y"] == 0), 0.0).otherwise(F.try_divide(v["c"], F.sqrt(v["x"] * v["y"])))

        return let(parts, of)

    return F.transform(indices(F.least(F.lit(lags), F.size(a) - 1)), lambda k: lag(k + 1))


def summary(a: Column) -> Column:
    """Mean, population variance, minimum, maximum, least-squares slope over 0 to n - 1."""
    n = F.size(a)
    middle = (n - 1) / 2
    slope = F.coalesce(F.try_divide(total(F.transform(a, lambda x, i: x * (i - middle))), n * (n * n - 1) / 12), F.lit(0.0))
    return F.array(mean(a), variance(a), F.array_min(a), F.array_max(a), slope)


def haar(a: Column) -> Column:
    """One level of the Haar wavelet: approximations, then details."""
    half = (F.size(a) / 2).cast("int")
    part = lambda s: F.transform(indices(half), lambda i: (at(a, 2 * i) + s * at(a, 2 * i + 1)) / math.sqrt(2))
    return F.concat(part(1), part(-1))


def convolve(a: Column, kernel: list[float]) -> Column:
    weights = F.array(*map(F.lit, kernel))
    return F.transform(indices(F.size(a) - len(kernel) + 1), lambda i: total(F.zip_with(F.slice(a, i + 1, F.lit(len(kernel))), weights, lambda x, w: x * w)))


def run_lengths(a: Column, most: int = 16) -> Column:
    """Histogram of the lengths of runs at or above, and under, the series' mean; longer runs count as the longest."""
    runs = F.aggregate(
        let(mean(a), lambda m: F.transform(a, lambda x: x >= m)),
        F.struct(F.lit(None).cast("boolean").alias("side"), F.lit(0).alias("n"), F.array().cast("array<int>").alias("done")),
        lambda s, x: F.when(s["side"] == x, F.struct(x.alias("side"), (s["n"] + 1).alias("n"), s["done"].alias("done"))).otherwise(
            F.struct(x.alias("side"), F.lit(1).alias("n"), F.when(s["n"] > 0, F.concat(s["done"], F.array(s["n"]))).otherwise(s["done"]).alias("done"))
        ),
        lambda s: F.when(s["n"] > 0, F.concat(s["done"], F.array(s["n"]))).otherwise(s["done"]),
    )
    return let(runs, lambda a: F.transform(F.sequence(F.lit(1), F.lit(most)), lambda k: F.size(F.filter(a, lambda r: F.least(r, F.lit(most)) == k)).cast("double")))


def moments(a: Column) -> Column:
    """Sum, sum of squares, mean, population variance, skewness and kurtosis (3 for a normal) as a struct; 0 for the last two without spread."""
    both = F.struct(mean(a).alias("m"), variance(a).alias("v"))
    power = lambda s, k: F.try_divide(total(a, lambda x: F.pow((x - s["m"]) / F.sqrt(s["v"]), F.lit(k))), F.size(a))
    return let(both, lambda s: F.struct(
        total(a).alias("sum"), total(a, lambda x: x * x).alias("sum_sq"), s["m"].alias("mean"), s["v"].alias("variance"),
        F.when(s["v"] > 0, power(s, 3)).otherwise(0.0).alias("skew"), F.when(s["v"] > 0, power(s, 4)).otherwise(0.0).alias("kurtosis"),
    ))


def slope_ref(a: Column) -> Column:
    """(sum of x_i i - (sum x)^2 / n) / (sum x^2 - (sum x)^2 / n), 0 where the divisor is."""
    s = F.struct(total(a).alias("s"), total(a, lambda x: x * x).alias("q"), total(F.transform(a, lambda x, i: x * i)).alias("w"))
    return let(s, lambda t: F.coalesce(F.try_divide(t["w"] - t["s"] * t["s"] / F.size(a), t["q"] - t["s"] * t["s"] / F.size(a)), F.lit(0.0)))


def argmax(a: Column) -> Column:
    return F.array_position(a, F.array_max(a)) - 1


def argmin(a: Column) -> Column:
    return F.array_position(a, F.array_min(a)) - 1


def resized(a: Column, n: Column | int, by: Column | None = None) -> Column:
    """The first n values; a shorter series is filled up with its mean, or what is given."""
    n = F.lit(n) if isinstance(n, int) else n
    return F.concat(F.slice(a, F.lit(1), F.least(F.size(a), n)), F.array_repeat(mean(a) if by is None else by, F.greatest(n - F.size(a), F.lit(0))))


def without_points(a: Column, places: list[int]) -> Column:
    return F.filter(a, lambda x, i: ~i.isin(places))


def points(a: Column, places: list[int]) -> Column:
    return F.array(*[F.get(a, F.lit(i)) for i in places])


def sliding(a: Column, size: int) -> Column:
    return F.transform(indices(F.size(a) - size + 1), lambda i: F.slice(a, i + 1, F.lit(size)))


def words(a: Column, size: int = 10, frames: int = 4, alphabet: int = 4) -> Column:
    """The SAX word of each z-normalised window, as letters."""
    letters = F.lit("abcdefghij")
    return F.transform(sliding(a, size), lambda w: F.array_join(F.transform(sax(standardise(w), frames, alphabet), lambda x: F.substring(letters, x.cast("int") + 1, F.lit(1))), ""))


def transposed(dims: Column) -> Column:
    return F.transform(indices(F.size(F.get(dims, F.lit(0)))), lambda t: F.transform(dims, lambda d: F.get(d, t)))
