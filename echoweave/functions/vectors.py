"""Arrays of numbers: finiteness, norms, cosines, gates, firing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CIF_THRESHOLD = 1.0
#: A peak fires from here on.
PEAK = 1 - 1e-4


def is_finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))


def all_finite(v: Column) -> Column:
    return F.forall(v, is_finite)


def finite_mean(v: Column) -> Column:
    """Mean of the finite elements, else minus infinity."""
    kept = F.filter(v, is_finite)
    return F.when(F.size(kept) > 0, F.try_divide(F.aggregate(kept, F.lit(0.0), lambda a, x: a + x), F.size(kept))).otherwise(F.lit(float("-inf")))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def cosine(a: Column, b: Column) -> Column:
    """0 for a zero vector."""
    return F.coalesce(F.try_divide(dot(a, b), norm(a) * norm(b)), F.lit(0.0))


def normalized(v: Column) -> Column:
    """Of length 1; null for a norm of at most 1e-10 or a component that isn't finite."""
    n = norm(v)
    return F.when(all_finite(v) & (n > 1e-10), F.transform(v, lambda x: F.try_divide(x.cast("double"), n)))


def argmax(v: Column) -> Column:
    """Index from 0 of the first maximum."""
    return (F.array_position(v, F.array_max(v)) - 1).cast("int")


def softmax_of_max(v: Column) -> Column:
    """Probability of the maximum: 1 / sum of exp(x - max)."""
    top = F.array_max(v)
    return F.try_divide(F.lit(1.0), F.aggregate(v, F.lit(0.0), lambda s, x: s + F.exp((x - top).cast("double"))))


def fire_places(peaks: Column) -> Column:
    """Indices of peaks of 1 - 1e-4 or more, shifted by -1.5."""
    places = F.transform(peaks, lambda x, i: F.when(x >= PEAK, i - 1.5))
    return F.filter(places, lambda p: p.isNotNull())


def fires(alphas: Column, threshold: float = CIF_THRESHOLD) -> Column:
    """Integrate alphas; at the threshold fire, at most once a step, and carry the rest. Indices of the firing steps."""
    state = F.struct(F.lit(0.0).alias("acc"), F.lit(0).alias("i"), F.array().cast("array<int>").alias("at"))

    def step(s: Column, x: Column) -> Column:
        total = s["acc"] + x
        fire = total >= threshold
        return F.struct(F.when(fire, total - threshold).otherwise(total).alias("acc"), (s["i"] + 1).alias("i"), F.when(fire, F.concat(s["at"], F.array(s["i"]))).otherwise(s["at"]).alias("at"))

    return F.aggregate(alphas, state, step, lambda s: s["at"])


def recomputed_fires(alphas: Column, expected: Column) -> Column:
    """Firing places from the weights, scaled to sum to the expected number of fires: integrated with carry, at most one a step, shifted by -1.5.

    None where the weights sum to 1e-6 or less.
    """
    total = F.aggregate(alphas, F.lit(0.0), lambda s, x: s + x)
    scaled = F.transform(alphas, lambda x: x * F.try_divide(expected.cast("double"), total))
    places = F.transform(fires(scaled, PEAK), lambda i: i - 1.5)
    return F.when(total > 1e-6, places).otherwise(F.array().cast("array<double>"))


def firing_places(peaks: Column, alphas: Column, n: Column) -> Column:
    """Places of n + 1 fires: those of the peaks, unless their number differs and there are weights to recompute them from."""
    seen = fire_places(peaks)
    return F.when((F.size(seen) != n + 1) & (F.size(alphas) > 0), recomputed_fires(alphas, n + 1)).otherwise(seen)


def token_times(peaks: Column, alphas: Column, n: Column, longest: Column, unit: float = 20.0, grid: int = 60) -> Column:
    """Milliseconds of n + 1 token bounds from firing_places(): units, kept between 0 and the longest.

    Missing ones follow the last in steps of the grid; with fewer than two
    places all lie on the grid. No tokens or no length: none.
    """
    places = firing_places(peaks, alphas, n)
    have = F.size(places)
    known = F.transform(F.slice(places, F.lit(1), n + 1), lambda p: F.least(longest, F.greatest(F.lit(0), F.round(p * unit).cast("int"))))
    after = F.transform(F.when(have <= n, F.sequence(have, n)).otherwise(F.array().cast("array<int>")), lambda i: F.least(longest, F.element_at(known, -1) + (i - have + 1) * grid))
    even = F.transform(F.sequence(F.lit(0), n), lambda i: F.least(longest, i * grid))
    return F.when((n <= 0) | (longest <= 0), F.array().cast("array<int>")).when(have < 2, even).otherwise(F.concat(known, after))


def padded(v: Column, size: int) -> Column:
    """Cut or zero-padded to a size."""
    return F.slice(F.concat(v, F.array_repeat(F.lit(0.0), size)), 1, size)
