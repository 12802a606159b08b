"""Peak search and Gaussian fits of one small histogram as column expressions.

A histogram is an array of counts, so a row is fitted where it lies: no Python worker and no shuffle. Loops are folds over
arrays; ``let`` names a value that an expression needs more than once.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Steps of a fit at most, and the damping from which it gives up.
STEPS, MOST_DAMPING = 500, 1e12


def let(value: Column, make: Callable[[Column], Column]) -> Column:
    """``make(value)`` with ``value`` computed once."""
    return F.get(F.transform(F.array(value), make), F.lit(0))


def _number(x: float) -> Column:
    return F.lit(float(x))


def indices(n: Column | int) -> Column:
    """0 to n - 1; empty for 0."""
    n = F.lit(n) if isinstance(n, int) else n
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


# ---- peaks


def plateaus(y: Column) -> Column:
    """Middles of the plateaus that are higher than what is on both sides of them; the ends of the array are no peaks."""
    n = F.size(y)

    def is_middle(i: Column) -> Column:
        other = lambda k: F.get(y, k) != F.get(y, i)
        before = F.array_max(F.filter(indices(i), other))
        after = F.array_min(F.filter(F.when(i + 1 < n, F.sequence(i + 1, n - 1)).otherwise(F.array().cast("array<int>")), other))
        lower = (F.get(y, before) < F.get(y, i)) & (F.get(y, after) < F.get(y, i))
        return F.coalesce(lower & (F.expr("1").cast("int") * F.floor((before + after) / 2) == i), F.lit(False))

    return F.filter(indices(n), is_middle)


def spaced(y: Column, peaks: Column, distance: int) -> Column:
    """Of peaks closer than ``distance`` the higher one (of equal ones the later), the highest chosen first."""
    high_first = F.reverse(F.array_sort(F.transform(peaks, lambda i: F.struct(F.get(y, i).alias("y"), i.alias("i")))))
    far = lambda kept, peak: ~F.exists(kept, lambda k: F.abs(k - peak["i"]) < distance)
    return F.aggregate(high_first, F.array().cast("array<int>"), lambda kept, peak: F.when(far(kept, peak), F.array_append(kept, peak["i"])).otherwise(kept))


def _rise_and_width(y: Column, k: Column) -> Column:
    """Struct of the prominence of the peak at ``k`` and its width at half of that, with crossings linearly interpolated."""
    at = lambda i: F.get(y, i)
    n = F.size(y)
    higher = lambda i: at(i) > at(k)
    left = F.coalesce(F.array_max(F.filter(indices(k), higher)) + 1, F.lit(0))
    right = F.coalesce(F.array_min(F.filter(F.sequence(k, n - 1), higher)) - 1, n - 1)

    def inside(ends: Column) -> Column:
        low, high = ends["left"], ends["right"]
        least = lambda a, b: F.array_min(F.transform(F.sequence(a, b), at))
        rise = at(k) - F.greatest(least(low, k), least(k, high))

        def width(r: Column) -> Column:
            level = at(k) - r / 2
            under = lambda i: at(i) <= level
            a = F.array_max(F.filter(indices(k), lambda i: (i >= low) & under(i)))
            b = F.array_min(F.filter(F.sequence(k, n - 1), lambda i: (i > k) & (i <= high) & under(i)))
            crossing = lambda i, step: F.when(at(i) < level, i - step * F.try_divide(level - at(i), at(i - step) - at(i))).otherwise(i.cast("double"))
            start = F.coalesce(let(a, lambda i: F.when(i.isNotNull(), crossing(i, -1))), low.cast("double"))
            end = F.coalesce(let(b, lambda i: F.when(i.isNotNull(), crossing(i, 1))), high.cast("double"))
            return F.struct(r.alias("rise"), (end - start).alias("width"))

        return let(rise, width)

    return let(F.struct(left.alias("left"), right.alias("right")), inside)


def rightmost_peak(y: Column, height: Column, distance: int, prominence: float, width: float) -> Column:
    """Position of the last peak of ``y`` (array of double) that is high, isolated, prominent and wide enough; NULL if there is none."""
    high = F.filter(plateaus(y), lambda i: F.get(y, i) >= height)
    good = lambda i: let(_rise_and_width(y, i), lambda m: (m["rise"] >= prominence) & (m["width"] >= width))
    return F.array_max(F.filter(spaced(y, high, distance), good))


# ---- fits


def _bells(x: Column, p: Column, count: int) -> list[Column]:
    """For each of ``count`` area-normalised Gaussians (area, mean, sigma in ``p``) an array: its value and its three derivatives."""

    def bell(area: Column, mean: Column, sigma: Column) -> Column:
        parts = lambda z: lambda u: F.array(area * u, u, area * u * z / sigma, area * u * (z * z - 1) / sigma)
        unit = lambda z: F.exp(-0.5 * z * z) / (math.sqrt(2 * math.pi) * sigma)
        return let((x - mean) / sigma, lambda z: let(unit(z), parts(z)))

    return [bell(*(F.get(p, F.lit(3 * k + i)) for i in range(3))) for k in range(count)]


def curve(x: Column, p: Column, count: int) -> Column:
    """Sum of ``count`` Gaussians at ``x``."""
    values = [F.get(b, F.lit(0)) for b in _bells(x, p, count)]
    return sum(values[1:], values[0])


def _system(points: Column, p: Column, count: int) -> Column:
    """Array: weighted sum of squares, the upper triangle of the normal matrix, and the gradient, for points (x, y, err)."""
    n = 3 * count
    zeros = F.array_repeat(_number(0), 1 + n * (n + 1) // 2 + n)

    def products(row: Column) -> Column:
        r, g = F.get(row, F.lit(0)), [F.get(row, F.lit(1 + i)) for i in range(n)]
        return F.array(r * r, *(g[i] * g[j] for i in range(n) for j in range(i, n)), *(g[i] * r for i in range(n)))

    def row(q: Column) -> Column:
        def weighted(bells: Column) -> Column:
            parts = [F.get(bells, F.lit(k)) for k in range(count)]
            values = [F.get(b, F.lit(0)) for b in parts]
            slopes = [F.get(b, F.lit(i)) / q["err"] for b in parts for i in (1, 2, 3)]
            return F.array((q["y"] - sum(values[1:], values[0])) / q["err"], *slopes)

        return let(F.array(*_bells(q["x"], p, count)), weighted)

    return F.aggregate(points, zeros, lambda acc, q: F.zip_with(acc, let(row(q), products), lambda a, b: a + b))


def _eliminated(matrix: Column, n: int) -> Column:
    """Rows [A | B] turned into [I | inverse(A) B] by elimination; NULL numbers where A (symmetric, positive) is singular."""

    def pivot(m: Column, c: Column) -> Column:
        own = let(F.get(F.get(m, c), c), lambda d: F.transform(F.get(m, c), lambda v: F.try_divide(v, d)))
        return let(
            own,
            lambda first: F.transform(
                m, lambda row, i: F.when(i == c, first).otherwise(F.zip_with(row, first, lambda a, b: a - F.get(row, c) * b))
            ),
        )

    return F.aggregate(indices(n), matrix, pivot)


def _matrix(system: Column, n: int, damping: Column | None, right: Callable[[int], list[Column]]) -> Column:
    places = {}
    for i in range(n):
        for j in range(i, n):
            places[i, j] = places[j, i] = 1 + len({frozenset(k) for k in places})
    cell = lambda i, j: F.get(system, F.lit(places[i, j]))

    def damped(i: int) -> Column:
        d = cell(i, i)
        return d if damping is None else d + damping * F.when(d == 0, 1.0).otherwise(d)

    return F.array(*(F.array(*(damped(i) if i == j else cell(i, j) for j in range(n)), *right(i)) for i in range(n)))


def least_squares(points: Column, start: Column, count: int = 1, steps: int = STEPS) -> Column:
    """Damped Gauss-Newton fit of ``count`` Gaussians to ``points`` (array of x, y, err) from ``start`` (array of double).

    A struct: ``p``, ``cost`` (weighted sum of squares), ``covariance`` (scaled by cost per degree of freedom; NULL if the normal matrix is singular)
    and ``found``: a minimum was reached with more points than parameters. Widths stay positive.
    """
    n = 3 * count

    def state(p, system, damping, done):
        return F.struct(p.alias("p"), system.alias("system"), damping.alias("damping"), done.alias("done"))

    def step(now: Column) -> Column:
        gradient = lambda i: [F.get(now["system"], F.lit(1 + n * (n + 1) // 2 + i))]
        solved = _eliminated(_matrix(now["system"], n, now["damping"], gradient), n)
        moves = F.transform(solved, lambda row: F.get(row, F.lit(n)))

        def tried(move: Column) -> Column:
            trial = F.zip_with(now["p"], move, lambda a, b: a + b)

            def judged(t: Column) -> Column:
                positive = F.get(t, F.lit(2)) > 0
                for k in range(1, count):
                    positive &= F.get(t, F.lit(3 * k + 2)) > 0
                fitted = F.when(positive, _system(points, t, count))

                def decided(s: Column) -> Column:
                    cost, old = F.get(s, F.lit(0)), F.get(now["system"], F.lit(0))
                    small = F.forall(F.zip_with(move, now["p"], lambda d, p: F.abs(d) <= 1e-9 * (F.abs(p) + 1e-9)), lambda ok: ok)
                    ended = (old - cost <= 1e-12 * F.greatest(old, _number(1e-300))) & small
                    better = F.coalesce((cost <= old) & ~F.isnan(cost), F.lit(False))
                    worse = now["damping"] * 10
                    return F.when(better, state(t, s, F.greatest(now["damping"] / 10, _number(1e-12)), ended)).otherwise(
                        state(now["p"], now["system"], worse, worse > MOST_DAMPING)
                    )

                return let(fitted, decided)

            return let(trial, judged)

        return let(moves, tried)

    first = let(start, lambda p: state(p, _system(points, p, count), _number(1e-3), F.lit(False)))
    last = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), first, lambda now, _: F.when(now["done"], now).otherwise(step(now)))

    def result(end: Column) -> Column:
        cost, freedom = F.get(end["system"], F.lit(0)), F.size(points) - n
        unit = lambda i: [_number(i == j) for j in range(n)]
        inverse = F.transform(_eliminated(_matrix(end["system"], n, None, unit), n), lambda row: F.slice(row, n + 1, n))
        scaled = F.transform(inverse, lambda row: F.transform(row, lambda v: v * F.try_divide(cost, freedom)))
        whole = F.forall(F.flatten(scaled), lambda v: v.isNotNull() & ~F.isnan(v))
        found = ~F.isnan(cost) & (F.abs(cost) < math.inf) & (freedom > 0)
        return F.struct(end["p"].alias("p"), cost.alias("cost"), F.when(whole, scaled).alias("covariance"), found.alias("found"))

    return let(last, result)


def moments(points: Column) -> Column:
    """Struct ``total, mean, spread`` of points (x, y); the spread is that of a sample where the total exceeds 1."""
    summed = lambda of: F.aggregate(points, _number(0), lambda a, q: a + of(q))

    def around(first: Column) -> Column:
        mean = F.try_divide(first["xy"], first["total"])
        return let(mean, lambda m: F.struct(first["total"].alias("total"), m.alias("mean"), spread(points, first["total"], m).alias("spread")))

    return let(F.struct(summed(lambda q: q["y"]).alias("total"), summed(lambda q: q["x"] * q["y"]).alias("xy")), around)


def spread(points: Column, total: Column, mean: Column) -> Column:
    """Variance of points around ``mean``."""
    squares = F.aggregate(points, _number(0), lambda a, q: a + (q["x"] - mean) * (q["x"] - mean) * q["y"])
    return F.try_divide(squares, total) * F.when(total > 1, F.try_divide(total, total - 1)).otherwise(_number(1))
