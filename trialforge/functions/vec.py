"""Column expressions on ``array<double>``; all stay in the JVM.

NaN is turned into null at ingest, so nulls are the missing values here;
aggregates skip them as the nan-variants of the reference's statistics do.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS64 = 2.220446049250313e-16  # machine epsilon of a double


def doubles(x: Column) -> Column:
    return x.cast("array<double>")


def known(x: Column) -> Column:
    return F.filter(x, lambda v: v.isNotNull())


def total(x: Column) -> Column:
    return F.aggregate(known(x), F.lit(0.0), lambda a, v: a + v)


def mean(x: Column) -> Column:
    return F.try_divide(total(x), F.size(known(x)))


def std(x: Column) -> Column:
    """Population standard deviation."""
    return F.element_at(F.transform(F.array(mean(x)), lambda m: F.sqrt(F.try_divide(F.aggregate(known(x), F.lit(0.0), lambda a, v: a + (v - m) * (v - m)), F.size(known(x))))), 1)


def median(x: Column) -> Column:
    def pick(s: Column) -> Column:
        n = F.size(s)
        low, high = F.element_at(s, F.floor((n + 1) / 2).cast("int")), F.element_at(s, F.floor(n / 2).cast("int") + 1)
        return F.when(n > 0, (low + high) / 2)

    return F.element_at(F.transform(F.array(F.array_sort(known(x))), pick), 1)


def mad(x: Column) -> Column:
    """1.4826 times the median distance from the median."""
    return F.element_at(F.transform(F.array(median(x)), lambda m: F.lit(1.4826) * median(F.transform(x, lambda v: F.abs(v - m)))), 1)


def trapezoid(x: Column, step: Column | float = 1.0) -> Column:
    """Area under evenly spaced samples."""
    n = F.size(x)
    inner = F.transform(F.sequence(F.lit(1), n - 1), lambda i: (F.element_at(x, i) + F.element_at(x, i + 1)) / 2)
    return F.when(n > 1, total(inner) * step).otherwise(F.lit(0.0))


def difference(x: Column, n: int = 1) -> Column:
    """First difference, n times; the first element counts as preceded by itself."""

    def once(y: Column) -> Column:
        return F.transform(y, lambda v, i: F.when(i == 0, F.lit(0.0)).otherwise(v - F.element_at(y, F.greatest(i, F.lit(1)))))

    for _ in range(n):
        x = once(x)
    return x


def window(x: Column, first: Column | int, n: int) -> Column:
    """n elements from 0-based index ``first``; indexes beyond an end repeat the end."""
    first = F.lit(first) if isinstance(first, int) else first
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.element_at(x, F.least(F.greatest(first + k, F.lit(0)), F.size(x) - 1).cast("int") + 1))


def interpolate(x: Column, at: Column) -> Column:
    """Linear interpolation at fractional 0-based indexes; clamped at the ends."""

    def one(p: Column) -> Column:
        q = F.least(F.greatest(p, F.lit(0.0)), (F.size(x) - 1).cast("double"))
        i = F.floor(q).cast("int")
        low, high = F.element_at(x, i + 1), F.element_at(x, F.least(i + 2, F.size(x)))
        return low + (high - low) * (q - i)

    return F.transform(at, one)


def block_mean(x: Column, factor: int) -> Column:
    """Means of whole blocks; a partial last block is dropped."""
    blocks = F.floor(F.size(x) / factor).cast("int")
    return F.when(blocks > 0, F.transform(F.sequence(F.lit(0), blocks - 1), lambda b: total(F.slice(x, b * factor + 1, factor)) / factor))


def zscore(x: Column, base: Column) -> Column:
    s = F.when(std(base) == 0, F.lit(EPS64)).otherwise(std(base))
    return _with2(mean(base), s, lambda m, sd: F.transform(x, lambda v: (v - m) / sd))


def center(x: Column, base: Column) -> Column:
    return F.element_at(F.transform(F.array(mean(base)), lambda m: F.transform(x, lambda v: v - m)), 1)


def mad_norm(x: Column, base: Column) -> Column:
    return _with2(median(base), mad(base), lambda m, s: F.transform(x, lambda v: F.try_divide(v - m, s)))


def amp_norm(x: Column, base: Column) -> Column:
    return F.element_at(F.transform(F.array(center(x, base)), lambda c: F.element_at(F.transform(F.array(F.array_max(F.transform(c, F.abs))), lambda top: F.transform(c, lambda v: F.try_divide(v, top))), 1)), 1)


def _with2(a: Column, b: Column, f) -> Column:
    """Binds two values once for a lambda."""
    return F.element_at(F.transform(F.array(F.struct(a.alias("a"), b.alias("b"))), lambda s: f(s["a"], s["b"])), 1)


NORMALISATIONS = {"none": lambda x, b: x, "zscore": zscore, "zero": center, "mad": mad_norm, "amp": amp_norm}


def normalise(x: Column, base: Column, how: str = "none") -> Column:
    if how not in NORMALISATIONS:
        raise ValueError(f"unknown normalisation {how}")
    return NORMALISATIONS[how](x, base)
