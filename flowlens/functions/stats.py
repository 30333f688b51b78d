"""Column expressions over counts, and scalar helpers that several operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def share(part: Column, whole: Column) -> Column:
    """part / whole, 0 where there is no whole."""
    return F.when(whole == 0, 0.0).otherwise(part / whole)


def entropy(n: Column, total: Column) -> Column:
    """Aggregate: Shannon entropy (natural logarithm) of counts n that sum to total in every group."""
    p = n / total
    return -F.sum(p * F.ln(p))


def normal_entropy(n: Column, total: Column) -> Column:
    """Aggregate: entropy over ln of the number of categories, in [0, 1]; 0 for one category or none."""
    kinds = F.count(F.lit(1))
    return F.when(kinds <= 1, 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), entropy(n, total) / F.ln(F.greatest(kinds, F.lit(2))))))


def concentration(n: Column, total: Column) -> Column:
    """Aggregate: sum of squared shares."""
    return F.sum((n / total) * (n / total))


def richness(unique: Column, n: Column, most: int) -> Column:
    """log1p(unique) against log1p of what n rows allow, as 0 to 100."""
    return F.when(n <= 0, 0.0).otherwise(F.least(F.lit(100.0), 100 * F.log1p(unique) / F.log1p(F.least(n, F.lit(most)))))


def log_score(x: Column, most: float) -> Column:
    return F.least(F.lit(100.0), 100 * F.log1p(x) / F.log1p(F.lit(most)))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def finite(x: Column) -> Column:
    """x, or null where it is NaN or infinite."""
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


def clean(x: Column) -> Column:
    """x, or 0 where it is null, NaN or infinite."""
    return F.coalesce(finite(x), F.lit(0.0))
