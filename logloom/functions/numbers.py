"""Column expressions for counts, ratios and order statistics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Rewards this close to 1 count as success.
TOLERANCE = 1e-6


def is_successful(reward: Column) -> Column:
    """Whether a reward is 1 within the tolerance; null stays null."""
    return F.abs(reward - 1.0) <= TOLERANCE


def pass_hat_k(n: Column, c: Column, k: int) -> Column:
    """C(c, k) / C(n, k) as a running product, which overflows for no n; null where n < k."""
    ratio = F.lit(1.0)
    for i in range(k):
        ratio = ratio * F.greatest(c - i, F.lit(0)) / F.when(n >= k, n - i)
    return F.when(n >= k, ratio)


def round_up(value: Column, multiple: int, most: int | None = None) -> Column:
    """``value`` up to the next multiple, no more than ``most``."""
    up = F.ceil(value / multiple) * multiple
    return (F.least(up, F.lit(most)) if most is not None else up).cast("long")


def length_bin(tokens: Column, most: int = 16384) -> Column:
    """Closed upper bounds at 4096, 8192, 12288 and ``most``."""
    low, out = 0, None
    for high in (4096, 8192, 12288, most):
        label = f"{low:05d}-{high:05d}"
        out = F.when(tokens <= high, label) if out is None else out.when(tokens <= high, label)
        low = high + 1
    return out.otherwise(f">{most}")


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0 or either is null."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
