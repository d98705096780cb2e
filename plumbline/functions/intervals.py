"""Interval algebra of printed p-values, as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SIGNIFICANT, NOT_SIGNIFICANT, UNSURE = "significant", "nonsignificant", "indeterminate"
#: Ends of recomputed p-values as close as this are one number: far over the kernels' rounding, far under any printed digit.
SLACK = 1e-12


def pow10(decimals: Column) -> Column:
    """10 ** -decimals as a double."""
    return F.pow(F.lit(10.0), -decimals.cast("double"))


def overlap(low_a, high_a, low_b, high_b, *, low_a_closed=True, high_a_closed=True, low_b_closed=True, high_b_closed=True, slack: float | None = None) -> Column:  # noqa: ANN001
    """Whether two intervals share a point; ends that only touch (differ by slack at most) must both be closed."""
    over = lambda x, y: x > y if slack is None else x - y > slack
    touch = lambda x, y: x == y if slack is None else F.abs(x - y) <= slack
    both = lambda x, y: (x if isinstance(x, Column) else F.lit(x)) & (y if isinstance(y, Column) else F.lit(y))
    left = over(high_a, low_b) | (touch(high_a, low_b) & both(high_a_closed, low_b_closed))
    right = over(high_b, low_a) | (touch(high_b, low_a) & both(high_b_closed, low_a_closed))
    return left & right


def significance(low: Column, high: Column, alpha: Column, low_closed: Column | None = None) -> Column:
    """Where an interval of p-values lies against alpha."""
    open_at_alpha = F.lit(False) if low_closed is None else ~low_closed
    return (
        F.when(high <= alpha, F.lit(SIGNIFICANT))
        .when((low > alpha) | ((low == alpha) & open_at_alpha), F.lit(NOT_SIGNIFICANT))
        .otherwise(F.lit(UNSURE))
    )


def printed(p: Column, operator: Column, decimals: Column, alpha: Column) -> Column:
    """struct(low, high, low_closed, high_closed, zero, significance) of a printed p-value."""
    half = pow10(decimals) / 2
    equal = operator == "="
    below, above = operator.isin("<", "<="), operator.isin(">", ">=")
    zero = p == 0
    low = F.when(equal, F.greatest(F.lit(0.0), p - half)).when(below, F.lit(0.0)).otherwise(p)
    high = F.when(equal, F.least(F.lit(1.0), p + half)).when(above, F.lit(1.0)).otherwise(p)
    low_closed, high_closed = operator != ">", operator != "<"
    low, high = F.when(zero, F.lit(0.0)).otherwise(low), F.when(zero, F.lit(0.0)).otherwise(high)
    kind = F.when(zero, F.lit(SIGNIFICANT)).otherwise(significance(low, high, alpha, low_closed))
    return F.struct(low.alias("low"), high.alias("high"), low_closed.alias("low_closed"), high_closed.alias("high_closed"), zero.alias("zero"), kind.alias("significance"))


def consistency(p_min: Column, p_max: Column, shown: Column, alpha: Column) -> Column:
    """struct(consistent, decision_error) of recomputed bounds against a printed p-value; neither hangs on the last bits of a recomputed bound."""
    meets = overlap(p_min, p_max, shown["low"], shown["high"], low_b_closed=shown["low_closed"], high_b_closed=shown["high_closed"], slack=SLACK)
    mine = significance(p_min, p_max, alpha + SLACK)
    error = (mine != UNSURE) & (shown["significance"] != UNSURE) & (mine != shown["significance"])
    return F.struct((meets & ~shown["zero"]).alias("consistent"), error.alias("decision_error"), mine.alias("significance"))
