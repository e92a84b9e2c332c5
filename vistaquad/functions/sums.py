"""Sums that don't depend on how rows are dealt out: addends in whole steps of 2^-BITS, added up as whole numbers.

Floating sums differ in their last digits with the order of the addends, so with partitions, retries and executors. Here each
addend is cut to its step once, and whole numbers add up the same in any order; Spark still combines them before a shuffle.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

BITS = 40  # 2^-40 is about 1e-12; with 38 decimal digits sums reach 3e26


def fixed_sum(x: Column, bits: int = BITS) -> Column:
    """The sum of a double column as an aggregate: null of no values; infinite or NaN as soon as an addend is, or if the sum
    of a group is beyond 38 digits of steps."""
    finite = F.abs(x) < 2.0 ** (120 - bits)  # false for NaN
    whole = x * F.lit(2.0**bits)
    # floor() of doubles gives a long, so what is larger, and whole anyhow, goes around it.
    steps = F.when(F.abs(whole) < 2.0**53, F.floor(F.when(F.abs(whole) < 2.0**53, whole)).cast("decimal(38,0)")).when(finite, F.when(finite, whole).cast("decimal(38,0)"))
    return F.coalesce(F.sum(F.when(~finite, x)), F.sum(steps).cast("double") / F.lit(2.0**bits))


def fixed_mean(x: Column, bits: int = BITS) -> Column:
    return fixed_sum(x, bits) / F.nullif(F.count(x), F.lit(0).cast("long"))
