"""Sums that are the same bits under any dealing of rows."""

import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from vistaquad.functions.sums import fixed_mean, fixed_sum


@pytest.fixture(scope="module")
def values():
    rng = np.random.default_rng(1)
    return [float(x) for x in np.concatenate([rng.normal(0, 1e6, 3000), rng.normal(0, 1e-3, 3000), [1e18, -1e18, 0.1, -0.0]])]


def test_any_number_of_partitions(spark, values):
    df = spark.createDataFrame([(i % 3, v) for i, v in enumerate(values)], "k int, v double")
    seen, plain = set(), set()
    for n in (1, 4, 200):
        rows = df.repartition(n).groupBy("k").agg(fixed_sum(F.col("v")).alias("s"), fixed_mean(F.col("v")).alias("m"), F.sum("v").alias("p")).collect()
        seen.add(tuple(sorted((r.k, r.s, r.m) for r in rows)))
        plain.add(tuple(sorted((r.k, r.p) for r in rows)))
    assert len(seen) == 1
    for k, s, m in next(iter(seen)):
        own = values[k::3]
        want = sum((Fraction(math.floor(Fraction(v) * 2**40), 2**40) for v in own), Fraction(0))
        assert s == float(want) and m == float(want) / len(own)


def test_odd_values(spark):
    nan, inf = float("nan"), float("inf")
    groups = {"none": [None], "inf": [1.0, inf], "nan": [nan, 1.0], "both": [inf, -inf], "some": [None, 0.5], "large": [1e300, 1.0]}
    df = spark.createDataFrame([(k, v) for k, vs in groups.items() for v in vs], "k string, v double")
    got = {r.k: (r.s, r.m) for r in df.groupBy("k").agg(fixed_sum(F.col("v")).alias("s"), fixed_mean(F.col("v")).alias("m")).collect()}
    assert got["none"] == (None, None) and got["inf"][0] == inf and math.isnan(got["nan"][0]) and math.isnan(got["both"][0]) and got["some"] == (0.5, 0.5) and got["large"][0] == 1e300
    assert df.limit(0).agg(fixed_sum(F.col("v"))).first()[0] is None
