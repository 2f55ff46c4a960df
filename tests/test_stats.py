"""Ranks over ranges and tails of the normal law."""

import math
import random

import pytest
from pyspark.sql import functions as F

from logquarry.functions import ranks as rk
from logquarry.operators import stats as st


@pytest.mark.parametrize("z", [0.0, 0.1, 1.0, 2.5, 5.0, 10.0, 20.0])
def test_erfc_to_relative_accuracy(spark, z):
    got = spark.range(1).select(st.erfc(F.lit(z)).alias("p")).first()["p"]
    assert abs(got - math.erfc(z)) <= 1e-6 * math.erfc(z)


def test_p_value_in_the_tail(spark):
    rows = [(i, i + (i * 7919) % 200) for i in range(400)]
    df = spark.createDataFrame(rows, "x long, y long")
    k = st.kendall(df, "x", "y").first()
    n, s = k["n"], k["concordant"] - k["discordant"]
    ys = {}
    for _, y in rows:
        ys[y] = ys.get(y, 0) + 1
    ties = sum(t * (t - 1) * (2 * t + 5) for t in ys.values())
    want = math.erfc(abs(s) / math.sqrt((n * (n - 1) * (2 * n + 5) - ties) / 18) / math.sqrt(2))
    assert want < 1e-30 and abs(k["p_value"] - want) < 1e-4 * want


def test_totals_before_with_a_hot_value(spark):
    rng = random.Random(3)
    rows = [(rng.choice("aab"), rng.choice([5] * 3 + list(range(40)))) for _ in range(900)]
    df = spark.createDataFrame(rows, "k string, v int").repartition(7)
    got = {(r["k"], r["v"]): (r["n"], r["below"]) for r in rk.cumulative_counts(df, "v", keys=["k"]).collect()}
    want = {(k, v): (rows.count((k, v)), sum(a == k and b < v for a, b in rows)) for k, v in set(rows)}
    assert got == want
    assert rk.cumulative_counts(df.where("false"), "v").collect() == []
