"""Clustering by a chosen distance."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from logquarry.operators import clustering as cg
from logquarry.operators import sequences as sq


def kinds(spark, n=90):
    rng = random.Random(4)
    texts = ["alpha beta gamma delta {}", "one two three four five {}", "{} nothing alike in here at all"]
    rows = []
    for i in range(n):
        t = texts[i % 3].format(rng.randrange(9))
        rows.append((i, t, t.split(), [5.0 * (i % 3), 5.0 * (i % 3 == 1), rng.random() / 10]))
    return spark.createDataFrame(rows, "id long, text string, words array<string>, vec array<double>")


@pytest.mark.parametrize("name, threshold", [("edit", 0.3), ("ngram_1", 0.5), ("ngram_3", 0.7), ("jaccard", 0.5), ("lcs", 0.4), ("euclidean", 0.5), ("mixed", 0.4)])
def test_every_distance_finds_the_kinds(spark, name, threshold):
    got = cg.iterative_clusters(kinds(spark), ["id"], F.struct("text", "words", "vec"), name, threshold, sample_size=40).collect()
    by = {}
    for r in got:
        by.setdefault(r["centre"], set()).add(r["id"] % 3)
    assert len(got) == 90 and None not in by and sorted(map(tuple, by.values())) == [(0,), (1,), (2,)]


def test_own_distance_and_rows_left_over(spark):
    rows = [(i, float(i % 2 * 100 + i / 100)) for i in range(60)] + [(100, 1e6), (101, None)]
    df = spark.createDataFrame(rows, "id long, v double")
    got = {r["id"]: r["centre"] for r in cg.iterative_clusters(df, ["id"], F.struct("v"), lambda a, b: F.abs(a["v"] - b["v"]), 5.0).collect()}
    assert got[100] is None and got[101] is None
    assert len({got[i] for i in range(0, 60, 2)}) == 1 and {got[i] for i in range(0, 60, 2)} != {got[i] for i in range(1, 60, 2)}


def test_nothing_to_cluster(spark):
    df = kinds(spark)
    assert cg.iterative_clusters(df.where("false"), ["id"], F.struct("text"), "edit", 0.3).collect() == []
    assert [r["centre"] for r in cg.iterative_clusters(df.limit(2), ["id"], F.struct("text"), "edit", 0.3).collect()] == [None, None]


def test_linkage_against_definition():
    rng = np.random.default_rng(1)
    for _ in range(20):
        p = rng.random((12, 2))
        far = np.sqrt(((p[:, None] - p[None]) ** 2).sum(axis=2))
        groups = [{i} for i in range(12)]
        while len(groups) > 1:
            width = lambda pair: max(far[i, j] for i, j in itertools.product(*pair))
            best = min(itertools.combinations(groups, 2), key=width)
            if width(best) > 0.4:
                break
            groups = [g for g in groups if g not in best] + [best[0] | best[1]]
        assert sorted(map(sorted, groups)) == sorted(map(sorted, cg.linked(far, 0.4)))
        assert sorted(map(sorted, groups)) == sorted(map(sorted, sq.complete_linkage(p, 0.4)))


def test_pair_table_takes_the_larger_way(spark):
    df = spark.createDataFrame([(0, (1,)), (1, (4,)), (2, (9,))], "no int, item struct<v: int>")
    got = {(r["i"], r["j"]): r["distance"] for r in cg.pair_table(df, lambda a, b: a["v"] - b["v"]).collect()}
    assert got == {(1, 0): 3.0, (2, 0): 8.0, (2, 1): 5.0}
