"""Iterative clustering by any distance column.

A round draws a bounded sample of the rows without a cluster, computes the distances of its pairs
as a table, links it completely, and takes the medoid of each large enough cluster as a centre.
All rows that are left are then compared with the round's centres inside their own row.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from logquarry.operators import sequences as sq
from logquarry.session import cut_lineage, task_count

Distance = Callable[[Column, Column], Column]

TASK_ROWS = 100_000  # rows that one task compares with the centres

# distances of two items, which are structs with the named fields
BY_NAME: dict[str, Distance] = {
    "edit": lambda a, b: sq.normalized_edit_distance(a["text"], b["text"]),
    **{f"ngram_{n}": (lambda a, b, n=n: sq.ngram_distance(a["words"], b["words"], n)) for n in (1, 2, 3)},
    "jaccard": lambda a, b: sq.jaccard_distance(a["words"], b["words"]),
    "lcs": lambda a, b: sq.lcs_distance(a["words"], b["words"]),
    "euclidean": lambda a, b: sq.euclidean_per_length(a["vec"], b["vec"]),
    "cosine": lambda a, b: sq.cosine_distance(a["vec"], b["vec"]),
    "mixed": lambda a, b: sq.mixed_distance(a["words"], b["words"], a["vec"], b["vec"]),
}


def pair_table(sample: DataFrame, distance: Distance) -> DataFrame:
    """``(i, j, distance)`` of a bounded sample (no, item), j < i. A distance that is not symmetric counts by its larger way."""
    first = sample.where("no > 0").select(F.col("no").alias("i"), F.col("item").alias("a"), F.explode(F.sequence(F.lit(0), F.col("no") - 1)).alias("j"))
    second = sample.select(F.col("no").alias("j"), F.col("item").alias("b"))
    a, b = F.col("a"), F.col("b")
    return first.join(second, "j").select("i", "j", F.greatest(distance(a, b), distance(b, a)).cast("double").alias("distance"))


def linked(far: np.ndarray, threshold: float) -> list[list[int]]:
    """Complete linkage on a small matrix of distances: the nearest clusters merge while the farthest
    pair of their members is within ``threshold``."""
    far = far.copy()
    np.fill_diagonal(far, np.inf)
    groups = [[i] for i in range(len(far))]
    while len(groups) > 1:
        i, j = sorted(np.unravel_index(np.argmin(far), far.shape))
        if not far[i, j] <= threshold:
            break
        groups[i] += groups.pop(j)
        row = np.maximum(far[i], far[j])
        row[i] = np.inf
        far[i], far[:, i] = row, row
        far = np.delete(np.delete(far, j, 0), j, 1)
    return groups


def _centres(sample: DataFrame, distance: Distance, threshold: float, min_members: int) -> list[int]:
    """Numbers of the medoids of a sample's clusters."""
    pairs = pair_table(sample, distance).collect()  # at most half the square of the sample
    n = max((r["i"] for r in pairs), default=0) + 1
    far = np.full((n, n), np.inf)
    for r in pairs:
        far[r["i"], r["j"]] = far[r["j"], r["i"]] = np.inf if r["distance"] is None else r["distance"]
    np.fill_diagonal(far, 0)
    out = []
    for g in linked(far, threshold):
        if len(g) >= min_members:
            g = sorted(g)
            out.append(g[int(far[np.ix_(g, g)].sum(axis=1).argmin())])
    return out


def iterative_clusters(
    df: DataFrame,
    keys: Sequence[str],
    item: Column,
    distance: str | Distance,
    threshold: float,
    sample_size: int = 100,
    min_members: int = 3,
    max_empty_rounds: int = 3,
    seed: int = 0,
) -> DataFrame:
    """``(keys, centre)``: number of the nearest centre within ``threshold``, null for rows left over.

    ``keys`` are unique and ``item`` is a struct that ``distance`` understands: a name of :data:`BY_NAME`
    or a function of two items. A row belongs to the centres of the first round that has one near
    enough. About ``sample_size`` rows are drawn in a round, by hash, so a run can be repeated; rows
    whose distance is null stay left over.
    """
    measure = BY_NAME[distance] if isinstance(distance, str) else distance
    rest = cut_lineage(df.select(*keys, item.alias("item")).repartition(task_count(df, TASK_ROWS)))
    done: DataFrame | None = None
    known, empty, round_no = 0, 0, 0
    while empty < max_empty_rounds:
        left_over = rest.count()
        if left_over < min_members:
            break
        drawn = sq.random_sample(rest, keys, min(1.0, sample_size / left_over), seed + round_no)
        round_no += 1
        # one window over the sample only
        sample = cut_lineage(drawn.withColumn("no", F.row_number().over(W.orderBy(*keys)) - 1))
        centres = _centres(sample, measure, threshold, min_members)
        if not centres:
            empty += 1
            continue
        chosen = sample.where(F.col("no").isin(centres)).agg(F.array_sort(F.collect_list(F.struct("no", "item"))).alias("c"))
        near = F.transform("centres", lambda c, i: F.struct(measure(F.col("item"), c["item"]).cast("double").alias("d"), i.alias("no")))
        best = F.array_min(F.filter(near, lambda x: x["d"] <= threshold))
        placed = cut_lineage(rest.withColumn("centres", chosen.scalar()).withColumn("centre", best["no"] + known).drop("centres"))
        hit = placed.where("centre IS NOT NULL").select(*keys, "centre")
        if hit.isEmpty():
            empty += 1
            continue
        empty = 0
        known += len(centres)
        done = hit if done is None else done.union(hit)
        rest = placed.where("centre IS NULL").drop("centre")
    left = rest.select(*keys, F.lit(None).cast("int").alias("centre"))
    return left if done is None else done.union(left)
