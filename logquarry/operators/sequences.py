"""Event sequences: windows, vectors, samples, clusters and distances."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from logquarry.session import cut_lineage

PAD = "-1"


def event_windows(events: DataFrame, order: str, event: str, h: int = 50) -> DataFrame:
    """``(chunk_id, seq_no, events)``: runs of ``h`` events of a chunk, the last one padded.

    Row numbers are per chunk, so the window is bounded.
    """
    w = W.partitionBy("chunk_id").orderBy(order)
    numbered = events.select("chunk_id", F.col(event).cast("string").alias("e"), F.row_number().over(w).alias("rn"))
    seq = F.floor((F.col("rn") - 1) / h)
    items = F.transform(F.array_sort(F.collect_list(F.struct("rn", "e"))), lambda x: x["e"])
    return (
        numbered.groupBy("chunk_id", seq.alias("seq_no"))
        .agg(items.alias("events"))
        .withColumn("events", F.concat("events", F.array_repeat(F.lit(PAD), F.lit(h) - F.size("events"))))
    )


def event_weights(seqs: DataFrame, n_events: int | None = None) -> DataFrame:
    """``(event, weight)``: logistic of the centred log ratio of sequences to sequences with the event."""
    present = seqs.select(F.explode(F.array_distinct("events")).alias("event")).filter(F.col("event") != PAD)
    df_ = present.groupBy("event").agg(F.count(F.lit(1)).alias("df"))
    total = seqs.agg(F.count(F.lit(1))).scalar()
    idf = df_.withColumn("idf", F.log((total + 1) / (F.col("df") + 1))).withColumn("unseen", F.log(total + 1))
    if n_events is None:
        mean = F.avg("idf")
    else:
        # events never seen count with the largest ratio
        mean = (F.sum("idf") + (n_events - F.count(F.lit(1))) * F.max("unseen")) / n_events
    centre = idf.agg(mean).scalar()
    return idf.select("event", (1 / (1 + F.exp(-(F.col("idf") - centre)))).alias("weight"))


def event_vectors(seqs: DataFrame, n_events: int | None = None) -> DataFrame:
    """``(chunk_id, seq_no, event, weight)``: weighted counts, only where not zero."""
    counts = (
        seqs.select("chunk_id", "seq_no", F.explode("events").alias("event"))
        .filter(F.col("event") != PAD)
        .groupBy("chunk_id", "seq_no", "event")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return counts.join(event_weights(seqs, n_events), "event").select(
        "chunk_id", "seq_no", "event", (F.col("n") * F.col("weight")).alias("weight")
    )


def dense_vectors(vectors: DataFrame, names: Sequence[str]) -> DataFrame:
    """``(chunk_id, seq_no, vec)`` with one place per event name."""
    maps = vectors.groupBy("chunk_id", "seq_no").agg(
        F.map_from_entries(F.collect_list(F.struct("event", "weight"))).alias("m")
    )
    vec = F.array(*[F.coalesce(F.try_element_at("m", F.lit(n)), F.lit(0.0)) for n in names])
    return maps.select("chunk_id", "seq_no", vec.alias("vec"))


# --- samples: a seeded hash of the key gives the order, so a sample repeats


def draw(seed: int, *keys: str) -> Column:
    """A number from 0 to 1 for each key: the first eight hex digits of md5 of seed and key."""
    text = F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def block_sample(lines: DataFrame, rate: float, seed: int = 0, block: int = 20) -> DataFrame:
    """Lines of blocks of consecutive lines, each block drawn with probability ``rate``."""
    blocked = lines.withColumn("block", F.floor(F.col("line_no") / block))
    return blocked.filter(draw(seed, "chunk_id", "block") < rate).drop("block")


def random_sample(df: DataFrame, keys: Sequence[str], rate: float, seed: int = 0) -> DataFrame:
    """Rows drawn with probability ``rate`` each."""
    return df.filter(draw(seed, *keys) < rate)


def fixed_sample(df: DataFrame, keys: Sequence[str], m: int, seed: int = 0) -> DataFrame:
    return df.orderBy(draw(seed, *keys), *keys).limit(m)


def balanced_sample(df: DataFrame, cluster: str, keys: Sequence[str], n: int, seed: int = 0) -> DataFrame:
    """``ceil(n / clusters)`` seeded draws per cluster, with replacement where it is small.

    Every row hashes to one draw, and a draw keeps its row of least hash, so the data
    is read once and no cluster is gathered. A draw that no row hashed to takes the
    row of another draw of its cluster.
    """
    clusters = df.select(cluster).distinct()
    each = -(-n // max(clusters.count(), 1))
    key = F.struct(*keys)
    picks = (
        df.select(
            cluster,
            key.alias("key"),
            F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(each)).alias("slot"),
            F.xxhash64(F.lit(seed + 1), *keys).alias("h"),
        )
        .groupBy(cluster, "slot")
        .agg(F.min_by("key", F.struct("h", "key")).alias("key"))
    )
    # at most `each` rows per cluster
    per_cluster = picks.groupBy(cluster).agg(
        F.array_sort(F.collect_list(F.struct("slot", "key"))).alias("p")
    )
    chosen = F.transform(
        F.sequence(F.lit(0), F.lit(each - 1)),
        lambda d: F.coalesce(
            F.get(F.filter("p", lambda x: x["slot"] == d), F.lit(0)),
            F.get(F.col("p"), F.pmod(F.xxhash64(F.lit(seed + 2), d), F.size("p")).cast("int")),
        )["key"],
    )
    return per_cluster.select(cluster, F.posexplode(chosen).alias("draw", "key")).select(
        cluster, "draw", "key.*"
    )


Distance = Callable[[Column, Column], Column]


def _spread(df: DataFrame, text: str, distance: Distance, most: int, far: float | None, seed: int) -> tuple[DataFrame, DataFrame]:
    """Farthest-point selection over all distinct texts: the picks, and every text with its nearest pick.

    A round is one pass: each text keeps the distance to its nearest pick, and the one
    farthest away is next, of equals the one with the largest draw. Ends after ``most``
    picks or when no text is further than ``far`` from all picks.
    """
    spark = df.sparkSession
    pool = cut_lineage(
        df.select(F.col(text).alias("text")).where(F.col(text).isNotNull()).distinct().withColumn("draw", draw(seed, "text"))
        .withColumn("near", F.lit(float("inf"))).withColumn("pick", F.lit(None).cast("int"))
    )
    picks: list[tuple[int, str]] = []
    while len(picks) < most:
        row = pool.agg(F.max(F.struct("near", "draw", "text")).alias("m")).first()["m"]
        if row is None or row["near"] == 0 or (picks and far is not None and row["near"] <= far):
            break
        k = len(picks)
        picks.append((k, row["text"]))
        d = distance(F.col("text"), F.lit(row["text"])).cast("double")
        moved = pool.withColumn("d", d)
        pool = moved.select(
            "text",
            "draw",
            F.least("near", "d").alias("near"),
            F.when(F.col("d") < F.col("near"), F.lit(k)).otherwise(F.col("pick")).alias("pick"),
        )
        if k % 8 == 7:
            pool = cut_lineage(pool)
    return spark.createDataFrame(picks, "round int, text string"), pool


def diverse_sample(df: DataFrame, text: str, k: int, distance: Distance, seed: int = 0) -> DataFrame:
    """``(round, text)``: ``k`` texts, each the one farthest from those picked before it."""
    return _spread(df, text, distance, k, None, seed)[0]


def pattern_sample(
    df: DataFrame, text: str, distance: Distance, patterns: int, near: float = 0.2, far: float = 0.6, per_pattern: int = 3, seed: int = 0
) -> DataFrame:
    """``(pattern, text)``: centres that are further than ``far`` from each other, with texts nearer than ``near``.

    A pattern has at most ``per_pattern`` texts beside its centre: texts hash to that many
    places, and a place keeps the least draw, so no pattern is gathered.
    """
    centres, pool = _spread(df, text, distance, patterns, far, seed)
    close = pool.filter((F.col("near") < near) & (F.col("near") > 0))
    place = F.pmod(F.xxhash64(F.lit(seed), "text"), F.lit(per_pattern))
    members = close.groupBy("pick", place.alias("place")).agg(F.min_by("text", F.struct("draw", "text")).alias("text"))
    return centres.select(F.col("round").alias("pattern"), "text").union(members.select("pick", "text"))


# --- clusters


def complete_linkage(points: np.ndarray, threshold: float) -> list[list[int]]:
    """Clusters of a small sample: the two nearest clusters merge while the farthest pair of
    their members is within ``threshold``."""
    groups = [[i] for i in range(len(points))]
    far = np.sqrt(((points[:, None, :] - points[None, :, :]) ** 2).sum(axis=2))
    np.fill_diagonal(far, np.inf)
    while len(groups) > 1:
        i, j = np.unravel_index(np.argmin(far), far.shape)
        if far[i, j] > threshold:
            break
        i, j = min(i, j), max(i, j)
        groups[i] += groups.pop(j)
        row = np.maximum(far[i], far[j])
        row[i] = np.inf
        far[i], far[:, i] = row, row
        far = np.delete(np.delete(far, j, 0), j, 1)
    return groups


def assign_nearest(vectors: DataFrame, centres: np.ndarray, threshold: float, vec: str = "vec") -> DataFrame:
    """Adds ``centre``: the nearest one closer than ``threshold``, else null.

    The centres come from a bounded sample, so they travel with the task.
    """
    c = np.asarray(centres, dtype=float)

    @F.pandas_udf("int")
    def nearest(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            v = np.stack(batch.to_numpy()).astype(float)
            d = np.sqrt(np.maximum(((v[:, None, :] - c[None, :, :]) ** 2).sum(axis=2), 0))
            k = d.argmin(axis=1)
            yield pd.Series(np.where(d[np.arange(len(v)), k] < threshold, k, -1)).astype("int32")

    found = nearest(F.col(vec))
    return vectors.withColumn("found", found).withColumn(
        "centre", F.when(F.col("found") >= 0, F.col("found"))
    ).drop("found")


def iterative_clusters(
    vectors: DataFrame,
    keys: Sequence[str],
    sample_size: int,
    threshold: float = 0.6,
    min_members: int = 3,
    max_empty_rounds: int = 3,
    seed: int = 0,
) -> tuple[DataFrame, np.ndarray]:
    """Clusters of all vectors: sample, cluster the sample, assign by its centres, repeat on the rest.

    Returns the vectors with ``centre`` (null for the ones left over) and the centres.
    A round draws about ``sample_size`` of the vectors that are left; their number bounds
    what one round clusters on the driver. What is assigned and what is left is written
    to the checkpoint folder each round.
    """
    rest = cut_lineage(vectors)
    done: DataFrame | None = None
    centres: list[np.ndarray] = []
    empty, round_no = 0, 0
    while empty < max_empty_rounds:
        left_over = rest.count()
        if left_over < 2:
            break
        sample = random_sample(rest, keys, sample_size / left_over, seed + round_no).collect()
        round_no += 1
        if not sample:
            empty += 1
            continue
        points = np.array([r["vec"] for r in sample], dtype=float)
        means = [points[g].mean(axis=0) for g in complete_linkage(points, threshold) if len(g) >= min_members]
        if not means:
            empty += 1
            continue
        placed = cut_lineage(assign_nearest(rest, np.array(means), threshold))
        hit = placed.filter("centre is not null").withColumn("centre", F.col("centre") + len(centres))
        if hit.isEmpty():
            empty += 1
            continue
        empty = 0
        centres += means
        done = hit if done is None else done.unionByName(hit)
        rest = placed.filter("centre is null").drop("centre")
    left = rest.withColumn("centre", F.lit(None).cast("int"))
    return (left if done is None else done.unionByName(left)), np.array(centres)


def _aligned(a: Sequence[str], b: Sequence[str]) -> list[tuple[int, int]]:
    """Places of a longest common subsequence: the longest chain of equal pairs that rises on both sides."""
    places: dict[str, list[int]] = {}
    for j, item in enumerate(b):
        places.setdefault(item, []).append(j)
    ends: list[int] = []  # least end of a chain of each length
    chains: list[tuple] = []
    for i, item in enumerate(a):
        for j in reversed(places.get(item, [])):
            k = bisect_left(ends, j)
            link = ((i, j), chains[k - 1] if k else None)
            if k == len(ends):
                ends.append(j)
                chains.append(link)
            else:
                ends[k], chains[k] = j, link
    out = []
    link = chains[-1] if chains else None
    while link:
        out.append(link[0])
        link = link[1]
    return out[::-1]


def common_pattern(sequences: Sequence[Sequence[str]]) -> list[list[str]]:
    """Runs that all sequences hold in the same order; items of a run are neighbours in every sequence."""
    items = list(sequences[0])
    joined = [False] + [True] * (len(items) - 1)
    for seq in sequences[1:]:
        pairs = _aligned(items, seq)
        kept = [False] + [
            p[0] == q[0] + 1 and p[1] == q[1] + 1 and joined[p[0]] for q, p in zip(pairs, pairs[1:], strict=False)
        ]
        items, joined = [items[i] for i, _ in pairs], kept[: len(pairs)]
    runs: list[list[str]] = []
    for item, together in zip(items, joined, strict=False):
        if together:
            runs[-1].append(item)
        else:
            runs.append([item])
    return runs


def mined_patterns(seqs: DataFrame, cluster: str, keys: Sequence[str], per_cluster: int = 16, seed: int = 0) -> DataFrame:
    """``(cluster, pattern)``: what a bounded seeded sample of every cluster's sequences has in common.

    A sampled sequence is one of the least draws of its cluster, found by a partial
    aggregation over ``per_cluster`` places.
    """
    place = F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(per_cluster))
    sample = seqs.groupBy(F.col(cluster).alias("cluster"), place.alias("place")).agg(
        F.min_by("events", F.struct(draw(seed, *keys), *keys)).alias("events")
    )

    def mine(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        found = common_pattern([[e for e in seq if e != PAD] for seq in rows.sort_values("place")["events"]])
        return pd.DataFrame({"cluster": [key[0]], "pattern": [found]})

    kind = seqs.schema[cluster].dataType.simpleString()
    return sample.groupBy("cluster").applyInPandas(mine, f"cluster {kind}, pattern array<array<string>>")


def match_patterns(seqs: DataFrame, patterns: Sequence[Sequence[Sequence[str]]]) -> DataFrame:
    """Adds ``pattern``: the first pattern whose sub-lists occur in the sequence in order."""
    import re

    text = F.concat(F.array_join("events", ";"), F.lit(";"))
    found = F.lit(None).cast("int")
    for i in reversed(range(len(patterns))):
        body = "".join(
            "(?:[^;]*;)*?" + "".join(re.escape(e) + ";" for e in run) for run in patterns[i]
        )
        found = F.when(text.rlike("^" + body), i).otherwise(found)
    return seqs.withColumn("pattern", found)


# --- distances between two word arrays or vectors


def _gram(x: Column, y: Column) -> Column:
    """Two texts as one that no other two give; either may be null."""
    odd = F.when(x.isNull() & y.isNull(), "nn").when(x.isNull(), F.concat(F.lit("ny"), y)).otherwise(F.concat(F.lit("nx"), x))
    return F.coalesce(F.concat(F.length(x).cast("string"), F.lit(":"), x, y), odd)


def ngrams(words: Column, n: int) -> Column:
    """Distinct n-grams of an array of texts: a word alone, or the lengths and words of a run as one text.

    Texts are compared by hash; arrays of words would be compared pair by pair.
    """
    out = words
    for k in range(1, n):
        # the shorter of the two runs to its end, so nothing is looked up once for every n-gram
        shifted = F.slice(words, F.lit(k + 1), F.greatest(F.size(words) - k, F.lit(0)))
        out = F.zip_with(F.slice(out, F.lit(1), F.greatest(F.size(words) - k, F.lit(0))), shifted, _gram)
    return F.when(F.size(words) < n, F.slice(words, F.lit(1), F.lit(0))).otherwise(F.array_distinct(out))


def ngram_distance(a: Column, b: Column, n: int) -> Column:
    """Symmetric difference over the sum of sizes; null if there is no n-gram at all."""

    def share(g: Column) -> Column:
        both = F.size(F.array_intersect(g["a"], g["b"]))
        total = F.size(g["a"]) + F.size(g["b"])
        return F.when(total > 0, (total - 2 * both) / total)

    # the pair as the one element of an array, so that its n-grams are made once
    return F.get(F.transform(F.array(F.struct(ngrams(a, n).alias("a"), ngrams(b, n).alias("b"))), share), F.lit(0))


def ngram_similarity(a: Column, b: Column, n: int) -> Column:
    return 1 - ngram_distance(a, b, n)


def edit_distance(a: Column, b: Column) -> Column:
    return F.levenshtein(a, b)


def normalized_edit_distance(a: Column, b: Column) -> Column:
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 0.0).otherwise(F.levenshtein(a, b) / longest)


def jaccard_distance(a: Column, b: Column) -> Column:
    """One minus shared over all distinct words."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 0.0).otherwise(1 - F.size(F.array_intersect(a, b)) / union)


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def euclidean_per_length(a: Column, b: Column) -> Column:
    return F.sqrt(_sum(F.zip_with(a, b, lambda x, y: ((x - y) * (x - y)).cast("double")))) / F.size(a)


def cosine_distance(a: Column, b: Column) -> Column:
    dot = _sum(F.zip_with(a, b, lambda x, y: (x * y).cast("double")))
    norm = lambda v: F.sqrt(_sum(F.transform(v, lambda x: (x * x).cast("double"))))
    return 1 - dot / (norm(a) * norm(b))


def lcs_length(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence of two word arrays, one array row at a time."""

    def row(previous: Column, x: Column) -> Column:
        # previous[j]: best length for the words so far against the first j words of b
        return F.aggregate(
            F.sequence(F.lit(1), F.size(b)),
            F.array(F.lit(0)),
            lambda now, j: F.array_append(
                now,
                F.when(F.element_at(b, j) == x, F.element_at(previous, j) + 1).otherwise(
                    F.greatest(F.element_at(previous, j + 1), F.element_at(now, -1))
                ),
            ),
        )

    start = F.array_repeat(F.lit(0), F.size(b) + 1)
    none = (F.size(a) == 0) | (F.size(b) == 0)
    return F.when(none, 0).otherwise(F.element_at(F.aggregate(a, start, row), -1))


def lcs_distance(a: Column, b: Column) -> Column:
    return 1 - lcs_length(a, b) / F.size(a)


def mixed_distance(words_a: Column, words_b: Column, vec_a: Column, vec_b: Column) -> Column:
    return (lcs_distance(words_a, words_b) + euclidean_per_length(vec_a, vec_b)) / 2


DISTANCES: dict[str, Callable[[Column, Column], Column]] = {
    "ngram_1": lambda a, b: ngram_distance(a, b, 1),
    "ngram_2": lambda a, b: ngram_distance(a, b, 2),
    "ngram_3": lambda a, b: ngram_distance(a, b, 3),
    "jaccard": jaccard_distance,
    "lcs": lcs_distance,
}


def pair_distance(df: DataFrame, a: str, b: str, name: str) -> DataFrame:
    """Adds ``distance`` by the named function."""
    return df.withColumn("distance", DISTANCES[name](F.col(a), F.col(b)))
