"""Near-duplicate documents by chosen-path set similarity join.

Every document's shingle set is reduced to a fixed number of minwise tokens. A tree
branches on chosen token positions: a node holds the documents that agree on all tokens
of its path. Small nodes are compared exhaustively, larger ones branch further, and
independent trees are repeated until a pair at the threshold is met almost surely.
All candidates are confirmed on the full shingle sets.
"""

from __future__ import annotations

import random
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logquarry.llm.common import Scratch, arrow_batches, components, raw_texts, raw_words, shingle_set


@dataclass(frozen=True)
class Settings:
    """``trees`` sets the recall: a pair at similarity 0.8 survives five branchings of one tree
    with probability 0.53; simulated, 14 trees miss it five times in 100,000 (26 of 500,000),
    and the ``deep_trees`` after nine branchings once (5 of 500,000). Nodes are
    looked at after the first number of branchings in ``depths``; the members of a large node
    are tried with one of them. Members of large nodes that stay unconnected go through
    ``deep_trees`` trees of their own, so many that the second number of branchings misses no
    more; groups that agree there are compared in full, ``block`` by ``block`` members."""

    width: int = 5
    percent: int = 80
    tokens: int = 128
    trees: int = 14
    deep_trees: int = 44
    depths: tuple[int, int] = (5, 9)
    node_limit: int = 10
    block: int = 256
    seed: int = 7


def branches(s: Settings) -> list[list[tuple[int, int, int]]]:
    """Per depth (path, parent path, token position). A path has 100/percent children on average."""
    rng = random.Random(s.seed)
    levels: list[list[tuple[int, int, int]]] = []
    used: dict[int, tuple[int, ...]] = {-1 - t: () for t in range(s.trees)}
    number = 0
    for _ in range(max(s.depths)):
        level, after = [], {}
        for parent, taken in used.items():
            wanted = 100 / s.percent
            n = int(wanted) + (rng.random() < wanted - int(wanted))
            free = [c for c in range(s.tokens) if c not in taken]
            for c in rng.sample(free, min(n, len(free))):
                level.append((number, parent, c))
                after[number] = (*taken, c)
                number += 1
        levels.append(level)
        used = after
    return levels


def deep_branches(s: Settings) -> list[list[tuple[int, int, int]]]:
    """Branches of the trees for what stays unconnected in large nodes."""
    return branches(replace(s, trees=s.deep_trees, seed=s.seed + 1))[: s.depths[1]]


def minwise(shingles: np.ndarray, mult: np.ndarray, add: np.ndarray) -> np.ndarray:
    """The least hash under each of the given multiply-add functions, high 32 bits."""
    least = np.full(len(mult), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 2048):
        part = shingles[None, at : at + 2048] * mult[:, None]
        part += add[:, None]
        np.minimum(least, part.min(axis=1), out=least)
    return (least >> np.uint64(32)).astype(np.uint32).view(np.int32)


def sketches(docs: DataFrame, s: Settings) -> DataFrame:
    """Rows (doc_id, n_shingles, d1, d2, sketch): set size, 128-bit digest of the set, minwise tokens."""
    rng = np.random.default_rng(s.seed)
    mult = rng.integers(0, 2**63, s.tokens, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    add = rng.integers(0, 2**63, s.tokens, dtype=np.uint64)
    width = s.width
    schema = pa.schema(
        [("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()), ("sketch", pa.list_(pa.int32()))]
    )

    def sketch(batch: pa.RecordBatch) -> dict:
        out: dict = {"doc_id": batch.column("doc_id"), "n_shingles": [], "d1": [], "d2": [], "sketch": []}
        for text in raw_texts(batch.column("text")):
            found = shingle_set(raw_words(text), width)
            out["n_shingles"].append(len(found))
            d1, d2 = np.frombuffer(xxhash.xxh3_128_digest(found.tobytes()), np.int64).tolist() if len(found) else (None, None)
            out["d1"].append(d1)
            out["d2"].append(d2)
            out["sketch"].append(minwise(found, mult, add) if len(found) else None)
        return out

    return docs.select("doc_id", "text").mapInArrow(
        arrow_batches(sketch, schema), "doc_id long, n_shingles long, d1 long, d2 long, sketch array<int>"
    )


def _first_nodes(reps: DataFrame, depth: int, levels: list) -> DataFrame:
    """Nodes at the first depth that is looked at."""
    coords: dict[int, tuple[int, ...]] = {}
    for level in levels[:depth]:
        coords |= {p: (*coords.get(parent, ()), c) for p, parent, c in level}
    keys = [F.xxhash64(F.lit(p), *[F.col("sketch")[c] for c in coords[p]]) for p, _, _ in levels[depth - 1]]
    return reps.select(F.explode(F.array(*keys)).alias("key"), "rep")


def _deep_nodes(members: DataFrame, reps: DataFrame, s: Settings) -> DataFrame:
    """Nodes of the given documents in the deep trees, after the second number of branchings."""
    coords: dict[int, tuple[int, ...]] = {}
    levels = deep_branches(s)
    for level in levels:
        coords |= {p: (*coords.get(parent, ()), c) for p, parent, c in level}
    paths = F.array(*[F.struct(F.lit(p).alias("path"), F.array(*map(F.lit, coords[p])).alias("at")) for p, _, _ in levels[-1]])
    tokens = F.transform("x.at", lambda c: F.get("sketch", c))
    return (
        reps.join(members, "rep")
        .select("rep", "sketch", F.explode(paths).alias("x"))
        .select(F.xxhash64("x.path", tokens).alias("key"), "rep")
    )


def _sized(nodes: DataFrame, comps: DataFrame | None) -> DataFrame:
    """Members of nodes that can still give a link: key, rep, n (the node's size) and pivot, one of its members.

    A key holds its path. Without ``comps`` every document is a component of its own, and nodes
    have a pivot each by their key; with them there is a column ``comp``, and the pivot is the least
    member, which nodes that overlap mostly share.
    """
    node = Window.partitionBy("key")  # the members are dealt by their key once, for size and pivot alike
    if comps is None:
        pivot = F.min(F.struct(F.xxhash64("rep", "key").alias("order"), F.col("rep").alias("member"))).over(node)["member"]
        return nodes.select("key", "rep", F.count("*").over(node).alias("n"), pivot.alias("pivot")).where("n > 1")
    comp = F.coalesce("root", "rep").alias("comp")
    nodes = nodes.join(comps.select(F.col("node").alias("rep"), "root"), "rep", "left").select("rep", "key", comp)
    sizes = [F.count("*").over(node).alias("n"), F.min("rep").over(node).alias("pivot"), F.min("comp").over(node).alias("c0"), F.max("comp").over(node).alias("c1")]
    return nodes.select("*", *sizes).where("n > 1 and c0 <> c1").drop("c0", "c1")


def _node_edges(nodes: DataFrame) -> DataFrame:
    """Edges (a, b) that connect what nodes (rep, pivot) connect: one from each document to the least of its
    pivots, and those between a document's pivots, which are few as nodes share them."""
    least = nodes.groupBy("rep").agg(F.min("pivot").alias("a"), F.collect_set("pivot").alias("all"))
    own = least.select("a", F.col("rep").alias("b"))
    between = least.select("a", F.explode("all").alias("b")).distinct()
    return own.union(between).where("a <> b").distinct()


def _small_pairs(sized: DataFrame, limit: int) -> DataFrame:
    """All pairs in nodes of at most ``limit`` members."""
    members = sized.where(F.col("n") <= limit).groupBy("key").agg(F.collect_list("rep").alias("m"))
    return (
        members.select(F.explode("m").alias("x"), "m")
        .select("x", F.explode("m").alias("y"))
        .where("x < y")
        .select(F.col("x").alias("a"), F.col("y").alias("b"))
    )


def _block_links(groups: DataFrame, docs: DataFrame, s: Settings) -> DataFrame:
    """Links across components inside ``groups`` (rep, group, comp): every pair is compared in full.

    Members are dealt to blocks, and each two blocks of a group meet in one task. What comes
    back connects what the links connect: an edge from each linked document to the least of
    its cell that it reaches.
    """
    sizes = groups.groupBy("group").agg(F.ceil(F.count("*") / s.block).cast("int").alias("k"))
    mine = F.pmod(F.xxhash64("rep"), F.col("k")).cast("int")
    cells = F.transform(F.sequence(F.lit(0), F.col("k") - 1), lambda j: F.struct(F.least("mine", j).alias("i"), F.greatest("mine", j).alias("j")))
    spread = (
        groups.join(sizes, "group")
        .withColumn("mine", mine)
        .join(docs.select(F.col("doc_id").alias("rep"), "text").dropDuplicates(["rep"]), "rep")
        .select("group", "rep", "comp", "text", "mine", F.explode(cells).alias("cell"))
        .select("group", "rep", "comp", "text", "mine", "cell.i", "cell.j")
    )
    width, percent = s.width, s.percent

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("rep")
        sets = [shingle_set(raw_words(t.encode()), width) for t in rows["text"]]
        comp, mine = rows["comp"].to_numpy(), rows["mine"].to_numpy()
        linked = _common(sets)
        size = np.array([len(x) for x in sets])
        linked = 100 * linked >= percent * (size[:, None] + size[None, :] - linked)
        linked &= comp[:, None] != comp[None, :]
        if rows["i"].iloc[0] != rows["j"].iloc[0]:
            linked &= mine[:, None] != mine[None, :]
        least = np.arange(len(sets))
        x, y = np.nonzero(linked)
        while True:
            before = least.copy()
            np.minimum.at(least, x, before[y])
            least = least[least]
            if (least == before).all():
                break
        ids = rows["rep"].to_numpy()
        far = least != np.arange(len(sets))
        return pd.DataFrame({"a": ids[least[far]], "b": ids[far]}, dtype="int64")

    return spread.groupBy("group", "i", "j").applyInPandas(compare, "a long, b long")


def _common(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections, by products of slices of the incidence matrix."""
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    value, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times[column] > 1
    owner, column = owner[shared], (np.cumsum(times > 1) - 1)[column[shared]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    out = np.zeros((len(sets), len(sets)))
    for at in range(0, int((times > 1).sum()), 4096):
        lo, hi = np.searchsorted(column, [at, at + 4096])
        part = np.zeros((len(sets), 4096), np.float32)
        part[owner[lo:hi], column[lo:hi] - at] = 1
        out += part @ part.T
    return out.astype(np.int64)


def _least_agreeing(s: Settings) -> int:
    """Agreeing tokens that a linked pair has: five standard deviations below the mean."""
    p = s.percent / 100
    return max(1, int(s.tokens * p - 5 * (s.tokens * p * (1 - p)) ** 0.5))


def _tokens_moved() -> Column:
    """The low bits of the tokens; the high ones of least hashes are mostly zeros."""
    return F.transform("sketch", lambda x: F.shiftright(F.shiftleft(x, 16), 16).cast("short"))


def _likely(pairs: DataFrame, reps: DataFrame, s: Settings) -> DataFrame:
    """Distinct pairs whose tokens agree often enough. Half of their bits are compared: that moves half as much and loses no pair."""
    side = lambda c: reps.select(F.col("rep").alias(c), _tokens_moved().alias(f"s{c}"))
    agreeing = F.size(F.filter(F.zip_with("sa", "sb", lambda x, y: x == y), lambda x: x))
    return pairs.distinct().join(side("b"), "b").join(side("a"), "a").where(agreeing >= _least_agreeing(s)).select("a", "b")


def _exact(pairs: DataFrame, texts: DataFrame, s: Settings) -> DataFrame:
    """The pairs that hold on the full shingle sets."""
    width, percent = s.width, s.percent
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def confirm(batches):
        kept: tuple[bytes, np.ndarray] = (b"", np.empty(0, np.uint64))
        for batch in batches:
            a, b = [], []
            for x, y, tx, ty in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), raw_texts(batch.column("ta")), raw_texts(batch.column("tb")), strict=True):
                if kept[0] != tx:
                    kept = (tx, shingle_set(raw_words(tx), width))
                other = shingle_set(raw_words(ty), width)
                common = len(np.intersect1d(kept[1], other, assume_unique=True))
                if 100 * common >= percent * (len(kept[1]) + len(other) - common):
                    a.append(x)
                    b.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=schema)

    side = lambda c: texts.select(F.col("doc_id").alias(c), F.col("text").alias(f"t{c}"))
    return pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "ta", "tb").mapInArrow(confirm, "a long, b long")


def _across(pairs: DataFrame, comps: DataFrame) -> DataFrame:
    """Pairs whose ends are not yet known to be connected."""
    root = lambda c: comps.select(F.col("node").alias(c), F.col("root").alias(f"r{c}"))
    joined = pairs.join(root("b"), "b", "left").join(root("a"), "a", "left")
    return joined.where(F.coalesce("ra", "a") != F.coalesce("rb", "b")).select("a", "b")


def _confirmed(scratch: Scratch, docs: DataFrame, reps: DataFrame, pairs: DataFrame, s: Settings) -> DataFrame:
    """Components (node, root) of the links among the candidate pairs.

    One partner of each document is tried first; of the other pairs only those between
    documents that are not connected by then are needed.
    """
    likely = scratch.save(_likely(pairs, reps, s))
    scratch.sweep()
    ids = likely.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    texts = scratch.save(docs.select("doc_id", "text").join(ids, "doc_id"))
    scratch.sweep()
    first = _exact(likely.groupBy("b").agg(F.min("a").alias("a")), texts, s)
    known = scratch.save(components(scratch, first))
    scratch.sweep()
    rest = _exact(_across(likely, known), texts, s)
    comps = scratch.save(components(scratch, known.select(F.col("root").alias("a"), F.col("node").alias("b")).union(rest)))
    scratch.drop(likely, texts, known)
    scratch.sweep()
    return comps


def near_duplicates(docs: DataFrame, settings: Settings | None = None) -> DataFrame:
    """Groups of near-duplicates of ``docs`` (doc_id unique, text; other columns are ignored).

    Returns doc_id, n_shingles, component_id (least doc_id reachable over links), kept
    (doc_id = component_id). Two documents are linked if 100 * common >= percent * union
    of their shingle sets. A text with fewer words than ``width`` is one shingle; null,
    empty and blank texts have none and are alone. Equal sets are one class from the start,
    so copies cost nothing further. A repeated doc_id is taken as copies of one document.
    """
    s = settings or Settings()
    scratch = Scratch(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    base = scratch.save(sketches(docs, s))
    reps = scratch.save(
        base.where("n_shingles > 0").groupBy("d1", "d2").agg(F.min("doc_id").alias("rep"), F.any_value("sketch").alias("sketch"))
    )
    sketched, base = base, scratch.save(base.drop("sketch"))
    scratch.drop(sketched)
    scratch.sweep()
    levels = branches(s)
    first = s.depths[0]
    sized = scratch.save(_sized(_first_nodes(reps, first, levels), None))
    scratch.sweep()
    large = sized.where(F.col("n") > s.node_limit)
    star = large.where("rep <> pivot").select(F.least("pivot", "rep").alias("a"), F.greatest("pivot", "rep").alias("b"))
    comps = _confirmed(scratch, docs, reps, _small_pairs(sized, s.node_limit).union(star), s)
    crowded = _sized(large.select("key", "rep"), comps).select("rep").distinct()
    open_nodes = scratch.save(_sized(_deep_nodes(crowded, reps, s), comps))
    scratch.sweep()
    if not open_nodes.isEmpty():
        members = open_nodes.select("rep", "comp").distinct()
        groups = components(scratch, _node_edges(open_nodes))
        grouped = scratch.save(members.join(groups.select(F.col("node").alias("rep"), F.col("root").alias("group")), "rep"))
        links = _block_links(grouped, docs, s)
        known = comps.select(F.col("root").alias("a"), F.col("node").alias("b"))
        comps = scratch.save(components(scratch, known.union(links)))
    scratch.drop(sized, open_nodes)
    scratch.sweep()
    classes = reps.select("d1", "d2", "rep")
    of_class = classes.join(comps.withColumnRenamed("node", "rep"), "rep", "left").select("d1", "d2", F.coalesce("root", "rep").alias("component"))
    component = F.coalesce("component", "doc_id")
    return base.join(of_class, ["d1", "d2"], "left").select(
        "doc_id", "n_shingles", component.alias("component_id"), (component == F.col("doc_id")).alias("kept")
    )


def keep_one(docs: DataFrame, settings: Settings | None = None) -> DataFrame:
    """``docs`` without all but the least document of each near-duplicate group."""
    dropped = near_duplicates(docs, settings).where("not kept").select("doc_id")
    return docs.join(dropped, "doc_id", "left_anti")
