import random

import numpy as np
import pytest

from logquarry.llm import neardup as N
from logquarry.llm.common import Scratch, components, raw_words, shingle_set


def brute(texts, width, percent):
    sets = {i: set(shingle_set(raw_words((t or "").encode()), width).tolist()) for i, t in texts.items()}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            c = len(sets[i] & sets[j])
            if c and 100 * c >= percent * (len(sets[i]) + len(sets[j]) - c):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in ids}


def groups(seed, n_groups=12, size=14, words=60, edits=8):
    """Groups of edited copies; some pairs of a group are linked and some are not."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefghij", k=5))
    texts, doc = {}, 0
    for _ in range(n_groups):
        base = [word() for _ in range(words)]
        for _ in range(size):
            copy = list(base)
            for _ in range(rng.randint(0, edits)):
                copy[rng.randrange(words)] = word()
            texts[doc] = " ".join(copy)
            doc += 1
    return texts


@pytest.mark.parametrize("settings", [N.Settings(width=2), N.Settings(width=2, node_limit=2, depths=(2, 4), block=5)])
def test_against_brute_force(spark, settings):
    texts = groups(3)
    texts |= {1000: None, 1001: "", 1002: "alone", 1003: "Alone", 1004: "two words"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in N.near_duplicates(docs, settings).collect()}
    assert got == brute(texts, 2, 80)


def test_large_group(spark):
    texts = groups(5, n_groups=1, size=300, words=50, edits=9)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    s = N.Settings(width=2, block=64)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in N.near_duplicates(docs, s).collect()}
    assert got == brute(texts, 2, 80)


def test_odd_rows(odd, none):
    got = {r["doc_id"]: r for r in N.near_duplicates(odd).collect()}
    assert len(got) == odd.count()
    assert got[103]["component_id"] == got[104]["component_id"] == 103
    assert got[100]["kept"] and got[101]["kept"] and got[102]["n_shingles"] == 0
    assert N.near_duplicates(none).count() == 0
    kept = N.keep_one(odd)
    assert kept.columns == odd.columns and kept.count() == odd.count() - 1


def test_survival():
    """Pairs at the threshold meet in at least one tree, almost always."""
    s = N.Settings()
    levels = N.branches(s)[: s.depths[0]]
    rng = np.random.default_rng(0)
    missed = 0
    for _ in range(2000):
        same = rng.random(s.tokens) < s.percent / 100
        alive = {-1 - t for t in range(s.trees)}
        for level in levels:
            alive = {p for p, parent, c in level if parent in alive and same[c]}
        missed += not alive
    assert missed <= 2


def test_survival_in_large_nodes():
    """Where all nodes of a pair are large, the second depth misses no more than the first."""
    s = N.Settings()
    levels = N.deep_branches(s)
    assert len(levels) == s.depths[1]
    rng = np.random.default_rng(0)
    n = 20_000
    same = rng.random((s.tokens, n)) < s.percent / 100
    alive = {-1 - t: np.ones(n, bool) for t in range(s.deep_trees)}
    for level in levels:
        alive = {p: alive[parent] & same[c] for p, parent, c in level}
    missed = n - int(np.logical_or.reduce(list(alive.values())).sum())
    assert missed <= 3, missed


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 200), (200, 300), (7, 7)]
    got = dict(components(Scratch(spark), spark.createDataFrame(chain, "a long, b long")).collect())
    assert got == {i: 0 for i in range(41)} | {100: 100, 200: 100, 300: 100}
    assert components(Scratch(spark), spark.createDataFrame([], "a long, b long")).count() == 0


def test_node_edges_connect_what_nodes_connect(spark):
    rng = random.Random(8)
    rows = [(rng.randrange(40), rng.randrange(12) * 3) for _ in range(60)]
    got = [(r["a"], r["b"]) for r in N._node_edges(spark.createDataFrame(rows, "rep long, pivot long")).collect()]

    def parts(edges):
        root = {x: x for r in rows for x in r}
        find = lambda x: x if root[x] == x else find(root[x])
        for a, b in edges:
            root[find(a)] = find(b)
        return {frozenset(y for y in root if find(y) == find(x)) for x in root}

    assert parts(got) == parts(rows) and len(got) == len(set(got))


def test_shuffle_files_and_sketches_do_not_pile_up(spark, monkeypatch):
    left, swept = {}, []
    save, drop = Scratch.save, Scratch.drop

    def saving(self, df):
        saved = save(self, df)
        left[saved.saved_path] = saved.columns
        return saved

    def dropping(self, *saved):
        for df in saved:
            if df is not None:
                left.pop(df.saved_path, None)
        drop(self, *saved)

    monkeypatch.setattr(Scratch, "save", saving)
    monkeypatch.setattr(Scratch, "drop", dropping)
    monkeypatch.setattr(Scratch, "sweep", lambda self: swept.append(len(left)))
    docs = spark.createDataFrame(list(groups(3, n_groups=4).items()), "doc_id long, text string")
    assert N.near_duplicates(docs, N.Settings(width=2)).count() == 56
    assert [c for c in left.values() if "sketch" in c] == [["d1", "d2", "rep", "sketch"]]
    assert len(swept) >= 6


def test_nodes_are_dealt_once(spark):
    """Sizes and pivots of nodes need the members by their key in one shuffle, not two."""
    rows = [(k, r) for k in range(5) for r in range(k + 1)]
    nodes = spark.createDataFrame(rows, "key long, rep long")
    comps = spark.createDataFrame([(r, 0) for r in range(4)], "node long, root long")
    sized, again = N._sized(nodes, None), N._sized(nodes, comps)
    plans = [d._jdf.queryExecution().executedPlan().toString() for d in (sized, again)]
    assert [p.count("hashpartitioning(key") for p in plans] == [1, 1]
    got = sized.collect()
    assert {(r["key"], r["rep"], r["n"]) for r in got} == {(k, r, k + 1) for k, r in rows if k}
    pivots = {(r["key"], r["pivot"]) for r in got}
    assert len(pivots) == 4 and all((k, p) in rows for k, p in pivots)
    assert sorted((r["key"], r["rep"], r["n"], r["pivot"], r["comp"]) for r in again.collect()) == [(4, r, 5, 0, 0 if r < 4 else 4) for r in range(5)]


def test_pairs_are_tried_with_half_of_the_bits(spark):
    rng = random.Random(3)
    s = N.Settings()
    draw = lambda: rng.randrange(-(2**31), 2**31)
    first = [draw() for _ in range(s.tokens)]
    least = N._least_agreeing(s)
    rows = [(1, first), (2, first[:least] + [draw() for _ in range(s.tokens - least)]), (3, first[: least - 20] + [draw() for _ in range(s.tokens - least + 20)])]
    reps = spark.createDataFrame(rows, "rep long, sketch array<int>")
    pairs = spark.createDataFrame([(1, 2), (1, 3), (1, 2)], "a long, b long")
    likely = N._likely(pairs, reps, s)
    assert likely.collect() == [(1, 2)]
    assert reps.select(N._tokens_moved().alias("x")).dtypes == [("x", "array<smallint>")]
