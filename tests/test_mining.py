import itertools
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from logquarry.operators import partitions as pt
from logquarry.operators import relations as rl
from logquarry.operators import scoring as sc
from logquarry.operators import sequences as sq
from logquarry.operators import similarity as sm
from logquarry.operators import stats as st
from logquarry.operators import templates as tp
from logquarry.operators import wordclusters as wc


def cells(spark, truth, parsed):
    rows = [(i, a, b) for i, (a, b) in enumerate(zip(truth, parsed))]
    df = spark.createDataFrame(rows, "id long, truth string, parsed string")
    return sc.cells(df)


def test_scores(spark):
    c = cells(spark, "aabbb", "xxyyz")
    assert sc.group_accuracy(c).first()["group_accuracy"] == 0.4
    p = sc.pairwise_scores(c).first()
    assert (p["precision"], p["recall"], round(p["pairwise_f1"], 6)) == (1.0, 0.5, 0.666667)
    same = cells(spark, "aabbb", "aabbb")
    assert sc.group_accuracy(same).first()["group_accuracy"] == 1.0
    t = sc.template_accuracy(cells(spark, "aabbb", "aabcc")).first()
    assert (t["n_parsed"], t["n_truth"], t["n_correct"]) == (3, 2, 2)
    none = sc.pairwise_scores(cells(spark, "ab", "xy")).first()
    assert none["pairwise_f1"] == 0.0


def test_match_templates(spark, lines):
    t = spark.createDataFrame(
        [(1, "get <*> ok"), (2, "get file <*>"), (3, "<*> <*>"), (4, "<*> file ok")], "template_id long, template string"
    )
    texts = ["get file ok", "get x ok", "put file ok", "a b", "a b c", "get file now"]
    got = tp.match_templates(lines(texts), t, ["chunk_id", "line_no"]).orderBy("line_no")
    assert [r["template_id"] for r in got.collect()] == [1, 1, 4, 3, None, 2]


def test_more_specific_against_brute_force(spark):
    rng = random.Random(5)
    found = []
    for _ in range(60):
        k = rng.randint(1, 4)
        lo = [rng.randint(0, 1) * rng.randint(0, 1) for _ in range(k + 1)]
        found.append(([rng.choice("abc") for _ in range(k)], 1, lo, [x + rng.randint(0, 6) for x in lo]))
    seen = {tuple(c[0]): c for c in found}
    cands = list(seen.values())
    df = spark.createDataFrame(cands, "words array<string>, n long, gap_min array<int>, gap_max array<int>")

    def covers(x, y):
        nx, ny = len(x[0]), len(y[0])
        for pos in itertools.combinations(range(ny), nx):
            if any(y[0][p] != w for p, w in zip(pos, x[0])):
                continue
            ends = [-1, *pos, ny]
            if all(
                x[2][i] <= sum(y[2][a + 1 : b + 1]) + b - a - 1 and x[3][i] >= sum(y[3][a + 1 : b + 1]) + b - a - 1
                for i, (a, b) in enumerate(zip(ends, ends[1:]))
            ):
                return True
        return False

    want = {(tuple(x[0]), tuple(y[0])) for x in cands for y in cands if x[0] != y[0] and covers(x, y)}
    got = {(tuple(r["words"]), tuple(r["sub_words"])) for r in wc.more_specific(df).collect()}
    assert got == want and want


def test_word_support_counts_once_per_line(spark, lines):
    df = lines(["a a b", "a", "b c"])
    got = {r["word"]: r["n"] for r in wc.frequent_words(df, support=2).collect()}
    assert got == {"a": 2, "b": 2}


def test_word_options(spark, lines):
    df = lines(["u1 in", "u2 in", "u3 out"])
    opts = wc.rewrite_option("^u[0-9]$", "[0-9]", "#")
    words = wc.frequent_words(df, support=2, options=opts)
    assert {r["word"] for r in words.collect()} == {"u#", "in"}
    c = wc.line_candidates(df, words, ["line_no"], options=opts).orderBy("line_no").collect()
    assert [r["words"] for r in c] == [["u#", "in"], ["u#", "in"], ["u#"]]
    assert [r["gaps"] for r in c] == [[0, 0, 0], [0, 0, 0], [0, 1]]


def test_join_by_weight(spark):
    df = spark.createDataFrame(
        [(["a", "x", "b"], [0, 0, 0, 1], [0, 1, 0, 2], 3, [0.9, 0.1, 0.9]), (["a", "y", "b"], [0, 0, 0, 0], [1, 0, 0, 0], 2, [0.9, 0.2, 0.9])],
        "words array<string>, gap_min array<int>, gap_max array<int>, n long, weights array<double>",
    )
    text = lambda d: [(r[0], r[1]) for r in d.select(wc.cluster_text(F.col("words"), F.col("alts"), F.col("gap_min"), F.col("gap_max")), "n").collect()]
    assert text(wc.join_by_weight(df, 0.5)) == [("*{0,1} a *{0,1} (x|y) b *{0,2}", 5)]
    assert text(wc.join_by_weight(df, 0.5, True)) == [("*{0,1} a *{1,2} b *{0,2}", 5)]


def test_partition_relations(spark, lines):
    # two-word lines: step 3 looks at both positions
    texts = ["a x"] * 3 + ["b y1", "b y2", "b y3"] + ["c1 z", "c2 z"] + ["m1 q1", "m1 q2", "m2 q1"]
    parts = pt.step3(pt.step1(pt.distinct_words(lines(texts))))
    got = {tuple(r["words"]): r["part"].split(":")[-1] for r in parts.collect()}
    assert got[("a", "x")] == "a"
    # 3 words on 3 lines: a ratio of 1 splits by the single side
    assert {got[("b", f"y{i}")] for i in (1, 2, 3)} == {"b"}
    assert {got[("c1", "z")], got[("c2", "z")]} == {"z"}
    # as many words left on both sides: the second position splits
    assert (got[("m1", "q1")], got[("m1", "q2")], got[("m2", "q1")]) == ("q1", "q2", "q1")


def test_similarity_against_online_rule(spark, lines):
    rng = random.Random(3)
    texts = [" ".join(rng.choice(["a", "b", "c"]) for _ in range(4)) for _ in range(60)]
    clusters = []
    for t in dict.fromkeys(texts):
        seq = t.split()
        best, key = None, (-1.0, -1)
        for c in clusters:
            score = sum(x == y for x, y in zip(c["t"], seq) if x != "<*>") / 4
            k = (score, c["t"].count("<*>"))
            if k > key:
                best, key = c, k
        if best is None or key[0] < 0.6:
            clusters.append({"t": seq, "m": [t]})
        else:
            best["t"] = [x if x == y else "<*>" for x, y in zip(best["t"], seq)]
            best["m"].append(t)
    want = {m: " ".join(c["t"]) for c in clusters for m in c["m"]}
    got = {" ".join(r["words"]): r["template"] for r in sm.similarity_templates(lines(texts), 0.6).collect()}
    assert got == want


def test_rules_round_trip(spark):
    rng = random.Random(1)
    rows = [(i // 50, i, 3 * i + rng.randint(0, 2), rng.randint(0, 9), 5 * i, rng.choice("pq")) for i in range(200)]
    df = spark.createDataFrame(rows, "chunk_id long, row_no long, a long, b long, c long, k string")
    catalog = rl.forms(["a", "b", "c"], ["k"])
    rules = rl.choose_rules(rl.relation_scores(df, catalog, "row_no"), catalog)
    assert len(rules) == 3
    for chosen in (rules, [(rl.Form("a", "up"),), (rl.Form("b", "up", "k"), rl.Form("a")), (rl.Form("a", "do"), rl.Form("c", "do", "k"))]):
        encoded = rl.apply_rules(df, chosen, catalog, "row_no", ["k"])
        back = rl.undo_rules(encoded, chosen, "row_no").select("chunk_id", "row_no", "a", "b", "c", "k")
        assert sorted(map(tuple, back.collect())) == sorted(rows)


def test_id_forms(spark):
    df = spark.createDataFrame(
        [(0, 1, 1, "a"), (0, 2, 5, "b"), (0, 3, 4, "a"), (0, 4, 5, "b")], "chunk_id long, row_no long, v long, k string"
    )
    w = rl.with_forms(df, rl.forms(["v"], ["k"]), "row_no").orderBy("row_no").collect()
    assert [r["v_do_k"] for r in w] == [1, 5, 3, 0]
    assert [r["v_up_k"] for r in w] == [3, 0, 4, 5]
    assert [r["v_up"] for r in w] == [4, -1, 1, 5]


def test_kendall_and_spearman(spark):
    rng = np.random.default_rng(2)
    x, y = rng.integers(0, 12, 300), rng.integers(0, 15, 300)
    y = y + x // 3
    df = spark.createDataFrame(pd.DataFrame({"x": x, "y": y}))
    dx, dy = np.sign(x[:, None] - x), np.sign(y[:, None] - y)
    s = (dx * dy).sum() / 2
    tau = s / np.sqrt(np.abs(dx).sum() / 2 * np.abs(dy).sum() / 2)
    k = st.kendall(df, "x", "y").first()
    assert abs(k["tau"] - tau) < 1e-12 and k["concordant"] - k["discordant"] == s
    assert 0 <= k["p_value"] < 0.01
    rho = pd.Series(x).rank().corr(pd.Series(y).rank())
    assert abs(st.spearman(df, "x", "y").first()["rho"] - rho) < 1e-12


def test_patterns_and_linkage(spark):
    df = spark.createDataFrame([(0, 1, "1-2/3"), (0, 2, "4-5-6/7"), (1, 1, "a.b"), (1, 2, "ab")], "chunk_id long, row_no long, v string")
    p = {r[0]: r[1] for r in rl.column_patterns(df, "v", "row_no").collect()}
    assert p == {0: "-/", 1: ""}
    f = df.select(rl.split_by_pattern(F.col("v"), F.lit("-/")).alias("f")).first()[0]
    assert f == ["1", "2", "3"]
    groups = sq.complete_linkage(np.array([[0.0], [0.4], [1.0], [5.0]]), 0.6)
    assert sorted(map(sorted, groups)) == [[0, 1], [2], [3]]
    assert sq.common_pattern([list("abcd"), list("axcd"), list("abcde")]) == [["a"], ["c", "d"]]


def test_weighted_draws(spark):
    df = spark.range(100).selectExpr("id", "id % 4 as k").union(spark.createDataFrame([(1000, 9)], "id long, k long"))
    s = sq.balanced_sample(df, "k", ["id"], 50, seed=2)
    assert {r["k"]: r["count"] for r in s.groupBy("k").count().collect()} == {0: 10, 1: 10, 2: 10, 3: 10, 9: 10}


def test_diverse_samples(spark):
    df = spark.createDataFrame([(w,) for w in ("aaaa", "aaab", "zzzz", "mmmm")], "t string")
    picked = [r["text"] for r in sq.diverse_sample(df, "t", 3, sq.normalized_edit_distance).orderBy("round").collect()]
    assert len(picked) == 3 and not {"aaaa", "aaab"} <= set(picked)
    assert sq.diverse_sample(df, "t", 9, sq.normalized_edit_distance).count() == 4
    assert sq.diverse_sample(df.where("false"), "t", 3, sq.normalized_edit_distance).count() == 0
    rows = sq.pattern_sample(df, "t", sq.normalized_edit_distance, patterns=9, near=0.3, far=0.5).collect()
    groups = {}
    for r in rows:
        groups.setdefault(r["pattern"], set()).add(r["text"])
    assert sorted(map(sorted, groups.values())) == [["aaaa", "aaab"], ["mmmm"], ["zzzz"]]


@pytest.mark.parametrize("chunk", [10, 3, 1])
def test_templates_do_not_depend_on_chunks(spark, chunk):
    texts = ["user 1 in room a", "user 2 in room b", "user 3 in room c", "disk x is full now", "user 4 in room d"]
    df = spark.createDataFrame([(i // chunk, i, t) for i, t in enumerate(texts)], "chunk_id long, line_no long, line string")
    got = {r["template"]: r["n_lines"] for r in sm.template_totals(sm.similarity_templates(df, 0.5)).collect()}
    assert got == {"user <*> in room <*>": 4, "disk x is full now": 1}


def test_mined_patterns(spark):
    rows = [(1, i, ["x", "a", "b", str(i), "c", "-1"]) for i in range(5)] + [(2, 0, ["q", "-1"])]
    df = spark.createDataFrame(rows, "k long, i long, events array<string>")
    got = {r["cluster"]: r["pattern"] for r in sq.mined_patterns(df, "k", ["k", "i"], 8).collect()}
    assert got == {1: [["x", "a", "b"], ["c"]], 2: [["q"]]}


def test_many_numeric_columns(spark):
    n = 40
    df = spark.range(50).selectExpr("id div 25 as chunk_id", "id as row_no", *[f"id * {k} % 11 as c{k}" for k in range(n)])
    catalog = rl.forms([f"c{k}" for k in range(n)], [])
    assert len(catalog) == 3 * n
    got = rl.relation_scores(df, catalog, "row_no", triples=False)
    assert got.count() == len(rl.expressions(catalog, triples=False))


def test_damage(spark, lines):
    df = lines(["a 1 b", "a 2 b", "c d"]).withColumn(
        "template", F.when(F.col("line").startswith("a"), "a <*> b").otherwise("c d")
    )
    got = tp.damage_template(df, ["line_no"]).orderBy("line_no").collect()
    assert [(r["template"], r["touched"]) for r in got] == [("a 1 b", True), ("a 2 b", True), ("c d", False)]
