"""Templates by similarity in bounded rounds."""

import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from logquarry.functions.ranks import positions
from logquarry.operators import similarity as sm


def greedy(texts, threshold):
    """The online rule over a corpus in order, and the words that all members of a cluster share."""
    clusters = []
    for t in dict.fromkeys(texts):
        seq = t.split()
        best, key = None, (-1.0, -1)
        for c in clusters:
            if len(c["t"]) == len(seq):
                k = (sum(x == y for x, y in zip(c["t"], seq) if x != "<*>") / len(seq), c["t"].count("<*>"))
                if k > key:
                    best, key = c, k
        if best is None or key[0] < threshold:
            clusters.append({"t": seq, "m": [t]})
        else:
            best["t"] = [x if x == y else "<*>" for x, y in zip(best["t"], seq)]
            best["m"].append(t)
    out = {}
    for c in clusters:
        columns = zip(*[m.split() for m in c["m"]])
        text = " ".join(w[0] if len(set(w)) == 1 else "<*>" for w in columns)
        out |= dict.fromkeys(c["m"], text)
    return out


def templates(spark, texts, chunk, **options):
    df = spark.createDataFrame([(i // chunk, i, t) for i, t in enumerate(texts)], "chunk_id long, line_no long, line string").repartition(3)
    rows = sm.similarity_templates(df, options.pop("threshold", 0.6), **options).collect()
    found = {}
    for r in rows:
        found.setdefault(" ".join(r["words"]), set()).add(r["template"])
    assert all(len(t) == 1 for t in found.values())
    assert sum(r["n"] for r in rows) == sum(bool(t and t.strip()) for t in texts)
    return {k: t.pop() for k, t in found.items()}


@pytest.mark.parametrize("chunk", [7, 1000])
def test_one_block_is_the_online_rule(spark, chunk):
    rng = random.Random(chunk)
    texts = [" ".join(rng.choice("abcd") for _ in range(rng.choice([3, 5]))) for _ in range(80)]
    assert templates(spark, texts, chunk) == greedy(texts, 0.6)


@pytest.mark.parametrize("cells", [40, 200])
def test_rounds_of_small_blocks(spark, cells):
    # kinds far apart: any dealing gives the same templates; a block above its size fails an assertion in the task
    rng = random.Random(1)
    kinds = [f"a{k} b{k} c{k} {{}} d{k}" for k in range(12)]
    texts = [kinds[i % 12].format(f"v{rng.randrange(10**6)}") for i in range(300)] + ["alone here", "", None]
    want = {t: " ".join(w if not w.startswith("v") else "<*>" for w in t.split()) for t in texts[:300]} | {"alone here": "alone here"}
    small = templates(spark, texts, 50, cells=cells)
    assert small == want
    assert small == templates(spark, texts, 7, cells=cells)


def test_text_that_never_merges_ends(spark):
    texts = [f"x{i} y{i * 7} z{i * 3}" for i in range(60)]
    assert templates(spark, texts, 10, cells=15) == {t: t for t in texts}


def test_no_lines(spark, lines):
    assert sm.similarity_templates(lines(["", " "]).where("true")).collect() == []


def test_positions(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["hot"] * 5 + ["b", "c"]), i) for i in range(500)]
    df = spark.createDataFrame(rows, "k string, v int").repartition(6)
    got = {(r["k"], r["v"]): r["pos"] for r in positions(df, ["k"], ["v"]).collect()}
    want = {}
    for k in {r[0] for r in rows}:
        want |= {(k, v): i for i, v in enumerate(sorted(v for x, v in rows if x == k))}
    assert got == want
    assert positions(df.where(F.lit(False)), ["k"], ["v"]).collect() == []


def one_by_one(rows, threshold, separators):
    """The rule, a row at a time: cluster numbers and templates."""
    found, labels = [], []
    is_sep = re.compile(sm.SEPARATOR).match
    for row in rows:
        ranks = []
        for t in found:
            sep = [separators and w != sm.WILDCARD and bool(is_sep(w)) for w in t]
            alike = sum(a == b != sm.WILDCARD and not x for a, b, x in zip(t, row, sep))
            if any(x and a != b for a, b, x in zip(t, row, sep)):
                alike = -len(row)
            ranks.append((alike, t.count(sm.WILDCARD)))
        best = max(range(len(found)), key=lambda k: (*ranks[k], -k)) if found else None
        if best is None or ranks[best][0] / len(row) < threshold:
            labels.append(len(found))
            found.append(list(row))
        else:
            labels.append(best)
            found[best] = [a if a == b else sm.WILDCARD for a, b in zip(found[best], row)]
    return [found[k] for k in labels]


def test_blocks_are_clustered_together(monkeypatch):
    monkeypatch.setattr(sm, "_AT_ONCE", 7)
    rng = random.Random(3)
    for _ in range(60):
        separators, threshold, words, blocks, want = rng.random() < 0.5, rng.choice([0.1, 0.4, 0.6, 0.8]), [], [], []
        for block in range(3):
            width = rng.randrange(1, 6)
            rows = [[rng.choice(["<*>", "a", "b", ":", "=", "c"]) for _ in range(width)] for _ in range(rng.randrange(1, 30))]
            words += rows
            blocks += [block] * len(rows)
            want += one_by_one(rows, threshold, separators)
        table = pa.table({"words": pa.array(words, pa.list_(pa.string())), "n_words": [len(w) for w in words], "block": blocks})
        got = sm._clustered(table, 10**6, threshold, separators)
        assert got["words"].to_pylist() == words and got["common"].to_pylist() == want


def test_later_rounds_are_composed_from_behind(spark, monkeypatch):
    """No table of all forms is written for a later round, and templates of several rounds come together."""
    written, keep = [], sm.cut_lineage
    monkeypatch.setattr(sm, "cut_lineage", lambda df: written.append((df.columns, df.count())) or keep(df))
    rows = [(0, i, f"kind{i % 3} of line n{i} done") for i in range(300)]
    df = spark.createDataFrame(rows, "chunk_id long, line_no long, line string")
    got = {r["template"]: r["n_lines"] for r in sm.template_totals(sm.similarity_templates(df, 0.8, cells=40)).collect()}
    assert got == {f"kind{k} of line <*> done": 100 for k in range(3)}
    assert [n for columns, n in written if columns == ["words", "common"]].count(300) == 1
