import random
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from logquarry.llm import merkle

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, digest string, block int, tree string"


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    said = [None if v is None else str(v) for v in row[:5]]
    return h(*["-" if v is None else f"{len(v.encode())}:{v}" for v in said])


def tree(leaves):
    """Levels of a tree, and per leaf its siblings from below."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        low = levels[-1]
        levels.append([h(*low[i : i + 2]) for i in range(0, len(low), 2)])
    paths = []
    for i in range(len(leaves)):
        steps = []
        for low in levels[:-1]:
            steps.append((i & 1, low[i ^ 1] if (i ^ 1) < len(low) else ""))
            i >>= 1
        paths.append(steps)
    return levels[-1][0], paths


def fold(d, steps):
    for odd, s in steps:
        d = h(s, d) if odd else h(d, s)
    return d


def brute(rows, tampered):
    parts = {}
    for r in rows:
        parts.setdefault(r[2], []).append(r)
    langs = sorted(parts, key=lambda k: (k is not None, (k or "").encode()))
    trees = {}
    for k in langs:
        parts[k].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[k] = tree([leaf(r) for r in parts[k]])
    root, tops = tree([trees[k][0] for k in langs])
    out = []
    for k, top in zip(langs, tops):
        sub, paths = trees[k]
        for r, steps in zip(parts[k], paths):
            now = (*r[:3], r[3] + 1 if r[3] is not None else None, r[4], *r[5:]) if tampered(r[0]) else r
            folded = fold(leaf(now), steps + top)
            out.append((r[0], leaf(r), sub, root, h(*[s for _, s in steps + top]), folded, folded == root))
    return sorted(out, key=str)


def made(spark, rows):
    table = spark.createDataFrame(rows, SCHEMA).repartition(5)
    return merkle.build(table, FIELDS, "lang", "doc_id", {"n_chars": F.col("n_chars") + 1}, F.col("doc_id") % 3 == 0)


def check(spark, rows):
    got = sorted([tuple(r) for r in made(spark, rows).proofs().collect()], key=str)
    assert got == brute(rows, lambda i: i is not None and i % 3 == 0)


def row(i, lang, text="t", n=3, source="s"):
    return (i, source, lang, n, text, "digest", 1, "tree")


def test_against_brute_force(spark):
    rng = random.Random(5)
    rows = [row(i, rng.choice(["en"] * 8 + ["de", "fr", None, "é", "Z"]), "word " * rng.randrange(9)) for i in range(700)]
    rows += [row(9000, "one leaf"), row(9001, "two"), row(9002, "two")]
    check(spark, rows)


def test_odd_rows(spark):
    rows = [row(None, None, None, None, None), row(None, None, None, None, None), row(3, None, None, None, None)]
    rows += [row(6, "en", "")] * 3 + [row(6, "en", "long é " * 30_000), row(9, "en", n=None), row(-3, "", "x")]
    check(spark, rows)


@pytest.mark.parametrize("n", [1, 2, 3, 127, 128, 129, 257])
def test_sizes_around_blocks(spark, n):
    check(spark, [row(i, "en", str(i)) for i in range(n)])


def test_small_blocks_many_tables(spark):
    rows = [row(i, f"l{i % 11}" if i < 50 else "en", str(i)) for i in range(150)]
    table = spark.createDataFrame(rows, SCHEMA)
    m = merkle.build(table, FIELDS, "lang", "doc_id", {"n_chars": F.col("n_chars") + 1}, F.col("doc_id") % 3 == 0, levels=2)
    assert sorted([tuple(r) for r in m.proofs().collect()], key=str) == brute(rows, lambda i: i % 3 == 0)


def test_empty(spark):
    m = made(spark, [])
    assert m.proofs().collect() == [] and m.versions().collect() == []


def test_versions_copy_ancestors_only(spark):
    rows = [row(i, "en" if i % 5 else "de", str(i)) for i in range(300)]
    m = made(spark, rows)
    folded = {r["id"]: r["folded_root"] for r in m.proofs().collect()}
    copied = {}
    for r in m.versions().collect():
        copied.setdefault(r["id"], {})[r["level"]] = r["digest"]
    assert set(copied) == {i for i in range(300) if i % 3 == 0}
    for i, levels in copied.items():
        height = 6 if i % 5 == 0 else 8
        assert sorted(levels) == list(range(height + 2)) and levels[height + 1] == folded[i]
        now = row(i, "en" if i % 5 else "de", str(i), 4)
        assert levels[0] == leaf(now)


def test_version_shares_nodes():
    base = merkle.grow([str(i).encode() for i in range(100)], 7)
    new = merkle.replace(base, 7, 70, b"x")
    assert new.left is base.left and new.right.right is base.right.right and new.digest != base.digest
    assert merkle.replace(new, 7, 70, b"70") == base
