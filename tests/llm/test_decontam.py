import itertools
import random

import pytest

from logquarry.llm import decontam as D


def words(rng, n):
    return ["".join(rng.choices("abcdefghijklm", k=6)) for _ in range(n)]


@pytest.fixture(scope="module")
def case(spark):
    rng = random.Random(2)
    items = {i: words(rng, n) for i, n in enumerate([15, 20, 38, 60, 3, 40])}
    docs, want = {}, set()
    for d in range(120):
        text = words(rng, 80)
        i = d % 6
        item = list(items[i])
        kind = d % 4
        if kind == 1:
            for k in rng.sample(range(len(item)), len(item) // 5 if len(item) > 5 else 0):
                item[k] = "changed"
        if kind == 2 and len(item) >= 40:
            item = item[5:20]
        if kind == 3:
            item = item[: len(item) // 3] if len(item) // 3 < 13 else []
        elif not (kind == 2 and len(items[i]) >= 40) or len(item) >= 13:
            want.add((d, i))
        at = rng.randrange(80)
        docs[d] = " ".join(text[:at]) + ",\n" + "%%% ".join(w.upper() for w in item) + ". " + " ".join(text[at:])
    b = spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()], "item_id long, text string")
    return spark.createDataFrame(list(docs.items()), "doc_id long, text string"), b, want


@pytest.mark.parametrize("rows", [2_000_000, 0])
def test_planted(case, rows):
    docs, bench, want = case
    got = {(r["doc_id"], r["item_id"]) for r in D.find_leaks(docs, bench, D.Settings(broadcast_rows=rows)).collect()}
    assert got == want


def test_odd_rows(odd, none, spark):
    bench = spark.createDataFrame([(1, "one"), (2, None), (3, ""), (4, "two words"), (4, "two words")], "item_id long, text string")
    got = sorted((r["doc_id"], r["item_id"]) for r in D.find_leaks(odd, bench).collect())
    assert got == [(103, 1), (104, 1), (105, 4)]
    assert D.find_leaks(none, bench).count() == 0
    assert D.find_leaks(odd, bench.where("false")).count() == 0
    left = D.remove_leaks(odd, bench)
    assert left.columns == odd.columns and left.count() == odd.count() - 3


@pytest.mark.parametrize("n", range(5, 21))
def test_every_placing_is_met(n):
    s = D.Settings()
    seeds = D.own_masks(n, s) if n <= s.short else [(at, m) for m in s.masks for at in range(n - len(m) + 1)]
    used = [{at + k for k, c in enumerate(m) if c == "1"} for at, m in seeds]
    for changed in itertools.combinations(range(n), n // 5):
        assert any(u.isdisjoint(changed) for u in used), changed


def test_short_items_with_changes(spark):
    rng = random.Random(4)
    items = {n: words(rng, n) for n in (5, 6, 7, 8, 10)}
    docs, want = [], set()
    for n, item in items.items():
        for changed in itertools.combinations(range(n), n // 5):
            body = ["changed" if k in changed else w for k, w in enumerate(item)]
            docs.append(" ".join(words(rng, 9) + body + words(rng, 9)))
            want.add((len(docs) - 1, n))
        docs += [" ".join(item[n // 5 :] + words(rng, 3)), " ".join(words(rng, 3) + item[: n - n // 5])]
        want |= {(len(docs) - 2, n), (len(docs) - 1, n)}
        docs.append(" ".join(["changed"] * (n // 5 + 1) + item[n // 5 + 1 :]))
    bench = spark.createDataFrame([(n, " ".join(w)) for n, w in items.items()], "item_id long, text string")
    table = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in D.find_leaks(table, bench).collect()} == want


@pytest.mark.parametrize("rows", [2_000_000, 0])
def test_equal_texts_are_sought_once(case, monkeypatch, rows):
    docs, bench, want = case
    sizes, keep = [], D._index
    monkeypatch.setattr(D, "_index", lambda *a: sizes.append((made := keep(*a)).count()) or made)
    many = bench.selectExpr("item_id", "text", "explode(sequence(0, 29)) as copy").selectExpr("item_id + 100 * copy as item_id", "text")
    found = D.find_leaks(docs, many, D.Settings(broadcast_rows=rows)).collect()
    D.find_leaks(docs, bench, D.Settings(broadcast_rows=rows))
    assert sizes[0] == sizes[1]
    assert {(r["doc_id"], r["item_id"]) for r in found} == {(d, i + 100 * k) for d, i in want for k in range(30)}
    assert len(found) == 30 * len(want)


def test_an_item_of_two_texts_has_its_best_row(spark):
    rng = random.Random(5)
    a, b = words(rng, 20), words(rng, 30)
    bench = spark.createDataFrame([(1, " ".join(a)), (1, " ".join(b)), (None, " ".join(a))], "item_id long, text string")
    docs = spark.createDataFrame([(7, " ".join(a + b)), (8, " ".join(a))], "doc_id long, text string")
    got = {r["doc_id"]: (r["item_id"], r["item_words"], r["start"]) for r in D.find_leaks(docs, bench).collect()}
    assert got == {7: (1, 30, 20), 8: (1, 20, 0)}


def test_few_leaking_documents_move_no_text(case):
    docs, bench, want = case
    left = D.remove_leaks(docs, bench)
    assert "BroadcastHashJoin" in left._jdf.queryExecution().executedPlan().toString()
    assert left.count() == docs.count() - len({d for d, _ in want})
