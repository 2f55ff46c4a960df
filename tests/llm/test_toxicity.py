import random

from logquarry.llm import toxicity as T


def test_fold():
    assert T.fold("Y0u ID1OT, tr4sh c@n! 2024") == " you idiot trash can "
    assert T.fold("ѕtuріd") == " stupid "
    assert T.fold("") == "  "


def test_exceptions_and_length():
    m = T.Model({"trash ": 2.0, "idi": 1.0})
    assert T.matches(m, T.fold("put it in the trash can, idiots")) == (1.0, 1)
    assert T.matches(m, T.fold("trash trash")) == (4.0, 2)
    short, long = T.feature(m, T.fold("trash"))[0], T.feature(m, T.fold("trash" + " word" * 500))[0]
    assert short > long > 0


def _corpus(spark, n=600):
    rng = random.Random(1)
    words = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(300)]
    rows, labels = [], []
    for i in range(n):
        text = rng.choices(words, k=40)
        bad = i % 6 == 0
        if bad:
            text[3:3] = ["zorgel", "zorgelix"][: 1 + i % 2]
        rows.append((i, " ".join(text)))
        labels.append((i, int(bad)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_learns_held_out(spark):
    docs, labels = _corpus(spark)
    model = T.fit(docs.where("doc_id % 5 <> 0"), labels)
    got = {r["doc_id"]: r for r in T.score(docs, model).collect()}
    held = [i for i in got if i % 5 == 0]
    assert sum(got[i]["predicted"] == (i % 6 == 0) for i in held) >= 0.98 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_odd_rows(odd, none, spark):
    model = T.fit(none, spark.createDataFrame([], "doc_id long, toxic int"))
    got = T.score(odd, model).collect()
    assert len(got) == odd.count() and all(r["predicted"] == 0 for r in got)
    assert T.score(none, model).count() == 0
    assert T.reject_toxic(odd, model).columns == odd.columns
    assert T.reject_toxic(odd, model).count() == odd.count()


def test_null_labels_and_ids(spark):
    docs = spark.createDataFrame([(1, "you idiot"), (None, "you idiot"), (2, "fine")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, toxic int")
    assert T.score(docs, T.fit(docs, labels)).count() == 3


def test_rejects_by_few_texts_at_a_time(spark):
    import pyarrow as pa

    from logquarry.llm import common

    batch = pa.RecordBatch.from_pydict({"x": list(range(2500))})
    parts = list(common.sliced(iter([batch, batch.slice(0, 0)])))
    assert [b.num_rows for b in parts] == [1000, 1000, 500]
    assert [v for b in parts for v in b.column("x").to_pylist()] == list(range(2500))
    texts = ["you idiot", None, "", "a quiet day"]
    docs = spark.createDataFrame([(i, texts[i % 4]) for i in range(2300)], "doc_id long, text string").coalesce(1)
    model = T.Model({"idiot ": 9.0})
    kept = [r["doc_id"] for r in T.reject_toxic(docs, model).collect()]
    assert kept == [r["doc_id"] for r in T.score(docs, model).where("predicted = 0").collect()]
    assert kept == [i for i in range(2300) if i % 4]
