import itertools
import random

import numpy as np

from logquarry.llm import secret_tags as S

KEY = "9f8e7d6c5b4a39281706f5e4d3c2b1a09f8e7d6c"


def test_base_patterns():
    t = f"PassWord: hunter22 x token=abc AKIA{'A' * 12} {KEY} api_key = 'abcdefgh' AKIAB token=secret: abcdefgh"
    got = [(S.KINDS[k], t[a:b]) for a, k, b in S.base_spans(t)]
    assert got == [("assign", "PassWord: hunter22"), ("access", "AKIA" + "A" * 12), ("hex", KEY), ("assign", "api_key = 'abcdefgh")]


def _model(seed=0):
    rng = np.random.default_rng(seed)
    return rng.standard_normal((6, 3)), rng.standard_normal((3, 3))


def paths(n):
    for tags in itertools.product(range(3), repeat=n):
        if tags[0] != S.I and not any(a == S.O and b == S.I for a, b in itertools.pairwise(tags)):
            yield tags


def total(tags, emit, step):
    around = [S.O, *tags, S.O]
    return sum(emit[k][t] for k, t in enumerate(tags)) + sum(step[a, b] for a, b in itertools.pairwise(around))


def test_viterbi_and_sums():
    for seed in range(10):
        rng = np.random.default_rng(seed)
        n = seed % 5 + 1
        emit, step = rng.standard_normal((n, 3)), rng.standard_normal((3, 3))
        score = {p: total(p, emit, step) for p in paths(n)}
        assert tuple(S.viterbi(emit, step)) == max(score, key=score.get)
        weight = {p: np.exp(v) for p, v in score.items()}
        z = sum(weight.values())
        tags, moves = S._expected(emit, step)
        for k, t in itertools.product(range(n), range(3)):
            assert np.isclose(tags[k, t], sum(w for p, w in weight.items() if p[k] == t) / z)
        for a, b in itertools.product(range(3), repeat=2):
            want = sum(w * sum((x, y) == (a, b) for x, y in itertools.pairwise([S.O, *p, S.O])) for p, w in weight.items()) / z
            assert np.isclose(moves[a, b], want)


def test_adds_spans_and_keeps_base(spark):
    rng = random.Random(2)
    rows = [(i, f"some words token = \"{''.join(rng.choices('0123456789abcdef', k=40))}\" and more") for i in range(50)]
    model = S.fit(spark.createDataFrame(rows, "doc_id long, text string"))
    found = lambda t: [t[a:b] for a, k, b in S._spans_of(t, model)[1] if k == 3]
    assert found("deploy key ghp_16C7e42F292c6912E7710c838347Ae178B4a now") == ["ghp_16C7e42F292c6912E7710c838347Ae178B4a"]
    for harmless in ("the user abc12345 came", "version v1.2.3-beta4 is out", "see img00123.png now", "at 2024-01-02T10:20:30 it", "call 555-1234 or a1@mail.example.com"):
        assert found(harmless) == []
    base, spans = S._spans_of(f"token={KEY} x", model)
    assert set(base) <= set(spans) and found(f"token={KEY} x") == []


def test_odd_rows(odd, none, spark):
    model = S.fit(none)
    got = S.find_secrets(odd, model).collect()
    assert len(got) == odd.count() and all(r["spans"] == [] for r in got)
    assert S.find_secrets(none, model).count() == 0
    docs = spark.createDataFrame([(1, f"a token = {KEY} b", 7), (2, None, 7), (3, "clean", 7)], "doc_id long, text string, base int")
    hidden = S.hide_secrets(docs, model)
    assert hidden.columns == docs.columns
    assert [r["text"] for r in hidden.orderBy("doc_id").collect()] == ["a [SECRET] b", None, "clean"]
