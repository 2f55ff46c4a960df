import os
import random

import pyarrow as pa
import pytest

from logquarry.llm import pieces as P

PATH = "/opt/tokenizers/piece_bpe_32k.model"
needs_file = pytest.mark.skipif(not os.path.exists(PATH), reason="no model file")
SMALL = P.Settings(frequent=50, block_chars=30_000)


@needs_file
def test_equals_the_model(odd, none, spark):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=PATH)
    pieces = P.load(PATH)
    rng = random.Random(4)
    texts = ["".join(rng.choices("abcdehilnorst  \n.,'é世😀▁", k=rng.randint(1, 120))) for _ in range(300)]
    texts += [" " * 70 + "z", "ab" * 100, "é" * 80, "▁▁▁", "the\x00nul\x7f", "<s> </s>"]
    docs = odd.select("doc_id", "text").union(spark.createDataFrame([(1000 + i, t) for i, t in enumerate(texts)], "doc_id long, text string"))
    encoded = P.encode(docs, pieces, SMALL)
    got = {r["doc_id"]: r["ids"] for r in encoded.collect()}
    back = dict(P.decode(encoded, pieces).collect())
    for doc_id, text in docs.collect():
        assert got[doc_id] == model.encode(text or "")
        assert back[doc_id] == (text or "").replace("▁", " ")
    assert P.encode(odd, pieces, SMALL).count() == odd.count()
    assert P.encode(none, pieces).count() == 0


@needs_file
def test_long_units_fold_alike():
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=PATH)
    pieces = P.load(PATH)
    order = {s: k for k, s in enumerate(sorted({s for _, _, s in pieces.rows}, reverse=True))}
    ranks = {p: (order[s], i) for p, i, s in pieces.rows}
    rng = random.Random(1)
    for _ in range(200):
        unit = " " + "".join(rng.choices("abcdeinorst", k=rng.randint(1, 150)))
        assert P.merge_long(unit, ranks, pieces.bytes_at) == model.encode(unit[1:])


def test_units_go_back_to_their_blocks_in_few_rows():
    rows = [(b, c, list(range(c % 4))) for c in range(700) for b in (7, 3, 1 << 40)]
    batches = [pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows[at : at + 100], strict=True), (pa.int64(), pa.int32(), pa.list_(pa.int32())), strict=True)], names=["block", "code", "ids"]) for at in range(0, len(rows), 100)]
    got = []
    packed = [r for b in P._packed_units(iter(batches), rows=1000) for r in b.to_pylist()]
    for r in packed:
        body = P._unpressed(r["body"]).tolist()
        n, values = body[0], body[2 * body[0] + 1 :]
        for code, size in zip(body[1 : n + 1], body[n + 1 : 2 * n + 1], strict=True):
            got.append((r["block"], code, values[:size]))
            values = values[size:]
        assert not values
    assert sorted(got) == sorted(rows)
    assert len(packed) <= 9
    assert list(P._packed_units(iter([]))) == []


def test_codes_of_units():
    codes = P._Codes({"a": 0, "b": 1})
    assert [codes[u] for u in ("b", "c", "a", "d", "c")] == [1, 2, 0, 3, 2]


def best_score(unit, rows, lowest):
    best = {0: (0.0, [])}
    for to in range(1, len(unit) + 1):
        ways = []
        for at in range(to):
            if at not in best:
                continue
            part = unit[at:to]
            if part in rows:
                ways.append((best[at][0] + rows[part][1], -at, [*best[at][1], rows[part][0]]))
            elif to - at == 1:
                ways.append((best[at][0] + lowest, -at, [*best[at][1], *(100 + b for b in part.encode())]))
        top = max(ways, key=lambda w: (w[0], w[1]))
        best[to] = (top[0], top[2])
    return best[len(unit)][1]


def test_highest_total(spark):
    rng = random.Random(7)
    parts = {"".join(rng.choices("abc", k=n)) for n in (1, 1, 2, 2, 2, 3, 3, 3, 4, 4)} | {"a", "b"}
    rows = {p: (i, -rng.random() * 5) for i, p in enumerate(sorted(parts))}
    pieces = P.Pieces(tuple((p, i, s) for p, (i, s) in rows.items()), 100, merges=False)
    units = sorted({"".join(rng.choices("abcdé", weights=[5, 5, 5, 1, 1], k=rng.randint(1, 12))) for _ in range(150)})
    got = dict(P.encode_units(spark.createDataFrame([(u,) for u in units], "unit string"), pieces).collect())
    lowest = min(s for _, s in rows.values()) - 10
    assert {u: got[u] for u in units} == {u: best_score(u, rows, lowest) for u in units}


def test_pieces_across_blanks():
    with pytest.raises(ValueError):
        P.Pieces((("a b", 0, 0.0),), 1).cut()


def test_decode_odd_ids(spark):
    pieces = P.Pieces(((" a", 0, 0.0),), 10)
    rows = [(1, None), (2, []), (3, [0, 0, 999, 10 + 0xC3]), (4, [None])]
    got = dict(P.decode(spark.createDataFrame(rows, "doc_id long, ids array<int>"), pieces).collect())
    assert got == {1: "", 2: "", 3: "a a�", 4: ""}


def test_units_are_cut_where_no_piece_joins():
    pieces = P.Pieces((("ab", 0, 0.0), ("b.", 1, 0.0), (" a", 2, 0.0), ("x", 3, 0.0), ("世", 4, 0.0)), 10)
    cuts = P._Cuts(pieces.joints())
    parts, counts = cuts.parts([" abab.", "x", "ba世世", "ab", "\x00a"])
    assert parts == [" ab", "ab.", "x", "b", "a", "世", "世", "ab", "\x00", "a"]
    assert counts.tolist() == [2, 1, 4, 1, 2]
    assert cuts.parts([])[0] == []


@needs_file
def test_letters_end_before_a_full_stop(spark):
    import re

    import sentencepiece

    pieces = P.load(PATH)
    assert re.findall(pieces.cut(), " end. x²") == [" end", ".", " x²"]
    model = sentencepiece.SentencePieceProcessor(model_file=PATH)
    rng = random.Random(9)
    texts = [" ".join("".join(rng.choices("enstraßñéü.²,'", k=rng.randint(1, 14))) for _ in range(40)) for _ in range(60)]
    # rare units are cut, and the documents of a block keep their own ones
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    got = dict(P.encode(docs, pieces, P.Settings(frequent=20, block_chars=3000)).collect())
    assert got == {i: model.encode(t) for i, t in enumerate(texts)}
