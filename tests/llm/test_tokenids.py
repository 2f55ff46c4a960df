import os
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from logquarry.llm import tokenids as T

PATH = "/opt/tokenizers/byte_bpe_50k.json"
needs_file = pytest.mark.skipif(not os.path.exists(PATH), reason="no tokenizer file")


@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 2**32 - 1))))
def test_pack(values):
    packed = T.pack(np.array(values, np.uint32))
    assert T.unpack(packed, len(values)).tolist() == values
    assert len(packed) == -(-len(values) // 4) + sum(max(1, -(-v.bit_length() // 8)) for v in values)


@settings(max_examples=300, deadline=None)
@given(st.text(" \n\tab.,'1é\x1c\xa0", max_size=25))
def test_chunks(text):
    first, rest = T.chunks(text)
    assert first + "".join(" " + p for p in rest) == text


@needs_file
def test_regular_chunks_go_to_the_merges_part_by_part():
    encoder = T.Encoder(PATH, 1000)
    whole: list[str] = []
    raw = encoder._raw
    encoder._raw = lambda parts: (whole.extend(parts), raw(parts))[1]
    texts = ["in the.\nErhaes was,*** 12a-b_c (x) <|endoftext|> Über.", "it's a ½ don't.\n\nB", ""]
    found = [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(texts)]
    assert found == [e.ids for e in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert sorted(whole) == ["", " don't.\n\nB", " ½", "in", "it's"]


@needs_file
def test_parts_are_what_the_pattern_cuts():
    rng = random.Random(5)
    encoder = T.Encoder(PATH, 2000)
    texts = ["".join(rng.choices("aZsé ßÀʯɐ\n\t'.,;!?<|>_-0189½²Ⅷ日×÷\xa0\xad`~@[]\\^{}\"😀\x1c", k=rng.randint(0, 30))) for _ in range(5000)]
    for raw, e in zip(encoder.encode(texts), encoder.tokenizer.encode_batch(texts, add_special_tokens=False), strict=True):
        assert np.frombuffer(raw, "<u4").tolist() == e.ids


@needs_file
def test_chunks_encode_alike():
    rng = random.Random(4)
    encoder = T.Encoder(PATH, 50)
    texts = ["".join(rng.choices(" \n\tab.,'1é\x1c\xa0世", weights=[6, 1, 1, 4, 4, 1, 1, 1, 1, 1, 1, 1, 1], k=30)) for _ in range(2000)]
    whole = encoder.tokenizer.encode_batch(texts, add_special_tokens=False)
    for at in range(0, 2000, 100):
        for raw, e in zip(encoder.encode(texts[at : at + 100]), whole[at : at + 100], strict=True):
            assert np.frombuffer(raw, "<u4").tolist() == e.ids
    assert len(encoder.known) <= 50


@needs_file
def test_written_and_read(odd, none, tmp_path):
    from tokenizers import Tokenizer

    out = str(tmp_path / "ids")
    T.write_ids(odd, PATH, out, T.Settings(segment_ids=1000))
    tokenizer = Tokenizer.from_file(PATH)
    start = 0
    rows = odd.collect()
    got = T.read_ids(odd.sparkSession, out).orderBy("start").collect()
    assert len(got) == len(rows)
    for doc, r in zip(rows, got, strict=True):
        ids = [*tokenizer.encode(doc["text"] or "", add_special_tokens=False).ids, 0]
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids"]) == (doc["doc_id"], start, len(ids), ids)
        assert r["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
    T.write_ids(none, PATH, str(tmp_path / "none"))
    assert T.read_ids(odd.sparkSession, str(tmp_path / "none")).count() == 0


@needs_file
def test_repeated_ids(spark, tmp_path):
    rows = [(5, "b"), (5, "a"), (None, "c"), (1, None)]
    T.write_ids(spark.createDataFrame(rows, "doc_id long, text string"), PATH, str(tmp_path / "ids"))
    got = T.read_ids(spark, str(tmp_path / "ids"), with_ids=False).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == [None, 1, 5, 5]


def test_foreign_file():
    with pytest.raises(ValueError):
        T.read_segment(b"NONE" + bytes(12), np.zeros(1, np.uint32))
