import os
import random

import pytest

import corpus_pipeline as C
from logquarry.llm import decontam, neardup, pieces, secret_tags, toxicity

pytestmark = pytest.mark.skipif(not os.path.exists(C.PIECES_MODEL), reason="no model file")


def test_stages(spark, tmp_path):
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    clean = {i: " ".join(word() for _ in range(60)) for i in range(40)}
    item = " ".join(word() for _ in range(25))
    docs = dict(clean)
    docs[100] = clean[3]
    docs[101] = clean[4] + " tail"
    docs[102] = " ".join(word() for _ in range(30)) + " " + item
    docs[103] = "you stupid idiot " + " ".join(word() for _ in range(10)) + " worthless scum"
    docs[104] = "token = 9f8e7d6c5b4a39281706f5e4d3c2b1a09f8e7d6c " + word()
    docs[105] = None
    rows = [(i, t, "en", "s", len(t or "")) for i, t in docs.items()]
    folder = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([(103, 1), (0, 0)], "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
    assert [name for name, _ in C.STAGES] == ["toxicity", "minhash_near_dedup", "benchmark_decontamination", "secret_scans", "sentencepiece"]
    got = {r["doc_id"]: r for r in C.run(spark, folder).collect()}
    assert set(got) == set(clean) | {104, 105}
    model = pieces.load(C.PIECES_MODEL)
    table = pieces._decoding_table(model)
    assert pieces._joined(got[5]["ids"], table) == clean[5]
    assert pieces._joined(got[104]["ids"], table).startswith("[SECRET] ")
    assert got[105]["n_pieces"] == 0


def test_stage_functions_keep_columns(odd, none, tmp_path, spark):
    folder = str(tmp_path)
    spark.createDataFrame([(1, None)], "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    for docs in (odd, none):
        for _, stage in C.STAGES[:-1]:
            out = stage(spark, docs, folder)
            assert out.columns == docs.columns
            assert out.count() <= docs.count()
        assert C.STAGES[-1][1](spark, docs, folder).count() == docs.count()
