"""Work dealt by rows, and results that do not depend on how it is dealt."""

import math
from collections import Counter

from pyspark.sql import functions as F

from logquarry.operators import clustering as cg
from logquarry.operators import columns as cl
from logquarry.operators import encode as en
from logquarry.operators import numbers as nm
from logquarry.operators import relations as rl
from logquarry.operators import restore as rs
from logquarry.operators import sequences as sq
from logquarry.operators import tagging as tg


def plan(df) -> str:
    return df._jdf.queryExecution().toString()


def test_relation_cells_are_dealt_by_rows(spark, monkeypatch):
    df = spark.range(3000).selectExpr("id div 10 as chunk_id", "id as row_no", "id as a", "id % 7 as b", "id % 2 as k")
    catalog = rl.forms(["a", "b"], ["k"])
    monkeypatch.setattr(rl, "_TASK_CELLS", 100 * len(rl.expressions(catalog)))
    scores = rl.relation_scores(df, catalog, "row_no")
    text = plan(scores)
    # 3,000 rows of which a task may hold 100; two columns have no triples to go through
    assert "REPARTITION_BY_NUM" in text and ", 30)" in text
    assert text.count("Generate explode") == plan(rl.relation_scores(df, catalog, "row_no", triples=False)).count("Generate explode")
    assert scores.count() == len(rl.expressions(catalog))


def test_relation_scores_of_long_numbers(spark):
    big = [(1 << 62) + k % 3 for k in range(12)]
    df = spark.createDataFrame([(0, k, v, -v + (k % 2)) for k, v in enumerate(big)], "chunk_id long, row_no long, a long, b long")
    got = {r["expr"]: r["score"] for r in rl.relation_scores(df, [rl.Form("a"), rl.Form("b")], "row_no").collect()}
    for name, values in {"a": big, "b-a": [-2 * v + (k % 2) for k, v in enumerate(big)]}.items():
        assert abs(got[name] - (12 * math.log(12) - sum(c * math.log(c) for c in Counter(values).values()))) < 1e-9


def test_ngrams_are_texts_and_stay_apart(spark):
    pairs = [(["a", "b", "a", "b"], ["b", "a"]), (["1:a", "b"], ["1", ":ab"]), ([None, "x", None, None], ["x", None, ""]), (["", "", ""], [None, None]), ([], ["a"]), ([], [])]
    pairs += [(["ny", "x"], [None, "x"]), (["x", None], ["nx", "x"])]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a array<string>, b array<string>")
    assert df.select(sq.ngrams(F.col("a"), 2).alias("g")).schema["g"].dataType.simpleString() == "array<string>"
    for n in (1, 2, 3):
        got = {r["i"]: r["d"] for r in df.select("i", sq.ngram_distance(F.col("a"), F.col("b"), n).alias("d")).collect()}
        for i, (a, b) in enumerate(pairs):
            ga, gb = ({tuple(x[k : k + n]) for k in range(len(x) - n + 1)} for x in (a, b))
            total = len(ga) + len(gb)
            assert got[i] == ((total - 2 * len(ga & gb)) / total if total else None)


def test_rows_to_cluster_are_dealt_by_rows(spark, monkeypatch):
    parts = []
    keep = cg.cut_lineage
    monkeypatch.setattr(cg, "TASK_ROWS", 10)
    monkeypatch.setattr(cg, "cut_lineage", lambda df: parts.append(df.rdd.getNumPartitions()) or keep(df))
    df = spark.range(300).selectExpr("id", "concat('word ', id % 3) as text")
    got = cg.iterative_clusters(df, ["id"], F.struct("text"), "edit", 0.1, sample_size=60)
    assert got.count() == 300 and parts[0] == 30


def test_lines_and_values_are_dealt_by_rows(spark, monkeypatch):
    monkeypatch.setattr(en, "TASK_LINES", 10)
    monkeypatch.setattr(rs, "TASK_LINES", 10)
    monkeypatch.setattr(nm, "TASK_LINES", 10)
    monkeypatch.setattr(cl, "TASK_VALUES", 20)
    lines = spark.range(200).selectExpr("id div 5 as chunk_id", "id as line_no", "concat('user ', id % 9, ' paid ', id * id, ' to x', id % 4) as line")
    want = sorted(map(tuple, lines.collect()))
    encoded = en.encode(tg.tag_lines(lines))
    assert en.dealt(lines).rdd.getNumPartitions() == 20 and encoded.line_map.rdd.getNumPartitions() == 20
    restored = rs.restore_lines(encoded)
    assert ", 20)" in plan(restored) and sorted(map(tuple, restored.collect())) == want
    numbers = nm.decode_numbers(nm.encode_numbers(lines))
    assert ", 20)" in plan(numbers) and sorted(map(tuple, numbers.collect())) == want
    values = lines.select("chunk_id", F.lit("c").alias("col"), F.col("line_no").alias("seq"), F.col("line").alias("value"))
    columns = cl.encode_columns(values)
    assert ", 10)" in plan(columns.cells)
    assert sorted(map(tuple, cl.decode_columns(columns).collect())) == sorted(map(tuple, values.collect()))


def test_relation_scores_in_waves(spark, monkeypatch):
    df = spark.range(2000).selectExpr("id div 10 as chunk_id", "id as row_no", "id as a", "id % 7 as b", "id * id % 50 as c", "id % 2 as k")
    catalog = rl.forms(["a", "b", "c"], ["k"])
    once = {r["expr"]: r["score"] for r in rl.relation_scores(df, catalog, "row_no").collect()}
    sizes, keep = [], rl.written
    monkeypatch.setattr(rl, "written", lambda df: sizes.append(df.count() if "score" in df.columns else 0) or keep(df))
    monkeypatch.setattr(rl, "_WAVE_CELLS", 2000 * 150)
    got = {r["expr"]: r["score"] for r in rl.relation_scores(df, catalog, "row_no").collect()}
    assert len(got) == len(once) == len(rl.expressions(catalog)) and all(abs(got[k] - v) < 1e-6 for k, v in once.items())
    assert max(sizes) == 150 and len(sizes) == 1 - (-len(once) // 150)


def test_encoded_cells_are_made_once(spark, monkeypatch):
    """The tables of encoded columns come from written cells, not from the values again."""
    lines = spark.range(300).selectExpr("id div 5 as chunk_id", "'c' as col", "id as seq", "concat('a-', id % 3, '/', id) as value")
    columns = cl.encode_columns(lines)
    for df in (columns.cells, columns.fields, columns.words, columns.patterns):
        assert "Range" not in plan(df) and "Window" not in plan(df)
    assert sorted(map(tuple, cl.decode_columns(columns).collect())) == sorted(map(tuple, lines.collect()))


def test_tagged_lines_are_written_small_and_dropped(spark):
    """Encoded tables are compressed columns, and what they are made from is gone."""
    import os

    from logquarry.session import ensure_checkpoint_dir

    top = ensure_checkpoint_dir(spark).removeprefix("file:")
    lines = spark.range(2000).selectExpr("id div 100 as chunk_id", "id as line_no", "concat('some words of a long line that comes again ', id % 3, ' and more ', id) as line")
    raw = lines.selectExpr("sum(length(line))").first()[0]
    for encode, decode in ((lambda d: en.encode(tg.tag_lines(d)), rs.restore_lines), (nm.encode_numbers, nm.decode_numbers)):
        before = {d for d, _, _ in os.walk(top)}
        encoded = encode(lines)
        made = [f"{d}/{f}" for d, _, files in os.walk(top) if d not in before for f in files]
        assert made and all(f.endswith((".parquet", ".crc", "_SUCCESS")) for f in made)
        assert sum(map(os.path.getsize, made)) < raw and len({os.path.dirname(f) for f in made}) == 2
        assert sorted(map(tuple, decode(encoded).collect())) == sorted(map(tuple, lines.collect()))
