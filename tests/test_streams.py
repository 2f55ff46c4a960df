"""Streams whose batches share chunks, and line numbers that move no line."""

import random

import pytest

from logquarry.operators import restore as rs
from logquarry.sources import lines as src
from logquarry.streaming import chunks as ch


def tables(spark, path):
    e = ch.read_filled(spark, path)
    return {name: sorted(map(str, df.collect())) for name, df in e.tables().items()}


def lines_of(spark, path):
    got = rs.restore_lines(ch.read_filled(spark, path)).collect()
    return [r["line"] for r in sorted(got, key=lambda r: (r["chunk_id"], r["line_no"]))]


def batch(spark, texts):
    return spark.createDataFrame([(t,) for t in texts], "line string")


def test_batches_fill_chunks_together(spark, tmp_path):
    texts = [f"user {i} in room {i % 7} at 12{i}" for i in range(23)]
    path = str(tmp_path)
    for k, (a, b) in enumerate([(0, 3), (3, 3), (3, 11), (11, 23)]):
        ch.append_batch(batch(spark, texts[a:b]), k, path, chunk_lines=5)
        assert lines_of(spark, path) == texts[:b]
    sizes = {r["chunk_id"]: r["n"] for r in ch.read_filled(spark, path).line_map.groupBy("chunk_id").count().withColumnRenamed("count", "n").collect()}
    assert sizes == {0: 5, 1: 5, 2: 5, 3: 5, 4: 3}


def test_a_batch_again_changes_nothing(spark, tmp_path):
    path = str(tmp_path)
    ch.append_batch(batch(spark, [f"a {i}" for i in range(7)]), 0, path, chunk_lines=4)
    ch.append_batch(batch(spark, [f"b {i}" for i in range(6)]), 1, path, chunk_lines=4)
    before = tables(spark, path)
    ch.append_batch(batch(spark, [f"b {i}" for i in range(6)]), 1, path, chunk_lines=4)
    assert tables(spark, path) == before and len(lines_of(spark, path)) == 13


def test_stream_of_small_files(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    for k in range(4):
        (source / f"{k}.txt").write_text("".join(f"file {k} line {i}\n" for i in range(3)))
    text = spark.readStream.option("maxFilesPerTrigger", 1).text(str(source)).withColumnRenamed("value", "line")
    out = str(tmp_path / "out")
    ch.encode_stream_filled(text, out, str(tmp_path / "cp"), chunk_lines=5).awaitTermination()
    assert sorted(lines_of(spark, out)) == sorted(f"file {k} line {i}" for k in range(4) for i in range(3))
    assert ch.read_filled(spark, out).line_map.select("chunk_id").distinct().count() == 3
    # more files later: the open chunk is filled up
    (source / "9.txt").write_text("late 1\nlate 2\nlate 3\n")
    ch.encode_stream_filled(text, out, str(tmp_path / "cp"), chunk_lines=5).awaitTermination()
    assert lines_of(spark, out)[12:] == ["late 1", "late 2", "late 3"]
    assert ch.read_filled(spark, out).line_map.select("chunk_id").distinct().count() == 3


def test_nothing_written_yet(spark, tmp_path):
    assert rs.restore_lines(ch.read_filled(spark, str(tmp_path / "none"))).collect() == []


@pytest.mark.parametrize("bytes_in_split", ["200", "10000"])
def test_line_numbers_without_moving_lines(spark, tmp_path, bytes_in_split):
    rng = random.Random(1)
    want = {}
    for name in "abc":
        texts = ["x" * rng.randrange(60) for _ in range(rng.randrange(1, 80))] + ["end"]
        (tmp_path / f"{name}.log").write_text("\n".join(texts) + ("\n" if name != "b" else ""))
        want |= {(name, i): t for i, t in enumerate(texts, 1)}
    conf = {"spark.sql.files.maxPartitionBytes": bytes_in_split, "spark.sql.files.openCostInBytes": "10"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        df = src.read_lines(spark, str(tmp_path / "*.log"), chunk_lines=10)
        rows = df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert {(r["source"][-5], r["line_no"]): r["line"] for r in rows} == want
    assert all(r["chunk_id"] == (r["line_no"] - 1) // 10 for r in rows)
    # lines are joined in place: their side of the join has no exchange
    lines_side = plan[: plan.index("BroadcastExchange")] if "BroadcastExchange" in plan else plan
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in lines_side
