from pyspark.sql import functions as F

from logquarry.functions.presets import LOG_FORMATS
from logquarry.operators import encode as en
from logquarry.operators import profile as pf
from logquarry.operators import restore as rs
from logquarry.operators import tagging as tg
from logquarry.sources import formatted as fm
from logquarry.sources import lines as src
from logquarry.sources import tables as tb
from logquarry.streaming.encode import encode_stream
from logquarry.streaming.match import match_stream


def test_read_lines_and_newline_flag(spark, tmp_path):
    (tmp_path / "a.log").write_text("one\n\nthree")
    (tmp_path / "b.log").write_text("x\r\ny\n")
    got = src.read_lines(spark, str(tmp_path), chunk_lines=2)
    rows = {(r["source"][-5:], r["line_no"]): (r["chunk_id"], r["line"]) for r in got.collect()}
    assert rows[("a.log", 1)] == (0, "one") and rows[("a.log", 2)] == (0, "") and rows[("a.log", 3)] == (1, "three")
    assert rows[("b.log", 1)] == (0, "x\r")
    flags = {r["source"][-5:]: r["final_newline"] for r in src.final_newline_flags(spark, str(tmp_path)).collect()}
    assert flags == {"a.log": False, "b.log": True}


def test_formats(spark, lines):
    df = lines(["Jun 14 15:16:01 combo sshd(pam_unix)[19939]: failure; user=root", "bad"])
    fmt = fm.line_format(LOG_FORMATS["Linux"])
    r = fm.parse_format(df, fmt).collect()
    assert len(r) == 1 and (r[0]["Component"], r[0]["PID"], r[0]["Content"]) == ("sshd(pam_unix)", "19939", "failure; user=root")
    kept = fm.parse_format(df, fmt, "keep").orderBy("line_no").collect()
    assert kept[1]["Content"] == "bad" and kept[1]["Month"] == ""
    assert fm.loading_rate(df, fmt).first()["loading_rate"] == 0.5


def test_convert_lines(lines):
    df = lines(["k=v rest", "none"])
    got = src.convert_lines(df, r"(?<key>\w)=(\w)", "$2:$+{key}:$$:$9:${0}").collect()
    assert [r["line"] for r in got] == ["v:k:$::k=v rest"]


def test_continuations_cross_blocks(spark):
    rows = [("s", i // 2, i, t) for i, t in enumerate(["x", "H a", " b", " c", "H d", "H e", " f"])]
    df = spark.createDataFrame(rows, "source string, block long, line_no long, line string")
    got = src.join_continuations(df, "^H", ["source"], "line_no", "block").orderBy("record_no").collect()
    assert [r["record"] for r in got] == ["H a\n b\n c", "H d", "H e\n f"]
    short = src.join_continuations(df, "^H", ["source"], "line_no", "block", max_length=5)
    assert short.count() == 1


def test_structured_tables(spark, tmp_path):
    df = spark.createDataFrame([(1, "a <*>", ["x", "y"])], "LineId long, EventTemplate string, ParameterList array<string>")
    tb.write_structured(df, str(tmp_path / "s"))
    r = tb.read_structured(spark, str(tmp_path / "s")).first()
    assert (r["LineId"], r["ParameterList"]) == ("1", "['x', 'y']")
    rep = tb.template_report(df, "EventTemplate").first()
    assert len(rep["EventId"]) == 8 and rep["Occurrences"] == 1


def test_encoded_tables_round_trip(spark, lines, tmp_path):
    df = lines([f"job {i % 7} took 0.{i:03d}s" for i in range(50)])
    tb.write_encoded(en.encode(tg.tag_lines(df)), str(tmp_path / "e"))
    tb.encode_and_write(tg.tag_lines(df), str(tmp_path / "f"), "fast")
    for name in "ef":
        back = rs.restore_lines(tb.read_encoded(spark, str(tmp_path / name)))
        assert rs.line_difference(df, back, ["chunk_id", "line_no"]).count() == 0
    # tables that were read can be written again
    tb.write_encoded(tb.read_encoded(spark, str(tmp_path / "e")), str(tmp_path / "g"))
    copy = rs.restore_lines(tb.read_encoded(spark, str(tmp_path / "g")))
    assert rs.line_difference(df, copy, ["chunk_id", "line_no"]).count() == 0


def test_lines_in_order(spark, lines, tmp_path):
    texts = [f"line {i}" for i in range(500)]
    shuffled = lines(texts).orderBy(F.rand(1)).repartition(7)
    got = rs.in_order(shuffled).orderBy("position").collect()
    assert [(r["position"], r["line"]) for r in got] == list(enumerate(texts, 1))
    rs.write_text(shuffled, str(tmp_path / "log"))
    files = sorted(p for p in (tmp_path / "log").iterdir() if p.suffix == ".txt")
    assert "".join(p.read_text() for p in files) == "".join(t + "\n" for t in texts)
    assert rs.in_order(shuffled.where("false")).count() == 0


def test_result_rows(spark, tmp_path):
    row = spark.createDataFrame([("t", "s", 1, 10, 0.5, 1.0, "ok")], tb.DECOMPRESSION_RESULT)
    for _ in range(2):
        tb.append_result(row, str(tmp_path / "r"))
    assert spark.read.option("header", True).csv(str(tmp_path / "r")).count() == 2


def test_line_difference_of_uneven_files(lines):
    a, b = lines(["1", "2", "3"]), lines(["1", "2", "3", ""])
    assert rs.line_difference(a, b, ["line_no"]).count() == 0
    assert rs.line_difference(a, lines(["1", "2", "3", "4"]), ["line_no"]).count() == 1


def test_codec_sizes(lines):
    df = lines([f"line {i % 50} with the same words {i * i % 997}" for i in range(20_000)])
    got = {r["codec"]: r for r in pf.codec_report(pf.codec_sizes(df, ["chunk_id", "line_no"])).collect()}
    assert set(got) == {"none", "snappy", "gzip", "zstd"}
    assert {r["original_bytes"] for r in got.values()} == {df.selectExpr("sum(octet_length(line) + 1)").first()[0]}
    # a table without codec holds the length of each text besides
    assert got["zstd"]["encoded_bytes"] < got["snappy"]["encoded_bytes"] < got["none"]["encoded_bytes"]
    assert got["zstd"]["compression_ratio"] > 2 and 0.5 < got["zstd"]["space_savings"] < 1


def test_streams(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    texts = {k: [f"{k} value {i}{k} 12{i}" for i in range(5)] for k in range(3)}
    for k, t in texts.items():
        (source / f"{k}.txt").write_text("\n".join(t) + "\n")
    # equal lines of a batch stay apart
    (source / "0.txt").write_text("\n".join(texts[0] * 2 + ["user 5 in"] * 3) + "\n")
    text = spark.readStream.option("maxFilesPerTrigger", 1).text(str(source)).withColumnRenamed("value", "line")
    out = str(tmp_path / "out")
    encode_stream(text, out, str(tmp_path / "cp")).awaitTermination()
    stream = text.withColumn("line_no", F.xxhash64("line"))
    encoded = tb.read_encoded(spark, out)
    assert encoded.line_map.select("chunk_id").distinct().count() == 3
    got = sorted(r["line"] for r in rs.restore_lines(encoded).collect())
    assert got == sorted([x for t in texts.values() for x in t] + texts[0] + ["user 5 in"] * 3)
    small = str(tmp_path / "small")
    encode_stream(text, small, str(tmp_path / "cp3"), chunk_lines=4).awaitTermination()
    encoded_small = tb.read_encoded(spark, small)
    assert encoded_small.line_map.select("chunk_id").distinct().count() == 4 + 2 + 2
    assert sorted(r["line"] for r in rs.restore_lines(encoded_small).collect()) == got
    # each chunk is what the batch job makes of the same lines
    for row in encoded.line_map.groupBy("chunk_id").agg(F.collect_set("template_id").alias("t")).collect():
        assert row["t"] and min(row["t"]) == 1
    templates = spark.createDataFrame([(1, "0 value <*> <*>"), (2, "1 value <*> <*>")], "template_id long, template string")
    match_stream(stream, templates, str(tmp_path / "m"), str(tmp_path / "cp2"), ["line_no"]).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "m" / "matched")).count() == 15
    assert spark.read.parquet(str(tmp_path / "m" / "unmatched")).count() == 8
