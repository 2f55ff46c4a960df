"""Logs and columns come back from their encoded parts."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from logquarry.operators import columns as cl
from logquarry.operators import logparts as lp
from logquarry.operators import numbers as nm

FORMAT = r"<Date> \[<Level>\] <line>: <Content>"
TEMPLATES = [(1, "user <*> came"), (2, "no variable"), (3, "<*> <*> <*>"), (4, "load id=<*> done")]


def parts_of(spark, texts, fmt=FORMAT, chunk=lambda i: i // 6):
    lines = spark.createDataFrame([(chunk(i), i, t) for i, t in enumerate(texts)], "chunk_id long, line_no long, line string")
    return lp.split_log(lines, fmt, spark.createDataFrame(TEMPLATES, "template_id long, template string"))


def test_three_kinds_of_lines(spark):
    texts = [
        "10-1 [INFO] a: user 7 came", "10-1 [INFO] a: user 7 came", "10-02 [WARN] b: no variable", "no header at all",
        "10-3 [INFO]  a: user 8 came", "10-3 [INFO] a: user 8  came", "10-3 [INFO] a: x y z", "10-3 [INFO] a: ", "", None,
        "10-4 [INFO] a: user <*> came", "10-4 [INFO] a: user $1 came", "10-4 [INFO] a: load id=5 done", "10-5 [INFO] a: one two three four five",
    ]
    parts = parts_of(spark, texts)
    got = {r["line_no"]: r["line"] for r in lp.rebuild_log(parts).collect()}
    assert got == {i: t or "" for i, t in enumerate(texts)}
    events = {r["line_no"]: r["event"] for r in parts.events.collect()}
    assert [events[i] for i in range(len(texts))] == [1, 1, 2, -1, -1, 0, 3, 0, -1, -1, 1, 1, 3, 0]
    assert [r["line"] for r in parts.unmatched.where("chunk_id = 0").orderBy("k").collect()] == [texts[5]]
    # a side table knows its order only
    assert "line_no" not in parts.sides.columns


def test_rebuild_reads_parts_only(spark):
    parts = parts_of(spark, ["10-1 [INFO] a: user 7 came", "10-1 [INFO] a: user 8 came"])
    other = parts.templates.withColumn("template", F.regexp_replace("template", "came", "went"))
    changed = lp.LogParts(parts.events, parts.headers, parts.variables, other, parts.sides, parts.format)
    assert sorted(r["line"] for r in lp.rebuild_log(changed).collect()) == ["10-1 [INFO] a: user 7 went", "10-1 [INFO] a: user 8 went"]


@pytest.mark.parametrize("texts", [[], ["only text"], ["10-1 [INFO] a: no variable"]])
def test_parts_that_are_empty(spark, texts):
    assert [r["line"] for r in lp.rebuild_log(parts_of(spark, texts)).collect()] == texts


def test_format_without_a_single_text():
    with pytest.raises(ValueError):
        lp.format_pieces(r"<A>(\[<B>\])?: <Content>")
    assert lp.format_pieces(r"<A>\|<Content>") == ["", "A", "|", "Content", ""]


VALUES = {
    "steps": [str(100 + 3 * i) for i in range(40)],
    "padded": [f"{i % 12 + 1:02d}-{i:03d}" for i in range(40)],
    "words": [["red", "green"][i % 2] for i in range(40)],
    "runs": [["aa", "bb", "cc"][i // 14] for i in range(40)],
    "free": [f"w{i * 7919 % 97}x{i}" for i in range(40)],
    "mixed": [["1-2_3", "4-5", "x--y"][i % 3] for i in range(40)],
    "signs": [["-5", "007", "", "10", "9" * 30][i % 5] for i in range(40)],
    "negative": [str(i * i - 200) for i in range(40)],
    "odd": [["é/ü", "a/b/c", "/", "//"][i % 4] for i in range(40)],
}


def columns(spark, values):
    rows = [(i // 25, c, i, v) for c, vs in values.items() for i, v in enumerate(vs)]
    return spark.createDataFrame(rows, "chunk_id long, col string, seq long, value string")


def test_columns_come_back(spark):
    table = columns(spark, VALUES)
    encoded = cl.encode_columns(table)
    got = {(r["col"], r["seq"]): r["value"] for r in cl.decode_columns(encoded).collect()}
    assert got == {(c, i): v for c, vs in VALUES.items() for i, v in enumerate(vs)}
    forms = {(r["col"], r["field"]): r["form"] for r in encoded.fields.where("chunk_id = 0").collect()}
    assert forms["steps", 0] == cl.DELTA and forms["padded", 1] == cl.DELTA and forms["free", 0] == cl.TEXT
    assert {cl.DELTA, cl.TEXT, cl.DICT_DELTA} <= set(forms.values())
    patterns = {r["col"]: r["pattern"] for r in encoded.patterns.where("chunk_id = 0").collect()}
    assert patterns["mixed"] == "-" and patterns["odd"] == "/" and patterns["steps"] == ""


def test_dictionary_without_steps(spark):
    # ids jump more than they stay, so their steps cost more
    words = [f"w{i}x" for i in [0, 1, 2, 0, 2, 1, 2, 0, 1, 0, 2, 0, 1, 2, 1, 0, 0, 0, 1, 2, 0, 2, 0, 2]]
    encoded = cl.encode_columns(columns(spark, {"c": words}))
    assert {r["form"] for r in encoded.fields.collect()} <= {cl.DICT, cl.DICT_DELTA}
    assert encoded.words.where("chunk_id = 0").count() == 3
    got = sorted((r["seq"], r["value"]) for r in cl.decode_columns(encoded).collect())
    assert got == list(enumerate(words))


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="a1-_/0é ", max_size=8), min_size=1, max_size=30))
def test_any_column_comes_back(spark, values):
    got = cl.decode_columns(cl.encode_columns(columns(spark, {"c": values}))).collect()
    assert sorted((r["seq"], r["value"]) for r in got) == list(enumerate(values))


def test_lines_from_number_groups(spark, lines):
    texts = [
        "user 7 at 10.0.0.1 id=0007", "user 12 at 10.0.0.12 id=0012", "", None, "<a> 5 <*> <ab> 1234", "x" + "1" * 14 + "y", "x" + "1" * 15 + "y",
        "9" * 40, "1,2,3,22,33,4444", "no digits", "10.0.0.1", "010.0.0.1 1", "a1b22c333d4444", "$1 \\2 ${3}", "é5ü 77", "0 00 000 0000",
    ]
    table = lines(texts[:8]).union(lines(texts[8:], 1))
    log = nm.encode_numbers(table, [("<I>", r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?![\d.])")], [" ", ","])
    got = {(r["chunk_id"], r["line_no"]): r["line"] for r in nm.decode_numbers(log).collect()}
    assert got == {(i // 8, i % 8): t or "" for i, t in enumerate(texts)}
    assert "line_no" not in log.numbers.columns and "line_no" not in log.words.columns
    groups = {r["grp"] for r in log.numbers.collect()}
    assert {"<I>", "<a>", "<b>", "<da>", "<db>", "<nb>"} <= groups
    assert {r["text"] for r in log.dictionary.where("grp = '<*>'").collect()} == {"x" + "1" * 15 + "y", "9" * 40}


def test_number_groups_of_nothing(spark, lines):
    empty = lines(["x"]).where("false")
    assert nm.decode_numbers(nm.encode_numbers(empty)).collect() == []


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="ab01 9,-<>*é$\\", max_size=24), min_size=1, max_size=12))
def test_any_line_comes_back_from_number_groups(spark, lines, texts):
    log = nm.encode_numbers(lines(texts), [("<D>", "0+1+")], [" ", "-"])
    assert sorted((r["line_no"], r["line"]) for r in nm.decode_numbers(log).collect()) == list(enumerate(texts))
