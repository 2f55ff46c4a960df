import pytest
from pyspark.sql import functions as F

from logquarry.functions.presets import TAG_PATTERNS
from logquarry.operators import encode as en
from logquarry.operators import restore as rs
from logquarry.operators import tagging as tg

PATTERNS = [("<I>", r"(\d+)\.(\d+)\.(\d+)\.(\d+)"), ("<T>", r"\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}")]

CASES = [
    ("server started", "server started"),
    ("code 7 of 42", "code <LEN=1> of <LEN=2>"),
    ("pid 12345 ok", r"pid <IDX=2|CTX=pid|STR=\d{5}> ok"),
    ("id 0007", r"id <IDX=2|CTX=id|STR=\d{4}>"),
    ("load 12.5 done", r"load <CTX=load|STR=\d{2}\.\d{1}> done"),
    ("from 10.0.0.1 x 999", r"from <I> x <IDX=3|CTX=x|STR=\d{3}>"),
    ("pre10.0.0.1:80 abc 12345 zz-1", r"pre<I>:<LEN=2> abc <IDX=4|CTX=abc|STR=\d{5}> <CTX=abc|STR=_->"),
    ("at <init> and <za>", "at <init> and <za>"),
    ("", ""),
    ("größe ok 123", r"<STR=_> ok <IDX=3|CTX=ok|STR=\d{3}>"),
    ("a=b;c  \t x", "a=b;c  \t x"),
    ("10.0.0.1 1234", r"<I> <IDX=1|CTX=<I>|STR=\d{4}>"),
    ("v 123,456,7890", r"v <IDX=2|CTX=v|STR=\d{3}>,<IDX=3|CTX=v|STR=\d{3}>,<IDX=4|CTX=v|STR=\d{4}>"),
]


def test_hand_cases(lines):
    t = tg.tag_lines(lines([c[0] for c in CASES]), PATTERNS)
    got = t.orderBy("line_no").select(tg.parts_template(F.col("parts"))).collect()
    assert [r[0] for r in got] == [c[1] for c in CASES]


def test_long_line_numbers_agree_with_short_rule(lines):
    # more variables than the short-line rule covers, with runs that carry the context on
    text = " ".join(f"w{'x' * (i % 3)} {1000 + i},{2000 + i}" for i in range(80)) + " end 5555"
    t = tg.tag_lines(lines([text]))
    tags = t.select("parts.tags").first()[0]
    tokens = [x for x in text.replace(",", " ").split(" ") if x]
    want = []
    ctx = ""
    for i, tok in enumerate(tokens, 1):
        if tok.isdigit():
            c = f"CTX={ctx}|" if ctx else ""
            want.append(f"<IDX={i}|{c}STR=\\d{{{len(tok)}}}>")
        else:
            ctx = tok
    assert tags == want


def test_threshold_is_strict(lines):
    texts = ["a 12345"] * 3 + ["b 12345"] * 4
    kept = tg.apply_threshold(tg.tag_lines(lines(texts)), 3)
    got = {r[0] for r in kept.select(tg.parts_template(F.col("parts"))).collect()}
    assert got == {"a 12345", r"b <IDX=2|CTX=b|STR=\d{5}>"}


def test_json(lines):
    texts = ['{"a": {"b": 1}, "m": "x y 123", "e": "", "n": null}', "nope", '{"T":"007","q":"say \\"hi\\" 5"}']
    t = tg.tag_json_lines(lines(texts))
    got = [r[0] for r in t.orderBy("line_no").select(tg.parts_template(F.col("parts"))).collect()]
    assert got[0] == r'{"a": <json:a>, "m": "x y <IDX=3|CTX=y|STR=\d{3}>", "e": "<json:e>", "n": <json:n>}'
    assert got[1] == "nope"
    whole = t.select("line", tg.template_text(F.col("parts.statics"), F.col("parts.vars")).alias("b"))
    assert whole.filter("line <> b").count() == 0


def test_parse_tag(spark):
    df = spark.createDataFrame([(r"<IDX=2|CTX=pid|STR=\d{5}>",), ("<LEN=2>",), ("<STR=_|x>",)], "t string")
    got = [r[0] for r in df.select(tg.parse_tag(F.col("t"))).collect()]
    assert got == [{"IDX": "2", "CTX": "pid", "STR": r"\d{5}"}, {"LEN": "2"}, {"STR": "_|x"}]


ROUND_TRIP = [c[0] for c in CASES] + [
    "pid 00345 ok", "from 010.0.0.1 x", "from 1234.1.1.1", "t 2024-01-02 00:00:00", "t 2024-01-01 10:00:00",
    "n 1234567890123456789 12345678901234567890", "$a 1$2", "09:00:00,123", "back\\slash 1", "",
]


@pytest.mark.parametrize("mode", ["normal", "fast"])
def test_round_trip(lines, mode):
    df = lines(ROUND_TRIP)
    restored = rs.restore_lines(en.encode(tg.tag_lines(df, PATTERNS), mode))
    assert restored.count() == len(ROUND_TRIP)
    assert rs.line_difference(df, restored, ["chunk_id", "line_no"]).count() == 0


@pytest.mark.parametrize("dataset", ["HDFS", "OpenSSH", "BGL"])
def test_round_trip_presets(lines, dataset):
    texts = [
        "2005-06-03-15.42.50.675872 R02 core.2275 2005.06.03 generating",
        "Dec 10 06:55:46 sshd[24200]: from 173.234.31.186 port 38926 1.2.3.4.5",
        "081109 203615 148 INFO dfs: block blk_-38865049064139660 of 10.250.19.102:50010",
    ]
    df = lines(texts)
    restored = rs.restore_lines(en.encode(tg.tag_lines(df, TAG_PATTERNS[dataset])))
    assert rs.line_difference(df, restored, ["chunk_id", "line_no"]).count() == 0


def test_handlers(lines):
    texts = [f"level=0x{i:04x}" for i in range(5)]
    encode = lambda v: F.conv(F.substring(v, 3, 9), 16, 10)
    decode = lambda v: F.concat(F.lit("0x"), F.lpad(F.lower(F.conv(v, 10, 16)), 4, "0"))
    handlers = tg.handler_registry(H=(encode, decode))
    df = lines(texts)
    e = en.encode(tg.tag_lines(df, [("<H>", "0x[0-9a-f]+")]), "normal", handlers)
    assert e.tags.filter("tag = '<H>'").first()["storage_type"] == en.DELTA
    assert rs.line_difference(df, rs.restore_lines(e, handlers), ["chunk_id", "line_no"]).count() == 0


def test_storage_rules(spark, lines):
    def kind(values):
        rows = [(0, "<LEN=3>", i, 1, v) for i, v in enumerate(values)]
        df = spark.createDataFrame(rows, "chunk_id long, tag string, line_no long, var_no long, value string")
        return en.tag_table(en.encode_values(df)).first()["storage_type"]

    assert kind(["5"] * 5) == en.ALLSAME
    assert kind(["ab"] * 5) == en.MAPPING
    mixed = [str(10 ** (i % 3)) for i in range(101)]
    assert kind(mixed) == en.NODELTA
    assert kind(mixed[:100]) == en.DELTA
    assert kind(["1", "1234567890123456789"]) == en.MAPPING


def test_chunks_are_independent(spark, lines):
    a, b = lines(["x 1", "y 2"]), lines(["y 3", "x 4"], chunk=1)
    e = en.encode(tg.tag_lines(a.union(b)))
    got = {(r["chunk_id"], r["line_no"]): r["template_id"] for r in e.line_map.collect()}
    assert got == {(0, 0): 1, (0, 1): 2, (1, 0): 1, (1, 1): 2}


def test_literal_placeholder_is_another_template(lines):
    df = tg.tag_lines(lines(["at <T> x", "at 10:20 x", "at 11:30 x"]), [("<T>", r"\d{2}:\d{2}")])
    got = [(r["template"], r["n"]) for r in tg.template_counts(df, n=F.count(F.lit(1))).collect()]
    assert sorted(got) == [("at <T> x", 1), ("at <T> x", 2)]


def test_record_length_is_measured_first(spark):
    from logquarry.sources.lines import join_continuations

    rows = [("a", 0, i, t) for i, t in enumerate(["# one", "x", "# two", "yyyy", "zzzz"])]
    df = spark.createDataFrame(rows, "source string, block int, seq int, line string")
    got = join_continuations(df, "^#", ["source"], "seq", "block", max_length=7)
    assert [r["record"] for r in got.collect()] == ["# one\nx"]


@pytest.mark.parametrize("depth", [1, 5, 30, 99])
def test_json_depth(lines, depth):
    deep = '{"k": ' * depth + "1" + "}" * depth
    row = tg.tag_json_lines(lines(['{"a":%s,"z":5,"l":%s}' % (deep, "[" * depth + "]" * depth)])).first()
    assert row["parts"]["tags"] == ["<json:a>", "<json:z>", "<json:l>"]
    assert row["parts"]["vars"] == [deep, "5", "[" * depth + "]" * depth]


def _json_parts(spark, texts):
    df = spark.createDataFrame([(0, i, t) for i, t in enumerate(texts)], "chunk_id long, line_no long, line string")
    return [r["parts"] for r in tg.tag_json_lines(df).orderBy("line_no").collect()]


def test_json_of_any_depth(spark):
    deep = '{"a": ' + '{"b": [' * 500 + "1" + "]}" * 500 + ', "c": 2}'
    mixed = '{"a": {"b": "}]{"}, "d": [1, {"e": "x\\"y"}], "f": "g h"}'
    broken = '{"a": {"b": 1, "c": [2}'
    parts = _json_parts(spark, [deep, mixed, broken, "[1]", "", '{"k" : bare, "n": "one"}'])
    assert parts[0]["tags"] == ["<json:a>", "<json:c>"] and parts[0]["vars"][1] == "2"
    assert parts[1]["vars"][:2] == ['{"b": "}]{"}', '[1, {"e": "x\\"y"}]']
    assert parts[2]["vars"] == ["1", "[2}"] and parts[3]["vars"] == []
    assert parts[5]["tags"] == ["<json:k>", "<json:n>"]
    for text, p in zip([deep, mixed, broken], parts):
        assert "".join(s + v for s, v in zip(p["statics"], p["vars"] + [""])) == text


def test_unclosed_json_does_not_stall():
    import time

    start = time.process_time()
    tg.json_members('{"a":' * 20_000)
    tg.json_members('{"' * 40_000)
    assert time.process_time() - start < 3


def test_many_rare_tags(spark):
    # a tag for each word, and one that is frequent
    rows = [(0, i, f"w{i}x= {i % 10}abc 1.5 end") for i in range(3000)] + [(1, i, "1.5 1.5") for i in range(2)]
    df = spark.createDataFrame(rows, "chunk_id long, line_no long, line string")
    tagged = tg.tag_lines(df)
    counts = {(r["chunk_id"], r["tag"]): r["n"] for r in tg.tag_counts(tagged).collect()}
    kept = tg.apply_threshold(tagged, 100)
    before = {(r["chunk_id"], r["line_no"]): r["parts"] for r in tagged.collect()}
    for r in kept.collect():
        p, old = r["parts"], before[r["chunk_id"], r["line_no"]]
        assert p["tags"] == [t for t in old["tags"] if counts[r["chunk_id"], t] > 100]
        assert "".join(s + v for s, v in zip(p["statics"], p["vars"] + [""])) == r["line"]
