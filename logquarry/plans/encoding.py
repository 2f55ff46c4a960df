"""Storage decisions, deltas, dictionaries and the round trip."""

from __future__ import annotations

from pyspark.sql import functions as F

from logquarry.functions import tokens as tk
from logquarry.operators import encode as en
from logquarry.operators import profile as pf
from logquarry.operators import restore as rs
from logquarry.operators import tagging as tg
from logquarry.plans import inputs as inp
from logquarry.plans.registry import query, with_

EVENT_VALUES = (
    inp.EVENT_LINES,
    inp.pieces_sql("event_lines", inp.TIME_PATTERN),
    r"""vals AS (SELECT chunk_id, tag, line_no, var_no, value,
  CASE WHEN regexp_matches(value, '[0-9]') AND NOT regexp_matches(value, '[A-Za-z<>]') THEN regexp_replace(value, '[^0-9]', '', 'g') ELSE value END AS stored
  FROM pieces_vars)""",
    r"""stats AS (SELECT chunk_id, tag, count(*) AS n, count(DISTINCT stored) AS n_distinct, min(length(stored)) AS min_len, max(length(stored)) AS max_len,
  bool_and(regexp_full_match(stored, '[0-9]{1,18}')) AS num, count(DISTINCT length(CAST(TRY_CAST(stored AS BIGINT) AS VARCHAR))) AS n_len
  FROM vals GROUP BY chunk_id, tag)""",
    """kinds AS (SELECT *, CASE WHEN NOT num THEN 'MAPPING' WHEN n_distinct = 1 THEN 'ALLSAME'
  WHEN n > 100 AND n_len >= 3 THEN 'NUMERIC_NODELTA' ELSE 'NUMERIC_DELTA' END AS storage_type FROM stats)""",
)


def tagged_events(spark, sf):
    return tg.tag_lines(inp.event_lines(spark, sf), inp.EVENT_PATTERNS)


def event_values(spark, sf, mode="normal"):
    lines = en.dealt(inp.event_lines(spark, sf))
    return en.encode_values(tg.variable_rows(tg.tag_lines(lines, inp.EVENT_PATTERNS)), mode)


@query(
    "storage_types",
    with_(*EVENT_VALUES, select="SELECT chunk_id, tag, storage_type, n, n_distinct, min_len, max_len FROM kinds"),
)
def storage_types(spark, sf):
    return en.tag_table(event_values(spark, sf)).select(
        "chunk_id", "tag", "storage_type", "n", "n_distinct", "min_len", "max_len"
    )


@query(
    "storage_types_fast",
    with_(*EVENT_VALUES, select="SELECT chunk_id, tag, 'MAPPING' AS storage_type, count(*) AS n, count(DISTINCT value) AS n_distinct FROM vals GROUP BY chunk_id, tag"),
)
def storage_types_fast(spark, sf):
    return en.tag_table(event_values(spark, sf, "fast")).select("chunk_id", "tag", "storage_type", "n", "n_distinct")


@query(
    "delta_values",
    with_(
        *EVENT_VALUES,
        """d AS (SELECT v.chunk_id, v.tag, v.line_no, v.var_no, storage_type, CAST(stored AS BIGINT) AS x
  FROM vals v JOIN kinds k ON v.chunk_id = k.chunk_id AND v.tag = k.tag WHERE storage_type <> 'MAPPING')""",
        select="""SELECT chunk_id, tag, line_no, var_no, CASE WHEN storage_type = 'NUMERIC_DELTA'
  THEN x - coalesce(lag(x) OVER (PARTITION BY chunk_id, tag ORDER BY line_no, var_no), 0) ELSE x END AS num FROM d""",
    ),
)
def delta_values(spark, sf):
    return event_values(spark, sf).filter("num is not null").select("chunk_id", "tag", "line_no", "var_no", "num")


@query(
    "dictionary",
    with_(
        *EVENT_VALUES,
        "f AS (SELECT chunk_id, tag, value, count(*) AS n, min(line_no * 1000 + var_no) AS first_at FROM vals GROUP BY chunk_id, tag, value)",
        select="SELECT chunk_id, tag, row_number() OVER (PARTITION BY chunk_id, tag ORDER BY first_at) AS dict_id, value, n FROM f",
    ),
)
def dictionary(spark, sf):
    return en.dictionary_table(event_values(spark, sf, "fast"))


VARINT = "greatest(1, ceil(length(ltrim(bin(CASE WHEN {0} >= 0 THEN 2 * {0} ELSE -2 * {0} - 1 END), '0')) / 7.0))"


@query(
    "encoded_bytes",
    with_(
        *EVENT_VALUES,
        """f AS (SELECT v.*, storage_type, min(line_no * 1000 + var_no) OVER (PARTITION BY v.chunk_id, v.tag, stored) AS first_at
  FROM vals v JOIN kinds k ON v.chunk_id = k.chunk_id AND v.tag = k.tag)""",
        """e AS (SELECT chunk_id, tag, storage_type, CASE WHEN storage_type = 'MAPPING' THEN dense_rank() OVER (PARTITION BY chunk_id, tag ORDER BY first_at)
  WHEN storage_type = 'NUMERIC_DELTA' THEN TRY_CAST(stored AS BIGINT) - coalesce(lag(TRY_CAST(stored AS BIGINT)) OVER (PARTITION BY chunk_id, tag ORDER BY line_no, var_no), 0)
  ELSE TRY_CAST(stored AS BIGINT) END AS x FROM f)""",
        select=f"""SELECT tag, storage_type, count(DISTINCT chunk_id) AS n_chunks, CAST(sum({VARINT.format('x')}) AS BIGINT) AS id_bytes
FROM e GROUP BY tag, storage_type""",
    ),
)
def encoded_bytes(spark, sf):
    return en.tag_table(event_values(spark, sf)).groupBy("tag", "storage_type").agg(
        F.count(F.lit(1)).alias("n_chunks"), F.sum("id_bytes").alias("id_bytes")
    )


@query(
    "template_ids",
    with_(
        inp.DOC_LINES,
        inp.pieces_sql("doc_lines"),
        "t AS (SELECT chunk_id, line_no, string_agg(CASE WHEN tag = '' THEN text ELSE tag END, '' ORDER BY pos) AS template FROM pieces GROUP BY chunk_id, line_no)",
        "f AS (SELECT chunk_id, line_no, min(line_no) OVER (PARTITION BY chunk_id, template) AS first FROM t)",
        select="""SELECT chunk_id, line_no, dense_rank() OVER (PARTITION BY chunk_id ORDER BY first) AS template_id FROM f
UNION ALL SELECT chunk_id, line_no, 0 FROM doc_lines WHERE line = ''""",
    ),
)
def template_ids(spark, sf):
    tagged = tg.tag_lines(inp.doc_lines(spark, sf))
    return en.number_templates(tagged.select("chunk_id", "line_no", "parts")).select(
        "chunk_id", "line_no", "template_id"
    )


@query("round_trip", with_(inp.EVENT_LINES, select="SELECT chunk_id, line_no, line FROM event_lines"))
def round_trip(spark, sf):
    return rs.restore_lines(en.encode(tagged_events(spark, sf)))


@query("round_trip_documents", with_(inp.DOC_LINES, select="SELECT chunk_id, line_no, line FROM doc_lines"))
def round_trip_documents(spark, sf):
    return rs.restore_lines(en.encode(tg.tag_lines(inp.doc_lines(spark, sf))))


@query(
    "restored_order",
    with_(inp.ORDER_LINES, select="SELECT row_number() OVER (ORDER BY chunk_id, line_no) AS position, line FROM order_lines"),
)
def restored_order(spark, sf):
    encoded = en.encode(tg.tag_lines(inp.order_lines(spark, sf), inp.EVENT_PATTERNS))
    return rs.in_order(rs.restore_lines(encoded)).select("position", "line")


@query("round_trip_json", with_(inp.EVENT_JSON, select="SELECT chunk_id, line_no, line FROM event_json"))
def round_trip_json(spark, sf):
    return rs.restore_lines(en.encode(tg.tag_json_lines(inp.event_json(spark, sf))))


@query(
    "round_trip_digest",
    with_(
        inp.EVENT_LINES,
        "h AS (SELECT chunk_id, sha256(chunk_id || chr(10) || line_no || chr(10) || line) AS h FROM event_lines)",
        select="""SELECT chunk_id, count(*) AS n_lines, CAST(sum(CAST(('0x' || h[1:12]) AS BIGINT)) AS VARCHAR) AS digest_a,
  CAST(sum(CAST(('0x' || h[13:24]) AS BIGINT)) AS VARCHAR) AS digest_b FROM h GROUP BY chunk_id""",
    ),
)
def round_trip_digest(spark, sf):
    restored = rs.restore_lines(en.encode(tagged_events(spark, sf)))
    return rs.chunk_digest(restored, ["chunk_id", "line_no"])


def _revised(lines):
    """The lines with one event type spelt differently."""
    return lines.withColumn("line", F.regexp_replace("line", " ERROR ", " FAULT "))


REVISED = "revised AS (SELECT chunk_id, line_no, replace(line, ' ERROR ', ' FAULT ') AS line FROM event_lines WHERE line NOT LIKE '% VIEW %')"


@query(
    "line_diff",
    with_(
        inp.EVENT_LINES,
        REVISED,
        select="""SELECT coalesce(a.chunk_id, b.chunk_id) AS chunk_id, coalesce(a.line_no, b.line_no) AS line_no,
  coalesce(a.line, '') AS left_line, coalesce(b.line, '') AS right_line
FROM event_lines a FULL JOIN revised b ON a.chunk_id = b.chunk_id AND a.line_no = b.line_no WHERE coalesce(a.line, '') <> coalesce(b.line, '')""",
    ),
)
def line_diff(spark, sf):
    a = inp.event_lines(spark, sf)
    b = _revised(inp.event_lines(spark, sf)).filter(~F.col("line").contains(" VIEW "))
    return rs.line_difference(a, b, ["chunk_id", "line_no"])


@query(
    "first_line_diffs",
    with_(
        inp.EVENT_LINES,
        REVISED,
        select="""SELECT a.chunk_id, a.line_no, a.line AS left_line, coalesce(b.line, '') AS right_line
FROM event_lines a LEFT JOIN revised b ON a.chunk_id = b.chunk_id AND a.line_no = b.line_no WHERE a.line <> coalesce(b.line, '')
ORDER BY a.chunk_id, a.line_no LIMIT 10""",
    ),
)
def first_line_diffs(spark, sf):
    return rs.first_differences(line_diff(spark, sf), ["chunk_id", "line_no"], 10)


@query(
    "line_similarity",
    with_(
        inp.EVENT_LINES,
        REVISED,
        select="""SELECT count(*) AS n_lines, round(avg(1 - levenshtein(a.line, b.line) / greatest(length(a.line), length(b.line))), 6) AS mean_similarity
FROM event_lines a JOIN revised b ON a.chunk_id = b.chunk_id AND a.line_no = b.line_no""",
    ),
)
def line_similarity(spark, sf):
    a = inp.event_lines(spark, sf)
    b = _revised(inp.event_lines(spark, sf)).filter(~F.col("line").contains(" VIEW "))
    return rs.line_similarity(a, b, ["chunk_id", "line_no"]).withColumn(
        "mean_similarity", F.round("mean_similarity", 6)
    )


@query(
    "delta_decode",
    "SELECT event_id // 1000 AS chunk_id, event_id, CAST(user_id AS BIGINT) AS user_id FROM events",
)
def delta_decode(spark, sf):
    e = inp.table(spark, sf, "events").select(F.expr("event_id div 1000").alias("chunk_id"), "event_id", "user_id")
    d = en.delta(e, "user_id", ["chunk_id"], ["event_id"]).drop("user_id")
    return en.undelta(d, "delta", ["chunk_id"], ["event_id"], "user_id").drop("delta")


@query(
    "varint_sizes",
    f"SELECT {VARINT.format('(l_partkey - l_suppkey)')}::BIGINT AS n_bytes, count(*) AS n FROM lineitem GROUP BY 1",
)
def varint_sizes(spark, sf):
    li = inp.table(spark, sf, "lineitem")
    return li.groupBy(tk.varint_size(F.col("l_partkey") - F.col("l_suppkey")).alias("n_bytes")).agg(
        F.count(F.lit(1)).alias("n")
    )


@query(
    "fixed_width_numbers",
    "SELECT c_custkey, lpad(CAST(c_nationkey AS VARCHAR), 4, '0') AS padded FROM customer",
)
def fixed_width_numbers(spark, sf):
    return inp.table(spark, sf, "customer").select("c_custkey", tk.left_pad(F.col("c_nationkey"), 4).alias("padded"))


@query(
    "ipv4_round_trip",
    """SELECT s_suppkey, '10.' || (s_suppkey // 256) % 256 || '.' || s_suppkey % 256 || '.' || s_nationkey AS address,
  lpad('10', 3, '0') || lpad(CAST((s_suppkey // 256) % 256 AS VARCHAR), 3, '0') || lpad(CAST(s_suppkey % 256 AS VARCHAR), 3, '0') || lpad(CAST(s_nationkey AS VARCHAR), 3, '0') AS digits FROM supplier""",
)
def ipv4_round_trip(spark, sf):
    key = F.col("s_suppkey")
    address = F.concat_ws(
        ".", F.lit("10"), (F.expr("s_suppkey div 256") % 256).cast("string"), (key % 256).cast("string"), F.col("s_nationkey").cast("string")
    )
    digits = tk.ipv4_number(address)
    return inp.table(spark, sf, "supplier").select("s_suppkey", tk.ipv4_text(digits).alias("address"), digits.alias("digits"))


@query(
    "size_report",
    with_(
        *EVENT_VALUES,
        """f AS (SELECT v.*, storage_type, min(line_no * 1000 + var_no) OVER (PARTITION BY v.chunk_id, v.tag, stored) AS first_at
  FROM vals v JOIN kinds k ON v.chunk_id = k.chunk_id AND v.tag = k.tag)""",
        """e AS (SELECT chunk_id, CASE WHEN storage_type = 'MAPPING' THEN dense_rank() OVER (PARTITION BY chunk_id, tag ORDER BY first_at)
  WHEN storage_type = 'NUMERIC_DELTA' THEN TRY_CAST(stored AS BIGINT) - coalesce(lag(TRY_CAST(stored AS BIGINT)) OVER (PARTITION BY chunk_id, tag ORDER BY line_no, var_no), 0)
  ELSE TRY_CAST(stored AS BIGINT) END AS x FROM f)""",
        "t AS (SELECT chunk_id, line_no, string_agg(CASE WHEN tag = '' THEN text ELSE tag END, '' ORDER BY pos) AS template FROM pieces GROUP BY chunk_id, line_no)",
        "tf AS (SELECT chunk_id, line_no, template, min(line_no) OVER (PARTITION BY chunk_id, template) AS first FROM t)",
        "ti AS (SELECT chunk_id, dense_rank() OVER (PARTITION BY chunk_id ORDER BY first) AS x FROM tf)",
        f"""b AS (SELECT chunk_id, {VARINT.format('x')} AS s FROM e UNION ALL SELECT chunk_id, {VARINT.format('x')} FROM ti
  UNION ALL SELECT chunk_id, strlen(stored) + 1 FROM (SELECT DISTINCT chunk_id, tag, stored FROM f WHERE storage_type = 'MAPPING')
  UNION ALL SELECT chunk_id, strlen(template) + 1 FROM (SELECT DISTINCT chunk_id, template FROM t))""",
        "en AS (SELECT chunk_id, CAST(sum(s) AS BIGINT) AS encoded_bytes FROM b GROUP BY chunk_id)",
        "og AS (SELECT chunk_id, CAST(sum(strlen(line) + 1) AS BIGINT) AS original_bytes FROM event_lines GROUP BY chunk_id)",
        select="""SELECT og.chunk_id, original_bytes, encoded_bytes, round(original_bytes / encoded_bytes, 6) AS ratio,
  round(original_bytes / 1048576 / 2.0, 6) AS mb_per_second FROM og JOIN en ON og.chunk_id = en.chunk_id""",
    ),
)
def size_report(spark, sf):
    """Bytes of lines and of their encoded parts, for runs of two seconds."""
    encoded = en.encoded_sizes(en.encode(tagged_events(spark, sf)))
    none = F.lit(0).cast("bigint")
    lines = inp.event_lines(spark, sf).select("chunk_id", (F.octet_length("line") + 1).cast("bigint").alias("original_bytes"), none.alias("encoded_bytes"))
    parts = encoded.select("chunk_id", none.alias("original_bytes"), F.col("bytes").alias("encoded_bytes"))
    r = pf.run_summary(lines.union(parts), ["chunk_id"], F.lit(2.0))
    return r.withColumn("ratio", F.round("ratio", 6)).withColumn("mb_per_second", F.round("mb_per_second", 6))
