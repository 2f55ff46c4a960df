"""Lines rendered from the given tables, in Spark and in SQL.

A chunk is a bounded range of the table's key, so chunks stay small however
large the table is, and no query needs a global line number.
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logquarry.functions import tokens as tk
from logquarry.sources.lines import lines_of_text, spread

EVENT_CHUNK = 1000
DOC_CHUNK = 64
ORDER_CHUNK = 1024
TURN_BLOCK = 1024

D = tk.DELIMITERS
TIME_TAG = "<T>"
TIME_PATTERN = r"\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}"
EVENT_PATTERNS = [(TIME_TAG, TIME_PATTERN)]
EVENT_FORMAT = "<Date> <Time> <Level> user=<User> value=<Value> props=<Content>"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf}/{name}.parquet"))


def _money(c: str) -> F.Column:
    return F.col(c).cast("decimal(18,2)").cast("string")


def event_lines(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    return e.select(
        F.expr(f"event_id div {EVENT_CHUNK}").alias("chunk_id"),
        F.col("event_id").alias("line_no"),
        F.concat(
            F.date_format("ts", "yyyy-MM-dd HH:mm:ss"),
            F.lit(" "),
            F.translate("event_type", ascii_lowercase, ascii_uppercase),
            F.lit(" user="),
            F.col("user_id").cast("string"),
            F.lit(" value="),
            _money("value"),
            F.lit(" props="),
            F.col("props"),
        ).alias("line"),
    )


EVENT_LINES = f"""event_lines AS (
  SELECT event_id // {EVENT_CHUNK} AS chunk_id, event_id AS line_no,
         strftime(ts, '%Y-%m-%d %H:%M:%S') || ' ' || upper(event_type) || ' user=' || user_id
         || ' value=' || CAST(CAST(value AS DECIMAL(18,2)) AS VARCHAR) || ' props=' || props AS line
  FROM events)"""


def event_json(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    return e.select(
        F.expr(f"event_id div {EVENT_CHUNK}").alias("chunk_id"),
        F.col("event_id").alias("line_no"),
        F.concat(
            F.lit('{"user": "'),
            F.col("user_id").cast("string"),
            F.lit('", "type": "'),
            F.col("event_type"),
            F.lit('", "note": "paid '),
            _money("value"),
            F.lit(" by user "),
            F.col("user_id").cast("string"),
            F.lit('", "value": '),
            _money("value"),
            F.lit(', "props": '),
            F.col("props"),
            F.lit("}"),
        ).alias("line"),
    )


EVENT_JSON = f"""event_json AS (
  SELECT event_id // {EVENT_CHUNK} AS chunk_id, event_id AS line_no, CAST(user_id AS VARCHAR) AS u, event_type AS t,
         CAST(CAST(value AS DECIMAL(18,2)) AS VARCHAR) AS v, props AS p,
         '{{"user": "' || user_id || '", "type": "' || event_type || '", "note": "paid '
         || CAST(CAST(value AS DECIMAL(18,2)) AS VARCHAR) || ' by user ' || user_id || '", "value": '
         || CAST(CAST(value AS DECIMAL(18,2)) AS VARCHAR) || ', "props": ' || props || '}}' AS line
  FROM events)"""


def doc_lines(spark: SparkSession, sf: str) -> DataFrame:
    return lines_of_text(table(spark, sf, "documents").select("doc_id", "text"), "doc_id", "text", DOC_CHUNK)


DOC_LINES = f"""doc_parts AS (
  SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents),
doc_lines AS (
  SELECT doc_id // {DOC_CHUNK} AS chunk_id,
         doc_id * 4294967296 + generate_subscripts(parts, 1) - 1 AS line_no, unnest(parts) AS line
  FROM doc_parts)"""


def order_lines(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    return o.select(
        F.expr(f"o_orderkey div {ORDER_CHUNK}").alias("chunk_id"),
        F.col("o_orderkey").alias("line_no"),
        F.concat(
            F.lit("order "),
            F.col("o_orderkey").cast("string"),
            F.lit(" cust="),
            F.col("o_custkey").cast("string"),
            F.lit(" status="),
            F.col("o_orderstatus"),
            F.lit(" total="),
            _money("o_totalprice"),
            F.lit(" at "),
            F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"),
            F.lit(" prio "),
            F.col("o_orderpriority"),
        ).alias("line"),
    )


ORDER_LINES = f"""order_lines AS (
  SELECT o_orderkey // {ORDER_CHUNK} AS chunk_id, o_orderkey AS line_no,
         'order ' || o_orderkey || ' cust=' || o_custkey || ' status=' || o_orderstatus
         || ' total=' || CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR)
         || ' at ' || strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') || ' prio ' || o_orderpriority AS line
  FROM orders)"""


def chat_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Turns as ``role: text`` with the text's own newlines; ``block`` is a bounded run of turns."""
    c = table(spark, sf, "conversations")
    text = F.concat("role", F.lit(": "), "text")
    return c.select(
        "conv_id",
        F.expr(f"turn div {TURN_BLOCK}").alias("block"),
        "turn",
        F.posexplode_outer(F.split(text, "\n", -1)).alias("pos", "line"),
    ).select(
        "conv_id",
        "block",
        (F.shiftleft(F.col("turn").cast("bigint"), 32) + F.col("pos")).alias("line_no"),
        "line",
    )


CHAT_LINES = """chat_parts AS (
  SELECT conv_id, turn, string_split(role || ': ' || text, chr(10)) AS parts FROM conversations),
chat_lines AS (
  SELECT conv_id, turn * 4294967296 + generate_subscripts(parts, 1) - 1 AS line_no, unnest(parts) AS line
  FROM chat_parts)"""


def pieces_sql(lines: str, pattern: str | None = None, tag: str = TIME_TAG, out: str = "pieces", shaped: bool = True) -> str:
    """Pieces and tags in SQL: windows over exploded runs. The pattern must begin where a token begins."""
    runs = (f"{pattern}|" if pattern else "") + f"[{D}]+|[^{D}]+"
    hit = f"regexp_full_match(text, '{pattern}')" if pattern else "false"
    shaped_rule = (
        "WHEN digit AND NOT alpha THEN '<' || CASE WHEN ctx <> '' THEN 'CTX=' || ctx || '|' ELSE '' END || 'STR=' || "
        "array_to_string(list_transform(regexp_extract_all(text, '[0-9]+|[^0-9]+'), lambda x: CASE WHEN regexp_matches(x, '^[0-9]') "
        "THEN '\\d{' || length(x) || '}' ELSE regexp_replace(x, '([.*+?()\\[\\]{}^$\\\\])', '\\\\\\1', 'g') END), '') || '>'"
        if shaped
        else ""
    )
    return f"""{out}_runs AS (
  SELECT chunk_id, line_no, regexp_extract_all(line, '{runs}') AS r FROM {lines}),
{out}_flat AS (
  SELECT chunk_id, line_no, unnest(r) AS text, generate_subscripts(r, 1) - 1 AS pos FROM {out}_runs),
{out}_typed AS (
  SELECT *, {hit} AS hit, regexp_matches(text, '^[{D}]') AS delim,
         regexp_matches(text, '[0-9]') AS digit, regexp_matches(text, '[A-Za-z<>]') AS alpha,
         regexp_full_match(text, '[0-9]+') AS num, regexp_matches(text, '[^A-Za-z<>]') AS var
  FROM {out}_flat),
{out}_ctx AS (
  SELECT *, sum(CASE WHEN hit OR delim THEN 0 ELSE 1 END) OVER (PARTITION BY chunk_id, line_no ORDER BY pos) AS idx,
         coalesce(last_value(CASE WHEN hit THEN '{tag}' WHEN NOT delim AND NOT var THEN text END IGNORE NULLS) OVER (
           PARTITION BY chunk_id, line_no ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS ctx
  FROM {out}_typed),
{out} AS (
  SELECT chunk_id, line_no, CAST(pos AS BIGINT) AS pos, text,
    CASE WHEN hit THEN '{tag}' WHEN delim OR NOT var THEN ''
         WHEN num AND length(text) <= 2 THEN '<LEN=' || length(text) || '>'
         WHEN num THEN '<IDX=' || CAST(idx AS BIGINT) || CASE WHEN ctx <> '' THEN '|CTX=' || ctx ELSE '' END || '|STR=\\d{{' || length(text) || '}}>'
         {shaped_rule}
         ELSE '<' || CASE WHEN ctx <> '' THEN 'CTX=' || ctx || '|' ELSE '' END || 'STR=_' || regexp_replace(text, '[A-Za-z0-9\\s]|[^\\x00-\\x7F]', '', 'g') || '>'
    END AS tag
  FROM {out}_ctx),
{out}_vars AS (
  SELECT chunk_id, line_no, row_number() OVER (PARTITION BY chunk_id, line_no ORDER BY pos) AS var_no, tag, text AS value
  FROM {out} WHERE tag <> '')"""
