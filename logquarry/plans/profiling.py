"""Profiles of lines and tokens, formats and records."""

from __future__ import annotations

from pyspark.sql import functions as F

from logquarry.functions import tokens as tk
from logquarry.operators import profile as pf
from logquarry.plans import inputs as inp
from logquarry.plans.registry import query, with_
from logquarry.sources import formatted as fmt
from logquarry.sources import lines as src

D = inp.D


def _rounded(df, *cols):
    for c in cols:
        df = df.withColumn(c, F.round(c, 6))
    return df


@query(
    "line_profile",
    f"""WITH d AS (SELECT source, lang, unnest(string_split(text, chr(10))) AS line FROM documents)
SELECT source, lang, count(*) AS n_lines, CAST(sum(strlen(line) + 1) AS BIGINT) AS size_bytes,
       round(avg(length(line)), 6) AS avg_line_length
FROM d GROUP BY source, lang""",
)
def line_profile(spark, sf):
    d = inp.table(spark, sf, "documents").select(
        "source", "lang", F.explode_outer(F.split("text", "\n", -1)).alias("line")
    )
    return _rounded(pf.line_profile(d, ["source", "lang"]), "avg_line_length")


@query(
    "digit_ratio",
    """WITH d AS (SELECT lang, unnest(string_split(text, chr(10))) AS line FROM documents),
c AS (SELECT lang, sum(length(regexp_replace(line, '\\P{Nd}', '', 'g'))) AS a, sum(length(line) + 1) AS b FROM d GROUP BY lang)
SELECT lang, CAST(a AS BIGINT) AS n_digits, CAST(b - a AS BIGINT) AS n_other, round(a / b, 6) AS digit_ratio FROM c""",
)
def digit_ratio(spark, sf):
    d = inp.table(spark, sf, "documents").select("lang", F.explode_outer(F.split("text", "\n", -1)).alias("line"))
    return _rounded(pf.digit_ratio(d, ["lang"]), "digit_ratio")


@query(
    "digit_token_ratio",
    with_(
        inp.EVENT_LINES,
        """w AS (SELECT chunk_id, list_filter(string_split_regex(trim(line), '[ ,:=/-]+'), lambda x: x <> '') AS t FROM event_lines),
c AS (SELECT chunk_id, sum(len(t)) AS a, sum(len(list_filter(t, lambda x: regexp_matches(x, '\\p{Nd}')))) AS b FROM w GROUP BY chunk_id)""",
        select="SELECT chunk_id, CAST(a AS BIGINT) AS n_tokens, CAST(b AS BIGINT) AS n_digit_tokens, round(b / a, 6) AS digit_token_ratio FROM c",
    ),
)
def digit_token_ratio(spark, sf):
    return _rounded(pf.digit_token_ratio(inp.event_lines(spark, sf), ["chunk_id"]), "digit_token_ratio")


@query(
    "token_types",
    f"""WITH t AS (SELECT unnest(regexp_extract_all(text, '[^{D}]+')) AS token FROM documents)
SELECT regexp_matches(token, '[A-Za-z<>]') AS has_alpha, regexp_matches(token, '[0-9]') AS has_digit,
       regexp_matches(token, '[^0-9A-Za-z<>]') AS has_special, regexp_full_match(token, '[0-9]+') AS is_number,
       count(*) AS n_tokens
FROM t GROUP BY ALL""",
)
def token_types(spark, sf):
    return pf.token_types(inp.table(spark, sf, "documents").select("text"), "text")


SHAPE_SQL = (
    "array_to_string(list_transform(regexp_extract_all(token, '[0-9]+|[^0-9]+'), lambda x: CASE WHEN regexp_matches(x, '^[0-9]') "
    "THEN '\\d{' || length(x) || '}' ELSE regexp_replace(x, '([.*+?()\\[\\]{}^$\\\\])', '\\\\\\1', 'g') END), '')"
)


@query(
    "token_shapes",
    f"""WITH t AS (SELECT unnest(regexp_extract_all(html, '[^{D}]+')) AS token FROM pages)
SELECT {SHAPE_SQL} AS shape, count(*) AS n_tokens, count(DISTINCT token) AS n_distinct
FROM t WHERE regexp_matches(token, '[0-9]') GROUP BY 1""",
)
def token_shapes(spark, sf):
    return pf.token_shapes(inp.table(spark, sf, "pages").select("html"), "html")


EVENT_FMT = fmt.line_format(inp.EVENT_FORMAT)
# the same lines under a format that only some of them match
ERROR_FORMAT = "<Date> <Time> ERROR user=<User> <Content>"


@query(
    "format_parse",
    with_(
        inp.EVENT_LINES,
        select=r"""SELECT chunk_id, line_no, regexp_extract(line, '^(.*?)\s+(.*?)\s+ERROR\s+user=(.*?)\s+(.*?)$', 1) AS "Date",
  regexp_extract(line, '^(.*?)\s+(.*?)\s+ERROR\s+user=(.*?)\s+(.*?)$', 2) AS "Time",
  regexp_extract(line, '^(.*?)\s+(.*?)\s+ERROR\s+user=(.*?)\s+(.*?)$', 3) AS "User",
  regexp_extract(line, '^(.*?)\s+(.*?)\s+ERROR\s+user=(.*?)\s+(.*?)$', 4) AS "Content"
FROM event_lines WHERE line LIKE '% ERROR user=%'""",
    ),
)
def format_parse(spark, sf):
    return fmt.parse_format(inp.event_lines(spark, sf), fmt.line_format(ERROR_FORMAT))


@query(
    "format_parse_keep",
    """SELECT event_id // 1000 AS chunk_id, event_id AS line_no,
  CASE WHEN event_type = 'error' THEN strftime(ts, '%Y-%m-%d') ELSE '' END AS "Date",
  CASE WHEN event_type = 'error' THEN strftime(ts, '%H:%M:%S') ELSE '' END AS "Time",
  CASE WHEN event_type = 'error' THEN CAST(user_id AS VARCHAR) ELSE '' END AS "User",
  CASE WHEN event_type = 'error' THEN '' ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') || ' ' || upper(event_type) || ' user=' || user_id || ' ' END
  || 'value=' || CAST(CAST(value AS DECIMAL(18,2)) AS VARCHAR) || ' props=' || props AS "Content"
FROM events""",
)
def format_parse_keep(spark, sf):
    return fmt.parse_format(inp.event_lines(spark, sf), fmt.line_format(ERROR_FORMAT), "keep")


@query(
    "loading_rate",
    "SELECT count(*) AS n_lines, count(*) FILTER (event_type = 'error') AS n_loaded, round(count(*) FILTER (event_type = 'error') / count(*), 6) AS loading_rate FROM events",
)
def loading_rate(spark, sf):
    return _rounded(fmt.loading_rate(inp.event_lines(spark, sf), fmt.line_format(ERROR_FORMAT)), "loading_rate")


@query(
    "multiline_records",
    with_(
        inp.CHAT_LINES,
        """numbered AS (SELECT *, sum(CASE WHEN regexp_matches(line, '^(assistant|system): ') THEN 1 ELSE 0 END) OVER (
  PARTITION BY conv_id ORDER BY line_no) AS record_no FROM chat_lines)""",
        select="""SELECT conv_id, CAST(record_no AS BIGINT) AS record_no, count(*) AS n_lines,
  md5(string_agg(line, chr(10) ORDER BY line_no)) AS record_md5, CAST(sum(length(line) + 1) - 1 AS BIGINT) AS n_chars
FROM numbered WHERE record_no > 0 GROUP BY conv_id, record_no""",
    ),
)
def multiline_records(spark, sf):
    r = src.join_continuations(
        inp.chat_lines(spark, sf), "^(assistant|system): ", ["conv_id"], "line_no", "block"
    )
    return r.select(
        "conv_id",
        "record_no",
        "n_lines",
        F.md5("record").alias("record_md5"),
        F.length("record").cast("bigint").alias("n_chars"),
    )


@query(
    "mask_patterns",
    r"""WITH m AS (SELECT regexp_replace(regexp_replace(regexp_replace(url, '([0-9]+\.){3}[0-9]+', '<*>', 'g'), '[0-9]+', '<*>', 'g'),
  '[^\x00-\x7F]+', '<N/ASCII>', 'g') AS masked FROM pages)
SELECT masked, count(*) AS n FROM m GROUP BY masked""",
)
def mask_patterns(spark, sf):
    masked = tk.mask_non_ascii(tk.mask_patterns(F.col("url"), [r"([0-9]+\.){3}[0-9]+", "[0-9]+"]))
    return (
        inp.table(spark, sf, "pages").select(masked.alias("masked")).groupBy("masked").agg(F.count(F.lit(1)).alias("n"))
    )


@query(
    "delete_patterns",
    r"""SELECT lang, CAST(sum(length(regexp_replace(regexp_replace(text, '[0-9]+', '', 'g'), '[A-Za-z0-9._]+@[A-Za-z0-9.]+', '', 'g'))) AS BIGINT) AS n_chars
FROM documents GROUP BY lang""",
)
def delete_patterns(spark, sf):
    kept = tk.delete_patterns(F.col("text"), ["[0-9]+", "[A-Za-z0-9._]+@[A-Za-z0-9.]+"])
    return inp.table(spark, sf, "documents").groupBy("lang").agg(F.sum(F.length(kept)).alias("n_chars"))


@query(
    "mask_number_tokens",
    with_(
        inp.ORDER_LINES,
        r"""w AS (SELECT array_to_string(list_transform(string_split(line || ' from 10.0.7.' || line_no % 300, ' '), lambda x: CASE WHEN
  regexp_full_match(x, '[0-9]+|([0-9]{1,3}\.){3}[0-9]{1,3}') THEN '<*>' ELSE x END), ' ') AS masked FROM order_lines)""",
        select="SELECT regexp_replace(masked, '[0-9]+', '#', 'g') AS masked, count(*) AS n FROM w GROUP BY 1",
    ),
)
def mask_number_tokens(spark, sf):
    """Order numbers and addresses are masked; what digits are left stands in longer words."""
    line = F.concat("line", F.lit(" from 10.0.7."), (F.col("line_no") % 300).cast("string"))
    masked = F.regexp_replace(F.array_join(tk.mask_number_tokens(F.split(line, " ")), " "), "[0-9]+", "#")
    return inp.order_lines(spark, sf).groupBy(masked.alias("masked")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "filter_convert_lines",
    with_(
        inp.EVENT_LINES,
        select=r"""SELECT chunk_id, line_no, 'user ' || regexp_extract(line, 'user=([0-9]+) value=([0-9.]+)', 1) || ' paid '
  || regexp_extract(line, 'user=([0-9]+) value=([0-9.]+)', 2) || ' $ [' || line || ']' AS line
FROM event_lines WHERE line LIKE '% PURCHASE %'""",
    ),
)
def filter_convert_lines(spark, sf):
    kept = src.filter_lines(inp.event_lines(spark, sf), " PURCHASE ")
    return src.convert_lines(kept, r"user=([0-9]+) value=([0-9.]+)", "user $1 paid ${2} $$ [$0]")


@query(
    "drop_blank_lines",
    with_(
        inp.DOC_LINES,
        select=r"""SELECT chunk_id, count(*) AS n_lines, CAST(sum(length(line)) AS BIGINT) AS n_chars
FROM doc_lines WHERE regexp_matches(line, '\S') GROUP BY chunk_id""",
    ),
)
def drop_blank_lines(spark, sf):
    kept = src.drop_blank(inp.doc_lines(spark, sf))
    return kept.groupBy("chunk_id").agg(
        F.count(F.lit(1)).alias("n_lines"), F.sum(F.length("line")).alias("n_chars")
    )


@query(
    "user_line_function",
    """SELECT event_id // 1000 AS chunk_id, event_id AS line_no, upper(event_type) || ':' || user_id AS line
FROM events WHERE value >= 10""",
)
def user_line_function(spark, sf):
    e = inp.table(spark, sf, "events").select(
        F.expr("event_id div 1000").alias("chunk_id"),
        F.col("event_id").alias("line_no"),
        F.to_json(F.struct("event_type", "user_id", "value")).alias("line"),
    )

    def convert(line):
        big = F.get_json_object(line, "$.value").cast("double") >= 10
        text = F.concat(
            F.upper(F.get_json_object(line, "$.event_type")), F.lit(":"), F.get_json_object(line, "$.user_id")
        )
        return F.when(big, text)

    return src.map_lines(e, convert)


@query(
    "split_parameters",
    """SELECT o_orderkey AS id, o_orderstatus AS event_id, CAST(3 AS BIGINT) AS n_params, CAST(o_custkey AS VARCHAR) || '|' || o_orderpriority AS first_two
FROM orders""",
)
def split_parameters(spark, sf):
    o = inp.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.concat_ws("||", "o_orderstatus", F.col("o_custkey").cast("string"), "o_orderpriority", F.year("o_orderdate").cast("string"), F.lit("")).alias("line"),
    )
    s = src.split_parameters(o)
    return s.select(
        "id",
        "event_id",
        F.size("params").cast("bigint").alias("n_params"),
        F.concat_ws("|", F.col("params")[0], F.col("params")[1]).alias("first_two"),
    )


@query("codec_sizes")
def codec_sizes(spark, sf):
    return pf.codec_report(pf.codec_sizes(inp.event_lines(spark, sf), ["chunk_id", "line_no"]))
