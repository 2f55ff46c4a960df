"""Logs and columns taken apart and put together again."""

from __future__ import annotations

from pyspark.sql import functions as F

from logquarry.operators import columns as cl
from logquarry.operators import logparts as lp
from logquarry.operators import numbers as nm
from logquarry.plans import inputs as inp
from logquarry.plans.registry import query, with_
from logquarry.plans.relations import ORDER_TABLE, order_table

MIXED_FORMAT = "<Date> <Time> <Level>: <Content>"
MIXED_TEMPLATES = ["user <*> clicked <*> times", "user <*> viewed item <*>", "paid <*> for <*> items by <*>"]


def mixed_lines(spark, sf):
    """Events as lines of all three kinds: with a template, without one, and outside the format."""
    e = inp.table(spark, sf, "events")
    user, value = F.col("user_id").cast("string"), F.col("value").cast("decimal(18,2)").cast("string")
    k = F.regexp_extract("props", "[0-9]+", 0)
    kind = F.col("event_type")
    head = F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(" "), F.upper("event_type"), F.lit(": "))
    say = lambda *parts: F.concat(*[p if isinstance(p, F.Column) else F.lit(p) for p in parts])
    line = (
        F.when(kind == "error", say("Traceback in call ", k))
        .when((kind == "click") & (F.col("user_id") % 7 == 0), say(head, " user ", user, " clicked ", k, " times"))
        .when(kind == "click", say(head, "user ", user, " clicked ", k, " times"))
        .when(kind == "view", say(head, "user ", user, " viewed item ", k, "-", user, "/", k))
        .when(kind == "purchase", say(head, "paid ", value, " for ", k, " items by ", user))
        .otherwise(say(head, "account ", user, " made"))
    )
    return e.select(F.expr(f"event_id div {inp.EVENT_CHUNK}").alias("chunk_id"), F.col("event_id").alias("line_no"), line.alias("line"))


MIXED_LINES = f"""mixed AS (
  SELECT event_id // {inp.EVENT_CHUNK} AS chunk_id, event_id AS line_no, event_type AS t, user_id AS u, regexp_extract(props, '[0-9]+') AS k,
         CAST(CAST(value AS DECIMAL(18,2)) AS VARCHAR) AS v, strftime(ts, '%Y-%m-%d %H:%M:%S') || ' ' || upper(event_type) || ': ' AS h FROM events),
mixed_lines AS (
  SELECT chunk_id, line_no,
    CASE t WHEN 'error' THEN 'Traceback in call ' || k
      WHEN 'click' THEN h || CASE WHEN u % 7 = 0 THEN ' ' ELSE '' END || 'user ' || u || ' clicked ' || k || ' times'
      WHEN 'view' THEN h || 'user ' || u || ' viewed item ' || k || '-' || u || '/' || k
      WHEN 'purchase' THEN h || 'paid ' || v || ' for ' || k || ' items by ' || u ELSE h || 'account ' || u || ' made' END AS line,
    CAST(CASE WHEN t = 'error' OR (t = 'click' AND u % 7 = 0) THEN -1 WHEN t = 'click' THEN 1 WHEN t = 'view' THEN 2 WHEN t = 'purchase' THEN 3 ELSE 0 END AS BIGINT) AS event
  FROM mixed)"""


def _parts(spark, sf):
    templates = spark.createDataFrame(list(enumerate(MIXED_TEMPLATES, 1)), "template_id long, template string")
    return lp.split_log(mixed_lines(spark, sf), MIXED_FORMAT, templates)


@query("assembled_log", with_(MIXED_LINES, select="SELECT chunk_id, line_no, line FROM mixed_lines"))
def assembled_log(spark, sf):
    """The log from its headers, templates, variables and side tables; nothing else is read."""
    return lp.rebuild_log(_parts(spark, sf))


@query("log_events", with_(MIXED_LINES, select="SELECT chunk_id, line_no, event FROM mixed_lines"))
def log_events(spark, sf):
    return _parts(spark, sf).events


@query(
    "log_side_lines",
    with_(
        MIXED_LINES,
        select="SELECT chunk_id, event, row_number() OVER (PARTITION BY chunk_id, event ORDER BY line_no) AS k, line FROM mixed_lines WHERE event <= 0",
    ),
)
def log_side_lines(spark, sf):
    return _parts(spark, sf).sides


# --- columns

CODED = ["okey", "cents", "day", "status", "prio", "code"]


def coded_columns(spark, sf):
    """Columns of orders as text; ``code`` has two layouts of delimiters."""
    code = F.concat(
        F.col("cust").cast("string"), F.lit("/"), F.pmod("row_no", F.lit(7)).cast("string"), F.when(F.col("row_no") % 3 == 0, F.concat(F.lit("_"), "status")).otherwise("")
    )
    o = order_table(spark, sf).withColumn("code", code)
    cells = F.array(*[F.struct(F.lit(c).alias("col"), F.col(c).cast("string").alias("value")) for c in CODED])
    return o.select("chunk_id", F.col("row_no").alias("seq"), F.explode(cells).alias("c")).select("chunk_id", "seq", "c.col", "c.value")


CODED_COLUMNS = (
    ORDER_TABLE,
    "oc AS (SELECT *, cust || '/' || row_no % 7 || CASE WHEN row_no % 3 = 0 THEN '_' || status ELSE '' END AS code FROM ot)",
    "cc AS (" + " UNION ALL ".join(f"SELECT chunk_id, row_no AS seq, '{c}' AS col, CAST({c} AS VARCHAR) AS value FROM oc" for c in CODED) + ")",
)


@query("column_round_trip", with_(*CODED_COLUMNS, select="SELECT chunk_id, col, seq, value FROM cc"))
def column_round_trip(spark, sf):
    """Columns from split fields in four forms: text, steps, ids, and steps between ids."""
    return cl.decode_columns(cl.encode_columns(coded_columns(spark, sf)))


@query(
    "common_delimiters",
    with_(
        *CODED_COLUMNS,
        r"sg AS (SELECT chunk_id, col, regexp_replace(value, '[^-#><_:;,\[\]\\/.()]', '', 'g') AS sig FROM cc)",
        # in these columns the shortest signature begins all others
        select="SELECT chunk_id, col, arg_min(sig, length(sig)) AS pattern FROM sg GROUP BY chunk_id, col",
    ),
)
def common_delimiters(spark, sf):
    return cl.encode_columns(coded_columns(spark, sf)).patterns


_H = "sum(CASE WHEN {v} IS NOT NULL THEN (ln({n}) - ln({c})) * log2(abs({v}) + 1) / {n} END)"


@query(
    "column_fields",
    with_(
        *CODED_COLUMNS,
        """fx AS (SELECT chunk_id, col, seq, CASE WHEN col IN ('day', 'prio') THEN string_split(value, '-')
  WHEN col = 'code' THEN [split_part(value, '/', 1), substr(value, instr(value, '/') + 1)] ELSE [value] END AS x FROM cc)""",
        "ft AS (SELECT chunk_id, col, CAST(generate_subscripts(x, 1) - 1 AS INT) AS field, seq, unnest(x) AS text FROM fx)",
        """f1 AS (SELECT *, count(*) OVER f AS n, min(seq) OVER (PARTITION BY chunk_id, col, field, text) AS first_at,
  bool_and(regexp_full_match(text, '0|-?[1-9][0-9]{0,17}')) OVER f AS plain,
  bool_and(regexp_full_match(text, '[0-9]{1,18}')) OVER f AND min(length(text)) OVER f = max(length(text)) OVER f AS fixed
  FROM ft WINDOW f AS (PARTITION BY chunk_id, col, field))""",
        """f2 AS (SELECT *, CASE WHEN plain OR fixed THEN TRY_CAST(text AS BIGINT) END AS v,
  dense_rank() OVER (PARTITION BY chunk_id, col, field ORDER BY first_at) - 1 AS d FROM f1)""",
        "f3 AS (SELECT *, v - lag(v) OVER o AS sv, d - lag(d) OVER o AS sd FROM f2 WINDOW o AS (PARTITION BY chunk_id, col, field ORDER BY seq))",
        "f4 AS (SELECT *, "
        + ", ".join(f"count({c}) OVER (PARTITION BY chunk_id, col, field) AS n_{c}, count({c}) OVER (PARTITION BY chunk_id, col, field, {c}) AS c_{c}" for c in ("v", "sv", "d", "sd"))
        + " FROM f3)",
        "f5 AS (SELECT chunk_id, col, field, bool_and(plain) AS plain, bool_and(plain OR fixed) AS num, max(length(text)) AS w, count(*) AS n, max(d) + 1 < 0.5 * count(*) AS few, "
        + ", ".join(f"round(coalesce({_H.format(v=c, n=f'n_{c}', c=f'c_{c}')}, 0), 9) AS h_{c}" for c in ("v", "sv", "d", "sd"))
        + " FROM f4 GROUP BY chunk_id, col, field)",
        """f6 AS (SELECT *, CASE WHEN num AND h_v >= h_sv THEN 'delta' WHEN few AND h_d >= h_sd THEN 'dict_delta' WHEN few THEN 'dict' ELSE 'text' END AS form FROM f5)""",
        select="SELECT chunk_id, col, field, form, CAST(CASE WHEN form = 'delta' AND NOT plain THEN w END AS INT) AS width, n FROM f6",
    ),
)
def column_fields(spark, sf):
    return cl.encode_columns(coded_columns(spark, sf)).fields


# --- number groups


def number_lines(spark, sf):
    """Orders as lines of two layouts: fields between bars with a long number, and words."""
    o = inp.table(spark, sf, "orders")
    key, cust = F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string")
    total, at = F.col("o_totalprice").cast("decimal(18,2)").cast("string"), F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")
    bars = F.concat_ws("|", key, cust, F.concat(F.lit("ref_"), F.lpad(key, 16, "0")), total, at)
    words = F.concat(F.lit("order "), key, F.lit(" cust="), cust, F.lit(", total="), total, F.lit("; at "), at, F.lit(" <a> ok"))
    line = F.when(F.col("o_orderkey") % 2 == 0, bars).otherwise(words)
    return o.select(F.expr(f"o_orderkey div {inp.ORDER_CHUNK}").alias("chunk_id"), F.col("o_orderkey").alias("line_no"), line.alias("line"))


NUMBER_LINES = f"""number_lines AS (
  SELECT o_orderkey // {inp.ORDER_CHUNK} AS chunk_id, o_orderkey AS line_no,
    CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey || '|' || o_custkey || '|ref_' || lpad(CAST(o_orderkey AS VARCHAR), 16, '0') || '|'
        || CAST(o_totalprice AS DECIMAL(18,2)) || '|' || strftime(o_orderdate, '%Y-%m-%d %H:%M:%S')
      ELSE 'order ' || o_orderkey || ' cust=' || o_custkey || ', total=' || CAST(o_totalprice AS DECIMAL(18,2)) || '; at '
        || strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') || ' <a> ok' END AS line
  FROM orders)"""
MINED = """samp AS (SELECT arg_min(line, md5('3:' || line)) AS line FROM number_lines GROUP BY length(line)),
cand AS (SELECT unnest([',', ' ', '|', ';', '[', ']', '(', ')', '_', '/']) AS delimiter),
mined AS (SELECT delimiter, CAST(sum(length(line) - length(replace(line, delimiter, ''))) AS BIGINT) AS n FROM samp, cand
  GROUP BY delimiter HAVING sum(length(line) - length(replace(line, delimiter, ''))) > (SELECT count(*) FROM samp))"""


def _mined(lines):
    return nm.mined_delimiters(nm.length_sample(lines.select("line"), "line", seed=3), "line")


@query("mined_delimiters", with_(NUMBER_LINES, MINED, select="SELECT delimiter, n FROM mined"))
def mined_delimiters(spark, sf):
    return _mined(number_lines(spark, sf))


def _number_log(spark, sf):
    lines = number_lines(spark, sf)
    # at most as many as there are candidates
    found = [r["delimiter"] for r in _mined(lines).collect()]
    return nm.encode_numbers(lines, [(inp.TIME_TAG, inp.TIME_PATTERN)], found)


@query("round_trip_numbers", with_(NUMBER_LINES, select="SELECT chunk_id, line_no, line FROM number_lines"))
def round_trip_numbers(spark, sf):
    """Lines from number columns, words, masks and templates; a value is found by its place in its group."""
    return nm.decode_numbers(_number_log(spark, sf))


_GROUP = """'<' || chr(CAST(96 + length(x) AS INTEGER)) || CASE WHEN length(x) >= 4 THEN chr(CAST(97 + CAST(x[1] AS BIGINT) AS INTEGER)) ELSE '' END || '>'"""


@query(
    "number_templates",
    with_(
        NUMBER_LINES,
        MINED,
        "dl AS (SELECT '[' || string_agg(CASE WHEN delimiter IN ('[', ']', '|', '(', ')', '/') THEN '\\' || delimiter ELSE delimiter END, '') || ']+' AS d FROM mined)",
        # the time has no digit left in its place, so it is put in before the words are cut
        f"tm AS (SELECT chunk_id, regexp_replace(line, '{inp.TIME_PATTERN}', '\x01', 'g') AS line FROM number_lines)",
        "wd AS (SELECT chunk_id, regexp_extract_all(line, d || '|' || replace(d, '[', '[^')) AS w FROM tm, dl)",
        f"""nt AS (SELECT chunk_id, replace(array_to_string(list_transform(w, lambda w: CASE WHEN NOT regexp_matches(w, '[0-9]') THEN w
  WHEN regexp_matches(w, '[0-9]{{15}}') THEN '<*>' ELSE array_to_string(list_transform(regexp_extract_all(w, '[0-9]+|[^0-9]+'),
    lambda x: CASE WHEN regexp_matches(x, '^[0-9]') THEN {_GROUP} ELSE x END), '') END), ''), chr(1), '{inp.TIME_TAG}') AS template FROM wd)""",
        select="SELECT chunk_id, template, count(*) AS n_lines FROM nt GROUP BY chunk_id, template",
    ),
)
def number_templates(spark, sf):
    log = _number_log(spark, sf)
    named = log.templates.select("chunk_id", "template_id", nm.number_template_text(F.col("statics"), F.col("tags")).alias("template"))
    counts = log.line_map.groupBy("chunk_id", "template_id").agg(F.count(F.lit(1)).alias("n"))
    return counts.join(named, ["chunk_id", "template_id"]).groupBy("chunk_id", "template").agg(F.sum("n").alias("n_lines"))


@query("round_trip_numbers_documents", with_(inp.DOC_LINES, select="SELECT chunk_id, line_no, line FROM doc_lines"))
def round_trip_numbers_documents(spark, sf):
    return nm.decode_numbers(nm.encode_numbers(inp.doc_lines(spark, sf), [], [" ", ","]))
