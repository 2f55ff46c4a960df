"""Column relations, headers and correlations."""

from __future__ import annotations

from pyspark.sql import functions as F

from logquarry.operators import headers as hd
from logquarry.operators import profile as pf
from logquarry.operators import relations as rl
from logquarry.operators import stats as st
from logquarry.plans import inputs as inp
from logquarry.plans.registry import query, with_

NUMERIC = ["okey", "cust", "cents"]
IDS = ["status", "prio"]


def order_table(spark, sf):
    o = inp.table(spark, sf, "orders")
    return o.select(
        F.expr(f"o_orderkey div {inp.ORDER_CHUNK}").alias("chunk_id"),
        F.col("o_orderkey").alias("row_no"),
        F.col("o_orderkey").alias("okey"),
        F.col("o_custkey").alias("cust"),
        (F.col("o_totalprice").cast("decimal(18,2)") * 100).cast("bigint").alias("cents"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"),
        F.col("o_orderstatus").alias("status"),
        F.col("o_orderpriority").alias("prio"),
    )


ORDER_TABLE = f"""ot AS (SELECT o_orderkey // {inp.ORDER_CHUNK} AS chunk_id, o_orderkey AS row_no, o_orderkey AS okey, o_custkey AS cust,
  CAST(CAST(o_totalprice AS DECIMAL(18,2)) * 100 AS BIGINT) AS cents, strftime(o_orderdate, '%Y-%m-%d') AS day, o_orderstatus AS status, o_orderpriority AS prio FROM orders)"""

COLUMNS = ["okey", "cust", "cents", "day", "status", "prio"]
LONG = "lg AS (" + " UNION ALL ".join(f"SELECT chunk_id, '{c}' AS col, CAST({c} AS VARCHAR) AS value FROM ot" for c in COLUMNS) + ")"


@query(
    "column_types",
    with_(
        ORDER_TABLE,
        LONG,
        """c AS (SELECT col, bool_and(coalesce(abs(TRY_CAST(value AS BIGINT)) < 2147483648, false)) AS is_numeric, count(DISTINCT value) AS n_distinct, count(*) AS n FROM lg GROUP BY col)""",
        select="SELECT *, row_number() OVER (ORDER BY n_distinct, col) AS rank FROM c",
    ),
)
def column_types(spark, sf):
    return rl.column_types(rl.value_counts(rl.long_columns(order_table(spark, sf), [], COLUMNS), []), [])


FORMS_SQL = (
    ORDER_TABLE,
    """fm AS (SELECT chunk_id, row_no, cust, coalesce(lead(cust) OVER c - cust, cust) AS cust_up, cust - coalesce(lag(cust) OVER c, 0) AS cust_do,
  coalesce(lead(cust) OVER s - cust, cust) AS cust_up_status, cust - coalesce(lag(cust) OVER s, 0) AS cust_do_status FROM ot
  WINDOW c AS (PARTITION BY chunk_id ORDER BY row_no), s AS (PARTITION BY chunk_id, status ORDER BY row_no))""",
)


@query("column_forms", with_(*FORMS_SQL, select="SELECT * FROM fm"))
def column_forms(spark, sf):
    return rl.with_forms(order_table(spark, sf), rl.forms(["cust"], ["status"]), "row_no")


def _entropies(select_rows: str) -> str:
    return f"""SELECT expr, round(sum(c) * ln(sum(c)) - sum(c * ln(c)), 3) AS score FROM (SELECT expr, v, count(*) AS c FROM ({select_rows}) GROUP BY expr, v) GROUP BY expr"""


def _relation_sql(columns: list[str], by: str | None, triples: bool) -> str:
    windows, names = [], []
    for c in columns:
        own = [
            (c, c),
            (f"{c}_up", f"coalesce(lead({c}) OVER c - {c}, {c})"),
            (f"{c}_do", f"{c} - coalesce(lag({c}) OVER c, 0)"),
        ]
        if by:
            own += [
                (f"{c}_up_{by}", f"coalesce(lead({c}) OVER s - {c}, {c})"),
                (f"{c}_do_{by}", f"{c} - coalesce(lag({c}) OVER s, 0)"),
            ]
        windows += [f"{e} AS {n}" if e != n else n for n, e in own]
        names += [n for n, _ in own]
    source = lambda n: n.split("_")[0]
    rows = [f"SELECT '{n}' AS expr, {n} AS v FROM fr" for n in names]
    for i, b in enumerate(names):
        for a in names[i + 1 :]:
            if source(a) != source(b):
                rows.append(f"SELECT '{a}-{b}' AS expr, {a} - {b} AS v FROM fr")
    if triples:
        for a in names:
            for k, c in enumerate(names):
                for b in names[k + 1 :]:
                    if len({source(a), source(b), source(c)}) == 3:
                        rows.append(f"SELECT '{a}-{b}-{c}' AS expr, {a} - {b} - {c} AS v FROM fr")
    ids = f", s AS (PARTITION BY chunk_id, {by} ORDER BY row_no)" if by else ""
    return with_(
        ORDER_TABLE,
        f"fr AS (SELECT chunk_id, row_no, {', '.join(windows)} FROM ot WINDOW c AS (PARTITION BY chunk_id ORDER BY row_no){ids})",
        select=_entropies(" UNION ALL ".join(rows)),
    )


@query("relation_scores", _relation_sql(["okey", "cust"], "status", False))
def relation_scores(spark, sf):
    s = rl.relation_scores(order_table(spark, sf), rl.forms(["okey", "cust"], ["status"]), "row_no")
    return s.withColumn("score", F.round("score", 3))


@query("relation_scores_triples", _relation_sql(NUMERIC, None, True))
def relation_scores_triples(spark, sf):
    s = rl.relation_scores(order_table(spark, sf), rl.forms(NUMERIC, []), "row_no")
    return s.withColumn("score", F.round("score", 3))


def _rules(spark, sf):
    catalog = rl.forms(["okey", "cust"], ["status"])
    table = order_table(spark, sf)
    return table, catalog, rl.choose_rules(rl.relation_scores(table, catalog, "row_no"), catalog)


@query("relation_rules")
def relation_rules(spark, sf):
    table, catalog, rules = _rules(spark, sf)
    return rl.apply_rules(table, rules, catalog, "row_no", ["status"])


@query("relation_round_trip", with_(ORDER_TABLE, select="SELECT chunk_id, row_no, status, okey, cust FROM ot"))
def relation_round_trip(spark, sf):
    table, catalog, rules = _rules(spark, sf)
    encoded = rl.apply_rules(table, rules, catalog, "row_no", ["status"])
    return rl.undo_rules(encoded, rules, "row_no").select("chunk_id", "row_no", "status", "okey", "cust")


@query(
    "delta_useful",
    with_(
        ORDER_TABLE,
        """lg AS (SELECT chunk_id, 'okey' AS col, okey AS v, okey - lag(okey) OVER (PARTITION BY chunk_id ORDER BY row_no) AS d FROM ot
  UNION ALL SELECT chunk_id, 'cust', cust, cust - lag(cust) OVER (PARTITION BY chunk_id ORDER BY row_no) FROM ot)""",
        "b AS (SELECT chunk_id, col, v AS x, count(*) AS n FROM lg GROUP BY ALL)",
        "a AS (SELECT chunk_id, col, d AS x, count(*) AS n FROM lg WHERE d IS NOT NULL GROUP BY ALL)",
        "hb AS (SELECT chunk_id, col, (ln(sum(n)) * sum(n * log2(abs(x) + 1)) - sum(n * log2(abs(x) + 1) * ln(n))) / sum(n) AS h FROM b GROUP BY ALL)",
        "ha AS (SELECT chunk_id, col, (ln(sum(n)) * sum(n * log2(abs(x) + 1)) - sum(n * log2(abs(x) + 1) * ln(n))) / sum(n) AS h FROM a GROUP BY ALL)",
        select="""SELECT hb.chunk_id, hb.col, round(hb.h, 4) AS before, round(coalesce(ha.h, 0), 4) AS after, round(hb.h, 9) >= round(coalesce(ha.h, 0), 9) AS useful
FROM hb LEFT JOIN ha ON hb.chunk_id = ha.chunk_id AND hb.col = ha.col""",
    ),
)
def delta_useful(spark, sf):
    d = rl.delta_usefulness(order_table(spark, sf), ["okey", "cust"], "row_no")
    return d.withColumn("before", F.round("before", 4)).withColumn("after", F.round("after", 4))


@query(
    "dictionary_useful",
    with_(ORDER_TABLE, LONG, select="SELECT chunk_id, col, count(DISTINCT value) AS n_distinct, count(*) AS n, count(DISTINCT value) < 0.5 * count(*) AS useful FROM lg GROUP BY chunk_id, col"),
)
def dictionary_useful(spark, sf):
    c = rl.value_counts(rl.long_columns(order_table(spark, sf), ["chunk_id"], COLUMNS), ["chunk_id"])
    return rl.dictionary_usefulness(c, ["chunk_id"])


@query(
    "dictionary_delta",
    with_(
        ORDER_TABLE,
        "f AS (SELECT *, min(row_no) OVER (PARTITION BY chunk_id, prio) AS fa FROM ot)",
        "i AS (SELECT *, dense_rank() OVER (PARTITION BY chunk_id ORDER BY fa) - 1 AS did FROM f)",
        select="SELECT chunk_id, row_no, did - coalesce(lag(did) OVER (PARTITION BY chunk_id ORDER BY row_no), 0) AS dict_delta FROM i",
    ),
)
def dictionary_delta(spark, sf):
    return rl.dictionary_delta(order_table(spark, sf), "prio", "row_no").select("chunk_id", "row_no", "dict_delta")


def _stamped(spark, sf):
    """A column of values with common delimiters: date, priority and price in one text."""
    t = order_table(spark, sf)
    return t.select(
        "chunk_id",
        "row_no",
        F.concat("day", F.lit("/"), "status", F.lit("_"), F.col("cust").cast("string"), F.lit(":"), "prio").alias("value"),
    )


@query(
    "column_patterns",
    with_(
        ORDER_TABLE,
        """v AS (SELECT chunk_id, row_no, day || '/' || status || '_' || cust || ':' || prio AS value FROM ot)""",
        select="SELECT DISTINCT chunk_id, regexp_replace(value, '[^-/_:]', '', 'g') AS pattern FROM v",
    ),
)
def column_patterns(spark, sf):
    return rl.column_patterns(_stamped(spark, sf), "value", "row_no")


@query(
    "pattern_fields",
    with_(
        ORDER_TABLE,
        """v AS (SELECT chunk_id, row_no, day || '/' || status || '_' || cust || ':' || prio AS value FROM ot)""",
        r"""f AS (SELECT chunk_id, row_no, value, regexp_extract_all(value, '[^-/_:]+') AS x FROM v)""",
        select="SELECT chunk_id, row_no, array_to_string(x[1:6], '|') || '|' || array_to_string(x[7:], '-') AS fields, value AS rebuilt FROM f",
    ),
)
def pattern_fields(spark, sf):
    v = _stamped(spark, sf)
    p = rl.column_patterns(v, "value", "row_no")
    fields = rl.split_by_pattern(F.col("value"), F.col("pattern"))
    return (
        v.join(p, "chunk_id")
        .withColumn("f", fields)
        .select("chunk_id", "row_no", F.array_join("f", "|").alias("fields"), rl.join_by_pattern(F.col("f"), F.col("pattern")).alias("rebuilt"))
    )


# --- headers


def _headers(spark, sf):
    e = inp.table(spark, sf, "events")
    return e.select(
        "event_id",
        F.date_format("ts", "yyyy-MM-dd").alias("date"),
        F.date_format("ts", "HH:mm:ss.SSS").alias("time"),
        F.upper("event_type").alias("level"),
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("user"),
    )


HEADER_FORMATS = """WITH h AS (
  SELECT 'date' AS col, strftime(ts, '%Y-%m-%d') AS v FROM events UNION ALL SELECT 'time', strftime(ts, '%H:%M:%S.%g') FROM events
  UNION ALL SELECT 'level', upper(event_type) FROM events UNION ALL SELECT 'user', 'u' || user_id FROM events),
p AS (SELECT col, count(*) AS n, regexp_extract_all(v, '[0-9]+|[^0-9]+') AS x FROM h GROUP BY col, v),
l AS (SELECT col, len(x) AS k, sum(n) AS kn FROM p GROUP BY col, len(x)),
s AS (SELECT col, list(k ORDER BY kn DESC, k)[1] AS mode, max(kn) AS mode_n, sum(kn) AS total FROM l GROUP BY col),
e AS (SELECT p.col, n, unnest(x[1:mode]) AS part, generate_subscripts(x[1:mode], 1) AS pos FROM p JOIN s ON p.col = s.col),
bp AS (SELECT col, pos, part, sum(n) AS pn FROM e GROUP BY col, pos, part),
pv AS (SELECT col, pos, list(part ORDER BY pn DESC, part DESC)[1] AS piv, max(pn) AS piv_n, sum(pn) AS pos_n FROM bp GROUP BY col, pos),
bw AS (SELECT col, pos, length(part) AS w, sum(pn) AS wn FROM bp GROUP BY col, pos, length(part)),
wd AS (SELECT col, pos, list(w ORDER BY wn DESC, w DESC)[1] AS width, max(wn) AS width_n FROM bw GROUP BY col, pos),
j AS (SELECT pv.col, pv.pos, regexp_full_match(piv, '[0-9]+') AS num, piv, piv_n >= 0.95 * pos_n AS agreed,
  CASE WHEN width_n >= 0.95 * pos_n THEN width ELSE -1 END AS width FROM pv JOIN wd ON pv.col = wd.col AND pv.pos = wd.pos),
g AS (SELECT col, string_agg(CASE WHEN num THEN '%d' ELSE piv END, '' ORDER BY pos) AS format, bool_and(num OR agreed) AS stable,
  count(*) FILTER (NOT num) AS texts, count(*) FILTER (num) AS numbers, bool_or(num) FILTER (pos = 1) AS starts,
  string_agg(CASE WHEN num THEN CAST(width AS VARCHAR) END, ',' ORDER BY pos) AS widths FROM j GROUP BY col),
r AS (SELECT g.*, stable AND mode_n >= 0.95 * total AND (mode > 1 OR starts) AS regular FROM g JOIN s ON g.col = s.col)
SELECT col, CASE WHEN regular THEN format ELSE '%s' END AS format, CASE WHEN regular THEN texts ELSE 1 END AS n_strings,
  CASE WHEN regular THEN numbers ELSE 0 END AS n_numbers, CASE WHEN regular THEN widths ELSE '-1' END AS widths FROM r"""


@query("header_formats", HEADER_FORMATS)
def header_formats(spark, sf):
    f = hd.header_formats(_headers(spark, sf), ["date", "time", "level", "user"])
    return f.withColumn("widths", F.array_join(F.transform("widths", lambda w: w.cast("string")), ","))


@query(
    "header_restore",
    "SELECT event_id, strftime(ts, '%Y-%m-%d') AS date, strftime(ts, '%H:%M:%S.%g') AS time FROM events",
)
def header_restore(spark, sf):
    h = _headers(spark, sf).select("event_id", "date", "time")
    formats = hd.header_formats(h, ["date", "time"])
    # one row per header column
    shape = formats.agg(F.map_from_entries(F.collect_list(F.struct("col", F.struct("format", "widths")))).alias("m"))
    coded = h.select("event_id", *[hd.header_numbers(F.col(c)).alias(c) for c in ("date", "time")])
    coded = coded.withColumn("m", shape.scalar())
    return coded.select(
        "event_id",
        *[
            hd.header_text(F.col("m")[c]["format"], F.col(c), F.col("m")[c]["widths"]).alias(c)
            for c in ("date", "time")
        ],
    )


# --- correlations and reports


def metrics(spark, sf):
    li = inp.table(spark, sf, "lineitem")
    return li.select(
        "l_returnflag",
        "l_linestatus",
        F.col("l_quantity").alias("qty"),
        F.col("l_extendedprice").alias("price"),
        F.col("l_discount").alias("discount"),
        F.col("l_tax").alias("tax"),
    )


@query(
    "pearson",
    "WITH m AS (SELECT l_quantity AS qty, l_extendedprice AS price, l_discount AS discount FROM lineitem)\n"
    "SELECT 'qty' AS x, 'price' AS y, round(corr(qty, price), 6) AS r FROM m UNION ALL SELECT 'qty', 'discount', round(corr(qty, discount), 6) FROM m\n"
    "UNION ALL SELECT 'price', 'discount', round(corr(price, discount), 6) FROM m",
)
def pearson(spark, sf):
    return st.pearson(metrics(spark, sf), ["qty", "price", "discount"]).withColumn("r", F.round("r", 6))


RANKS = """WITH m AS (SELECT l_returnflag AS f, l_linestatus AS s, l_quantity AS x, l_extendedprice AS y FROM lineitem),
r AS (SELECT f, s, rank() OVER (PARTITION BY {k} ORDER BY x) + (count(*) OVER (PARTITION BY {k}, x) - 1) / 2 AS rx,
  rank() OVER (PARTITION BY {k} ORDER BY y) + (count(*) OVER (PARTITION BY {k}, y) - 1) / 2 AS ry FROM m)
"""


@query("spearman", RANKS.format(k="1 = 1") + "SELECT round(corr(rx, ry), 6) AS rho FROM r")
def spearman(spark, sf):
    return st.spearman(metrics(spark, sf), "qty", "price").withColumn("rho", F.round("rho", 6))


@query(
    "spearman_by_group",
    RANKS.format(k="f, s") + "SELECT f AS l_returnflag, round(corr(rx, ry) FILTER (s = 'F'), 6) AS \"F\", round(corr(rx, ry) FILTER (s = 'O'), 6) AS \"O\" FROM r GROUP BY f",
)
def spearman_by_group(spark, sf):
    p = st.spearman_pivot(metrics(spark, sf), "qty", "price", "l_returnflag", "l_linestatus", ["F", "O"])
    return p.select("l_returnflag", F.round("F", 6).alias("F"), F.round("O", 6).alias("O"))


@query(
    "average_ranks",
    "SELECT l_quantity AS qty, round(min(rk) + (count(*) - 1) / 2, 6) AS rank FROM (SELECT l_quantity, rank() OVER (ORDER BY l_quantity) AS rk FROM lineitem) GROUP BY 1",
)
def average_ranks(spark, sf):
    return st.average_ranks(metrics(spark, sf), "qty").withColumn("rank", F.round("rank", 6))


@query(
    "kendall_tau",
    """WITH c AS (SELECT l_quantity AS x, l_discount AS y, count(*) AS n FROM lineitem GROUP BY 1, 2),
p AS (SELECT sum(CASE WHEN (a.x - b.x) * (a.y - b.y) > 0 THEN a.n * b.n ELSE 0 END) / 2 AS cc, sum(CASE WHEN (a.x - b.x) * (a.y - b.y) < 0 THEN a.n * b.n ELSE 0 END) / 2 AS dd FROM c a, c b),
tx AS (SELECT sum(t * (t - 1)) / 2 AS v FROM (SELECT CAST(sum(n) AS DOUBLE) AS t FROM c GROUP BY x)),
ty AS (SELECT sum(t * (t - 1)) / 2 AS v FROM (SELECT CAST(sum(n) AS DOUBLE) AS t FROM c GROUP BY y)),
nn AS (SELECT CAST(sum(n) AS DOUBLE) AS n FROM c)
SELECT CAST(nn.n AS BIGINT) AS n, CAST(cc AS DOUBLE) AS concordant, CAST(dd AS DOUBLE) AS discordant, round((cc - dd) / sqrt((nn.n * (nn.n - 1) / 2 - tx.v) * (nn.n * (nn.n - 1) / 2 - ty.v)), 9) AS tau FROM p, tx, ty, nn""",
)
def kendall_tau(spark, sf):
    return st.kendall(metrics(spark, sf), "qty", "discount").select(
        "n", "concordant", "discordant", F.round("tau", 9).alias("tau")
    )


@query(
    "average_row",
    """WITH m AS (SELECT l_returnflag AS flag, avg(l_quantity) AS qty, avg(l_tax) AS tax FROM lineitem GROUP BY 1)
SELECT flag, round(qty, 6) AS qty, round(tax, 6) AS tax FROM m UNION ALL SELECT 'Average', round(avg(qty), 6), round(avg(tax), 6) FROM m""",
)
def average_row(spark, sf):
    m = metrics(spark, sf).groupBy(F.col("l_returnflag").alias("flag")).agg(F.avg("qty").alias("qty"), F.avg("tax").alias("tax"))
    a = pf.with_average_row(m, "flag", ["qty", "tax"])
    return a.select("flag", F.round("qty", 6).alias("qty"), F.round("tax", 6).alias("tax"))


@query(
    "speed_up",
    """WITH r AS (SELECT o_orderpriority AS job, o_custkey % 5 + 1 AS threads, avg(o_totalprice) AS seconds FROM orders GROUP BY 1, 2),
b AS (SELECT job, arg_min(seconds, threads) AS bs, min(threads) AS bt FROM r GROUP BY job)
SELECT r.job, threads, round(seconds, 4) AS seconds, round(bs / seconds, 6) AS speed_up, round(bs / seconds * bt / threads, 6) AS efficiency FROM r JOIN b ON r.job = b.job""",
)
def speed_up(spark, sf):
    runs = (
        inp.table(spark, sf, "orders")
        .groupBy(F.col("o_orderpriority").alias("job"), (F.col("o_custkey") % 5 + 1).alias("threads"))
        .agg(F.avg("o_totalprice").alias("seconds"))
    )
    s = pf.speed_up(runs, ["job"], "threads", "seconds")
    return s.select(
        "job",
        "threads",
        F.round("seconds", 4).alias("seconds"),
        F.round("speed_up", 6).alias("speed_up"),
        F.round("efficiency", 6).alias("efficiency"),
    )
