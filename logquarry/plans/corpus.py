"""Templates of a whole corpus by similarity and by partitions."""

from __future__ import annotations

from pyspark.sql import functions as F

from logquarry.functions import tokens as tk
from logquarry.operators import partitions as pt
from logquarry.operators import similarity as sm
from logquarry.operators import templates as tp
from logquarry.plans import inputs as inp
from logquarry.plans.registry import query, with_

# --- similarity


def kind_lines(spark, sf):
    """Line items as lines of up to 42 kinds with one variable each, which no two lines share."""
    li = inp.table(spark, sf, "lineitem")
    return li.select(
        F.expr(f"l_orderkey div {inp.ORDER_CHUNK}").alias("chunk_id"),
        (F.col("l_orderkey") * 16 + F.col("l_linenumber")).alias("line_no"),
        F.concat(
            F.lit("flag"), "l_returnflag", F.lit(" item state"), "l_linestatus", F.lit(" of line"), F.col("l_linenumber").cast("string"),
            F.lit(" number n"), (F.col("l_orderkey") * 16 + F.col("l_linenumber")).cast("string"), F.lit(" done"),
        ).alias("line"),
    )


KIND_LINES = f"""kind_lines AS (
  SELECT l_orderkey // {inp.ORDER_CHUNK} AS chunk_id, l_orderkey * 16 + l_linenumber AS line_no,
    'flag' || l_returnflag || ' item state' || l_linestatus || ' of line' || l_linenumber || ' number n' AS head, l_orderkey * 16 + l_linenumber AS v
  FROM lineitem)"""
KIND_TEMPLATES = """k AS (SELECT regexp_replace(head, ' n$', ' ') || CASE WHEN count(*) = 1 THEN 'n' || any_value(v) ELSE '<*>' END || ' done' AS template, count(*) AS n_lines FROM kind_lines GROUP BY head)"""


@query("corpus_templates", with_(KIND_LINES, KIND_TEMPLATES, select="SELECT template, n_lines, substr(md5(template), 1, 8) AS event_id FROM k"))
def corpus_templates(spark, sf):
    """Small blocks, so that the forms take several rounds."""
    return sm.template_totals(sm.similarity_templates(kind_lines(spark, sf), 0.8, cells=2048))


@query("corpus_separator_templates", with_(KIND_LINES, KIND_TEMPLATES, select="SELECT template, n_lines, substr(md5(template), 1, 8) AS event_id FROM k"))
def corpus_separator_templates(spark, sf):
    return sm.template_totals(sm.separator_templates(kind_lines(spark, sf), 0.45, cells=4096))


CLICK = ["<*>", "CLICK", "user=<*>", "value=<*>", 'props={"k":', "7}"]


@query(
    "template_similarity",
    with_(
        inp.EVENT_LINES,
        "w AS (SELECT chunk_id, line_no, string_split(line, ' ')[2:] AS w, [" + ", ".join(f"'{w}'" for w in CLICK) + "] AS t FROM event_lines)",
        """z AS (SELECT chunk_id, line_no, w, t, list_transform(generate_series(1, 6), lambda i: t[i] = w[i]) AS same FROM w)""",
        select="""SELECT chunk_id, line_no, list_sum(list_transform(same, lambda b: CAST(b AS INT))) / 6 AS alike,
  array_to_string(list_transform(generate_series(1, 6), lambda i: CASE WHEN same[i] THEN t[i] ELSE '<*>' END), ' ') AS both,
  CAST(list_sum(list_transform(same, lambda b: 1 - CAST(b AS INT))) AS INT) AS wild FROM z""",
    ),
)
def template_similarity(spark, sf):
    """Each line against one template: share of equal words, and the template of both."""
    words = F.slice(tp.words("line"), 2, 6)
    t = F.array(*[F.lit(w) for w in CLICK])
    both = sm.merged(t, words)
    return inp.event_lines(spark, sf).select(
        "chunk_id", "line_no", sm.similarity(t, words).alias("alike"), F.array_join(both, " ").alias("both"), sm.wildcards(both).alias("wild")
    )


ORDER_TEMPLATE = ["order", " ", "<*>", " ", "cust", "=", "<*>", " ", "status", "=", "O", " ", "total", "=", "<*>", " ", "at", " ", "<*>", " "]
ORDER_TEMPLATE += ["<*>", ":", "<*>", ":", "<*>", " ", "prio", " ", "1-URGENT"]


@query(
    "template_similarity_separators",
    with_(
        inp.ORDER_LINES,
        # words of a line that equals the template but for its key, customer, status, total, time and priority
        "w AS (SELECT chunk_id, line_no, line, regexp_extract(line, 'status=(.)', 1) AS s, regexp_extract(line, 'prio (.*)$', 1) AS p FROM order_lines)",
        select="SELECT chunk_id, line_no, CASE WHEN len(string_split(p, ' ')) = 1 THEN (6 + CAST(s = 'O' AS INT) + CAST(p = '1-URGENT' AS INT)) / 29 ELSE -1 END AS alike FROM w",
    ),
)
def template_similarity_separators(spark, sf):
    """Separators must agree and count for nothing."""
    t = F.array(*[F.lit(w) for w in ORDER_TEMPLATE])
    parts = tk.mask_number_tokens(tk.separator_tokens(F.col("line")))
    same_length = F.when(F.size(parts) == F.size(t), sm.separator_similarity(t, parts)).otherwise(-1.0)
    return inp.order_lines(spark, sf).select("chunk_id", "line_no", same_length.alias("alike"))


# --- similarity templates of two sources



@query("similarity_templates")
def similarity_templates(spark, sf):
    m = sm.similarity_templates(inp.event_lines(spark, sf).union(inp.order_lines(spark, sf)), 0.6, [inp.TIME_PATTERN, r"(?<==)[\d.]+"])
    return sm.template_totals(m)


@query("separator_templates")
def separator_templates(spark, sf):
    lines = inp.event_lines(spark, sf).union(inp.order_lines(spark, sf))
    return sm.template_totals(sm.separator_templates(lines, 0.1))


# --- partitioning


def split_lines(spark, sf):
    """Line items as lines of five lengths without a constant word, so every step of partitioning splits."""
    li = inp.table(spark, sf, "lineitem")
    more = F.transform(
        F.sequence(F.lit(0), F.col("l_linenumber") % 5),
        lambda j: F.when(j == 0, "").otherwise(F.concat(F.lit(" m"), ((F.col("l_partkey") + j) % 3).cast("string"))),
    )
    word = lambda mark, c: F.concat(F.lit(mark), c.cast("string"))
    fixed = F.concat_ws(
        " ", word("f", F.col("l_returnflag")), word("s", F.col("l_linestatus")), word("p", F.col("l_partkey") % 5), word("q", F.col("l_quantity").cast("int"))
    )
    return li.select(F.concat(fixed, F.array_join(more, "")).alias("line"))


SPLIT_LINES = """split_lines AS (
  SELECT 'f' || l_returnflag || ' s' || l_linestatus || ' p' || l_partkey % 5 || ' q' || CAST(l_quantity AS INT)
    || array_to_string(list_transform(range(1, l_linenumber % 5 + 1), lambda j: ' m' || (l_partkey + j) % 3), '') AS line FROM lineitem)"""

WORDS_SQL = r"list_filter(string_split_regex(line, '[\s=:,]'), lambda x: x <> '')"
PART_ROWS = (
    SPLIT_LINES,
    f"dw AS (SELECT {WORDS_SQL} AS words, count(*) AS n FROM split_lines GROUP BY 1)",
    "p1 AS (SELECT 'len=' || len(words) AS part, * FROM dw)",
    "x1 AS (SELECT part, generate_subscripts(words, 1) AS pos, unnest(words) AS word FROM p1)",
    "c1 AS (SELECT part, pos, count(DISTINCT word) AS nd FROM x1 GROUP BY part, pos)",
    "b1 AS (SELECT part, arg_min(pos, nd * 100000 + pos) AS pos, min(nd) AS nd FROM c1 GROUP BY part)",
    """p2 AS (SELECT CASE WHEN nd > 1 THEN p.part || '/2:' || words[pos] ELSE p.part END AS part, words, n FROM p1 p JOIN b1 b ON p.part = b.part)""",
)


def _step2(spark, sf):
    return pt.step2(pt.step1(pt.distinct_words(split_lines(spark, sf))))


@query("partition_step1", with_(*PART_ROWS, select="SELECT part, count(*) AS n_distinct, CAST(sum(n) AS BIGINT) AS n_lines FROM p1 GROUP BY part"))
def partition_step1(spark, sf):
    p = pt.step1(pt.distinct_words(split_lines(spark, sf)))
    return p.groupBy("part").agg(F.count(F.lit(1)).alias("n_distinct"), F.sum("n").alias("n_lines"))


@query("position_counts", with_(*PART_ROWS, select="SELECT part, CAST(pos - 1 AS BIGINT) AS pos, nd FROM c1"))
def position_counts(spark, sf):
    p = pt.step1(pt.distinct_words(split_lines(spark, sf)))
    return pt.position_counts(p).select("part", F.col("pos").cast("bigint").alias("pos"), "nd")


@query("partition_step2", with_(*PART_ROWS, select="SELECT part, count(*) AS n_distinct, CAST(sum(n) AS BIGINT) AS n_lines FROM p2 GROUP BY part"))
def partition_step2(spark, sf):
    return _step2(spark, sf).groupBy("part").agg(F.count(F.lit(1)).alias("n_distinct"), F.sum("n").alias("n_lines"))


@query(
    "partition_step4",
    with_(
        *PART_ROWS,
        "x2 AS (SELECT part, generate_subscripts(words, 1) AS pos, unnest(words) AS word FROM p2)",
        "t2 AS (SELECT part, pos, CASE WHEN count(DISTINCT word) = 1 THEN min(word) ELSE '<*>' END AS w FROM x2 GROUP BY part, pos)",
        "s2 AS (SELECT part, sum(n) AS n FROM p2 GROUP BY part)",
        select="SELECT t2.part, string_agg(w, ' ' ORDER BY pos) AS template, CAST(any_value(n) AS BIGINT) AS n_lines FROM t2 JOIN s2 ON t2.part = s2.part GROUP BY t2.part",
    ),
)
def partition_step4(spark, sf):
    return pt.step4(_step2(spark, sf))


@query("partition_templates")
def partition_templates(spark, sf):
    return pt.partition_templates(split_lines(spark, sf))


# order keys as two-word lines, where step 3 always picks positions 0 and 1

@query(
    "relation_split",
    """WITH l AS (SELECT 'k' || (p_partkey % 40 // 4) AS t1, 's' || (CASE WHEN p_partkey % 40 < 12 THEN p_partkey % 40 // 4 WHEN p_partkey % 40 < 20 THEN p_partkey % 40
  WHEN p_partkey % 40 < 32 THEN 100 ELSE p_size END) AS t2 FROM part),
e AS (SELECT t1, t2, count(*) AS n FROM l GROUP BY t1, t2),
d AS (SELECT *, count(*) OVER (PARTITION BY t1) AS deg1, count(*) OVER (PARTITION BY t2) AS deg2, sum(n) OVER (PARTITION BY t1) AS n1, sum(n) OVER (PARTITION BY t2) AS n2 FROM e),
f AS (SELECT *, max(deg2) OVER (PARTITION BY t1) AS far2, max(deg1) OVER (PARTITION BY t2) AS far1 FROM d),
k AS (SELECT *, CASE WHEN deg1 = 1 AND deg2 = 1 THEN '1-1' WHEN deg1 > 1 AND far2 = 1 THEN '1-M' WHEN deg2 > 1 AND far1 = 1 THEN 'M-1' ELSE 'M-M' END AS kind FROM f),
m AS (SELECT count(DISTINCT t1) AS left1, count(DISTINCT t2) AS left2 FROM k WHERE kind = 'M-M'),
s AS (SELECT n, 'len=2/3:w:' || CASE kind WHEN '1-1' THEN t1 WHEN '1-M' THEN CASE WHEN deg1 / n1 <= 0.25 THEN t2 ELSE t1 END
  WHEN 'M-1' THEN CASE WHEN deg2 / n2 <= 0.25 THEN t1 ELSE t2 END ELSE CASE WHEN left1 < left2 THEN t1 ELSE t2 END END AS part FROM k, m)
SELECT part, CAST(sum(n) AS BIGINT) AS n_lines FROM s GROUP BY part""",
)
def relation_split(spark, sf):
    m = F.col("p_partkey") % 40
    four = F.expr("p_partkey % 40 div 4")
    second = (
        F.when(m < 12, four).when(m < 20, m).when(m < 32, 100).otherwise(F.col("p_size"))
    )
    lines = inp.table(spark, sf, "part").select(
        F.concat(F.lit("k"), four.cast("string"), F.lit(" s"), second.cast("string")).alias("line")
    )
    parts = pt.step3(pt.step1(pt.distinct_words(lines)))
    return parts.groupBy("part").agg(F.sum("n").alias("n_lines"))
