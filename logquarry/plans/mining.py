"""Templates, partitions and word clusters mined from lines, and their scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from logquarry.functions import tokens as tk
from logquarry.operators import numbers as nm
from logquarry.operators import scoring as sc
from logquarry.operators import tagging as tg
from logquarry.operators import templates as tp
from logquarry.operators import wordclusters as wc
from logquarry.plans import inputs as inp
from logquarry.plans.registry import query, with_
from logquarry.session import cut_lineage

# --- scores: the generic parser taken as truth, the tagger as prediction

ORDER_CELLS = (
    inp.ORDER_LINES,
    inp.pieces_sql("order_lines", inp.TIME_PATTERN),
    f"""both_ AS (SELECT chunk_id, line_no, string_agg(CASE WHEN tag = '' THEN text WHEN tag = '{inp.TIME_TAG}' THEN tag ELSE '<*>' END, '' ORDER BY pos) AS truth,
  string_agg(CASE WHEN tag = '' THEN text WHEN tag = '<LEN=1>' THEN '<*>' WHEN tag LIKE '%CTX=cust%' THEN '<*>' WHEN tag = '{inp.TIME_TAG}' THEN tag WHEN tag LIKE '<IDX=2|%' THEN '<*>' WHEN tag LIKE '%total%' AND tag NOT LIKE '%{{6}}%' THEN '<*>' ELSE tag END, '' ORDER BY pos) AS parsed
  FROM pieces GROUP BY chunk_id, line_no)""",
    "cells AS (SELECT truth, parsed, count(*) AS n FROM both_ GROUP BY truth, parsed)",
)


def order_cells(spark, sf):
    lines = inp.order_lines(spark, sf)
    truth = tg.tag_lines(lines, inp.EVENT_PATTERNS, style="generic")
    tagged = tg.tag_lines(lines, inp.EVENT_PATTERNS)
    loose = F.transform(
        F.col("parts.tags"),
        lambda t: F.when(t == inp.TIME_TAG, t)
        .when(
            (t == "<LEN=1>")
            | t.contains("CTX=cust")
            | t.startswith("<IDX=2|")
            | (t.contains("total") & ~t.contains("{6}")),
            F.lit("<*>"),
        )
        .otherwise(t),
    )
    a = truth.select("chunk_id", "line_no", tg.parts_template(F.col("parts")).alias("template"))
    b = tagged.select("chunk_id", "line_no", tg.template_text(F.col("parts.statics"), loose).alias("template"))
    return sc.cells(sc.align(a, b, ["chunk_id", "line_no"]))


def rounded(df, *cols):
    return df.select(*[F.round(c, 6).alias(c) if c in cols else F.col(c) for c in df.columns])


@query("score_cells", with_(*ORDER_CELLS, select="SELECT truth, parsed, n FROM cells"))
def score_cells(spark, sf):
    return order_cells(spark, sf)


@query(
    "group_accuracy",
    with_(
        *ORDER_CELLS,
        "g AS (SELECT n, sum(n) OVER (PARTITION BY truth) AS a, sum(n) OVER (PARTITION BY parsed) AS b FROM cells)",
        select="""SELECT CAST(sum(n) AS BIGINT) AS n_lines, CAST(coalesce(sum(n) FILTER (n = a AND n = b), 0) AS BIGINT) AS n_accurate,
  round(coalesce(sum(n) FILTER (n = a AND n = b), 0) / sum(n), 6) AS group_accuracy FROM g""",
    ),
)
def group_accuracy(spark, sf):
    return rounded(sc.group_accuracy(order_cells(spark, sf)), "group_accuracy")


@query(
    "pairwise_scores",
    with_(
        *ORDER_CELLS,
        """s AS (SELECT (SELECT sum(x * (x - 1) / 2) FROM (SELECT sum(n) AS x FROM cells GROUP BY truth)) AS t,
  (SELECT sum(x * (x - 1) / 2) FROM (SELECT sum(n) AS x FROM cells GROUP BY parsed)) AS p, (SELECT sum(n * (n - 1) / 2) FROM cells) AS b)""",
        select="""SELECT CAST(t AS DOUBLE) AS true_pairs, CAST(p AS DOUBLE) AS parsed_pairs, CAST(b AS DOUBLE) AS common_pairs, round(b / p, 6) AS precision, round(b / t, 6) AS recall,
  round(2 * (b / p) * (b / t) / (b / p + b / t), 6) AS pairwise_f1 FROM s""",
    ),
)
def pairwise_scores(spark, sf):
    return rounded(sc.pairwise_scores(order_cells(spark, sf)), "precision", "recall", "pairwise_f1")


@query(
    "parsing_accuracy",
    with_(*ORDER_CELLS, select="SELECT round(sum(CASE WHEN truth = parsed THEN n ELSE 0 END) / sum(n), 6) AS parsing_accuracy FROM cells"),
)
def parsing_accuracy(spark, sf):
    return rounded(sc.parsing_accuracy(order_cells(spark, sf)), "parsing_accuracy")


@query(
    "template_accuracy",
    with_(
        *ORDER_CELLS,
        """s AS (SELECT (SELECT count(DISTINCT parsed) FROM cells) AS n_parsed, (SELECT count(DISTINCT truth) FROM cells) AS n_truth,
  (SELECT count(*) FROM (SELECT parsed FROM cells GROUP BY parsed HAVING count(DISTINCT truth) = 1 AND min(truth) = parsed)) AS n_correct)""",
        select="""SELECT n_parsed, n_truth, n_correct, round(n_correct / n_parsed, 6) AS pta, round(n_correct / n_truth, 6) AS rta,
  CASE WHEN n_correct = 0 THEN 0.0::DOUBLE ELSE round(2 * (n_correct / n_parsed) * (n_correct / n_truth) / (n_correct / n_parsed + n_correct / n_truth), 6) END AS fta FROM s""",
    ),
)
def template_accuracy(spark, sf):
    return rounded(sc.template_accuracy(order_cells(spark, sf)), "pta", "rta", "fta")


# --- known templates


EVENT_TEMPLATES = [
    f"<*> <*> {level} <*> <*> <*> <*>" for level in ("CLICK", "PURCHASE", "ERROR", "SIGNUP")
]


def event_templates(spark):
    rows = [(i + 1, t) for i, t in enumerate(EVENT_TEMPLATES)]
    return spark.createDataFrame(rows, "template_id long, template string")


@query(
    "template_match",
    with_(
        inp.EVENT_LINES,
        select="""SELECT chunk_id, line_no, CASE string_split(line, ' ')[3] WHEN 'CLICK' THEN 1 WHEN 'PURCHASE' THEN 2 WHEN 'ERROR' THEN 3 WHEN 'SIGNUP' THEN 4 END::BIGINT AS template_id
FROM event_lines""",
    ),
)
def template_match(spark, sf):
    m = tp.match_templates(inp.event_lines(spark, sf), event_templates(spark), ["chunk_id", "line_no"])
    return m.select("chunk_id", "line_no", "template_id")


@query(
    "unmatched_lines",
    with_(inp.EVENT_LINES, select="SELECT chunk_id, count(*) AS n FROM event_lines WHERE line LIKE '% VIEW %' GROUP BY chunk_id"),
)
def unmatched_lines(spark, sf):
    m = tp.match_templates(inp.event_lines(spark, sf), event_templates(spark), ["chunk_id", "line_no"])
    return m.filter("template_id is null").groupBy("chunk_id").agg(F.count(F.lit(1)).alias("n"))


def _event_template():
    words = F.split("line", " ")
    return F.concat(F.lit("<*> <*> "), words[2], F.lit(" user=<*> value=<*> props={\"k\": <*>"))


@query(
    "template_params",
    with_(
        inp.EVENT_LINES,
        select=r"""SELECT chunk_id, line_no, array_to_string([string_split(line, ' ')[1], string_split(line, ' ')[2], regexp_extract(line, 'user=(\S+)', 1),
  regexp_extract(line, 'value=(\S+)', 1), string_split(line, ' ')[7]], '|') AS params FROM event_lines""",
    ),
)
def template_params(spark, sf):
    t = inp.event_lines(spark, sf).withColumn("template", _event_template())
    return tp.template_params(t).select("chunk_id", "line_no", F.array_join("params", "|").alias("params"))


@query(
    "template_params_regex",
    with_(
        inp.EVENT_LINES,
        select=r"""SELECT chunk_id, line_no, regexp_extract(line, 'user=(\S+)', 1) || '|' || regexp_extract(line, 'value=(\S+)', 1) || '|' || regexp_extract(line, 'props=(.*)$', 1) AS params
FROM event_lines""",
    ),
)
def template_params_regex(spark, sf):
    level = F.concat(F.split("line", " ")[0], F.lit(" "), F.split("line", " ")[1], F.lit(" "), F.split("line", " ")[2])
    t = inp.event_lines(spark, sf).withColumn("template", F.concat(level, F.lit(" user=<*> value=<*> props=<*>")))
    return tp.template_params_regex(t).select("chunk_id", "line_no", F.array_join("params", "|").alias("params"))


@query(
    "variable_columns",
    with_(
        inp.EVENT_LINES,
        """v AS (SELECT string_split(line, ' ')[3] AS lvl, unnest(string_split(line, ' ')) AS value, generate_subscripts(string_split(line, ' '), 1) AS position FROM event_lines)""",
        select="""SELECT '<*> <*> ' || lvl || ' user=<*> value=<*> props={"k": <*>' AS template, position, count(*) AS n, count(DISTINCT value) AS n_distinct,
  bool_and(regexp_full_match(value, '[0-9]+')) AS is_number FROM v WHERE position NOT IN (3, 6) GROUP BY ALL""",
    ),
)
def variable_columns(spark, sf):
    t = inp.event_lines(spark, sf).withColumn("template", _event_template())
    v = tp.variable_columns(t, ["chunk_id", "line_no"])
    # values are counted before columns are summed up
    counted = v.groupBy("template", "position", "value").agg(F.count(F.lit(1)).alias("n"))
    return counted.groupBy("template", "position").agg(
        F.sum("n").alias("n"),
        F.count(F.lit(1)).alias("n_distinct"),
        F.bool_and(tk.is_number(F.col("value"))).alias("is_number"),
    )


@query(
    "parameter_list_columns",
    """WITH p AS (SELECT o_orderstatus AS template, unnest([CAST(o_custkey AS VARCHAR), o_orderpriority]) AS value, unnest([1, 2]) AS position FROM orders)
SELECT template, CAST(position AS BIGINT) AS position, count(*) AS n, count(DISTINCT value) AS n_distinct FROM p GROUP BY ALL""",
)
def parameter_list_columns(spark, sf):
    text = F.concat(F.lit("['"), F.col("o_custkey").cast("string"), F.lit("', '"), F.col("o_orderpriority"), F.lit("']"))
    o = inp.table(spark, sf, "orders").select("o_orderkey", F.col("o_orderstatus").alias("template"), tk.parameter_list(text).alias("params"))
    v = tp.parameter_columns(o, ["o_orderkey"])
    return v.groupBy("template", "position").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("value").alias("n_distinct")
    )


@query("damaged_template")
def damaged_template(spark, sf):
    t = inp.event_lines(spark, sf).withColumn("template", _event_template())
    d = tp.damage_template(t, ["chunk_id", "line_no"], seed=7)
    return d.groupBy("touched").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("template").alias("n_templates"))


@query(
    "frequent_templates",
    f"""WITH d AS (SELECT unnest(string_split(text, chr(10))) AS template FROM documents)
SELECT template, count(*) AS n FROM d GROUP BY template HAVING count(*) >= 2""",
)
def frequent_templates(spark, sf):
    return tp.frequent_templates(inp.doc_lines(spark, sf).select(F.col("line").alias("template")))


@query(
    "event_fallback",
    """SELECT event_id, CASE WHEN event_type IN ('click', 'view') THEN 'seen <*>' ELSE event_type || ' ' || user_id END AS event_template FROM events""",
)
def event_fallback(spark, sf):
    e = inp.table(spark, sf, "events")
    lines = e.select("event_id", F.concat_ws(" ", "event_type", F.col("user_id").cast("string")).alias("line"))
    known = e.filter(F.col("event_type").isin("click", "view")).select("event_id", F.lit("seen <*>").alias("template"))
    return tp.with_event(lines, known, ["event_id"]).select("event_id", "event_template")


# --- number groups


@query(
    "number_groups",
    with_(
        inp.ORDER_LINES,
        "r AS (SELECT chunk_id, unnest(regexp_extract_all(line, '[0-9]+')) AS x FROM order_lines)",
        select="""SELECT chunk_id, '<' || chr(CAST(96 + length(x) AS INTEGER)) || CASE WHEN length(x) >= 4 THEN chr(CAST(97 + CAST(x[1] AS BIGINT) AS INTEGER)) ELSE '' END || '>' AS grp,
  count(*) AS n, CAST(sum(CAST(x AS BIGINT)) AS BIGINT) AS total FROM r WHERE length(x) < 15 GROUP BY ALL""",
    ),
)
def number_groups(spark, sf):
    g = nm.number_groups(inp.order_lines(spark, sf))
    return g.groupBy("chunk_id", "grp").agg(F.count(F.lit(1)).alias("n"), F.sum("num").alias("total"))


@query(
    "number_columns",
    with_(
        inp.ORDER_LINES,
        "r AS (SELECT chunk_id, line_no, unnest(regexp_extract_all(line, '[0-9]+')) AS x, generate_subscripts(regexp_extract_all(line, '[0-9]+'), 1) - 1 AS seq FROM order_lines)",
        """g AS (SELECT chunk_id, line_no, seq, CAST(x AS BIGINT) AS v,
  '<' || chr(CAST(96 + length(x) AS INTEGER)) || CASE WHEN length(x) >= 4 THEN chr(CAST(97 + CAST(x[1] AS BIGINT) AS INTEGER)) ELSE '' END || '>' AS grp FROM r)""",
        select="""SELECT chunk_id, line_no, CAST(seq AS BIGINT) AS seq, grp, CASE WHEN grp IN ('<a>', '<b>', '<c>') THEN v
  ELSE v - coalesce(lag(v) OVER (PARTITION BY chunk_id, grp ORDER BY line_no, seq), 0) END AS stored FROM g""",
    ),
)
def number_columns(spark, sf):
    return nm.number_columns(nm.number_groups(inp.order_lines(spark, sf))).select(
        "chunk_id", "line_no", "seq", "grp", "stored"
    )


@query(
    "number_restore",
    with_(
        inp.ORDER_LINES,
        select="""SELECT chunk_id, line_no, CAST(unnest(range(len(regexp_extract_all(line, '[0-9]+')))) AS BIGINT) AS seq, unnest(regexp_extract_all(line, '[0-9]+')) AS digits FROM order_lines""",
    ),
)
def number_restore(spark, sf):
    g = nm.number_columns(nm.number_groups(inp.order_lines(spark, sf))).drop("num")
    return nm.restore_numbers(g).select("chunk_id", "line_no", "seq", "digits")


@query(
    "delimiter_templates",
    with_(
        inp.ORDER_LINES,
        select="""SELECT template, count(*) AS n FROM (SELECT array_to_string(list_transform(regexp_extract_all(line, '[ _]|[^ _]+'),
  lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN '<*>' ELSE x END), '') AS template FROM order_lines) GROUP BY template""",
    ),
)
def delimiter_templates(spark, sf):
    t = nm.mask_by_delimiters(F.col("line"), [" ", "_"])
    return inp.order_lines(spark, sf).groupBy(t.alias("template")).agg(F.count(F.lit(1)).alias("n"))


# --- word clusters

SUPPORT = 2.0
WORD_ROWS = (
    inp.EVENT_LINES,
    r"w AS (SELECT chunk_id, line_no, string_split_regex(line, '\s+') AS ws FROM event_lines)",
    "u AS (SELECT chunk_id, line_no, unnest(list_distinct(ws)) AS word FROM w)",
    f"fw AS (SELECT word, count(*) AS n FROM u GROUP BY word HAVING count(*) >= (SELECT floor(count(*) * {SUPPORT} / 100) FROM event_lines))",
    "x AS (SELECT chunk_id, line_no, len(ws) AS k, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM w)",
    "y AS (SELECT x.* FROM x JOIN fw ON x.word = fw.word)",
    "g AS (SELECT chunk_id, line_no, k, word, pos, pos - coalesce(lag(pos) OVER (PARTITION BY chunk_id, line_no ORDER BY pos), 0) - 1 AS gap FROM y)",
    """c AS (SELECT chunk_id, line_no, string_agg(word, ' ' ORDER BY pos) AS words, count(*) AS nw, any_value(k) - max(pos) AS tail FROM g GROUP BY chunk_id, line_no)""",
    """gaps AS (SELECT c.words, g2.i, g2.gap FROM c JOIN (SELECT chunk_id, line_no, row_number() OVER (PARTITION BY chunk_id, line_no ORDER BY pos) AS i, gap FROM g
  UNION ALL SELECT chunk_id, line_no, nw + 1, tail FROM c) g2 ON c.chunk_id = g2.chunk_id AND c.line_no = g2.line_no)""",
    "sp AS (SELECT words, i, count(*) AS n, min(gap) AS lo, max(gap) AS hi FROM gaps GROUP BY words, i)",
    "cand AS (SELECT words, any_value(n) AS n, string_agg(lo || '-' || hi, ',' ORDER BY i) AS gaps FROM sp GROUP BY words)",
)
KEYS = ["chunk_id", "line_no"]


def _frequent(spark, sf):
    return wc.frequent_words(inp.event_lines(spark, sf), relative=SUPPORT)


def _per_line(spark, sf):
    return wc.line_candidates(inp.event_lines(spark, sf), _frequent(spark, sf), KEYS)


def _cands(spark, sf):
    # written once: dependencies and weights both read it
    return cut_lineage(wc.candidates(_per_line(spark, sf)))


def _spans():
    return F.array_join(
        F.zip_with("gap_min", "gap_max", lambda a, b: F.concat_ws("-", a.cast("string"), b.cast("string"))), ","
    )


@query("frequent_words", with_(*WORD_ROWS, select="SELECT word, n FROM fw"))
def frequent_words(spark, sf):
    return _frequent(spark, sf)


@query("word_candidates", with_(*WORD_ROWS, select="SELECT words, n, gaps FROM cand"))
def word_candidates(spark, sf):
    return _cands(spark, sf).select(F.array_join("words", " ").alias("words"), "n", _spans().alias("gaps"))


@query("frequent_candidates", with_(*WORD_ROWS, select="SELECT words, n FROM cand WHERE n >= 60"))
def frequent_candidates(spark, sf):
    return wc.frequent_candidates(_cands(spark, sf), 60).select(F.array_join("words", " ").alias("words"), "n")


@query("top_candidates", with_(*WORD_ROWS, select="SELECT words, n FROM cand ORDER BY n DESC, string_split(words, ' ') LIMIT 25"))
def top_candidates(spark, sf):
    return wc.top_candidates(_cands(spark, sf), 25).select(F.array_join("words", " ").alias("words"), "n")


DEPS = (
    *WORD_ROWS,
    "cw AS (SELECT words, n, unnest(list_distinct(string_split(words, ' '))) AS word FROM cand)",
    "pr AS (SELECT a.word AS w1, b.word AS w2, sum(a.n) AS both_n FROM cw a JOIN cw b ON a.words = b.words GROUP BY a.word, b.word)",
    "dep AS (SELECT p.w1, p.w2, p.both_n / o.both_n AS dep FROM pr p JOIN pr o ON p.w1 = o.w1 AND o.w1 = o.w2)",
)


@query("word_dependencies", with_(*DEPS, select="SELECT w1, w2, round(dep, 6) AS dep FROM dep"))
def word_dependencies(spark, sf):
    return rounded(wc.dependencies(_cands(spark, sf)), "dep")


WEIGHTS = {
    1: "sum(dep) / len(string_split(words, ' '))",
    2: "CASE WHEN len(string_split(words, ' ')) = 1 THEN 1.0 ELSE sum(CASE WHEN w1 <> w2 THEN dep ELSE 0 END) / (len(string_split(words, ' ')) - 1) END",
    3: "sum(dep + back) / (2 * len(string_split(words, ' ')))",
    4: "CASE WHEN len(string_split(words, ' ')) = 1 THEN 1.0 ELSE sum(CASE WHEN w1 <> w2 THEN dep + back ELSE 0 END) / (2 * (len(string_split(words, ' ')) - 1)) END",
}
WEIGHT_ROWS = (
    *DEPS,
    "d2 AS (SELECT a.w1, a.w2, a.dep, b.dep AS back FROM dep a JOIN dep b ON a.w1 = b.w2 AND a.w2 = b.w1)",
    "cx AS (SELECT a.words, a.n, a.word AS w2, b.word AS w1 FROM cw a JOIN cw b ON a.words = b.words)",
)


def _register_weights(function: int) -> None:
    @query(
        f"word_weights_{function}",
        with_(
            *WEIGHT_ROWS,
            select=f"""SELECT cx.words, cx.w2 AS word, round({WEIGHTS[function]}, 6) AS weight
FROM cx JOIN d2 ON cx.w1 = d2.w1 AND cx.w2 = d2.w2 GROUP BY cx.words, cx.w2""".replace("w1 <> w2", "cx.w1 <> cx.w2"),
        ),
    )
    def word_weights(spark, sf):
        c = _cands(spark, sf)
        w = wc.word_weights(c, wc.dependencies(c), function)
        flat = w.select(F.array_join("words", " ").alias("words"), F.explode(F.arrays_zip("words", "weights")).alias("z"))
        # words of a candidate are distinct here, but for dates beside other words
        return flat.select("words", F.col("z.words").alias("word"), F.round("z.weights", 6).alias("weight")).distinct()


for _function in WEIGHTS:
    _register_weights(_function)


@query(
    "word_clusters",
    with_(
        *WORD_ROWS,
        """tx AS (SELECT s.words, s.n, string_agg(CASE WHEN s.i > len(string_split(s.words, ' ')) THEN CASE WHEN hi > 0 THEN '*{' || lo || ',' || hi || '}' END
  ELSE CASE WHEN hi > 0 THEN '*{' || lo || ',' || hi || '} ' ELSE '' END || string_split(s.words, ' ')[s.i] END, ' ' ORDER BY s.i) AS cluster FROM sp s GROUP BY s.words, s.n)""",
        select="SELECT cluster, n FROM tx WHERE n >= 20",
    ),
)
def word_clusters(spark, sf):
    c = wc.plain_clusters(wc.frequent_candidates(_cands(spark, sf), 20))
    return c.select(
        wc.cluster_text(F.col("words"), F.col("alts"), F.col("gap_min"), F.col("gap_max")).alias("cluster"), "n"
    )


def _joined(spark, sf, wildcard):
    c = _cands(spark, sf)
    w = wc.word_weights(wc.frequent_candidates(c, 20), wc.dependencies(c), 1)
    j = wc.join_by_weight(w, 0.45, wildcard)
    return j.select(
        wc.cluster_text(F.col("words"), F.col("alts"), F.col("gap_min"), F.col("gap_max")).alias("cluster"), "n"
    )


JOINED = (
    *WEIGHT_ROWS,
    "wt AS (SELECT cx.words, cx.w2 AS word, sum(dep) / len(string_split(cx.words, ' ')) AS w FROM cx JOIN d2 ON cx.w1 = d2.w1 AND cx.w2 = d2.w2 WHERE n >= 20 GROUP BY cx.words, cx.w2)",
    "ps AS (SELECT words, n, unnest(string_split(words, ' ')) AS word, generate_subscripts(string_split(words, ' '), 1) AS i FROM cand WHERE n >= 20)",
    "pw AS (SELECT ps.*, w >= 0.45 AS heavy FROM ps JOIN wt ON ps.words = wt.words AND ps.word = wt.word)",
    "ky AS (SELECT words, string_agg(CASE WHEN heavy THEN word ELSE '' END, ' ' ORDER BY i) AS key FROM pw GROUP BY words)",
    """sg AS (SELECT key, sp.i, sum(sp.n) AS n, min(lo) AS lo, max(hi) AS hi, max(CASE WHEN heavy THEN word END) AS word,
  list_sort(list_distinct(list(word) FILTER (NOT heavy))) AS alts FROM sp JOIN ky ON sp.words = ky.words LEFT JOIN pw ON pw.words = sp.words AND pw.i = sp.i GROUP BY key, sp.i)""",
    """tx AS (SELECT key, i, n, CASE WHEN hi > 0 THEN '*{' || lo || ',' || hi || '}' END AS gap,
  coalesce(word, CASE WHEN len(alts) > 1 THEN '(' || array_to_string(alts, '|') || ')' WHEN len(alts) = 1 THEN alts[1] END) AS body FROM sg)""",
)


@query(
    "joined_clusters",
    with_(
        *JOINED,
        select="SELECT string_agg(concat_ws(' ', gap, body), ' ' ORDER BY i) FILTER (gap IS NOT NULL OR body IS NOT NULL) AS cluster, CAST(any_value(n) AS BIGINT) AS n FROM tx GROUP BY key",
    ),
)
def joined_clusters(spark, sf):
    return _joined(spark, sf, False)


@query("joined_clusters_wildcard")
def joined_clusters_wildcard(spark, sf):
    return _joined(spark, sf, True)


@query(
    "common_cluster_words",
    with_(
        *WORD_ROWS,
        "k AS (SELECT words, unnest(list_distinct(string_split(words, ' '))) AS word FROM cand WHERE n >= 20)",
        select="SELECT word, count(*) AS n_clusters FROM k GROUP BY word HAVING count(*) >= 0.3 * (SELECT count(*) FROM cand WHERE n >= 20)",
    ),
)
def common_cluster_words(spark, sf):
    return wc.common_cluster_words(wc.plain_clusters(wc.frequent_candidates(_cands(spark, sf), 20)), 0.3)


@query(
    "outlier_lines",
    with_(
        *WORD_ROWS,
        select="SELECT e.chunk_id, e.line_no, e.line FROM event_lines e LEFT JOIN c ON e.chunk_id = c.chunk_id AND e.line_no = c.line_no LEFT JOIN cand k ON c.words = k.words AND k.n >= 60 WHERE k.words IS NULL",
    ),
)
def outlier_lines(spark, sf):
    per_line = _per_line(spark, sf)
    frequent = wc.frequent_candidates(wc.candidates(per_line), 60)
    return wc.outliers(inp.event_lines(spark, sf), per_line, frequent, KEYS)


@query("aggregated_supports")
def aggregated_supports(spark, sf):
    a = wc.aggregate_supports(_cands(spark, sf))
    return a.select(F.array_join("words", " ").alias("words"), "own_n", "n")
