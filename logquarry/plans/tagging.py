"""Tags and templates."""

from __future__ import annotations

from pyspark.sql import functions as F

from logquarry.functions import tokens as tk
from logquarry.operators import tagging as tg
from logquarry.plans import inputs as inp
from logquarry.plans.registry import query, with_

EVENT_PIECES = inp.pieces_sql("event_lines", inp.TIME_PATTERN)
DOC_PIECES = inp.pieces_sql("doc_lines")


def tagged_events(spark, sf):
    return tg.tag_lines(inp.event_lines(spark, sf), inp.EVENT_PATTERNS)


@query(
    "tagged_variables",
    with_(inp.EVENT_LINES, EVENT_PIECES, select="SELECT chunk_id, line_no, var_no, tag, value FROM pieces_vars"),
)
def tagged_variables(spark, sf):
    return tg.variable_rows(tagged_events(spark, sf))


@query(
    "tagged_variables_documents",
    with_(inp.DOC_LINES, DOC_PIECES, select="SELECT chunk_id, line_no, var_no, tag, value FROM pieces_vars"),
)
def tagged_variables_documents(spark, sf):
    return tg.variable_rows(tg.tag_lines(inp.doc_lines(spark, sf)))


@query(
    "tag_counts",
    with_(inp.EVENT_LINES, EVENT_PIECES, select="SELECT chunk_id, tag, count(*) AS n FROM pieces WHERE tag <> '' GROUP BY chunk_id, tag"),
)
def tag_counts(spark, sf):
    return tg.tag_counts(tagged_events(spark, sf))


# placeholders are marked while lines are grouped, so that equal text is not taken for one
PLAIN = "replace(replace(template, chr(1), ''), chr(2), '')"


@query(
    "tag_threshold",
    with_(
        inp.EVENT_LINES,
        EVENT_PIECES,
        "n AS (SELECT *, count(*) OVER (PARTITION BY chunk_id, tag) AS c FROM pieces)",
        f"k AS (SELECT chunk_id, line_no, pos, CASE WHEN tag = '{inp.TIME_TAG}' OR (tag <> '' AND c > 150) THEN chr(1) || tag || chr(2) ELSE text END AS t FROM n)",
        "l AS (SELECT chunk_id, line_no, string_agg(t, '' ORDER BY pos) AS template FROM k GROUP BY chunk_id, line_no)",
        select=f"SELECT chunk_id, {PLAIN} AS template, n FROM (SELECT chunk_id, template, count(*) AS n FROM l GROUP BY chunk_id, template)",
    ),
)
def tag_threshold(spark, sf):
    kept = tg.apply_threshold(tagged_events(spark, sf), 150, inp.EVENT_PATTERNS)
    return tg.template_counts(kept, ["chunk_id"], n=F.count(F.lit(1)))


@query(
    "tags_without_context",
    with_(
        inp.ORDER_LINES,
        inp.pieces_sql("order_lines", inp.TIME_PATTERN),
        select=r"""SELECT chunk_id, regexp_replace(tag, 'CTX=[^|]*\|', '') AS tag, count(*) AS n
FROM pieces WHERE tag <> '' GROUP BY 1, 2""",
    ),
)
def tags_without_context(spark, sf):
    return tg.tag_counts(
        tg.tag_lines(inp.order_lines(spark, sf), inp.EVENT_PATTERNS, use_context=False)
    )


@query(
    "tags_single_pass_rule",
    with_(
        inp.ORDER_LINES,
        inp.pieces_sql("order_lines", inp.TIME_PATTERN, shaped=False),
        select="SELECT tag, count(*) AS n FROM pieces WHERE tag <> '' GROUP BY tag",
    ),
)
def tags_single_pass_rule(spark, sf):
    t = tg.tag_lines(inp.order_lines(spark, sf), inp.EVENT_PATTERNS, shape_mixed_digits=False)
    return t.select(F.explode("parts.tags").alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("n"))


@query(
    "generic_templates",
    with_(
        inp.ORDER_LINES,
        inp.pieces_sql("order_lines", inp.TIME_PATTERN),
        f"t AS (SELECT chunk_id, line_no, string_agg(CASE WHEN tag = '' THEN text ELSE chr(1) || CASE WHEN tag = '{inp.TIME_TAG}' THEN tag ELSE '<*>' END || chr(2) END, '' ORDER BY pos) AS template FROM pieces GROUP BY chunk_id, line_no)",
        select=f"SELECT {PLAIN} AS template, n FROM (SELECT template, count(*) AS n FROM t GROUP BY template)",
    ),
)
def generic_templates(spark, sf):
    t = tg.tag_lines(inp.order_lines(spark, sf), inp.EVENT_PATTERNS, style="generic", use_context=False)
    return tg.template_counts(t, n=F.count(F.lit(1)))


@query(
    "template_counts",
    with_(
        inp.DOC_LINES,
        DOC_PIECES,
        "t AS (SELECT line_no, string_agg(CASE WHEN tag = '' THEN text ELSE chr(1) || tag || chr(2) END, '' ORDER BY pos) AS template FROM pieces GROUP BY line_no)",
        select=f"SELECT {PLAIN} AS template, n_lines, first_line_no FROM (SELECT template, count(*) AS n_lines, min(line_no) AS first_line_no FROM t GROUP BY template)",
    ),
)
def template_counts(spark, sf):
    t = tg.tag_lines(inp.doc_lines(spark, sf)).filter("line <> ''")
    return tg.template_counts(t, n_lines=F.count(F.lit(1)), first_line_no=F.min("line_no"))


@query(
    "tag_parts",
    with_(
        inp.EVENT_LINES,
        EVENT_PIECES,
        select=r"""SELECT coalesce(nullif(regexp_extract(tag, '^<IDX=([0-9]+)', 1), ''), '') AS idx, coalesce(nullif(regexp_extract(tag, 'LEN=([0-9]+)', 1), ''), '') AS len,
  regexp_extract(tag, 'CTX=([^|>]*)', 1) || CASE WHEN tag LIKE '%CTX=<T>%' THEN '>' ELSE '' END AS ctx, regexp_extract(tag, 'STR=(.*)>$', 1) AS str, count(*) AS n
FROM pieces WHERE tag LIKE '%=%' GROUP BY 1, 2, 3, 4""",
    ),
)
def tag_parts(spark, sf):
    counts = tg.tag_counts(tagged_events(spark, sf)).groupBy("tag").agg(F.sum("n").alias("n")).filter("tag like '%=%'")
    parts = tg.parse_tag(F.col("tag"))
    pick = lambda k: F.coalesce(parts[k], F.lit(""))
    return counts.groupBy(
        pick("IDX").alias("idx"), pick("LEN").alias("len"), pick("CTX").alias("ctx"), pick("STR").alias("str")
    ).agg(F.sum("n").alias("n"))


@query(
    "json_tags",
    with_(
        inp.EVENT_JSON,
        """tags AS (
  SELECT chunk_id, '<json:user>' AS tag FROM event_json UNION ALL SELECT chunk_id, '<json:type>' FROM event_json
  UNION ALL SELECT chunk_id, '<json:value>' FROM event_json UNION ALL SELECT chunk_id, '<json:props>' FROM event_json
  UNION ALL SELECT chunk_id, '<CTX=paid|STR=\\d{' || length(string_split(v, '.')[1]) || '}\\.\\d{2}>' FROM event_json
  UNION ALL SELECT chunk_id, CASE WHEN length(u) <= 2 THEN '<LEN=' || length(u) || '>' ELSE '<IDX=5|CTX=user|STR=\\d{' || length(u) || '}>' END FROM event_json)""",
        select="SELECT chunk_id, tag, count(*) AS n FROM tags GROUP BY chunk_id, tag",
    ),
)
def json_tags(spark, sf):
    return tg.tag_counts(tg.tag_json_lines(inp.event_json(spark, sf)))


@query(
    "json_templates",
    with_(
        inp.EVENT_JSON,
        r"""t AS (SELECT '{"user": "<json:user>", "type": "<json:type>", "note": "paid <CTX=paid|STR=\d{' || length(string_split(v, '.')[1])
  || '}\.\d{2}> by user ' || CASE WHEN length(u) <= 2 THEN '<LEN=' || length(u) || '>' ELSE '<IDX=5|CTX=user|STR=\d{' || length(u) || '}>' END
  || '", "value": <json:value>, "props": <json:props>}' AS template FROM event_json)""",
        select="SELECT template, count(*) AS n FROM t GROUP BY template",
    ),
)
def json_templates(spark, sf):
    t = tg.tag_json_lines(inp.event_json(spark, sf))
    return t.groupBy(tg.parts_template(F.col("parts")).alias("template")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "plain_wildcard_templates",
    f"""WITH d AS (SELECT unnest(string_split(text, chr(10))) AS line FROM documents),
t AS (SELECT array_to_string(list_transform(regexp_extract_all(trim(line), '[{inp.D}]+|[^{inp.D}]+'),
  lambda x: CASE WHEN regexp_matches(x, '^[{inp.D}]') OR NOT regexp_matches(x, '[^A-Za-z<>]') THEN x ELSE '<*>' END), '') AS template
  FROM d WHERE trim(line) <> '')
SELECT substr(md5(template), 1, 8) AS event_id, template, count(*) AS n FROM t GROUP BY template""",
)
def plain_wildcard_templates(spark, sf):
    """The digit-or-special parser used for scoring."""
    lines = inp.doc_lines(spark, sf).filter(F.trim("line") != "")
    template = F.array_join(
        F.transform(
            tk.runs(F.trim("line")),
            lambda r: F.when(tk.is_delimiter_run(r) | ~tk.is_variable(r), r).otherwise(F.lit("<*>")),
        ),
        "",
    )
    return (
        lines.groupBy(template.alias("template"))
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("event_id", tk.event_id(F.col("template")))
    )
