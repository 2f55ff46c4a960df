"""What goes through files and comes back, and options of users."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from logquarry.functions import tokens as tk
from logquarry.operators import encode as en
from logquarry.operators import restore as rs
from logquarry.operators import scoring as sc
from logquarry.operators import tagging as tg
from logquarry.operators import wordclusters as wc
from logquarry.plans import inputs as inp
from logquarry.plans.encoding import tagged_events
from logquarry.plans.registry import query, with_
from logquarry.session import ensure_checkpoint_dir
from logquarry.sources import lines as src
from logquarry.sources import tables as tb


def _folder(spark) -> str:
    """A new folder in the shared place of intermediate tables."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/files-{uuid.uuid4().hex}"


@query("text_files_in_order", with_(inp.ORDER_LINES, select="SELECT row_number() OVER (ORDER BY chunk_id, line_no) AS position, line FROM order_lines"))
def text_files_in_order(spark, sf):
    """Lines written as text files, and numbered again as they are read: files in order, lines in order."""
    folder = _folder(spark)
    rs.write_text(inp.order_lines(spark, sf), folder)
    return rs.in_order(src.read_lines(spark, folder), ["source", "line_no"]).select("position", "line")


@query(
    "numbered_files",
    with_(
        inp.ORDER_LINES,
        select="SELECT count(*) AS n_lines, CAST(sum(length(line)) AS BIGINT) AS n_chars, true AS last_is_count, true AS all_end FROM order_lines",
    ),
)
def numbered_files(spark, sf):
    """Of text files: lines, characters, whether each file's last number is its count, and whether all end their last line."""
    folder = _folder(spark)
    rs.write_text(inp.order_lines(spark, sf), folder)
    per_file = src.read_lines(spark, folder).groupBy("source").agg(
        F.count(F.lit(1)).alias("n"), F.max("line_no").alias("last"), F.sum(F.length("line")).alias("chars")
    )
    flags = src.final_newline_flags(spark, folder).agg(F.bool_and("final_newline").alias("f"))
    return per_file.agg(
        F.sum("n").alias("n_lines"), F.sum("chars").alias("n_chars"), F.bool_and(F.col("n") == F.col("last")).alias("last_is_count")
    ).withColumn("all_end", flags.scalar())


@query("round_trip_encoded_files", with_(inp.EVENT_LINES, select="SELECT chunk_id, line_no, line FROM event_lines"))
def round_trip_encoded_files(spark, sf):
    folder = _folder(spark)
    tb.encode_and_write(tagged_events(spark, sf), folder)
    return rs.restore_lines(tb.read_encoded(spark, folder))


def _structured(spark, sf):
    e = inp.table(spark, sf, "events")
    return e.select(
        F.col("event_id").alias("LineId"),
        F.concat_ws(" ", "event_type", F.col("user_id").cast("string")).alias("Content"),
        F.concat("event_type", F.lit(" <*>")).alias("EventTemplate"),
        F.array(F.col("user_id").cast("string"), F.lit("a, b")).alias("ParameterList"),
    )


@query(
    "structured_round_trip",
    """SELECT CAST(event_id AS VARCHAR) AS LineId, event_type || ' ' || user_id AS Content, event_type || ' <*>' AS EventTemplate,
  '[''' || user_id || ''', ''a, b'']' AS ParameterList, user_id || '|a, b' AS items FROM events""",
)
def structured_round_trip(spark, sf):
    """A structured log as CSV and back; lists are printed, and read again as items."""
    folder = _folder(spark)
    tb.write_structured(_structured(spark, sf), folder)
    back = tb.read_structured(spark, folder)
    return back.withColumn("items", F.array_join(tk.parameter_list(F.col("ParameterList")), "|"))


@query(
    "template_report",
    """SELECT substr(md5(event_type || ' <*>'), 1, 8) AS EventId, event_type || ' <*>' AS EventTemplate, count(*) AS Occurrences FROM events GROUP BY event_type""",
)
def template_report(spark, sf):
    return tb.template_report(_structured(spark, sf), "EventTemplate")


@query(
    "masked_non_ascii",
    with_(
        inp.DOC_LINES,
        select=r"SELECT lower(regexp_replace(line, '[^\x00-\x7F]+', '<N/ASCII>', 'g')) AS masked, count(*) AS n FROM doc_lines WHERE regexp_matches(line, '[^\x00-\x7F]') GROUP BY 1",
    ),
)
def masked_non_ascii(spark, sf):
    d = inp.doc_lines(spark, sf).where(F.col("line").rlike(r"[^\x00-\x7F]"))
    return d.groupBy(F.lower(tk.mask_non_ascii(F.col("line"))).alias("masked")).agg(F.count(F.lit(1)).alias("n"))


@query("round_trip_handlers", with_(inp.EVENT_LINES, select="SELECT chunk_id, line_no, line FROM event_lines"))
def round_trip_handlers(spark, sf):
    """Times stored by a handler of the user, as seconds."""
    handlers = tg.handler_registry(
        T=(lambda v: F.unix_timestamp(v, "yyyy-MM-dd HH:mm:ss").cast("string"), lambda s: F.from_unixtime(s.cast("bigint"), "yyyy-MM-dd HH:mm:ss"))
    )
    encoded = en.encode(tagged_events(spark, sf), "normal", handlers)
    return rs.restore_lines(encoded, handlers)


@query(
    "words_with_option",
    with_(
        inp.EVENT_LINES,
        "w AS (SELECT chunk_id, line_no, unnest(list_distinct(string_split(line, ' '))) AS word FROM event_lines)",
        "o AS (SELECT word FROM w UNION ALL SELECT regexp_replace(word, '[0-9]+', '#') FROM w WHERE regexp_matches(word, '^user=[0-9]+$'))",
        select="SELECT word, count(*) AS n FROM o GROUP BY word HAVING count(*) >= 20",
    ),
)
def words_with_option(spark, sf):
    """A word may also count in a form that the user gives."""
    option = wc.rewrite_option("^user=[0-9]+$", "[0-9]+", "#")
    return wc.frequent_words(inp.event_lines(spark, sf), support=20, separator=" ", options=option)


@query(
    "scores_of_known_truth",
    """WITH t AS (SELECT event_id, CASE WHEN event_id % 10 = 0 THEN NULL ELSE event_type END AS truth, CASE WHEN event_type IN ('click', 'view') THEN 'seen' ELSE event_type END AS parsed FROM events),
c AS (SELECT truth, parsed, count(*) AS n FROM t WHERE truth IS NOT NULL GROUP BY 1, 2),
g AS (SELECT *, sum(n) OVER (PARTITION BY truth) AS tn, sum(n) OVER (PARTITION BY parsed) AS pn FROM c)
SELECT CAST(sum(n) AS BIGINT) AS n_lines, CAST(sum(CASE WHEN n = tn AND n = pn THEN n ELSE 0 END) AS BIGINT) AS n_accurate,
  round(sum(CASE WHEN n = tn AND n = pn THEN n ELSE 0 END) / sum(n), 9) AS group_accuracy FROM g""",
)
def scores_of_known_truth(spark, sf):
    """Lines whose truth is not known do not count."""
    e = inp.table(spark, sf, "events")
    truth = e.select("event_id", F.when(F.col("event_id") % 10 != 0, F.col("event_type")).alias("template"))
    parsed = e.select("event_id", F.when(F.col("event_type").isin("click", "view"), "seen").otherwise(F.col("event_type")).alias("template"))
    scores = sc.group_accuracy(sc.cells(sc.align(truth, parsed, ["event_id"])))
    return scores.withColumn("group_accuracy", F.round("group_accuracy", 9))
