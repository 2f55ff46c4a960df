"""Templates by successive partitioning: token count, then rarest position, then token relations.

Positions are counted on exploded tokens with partial aggregation. Every step works
on distinct token arrays with their line counts, so equal lines are handled once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from logquarry.functions import tokens as tk
from logquarry.session import cut_lineage

OUTLIER = "outlier"


def distinct_words(lines: DataFrame, text: str = "line", masks: list[str] | None = None) -> DataFrame:
    """``(words, n)`` of the distinct word arrays of non-blank lines."""
    masked = tk.mask_patterns(F.col(text), masks or [])
    return (
        lines.filter(F.trim(F.regexp_replace(text, r"\s", " ")) != "")
        .select(tk.word_tokens(masked).alias("words"))
        .groupBy("words")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def step1(distinct: DataFrame, min_share: float = 0.0) -> DataFrame:
    """Partition by word count; partitions below ``min_share`` of the lines are outliers."""
    sized = distinct.withColumn("n_words", F.size("words").cast("bigint"))
    part = F.concat(F.lit("len="), F.col("n_words").cast("string"))
    if not min_share:
        return sized.withColumn("part", part).withColumn("step", F.lit(1))
    total = distinct.agg(F.sum("n")).scalar()
    sizes = sized.groupBy("n_words").agg(F.sum("n").alias("part_n"))
    small = F.col("part_n") / (total + 1) < min_share
    return (
        sized.join(sizes, "n_words")
        .withColumn("part", F.when(small, OUTLIER).otherwise(part))
        .withColumn("step", F.lit(1))
        .drop("part_n")
    )


def position_counts(parts: DataFrame) -> DataFrame:
    """``(part, pos, nd)``: distinct words at every position of every partition."""
    return (
        parts.filter(F.col("part") != OUTLIER)
        .select("part", F.posexplode("words").alias("pos", "word"))
        .groupBy("part", "pos", "word")
        .agg(F.lit(1).alias("one"))
        .groupBy("part", "pos")
        .agg(F.count(F.lit(1)).alias("nd"))
    )


def _drop_small(parts: DataFrame, sub: str, min_share: float) -> DataFrame:
    """Sub-partitions below ``min_share`` of their partition become outliers."""
    if not min_share:
        return parts
    whole = parts.groupBy("part").agg(F.sum("n").alias("part_n"))
    piece = parts.groupBy("part", sub).agg(F.sum("n").alias("sub_n"))
    small = F.col(sub).isNotNull() & (F.col("sub_n") / F.col("part_n") < min_share)
    joined = parts.join(whole, "part").join(
        piece.withColumnRenamed("part", "p2").withColumnRenamed(sub, "s2"),
        (F.col("part") == F.col("p2")) & F.col(sub).eqNullSafe(F.col("s2")),
    )
    return joined.withColumn(sub, F.when(small, F.lit(OUTLIER)).otherwise(F.col(sub))).drop(
        "part_n", "sub_n", "p2", "s2"
    )


def _descend(parts: DataFrame, sub: str, step: int) -> DataFrame:
    """Replace ``part`` by its sub-partition where there is one."""
    name = F.when(F.col(sub) == OUTLIER, F.col(sub)).otherwise(
        F.concat_ws("/", F.col("part"), F.concat(F.lit(f"{step}:"), F.col(sub)))
    )
    return (
        parts.withColumn("step", F.when(F.col(sub).isNull(), F.col("step")).otherwise(step))
        .withColumn("part", F.when(F.col(sub).isNull(), F.col("part")).otherwise(name))
        .drop(sub)
    )


def step2(parts: DataFrame, support: int = 0, min_share: float = 0.0) -> DataFrame:
    """Split each partition by the word at its position with the fewest distinct words.

    The lowest such position counts; a partition with a constant position, or with
    at most ``support`` lines, stays whole.
    """
    best = (
        position_counts(parts)
        .groupBy("part")
        .agg(F.min(F.struct("nd", "pos")).alias("b"))
        .filter("b.nd > 1")
        .select("part", F.col("b.pos").alias("split_pos"))
    )
    if support:
        big = parts.groupBy("part").agg(F.sum("n").alias("t")).filter(F.col("t") > support).select("part")
        best = best.join(big, "part")
    split = parts.join(best, "part", "left").withColumn(
        "sub", F.get(F.col("words"), F.col("split_pos"))
    )
    return _descend(_drop_small(split.drop("split_pos"), "sub", min_share), "sub", 2)


def _top_two(part_cards: DataFrame) -> DataFrame:
    """Per partition the position pair of step 3, from ``(part, step, n_words, cards)``.

    ``cards`` holds, per distinct cardinality in order of its first position:
    ``nd``, how many positions share it (``f``), and its first two positions. After
    step 2 the pair is the first two positions of the most shared cardinality, else the
    first positions of the two least shared ones.
    """
    # the cardinality that most varied positions share, the leftmost of equals
    shared = F.filter("cards", lambda c: (c["nd"] > 1) & (c["f"] > 1))
    widest = F.array_min(F.transform(shared, lambda c: F.struct((-c["f"]).alias("order"), c["p1"].alias("p1"), c["p2"].alias("p2"))))
    # the two smallest numbers of positions that share a cardinality
    rarest = F.array_sort(F.array_distinct(F.transform("cards", lambda c: c["f"])))

    def leftmost(place: int) -> Column:
        alike = F.filter("cards", lambda c: c["f"] == F.get(rarest, F.lit(place)))
        return F.array_min(F.transform(alike, lambda c: c["p1"]))

    two = F.col("step") == 2
    p1 = F.when(two, widest["p1"]).otherwise(leftmost(0))
    p2 = F.when(two, widest["p2"]).otherwise(leftmost(1))
    short = F.col("n_words") == 2
    return part_cards.select(
        "part",
        F.when(short, F.lit(0)).otherwise(p1).alias("p1"),
        F.when(short, F.lit(1)).otherwise(p2).alias("p2"),
    ).filter("p1 is not null and p2 is not null")


def position_pairs(parts: DataFrame, constant_share: float = 0.35) -> DataFrame:
    """``(part, p1, p2)`` for partitions that step 3 splits.

    Partitions with one word, or with at least ``constant_share`` constant positions,
    are left alone. After step 2 the pair comes from the cardinality most positions
    share; after step 1 from the one fewest share.
    """
    counts = position_counts(parts)
    ranked = counts.groupBy("part", "nd").agg(
        F.count(F.lit(1)).alias("f"), F.array_sort(F.collect_list("pos")).alias("at")
    )
    cards = ranked.groupBy("part").agg(
        F.array_sort(
            F.collect_list(
                F.struct(
                    F.get("at", F.lit(0)).alias("p1"),
                    F.col("nd"),
                    F.col("f"),
                    F.get("at", F.lit(1)).alias("p2"),
                )
            )
        ).alias("cards"),
        F.sum(F.when(F.col("nd") == 1, F.col("f")).otherwise(0)).alias("constant"),
    )
    info = parts.filter(F.col("part") != OUTLIER).groupBy("part").agg(
        F.first("step").alias("step"), F.first("n_words").alias("n_words")
    )
    open_parts = cards.join(info, "part").filter(
        (F.col("n_words") == 2)
        | ((F.col("n_words") > 2) & (F.col("constant") / F.col("n_words") < constant_share))
    )
    return _top_two(open_parts)


def step3(
    parts: DataFrame,
    constant_share: float = 0.35,
    lower: float = 0.25,
    upper: float = 0.9,
    min_share: float = 0.0,
) -> DataFrame:
    """Split by the relation of the words at two positions: 1-1, 1-M, M-1 or M-M."""
    # the steps below read the partitions and the edges several times
    parts = cut_lineage(parts)
    pairs = position_pairs(parts, constant_share)
    placed = parts.join(pairs, "part", "left").withColumn(
        "t1", F.when(F.col("p1").isNotNull(), F.get(F.col("words"), F.col("p1")))
    ).withColumn("t2", F.when(F.col("p2").isNotNull(), F.get(F.col("words"), F.col("p2"))))
    edges = cut_lineage(
        placed.filter("t1 is not null")
        .groupBy("part", "t1", "t2")
        .agg(F.sum("n").alias("edge_n"), F.first("step").alias("step"))
    )
    # degrees by two joins on aggregated edges: a hot word is one row there
    d1 = edges.groupBy("part", "t1").agg(F.count(F.lit(1)).alias("deg1"), F.sum("edge_n").alias("n1"))
    d2 = edges.groupBy("part", "t2").agg(F.count(F.lit(1)).alias("deg2"), F.sum("edge_n").alias("n2"))
    e = cut_lineage(edges.join(d1, ["part", "t1"]).join(d2, ["part", "t2"]))
    # the greatest degree on the other side decides whether a word fans out cleanly
    m1 = e.groupBy("part", "t1").agg(F.max("deg2").alias("far2"))
    m2 = e.groupBy("part", "t2").agg(F.max("deg1").alias("far1"))
    e = e.join(m1, ["part", "t1"]).join(m2, ["part", "t2"])
    kind = (
        F.when((F.col("deg1") == 1) & (F.col("deg2") == 1), "1-1")
        .when((F.col("deg1") > 1) & (F.col("far2") == 1), "1-M")
        .when((F.col("deg2") > 1) & (F.col("far1") == 1), "M-1")
        .otherwise("M-M")
    )
    e = cut_lineage(e.withColumn("kind", kind))
    # words left over on each side decide which side splits an M-M relation
    left = (
        e.filter("kind = 'M-M'").select("part", "t1").distinct().groupBy("part").agg(F.count(F.lit(1)).alias("left1"))
    )
    right = (
        e.filter("kind = 'M-M'").select("part", "t2").distinct().groupBy("part").agg(F.count(F.lit(1)).alias("left2"))
    )
    e = e.join(left, "part", "left").join(right, "part", "left")
    one_m = F.when(F.col("deg1") / F.col("n1") <= lower, F.col("t2")).otherwise(F.col("t1"))
    m_one = F.when(F.col("deg2") / F.col("n2") <= lower, F.col("t1")).otherwise(F.col("t2"))
    m_m = F.when(F.col("step") == 2, F.lit("rest")).when(
        F.col("left1") < F.col("left2"), F.col("t1")
    ).otherwise(F.col("t2"))
    # the split word alone names the new partition; the leftover of step 2 is apart
    sub = (
        F.when(F.col("kind") == "1-1", F.concat(F.lit("w:"), F.col("t1")))
        .when(F.col("kind") == "1-M", F.concat(F.lit("w:"), one_m))
        .when(F.col("kind") == "M-1", F.concat(F.lit("w:"), m_one))
        .when(F.col("step") == 2, F.lit("rest"))
        .otherwise(F.concat(F.lit("w:"), m_m))
    )
    named = e.select("part", "t1", "t2", sub.alias("sub"))
    split = placed.join(named, ["part", "t1", "t2"], "left").drop("t1", "t2", "p1", "p2")
    return _descend(_drop_small(split, "sub", min_share), "sub", 3)


def step4(parts: DataFrame) -> DataFrame:
    """``(part, template, n_lines)``: constant positions as words, the others as ``<*>``."""
    positions = (
        parts.filter(F.col("part") != OUTLIER)
        .select("part", "n", F.posexplode("words").alias("pos", "word"))
        .groupBy("part", "pos")
        .agg(
            F.when(F.min("word") == F.max("word"), F.min("word")).otherwise(F.lit("<*>")).alias("word"),
        )
    )
    texts = positions.groupBy("part").agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("pos", "word"))), lambda s: s["word"]), " "
        ).alias("template")
    )
    sizes = parts.groupBy("part").agg(F.sum("n").alias("n_lines"))
    return sizes.join(texts, "part", "left").select(
        "part", F.coalesce("template", F.lit("Outlier")).alias("template"), "n_lines"
    )


def partition_templates(
    lines: DataFrame, text: str = "line", masks: list[str] | None = None, min_share: float = 0.0
) -> DataFrame:
    """All four steps: ``(part, template, n_lines)``."""
    parts = step1(distinct_words(lines, text, masks), min_share)
    return step4(step3(step2(parts, 0, min_share), min_share=min_share))


def label_lines(lines: DataFrame, parts: DataFrame, templates: DataFrame, text: str = "line", masks: list[str] | None = None) -> DataFrame:
    """Template of every line, through its word array."""
    named = parts.join(templates.select("part", "template"), "part").select("words", "template")
    keyed = lines.withColumn("words", tk.word_tokens(tk.mask_patterns(F.col(text), masks or [])))
    return keyed.join(named, "words", "left").drop("words")
