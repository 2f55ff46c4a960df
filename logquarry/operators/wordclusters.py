"""Line patterns from frequent words: candidates, supports, word weights, clusters, outliers.

Every per-line result is counted first; what follows works on candidates, one row
per distinct pattern.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from logquarry.functions.arrays import explode_rows, posexplode_rows
from logquarry.operators.tagging import let
from logquarry.operators.templates import checked_broadcast

Options = Callable[[Column], Column]


def split_words(line: Column, separator: str = r"\s+") -> Column:
    """Words of a line; a separator at its end adds none, one at its start an empty word."""
    body = F.regexp_replace(line, f"(?:{separator})$", "")
    return F.when(body == "", F.expr("cast(array() as array<string>)")).otherwise(
        F.split(body, separator, -1)
    )


def rewrite_option(pattern: str, search: str, replace: str) -> Options:
    """Words that match ``pattern`` may also count with ``search`` replaced."""
    return lambda w: F.when(w.rlike(pattern), F.array(F.regexp_replace(w, search, replace))).otherwise(
        F.expr("cast(array() as array<string>)")
    )


def _choices(word: Column, options: Options | None) -> Column:
    return F.array(word) if options is None else F.concat(F.array(word), options(word))


def frequent_words(
    lines: DataFrame,
    support: int | None = None,
    relative: float | None = None,
    text: str = "line",
    separator: str = r"\s+",
    options: Options | None = None,
) -> DataFrame:
    """``(word, n)``: words in at least ``support`` lines, or in ``relative`` percent of them.

    A word counts once per line; a rewritten word counts once per distinct raw word.
    """
    words = F.array_distinct(split_words(F.col(text), separator))
    if options is not None:
        words = F.flatten(F.transform(words, lambda w: _choices(w, options)))
    counts = (
        explode_rows(lines, [], words, "word").groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    )
    if support is not None:
        return counts.filter(F.col("n") >= support)
    least = lines.agg(F.floor(F.count(F.lit(1)) * relative / 100)).scalar()
    return counts.filter(F.col("n") >= least)


def line_candidates(
    lines: DataFrame,
    words: DataFrame,
    keys: Sequence[str],
    text: str = "line",
    separator: str = r"\s+",
    options: Options | None = None,
) -> DataFrame:
    """``(keys, words, gaps)``: the frequent words of a line in order, and the words between them.

    With relative support the word table is bounded: a word needs a share of all
    lines. It is broadcast only if its measured size allows.
    """
    tokens = split_words(F.col(text), separator)
    cut = lines.select(*keys, tokens.alias("tokens"))
    exploded = posexplode_rows(cut, [*keys, F.size("tokens").alias("n_words")], F.col("tokens"), "pos", "raw").select(
        *keys, "n_words", "pos", F.posexplode_outer(_choices(F.col("raw"), options)).alias("option", "word")
    )
    known = exploded.join(checked_broadcast(words.select("word"), "word"), "word")
    per_line = known.groupBy(*keys).agg(
        F.first("n_words").alias("n_words"),
        F.array_sort(F.collect_list(F.struct("pos", "option", "word"))).alias("w"),
    )
    # the first known option of a word counts
    first = F.filter("w", lambda x, i: (i == 0) | (F.get(F.col("w"), i - 1)["pos"] != x["pos"]))
    at = F.concat(F.array(F.lit(-1)), F.transform("w", lambda x: x["pos"]), F.array(F.col("n_words")))
    return (
        per_line.withColumn("w", first)
        .withColumn("at", at)
        .select(
            *keys,
            F.transform("w", lambda x: x["word"]).alias("words"),
            F.zip_with(
                F.slice("at", F.lit(2), F.size("at") - 1),
                F.slice("at", F.lit(1), F.size("at") - 1),
                lambda b, a: b - a - 1,
            ).alias("gaps"),
        )
    )


def candidates(per_line: DataFrame) -> DataFrame:
    """``(words, n, gap_min, gap_max)``, one row per distinct sequence of frequent words."""
    spans = (
        per_line.select("words", F.posexplode("gaps").alias("pos", "gap"))
        .groupBy("words", "pos")
        .agg(F.count(F.lit(1)).alias("n"), F.min("gap").alias("lo"), F.max("gap").alias("hi"))
    )
    ordered = F.array_sort(F.collect_list(F.struct("pos", "lo", "hi")))
    return (
        spans.groupBy("words")
        .agg(F.first("n").alias("n"), ordered.alias("s"))
        .select(
            "words",
            "n",
            F.transform("s", lambda x: x["lo"]).alias("gap_min"),
            F.transform("s", lambda x: x["hi"]).alias("gap_max"),
        )
    )


def more_specific(cands: DataFrame) -> DataFrame:
    """``(words, sub_words, sub_n)``: candidates whose lines all match a more general one.

    The general words appear in the other in order, and each of its gaps spans what
    lies between. Candidates meet on the rarest word of the general one only.
    """
    frequency = (
        cands.select("n", F.explode(F.array_distinct("words")).alias("word"))
        .groupBy("word")
        .agg(F.sum("n").alias("f"))
    )
    rarest = (
        cands.select("words", "gap_min", "gap_max", F.explode(F.array_distinct("words")).alias("word"))
        .join(frequency, "word")
        .groupBy("words", "gap_min", "gap_max")
        .agg(F.min_by("word", F.struct("f", "word")).alias("word"))
    )
    other = cands.select(
        F.col("words").alias("sub_words"),
        F.col("n").alias("sub_n"),
        F.col("gap_min").alias("sub_min"),
        F.col("gap_max").alias("sub_max"),
        F.explode(F.array_distinct("words")).alias("word"),
    )
    met = rarest.join(other, "word").filter(
        (F.col("words") != F.col("sub_words"))
        & (F.size("words") <= F.size("sub_words"))
        & (F.size(F.array_except("words", "sub_words")) == 0)
    )

    def sums(gaps: str) -> Column:
        # words and gaps in front of each position, the end included
        return F.transform(
            gaps,
            lambda _, j: F.aggregate(F.slice(gaps, F.lit(1), j + 1), F.lit(0), lambda a, g: a + g) + j,
        )

    def spanned(lo: Column, hi: Column, i: Column, p: Column, j: Column) -> Column:
        # what lies between the matched position p and position j, both ends apart
        before = lambda s: F.when(p < 0, 0).otherwise(F.get(s, p) + 1)
        return (F.get(F.col("gap_min"), i) <= F.get(lo, j) - before(lo)) & (
            F.get(F.col("gap_max"), i) >= F.get(hi, j) - before(hi)
        )

    def covers(z: Column) -> Column:
        lo, hi = z["lo"], z["hi"]
        size = F.size("sub_words")

        def match(state: Column, i: Column) -> Column:
            return F.filter(
                F.sequence(F.lit(0), size - 1),
                lambda j: (F.get(F.col("sub_words"), j) == F.get(F.col("words"), i))
                & F.exists(state, lambda p: (p < j) & spanned(lo, hi, i, p, j)),
            )

        ends = F.aggregate(F.sequence(F.lit(0), F.size("words") - 1), F.array(F.lit(-1)), match)
        return F.exists(ends, lambda p: spanned(lo, hi, F.size("words"), p, size))

    fits = let(F.struct(sums("sub_min").alias("lo"), sums("sub_max").alias("hi")), covers)
    return met.filter(fits).select("words", "sub_words", "sub_n")


def aggregate_supports(cands: DataFrame) -> DataFrame:
    """Candidates with the supports of all more specific ones added; ``own_n`` is the count before."""
    extra = more_specific(cands).groupBy("words").agg(F.sum("sub_n").alias("extra"))
    return (
        cands.join(extra, "words", "left")
        .withColumn("own_n", F.col("n"))
        .withColumn("n", F.col("n") + F.coalesce("extra", F.lit(0)))
        .drop("extra")
    )


def frequent_candidates(cands: DataFrame, support: int) -> DataFrame:
    return cands.filter(F.col("n") >= support)


def top_candidates(cands: DataFrame, k: int) -> DataFrame:
    """The report of the ``k`` most frequent candidates, descending; of equals by their words."""
    return cands.orderBy(F.desc("n"), "words").limit(k)


def dependencies(cands: DataFrame) -> DataFrame:
    """``(w1, w2, dep)``: share of the lines with ``w1`` that also hold ``w2``.

    Pairs are formed per candidate, weighted by its count, not per line.
    """
    words = F.array_distinct("words")
    pairs = (
        cands.select("n", F.explode(words).alias("w1"), "words")
        .select("n", "w1", F.explode(words).alias("w2"))
        .groupBy("w1", "w2")
        .agg(F.sum("n").alias("both"))
    )
    alone = pairs.filter("w1 = w2").select("w1", F.col("both").alias("own"))
    return pairs.join(alone, "w1").select("w1", "w2", (F.col("both") / F.col("own")).alias("dep"))


def word_weights(cands: DataFrame, deps: DataFrame, function: int = 1) -> DataFrame:
    """Adds ``weights``, one per word: how far the other words of the candidate imply it.

    1: mean over all words; 2: mean over the other distinct words; 3 and 4: the same
    with both directions.
    """
    if function not in (1, 2, 3, 4):
        raise ValueError(function)
    unique = function in (2, 4)
    pool = F.array_distinct("words") if unique else F.col("words")
    distinct = F.array_distinct("words")
    # a candidate meets the rows of its own pairs only; those of one pair may be split between tasks
    pairs = (
        cands.select("words", F.explode(distinct).alias("w1"), distinct.alias("others"))
        .select("words", "w1", F.explode("others").alias("w2"))
        .join(deps, ["w1", "w2"])
    )
    if function in (3, 4):
        back = deps.select(F.col("w1").alias("w2"), F.col("w2").alias("w1"), F.col("dep").alias("back"))
        pairs = pairs.join(back, ["w1", "w2"]).withColumn("dep", (F.col("dep") + F.col("back")) / 2)
    if unique:
        pairs = pairs.filter("w1 <> w2")
        times = F.lit(1)
    else:
        times = F.size(F.filter("words", lambda w: w == F.col("w1")))
    total = F.size(pool) - (1 if unique else 0)
    per_word = pairs.groupBy("words", "w2").agg((F.sum(F.col("dep") * times)).alias("s"))
    maps = per_word.groupBy("words").agg(
        F.map_from_entries(F.collect_list(F.struct("w2", "s"))).alias("m")
    )
    weight = F.transform(
        "words",
        lambda w: F.when(total == 0, 1.0).otherwise(F.coalesce(F.try_element_at("m", w), F.lit(0.0)) / total),
    )
    return cands.join(maps, "words", "left").withColumn("weights", weight).drop("m")


def join_by_weight(cands: DataFrame, least: float, wildcard: bool = False) -> DataFrame:
    """Clusters: candidates that agree on all words of weight ``least`` or more.

    Other words become alternatives (``alts``, sorted), or with ``wildcard`` part of
    the gap. Columns ``words``, ``alts``, ``gap_min``, ``gap_max``, ``n``.
    """
    if wildcard:
        z = F.arrays_zip("words", "weights", "gap_min", "gap_max")
        start = F.expr(
            "named_struct('words', cast(array() as array<string>), 'lo', cast(array() as array<int>),"
            " 'hi', cast(array() as array<int>), 'a', 0, 'b', 0)"
        )

        def step(s: Column, x: Column) -> Column:
            heavy = x["weights"] >= least
            low, high = x["gap_min"] + s["a"], x["gap_max"] + s["b"]
            return F.struct(
                F.when(heavy, F.array_append(s["words"], x["words"])).otherwise(s["words"]).alias("words"),
                F.when(heavy, F.array_append(s["lo"], low)).otherwise(s["lo"]).alias("lo"),
                F.when(heavy, F.array_append(s["hi"], high)).otherwise(s["hi"]).alias("hi"),
                F.when(heavy, 0).otherwise(low + 1).alias("a"),
                F.when(heavy, 0).otherwise(high + 1).alias("b"),
            )

        folded = F.aggregate(F.slice(z, F.lit(1), F.size("words")), start, step)
        shaped = cands.withColumn("f", folded).select(
            F.col("f.words").alias("words"),
            F.array_append(F.col("f.lo"), F.element_at("gap_min", -1) + F.col("f.a")).alias("gap_min"),
            F.array_append(F.col("f.hi"), F.element_at("gap_max", -1) + F.col("f.b")).alias("gap_max"),
            F.expr("transform(f.words, w -> '')").alias("low"),
            "n",
        )
    else:
        heavy = F.zip_with("words", "weights", lambda w, x: F.when(x >= least, w).otherwise(F.lit("")))
        low = F.zip_with("words", "weights", lambda w, x: F.when(x >= least, F.lit("")).otherwise(w))
        shaped = cands.select(heavy.alias("words"), "gap_min", "gap_max", low.alias("low"), "n")
    z = F.arrays_zip("gap_min", "gap_max", "low")
    per_pos = (
        shaped.select("words", "n", F.posexplode(z).alias("pos", "z"))
        .groupBy("words", "pos")
        .agg(
            F.sum("n").alias("n"),
            F.min("z.gap_min").alias("lo"),
            F.max("z.gap_max").alias("hi"),
            F.array_sort(F.collect_set(F.when(F.col("z.low") != "", F.col("z.low")))).alias("alt"),
        )
    )
    ordered = F.array_sort(F.collect_list(F.struct("pos", "lo", "hi", "alt")))
    return per_pos.groupBy("words").agg(F.first("n").alias("n"), ordered.alias("s")).select(
        "words",
        F.transform(F.slice("s", F.lit(1), F.size("words")), lambda x: x["alt"]).alias("alts"),
        F.transform("s", lambda x: x["lo"]).alias("gap_min"),
        F.transform("s", lambda x: x["hi"]).alias("gap_max"),
        "n",
    )


def plain_clusters(cands: DataFrame) -> DataFrame:
    """Candidates as clusters, without alternatives."""
    return cands.select(
        "words",
        F.expr("transform(words, w -> cast(array() as array<string>))").alias("alts"),
        "gap_min",
        "gap_max",
        "n",
    )


def cluster_text(words: Column, alts: Column, lo: Column, hi: Column) -> Column:
    """``*{1,3} word (a|b) *{0,2}``; a gap shows where it can be longer than zero."""

    def gap(a: Column, b: Column) -> Column:
        return F.when(
            b > 0, F.concat(F.lit("*{"), a.cast("string"), F.lit(","), b.cast("string"), F.lit("}"))
        )

    def word(z: Column) -> Column:
        text = (
            F.when(F.size(z["alt"]) > 1, F.concat(F.lit("("), F.array_join(z["alt"], "|"), F.lit(")")))
            .when(F.size(z["alt"]) == 1, F.get(z["alt"], F.lit(0)))
            .otherwise(z["w"])
        )
        return F.concat_ws(" ", gap(z["a"], z["b"]), text)

    n = F.size(words)
    body = F.transform(
        F.arrays_zip(
            words.alias("w"), alts.alias("alt"), F.slice(lo, F.lit(1), n).alias("a"), F.slice(hi, F.lit(1), n).alias("b")
        ),
        word,
    )
    return F.concat_ws(" ", F.array_join(body, " "), gap(F.element_at(lo, -1), F.element_at(hi, -1)))


def common_cluster_words(clusters: DataFrame, share: float) -> DataFrame:
    """Words in at least ``share`` of all clusters."""
    total = clusters.agg(F.count(F.lit(1))).scalar()
    return (
        clusters.select(F.explode(F.array_distinct(F.filter("words", lambda w: w != ""))).alias("word"))
        .groupBy("word")
        .agg(F.count(F.lit(1)).alias("n_clusters"))
        .filter(F.col("n_clusters") >= total * share)
    )


def outliers(lines: DataFrame, per_line: DataFrame, frequent: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Lines that match no frequent candidate.

    For aggregated supports add the more specific candidates to ``frequent``.
    """
    covered = per_line.join(frequent.select("words"), "words", "left_semi").select(*keys)
    return lines.join(covered, list(keys), "left_anti")
