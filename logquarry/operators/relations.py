"""Relations between the columns of a table of variables.

Rows carry ``chunk_id`` and an order; every window stays inside a chunk.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from itertools import combinations, permutations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from logquarry.session import drop_written, task_count, written

# Characters that may cut a value into fields.
FIELD_DELIMITERS = "-#><_:;,[]\\/.()"


def long_columns(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """``(keys, col, value)`` rows of a wide table."""
    cells = F.array(*[F.struct(F.lit(c).alias("col"), F.col(c).cast("string").alias("value")) for c in columns])
    return df.select(*keys, F.explode(cells).alias("c")).select(*keys, "c.col", "c.value")


def value_counts(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    return cells.groupBy(*keys, "col", "value").agg(F.count(F.lit(1)).alias("n"))


def column_types(counts: DataFrame, keys: Sequence[str], bits: int = 31) -> DataFrame:
    """Numeric columns (all integers below ``2**bits`` in size), and columns ranked by distinct values."""
    number = F.when(F.col("value").rlike("^[+-]?[0-9]{1,19}$"), F.col("value").try_cast("bigint"))
    fits = number.isNotNull() if bits == 63 else F.coalesce(F.abs(number) < (1 << bits), F.lit(False))
    w = W.partitionBy(*keys).orderBy("n_distinct", "col")
    # one row per column and key from here on
    return (
        counts.groupBy(*keys, "col")
        .agg(
            F.bool_and(fits).alias("is_numeric"),
            F.count(F.lit(1)).alias("n_distinct"),
            F.sum("n").alias("n"),
        )
        .withColumn("rank", F.row_number().over(w).cast("bigint"))
    )


@dataclass(frozen=True)
class Form:
    """A numeric column as it is, or as the step to the row before (``do``) or after (``up``),
    the neighbour being the next row or the next row with the same id."""

    source: str
    kind: str = "raw"
    by: str | None = None

    @property
    def name(self) -> str:
        return "_".join(x for x in (self.source, None if self.kind == "raw" else self.kind, self.by) if x)

    def column(self, order: str) -> Column:
        v = F.col(self.source)
        w = W.partitionBy("chunk_id", *([self.by] if self.by else [])).orderBy(order)
        if self.kind == "do":
            return v - F.coalesce(F.lag(v).over(w), F.lit(0))
        if self.kind == "up":
            return F.coalesce(F.lead(v).over(w) - v, v)
        return v

    def restore(self, value: Column, order: str) -> Column:
        """The column's values from the values of this form."""
        w = W.partitionBy("chunk_id", *([self.by] if self.by else [])).orderBy(order)
        if self.kind == "do":
            return F.sum(value).over(w.rowsBetween(W.unboundedPreceding, W.currentRow))
        if self.kind == "up":
            rest = F.sum(value).over(w.rowsBetween(W.currentRow, W.unboundedFollowing))
            last = F.last(value).over(w.rowsBetween(W.currentRow, W.unboundedFollowing))
            return 2 * last - rest
        return value


def forms(numeric: Sequence[str], ids: Sequence[str]) -> list[Form]:
    """Raw, up, down, and up and down per id column, for the first three ids."""
    out = []
    for c in numeric:
        out += [Form(c), Form(c, "up"), Form(c, "do")]
        for i in ids[:3]:
            out += [Form(c, "up", i), Form(c, "do", i)]
    return out


def with_forms(df: DataFrame, catalog: Sequence[Form], order: str) -> DataFrame:
    return df.select("chunk_id", order, *[f.column(order).alias(f.name) for f in catalog])


def expressions(catalog: Sequence[Form], triples: bool = True) -> list[tuple[Form, ...]]:
    """Single forms, differences ``a-b`` and ``a-b-c`` of forms of different columns.

    A pair may not mix two ids; a triple has one id, or none, throughout.
    """
    index = {f: i for i, f in enumerate(catalog)}
    out: list[tuple[Form, ...]] = [(f,) for f in catalog]
    for b, a in combinations(catalog, 2):
        if a.source != b.source and (a.by is None or b.by is None or a.by == b.by):
            out.append((a, b))
    if triples:
        for a, b, c in permutations(catalog, 3):
            if index[b] > index[c] and len({a.source, b.source, c.source}) == 3 and a.by == b.by == c.by:
                out.append((a, b, c))
    return out


def expression_name(e: Sequence[Form]) -> str:
    return "-".join(f.name for f in e)


def _difference(e: Sequence[Form]) -> Column:
    value = F.col(e[0].name)
    for f in e[1:]:
        value = value - F.col(f.name)
    return value


_TASK_CELLS = 4_000_000  # values of expressions that one task makes
_WAVE_CELLS = 300_000_000  # values of expressions that are counted at once, and are on disk meanwhile


def _value_type(df: DataFrame, catalog: Sequence[Form]) -> str:
    """``bigint`` where no expression of the columns can leave its range, else a decimal."""
    sources = sorted({f.source for f in catalog})
    if any(df.schema[c].dataType.typeName() not in ("byte", "short", "integer", "long") for c in sources):
        return "decimal(38,6)"
    ends = df.agg(*[f(c) for c in sources for f in (F.min, F.max)]).first()
    # a step is a difference of two values, and an expression has up to three forms
    return "bigint" if all(abs(e) < (1 << 62) // 6 for e in ends if e is not None) else "decimal(38,6)"


def relation_scores(df: DataFrame, catalog: Sequence[Form], order: str, triples: bool = True) -> DataFrame:
    """``(expr, score)``: entropy in nats times the number of rows, for every expression.

    A row holds its forms as one array, and expressions are made of places in it inside
    the row, so the plan has the same size for any number of columns. Rows are dealt by chunk
    to as many tasks as their expressions ask for. Value counts are
    aggregated before the sum, so a value that fills most rows is one row. Where all values would
    be more than ``_WAVE_CELLS``, some expressions at a time are counted.
    ``n*H = n ln n - sum(c ln c)``.
    """
    n_forms = len(catalog)
    sources = sorted({f.source for f in catalog})
    ids = sorted({f.by for f in catalog if f.by is not None})
    triples = triples and len(sources) > 2
    listed = expressions(catalog, triples)
    per_row = len(listed)
    kind = _value_type(df, catalog)
    needed = df.select("chunk_id", order, *[c for c in dict.fromkeys([*sources, *ids]) if c != order])
    n_rows = df.count()
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, -(-n_rows // max(1, _TASK_CELLS // per_row)))
    dealt = needed.repartition(tasks, "chunk_id")
    source = F.array(*[F.lit(sources.index(f.source)) for f in catalog])
    by = F.array(*[F.lit(-1 if f.by is None else ids.index(f.by)) for f in catalog])
    wide = with_forms(dealt, catalog, order).select(F.array(*[F.col(f.name).cast(kind) for f in catalog]).alias("v"))
    places = F.sequence(F.lit(0), F.lit(n_forms - 1))
    below = lambda c: F.explode(F.when(F.col(c) > 0, F.sequence(F.lit(0), F.col(c) - 1)))
    at = lambda x, c: x[F.col(c)]
    one = wide.select("v", F.explode(places).alias("a"))
    none = F.lit(-1)
    number = lambda a, b, c: ((F.col(a).cast("bigint") * (n_forms + 1) + (b + 1)) * (n_forms + 1) + (c + 1)).alias("e")
    value = lambda *of: sum((-at(F.col("v"), c) for c in of[1:]), at(F.col("v"), of[0])).alias("v")
    two = one.select("v", "a", below("a").alias("b")).where(at(source, "a") != at(source, "b"))
    two = two.where((at(by, "a") < 0) | (at(by, "b") < 0) | (at(by, "a") == at(by, "b")))
    cells = one.select(number("a", none, none), value("a")).union(two.select(number("a", F.col("b"), none), value("a", "b")))
    if triples:
        alike = lambda x, y: (at(source, x) != at(source, y)) & (at(by, x) == at(by, y))
        first = one.select("v", "a", F.explode(places).alias("b")).where(alike("a", "b"))
        three = first.select("v", "a", "b", below("b").alias("c")).where(alike("a", "c") & alike("b", "c"))
        cells = cells.union(three.select(number("a", F.col("b"), F.col("c")), value("a", "b", "c")))
    names = F.array(*[F.lit(f.name) for f in catalog])
    if n_rows * per_row <= _WAVE_CELLS:
        scores = _scored(cells)
    else:
        scores = _scores_in_waves(wide, [[catalog.index(f) for f in e] for e in listed], n_forms, n_rows)
    # one row for each expression
    base = n_forms + 1
    of = [F.floor(F.col("e") / base**2), F.floor(F.col("e") / base) % base - 1, F.col("e") % base - 1]
    expr = F.concat_ws("-", *[F.when(k >= 0, F.get(names, k.cast("int"))) for k in of])
    return scores.select(expr.alias("expr"), "score")


def _scored(cells: DataFrame) -> DataFrame:
    """``(e, score)`` from the values (e, v) of expressions."""
    counts = cells.groupBy("e", "v").agg(F.count(F.lit(1)).alias("c"))
    n = F.sum("c")
    return counts.groupBy("e").agg((n * F.log(n) - F.sum(F.col("c") * F.log(F.col("c")))).alias("score"))


def _scores_in_waves(wide: DataFrame, places: Sequence[Sequence[int]], n_forms: int, n_rows: int) -> DataFrame:
    """``(e, score)`` of the expressions with their forms at ``places`` of ``v``, some at a time.

    The forms are written once; the shuffle of a wave is removed when its scores are written.
    """
    spark = wide.sparkSession
    wide = written(wide)
    base = n_forms + 1
    rows = []
    for e in places:
        a, b, c = [*e, -1, -1][:3]
        rows.append(((a * base + b + 1) * base + c + 1, a, b, c))
    at = lambda c: F.col("v")[F.col(c)]
    value = F.when(F.col("b") < 0, at("a")).when(F.col("c") < 0, at("a") - at("b")).otherwise(at("a") - at("b") - at("c"))
    several = max(1, _WAVE_CELLS // n_rows)
    paths = []
    for k in range(0, len(rows), several):
        # a wave's expressions, a row each
        some = spark.createDataFrame(rows[k : k + several], "e long, a int, b int, c int")
        paths.append(written(_scored(wide.crossJoin(F.broadcast(some)).select("e", value.alias("v")))).saved_path)
    drop_written(wide)
    return spark.read.schema("e long, score double").parquet(*paths)


def choose_rules(scores: DataFrame, catalog: Sequence[Form], triples: bool = True) -> list[tuple[Form, ...]]:
    """One expression per column: again and again the lowest score that gives exactly one new column.

    The score table has one row per expression, so its size depends on the number of
    columns only.
    """
    value = {r["expr"]: r["score"] for r in scores.collect()}
    ranked = sorted(
        (e for e in expressions(catalog, triples) if expression_name(e) in value),
        key=lambda e: (value[expression_name(e)], len(e), expression_name(e)),
    )
    known: set[str] = set()
    rules = []
    sources = {f.source for f in catalog}
    while known < sources:
        rule = next(e for e in ranked if len({f.source for f in e} - known) == 1)
        rules.append(rule)
        known |= {f.source for f in rule}
    return rules


def apply_rules(df: DataFrame, rules: Sequence[Sequence[Form]], catalog: Sequence[Form], order: str, keep: Sequence[str] = ()) -> DataFrame:
    """``(chunk_id, order, keep, rule_0, rule_1, ..)``: numeric columns rewritten by the rules."""
    used = [f for f in catalog if any(f in r for r in rules)]
    wide = df.select("chunk_id", order, *keep, *[f.column(order).alias(f.name) for f in used])
    return wide.select(
        "chunk_id", order, *keep, *[_difference(r).alias(f"rule_{i}") for i, r in enumerate(rules)]
    )


def undo_rules(encoded: DataFrame, rules: Sequence[Sequence[Form]], order: str) -> DataFrame:
    """The numeric columns from rewritten ones, in the order in which the rules determine them."""
    df, known = encoded, set()
    for i, rule in enumerate(rules):
        new = next(f for f in rule if f.source not in known)
        others = [f for f in rule if f is not new]
        for f in others:
            df = df.withColumn(f.name + "#", f.column(order))
        out = F.col(f"rule_{i}")
        if new == rule[0]:
            for f in others:
                out = out + F.col(f.name + "#")
        else:
            out = F.col(rule[0].name + "#") - out
            for f in others[1:]:
                out = out - F.col(f.name + "#")
        df = df.withColumn("solved", out)
        df = df.withColumn(new.source, new.restore(F.col("solved"), order)).drop(
            "solved", f"rule_{i}", *[f.name + "#" for f in others]
        )
        known.add(new.source)
    return df


def weighted_entropy(counts: DataFrame, keys: Sequence[str], value: str, out: str) -> DataFrame:
    """``-sum p ln p log2(|v|+1)`` from value counts ``n``."""
    weight = F.col("n") * F.log2(F.abs(value) + 1)
    n = F.sum("n")
    return counts.groupBy(*keys).agg(
        ((F.log(n) * F.sum(weight) - F.sum(weight * F.log("n"))) / n).alias(out)
    )


def delta_usefulness(df: DataFrame, columns: Sequence[str], order: str) -> DataFrame:
    """``(chunk_id, col, before, after, useful)``: whether differences are the cheaper form."""
    w = W.partitionBy("chunk_id").orderBy(order)
    cells = F.array(
        *[F.struct(F.lit(c).alias("col"), F.col(c).alias("v"), (F.col(c) - F.lag(c).over(w)).alias("d")) for c in columns]
    )
    long = df.select("chunk_id", cells.alias("a")).select("chunk_id", F.explode("a").alias("c")).select("chunk_id", "c.*")
    both = long.select("chunk_id", "col", F.explode(F.array(
        F.struct(F.lit("before").alias("side"), F.col("v").alias("x")),
        F.struct(F.lit("after").alias("side"), F.col("d").alias("x")),
    )).alias("s")).select("chunk_id", "col", "s.side", "s.x").filter("x is not null")
    counts = both.groupBy("chunk_id", "col", "side", "x").agg(F.count(F.lit(1)).alias("n"))
    ent = weighted_entropy(counts, ["chunk_id", "col", "side"], "x", "h")
    return (
        ent.groupBy("chunk_id", "col")
        .agg(
            F.max(F.when(F.col("side") == "before", F.col("h"))).alias("before"),
            F.coalesce(F.max(F.when(F.col("side") == "after", F.col("h"))), F.lit(0.0)).alias("after"),
        )
        .withColumn("useful", F.round(F.col("before"), 9) >= F.round(F.col("after"), 9))
    )


def dictionary_usefulness(counts: DataFrame, keys: Sequence[str], share: float = 0.5) -> DataFrame:
    """``(keys, col, useful)``: fewer distinct values than ``share`` of all."""
    return counts.groupBy(*keys, "col").agg(
        F.count(F.lit(1)).alias("n_distinct"),
        F.sum("n").alias("n"),
        (F.count(F.lit(1)) < share * F.sum("n")).alias("useful"),
    )


def dictionary_delta(df: DataFrame, column: str, order: str) -> DataFrame:
    """Adds ``dict_delta``: first-seen ids from 0 inside the chunk, then their differences."""
    first = F.min(order).over(W.partitionBy("chunk_id", column))
    w = W.partitionBy("chunk_id").orderBy(order)
    ids = df.withColumn("first_at", first).withColumn(
        "dict_id", F.dense_rank().over(W.partitionBy("chunk_id").orderBy("first_at")) - 1
    )
    return ids.withColumn(
        "dict_delta", (F.col("dict_id") - F.coalesce(F.lag("dict_id").over(w), F.lit(0))).cast("bigint")
    ).drop("first_at")


def _common(a: str, b: str) -> str:
    """Longest common subsequence; of equally long ones the one that skips in ``a`` first."""
    n, m = len(a), len(b)
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            best[i][j] = (
                best[i + 1][j + 1] + 1 if a[i] == b[j] else max(best[i + 1][j], best[i][j + 1])
            )
    out, i, j = [], 0, 0
    while i < n and j < m:
        if a[i] == b[j]:
            out.append(a[i])
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            i += 1
        else:
            j += 1
    return "".join(out)


def delimiter_signature(value: Column) -> Column:
    """The delimiters of a value, in order."""
    keep = "".join("\\" + c for c in FIELD_DELIMITERS)
    return F.regexp_replace(value, f"[^{keep}]", "")


def column_patterns(df: DataFrame, column: str, order: str, keys: Sequence[str] = ("chunk_id",)) -> DataFrame:
    """``(keys, pattern)``: delimiters common to all values of a column in a chunk.

    Values are reduced to their distinct delimiter signatures first. Where all agree, the
    signature is the pattern; the others are folded in the order of their first value.
    """
    sig = delimiter_signature(F.col(column))
    signatures = df.groupBy(*keys, sig.alias("sig")).agg(F.min(order).alias("at"))
    gathered = signatures.groupBy(*keys).agg(F.min("sig").alias("least"), F.max("sig").alias("most"), F.collect_list(F.struct("at", "sig")).alias("s"))
    differ = F.col("least") != F.col("most")
    # a function of pandas runs for every row, so it is handed nothing where all agree
    folded = common_delimiters(F.when(differ, F.transform(F.array_sort("s"), lambda x: x["sig"])))
    return gathered.select(*keys, F.when(differ, folded).otherwise(F.col("least")).alias("pattern"))


@F.pandas_udf(StringType())
def common_delimiters(signatures: pd.Series) -> pd.Series:
    """The longest common part of signatures, taken in one after the other."""

    def fold(sigs) -> str | None:
        if sigs is None:
            return None
        pattern = sigs[0]
        for sig in sigs[1:]:
            if not pattern:
                break
            # a signature that holds the pattern changes nothing
            rest = iter(sig)
            if not all(d in rest for d in pattern):
                pattern = _common(pattern, sig)
        return pattern

    return signatures.map(fold)


def split_by_pattern(value: Column, pattern: Column) -> Column:
    """Fields of a value between the delimiters of the pattern; empty fields are kept.

    The fields joined by the delimiters are the value again.
    """
    delimiters = F.filter(F.split(pattern, "", -1), lambda d: d != "")

    def cut(s: Column, d: Column) -> Column:
        at = F.position(d, s["rest"])
        return F.struct(
            F.array_append(s["out"], F.substring(s["rest"], F.lit(1), at - 1)).alias("out"),
            F.substring(s["rest"], at + 1, F.length(s["rest"])).alias("rest"),
        )

    start = F.struct(F.expr("cast(array() as array<string>)").alias("out"), value.alias("rest"))
    return F.aggregate(delimiters, start, cut, lambda s: F.array_append(s["out"], s["rest"]))


def join_by_pattern(fields: Column, pattern: Column) -> Column:
    """Inverse of :func:`split_by_pattern`."""
    delimiters = F.filter(F.split(pattern, "", -1), lambda d: d != "")
    return F.array_join(
        F.zip_with(fields, F.array_append(delimiters, F.lit("")), lambda f, d: F.concat(f, d)), ""
    )
