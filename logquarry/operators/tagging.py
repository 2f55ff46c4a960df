"""Lines to pieces: static text and tagged variables.

A line becomes ``parts struct<statics, vars, tags>`` in one projection without a
shuffle: the texts between the variables, the variables, and their tags. Most
characters are handled by one pass of a regex; arrays hold only the variables.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from logquarry.functions import tokens as tk
from logquarry.functions.arrays import explode_rows, posexplode_rows

Patterns = Sequence[tuple[str, str]]


def _raw(text: Column, tag: Column, before: Column) -> Column:
    return F.struct(text.alias("text"), tag.alias("tag"), before.alias("before"))


def segments(line: Column, patterns: Patterns) -> Column:
    """Cut a line at pattern matches; an earlier pattern takes its text first.

    Gaps and matches alternate, beginning and ending with a gap. ``before`` of a
    gap is the tag of the match in front of it.
    """
    segs = F.array(_raw(line, F.lit(""), F.lit("")))
    for tag, regex in patterns:
        segs = F.flatten(F.transform(segs, _cutter(tag, regex)))
    return segs


def _cutter(tag: str, regex: str) -> Callable[[Column], Column]:
    """Cuts one segment at the matches of a pattern; segments that are matches stay."""
    empty = F.lit("")

    def cut(s: Column) -> Column:
        gaps = F.split(s["text"], regex, -1)
        found = F.regexp_extract_all(s["text"], F.lit(regex), F.lit(0))
        pairs = F.arrays_zip(gaps.alias("gap"), found.alias("hit"))

        def pair(p: Column, i: Column) -> Column:
            before = F.when(i == 0, s["before"]).otherwise(F.lit(tag))
            gap = _raw(p["gap"], empty, before)
            hit = _raw(p["hit"], F.lit(tag), empty)
            return F.when(p["hit"].isNull(), F.array(gap)).otherwise(F.array(gap, hit))

        return F.when(s["tag"] != "", F.array(s)).otherwise(F.flatten(F.transform(pairs, pair)))

    return cut


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once."""
    return F.transform(F.array(value), use)[0]


# Up to this many variables in a line, counting words in front of the few numbers
# that need it is cheaper than numbering all tokens; beyond it, it would be quadratic.
_SHORT_LINE = 64


def _contexts(statics: Column, n: Column, before: Column) -> Column:
    """Context of each variable: the last word in front of it, else that of the one before."""
    words = F.transform(
        F.slice(statics, F.lit(1), n),
        lambda s, i: F.when(s.rlike("[A-Za-z<>]"), F.regexp_extract(s, tk.LAST_WORD, 1)).when(i == 0, before),
    )

    def filled(w: Column) -> Column:
        # positions that set a context, and how far each one reaches
        at = F.filter(
            F.transform(w, lambda x, i: F.when(x.isNotNull(), i)), lambda i: i.isNotNull()
        )
        return let(
            at,
            lambda a: F.flatten(
                F.zip_with(
                    a,
                    F.slice(F.concat(a, F.array(F.size(w))), F.lit(2), F.size(a)),
                    lambda lo, hi: F.array_repeat(F.get(w, lo), hi - lo),
                )
            ),
        )

    return let(words, lambda w: F.when(F.exists(w, lambda x: x.isNull()), filled(w)).otherwise(w))


def _token_numbers(text: Column, n: Column) -> Column:
    """Numbers of the variables among the tokens, for lines with many variables."""
    counted = F.filter(
        F.transform(tk.tokens(text), lambda t, i: F.when(tk.is_variable(t), i + 1)),
        lambda i: i.isNotNull(),
    )
    return F.when((n > _SHORT_LINE) & text.rlike(tk.LONG_NUMBER), counted)


def _token_number(statics: Column, numbers: Column, k: Column) -> Column:
    """Number of variable ``k``: the variables up to it and the words in front."""
    words = F.regexp_count(F.array_join(F.slice(statics, F.lit(1), k + 1), " "), F.lit("[A-Za-z<>]+"))
    return F.when(numbers.isNull(), k + 1 + words).otherwise(F.get(numbers, k))


def gap_parts(
    text: Column,
    before: Column,
    base: Column,
    style: str = "structured",
    use_context: bool = True,
    shape_mixed_digits: bool = True,
) -> Column:
    """``struct<statics, vars, tags>`` of a text without pattern matches.

    ``statics`` has one element more than ``vars``; joined in turn they are the text.
    """
    variables = F.regexp_extract_all(text, F.lit(tk.VARIABLE), F.lit(0))
    statics = F.split(text, tk.VARIABLE, -1)

    def tagged(z: Column) -> Column:
        n = F.size(z["vars"])
        if style == "generic":
            tags = F.array_repeat(F.lit("<*>"), n)
        else:
            extra = let(
                F.struct(
                    (_contexts(z["statics"], n, before) if use_context else F.array_repeat(F.lit(""), n)).alias("ctx"),
                    _token_numbers(text, n).alias("idx"),
                ),
                lambda e: F.transform(
                    z["vars"],
                    lambda v, k: variable_tag(
                        v,
                        F.get(e["ctx"], k),
                        base + _token_number(z["statics"], e["idx"], k),
                        shape_mixed_digits,
                    ),
                ),
            )
            tags = F.when(n == 0, F.expr("cast(array() as array<string>)")).otherwise(extra)
        return F.struct(z["statics"].alias("statics"), z["vars"].alias("vars"), tags.alias("tags"))

    return let(F.struct(variables.alias("vars"), statics.alias("statics")), tagged)


def line_parts(
    line: Column,
    patterns: Patterns = (),
    style: str = "structured",
    use_context: bool = True,
    shape_mixed_digits: bool = True,
) -> Column:
    """``struct<statics, vars, tags>`` of a line."""
    options = (style, use_context, shape_mixed_digits)
    whole = gap_parts(line, F.lit(""), F.lit(0), *options)
    if not patterns:
        return whole

    def part(s: Column, base: Column) -> Column:
        hit = F.struct(
            F.expr("cast(array() as array<string>)").alias("statics"),
            F.array(s["text"]).alias("vars"),
            F.array(s["tag"]).alias("tags"),
        )
        before = s["before"] if use_context else F.lit("")
        return F.when(s["tag"] != "", hit).otherwise(gap_parts(s["text"], before, base, *options))

    # tokens in front of each segment; quadratic only in the number of matches of a line
    def bases(segs: Column) -> Column:
        counts = F.transform(
            segs,
            lambda s: F.when(s["tag"] != "", 0).otherwise(F.regexp_count(s["text"], F.lit(tk.TOKEN_RUN))),
        )
        running = let(
            counts,
            lambda c: F.transform(
                c, lambda _, i: F.aggregate(F.slice(c, F.lit(1), i), F.lit(0), lambda a, x: a + x)
            ),
        )
        zeros = F.array_repeat(F.lit(0), F.size(segs))
        return F.when(line.rlike("[0-9]{3}"), running).otherwise(zeros)

    def joined(parts: Column) -> Column:
        fields = ("statics", "vars", "tags")
        return F.struct(
            *[F.flatten(F.transform(parts, (lambda f: lambda p: p[f])(f))).alias(f) for f in fields]
        )

    def cut(segs: Column) -> Column:
        return let(F.zip_with(segs, bases(segs), part), joined)

    return let(
        segments(line, patterns), lambda segs: F.when(F.size(segs) > 1, cut(segs)).otherwise(whole)
    )


def structured_tag(context: Column, structure: Column, index: Column | None = None) -> Column:
    """``<IDX=..|CTX=..|STR=..>`` with empty parts left out."""
    place = [] if index is None else [F.lit("IDX="), index.cast("string"), F.lit("|")]
    word = F.when(context == "", context).otherwise(F.concat(F.lit("CTX="), context, F.lit("|")))
    return F.concat(F.lit("<"), *place, word, F.lit("STR="), structure, F.lit(">"))


def variable_tag(token: Column, ctx: Column, idx: Column, shape_mixed_digits: bool = True) -> Column:
    """Tag of a variable token."""
    n = F.length(token).cast("string")
    number = F.when(F.length(token) <= 2, F.concat(F.lit("<LEN="), n, F.lit(">"))).otherwise(
        structured_tag(ctx, F.concat(F.lit("\\d{"), n, F.lit("}")), idx)
    )
    tag = F.when(tk.is_number(token), number)
    if shape_mixed_digits:
        tag = tag.when(
            tk.has_digit(token) & ~tk.has_alpha(token), structured_tag(ctx, tk.shape(token))
        )
    return tag.otherwise(structured_tag(ctx, F.concat(F.lit("_"), tk.specials(token))))


def parse_tag(tag: Column) -> Column:
    """Map of the parts of a structured tag.

    The parts come in a fixed order and context words hold no ``|``, so the
    structure part may contain any character.
    """
    pattern = r"^<(?:IDX=([0-9]+)\|?)?(?:LEN=([0-9]+)\|?)?(?:CTX=([^|]*)(?:\||(?=>$)))?(?:STR=(.*))?>$"
    keys = ["IDX", "LEN", "CTX", "STR"]
    entries = [
        F.struct(F.lit(k).alias("key"), F.regexp_extract(tag, pattern, i + 1).alias("value"))
        for i, k in enumerate(keys)
    ]
    return F.map_from_entries(F.filter(F.array(*entries), lambda e: e["value"] != ""))


def tag_lines(
    lines: DataFrame,
    patterns: Patterns = (),
    style: str = "structured",
    use_context: bool = True,
    shape_mixed_digits: bool = True,
) -> DataFrame:
    """Single pass: adds ``parts`` and drops nothing."""
    return lines.withColumn(
        "parts", line_parts(F.col("line"), patterns, style, use_context, shape_mixed_digits)
    )


def variable_rows(tagged: DataFrame) -> DataFrame:
    """``(chunk_id, line_no, var_no, tag, value)``; variables are numbered from 1 in their line."""
    zipped = F.arrays_zip(F.col("parts.tags").alias("tag"), F.col("parts.vars").alias("value"))
    return posexplode_rows(tagged, ["chunk_id", "line_no"], zipped, "pos", "v").select(
        "chunk_id",
        "line_no",
        (F.col("pos") + 1).cast("bigint").alias("var_no"),
        F.col("v.tag").alias("tag"),
        F.col("v.value").alias("value"),
    )


def template_text(statics: Column, tags: Column) -> Column:
    """Template as text for reports; variables appear as their tag."""
    return F.array_join(
        F.zip_with(statics, F.concat(tags, F.array(F.lit(""))), lambda s, t: F.concat(s, t)), ""
    )


def parts_template(parts: Column) -> Column:
    return template_text(parts["statics"], parts["tags"])


def template_counts(tagged: DataFrame, keys: Sequence[str] = (), **aggregates: Column) -> DataFrame:
    """Rows of equal templates: the keys, ``template`` as text, and the aggregates.

    Lines belong together if texts and tags are equal, not if they merely look alike:
    a literal ``<T>`` in a line stays apart from a placeholder of that name.
    """
    of_template = tagged.groupBy(*keys, F.col("parts.statics").alias("statics"), F.col("parts.tags").alias("tags"))
    found = of_template.agg(*[a.alias(name) for name, a in aggregates.items()])
    return found.select(*keys, template_text(F.col("statics"), F.col("tags")).alias("template"), *aggregates)


def tag_counts(tagged: DataFrame) -> DataFrame:
    """Occurrences of every tag in every chunk."""
    return (
        explode_rows(tagged, ["chunk_id"], F.col("parts.tags"), "tag")
        .groupBy("chunk_id", "tag")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def apply_threshold(tagged: DataFrame, threshold: int, patterns: Patterns = ()) -> DataFrame:
    """Second pass: a tag stays if a pattern gives it or it occurs more than ``threshold`` times in its chunk.

    What joins a chunk's lines are the tags that stay, at most the chunk's variables divided by the
    threshold; a line looks its own tags up in their hashed set, so rare tags cost nothing, however many
    a chunk has.
    """
    fixed = [tag for tag, _ in patterns]
    kept = (
        tag_counts(tagged)
        .filter((F.col("n") > threshold) & ~F.col("tag").isin(fixed))
        .groupBy("chunk_id")
        .agg(F.collect_set("tag").alias("kept"))
    )
    stays = F.concat(F.coalesce("kept", F.expr("cast(array() as array<string>)")), F.array(*[F.lit(t) for t in ["", *fixed]]))
    # distinct tags of the line that go
    going = F.array_except(F.col("parts.tags"), F.col("stays"))
    demoted = F.transform(F.col("parts.tags"), lambda t: F.when(F.array_contains(F.col("going"), t), F.lit("")).otherwise(t))
    changed = parts_of_pieces(_alternate(F.col("parts.statics"), F.col("parts.vars"), demoted))
    return (
        tagged.join(kept, "chunk_id", "left")
        .withColumn("stays", stays)
        .withColumn("going", going)
        .withColumn("parts", F.when(F.size("going") > 0, changed).otherwise(F.col("parts")))
        .select(*tagged.columns)
    )


def _alternate(statics: Column, variables: Column, tags: Column) -> Column:
    """Static and variable pieces in the order of the line."""
    zipped = F.arrays_zip(statics.alias("s"), variables.alias("v"), tags.alias("t"))
    return F.filter(
        F.flatten(
            F.transform(
                zipped,
                lambda z: F.array(
                    F.struct(z["s"].alias("text"), F.lit("").alias("tag")),
                    F.struct(z["v"].alias("text"), z["t"].alias("tag")),
                ),
            )
        ),
        lambda p: p["text"].isNotNull(),
    )


def parts_of_pieces(pieces: Column) -> Column:
    """``struct<statics, vars, tags>`` of ``array<struct<text, tag>>``; runs of static pieces are joined."""

    def build(p: Column) -> Column:
        at = F.filter(
            F.transform(p, lambda x, i: F.when(x["tag"] != "", i + 1)), lambda i: i.isNotNull()
        )

        def cut(a: Column) -> Column:
            begin = F.concat(F.array(F.lit(1)), F.transform(a, lambda i: i + 1))
            end = F.concat(a, F.array(F.size(p) + 1))
            kept = F.filter(p, lambda x: x["tag"] != "")
            return F.struct(
                F.zip_with(
                    begin,
                    end,
                    lambda lo, hi: F.array_join(F.transform(F.slice(p, lo, hi - lo), lambda x: x["text"]), ""),
                ).alias("statics"),
                F.transform(kept, lambda x: x["text"]).alias("vars"),
                F.transform(kept, lambda x: x["tag"]).alias("tags"),
            )

        return let(at, cut)

    return let(pieces, build)


_BLANK = r"[ \t\n\x0b\f\r]*+"
_STRING = r'[^"\\]*+(?:\\[^\n\r\x85\u2028\u2029][^"\\]*+)*+'
_KEY = re.compile(f'"({_STRING})"({_BLANK}:{_BLANK})')
_VALUE = re.compile(f'"({_STRING})"' + r'|([^ \t\n\x0b\f\r",{}\[\]:]++)')
_INNER = re.compile(r'[^{}\[\]"]++|([{\[])|([}\]])|"' + _STRING + '"')
_MEMBERS = ArrayType(StructType([StructField(c, StringType()) for c in ("gap", "key", "head", "value", "tail")]))


def _close(line: str, at: int, known: dict[int, int]) -> int:
    """End of the object or array that begins at ``at``, -1 without one; brackets inside are noted in ``known``."""
    if at in known:
        return known[at]
    unclosed, pos = [at], at + 1
    while unclosed:
        m = _INNER.match(line, pos)
        if m is None:
            break
        if m[1]:
            unclosed.append(pos)
        pos = m.end()
        if m[2]:
            known[unclosed.pop()] = pos
    known.update(dict.fromkeys(unclosed, -1))
    return known[at]


def json_members(line: str) -> list[dict]:
    """Members of an object from left to right, each with the text in front of it; the last entry has text only.

    A value is a string, a bare word, or an object or array of any depth as a whole.
    """
    out, known = [], {}
    done = at = 0
    while m := _KEY.search(line, at):
        start = m.end()
        if line[start : start + 1] in ("{", "["):
            end = _close(line, start, known)
            value, quote = line[start:end], ""
        else:
            v = _VALUE.match(line, start)
            end = v.end() if v else -1
            value, quote = (v[1], '"') if v and v[1] is not None else (v[2] if v else None, "")
        if end < 0:
            at = m.start() + 1
            continue
        out.append({"gap": line[done : m.start()], "key": m[1], "head": m[0] + quote, "value": value, "tail": quote})
        done = at = end
    out.append({"gap": line[done:], "key": None, "head": None, "value": None, "tail": None})
    return out


@F.pandas_udf(_MEMBERS)
def _members(lines: pd.Series) -> pd.Series:
    return lines.map(lambda x: None if x is None else json_members(x))


def tag_json_lines(
    lines: DataFrame, style: str = "structured", shape_mixed_digits: bool = True
) -> DataFrame:
    """JSON mode: values of a flat object are variables, the text around them is static.

    Tags of whole values live in their own namespace, ``<json:key>``. A value with
    delimiters is cut like a text line whose first context is the key. A nested
    object or array of any depth is one value. Lines that are not an object stay static.
    A short Python helper finds the members, in one scan of the line; the rest is column functions.
    """
    line = F.col("line")

    def static(text: Column) -> Column:
        return F.struct(text.alias("text"), F.lit("").alias("tag"))

    def parts(m: Column) -> Column:
        whole = F.array(
            F.struct(
                m["value"].alias("text"), F.concat(F.lit("<json:"), m["key"], F.lit(">")).alias("tag")
            )
        )
        cut = let(
            gap_parts(m["value"], m["key"], F.lit(0), style, True, shape_mixed_digits),
            lambda g: _alternate(g["statics"], g["vars"], g["tags"]),
        )
        is_cut = (m["tail"] != "") & m["value"].rlike(f"[{tk.DELIMITERS}]")
        body = F.when(is_cut, cut).otherwise(whole)
        all_parts = F.concat(F.array(static(m["gap"])), F.array(static(m["head"])), body, F.array(static(m["tail"])))
        return F.when(m["key"].isNull(), F.array(static(m["gap"]))).otherwise(all_parts)

    members = F.flatten(F.transform("members", parts))
    is_object = line.rlike(r"(?s)^\{.*\}$")
    all_pieces = F.when(is_object, members).otherwise(F.array(static(line)))
    found = lines.withColumn("members", _members(F.when(is_object, line)))
    return found.withColumn("parts", parts_of_pieces(all_pieces)).drop("members")


Handler = tuple[Callable[[Column], Column], Callable[[Column], Column]]


def handler_registry(**handlers: Handler) -> dict[str, Handler]:
    """User handlers ``name -> (encode, decode)`` for the tag ``<name>``; both work on columns."""
    return {f"<{name}>": pair for name, pair in handlers.items()}
