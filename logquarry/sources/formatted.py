"""Lines with a declared header format, such as ``<Date> <Time> <Level>: <Content>``."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class LineFormat:
    """Anchored regex of a format, with the group number of each header."""

    regex: str
    headers: tuple[str, ...]
    groups: tuple[int, ...]


def line_format(text: str) -> LineFormat:
    """Compile a format string; literal parts are regex, and runs of blanks match any white space.

    Parentheses of the literal parts count as groups, so headers keep their number.
    """
    regex, headers, groups, n = "", [], [], 0
    for i, part in enumerate(re.split(r"<([^<>]+)>", text)):
        if i % 2:
            n += 1
            headers.append(part)
            groups.append(n)
            regex += "(.*?)"
        else:
            n += len(re.findall(r"(?<!\\)\((?!\?)", part))
            regex += re.sub(" +", lambda _: r"\s+", part)
    return LineFormat(f"^{regex}$", tuple(headers), tuple(groups))


def parse_format(lines: DataFrame, fmt: LineFormat, on_mismatch: str = "drop", text: str = "line") -> DataFrame:
    """One column per header.

    A line that does not match is dropped (``drop``) or becomes ``Content`` as a
    whole with the other headers empty (``keep``). The line's own key stays.
    """
    if on_mismatch not in ("drop", "keep"):
        raise ValueError(on_mismatch)
    matched = F.col(text).rlike(fmt.regex)
    columns = []
    for header, group in zip(fmt.headers, fmt.groups):
        value = F.regexp_extract(text, fmt.regex, group)
        if on_mismatch == "keep":
            value = F.when(matched, value).otherwise(F.col(text) if header == "Content" else F.lit(""))
        columns.append(value.alias(header))
    kept = lines.filter(matched) if on_mismatch == "drop" else lines
    return kept.select(*[c for c in lines.columns if c != text], *columns)


def loading_rate(lines: DataFrame, fmt: LineFormat, text: str = "line") -> DataFrame:
    """Share of lines that match the format."""
    matched = F.col(text).rlike(fmt.regex)
    return lines.agg(
        F.count(F.lit(1)).alias("n_lines"),
        F.count_if(matched).alias("n_loaded"),
        F.avg(matched.cast("double")).alias("loading_rate"),
    )
