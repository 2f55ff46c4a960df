"""Token-level column functions. All of them run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The token delimiters, written for use inside a character class.
DELIMITERS = ' \\t\\n\\r,|;\\[\\]_+=:@#\\\\"{}()'

DELIMITER_TEXT = ' \t\n\r,|;[]_+=:@#\\"{}()'

DELIMITER_RUN = f"[{DELIMITERS}]+"
TOKEN_RUN = f"[^{DELIMITERS}]+"
RUNS = f"{DELIMITER_RUN}|{TOKEN_RUN}"
# A token of letters only; '<' and '>' count as letters.
_STATIC = f"[A-Za-z<>]++(?![^{DELIMITERS}])"
# Any other token. Repetitions are possessive, so long lines do not backtrack.
VARIABLE = f"(?<![^{DELIMITERS}])(?!{_STATIC})[^{DELIMITERS}]++"
# The last word of a static text.
LAST_WORD = f"([A-Za-z<>]++)[{DELIMITERS}]*+$"
# A number whose tag names its place in the line.
LONG_NUMBER = f"(?<![^{DELIMITERS}])[0-9]{{3,}}+(?![^{DELIMITERS}])"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def runs(line: Column | str) -> Column:
    """Delimiter runs and tokens of a line, in order; together they are the line."""
    return F.regexp_extract_all(col(line), F.lit(RUNS), F.lit(0))


def tokens(line: Column | str) -> Column:
    return F.regexp_extract_all(col(line), F.lit(TOKEN_RUN), F.lit(0))


def is_delimiter_run(piece: Column) -> Column:
    return F.instr(F.lit(DELIMITER_TEXT), F.substring(piece, 1, 1)) > 0


def has_digit(token: Column) -> Column:
    return token.rlike("[0-9]")


def has_alpha(token: Column) -> Column:
    return token.rlike("[A-Za-z<>]")


def has_special(token: Column) -> Column:
    """Anything but ASCII letters, digits, '<' and '>'; every non-ASCII letter counts."""
    return token.rlike("[^0-9A-Za-z<>]")


def is_number(token: Column) -> Column:
    return token.rlike("^[0-9]+$")


def is_variable(token: Column) -> Column:
    """A token varies if it holds a digit or a special character."""
    return token.rlike("[^A-Za-z<>]")


def specials(token: Column) -> Column:
    """ASCII characters of a token that are neither alphanumeric nor space."""
    return F.regexp_replace(token, r"[A-Za-z0-9\s\x0B]|[^\x00-\x7F]", "")


def digits(token: Column) -> Column:
    return F.regexp_replace(token, "[^0-9]", "")


def shape(token: Column) -> Column:
    """Digit runs become ``\\d{n}``; other characters stay, escaped where a regex needs it."""
    parts = F.regexp_extract_all(token, F.lit("[0-9]+|[^0-9]+"), F.lit(0))

    def part(p: Column) -> Column:
        return F.when(
            p.rlike("^[0-9]"), F.concat(F.lit("\\d{"), F.length(p).cast("string"), F.lit("}"))
        ).otherwise(F.regexp_replace(p, r"([.*+?()\[\]{}^$\\])", r"\\$1"))

    # the commonest shape needs no array
    run = lambda d: F.concat(F.lit("\\d{"), F.length(d).cast("string"), F.lit("}"))
    decimal = F.concat(
        run(F.substring_index(token, ".", 1)), F.lit("\\."), run(F.substring_index(token, ".", -1))
    )
    return F.when(token.rlike(r"^[0-9]+\.[0-9]+$"), decimal).otherwise(
        F.array_join(F.transform(parts, part), "")
    )


def refill_pattern(value: Column) -> Column:
    """Regex that cuts the digits of ``value`` into its digit runs."""
    runs_ = F.regexp_extract_all(value, F.lit("[0-9]+"), F.lit(0))
    return F.array_join(
        F.transform(runs_, lambda r: F.concat(F.lit("([0-9]{"), F.length(r).cast("string"), F.lit("})"))),
        "",
    )


def refill_layout(value: Column) -> Column:
    """Replacement that puts the digit runs back between the other characters."""
    parts = F.regexp_extract_all(value, F.lit("[0-9]+|[^0-9]+"), F.lit(0))
    first = F.when(value.rlike("^[0-9]"), 2).otherwise(1)

    def part(p: Column, i: Column) -> Column:
        # digit and other runs alternate, so the run number follows from the index
        number = F.floor((i + first) / 2).cast("int").cast("string")
        return F.when(p.rlike("^[0-9]"), F.concat(F.lit("$"), number)).otherwise(
            F.regexp_replace(p, r"([\\$])", r"\\$1")
        )

    return F.array_join(F.transform(parts, part), "")


def refill(digit_text: Column, pattern: Column, layout: Column) -> Column:
    """Inverse of :func:`digits` for a value whose run layout is known."""
    return F.regexp_replace(digit_text, pattern, layout)


def ipv4_number(value: Column) -> Column:
    """IPv4 text as twelve digits."""
    return F.array_join(F.transform(F.split(value, r"\."), lambda o: F.lpad(o, 3, "0")), "")


def ipv4_text(number: Column) -> Column:
    """Inverse of :func:`ipv4_number` for canonical addresses."""
    padded = F.lpad(number, 12, "0")
    octets = [F.substring(padded, 1 + 3 * i, 3).cast("int").cast("string") for i in range(4)]
    return F.concat_ws(".", *octets)


def is_canonical_ipv4(value: Column) -> Column:
    """No leading zeros and at most three digits per octet."""
    return value.rlike(r"^(0|[1-9][0-9]{0,2})(\.(0|[1-9][0-9]{0,2})){3}$")


def left_pad(value: Column, width: Column | int) -> Column:
    """Zero padding to ``width``; longer values are left alone."""
    w = F.lit(width) if isinstance(width, int) else width
    text = value.cast("string")
    return F.lpad(text, F.greatest(w, F.length(text)), F.lit("0"))


def zigzag(value: Column) -> Column:
    v = value.cast("bigint")
    return F.shiftleft(v, 1).bitwiseXOR(F.shiftright(v, 63))


def varint_size(value: Column) -> Column:
    """Bytes of the zigzag variable-length form of a 64-bit integer."""
    return F.greatest(F.lit(1), F.ceil(F.length(F.bin(zigzag(value))) / 7)).cast("bigint")


def digit_split(text: Column) -> Column:
    """Digit and non-digit runs of a header value."""
    return F.regexp_extract_all(text, F.lit("[0-9]+|[^0-9]+"), F.lit(0))


def separator_tokens(line: Column) -> Column:
    """Tokens with their separators kept: white space, ``:``, ``<*>``, ``,`` and ``=``."""
    return F.regexp_extract_all(
        line, F.lit(r"<\*>|\s+|[:,=]|(?:(?!<\*>)[^\s:,=])+"), F.lit(0)
    )


def word_tokens(line: Column) -> Column:
    """Words between white space, ``=``, ``:`` and ``,``; one blank word for none."""
    words = F.filter(F.split(line, r"[\s=:,]"), lambda w: w != "")
    return F.when(F.size(words) == 0, F.array(F.lit(" "))).otherwise(words)


def mask_patterns(text: Column, patterns: list[str], token: str = "<*>") -> Column:
    """Replace every match of the patterns, one after the other."""
    for p in patterns:
        text = F.regexp_replace(text, p, token)
    return text


def delete_patterns(text: Column, patterns: list[str]) -> Column:
    return mask_patterns(text, patterns, "")


def mask_number_tokens(words: Column) -> Column:
    """Pure numbers and IPv4 addresses of a word array become ``<*>``."""
    return F.transform(
        words,
        lambda w: F.when(
            w.rlike(r"^[0-9]+$|^([0-9]{1,3}\.){3}[0-9]{1,3}$"), F.lit("<*>")
        ).otherwise(w),
    )


def mask_non_ascii(text: Column) -> Column:
    return F.regexp_replace(text, r"[^\x00-\x7F]+", "<N/ASCII>")


def event_id(template: Column) -> Column:
    """First eight hex digits of the template's md5."""
    return F.substring(F.md5(template), 1, 8)


def wildcard_text(template: Column) -> Column:
    """Gap marks such as ``*{1,3}`` become ``<*>``."""
    return F.regexp_replace(template, r"\*\{[^}]*\}", "<*>")


def parameter_list(text: Column) -> Column:
    """Items of a printed list such as ``['a', 'b']``."""
    inner = F.regexp_replace(text, r"^\[|\]$", "")
    items = F.regexp_extract_all(inner, F.lit(r"'([^']*)'|\"([^\"]*)\""), F.lit(0))
    return F.transform(items, lambda i: F.substring(i, F.lit(2), F.length(i) - 2))


# Letters that name run lengths and first digits.
GROUP_LETTERS = "abcdefghijklmnopqrstuvwxyz"


def number_group(run: Column) -> Column:
    """Group key of a digit run: a letter for its length and, from length four on,
    one for its first digit. Runs of fifteen digits or more have no group."""
    letters = F.lit(GROUP_LETTERS)
    n = F.length(run)
    first = F.ascii(run) - F.lit(47)
    return F.when(
        n < 15,
        F.concat(
            F.lit("<"),
            F.substring(letters, n, F.lit(1)),
            F.when(n >= 4, F.substring(letters, first, F.lit(1))).otherwise(F.lit("")),
            F.lit(">"),
        ),
    )
