"""String functions shared by all operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters a full strip removes (all Unicode white space).
WHITESPACE = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
    "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
# The narrower set a database-side trim removes.
DB_WHITESPACE = " \t\n\r\x00\x0b"


def _class(chars: str) -> str:
    """Regular expression of one of some blanks; a visible ASCII character fails at the first test, the list is a chain of them."""
    runs: list[list[int]] = []
    for c in sorted(map(ord, chars)):
        if runs and c == runs[-1][1] + 1:
            runs[-1][1] = c
        else:
            runs.append([c, c])
    return "[[^!-~]&&[" + "".join(f"\\u{a:04x}" + (f"-\\u{b:04x}" if b > a else "") for a, b in runs) + "]]"


# A line break and the white space behind it.
LINE_BREAK = rf"\R{_class(WHITESPACE)}*+"
# A line of a text of ``joined_lines`` with a colon and a value behind it, stripped.
_BLANK = _class(WHITESPACE.replace("\n", ""))
VALUE_LINE = rf"(?m)^[^:\n]*+:{_BLANK}*+(.*(?!{_BLANK}).)"

Getter = Callable[[str], Column]


def map_getter(fields: str | Column) -> Getter:
    """Look a key up in a map column (NULL when absent)."""
    col = F.col(fields) if isinstance(fields, str) else fields
    return lambda key: col[key]


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITESPACE))


def db_trim(c: Column) -> Column:
    return F.btrim(c, F.lit(DB_WHITESPACE))


def once(c: Column, f: Callable[[Column], Column]) -> Column:
    """f(c) with c evaluated once, however often f mentions it."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def filled(c: Column) -> Column:
    """NULL for an empty string, the value itself otherwise.

    Written as an array filter because ``nullif`` evaluates its operand
    twice, which multiplies when searches are nested.
    """
    return F.get(F.filter(F.array(c), lambda x: x != ""), F.lit(0))


def not_empty(c: Column) -> Column:
    """``filled`` without a lambda.

    What stands inside a lambda's function is evaluated node by node; this form
    is compiled together with its operand, which counts where a row has dozens.
    """
    return F.get(F.array_remove(F.array(c), ""), F.lit(0))


def apart(c: Column) -> Column:
    """The same string.  A projection with a lambda is compiled in many short methods.

    Without one it becomes a single method, and one of dozens of compiled
    look-ups is too long for the JVM to translate.
    """
    return F.concat(c, F.array_join(F.transform(F.array(F.lit("")), lambda x: x), ""))


def stripped(c: Column) -> Column:
    """Stripped value, NULL when blank."""
    return filled(strip(c))


def first_filled(*cols: Column, default: str | None = "") -> Column:
    """First column whose stripped value is not empty."""
    parts = [stripped(c) for c in cols]
    if default is not None:
        parts.append(F.lit(default))
    return F.coalesce(*parts)


def or_chain(*cols: Column, default: str = "") -> Column:
    """First non-empty value, unstripped: ``a or b or default``."""
    return F.coalesce(*[filled(c) for c in cols], F.lit(default))


def null_chain(*cols: Column, default: str = "") -> Column:
    """First non-null value: an empty string counts as present."""
    return F.coalesce(*cols, F.lit(default))


def capitalize(c: Column) -> Column:
    """First character upper, the rest lower (not per word)."""
    return once(c, lambda x: F.concat(F.upper(F.substring(x, 1, 1)),
                                       F.lower(F.substring(x, 2, 2**31 - 1))))


def joined_lines(c: Column) -> Column:
    """The non-empty lines of a text, stripped on the left, with a line feed between them."""
    return F.regexp_replace(strip(c), LINE_BREAK, "\n")


def after_colon(c: Column) -> Column:
    """Text after the first colon, stripped; NULL without a colon."""
    pos = F.instr(c, ":")
    return F.when(pos > 0, strip(F.substring(c, pos + 1, F.length(c))))


def comma_parts(c: Column) -> Column:
    """Non-blank, stripped parts of a comma list."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ","), strip), lambda x: x != "")


def comma_part(c: Column, i: int) -> Column:
    return F.coalesce(F.get(comma_parts(c), F.lit(i)), F.lit(""))


def join_words(words: Column) -> Column:
    """Words stripped one by one, joined with one space, block stripped."""
    return strip(F.array_join(F.transform(words, strip), " "))


def blank_if_separators(c: Column) -> Column:
    """Blank out a string made of spaces and commas only."""
    return F.when(F.btrim(c, F.lit(" ,")) == "", F.lit("")).otherwise(c)


def words(c: Column) -> Column:
    """White-space separated tokens."""
    return F.filter(F.split(c, r"[\s\x1c-\x1f\x85\p{Z}]+"), lambda x: x != "")


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def stem(path: Column) -> Column:
    """File name without its last extension."""
    return F.regexp_replace(basename(path), r"(?<=.)\.[^.]*$", "")


def extension(path: Column) -> Column:
    """Lower-case last extension, '' when there is none."""
    return F.lower(F.regexp_extract(basename(path), r".\.([^.]+)$", 1))


def stem_label(path: Column) -> Column:
    return F.replace(stem(path), F.lit("_"), F.lit(" "))


def char_index(text: Column) -> Column:
    """1-based indices of the printable ASCII characters of a text.

    Characters outside the alphabet are dropped; a text that loses all of
    them encodes as one space.
    """
    chars = F.filter(F.split(text, ""), lambda x: (x >= " ") & (x <= "~") & (x != ""))
    codes = F.transform(chars, lambda x: F.ascii(x) - 31)
    return F.when(F.size(codes) == 0, F.array(F.lit(1))).otherwise(codes)


def index_char(idx: Column) -> Column:
    """Character of a 1-based alphabet index, NULL outside it."""
    return F.when(idx.between(1, 95), F.char(idx + 31))


def safe_ratio(num: Column, den: Column, scale: float = 1.0) -> Column:
    """num / den * scale, 0 when the denominator is 0."""
    return F.coalesce(F.try_divide(num.cast("double"), den.cast("double")) * F.lit(float(scale)),
                      F.lit(0.0))
