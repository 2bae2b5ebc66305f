"""SQL expression fragments for wide compositions.

A form has dozens of composed fields.  Writing them as one SQL expression
each keeps the driver's plan building short: a Column tree of the same size
takes thousands of calls into the JVM before the job even starts.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from vitalforms.functions.text import DB_WHITESPACE, WHITESPACE

Get = Callable[[str], str]


def text(value: str) -> str:
    """String literal."""
    body = "".join(c if c.isascii() and c.isprintable() and c not in "'\\" else f"\\u{ord(c):04x}" for c in value)
    return f"'{body}'"


def key_of(column: str) -> Get:
    """Look a key up in a map column (NULL when absent)."""
    return lambda key: f"{column}[{text(key)}]"


def strip(x: str) -> str:
    return f"btrim({x}, {text(WHITESPACE)})"


def quick_strip(x: str) -> str:
    """``strip`` of a column that costs little to mention: the set is searched only if an end is not a visible ASCII character."""
    return (f"CASE WHEN ascii({x}) BETWEEN 33 AND 126 AND ascii(substring({x}, -1)) BETWEEN 33 AND 126 "
            f"THEN {x} ELSE {strip(x)} END")


def db_trim(x: str) -> str:
    return f"btrim({x}, {text(DB_WHITESPACE)})"


# The choices below go through array functions, so that each operand is
# written (and evaluated) once; nullif() would repeat it.

def first_filled(*xs: str) -> str:
    """First operand that is not blank, stripped; '' when there is none."""
    return f"coalesce(get(filter(transform(array({', '.join(xs)}), x -> {strip('x')}), x -> x <> ''), 0), '')"


def not_empty(x: str) -> str:
    """NULL for an empty string, without a lambda (see ``text.not_empty``)."""
    return f"get(array_remove(array({x}), ''), 0)"


def apart(x: str) -> str:
    """The same string, in a projection compiled in many short methods (see ``text.apart``)."""
    return f"{x} || array_join(transform(array(''), e -> e), '')"


def or_chain(*xs: str, default: str = "") -> str:
    """First operand that is not empty."""
    return f"coalesce(get(filter(array({', '.join(xs)}), x -> x <> ''), 0), {text(default)})"


def filled_chain(*xs: str) -> str:
    """``or_chain`` with default '' and without a lambda, for projections that are kept apart (see ``apart``)."""
    return f"coalesce({', '.join(not_empty(x) for x in xs)}, '')"


def null_chain(*xs: str) -> str:
    return f"coalesce({', '.join(xs)}, '')"


def join_filled(sep: str, *xs: str, unlike: str = "") -> str:
    """Operands that are not empty (nor equal to ``unlike``), joined."""
    test = f"x <> '' AND x <> {text(unlike)}" if unlike else "x <> ''"
    return f"array_join(filter(array({', '.join(xs)}), x -> {test}), {text(sep)})"


def record_name(*xs: str) -> str:
    return db_trim(" || ' ' || ".join(null_chain(x) for x in xs))


def record_date(month: str, day: str, year: str) -> str:
    return db_trim(f"{null_chain(month)} || ' ' || {null_chain(day)} || ', ' || {null_chain(year)}")


def record_place(a: str, b: str) -> str:
    tail = f"CASE WHEN {null_chain(b)} IN ('', '0') THEN '' ELSE ', ' || {b} END"
    return db_trim(f"{null_chain(a)} || {tail}")


def screen_name(*xs: str) -> str:
    return strip(join_filled(" ", *xs))


def screen_date(month: str, day: str, year: str) -> str:
    with_comma = f"get(transform(filter(array({day}), x -> x <> ''), x -> x || ','), 0)"
    return strip(join_filled(" ", month, with_comma, year))


def screen_place(a: str, b: str) -> str:
    return join_filled(", ", a, b)


def comma_part(x: str, i: int) -> str:
    parts = f"filter(transform(split(coalesce({x}, ''), ','), p -> {strip('p')}), p -> p <> '')"
    return f"coalesce(get({parts}, {i}), '')"


def as_map(values: Mapping[str, str]) -> str:
    return "map(" + ", ".join(f"{text(k)}, {v}" for k, v in values.items()) + ")"


def case(subject: str, arms: Mapping[str, str], otherwise: str | None = None) -> str:
    body = " ".join(f"WHEN {text(k)} THEN {v}" for k, v in arms.items())
    tail = f" ELSE {otherwise}" if otherwise is not None else ""
    return f"CASE {subject} {body}{tail} END"


def text_array(values: tuple[str, ...]) -> str:
    return "array(" + ", ".join(text(v) for v in values) + ")"
