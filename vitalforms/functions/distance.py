"""Edit distances over characters and over tokens."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vitalforms.functions.text import once, words

# Below so many cells of the plain table the shorter ways cost more than they save; the distance is the same.
SMALL_TABLE = 4096

# Expressions over strings a and b, in the order in which each builds on the ones before.
_COMMON_START = """aggregate(transform(sequence(int(log2(greatest(length(a), 1))), 0, -1), i -> shiftleft(1, i)), 0,
  (n, step) -> if(n + step <= least(length(a), length(b)) AND substring(a, n + 1, step) = substring(b, n + 1, step), n + step, n))"""
_MISMATCHES = """filter(zip_with(split(a, ''), split(b, ''), (x, y) -> if(x = y, NULL, named_struct('x', x, 'y', y))), p -> p IS NOT NULL)"""


def _bind(name: str, value: str, body: str) -> str:
    """``body`` with a name bound to a value, which is evaluated once."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def _within(bound: str) -> str:
    """The distance if it is at most ``bound``, NULL otherwise, by a band of that width."""
    return f"get(filter(array(levenshtein(a, b, int({bound}))), d -> d >= 0), 0)"


def _doubling(least: str, most: str) -> str:
    """Exact distance known to lie between two bounds: bands of doubled width until one holds it."""
    tries = [_within(f"least(greatest(1, {least}) * {1 << i}, {most})") for i in range(0, 16, 2)]
    return f"coalesce({', '.join(tries)}, levenshtein(a, b))"


def bounded_distance(left: str, right: str) -> str:
    """Expression of the exact edit distance of two strings by upper and lower bounds.

    The common start and end are cut off.  Strings of one length differ by at
    most their mismatching places, and if no character is lost at one place and
    gained at another, each of these costs an edit: then the count is the
    distance and no table is filled.  Otherwise the table is filled in a band
    whose width doubles until the distance lies inside.
    """
    same_length = _bind("m", _MISMATCHES, f"""CASE WHEN NOT arrays_overlap(transform(m, p -> p.x), transform(m, p -> p.y))
      THEN size(m) ELSE {_doubling("1", "size(m)")} END""")
    rest = f"""CASE WHEN length(a) = 0 OR length(b) = 0 THEN length(a) + length(b) WHEN length(a) = length(b) THEN {same_length}
      ELSE {_doubling("abs(length(a) - length(b))", "greatest(length(a), length(b))")} END"""
    back = _bind("a", "reverse(a)", _bind("b", "reverse(b)", _bind(
        "n", _COMMON_START, _bind("a", "substring(a, n + 1)", _bind("b", "substring(b, n + 1)", rest)))))
    cut = _bind("n", _COMMON_START, _bind("a", "substring(a, n + 1)", _bind("b", "substring(b, n + 1)", back)))
    whole = f"""CASE WHEN a IS NULL OR b IS NULL THEN NULL WHEN a = b THEN 0
      WHEN bigint(length(a)) * length(b) <= {SMALL_TABLE} THEN levenshtein(a, b) ELSE {cut} END"""
    return _bind("a", left, _bind("b", right, whole))


def char_distance(a: str, b: str) -> Column:
    """Edit distance of two string columns, given by name."""
    return F.expr(bounded_distance(a, b))


def _code_point(i: Column) -> Column:
    """One character per positive integer, stepping over the surrogate range."""
    code = F.when(i >= 0xD800, i + 0x800).otherwise(i)
    return F.when(i < 256, F.char(i)).otherwise(F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))


def token_distance(a: Column, b: Column) -> Column:
    """Edit distance of two token arrays.

    Each distinct token of the pair is given one character, so the built-in
    character distance applies to the encoded strings.
    """
    def encode(tokens: Column, alphabet: Column) -> Column:
        return F.array_join(F.transform(tokens, lambda t: _code_point(F.array_position(alphabet, t))), "")

    # each array, and the alphabet of both, is made once for a pair and not once for a token
    return once(a, lambda x: once(b, lambda y: once(
        F.array_distinct(F.concat(x, y)), lambda known: F.levenshtein(encode(x, known), encode(y, known)))))


def word_distance(a: Column, b: Column) -> Column:
    return token_distance(words(a), words(b))
