"""Span arrays: array<struct<start:int,end:int,label:string>> over one text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vitalforms.functions.text import WHITESPACE, once, strip

SPAN = "struct<start:int,end:int,label:string>"
SPANS = f"array<{SPAN}>"

# Punctuation that is dropped when it stands alone in a span.
LONE_PUNCTUATION = ".:,;!?()[]{}%$#@&*+-=/<>|\\'\""


def span(start: Column, end: Column, label: Column) -> Column:
    return F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"), label.alias("label"))


def covered(text: Column, s: Column) -> Column:
    """Text under a span (offsets are 0-based, end exclusive)."""
    return F.substring(text, s["start"] + 1, s["end"] - s["start"])


def overlaps(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def trim_span(text: Column, s: Column) -> Column:
    """Move both ends inwards past white space."""
    raw = covered(text, s)
    lead = F.length(raw) - F.length(F.ltrim(raw, F.lit(WHITESPACE)))
    return span(s["start"] + lead, s["start"] + lead + F.length(strip(raw)), s["label"])


def span_problem(text: Column, s: Column, max_length: int | None = None) -> Column:
    """Why a span must be dropped, NULL when it is usable."""
    size = s["end"] - s["start"]
    body = strip(covered(text, s))
    return (
        F.when(size <= 0, "empty")
        .when(F.lit(False) if max_length is None else size > max_length, "too long")
        .when(body == "", "blank")
        .when((F.length(body) == 1) & F.contains(F.lit(LONE_PUNCTUATION), body), "punctuation")
    )


def clean_spans(text: Column, spans: Column, max_length: int | None = None) -> Column:
    """Usable spans, trimmed."""
    kept = F.filter(spans, lambda s: span_problem(text, s, max_length).isNull())
    return F.transform(kept, lambda s: trim_span(text, s))


def audit_reason(body: Column) -> Column:
    """Fault of a span's text as the corpus audit names it, NULL when clean."""
    return (
        F.when(strip(body) == "", "EMPTY")
        .when(strip(body) != body, "WHITESPACE")
        .when((F.length(body) == 1) & ~body.rlike(r"^[\p{L}\p{N}]$"), "SINGLE PUNCTUATION CHAR")
    )


def _longest_first(group: Column) -> Column:
    """Greedy choice inside one run of connected spans."""
    ranked = F.array_sort(F.transform(group, lambda s: F.struct(
        (s["start"] - s["end"]).alias("rank"), s["start"].alias("start"),
        s["end"].alias("end"), s["label"].alias("label"))))
    return F.aggregate(
        ranked, F.array().cast(SPANS),
        lambda acc, s: F.when(
            F.exists(acc, lambda k: overlaps(k, s)), acc,
        ).otherwise(F.array_append(acc, span(s["start"], s["end"], s["label"]))),
    )


def drop_overlaps(spans: Column) -> Column:
    """Longest span first, then the earlier one; spans overlapping a kept one go.

    Spans are walked in start order and cut into runs that share no text, so
    the pairwise test stays inside a run.  The result is in start order.
    """
    ordered = F.array_sort(F.filter(spans, lambda s: s["end"] > s["start"]))
    start = F.struct(F.array().cast(SPANS).alias("kept"), F.array().cast(SPANS).alias("run"),
                     F.lit(-1).alias("reach"))

    def step(acc: Column, s: Column) -> Column:
        own = span(s["start"], s["end"], s["label"])
        apart = F.struct(F.concat(acc["kept"], _longest_first(acc["run"])).alias("kept"),
                         F.array(own).alias("run"), s["end"].alias("reach"))
        joined = F.struct(acc["kept"].alias("kept"), F.array_append(acc["run"], own).alias("run"),
                          F.greatest(acc["reach"], s["end"]).alias("reach"))
        return F.when(s["start"] >= acc["reach"], apart).otherwise(joined)

    return F.aggregate(ordered, start, step,
                       lambda acc: F.array_sort(F.concat(acc["kept"], _longest_first(acc["run"]))))


def _find(text: Column, phrase: Column, start: Column) -> Column:
    """0-based offset of a phrase at or after ``start``, NULL when absent."""
    pos = F.call_function("locate", phrase, text, start + 1)
    return F.when(pos > 0, pos - 1)


def locate_phrases(text: Column, pairs: Column) -> Column:
    """Spans of (phrase, label) pairs, in pair order.

    A repeated phrase is looked for after its previous hit, then from the
    beginning.  A hit that overlaps an accepted span moves to the phrase's
    next occurrence after it, and the pair is dropped when there is none.
    """
    hit = "struct<start:int,end:int,label:string,phrase:string>"
    empty = F.array().cast(f"array<{hit}>")

    def placed(acc: Column, pair: Column, phrase: Column, size: Column, first: Column) -> Column:
        clash = F.exists(acc, lambda h: (h["start"] < first + size) & (first < h["end"]))

        def added(start: Column) -> Column:
            found = F.struct(start.cast("int").alias("start"), (start + size).cast("int").alias("end"),
                             pair["label"].alias("label"), phrase.alias("phrase"))
            return F.when(start.isNotNull() & (size > 0), F.array_append(acc, found)).otherwise(acc)

        return once(F.when(clash, _find(text, phrase, first + size)).otherwise(first), added)

    def step(acc: Column, pair: Column) -> Column:
        def located(phrase: Column) -> Column:
            earlier = F.filter(acc, lambda h: h["phrase"] == phrase)
            resume = F.coalesce(F.try_element_at(earlier, F.lit(-1))["end"], F.lit(0))
            first = once(resume, lambda at: F.coalesce(_find(text, phrase, at), _find(text, phrase, F.lit(0))))
            return once(first, lambda at: placed(acc, pair, phrase, F.length(phrase), at))

        return once(strip(pair["phrase"]), located)

    hits = F.aggregate(pairs, empty, step)
    return F.transform(hits, lambda h: span(h["start"], h["end"], h["label"]))
