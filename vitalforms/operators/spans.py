"""Span corpora: offsets, cleaning, token alignment and audits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitalforms.functions import codes
from vitalforms.functions import spans as sp
from vitalforms.functions.text import join_words, strip
from vitalforms.operators.scan import SEGMENT_ROWS, running
from vitalforms.session import work_dir


def block_offsets(blocks: DataFrame, key: str, order: str, text: str,
                  segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """Start and end of each block when blocks are joined with one blank."""
    out = running(blocks, [key], order, {"_before": ("sum", F.length(text) + 1)}, inclusive=False,
                  segment_rows=segment_rows)
    start = F.coalesce("_before", F.lit(0))
    return (out.withColumn("start", start.cast("long"))
            .withColumn("end", (start + F.length(text)).cast("long")).drop("_before"))


def joined_example(blocks: Column) -> Column:
    """struct(text, spans) of an array of (text, label) blocks of one page."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast(sp.SPANS).alias("spans"))

    def step(acc: Column, b: Column) -> Column:
        end = acc["at"] + F.length(b["text"])
        return F.struct((end + 1).alias("at"),
                        F.array_append(acc["spans"], sp.span(acc["at"], end, b["label"])).alias("spans"))

    spans = F.aggregate(blocks, start, step, lambda acc: acc["spans"])
    return F.struct(F.array_join(F.transform(blocks, lambda b: b["text"]), " ").alias("text"),
                    spans.alias("spans"))


def page_blocks(form: Column) -> Column:
    """(text, label) blocks of a page's form items; blocks without text go."""
    none = F.array().cast("array<string>")
    blocks = F.transform(form, lambda i: F.struct(
        join_words(F.coalesce(F.transform(i["words"], lambda w: F.coalesce(w["text"], F.lit(""))), none)).alias("text"),
        codes.page_label(F.coalesce(i["label"], F.lit("other"))).alias("label")))
    return F.filter(blocks, lambda b: b["text"] != "")


def word_blocks(words: Column, labels: Column) -> Column:
    """(text, label) blocks of parallel word and label-number arrays."""
    pairs = F.arrays_zip(words.alias("w"), labels.alias("l"))
    blocks = F.transform(pairs, lambda p: F.struct(
        strip(F.coalesce(p["w"], F.lit(""))).alias("text"), codes.page_label_of_number(p["l"]).alias("label")))
    return F.filter(blocks, lambda b: b["text"] != "")


def examples(pages: DataFrame, key: str, blocks: Column) -> DataFrame:
    """(key, text, spans) of pages that have any text."""
    built = pages.select(key, blocks.alias("_b")).filter(F.size("_b") > 0)
    return built.select(key, joined_example(F.col("_b")).alias("_e")).select(key, "_e.text", "_e.spans")


def snap(text: Column, s: Column, mode: str = "expand") -> Column:
    """Move a span to token edges; tokens are word runs or single symbols.

    ``expand`` takes in a token the span cuts, ``contract`` leaves it out.
    """
    start, end = s["start"], s["end"]
    head = F.length(F.regexp_extract(F.substring(text, 1, start), r"(\w*)$", 1))
    tail = F.length(F.regexp_extract(F.substring(text, end + 1, F.length(text)), r"^(\w*)", 1))
    body = sp.covered(text, s)
    cut_head = F.regexp_like(body, F.lit(r"^\w")) & (head > 0)
    cut_tail = F.regexp_like(body, F.lit(r"\w$")) & (tail > 0)
    if mode == "expand":
        return sp.span(start - F.when(cut_head, head).otherwise(0),
                       end + F.when(cut_tail, tail).otherwise(0), s["label"])
    lead = F.length(F.regexp_extract(body, r"^(\w*)", 1))
    trail = F.length(F.regexp_extract(body, r"(\w*)$", 1))
    new_start = start + F.when(cut_head, lead).otherwise(0)
    return sp.span(new_start, F.greatest(new_start, end - F.when(cut_tail, trail).otherwise(0)), s["label"])


def align_spans(text: Column, spans: Column) -> Column:
    """Spans on token edges: expanded, or contracted where that takes in blanks."""
    def fit(s: Column) -> Column:
        wide = snap(text, s)
        body = sp.covered(text, wide)
        return F.when(strip(body) == body, wide).otherwise(snap(text, s, "contract"))

    fitted = F.transform(spans, fit)

    def usable(s: Column) -> Column:
        body = sp.covered(text, s)
        return (strip(body) != "") & (strip(body) == body)

    return F.filter(fitted, usable)


def span_corpus(df: DataFrame, text: str = "text", spans: str = "spans",
                max_length: int | None = None) -> DataFrame:
    """Cleaned, aligned, non-overlapping spans and the number dropped on the way.

    Overlap removal is not counted as skipped.
    """
    t = F.col(text)
    step = df.withColumn("_clean", sp.clean_spans(t, F.col(spans), max_length))
    step = step.withColumn("_fit", align_spans(t, F.col("_clean")))
    return (step.withColumn("skipped", F.size(spans) - F.size("_fit"))
            .withColumn(spans, sp.drop_overlaps(F.col("_fit"))).drop("_clean", "_fit"))


def _cells(start: Column, end: Column) -> Column:
    """The aligned cells (level, at) of 2^level offsets that make up a span."""
    def of_level(k: Column) -> Column:
        low, high = F.call_function("shiftright", start + F.call_function("shiftleft", F.lit(1).cast("long"), k) - 1, k), F.call_function("shiftright", end, k)
        odd = lambda at: (low < high) & (at % 2 == 1)
        found = F.array(F.when(odd(low), low), F.when(odd(high), high - 1))
        return F.transform(F.filter(found, lambda at: at.isNotNull()), lambda at: F.struct(k.alias("level"), at.alias("at")))

    levels = F.sequence(F.lit(0), F.floor(F.log2(end - start)).cast("int") + 1)
    return F.inline(F.flatten(F.transform(levels, of_level)))


def choose_spans(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, start, end, label): longest spans first, then the earlier, then by label; overlapping ones go.

    ``rows`` has one span a row; no document is gathered anywhere.  In each
    round the spans that no better one overlaps are kept and those they
    overlap go.  A better span is at least as long, so it covers the first or
    the last offset of the worse one: each span is entered under the few
    aligned cells it is made of, and both end offsets look up the cells they
    lie in.  The rounds are as many as the longest chain of overlapping spans
    in which each next one is worse and undecided: at most the root of twice
    the text's length, in prose two or three.  The cells are joined by sorting:
    a round's file says little about their number, and a broadcast of them
    would pass through the driver.

    Equal spans count once; empty or reversed ones, and those without an
    offset, go.  Null keys form a group like any other, a null label is the
    first in order, other columns are ignored, an empty table gives no rows.
    """
    spark, root = rows.sparkSession, work_dir(rows.sparkSession, "span-choice")
    kinds = {c: rows.schema[c].dataType for c in ("start", "end")}
    span = F.struct(F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "label").alias("span")
    left = rows.where(F.col("end") > F.col("start")).select(F.struct(*keys).alias("group"), span).distinct()
    start, end = F.col("span.start"), F.col("span.end")
    rank = F.struct((start - end).alias("length"), start.alias("start"), F.col("span.label").alias("label"))
    ends = F.explode(F.array_distinct(F.array(start, end - 1)))

    def looked_up(spans: DataFrame, top: int) -> DataFrame:
        points = spans.select("group", "span", ends.alias("point"))
        level = F.explode(F.sequence(F.lit(0), F.lit(top)))
        return points.withColumn("level", level).select(
            "group", "span", "level", F.call_function("shiftright", "point", F.col("level")).alias("at"))

    paths: list[str] = []
    while True:
        n = len(paths)
        left.write.parquet(f"{root}/open-{n}")
        left = spark.read.schema(left.schema).parquet(f"{root}/open-{n}")
        longest = left.agg(F.max(end - start)).first()[0]
        if longest is None:
            break
        top = longest.bit_length() - 1
        best = left.select("group", rank.alias("rank"), _cells(start, end)).groupBy("group", "level", "at").agg(
            F.min("rank").alias("best"))
        judged = looked_up(left, top).join(best.hint("merge"), ["group", "level", "at"]).groupBy("group", "span").agg(
            F.min("best").alias("best")).select("group", "span", F.col("best").eqNullSafe(rank).alias("kept"))
        judged.write.parquet(f"{root}/judged-{n}")
        paths.append(f"{root}/judged-{n}")
        judged = spark.read.schema(judged.schema).parquet(paths[-1])
        taken = judged.where("kept").select("group", _cells(start, end)).withColumn("hit", F.lit(1))
        lost = looked_up(judged.where("NOT kept"), top)
        left = lost.join(taken.hint("merge"), ["group", "level", "at"], "left").groupBy("group", "span").agg(
            F.count("hit").alias("hits")).where("hits = 0").select("group", "span")
    if not paths:
        return rows.select(*keys, "start", "end", "label").where(F.lit(False))
    chosen = spark.read.schema(judged.schema).parquet(*paths).where("kept")
    return chosen.select(*[F.col(f"group.{k}").alias(k) for k in keys],
                         *[F.col(f"span.{c}").cast(t).alias(c) for c, t in kinds.items()], F.col("span.label").alias("label"))


def span_rows(df: DataFrame, keys: Sequence[str], text: str = "text", spans: str = "spans") -> DataFrame:
    """One row per span with its text."""
    long = df.select(*keys, text, F.explode_outer(spans).alias("_s")).filter("_s IS NOT NULL")
    return long.select(*keys, F.col("_s.start").alias("start"), F.col("_s.end").alias("end"),
                       F.col("_s.label").alias("label"), sp.covered(F.col(text), F.col("_s")).alias("span_text"))


def audit_spans(rows: DataFrame, source: str) -> tuple[DataFrame, DataFrame]:
    """Faulty spans by (source, reason), and the first ten of each source.

    ``rows`` comes from ``span_rows``; listing keeps ten rows per source and
    task before the shuffle.
    """
    bad = rows.withColumn("reason", sp.audit_reason(F.col("span_text"))).filter("reason is not null")
    counts = bad.groupBy(source, "reason").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(source).orderBy("doc_id", "start", "end", "label")
    first = bad.withColumn("rank", F.row_number().over(w)).filter("rank <= 10")
    return counts, first
