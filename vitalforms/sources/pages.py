"""Form-understanding pages: nested JSON pages and parallel-array pages."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vitalforms.operators.spans import examples, page_blocks, word_blocks

PAGE = ("form array<struct<box: array<int>, text: string, label: string, "
        "words: array<struct<box: array<int>, text: string>>, linking: array<array<int>>, id: int>>")
WORD_PAGE = "words array<string>, labels array<int>, bboxes array<array<double>>"


def read_pages(spark: SparkSession, root: str, split: str) -> DataFrame:
    """(page_id, form) of the JSON pages in any ``annotations`` folder of a split.

    The folder may lie at any depth below ``root``.  Files of one name and the
    same content are one page, so a corpus unpacked twice counts once.  The
    page_id is the file name or, where different pages have that name, the
    path below ``root``, both without ``.json``.
    """
    files = (spark.read.schema(PAGE).option("multiLine", "true").option("recursiveFileLookup", "true")
             .option("pathGlobFilter", "*.json").json(root)
             .select(F.col("_metadata.file_path").alias("path"), "form"))
    return _named(_of_split(files, split), root)


def _of_split(files: DataFrame, split: str) -> DataFrame:
    return files.filter(F.contains("path", F.lit(split)) & F.regexp_like("path", F.lit(r"/annotations/[^/]+$")))


def _named(own: DataFrame, root: str) -> DataFrame:
    """(page_id, form) of files (path, form): equal ones of a name once, different ones by their path."""
    page = F.regexp_extract("path", r"([^/]+)\.json$", 1)
    once = own.groupBy(page.alias("_name"), "form").agg(F.min("path").alias("path"))
    below = F.element_at(F.split("path", "/" + re.escape(root.strip("/")) + "/", 2), -1)
    alone = F.count(F.lit(1)).over(Window.partitionBy("_name")) == 1
    page_id = F.when(alone, F.col("_name")).otherwise(F.regexp_replace(below, r"\.json$", ""))
    return once.select(page_id.alias("page_id"), "form")


def checked(records: DataFrame, value: str = "value") -> DataFrame:
    """``records`` with form and reason: pages out of JSON texts, or why a text is none.

    Reasons, the first that holds: ``blank``, ``not json``, ``no form``, ``form
    is no list``, ``wrong type`` (a member of a block has not the type of the
    schema).  A page has no reason; a broken one has no form.  Texts are read
    each by itself, so broken ones do not change others.
    """
    text = F.col(value)
    parsed = F.from_json(text, PAGE + ", _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    form = F.get_json_object(text, "$.form")
    # the parser stops after the first value; as the only item of a list it must be followed by nothing
    alone = F.coalesce(F.json_array_length(F.concat(F.lit("["), text, F.lit("]"))) == 1, F.lit(False))
    reason = (F.when(F.coalesce(F.btrim(text, F.lit(" \t\r\n")), F.lit("")) == "", "blank")
              .when(F.try_parse_json(text).isNull() | ~alone, "not json").when(form.isNull(), "no form")
              .when(~form.startswith("["), "form is no list").when(F.col("_page._corrupt").isNotNull(), "wrong type"))
    out = records.withColumn("_page", parsed).withColumn("reason", reason)
    return out.withColumn("form", F.when(F.col("reason").isNull(), F.col("_page.form"))).drop("_page")


def read_pages_checked(spark: SparkSession, root: str, split: str) -> tuple[DataFrame, DataFrame]:
    """The pages (page_id, form) of ``read_pages``, and the rejects (path, reason, value) of the same folders.

    Files are read as texts, so one that is no JSON stops nothing.
    """
    files = (spark.read.option("wholetext", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json")
             .text(root).select(F.col("_metadata.file_path").alias("path"), "value"))
    rows = checked(_of_split(files, split))
    return _named(rows.where("reason IS NULL").select("path", "form"), root), rows.where("reason IS NOT NULL").select(
        "path", "reason", "value")


def page_examples(pages: DataFrame) -> DataFrame:
    """(page_id, text, spans) of nested pages."""
    return examples(pages, "page_id", page_blocks(F.coalesce("form", F.array())))


def read_word_pages(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, words, labels, bboxes) of a parallel-array page list."""
    raw = spark.read.schema(WORD_PAGE).option("multiLine", "true").json(path)
    return raw.withColumn("page_id", F.md5(F.to_json(F.struct("words", "labels", "bboxes"))))


def word_page_examples(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """(page_id, text, spans) of parallel-array pages, one span per word."""
    return examples(pages, key, word_blocks(F.col("words"), F.col("labels")))


def word_boxes(pages: DataFrame) -> DataFrame:
    """(page_id, word_no, text, x1, y1, x2, y2) of the words of nested pages."""
    words = F.flatten(F.transform("form", lambda i: i["words"]))
    long = pages.select("page_id", F.posexplode(words).alias("word_no", "w"))
    box = F.col("w.box")
    return long.select("page_id", "word_no", F.col("w.text").alias("text"),
                       *[F.get(box, F.lit(i)).alias(n) for i, n in enumerate(("x1", "y1", "x2", "y2"))])
