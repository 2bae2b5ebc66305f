"""Annotation lists, image folders with sidecar labels, and word lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vitalforms.catalog.forms import IMAGE_EXTENSIONS, UPLOAD_EXTENSIONS
from vitalforms.functions.text import extension, stem_label, strip

ANNOTATION = "image_path string, text string"
LEGACY_ANNOTATION = "image string, image_path string, label string, text string"


def read_annotations(spark: SparkSession, path: str, lines: bool = False, legacy: bool = False) -> DataFrame:
    """``[{image_path, text}]`` lists; ``lines`` reads one object per line,
    which Spark can split within a file."""
    reader = spark.read.schema(LEGACY_ANNOTATION if legacy else ANNOTATION)
    return reader.option("multiLine", str(not lines).lower()).json(path)


def usable_annotations(annotations: DataFrame, files: DataFrame,
                       form: str = "all") -> tuple[DataFrame, DataFrame]:
    """Annotations with text whose image exists, and the number missing.

    ``files`` has the column image_path.  Blank texts of existing images are
    dropped without being counted as missing.
    """
    own = annotations if form == "all" else annotations.filter(F.contains("image_path", F.lit(form)))
    names = files.select("image_path").distinct()
    kept = (own.join(names, "image_path", "left_semi")
            .select("image_path", strip(F.col("text")).alias("text")).filter("text != ''"))
    missing = own.join(names, "image_path", "left_anti").agg(F.count(F.lit(1)).alias("missing"))
    return kept, missing


def list_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, length) of all files below a folder; contents are not read."""
    return (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
            .select("path", "length"))


def read_sidecars(spark: SparkSession, folder: str) -> DataFrame:
    """(path, label) of the .txt files below a folder."""
    texts = (spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt")
             .option("wholetext", "true").text(folder))
    return texts.select(F.col("_metadata.file_path").alias("path"), strip(F.col("value")).alias("label"))


def _without_extension(path: Column) -> Column:
    return F.regexp_replace(path, r"\.[^./\\]*$", "")


def _plain_path(path: Column) -> Column:
    """A file path without its scheme, so that listings of two readers agree."""
    return F.regexp_replace(path, r"^file:/+", "/")


def folder_annotations(images: DataFrame, sidecars: DataFrame, root: str,
                       extensions: tuple[str, ...] = IMAGE_EXTENSIONS) -> DataFrame:
    """Annotation of each image: the sidecar's text, else the file stem.

    ``images`` has (path), ``sidecars`` (path, label).  An empty sidecar drops
    its image, as a blank label does.
    """
    side = sidecars.select(_without_extension(_plain_path(F.col("path"))).alias("_base"), "label")
    own = images.select(_plain_path(F.col("path")).alias("path")).filter(
        extension(F.col("path")).isin(*extensions))
    joined = own.withColumn("_base", _without_extension(F.col("path"))).join(side, "_base", "left")
    base = root.rstrip("/") + "/"
    rel = F.when(F.startswith("path", F.lit(base)), F.substring(F.col("path"), F.lit(len(base) + 1), F.length("path"))).otherwise(
        F.col("path"))
    return joined.select(
        F.replace(rel, F.lit("\\"), F.lit("/")).alias("image_path"),
        F.coalesce("label", stem_label(F.col("path"))).alias("text")).filter(F.col("text") != "")


def upload_gate(files: DataFrame, path: str = "path") -> DataFrame:
    """Accepted uploads with the route (pdf or image) each one takes."""
    ext = extension(F.col(path))
    return (files.filter(ext.isin(*UPLOAD_EXTENSIONS)).withColumn("extension", ext)
            .withColumn("route", F.when(ext == "pdf", "pdf").otherwise("image")))


def read_word_list(lines: DataFrame, value: str = "value", max_length: int | None = None) -> DataFrame:
    """(image_path, text) of a handwriting word list.

    Comments, blank lines, short rows, rows not segmented ``ok`` and words
    over ``max_length`` characters (if given) are left out.
    """
    row = strip(F.col(value))
    parts = F.split(row, " ")
    rows = lines.filter((row != "") & ~F.startswith(row, F.lit("#"))).select(parts.alias("p")).filter(
        F.size("p") >= 9)
    word, seg, text = F.get("p", F.lit(0)), F.get("p", F.lit(1)), F.element_at("p", -1)
    good = rows.filter((seg == "ok") & (F.length(text) >= 1) & (F.lit(True) if max_length is None else F.length(text) <= max_length))
    ids = F.split(word, "-")
    path = F.concat_ws("/", F.get(ids, F.lit(0)), F.concat_ws("-", F.get(ids, F.lit(0)), F.get(ids, F.lit(1))),
                       F.concat(word, F.lit(".png")))
    return good.select(path.alias("image_path"), text.alias("text"))


def read_word_file(spark: SparkSession, path: str, max_length: int | None = None) -> DataFrame:
    return read_word_list(spark.read.text(path), max_length=max_length)


def read_name_pools(spark: SparkSession, path: str) -> DataFrame:
    """(pool, name) rows of a name file; middle names default to last names."""
    schema = ("first_names struct<all: array<string>>, last_names array<string>, "
              "middle_names array<string>")
    raw = spark.read.schema(schema).option("multiLine", "true").json(path)
    return name_pools(raw)


def read_name_lines(spark: SparkSession, path: str) -> DataFrame:
    """(pool, name) rows of name files of any size, one object a line; without a middle pool the last names are one."""
    names = spark.read.schema("pool string, name string").json(path)
    middle = names.filter("pool = 'middle'").agg(F.count(F.lit(1))).scalar()
    again = names.filter("pool = 'last'").filter(middle == 0).select(F.lit("middle").alias("pool"), "name")
    return names.unionByName(again)


def name_pools(raw: DataFrame) -> DataFrame:
    pools = F.array(
        F.struct(F.lit("first").alias("pool"), F.col("first_names.all").alias("names")),
        F.struct(F.lit("last").alias("pool"), F.col("last_names").alias("names")),
        F.struct(F.lit("middle").alias("pool"), F.coalesce("middle_names", "last_names").alias("names")))
    return raw.select(F.inline(pools)).select("pool", F.explode("names").alias("name"))
