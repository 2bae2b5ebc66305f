"""Field boxes on pages, and words assigned to the box that holds them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COLUMNS, ROWS = 16, 32  # cells of the grid over a form's border box
ANY_CELL = -1           # stands for all regions, for pages too small for the grid


def _pixel_box() -> dict[str, Column]:
    """Box of a region on a page: whole pixels, inside the image."""
    width, height = F.col("right") - F.col("left"), F.col("bottom") - F.col("top")

    def pixel(origin: str, ratio: str, extent: Column, size: str) -> Column:
        raw = (F.col(origin) + F.col(ratio) * extent).cast("int")
        return F.greatest(F.lit(0), F.least(raw, F.col(size) - 1)).cast("int")

    return {"x1": pixel("left", "rx1", width, "w"), "y1": pixel("top", "ry1", height, "h"),
            "x2": pixel("left", "rx2", width, "w"), "y2": pixel("top", "ry2", height, "h")}


def field_boxes(pages: DataFrame, regions: DataFrame) -> DataFrame:
    """Pixel box of every field of every page.

    ``pages`` has (page_id, form_type, w, h, left, top, right, bottom).
    Coordinates are cut to whole pixels, kept inside the image, and boxes
    without area are dropped.
    """
    boxed = pages.join(regions, "form_type").select(
        "page_id", "form_type", "field", *[c.alias(name) for name, c in _pixel_box().items()])
    return boxed.filter((F.col("x2") > F.col("x1")) & (F.col("y2") > F.col("y1")))


def region_cells(regions: DataFrame) -> DataFrame:
    """(form_type, cell, field and ratios): the regions that a point of each grid cell can lie in.

    A region takes the cells it covers and one more on every side, which makes
    up for the cutting to whole pixels on pages of at least a pixel a cell.
    """
    def cells(low: str, high: str, n: int) -> Column:
        first = F.greatest(F.lit(0), F.least(F.floor(F.least(low, high) * n) - 1, F.lit(n - 1)))
        last = F.greatest(F.lit(0), F.least(F.floor(F.greatest(low, high) * n) + 1, F.lit(n - 1)))
        return F.sequence(first, last)

    grid = regions.withColumn("_r", F.explode(cells("ry1", "ry2", ROWS))).withColumn("_c", F.explode(cells("rx1", "rx2", COLUMNS)))
    near = grid.select(*regions.columns, (F.col("_r") * COLUMNS + F.col("_c")).cast("int").alias("cell"))
    return near.unionByName(regions.withColumn("cell", F.lit(ANY_CELL)))


def word_regions(word_boxes: DataFrame, pages: DataFrame, regions: DataFrame) -> DataFrame:
    """Words with the field whose box contains their centre.

    ``word_boxes`` has (page_id, word_no, text, x1, y1, x2, y2).  Words meet
    the measures of their page, look up the cell of the form's grid in which
    their centre lies, and are tested against the few regions of that cell; no
    box of a page is made or moved.  A word in two boxes is listed under each.
    """
    words = word_boxes.select("page_id", "word_no", "text", ((F.col("x1") + F.col("x2")) / 2).alias("cx"),
                              ((F.col("y1") + F.col("y2")) / 2).alias("cy"))
    placed = words.join(pages.select("page_id", "form_type", "w", "h", "left", "top", "right", "bottom"), "page_id")

    def step(at: str, low: str, high: str, n: int) -> Column:
        share = F.try_divide(F.col(at) - F.col(low), F.col(high) - F.col(low))
        return F.greatest(F.lit(0), F.least(F.floor(share * n), F.lit(n - 1)))

    fits = (F.col("right") - F.col("left") >= COLUMNS) & (F.col("bottom") - F.col("top") >= ROWS)
    cell = F.when(fits, step("cy", "top", "bottom", ROWS) * COLUMNS + step("cx", "left", "right", COLUMNS)).otherwise(ANY_CELL)
    met = placed.withColumn("cell", cell.cast("int")).join(region_cells(regions), ["form_type", "cell"])
    hit = met.select("page_id", "word_no", "text", "field", "cx", "cy", *[c.alias(name) for name, c in _pixel_box().items()])
    return hit.filter((F.col("x2") > F.col("x1")) & (F.col("y2") > F.col("y1")) & F.col("cx").between(F.col("x1"), F.col("x2"))
                      & F.col("cy").between(F.col("y1"), F.col("y2"))).select("page_id", "word_no", "text", "field")
