"""Completeness checks of extracted data."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vitalforms.catalog.forms import REQUIRED_FIELDS


def required_errors(data: Column, folder: Column) -> Column:
    """Messages for the required fields a record lacks (none for other folders)."""
    none = F.array().cast("array<string>")
    names = F
    for form, fields in REQUIRED_FIELDS.items():
        names = names.when(folder == form, F.array(*[F.lit(f) for f in fields]))
    wanted = names.otherwise(none)
    missing = F.filter(wanted, lambda f: F.coalesce(data[f], F.lit("")) == "")
    return F.transform(missing, lambda f: F.concat(F.lit("Missing required field: "), f))


def is_valid(data: Column, folder: Column) -> Column:
    return F.size(required_errors(data, folder)) == 0
