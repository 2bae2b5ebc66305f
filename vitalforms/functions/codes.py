"""Code-to-code lookups kept as literal maps (each has a handful of rows)."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vitalforms.catalog import forms, labels
from vitalforms.session import small_table


def lookup(mapping: dict, key: Column, default: object = None) -> Column:
    """Value of a literal map, ``default`` when the key is unknown."""
    table = F.create_map(*[F.lit(x) for x in chain.from_iterable(mapping.items())])
    found = table[key]
    return found if default is None else F.coalesce(found, F.lit(default))


def kind_of_code(type_code: Column) -> Column:
    return lookup(forms.column_map("type_code", "kind"), F.upper(F.trim(type_code)), "birth")


def hint_of_kind(kind: Column) -> Column:
    return lookup(forms.column_map("kind", "hint"), kind, "1A")


def type_id_of_hint(hint: Column) -> Column:
    return lookup(forms.column_map("hint", "type_id"), hint, 1)


def pipeline_type_of_hint(hint: Column) -> Column:
    return lookup(forms.column_map("hint", "pipeline_type"), hint, "birth")


def pipeline_type_of_class(code: Column) -> Column:
    known = {c: forms.column_map("class_code", "pipeline_type")[c] for c in forms.TEXT_CLASSES}
    return lookup(known, code, "birth")


def hint_of_folder(folder: Column, fallback: Column) -> Column:
    return F.coalesce(lookup(forms.column_map("folder", "hint"), F.lower(folder)), fallback)


def screen_title(kind: Column) -> Column:
    """Title shown for a kind; an unknown kind is shown as it is."""
    return F.coalesce(lookup(forms.column_map("kind", "type_name"), kind), kind)


def document_title(folder: Column) -> Column:
    return lookup(forms.column_map("folder", "title"), folder)


def hint_of_label(label: Column) -> Column:
    """Form hint told by a label's prefix."""
    expr = F
    for prefix, hint in forms.LABEL_PREFIX_HINTS:
        expr = expr.when(F.startswith(label, F.lit(prefix)), hint)
    return expr.otherwise("1A")


def hint_of_labels(label_array: Column) -> Column:
    """Hint of the first label in an array that has a known prefix."""
    known = F.filter(label_array, lambda x: x.rlike(
        "^(" + "|".join(p for p, _ in forms.LABEL_PREFIX_HINTS) + ")"))
    return hint_of_label(F.coalesce(F.get(known, F.lit(0)), F.lit("")))


def is_page_label(label: Column) -> Column:
    return F.startswith(label, F.lit("FORM_"))


def page_label(name: Column) -> Column:
    return lookup(labels.PAGE_LABELS, F.lower(name), labels.PAGE_LABEL_DEFAULT)


def page_label_of_number(number: Column) -> Column:
    return lookup(labels.PAGE_LABEL_CODES, number.cast("int"), labels.PAGE_LABEL_DEFAULT)


def character_class(idx: Column) -> Column:
    """Character of a class index, NULL when out of range."""
    size = len(labels.CHARACTER_CLASSES)
    inside = idx.between(0, size - 1)
    return F.when(inside, F.substring(F.lit(labels.CHARACTER_CLASSES), idx.cast("int") + 1, F.lit(1)))


def band(value: Column, bands: tuple) -> Column:
    """Name of the first band whose threshold the value reaches."""
    expr = F
    for threshold, name in bands[:-1]:
        expr = expr.when(value >= threshold, name)
    return expr.otherwise(bands[-1][1])


def form_type_table(spark: SparkSession) -> DataFrame:
    """The form type dimension (four rows)."""
    types = ["int"] + ["string"] * (len(forms.FORM_TYPE_COLUMNS) - 1)
    schema = ", ".join(f"{c} {t}" for c, t in zip(forms.FORM_TYPE_COLUMNS, types))
    return small_table(spark, forms.FORM_TYPES, schema)
