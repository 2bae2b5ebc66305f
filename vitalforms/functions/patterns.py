"""Fallback patterns for dates, sex, civil status, citizenship, religion, age."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vitalforms.functions.text import capitalize, filled

# The vocabularies and patterns of the fallback search.
MONTHS = (
    "January", "February", "March", "April", "May", "June", "July", "August",
    "September", "October", "November", "December",
)
CITIZENSHIPS = (
    "Filipino", "American", "Chinese", "Japanese", "Korean", "Spanish", "British",
    "Australian", "Canadian", "Indian", "Stateless",
)


def _any(options: tuple[str, ...]) -> str:
    return "|".join(options)


DATE = (rf"(?i)\b(?:{_any(MONTHS)})\s+\d{{1,2}},?\s+\d{{4}}\b"
        r"|\b\d{1,2}[/\-]\d{1,2}[/\-]\d{2,4}\b")
SEX = r"(?i)\b(Male|Female)\b"
CIVIL_STATUS = r"(?i)\b(Single|Married|Widowed|Divorced|Annulled|Separated)\b"
CITIZENSHIP = rf"(?i)\b({_any(CITIZENSHIPS)})\b"
RELIGION = (r"(?i)\b(Roman\s*Catholic|Catholic|Islam|Muslim"
            r"|Protestant|Iglesia\s*ni\s*Cristo|Baptist|Born\s*Again|Christian|Seventh\s*Day\s*Adventist|Aglipayan)\b")
REGISTRY_NUMBER = r"\b(?:[A-Z]{0,5}[-]?)?\d{4}[-]\d{3,6}\b"
AGE = r"\b(\d{1,3})\s*(?:years?\s*old)?\b"
STRICT_AGE = r"(?i)\bage\W{0,3}(\d{1,3})\b|\b(\d{1,3})\s*years?\s*old\b"


def find(text: Column, pattern: str, group: int = 0) -> Column:
    """First match of a pattern, NULL when there is none."""
    return filled(F.regexp_extract(text, pattern, group))


def find_date(text: Column) -> Column:
    return find(text, DATE)


def find_sex(text: Column) -> Column:
    return capitalize(find(text, SEX))


def find_civil_status(text: Column) -> Column:
    return capitalize(find(text, CIVIL_STATUS))


def find_citizenship(text: Column) -> Column:
    return capitalize(find(text, CITIZENSHIP))


def find_religion(text: Column) -> Column:
    return find(text, RELIGION)


def find_age(text: Column, strict: bool = False) -> Column:
    """First 1-3 digit number; with ``strict`` only one announced as an age."""
    if strict:
        return F.coalesce(find(text, STRICT_AGE, 1), find(text, STRICT_AGE, 2))
    return find(text, AGE, 1)


def find_registry_number(text: Column) -> Column:
    return find(text, REGISTRY_NUMBER)


def is_registry_number(value: Column) -> Column:
    return F.coalesce(value.rlike(rf"^(?:{REGISTRY_NUMBER})$"), F.lit(False))


FINDERS = {
    "date": find_date,
    "sex": find_sex,
    "age": find_age,
    "citizenship": find_citizenship,
    "civil_status": find_civil_status,
    "religion": find_religion,
}
