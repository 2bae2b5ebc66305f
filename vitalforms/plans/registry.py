"""Registry of named queries and the SQL each one is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from vitalforms.catalog.forms import FORM_TYPES
from vitalforms.plans import tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, casts: str = "") -> Callable[[Query], Query]:
    """Register a query; ``sql`` is left out where SQL cannot express it.

    ``casts`` ("column type, ...") brings columns the SQL engine widens, such
    as sums of integers, to the query's types.
    """
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            pairs = [c.rsplit(" ", 1) for c in casts.split(",")] if casts else []
            items = ", ".join(f'CAST("{c.strip()}" AS {k}) AS "{c.strip()}"' for c, k in pairs)
            ORACLES[name] = f"SELECT * REPLACE ({items}) FROM ({sql})" if items else sql
        return fn

    return add


def view(name: str, exprs: list[str], source: str) -> str:
    return f"{name} AS (SELECT {', '.join(exprs)} FROM {source})"


def values(name: str, columns: str, rows: list[tuple]) -> str:
    def lit(v: object) -> str:
        return "NULL" if v is None else str(v) if not isinstance(v, str) else "'" + v.replace("'", "''") + "'"

    body = ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows)
    return f"{name}({columns}) AS (VALUES {body})"


DOCS = view("docs", tables.DOCUMENTS, "orders")
USERS = view("users", tables.USERS, "customer")
DATA = view("data", tables.DOCUMENT_DATA, "lineitem")
FIELDS = values("fields", "field_id, field_name", [(i, n) for n, i in tables.FIELD_ID.items()])
TYPES = values("types", "type_id, type_code, type_name, hint, kind",
               [r[:5] for r in FORM_TYPES])
RAW = (f"raw AS (SELECT o_orderkey AS doc_id, "
       + ", ".join(f"{e} AS {k}" for k, e in tables.RAW_FIELDS.items())
       + f" FROM {tables.RAW_FROM})")
LATEST = ("latest AS (SELECT doc_id, field_name, extracted_value FROM (SELECT doc_id, field_name, "
          "extracted_value, row_number() OVER (PARTITION BY doc_id, field_name ORDER BY data_id DESC, "
          "extracted_value DESC) AS n FROM data JOIN fields USING (field_id)) WHERE n = 1)")


def with_ctes(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"
