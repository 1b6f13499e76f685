"""Literal tables. They are folded into the plan, so a fixed table needs no join.

They are written as one SQL expression each: a table of many entries then costs one call into the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sql_literal(value: str | int | float | None) -> str:
    if value is None:
        return "CAST(NULL AS STRING)"
    if isinstance(value, str):
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return f"{value}D" if isinstance(value, float) else str(value)


def literal_array(values) -> Column:
    return F.expr(f"array({', '.join(map(sql_literal, values))})")


def literal_map(table: dict) -> Column:
    return F.expr(f"map({', '.join(sql_literal(part) for item in table.items() for part in item)})")


def lookup(key: Column, table: dict) -> Column:
    """The table's value for the key, or NULL."""
    return F.try_element_at(literal_map(table), key)


def contains_any(c: Column, tokens) -> Column:
    hit = F.lit(False)
    for i, token in enumerate(tokens):
        hit = c.contains(token) if i == 0 else hit | c.contains(token)
    return hit
