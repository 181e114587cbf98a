"""Callers' tables have columns of any name; these keep an operator's own names apart from them.

A row is packed into one struct, beside which an operator's columns stand alone, and is unpacked at the end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROW = "_row"


def named(name: str) -> Column:
    """The column of exactly this name, whatever characters it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def packed(table: DataFrame, *own: Column) -> DataFrame:
    """The rows as one struct, and own columns made from them."""
    return table.select(F.struct(*[named(c) for c in table.columns]).alias(ROW), *own)


def unpacked(rows: DataFrame, columns: list[str], **changed: Column) -> DataFrame:
    """The packed rows' columns again, some of them replaced (those that are not there are left out)."""
    return rows.select(*[changed.get(c, F.col(ROW).getField(c)).alias(c) for c in columns])


def fresh(name: str, columns: list[str]) -> str:
    """The name, with underscores before it while a column has it, in whatever case."""
    there = {c.lower() for c in columns}
    while name.lower() in there:
        name = f"_{name}"
    return name
