"""List-valued columns: text forms, parsing and zipping."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def list_concat(items: Column | str) -> Column:
    """A list as space-joined text."""
    return F.array_join(F.transform(items, lambda x: x.cast("string")), " ")


def list_split(text: Column | str) -> Column:
    """Space-joined text back to whole numbers."""
    return F.transform(F.split(text, " "), lambda x: x.cast("bigint"))


def parse_list(text: Column | str) -> Column:
    """Bracketed list text such as "[1, 2]" to an array."""
    return F.from_json(text, "array<bigint>")
