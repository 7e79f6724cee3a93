"""Names of identifiers: their words, other spellings, quoting."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def words_of(name: Column, separators: str = "[ _#]") -> Column:
    """The different words of a name in lower case, sorted."""
    return F.array_sort(F.array_distinct(F.split(F.lower(name), separators)))


def snake_case(name: Column) -> Column:
    """``camelCase`` as ``camel_case``."""
    return F.lower(F.regexp_replace(name, "([a-z])([A-Z])", "$1_$2"))


def quoted(name: Column, separator: str = " ") -> Column:
    """The parts of a name, each in single quotes, as a list."""
    return F.array_join(F.transform(F.split(name, separator), lambda x: F.concat(F.lit("'"), x, F.lit("'"))), ", ")


def line_distance(a: Column, b: Column, lines: Column | None = None) -> Column:
    """Edit distance of two lists, item by item (tokens or lines), by one row of the table at a time."""
    first = F.sequence(F.lit(0), F.size(b))

    def row(before: Column, x: Column) -> Column:
        start = F.array(F.element_at(before, 1) + 1)
        return F.aggregate(
            F.when(F.size(b) > 0, F.sequence(F.lit(1), F.size(b))).otherwise(F.array().cast("array<int>")),
            start,
            lambda now, j: F.array_append(now, F.least(F.element_at(now, -1) + 1, F.element_at(before, j + 1) + 1, F.element_at(before, j) + F.when(F.element_at(b, j) == x, 0).otherwise(1))),
        )

    return F.element_at(F.aggregate(a, first, row), -1)
