"""Small compositions of SQL functions that the native operators share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

#: White space of the word rule: a space, tab, line feed, vertical tab, form feed, carriage return.
BLANKS = " \t\n\x0b\x0c\r"
BLANK_RUN = r"[\x20\x09-\x0D]+"


def unused(name: str, columns: list[str]) -> str:
    """A column name like ``name`` that no column has, whatever its case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)``, with ``value`` computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    """Runs of characters other than ``BLANKS``; none for null."""
    bare = F.trim(text, F.lit(BLANKS))
    return F.when(F.length(bare) > 0, F.split(bare, BLANK_RUN)).otherwise(F.expr("cast(array() as array<string>)"))


def _fold(sizes: Column) -> Column:
    """Sums before each place, one more than places, for short arrays."""
    return F.aggregate(sizes, F.expr("array(0L)"), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x.cast("long"))))


def sums_before(sizes: Column, block: int = 512) -> Column:
    """For each place of an array of integers the sum of those before it. Blocks keep the copying far below n squared."""

    def of(arr: Column) -> Column:
        starts = F.sequence(F.lit(0), ((F.size(arr) - 1) / block).cast("int"))
        parts = F.transform(starts, lambda k: _fold(F.slice(arr, k * block + 1, F.lit(block))))

        def joined(p: Column) -> Column:
            base = _fold(F.transform(p, lambda q: F.element_at(q, -1)))
            return let(base, lambda b: F.flatten(F.transform(p, lambda q, k: F.transform(F.slice(q, F.lit(1), F.size(q) - 1), lambda x: x + F.get(b, k)))))

        return let(parts, joined)

    return let(sizes, lambda arr: F.when(F.size(arr) > 0, of(arr)).otherwise(F.expr("cast(array() as array<bigint>)")))
