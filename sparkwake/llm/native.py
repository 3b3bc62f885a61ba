"""Expressions shared by the operators that stay within Spark's own functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "struct<start:int,end:int,match:string>"


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with the value computed once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def running(values: Column, join: Callable[[Column, Column], Column]) -> Column:
    """Of an array of integers, for each place the values up to it joined (a sum, a maximum), by doubling strides: n log n steps
    and no array that grows."""
    strides = F.sequence(F.lit(0), F.ceil(F.log2(F.size(values) + F.lit(1))).cast("int"))
    step = lambda held, k: F.transform(held, lambda x, i: F.coalesce(join(x, F.get(held, i - F.pow(F.lit(2), k).cast("int"))), x))
    return F.aggregate(strides, values, step)


def matches(text: Column, pattern: str) -> Column:
    """array<struct<start,end,match>> of a pattern's leftmost matches that do not overlap, none of them empty; in code
    points, end exclusive. The gaps between the matches give the places."""

    def placed(found: Column) -> Column:
        sizes = F.zip_with(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found)), found, lambda gap, m: F.length(gap) + F.length(m))
        ends = let(sizes, lambda s: running(s, lambda a, b: a + b))
        return F.zip_with(ends, found, lambda end, m: F.struct((end - F.length(m)).alias("start"), end.alias("end"), m.alias("match")))

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda found: F.when(F.size(found) > 0, placed(found)).otherwise(F.array().cast(f"array<{SPAN}>")))


def kinds(spans: Column, kind: str, number: int) -> Column:
    """The spans with their kind, and its number for the order among spans that start together."""
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(number).alias("order"), s["end"].alias("end"), F.lit(kind).alias("kind")))


def listed(spans: Column) -> Column:
    """kind:start:end by start, then order of the kinds, comma-joined."""
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
