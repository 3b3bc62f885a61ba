"""Labels of the model and their orders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Strongest last; an edge type's place is its order.
CONFIDENCE = ("uncertain", "inferred", "static", "observed")
EDGE_TYPES = ("http", "event", "grpc", "database", "import")
RELATIONS = {"http": "calls", "grpc": "calls", "import": "imports", "database": "shares-database", "event": "consumes"}


def _number(label: Column, names: tuple[str, ...]) -> Column:
    return F.coalesce(*[F.when(label == n, F.lit(i)) for i, n in enumerate(names)])


def _name(number: Column, names: tuple[str, ...]) -> Column:
    return F.coalesce(*[F.when(number == i, F.lit(n)) for i, n in enumerate(names)])


def confidence_rank(label: Column) -> Column:
    return _number(label, CONFIDENCE)


def confidence_label(rank: Column) -> Column:
    return _name(rank, CONFIDENCE)


def type_order(label: Column) -> Column:
    return _number(label, EDGE_TYPES)


def type_label(order: Column) -> Column:
    return _name(order, EDGE_TYPES)


def weaker(a: Column, b: Column) -> Column:
    return F.least(a, b)
