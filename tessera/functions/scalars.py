"""Column helpers that hide differences in types; all are built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def exact(column: Column | str, scale: int = 2) -> Column:
    """Money kept as double, as a decimal, so that sums do not depend on their order."""
    return (F.col(column) if isinstance(column, str) else column).cast(f"decimal(18,{scale})")


def exact_sum(column: Column | str, scale: int = 2) -> Column:
    return F.sum(exact(column, scale)).cast("double")


def json_long(column: str, key: str) -> Column:
    return F.get_json_object(column, f"$.{key}").cast("long")


def squared_length(vector: Column) -> Column:
    """Of an array of floats, added up from left to right in double precision."""
    return F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
