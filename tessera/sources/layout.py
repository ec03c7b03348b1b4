"""A layout of files by a space-filling curve, so that filters on any of several columns skip most of them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of each column's place: columns are cut into so many ranges of about equally many rows.
BITS = 8

#: Files of a layout that are as short as asked for; beyond, a file has pages of that length, up to MOST_ROWS rows in all.
SHORT_FILES, MOST_ROWS = 64, 1_000_000


def files_for(rows: int, stretch: int) -> int:
    """The files of a layout that tells stretches of so many rows apart, by their own statistics or their pages'."""
    return max(1, min(SHORT_FILES, rows // stretch), -(-rows // MOST_ROWS))


def with_places(df: DataFrame, columns: list[str], bits: int = BITS) -> DataFrame:
    """Adds __p0, __p1, ...: the range that a row falls into, in each column; the ranges come from approximate quantiles, nulls first.

    A place is found by halving; each step is a projection, since it uses the last one twice.
    """
    shares = [k / (1 << bits) for k in range(1, 1 << bits)]
    as_number = [F.unix_micros(F.col(c).cast("timestamp")) if df.schema[c].dataType.simpleString() in ("timestamp", "timestamp_ntz", "date") else F.col(c).cast("double") for c in columns]
    cuts = df.agg(*[F.percentile_approx(x, shares, 10_000).alias(f"c{i}") for i, x in enumerate(as_number)]).first()
    kinds = df.select(*[x.alias(f"c{i}") for i, x in enumerate(as_number)]).schema
    below = []
    for i in range(len(columns)):
        own = sorted(set(cuts[i] or []))
        below.append(F.array(*[F.lit(x) for x in own + [None] * (len(shares) - len(own))]).cast(f"array<{kinds[i].dataType.simpleString()}>"))
    df = df.withColumns({f"__x{i}": x for i, x in enumerate(as_number)}).withColumns({f"__p{i}": F.lit(0) for i in range(len(columns))})
    for k in reversed(range(bits)):
        more = lambda i: F.when(F.get(below[i], F.col(f"__p{i}") + F.lit((1 << k) - 1)) < F.col(f"__x{i}"), 1 << k).otherwise(0)
        df = df.withColumns({f"__p{i}": F.col(f"__p{i}") + more(i) for i in range(len(columns))})
    return df.drop(*[f"__x{i}" for i in range(len(columns))])


def interleaved(places: list[Column], bits: int = BITS) -> Column:
    """The bits of all places in turn, the highest first: near rows of the curve are near in every column."""
    n = len(places)
    spread = lambda p, i: sum((p >> k & 1) << (k * n + n - 1 - i) for k in range(bits))
    parts = [F.get(F.array(*[F.lit(spread(p, i)).cast("long") for p in range(1 << bits)]), place) for i, place in enumerate(places)]
    return reduce(lambda a, b: a.bitwiseOR(b), parts)


def write_clustered(df: DataFrame, path: str, columns: list[str], files: int, mode: str = "errorifexists", page: int | None = None) -> None:
    """Writes Parquet files that each hold one stretch of the curve over the columns, so that their statistics are narrow in all of them.

    With `page`, so do the pages of a file, by so many rows; readers skip pages by Parquet's column index.
    """
    keyed = with_places(df, columns).withColumn("__z", interleaved([F.col(f"__p{i}") for i in range(len(columns))])).select(*df.columns, "__z")
    writer = keyed.repartitionByRange(files, "__z").sortWithinPartitions("__z").drop("__z").write.mode(mode)
    (writer.option("parquet.page.row.count.limit", page) if page else writer).parquet(path)
