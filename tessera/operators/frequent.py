"""Items that hold more than one in k of all values, by counters of bounded size and a second, exact pass."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Summaries that one task merges.
FAN = 16


def trimmed(items: pa.Array, counts: np.ndarray, k: int) -> tuple[pa.Array, np.ndarray]:
    """At most k counters: the next largest count is taken off all, and what is left of none goes.

    Of n values no counter loses more than n / (k + 1) in all, whatever is merged in what order,
    so an item that holds more than that keeps a counter.
    """
    if len(items) <= k:
        return items, counts
    counts = counts - np.partition(counts, len(counts) - k - 1)[len(counts) - k - 1]
    kept = np.flatnonzero(counts > 0)
    return items.take(pa.array(kept)), counts[kept]


def summed(items: pa.Array, counts: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """One counter for each item."""
    coded = items.dictionary_encode()
    return coded.dictionary, np.bincount(coded.indices.to_numpy(), weights=counts, minlength=len(coded.dictionary)).astype(np.int64)


def heavy_hitters(df: DataFrame, column: str, k: int, fan: int = FAN) -> DataFrame:
    """(item, n): the values of a column that are more than one in k of all values, with their exact counts.

    Each task keeps k counters; summaries are merged by a tree of `fan` each, so no task holds more
    than fan * k counters. The k candidates are then counted exactly. Nulls are no values. At most
    k - 1 items are found, however many different values there are, and nothing else is shuffled.
    """
    values = df.select(F.col(column).alias("item")).where(F.col("item").isNotNull())
    kind = values.schema["item"].dataType.simpleString()

    def summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            found = pc.value_counts(batch.column(0))
            items, counts = found.field("values"), found.field("counts").to_numpy().astype(np.int64)
            if held is not None:
                items, counts = summed(pa.concat_arrays([held[0], items]), np.concatenate([held[1], counts]))
            held = trimmed(items, counts, k)
        if held is not None and len(held[0]):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(held[0]), TaskContext.get().partitionId(), np.int32)), held[0], pa.array(held[1])], names=["part", "item", "n"])

    def merge(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        column_ = rows.column("item")
        items = column_.chunk(0) if column_.num_chunks == 1 else pa.concat_arrays(column_.chunks)
        items, counts = trimmed(*summed(items, rows.column("n").to_numpy()), k)
        return pa.table({"part": pa.array(np.full(len(items), rows.column("part")[0].as_py(), np.int32)), "item": items, "n": pa.array(counts)})

    schema = f"part int, item {kind}, n long"
    found, parts = values.mapInArrow(summary, schema), values.rdd.getNumPartitions()
    while parts > 1:
        found = found.withColumn("part", (F.col("part") / fan).cast("int")).groupBy("part").applyInArrow(merge, schema)
        parts = -(-parts // fan)
    total = values.count()
    exact = values.join(F.broadcast(found.select("item")), "item").groupBy("item").agg(F.count("*").alias("n"))  # k items at most
    return exact.where(F.col("n") * k > total)
