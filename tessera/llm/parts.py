"""A corpus kept in parts, and a two-way exchange of hashes between them.

Exact matching over all windows of a corpus would shuffle several times its size. Here the
texts stay where they are: `Parts` writes them once as a table bucketed by the number of the
input partition, so later passes over one part need no shuffle of texts. In each pass a part
sends every *distinct* hash once to the bucket that owns it, and the bucket answers with one
bit for each. A group of copies of any size is so reduced to one hash a part before anything
is shuffled, and no task sees more than one part or one bucket.

Memory follows bytes, not settings: input partitions are divided so that a part has about
`PART_BYTES` of text, and there is a bucket of hashes for each `BUCKET_BYTES` of the corpus, or
more where `spark.sql.shuffle.partitions` asks for them. Rows are dealt to the parts of their
partition by a hash of the text, so copies stay together; a single text or group of copies that
is larger than a part makes a larger part.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import remove, scratch

REQUEST = "bucket int, part long, body binary"
ANSWER = "part long, step int, bucket int, body binary"

#: Spark's own bound on buckets of a table.
MOST_BUCKETS = 100_000

#: Bytes of text in a part, and of the corpus for each bucket of hashes.
PART_BYTES, BUCKET_BYTES = 4 << 20, 32 << 20


class Parts(NamedTuple):
    """A table (doc_id, text, part), bucketed by part, and how many buckets of hashes it needs."""

    rows: DataFrame
    buckets: int


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def buckets_of(spark: SparkSession, n_bytes: int) -> int:
    return max(shuffle_partitions(spark), -(-n_bytes // BUCKET_BYTES))


@contextmanager
def parts(docs: DataFrame, name: str, part_bytes: int = PART_BYTES) -> Iterator[Parts]:
    """The rows (doc_id, text) with their part, bucketed by it; dropped at the end."""
    spark = docs.sparkSession
    table, path = f"tessera_{name}_{uuid.uuid4().hex}", scratch(spark, name)
    plain = docs.select("doc_id", "text")
    sizes = plain.groupBy(F.spark_partition_id()).agg(F.sum(F.octet_length("text").cast("long")).alias("n"))
    total, largest = (x or 0 for x in sizes.agg(F.sum("n"), F.max("n")).head())
    split = max(1, -(-largest // part_bytes))
    rows = plain.withColumn("part", F.spark_partition_id().cast("long") * split + F.pmod(F.xxhash64("text"), F.lit(split)))
    writer = rows.write.bucketBy(min(buckets_of(spark, total), MOST_BUCKETS), "part").option("path", path).option("compression", "zstd")
    writer.format("parquet").saveAsTable(table)
    try:
        yield Parts(spark.table(table), buckets_of(spark, total))
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {table}")
        remove(spark, path)


def by_part(rows: DataFrame, f: Callable[[int, pa.Table], pa.Table], schema: str) -> DataFrame:
    """f(part, its rows) for every part."""
    return rows.groupBy("part").applyInArrow(lambda key, t: f(key[0].as_py(), t), schema)


def with_answers(rows: DataFrame, answers: DataFrame, f: Callable[[int, pa.Table, dict], pa.Table], schema: str) -> DataFrame:
    """f(part, its rows, {(step, bucket): body}) for every part."""

    def run(key, left, right):
        found = dict(zip(zip(right["step"].to_pylist(), right["bucket"].to_pylist()), right["body"].to_pylist()))
        return f(key[0].as_py(), left, found)

    return rows.groupBy("part").cogroup(answers.groupBy("part")).applyInArrow(run, schema)


def by_bucket(requests: DataFrame, step: int, f: Callable[[list[bytes]], list[bytes]]) -> DataFrame:
    """The answers of f, which gets what all parts sent to one bucket and returns an answer for each."""

    def run(key, table):
        bodies = f(table["body"].to_pylist())
        return pa.table({"part": table["part"], "step": pa.array([step] * len(bodies), pa.int32()), "bucket": table["bucket"], "body": pa.array(bodies, pa.binary())})

    return requests.groupBy("bucket").applyInArrow(run, ANSWER)


def cut(owner: np.ndarray, buckets: int) -> Iterator[tuple[int, int, int]]:
    """(bucket, start, end) of the runs of a sorted array of owners."""
    edges = np.searchsorted(owner, np.arange(buckets + 1))
    for b in np.flatnonzero(np.diff(edges)):
        yield int(b), int(edges[b]), int(edges[b + 1])


def owned(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of each hash; from its upper bits, so that sorted hashes have sorted owners."""
    return ((hashes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int32)


def requests_of(part: int, hashes: np.ndarray, buckets: int) -> pa.Table:
    """Requests with sorted distinct hashes, each in the bucket that owns it."""
    rows = [(b, hashes[i:j].tobytes()) for b, i, j in cut(owned(hashes, buckets), buckets)]
    return pa.table({"bucket": pa.array([r[0] for r in rows], pa.int32()), "part": pa.array([part] * len(rows), pa.int64()), "body": pa.array([r[1] for r in rows], pa.binary())})


def elsewhere(bodies: list[bytes]) -> list[bytes]:
    """For each part's sorted hashes, bits that tell which of them another part has sent too."""
    each = [np.frombuffer(x, np.uint64) for x in bodies]
    merged = np.sort(np.concatenate(each))
    twice = np.unique(merged[1:][merged[1:] == merged[:-1]])
    return [np.packbits(member(x, twice)).tobytes() for x in each]


def member(values: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Which values are in a sorted array."""
    if not len(of):
        return np.zeros(len(values), bool)
    at = np.searchsorted(of, values)
    at[at == len(of)] = 0
    return of[at] == values


def answered(hashes: np.ndarray, buckets: int, answers: dict, step: int) -> np.ndarray:
    """The bits that came back for the sorted hashes of a part."""
    out = np.zeros(len(hashes), bool)
    for b, i, j in cut(owned(hashes, buckets), buckets):
        out[i:j] = np.unpackbits(np.frombuffer(answers[step, b], np.uint8), count=j - i).astype(bool)
    return out
