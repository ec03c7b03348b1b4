"""What the corpus operators share: tables, row keys, shared storage and batching."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one vectorised step handles at a time inside a task.
CHUNK_BYTES = 1 << 20

#: Stands for a null id inside keys.
NO_ID = -(1 << 63)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, kd, th): the id, the text and a row key that is never null.

    Rows that agree in id and text share a key; rows that share only the id do not.
    Only the two named columns are taken, so no other column of the input can clash.
    """
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).withColumns(
        {"kd": F.coalesce("doc_id", F.lit(NO_ID)), "th": F.xxhash64("text")}
    )


def keyed_columns(id_col: str = "doc_id", text_col: str = "text") -> dict[str, Column]:
    """The same row key for rows that keep all their columns."""
    return {"__kd": F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)), "__th": F.xxhash64(F.col(text_col).cast("string"))}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only in local mode where none is set."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    context = spark.sparkContext._jsc.sc()
    if context.getCheckpointDir().isEmpty():
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
    return context.getCheckpointDir().get().rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/tessera/{name}-{uuid.uuid4().hex}"


_of_thread = threading.local()


def _spaces() -> list[list[str]]:
    """The folders written since each `scratch_space` of this thread was opened, innermost last."""
    return vars(_of_thread).setdefault("spaces", [])


def stored(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage with a Parquet table in the shared folder; the innermost scratch space owns it."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    if _spaces():
        _spaces()[-1].append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


@contextmanager
def scratch_space(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Deletes at its end what was stored inside, but for the tables given to the function that it yields.

    Those are read by the result that leaves the space, and belong to the space around it; the
    outermost ones stay for as long as the caller wants to read the result.
    """
    own: list[str] = []
    _spaces().append(own)
    kept: list[str] = []

    def keep(df: DataFrame) -> DataFrame:
        kept.append(df._stored_at)
        return df

    try:
        yield keep
    finally:
        _spaces().pop()
        for path in own:
            if path in kept:
                if _spaces():
                    _spaces()[-1].append(path)
            else:
                remove(spark, path)


def remove_stored(df: DataFrame) -> None:
    """Deletes a table that `stored` has written."""
    remove(df.sparkSession, df._stored_at)


#: Numbers that one row holds while rows are written out again.
RUN = 4096


def numbered_copies(df: DataFrame, n: str, out: str) -> DataFrame:
    """Each row n times, numbered from 0; in two steps, so that no row holds many numbers. The column n stays."""
    steps = df.where(F.col(n) > 0).select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1, F.lit(RUN).cast("long"))).alias("__begin"))
    stop = F.least(F.col(n), F.col("__begin") + RUN) - 1
    return steps.select(*df.columns, F.explode(F.sequence("__begin", stop)).alias(out))


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a scratch path with the file system that holds it."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive rows of a batch whose texts hold about `limit` bytes; one long text is a slice of its own."""
    if not batch.num_rows:
        return
    sizes = pc.binary_length(batch.column(batch.schema.get_field_index(column))).fill_null(0).to_numpy(zero_copy_only=False)
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if i > start and total + n > limit:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += int(n)
    yield batch.slice(start)
