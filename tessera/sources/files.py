"""Readers and writers of the tables' file formats, with explicit schemas where a format has none."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: Formats that keep names and types themselves.
TYPED = ("parquet", "orc")

TIMES = {"timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}
#: CSV values may hold line breaks, so its files are not split.
WRITING = {"csv": {"header": True, "escape": '"', **TIMES}, "json": {"ignoreNullFields": False, **TIMES}}
READING = {"csv": {"header": True, "escape": '"', "multiLine": True, "mode": "FAILFAST", **TIMES}, "json": {"mode": "FAILFAST", **TIMES}}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def write(df: DataFrame, path: str, kind: str = "parquet", partition_by: tuple[str, ...] = (), mode: str = "errorifexists") -> None:
    """Writes a folder of files; partition columns become folder names, so later reads prune by them."""
    writer = df.write.mode(mode).partitionBy(*partition_by) if partition_by else df.write.mode(mode)
    writer.format(kind).options(**WRITING.get(kind, {})).save(path)


def read(spark: SparkSession, path: str, kind: str = "parquet", schema: T.StructType | None = None) -> DataFrame:
    """Reads what `write` wrote. CSV and JSON need the schema; inference would read the data twice and lose types."""
    if kind not in TYPED and schema is None:
        raise ValueError(f"{kind} files need a schema")
    reader = spark.read.format(kind).options(**READING.get(kind, {}))
    return (reader.schema(schema) if schema else reader).load(path)


def stream(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int = 100) -> DataFrame:
    """A stream of the Parquet files that arrive under a path."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)
