"""Registered queries on vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.neighbours import VectorIndex
from tessera.plans.registry import query
from tessera.sources.files import read_table

#: Neighbours a query asks for; one vector in so many is a query of the exact search.
NEAREST, ONE_IN = 10, 20


@query(f"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
s AS (SELECT q.vec_id, v.vec_id AS neighbour, list_inner_product(q.e, v.e) / sqrt(list_inner_product(q.e, q.e) * list_inner_product(v.e, v.e)) AS similarity
      FROM v q JOIN v ON q.vec_id % {ONE_IN} = 0 AND q.vec_id <> v.vec_id)
SELECT vec_id, CAST(rank AS INT) AS rank, neighbour, round(similarity, 6) AS similarity
FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY similarity DESC, neighbour) AS rank FROM s) WHERE rank <= {NEAREST}
""")
def nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact search: a stated set of queries, every twentieth vector, against all vectors."""
    rows = read_table(spark, sf_dir, "embeddings")
    index = VectorIndex(rows, "vec_id", "embedding")
    found = index.search(rows.where(F.col("vec_id") % ONE_IN == 0), "vec_id", "embedding", NEAREST, exact=True)
    return found.select(F.col("query").alias("vec_id"), "rank", F.col("id").alias("neighbour"), F.round("similarity", 6).alias("similarity"))


@query(None)
def probable_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbours of every vector out of the cells that hold 95 % of the true ones of a sample of queries."""
    rows = read_table(spark, sf_dir, "embeddings")
    index = VectorIndex(rows, "vec_id", "embedding")
    probes = index.probes_for(rows, "vec_id", "embedding", NEAREST)
    found = index.search(rows, "vec_id", "embedding", NEAREST, probes)
    return found.select(F.col("query").alias("vec_id"), "rank", F.col("id").alias("neighbour"), F.round("similarity", 6).alias("similarity"))
