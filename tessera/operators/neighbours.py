"""Nearest neighbours by inverted lists: vectors by the cell of their nearest centre, queries sent to few cells.

Centres come from distributed k-means on a bounded sample; every vector is then put into a cell.
Cells that lie together are a group, and groups are cut into shares of bounded size, so that a cell of any size
is many tasks. A query meets the `probes` cells whose centres are nearest; it travels once to each share
of their groups, however many cells it meets there, and comes back with its best `k` of the share. The best of
those are the answer. How many probes reach a recall is measured on a sample of queries. The exact
mode goes on to all cells that may still hold a nearer vector: by the triangle inequality those
whose centre is nearer than the k-th neighbour found so far and the cell's radius together.

Similarity is the cosine in double precision; of equal ones the smaller id comes first. Vectors that
are null, empty or zero, or hold null or non-finite components, are no one's neighbours and have none; all
others are of one length.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.sources.scratch import written

#: Vectors that k-means is fitted on, with the smallest hashes; queries that the recall is measured on.
SAMPLE, MEASURED = 100_000, 256
MOST_CELLS, BLOCK, SLACK = 4096, 4096, 1e-9
#: Groups of cells; parts of the queries; vectors or queries of one task, beyond which there are more of them; queries of a step.
GROUPS, PARTS, MOST_HELD, STEP = 8, 8, 1 << 17, 1024

HIT = "query long, id long, similarity double"


def usable(vector: Column) -> Column:
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.coalesce(~F.exists(vector, odd) & F.exists(vector, lambda x: x != 0), F.lit(False))


def kind(df: DataFrame, vector_col: str) -> str:
    """Floats travel as they are; all reckoning is in double precision."""
    return "array<float>" if df.schema[vector_col].dataType.simpleString() == "array<float>" else "array<double>"


def halved(centres: np.ndarray, counts: np.ndarray, groups: int) -> np.ndarray:
    """The group of each centre: halves of about equally many vectors along the direction of largest spread, and so on."""
    out = np.zeros(len(centres), np.int64)
    if groups > 1 and len(centres) > 1:
        x = centres - centres.mean(axis=0)
        order = np.argsort(x @ np.linalg.svd(x, full_matrices=False)[2][0], kind="stable")
        at = int(np.clip(np.searchsorted(np.cumsum(counts[order]), counts.sum() / 2), 1, len(order) - 1))
        for own, first in ((order[:at], 0), (order[at:], groups // 2)):
            out[own] = first + halved(centres[own], counts[own], groups // 2)
    return out


def unit_rows(vectors: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    if isinstance(vectors, pa.ChunkedArray):
        vectors = pa.concat_arrays(vectors.chunks) if vectors.num_chunks else pa.array([], pa.list_(pa.float64()))
    x = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


class Cells:
    """The centres, the vectors of each cell and the angle to its farthest one, groups and their shares; sent to every task."""

    def __init__(self, centres: np.ndarray):
        norms = np.linalg.norm(centres, axis=1, keepdims=True)
        self.centres = centres / np.where(norms > 0, norms, 1)
        self.dim = centres.shape[1]
        self.counts = np.zeros(len(centres), np.int64)
        self.radius = np.full(len(centres), -math.inf)

    def deal(self) -> None:
        """Puts cells into groups and numbers the shares of each group."""
        self.group = halved(self.centres, self.counts, GROUPS)
        held = np.bincount(self.group, self.counts, GROUPS).astype(np.int64)
        self.shares = np.maximum(1, -(-held // MOST_HELD))
        self.first_share = np.cumsum(self.shares) - self.shares

    def angles(self, x: np.ndarray) -> np.ndarray:
        return np.arccos(np.clip(x @ self.centres.T, -1, 1))

    def placed(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(id, cell, angle, vector) of (id, vector)."""
        for batch in batches:
            angle = self.angles(unit_rows(batch.column(1), self.dim))
            cell = angle.argmin(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cell.astype(np.int32)), pa.array(angle[np.arange(len(cell)), cell]), batch.column(1)], names=["id", "cell", "angle", "vector"])

    def sent(self, probes: int, beyond: bool):
        """(query, share, cells, vector) for the nearest cells of a query, or for those beyond that may hold a vector nearer than the k-th so far."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for k in range(0, whole.num_rows, STEP):
                    batch = whole.slice(k, STEP)
                    vectors = batch.column(batch.num_columns - 1)
                    angle = self.angles(unit_rows(vectors, self.dim))
                    wanted = np.argsort(np.argsort(angle, axis=1, kind="stable"), axis=1) < probes
                    if beyond:
                        reach = np.arccos(np.clip(batch.column(1).fill_null(-1.0).to_numpy(zero_copy_only=False), -1, 1))
                        wanted = ~wanted & (angle - self.radius[None, :] <= reach[:, None] + SLACK)
                    wanted &= self.counts > 0
                    for g in range(GROUPS):
                        own = np.flatnonzero(self.group == g)
                        who, cell = np.nonzero(wanted[:, own])
                        n = np.bincount(who, minlength=batch.num_rows)
                        asks = np.flatnonzero(n)
                        if len(asks):
                            cells = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n[asks])).astype(np.int32)), pa.array(own[cell].astype(np.int32)))
                            ids, what = batch.column(0).take(pa.array(asks)), vectors.take(pa.array(asks))
                            for share in range(self.first_share[g], self.first_share[g] + self.shares[g]):
                                yield pa.RecordBatch.from_arrays([ids, pa.array(np.full(len(asks), share, np.int32)), cells, what], names=["query", "share", "cells", "vector"])

        return run


class VectorIndex:
    """Inverted lists over (id, vector) rows."""

    def __init__(self, rows: DataFrame, id_col: str, vector_col: str, cells: int | None = None, seed: int = 11):
        fit = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast(kind(rows, vector_col)).alias("vector")).where(usable(F.col("vector")))
        self.count = fit.count()
        self.empty = not self.count
        if self.empty:
            self.rows = fit
            return
        k = cells or min(MOST_CELLS, max(2, math.isqrt(self.count)))
        double = F.col("vector").cast("array<double>")
        length = F.sqrt(F.aggregate(double, F.lit(0.0), lambda s, x: s + x * x))
        # the order by a hash keeps the first SAMPLE rows of each task, and is what bounds the fit
        sample = written(fit.orderBy(F.xxhash64("id", "vector")).limit(SAMPLE).select(array_to_vector(F.transform(double, lambda x: x / length)).alias("features")), "sample")
        centres = np.stack(KMeans(k=k, maxIter=10, seed=seed, initMode="random").fit(sample).clusterCenters())
        self.cells = Cells(centres)
        placed = written(fit.mapInArrow(self.cells.placed, f"id long, cell int, angle double, vector {kind(fit, 'vector')}"), "cells")
        for r in placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("angle").alias("radius")).collect():  # a row for each cell
            self.cells.counts[r["cell"]], self.cells.radius[r["cell"]] = r["n"], r["radius"]
        self.cells.deal()
        of = lambda values: F.get(F.array(*[F.lit(int(x)) for x in values]), F.col("cell"))
        shares, first = of(self.cells.shares[self.cells.group]), of(self.cells.first_share[self.cells.group])
        self.rows = placed.select("id", "cell", (first + F.pmod(F.xxhash64("id"), shares)).cast("int").alias("share"), "vector")

    def _queries(self, queries: DataFrame, id_col: str, vector_col: str) -> DataFrame:
        return queries.select(F.col(id_col).cast("long").alias("query"), F.col(vector_col).cast(kind(queries, vector_col)).alias("vector")).where(usable(F.col("vector")))

    def _met(self, sent: DataFrame, k: int, itself: bool, n_asked: int) -> DataFrame:
        """(query, id, similarity): the best k of each share that a query was sent to."""
        parts = max(1, min(PARTS, n_asked // STEP), -(-n_asked // MOST_HELD))  # queries of one share are dealt over parts
        dim, n_cells = self.cells.dim, len(self.cells.centres)

        def best(key: tuple, asked: pa.Table, held: pa.Table) -> pa.Table:
            if not asked.num_rows or not held.num_rows:
                return _HIT.empty_table()
            held = held.sort_by("cell")
            edges = np.searchsorted(held.column("cell").to_numpy(), np.arange(n_cells + 1))
            ids, x = held.column("id").to_numpy(), unit_rows(held.column("vector"), dim)
            out = []
            for at in range(0, asked.num_rows, STEP):
                some = asked.slice(at, STEP).combine_chunks()
                q, v, lists = some.column("query").to_numpy(), unit_rows(some.column("vector"), dim), some.column("cells").combine_chunks()
                who = np.repeat(np.arange(len(q)), lists.value_lengths().to_numpy())
                cell = lists.flatten().to_numpy()
                order = np.argsort(cell, kind="stable")
                who, begins = who[order], np.searchsorted(cell[order], np.arange(n_cells + 1))
                hits, more, kth = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)], [], np.full(len(q), -2.0)

                def merged() -> None:
                    hits[:] = [np.concatenate(c) for c in zip(hits, *more)]
                    more.clear()
                    by = np.lexsort((hits[1], -hits[2], hits[0]))
                    first = np.searchsorted(hits[0][by], np.arange(len(q)))
                    by = by[np.arange(len(by)) - first[hits[0][by]] < k]  # of equal similarity, the smaller ids
                    hits[:] = [c[by] for c in hits]
                    full = np.flatnonzero(np.bincount(hits[0], minlength=len(q)) == k)
                    last = np.searchsorted(hits[0], full, "right") - 1
                    kth[full] = hits[2][last]

                for c in np.unique(cell):
                    asks = who[begins[c] : begins[c + 1]]
                    for i in range(edges[c], edges[c + 1], BLOCK):
                        j = min(i + BLOCK, edges[c + 1])
                        s = v[asks] @ x[i:j].T
                        if not itself:
                            s[q[asks][:, None] == ids[None, i:j]] = -2.0
                        least = kth[asks]
                        if j - i > k:
                            least = np.maximum(least, np.partition(s, j - i - k, axis=1)[:, j - i - k])
                        row, col = np.nonzero((s >= least[:, None]) & (s > -2.0))
                        more.append((asks[row], ids[i:j][col], s[row, col]))
                        if sum(len(m[0]) for m in more) > 4 * k * STEP:
                            merged()
                merged()
                out.append(pa.table({"query": q[hits[0]], "id": hits[1], "similarity": hits[2]}, schema=_HIT))
            return pa.concat_tables(out)

        asked = sent.withColumn("part", F.pmod(F.xxhash64("query"), F.lit(parts)).cast("int")).groupBy("share", "part")
        held = self.rows.withColumn("part", F.explode(F.array(*[F.lit(p) for p in range(parts)]))).groupBy("share", "part")
        return asked.cogroup(held).applyInArrow(best, HIT)

    def _best(self, hits: DataFrame, k: int) -> DataFrame:
        order = W.partitionBy("query").orderBy(F.desc("similarity"), "id")
        return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    def search(self, queries: DataFrame, id_col: str, vector_col: str, k: int = 10, probes: int = 8, exact: bool = False, itself: bool = False) -> DataFrame:
        """(query, rank, id, similarity) of the k nearest vectors of each query; without itself, vectors with the query's id do not count."""
        asked = self._queries(queries, id_col, vector_col)
        if self.empty:
            return asked.select("query", F.lit(1).alias("rank"), F.col("query").alias("id"), F.lit(0.0).alias("similarity")).limit(0)
        n = asked.count()
        columns = f"query long, share int, cells array<int>, vector {kind(asked, 'vector')}"
        hits = self._met(asked.select("query", "vector").mapInArrow(self.cells.sent(probes, False), columns), k, itself, n)
        if exact:
            hits = written(self._best(hits, k).select("query", "id", "similarity"), "first-hits")
            # a query with fewer than k hits so far has to see every cell
            reach = hits.groupBy("query").agg(F.when(F.count("*") >= k, F.min("similarity")).alias("kth"))
            beyond = asked.join(reach, "query", "left").select("query", "kth", "vector").mapInArrow(self.cells.sent(probes, True), columns)
            hits = hits.unionByName(self._met(beyond, k, itself, n))
        return self._best(hits, k).select("query", "rank", "id", "similarity")

    def probes_for(self, queries: DataFrame, id_col: str, vector_col: str, k: int = 10, recall: float = 0.95, itself: bool = False) -> int:
        """The least number of probes that finds the share `recall` of the true neighbours of MEASURED queries."""
        if self.empty:
            return 1
        some = written(queries.orderBy(F.xxhash64(id_col)).limit(MEASURED), "measured")
        true = self.search(some, id_col, vector_col, k, max(1, len(self.cells.centres) // 8), exact=True, itself=itself)
        found = true.select("query", "id").join(self.rows.select("id", "cell"), "id").select("query", "cell")
        needed = found.join(self._queries(some, id_col, vector_col), "query").select("query", "cell", "vector")
        ranks = []
        for r in needed.collect():  # MEASURED times k rows
            x = np.array(r["vector"])
            angle = self.cells.angles((x / np.linalg.norm(x))[None])[0]
            ranks.append(int((angle < angle[r["cell"]]).sum()) + 1)
        ranks.sort()
        return ranks[min(len(ranks) - 1, math.ceil(recall * len(ranks)) - 1)] if ranks else 1


_HIT = pa.schema([("query", pa.int64()), ("id", pa.int64()), ("similarity", pa.float64())])
