"""Near duplicates among embeddings by counting collisions of one-dimensional projections.

Every vector is projected on many random lines. A list sorts the vectors by one line; two vectors
collide in it if the second lies in a window around the first, `WIDTH` standard deviations of the
difference that vectors at the least similarity have. So that windows stay short in large tables, a
list is sorted within the cells that the signs of further projections make, about `IN_CELL`
vectors each. Collisions are counted per pair over all lists; pairs that collide at least
`LEAST_HITS` times are compared exactly. The number of lists follows from the chance that a pair
at the least similarity collides in one, so that it reaches the count with `RECALL`. Cells take
log2(n) signs, lists grow as about n^0.15, and each vector meets a bounded number of others a list.

Crowds, where windows would hold all pairs of many vectors, are taken out first: the fullest
cells of a coarse hash give up to `CENTRES` centres, and a vector within the link angle of a centre
belongs to the nearest one. All its pairs, with vectors up to twice that angle from the centre, are
settled there and not in the lists: by the triangle inequality from the two distances to the centre
where that is enough, else by comparing blocks of `BLOCK` vectors. Blocks give counts and one
label a vector, never pairs. Centres only decide where a pair is settled, so their number changes no
row; a pair with a vector near a centre is never missed.

Equal vectors are one node with a weight; components are found over links, stars and labels.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components link with
nothing, and so do vectors of different lengths with each other; a null vec_id is the smallest, and
rows that repeat a vec_id are vectors of their own; an empty table gives no row. Only vec_id and
embedding are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import NO_ID, scratch_space, stored, table
from tessera.llm.components import components

SIMILARITY = 0.95
ANGLE = math.acos(SIMILARITY)
RECALL, LEAST_HITS = 0.9995, 2
#: Half the width of a window, in standard deviations of the difference of two projections.
WIDTH = 2.5
WINDOW = WIDTH * math.sqrt(2 - 2 * SIMILARITY)
IN_CELL = 8

#: A coarse cell with so many vectors is a crowd; centres are few enough to be sent to every task.
CROWD, CENTRES = 64, 256
BLOCK = 2048
#: Rings around a centre, so many within the link angle.
RINGS = 8
SLACK = 1e-9
#: Vectors that a task projects at a time.
SLICE = 2048

SEED_LISTS, SEED_COARSE = 1, 2


def collision(signs: int) -> float:
    """The chance that two vectors at the least similarity collide in one list."""
    return (1 - ANGLE / math.pi) ** signs * math.erf(WIDTH / math.sqrt(2))


def signs_for(n: int) -> int:
    return max(0, math.floor(math.log2(max(1, n) / IN_CELL)))


def lists_for(signs: int) -> int:
    """The least number of lists in which such a pair collides `LEAST_HITS` times with `RECALL`."""
    p, lists = collision(signs), LEAST_HITS
    while sum(math.comb(lists, k) * p**k * (1 - p) ** (lists - k) for k in range(LEAST_HITS)) > 1 - RECALL:
        lists += 1
    return lists


@lru_cache(8)
def lines(seed: int, dim: int, n: int) -> np.ndarray:
    return np.random.default_rng((seed, dim)).standard_normal((dim, n))


def units(vectors: pa.Array, dim: int) -> np.ndarray:
    """Vectors of one length as rows of length one, in double precision."""
    x = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def by_length(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch, np.ndarray]]:
    """(dim, rows, units) of slices whose vectors are equally long; the vectors are the last column."""
    for batch in batches:
        vectors = batch.column(batch.num_columns - 1)
        dims = vectors.value_lengths().to_numpy(zero_copy_only=False)
        for dim in np.unique(dims):
            rows = batch.filter(pa.array(dims == dim))
            for k in range(0, rows.num_rows, SLICE):
                part = rows.slice(k, SLICE)
                yield int(dim), part, units(part.column(part.num_columns - 1), int(dim))


def cells(x: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """The number that the signs of the projections make."""
    out = np.zeros(len(x), np.int64)
    for side in (x @ planes > 0).T:
        out = 2 * out + side
    return out


class Centres:
    """Unit vectors by their length, told by numbers over all lengths."""

    def __init__(self, found: dict[int, np.ndarray]):
        self.found = {}
        first = 0
        for dim in sorted(found):
            self.found[dim] = (first, found[dim])
            first += len(found[dim])

    def angles(self, dim: int, x: np.ndarray) -> tuple[int, np.ndarray]:
        """(number of the first centre, the angle between each vector and each centre)."""
        first, at = self.found.get(dim, (0, np.zeros((0, dim))))
        return first, np.arccos(np.clip(x @ at.T, -1, 1))

    def owned(self, dim: int, x: np.ndarray) -> np.ndarray:
        _, angle = self.angles(dim, x)
        return angle.min(axis=1, initial=math.inf) <= ANGLE


def coarse(signs: int):
    """(dim, cell) of each vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for dim, _, x in by_length(batches):
            yield pa.record_batch({"dim": np.full(len(x), dim, np.int32), "cell": cells(x, lines(SEED_COARSE, dim, signs))})

    return run


def sums(signs: int, crowded: list[tuple[int, int]]):
    """(dim, cell, total): the sum of the unit vectors of each crowded cell in a slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for dim, _, x in by_length(batches):
            own = np.array(sorted(c for d, c in crowded if d == dim), np.int64)
            if not len(own):
                continue
            cell = cells(x, lines(SEED_COARSE, dim, signs))
            place = np.minimum(np.searchsorted(own, cell), len(own) - 1)
            hit = own[place] == cell
            total = np.zeros((len(own), dim))
            np.add.at(total, place[hit], x[hit])
            there = np.unique(place[hit])
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(there) + 1) * dim, pa.int32()), pa.array(total[there].ravel()))
            yield pa.record_batch({"dim": np.full(len(there), dim, np.int32), "cell": own[there], "total": flat})

    return run


def centres(nodes: DataFrame, n: int) -> Centres | None:
    """The directions of the fullest coarse cells, none within half the link angle of a fuller one's."""
    signs = signs_for(n)
    dims = nodes.select("embedding")
    full = dims.mapInArrow(coarse(signs), "dim int, cell long").groupBy("dim", "cell").count().where(F.col("count") >= CROWD)
    crowded = full.orderBy(F.desc("count"), "dim", "cell").limit(CENTRES).collect()  # where pairs are settled, not which
    if not crowded:
        return None
    keys = [(r["dim"], r["cell"]) for r in crowded]
    parts = dims.mapInArrow(sums(signs, keys), "dim int, cell long, total array<double>")
    totals: dict[tuple[int, int], dict[int, float]] = {}
    for r in parts.select("dim", "cell", F.posexplode("total")).groupBy("dim", "cell", "pos").agg(F.sum("col").alias("s")).collect():
        totals.setdefault((r["dim"], r["cell"]), {})[r["pos"]] = r["s"]
    found: dict[int, list[np.ndarray]] = {}
    for key in keys:
        c = np.array([totals[key][k] for k in range(key[0])])
        c = c / max(np.linalg.norm(c), 1e-300)
        if all(c @ other < math.cos(ANGLE / 2) for other in found.get(key[0], [])):
            found.setdefault(key[0], []).append(c)
    return Centres({dim: np.stack(x) for dim, x in found.items()})


NEAR = "rid long, weight long, c int, own boolean, ring int, embedding array<float>"


def near(at: Centres):
    """A row for each centre at which pairs of a vector are settled; `own` where the vector belongs to it.

    Vectors that belong to a centre are sent only to such further ones as have smaller numbers, so
    that a pair is settled once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for dim, rows, x in by_length(batches):
            first, angle = at.angles(dim, x)
            if not angle.shape[1]:
                continue
            owner = np.where(angle.min(axis=1) <= ANGLE, angle.argmin(axis=1), angle.shape[1])
            who, c = np.nonzero((angle <= 2 * ANGLE + SLACK) & (np.arange(angle.shape[1]) <= owner[:, None]))
            ring = np.floor(angle[who, c] / (ANGLE / RINGS)).astype(np.int32)
            out = rows.take(pa.array(who))
            yield pa.RecordBatch.from_arrays([out.column(0), out.column(1), pa.array((first + c).astype(np.int32)), pa.array(owner[who] == c), pa.array(ring), out.column(2)], names=["rid", "weight", "c", "own", "ring", "embedding"])

    return run


def linked_labels(linked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the components of rows and columns that a matrix of links joins; each row and column is read once."""
    rows, cols = np.full(linked.shape[0], -1), np.full(linked.shape[1], -1)
    for n, seed in enumerate(np.flatnonzero(linked.any(axis=1))):
        front = np.array([seed]) if rows[seed] < 0 else np.zeros(0, int)
        rows[front] = n
        while len(front):
            new = linked[front].any(axis=0) & (cols < 0)
            cols[new] = n
            front = np.flatnonzero(linked[:, new].any(axis=1) & (rows < 0))
            rows[front] = n
    return rows, cols


FOUND = "rid long, links long, other long"
_FOUND = pa.schema([("rid", pa.int64()), ("links", pa.int64()), ("other", pa.int64())])


def compared(block: pa.Table) -> pa.Table:
    """(rid, links, other) of the vectors of one pair of blocks that have links: their weight, and a member of the same component."""
    block = block.combine_chunks()
    left = block.column("left").to_numpy()
    same = bool(block.column("same")[0].as_py())
    rid, weight = block.column("rid").to_numpy(), block.column("weight").to_numpy()
    vectors = block.column("embedding").combine_chunks()
    dim = len(vectors[0])
    x = units(vectors if isinstance(vectors, pa.ListArray) else pa.concat_arrays(vectors.chunks), dim)
    a = np.flatnonzero(left)
    b = a if same else np.flatnonzero(~left)
    linked = x[a] @ x[b].T >= SIMILARITY
    if same:
        np.fill_diagonal(linked, False)
    rows, cols = linked_labels(linked)
    ends, labels, links = [a, b], [rows, cols], [linked @ weight[b], weight[a] @ linked]
    if same:
        ends, labels, links = ends[:1], [np.maximum(rows, cols)], links[:1]
    ends, labels, links = np.concatenate(ends), np.concatenate(labels), np.concatenate(links)
    hit = labels >= 0
    ends, labels, links = ends[hit], labels[hit], links[hit]
    least = np.full(labels.max(initial=-1) + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, labels, rid[ends])
    return pa.table({"rid": rid[ends], "links": links.astype(np.int64), "other": least[labels]}, schema=_FOUND)


def settled_by_centres(around: DataFrame) -> DataFrame:
    """(rid, links, other) of all pairs of which a vector belongs to a centre."""
    spark = around.sparkSession
    rings = around.groupBy("c", "own", "ring").agg(F.count("*").alias("n"), F.sum("weight").alias("weight"), F.min("rid").alias("least")).collect()  # centres times rings
    step = ANGLE / RINGS
    sure, pairs = {}, []
    by_centre: dict[int, list] = {}
    for r in rings:
        by_centre.setdefault(r["c"], []).append(r)
    for own in by_centre.values():
        for i, p in enumerate(own):
            for q in own[i:]:
                if not (p["own"] or q["own"]):
                    continue
                if (p["ring"] + q["ring"] + 2) * step <= ANGLE - SLACK:
                    for x, y in ((p, q), (q, p)) if p is not q else ((p, p),):
                        sure.setdefault((x["c"], x["own"], x["ring"]), []).append((y["weight"], y["least"], x is y))
                elif (abs(p["ring"] - q["ring"]) - 1) * step <= ANGLE + SLACK:
                    pairs.append((p, q))
    salts = lambda r: -(-r["n"] // BLOCK)
    sides = []
    for k, (p, q) in enumerate(pairs):
        sides.append((p["c"], p["own"], p["ring"], k, True, p is q, salts(p), salts(q)))
        sides.append((q["c"], q["own"], q["ring"], k, False, p is q, salts(q), salts(p)))
    out = None
    if sure:
        known = spark.createDataFrame([(*k, sum(w for w, _, _ in v), any(s for _, _, s in v), sorted({x for _, x, _ in v})) for k, v in sure.items()], "c int, own boolean, ring int, sum long, itself boolean, leasts array<long>")
        rows = around.select("rid", "weight", "c", "own", "ring").join(F.broadcast(known), ["c", "own", "ring"])  # centres times rings
        links = F.col("sum") - F.when(F.col("itself"), F.col("weight")).otherwise(0)
        each = rows.select("rid", links.alias("links"), F.posexplode("leasts").alias("k", "other"))
        out = each.select("rid", F.when(F.col("k") == 0, F.col("links")).otherwise(0).alias("links"), "other")
    if sides:
        plan = spark.createDataFrame(sides, "c int, own boolean, ring int, pair int, left boolean, itself boolean, salts long, others long")
        rows = around.join(F.broadcast(plan), ["c", "own", "ring"]).withColumn("salt", F.pmod(F.xxhash64("rid"), F.col("salts")))
        # of a ring with itself, each two blocks meet once, and a block meets itself as the left one
        first = F.when(F.col("itself") & F.col("left"), F.col("salt")).otherwise(0)
        last = F.when(F.col("itself") & ~F.col("left"), F.col("salt") - 1).otherwise(F.col("others") - 1)
        met = rows.where(first <= last).withColumn("other", F.explode(F.sequence(first, last)))
        mine, theirs = F.col("salt"), F.col("other")
        met = met.select("pair", F.when(F.col("left"), mine).otherwise(theirs).alias("p"), F.when(F.col("left"), theirs).otherwise(mine).alias("q"), "left", (F.col("itself") & (mine == theirs)).alias("same"), "rid", "weight", "embedding")
        found = met.groupBy("pair", "p", "q").applyInArrow(compared_if_both, FOUND)
        out = found if out is None else out.unionByName(found)
    return out if out is not None else spark.createDataFrame([], FOUND)


def compared_if_both(block: pa.Table) -> pa.Table:
    sides = block.column("left").to_numpy()
    if not block.column("same")[0].as_py() and (sides.all() or not sides.any()):
        return _FOUND.empty_table()  # a salt that no vector of the other ring has
    return compared(block)


def listed(signs: int, lists: int, at: Centres | None):
    """(dim, key, pos, rid): each vector that no centre has, in each list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for dim, rows, x in by_length(batches):
            rid = rows.column(0).to_numpy()
            if at is not None:
                free = ~at.owned(dim, x)
                rid, x = rid[free], x[free]
            p = x @ lines(SEED_LISTS, dim, lists * (signs + 1))
            for k in range(lists):
                own = p[:, k * (signs + 1) : (k + 1) * (signs + 1)]
                cell = np.full(len(x), k, np.int64)
                for side in (own[:, 1:] > 0).T:
                    cell = 2 * cell + side
                yield pa.record_batch({"dim": np.full(len(x), dim, np.int32), "key": cell, "pos": own[:, 0].astype(np.float32), "rid": rid})

    return run


def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b): pairs in one window of sorted rows (dim, key, pos, rid); holds a batch and one window."""
    held: list[np.ndarray] | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        new = [batch.column(k).to_numpy() for k in range(4)]
        dim, key, pos, rid = new if held is None else (np.concatenate(x) for x in zip(held, new))
        fresh = len(rid) - batch.num_rows
        for k in range(1, len(rid)):
            j = np.arange(max(k, fresh), len(rid))
            i = j - k
            hit = (key[i] == key[j]) & (dim[i] == dim[j]) & (pos[j] - pos[i] <= WINDOW)
            if not hit.any():
                break
            i, j = rid[i[hit]], rid[j[hit]]
            yield pa.record_batch({"a": np.minimum(i, j), "b": np.maximum(i, j)})
        stay = (key == key[-1]) & (dim == dim[-1]) & (pos[-1] - pos <= WINDOW)
        held = [x[stay] for x in (dim, key, pos, rid)]


def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Those of (a, b, wa, wb, x, y) whose vectors link."""
    for batch in batches:
        for _, rows, y in by_length([batch]):
            x = units(rows.column(4), y.shape[1])
            hit = pa.array(np.einsum("ij,ij->i", x, y) >= SIMILARITY)
            yield pa.RecordBatch.from_arrays([rows.column(k).filter(hit) for k in range(4)], names=["a", "b", "wa", "wb"])


def settled_by_lists(nodes: DataFrame, n: int, at: Centres | None) -> DataFrame:
    """(rid, links, other) of pairs of vectors that belong to no centre."""
    signs = signs_for(n)
    lists = lists_for(signs)
    rows = nodes.select("rid", "embedding").mapInArrow(listed(signs, lists, at), "dim int, key long, pos float, rid long")
    pairs = rows.repartition("dim", "key").sortWithinPartitions("dim", "key", "pos").mapInArrow(windows, "a long, b long")
    counted = pairs.groupBy("a", "b").agg(F.count("*").alias("hits")).where(F.col("hits") >= LEAST_HITS).select("a", "b")
    x = nodes.select(F.col("rid").alias("a"), F.col("weight").alias("wa"), F.col("embedding").alias("x"))
    y = nodes.select(F.col("rid").alias("b"), F.col("weight").alias("wb"), F.col("embedding").alias("y"))
    found = stored(counted.join(x, "a").join(y, "b").select("a", "b", "wa", "wb", "x", "y").mapInArrow(verified, "a long, b long, wa long, wb long"), "links")
    return found.select(F.col("a").alias("rid"), F.col("wb").alias("links"), F.col("b").alias("other")).unionByName(found.select(F.col("b").alias("rid"), F.col("wa").alias("links"), F.col("a").alias("other")))


def fit_to_link(vector: Column) -> Column:
    """Whether a vector can link: some component, all of them finite numbers, not all zero."""
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.coalesce(~F.exists(vector, odd) & F.exists(vector, lambda x: x != 0), F.lit(False))


def link(rows: DataFrame) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of each of (vec_id, embedding)."""
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<float>").alias("embedding"))
    with scratch_space(rows.sparkSession) as keep:
        fit = rows.where(fit_to_link(F.col("embedding")))
        known = F.coalesce("vec_id", F.lit(NO_ID))
        nodes = fit.groupBy("embedding").agg(F.count("*").cast("long").alias("weight"), F.min(known).alias("least"))
        nodes = stored(nodes.select(F.monotonically_increasing_id().alias("rid"), "weight", "least", "embedding"), "vectors")
        n = nodes.count()
        at = centres(nodes, n)
        found = None
        if at is not None:
            around = stored(nodes.select("rid", "weight", "embedding").mapInArrow(near(at), NEAR), "near")
            n -= around.where("own").count()
            found = settled_by_centres(around)
        free = settled_by_lists(nodes, n, at)
        found = stored(free if found is None else found.unionByName(free), "found")
        links = found.groupBy("rid").agg(F.sum("links").alias("links"))
        joined = stored(components(found.select(F.col("rid").alias("a"), F.col("other").alias("b"))), "components").withColumnRenamed("node", "rid")
        least = stored(joined.join(nodes.select("rid", "least"), "rid").groupBy("root").agg(F.min("least").alias("component")), "roots")
        out = nodes.join(links, "rid", "left").join(joined, "rid", "left").join(least, "root", "left")
        out = stored(out.select("least", "weight", "embedding", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "least").alias("component")), "classes")
        once = out.where("weight = 1").select(F.nullif("least", F.lit(NO_ID)).alias("vec_id"), "n_links", "component")
        many = out.where("weight > 1").select("embedding", "n_links", "component")
        if not many.isEmpty():
            once = once.unionByName(fit.join(many, "embedding").select("vec_id", "n_links", "component"))
        alone = rows.where(~fit_to_link(F.col("embedding"))).select("vec_id", F.lit(0).cast("long").alias("n_links"), known.alias("component"))
        every = once.unionByName(alone).withColumn("component_id", F.nullif("component", F.lit(NO_ID)))
        return keep(stored(every.select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept")), "linked"))


def op11_embedding_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link(table(spark, sf_dir, "embeddings"))


SQL = f"""
WITH RECURSIVE fit AS (
    SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
    WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
    SELECT a.vec_id AS a, b.vec_id AS b FROM fit a JOIN fit b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
    WHERE list_inner_product(a.e, b.e) / sqrt(list_inner_product(a.e, a.e) * list_inner_product(b.e, b.e)) >= {SIMILARITY}),
reached AS (
    SELECT a AS vec_id, a AS other FROM links UNION SELECT r.vec_id, l.b FROM reached r JOIN links l ON l.a = r.other)
SELECT e.vec_id, coalesce(n.n_links, 0)::BIGINT AS n_links, coalesce(c.component_id, e.vec_id) AS component_id, e.vec_id = coalesce(c.component_id, e.vec_id) AS kept
FROM embeddings e
LEFT JOIN (SELECT a AS vec_id, count(*) AS n_links FROM links GROUP BY a) n USING (vec_id)
LEFT JOIN (SELECT vec_id, min(other) AS component_id FROM reached GROUP BY vec_id) c USING (vec_id)
"""
