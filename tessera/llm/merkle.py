"""Merkle manifest of a table: a tree of hashes for each group, one root, and a proof for each row.

Rows are leaves. A group's leaves are numbered in order; every `ARITY` consecutive nodes become
the hash of their hashes, until one is left, the group's subroot. The subroots, in the order of
their groups, give the root in the same way. Trees are built by supersteps over RDDs: children send
their hashes to their parents, a parent that has all its children hashes them and sends on. In the
reverse supersteps a parent sends each child the hashes of its siblings and all that it was sent
itself, so that a leaf gets what it needs to prove that it belongs to the root.

A leaf is the SHA-256 of its fields, each `-` if null, else its length in bytes, `:` and its
value. Hashes are joined and hashed again as lowercase hexadecimal text.

Numbering sorts by ranges of (group, id, leaf), so a group is spread over tasks whatever its size;
counts of a group in a range give the offsets. A message goes to (group, number of the parent), at
most `ARITY` to each. Levels are written to shared storage, so a lost executor costs one superstep.

Defined results: a null group is the first group; null ids come first, and rows with one id are
ordered by their leaf hash; rows that repeat all fields are leaves of their own; null and empty
texts differ; a lone leaf is its subroot, a lone subroot the root; an empty table gives no row.
Only the named columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

from pyspark import RDD
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.common import scratch_space, stored, table

ARITY = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Rows of a level for each partition of the superstep that sends them.
ROWS_A_PART = 50_000

NODE = "g long, i long, n long, h string, kids string"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def leaf_hash(fields: list[Column]) -> Column:
    """The hash of a row's fields, each with its length, so that no two rows share an encoding."""
    coded = [F.coalesce(F.concat(F.octet_length(f.cast("string")).cast("string"), F.lit(":"), f.cast("string")), F.lit("-")) for f in fields]
    return F.sha2(F.concat(*coded), 256)


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


class Forest(NamedTuple):
    """Levels of nodes (g, i, n, h, kids), leaves first: node i of n on its level of tree g; kids are the joined hashes below it."""

    levels: list[DataFrame]

    def tops(self) -> DataFrame:
        """(g, h): each tree's last node."""
        out = None
        for level in self.levels:
            top = level.where("n = 1").select("g", "h")
            out = top if out is None else out.unionByName(top)
        return out


def numbered(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """The rows with g, the number of their group in order, i, their number in it, and n, its rows; all from 0, nulls first."""
    tied = rows.withColumn("__tie", F.monotonically_increasing_id())
    ranged = tied.repartitionByRange(group, *order, "__tie").sortWithinPartitions(group, *order, "__tie").drop("__tie")
    placed = stored(ranged.withColumn("__at", F.monotonically_increasing_id()), "leaves")
    part = F.shiftright("__at", 33)
    counts = placed.groupBy(part.alias("__part"), F.col(group).alias("__group")).agg(F.count("*").alias("__rows"), F.min("__at").alias("__first"))
    of_group = W.partitionBy("__group").orderBy("__part")
    counts = stored(counts.withColumns({"__before": F.sum("__rows").over(of_group) - F.col("__rows"), "n": F.sum("__rows").over(W.partitionBy("__group"))}), "counts")
    groups = group_numbers(counts.select("__group").distinct())
    spans = counts.join(groups, F.col("__group").eqNullSafe(F.col("__name"))).drop("__name")
    # a key is a group within one range of rows, so no key has more rows than a task
    out = placed.join(spans, (part == F.col("__part")) & F.col(group).eqNullSafe(F.col("__group")))
    return out.select(*rows.columns, "g", (F.col("__before") + F.col("__at") - F.col("__first")).alias("i"), "n")


def group_numbers(groups: DataFrame) -> DataFrame:
    """(__name, g): groups numbered in order from 0, nulls first."""
    ordered = stored(groups.repartitionByRange("__group").sortWithinPartitions("__group").select(F.col("__group").alias("__name"), F.monotonically_increasing_id().alias("__at")), "groups")
    part = F.shiftright("__at", 33)
    sizes = {r[0]: r[1] for r in ordered.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()}  # a row for each partition
    before, total = {}, 0
    for p in sorted(sizes):
        before[p] = total - (p << 33)
        total += sizes[p]
    offsets = F.create_map(*[F.lit(x) for p in before for x in (p, before[p])]) if before else F.create_map()
    return ordered.select("__name", (F.col("__at") + F.element_at(offsets, part)).alias("g") if before else F.col("__at").alias("g"))


def completed(message: tuple) -> tuple:
    """The parent of the children that have sent their (place, hash, nodes on their level)."""
    (g, i), sent = message
    children = sorted(sent)
    n = children[0][2]
    if [c[0] for c in children] != list(range(min(ARITY, n - ARITY * i))):
        raise RuntimeError(f"node {i} of tree {g} has not heard from all its children")
    kids = "".join(c[1] for c in children)
    return g, i, -(-n // ARITY), digest(kids), kids


def climbed(leaves: DataFrame) -> Forest:
    """The trees over leaves (g, i, n, h), a superstep a level."""
    spark, levels = leaves.sparkSession, [leaves]
    most = leaves.agg(F.max("n")).first()[0] or 0
    while most > 1:
        open_ = levels[-1].where("n > 1").select("g", "i", "n", "h")
        parts = max(1, open_.count() // ROWS_A_PART)
        sent = open_.rdd.map(lambda r: ((r[0], r[1] // ARITY), (r[1] % ARITY, r[3], r[2])))
        parents = sent.groupByKey(parts).map(completed)
        levels.append(stored(spark.createDataFrame(parents, NODE), "nodes"))
        most = -(-most // ARITY)
    return Forest(levels)


def around(kids: str, j: int) -> tuple[str, str]:
    """The hashes on the left and on the right of child j."""
    return kids[: 64 * j], kids[64 * (j + 1) :]


def vertices(level: DataFrame) -> RDD:
    return level.select("g", "i", "kids").rdd.map(lambda r: ((r[0], r[1]), r[2]))


def descended(forest: Forest, starts: RDD, down_to: int) -> RDD:
    """((g, i), path) of the nodes of one level; a path is a tuple of (left, right), the nearest siblings first.

    starts: (g, path) of the trees' last nodes.
    """
    paths = None
    for k in range(len(forest.levels) - 1, down_to - 1, -1):
        level = forest.levels[k]
        heads = level.where("n = 1").select("g").rdd.map(lambda r: (r[0], None)).join(starts, level.rdd.getNumPartitions()).map(lambda x: ((x[0], 0), x[1][1]))
        paths = heads if paths is None else paths.union(heads)
        if k > down_to:
            parts = max(1, level.rdd.getNumPartitions())
            paths = vertices(level).join(paths, parts).flatMap(lambda x: [((x[0][0], x[0][1] * ARITY + j), (around(x[1][0], j), *x[1][1])) for j in range(len(x[1][0]) // 64)])
    return paths


def folded(h: str, path: tuple) -> str:
    """The root that a leaf's hash leads to."""
    for left, right in path:
        h = digest(left + h + right)
    return h


def proved(message: tuple, root: str) -> Iterator[tuple]:
    """(doc_id, leaf, subroot, root, proof, folded, verified) of the leaves below one node."""
    _, (leaves, above) = message
    (kids, subroot, path) = next(iter(above))
    for place, doc_id, leaf, now in leaves:
        own = (around(kids, place), *path) if kids else path
        proof = digest("".join(left + right for left, right in own))
        back = folded(now, own)
        yield doc_id, leaf, subroot, root, proof, back, back == root


PROOF = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def verify(leaves: DataFrame, group: str) -> DataFrame:
    """A proof for each of (doc_id, leaf, now, group): leaf as it was when the manifest was made, now as it is found."""
    spark = leaves.sparkSession
    with scratch_space(spark) as keep:
        rows = stored(numbered(leaves, group, ["doc_id", "leaf"]), "numbered")
        forest = climbed(rows.select("g", "i", "n", F.col("leaf").alias("h"), F.lit(None).cast("string").alias("kids")))
        tops = stored(forest.tops(), "subroots")
        n = tops.count()
        if not n:
            return keep(stored(spark.createDataFrame([], PROOF), "proofs"))
        above = climbed(tops.select(F.lit(0).cast("long").alias("g"), F.col("g").alias("i"), F.lit(n).cast("long").alias("n"), "h", F.lit(None).cast("string").alias("kids")))
        root = above.tops().first()["h"]
        starts = descended(above, spark.sparkContext.parallelize([(0, ())], 1), 0).map(lambda x: (x[0][1], x[1]))
        starts = tops.rdd.map(lambda r: (r[0], r[1])).join(starts).map(lambda x: (x[0], ((x[1][0],), *x[1][1])))  # the subroot travels in front
        # the lowest parents keep the hashes below them; a lone leaf has none, and hangs on its tree's start
        low = 1 if len(forest.levels) > 1 else 0
        paths = descended(Forest(forest.levels[low:]), starts, 0) if low else None
        parents = vertices(forest.levels[1]).join(paths).map(lambda x: (x[0], (x[1][0], *parted(x[1][1])))) if low else None
        lone = rows.where("n = 1").select("g").rdd.map(lambda r: (r[0], None)).join(starts).map(lambda x: ((x[0], -1), (None, *parted(x[1][1]))))
        heard = parents.union(lone) if low else lone
        sent = rows.select("g", "i", "n", "doc_id", "leaf", "now").rdd.map(lambda r: ((r[0], r[1] // ARITY if r[2] > 1 else -1), (r[1] % ARITY, r[3], r[4], r[5])))
        parts = max(1, rows.count() // ROWS_A_PART)
        out = sent.cogroup(heard, numPartitions=parts).flatMap(lambda x: proved(x, root))
        return keep(stored(spark.createDataFrame(out, PROOF), "proofs"))


def parted(path: tuple) -> tuple[str, tuple]:
    """(subroot, path) of a path in which the subroot travels."""
    at = next(k for k, step in enumerate(path) if len(step) == 1)
    return path[at][0], path[:at] + path[at + 1 :]


def tampered(text: Column, doc_id: Column) -> Column:
    """The text with A-Z in lower case where 3 divides the id's CRC; other texts, and those without an id, as they are."""
    return F.when(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 0, F.translate(text, UPPER, LOWER)).otherwise(text)


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(*FIELDS)
    fields = {c: F.col(c) for c in FIELDS}
    changed = fields | {"text": tampered(F.col("text"), F.col("doc_id"))}
    return verify(docs.select("doc_id", F.col("lang").alias("branch"), leaf_hash([*fields.values()]).alias("leaf"), leaf_hash([*changed.values()]).alias("now")), "branch")


#: Levels of ARITY that the SQL unrolls: 16 million leaves a group.
SQL_LEVELS = 8

#: The CRC by bits: a byte is taken in, then eight shifts follow (-1).
CRC_SQL = "xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))), lambda a, e: CASE WHEN e >= 0 THEN xor(a, e) WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384::BIGINT) ELSE a >> 1 END), 4294967295::BIGINT)"


def _tree_sql(name: str, start: str) -> str:
    """CTEs: nodes of each level of the trees in `start` (g, i, h), with what stands left and right of each."""
    out = []
    for k in range(SQL_LEVELS):
        out.append(f"""{name}{k} AS (
            SELECT *, count(*) OVER (PARTITION BY g) AS n,
                coalesce(string_agg(h, '') OVER (PARTITION BY g, i // {ARITY} ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
                coalesce(string_agg(h, '') OVER (PARTITION BY g, i // {ARITY} ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
            FROM {f"({start})" if k == 0 else f"(SELECT g, i // {ARITY} AS i, CASE WHEN max(n) > 1 THEN sha256(string_agg(h, '' ORDER BY i)) ELSE max(h) END AS h FROM {name}{k - 1} GROUP BY g, i // {ARITY})"})""")
    return ",\n".join(out)


def _sql() -> str:
    field = lambda c: f"coalesce(strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')"
    leaf = lambda text: "sha256(" + " || ".join(field(c) if c != "text" else field(text) for c in FIELDS) + ")"
    lowered = f"CASE WHEN {CRC_SQL} % 3 = 0 THEN translate(text, '{UPPER}', '{LOWER}') ELSE text END"
    steps = [(f"t{k}", "g", f"i // {ARITY**k}") for k in range(SQL_LEVELS)] + [(f"s{k}", "0", f"g // {ARITY**k}") for k in range(SQL_LEVELS)]
    fold, previous = [], "SELECT g, i, doc_id, h, now AS back, '' AS proof FROM leaves"
    for k, (level, g, i) in enumerate(steps):
        # beyond a tree's last node nothing is hashed any more
        fold.append(f"""f{k} AS (SELECT p.g, p.i, p.doc_id, p.h, p.proof || CASE WHEN x.n > 1 THEN x.l || x.r ELSE '' END AS proof,
            CASE WHEN x.n > 1 THEN sha256(x.l || p.back || x.r) ELSE p.back END AS back
            FROM ({previous}) p JOIN {level} x ON x.g = {"p.g" if g == "g" else g} AND x.i = {i.replace("i //", "p.i //").replace("g //", "p.g //")})""")
        previous = f"SELECT * FROM f{k}"
    return f"""
    WITH leaves AS (
        SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, h) - 1 AS i
        FROM (SELECT dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS g, doc_id, {leaf("text")} AS h, {leaf(f"({lowered})")} AS now FROM documents)),
    {_tree_sql("t", "SELECT g, i, h FROM leaves")},
    {_tree_sql("s", f"SELECT 0 AS g, g AS i, h FROM t{SQL_LEVELS - 1}")},
    {", ".join(fold)}
    SELECT f.doc_id, f.h AS leaf, t.h AS subroot, s.h AS root, sha256(f.proof) AS proof_sha256, f.back AS folded_root, f.back = s.h AS verified
    FROM f{len(steps) - 1} f JOIN t{SQL_LEVELS - 1} t ON t.g = f.g CROSS JOIN s{SQL_LEVELS - 1} s"""


SQL = _sql()
