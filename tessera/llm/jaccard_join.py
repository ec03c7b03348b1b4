"""N-gram Jaccard join by MinHash banding, with every link verified on full n-gram sets.

Words are runs without white space, unchanged; a text's set holds its runs of `n` words, or
all its words as one run where there are fewer. Two texts are linked when the Jaccard
similarity of their sets is at least `threshold`.

1. One pass makes MinHash values, band hashes and a 128-bit digest of each set. Texts with
   equal sets become one node with a count, so copies meet no further work.
2. Band hashes are shuffled. Nodes that share one are compared by their signatures, all with all
   where they are few; else leaders, found round by round, are compared with the others, and
   members close to a leader leave with it. A band hash with very many members is first thinned
   in blocks, each around its own centre, and only what is left over meets across blocks. What
   comes out are spanning edges: they grow with the nodes, not with pairs.
3. Components of those edges gather the texts that may be linked. In a component that fits one
   task all pairs are verified: intersections of full sets are counted by products of 0/1
   matrices. In a larger one each set is written as its difference to the component's centre,
   the n-grams that most of a sample have. Two sets with differences D and weights w (n-grams
   missing + threshold * n-grams added) are linked exactly if
   w1 + w2 <= (1 - threshold) * |centre| + (1 + threshold) * |D1 & D2|.
   So all sets of at most half that weight are linked with each other and are only counted;
   each other set is verified against all sets, in blocks of differences. The sample has no
   influence on the result, only on how many sets are near the centre.
4. The verified links give each document its number of links and its class.

Bands and rows come from `banding`: of all splits that keep the chance to miss a pair at the
threshold below 1 - recall, one whose bands have the most rows within `most` hashes, since more
rows mean fewer chance collisions.

Defined results: texts without words (null, empty) have no set, are linked with nothing and are
classes of their own; repeated rows count as copies; the class id is the least doc_id in the
class (a null id counts as the smallest and is given as -2**63). Only id and text are read.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import keyed, scratch_space, slices, stored, table
from tessera.llm.components import components
from tessera.llm.hashing import U64, gram_hashes, mixed, raw, word_digests, words
from tessera.llm.parts import shuffle_partitions

N, THRESHOLD, RECALL, MOST_HASHES = 5, 0.8, 1 - 1e-5, 160
SLICE_BYTES = 1 << 19
#: Bytes of a signature: one of each MinHash value, of the first so many.
SIGNATURE = 128
#: Members of a shared band hash, and bytes of a component's texts or differences, that one task compares at once.
BLOCK_MEMBERS, BLOCK_BYTES = 4096, 8 << 20
#: Members of a shared band hash that are compared all with all, and the estimate of similarity
#: (standard error 0.035 at the threshold) from which they get an edge.
FEW_MEMBERS, SURE = 512, 0.62
#: For more members (standard error 0.044 at most). Below NEAR there is no edge to the leader. From
#: TAKEN on the leader stands for a member: by the triangle inequality of Jaccard distance, what is
#: linked to that member is about NEAR to the leader, or nearer.
NEAR, TAKEN = 0.30, 0.70
#: The same for members that are thinned in blocks: two steps lie between linked members then.
HOT_NEAR, HOT_TAKEN = 0.15, 0.75
#: Texts of a large component, about, that its centre is made of.
CENTRE_SAMPLE = 64
#: Edges that are held before they are reduced to spanning ones.
MOST_EDGES = 1 << 20


def banding(threshold: float = THRESHOLD, recall: float = RECALL, most: int = MOST_HASHES) -> tuple[int, int]:
    """(bands, rows)."""
    best = None
    for rows in range(1, 33):
        bands = math.ceil(math.log(1 - recall) / math.log1p(-(threshold**rows)))
        if bands * rows <= most:
            best = (bands, rows)
    if best is None:
        raise ValueError("no banding reaches the recall within so many hashes")
    return best


def grams(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first): the distinct n-gram hashes of each text, sorted, and where each text's begin."""
    starts, ends, first = words(data, offsets)
    values = word_digests(data, starts, ends)[0]
    counts = np.diff(first)
    all_ = gram_hashes(values, n)
    each = np.maximum(counts - n + 1, 0)
    back = np.cumsum(each) - each
    at = np.repeat(first[:-1] - back, each) + np.arange(each.sum())
    text = np.repeat(np.arange(len(counts)), each)
    found, owners = [all_[at] if len(at) else np.zeros(0, U64)], [text]
    for k in range(1, n):  # a shorter text is one run
        short = np.flatnonzero(counts == k)
        if len(short):
            found.append(gram_hashes(values, k)[first[short]])
            owners.append(short)
    hashes, text = np.concatenate(found), np.concatenate(owners)
    order = np.lexsort((hashes, text))
    hashes, text = hashes[order], text[order]
    fresh = np.ones(len(hashes), bool)
    fresh[1:] = (hashes[1:] != hashes[:-1]) | (text[1:] != text[:-1])
    return hashes[fresh], np.searchsorted(text[fresh], np.arange(len(counts) + 1))


def signatures(docs: DataFrame, n: int, bands: int, rows: int) -> DataFrame:
    """(kd, th, doc_id, n_bytes, size, d1, d2, signature, bands) of every row; size 0 where there are no words."""
    random = np.random.default_rng(71)
    flips = random.integers(0, 1 << 64, bands * rows, dtype=U64)
    factors = random.integers(0, 1 << 64, bands * rows, dtype=U64) | U64(1)

    def sign(batches):
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                data, offsets = raw(part.column(1))
                hashes, first = grams(data, offsets, n)
                size = np.diff(first)
                full = np.flatnonzero(size > 0)
                least = np.zeros((len(size), bands * rows), U64)
                digest = np.zeros((2, len(size)), U64)
                if len(full):
                    for j in range(bands * rows):
                        least[full, j] = np.minimum.reduceat((hashes ^ flips[j]) * factors[j], first[full])
                    for k in (0, 1):
                        digest[k, full] = np.add.reduceat(mixed(hashes * U64(2 * k + 1) + U64(k)), first[full])
                keys = np.zeros((len(size), bands), U64)
                for b in range(bands):
                    h = np.full(len(size), b + 1, U64)
                    for j in range(b * rows, (b + 1) * rows):
                        h = mixed(h + least[:, j])
                    keys[:, b] = h
                sig = (mixed(least[:, :SIGNATURE]) & U64(255)).astype(np.uint8)
                width = sig.shape[1]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(2), part.column(3), part.column(0), pa.array(np.diff(offsets)), pa.array(size, pa.int64()), pa.array(digest[0].view(np.int64)), pa.array(digest[1].view(np.int64)),
                        pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), len(size), [None, pa.py_buffer(np.ascontiguousarray(sig))]).cast(pa.binary()),
                        pa.ListArray.from_arrays(pa.array(np.arange(len(size) + 1) * bands, pa.int32()), pa.array(keys.view(np.int64).ravel())),
                    ],
                    ["kd", "th", "doc_id", "n_bytes", "size", "d1", "d2", "signature", "bands"],
                )

    return keyed(docs).mapInArrow(sign, "kd long, th long, doc_id long, n_bytes long, size long, d1 long, d2 long, signature binary, bands array<long>")


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, root) for the nodes of edges that are not the least of their component."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        least = np.minimum(label[x], label[y])
        following = label.copy()
        np.minimum.at(following, x, least)
        np.minimum.at(following, y, least)
        np.minimum.at(following, label[x], least)
        np.minimum.at(following, label[y], least)
        following = following[following]
        if (following == label).all():
            break
        label = following
    below = label != np.arange(len(nodes))
    return nodes[below], nodes[label[below]]


def leaders(group: np.ndarray, ids: np.ndarray, signature: np.ndarray, near: float = NEAR, taken: float = TAKEN) -> tuple[np.ndarray, np.ndarray]:
    """Edges (a, b) that connect, in each group, all members whose similarity may reach the threshold.

    In each round the first member left of each group leads: it gets an edge to each other one
    that is similar enough, and takes the most similar ones out. What is returned spans the
    edges, so it has fewer rows than members.
    """
    order = np.lexsort((ids, group))
    group, ids, signature = group[order], ids[order], signature[order]
    left = np.arange(len(group))
    out_a, out_b = ids[:0], ids[:0]
    held: list[tuple[np.ndarray, np.ndarray]] = []
    while len(left) > 1:
        g = group[left]
        fresh = np.ones(len(g), bool)
        fresh[1:] = g[1:] != g[:-1]
        lead = left[np.flatnonzero(fresh)[np.cumsum(fresh) - 1]]
        others = ~fresh
        a, b = lead[others], left[others]
        if not len(a):
            break
        like = np.empty(len(a))
        for i in range(0, len(a), 1 << 16):
            like[i : i + (1 << 16)] = (signature[a[i : i + (1 << 16)]] == signature[b[i : i + (1 << 16)]]).mean(1)
        close = like >= near
        held.append((ids[a[close]], ids[b[close]]))
        left = b[like < taken]
        if sum(len(x) for x, _ in held) > MOST_EDGES or len(left) < 2:
            out_a, out_b = forest(np.concatenate([out_a, *(x for x, _ in held)]), np.concatenate([out_b, *(y for _, y in held)]))
            held = []
    return forest(np.concatenate([out_a, *(x for x, _ in held)]), np.concatenate([out_b, *(y for _, y in held)])) if held else (out_a, out_b)


def spanning(group: np.ndarray, ids: np.ndarray, signature: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges of groups of any size: all pairs of the small ones, leaders in the others."""
    _, at, n = np.unique(group, return_inverse=True, return_counts=True)
    few = n[at] <= FEW_MEMBERS
    one = leaders(group[few], ids[few], signature[few], SURE, 2.0)
    two = leaders(group[~few], ids[~few], signature[~few])
    return np.concatenate([one[0], two[0]]), np.concatenate([one[1], two[1]])


def thinned(ids: np.ndarray, signature: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, left) of one block: edges to the member that stands for others, and the members that still stand.

    The most frequent byte of each place of the signatures is the block's centre; members close to
    it hang on the one that is closest.
    """
    centre = np.array([np.bincount(column, minlength=256).argmax() for column in signature.T], np.uint8)
    like = (signature == centre).mean(1)
    close = like >= HOT_TAKEN
    if not close.any():
        return ids[:0], ids[:0], ids
    head = int(np.lexsort((ids, -like))[0])
    gone = close.copy()
    gone[head] = False
    # what is not close to the centre stays, and is compared with the head elsewhere
    return ids[gone], np.full(int(gone.sum()), ids[head]), ids[~gone]


def calls(group: str, split: Column | str, buckets: int) -> tuple[Column, Column]:
    """(bucket, alone): what is checked in one call; a group of something that was split is alone, others share a bucket."""
    split = F.col(split) if isinstance(split, str) else split
    return F.pmod(group, F.lit(buckets)).cast("int").alias("bucket"), F.when(split, F.col(group)).alias("alone")


def in_blocks(blocks: str, own: str) -> Column:
    """The pairs (i, j) of blocks in which a member of block `own` takes part."""
    return F.transform(F.sequence(F.lit(0), F.col(blocks) - 1), lambda j: F.struct(F.least(own, j).alias("i"), F.greatest(own, j).alias("j")))


def signature_array(rows: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(rows["signature"].to_pylist()), np.uint8).reshape(rows.num_rows, -1)


def edges_of(a: np.ndarray, b: np.ndarray) -> pa.Table:
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def candidate_edges(nodes: DataFrame) -> DataFrame:
    """(a, b): edges that span all pairs which share a band hash and may be similar enough."""
    buckets = shuffle_partitions(nodes.sparkSession)
    members = nodes.select(F.col("node"), F.explode("bands").alias("band"))
    shared = stored(members.groupBy("band").agg(F.count("*").alias("n")).where("n > 1"), "shared-bands")
    signature = nodes.select("node", "signature")

    def compare(key, rows):
        return edges_of(*spanning(rows["group"].to_numpy(), rows["node"].to_numpy(), signature_array(rows)))

    usual = members.join(shared.where(F.col("n") <= BLOCK_MEMBERS), "band").select("node", F.col("band").alias("group"))
    usual = usual.join(signature, "node").select("node", "group", "signature", *calls("group", F.lit(False), buckets))
    found = usual.groupBy("bucket", "alone").applyInArrow(compare, "a long, b long")
    hot = shared.where(F.col("n") > BLOCK_MEMBERS)
    if not hot.isEmpty():
        found = found.unionByName(hot_edges(members.join(hot, "band"), signature, buckets))
    return found.distinct()


def hot_edges(held: DataFrame, signature: DataFrame, buckets: int) -> DataFrame:
    """The edges of band hashes with very many members: blocks are thinned first, then what is left is compared."""
    own = F.pmod(F.xxhash64("node"), F.ceil(F.col("n") / BLOCK_MEMBERS)).cast("int")
    dealt = held.select("node", "band", F.xxhash64("band", own).alias("group")).join(signature, "node")

    def thin(key, rows):
        a, b, left = thinned(rows["node"].to_numpy(), signature_array(rows))
        band = rows["band"][0].as_py()
        none = [None] * len(left)
        return pa.table({
            "a": pa.array([*a.tolist(), *left.tolist()], pa.int64()), "b": pa.array([*b.tolist(), *none], pa.int64()),
            "band": pa.array([None] * len(a) + [band] * len(left), pa.int64()),
        })

    first = stored(dealt.groupBy("group").applyInArrow(thin, "a long, b long, band long"), "thinned")
    left = first.where("b IS NULL").select(F.col("a").alias("node"), "band")
    n = left.groupBy("band").agg(F.count("*").alias("n"))
    left = left.join(n, "band").withColumn("blocks", F.ceil(F.col("n") / BLOCK_MEMBERS).cast("int"))
    left = left.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    left = left.select("node", "band", "blocks", F.explode(in_blocks("blocks", "own")).alias("pair"))
    left = left.select("node", F.xxhash64("band", "pair.i", "pair.j").alias("group")).join(signature, "node")

    def compare(key, rows):
        return edges_of(*leaders(rows["group"].to_numpy(), rows["node"].to_numpy(), signature_array(rows), HOT_NEAR))

    return first.where("b IS NOT NULL").select("a", "b").unionByName(left.groupBy("group").applyInArrow(compare, "a long, b long"))


def linked(hashes: np.ndarray, first: np.ndarray, base: np.ndarray, left: np.ndarray, right: np.ndarray, slack: float, threshold: float, step: int = 512, width: int = 2048):
    """(rows of left, their 0/1 links to right) in steps, for sets given by number.

    Sets i and j are linked if base[i] + base[j] <= slack + (1 + threshold) * |i & j|.
    """
    texts = np.unique(np.concatenate([left, right]))
    each = np.diff(first)[texts]
    back = np.cumsum(each) - each
    flat = hashes[np.repeat(first[texts] - back, each) + np.arange(each.sum())]
    owner = np.repeat(np.arange(len(texts)), each)
    # a gram that one text alone has adds to no intersection
    found, number, times = np.unique(flat, return_inverse=True, return_counts=True)
    kept = times[number] > 1
    number, owner = (np.cumsum(times > 1) - 1)[number[kept]], owner[kept]
    grams_ = int((times > 1).sum())
    by_gram = np.argsort(number, kind="stable")
    number, owner = number[by_gram], owner[by_gram]
    at_left, at_right = np.searchsorted(texts, left), np.searchsorted(texts, right)
    for i in range(0, len(left), step):
        rows = at_left[i : i + step]
        both = np.zeros((len(rows), len(right)), np.float32)
        for c in range(0, grams_, width):
            lo, hi = np.searchsorted(number, (c, c + width))
            m = np.zeros((len(texts), min(width, grams_ - c)), np.float32)
            m[owner[lo:hi], number[lo:hi] - c] = 1
            both += m[rows] @ m[at_right].T
        # intersections are whole numbers, so the small slack only absorbs rounding
        yield slice(i, i + step), base[left[i : i + step], None] + base[None, right] <= slack + (1 + threshold) * both.astype(np.float64) + 1e-6


def verify(hashes: np.ndarray, first: np.ndarray, base: np.ndarray, slack: np.ndarray, group: np.ndarray, block: np.ndarray, cross: np.ndarray, ids: np.ndarray, copies: np.ndarray, threshold: float):
    """(links, root) of each set in each group: linked copies, and a linked set with the least id that is known.

    block: 0 or 1; in a cross group only pairs of different blocks count.
    """
    order = np.lexsort((ids, group))
    edges = np.flatnonzero(np.diff(group[order])) + 1
    links, root = np.zeros(len(ids), np.int64), ids.copy()
    for members in np.split(order, edges):
        if len(members) < 2:
            continue
        if cross[members[0]]:
            left, right = members[block[members] == 0], members[block[members] == 1]
        else:
            left = right = members
        if not len(left) or not len(right):
            continue
        label = {int(m): k for k, m in enumerate(members)}
        at_l, at_r = np.array([label[int(m)] for m in left]), np.array([label[int(m)] for m in right])
        labels = np.arange(len(members))
        for rows, hit in linked(hashes, first, base, left, right, slack[members[0]], threshold):
            own = left[rows]
            if left is right:
                hit[np.arange(len(own)), np.arange(rows.start, rows.start + len(own))] = False
            links[own] += hit @ copies[right]
            if left is not right:
                links[right] += copies[own] @ hit
            for k, h in zip(at_l[rows], hit):
                near = labels[at_r[h]]
                if len(near):
                    mine = np.unique(np.append(near, labels[k]))
                    if len(mine) > 1:
                        labels[np.isin(labels, mine[1:])] = mine[0]
        root[members] = ids[members[labels]]
    return links, root


LINKS = "node long, links long, root long, whole boolean"


def verified(nodes: DataFrame, docs: DataFrame, n: int, threshold: float) -> DataFrame:
    """(node, links, root, whole): verified links of every node that has any candidates, once for each task it was in.

    whole: the task had all candidates of its nodes, so its roots are final.
    """
    buckets = 4 * shuffle_partitions(nodes.sparkSession)
    roots = stored(components(candidate_edges(nodes)), "candidates")
    held = nodes.select("node", "kd", "th", "n_bytes", "copies").join(roots, "node")
    weight = held.groupBy("root").agg(F.ceil(F.sum(F.col("n_bytes") + 512) / BLOCK_BYTES).cast("int").alias("blocks"), F.count("*").alias("members"))
    held = stored(held.join(weight, "root").drop("n_bytes"), "held")
    # copies of one set may have different texts and equal keys; any one of them has the node's set.
    # Candidates grow with the corpus, so the same join is used at every size.
    texts = keyed(docs).select("kd", "th", "text").join(held.hint("merge"), ["kd", "th"]).dropDuplicates(["node"])

    def check(key, rows):
        hashes, first = grams(*raw(rows["text"]), n)
        get = lambda c: rows[c].to_numpy()
        zero = np.zeros(rows.num_rows, np.int64)
        # links by sizes and intersections: t * (s1 + s2) <= (1 + t) * |1 & 2|
        links, root = verify(hashes, first, threshold * np.diff(first), zero.astype(float), get("root"), zero, zero.astype(bool), get("node"), get("copies"), threshold)
        return pa.table({"node": rows["node"], "links": pa.array(links), "root": pa.array(root), "whole": pa.array(np.ones(len(links), bool))})

    small = texts.where("blocks = 1").select("node", "copies", "text", "root", *calls("root", F.lit(False), buckets)).groupBy("bucket").applyInArrow(check, LINKS)
    if held.where("blocks > 1").isEmpty():
        return small
    return small.unionByName(large_components(texts.where("blocks > 1"), n, threshold))


def large_components(texts: DataFrame, n: int, threshold: float) -> DataFrame:
    """The same for components of more than one block: (node, copies, root, members, text)."""
    sampled = texts.where(F.pmod(F.xxhash64("node", F.lit("centre")), F.ceil(F.col("members") / CENTRE_SAMPLE)) == 0).select("root", "text")

    def middle(key, rows):
        hashes, first = grams(*raw(rows["text"]), n)
        found, times = np.unique(hashes, return_counts=True)
        return pa.table({"root": pa.array([key[0].as_py()], pa.int64()), "centre": pa.array([found[2 * times > rows.num_rows].tobytes()], pa.binary())})

    centres = stored(sampled.groupBy("root").applyInArrow(middle, "root long, centre binary"), "centres")

    def compared(batches):
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                get = lambda c: part.column(part.schema.get_field_index(c))  # noqa: E731, B023
                hashes, first = grams(*raw(get("text")), n)
                out = []
                for i, centre in enumerate(get("centre").to_pylist()):
                    own, middle_ = hashes[first[i] : first[i + 1]], np.frombuffer(centre or b"", U64)
                    more, less = np.setdiff1d(own, middle_, True), np.setdiff1d(middle_, own, True)
                    out.append((len(less) + threshold * len(more), len(middle_), np.concatenate([less, more]).tobytes()))
                weights, sizes, bodies = zip(*out) if out else ((), (), ())
                yield pa.RecordBatch.from_arrays(
                    [get("node"), get("copies"), get("root"), pa.array(weights, pa.float64()), pa.array([(1 - threshold) * k for k in sizes], pa.float64()), pa.array(bodies, pa.binary())],
                    ["node", "copies", "root", "w", "slack", "body"],
                )

    rows = texts.select("node", "copies", "root", "text").join(centres, "root", "left")
    sets = stored(rows.mapInArrow(compared, "node long, copies long, root long, w double, slack double, body binary"), "differences")
    core = F.col("w") * 2 <= F.col("slack") - 1e-6
    inner = sets.where(core)
    total = inner.groupBy("root").agg(F.sum("copies").alias("total"), F.min("node").alias("least"))
    counted = inner.join(total, "root").select("node", (F.col("total") - F.col("copies")).alias("links"), F.col("least").alias("root"), F.lit(False).alias("whole"))
    sized = sets.withColumn("side", F.when(core, 1).otherwise(0)).withColumn("n", F.octet_length("body") + 1024)
    blocks = sized.groupBy("root").agg(*[F.ceil(F.sum(F.when(F.col("side") == k, F.col("n")).otherwise(0)) / BLOCK_BYTES).cast("int").alias(f"blocks{k}") for k in (0, 1)])
    blocks = blocks.where("blocks0 > 0")
    dealt = sized.join(blocks, "root")
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("node"), F.when(F.col("side") == 0, F.col("blocks0")).otherwise(F.col("blocks1"))).cast("int"))
    # rim with rim: pairs of blocks; rim with core: each block of one with each of the other
    rim, inside = dealt.where("side = 0"), dealt.where("side = 1")
    pair = rim.select("*", F.explode(in_blocks("blocks0", "own")).alias("pair"))
    pair = pair.select("node", "copies", "w", "slack", "body", F.xxhash64("root", F.lit(0), "pair.i", "pair.j").alias("group"), (F.col("own") == F.col("pair.j")).cast("int").alias("block"), (F.col("pair.i") != F.col("pair.j")).alias("cross"))
    every = lambda df, blocks_: df.where(F.col(blocks_) > 0).select("*", F.explode(F.sequence(F.lit(0), F.col(blocks_) - 1)).alias("other"))
    mixed_ = every(rim, "blocks1").withColumns({"i": F.col("own"), "j": F.col("other")}).unionByName(every(inside, "blocks0").withColumns({"i": F.col("other"), "j": F.col("own")}))
    mixed_ = mixed_.select("node", "copies", "w", "slack", "body", F.xxhash64("root", F.lit(1), "i", "j").alias("group"), F.col("side").alias("block"), F.lit(True).alias("cross"))

    def check(key, rows):
        bodies = rows["body"].to_pylist()
        hashes = np.frombuffer(b"".join(bodies), U64)
        first = np.concatenate([[0], np.cumsum([len(x) // 8 for x in bodies])])
        get = lambda c: rows[c].to_numpy()
        links, root = verify(hashes, first, get("w"), get("slack"), get("group"), get("block"), get("cross"), get("node"), get("copies"), threshold)
        return pa.table({"node": rows["node"], "links": pa.array(links), "root": pa.array(root), "whole": pa.array(np.zeros(len(links), bool))})

    return counted.unionByName(pair.unionByName(mixed_).groupBy("group").applyInArrow(check, LINKS))


def join(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """(doc_id, kd, th, class_id, n_links, first) of every row; first marks the rows with the class's least key."""
    with scratch_space(docs.sparkSession) as keep:
        return _joined(docs, n, threshold, recall, keep)


def _joined(docs: DataFrame, n: int, threshold: float, recall: float, keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    bands, rows = banding(threshold, recall)
    signed = stored(signatures(docs, n, bands, rows), "signatures")
    nodes = signed.where("size > 0").groupBy("d1", "d2").agg(
        F.min(F.struct("kd", "th")).alias("k"), F.count("*").alias("copies"), F.first("n_bytes").alias("n_bytes"), F.first("signature").alias("signature"), F.first("bands").alias("bands")
    )
    nodes = stored(nodes.select("d1", "d2", "k.kd", "k.th", "copies", "n_bytes", "signature", "bands").withColumn("node", F.monotonically_increasing_id()), "nodes")
    found = stored(verified(nodes, docs, n, threshold), "links")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    roots = found.where("whole").select("node", "root")
    dealt = found.where("NOT whole")
    if not dealt.isEmpty():
        roots = roots.unionByName(components(dealt.select(F.col("node").alias("a"), F.col("root").alias("b"))))
    least = nodes.select("node", "kd", "th", "d1", "d2", "copies").join(links, "node", "left").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    of_class = least.groupBy("root").agg(F.min(F.struct("kd", "th")).alias("first_key"))
    named = least.join(of_class, "root").select("d1", "d2", "first_key", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    out = signed.select("doc_id", "kd", "th", "size", "d1", "d2").join(stored(named, "classes"), ["d1", "d2"], "left")
    alone = F.col("size") == 0
    first = alone | ((F.col("kd") == F.col("first_key.kd")) & (F.col("th") == F.col("first_key.th")))
    out = out.select("doc_id", "kd", "th", F.when(alone, F.col("kd")).otherwise(F.col("first_key.kd")).alias("class_id"), F.when(alone, 0).otherwise(F.col("n_links")).cast("long").alias("n_links"), first.alias("first"))
    return keep(stored(out, "joined"))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links")


SQL = f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
g AS (SELECT DISTINCT r, array_to_string(w[i:i + {N - 1}], ' ') AS gram FROM (SELECT r, w, unnest(range(1, greatest(len(w) - {N} + 1, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT r, count(*) AS n FROM g GROUP BY r),
x AS (SELECT a.r AS a, b.r AS b, count(*) AS c FROM g a JOIN g b ON a.gram = b.gram AND a.r <> b.r GROUP BY a.r, b.r),
l AS (SELECT x.a, x.b FROM x JOIN n p ON x.a = p.r JOIN n q ON x.b = q.r WHERE c * 10 >= {round(THRESHOLD * 10)} * (p.n + q.n - c)),
t AS (SELECT r AS a, r AS b FROM d UNION SELECT t.a, l.b FROM t JOIN l ON t.b = l.a),
k AS (SELECT t.a AS r, min(doc_id) AS class_id FROM t JOIN d ON t.b = d.r GROUP BY t.a),
m AS (SELECT a AS r, count(*) AS n_links FROM l GROUP BY a)
SELECT doc_id, class_id, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links FROM d JOIN k USING (r) LEFT JOIN m USING (r)
"""
