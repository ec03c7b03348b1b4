"""Language identification by prediction by partial matching.

Each language has a variable-order context tree over bytes, counted on labelled texts and then
frozen. A byte costs the exact code length that the tree gives it: the longest known context
predicts it, or escapes (method C: the number of distinct bytes seen there counts as escapes)
to the next shorter one, in which bytes already ruled out are excluded; below order 0 all
bytes are equally likely. The language whose tree codes a text in the fewest bits is predicted.

Frozen trees make the cost a function of (longest known context, byte), so it is tabulated
once; scoring a text is then a lookup for every byte of it, in numpy, with no loop over bytes.

Fitting takes a bounded sample of labelled rows: at most `per_label` distinct texts of each label,
those with the smallest hashes, whole. Hashes are ranked before any text is moved, and texts that
repeat count once, so the sample is bounded whatever the rows are. Every label of the rows is
learned, with up to `CONTEXTS` contexts each. Labels are fitted in tasks by groups of `GROUP` and
scored in passes over these groups, so that a worker holds the tables of one group however many
labels there are; which labels share a group changes no code length. Counts of all groups are sent
to the workers, packed (some megabytes each).

Defined results: `und` with score 0 if the text is null, has no letter, or nothing was learned; a
label `und` of the rows is learned like any other; ties go to the label that sorts first. The score
is the share of the winner among the languages' probabilities per byte, and `bits` the winner's
bits a byte. Repeated rows each get their row; a text is scored whole whatever its length.
"""

from __future__ import annotations

import pickle
import zlib
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.common import scratch_space, slices, stored, table
from tessera.llm.hashing import raw

ORDER = 3
UND = "und"
#: Texts of each label that are learned.
PER_LABEL = 300
#: Labels whose tables are held at once.
GROUP = 4
#: Contexts in the tree of a label; rarer ones are left out beyond it, in each label alike.
CONTEXTS = 8_000
#: Salts in which the hashes of a label are ranked first.
SALTS = 64
#: Sampled texts up to which the table of their hashes is broadcast: some 30 MB.
FEW_SAMPLED = 1_000_000
#: Bytes of sampled texts that are counted at once.
COUNT_BYTES = 1 << 22
#: Bytes of text that go through all groups before the next ones, where there is more than one.
PASS_BYTES = 1 << 25

FIELDS = "lang_pred string, score double, bits double"


def contexts(data: np.ndarray, offsets: np.ndarray, order: int) -> np.ndarray:
    """The last `order` bytes before each place as a number; a text starts after zero bytes."""
    out = np.zeros(len(data), np.uint32)
    for k in range(1, order + 1):
        before = np.zeros(len(data), np.uint32)
        before[k:] = data[:-k]
        for j in range(k):  # places that reach beyond the start of their text
            at = offsets[:-1] + j
            before[at[at < offsets[1:]]] = 0
        out |= before << np.uint32(8 * (k - 1))
    return out


class ContextTrees:
    """Cost tables for all labels: costs[label, node, byte] in bits, and the node of each context.

    A node is a context that some label's sample has; a label that lacks it uses its own longest
    known suffix of it. `nodes` maps the last ORDER bytes to the longest such context. The tables
    are made from the counts when they are first used, so that counts alone are sent around.
    """

    def __init__(self, samples: dict[str, list[bytes]], order: int = ORDER, most: int = CONTEXTS):
        self.order, self.labels = order, sorted(samples)
        counted = [self._counts(samples[k], order) for k in self.labels]
        # each label keeps its own most frequent contexts, whatever other labels it is held with; a context is
        # at most as frequent as its suffixes, so a bound on the frequency keeps the suffixes of what it keeps
        kept = [self._frequent(c, most) for c in counted]
        self.known = [np.unique(np.concatenate([k[o] for k in kept])) for o in range(order + 1)] if kept else [np.zeros(0, np.uint32)] * (order + 1)
        self.begins = np.cumsum([0] + [len(k) for k in self.known])
        self.counted = [[tuple(x[np.isin(c[o][0], k[o])] for x in c[o]) for o in range(order + 1)] for c, k in zip(counted, kept)]

    @staticmethod
    def _frequent(counts: list[tuple[np.ndarray, np.ndarray, np.ndarray]], most: int) -> list[np.ndarray]:
        """For each order the contexts that are more frequent than the one after the first `most`, and that of order 0."""
        own, times = [], []
        for found, _, n in counts:
            different, of = np.unique(found, return_inverse=True)
            own.append(different)
            times.append(np.bincount(of, n, len(different)))
        total = np.sort(np.concatenate(times))[::-1]
        least = 0 if len(total) <= most else total[most]
        return [k[(n > least) | (o == 0)] for o, (k, n) in enumerate(zip(own, times))]

    @cached_property
    def costs(self) -> np.ndarray:
        known, begins = self.known, self.begins
        costs = np.zeros((len(self.labels), max(1, int(begins[-1])), 256), np.float32)
        for i, counts in enumerate(self.counted):
            # below order 0 every byte that is left is equally likely: 8 bits
            parent_p = np.full((1, 256), 1 / 256)
            for o in range(self.order + 1):
                contexts_o = known[o]
                up = parent_p[self._parents(contexts_o, o)] if o else np.repeat(parent_p, len(contexts_o), 0)
                p = self._mixed(contexts_o, counts[o], up)
                costs[i, begins[o] : begins[o + 1]] = -np.log2(p)
                parent_p = p
        return costs

    def _parents(self, contexts_o: np.ndarray, o: int) -> np.ndarray:
        """Where the context without its oldest byte is, among those of the order below."""
        shorter = contexts_o & np.uint32((1 << 8 * (o - 1)) - 1)
        return np.searchsorted(self.known[o - 1], shorter)

    @staticmethod
    def _counts(texts: list[bytes], order: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each order (contexts, bytes, counts), the pairs sorted."""
        chunks: list[list[bytes]] = [[]]
        for text in texts:
            if chunks[-1] and sum(map(len, chunks[-1])) + len(text) > COUNT_BYTES:
                chunks.append([])
            chunks[-1].append(text)
        pairs: list[list[np.ndarray]] = [[] for _ in range(order + 1)]
        times: list[list[np.ndarray]] = [[] for _ in range(order + 1)]
        for chunk in chunks:
            data = np.frombuffer(b"".join(chunk), np.uint8)
            offsets = np.concatenate([[0], np.cumsum([len(t) for t in chunk])]).astype(np.int64)
            full = contexts(data, offsets, order)
            for o in range(order + 1):
                found, n = np.unique((full & np.uint32((1 << 8 * o) - 1)).astype(np.uint64) << np.uint64(8) | data, return_counts=True)
                pairs[o].append(found)
                times[o].append(n)
        out = []
        for o in range(order + 1):
            found, at = np.unique(np.concatenate(pairs[o]), return_inverse=True)
            n = np.bincount(at, np.concatenate(times[o]), len(found))
            out.append(((found >> np.uint64(8)).astype(np.uint32), (found & np.uint64(255)).astype(np.uint8), n.astype(np.int64)))
        return out

    @staticmethod
    def _mixed(nodes: np.ndarray, counts: tuple, up: np.ndarray) -> np.ndarray:
        """Probabilities at each node, given those at its parent: counts, and the escape spread over unseen bytes."""
        context, byte, times = counts
        at = np.searchsorted(nodes, context)
        kept = at < len(nodes)
        kept[kept] = nodes[at[kept]] == context[kept]
        c = np.zeros((len(nodes), 256))
        c[at[kept], byte[kept]] = times[kept]
        seen = c > 0
        total, distinct = c.sum(1, keepdims=True), seen.sum(1, keepdims=True)
        own = total[:, 0] > 0
        rest = np.where(seen, 0, up).sum(1, keepdims=True)
        with np.errstate(divide="ignore", invalid="ignore"):
            novel = up * (distinct / (total + distinct)) / rest  # exclusion: seen bytes take no share of the escape
            p = np.where(seen, c / (total + distinct), novel)
        full = own & (rest[:, 0] <= 0)  # nothing is left to escape to
        p[full] = c[full] / total[full]
        return np.where(own[:, None], p, up)

    def lookup(self) -> np.ndarray:
        """The node of every value of the last ORDER bytes."""
        out = np.zeros(1 << 8 * self.order, np.int32)
        for o in range(1, self.order + 1):
            span = 1 << 8 * o
            grid = out.reshape(-1, span)
            grid[:, self.known[o]] = np.arange(self.begins[o], self.begins[o + 1], dtype=np.int32)
        return out

    def bits(self, data: np.ndarray, offsets: np.ndarray, lookup: np.ndarray) -> np.ndarray:
        """(texts, labels): the code length of each text under each label."""
        at = lookup[contexts(data, offsets, self.order)].astype(np.int64) * 256 + data
        out = np.zeros((len(offsets) - 1, len(self.labels)))
        for i, table_ in enumerate(self.costs.reshape(len(self.labels), -1)):
            sums = np.concatenate([[0.0], np.cumsum(table_[at], dtype=np.float64)])
            out[:, i] = sums[offsets[1:]] - sums[offsets[:-1]]
        return out


def sampled(rows: DataFrame, label_col: str, text_col: str, per_label: int) -> DataFrame:
    """(label, h, text): of each label the distinct texts with the smallest hashes.

    Hashes are ranked within salts first, so that the task of a label gets `SALTS * per_label` of
    them at most, however many rows the label has; the texts are joined afterwards.
    """
    label = F.col(label_col).cast("string")
    labelled = rows.where(label.isNotNull() & F.col(text_col).isNotNull()).select(label.alias("label"), F.xxhash64(text_col).alias("h"), F.col(text_col).alias("text"))
    distinct = labelled.groupBy("label", "h").agg(F.lit(1).alias("one"))
    chosen = distinct.withColumn("salt", F.pmod("h", F.lit(SALTS)))
    for group in (["label", "salt"], ["label"]):
        place = F.row_number().over(W.partitionBy(*group).orderBy("h"))
        chosen = chosen.withColumn("place", place).where(F.col("place") <= per_label).drop("place")
    chosen = chosen.select("label", "h")
    chosen = stored(chosen, "sample")
    chosen = F.broadcast(chosen) if chosen.count() <= FEW_SAMPLED else chosen
    return labelled.join(chosen, ["label", "h"]).groupBy("label", "h").agg(F.min("text").alias("text"))


def fit(rows: DataFrame, label_col: str = "lang", text_col: str = "text", per_label: int = PER_LABEL) -> list[Broadcast]:
    """Packed trees of each group of labels, in the order of labels, from a bounded sample of rows."""
    spark = rows.sparkSession

    def learn(key, sample):
        samples: dict[str, list[bytes]] = {}
        for name, _, text in sorted(zip(*(sample[c].to_pylist() for c in ("label", "h", "text")))):
            samples.setdefault(name, []).append(text.encode("utf-8", "surrogatepass"))
        body = zlib.compress(pickle.dumps(ContextTrees(samples)), 1)
        return pa.table({"group": pa.array([key[0].as_py()], pa.int32()), "trees": pa.array([body], pa.binary())})

    with scratch_space(spark):
        sample = stored(sampled(rows, label_col, text_col, per_label), "sampled-texts")
        labels = sorted(r.label for r in sample.select("label").distinct().toLocalIterator())
        if not labels:
            return []
        of = spark.createDataFrame([(k, i // GROUP) for i, k in enumerate(labels)], "label string, group int")
        learned = stored(sample.join(of, "label").groupBy("group").applyInArrow(learn, "group int, trees binary"), "context-trees")
        groups = {r.group: spark.sparkContext.broadcast(bytes(r.trees)) for r in learned.toLocalIterator()}
    return [groups[g] for g in sorted(groups)]


@lru_cache(maxsize=1)
def unpacked(body: bytes) -> tuple[ContextTrees, np.ndarray]:
    """Trees and their lookup table; a worker holds the last ones."""
    trees = pickle.loads(zlib.decompress(body))
    return trees, trees.lookup()


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike("\\p{L}"), F.lit(False))


def identify(docs: DataFrame, models: list[Broadcast], text_col: str = "text") -> DataFrame:
    """The rows of docs with lang_pred, score and bits."""
    columns = [c for c in docs.columns if c not in ("lang_pred", "score", "bits")]
    rows = docs.select(*columns, has_letter(F.col(text_col)).alias("__letter"))
    place = columns.index(text_col)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != "__letter") + ", " + FIELDS

    def passed(parts):
        """The parts with predictions, after one pass over the groups."""
        n = [part.num_rows for part in parts]
        names, least, total = [np.full(k, UND, object) for k in n], [np.full(k, np.inf) for k in n], [np.zeros(k) for k in n]
        for model in models:
            trees, lookup = unpacked(model.value)
            for i, part in enumerate(parts):
                data, offsets = raw(part.column(place))
                per_byte = trees.bits(data, offsets, lookup) / np.maximum(1, np.diff(offsets))[:, None]
                best = per_byte.argmin(1)
                own = per_byte[np.arange(n[i]), best]
                names[i] = np.where(own < least[i], np.array(trees.labels, object)[best], names[i])  # ties go to earlier labels
                both = np.minimum(own, least[i])
                total[i] = total[i] * np.exp2(both - least[i]) + np.exp2(both[:, None] - per_byte).sum(1)
                least[i] = both
            del trees, lookup
        for i, part in enumerate(parts):
            letter = part.column(len(columns)).to_numpy(zero_copy_only=False).astype(bool) & bool(models)
            share = 1 / np.maximum(total[i], 1)
            out = [pa.array(np.where(letter, names[i], UND), pa.string()), pa.array(np.where(letter, share, 0.0)), pa.array(np.where(letter, least[i], 0.0))]
            yield pa.RecordBatch.from_arrays([part.column(c) for c in range(len(columns))] + out, columns + ["lang_pred", "score", "bits"])

    def predict(batches):
        wanted = PASS_BYTES if len(models) > 1 else 0
        parts, held = [], 0
        for batch in batches:
            for part in slices(batch, text_col, 1 << 18):
                parts.append(part)
                held += part.nbytes
                if held >= wanted:
                    yield from passed(parts)
                    parts, held = [], 0
        if parts:
            yield from passed(parts)

    return rows.mapInArrow(predict, schema)


def held_out(id_col: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 5, is 0; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 5 == 0


def op3_ppm_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    trees = fit(docs.where(~held_out()))
    out = identify(docs.select("doc_id", "text"), trees)
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "bits")
