"""Substring dedup over words with a log-structured index of window fingerprints.

A word is removed if a window of `size` consecutive words that covers it occurs anywhere
else, in the same document too. Windows never cross documents and are judged on the input.

The index is a folder of immutable runs. A run holds, for each bucket of the hash space and
each part of a batch, the sorted fingerprints of the batch's windows: two 64-bit hashes made
from both halves of the words' 128-bit keyed digests, and whether the part has the window more
than once. A new batch becomes a run of its own; per bucket all runs are merged by the first
hash, equal neighbours are verified by the second, and the batch is told which of its windows
occur elsewhere. `compact` merges the runs into one, in which each window stands once; it can
answer the parts of the runs that it merges in the same pass.

A corpus that is closed is ingested in several batches, one run each; one compaction then
answers all of them. Before, parts exchange the least gram hash of each window (see `parts`): a
window whose least hash occurs once in a closed corpus cannot recur and needs no entry. That
filter is off when an index is kept for later batches, since they may bring the window; an
index of a closed corpus says so and refuses further batches.

Defined results: null and empty texts have no words; texts shorter than a window lose
nothing; repeated rows delete each other's windows, whatever their ids. Only the id and the
text are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import remove, remove_stored, scratch, slices, stored, table
from tessera.llm.hashing import gram_hashes, mixed, pieces, raw, sliding_min, word_digests, words
from tessera.llm.parts import ANSWER, BUCKET_BYTES, REQUEST, Parts, answered, by_bucket, by_part, cut, elsewhere, member, owned, parts, requests_of, shuffle_partitions, with_answers

SIZE, GRAM = 35, 8
SLICE_BYTES = 1 << 19
#: Batches, and so runs, of a closed corpus.
BATCHES = 2

RUN = "run int, bucket int, part long, body binary"


def repeated(grams: np.ndarray, least: np.ndarray, width: int) -> np.ndarray:
    """The least grams that occur twice near each other, as in periodic text, where a window may overlap its copy."""
    if not len(least):
        return least
    padded = np.concatenate([np.zeros(width - 1, np.uint64), least, np.zeros(width - 1, np.uint64)])
    chosen = grams[grams == ~sliding_min(~padded, width)]  # grams that are the least of some window, in order
    return chosen[1:][chosen[1:] == chosen[:-1]]


class Windows:
    """The words and windows of a part, slice by slice."""

    def __init__(self, rows: pa.Table, size: int, gram: int):
        self.size, self.batches, each, tied = size, [], [], []
        for batch in rows.to_batches():
            for part in slices(batch, "text", SLICE_BYTES):
                data, offsets = raw(part.column(part.schema.get_field_index("text")))
                starts, ends, first = words(data, offsets)
                values, checks = word_digests(data, starts, ends)
                grams = gram_hashes(values, gram)
                least = sliding_min(grams, size - gram + 1)
                at, counts = pieces(least, first, size) if len(least) else (np.zeros(0, np.int64),) * 2
                each.append(mixed(least[at]))
                tied.append(mixed(repeated(grams, least, size - gram + 1)))
                # places in a slice fit 32 bits; a part's slices are all held at once
                self.batches.append((data, starts.astype(np.int32), ends.astype(np.int32), first, values, checks, at.astype(np.int32), counts.astype(np.int32)))
        self.least = np.concatenate(each) if each else np.zeros(0, np.uint64)
        self.hashes, times = np.unique(np.concatenate([self.least, *tied]), return_counts=True)
        self.again = times > 1

    def choose(self, buckets: int, answers: dict | None) -> None:
        """Takes the windows whose least hash recurs, or all without answers, and sorts the distinct ones."""
        kept = np.ones(len(self.least), bool)
        if answers is not None:
            kept = member(self.least, self.hashes[self.again | answered(self.hashes, buckets, answers, 1)])
        at, where, hashes, checks = 0, [], [], []
        for _, _, _, _, values, second, s, counts in self.batches:
            chosen = kept[at : at + len(s)]
            at += len(s)
            n = counts[chosen]
            w = np.repeat(s[chosen] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            where.append(w)
            hashes.append(gram_hashes(values, self.size, 0)[w])
            checks.append(gram_hashes(second, self.size, 1)[w] if len(w) else np.zeros(0, np.uint64))
        self.where = where
        h = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        c = np.concatenate(checks) if checks else np.zeros(0, np.uint64)
        order = np.argsort(h)
        tied = np.flatnonzero(h[order][1:] == h[order][:-1])
        if len(tied) and (c[order][tied] != c[order][tied + 1]).any():
            order = np.lexsort((c, h))  # different windows with one hash: rare, but they must not alternate
        h, c = h[order], c[order]
        fresh = np.ones(len(h), bool)
        fresh[1:] = (h[1:] != h[:-1]) | (c[1:] != c[:-1])
        self.number = np.empty(len(h), np.int64)
        self.number[order] = np.cumsum(fresh) - 1
        self.index, self.checks = h[fresh], c[fresh]
        self.twice = np.diff(np.append(np.flatnonzero(fresh), len(h))) > 1
        self.cuts = list(cut(owned(self.index, buckets), buckets))

    def requests(self, part: int) -> pa.Table:
        bodies = [body(self.index[i:j], self.checks[i:j], self.twice[i:j]) for _, i, j in self.cuts]
        return pa.table({"bucket": pa.array([c[0] for c in self.cuts], pa.int32()), "part": pa.array([part] * len(bodies), pa.int64()), "body": pa.array(bodies, pa.binary())})

    def removed(self, answers: dict) -> list[np.ndarray]:
        """For each slice, which of its words go."""
        bits = [np.unpackbits(np.frombuffer(answers[2, b], np.uint8), count=j - i) for b, i, j in self.cuts]
        hit = (np.concatenate(bits).astype(bool) if bits else np.zeros(0, bool))[self.number]
        at, out = 0, []
        for (_, starts, *_), w in zip(self.batches, self.where):
            own = w[hit[at : at + len(w)]]
            at += len(w)
            marks = np.zeros(len(starts) + 1, np.int64)
            marks[own] += 1
            marks[own + self.size] -= 1
            out.append(np.cumsum(marks)[:-1] > 0)
        return out


def body(hashes: np.ndarray, checks: np.ndarray, twice: np.ndarray) -> bytes:
    return np.int64(len(hashes)).tobytes() + hashes.tobytes() + checks.tobytes() + np.packbits(twice).tobytes()


def opened(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = int(np.frombuffer(data, np.int64, 1)[0])
    return np.frombuffer(data, np.uint64, n, 8), np.frombuffer(data, np.uint64, n, 8 + 8 * n), np.unpackbits(np.frombuffer(data, np.uint8, -1, 8 + 16 * n), count=n).astype(bool)


def merge(bodies: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """(hashes, checks, twice, places): the sorted distinct windows of runs, and where each run's windows are in them."""
    runs = [opened(x) for x in bodies]
    h, c, t = (np.concatenate([r[k] for r in runs]) for k in range(3))
    order = np.argsort(h, kind="stable")  # merges what is sorted already
    a, b = h[order][1:], h[order][:-1]
    if (c[order][1:] != c[order][:-1])[a == b].any():
        order = np.lexsort((c, h))
    h, c = h[order], c[order]
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[1:] != h[:-1]) | (c[1:] != c[:-1])  # verified: both hashes agree
    number = np.cumsum(fresh) - 1
    begins = np.flatnonzero(fresh)
    twice = np.diff(np.append(begins, len(h))) > 1
    if len(begins):
        twice |= np.logical_or.reduceat(t[order], begins)
    places = np.empty(len(h), np.int64)
    places[order] = number
    return h[fresh], c[fresh], twice, np.split(places, np.cumsum([len(r[0]) for r in runs])[:-1])


def recurring(bodies: list[bytes]) -> list[bytes]:
    """For each run, bits that tell which of its windows occur more than once in all runs."""
    _, _, twice, places = merge(bodies)
    return [np.packbits(twice[p]).tobytes() for p in places]


#: Bytes of fingerprints in the largest bucket beyond which compaction splits all of them.
MOST_BYTES = 64 << 20

OUTPUT = "doc_id long, n_words long, n_removed long, kept string"


def finish(windows: Windows, rows: pa.Table, answers: dict) -> pa.Table:
    n, gone, kept = [], [], []
    for (data, starts, ends, first, *_), out in zip(windows.batches, windows.removed(answers)):
        total = np.concatenate([[0], np.cumsum(out)])
        n.append(np.diff(first))
        gone.append(np.diff(total[first]))
        left = np.flatnonzero(~out)
        sizes = ends[left] - starts[left] + 1  # each kept word and a space behind it
        to = np.cumsum(sizes) - sizes
        flat = np.full(int(sizes.sum()), 0x20, np.uint8)
        inside = np.repeat(starts[left] - to, sizes - 1)
        at = np.repeat(np.arange(len(left)), sizes - 1) + np.arange(len(inside))
        flat[at] = data[inside + at]
        edge = np.append(to, len(flat))[first - total[first]].tolist()
        joined = flat.tobytes()
        kept += [joined[i : max(i, j - 1)] for i, j in zip(edge, edge[1:])]
    flat = lambda x: pa.array(np.concatenate(x) if x else [], pa.int64())
    return pa.table({"doc_id": rows["doc_id"], "n_words": flat(n), "n_removed": flat(gone), "kept": pa.array(kept, pa.binary()).cast(pa.string())})


class FingerprintIndex:
    """Runs of window fingerprints under `path`, a folder that driver and executors share.

    The runs are in the latest complete generation g<n> of the folder; compaction writes the
    next one before it deletes the old, so an index can be opened again after a failure. There is a
    bucket for each `BUCKET_BYTES` of the text that is expected when the index is made, and the
    session's shuffle partitions at least. Compaction of an open index splits all buckets when the
    largest holds more than `MOST_BYTES` of fingerprints, so that no task grows with its history.
    """

    def __init__(self, spark: SparkSession, path: str, size: int = SIZE, gram: int = GRAM, expected_bytes: int = 0):
        self.spark, self.base, self.size, self.gram = spark, path, size, gram
        self.generation, self.count, self.closed = 0, 0, False
        self.buckets = max(shuffle_partitions(spark), -(-expected_bytes // BUCKET_BYTES))
        if self._exists(path):
            whole = [int(name[1:]) for name in self._names(path) if self._exists(f"{path}/{name}/_SUCCESS")]
            if whole:
                self.generation = max(whole)
                runs = [int(name[4:]) for name in self._names(self.path) if name.startswith("run=")]
                self.count = 1 + max(runs, default=-1)
                notes = dict(r.value.split("=") for r in self.spark.read.text(self._notes_at(self.generation)).collect())  # two lines
                self.buckets, self.closed = int(notes["buckets"]), notes["closed"] == "True"

    def _hadoop(self, path: str):
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return where, where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _exists(self, path: str) -> bool:
        where, files = self._hadoop(path)
        return files.exists(where)

    def _names(self, path: str) -> list[str]:
        where, files = self._hadoop(path)
        return [x.getPath().getName() for x in files.listStatus(where)]

    def _notes_at(self, generation: int) -> str:
        return f"{self.base}-notes/g{generation}"

    def _note(self, generation: int, buckets: int) -> None:
        """Written before the generation that it tells of, so that whichever is found whole has its notes."""
        notes = [(f"buckets={buckets}",), (f"closed={self.closed}",)]
        self.spark.createDataFrame(notes, "value string").coalesce(1).write.mode("overwrite").text(self._notes_at(generation))

    @property
    def path(self) -> str:
        return f"{self.base}/g{self.generation}"

    def runs(self) -> DataFrame:
        return self.spark.read.schema(RUN).parquet(self.path).where("run >= 0") if self.count else self.spark.createDataFrame([], RUN)

    def append(self, requests: DataFrame) -> int:
        """Adds the fingerprints of a batch as a run and returns its number."""
        if not self.count:
            self._note(self.generation, self.buckets)
        run = self.count
        requests.select(F.lit(run).alias("run"), "bucket", "part", "body").write.mode("append").partitionBy("run").parquet(self.path)
        self.count += 1
        return run

    def answers(self, run: int) -> DataFrame:
        """For the parts of a run, which windows occur elsewhere in the index or the run."""

        def fuse(key, rows):
            mine = np.flatnonzero(rows["run"].to_numpy() == run)
            if not len(mine):
                return answer_rows(rows, mine, [])
            return answer_rows(rows, mine, recurring(rows["body"].to_pylist()))

        return self.runs().groupBy("bucket").applyInArrow(fuse, ANSWER)

    def compact(self) -> DataFrame:
        """Merges all runs into one, as a new generation, and returns what `answers` gives for all runs.

        The old generation goes afterwards. The answers stand beside the merged run and are read
        from there, so they are gone with the next compaction.
        """

        old, had, more = self.path, self.count, 1
        if had and not self.closed:  # the answers of a closed index name the buckets that were asked
            largest = self.runs().groupBy("bucket").agg(F.sum(F.octet_length("body").cast("long")).alias("n")).agg(F.max("n")).head()[0]
            more = max(1, -(-largest // MOST_BYTES))
        buckets = self.buckets * more

        def fuse(key, rows):
            bodies = rows["body"].to_pylist()
            hashes, checks, twice, places = merge(bodies)
            own = np.flatnonzero(rows["part"].to_numpy() >= 0)
            told = answer_rows(rows, own, [np.packbits(twice[p]).tobytes() for p in places])
            pieces = list(cut(owned(hashes, buckets), buckets))
            n, merged = len(pieces), [body(hashes[i:j], checks[i:j], twice[i:j]) for _, i, j in pieces]
            one = pa.table({"part": pa.array([-1] * n, pa.int64()), "step": pa.array([0] * n, pa.int32()), "bucket": pa.array([b for b, _, _ in pieces], pa.int32()), "body": pa.array(merged, pa.binary())})
            return pa.concat_tables([one, told])

        if had:
            self._note(self.generation + 1, buckets)
            fused = self.runs().groupBy("bucket").applyInArrow(fuse, ANSWER)
            fused.withColumn("run", F.when(F.col("step") == 0, 0).otherwise(-1)).write.mode("overwrite").partitionBy("run").parquet(f"{self.base}/g{self.generation + 1}")
            self.generation, self.count, self.buckets = self.generation + 1, 1, buckets
            remove(self.spark, old)
            remove(self.spark, self._notes_at(self.generation - 1))
        return self.spark.read.schema(ANSWER).parquet(f"{self.path}/run=-1") if had and self._exists(f"{self.path}/run=-1") else self.spark.createDataFrame([], ANSWER)

    def _chosen(self, texts: DataFrame, known: DataFrame | None) -> DataFrame:
        """The windows of each part, as requests to the buckets that own them."""
        size, gram, buckets = self.size, self.gram, self.buckets

        def chosen(part, rows, answers=None):
            windows = Windows(rows, size, gram)
            windows.choose(buckets, answers)
            return windows.requests(part)

        return by_part(texts, chosen, REQUEST) if known is None else with_answers(texts, known, chosen, REQUEST)

    def _judged(self, texts: DataFrame, answers: DataFrame, filtered: bool) -> DataFrame:
        size, gram, buckets = self.size, self.gram, self.buckets

        def judged(part, rows, found):
            windows = Windows(rows, size, gram)
            windows.choose(buckets, found if filtered else None)
            return finish(windows, rows, found)

        return stored(with_answers(texts, answers, judged, OUTPUT), "fingerprint-dedup")

    def ingest(self, docs: DataFrame) -> DataFrame:
        """(doc_id, n_words, n_removed, kept) of a batch, judged by the index and the batch itself; the batch joins the index."""
        if self.closed:
            raise ValueError("the index holds a closed corpus: it lacks windows that occurred once")
        with parts(typed(docs), "windows") as texts:
            run = self.append(self._chosen(texts.rows, None))
            return self._judged(texts.rows, self.answers(run), False)

    def ingest_closed(self, docs: DataFrame, batches: int = BATCHES) -> DataFrame:
        """The same for a whole corpus to which nothing will be added, into an empty index.

        Each batch becomes a run; then one compaction merges the runs and judges all of them.
        """
        if self.count:
            raise ValueError("a closed corpus needs an empty index")
        self.closed = True
        with parts(typed(docs), "windows") as texts:
            known = self._shared(texts)
            for b in range(batches):
                mine = F.pmod("part", F.lit(batches)) == b
                self.append(self._chosen(texts.rows.where(mine), known.where(mine)))
            out = self._judged(texts.rows, known.unionByName(self.compact()), True)
            remove_stored(known)
            return out

    def _shared(self, texts: Parts) -> DataFrame:
        """For each part, which of its least hashes another part has too."""
        size, gram, buckets = self.size, self.gram, self.buckets

        def hashes(part, rows):
            return requests_of(part, Windows(rows, size, gram).hashes, buckets)

        return stored(by_bucket(by_part(texts.rows, hashes, REQUEST), 1, elsewhere), "least-hashes")


def answer_rows(rows: pa.Table, mine: np.ndarray, bits: list[bytes]) -> pa.Table:
    """Answers to the given rows of a bucket, out of the bits of all its rows."""
    return pa.table({"part": rows["part"].take(mine), "step": pa.array([2] * len(mine), pa.int32()), "bucket": rows["bucket"].take(mine), "body": pa.array([bits[i] for i in mine], pa.binary())})


def typed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))


def op1_fingerprint_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    size = docs.agg(F.sum(F.octet_length("text").cast("long"))).head()[0] or 0
    path = scratch(spark, "fingerprints")
    index = FingerprintIndex(spark, path, expected_bytes=size)
    out = index.ingest_closed(docs)
    for at in (path, f"{path}-notes"):  # the query keeps no index
        remove(spark, at)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
g AS (SELECT r, i, array_to_string(w[i:i + {SIZE - 1}], ' ') AS span FROM (SELECT r, w, unnest(range(1, len(w) - {SIZE} + 2)) AS i FROM d WHERE len(w) >= {SIZE})),
c AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY span) AS n FROM g) WHERE n > 1),
p AS (SELECT DISTINCT r, unnest(range(i, i + {SIZE})) AS pos FROM c),
u AS (SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS pos FROM d),
k AS (SELECT u.r, count(p.pos) AS n_removed, coalesce(string_agg(CASE WHEN p.pos IS NULL THEN word END, ' ' ORDER BY u.pos), '') AS kept FROM u LEFT JOIN p ON u.r = p.r AND u.pos = p.pos GROUP BY u.r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (r)
"""
