import random
import re
from collections import Counter

import numpy as np
import pytest

from tessera.llm import fingerprint_index as I
from tessera.llm.common import scratch


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def brute(rows, size, history=()):
    """The contract by direct search; history: earlier texts, which count as elsewhere."""
    seen = Counter(tuple(w[i : i + size]) for _, t in [*rows, *history] for w in [split(t)] for i in range(len(w) - size + 1))
    out = []
    for key, text in rows:
        w = split(text)
        gone = np.zeros(len(w), bool)
        for i in range(len(w) - size + 1):
            if seen[tuple(w[i : i + size])] > 1:
                gone[i : i + size] = True
        out.append((key, len(w), int(gone.sum()), " ".join(x for x, g in zip(w, gone) if not g)))
    return sorted(out, key=str)


def rows_of(df):
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in df.collect()), key=str)


def corpus(seed):
    rnd = random.Random(seed)
    text = lambda n: "".join(rnd.choice(["a", "b", "cé", "\0d", " e"]) + str(rnd.randint(0, 9)) + rnd.choice([" ", "\n", "\t ", " \x0b"]) for _ in range(n))
    passage = text(60)
    rows = [(i, text(rnd.randint(0, 80)) + (passage[rnd.randint(0, 30) :] if i % 3 else "") + text(rnd.randint(0, 40))) for i in range(40)]
    return [*rows, (40, rows[3][1]), (40, rows[3][1]), (2, rows[4][1]), (None, rows[5][1]), (42, None), (43, ""), (44, "same " * 90), (45, " \n "), (46, "same " * 34)]


@pytest.mark.parametrize("partitions", [1, 5])
def test_closed_corpus(spark, partitions):
    rows = corpus(1)
    docs = spark.createDataFrame([(t, i, 1) for i, t in rows], "text string, doc_id long, part int").repartition(partitions)
    assert rows_of(I.FingerprintIndex(spark, scratch(spark, "t")).ingest_closed(docs)) == brute(rows, 35)


def test_batches_and_compaction(spark):
    path, history = scratch(spark, "t"), []
    for seed in (1, 2, 1):
        index = I.FingerprintIndex(spark, path)  # opened again for each batch
        rows = corpus(seed)
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
        assert rows_of(index.ingest(docs)) == brute(rows, 35, history)
        history += rows
        if seed == 2:
            index.compact()
            with pytest.raises(ValueError):
                index.ingest_closed(docs)
            assert index.runs().groupBy("bucket").count().where("count > 1").count() == 0


def test_empty_table(spark):
    assert I.FingerprintIndex(spark, scratch(spark, "t")).ingest_closed(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_equal_hashes_are_verified():
    h, c = np.array([7, 7, 9], np.uint64), np.array([1, 2, 3], np.uint64)
    a, b = I.body(h, c, np.zeros(3, bool)), I.body(h[1:], np.array([4, 3], np.uint64), np.zeros(2, bool))
    bits = [np.unpackbits(np.frombuffer(x, np.uint8), count=n).tolist() for x, n in zip(I.recurring([a, b]), (3, 2))]
    assert bits == [[0, 0, 1], [0, 1]]


def swapped(order):
    """Two byte strings that differ in every place, alternating in the order of Thue and Morse: powers cancel out on them."""
    a, b = b"a", b"b"
    for _ in range(order):
        a, b = a + b, b + a
    return a.decode(), b.decode()


@pytest.mark.parametrize("order", [10, 13])
def test_words_that_polynomials_cannot_tell_apart(spark, order):
    a, b = swapped(order)
    words = [f"w{i}" for i in range(40)]
    rows = [(1, " ".join(words[:20] + [a] + words[20:])), (2, " ".join(words[:20] + [b] + words[20:]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for parts in (1, 4):
        found = rows_of(I.FingerprintIndex(spark, scratch(spark, "t")).ingest_closed(docs.repartition(parts)))
        assert found == brute(rows, 35) and all(n == 0 for _, _, n, _ in found)


def test_a_closed_index_refuses_batches(spark):
    path = scratch(spark, "t")
    docs = spark.createDataFrame(corpus(1), "doc_id long, text string")
    I.FingerprintIndex(spark, path).ingest_closed(docs)
    with pytest.raises(ValueError, match="closed"):
        I.FingerprintIndex(spark, path).ingest(docs)


@pytest.mark.parametrize("batches", [1, 3])
def test_runs_of_a_closed_corpus_are_compacted(spark, batches):
    rows = corpus(1)
    index = I.FingerprintIndex(spark, scratch(spark, "t"), expected_bytes=100)
    assert rows_of(index.ingest_closed(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), batches)) == brute(rows, 35)
    assert index.runs().select("run").distinct().count() == 1 and index.generation == 1


def test_the_number_of_buckets_follows_bytes(spark):
    assert I.FingerprintIndex(spark, scratch(spark, "t"), expected_bytes=1 << 40).buckets == (1 << 40) // I.BUCKET_BYTES


def test_an_open_index_splits_its_buckets(spark, monkeypatch):
    """Batches, compactions and openings in turn; the rows are those of an index that never splits."""
    rows, found, path = corpus(3), [], scratch(spark, "t")
    batches = [rows[k::4] for k in range(4)]
    monkeypatch.setattr(I, "MOST_BYTES", 2000)
    for n, batch in enumerate(batches):
        index = I.FingerprintIndex(spark, path)
        buckets = index.buckets
        found.append(rows_of(index.ingest(spark.createDataFrame(batch, "doc_id long, text string").repartition(3))))
        if n < 3:
            index.compact()
            assert index.buckets >= buckets
    assert I.FingerprintIndex(spark, path).buckets == index.buckets > 4
    monkeypatch.setattr(I, "MOST_BYTES", 1 << 40)
    whole = I.FingerprintIndex(spark, scratch(spark, "t"))
    assert found == [rows_of(whole.ingest(spark.createDataFrame(b, "doc_id long, text string"))) for b in batches]
    assert sum(x[2] for f in found for x in f) > 0
