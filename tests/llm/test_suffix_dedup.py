import hashlib
import random

import numpy as np
import pytest

from tessera.llm import suffix_dedup as S


def brute(rows, size):
    """The contract by direct search."""
    first = {}
    for key, text in rows:
        key, raw = S.NO_ID if key is None else key, (text or "").encode()
        for i in range(len(raw) - size + 1):
            w = raw[i : i + size]
            first[w] = min(first.get(w, key), key)
    out = []
    for key, text in rows:
        k, raw = S.NO_ID if key is None else key, (text or "").encode()
        gone = np.zeros(len(raw) + 1, bool)
        for i in range(len(raw) - size + 1):
            if first[raw[i : i + size]] < k:
                gone[i : i + size] = True
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        spans = int((gone[:-1] & ~np.concatenate([[False], gone[:-1]])[:-1]).sum())
        out.append((key, len(raw), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("alphabet", ["ab", "abcdefghij", "aé\0 "])
def test_two_stage_order(alphabet):
    rnd = random.Random(len(alphabet))
    for n in (1, 2, 7, 60, 400):
        text = np.frombuffer("".join(rnd.choices(alphabet, k=n)).encode(), np.uint8) + np.uint8(1)
        text = np.append(text, np.uint8(0))
        order = S.two_stage(text, np.ones(len(text), bool), 50)
        raw = text.tobytes()
        assert sorted(order.tolist()) == list(range(len(text)))
        prefixes = [raw[i : i + 50] for i in order]
        assert prefixes == sorted(prefixes)
        lcp = S.common_prefixes(text, order, 50)
        for a, b, k in zip(order, order[1:], lcp[1:]):
            assert k == next((j for j in range(50) if raw[a + j : a + j + 1] != raw[b + j : b + j + 1] or a + j >= len(raw)), 50)


def corpus():
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choices("abcé", k=rnd.randint(1, 6)))
    text = lambda n: " ".join(word() for _ in range(n))
    passage, rows = text(30), []
    for i in range(40):
        rows.append((i, text(10) + passage[rnd.randint(0, 40) :] + text(rnd.randint(0, 40)) if i % 3 else text(20)))
    rows += [(40, rows[3][1]), (41, rows[3][1]), (2, rows[4][1]), (None, rows[5][1]), (42, None), (43, ""), (44, "x" * 400), (45, "x" * 300 + "y"), (46, "\0" * 70), (47, "\0" * 60), (40, rows[3][1])]
    return rows


@pytest.mark.parametrize("partitions", [1, 5])
def test_against_direct_search(spark, partitions):
    rows = corpus()
    docs = spark.createDataFrame([(t, i, "extra") for i, t in rows], "text string, doc_id long, part string").repartition(partitions)
    found = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(bytes(r.kept)).hexdigest()) for r in S.deduplicate(docs).collect()]
    assert sorted(found, key=str) == brute(rows, 50)


def test_empty_table(spark):
    assert S.deduplicate(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_sample_of_a_real_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    found = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(bytes(r.kept)).hexdigest()) for r in S.deduplicate(docs).collect()]
    assert sorted(found, key=str) == brute(rows, 50)


@pytest.mark.parametrize("hot", [0, 2, 30])
def test_hot_hashes_against_direct_search(spark, hot):
    rows = corpus()
    docs = spark.createDataFrame([(t, i) for i, t in rows], "text string, doc_id long").repartition(3)
    found = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(bytes(r.kept)).hexdigest()) for r in S.deduplicate(docs, hot=hot).collect()]
    assert sorted(found, key=str) == brute(rows, 50)


def test_a_hot_hash_is_spread_over_buckets():
    """One gram of a small hash in 400 surroundings: no bucket gets more than a small share of it."""
    rnd = random.Random(6)
    tries = ["".join(rnd.choices("ABCDEFGHIJ", k=20)) for _ in range(20_000)]
    common = min(tries, key=lambda g: S.gram_hashes(S.BYTE_VALUES[0][np.frombuffer(g.encode(), np.uint8)], 20)[0])
    noise = lambda: "".join(rnd.choices("abcdefghijklmnop", k=60))
    rows = S.pa.table({"doc_id": S.pa.array(range(400), S.pa.int64()), "text": [noise() + common + noise() for _ in range(400)]})
    largest = {}
    for hot in (100, 1 << 16):
        shared = S.Shared(rows, 50, 20)
        asked = S.counted(0, shared.hashes, shared.times, 4)
        bodies = S.elsewhere_or_hot(asked["body"].to_pylist(), hot)
        shared.find(4, dict(zip(((1, b) for b in asked["bucket"].to_pylist()), bodies)))
        sizes = [int((shared.sent[i:j, 2] - shared.sent[i:j, 1]).sum()) for _, i, j in shared.cuts]
        largest[hot] = max(sizes) / sum(sizes)
    assert largest[100] < 0.1 and largest[1 << 16] > 0.2


def test_bytes_that_polynomials_cannot_tell_apart(spark):
    """Long runs of two symbols in the order of Thue and Morse: nothing of 50 bytes recurs across the texts by hash alone."""
    rnd = random.Random(8)
    rows = []
    for i in range(20):
        a, b = ("".join(rnd.choices("abcdefgh", k=3)) for _ in range(2))
        for _ in range(11):
            a, b = a + b, b + a
        rows.append((i, a if i % 2 else b))
    rows.append((20, rows[3][1][:4000]))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows, 50)
    for parts in (1, 4):
        for hot in (0, 1 << 16):
            found = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(bytes(r.kept)).hexdigest()) for r in S.deduplicate(docs.repartition(parts), hot=hot).collect()]
            assert sorted(found, key=str) == want


@pytest.mark.parametrize("most", [30, 1 << 20])
def test_windows_are_told_apart_in_groups(monkeypatch, most):
    monkeypatch.setattr(S, "MOST_WINDOWS", most)
    rows = corpus()
    shared = S.Shared(S.pa.table({"doc_id": S.pa.array([k for k, _ in rows], S.pa.int64()), "text": [t for _, t in rows]}), 50, 20)
    (data, offsets, starts, counts) = shared.batches[0]
    at = S.ranges(starts, counts)
    key, number, sample = shared.windows(np.zeros(len(at), np.int64), at)
    each = [data[i : i + 50].tobytes() for i in at]
    assert len(sample) == len(set(each)) and [each[sample[n]] for n in number] == each
    assert len(set(zip(each, key.tolist()))) == len(set(each))


def test_runs_of_one_byte():
    """Pieces with runs of every length up to 200, against direct search."""
    rnd = random.Random(9)
    for size in (2, 5, 50):
        for k in range(40):
            bodies = [b"".join(bytes([rnd.choice(b"abz\0")]) * (1 + (5 * k + 7 * j) % 200 if rnd.random() < 0.4 else rnd.randint(1, 3)) for j in range(8)) for _ in range(4)]
            bodies = [b for b in bodies if len(b) >= size]
            owners = [rnd.randint(1, 9) for _ in bodies]
            least = {}
            for b, o in zip(bodies, owners):
                for i in range(len(b) - size + 1):
                    least[b[i : i + size]] = min(least.get(b[i : i + size], o), o)
            if bodies:
                found = S.least_owner(bodies, np.array(owners), size)
                assert [x.tolist() for x in found] == [[least[b[i : i + size]] for i in range(len(b) - size + 1)] for b in bodies]


def test_a_long_run_is_one_step():
    import time

    began = time.monotonic()
    found = S.least_owner([b"z" * 4_000_000, b"a" + b"z" * 3_000_000], np.array([2, 1]), 50)
    assert [set(x.tolist()) for x in found] == [{1}, {1}] and time.monotonic() - began < 30
