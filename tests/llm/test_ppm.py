import math
import random
import zlib

import numpy as np

from tessera.llm import ppm as P


def brute_bits(train, text, order):
    """The code length of a text by walking down the contexts of each byte."""
    trees = {}
    for t in train:
        t0 = b"\0" * order + t
        for i in range(order, len(t0)):
            for o in range(order + 1):
                c = trees.setdefault(t0[i - o : i], {})
                c[t0[i]] = c.get(t0[i], 0) + 1
    total, t0 = 0.0, b"\0" * order + text
    for i in range(order, len(t0)):
        excluded, p = set(), 1.0
        for o in range(order, -1, -1):
            c = trees.get(t0[i - o : i])
            if not c:
                continue
            left = {k: v for k, v in c.items()}
            n, d = sum(left.values()), len(left)
            if t0[i] in left:
                p *= left[t0[i]] / (n + d)
                break
            p *= d / (n + d)
            # exclusion: what the longer contexts know takes no share below
            excluded |= set(left)
            return_to = [o2 for o2 in range(o - 1, -1, -1)]
            p *= spread(trees, t0, i, return_to, excluded)
            break
        else:
            p *= 1 / 256
        total -= math.log2(p)
    return total


def spread(trees, t0, i, orders, excluded):
    """P(byte | shorter contexts), renormalised over bytes that are not excluded."""
    def prob(byte, orders):
        if not orders:
            return 1 / 256
        c = trees.get(t0[i - orders[0] : i])
        if not c:
            return prob(byte, orders[1:])
        n, d = sum(c.values()), len(c)
        if byte in c:
            return c[byte] / (n + d)
        rest = sum(prob(b, orders[1:]) for b in range(256) if b not in c)
        return d / (n + d) * prob(byte, orders[1:]) / rest

    rest = sum(prob(b, orders) for b in range(256) if b not in excluded)
    return prob(t0[i], orders) / rest


def test_code_lengths():
    rnd = random.Random(1)
    train = [bytes(rnd.choices(b"abc ", k=60)) for _ in range(3)]
    texts = [b"abca", b"", b"zz a", bytes(rnd.choices(b"abc d", k=30))]
    trees = P.ContextTrees({"x": train}, 2)
    data = np.frombuffer(b"".join(texts), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    found = trees.bits(data, offsets, trees.lookup())[:, 0]
    assert np.allclose(found, [brute_bits(train, t, 2) for t in texts], rtol=1e-4)


def test_probabilities_sum_to_one():
    trees = P.ContextTrees({"a": [b"abracadabra" * 3], "b": [b"the cat sat"]}, 3, most=20)
    assert np.allclose(np.exp2(-trees.costs.astype(float)).sum(2), 1, atol=1e-4)
    assert trees.costs.shape[1] <= 2 * 21


def test_accuracy_on_held_out_rows(spark):
    out = P.op3_ppm_language(spark, "/root/testdata/sf0.01")
    truth = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    rows = out.join(truth, "doc_id").collect()
    assert len(rows) == 1000
    held = [r for r in rows if r.held_out]
    assert all((zlib.crc32(str(r.doc_id).encode()) % 5 == 0) == r.held_out for r in rows)
    assert sum(r.lang == r.lang_pred for r in held) >= 0.97 * len(held)


def test_edge_cases(spark):
    rows = [(1, "aa bb aa", "x", 1.0), (2, "zz yy zz", "y", 2.0), (3, None, "x", 1.0), (4, "", None, 1.0), (5, "123 !", "y", 1.0), (None, "aa bb", None, 1.0), (1, "aa bb aa", "x", 1.0), (6, "aa " * 200_000, "x", 1.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")
    out = {(r.doc_id, r.text): r for r in P.identify(docs, P.fit(docs)).collect()}
    assert out[3, None].lang_pred == out[4, ""].lang_pred == out[5, "123 !"].lang_pred == "und"
    assert out[1, "aa bb aa"].lang_pred == "x" and out[2, "zz yy zz"].lang_pred == "y" and out[None, "aa bb"].lang_pred == "x"
    assert out[5, "123 !"].score == 0 and 0.5 < out[6, "aa " * 200_000].score <= 1
    empty = docs.limit(0)
    assert P.identify(empty, P.fit(empty)).collect() == []
    assert {r.lang_pred for r in P.identify(docs, P.fit(empty)).collect()} == {"und"}


def test_every_label_is_learned(spark):
    rnd = random.Random(2)
    labels = [f"l{i:02}" for i in range(70)]
    words = {k: ["".join(rnd.choices("abcdefghijklmnopqrstuvwxyz", k=5)) for _ in range(12)] for k in labels}
    text = lambda k: " ".join(rnd.choices(words[k], k=25))
    # the later a label, the fewer rows it has
    train = [(i, text(k), k) for i, k in enumerate(k for j, k in enumerate(labels) for _ in range(max(2, 9 - j // 9)))]
    asked = [(10_000 + i, text(k), k) for i, k in enumerate(labels)]
    models = P.fit(spark.createDataFrame(train, "doc_id long, text string, lang string"))
    out = P.identify(spark.createDataFrame(asked, "doc_id long, text string, lang string").repartition(2), models).collect()
    assert [k for m in models for k in P.unpacked(m.value)[0].labels] == labels
    assert {r.lang_pred for r in out} == set(labels) and all(r.lang_pred == r.lang for r in out)
    assert all(0 < r.score <= 1 for r in out)


def test_a_label_with_few_bytes_keeps_contexts():
    rnd = random.Random(3)
    much = [bytes(rnd.choices(b"abcdefgh", k=4000)) for _ in range(5)]
    few = P.ContextTrees({"few": [b"xyzxyzxyzxyz"], "much": much}, 3, most=100)
    assert int.from_bytes(b"xyz", "big") in few.known[3].tolist()


def test_neighbours_change_no_code_length():
    """A label is cut alike whether it is held alone or with others that have many contexts."""
    rnd = random.Random(8)
    texts = {k: [bytes(rnd.choices(abc, k=3000)) for _ in range(4)] for k, abc in (("a", b"abcdefgh"), ("b", b"fghijklmnop"), ("c", b"abcxyz"))}
    asked = [bytes(rnd.choices(b"abcdefghxyz", k=500)) for _ in range(5)]
    data, offsets = np.frombuffer(b"".join(asked), np.uint8), np.arange(6) * 500
    together = P.ContextTrees(texts, 3, most=60)
    bits = together.bits(data, offsets, together.lookup())
    for i, k in enumerate(together.labels):
        alone = P.ContextTrees({k: texts[k]}, 3, most=60)
        assert np.allclose(alone.bits(data, offsets, alone.lookup())[:, 0], bits[:, i], rtol=1e-5)


def counted(train, order):
    trees = {}
    for t in train:
        t0 = b"\0" * order + t
        for i in range(order, len(t0)):
            for o in range(order + 1):
                c = trees.setdefault((o, t0[i - o : i]), {})
                c[t0[i]] = c.get(t0[i], 0) + 1
    return trees


def quick_bits(model, text, order):
    """The same code length with the distribution of each context kept."""
    trees, known = model

    def of(context):
        if context not in known:
            up = of(context[1:]) if context else [1 / 256] * 256
            c = trees.get((len(context), context))
            if c:
                n, d = sum(c.values()), len(c)
                rest = sum(p for b, p in enumerate(up) if b not in c)
                up = [c[b] / (n + d) if b in c else p * d / (n + d) / rest for b, p in enumerate(up)]
            known[context] = up
        return known[context]

    t0 = b"\0" * order + text
    return -sum(math.log2(of(t0[i - order : i])[t0[i]]) for i in range(order, len(t0)))


def test_predictions_against_brute_force(spark):
    """The query's predictions and scores, by walking down the contexts of every byte of every text."""
    rnd = random.Random(11)
    letters = {"xx": "abcde ", "yy": "bcdef ", "zz": "cdefg é", "und": "xyz "}
    rows = [(i, "".join(rnd.choices(letters[k], k=rnd.randint(1, 60))), k if rnd.random() < 0.8 else None) for i, k in enumerate(rnd.choices(sorted(letters), k=60))]
    rows += [(100, None, "xx"), (101, "123", "yy"), (102, "", "zz"), (103, rows[0][1], rows[0][2]), (None, "abc cab", None), (104, "a" * 500, "xx")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    train = {}
    for key, text, label in rows:
        if label and text is not None and zlib.crc32(str("" if key is None else key).encode()) % 5:
            train.setdefault(label, set()).add(text)
    labels = sorted(train)
    trees = {k: (counted([t.encode() for t in train[k]], P.ORDER), {}) for k in labels}
    want = []
    for key, text, _ in rows:
        if not any(c.isalpha() for c in text or ""):
            want.append((key, "und", 0.0))
            continue
        per_byte = [quick_bits(trees[k], text.encode(), P.ORDER) / len(text.encode()) for k in labels]
        best = min(range(len(labels)), key=lambda i: per_byte[i])
        want.append((key, labels[best], 1 / sum(2 ** (per_byte[best] - x) for x in per_byte)))
    out = P.identify(docs.repartition(3), P.fit(docs.where(~P.held_out()))).collect()
    for (key, label, score), r in zip(sorted(want, key=str), sorted(out, key=lambda r: str((r.doc_id, r.lang_pred, r.score)))):
        assert (r.doc_id, r.lang_pred) == (key, label) and math.isclose(r.score, score, rel_tol=1e-3, abs_tol=1e-9)


def test_repeated_rows_and_whole_texts(spark):
    """A label of repeated rows is learned beside a larger one, and what stands at the end of a long text counts."""
    rows = [(i, "only one text of this label", "y") for i in range(3000)] + [(i, "quite another one", "x") for i in range(3000, 3300)]
    rows += [(4000, "aa bb " * 3000 + "qq ww " * 3000, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    assert P.sampled(docs, "lang", "text", 2).count() == 3
    asked = spark.createDataFrame([(1, "one text of this label"), (2, "quite another"), (3, "qq ww qq")], "doc_id long, text string")
    out = {r.doc_id: r.lang_pred for r in P.identify(asked, P.fit(docs)).collect()}
    assert out == {1: "y", 2: "x", 3: "z"}


def test_the_sample_is_cut_before_it_is_shuffled(spark):
    rows = [(i, f"text {i}", "x" if i % 3 else "y") for i in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = {(r.label, r.text) for r in P.sampled(docs, "lang", "text", 20).collect()}
    h = {r.text: r.h for r in docs.selectExpr("text", "xxhash64(text) AS h").collect()}
    want = {(k, t) for k in "xy" for t in sorted((t for _, t, x in rows if x == k), key=h.get)[:20]}
    assert found == want


def test_texts_are_counted_in_chunks(monkeypatch):
    rnd = random.Random(4)
    texts = [bytes(rnd.choices(b"abc ", k=50)) for _ in range(9)]
    whole = P.ContextTrees._counts(texts, 2)
    monkeypatch.setattr(P, "COUNT_BYTES", 120)
    for a, b in zip(whole, P.ContextTrees._counts(texts, 2)):
        assert all(np.array_equal(x, y) for x, y in zip(a, b))
