import random
import re
from collections import Counter

import numpy as np
import pytest

from tessera.llm import jaccard_join as J
from tessera.llm.components import components


def gram_set(text, n=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def brute(rows, threshold=0.8):
    """All pairs, and classes by search over the links."""
    sets = [gram_set(t) for _, t in rows]
    near = [[j for j in range(len(rows)) if j != i and sets[i] and sets[j] and len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j]) - 1e-12] for i in range(len(rows))]
    keys = [-(1 << 63) if k is None else k for k, _ in rows]
    out = []
    for i, (key, _) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            new = [j for j in near[todo.pop()] if j not in seen]
            seen |= set(new)
            todo += new
        out.append((key, min(keys[j] for j in seen), len(near[i])))
    return sorted(out, key=str)


def rows_of(df):
    return sorted(((r.doc_id, r.class_id, r.n_links) for r in df.collect()), key=str)


def corpus():
    rnd = random.Random(9)
    word = lambda: rnd.choice("abcdefgh") + str(rnd.randint(0, 60))
    rows = []
    for base in range(12):
        w = [word() for _ in range(rnd.randint(30, 150))]
        for _ in range(rnd.randint(1, 12)):
            c = list(w)
            for _ in range(rnd.randint(0, 4)):
                c[rnd.randrange(len(c))] = word()
            rows.append((len(rows), (" ", "\n")[rnd.randint(0, 1)].join(c)))
    rows += [(500 + i, rows[0][1]) for i in range(30)] + [(600, None), (601, ""), (602, "one"), (603, "one"), (604, "one two"), (None, rows[5][1]), (3, rows[3][1]), (605, " \t"), (606, "x " * 5000), (607, "x " * 6000)]
    return rows


@pytest.mark.parametrize("members,size", [(4096, 4 << 20), (4, 2000)])
def test_against_all_pairs(spark, monkeypatch, members, size):
    monkeypatch.setattr(J, "BLOCK_MEMBERS", members)
    monkeypatch.setattr(J, "BLOCK_BYTES", size)
    rows = corpus()
    docs = spark.createDataFrame([(t, k, "x", 1) for k, t in rows], "text string, doc_id long, node string, kd int").repartition(3)
    found = J.join(docs)
    assert rows_of(found) == brute(rows)
    firsts = Counter(r.class_id for r in found.where("first").collect() if r.class_id not in (3,))
    assert max(firsts.values()) == 1


def test_a_real_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert rows_of(J.op8_jaccard_join(spark, "/root/testdata/sf0.001")) == brute([tuple(r) for r in docs.select("doc_id", "text").collect()])


def test_empty_table(spark):
    assert J.join(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_banding_reaches_its_recall():
    bands, rows = J.banding()
    assert bands * rows <= J.MOST_HASHES and (1 - 0.8**rows) ** bands <= 1e-5
    with pytest.raises(ValueError):
        J.banding(0.1, 1 - 1e-9, 10)


def test_leaders_keep_similar_members_together():
    rnd = np.random.default_rng(1)
    base = rnd.integers(0, 256, (1, 128), dtype=np.uint8)
    sig = np.repeat(base, 60, 0)
    change = rnd.random(sig.shape) < 0.1
    sig[change] = rnd.integers(0, 256, int(change.sum()), dtype=np.uint8)
    a, b = J.leaders(np.zeros(60, int), np.arange(60), sig)
    assert sorted(a.tolist()) == list(range(1, 60)) and set(b.tolist()) == {0}
    assert len(J.leaders(np.arange(5), np.arange(5), sig[:5])[0]) == 0


def test_components(spark):
    rnd = random.Random(2)
    edges = [(i, i + 1) for i in range(100, 160)] + [(rnd.randint(0, 60), rnd.randint(0, 60)) for _ in range(40)] + [(7, 7)]
    root = {}
    find = lambda x: x if root.setdefault(x, x) == x else find(root[x])
    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    want = {(x, find(x)) for x in root}
    least = {r: min(x for x, s in want if s == r) for _, r in want}
    alone = {7} if not any(7 in e and e != (7, 7) for e in edges) else set()
    got = {(r.node, r.root) for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    linked = {x for e in edges if e[0] != e[1] for x in e}
    assert got == {(x, least[r]) for x, r in want if x in linked} and not alone & {x for x, _ in got}


def test_blocks_of_a_large_component_are_checked_one_by_one(spark, monkeypatch):
    monkeypatch.setattr(J, "BLOCK_BYTES", 2000)
    plain = J.verify

    def one(hashes, first, base, slack, group, block, cross, *rest):
        if cross.any() and len(set(group.tolist())) > 1:
            raise ValueError("a call holds several groups")
        return plain(hashes, first, base, slack, group, block, cross, *rest)

    monkeypatch.setattr(J, "verify", one)
    rnd = random.Random(4)
    base = [f"w{i}" for i in range(60)]
    # two changed words: many of these are further from the centre than half the threshold allows
    rows = [(i, " ".join(f"x{i}" if j in (rnd.randrange(60), 7) else w for j, w in enumerate(base))) for i in range(40)]
    assert rows_of(J.join(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)


def test_near_copies_of_one_text_are_only_counted(spark, monkeypatch):
    """Sets near the centre are linked with each other by their weights alone: nothing is dealt to pairs of blocks."""
    monkeypatch.setattr(J, "BLOCK_BYTES", 4000)
    monkeypatch.setattr(J, "BLOCK_MEMBERS", 16)

    def none(*_):
        raise ValueError("pairs of blocks are compared")

    monkeypatch.setattr(J, "verify", none)
    base = [f"w{i}" for i in range(150)]
    rnd = random.Random(5)
    rows = []
    for i in range(120):
        w = list(base)
        w[rnd.randrange(150)] = f"x{i}"
        rows.append((i, " ".join(w)))
    assert rows_of(J.join(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))) == brute(rows) == sorted(((i, 0, 119) for i in range(120)), key=str)


def test_words_that_polynomials_cannot_tell_apart(spark):
    a, b = "a", "b"
    for _ in range(12):
        a, b = a + b, b + a
    rows = [(1, a), (2, b), (3, f"{a} one two three four five"), (4, f"{b} one two three four five")]
    assert rows_of(J.join(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)
    assert brute(rows)[0] == (1, 1, 0)


def test_scratch_tables_are_deleted(spark):
    import os

    from tessera.llm.common import shared_dir

    folder = f"{shared_dir(spark)}/tessera".removeprefix("file:")
    before = set(os.listdir(folder)) if os.path.exists(folder) else set()
    J.join(spark.createDataFrame(corpus(), "doc_id long, text string"))
    assert {x.rsplit("-", 1)[0] for x in set(os.listdir(folder)) - before} == {"joined"}
