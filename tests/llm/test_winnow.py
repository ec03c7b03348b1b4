import hashlib
import random
import re

import pytest

from tessera.llm import winnow as N


def split(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(docs, items, window=13):
    spans = {}
    for key, text in items:
        w = split(text)
        if w:
            k = min(len(w), window)
            for i in range(len(w) - k + 1):
                spans.setdefault(tuple(w[i : i + k]), set()).add(key)
    lengths = {len(s) for s in spans}
    out = []
    for key, text in docs:
        w = split(text)
        hit, found = set(), set()
        for k in lengths:
            for i in range(len(w) - k + 1):
                got = spans.get(tuple(w[i : i + k]))
                if got:
                    hit |= set(range(i, i + k))
                    found |= got
        out.append((key, len(w), len(hit), len(found), sorted(str(x) for x in found if x is not None)))
    return sorted(out, key=str)


def found(df):
    return sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, r["items"]) for r in df.collect()), key=str)


def cases():
    rnd = random.Random(3)
    text = lambda n: " ".join(rnd.choice(["Alpha", "béta", "x1", "d-e", "Ω", "an"]) for _ in range(n))
    items = [(i, text(rnd.randint(1, 40))) for i in range(25)] + [(90, None), (91, ""), (92, "Ω!"), (93, "only, Ten words that are not found elsewhere at all"), (None, "null item text of some length here")]
    docs = [(i, text(rnd.randint(0, 60)) + ". " + (rnd.choice(items)[1] or "").upper()[: rnd.randint(0, 300)] + " " + text(5)) for i in range(60)]
    docs += [(1, docs[1][1]), (None, docs[2][1]), (70, None), (71, ""), (72, "..."), (73, "An " * 3000), (74, "only ten words that are not found elsewhere at")]
    return docs, items


@pytest.mark.parametrize("few", [1 << 24, 0])
def test_against_direct_search(spark, monkeypatch, few):
    monkeypatch.setattr(N, "FEW_BYTES", few)
    docs, items = cases()
    d = spark.createDataFrame([(t, i, "x", 1) for i, t in docs], "text string, doc_id long, fp string, length int").repartition(3)
    b = spark.createDataFrame([(*r, "y") for r in items], "item_id long, text string, doc_id string")
    assert found(N.decontaminate(d, b)) == brute(docs, items)


def test_empty_tables(spark):
    docs, items = cases()
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert N.decontaminate(d.limit(0), b).collect() == []
    assert found(N.decontaminate(d, b.limit(0))) == brute(docs, [])


def test_a_real_table_and_the_digest(spark):
    sf = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    want = brute(docs, items)
    out = {r.doc_id: r for r in N.op6_winnow(spark, sf).collect()}
    assert sum(x[2] > 0 for x in want) >= 3
    for key, n, hit, _, ids in want:
        r = out[key]
        assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (n, hit, len(ids), hit > 0 and 20 * hit >= n)
        assert r.items_sha256 == hashlib.sha256(",".join(ids).encode()).hexdigest()


def test_items_without_an_id_are_hit(spark):
    text = " ".join(f"w{i}" for i in range(20))
    docs = spark.createDataFrame([(1, text), (2, "other words")], "doc_id long, text string")
    one = spark.createDataFrame([(None, text)], "item_id long, text string")
    assert found(N.decontaminate(docs, one)) == [(1, 20, 20, 1, []), (2, 2, 0, 0, [])]
    two = spark.createDataFrame([(None, text), (7, text), (None, "other words"), (8, text)], "item_id long, text string")
    assert found(N.decontaminate(docs, two)) == [(1, 20, 20, 3, ["7", "8"]), (2, 2, 2, 1, [])]


def test_documents_are_read_once_for_all_lengths(spark):
    lengths = [1, 3, 5, 8, 13]
    rows = spark.createDataFrame([(1, ["a", "b"] * 20)], "kd long, w array<string>")
    plan = N.with_fingerprints(rows.selectExpr("transform(w, x -> xxhash64(x)) AS h"), "h", lengths, 5)
    assert [c for c in plan.columns if c.startswith("fp_")] == [f"fp_{k}" for k in lengths]
    out = plan.head()
    assert [len(out[f"fp_{k}"]) for k in lengths] == [40 - k + 1 for k in lengths]
