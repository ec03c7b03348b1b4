import hashlib
import itertools
import zlib

import pytest
from pyspark.sql import functions as F

from tessera.llm import merkle as M

SCHEMA = "text string, doc_id long, g long, leaf string, lang string, source string, n_chars long"


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(doc_id, source, lang, n_chars, text):
    return h("".join("-" if x is None else f"{len(str(x).encode())}:{x}" for x in (doc_id, source, lang, n_chars, text)))


def up(nodes):
    """All levels of one tree, recursively by slices."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h("".join(levels[-1][k : k + 8])) for k in range(0, len(levels[-1]), 8)])
    return levels


def brute(rows):
    """rows: (doc_id, source, lang, n_chars, text)."""
    first = lambda x: (x is not None, x)
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    trees = {k: up([x[1] for x in sorted(((first(r[0]), leaf(*r)) for r in rows if r[2] == k), key=str_key)]) for k in langs}
    top = up([trees[k][-1][0] for k in langs])
    out = []
    for n, k in enumerate(langs):
        own = sorted((r for r in rows if r[2] == k), key=lambda r: str_key((first(r[0]), leaf(*r))))
        for i, r in enumerate(own):
            low = r[4] is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
            now = leaf(*r[:4], "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r[4]) if low else r[4])
            proof, at = "", i
            for level in itertools.chain(trees[k][:-1], [None], top[:-1]):
                if level is None:
                    at = n
                    continue
                run = level[at // 8 * 8 : at // 8 * 8 + 8]
                proof += "".join(run[: at % 8] + run[at % 8 + 1 :])
                run[at % 8] = now
                now, at = h("".join(run)), at // 8
            out.append((r[0], leaf(*r), trees[k][-1][0], top[-1][0], h(proof), now, now == top[-1][0]))
    return sorted(out, key=str)


def str_key(x):
    (there, doc_id), leaf_hash = x
    return there, doc_id or 0, leaf_hash


def run(spark, tmp_path, rows):
    df = spark.createDataFrame([(r[4], r[0], 1, "x", r[2], r[1], r[3]) for r in rows], SCHEMA).repartition(3)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    out = M.op12_merkle_manifest(spark, str(tmp_path))
    return sorted((tuple(r) for r in out.collect()), key=str)


@pytest.mark.parametrize("sizes", [{"a": 1}, {"a": 8}, {"a": 9, "b": 1, None: 3}, {"a": 64, "b": 65, "c": 513}, {str(k): 1 + k % 3 for k in range(70)}])
def test_trees(spark, tmp_path, sizes):
    rows = [(17 * i + n, f"s{i % 3}", k, i, f"Text {i} É{k}") for n, (k, size) in enumerate(sizes.items()) for i in range(size)]
    assert run(spark, tmp_path, rows) == brute(rows)


def test_nulls_ties_and_long_texts(spark, tmp_path):
    rows = [(1, None, None, None, None), (1, None, None, None, ""), (None, "s", "de", 3, "ABC"), (None, "s", "de", 3, "ABC"), (5, "", "de", -3, "x" * 300_000 + "Z"), (5, "s", "", 3, "-"), (9, "s", "de", 3, "ABC"), (9, "t", "de", 3, "ABC"), (12, "É", "é", 1, "A:B-")]
    assert run(spark, tmp_path, rows) == brute(rows)


def test_many_copies_of_one_row(spark, tmp_path):
    rows = [(3, "s", "en", 1, "Same")] * 700 + [(k, "s", "en", 1, "Same") for k in range(40)]
    assert run(spark, tmp_path, rows) == brute(rows)


def test_empty_table(spark, tmp_path):
    assert run(spark, tmp_path, []) == []


def test_a_proof_needs_every_sibling(spark):
    leaves = spark.range(100).select(F.col("id").alias("doc_id"), F.lit("x").alias("branch"), F.sha2(F.col("id").cast("string"), 256).alias("leaf"))
    clean = M.verify(leaves.withColumn("now", F.col("leaf")), "branch")
    assert clean.where("verified").count() == 100 and clean.select("root").distinct().count() == 1
    other = M.verify(leaves.withColumn("now", F.sha2(F.lit("other"), 256)), "branch")
    assert other.where("verified").count() == 0


def test_a_missing_child_is_an_error():
    with pytest.raises(RuntimeError):
        M.completed(((0, 0), [(0, "a", 3), (2, "c", 3)]))
