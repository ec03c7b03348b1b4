import numpy as np
import pytest

from tessera.operators.neighbours import VectorIndex
from tessera.plans import search

SCHEMA = "id long, vector array<float>"


def rows_of(x, first=0):
    return [(first + k, [float(v) for v in r]) for k, r in enumerate(x.astype(np.float32))]


def brute(rows, k):
    fit = [(i, np.array(v, float)) for i, v in rows if v and None not in v and np.isfinite(v).all() and any(v)]
    x = np.stack([v / np.linalg.norm(v) for _, v in fit])
    ids = np.array([i for i, _ in fit])
    out = {}
    for i, v in zip(ids, x):
        s = x @ v
        out[int(i)] = [int(j) for j in ids[np.lexsort((ids, -s))] if j != i][:k]
    return out


def lists(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query"], r["rank"])):
        out.setdefault(r["query"], []).append(r["id"])
    return out


@pytest.mark.parametrize("block", [4096, 40])
def test_exact_search(spark, monkeypatch, block):
    """Tight groups, loners and odd vectors; small blocks."""
    monkeypatch.setattr("tessera.operators.neighbours.BLOCK", block)
    rng = np.random.default_rng(5)
    groups = [c + 0.1 * rng.standard_normal((60, 16)) for c in rng.standard_normal((5, 16))]
    rows = rows_of(np.concatenate([*groups, rng.standard_normal((200, 16))]))
    rows += [(900, None), (901, []), (902, [0.0] * 16), (903, [float("nan")] * 16)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    index = VectorIndex(df, "id", "vector", cells=12)
    assert lists(index.search(df, "id", "vector", 7, probes=2, exact=True)) == brute(rows, 7)


def test_few_vectors_and_none(spark):
    rows = rows_of(np.eye(4)[:3])
    df = spark.createDataFrame(rows, SCHEMA)
    assert lists(VectorIndex(df, "id", "vector").search(df, "id", "vector", 10, exact=True)) == brute(rows, 10)
    none = df.limit(0)
    assert VectorIndex(none, "id", "vector").search(df, "id", "vector").collect() == []


def test_probes_reach_the_recall(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r[0], list(r[1])) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()]
    want, found = brute(rows, search.NEAREST), {}
    for r in search.probable_neighbours(spark, sf).collect():
        found.setdefault(r.vec_id, set()).add(r.neighbour)
    assert len(found) == len(rows)
    assert sum(len(found[i] & set(v)) for i, v in want.items()) >= 0.9 * sum(map(len, want.values()))
    assert max(map(len, found.values())) == search.NEAREST


def test_no_pairs_are_formed_by_a_join(spark):
    plan = search.nearest_vectors(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


@pytest.mark.parametrize("held", [1 << 17, 50])
def test_a_query_travels_once_to_a_share(spark, monkeypatch, held):
    """However many cells it meets there; floats stay floats; of equal similarity the smaller ids; a cell may have several shares."""
    monkeypatch.setattr("tessera.operators.neighbours.MOST_HELD", held)
    rng = np.random.default_rng(8)
    x = rng.standard_normal((400, 8))
    rows = rows_of(np.concatenate([x, x[:30], np.repeat(x[:1], 150, axis=0)]))
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    index = VectorIndex(df, "id", "vector", cells=20)
    asked = index._queries(df, "id", "vector")
    sent = asked.mapInArrow(index.cells.sent(15, False), "query long, share int, cells array<int>, vector array<float>").toArrow()
    assert dict(index.rows.dtypes)["vector"] == dict(asked.dtypes)["vector"] == "array<float>"
    pairs = list(zip(sent["query"].to_pylist(), sent["share"].to_pylist()))
    assert len(set(pairs)) == len(pairs) <= int(index.cells.shares.sum()) * len(rows)
    assert held > 50 or int(index.cells.shares.max()) > 1
    assert lists(index.search(df, "id", "vector", 7, probes=20)) == lists(index.search(df, "id", "vector", 7, probes=3, exact=True))
    assert {len(v) for v in lists(index.search(df, "id", "vector", 7, probes=20)).values()} == {7}
