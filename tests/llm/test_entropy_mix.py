import math
import re
from collections import defaultdict

import pytest

from tessera.llm import common
from tessera.llm import entropy_mix as E


def size_of(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def brute_targets(totals, weights=(3, 1, 2), share=1.5, most=2):
    """Repeats the resharing until no source is above its cap."""
    names = sorted((s for s in totals if s is not None), key=lambda s: s.encode()) + [None] * (None in totals)
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    wanted, capped = share * sum(totals.values()), set()
    while True:
        left = wanted - sum(most * totals[s] for s in capped)
        free = sum(w[s] for s in totals if s not in capped)
        t = {s: most * totals[s] if s in capped else left * w[s] / free for s in totals}
        over = {s for s in totals if s not in capped and t[s] > most * totals[s]}
        if not over:
            return t
        capped |= over


def check(rows, out):
    """The limits, and that no single copy more or less would bring a source nearer to its target."""
    sizes = defaultdict(list)
    for _, source, text in rows:
        sizes[source].append(size_of(text))
    totals = {s: sum(v) for s, v in sizes.items()}
    want = brute_targets(totals)
    taken, more, less = defaultdict(int), defaultdict(list), defaultdict(list)
    for r in out:
        assert r.source_size == totals[r.source]
        assert math.isclose(r.target, want[r.source], rel_tol=1e-6, abs_tol=1e-6)
        assert r.copies in (0, 1, 2) and (r.size or r.copies == 0)
        taken[r.source] += r.size * r.copies
        if r.size:
            more[r.source] += [r.size] * (r.copies < 2)
            less[r.source] += [r.size] * (r.copies > 0)
    for s in totals:
        gap = want[s] - taken[s]
        assert abs(gap) < min((more if gap > 0 else less)[s], default=1) + 1e-6 * max(1, want[s])


def test_a_real_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "source", "text").collect()]
    out = E.mix(docs).collect()
    assert len(out) == len(rows)
    check(rows, out)
    again = {(r.doc_id, r.copies) for r in E.mix(docs.repartition(7)).collect()}
    assert again == {(r.doc_id, r.copies) for r in out}


def test_rates_solve_the_dual(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    sums, tilts = defaultdict(float), defaultdict(set)
    for r in E.mix(docs).collect():
        sums[r.source, r.target] += r.size * r.rate
        if 0 < r.rate < 2:
            tilts[r.source].add(round(math.log(r.rate) / r.size, 9))
    assert all(math.isclose(v, t, rel_tol=1e-6) for (_, t), v in sums.items())
    assert all(len(v) == 1 for v in tilts.values())


@pytest.mark.parametrize("few", [10_000, 0])
def test_edge_cases(spark, monkeypatch, few):
    monkeypatch.setattr(E, "FEW_SOURCES", few)
    rows = [(i, "hot", "a b c") for i in range(300)] + [(i, f"s{i % 7}", "x " * (i % 50)) for i in range(300, 600)]
    rows += [(None, None, "a b"), (1, None, None), (2, "only empty", ""), (3, "only null", None), (4, "one long", "w " * 50_000), (5, "é", "a\x0bb\u00a0c d"), (5, "é", "a\x0bb\u00a0c d")]
    docs = spark.createDataFrame([(*r, 1, 2.0) for r in rows], "doc_id long, source string, text string, rank int, target double")
    check(rows, E.mix(docs).collect())
    assert E.mix(docs.limit(0)).collect() == []
    assert {r.copies for r in E.mix(docs.where("text IS NULL")).collect()} == {0}


@pytest.mark.parametrize("run", [7, 4096])
def test_repeated_rows_reach_the_target(spark, monkeypatch, run):
    monkeypatch.setattr(common, "RUN", run)
    rows = [(1, "a", "w x y z")] * 2000 + [(i, "b", "p q") for i in range(2, 502)] + [(1, "b", "w x y z")] * 3
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(3)
    out = E.mix(docs).collect()
    check(rows, out)
    assert len(out) == len(rows) and sum(r.copies > 1 for r in out if r.source == "a") not in (0, 2000)
    again = sorted((r.doc_id, r.source, r.copies) for r in E.mix(docs.repartition(5)).collect())
    assert again == sorted((r.doc_id, r.source, r.copies) for r in out)


def test_an_unsolved_dual_is_an_error(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = E.sized(docs)
    sources = rows.groupBy("source").agg(E.F.sum("size").alias("total"), E.F.count("*").alias("documents"))
    histogram = rows.groupBy("source", "size").agg(E.F.count("*").alias("n"))
    with pytest.raises(RuntimeError, match="not solved"):
        E.solve(E.targets(sources), histogram, True, rounds=2)
