import math

import numpy as np
import pytest

from tessera.llm import embedding_links as E

SCHEMA = "label int, embedding array<float>, vec_id long, rid long, weight int"


def brute(rows):
    """Direct comparison of all pairs, in double precision."""
    fit = [k for k, (_, v) in enumerate(rows) if v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    link = {k: set() for k in range(len(rows))}
    for dim in {len(rows[k][1]) for k in fit}:
        own = [k for k in fit if len(rows[k][1]) == dim]
        x = np.array([rows[k][1] for k in own], np.float32).astype(float)
        c = (x @ x.T) / np.sqrt((x * x).sum(1)[:, None] * (x * x).sum(1)[None])
        for i, j in zip(*np.nonzero(c >= 0.95)):
            if i != j:
                link[own[i]].add(own[j])
    least = lambda k: -(1 << 63) if rows[k][0] is None else rows[k][0]
    root = {}
    for k in sorted(link, key=least):
        if k not in root:
            front = [k]
            root[k] = k
            while front:
                for j in link[front.pop()]:
                    if j not in root:
                        root[j] = k
                        front.append(j)
    return sorted(((rows[k][0], len(link[k]), rows[root[k]][0], rows[k][0] == rows[root[k]][0]) for k in link), key=str)


def run(spark, rows):
    df = spark.createDataFrame([(1, v, k, 5, 2) for k, v in rows], SCHEMA).repartition(3)
    return sorted((tuple(r) for r in E.link(df).collect()), key=str)


def crowd(rng, n, dim, spread, centre=None):
    c = rng.standard_normal(dim) if centre is None else centre
    x = c / np.linalg.norm(c) + spread * rng.standard_normal((n, dim)) / math.sqrt(dim)
    return [[float(v) for v in r] for r in (x * rng.uniform(0.5, 3, (n, 1))).astype(np.float32)]


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [1.0, nan]), (6, [inf, 1.0]), (7, [1.0, 2.0]), (8, [2.0, 4.0]), (9, [1.0, 2.0, 0.0]), (None, [1.0, 2.0]), (12, [-1.0, -2.0]), (13, [1e-30, 2e-30]), (14, [1e30, 2.1e30]), (7, [1.0, 2.0]), (15, [5.0]), (16, [3.0]), (17, [-3.0])]
    assert run(spark, rows) == brute(rows)


def test_empty_table(spark):
    assert run(spark, []) == []


@pytest.mark.parametrize("spread", [0.05, 0.2, 0.25, 0.3])
def test_crowds(spark, monkeypatch, spread):
    """Tight and wide groups, chains between groups, and many loners; small blocks."""
    monkeypatch.setattr(E, "BLOCK", 50)
    monkeypatch.setattr(E, "CROWD", 20)
    rng = np.random.default_rng(7)
    a, b = rng.standard_normal(24), rng.standard_normal(24)
    a, b = a / np.linalg.norm(a), b / np.linalg.norm(b)
    bridge = [[float(v) for v in (1 - t) * a + t * b] for t in np.linspace(0, 1, 12)]
    vectors = [*crowd(rng, 300, 24, spread, a), *crowd(rng, 200, 24, 1.5 * spread, b), *bridge, *crowd(rng, 500, 24, 30.0), *crowd(rng, 3, 24, spread)]
    vectors += [vectors[0]] * 40 + [vectors[-1]] * 5
    rows = [(int(k), v) for k, v in zip(rng.permutation(len(vectors)), vectors)]
    assert run(spark, rows) == brute(rows)


def test_lists_alone(spark):
    """Pairs at about the least similarity in a table without crowds."""
    rng = np.random.default_rng(3)
    x = rng.standard_normal((1500, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = rng.standard_normal((1500, 32))
    y -= (y * x).sum(1, keepdims=True) * x
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    t = rng.uniform(0, 1.2 * E.ANGLE, (1500, 1))
    vectors = [*x, *(np.cos(t) * x + np.sin(t) * y)]
    rows = [(k, [float(a) for a in v.astype(np.float32)]) for k, v in enumerate(vectors)]
    found, want = run(spark, rows), brute(rows)
    missed = sum(w[1] - f[1] for f, w in zip(found, want))
    assert 0 <= missed <= 0.002 * sum(w[1] for w in want)


def test_calibration():
    for signs in (0, 5, 12, 26):
        p, n = E.collision(signs), E.lists_for(signs)
        missed = (1 - p) ** n + n * p * (1 - p) ** (n - 1)
        assert missed <= 1 - E.RECALL
    assert E.lists_for(26) < 12 * E.lists_for(10)
