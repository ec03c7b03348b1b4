import re

import numpy as np
import pytest

from tessera.llm import link_trust as L


def place(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    return low, re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]


def rule_of(host, path):
    best = None
    for verdict, h, p in L.RULES:
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(h + p) > len(best[0])):
            best = (h + p, verdict)
    return best or (None, None)


def brute(pages):
    """Dense matrices, and more rounds than any graph needs."""
    rows = [(key, *place(url), html) for key, url, html in pages]
    rows = [(k, h, p, *rule_of(h, p), html) for k, h, p, html in rows]
    links = [(h, "".join(c.lower() if "A" <= c <= "Z" else c for c in t)) for _, h, _, _, _, html in rows if h for t in re.findall(L.LINK, html or "")]
    links = [x for x in links if x[0] != x[1]]
    names = sorted({h for _, h, *_ in rows if h} | {t for _, t in links})
    at = {h: i for i, h in enumerate(names)}
    a = np.zeros((len(names), len(names)))
    for s, t in links:
        a[at[s], at[t]] += 1
    good, seen = np.zeros(len(names)), np.zeros(len(names))
    for _, h, _, _, verdict, _ in rows:
        if h and verdict:
            seen[at[h]] += 1
            good[at[h]] += verdict == "allow"
    share = np.divide(good, seen, out=np.zeros(len(names)), where=seen > 0)
    scores = []
    for m, seed in ((a, share), (a.T, np.where(seen > 0, 1 - share, 0))):
        seed = seed / seed.sum() if seed.sum() else seed
        out = m.sum(1, keepdims=True)
        m = np.divide(m, out, out=np.zeros_like(m), where=out > 0)
        v = seed
        for _ in range(400):
            v = (1 - L.DAMPING) * seed + L.DAMPING * (v @ m)
        scores.append(v)
    blocked = {h for h in names if scores[1][at[h]] > scores[0][at[h]] + 1e-9 and scores[1][at[h]] > L.FLOOR}
    return sorted(((k, h, p, r, v or ("block" if h in blocked else "allow")) for k, h, p, r, v, _ in rows), key=str)


def test_rules_and_edges(spark):
    link = lambda *hosts: "".join(f'<a href="https://{h}/x">' for h in hosts)
    pages = [
        (1, "http://Good.org/a", link("friend.net", "mid.net")),
        (2, "http://a.example.org/es/1", link("x.net")),
        (3, "https://example.org/en/12?x#y", None),
        (4, "http://friend.net", link("good.org", "other.net")),
        (5, "http://bad.net/", link("a.example.org", "SHOP.com", "friend.net")),
        (6, "http://shop.com/de/", "<a href='//bad.net'> <a href=/self>"),
        (7, "http://com/fr/é", link("com")),
        (8, "http://notcom/de/", ""),
        (9, None, link("good.org")),
        (10, "no scheme", None),
        (11, "x://h?://y/de/", link("bad.net")),
        (None, "http://u@WWW.shop.com:80/de/a", None),
        (12, "http://lurker.net/a\nb", link("bad.net", "shop.com")),
        (1, "http://Good.org/a", link("friend.net", "mid.net")),
    ]
    docs = spark.createDataFrame([(k, u, h, "x", "y") for k, u, h in pages], "page_id long, url string, html string, host string, verdict string")
    found = sorted((tuple(r) for r in L.judge(docs).collect()), key=str)
    assert found == brute(pages)
    assert any(r[3] is None and r[4] == "block" for r in found)
    assert L.judge(docs.limit(0)).collect() == []


def test_a_real_table(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "url", "html")
    assert sorted((tuple(r) for r in L.judge(pages).collect()), key=str) == brute([tuple(r) for r in pages.collect()])


@pytest.mark.parametrize("hub", [100_000, 1])
def test_scores_settle_along_a_chain(spark, monkeypatch, hub):
    monkeypatch.setattr(L, "HUB", hub)
    n = 30
    edges = [(f"h{i}", f"h{i + 1}", 1) for i in range(n - 1)] + [("h3", "h1", 2), ("h9", "h20", 1)]
    flow = L.stored(L.flows(spark.createDataFrame(edges, "source string, target string, n long")), "t")
    start = spark.createDataFrame([("trust", "h0", 1.0), ("distrust", f"h{n - 1}", 0.5), ("distrust", "h5", 0.5)], "kind string, host string, seed double")
    found = {(r.kind, r.host): r.score for r in L.propagate(start, flow).collect()}
    a = np.zeros((n, n))
    for s, t, k in edges:
        a[int(s[1:]), int(t[1:])] += k
    for kind, m in (("trust", a), ("distrust", a.T)):
        out = m.sum(1, keepdims=True)
        m = np.divide(m, out, out=np.zeros_like(m), where=out > 0)
        seed = np.zeros(n)
        for r in start.where(f"kind = '{kind}'").collect():
            seed[int(r.host[1:])] = r.seed
        want = np.linalg.solve(np.eye(n) - L.DAMPING * m.T, (1 - L.DAMPING) * seed)
        assert np.allclose([found.get((kind, f"h{i}"), 0) for i in range(n)], want, rtol=1e-4, atol=0)
        assert (want > 0).all()


def test_a_chain_longer_than_any_number_of_rounds(spark):
    """Hosts that link towards a blocked one are blocked as far as distrust counts; those behind are allowed."""
    link = lambda h: f'<a href="http://{h}/">'
    pages = [(0, "http://h0.com/de/", None)] + [(i, f"http://h{i}.net/", link(f"h{i - 1}.net" if i > 1 else "h0.com")) for i in range(1, 5000)]
    out = L.judge(spark.createDataFrame(pages, "page_id long, url string, html string"))
    blocked = sorted(r.page_id for r in out.where("verdict = 'block'").collect())
    assert blocked == [k for k in range(5000) if (1 - L.DAMPING) * L.DAMPING**k > L.FLOOR] and len(blocked) > 100
