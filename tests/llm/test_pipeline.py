from collections import Counter

import corpus_pipeline as C
import duckdb

from tests.llm.test_entropy_mix import brute_targets, size_of
from tests.llm.test_jaccard_join import brute as classes
from tests.llm.test_line_templates import brute as templates
from tests.llm.test_winnow import brute as hits


def test_each_stage_against_its_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    extra = [(9000, None, "en", "src1", 0), (9001, "", "en", "src1", 0), (9002, "12 34 56", "en", "src2", 8), (9003, docs.first().text, None, None, 1), (0, docs.orderBy("doc_id").first().text, "en", "src0", 1)]
    docs = docs.select(*C.COLUMNS).unionByName(spark.createDataFrame(extra, docs.select(*C.COLUMNS).schema))
    rows = lambda df: sorted(((r.doc_id, r.text) for r in df.collect()), key=str)
    texts = [tuple(r) for r in docs.select("doc_id", "text").collect()]

    kept = C.stored(C.language(spark, docs, sf), "t")
    assert kept.columns == C.COLUMNS
    assert rows(kept) == sorted((x for x in texts if any(c.isalpha() for c in x[1] or "")), key=str)
    assert kept.where("lang IS NULL").count() == 0

    before = rows(kept)
    kept = C.stored(C.lines(spark, kept, sf), "t")
    want = templates(before, exact_tokens=None)
    assert rows(kept) == sorted(((k, t) for k, t, n, lost in want if not lost or lost < n), key=str)
    assert all(r.n_chars == len(r.text) for r in kept.collect() if r.n_chars > 1)

    before = rows(kept)
    kept = C.stored(C.near_duplicates(spark, kept, sf), "t")
    found = classes(before)
    assert Counter(k for k, _ in rows(kept)) == Counter({c: 1 for _, c, _ in found})

    before = rows(kept)
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    kept = C.stored(C.decontaminate(spark, kept, sf), "t")
    bad = {k for k, n, hit, _, _ in hits(before, items) if hit and 20 * hit >= n}
    assert rows(kept) == [x for x in before if x[0] not in bad]

    sizes = [(r.source, size_of(r.text)) for r in kept.collect()]
    mixed = C.mixture(spark, kept, sf)
    assert mixed.columns == [*C.COLUMNS, "copy"]
    taken = Counter()
    for r in mixed.collect():
        taken[r.source] += size_of(r.text)
    totals = Counter()
    for s, n in sizes:
        totals[s] += n
    for s, t in brute_targets(totals).items():
        assert abs(taken[s] - t) <= 0.51 * max(n for x, n in sizes if x == s) + 1


CASES = [
    (1, "some plain words of one language here", "en", "a", 37), (2, None, "en", "a", 0), (3, "", None, None, 0), (None, "some other plain words with a null id", "en", None, 38),
    (4, "long text of many words " * 20_000, "en", "b", 480_000), (5, "repeated row with its words", "en", "a", 27), (5, "repeated row with its words", "en", "a", 27), (5, "repeated row with its words", "fr", "a", 27),
    (5, "the same id and another text", "en", "a", 28), (6, "123 456", "en", "b", 7),
]


def test_edge_cases_of_each_stage(spark):
    """Nulls, empty and long texts, repeated rows and columns of clashing names, and an empty table."""
    sf = "/root/testdata/sf0.001"
    plain = spark.createDataFrame(CASES, "doc_id long, text string, lang string, source string, n_chars long")
    docs = plain.selectExpr("*", "1 AS kd", "'x' AS th", "2 AS __kd", "3 AS n_lines", "4 AS copies", "'y' AS lang_pred", "5 AS copy", "6 AS items")
    ids = lambda df: sorted((r.doc_id if r.doc_id is not None else -1 for r in df.collect()))
    for name, stage in C.STAGES:
        assert stage(spark, docs.limit(0), sf).collect() == [], name
    kept = C.language(spark, docs, sf)
    assert kept.columns == C.COLUMNS and ids(kept) == [-1, 1, 4, 5, 5, 5, 5]
    kept = C.lines(spark, docs, sf)
    assert kept.columns == C.COLUMNS and ids(kept) == [-1, 1, 2, 3, 4, 5, 5, 5, 5, 6]
    kept = C.near_duplicates(spark, docs, sf)
    assert kept.columns == C.COLUMNS and ids(kept) == [-1, 1, 2, 3, 4, 5, 5, 6]
    kept = C.decontaminate(spark, docs, sf)
    assert kept.columns == C.COLUMNS and ids(kept) == [-1, 1, 2, 3, 4, 5, 5, 5, 5, 6]
    mixed = C.mixture(spark, docs, sf)
    assert mixed.columns == [*C.COLUMNS, "copy"] and not {2, 3} & set(ids(mixed))


def test_repeated_rows_share_their_copies(spark):
    rows = [(1, "w x y z", "en" if i % 3 else None, "a", 7) for i in range(900)] + [(i, "p q", "en", "b", 3) for i in range(2, 302)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    out = C.mixture(spark, docs, "").collect()
    words = Counter()
    for r in out:
        words[r.source] += size_of(r.text)
    want = brute_targets({"a": 3600, "b": 600})
    assert all(abs(words[s] - t) <= 4 for s, t in want.items())
    each = Counter(r.lang for r in out if r.source == "a")
    assert abs(each["en"] - 2 * each[None]) <= 3 and {r.copy for r in out} <= {1, 2}
    assert Counter((r.lang, r.copy) for r in out if r.source == "a")["en", 1] == 600


def test_run_applies_the_stages_in_order(spark):
    assert [n for n, _ in C.STAGES] == ["language ID", "line dedup", "n-gram Jaccard join", "benchmark decontamination", "mixing sources"]
    out = C.run(spark, "/root/testdata/sf0.001")
    n = duckdb.sql("SELECT count(*) FROM '/root/testdata/sf0.001/documents.parquet'").fetchall()[0][0]
    assert 0 < out.select("doc_id").distinct().count() < n
