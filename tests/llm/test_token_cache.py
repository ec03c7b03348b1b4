import pytest
from tokenizers import Tokenizer

from tessera.llm import token_cache as T
from tessera.llm.common import scratch


def brute(rows):
    model = Tokenizer.from_file(T.vocabulary_path())
    return sorted(((k, len((t or "").encode()), len(model.encode(t or "", add_special_tokens=False).ids)) for k, t in rows), key=str)


def rows_of(df):
    return sorted(((r.doc_id, r.n_bytes, r.n_tokens) for r in df.collect()), key=str)


ROWS = [(1, "Hello there,  you'll see"), (2, None), (3, ""), (1, "Hello there,  you'll see"), (4, "a <|endoftext|> b <|endoftext|><|end"), (5, "é日本 ß́   😀\n\n\t x"), (None, "Hello there,  you'll see"), (6, "long " * 30_000), (7, "x" * 5000)]


@pytest.mark.parametrize("ranks", [T.RANKS, None])
def test_counts(spark, ranks):
    docs = spark.createDataFrame([(t, k, 5) for k, t in ROWS], "text string, doc_id long, n_tokens int").repartition(3)
    cache = T.TokenCache(spark, scratch(spark, "t"), T.vocabulary_path(), ranks and T.vocabulary_path(ranks))
    out = cache.count(docs)
    assert rows_of(out) == brute(ROWS)
    assert all(r.over_limit == (r.n_tokens > 1024) for r in out.collect())
    assert cache.entries().count() == len({t or "" for _, t in ROWS})


def test_only_misses_are_encoded(spark):
    cache = T.TokenCache(spark, scratch(spark, "t"), T.vocabulary_path())
    docs = spark.createDataFrame(ROWS, "doc_id long, text string")
    cache.count(docs.limit(4))
    before = cache.entries().count()
    cache.spark.read.parquet(cache.path).createOrReplaceTempView("cached")
    cache.count(docs)
    cache.count(docs)
    stored = spark.read.parquet(cache.path)
    assert before < stored.count() == stored.select("text_digest").distinct().count() == len({t or "" for _, t in ROWS})


def test_empty_table(spark):
    cache = T.TokenCache(spark, scratch(spark, "t"), T.vocabulary_path())
    assert cache.count(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_another_vocabulary_is_refused(spark):
    with pytest.raises(ValueError):
        T.TokenCache(spark, scratch(spark, "t"), T.vocabulary_path(), T.vocabulary_path("byte_bpe_multi_50k.tiktoken"))


def test_the_query_meets_a_cache(spark):
    sf, path = "/root/testdata/sf0.001", scratch(spark, "t")
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    want = brute([tuple(r) for r in docs.collect()])
    spark.conf.set(T.CACHE, path)
    try:
        cache = T.TokenCache(spark, path, T.vocabulary_path())
        cache.fill(docs.where("doc_id < 100"))
        half = spark.read.parquet(path).count()
        assert rows_of(T.op5_token_cache(spark, sf)) == want
        whole = spark.read.parquet(path)
        n = docs.select("text").distinct().count()
        assert 0 < half < n == whole.count() == whole.select("text_digest").distinct().count()
        # counts that are stored are used: spoiled ones come back
        spoiled = scratch(spark, "t")
        whole.selectExpr("text_digest", "n_tokens + 1000000 AS n_tokens", "tokenizer").write.parquet(spoiled)
        spark.conf.set(T.CACHE, spoiled)
        assert rows_of(T.op5_token_cache(spark, sf)) == [(k, n, t + 1_000_000) for k, n, t in want]
        assert spark.read.parquet(spoiled).count() == n
    finally:
        spark.conf.unset(T.CACHE)


@pytest.mark.parametrize("c", [" ", "\n", "\u3000"])
def test_long_runs_of_white_space(spark, c):
    rows = [(1, f"a{c * 2_000_000}b"), (2, c * 1_000_000), (3, "x" * 1_000_000)]
    cache = T.TokenCache(spark, scratch(spark, "t"), T.vocabulary_path(), T.vocabulary_path(T.RANKS))
    assert rows_of(cache.count(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)


def test_both_libraries_agree_on_all_characters():
    path = T.vocabulary_path()
    special = T.specials(path)
    one, two = T.encoder(path), T.ranked_encoder(T.vocabulary_path(T.RANKS), special)
    for low in range(0, 0x110000, 4096):
        texts = ["".join(f"a{c}1{c} {c}{c}!" for c in map(chr, range(i, i + 64)) if not "\ud800" <= c <= "\udfff") for i in range(low, low + 4096, 64)]
        assert one(texts) == two(texts)


def test_a_hot_text_and_repeated_rows(spark):
    rows = [(7, "the same text")] * 3000 + [(i, f"text {i}") for i in range(50)]
    cache = T.TokenCache(spark, scratch(spark, "t"), T.vocabulary_path(), T.vocabulary_path(T.RANKS))
    assert rows_of(cache.count(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))) == brute(rows)
    assert spark.read.parquet(cache.path).count() == 51
