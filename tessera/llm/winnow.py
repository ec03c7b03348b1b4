"""Benchmark decontamination by winnowing, with DataFrame operations only.

Texts become words (ASCII letters lower-cased, everything else that is not a letter or digit
in ASCII separates). Every window of `window` words has a fingerprint: the least hash among its
grams of `gram` words. Equal windows have equal fingerprints, so joining the fingerprints of
documents and benchmark finds every shared window. Hits are extended exactly: the document's
windows with a joined fingerprint are compared, as text, with the benchmark's.

An item with fewer words than a window is a window by itself. Its fingerprint is its own least
gram hash (or its only word's hash, where it has fewer words than a gram); documents are then
fingerprinted at that length too, for each length that the benchmark has, in the same pass.

Work on documents: one pass hashes the words once and makes the distinct fingerprints of each
document (nothing is shuffled but these, and none at all while the benchmark's windows stay
under a stated number of bytes and are broadcast); a second pass joins the few documents with
hits to their texts. Places are joined to the distinct windows first, and items only to the
distinct windows that a document has.

Defined results: null and empty texts have no words and are clean; items without words are left
out; items with one id count once, and all items without an id count as one, which has no id to
list; a hit word counts once however many windows cover it. Rows are told apart by id and text,
so repeated rows each get their result.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.common import keyed, keyed_columns, scratch_space, stored, table

WINDOW, GRAM = 13, 5
#: One hit word in so many contaminates a document.
ONE_IN = 20
#: Bytes, as counted, up to which windows of the benchmark or results of hits are broadcast.
FEW_BYTES = 24 << 20

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words in lower case; what separates words, and words, before letters are lower-cased. The
#: last is written without a complement, which the regex engine matches three times as fast.
WORD = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
SEPARATORS = "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
ANY_WORD = "[0-9A-Za-z\\x80-\\x{10FFFF}]+"


def lowered(word: Column) -> Column:
    """A-Z in lower case, nothing else changed; lower() does just that to ASCII, and faster."""
    return F.when(F.octet_length(word) == F.char_length(word), F.lower(word)).otherwise(F.translate(word, UPPER, LOWER))


def words(text: Column) -> Column:
    found = F.filter(F.split(F.coalesce(text, F.lit("")), SEPARATORS), lambda w: w != "")
    return F.transform(found, lowered)


def runs(values: Column, at: list[int], f) -> Column:
    """f over the elements at the given distances from each place of an array column, as far as the last one reaches."""
    first = F.slice(values, 1, F.greatest(F.size(values) - at[-1], F.lit(0)))
    return F.transform(first, lambda _, i: f(*[F.get(values, i + j) for j in at]))


def with_fingerprints(rows: DataFrame, hashes: str, lengths: list[int], gram: int) -> DataFrame:
    """Adds fp_<k>, the least gram hash of each run of k words, for all lengths k, given the words' hashes.

    Each array is a column of its own, so that it is made once and not in every reference to it.
    """
    for g in sorted({min(gram, k) for k in lengths}):
        rows = rows.withColumn(f"gram_{g}", runs(F.col(hashes), list(range(g)), F.xxhash64))
    for k in lengths:
        own, out = F.col(f"gram_{min(gram, k)}"), f"fp_{k}"
        width = k - min(gram, k) + 1
        part = math.isqrt(width)  # least of short runs, then of those that make up the whole width
        rows = rows.withColumn(out, runs(own, list(range(part)), F.least) if part > 1 else own)
        at = [*range(0, width - part, part), width - part]
        rows = rows.withColumn(out, runs(F.col(out), at, F.least)) if len(at) > 1 else rows
    return rows


def of_all_lengths(lengths: list[int], f: Callable[[int], Column]) -> Column:
    """The arrays of all lengths in one."""
    return F.concat(*[f(k) for k in lengths])


def benchmark_windows(benchmark: DataFrame, window: int, gram: int, id_col: str, text_col: str) -> DataFrame:
    """(item_id, length, fp, span): the distinct windows of each item, as text."""
    rows = benchmark.select(F.col(id_col).cast("string").alias("item_id"), words(F.col(text_col)).alias("w")).where(F.size("w") > 0)
    rows = rows.withColumn("length", F.least(F.size("w"), F.lit(window)))
    spans = F.transform(F.sequence(F.lit(1), F.size("w") - F.col("length") + 1), lambda i: F.array_join(F.slice("w", i, F.col("length")), " "))
    rows = rows.select("item_id", "length", F.explode(F.array_distinct(spans)).alias("span"))
    rows = rows.withColumn("h", F.transform(F.split("span", " "), lambda w: F.xxhash64(w)))
    most = min(gram, window)
    # the same gram size as for documents: a shorter item than a gram is hashed as a whole
    fps = F.lit(None).cast("array<long>")
    for g in range(1, most + 1):
        fps = F.when(F.least(F.size("h"), F.lit(most)) == g, runs(F.col("h"), list(range(g)), F.xxhash64)).otherwise(fps)
    return rows.select("item_id", "length", F.array_min(fps).alias("fp"), "span")


def small(df: DataFrame, n_bytes: int) -> DataFrame:
    return F.broadcast(df) if n_bytes <= FEW_BYTES else df


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of docs with n_words, n_hit, n_items and items (sorted item ids, as strings) in place of any columns of these names."""
    with scratch_space(docs.sparkSession) as keep:
        hit, n_bytes = _hits(keyed(docs, id_col, text_col), benchmark, window, gram, item_id, item_text, keep)
    others = [c for c in docs.columns if c not in ("n_words", "n_hit", "n_items", "items")]
    n_words = F.coalesce(F.regexp_count(F.col(text_col), F.lit(ANY_WORD)), F.lit(0)).cast("long")
    if hit is None:
        zero = F.lit(0).cast("long")
        return docs.select(*others, n_words.alias("n_words"), zero.alias("n_hit"), zero.alias("n_items"), F.array().cast("array<string>").alias("items"))
    hit = small(hit.select(*[F.col(c).alias(f"__{c}") for c in ("kd", "th", "digest", "n_hit", "n_items", "items")]), n_bytes)
    own = keyed_columns(id_col, text_col) | {"__digest": F.sha2(F.col(text_col).cast("string"), 256)}
    out = docs.select(*others).withColumns(own).join(hit, ["__kd", "__th", "__digest"], "left")
    return out.select(
        *others, n_words.alias("n_words"), F.coalesce("__n_hit", F.lit(0)).alias("n_hit"), F.coalesce("__n_items", F.lit(0)).alias("n_items"), F.coalesce("__items", F.array().cast("array<string>")).alias("items")
    )


def _hits(rows: DataFrame, benchmark: DataFrame, window: int, gram: int, item_id: str, item_text: str, keep: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame | None, int]:
    """(kd, th, digest, n_hit, n_items, items) of the documents with hits, and about how many bytes that is."""
    spans = stored(benchmark_windows(benchmark, window, gram, item_id, item_text), "benchmark-windows")
    n_bytes = spans.agg(F.sum(F.octet_length("span") + F.coalesce(F.octet_length("item_id"), F.lit(0)) + 48)).head()[0]
    lengths = sorted(r[0] for r in spans.select("length").distinct().collect())  # at most `window` numbers
    if not lengths:
        return None, 0
    marks, windows_ = spans.select("length", "fp").distinct(), spans.select("length", "span").distinct()
    hashed = rows.select("kd", "th", F.transform(words(F.col("text")), lambda w: F.xxhash64(w)).alias("h"))
    own = of_all_lengths(lengths, lambda k: F.transform(F.array_distinct(f"fp_{k}"), lambda fp: F.struct(F.lit(k).alias("length"), fp.alias("fp"))))
    found = with_fingerprints(hashed, "h", lengths, gram).select("kd", "th", F.explode(own).alias("f")).select("kd", "th", "f.length", "f.fp")
    found = found.join(small(marks, n_bytes), ["length", "fp"], "left_semi")
    # a document's own fingerprints that the benchmark has; repeated rows agree on them
    matched = stored(found.distinct(), "matched")
    near = rows.join(matched.select("kd", "th").distinct(), ["kd", "th"]).dropDuplicates(["kd", "th", "text"])
    near = stored(near.select(F.monotonically_increasing_id().alias("row"), "kd", "th", F.sha2("text", 256).alias("digest"), words(F.col("text")).alias("w")), "near-texts")
    # consecutive windows share their fingerprint; each place looks its own up by a join, so a long text with many hits takes time in proportion
    marked = with_fingerprints(near.select("row", F.transform("w", lambda w: F.xxhash64(w)).alias("h")), "h", lengths, gram)
    places = of_all_lengths(lengths, lambda k: F.transform(f"fp_{k}", lambda fp, i: F.struct(F.lit(k).alias("length"), i.alias("at"), fp.alias("fp"))))
    places = marked.select("row", F.explode(places).alias("p")).select("row", "p.length", "p.at", "p.fp")
    wanted = near.select("row", "kd", "th").join(matched, ["kd", "th"]).select("row", "length", "fp")
    places = places.join(wanted, ["row", "length", "fp"], "left_semi").groupBy("row").agg(F.collect_list(F.struct("length", "at")).alias("places"))
    spans_at = F.transform("places", lambda p: F.struct(p["length"].alias("length"), p["at"].alias("at"), F.array_join(F.slice("w", p["at"] + 1, p["length"]), " ").alias("span")))
    starts = near.join(places, "row").select("kd", "th", "digest", F.explode(spans_at).alias("p")).select("kd", "th", "digest", "p.length", "p.at", "p.span")
    hits = stored(starts.join(small(windows_, n_bytes), ["length", "span"], "left_semi"), "hit-places")
    end = F.col("at") + F.col("length")
    before = F.max(end).over(W.partitionBy("kd", "th", "digest").orderBy("at", "length").rowsBetween(W.unboundedPreceding, -1))
    fresh = hits.select("kd", "th", "digest", F.greatest(F.lit(0), end - F.greatest("at", F.coalesce(before, F.col("at")))).alias("fresh"))
    covered = fresh.groupBy("kd", "th", "digest").agg(F.sum("fresh").cast("long").alias("n_hit"))
    named = hits.select("kd", "th", "digest", "length", "span").distinct().join(small(spans.select("item_id", "length", "span"), n_bytes), ["length", "span"])
    nameless = F.max(F.col("item_id").isNull().cast("long"))
    named = named.groupBy("kd", "th", "digest").agg(F.array_sort(F.collect_set("item_id")).alias("items"), nameless.alias("nameless"))
    hit = covered.join(named, ["kd", "th", "digest"]).select("kd", "th", "digest", "n_hit", (F.size("items") + F.col("nameless")).alias("n_items"), "items")
    hit = keep(stored(hit, "hits"))
    sizes = F.coalesce(F.aggregate("items", F.lit(0), lambda n, x: n + F.octet_length(x) + 16), F.lit(0))
    return hit, hit.agg(F.sum(sizes + 160)).head()[0] or 0


def contaminated(n_hit: Column, n_words: Column, one_in: int = ONE_IN) -> Column:
    return (n_hit > 0) & (n_hit * one_in >= n_words)


def op6_winnow(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select(
        "doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"),
    )


SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS w FROM benchmark),
s AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS span
      FROM (SELECT item_id, w, least(len(w), {WINDOW}) AS k, unnest(range(1, len(w) - least(len(w), {WINDOW}) + 2)) AS i FROM b WHERE len(w) > 0)),
g AS (SELECT r, i, k, array_to_string(w[i:i + k - 1], ' ') AS span FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM s) WHERE len(w) >= k)),
m AS (SELECT g.r, g.i, g.k, s.item_id FROM g JOIN s ON g.k = s.k AND g.span = s.span),
c AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + k)) AS p FROM m) GROUP BY r),
t AS (SELECT r, list_sort(list(DISTINCT item_id) FILTER (item_id IS NOT NULL)) AS items, max(CAST(item_id IS NULL AS BIGINT)) AS nameless FROM m GROUP BY r)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(len(items), 0) + coalesce(nameless, 0) AS BIGINT) AS n_items,
       sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(n_hit > 0 AND {ONE_IN} * n_hit >= len(w), false) AS contaminated
FROM d LEFT JOIN c USING (r) LEFT JOIN t USING (r)
"""
