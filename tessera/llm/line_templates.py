"""Line dedup by a tree of line templates, with DataFrame operations only.

A line is parsed to a fixed depth: its number of tokens, then its first `depth` tokens, where a
token with a digit counts as variable. Lines with one such path share a leaf. Below the leaf a
line goes down by its most frequent tokens: of the tokens behind the path, with their places, those
that stand in most documents of the leaf come first (of equally frequent ones the first place), none
in fewer than `min_docs`, until a share `similar` of the places is fixed. Each such way is a
template of its own; its other places are variable. So templates that share a leaf do not dilute
each other, and lines that only share the leaf change nothing, unless they put a word that one
template's variable field holds in more documents than that template has. A line no longer than the
path is a template if its path has a token that is not variable. A line without enough frequent
tokens has no template. A template found in at least `min_docs` documents is boilerplate: its lines
are dropped, but for the document with the smallest id, which keeps them. Lines of `exact_tokens`
tokens or more that stand word for word in two documents are dropped in the same way, unless that
is None.

Leaves of fewer than `min_docs` documents hold no template, so only the lines of the other leaves
go on. Tokens are counted by documents, in two steps, so that a leaf of any size is spread. Tables
of leaves, tokens and templates are broadcast up to a counted number of bytes, and joined by
shuffles beyond it. Lines are told apart by their leaf from the text of their path and a count of
spaces; only those of leaves that go on are split into tokens. Tokens travel as 64-bit hashes of leaf, place and token; templates and whole
lines are compared by 128-bit digests.

Defined results: null and empty texts have no lines and come back as they are; blank lines are
never dropped, and a text that loses nothing is unchanged; rows that repeat id and text count as
one document; rows with the smallest id all keep their lines; a null id counts as the smallest.
Only the id and the text are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import keyed, keyed_columns, scratch_space, stored, table

DEPTH, MIN_DOCS, SIMILAR, EXACT_TOKENS = 3, 5, 0.5, 10
#: Bytes, as counted, up to which a table is broadcast.
FEW_BYTES = 8 << 20

#: White space other than a space that a line may hold.
ODD_SPACES = "\t\v\f\r"
#: A token with a digit; tokens are joined by one space.
VARIABLE = "(?<![^ ])[^ 0-9]*+[0-9][^ ]*+"
WILD = "<*>"


def raw_lines(text: Column) -> Column:
    """The lines of a text, with one space for each run of white space.

    A text is rewritten only if it holds other white space: looking for it costs a small part of a
    regular expression over the whole text.
    """
    text = F.coalesce(text, F.lit(""))
    odd, spaced = F.contains(text, F.lit("  ")), text
    for c in ODD_SPACES:
        odd, spaced = odd | F.contains(text, F.lit(c)), F.replace(spaced, F.lit(c), F.lit(" "))
    return F.split(F.when(odd, F.regexp_replace(spaced, "  +", " ")).otherwise(text), "\n")


def count_tokens(line: Column) -> Column:
    """The number of tokens that one space joins, without making them."""
    return F.when(line != "", F.octet_length(line) - F.octet_length(F.replace(line, F.lit(" "), F.lit(""))) + 1).otherwise(0)


def masked_path(line: Column, depth: int) -> Column:
    """The first tokens, joined by one space, variable ones as WILD."""
    return F.regexp_replace(F.substring_index(line, " ", depth), VARIABLE, WILD)


def leaf(n: Column, path: Column) -> Column:
    return F.xxhash64(n, path)


def small(df: DataFrame) -> DataFrame:
    """Broadcast where a count of its bytes shows that it is small."""
    sizes = [F.coalesce(F.aggregate(f.name, F.lit(0), lambda n, x: n + F.octet_length(x) + 8), F.lit(0)) if f.dataType.simpleString() == "array<string>" else F.lit(16) for f in df.schema.fields]
    n = df.agg(F.sum(sum(sizes[1:], sizes[0]) + 32)).head()[0] or 0
    return F.broadcast(df) if n <= FEW_BYTES else df


def digest(text: Column) -> Column:
    return F.unhex(F.md5(text.cast("binary")))


def template_lines(docs: DataFrame, marks: DataFrame, depth: int, min_docs: int, similar: float) -> DataFrame:
    """(kd, th, i, least): lines of templates that stand in enough documents, with the smallest id of those."""
    leaves = marks.select(F.explode(F.array_distinct("leaves")).alias("leaf")).where("leaf IS NOT NULL").groupBy("leaf").agg(F.count("*").alias("n"))
    leaves = stored(leaves.where(F.col("n") >= min_docs).select("leaf"), "leaves")
    lines = docs.select("kd", "th", F.posexplode(raw_lines(F.col("text"))).alias("i", "line")).withColumn("line", F.trim("line")).where("line <> ''")
    lines = lines.withColumns({"n": count_tokens(F.col("line")), "path": masked_path(F.col("line"), depth)}).withColumn("leaf", leaf(F.col("n"), F.col("path")))
    # only lines of leaves that may hold a template are split into tokens
    lines = lines.join(small(leaves), "leaf").withColumn("line", F.split("line", " "))
    # the tokens behind the path with their places, but for variable ones
    behind = F.transform(F.slice("line", depth + 1, F.greatest(F.size("line") - depth, F.lit(0))), lambda t, i: F.when(~t.rlike("[0-9]") & (t != WILD), F.struct(i.alias("place"), t.alias("token"))))
    need = F.ceil(F.greatest(F.col("n") - depth, F.lit(0)) * similar).cast("int")
    # a token of a leaf at a place, as a number
    keys = F.transform(F.filter(behind, lambda t: t.isNotNull()), lambda t: F.struct(t["place"].alias("place"), F.xxhash64("leaf", t["place"], t["token"]).alias("key")))
    own = [F.monotonically_increasing_id().alias("line"), "kd", "th", "i", "n", need.alias("need"), "path", keys.alias("keys")]
    held = stored(lines.select(*own), "lines")
    # every line's tokens count, also of one that has too few for a template
    each = held.select("line", (F.size("keys") >= F.col("need")).alias("enough"), F.xxhash64("kd", "th").alias("doc"), F.inline("keys"))
    often = each.groupBy("key", "doc").agg(F.lit(1).alias("one")).groupBy("key").agg(F.count("*").alias("docs")).where(F.col("docs") >= min_docs)
    often = stored(often, "tokens").hint("merge")  # the same join at every size; a frequent token's rows can be split
    ranked = each.where("enough").select("line", "place", "key").join(often, "key").groupBy("line").agg(F.array_sort(F.collect_list(F.struct((-F.col("docs")).alias("first"), "place", "key"))).alias("ranked"))
    fixed = F.array_sort(F.transform(F.slice("ranked", 1, F.col("need")), lambda t: F.struct(t["place"].alias("place"), t["key"].alias("key"))))
    found = held.select("line", "kd", "th", "i", "n", "need", "path").join(ranked, "line").where(F.size("ranked") >= F.col("need"))
    found = found.select("kd", "th", "i", "n", "path", F.transform(fixed, lambda t: F.concat_ws(" ", t["place"].cast("string"), t["key"].cast("string"))).alias("fixed"))
    short = held.where(F.col("n") <= depth).where(F.exists(F.split("path", " "), lambda t: t != WILD)).select("kd", "th", "i", "n", "path", F.array().cast("array<string>").alias("fixed"))
    text = F.array_join(F.concat(F.array(F.col("n").cast("string"), F.col("path")), "fixed"), "\n")
    found = stored(found.unionByName(short).select("kd", "th", "i", digest(text).alias("template")), "templates")
    per_doc = found.groupBy("template", "kd", "th").agg(F.lit(1).alias("one"))
    recurring = per_doc.groupBy("template").agg(F.count("*").alias("docs"), F.min("kd").alias("least")).where(F.col("docs") >= min_docs)
    return found.join(small(stored(recurring.select("template", "least"), "recurring")), "template").select("kd", "th", "i", "least")


def exact_lines(marks: DataFrame) -> DataFrame:
    """(kd, th, i, least): long lines that stand in more than one document."""
    each = marks.select(F.struct("kd", "th").alias("doc"), F.explode(F.array_distinct("digests")).alias("line")).where("line IS NOT NULL")
    again = each.groupBy("line").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).where("first <> last")
    again = stored(again.select("line", F.col("first.kd").alias("least")), "exact-lines")
    lines = marks.select("kd", "th", F.posexplode("digests").alias("i", "line")).where("line IS NOT NULL")
    return lines.join(small(again), "line").select("kd", "th", "i", "least")


def dropped_lines(docs: DataFrame, depth: int, min_docs: int, similar: float, exact_tokens: int | None) -> DataFrame:
    """(kd, th, gone): the numbers of the lines that each document loses."""
    parsed = docs.select("kd", "th", F.transform(raw_lines(F.col("text")), lambda line: F.trim(line)).alias("lines"))
    parsed = parsed.withColumn("sizes", F.transform("lines", count_tokens))
    marks = [F.zip_with("lines", "sizes", lambda line, n: F.when(n > 0, leaf(n, masked_path(line, depth)))).alias("leaves")]
    if exact_tokens is not None:
        marks.append(F.zip_with("lines", "sizes", lambda line, n: F.when(n >= exact_tokens, digest(line))).alias("digests"))
    # hashes of lines are a small part of the texts, and are read again for each count
    marks = stored(parsed.select("kd", "th", *marks), "line-marks")
    found = template_lines(docs, marks, depth, min_docs, similar)
    if exact_tokens is not None:
        found = found.unionByName(exact_lines(marks))
    return found.where(F.col("kd") != F.col("least")).groupBy("kd", "th").agg(F.collect_set("i").alias("gone"))


def dedup_lines(
    docs: DataFrame, depth: int = DEPTH, min_docs: int = MIN_DOCS, similar: float = SIMILAR, exact_tokens: int | None = EXACT_TOKENS, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """The rows of docs with text replaced, and n_lines, n_dropped in place of any columns of these names."""
    with scratch_space(docs.sparkSession) as keep:
        gone = keep(stored(dropped_lines(keyed(docs, id_col, text_col), depth, min_docs, similar, exact_tokens), "dropped-lines"))
    others = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    rows = docs.select(*others).withColumns(keyed_columns(id_col, text_col))
    # documents that lose lines grow with the corpus, so the same join is used at every size
    gone = gone.select(F.col("kd").alias("__kd"), F.col("th").alias("__th"), F.col("gone").alias("__gone")).hint("merge")
    rows = rows.join(gone, ["__kd", "__th"], "left")
    rows = rows.withColumn("__lines", F.split(F.coalesce(F.col(text_col), F.lit("")), "\n"))
    left = F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), F.col("__gone"))
    text = F.when(F.col("__gone").isNull(), F.col(text_col)).otherwise(F.array_join(F.transform(left, lambda i: F.get("__lines", i)), "\n"))
    count = F.size(F.filter("__lines", lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))).cast("long")
    lost = F.coalesce(F.size("__gone"), F.lit(0)).cast("long")
    out = rows.select(*[text.alias(c) if c == text_col else F.col(c) for c in others], count.alias("n_lines"), F.when(F.col("__gone").isNull(), 0).otherwise(lost).cast("long").alias("n_dropped"))
    return out


def op2_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT r, doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS i FROM d),
t AS (SELECT r, doc_id, i, w, list_transform(w, lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN '{WILD}' ELSE x END) AS m
      FROM (SELECT r, doc_id, i, list_filter(regexp_split_to_array(line, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM l)),
p AS (SELECT r, doc_id, i, m, len(m) AS n, m[1:{DEPTH}] AS path FROM t WHERE len(m) > 0),
f AS (SELECT n, path FROM p GROUP BY n, path HAVING count(DISTINCT r) >= {MIN_DOCS}),
c AS (SELECT p.* FROM p JOIN f ON p.n = f.n AND p.path = f.path),
k AS (SELECT * FROM (SELECT r, doc_id, i, n, path, unnest(m) AS tok, unnest(range(len(m))) AS pos FROM c) WHERE tok <> '{WILD}' AND pos >= {DEPTH}),
o AS (SELECT n, path, pos, tok, count(DISTINCT r) AS docs FROM k GROUP BY n, path, pos, tok HAVING count(DISTINCT r) >= {MIN_DOCS}),
g AS (SELECT k.r, k.doc_id, k.i, k.n, k.path, list({{'pos': k.pos, 'tok': k.tok}} ORDER BY o.docs DESC, k.pos) AS ranked
      FROM k JOIN o ON k.n = o.n AND k.path = o.path AND k.pos = o.pos AND k.tok = o.tok GROUP BY k.r, k.doc_id, k.i, k.n, k.path),
h AS (SELECT r, doc_id, i, {{'n': n, 'path': path, 'fixed': list_sort(ranked[1:ceil({SIMILAR} * (n - {DEPTH}))::BIGINT])}} AS template FROM g WHERE len(ranked) >= ceil({SIMILAR} * (n - {DEPTH}))
      UNION ALL SELECT r, doc_id, i, {{'n': n, 'path': path, 'fixed': []}} AS template FROM c WHERE n <= {DEPTH} AND len(list_filter(path, lambda x: x <> '{WILD}')) > 0),
w AS (SELECT template, min(doc_id) AS least FROM h GROUP BY template HAVING count(DISTINCT r) >= {MIN_DOCS}),
e AS (SELECT w, min(doc_id) AS least FROM t WHERE len(w) >= {EXACT_TOKENS} GROUP BY w HAVING count(DISTINCT r) > 1),
x AS (SELECT h.r, h.i FROM h JOIN w ON h.template = w.template WHERE h.doc_id <> w.least
      UNION SELECT t.r, t.i FROM t JOIN e ON t.w = e.w WHERE t.doc_id <> e.least),
y AS (SELECT l.r, count(x.i) AS n_dropped, coalesce(string_agg(CASE WHEN x.i IS NULL THEN line END, chr(10) ORDER BY l.i), '') AS kept,
             count(*) FILTER (regexp_matches(line, '[^\\x20\\x09-\\x0D]')) AS n_lines
      FROM l LEFT JOIN x ON l.r = x.r AND l.i = x.i GROUP BY l.r)
SELECT d.doc_id, CAST(n_lines AS BIGINT) AS n_lines, CAST(n_dropped AS BIGINT) AS n_dropped, sha256(kept) AS kept_sha256 FROM d JOIN y USING (r)
"""
