import math
import random
import re
from collections import defaultdict

import duckdb
import pytest

from tessera.llm import line_templates as T


def brute(rows, depth=3, min_docs=5, similar=0.5, exact_tokens=10):
    key = lambda r: (-(1 << 63) if r[0] is None else r[0], r[1])
    parsed, whole = [], defaultdict(list)
    for r in {key(r): r for r in rows}.values():
        for i, line in enumerate((r[1] or "").split("\n")):
            w = re.findall(r"[^\x20\x09-\x0D]+", line)
            m = ["<*>" if re.search("[0-9]", t) else t for t in w]
            if m:
                parsed.append((key(r), i, (len(m), *m[:depth]), m))
            if exact_tokens and len(w) >= exact_tokens:
                whole[tuple(w)].append((key(r), i))
    docs = defaultdict(set)
    for k, _, leaf, _ in parsed:
        docs[leaf].add(k)
    parsed = [p for p in parsed if len(docs[p[2]]) >= min_docs]
    often = defaultdict(set)
    for k, _, leaf, m in parsed:
        for j, t in enumerate(m):
            often[leaf, j, t].add(k)
    found = defaultdict(list)
    for k, i, leaf, m in parsed:
        ways = sorted((-len(often[leaf, j, x]), j) for j, x in enumerate(m) if j >= depth and x != "<*>" and len(often[leaf, j, x]) >= min_docs)
        need = math.ceil(similar * (len(m) - depth)) if len(m) > depth else 0
        if len(ways) >= need if need else any(x != "<*>" for x in m):
            fixed = {j for _, j in ways[:need]}
            found[tuple(x if j < depth or j in fixed else "<*>" for j, x in enumerate(m))].append((k, i))
    gone = set()
    for groups, least_docs in ((found, min_docs), (whole, 2)):
        for hits in groups.values():
            if len({k for k, _ in hits}) >= least_docs:
                least = min(k[0] for k, _ in hits)
                gone |= {(k, i) for k, i in hits if k[0] != least}
    out = []
    for r in rows:
        lines = (r[1] or "").split("\n")
        kept = [x for i, x in enumerate(lines) if (key(r), i) not in gone]
        lost = len(lines) - len(kept)
        out.append((r[0], None if r[1] is None else "\n".join(kept), sum(bool(re.search(r"[^\x20\x09-\x0D]", x)) for x in lines), lost))
    return sorted(out, key=str)


def corpus():
    rnd = random.Random(4)
    rows = []
    for i in range(80):
        lines = [" ".join(rnd.choice(["alpha", "beta", "gamma", "d1", "é"]) + rnd.choice("xyz") for _ in range(rnd.randint(1, 9))) for _ in range(rnd.randint(0, 5))]
        if i % 2:
            lines.append(f"Posted by {rnd.choice(['ann', 'bob', 'cy' + str(i)])} on day {i} of  May\t.")
        if i % 3 == 0:
            lines.insert(0, "All rights reserved.")
        rows.append((i, "\n".join(lines) + rnd.choice(["", "\n", "\n\n  \n"])))
    return [*rows, (7, rows[7][1]), (None, rows[9][1]), (100, None), (101, ""), (102, "\n"), (103, "All rights reserved."), (0, "other\nAll rights reserved."), (104, "long line " * 20_000), (105, "All rights reserved.\n" * 500), (106, "a line of ten words that stands in two documents in full"), (107, "first\na line of ten words that stands in two documents in full")]


@pytest.mark.parametrize("few", [8 << 20, 0])
def test_against_direct_parsing(spark, monkeypatch, few):
    monkeypatch.setattr(T, "FEW_BYTES", few)
    rows = corpus()
    docs = spark.createDataFrame([(t, k, "x", 1) for k, t in rows], "text string, doc_id long, leaf string, n_lines int").repartition(3)
    out = T.dedup_lines(docs)
    assert out.columns == ["text", "doc_id", "leaf", "n_lines", "n_dropped"]
    assert sorted(((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in out.collect()), key=str) == brute(rows)
    assert sum(x[3] for x in brute(rows)) > 500


def test_empty_table(spark):
    assert T.dedup_lines(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_the_sql(spark):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = sorted(con.execute(T.SQL).fetchall())
    found = sorted((r.doc_id, r.n_lines, r.n_dropped, r.kept_sha256) for r in T.op2_line_templates(spark, sf).collect())
    assert found == want and sum(r[2] for r in found) > 0


@pytest.mark.parametrize("times", [1, 10])
def test_a_template_is_the_same_however_often_it_occurs(spark, times):
    """Word-valued fields stay variable when the table grows: one document keeps its line."""
    rnd = random.Random(times)
    word = lambda: "".join(rnd.choices("abcdefghij", k=6))
    names, sections = [word() for _ in range(200)], [word() for _ in range(50)]
    rows = [(i, f"Article written by {rnd.choice(names)} for {rnd.choice(sections)} desk today") for i in range(300 * times)]
    out = T.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"))
    assert [r.doc_id for r in out.where("n_dropped = 0").collect()] == [0]


@pytest.mark.parametrize("others", [10, 100, 10_000])
def test_unrelated_lines_of_a_leaf_change_nothing(spark, others):
    """Several templates in one leaf, among other lines of its length that begin alike; one document repeats one line often."""
    rnd = random.Random(others)
    word = lambda: "".join(rnd.choices("abcdefghij", k=8))
    rows = [(i, f"Read more about {word()} on our daily news site") for i in range(40)]
    rows += [(i, "Read more about " + " ".join(f"t{chr(97 + i % 12)}{'abcde'[k]}" for k in range(5)) + f" {word()}") for i in range(40, 280)]
    rows += [(1000 + i, "Read more about " + " ".join(word() for _ in range(6))) for i in range(others)]
    rows += [(999, "\n".join(["Read more about one line that stands here often"] * 300))]
    out = T.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).where("n_dropped = 0 AND doc_id < 1000")
    assert sorted(r.doc_id for r in out.collect()) == [0, *range(40, 52), 999]


def test_lines_that_share_only_their_first_words_stay(spark):
    rnd = random.Random(6)
    rows = [(i, "Was erlytion that. " + " ".join("".join(rnd.choices("abcdefghij", k=7)) for _ in range(1 + i % 3))) for i in range(60)]
    assert T.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).where("n_dropped > 0").isEmpty()


def test_whole_lines_can_be_left_alone(spark):
    line = "one two three four five six seven eight nine ten eleven"
    docs = spark.createDataFrame([(i, line) for i in range(4)], "doc_id long, text string")
    assert T.dedup_lines(docs).where("n_dropped > 0").count() == 3
    assert T.dedup_lines(docs, exact_tokens=None).where("n_dropped > 0").count() == 0


def test_white_space_of_any_kind_parts_tokens(spark):
    """Runs, tabs, vertical tabs, form feeds and returns part tokens, at both ends of a line too; other blanks are letters."""
    rnd = random.Random(12)
    gap = lambda: "".join(rnd.choices(" \t\v\f\r", k=rnd.randint(1, 4)))
    end = lambda: rnd.choice(["", "", gap()])
    words = ["Read", "m2re", "<*>", "é7", "of\u00a0all", "0", "\U0001f600x", "1\u2003b", "our", "site", "at", "length", "now"]
    rows = []
    for i in range(60):
        lines = [end() + gap().join(words[j : j + n]) + end() for j, n in [(0, 3), (0, 8), (0, 13), (1, 2), (2, 5), (2, 1), (1, 1), (i % 9, 4)]]
        lines += [gap(), "Read m2re <*> " + " ".join(words[4:9]), f" {i % 10}  0 1"]
        rnd.shuffle(lines)
        rows.append((i, "\n".join(lines)))
    rows += [(60, " " * 100_000 + "Read\t" + "x" * 100_000 + " " * 100_000), (61, "x" * 300_000 + " 1 y"), (62, " 0 1\u00a0 2")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for options in ({}, {"depth": 0}, {"depth": 1, "exact_tokens": None}):
        found = sorted(((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in T.dedup_lines(docs, **options).collect()), key=str)
        assert found == brute(rows, **options) and sum(x[3] for x in found) > 100


def test_only_lines_of_leaves_that_go_on_are_split_into_tokens(spark, monkeypatch):
    """Making the tokens of all lines was most of the job's CPU seconds."""
    plans, real = {}, T.stored

    def seen(df, name):
        plans[name] = df._jdf.queryExecution().optimizedPlan().toString()
        return real(df, name)

    monkeypatch.setattr(T, "stored", seen)
    T.dedup_lines(spark.createDataFrame([(i, f"a line of tokens {i}") for i in range(8)], "doc_id long, text string"))
    assert plans["line-marks"].count("split(") == 1  # the lines of a text
    before, join, behind = plans["lines"].partition("Join Inner")
    assert join and before.count("split(") == 1 and behind.count("split(") == 1
