import hashlib
import itertools
import random
import re
import zlib

import duckdb
import pytest

from tessera.llm import conversation_repair as R

SCHEMA = "text string, conv_id long, seg long, turn long, role string, at int"
BLANK, END = re.compile(r"[^\x20\x09-\x0D]"), re.compile(r"[.!?][\x20\x09-\x0D]*\Z")


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (kind and 1 + (kind == 3))
    return out


def every_way(kinds):
    """All edits of a few rows with at most two insertions at a place."""
    gaps = [("", ""), ("I", "u"), ("I", "a"), ("II", "ua"), ("II", "au")]
    of_row = []
    for initial, gone, cut in kinds:
        more = 5 * cut
        of_row.append([("D", "", 2)] + ([] if gone else [("K", initial, more), ("R", "u", 1 + more), ("R", "a", 1 + more)]))
    best = None
    for chosen in itertools.product(*of_row):
        for between in itertools.product(gaps, repeat=len(kinds) + 1):
            emitted = "".join(b[1] + (c[1] or "") for b, c in zip(between, [*chosen, ("", "", 0)]))
            if "-" not in emitted and re.fullmatch("(s?(ua)+)?", emitted):
                labels = "".join(b[0] + c[0] for b, c in zip(between, [*chosen, ("", "", 0)]))
                cost = sum(c[2] for c in chosen) + 5 * sum(len(b[0]) for b in between)
                best = min(best or (cost, labels, emitted), (cost, labels, emitted))
    return best


def brute(rows):
    out, broken = [], damage(rows)
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in broken if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))
        seen, kinds, blank, again, cut = set(), [], 0, 0, 0
        for _, _, role, text in own:
            fault = "b" if not BLANK.search(text) else "d" if (role, text) in seen else "t" if not END.search(text) else ""
            seen.add((role, text))
            blank, again, cut = blank + (fault == "b"), again + (fault == "d"), cut + (fault == "t")
            kinds.append((role[:1] if role[:1] in ("s", "u", "a") else "-", fault in ("b", "d"), fault == "t"))
        turns = [r[1] for r in own if r[1] is not None]
        odd = sum(own[k][2][:1] + own[k + 1][2][:1] not in ("su", "ua", "au") for k in range(len(own) - 1))
        cost, labels, emitted = every_way(kinds)
        lines, at, nth = [], 0, 0
        for x in labels:
            role, text = ({"u": "user", "a": "assistant", "s": ""}[emitted[nth]] if x != "D" else ""), ""
            if x != "I":
                text, role = own[at][3], own[at][2] if x == "K" else role
                at += 1
            if x != "D":
                lines.append(f"{role}:{text}")
                nth += 1
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out.append((conv, gaps, blank, again, cut, odd, cost, labels, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=str)


def run(spark, tmp_path, rows):
    df = spark.createDataFrame([(r[3], r[0], 1, r[1], r[2], 2) for r in rows], SCHEMA).repartition(3)
    df.write.parquet(f"{tmp_path}/conversations.parquet")
    return sorted((tuple(r) for r in R.op13_conversation_repair(spark, str(tmp_path)).collect()), key=str)


def by_sql(tmp_path):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    return sorted(con.execute(R.SQL).fetchall(), key=str)


def some(rng, convs, most):
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "sys", "", None, "User"]
    texts = ["Hello.", "Yes", "No!", "", " \t\n", None, "Why? \n", "é.", " ", "x. y"]
    return [(c, rng.choice([k, k, k, k + 1, None, 0]), rng.choice(roles[: rng.choice([3, 10])]), rng.choice(texts)) for c in [*range(convs), None] for k in range(rng.randrange(1, most + 1))]


def test_against_all_edits(spark, tmp_path):
    rows = [r for r in some(random.Random(1), 150, 2)]
    assert run(spark, tmp_path, rows) == brute(rows)


@pytest.mark.parametrize("bits", [1, 3, 10])
def test_segments(spark, tmp_path, monkeypatch, bits):
    monkeypatch.setattr(R, "SEGMENT_BITS", bits)
    rng = random.Random(2)
    long = [(500, k // 2, rng.choice(["user", "assistant", "user", "system"]), rng.choice([f"Text {k}.", f"Text {k % 40}", "", "x" * 5000 + "."])) for k in range(400)]
    rows = [*some(rng, 60, 12), *long]
    assert run(spark, tmp_path, rows) == by_sql(tmp_path)


def test_empty_lost_and_repeated(spark, tmp_path):
    lost = next(k for k in range(1000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    rows = [(lost, 0, "user", "Gone."), (None, None, None, None), *[(7, None, "user", "Same.")] * 300, (2000, 1, "assistant", "z" * 400_000)]
    found = run(spark, tmp_path, rows)
    assert found == by_sql(tmp_path)
    assert (lost, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) in found
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/none/conversations.parquet")
    assert R.op13_conversation_repair(spark, f"{tmp_path}/none").collect() == []


def test_composition():
    assert R.shortest("uwaw", R.BEGUN, True)[R.AFTER_A] == (0, "KK")
    assert R.shortest("awuw", R.BEGUN, True)[R.AFTER_A] == (2, "RR")
    assert R.shortest("sw", R.BEGUN, True)[R.BEGUN] == (2, "D")
    assert R.shortest("utat", R.BEGUN, True)[R.BEGUN] == (4, "DD")
