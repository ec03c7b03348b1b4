"""Repair of conversations by composition of weighted finite-state machines.

A conversation's rows are an input acceptor, a chain of symbols: the initial of the role and
whether the row is whole, truncated or must go (blank, or a duplicate of an earlier row). The
edit transducer keeps, reroles or deletes a row and inserts rows, each at a cost. The grammar of
roles is an acceptor of four states. Their composition is built as rows come in, so only its
states (row, grammar state) of one row are there at a time, and the shortest path is found row by
row, which is a topological order. Weights are pairs (cost, labels): the cheapest edits win, of
equally cheap ones the least labels. Of two ways through the same rows with the same cost neither
has labels that begin the other's, so the order of pairs is kept by whatever follows.

Rows are sorted by ranges of (conversation, turn, role, text) and cut into segments of
1,024 rows. A segment's shortest paths between all grammar states are a matrix, and matrices of
a conversation's segments are folded in order; so a conversation of any length is worked on by many
tasks. One thing is not cut: the SHA-256 of a repaired conversation is one chain, which a task
computes as a stream over the sorted rows and holds none of them. First occurrences of a row are
found by grouping and come back by row number, so no key is hot there.

Defined results: null fields count as one space, so null and space agree; rows of one turn are
ordered by role, then text, bytewise, and equal rows are interchangeable; null turns come first; an
empty role fits no place in the grammar and can only be reroled or deleted; a conversation that
loses all rows has zeros, an empty audit and the hash of nothing; an empty table gives no row. A
null conv_id is a conversation like any other. Only the four named columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import scratch_space, stored, table

#: Bits of the rows of a segment: 1,024 rows.
SEGMENT_BITS = 10

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5

#: The grammar (s?(ua)+)?: begun, after s, after u, after a.
BEGUN, AFTER_S, AFTER_U, AFTER_A = range(4)
GRAMMAR = ({"s": AFTER_S, "u": AFTER_U}, {"u": AFTER_U}, {"a": AFTER_A}, {"u": AFTER_U})
ACCEPTED = (BEGUN, AFTER_A)
ROLES = {"u": "user", "a": "assistant"}
LEGAL = ("su", "ua", "au")

#: Symbols: the initial, or - for any other, and whether the row is whole, truncated or must go.
WHOLE, CUT, GOES = "w", "t", "g"

Weight = tuple[int, str]
Weights = list[Weight | None]


def edits(initial: str, state: str) -> Iterator[tuple[str, int, str]]:
    """(label, cost, emitted initial) of the edit transducer's arcs for one row; no initial is emitted by a deletion."""
    yield "D", DELETE, ""
    if state != GOES:
        more = TRUNCATED if state == CUT else 0
        yield "K", KEEP + more, initial
        for role in ROLES:
            yield "R", REROLE + more, role


@lru_cache(None)
def composed(initial: str, state: str) -> list[tuple[int, int, int, str]]:
    """(from, to, cost, label): the edits of one row composed with the grammar."""
    out = set()
    for label, cost, emitted in edits(initial, state):
        for at, arcs in enumerate(GRAMMAR):
            to = arcs.get(emitted) if emitted else at
            if to is not None:
                out.add((at, to, cost, label))
    return sorted(out)


def better(a: Weight | None, b: Weight | None) -> Weight | None:
    return b if a is None or b is not None and b < a else a


def with_inserts(weights: Weights) -> Weights:
    """The weights when rows may be inserted here: a user row first, then an assistant row; more would only cost."""
    out = list(weights)
    for role in ROLES:
        to = AFTER_U if role == "u" else AFTER_A
        for at, arcs in enumerate(GRAMMAR):
            if role in arcs and out[at] is not None:
                out[to] = better(out[to], (out[at][0] + INSERT, out[at][1] + "I"))
    return out


def shortest(symbols: str, start: int, last: bool) -> Weights:
    """The weight of the best way from a grammar state over the rows to each state; two characters a row."""
    weights: Weights = [None] * len(GRAMMAR)
    weights[start] = (0, "")
    for k in range(0, len(symbols), 2):
        before, weights = with_inserts(weights), [None] * len(GRAMMAR)
        for at, to, cost, label in composed(symbols[k], symbols[k + 1]):
            if before[at] is not None:
                weights[to] = better(weights[to], (before[at][0] + cost, before[at][1] + label))
    return with_inserts(weights) if last else weights


#: Short conversations look alike.
shortest_of_few = lru_cache(1 << 14)(shortest)


def paths(symbols: str, start: int, last: bool) -> Weights:
    return (shortest_of_few if len(symbols) <= 32 else shortest)(symbols, start, last)


def illegal_pairs(initials: str) -> int:
    return sum(initials[k : k + 2] not in LEGAL for k in range(len(initials) - 1))


def instructions(symbols: str, labels: str, state: int) -> tuple[list[list[str]], list[str]]:
    """For each row the roles inserted before it, and what becomes of it: "" deleted, "=" kept, else the new role.

    The lists of inserted roles are one more than the rows: the last ones stand behind all.
    """
    inserted: list[list[str]] = [[]]
    becomes = []
    for label in labels:
        own = "a" if state == AFTER_U else "u"  # the only role that can be put here
        if label == "I":
            inserted[-1].append(ROLES[own])
        elif label == "D":
            becomes.append("")
        else:
            becomes.append("=" if label == "K" else ROLES[own])
            own = symbols[2 * len(becomes) - 2] if label == "K" else own
        if label in "KRD":
            inserted.append([])
        if label != "D":
            state = GRAMMAR[state][own]
    return inserted, becomes


MATRIX = "conv string, seg long, symbols string, ats array<long>, first boolean, last boolean, matrix array<struct<start:int, stop:int, cost:long, labels:string>>, illegal long"
_MATRIX = pa.schema(
    [
        ("conv", pa.string()),
        ("seg", pa.int64()),
        ("symbols", pa.string()),
        ("ats", pa.list_(pa.int64())),
        ("first", pa.bool_()),
        ("last", pa.bool_()),
        ("matrix", pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("cost", pa.int64()), ("labels", pa.string())]))),
        ("illegal", pa.int64()),
    ]
)


def ways(symbols: str, first: bool, last: bool) -> list[dict]:
    """The best ways through a segment: from the beginning if it is a conversation's first, and only the best one if it is its last, too."""
    found = [{"start": s, "stop": t, "cost": w[0], "labels": w[1]} for s in ((BEGUN,) if first else range(len(GRAMMAR))) for t, w in enumerate(paths(symbols, s, last)) if w is not None]
    if first and last:
        return [min((x for x in found if x["stop"] in ACCEPTED), key=lambda x: (x["cost"], x["labels"]))]
    return found


def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [r | {"matrix": ways(r["symbols"], r["first"], r["last"]), "illegal": illegal_pairs(r["symbols"][::2])} for r in batch.to_pylist()]
        yield pa.RecordBatch.from_pylist(rows, schema=_MATRIX)


FOLDED = "conv string, seg long, start int, stop int, cost long, audit string, illegal long"
_FOLDED = pa.schema([("conv", pa.string()), ("seg", pa.int64()), ("start", pa.int32()), ("stop", pa.int32()), ("cost", pa.int64()), ("audit", pa.string()), ("illegal", pa.int64())])


def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Folds the matrices of each conversation's sorted segments.

    Gives a row for each segment with the states between which the best way goes, and a last one
    (seg null) with the cost, the labels and the illegal pairs where segments meet. The labels and
    two small numbers a segment are all that is held.
    """
    conv, best, back, seen, ends = None, [], [], 0, ""

    def done() -> Iterator[pa.RecordBatch]:
        stop = min((s for s in ACCEPTED if best[s] is not None), key=lambda s: best[s])
        rows = [{"conv": conv, "seg": None, "start": None, "stop": None, "cost": best[stop][0], "audit": best[stop][1], "illegal": seen}]
        for seg, came in reversed(back):
            rows.append({"conv": conv, "seg": seg, "start": came[stop], "stop": stop, "cost": None, "audit": None, "illegal": None})
            stop = came[stop]
        yield pa.RecordBatch.from_pylist(rows, schema=_FOLDED)

    for batch in batches:
        for r in batch.to_pylist():
            if r["conv"] != conv:
                if conv is not None:
                    yield from done()
                conv, best, back, seen, ends = r["conv"], [(0, ""), None, None, None], [], 0, ""
            after: Weights = [None] * len(GRAMMAR)
            came = [None] * len(GRAMMAR)
            for x in r["matrix"]:
                if (w := best[x["start"]]) is not None:
                    w = (w[0] + x["cost"], w[1] + x["labels"])
                    if better(after[x["stop"]], w) is w:
                        after[x["stop"]], came[x["stop"]] = w, x["start"]
            back.append((r["seg"], came))
            seen += illegal_pairs(ends + r["symbols"][0])
            best, ends = after, r["symbols"][-2]
    if conv is not None:
        yield from done()


PLAN = "at long, lead string, becomes string, trail string"
_PLAN = pa.schema([("at", pa.int64()), ("lead", pa.string()), ("becomes", pa.string()), ("trail", pa.string())])


def planned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What becomes of each row of segments whose labels are settled."""
    said = lambda roles: "\n".join(f"{x}:" for x in roles) if roles else None
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            inserted, becomes = instructions(r["symbols"], r["labels"], r["start"])
            for k, at in enumerate(r["ats"]):
                out.append({"at": at, "lead": said(inserted[k]), "becomes": becomes[k], "trail": said(inserted[k + 1]) if k + 1 == len(r["ats"]) else None})
        yield pa.RecordBatch.from_pylist(out, schema=_PLAN)


HASHED = "conv string, repaired_sha256 string"
_HASHED = pa.schema([("conv", pa.string()), ("repaired_sha256", pa.string())])


def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hash of each conversation's lines, which come sorted and are joined by line feeds."""
    conv, chain, out = None, None, []
    for batch in batches:
        for name, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if name != conv:
                if conv is not None:
                    out.append({"conv": conv, "repaired_sha256": chain.hexdigest()})
                conv, chain = name, hashlib.sha256(line.encode())
            else:
                chain.update(b"\n")
                chain.update(line.encode())
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=_HASHED)
            out = []
    if conv is not None:
        yield pa.RecordBatch.from_pylist([{"conv": conv, "repaired_sha256": chain.hexdigest()}], schema=_HASHED)


VISIBLE, ENDED = "[^\\x20\\x09-\\x0D]", "[.!?][\\x20\\x09-\\x0D]*\\z"


def segments(placed: DataFrame) -> DataFrame:
    """(conv, seg, symbols, ats, counts) of rows with their faults; first and last mark a conversation's ends."""
    firsts = placed.groupBy("conv", "role", F.md5(F.col("text").cast("binary")).alias("digest")).agg(F.min("at").alias("at")).select("at", F.lit(True).alias("new"))
    rows = placed.select("conv", "at", "turn", F.substring("role", 1, 1).alias("initial"), "blank", "ended").join(firsts, "at", "left")
    again = F.col("new").isNull()
    fault = F.when(F.col("blank"), "b").when(again, "d").when(~F.col("ended"), "t")
    initial = F.when(F.col("initial").isin("s", "u", "a"), F.col("initial")).otherwise("-")
    symbol = F.concat(initial, F.when(F.col("fault").isin("b", "d"), GOES).when(F.col("fault") == "t", CUT).otherwise(WHOLE))
    rows = rows.withColumn("fault", fault).withColumn("symbol", symbol)
    of = lambda x: F.count(F.when(F.col("fault") == x, 1))
    sorted_rows = F.array_sort(F.collect_list(F.struct("at", "symbol")))
    segs = rows.groupBy("conv", F.shiftright("at", SEGMENT_BITS).alias("seg")).agg(
        sorted_rows.alias("rows"), of("b").alias("blank"), of("d").alias("duplicate"), of("t").alias("truncated"), F.min("turn").alias("least"), F.max("turn").alias("most")
    )
    segs = stored(segs.select("conv", "seg", F.array_join("rows.symbol", "").alias("symbols"), F.col("rows.at").alias("ats"), "blank", "duplicate", "truncated", "least", "most"), "segments")
    ends = segs.groupBy("conv").agg(F.min("seg").alias("__first"), F.max("seg").alias("__last"))
    return segs.join(ends, "conv").select(*segs.columns, (F.col("seg") == F.col("__first")).alias("first"), (F.col("seg") == F.col("__last")).alias("last"))


def placed_rows(rows: DataFrame) -> DataFrame:
    """(conv, at, turn, role, text, blank, ended): rows in their order, told by `at` over the whole table."""
    tied = rows.withColumn("__tie", F.monotonically_increasing_id())
    order = ["conv", F.col("turn").asc_nulls_first(), "role", "text", "__tie"]
    ranged = tied.repartitionByRange(*order).sortWithinPartitions(*order)
    return stored(ranged.select("conv", F.monotonically_increasing_id().alias("at"), "turn", "role", "text", (~F.col("text").rlike(VISIBLE)).alias("blank"), F.col("text").rlike(ENDED).alias("ended")), "rows")


def repair(rows: DataFrame) -> DataFrame:
    """(conv, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of rows (conv, turn, role, text) without nulls but in turn."""
    with scratch_space(rows.sparkSession) as keep:
        placed = placed_rows(rows)
        segs = stored(segments(placed), "segments")
        faults = segs.groupBy("conv").agg(*[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")], F.min("least").alias("least"), F.max("most").alias("most"))
        turns = placed.where("turn IS NOT NULL").groupBy("conv", "turn").agg(F.lit(1).alias("one")).groupBy("conv").agg(F.count("*").alias("turns"))
        faults = faults.join(turns, "conv", "left").select("conv", F.coalesce(F.col("most") - F.col("least") + 1 - F.col("turns"), F.lit(0)).cast("long").alias("gaps"), "blank", "duplicate", "truncated")
        found = stored(segs.select("conv", "seg", "symbols", "ats", "first", "last").mapInArrow(matrices, MATRIX), "matrices")
        single, parts = found.where("first AND last"), found.where("NOT (first AND last)")
        way = F.col("matrix")[0]
        whole = single.select("conv", way["cost"].alias("cost"), way["labels"].alias("audit"), "illegal")
        settled = single.select("symbols", "ats", F.lit(BEGUN).alias("start"), way["labels"].alias("labels"))
        if not parts.isEmpty():
            ordered = parts.select("conv", "seg", "symbols", "matrix").repartition("conv").sortWithinPartitions("conv", "seg")
            best = stored(ordered.mapInArrow(folded, FOLDED), "ways")
            inside = parts.groupBy("conv").agg(F.sum("illegal").alias("inside"))
            whole = whole.unionByName(best.where("seg IS NULL").join(inside, "conv").select("conv", "cost", "audit", (F.col("illegal") + F.col("inside")).alias("illegal")))
            chosen = parts.join(best.where("seg IS NOT NULL").select("conv", "seg", "start", "stop"), ["conv", "seg"])
            taken = F.filter("matrix", lambda x: (x["start"] == F.col("start")) & (x["stop"] == F.col("stop")))[0]
            settled = settled.unionByName(chosen.select("symbols", "ats", "start", taken["labels"].alias("labels")))
        plan = settled.mapInArrow(planned, PLAN).where("lead IS NOT NULL OR trail IS NOT NULL OR becomes <> ''")
        role = F.when(F.col("becomes") == "=", F.col("role")).otherwise(F.col("becomes"))
        line = F.concat_ws("\n", "lead", F.when(F.col("becomes") != "", F.concat(role, F.lit(":"), "text")), "trail")
        lines = placed.select("conv", "at", "role", "text").join(plan, "at").select("conv", line.alias("line"), "at")
        hashes = lines.repartition("conv").sortWithinPartitions("conv", "at").select("conv", "line").mapInArrow(hashed, HASHED)
        out = faults.join(whole, "conv").join(hashes, "conv", "left")
        empty = hashlib.sha256().hexdigest()
        return keep(stored(out.select("conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.coalesce("repaired_sha256", F.lit(empty)).alias("repaired_sha256")), "repaired"))


def conv_key(conv_id: Column) -> Column:
    return F.coalesce(conv_id.cast("string"), F.lit(" "))


def damaged(rows: DataFrame) -> DataFrame:
    """(conv, turn, role, text) after the damage that the query deals by the CRC of conversation and turn."""
    space = F.lit(" ")
    key = F.concat_ws(":", conv_key(F.col("conv_id")), F.coalesce(F.col("turn").cast("string"), space))
    rows = rows.select(conv_key(F.col("conv_id")).alias("conv"), "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"), (F.crc32(key.cast("binary")) % 20).alias("kind"))
    rows = rows.where("kind <> 0").withColumn("copy", F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return rows.select("conv", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    found = repair(damaged(rows))
    every = rows.select("conv_id", conv_key(F.col("conv_id")).alias("conv")).distinct()
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    counts = [zero(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    out = every.join(found, "conv", "left")
    return out.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))


def _add(weight: str, cost: str | int, label: str) -> str:
    """A weight in the SQL: nine digits of cost, then the labels, so that text order is the order of weights."""
    return f"(lpad((substr({weight}, 1, 9)::BIGINT + {cost})::VARCHAR, 9, '0') || substr({weight}, 10) || '{label}')"


def _with_inserts(source: str) -> str:
    user = "least(u, " + ", ".join(_add(x, INSERT, "I") for x in ("b", "s", "a")) + ")"
    return f"SELECT * REPLACE (least(a, {_add('u', INSERT, 'I')}) AS a) FROM (SELECT * REPLACE ({user} AS u) FROM ({source}))"


def _sql() -> str:
    arrows = {"s": (("b", "s"),), "u": (("b", "u"), ("s", "u"), ("a", "u")), "a": (("u", "a"),)}
    crc = (
        "xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), "
        "lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))), lambda a, e: CASE WHEN e >= 0 THEN xor(a, e) WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384::BIGINT) ELSE a >> 1 END), 4294967295::BIGINT)"
    )

    def reached(state: str) -> str:
        ways = [_add(f"w.{state}", DELETE, "D")]
        for initial, arcs in arrows.items():
            for at, to in arcs:
                if to == state:
                    ways.append(f"CASE WHEN NOT r.gone AND r.initial = '{initial}' THEN {_add(f'w.{at}', f'r.more + {KEEP}', 'K')} END")
                    if initial != "s":
                        ways.append(f"CASE WHEN NOT r.gone THEN {_add(f'w.{at}', f'r.more + {REROLE}', 'R')} END")
        return f"least({', '.join(ways)}) AS {state}" if len(ways) > 1 else f"{ways[0]} AS {state}"

    return f"""
    WITH RECURSIVE dealt AS (
        SELECT coalesce(conv_id::VARCHAR, ' ') AS conv, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc} % 20 AS kind FROM conversations),
    broken AS (
        SELECT conv, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
        FROM (SELECT *, unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) FROM dealt WHERE kind <> 0)),
    sorted AS (
        SELECT *, row_number() OVER (PARTITION BY conv ORDER BY turn NULLS FIRST, role, text) AS k, substr(role, 1, 1) AS initial,
            NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') AS blank,
            NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') AS cut
        FROM broken),
    rows AS (SELECT *, row_number() OVER (PARTITION BY conv, role, text ORDER BY k) > 1 AS again FROM sorted),
    marked AS (
        SELECT *, blank OR again AS gone, CASE WHEN cut AND NOT blank AND NOT again THEN {TRUNCATED} ELSE 0 END AS more,
            coalesce(lag(initial) OVER (PARTITION BY conv ORDER BY k) || initial NOT IN ('su', 'ua', 'au'), false) AS odd
        FROM rows),
    counts AS (
        SELECT conv, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE blank) AS blank, count(*) FILTER (WHERE again AND NOT blank) AS duplicate,
            count(*) FILTER (WHERE more > 0) AS truncated, count(*) FILTER (WHERE odd) AS illegal, count(*) AS n
        FROM marked GROUP BY conv),
    walk AS (
        SELECT conv, 0::BIGINT AS k, '000000000' AS b, NULL::VARCHAR AS s, NULL::VARCHAR AS u, NULL::VARCHAR AS a FROM counts
        UNION ALL
        SELECT w.conv, r.k, {", ".join(reached(x) for x in "bsua")}
        FROM ({_with_inserts("SELECT * FROM walk")}) w JOIN marked r ON r.conv = w.conv AND r.k = w.k + 1),
    best AS (
        SELECT conv, least(b, a) AS weight FROM ({_with_inserts("SELECT walk.* FROM walk JOIN counts USING (conv) WHERE k = n")})),
    labels AS (
        SELECT conv, unnest(string_split(substr(weight, 10), '')) AS label, generate_subscripts(string_split(substr(weight, 10), ''), 1) AS place FROM best WHERE length(weight) > 9),
    placed AS (
        SELECT *, count(*) FILTER (WHERE label <> 'I') OVER w AS k, count(*) FILTER (WHERE label <> 'D') OVER w AS nth FROM labels WINDOW w AS (PARTITION BY conv ORDER BY place ROWS UNBOUNDED PRECEDING)),
    lines AS (
        SELECT p.conv, p.place, p.nth, p.label, CASE WHEN p.label = 'K' THEN r.role END AS own, CASE WHEN p.label = 'I' THEN '' ELSE r.text END AS text
        FROM placed p LEFT JOIN marked r ON r.conv = p.conv AND r.k = p.k WHERE p.label <> 'D'),
    texts AS (
        SELECT conv, string_agg(coalesce(own, CASE WHEN (nth + led) % 2 = 1 THEN 'user' ELSE 'assistant' END) || ':' || text, chr(10) ORDER BY place) AS text
        FROM (SELECT *, max(CASE WHEN nth = 1 AND own[1] = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY conv) AS led FROM lines) GROUP BY conv)
    SELECT e.conv_id, coalesce(c.gaps, 0)::BIGINT AS gaps, coalesce(c.blank, 0)::BIGINT AS blank, coalesce(c.duplicate, 0)::BIGINT AS duplicate, coalesce(c.truncated, 0)::BIGINT AS truncated,
        coalesce(c.illegal, 0)::BIGINT AS illegal, coalesce(substr(b.weight, 1, 9)::BIGINT, 0) AS cost, coalesce(substr(b.weight, 10), '') AS audit, sha256(coalesce(t.text, '')) AS repaired_sha256
    FROM (SELECT DISTINCT conv_id, coalesce(conv_id::VARCHAR, ' ') AS conv FROM conversations) e
    LEFT JOIN counts c USING (conv) LEFT JOIN best b USING (conv) LEFT JOIN texts t USING (conv)"""


SQL = _sql()
