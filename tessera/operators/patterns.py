"""Patterns over the ordered rows of a key, such as funnels with repeated and optional steps.

A pattern is a list of steps, each a set of symbols with the least and the greatest number of rows;
rows that match are neighbours in their key's order, with at most a given gap in time. For every
row that completes the pattern there is one match, with the earliest beginning.

The pattern is an automaton of positions, and its memory is, for each position, the earliest
beginning of a run that has come to it. Rows are sorted by ranges of (key, time), so a long key is
spread over many tasks. What a piece of a key does to the memory that comes in is small: which
positions lead to which, what beginnings of its own it leaves, and which of its rows complete a run
that came in. Pieces are then composed in order, a few numbers each, and rows are not shuffled again.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Step(NamedTuple):
    """Rows with one of the symbols: from `least` to `most` of them, without a limit if that is None."""

    symbols: frozenset[str]
    least: int = 1
    most: int | None = 1


class Automaton:
    def __init__(self, steps: list[Step]):
        self.symbols: list[frozenset[str]] = []
        self.loops: list[bool] = []
        skipped: list[bool] = []
        for step in steps:
            n = max(step.least, 1) if step.most is None else step.most
            for k in range(n):
                self.symbols.append(step.symbols)
                self.loops.append(step.most is None and k == n - 1)
                skipped.append(k >= step.least)
        n = len(self.symbols)
        free = lambda i, j: all(skipped[i:j])
        self.first = [free(0, p) for p in range(n)]
        self.last = [p for p in range(n) if free(p + 1, n)]
        self.before = [[q for q in range(p) if free(q + 1, p)] + [p] * self.loops[p] for p in range(n)]
        self.size = n

    def moves(self, symbol: str, active: list) -> list:
        """The memory after one row, without runs that begin at it."""
        return [min((active[q] for q in self.before[p] if active[q] is not None), default=None) if symbol in self.symbols[p] else None for p in range(self.size)]

    def begun(self, symbol: str, active: list, at: int) -> list:
        return [at if x is None and self.first[p] and symbol in self.symbols[p] else x for p, x in enumerate(active)]


class Piece:
    """What consecutive rows of one key do, whatever came before them."""

    def __init__(self, automaton: Automaton, gap: int):
        self.automaton, self.gap = automaton, gap
        n = automaton.size
        self.begin = self.end = None
        self.own: list = [None] * n
        # for each position that may come in, the positions that it has led to
        self.led = [[0 if p == q else None for p in range(n)] for q in range(n)]
        self.alive = True
        self.matches: list[tuple[int, int | None, list[int]]] = []  # (end, own beginning, positions that came in)

    def add(self, at: int, symbol: str) -> None:
        a = self.automaton
        if self.end is not None and at - self.end > self.gap:
            self.own, self.alive = [None] * a.size, False
        if self.begin is None:
            self.begin = at
        self.end = at
        self.own = a.begun(symbol, a.moves(symbol, self.own), at)
        came = []
        if self.alive:
            self.led = [a.moves(symbol, x) for x in self.led]
            came = [q for q, x in enumerate(self.led) if any(x[p] is not None for p in a.last)]
            self.alive = any(y is not None for x in self.led for y in x)
        own = min((self.own[p] for p in a.last if self.own[p] is not None), default=None)
        if own is not None or came:
            self.matches.append((at, own, came))

    def after(self, memory: list) -> list:
        """The memory behind the piece."""
        out = list(self.own)
        if self.alive:
            for q, start in enumerate(memory):
                if start is not None:
                    for p, x in enumerate(self.led[q]):
                        if x is not None and (out[p] is None or start < out[p]):
                            out[p] = start
        return out


PIECE = "key string, part int, begin long, end long, own array<long>, led array<array<int>>, ends array<long>, starts array<long>, came array<array<int>>"
_PIECE = pa.schema(
    [("key", pa.string()), ("part", pa.int32()), ("begin", pa.int64()), ("end", pa.int64()), ("own", pa.list_(pa.int64())), ("led", pa.list_(pa.list_(pa.int32()))), ("ends", pa.list_(pa.int64())), ("starts", pa.list_(pa.int64())), ("came", pa.list_(pa.list_(pa.int32())))]
)
MATCH = "key string, begin long, end long"
_MATCH = pa.schema([("key", pa.string()), ("begin", pa.int64()), ("end", pa.int64())])


def match_rows(df: DataFrame, key: Column, at: Column, symbol: Column, steps: list[Step], gap_seconds: int, order: list[Column] = ()) -> DataFrame:
    """(key, begin, end): the matches of a pattern; the key as text, times in microseconds.

    order: what tells rows of one key and time apart. Rows with a null key, time or symbol are left out.
    """
    automaton, gap = Automaton(steps), gap_seconds * 1_000_000
    rows = df.select(key.cast("string").alias("key"), F.unix_micros(at.cast("timestamp")).alias("at"), symbol.cast("string").alias("symbol"), *[c.alias(f"o{i}") for i, c in enumerate(order)]).dropna(subset=["key", "at", "symbol"])
    sort = ["key", "at", *[f"o{i}" for i in range(len(order))], "symbol"]
    ranged = rows.repartitionByRange(*sort).sortWithinPartitions(*sort).select("key", "at", "symbol")

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, name, piece, out = TaskContext.get().partitionId(), None, None, []

        def closed() -> dict:
            led = [[p for p, x in enumerate(piece.led[q]) if x is not None] if piece.alive else [] for q in range(automaton.size)]
            ends, starts, came = zip(*piece.matches) if piece.matches else ((), (), ())
            return {"key": name, "part": part, "begin": piece.begin, "end": piece.end, "own": piece.own, "led": led, "ends": ends, "starts": starts, "came": came}

        for batch in batches:
            for k, t, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if k != name:
                    if piece is not None:
                        out.append(closed())
                    name, piece = k, Piece(automaton, gap)
                piece.add(t, s)
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=_PIECE)
                out = []
        if piece is not None:
            yield pa.RecordBatch.from_pylist([closed()], schema=_PIECE)

    def composed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, memory, until = None, None, None
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if r["key"] != name:
                    name, memory, until = r["key"], [None] * automaton.size, None
                if until is not None and r["begin"] - until > gap:
                    memory = [None] * automaton.size
                for end, start, came in zip(r["ends"], r["starts"], r["came"]):
                    found = [memory[q] for q in came if memory[q] is not None] + [start] * (start is not None)
                    if found:
                        out.append({"key": name, "begin": min(found), "end": end})
                after = list(r["own"])
                for q, begin in enumerate(memory):
                    for p in r["led"][q] if begin is not None else ():
                        after[p] = begin if after[p] is None else min(after[p], begin)
                memory, until = after, r["end"]
            yield pa.RecordBatch.from_pylist(out, schema=_MATCH)

    return ranged.mapInArrow(pieces, PIECE).repartition("key").sortWithinPartitions("key", "part").mapInArrow(composed, MATCH)
