"""Substring dedup over bytes with suffix arrays built by two-stage sorting.

A byte is removed if a string of `size` bytes that covers it also starts in a document with
a smaller id. Strings never cross documents and are judged on the input.

1. Each window of `size` bytes has a least hash among its grams of `gram` bytes, the same
   wherever the window occurs. Parts exchange these hashes (see `parts`); windows whose least
   hash occurs once in the corpus occur once themselves and are done.
2. Runs of the other windows are cut out as pieces. Every distinct piece of a part goes once,
   with the smallest id that has it, to the bucket that owns its hash. There all pieces are
   suffix-sorted: suffixes smaller than their successors directly, the others induced from
   them by scans over the buckets of first bytes. Adjacent common prefixes of `size` bytes
   delimit the groups of equal windows, and each group's smallest id answers the parts. Least
   hashes of very many pieces would fill one bucket: their windows go one by one, distinct in
   their part, to the buckets of their own hashes, so equal windows still meet.
3. Each part marks the bytes its documents lose.

Defined results: null is the empty text and loses nothing; a null id counts as the smallest;
rows with the same id do not delete from each other; repeated texts under different ids lose
everything but the first. Only the id and the text are read.
"""

from __future__ import annotations


from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import NO_ID, remove_stored, slices, stored, table
from tessera.llm.hashing import BYTE_VALUES, binary_array, gram_hashes, mixed, pieces, raw, sliding_min
from tessera.llm.parts import answered, by_bucket, by_part, cut, member, owned, parts, with_answers, REQUEST

SIZE, GRAM = 50, 20
SLICE_BYTES = 1 << 18

#: Buckets of pieces for each bucket of hashes, so that one suffix array holds a few megabytes.
FINER = 8

#: Pieces with one least hash, of all parts together, from which their windows are sent one by one.
HOT = 1 << 16

#: Windows of such pieces that are told apart at once.
MOST_WINDOWS = 1 << 20

#: Bytes that one key of the direct sort compares.
STEP = 8


def larger(text: np.ndarray) -> np.ndarray:
    """Which suffixes are larger than their successors; the last one is, as the empty suffix is smallest."""
    n = len(text)
    step = np.ones(n, np.int8)
    step[:-1] = np.sign(text[:-1].astype(np.int16) - text[1:])
    # a run of equal bytes has the type of its last byte
    at = np.where(step != 0, np.arange(n, dtype=np.int32), np.int32(n - 1))
    at = np.minimum.accumulate(at[::-1])[::-1]
    return step[at] > 0


def keys(text: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as a number; zeros beyond the end."""
    out = np.zeros(len(text) + STEP, np.uint64)
    out[: len(text)] = text
    for k in (1, 2, 4):
        out[:-k] = (out[:-k] << np.uint64(8 * k)) | out[k:]
    return out[: len(text)]


def direct_sort(where: np.ndarray, key: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes at the given places in the order of their first `depth` bytes.

    Only groups that are still tied take part in the next step of eight bytes.
    """
    order = where[np.argsort(key[where])]
    group = np.zeros(len(order), np.int64)
    k = key[order]
    np.cumsum(k[1:] != k[:-1], out=group[1:])
    for at in range(STEP, depth, STEP):
        tied = np.zeros(len(order), bool)
        same = group[1:] == group[:-1]
        tied[1:] = same
        tied[:-1] |= same
        places = np.flatnonzero(tied)
        if not len(places):
            break
        own, g = order[places], group[places]
        behind = own + at
        k = np.where(behind < len(key), key[np.minimum(behind, len(key) - 1)], 0)
        by_key = np.argsort(k)
        rank = np.zeros(len(k), np.int64)
        rank[by_key[1:]] = np.cumsum(k[by_key[1:]] != k[by_key[:-1]])
        merged = g * (len(k) + 1) + rank
        now = np.argsort(merged)
        order[places] = own[now]
        merged = merged[now]
        fresh = np.zeros(len(order), np.int64)
        fresh[places[1:]] = (merged[1:] != merged[:-1]) & (g[1:] == g[:-1])
        fresh[1:] += group[1:] != group[:-1]
        group = np.cumsum(fresh)
    return order


def two_stage(text: np.ndarray, wanted: np.ndarray, depth: int) -> np.ndarray:
    """The wanted suffixes, and those between them and the next directly sorted one, in order to `depth` bytes.

    Stage one sorts suffixes that are smaller than their successors. Stage two scans the buckets
    of first bytes upwards: the predecessor of a suffix that is already in place is larger than
    it and comes next in the bucket of its own first byte, before that bucket's sorted suffixes.
    A suffix may induce another one in the same bucket, which happens along a run of one byte; all
    suffixes of a bucket's runs are put in place in one step, by their distance from the run's end.
    """
    big = larger(text)
    # what the wanted suffixes are induced from: everything up to the next small suffix
    ends = np.where(~big, np.arange(len(text), dtype=np.int32), np.int32(len(text) - 1))
    ends = np.minimum.accumulate(ends[::-1])[::-1]
    reach = wanted.astype(np.int32)
    reach[1:] -= np.bincount(ends[wanted], minlength=len(text))[:-1]
    need = (np.cumsum(reach) > 0) | wanted
    del ends, reach
    small = direct_sort(np.flatnonzero(need & ~big).astype(np.int32), keys(text), depth)
    first = text[small]
    edges = np.searchsorted(first, np.arange(257))
    placed: list[list[np.ndarray]] = [[] for _ in range(256)]
    if need[-1] and big[-1]:  # the end is induced by the empty suffix
        placed[text[-1]].append(np.array([len(text) - 1], np.int32))
    out = []

    # places that go on a run of one byte, all of whose suffixes are needed, and where their runs begin
    goes_on = np.zeros(len(text), bool)
    goes_on[1:] = (text[1:] == text[:-1]) & need[1:] & need[:-1]
    inner = np.flatnonzero(goes_on).astype(np.int32)
    begins = np.where(goes_on[inner - 1], np.int32(0), inner - np.int32(1)) if len(inner) else inner
    np.maximum.accumulate(begins, out=begins)

    def with_runs(wave: np.ndarray) -> np.ndarray:
        """The suffixes, then those before them in their runs: nearer ones first, in the order of what they lead to."""
        last = wave[goes_on[wave]]
        if not len(last):
            return wave
        back = last - begins[np.searchsorted(inner, last)]
        steps = ranges(np.ones(len(last), np.int32), back).astype(np.int32)
        return np.concatenate([wave, (np.repeat(last, back) - steps)[np.argsort(steps, kind="stable")]])

    def induce(found: np.ndarray, c: int) -> None:
        """Places the larger predecessors that belong to other buckets."""
        before = found[found > 0] - 1
        before = before[big[before] & need[before]]
        chars = text[before]
        by_char = np.argsort(chars, kind="stable")
        chars = chars[by_char]
        cuts = np.flatnonzero(np.diff(chars)) + 1
        for i, j in zip([0, *cuts], [*cuts, len(chars)]):
            if i < j and chars[i] != c:
                placed[chars[i]].append(before[by_char[i:j]])

    for c in np.unique(text[need]):
        large = with_runs(np.concatenate(placed[c])) if placed[c] else np.zeros(0, np.int32)
        for found in (large, small[edges[c] : edges[c + 1]]):
            out.append(found)
            induce(found, c)
    return np.concatenate(out) if out else np.zeros(0, np.int32)


def common_prefixes(text: np.ndarray, order: np.ndarray, size: int) -> np.ndarray:
    """How many bytes, up to `size`, each suffix shares with the one before it in the order."""
    key = keys(text)
    out = np.zeros(len(order), np.int32)
    open_ = np.arange(1, len(order), dtype=np.int32)
    for at in range(0, size, STEP):
        if not len(open_):
            break
        a, b = order[open_ - 1] + at, order[open_] + at
        inside = (a < len(key)) & (b < len(key))
        differ = np.full(len(open_), ~np.uint64(0))
        differ[inside] = key[a[inside]] ^ key[b[inside]]
        same = differ == 0
        out[open_[same]] += STEP
        last, differ = open_[~same], differ[~same]
        for k in range(STEP - 1):  # leading equal bytes of the eight
            out[last] += (differ >> np.uint64(8 * (STEP - 1 - k))) == 0
        open_ = open_[same]
    return np.minimum(out, size)


def least_owner(bodies: list[bytes], owners: list[np.ndarray], size: int) -> list[np.ndarray]:
    """For each piece, the smallest owner of each of its windows, by a suffix array over all pieces."""
    place: dict[bytes, int] = {}
    which = np.fromiter((place.setdefault(b, len(place)) for b in bodies), np.int64, len(bodies))
    own = np.full(len(place), np.iinfo(np.int64).max)
    np.minimum.at(own, which, np.asarray(owners, np.int64))
    # bytes of UTF-8 are below 0xF5, so one more leaves zero for the end of a piece
    text = np.frombuffer(b"".join(b + b"\xff" for b in place), np.uint8) + np.uint8(1)
    lengths = np.fromiter((len(b) + 1 for b in place), np.int64, len(place))
    if len(text) > np.iinfo(np.int32).max:
        raise ValueError("a bucket of pieces holds over 2 GB: more buckets are needed")
    begins = np.cumsum(lengths) - lengths
    wanted = np.repeat((begins + lengths).astype(np.int32), lengths) - np.arange(len(text), dtype=np.int32) > size
    order = two_stage(text, wanted, size)
    order = order[wanted[order]]
    group = np.cumsum(common_prefixes(text, order, size) < size) - 1
    of = np.repeat(own, lengths)
    least = np.full(group[-1] + 1 if len(group) else 0, np.iinfo(np.int64).max)
    np.minimum.at(least, group, of[order])
    del of
    per_byte = np.zeros(len(text), np.int64)
    per_byte[order] = least[group]
    return [per_byte[begins[i] : begins[i] + lengths[i] - size] for i in which]


def answer(bodies: list[bytes], size: int) -> list[bytes]:
    """Bits for every window of every piece: whether a smaller id than the part's own has it."""
    texts, owners, counts = [], [], []
    for body in bodies:
        n = int(np.frombuffer(body, np.int64, 1)[0])
        ids, lengths = np.frombuffer(body, np.int64, n, 8), np.frombuffer(body, np.int64, n, 8 + 8 * n)
        ends = 8 + 16 * n + np.cumsum(lengths)
        texts += [body[e - k : e] for e, k in zip(ends.tolist(), lengths.tolist())]
        owners.append(ids)
        counts.append(n)
    owner = np.concatenate(owners)
    found = least_owner(texts, owner, size)
    out, at = [], 0
    for n in counts:
        bits = [x < o for x, o in zip(found[at : at + n], owner[at : at + n])]
        out.append(np.packbits(np.concatenate(bits)).tobytes())
        at += n
    return out


def counted(part: int, hashes: np.ndarray, times: np.ndarray, buckets: int) -> pa.Table:
    """Requests with sorted distinct hashes and how often each occurs, where that is more than once."""
    bodies, own = [], []
    for b, i, j in cut(owned(hashes, buckets), buckets):
        more = np.flatnonzero(times[i:j] > 1)
        bodies.append(np.int64(j - i).tobytes() + hashes[i:j].tobytes() + more.astype(np.int64).tobytes() + times[i:j][more].astype(np.int64).tobytes())
        own.append(b)
    return pa.table({"bucket": pa.array(own, pa.int32()), "part": pa.array([part] * len(own), pa.int64()), "body": pa.array(bodies, pa.binary())})


def elsewhere_or_hot(bodies: list[bytes], hot: int) -> list[bytes]:
    """For each part's sorted hashes, bits that tell which of them another part has too, then those which occur more than `hot` times."""
    each, often, times = [], [], []
    for body in bodies:
        n = int(np.frombuffer(body, np.int64, 1)[0])
        each.append(np.frombuffer(body, np.uint64, n, 8))
        more, of = np.frombuffer(body, np.int64, -1, 8 + 8 * n).reshape(2, -1) if len(body) > 8 + 8 * n else (np.zeros(0, np.int64),) * 2
        often.append(each[-1][more])
        times.append(of - 1)
    merged = np.sort(np.concatenate(each))
    begins = np.flatnonzero(np.append(True, merged[1:] != merged[:-1]))
    n = np.diff(np.append(begins, len(merged)))
    found, shared = merged[begins], merged[begins[n > 1]]
    np.add.at(n, np.searchsorted(found, np.concatenate(often)), np.concatenate(times))
    hottest = found[n > hot]
    return [np.packbits(member(x, shared)).tobytes() + np.packbits(member(x, hottest)).tobytes() for x in each]


def answered_hot(hashes: np.ndarray, buckets: int, answers: dict) -> np.ndarray:
    """The second bits that came back for the sorted hashes of a part."""
    out = np.zeros(len(hashes), bool)
    for b, i, j in cut(owned(hashes, buckets), buckets):
        out[i:j] = np.unpackbits(np.frombuffer(answers[1, b], np.uint8, -1, (j - i + 7) // 8), count=j - i).astype(bool)
    return out


def ranges(begins: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers from each begin on, as many as its count."""
    back = np.cumsum(counts) - counts
    return np.repeat(begins - back, counts) + np.arange(counts.sum())


def numbered(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The number of the distinct byte string at each place, and the place where each stands first."""
    coded = values.dictionary_encode()
    number = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    first = np.full(len(coded.dictionary), len(number), np.int64)
    np.minimum.at(first, number, np.arange(len(number)))
    return number, first


class Shared:
    """The pieces of a part whose least hash occurs more than once in the corpus."""

    def __init__(self, rows: pa.Table, size: int, gram: int):
        self.size, self.batches, self.ids = size, [], []
        each, weights = [], []
        for batch in rows.to_batches():
            for part in slices(batch, "text", SLICE_BYTES):
                data, offsets = raw(part.column(part.schema.get_field_index("text")))
                values = BYTE_VALUES[0][data]
                least = sliding_min(gram_hashes(values, gram), size - gram + 1)
                starts, counts = pieces(least, offsets, size) if len(least) else (np.zeros(0, np.int64),) * 2
                each.append(mixed(least[starts]))  # least hashes are small numbers; mixed, they spread over the buckets
                weights.append(-(-(counts + size - 1) // (2 * size - gram)))  # a long piece counts as several
                self.batches.append((data, offsets, starts, counts))
                self.ids.append(part.column(part.schema.get_field_index("doc_id")).fill_null(NO_ID).to_numpy(zero_copy_only=False))
        self.least = np.concatenate(each) if each else np.zeros(0, np.uint64)
        self.hashes, of, times = np.unique(self.least, return_inverse=True, return_counts=True)
        self.again = times > 1
        self.times = np.bincount(of, np.concatenate(weights), len(times)).astype(np.int64) if each else times

    def find(self, buckets: int, answers: dict) -> None:
        """Chooses the pieces and numbers the distinct ones, in the order in which they are sent."""
        kept = member(self.least, self.hashes[self.again | answered(self.hashes, buckets, answers, 1)])
        at, held, owner, spans = 0, [], [], []
        for b, (data, offsets, starts, counts) in enumerate(self.batches):
            chosen = kept[at : at + len(starts)]
            at += len(starts)
            s, e = starts[chosen], starts[chosen] + counts[chosen] + self.size - 1
            docs = self.ids[b][np.searchsorted(offsets, s, "right") - 1]
            owner.append(docs)
            spans.append(np.stack([np.full(len(s), b), s, e], 1))
            held.append(binary_array(data[ranges(s, e - s)], e - s))
        self.owner = np.concatenate(owner) if owner else np.zeros(0, np.int64)
        self.spans = np.concatenate(spans) if spans else np.zeros((0, 3), np.int64)
        # equal bytes have one number; a piece's bytes give its least hash
        self.number, self.sample = numbered(pa.concat_arrays(held) if held else pa.array([], pa.large_binary()))
        least = self.least[kept]
        self.first = np.full(len(self.sample), np.iinfo(np.int64).max)
        np.minimum.at(self.first, self.number, self.owner)
        self.send(least[self.sample], self.hashes[answered_hot(self.hashes, buckets, answers)], FINER * buckets)

    def send(self, least: np.ndarray, hot: np.ndarray, buckets: int) -> None:
        """Chooses what is sent: distinct pieces, and the distinct windows of those with a hot least hash."""
        spans, apart = self.spans[self.sample], member(least, hot)
        self.cold, self.hot = np.flatnonzero(~apart), np.flatnonzero(apart)
        counts = (spans[:, 2] - spans[:, 1] - self.size + 1)[self.hot]
        batch, start, first = np.repeat(spans[self.hot, 0], counts), ranges(spans[self.hot, 1], counts), np.repeat(self.first[self.hot], counts)
        key, number, sample = self.windows(batch, start)
        least_first = np.full(len(sample), np.iinfo(np.int64).max)
        np.minimum.at(least_first, number, first)
        key = np.concatenate([least[self.cold], key[sample]])
        by_key = np.argsort(key, kind="stable")
        self.sent = np.concatenate([spans[self.cold], np.stack([batch[sample], start[sample], start[sample] + self.size], 1)])[by_key]
        self.sent_first = np.concatenate([self.first[self.cold], least_first])[by_key]
        place = np.empty(len(key), np.int64)
        place[by_key] = np.arange(len(key))
        self.cold_sent, self.hot_sent = place[: len(self.cold)], place[len(self.cold) + number]
        self.hot_later = first > least_first[number]  # another piece of the part has the window with a smaller id
        self.cuts = list(cut(owned(key[by_key], buckets), buckets))

    def windows(self, batch: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hash, number, sample) of single windows, which are told apart by their bytes, some at a time."""
        key, number, sample = np.zeros(len(start), np.uint64), np.zeros(len(start), np.int64), []
        for b in np.unique(batch):
            at = np.flatnonzero(batch == b)
            key[at] = mixed(gram_hashes(BYTE_VALUES[0][self.batches[b][0]], self.size))[start[at]]
        groups = 1 << max(0, (len(start) // MOST_WINDOWS).bit_length())
        group = (key & np.uint64(groups - 1)).astype(np.int32)
        for g in range(groups):
            own, flat = np.flatnonzero(group == g), []
            for b in np.unique(batch[own]):
                at = start[own[batch[own] == b]]
                flat.append(self.batches[b][0][ranges(at, np.full(len(at), self.size))])
            own = own[np.argsort(batch[own], kind="stable")]
            n, first = numbered(binary_array(np.concatenate(flat) if flat else np.zeros(0, np.uint8), np.full(len(own), self.size)))
            number[own] = n + sum(map(len, sample))
            sample.append(own[first])
        return key, number, np.concatenate(sample)

    def requests(self, part: int) -> pa.Table:
        bodies = []
        for _, i, j in self.cuts:
            spans = self.sent[i:j]
            head = np.concatenate([[j - i], self.sent_first[i:j], spans[:, 2] - spans[:, 1]]).astype(np.int64)
            bodies.append(head.tobytes() + b"".join(self.batches[b][0][s:e].tobytes() for b, s, e in spans.tolist()))
        return pa.table({"bucket": pa.array([c[0] for c in self.cuts], pa.int32()), "part": pa.array([part] * len(bodies), pa.int64()), "body": pa.array(bodies, pa.binary())})

    def removed(self, answers: dict) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(bytes, offsets, which bytes go) of each slice."""
        counts = self.sent[:, 2] - self.sent[:, 1] - self.size + 1
        bits = [np.unpackbits(np.frombuffer(answers[2, b], np.uint8), count=int(counts[i:j].sum())) for b, i, j in self.cuts]
        bits = np.concatenate(bits).astype(bool) if bits else np.zeros(0, bool)
        sent_at = np.cumsum(counts) - counts
        counts = (self.spans[:, 2] - self.spans[:, 1] - self.size + 1)[self.sample]
        begins = np.cumsum(counts) - counts
        sent, bits = bits, np.zeros(counts.sum(), bool)  # back to the order of pieces
        bits[ranges(begins[self.cold], counts[self.cold])] = sent[ranges(sent_at[self.cold_sent], counts[self.cold])]
        bits[ranges(begins[self.hot], counts[self.hot])] = sent[sent_at[self.hot_sent]] | self.hot_later
        later = self.owner > self.first[self.number]  # the part itself has a smaller id with the whole piece
        edges = np.searchsorted(self.spans[:, 0], np.arange(len(self.batches) + 1))
        for (data, offsets, _, _), i, j in zip(self.batches, edges, edges[1:]):
            number = self.number[i:j]
            lengths = counts[number]
            back = np.cumsum(lengths) - lengths
            step = np.arange(lengths.sum())
            hit = bits[np.repeat(begins[number] - back, lengths) + step] | np.repeat(later[i:j], lengths)
            places = (np.repeat(self.spans[i:j, 1] - back, lengths) + step)[hit]
            marks = np.zeros(len(data) + 1, np.int32)
            marks[places] += 1
            marks[places + self.size] -= 1
            yield data, offsets, np.cumsum(marks)[:-1] > 0


def deduplicate(docs: DataFrame, size: int = SIZE, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept): kept holds the bytes that stay, maybe cut inside a character."""
    spark = docs.sparkSession

    def hashes(part, rows):
        shared = Shared(rows, size, gram)
        return counted(part, shared.hashes, shared.times, buckets)

    def found(part, rows, answers):
        shared = Shared(rows, size, gram)
        shared.find(buckets, answers)
        return shared.requests(part)

    def finish(part, rows, answers):
        shared = Shared(rows, size, gram)
        shared.find(buckets, answers)
        ids, n, gone, spans, kept = [], [], [], [], []
        for data, offsets, out in shared.removed(answers):
            total = np.concatenate([[0], np.cumsum(out)])
            begun = out.copy()
            begun[1:] &= ~out[:-1]
            cuts = offsets[:-1][offsets[:-1] < offsets[1:]]
            begun[cuts] = out[cuts]
            runs = np.concatenate([[0], np.cumsum(begun)])
            n.append(np.diff(offsets))
            gone.append(np.diff(total[offsets]))
            spans.append(np.diff(runs[offsets]))
            left, at = data[~out].tobytes(), (offsets - total[offsets]).tolist()
            kept += [left[i:j] for i, j in zip(at, at[1:])]
        flat = lambda x: pa.array(np.concatenate(x) if x else [], pa.int64())
        return pa.table({"doc_id": rows["doc_id"], "n_bytes": flat(n), "n_removed": flat(gone), "n_spans": flat(spans), "kept": pa.array(kept, pa.binary())})

    plain = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    with parts(plain, "suffixes") as (texts, buckets):
        shared = stored(by_bucket(by_part(texts, hashes, REQUEST), 1, lambda bodies: elsewhere_or_hot(bodies, hot)), "shared-hashes")
        smaller = by_bucket(with_answers(texts, shared, found, REQUEST), 2, lambda bodies: answer(bodies, size))
        out = stored(with_answers(texts, shared.union(smaller), finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"), "suffix-dedup")
        remove_stored(shared)
        return out


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = deduplicate(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n FROM documents),
g AS (SELECT r, doc_id, i, h[2 * i + 1:2 * i + {2 * SIZE}] AS span FROM (SELECT r, doc_id, h, unnest(range(n - {SIZE} + 1)) AS i FROM d WHERE n >= {SIZE})),
c AS (SELECT r, i FROM (SELECT r, i, doc_id, min(doc_id) OVER (PARTITION BY span) AS least FROM g) WHERE least < doc_id),
p AS (SELECT DISTINCT r, unnest(range(i, i + {SIZE})) AS pos FROM c),
s AS (SELECT r, count(*) AS n_removed, count(*) FILTER (fresh) AS n_spans FROM (SELECT r, pos - lag(pos) OVER (PARTITION BY r ORDER BY pos) IS DISTINCT FROM 1 AS fresh FROM p) GROUP BY r),
u AS (SELECT r, pos, h[2 * pos + 1:2 * pos + 2] AS byte FROM (SELECT r, h, unnest(range(n)) AS pos FROM d WHERE r IN (SELECT r FROM s))),
k AS (SELECT u.r, coalesce(string_agg(byte, '' ORDER BY u.pos), '') AS kept FROM u LEFT JOIN p ON u.r = p.r AND u.pos = p.pos WHERE p.pos IS NULL GROUP BY u.r)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
       sha256(unhex(CASE WHEN s.r IS NULL THEN h ELSE coalesce(kept, '') END)) AS kept_sha256
FROM d LEFT JOIN s ON d.r = s.r LEFT JOIN k ON d.r = k.r
"""
