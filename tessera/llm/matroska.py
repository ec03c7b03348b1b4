"""Matroska media columns: writing 8-bit sample tracks and parsing packet tables.

`store` writes the bytes of a text as an 8-bit PCM track of a Matroska file, one binary
value a row. `packets` parses any binary column of Matroska files into a packet table.
`read_back` parses each file, joins its packets and returns the payload's features.

Defined results: a null text is stored as an empty one, an empty one as 64 zero bytes;
equal texts give equal files; a null or damaged file yields no packets, and `read_back`
raises on it, since it only reads what `store` wrote. Texts of any length are held whole
in one row, and no rows meet, so repeated rows and skew have no effect. Rows go through a task
in slices of about `CHUNK_BYTES`.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import slices, table

#: Element ids of the format (fixed values).
EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0x1F43B675, 0x1C53BB6B
DOC_TYPE, DOC_TYPE_VERSION, DOC_TYPE_READ_VERSION = 0x4282, 0x4287, 0x4285
TIMESTAMP_SCALE, DURATION = 0x2AD7B1, 0x4489
TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, CODEC_ID, FLAG_LACING = 0xAE, 0xD7, 0x73C5, 0x83, 0x86, 0x9C
AUDIO, SAMPLING_FREQUENCY, CHANNELS, BIT_DEPTH = 0xE1, 0xB5, 0x9F, 0x6264
TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK = 0xE7, 0xA3, 0xA0, 0xA1
CUE_POINT, CUE_TIME, CUE_TRACK_POSITIONS, CUE_TRACK, CUE_CLUSTER_POSITION = 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
SEEK_HEAD, CHAPTERS, TAGS, ATTACHMENTS = 0x114D9B74, 0x1043A770, 0x1254C367, 0x1941A469
LEVEL_ONE = frozenset({INFO, TRACKS, CLUSTER, CUES, SEEK_HEAD, CHAPTERS, TAGS, ATTACHMENTS})
MASTERS = frozenset({EBML, SEGMENT, INFO, TRACKS, TRACK_ENTRY, AUDIO, CLUSTER, BLOCK_GROUP, CUES, CUE_POINT, CUE_TRACK_POSITIONS})

#: 8,000 samples a second, so that a frame of 512 samples lasts 64 milliseconds.
RATE, FRAME, FRAMES_A_BLOCK, BLOCKS_A_CLUSTER, UNIT = 8000, 512, 8, 32, 64


class Packet(NamedTuple):
    cluster: int
    track: int
    timestamp: int
    lacing: int
    key: bool
    start: int
    size: int


def _size(n: int) -> bytes:
    """A data size in as few bytes as hold it; all ones is kept for an unknown size."""
    width = 1
    while n >= (1 << 7 * width) - 1:
        width += 1
    return (n | 1 << 7 * width).to_bytes(width, "big")


def _element(kind: int, body: bytes) -> bytes:
    return kind.to_bytes((kind.bit_length() + 7) // 8, "big") + _size(len(body)) + body


def _number(kind: int, n: int) -> bytes:
    return _element(kind, n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big"))


def payload(text: str | None) -> bytes:
    """UTF-8 with zero bytes up to a positive multiple of 64."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + bytes(-len(raw) % UNIT if raw else UNIT)


def _block(frames: list[bytes], after: int) -> bytes:
    """A simple block of track 1; equal frames are laced at fixed size, others with EBML sizes."""
    if len(frames) == 1:
        return _element(SIMPLE_BLOCK, b"\x81" + struct.pack(">hB", after, 0x80) + frames[0])
    sizes = [len(x) for x in frames]
    count = bytes([len(frames) - 1])
    if len(set(sizes)) == 1:
        return _element(SIMPLE_BLOCK, b"\x81" + struct.pack(">hB", after, 0x84) + count + b"".join(frames))
    lace = _size(sizes[0])
    for a, b in zip(sizes, sizes[1:-1]):
        width = 1
        while not -(1 << 7 * width - 1) < b - a < (1 << 7 * width - 1):
            width += 1
        lace += (b - a + (1 << 7 * width - 1) - 1 | 1 << 7 * width).to_bytes(width, "big")
    return _element(SIMPLE_BLOCK, b"\x81" + struct.pack(">hB", after, 0x86) + count + lace + b"".join(frames))


def mux(samples: bytes) -> bytes:
    """A Matroska file with one track of 8-bit samples, clusters, laced blocks and cues."""
    head = _element(EBML, _element(DOC_TYPE, b"matroska") + _number(DOC_TYPE_VERSION, 4) + _number(DOC_TYPE_READ_VERSION, 2))
    info = _element(INFO, _number(TIMESTAMP_SCALE, 1_000_000) + _element(DURATION, struct.pack(">d", len(samples) * 1000 / RATE)))
    audio = _element(AUDIO, _element(SAMPLING_FREQUENCY, struct.pack(">d", RATE)) + _number(CHANNELS, 1) + _number(BIT_DEPTH, 8))
    entry = _number(TRACK_NUMBER, 1) + _number(TRACK_UID, 1) + _number(TRACK_TYPE, 2) + _number(FLAG_LACING, 1)
    tracks = _element(TRACKS, _element(TRACK_ENTRY, entry + _element(CODEC_ID, b"A_PCM/INT/LIT") + audio))
    clusters, cues, at = [], [], len(info) + len(tracks)
    step = FRAME * FRAMES_A_BLOCK
    for start in range(0, len(samples), step * BLOCKS_A_CLUSTER):
        time = start * 1000 // RATE
        body = [_number(TIMESTAMP, time)]
        for b in range(start, min(start + step * BLOCKS_A_CLUSTER, len(samples)), step):
            part = samples[b : b + step]
            body.append(_block([part[i : i + FRAME] for i in range(0, len(part), FRAME)], b * 1000 // RATE - time))
        clusters.append(_element(CLUSTER, b"".join(body)))
        place = _element(CUE_TRACK_POSITIONS, _number(CUE_TRACK, 1) + _number(CUE_CLUSTER_POSITION, at))
        cues.append(_element(CUE_POINT, _number(CUE_TIME, time) + place))
        at += len(clusters[-1])
    return head + _element(SEGMENT, b"".join([info, tracks, *clusters, _element(CUES, b"".join(cues))]))


def _vint(data: bytes, at: int, keep_marker: bool = False) -> tuple[int, int]:
    """A variable-length integer and where it ends; -1 where all its bits are ones (unknown size)."""
    first = data[at]
    if not first:
        raise ValueError(f"no element starts at byte {at}")
    width = 9 - first.bit_length()
    if at + width > len(data):
        raise ValueError("the file ends inside an element")
    raw = int.from_bytes(data[at : at + width], "big")
    if keep_marker:
        return raw, at + width
    n = raw & (1 << 7 * width) - 1
    return (-1 if n == (1 << 7 * width) - 1 else n), at + width


def elements(data: bytes, start: int, end: int) -> Iterator[tuple[int, int, int]]:
    """(id, first byte, end) of the elements in a range, masters before what they hold.

    A segment or cluster of unknown size, as streams have them, is given with the end of its
    parent; what it holds ends where the next element of the segment's level begins.
    """
    opened = [(end, 0, False)]  # end, id and unknown size of each master that is open
    while True:
        while len(opened) > 1 and start >= opened[-1][0]:
            opened.pop()
        if start >= opened[-1][0]:
            return
        kind, at = _vint(data, start, keep_marker=True)
        n, at = _vint(data, at)
        if kind in LEVEL_ONE:
            while opened[-1][2] and opened[-1][1] != SEGMENT:
                opened.pop()
        elif kind in (EBML, SEGMENT):
            while opened[-1][2]:
                opened.pop()
        if n < 0 and kind not in MASTERS:
            raise ValueError("an element that holds data has no size")
        stop = opened[-1][0] if n < 0 else at + n
        if stop > opened[-1][0]:
            raise ValueError("an element reaches beyond its parent")
        yield kind, at, stop
        if kind in MASTERS:
            opened.append((stop, kind, n < 0))
            start = at
        else:
            start = stop


def _laces(data: bytes, at: int, end: int, lacing: int) -> list[tuple[int, int]]:
    """(first byte, length) of the frames of a block."""
    if not lacing:
        return [(at, end - at)]
    count, at, sizes = data[at] + 1, at + 1, []
    if lacing == 2:  # fixed
        if (end - at) % count:
            raise ValueError("frames of a fixed lacing differ in size")
        sizes = [(end - at) // count] * count
    elif lacing == 1:  # Xiph
        for _ in range(count - 1):
            n = 0
            while data[at] == 255:
                n, at = n + 255, at + 1
            sizes.append(n + data[at])
            at += 1
    else:  # EBML
        for i in range(count - 1):
            before = at
            n, at = _vint(data, at)
            sizes.append(sizes[-1] + n - ((1 << 7 * (at - before) - 1) - 1) if i else n)
    if lacing != 2:
        sizes.append(end - at - sum(sizes))
    if min(sizes) < 0:
        raise ValueError("laced frames are longer than their block")
    out = []
    for n in sizes:
        out.append((at, n))
        at += n
    return out


def demux(data: bytes) -> tuple[list[Packet], dict[int, str], list[tuple[int, int, int]], int]:
    """The packets in file order, each track's codec, the cues as (time, track, byte) and the clusters."""
    packets, codecs, cues = [], {}, []
    segment = cluster = -1
    time = number = cue_time = cue_track = 0
    for kind, at, end in elements(data, 0, len(data)):
        if kind == SEGMENT:
            segment = at
        elif kind == CLUSTER:
            cluster += 1
            time = 0
        elif kind == TIMESTAMP:
            time = int.from_bytes(data[at:end], "big")
        elif kind in (SIMPLE_BLOCK, BLOCK):
            track, at = _vint(data, at)
            after, flags = struct.unpack_from(">hB", data, at)
            lacing = flags >> 1 & 3
            packets += [Packet(cluster, track, time + after, lacing, kind == BLOCK or flags > 127, a, n) for a, n in _laces(data, at + 3, end, lacing)]
        elif kind == TRACK_NUMBER:
            number = int.from_bytes(data[at:end], "big")
        elif kind == CODEC_ID:
            codecs[number] = data[at:end].decode("ascii", "replace")
        elif kind == CUE_TIME:
            cue_time = int.from_bytes(data[at:end], "big")
        elif kind == CUE_TRACK:
            cue_track = int.from_bytes(data[at:end], "big")
        elif kind == CUE_CLUSTER_POSITION:
            cues.append((cue_time, cue_track, segment + int.from_bytes(data[at:end], "big")))
    return packets, codecs, cues, cluster + 1


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): each whole text as a Matroska file."""

    def write(batches):
        for batch in batches:
            for part in slices(batch):
                texts = part.column(1).to_pylist()
                media = [mux(payload(t)) for t in texts]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len((t or "").encode("utf-8", "surrogatepass")) for t in texts], pa.int64()), pa.array(media, pa.binary())],
                    ["doc_id", "n_bytes", "media"],
                )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(write, "doc_id long, n_bytes long, media binary")


def packets(files: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """One row a packet: doc_id, packet, cluster, track, timestamp, lacing, is_key, start, size, is_cue.

    start and size are the frame's byte range in the file; is_cue tells that a cue points to the
    packet's cluster. Damaged files and nulls have no rows.
    """
    fields = "doc_id long, packet int, cluster int, track int, timestamp long, lacing int, is_key boolean, start long, size long, is_cue boolean"

    def read(batches):
        for batch in batches:
            for key, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    found, _, cues, _ = demux(data or b"")
                    starts = [at for kind, at, _ in elements(data or b"", 0, len(data or b"")) if kind == CLUSTER]
                except (ValueError, IndexError, struct.error):
                    continue
                cued = {sum(s <= place for s in starts) for _, _, place in cues}
                yield pa.RecordBatch.from_pylist(
                    [
                        {"doc_id": key, "packet": i, "cluster": p.cluster, "track": p.track, "timestamp": p.timestamp, "lacing": p.lacing, "is_key": p.key, "start": p.start, "size": p.size, "is_cue": p.cluster in cued}
                        for i, p in enumerate(found)
                    ],
                    schema=pa.schema([("doc_id", pa.int64()), ("packet", pa.int32()), ("cluster", pa.int32()), ("track", pa.int32()), ("timestamp", pa.int64()), ("lacing", pa.int32()), ("is_key", pa.bool_()), ("start", pa.int64()), ("size", pa.int64()), ("is_cue", pa.bool_())]),
                )

    return files.select(F.col(id_col).cast("long").alias("doc_id"), F.col(media_col).alias("media")).mapInArrow(read, fields)


def _feature(data: bytes, read: bytes, found: list[Packet], codecs: dict[int, str], cues: list, clusters: int) -> str:
    samples = np.frombuffer(read, np.uint8)
    counts = np.bincount(samples, minlength=256)
    p = counts[counts > 0] / len(samples)
    last = found[-1]
    return (
        f"codec={codecs[found[0].track]};packets={len(found)};clusters={clusters};cues={len(cues)};laced={sum(x.lacing > 0 for x in found)};"
        f"ms={last.timestamp};mean={samples.mean():.3f};entropy={abs(-(p * np.log2(p)).sum()):.3f}"
    )


def read_back(files: DataFrame) -> DataFrame:
    """Parses what `store` wrote: doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature."""

    def read(batches):
        for batch in batches:
            for part in slices(batch, "media"):
                rows = []
                for data in part.column(2).to_pylist():
                    found, codecs, cues, clusters = demux(data)
                    body = b"".join(data[p.start : p.start + p.size] for p in found)
                    rows.append((len(body), hashlib.sha256(body).hexdigest(), zlib.crc32(body[-UNIT:]), len(data), hashlib.sha256(data).hexdigest(), _feature(data, body, found, codecs, cues, clusters)))
                sizes, shas, tails, lengths, digests, features = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(sizes, pa.int64()), pa.array(shas), pa.array(tails, pa.int64()), pa.array(lengths, pa.int64()), pa.array(digests), pa.array(features)],
                    ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"],
                )

    return files.select("doc_id", "n_bytes", "media").mapInArrow(
        read, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    )


def op7_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_back(store(table(spark, sf_dir, "documents")))
