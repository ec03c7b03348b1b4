import hashlib
import zlib

import pytest

from tessera.llm import matroska as M

ROWS = [(1, "abc"), (2, None), (3, ""), (4, "é" * 10_000), (5, "x" * 64), (6, "y" * 300_000), (None, "abc"), (1, "abc")]


def test_round_trip(spark):
    docs = spark.createDataFrame([(t, k, 1) for k, t in ROWS], "text string, doc_id long, media int").repartition(3)
    out = sorted((tuple(r) for r in M.read_back(M.store(docs)).collect()), key=str)
    want = []
    for key, text in ROWS:
        p = M.payload(text)
        assert len(p) % 64 == 0 and len(p) >= 64 and p.rstrip(b"\0") == (text or "").encode()
        file = M.mux(p)
        want.append((key, len((text or "").encode()), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]), len(file), hashlib.sha256(file).hexdigest()))
    assert [x[:-1] for x in out] == sorted(want, key=str)
    assert M.read_back(M.store(docs.limit(0))).collect() == []


def test_packets_cover_the_payload(spark):
    p = M.payload("z" * 300_000)
    data = M.mux(p)
    files = spark.createDataFrame([(1, data), (2, None), (3, data[:-30]), (4, b"\0\0")], "doc_id long, media binary")
    rows = sorted(M.packets(files).collect(), key=lambda r: (r.doc_id, r.packet))
    assert {r.doc_id for r in rows} == {1}
    assert b"".join(data[r.start : r.start + r.size] for r in rows) == p
    assert all(r.is_cue for r in rows) and [r.timestamp for r in rows] == sorted(r.timestamp for r in rows)
    assert len({r.cluster for r in rows}) == -(-len(p) // (512 * 8 * 32))


@pytest.mark.parametrize("lacing,sizes", [(1, [300, 20, 255]), (3, [300, 20, 255, 7]), (2, [9, 9])])
def test_lacings(lacing, sizes):
    head = bytes([len(sizes) - 1])
    if lacing == 1:
        head += b"".join(b"\xff" * (n // 255) + bytes([n % 255]) for n in sizes[:-1])
    elif lacing == 3:
        head += M._size(sizes[0])
        for a, b in zip(sizes, sizes[1:-1]):
            head += (b - a + 8191 | 1 << 14).to_bytes(2, "big")
    data = head + bytes(sum(sizes))
    found = M._laces(data, 0, len(data), lacing)
    assert [n for _, n in found] == sizes and found[0][0] == len(head)


def test_unknown_sizes():
    body = M._element(M.CLUSTER, M._number(M.TIMESTAMP, 5) + M._element(M.SIMPLE_BLOCK, b"\x81\0\x02\x80data"))
    data = M._element(M.EBML, b"") + M.SEGMENT.to_bytes(4, "big") + b"\xff" + M._element(M.TRACKS, b"") + body
    packets, _, _, clusters = M.demux(data)
    assert clusters == 1 and packets[0].timestamp == 7 and data[packets[0].start :][: packets[0].size] == b"data"


def test_streamed_files_of_many_clusters(spark):
    """Segment and clusters of unknown size: each cluster ends where the next one begins."""
    unknown = lambda kind, body: kind.to_bytes((kind.bit_length() + 7) // 8, "big") + b"\xff" + body
    n = 5000
    cluster = lambda i: unknown(M.CLUSTER, M._number(M.TIMESTAMP, i) + M._element(M.SIMPLE_BLOCK, b"\x81\0\x01\x80" + i.to_bytes(4, "big")))
    data = M._element(M.EBML, b"") + unknown(M.SEGMENT, M._element(M.TRACKS, b"") + b"".join(map(cluster, range(n))) + M._element(M.CUES, b""))
    rows = sorted(M.packets(spark.createDataFrame([(1, data)], "doc_id long, media binary")).collect(), key=lambda r: r.packet)
    assert [(r.cluster, r.timestamp, data[r.start : r.start + r.size]) for r in rows] == [(i, i + 1, i.to_bytes(4, "big")) for i in range(n)]


def test_slices_of_few_bytes():
    from tessera.llm.common import slices

    batch = M.pa.RecordBatch.from_pydict({"id": list(range(6)), "media": [b"x" * n for n in (10, 60, 40, 500, 0, 1)]})
    assert [p.column(0).to_pylist() for p in slices(batch, "media", 100)] == [[0, 1], [2], [3], [4, 5]]


def test_a_file_written_by_hand():
    """Byte by byte after the public format: unknown segment size, a simple block, a block with Xiph lacing in a group."""
    head = bytes.fromhex("1A45DFA3 8B 4282 88") + b"matroska"
    tracks = bytes.fromhex("1654AE6B 8C AE 8A D7 81 02 86 85") + b"V_VP8"
    simple = bytes.fromhex("A3 87 82 000A 80") + b"abc"
    group = bytes.fromhex("A0 8D A1 8B 82 0014 02 01 02") + b"de" + b"fgh"
    cluster = bytes.fromhex("1F43B675 9C E7 82 03E8") + simple + group
    data = head + bytes.fromhex("18538067 01FFFFFFFFFFFFFF") + tracks + cluster
    packets, codecs, cues, _ = M.demux(data)
    assert [data[p.start : p.start + p.size] for p in packets] == [b"abc", b"de", b"fgh"]
    assert [(p.track, p.timestamp) for p in packets[:2]] == [(2, 1010), (2, 1020)] and {p.cluster for p in packets} == {0}
    assert codecs == {2: "V_VP8"} and cues == []
