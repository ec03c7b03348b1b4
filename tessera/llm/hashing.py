"""Vectorised hashing of words and byte strings for code that runs inside tasks.

A text column becomes one byte array with offsets; words, windows and their hashes are then
numpy arrays over the whole slice. Words are told apart by a keyed 128-bit BLAKE2b digest of
their bytes, made once for each distinct word of a slice. Runs of values are hashed by a tree:
two neighbouring runs are joined by a step that is not linear, so no pattern of repeated or
swapped values cancels out.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa

U64 = np.uint64

#: Space, tab, newline, vertical tab, form feed and return.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

#: The key of the digests, which are kept in indexes; random values of bytes; an odd factor for
#: each of two families of tree hashes.
KEY = b"tessera words 1"
_random = np.random.default_rng(20240229)
BYTE_VALUES = _random.integers(0, 1 << 64, (2, 256), dtype=U64)
FACTORS = tuple(U64(int(x) | 1) for x in _random.integers(0, 1 << 64, 2, dtype=U64))


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective finish that spreads every bit (the 64-bit finalizer of MurmurHash3)."""
    h = h ^ (h >> U64(33))
    h *= U64(0xFF51AFD7ED558CCD)
    h ^= h >> U64(33)
    h *= U64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U64(33))


def raw(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a text column; nulls are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
        if isinstance(texts, pa.ChunkedArray):
            texts = pa.concat_arrays(texts.chunks) if texts.num_chunks else pa.array([], pa.string())
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    found = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return found[offsets[0] : offsets[-1]], offsets - offsets[0]


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first): where each word lies, and the index of each text's first word.

    Words are runs of bytes other than white space and never cross texts; `first` has one
    more entry than there are texts.
    """
    inside = ~SPACE[data]
    starts, ends = inside.copy(), inside.copy()
    starts[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    cuts = offsets[:-1][(offsets[:-1] < offsets[1:])]
    starts[cuts] = inside[cuts]
    ends[cuts[1:] - 1] = inside[cuts[1:] - 1]
    where = np.flatnonzero(starts)
    return where, np.flatnonzero(ends) + 1, np.searchsorted(where, offsets)


def binary_array(flat: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """Consecutive byte strings of the given lengths."""
    offsets = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=offsets[1:])
    return pa.Array.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(flat))])


def word_digests(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """(2, words): the halves of the keyed digest of each word that `words` has found."""
    if not len(starts):
        return np.zeros((2, 0), U64)
    coded = binary_array(data[~SPACE[data]], ends - starts).dictionary_encode()  # compares bytes
    digests = b"".join(hashlib.blake2b(w, digest_size=16, key=KEY).digest() for w in coded.dictionary.to_pylist())
    table = np.frombuffer(digests, U64).reshape(-1, 2).T
    return np.ascontiguousarray(table[:, coded.indices.to_numpy(zero_copy_only=False)])


def remaining(first: np.ndarray) -> np.ndarray:
    """How many items each item's text still has, itself included."""
    return np.repeat(first[1:], np.diff(first)) - np.arange(first[-1])


def window_starts(first: np.ndarray, size: int) -> np.ndarray:
    """The indexes at which a window of `size` items lies within one text."""
    return np.flatnonzero(remaining(first) >= size)


def joined(left: np.ndarray, right: np.ndarray, family: int) -> np.ndarray:
    h = left * FACTORS[family]
    h += right
    return mixed(h)


def gram_hashes(values: np.ndarray, size: int, family: int = 0) -> np.ndarray:
    """The hashes of all runs of `size` consecutive values."""
    n = len(values) - size + 1
    if n < 1:
        return values[:0]
    level, width, have, out = values, 1, 0, None  # out: the runs of the lowest bits of size, at their own places
    while True:
        if size & width:
            out = level if out is None else _behind(level, out, width, family)
            have += width
        if have == size:
            return mixed(out[:n] + U64(size))
        level = joined(level[:-width], level[width:], family)
        width *= 2


def _behind(level: np.ndarray, out: np.ndarray, width: int, family: int) -> np.ndarray:
    """Runs of `width` values, each followed by the shorter run that begins behind it."""
    n = min(len(level), len(out) - width)
    return joined(level[:n], out[width : width + n], family)


def pieces(least: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(starts, counts): maximal runs of window starts in one text whose windows have the same least hash.

    least: the least gram hash of the window at each start; first: offsets of the texts.
    """
    left = remaining(first)[: len(least)]
    ok = left >= size
    fresh = np.ones(len(least), bool)
    fresh[1:] = (least[1:] != least[:-1]) | ~ok[:-1]
    cuts = first[:-1]
    fresh[cuts[cuts < len(least)]] = True
    starts = np.flatnonzero(fresh & ok)
    nexts = np.append(starts[1:], len(least))
    return starts, np.minimum(nexts - starts, left[starts] - size + 1)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` consecutive values, by doubling; shorter by width - 1."""
    if len(values) < width:
        return values[:0]
    out, have = values, 1
    while 2 * have <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    rest = width - have
    return np.minimum(out[:-rest], out[rest:]) if rest else out
