"""Vectorised byte-level text tools shared by the Python-side operators.

A column of strings is treated as one contiguous byte buffer with row offsets;
hashes of any substring come from prefix sums of ``T[byte] * BASE**position``
modulo 2**64, so that no per-row Python loop runs in the hot path.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
BASE_INV = np.uint64(pow(int(BASE), -1, 1 << 64))
_TABLE = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[str, np.ndarray] = {}
#: Powers that a worker remembers (8 MB for each of the two bases); longer tables are made anew.
_KEPT = (1 << 20) + (1 << 12)


def _power(base: np.uint64, n: int, name: str) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        size = max(_KEPT, n)
        have = np.full(size, base, dtype=np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        if size == _KEPT:
            _powers[name] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values (multiply and xor-shift), into a new array."""
    x = x ^ (x >> np.uint64(31))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(32)
    return x


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """P with P[j] - P[i] = hash of data[i:j] times BASE**i."""
    out = np.empty(len(data) + 1, dtype=np.uint64)
    out[0] = 0
    np.cumsum(_TABLE[data] * _power(BASE, len(data), "up"), out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Mixed 64-bit hashes of the spans [start, end), length included."""
    down = _power(BASE_INV, len(prefix), "down")
    h = (prefix[end] - prefix[start]) * down[start]
    return mix(h + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all rows together, and len + 1 offsets; null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def chunks(offsets: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``most`` bytes; a longer row is a range of its own."""
    n, at = len(offsets) - 1, 0
    while at < n:
        end = int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1
        end = min(n, max(at + 1, end))
        yield at, end
        at = end


def overlapping(data: np.ndarray, offsets: np.ndarray, overlap: int, most: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """First row, place in that row, bytes and row offsets of parts of about ``most`` bytes; a longer row comes in stretches that share ``overlap`` bytes."""
    for a, b in chunks(offsets, most):
        own = data[offsets[a] : offsets[b]]
        if b - a > 1 or len(own) <= 2 * most:
            yield a, 0, own, offsets[a : b + 1] - offsets[a]
            continue
        for at in range(0, len(own) - overlap, most):
            piece = own[at : at + most + overlap]
            yield a, at, piece, np.array([0, len(piece)])


def word_spans(keep: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of kept bytes inside rows: start, end, row."""
    n = len(keep)
    if not n:
        empty = np.empty(0, np.int64)
        return empty, empty, empty
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    before = np.empty(n, dtype=bool)
    before[0] = False
    before[1:] = keep[:-1]
    start = np.flatnonzero(keep & (~before | edge[:n]))
    after = np.empty(n, dtype=bool)
    after[-1] = False
    after[:-1] = keep[1:]
    end = np.flatnonzero(keep & (~after | edge[1:])) + 1
    row = np.searchsorted(offsets, start, side="right") - 1
    return start, end, row


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True


def lower(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z; all other bytes stay."""
    return _LOWER[data]


def word_hashes(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray, most: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every word: a run of bytes that ``inside`` (a table of 256) holds, A-Z lower-cased.

    Bytes are hashed in stretches of about ``most``, which end between words, so that a
    very long text needs little more memory than its words' hashes.
    """
    hashes, rows = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
    lo, n = 0, len(data)
    while lo < n:
        hi = min(n, lo + most)
        while hi < n:
            ends = np.flatnonzero(~inside[_LOWER[data[hi : hi + 4096]]])
            if len(ends):
                hi += int(ends[0])
                break
            hi = min(n, hi + 4096)
        low = _LOWER[data[lo:hi]]
        start, end, row = word_spans(inside[low], np.clip(offsets - lo, 0, hi - lo))
        hashes.append(span_hash(prefix_hash(low), start, end))
        rows.append(row)
        lo = hi
    return np.concatenate(hashes), np.concatenate(rows)


#: Bytes of words between spaces, tabs and line ends (0x20, 0x09-0x0D).
NOT_BLANK = ~_BLANK
