"""Vectorised scanning of Arrow text columns.

The kernels work on the UTF-8 bytes of whole record batches, so that Python
only loops over batches and long cuts of them, never over words.
"""

from __future__ import annotations

import contextlib
import ctypes
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

WORD = r"[^\x20\x09-\x0D]+"
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: besides blanks, all ASCII but letters and digits
NOT_TERM = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15 | 1
_MIX = None
_POW: np.ndarray | None = None
_INV: np.ndarray | None = None
CUT = 1 << 20


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, elementwise on uint64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """At least n powers of the hash base and of its inverse modulo 2**64."""
    global _POW, _INV, _MIX
    if _POW is None or len(_POW) < n:
        size = max(n, CUT + (CUT >> 2))
        base = np.full(size, _BASE, np.uint64)
        base[0] = 1
        inverse = np.full(size, pow(_BASE, -1, 1 << 64), np.uint64)
        inverse[0] = 1
        _POW, _INV = np.cumprod(base, dtype=np.uint64), np.cumprod(inverse, dtype=np.uint64)
    return _POW, _INV


def byte_mix() -> np.ndarray:
    global _MIX
    if _MIX is None:
        _MIX = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return _MIX


def spark_hash(ids: np.ndarray, buckets: int) -> np.ndarray:
    """pmod(xxhash64(id), buckets) of 64-bit integers, as Spark computes it."""
    p1, p2, p3, p4, p5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    turn = lambda x, n: (x << np.uint64(n)) | (x >> np.uint64(64 - n))
    h = (np.uint64(42 + 8) + p5) ^ (turn(ids.astype(np.uint64) * p2, 31) * p1)
    h = turn(h, 27) * p1 + p4
    h = (h ^ (h >> np.uint64(33))) * p2
    h = (h ^ (h >> np.uint64(29))) * p3
    return (h ^ (h >> np.uint64(32))).view(np.int64) % buckets


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    """The column, as text or binary with 32-bit offsets."""
    got = batch.column(batch.schema.get_field_index(name))
    return got.cast(pa.string()) if pa.types.is_large_string(got.type) else got


def text_buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and the offsets of each; a null is an empty text."""
    if col.null_count:
        col = col.fill_null("" if not pa.types.is_binary(col.type) else b"")
    n = len(col)
    offsets = np.frombuffer(col.buffers()[1], np.int32)[col.offset : col.offset + n + 1].astype(np.int64) if n else np.zeros(1, np.int64)
    raw = col.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], name: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about limit bytes of text (one row at least). After the last, what the worker has freed goes back to the system."""
    try:
        for batch in batches:
            if not batch.num_rows:
                continue
            _, offsets = text_buffers(column(batch, name))
            at = 0
            while at < batch.num_rows:
                to = int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1
                to = min(max(to, at + 1), batch.num_rows)
                yield batch.slice(at, to - at)
                at = to
    finally:
        batch = offsets = None
        release()


def release() -> None:
    """Gives free memory back: an idle worker that Spark keeps for later tasks would hold the most it ever used."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        with contextlib.suppress(AttributeError, OSError):  # other C libraries than GNU's lack it
            ctypes.CDLL(None).malloc_trim(0)


def word_cuts(data: np.ndarray, blank: np.ndarray = _BLANK, limit: int = CUT) -> Iterator[tuple[int, int]]:
    """Ranges of about limit bytes that end at a blank, so that no word is cut."""
    at, n = 0, len(data)
    while at < n:
        to = min(at + limit, n)
        while to < n:
            found = np.flatnonzero(blank[data[to : to + 4096]])
            if len(found):
                to += int(found[0])
                break
            to = min(to + 4096, n)
        yield at, to
        at = to


class Words:
    """All words of a batch in order: byte ranges, 64-bit hashes and the range of each text's words."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False, hashes: bool = True, blank: np.ndarray = _BLANK, heads: tuple[int, ...] = ()):
        """heads: also hash the first so many bytes of each longer word."""
        starts, ends, hashed, leads, owners, seen = [], [], [], [], [], 0
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        mixed = byte_mix()
        if lower:
            mixed = mixed[_LOWER]
        for a, b in word_cuts(data, blank):
            part = data[a:b]
            full = ~blank[part]
            first = full.copy()
            first[1:] &= ~full[:-1] | edge[a + 1 : b]
            last = full.copy()
            last[:-1] &= ~full[1:] | edge[a + 1 : b]
            s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
            starts.append(s + a)
            ends.append(e + a)
            if hashes:
                up, down = powers(len(part) + 1)
                total = np.zeros(len(part) + 1, np.uint64)
                np.cumsum(mixed[part] * up[: len(part)], out=total[1:])
                hashed.append(mix64((total[e] - total[s]) * down[s] + (e - s).astype(np.uint64)))
                for k in heads:
                    longer = np.flatnonzero(e - s > k)
                    at = s[longer]
                    leads.append(mix64(((total[at + k] - total[at]) * down[at] + np.uint64(k)) ^ np.uint64(0xA5A5A5A5A5A5A5A5)))
                    owners.append(longer + seen)
            seen += len(s)
        none = np.zeros(0, np.int64)
        self.data, self.offsets = data, offsets
        self.starts = np.concatenate(starts) if starts else none
        self.ends = np.concatenate(ends) if ends else none
        self.hashes = np.concatenate(hashed) if hashed else none.astype(np.uint64)
        self.heads = np.concatenate(leads) if leads else none.astype(np.uint64)
        self.owners = np.concatenate(owners) if owners else none
        #: words of text i: bounds[i] to bounds[i + 1]
        self.bounds = np.searchsorted(self.starts, offsets)

    def __len__(self) -> int:
        return len(self.starts)


def windows(hashes: np.ndarray, size: int, salt: int = 0) -> np.ndarray:
    """A hash of each run of size neighbours: as many elements as there are such runs."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    if salt:
        hashes = mix64(hashes ^ np.uint64(salt))
    up, down = powers(len(hashes) + 1)
    total = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * up[: len(hashes)], out=total[1:])
    return mix64((total[size:] - total[:n]) * down[:n])


def within(bounds: np.ndarray, size: int) -> np.ndarray:
    """The first words of all runs of size words that lie in one text; bounds as in Words."""
    n = int(bounds[-1])
    end = np.repeat(bounds[1:], np.diff(bounds))
    return np.flatnonzero(np.arange(size, n + size) <= end)


def joined(words: Words, keep: np.ndarray) -> list[bytes]:
    """Of each text the kept words, joined by one space."""
    data, starts, ends = words.data, words.starts[keep], words.ends[keep]
    at = np.concatenate([[0], np.cumsum(keep)])[words.bounds]
    lens = ends - starts + 1
    to = np.cumsum(lens)
    total = int(to[-1]) if len(to) else 0
    out = np.full(total, 0x20, np.uint8)
    source = np.arange(total) + np.repeat(starts - (to - lens), lens)
    inside = np.ones(total, bool)
    inside[to - 1] = False
    out[inside] = data[source[inside]]
    edges = np.concatenate([[0], to])[at]
    raw = out.tobytes()
    return [raw[a : max(a, b - 1)] for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
