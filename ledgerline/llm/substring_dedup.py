"""Removal of repeated passages, exactly, behind a count-min prefilter (operator 7).

A window is `size` consecutive words of one document. Each word covered by a
window whose word sequence also starts earlier (smaller key, or same document
and earlier start) is removed; windows are judged on the input.

1. Documents are bundled in units of some MB, compressed, and written to the
   shared folder once; every later pass reads the same units.
2. The hash of a window names a shard and a fingerprint there. Each unit sends
   its partial sketch to every shard: its different fingerprints, delta-coded,
   and which of them it holds twice. A shard merges them into a count-min sketch
   (two rows of counters that saturate at 2) that never underestimates, and
   answers each unit with one bit a fingerprint: estimated as repeated or not.
3. A second pass takes only windows estimated as repeated. Within a unit all but
   the first occurrence are settled at once, so a hot window sends one row for
   each unit. The first ones meet by 128-bit digest of their words, and all but
   the earliest are repeated.
4. Settled starts meet their units and the covered words go.

Shards are as many as the windows need, so counters are filled alike at every
size: the share of windows that pass the prefilter doesn't grow with the input,
no task holds more than one shard, unit or group of digests, and neither the
driver nor a broadcast holds any part of the sketch. With windows of 64-bit
hashes h(w) (word sequences stand as 128-bit digests), two of n different
windows are taken for one with a probability of about n * n / 2**129.

Null text: no words, empty result. Rows with a null key take no part and keep
their words. Rows that repeat a key are one document: windows with equal key and
start count as one place. Other columns of the input are carried or not read.
An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.shared import checkpointed, small_batches
from ledgerline.llm.text import Words, column, joined, mix64, slices, text_buffers, windows, within

SIZE = 20
UNIT = 4 << 20  # bytes of text
SHARD = 1 << 20  # windows; up to 32 times as many where there would be over 2**14 shards
MAX_BITS = 28  # of a row of a shard's counters
GROUP = 32 << 20  # bytes of text whose repeated windows one group of digests stands for
_SALT = 0x51_7C_C1_B7_27_22_0A_95


def pack_deltas(spots: np.ndarray) -> bytes:
    """Ascending positions below 2**32: their gaps, byte plane by byte plane, compressed."""
    gaps = np.diff(spots, prepend=0).astype("<u4")
    return zstandard.compress(np.ascontiguousarray(gaps.view(np.uint8).reshape(-1, 4).T).tobytes(), 1)


def unpack_deltas(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(raw), np.uint8).reshape(4, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u4").ravel(), dtype=np.int64)


def pack_bits(flags: np.ndarray) -> bytes:
    return np.packbits(flags, bitorder="little").tobytes()


def unpack_bits(raw: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(raw, np.uint8), count=n, bitorder="little").astype(bool)


class Sketch:
    """How hashes of windows fall on shards, fingerprints and counters."""

    def __init__(self, total: int, max_bits: int = MAX_BITS):
        """total: bytes of text; a window for each 6 bytes is the estimate."""
        n = max(1, total // 6)
        held = min(32 * SHARD, max(SHARD, n >> 14))
        self.shards = max(1, min(64, n >> 12), -(-n // held))
        #: 8 counters a window, or more
        self.bits = min(max_bits, max(10, math.ceil(math.log2(8 * n / self.shards))))
        self.width = min(32, self.bits + 8)  # of a fingerprint

    def place(self, hashes: np.ndarray) -> np.ndarray:
        """Shard and fingerprint in one number."""
        shard = ((hashes >> np.uint64(32)) * np.uint64(self.shards)) >> np.uint64(32)
        return shard << np.uint64(self.width) | hashes & np.uint64((1 << self.width) - 1)

    def cuts(self, places: np.ndarray) -> np.ndarray:
        """Where the places of each shard begin, in ascending places."""
        return np.searchsorted(places, np.arange(self.shards + 1, dtype=np.uint64) << np.uint64(self.width))

    def counters(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The counter of each fingerprint in both rows."""
        low = np.uint64((1 << self.bits) - 1)
        x = prints.astype(np.uint64)
        return x & low, mix64(x + np.uint64(_SALT)) & low


class Unit:
    """The rows of a unit, and the windows of those that have a key."""

    def __init__(self, blob: bytes, size: int, hashes: bool = True):
        with pa.ipc.open_stream(zstandard.decompress(blob)) as reader:
            self.batch = reader.read_all().combine_chunks().to_batches()[0]
        self.words = Words(*text_buffers(column(self.batch, "text")), hashes=hashes)
        self.ids = self.batch.column(0).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        if hashes:
            starts = within(self.words.bounds, size)
            row = np.searchsorted(self.words.bounds, starts, "right") - 1
            named = self.batch.column(0).is_valid().to_numpy(zero_copy_only=False)[row]
            self.starts, self.row = starts[named], row[named]
            self.hashes = windows(self.words.hashes, size)[self.starts]


def units(ids: DataFrame, unit: int) -> DataFrame:
    """unit, blob: rows of about `unit` bytes of text as a compressed Arrow stream, written to the shared folder. ids: id, text, carried."""

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, n = TaskContext.get().partitionId() << 32, 0
        held: list[pa.RecordBatch] = []
        size = 0

        def flush() -> pa.RecordBatch:
            whole = pa.Table.from_batches(held).combine_chunks()
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, whole.schema) as writer:
                writer.write_table(whole)
            blob = zstandard.compress(sink.getvalue(), 5)
            return pa.RecordBatch.from_arrays([pa.array([first + n], pa.int64()), pa.array([blob], pa.binary())], names=["unit", "blob"])

        for batch in slices(batches, "text", unit):
            size += int(text_buffers(column(batch, "text"))[1][-1])
            held.append(batch)
            if size >= unit // 2:
                yield flush()
                held, size, n = [], 0, n + 1
        if held:
            yield flush()

    return checkpointed(ids.mapInArrow(bundle, "unit long, blob binary"))


def sketched(bundled: DataFrame, size: int, sketch: Sketch) -> DataFrame:
    """unit, shard, bits: of the unit's fingerprints in that shard, in order, which are estimated as repeated."""
    schema = pa.schema([("shard", pa.int32()), ("unit", pa.int64()), ("prints", pa.binary()), ("twice", pa.binary())])

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for unit, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                places, times = np.unique(sketch.place(Unit(blob.as_py(), size).hashes), return_counts=True)
                cuts = sketch.cuts(places)
                prints, twice = (places & np.uint64((1 << sketch.width) - 1)).astype(np.int64), times > 1
                some = np.flatnonzero(np.diff(cuts))
                ranges = [slice(cuts[s], cuts[s + 1]) for s in some]
                yield pa.RecordBatch.from_arrays([
                    pa.array(some, pa.int32()), pa.array([unit] * len(some), pa.int64()), pa.array([pack_deltas(prints[r]) for r in ranges], pa.binary()), pa.array([pack_bits(twice[r]) for r in ranges], pa.binary()),
                ], schema=schema)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A partition is a shard."""
        held: list[tuple[int, bytes, bytes]] = []

        def answered(shard: int) -> Iterator[pa.RecordBatch]:
            rows = np.zeros((2, 1 << sketch.bits), np.uint8)
            for _, raw, twice in held:
                prints = unpack_deltas(raw)
                twice = unpack_bits(twice, len(prints))
                for row, spots in zip(rows, sketch.counters(prints), strict=True):
                    row[spots] = np.minimum(row[spots] + 1, 2)
                    row[spots[twice]] = 2  # after the others: fingerprints may share a counter
            for at in range(0, len(held), 64):
                part, bits = held[at : at + 64], []
                for _, raw, _ in part:
                    one, two = sketch.counters(unpack_deltas(raw))
                    bits.append(pack_bits(np.minimum(rows[0][one], rows[1][two]) > 1))
                yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in part], pa.int64()), pa.array([shard] * len(part), pa.int32()), pa.array(bits, pa.binary())], names=["unit", "shard", "bits"])

        for batch in batches:
            for shard, unit, raw, twice in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.append((unit, raw, twice))
        if held:
            yield from answered(shard)

    touched = bundled.mapInArrow(partial, "shard int, unit long, prints binary, twice binary")
    return touched.repartitionById(sketch.shards, "shard").mapInArrow(merge, "unit long, shard int, bits binary")


def _heads(doc: np.ndarray, start: np.ndarray, k1: np.ndarray, k2: np.ndarray) -> np.ndarray:
    """Which occurrences lie at their digest's earliest place."""
    if not len(doc):
        return np.zeros(0, bool)
    placed = np.lexsort((start, doc))
    order = placed[np.argsort(k1[placed], kind="stable")]
    a, b = k1[order], k2[order]
    if np.any((a[1:] == a[:-1]) & (b[1:] != b[:-1])):  # equal halves of different digests
        order = np.lexsort((start, doc, k2, k1))
        a, b = k1[order], k2[order]
    heads = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
    head = np.repeat(order[heads], np.diff(np.append(heads, len(order))))
    out = np.zeros(len(doc), bool)
    out[order] = (doc[order] == doc[head]) & (start[order] == start[head])
    return out


_MET = "kind int, part long, unit long, at binary, doc binary, base binary, k1 binary, k2 binary"
_MET_SCHEMA = pa.schema([("kind", pa.int32()), ("part", pa.int64()), ("unit", pa.int64()), *((c, pa.binary()) for c in ("at", "doc", "base", "k1", "k2"))])


def _met(rows: list[tuple]) -> pa.RecordBatch:
    full = [r + (None,) * (8 - len(r)) for r in rows]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in full], f.type) for i, f in enumerate(_MET_SCHEMA)], schema=_MET_SCHEMA)


def settled(bundled: DataFrame, answers: DataFrame, size: int, sketch: Sketch, groups: int) -> DataFrame:
    """unit, at: packed positions, among the unit's words, of the starts of windows that also start earlier."""

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by unit, its answers in order of shard before its blob."""
        told: list[tuple[int, bytes]] = []
        for batch in batches:
            for unit, shard, bits, blob in zip(*(batch.column(c).to_pylist() for c in ("unit", "shard", "bits", "blob")), strict=True):
                if blob is None:
                    told.append((shard, bits))
                    continue
                answers, told = told, []
                yield from _taken(unit, Unit(blob, size), answers)

    def _taken(unit: int, got: Unit, answers: list[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
        places = sketch.place(got.hashes)
        different = np.unique(places)
        cuts = sketch.cuts(different)
        again = [different[cuts[s] : cuts[s + 1]][unpack_bits(bits, cuts[s + 1] - cuts[s])] for s, bits in answers]
        again = np.concatenate(again) if again else different[:0]
        if not len(again):
            return
        maybe = again[np.minimum(np.searchsorted(again, places), len(again) - 1)] == places
        at, row, k1 = got.starts[maybe], got.row[maybe], got.hashes[maybe]
        k2 = windows(got.words.hashes, size, _SALT)[at]
        doc, start = got.ids[row], at - got.words.bounds[row]
        first = _heads(doc, start, k1, k2)
        rows = [(1, unit, unit, pack_deltas(at[~first]))] if not first.all() else []
        part = (k2 % np.uint64(groups)).astype(np.int64)
        some = np.flatnonzero(first)
        some = some[np.argsort(part[some], kind="stable")]
        heads = np.flatnonzero(np.diff(part[some], prepend=-1))
        for a, b in zip(heads.tolist(), [*heads[1:].tolist(), len(some)], strict=True):
            pick = some[a:b]
            rows.append((0, int(part[pick[0]]), unit, pack_deltas(at[pick]), zstandard.compress(doc[pick].tobytes(), 1), zstandard.compress((at - start)[pick].astype(np.int32).tobytes(), 1), k1[pick].tobytes(), k2[pick].tobytes()))
        for a in range(0, len(rows), 256):
            yield _met(rows[a : a + 256])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by kind and part; one group of digests is held at a time."""
        group, held = None, []

        def done() -> Iterator[pa.RecordBatch]:
            names = np.repeat([h[0] for h in held], [len(h[1]) for h in held])
            at, doc, start, k1, k2 = (np.concatenate(x) for x in list(zip(*held, strict=True))[1:])
            later = ~_heads(doc, start, k1, k2)
            names, at = names[later], at[later]
            heads = np.flatnonzero(np.concatenate([[True], names[1:] != names[:-1]])) if len(names) else []
            rows = [(1, int(names[a]), int(names[a]), pack_deltas(at[a:b])) for a, b in zip(heads, [*heads[1:], len(names)], strict=True)] if len(names) else []
            for a in range(0, len(rows), 256):
                yield _met(rows[a : a + 256])

        for batch in batches:
            passed = []
            for kind, part, unit, at, doc, base, k1, k2 in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if kind:
                    passed.append((kind, part, unit, at))
                    continue
                if part != group and held:
                    yield from done()
                    held = []
                group = part
                at = unpack_deltas(at)
                held.append((unit, at, np.frombuffer(zstandard.decompress(doc), np.int64), at - np.frombuffer(zstandard.decompress(base), np.int32), np.frombuffer(k1, np.uint64), np.frombuffer(k2, np.uint64)))
            if passed:
                yield _met(passed)
        if held:
            yield from done()

    taken = _beside(bundled, answers, ["shard", "bits"], "shard").mapInArrow(take, _MET)
    return taken.repartition("kind", "part").sortWithinPartitions("kind", "part").mapInArrow(meet, _MET).select("unit", "at")


def _beside(bundled: DataFrame, others: DataFrame, columns: list[str], *order: str) -> DataFrame:
    """The rows of others that belong to a unit, then the unit's own, unit by unit."""
    none = [F.lit(None).cast(others.schema[c].dataType).alias(c) for c in columns]
    rows = others.select("unit", F.lit(0).alias("kind"), *columns, F.lit(None).cast("binary").alias("blob"))
    met = rows.unionByName(bundled.select("unit", F.lit(1).alias("kind"), *none, "blob"))
    return met.repartition("unit").sortWithinPartitions("unit", "kind", *order)


def covered(words: Words, marks: np.ndarray, size: int) -> np.ndarray:
    """Words that lie in a run of size words from one of the marks."""
    n = len(words) + 1
    return np.cumsum(np.bincount(marks, minlength=n) - np.bincount(marks + size, minlength=n))[:-1] > 0


def original(words: Words, keep: np.ndarray) -> list[bytes]:
    """Texts that lose nothing stay as they are; elsewhere a lost word goes with the blanks before it."""
    gone = np.flatnonzero(~keep)
    first = np.zeros(len(words) + 1, bool)
    first[words.bounds] = True
    text = np.searchsorted(words.bounds, gone, "right") - 1
    before = np.where(first[gone], words.offsets[text], words.ends[gone - 1])
    n = len(words.data) + 1
    stay = np.cumsum(np.bincount(before, minlength=n) - np.bincount(words.ends[gone], minlength=n))[:-1] == 0
    edges = np.concatenate([[0], np.cumsum(stay)])[words.offsets]
    raw = words.data[stay].tobytes()
    return [raw[a:b] for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]


def dedup_substrings(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SIZE, max_bits: int = MAX_BITS, layout: str = "joined", carry: bool = False) -> DataFrame:
    """key, text (what is kept), n_words, n_removed; with carry also the other columns, as the struct `carried`.

    layout "joined": kept words joined by one space. "original": texts that lose
    nothing are unchanged and others keep their white space.
    """
    small_batches(docs.sparkSession)
    total = docs.select(F.sum(F.octet_length(text)).alias("n")).first()["n"] or 0
    sketch = Sketch(total, max_bits)
    others = [F.col(c) for c in docs.columns if c not in (key, text)] if carry else []
    carried = F.struct(*others) if others else F.struct(F.lit(None).cast("int").alias("none"))
    ids = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"), carried.alias("carried"))
    bundled = units(ids, min(8 * UNIT, max(UNIT, total >> 18)))
    marks = settled(bundled, sketched(bundled, size, sketch), size, sketch, max(64, total // GROUP))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by unit, the settled starts of a unit before its blob."""
        told: list[np.ndarray] = []
        for batch in batches:
            for at, blob in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if blob is None:
                    told.append(unpack_deltas(at))
                    continue
                unit = Unit(blob, size, hashes=False)
                words = unit.words
                keep = ~covered(words, np.concatenate(told) if told else np.zeros(0, np.int64), size)
                told = []
                sizes, kept = np.diff(words.bounds), np.diff(np.concatenate([[0], np.cumsum(keep)])[words.bounds])
                texts = joined(words, keep) if layout == "joined" else original(words, keep)
                yield pa.RecordBatch.from_arrays([unit.batch.column(0), pa.array(texts, pa.binary()).cast(pa.string()), pa.array(sizes), pa.array(sizes - kept), unit.batch.column(2)], names=[key, "text", "n_words", "n_removed", "carried"])

    kind, held = docs.schema[key].dataType.simpleString(), ids.schema["carried"].dataType.simpleString()
    out = _beside(bundled, marks, ["at"]).mapInArrow(cut, f"`{key}` long, text string, n_words long, n_removed long, carried {held}")
    out = out.withColumn(key, F.col(key).cast(kind))
    return out if carry else out.drop("carried")
