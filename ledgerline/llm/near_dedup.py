"""Near-duplicate documents by b-bit MinHash (operator 5).

1. One pass gives each document's shingle set a size, a 128-bit digest, minima
   under bands * rows hash functions, the keys of its bands, and a signature of
   the low b bits of the minima, packed.
2. Documents with equal sets form a class; its smallest key stands for it.
   Tasks forward one document of each set and flush, so copies don't pile up.
3. Documents with equal band keys meet at the smallest key of their bucket: a
   star, never all pairs. Tasks contract what meets in them to an edge a
   document. Components of the stars are the candidate groups.
4. Within a group, blocks of signatures are compared by bit counts; the
   collision-corrected similarity, less five standard errors, splits groups.
5. Within what is left, full shingle sets are compared and links confirmed by
   integer arithmetic. Tasks return spanning trees, not pairs, and of two blocks
   only what joins the trees of either.

Groups larger than a block are dealt as pairs of blocks, so no task holds more
than two blocks, and no pair of a group is left out. At similarity 0.8 the
chance that a pair shares no band is under 1e-6 with the default 50 bands of 6.

Null or blank text: empty set, linked with nothing, kept. Rows with a null key
take no part: component_id is null and they are kept. Rows that repeat a key
are one document that has the links of each. Other columns are not read. An
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.graph import by_group, components, dealt, forest, joined, least_reachable, trees
from ledgerline.llm.shared import checkpointed, collect_garbage, small_batches
from ledgerline.llm.text import Words, column, mix64, slices, text_buffers, windows

SHINGLE = 5
PERCENT = 80
BANDS, ROWS = 50, 6
BITS = 4
BLOCK = 1024
FLUSH_ROWS = 20_000
Alike = Callable[[int, np.ndarray], np.ndarray]  # which others a member is linked to
BUCKET = 16 << 20  # bytes of keys that meet at once
SHINGLES = 1 << 21  # of a block whose sets are compared


def shingles(words: Words, i: int, size: int) -> np.ndarray:
    """The distinct shingles of text i, ascending; with fewer words than size, all words as one."""
    h = words.hashes[words.bounds[i] : words.bounds[i + 1]]
    if not len(h):
        return h
    got = np.sort(windows(h, min(size, len(h)), 1 + min(size, len(h))))
    return got[np.concatenate([[True], got[1:] != got[:-1]])]


def factors(n: int) -> np.ndarray:
    return mix64(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def minima(found: np.ndarray, by: np.ndarray, step: int = 2048) -> np.ndarray:
    """The least product of the set's elements with each factor; the set is not empty."""
    out = np.full(len(by), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(found), step):
        np.minimum(out, (by[:, None] * found[None, at : at + step]).min(axis=1), out=out)
    return out


def packed(low: np.ndarray, bits: int) -> np.ndarray:
    """Fields of so many bits (1, 2, 4 or 8), packed into 64-bit words row by row."""
    per = 64 // bits
    n = -(-low.shape[1] // per) * per
    full = np.zeros((len(low), n), np.uint64)
    full[:, : low.shape[1]] = low
    return (full.reshape(len(low), -1, per) << (np.arange(per, dtype=np.uint64) * np.uint64(bits))).sum(axis=2, dtype=np.uint64)


def differing(x: np.ndarray, bits: int) -> np.ndarray:
    """How many fields of a row of XORed words are not zero."""
    step = 1
    while step < bits:
        x = x | (x >> np.uint64(step))
        step *= 2
    ones = np.uint64(sum(1 << k for k in range(0, 64, bits)))
    return np.bitwise_count(x & ones).sum(axis=1, dtype=np.int64)


def least_matches(fields: int, bits: int, percent: int, errors: float = 5.0) -> int:
    """Fields that must agree so that the corrected estimate is not over `errors` standard errors below the threshold."""
    chance, least = 2.0**-bits, percent / 100
    agree = chance + (1 - chance) * least
    return math.floor(fields * (agree - errors * math.sqrt(agree * (1 - agree) / fields)))


def sketches(docs: DataFrame, key: str, text: str, size: int, bands: int, rows: int, bits: int) -> DataFrame:
    """id, n, d1, d2 (digest, null for an empty set), keys (bands * 8 bytes), signature."""
    by = factors(bands * rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            words = Words(*text_buffers(column(batch, text)), lower=True)
            sizes, digests, least = [], [], np.zeros((batch.num_rows, len(by)), np.uint64)
            for i in range(batch.num_rows):
                found = shingles(words, i, size)
                sizes.append(len(found))
                digests.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest() if len(found) else None)
                if len(found):
                    least[i] = minima(found, by)
            fold = np.zeros((batch.num_rows, bands), np.uint64)
            for r in range(rows):
                fold = mix64(fold * np.uint64(0xD6E8FEB86659FD93) + least[:, r::rows])
            fold = mix64(fold + np.arange(1, bands + 1, dtype=np.uint64))
            fields = packed((least >> np.uint64(24)) & np.uint64((1 << bits) - 1), bits)
            halves = [np.frombuffer(d, np.int64).tolist() if d else [None, None] for d in digests]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array(sizes, pa.int64()), pa.array([h[0] for h in halves], pa.int64()), pa.array([h[1] for h in halves], pa.int64()),
                pa.array([f.tobytes() for f in fold], pa.binary()), pa.array([f.tobytes() for f in fields], pa.binary()),
            ], names=["id", "n", "d1", "d2", "keys", "signature"])

    return docs.select(F.col(key).cast("long").alias("id"), text).mapInArrow(run, "id long, n long, d1 long, d2 long, keys binary, signature binary")


def stars(made: DataFrame, buckets: int) -> DataFrame:
    """Edges (a, b) that connect all documents that share a band's key.

    Documents that meet in a flush are contracted at once: each gets one edge, to the smallest of
    those it is connected with there, which stands for all of them in the buckets.
    """

    def first_of(keys: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        order = np.lexsort((ids, keys))
        k, d = keys[order], ids[order]
        heads = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
        return k, d, np.repeat(heads, np.diff(np.append(heads, len(k))))

    schema = pa.schema([("bucket", pa.int32()), ("keys", pa.binary()), ("ids", pa.binary()), ("a", pa.int64()), ("b", pa.int64())])

    def told(pair: np.ndarray) -> pa.RecordBatch:
        n = len(pair)
        return pa.RecordBatch.from_arrays([pa.nulls(n, pa.int32()).fill_null(-1), pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary()), pa.array(pair[:, 0]), pa.array(pair[:, 1])], schema=schema)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush() -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(held)
            ids, d1, d2 = (table.column(c).to_numpy() for c in ("id", "d1", "d2"))
            keys = np.frombuffer(b"".join(table.column("keys").to_pylist()), np.uint64).reshape(len(ids), -1)
            # one document of each set: the smallest key
            order = np.lexsort((ids, d2, d1))
            new = np.ones(len(order), bool)
            new[1:] = (d1[order][1:] != d1[order][:-1]) | (d2[order][1:] != d2[order][:-1])
            pick = order[new]
            k, d, head = first_of(keys[pick].ravel(), np.repeat(ids[pick], keys.shape[1]))
            nodes, label = least_reachable(d[head], d)
            pair = np.stack([label, nodes], axis=1)[nodes != label]
            if len(pair):
                yield told(pair)
            top = head == np.arange(len(head))
            k, d = k[top], label[np.searchsorted(nodes, d[top])]
            bucket = (k % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            k, d, bucket = k[order], d[order], bucket[order]
            at = np.searchsorted(bucket, np.arange(buckets + 1))
            full = [b for b in range(buckets) if at[b + 1] > at[b]]
            yield pa.RecordBatch.from_arrays([
                pa.array(full, pa.int32()), pa.array([k[at[b] : at[b + 1]].tobytes() for b in full], pa.binary()), pa.array([d[at[b] : at[b + 1]].tobytes() for b in full], pa.binary()),
                pa.nulls(len(full), pa.int64()), pa.nulls(len(full), pa.int64()),
            ], schema=schema)

        n = 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= FLUSH_ROWS:
                yield from flush()
                held, n = [], 0
        if n:
            yield from flush()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passed: list[tuple[np.ndarray, np.ndarray]] = []  # edges; they lead, and go on batch by batch

        def buckets_of() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                n = int(np.searchsorted(batch.column(0).to_numpy(), 0))
                if n:
                    passed.append(tuple(batch.slice(0, n).column(c).to_numpy() for c in ("a", "b")))
                yield batch.slice(n)

        def edges() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            for group in by_group(buckets_of(), 1):
                yield from passed
                passed.clear()
                keys = np.frombuffer(b"".join(group.column("keys").to_pylist()), np.uint64)
                _, d, head = first_of(keys, np.frombuffer(b"".join(group.column("ids").to_pylist()), np.int64))
                away = d != d[head]
                yield d[head][away], d[away]
            yield from passed

        return trees(edges())

    full = made.where("id is not null and d1 is not null").select("id", "d1", "d2", "keys")
    sent = full.mapInArrow(spread, "bucket int, keys binary, ids binary, a long, b long")
    # edges found within a flush pass through, spread by their ends
    dealt_ = sent.repartition("bucket", "a").sortWithinPartitions("bucket")
    return dealt_.mapInArrow(meet, "a long, b long")


def _trees(met: DataFrame, compare: Callable[[pa.Table], Alike]) -> DataFrame:
    """Edges (a, b) that connect all linked documents; compare(table) tells which are linked, as in forest. met: group, i, j, id, block, k, ...

    Each task finds the trees within its two blocks and then the links that join them. The trees' own
    edges come from one of a block's tasks only, that with the next block, and else an edge for each
    two trees that were apart. So a large group gives an edge a document and few for each pair of blocks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in by_group(batches, 3):
            ids = group.column("id").to_numpy()
            order = np.argsort(ids, kind="stable")
            group, ids = group.take(pa.array(order)), ids[order]
            i, j, block, k = (group.column(c).to_numpy() for c in ("i", "j", "block", "k"))
            told = (i == j) | (block == i) & (j == (i + 1) % k) | (block == j) & (i == (j + 1) % k)
            alike = compare(group)

            def inside(m: int, others: np.ndarray, block=block, alike=alike) -> np.ndarray:
                out = block[others] == block[m]
                out[out] = alike(m, others[out])
                return out

            within = forest(group.num_rows, inside)
            root = joined(within, block, alike) if i[0] != j[0] else within
            # a member to its tree in the block, a tree to the first it is joined with
            to = np.where(within == np.arange(len(ids)), root, within)
            away = (to != np.arange(len(ids))) & (told | (within == np.arange(len(ids))))
            if away.any():
                yield pa.RecordBatch.from_arrays([pa.array(ids[to][away]), pa.array(ids[away])], names=["a", "b"])

    return met.repartition("group", "i", "j").sortWithinPartitions("group", "i", "j").mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SHINGLE, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS, bits: int = BITS, block: int = BLOCK) -> DataFrame:
    """key, n_shingles, component_id (smallest key reachable by links), kept (key = component_id)."""
    small_batches(docs.sparkSession)
    made = checkpointed(sketches(docs, key, text, size, bands, rows, bits))
    # a key takes 16 bytes with its document's
    buckets = max(64, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 16 * bands * made.count() // BUCKET)
    fields = bands * rows
    matches = least_matches(fields, bits, percent)

    def estimate(group: pa.Table) -> Alike:
        words = np.frombuffer(b"".join(group.column("signature").to_pylist()), np.uint64).reshape(group.num_rows, -1)
        n = group.column("n").to_numpy()

        def alike(i: int, others: np.ndarray) -> np.ndarray:
            sizes = n[others]
            near = 100 * np.minimum(sizes, n[i]) >= percent * np.maximum(sizes, n[i])
            near[near] = fields - differing(words[others[near]] ^ words[i], bits) >= matches
            return near

        return alike

    def exact(group: pa.Table) -> Alike:
        sets = [np.frombuffer(x, np.uint64) for x in group.column("found").to_pylist()]
        n = np.array([len(s) for s in sets])
        words = np.frombuffer(b"".join(group.column("signature").to_pylist()), np.uint64).reshape(group.num_rows, -1)
        _, flat = np.unique(np.concatenate(sets), return_inverse=True)
        ends = np.cumsum(n)
        mark = np.zeros(int(flat.max()) + 1, bool)

        def alike(i: int, others: np.ndarray) -> np.ndarray:
            near = 100 * np.minimum(n[others], n[i]) >= percent * np.maximum(n[others], n[i])
            near[near] = fields - differing(words[others[near]] ^ words[i], bits) >= matches
            some = others[near]
            if len(some):
                own = flat[ends[i] - n[i] : ends[i]]
                mark[own] = True
                lens = n[some]
                to = np.cumsum(lens)
                spots = np.arange(int(to[-1])) + np.repeat(ends[some] - lens - (to - lens), lens)
                shared = np.add.reduceat(mark[flat[spots]].astype(np.int64), to - lens)
                mark[own] = False
                near[near] = 100 * shared >= percent * (n[i] + lens - shared)
            return near

        return alike

    def linked(edges: DataFrame) -> DataFrame:
        found = components(edges, contract=True)
        collect_garbage(docs.sparkSession)
        return found

    sig = made.where("d1 is not null").select("id", "n", "signature")
    coarse = linked(stars(made, buckets)).select(F.col("node").alias("id"), F.col("label").alias("group"))
    close = linked(_trees(dealt(coarse, block).join(sig, "id").select("group", "i", "j", "block", "k", "id", "n", "signature"), estimate)).select(F.col("node").alias("id"), F.col("label").alias("group"))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            words = Words(*text_buffers(column(batch, "text")), lower=True)
            found = [shingles(words, i, size).tobytes() for i in range(batch.num_rows)]
            # each document's set is made once and copied to its pairs of blocks
            met = batch.column(batch.schema.get_field_index("met"))
            where = met.value_lengths().to_numpy()
            row = np.repeat(np.arange(batch.num_rows), where)
            flat = met.flatten()
            take = pa.array(row)
            for at in range(0, len(row), 256):
                part = take.slice(at, 256)
                ij = flat.slice(at, 256)
                yield pa.RecordBatch.from_arrays([
                    batch.column(1).take(part), ij.field(0), ij.field(1), batch.column(0).take(part),
                    batch.column(5).take(part), batch.column(6).take(part), batch.column(3).take(part), pa.array([found[r] for r in row[at : at + 256]], pa.binary()),
                ], names=["group", "i", "j", "id", "block", "k", "signature", "found"])

    near = dealt(close.join(sig.select("id", "n"), "id"), block, F.col("n"), SHINGLES, copied=False).drop("n").join(sig.select("id", "signature"), "id")
    texts = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")).where("id is not null")
    full = near.join(texts, "id").select("id", "group", "met", "signature", "text", "block", "k")
    confirmed = linked(_trees(full.mapInArrow(sets, "group long, i int, j int, id long, block int, k int, signature binary, found binary"), exact))

    # written out, or the join would share the aggregate's partitions, which Spark can't split for a large class
    least = checkpointed(made.where("id is not null and d1 is not null").groupBy("d1", "d2").agg(F.min("id").alias("rep")))
    labelled = made.select("id", "n", "d1", "d2").join(least, ["d1", "d2"], "left").join(confirmed.withColumnRenamed("node", "rep"), "rep", "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("label", "rep", "id"))
    out = labelled.select("id", F.col("n").alias("n_shingles"), component.alias("component_id"))
    kind = docs.schema[key].dataType.simpleString()
    return out.select(F.col("id").cast(kind).alias(key), "n_shingles", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))
