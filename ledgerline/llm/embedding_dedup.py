"""Embedding near-dedup by randomised-rotation binary codes (operator 4).

1. Once, each vector is rotated by a random orthogonal matrix and coded by the
   signs of its components; the code and its correction factor, <code, vector>,
   are stored beside the vector in the shared folder. <code, query> / factor
   estimates the inner product with a query without bias.
2. Vectors that are equal and have the same label form a class; one member
   stands for it. A label's classes are cut into blocks. A task holds the
   vectors of one block and the codes, an eighth of a byte a component, of those
   blocks that it must meet; every two blocks meet in one task. It links what lies
   within its block and tells which other vectors' codes come near: with cosine c the estimate's standard error is
   spread * sqrt(1 - c * c), so an estimate more than `errors` of these below
   the least cosine can't belong to a link.
3. Only these vectors are sent to the block. There the codes decide again, pair
   by pair, what is recomputed exactly, in double precision; only these pairs can
   be links. Tasks return link counts and spanning trees, never pairs.

No pair of blocks is left out: work within a label is quadratic in its classes,
at one multiplication of a sign a component, and so are the codes sent, by a
factor of 1 / (2 * block) of dim / 8 + 60 bytes. The chance that a link is missed is that of a
normal variable over `errors` standard errors, under 3e-7.

Null or zero vectors, those with null or non-finite components, and rows with a
null label have no links; they are kept. Vectors of different dimension are not
compared. Rows with a null key have no component and are kept. Rows that repeat
a key are compared each on its own; their links add up. Other columns are not
read. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.graph import components
from ledgerline.llm.shared import checkpointed, small_batches

LEAST = 0.93
ERRORS = 5.0
BLOCK = 8192
COMPONENTS = 1 << 22  # of a block, at most
BROADCAST_ROWS = 200_000  # of a block and a digest: some 20 MB
SEED = 20240517
_TILE = 1 << 22  # pairs that are estimated at once
_ROTATIONS: dict[int, np.ndarray] = {}


def rotation(dim: int) -> np.ndarray:
    """The same random orthogonal matrix everywhere."""
    if dim not in _ROTATIONS:
        q, r = np.linalg.qr(np.random.default_rng(SEED + dim).normal(size=(dim, dim)))
        _ROTATIONS[dim] = q * np.sign(np.diag(r))
    return _ROTATIONS[dim]


class Codes:
    """Codes of unit vectors: sign bits and correction factors; made of vectors, also the rotated vectors, for use as queries."""

    def __init__(self, unit: np.ndarray):
        self.dim = unit.shape[1]
        self.turned = (unit @ rotation(self.dim)).astype(np.float32)
        self.bits = np.packbits(self.turned > 0, axis=1, bitorder="little")
        self.factor = np.abs(self.turned).sum(axis=1, dtype=np.float64) / math.sqrt(self.dim)

    @classmethod
    def stored(cls, dim: int, bits: np.ndarray, factor: np.ndarray) -> Codes:
        held = cls.__new__(cls)
        held.dim, held.bits, held.factor = dim, bits, factor
        return held

    def spread(self) -> np.ndarray:
        """The standard error of an estimate from each code with an orthogonal query."""
        factor = np.clip(self.factor, 1e-12, 1)
        return np.sqrt(1 - factor**2) / factor / math.sqrt(max(1, self.dim - 1))

    def estimates(self, other: Codes, errors: float = ERRORS) -> tuple[np.ndarray, np.ndarray]:
        """Unbiased inner products of own vectors (rows, as queries) with another's (columns), and the bound of their errors."""
        signs = np.unpackbits(other.bits, axis=1, count=self.dim, bitorder="little").astype(np.float32)
        signs = (2 * signs - 1) / (math.sqrt(self.dim) * np.clip(other.factor, 1e-12, 1)).astype(np.float32)[:, None]
        return self.turned @ signs.T, errors * other.spread()[None, :]

    def near(self, other: Codes, least: float, errors: float = ERRORS) -> np.ndarray:
        """Which pairs may have an inner product of least or more."""
        guess, bound = self.estimates(other, errors)
        return guess >= (least - bound * math.sqrt(max(0.0, 1 - least * least)) - 1e-5).astype(np.float32)


def linked(a: np.ndarray, own: Codes, b: np.ndarray, codes: Codes, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (of a row of a and one of b) with cosine of least or more, tile by tile, confirmed exactly. own, codes: of a and of b."""
    step = max(1, _TILE // max(1, len(b)))
    for at in range(0, len(a), step):
        part = Codes.stored(own.dim, own.bits[at : at + step], own.factor[at : at + step])
        part.turned = own.turned[at : at + step]
        maybe = part.near(codes, least)
        i, j = np.nonzero(maybe)
        if len(i) * 16 > maybe.size:  # dense: one product is cheaper than gathering
            good = (a[at : at + step] @ b.T)[i, j] >= least
        else:
            good = np.concatenate([np.einsum("ij,ij->i", a[at + i[k : k + 65536]], b[j[k : k + 65536]]) for k in range(0, max(1, len(i)), 65536)]) >= least
        yield i[good] + at, j[good]


def roots(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least member of each member's component, where label names an earlier one of the same component."""
    n = np.arange(len(label))
    i, j = np.concatenate([i, n[label != n]]), np.concatenate([j, label[label != n]])
    while len(i):
        before = label.copy()
        least = np.minimum(label[i], label[j])
        np.minimum.at(label, i, least)
        np.minimum.at(label, j, least)
        label = label[label]
        if np.array_equal(before, label):
            break
    return label


def unit_rows(raw: list[bytes], width: int, dim: int) -> np.ndarray:
    """Vectors of components of `width` bytes as unit vectors in double precision."""
    x = np.frombuffer(b"".join(raw), f"<f{width}").reshape(-1, dim).astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def prepared(vectors: DataFrame, key: str, vector: str, label: str, width: int) -> DataFrame:
    """id, label, dim, d1, d2 (digest), raw (components), code, factor; the last five are null for vectors that link with nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, named = batch.column(2), batch.column(1).is_valid().to_numpy(zero_copy_only=False)
            dims = rows.value_lengths().fill_null(0).to_numpy()
            ends = dims.cumsum()
            flat = rows.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
            usable = named & rows.is_valid().to_numpy(zero_copy_only=False) & (dims > 0)
            told: list[tuple] = [(None,) * 5] * batch.num_rows
            for dim in np.unique(dims[usable]).tolist():
                mine = np.flatnonzero(usable & (dims == dim))
                x = flat[(ends[mine] - dim)[:, None] + np.arange(dim)]
                good = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
                mine, x = mine[good], x[good].astype(f"<f{width}") + 0.0  # no negative zero, which would part equal vectors
                if not len(mine):
                    continue
                parts = [r.tobytes() for r in x]
                codes = Codes(unit_rows(parts, width, dim))
                for m, raw, bits, factor in zip(mine.tolist(), parts, codes.bits, codes.factor.tolist(), strict=True):
                    told[m] = (*np.frombuffer(hashlib.blake2b(raw, digest_size=16).digest(), np.int64).tolist(), raw, bits.tobytes(), factor)
            kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(dims.astype(np.int32)), *(pa.array([t[k] for t in told], kind) for k, kind in enumerate(kinds))], names=["id", "label", "dim", "d1", "d2", "raw", "code", "factor"])

    chosen = vectors.select(F.col(key).cast("long").alias("id"), F.col(label).cast("string").alias("label"), F.col(vector).alias("vector"))
    return chosen.mapInArrow(run, "id long, label string, dim int, d1 long, d2 long, raw binary, code binary, factor double")


class Block:
    """The vectors of one block, read off the rows of kind 0 that lead its group."""

    def __init__(self, rows: pa.Table, width: int):
        self.dim, self.group = rows.column("dim")[0].as_py(), rows.column("group")[0].as_py()
        self.rows = rows.select(["id", "d1", "d2", "copies"])
        self.unit = unit_rows(rows.column("raw").to_pylist(), width, self.dim)
        self.codes = Codes(self.unit)


def _codes(rows: pa.RecordBatch, dim: int) -> Codes:
    bits = np.frombuffer(b"".join(rows.column("code").to_pylist()), np.uint8).reshape(rows.num_rows, -1)
    return Codes.stored(dim, bits, rows.column("factor").to_numpy())


def _by_block(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[Block, pa.RecordBatch | None, bool]]:
    """Each block with the batches of kind 1 that follow it, one by one, then None. Input is sorted by group, block and kind."""
    key, held, block = None, [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = list(zip(batch.column("group").to_pylist(), batch.column("i").to_pylist(), batch.column("kind").to_pylist(), strict=True))
        heads = [0, *(n for n in range(1, len(keys)) if keys[n] != keys[n - 1]), len(keys)]
        for a, b in zip(heads[:-1], heads[1:], strict=True):
            group, i, kind = keys[a]
            if (group, i) != key:
                if held or block is not None:
                    yield block or Block(pa.Table.from_batches(held), width), None
                key, held, block = (group, i), [], None
            if kind == 0:
                held.append(batch.slice(a, b - a))
                continue
            if block is None and not held:
                continue  # no vector has fallen on this block
            if block is None:
                block, held = Block(pa.Table.from_batches(held), width), []
            yield block, batch.slice(a, b - a)
    if held or block is not None:
        yield block or Block(pa.Table.from_batches(held), width), None


_FOUND = "group string, i int, d1 long, d2 long, id long, links long, root long"


def _found(group: str, i: int | None, d1: np.ndarray, d2: np.ndarray, ids: np.ndarray, links: np.ndarray | None = None, root: np.ndarray | None = None) -> pa.RecordBatch:
    """Rows of _FOUND: linked members (i null), or members that block i wants (links and root null)."""
    n = len(ids)
    rest = [pa.nulls(n, pa.int64()) if x is None else pa.array(x) for x in (links, root)]
    return pa.RecordBatch.from_arrays([pa.array([group] * n, pa.string()), pa.array([i] * n, pa.int32()), pa.array(d1), pa.array(d2), pa.array(ids), *rest], names=["group", "i", "d1", "d2", "id", "links", "root"])


def near_duplicates(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", least: float = LEAST, block: int = BLOCK) -> DataFrame:
    """key, n_links, component_id, kept."""
    small_batches(vectors.sparkSession)
    width = 4 if vectors.schema[vector].dataType.elementType.simpleString() == "float" else 8
    made = checkpointed(prepared(vectors, key, vector, label, width))
    same = ["label", "dim", "d1", "d2"]
    usable = made.where("id is not null and d1 is not null")
    # the vectors stay where they are: a class is known by its digest, and its smallest key's row carries the vector
    first = usable.groupBy(*same).agg(F.min(F.struct("id", "raw", "code", "factor")).alias("m"), F.count("*").alias("copies"))
    classes = checkpointed(first.select(*same, F.col("m.id").alias("id"), "m.raw", "m.code", "m.factor", "copies"))
    group = F.concat_ws(":", F.col("dim").cast("string"), "label")
    most = F.greatest(F.lit(1), F.least(F.lit(block), (F.lit(COMPONENTS) / F.col("dim")).cast("int")))
    sizes = classes.groupBy("label", "dim").agg(F.count("*").alias("n")).where("n > 1")
    sizes = sizes.select("label", "dim", F.ceil(F.col("n") / most).cast("int").alias("k"))
    dealt = classes.join(sizes, ["label", "dim"]).withColumn("block", F.pmod(F.xxhash64("d1", "d2"), F.col("k")).cast("int"))
    columns = ["group", "i", "kind", "id", "dim", "d1", "d2", "copies", "raw", "code", "factor"]
    none = F.lit(None)
    own = dealt.select(group.alias("group"), F.col("block").alias("i"), F.lit(0).alias("kind"), "id", "dim", "d1", "d2", "copies", "raw", none.cast("binary").alias("code"), none.cast("double").alias("factor"))
    # block b is met by those `step` before it, round the circle; half way round, by the first half only
    stepped = dealt.where("k > 1").select("*", F.explode(F.sequence(F.lit(1), F.floor(F.col("k") / 2).cast("int"))).alias("step"))
    stepped = stepped.withColumn("i", F.pmod(F.col("block") - F.col("step"), F.col("k"))).where("2 * step < k or 2 * i < k")
    sent = stepped.select(group.alias("group"), "i", F.lit(1).alias("kind"), "id", "dim", "d1", "d2", "copies", none.cast("binary").alias("raw"), "code", "factor")

    def told(held: Block, met: list[pa.RecordBatch] | None) -> pa.RecordBatch:
        """Link counts, and each linked member's root, of the pairs within a block or, with met, of those between it and the met."""
        rows = pa.concat_tables([held.rows, *(pa.Table.from_batches([x]).select(held.rows.column_names) for x in met or [])])
        copies = rows.column("copies").to_numpy()
        counts, label_of = np.zeros(len(copies), np.int64), np.arange(len(copies))
        at = len(held.unit)
        for other in [None] if met is None else met:
            b, codes = (held.unit, held.codes) if other is None else (unit_rows(other.column("raw").to_pylist(), width, held.dim), _codes(other, held.dim))
            for i, j in linked(held.unit, held.codes, b, codes, least):
                if other is None:
                    i, j = i[i < j], j[i < j]
                else:
                    j = j + at
                counts += (np.bincount(i, copies[j], len(copies)) + np.bincount(j, copies[i], len(copies))).astype(np.int64)
                label_of = roots(label_of, i, j)
            at += 0 if other is None else other.num_rows
        some = np.flatnonzero(counts)
        ids = rows.column("id").to_numpy()
        return _found(held.group, None, rows.column("d1").to_numpy()[some], rows.column("d2").to_numpy()[some], ids[some], counts[some], ids[label_of[some]])

    def first_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Links within each block, and which vectors of others it wants."""
        last = None
        for held, other in _by_block(batches, width):
            if held is not last:
                yield told(held, None)
                last = held
            if other is None:
                continue
            codes = _codes(other, held.dim)
            close = np.zeros(other.num_rows, bool)
            step = max(1, _TILE // len(held.unit))
            for at in range(0, other.num_rows, step):
                close[at : at + step] = held.codes.near(Codes.stored(held.dim, codes.bits[at : at + step], codes.factor[at : at + step]), least).any(axis=0)
            want = other.filter(pa.array(close))
            yield _found(held.group, other.column("i")[0].as_py(), *(want.column(c).to_numpy() for c in ("d1", "d2", "id")))

    def second_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Links between each block and what it wanted."""
        last, met = None, []
        for held, other in _by_block(batches, width):
            if last is not None and held is not last:
                yield told(last, met)
                met = []
            last = held
            if other is not None:
                met.append(other)
        if last is not None:
            yield told(last, met)

    by_block = lambda rows: rows.select(*columns).repartition("group", "i").sortWithinPartitions("group", "i", "kind")
    passed = checkpointed(by_block(own.unionByName(sent)).mapInArrow(first_pass, _FOUND))
    wanted = passed.where("i is not null").select("group", "i", "d1", "d2")
    known = classes.select(group.alias("group"), "d1", "d2", "id", "dim", "copies", "raw", "code", "factor")
    told_, n = passed.where("i is null"), wanted.count()
    if n:
        fetched = known.join(F.broadcast(wanted) if n <= BROADCAST_ROWS else wanted, ["group", "d1", "d2"]).withColumn("kind", F.lit(1))
        # one row a block, so of some thousand vectors
        wanting = own.join(F.broadcast(wanted.select("group", "i").distinct()), ["group", "i"], "left_semi")
        across = checkpointed(by_block(wanting.unionByName(fetched.select(*columns))).mapInArrow(second_pass, _FOUND))
        told_ = told_.unionByName(across)
    counts = told_.groupBy("group", "d1", "d2", "id").agg(F.sum("links").alias("links"))
    labels = components(told_.select(F.col("root").alias("a"), F.col("id").alias("b"))).select(F.col("node").alias("id"), F.col("label").alias("component"))
    of_class = classes.select(*same, "id", "copies", group.alias("group")).join(counts, ["group", "d1", "d2", "id"], "left").drop("group").join(labels, "id", "left").withColumnRenamed("id", "rep")
    out = made.drop("raw", "code", "factor").join(of_class, same, "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "rep", "id"))
    kind = vectors.schema[key].dataType.simpleString()
    total = F.when(F.col("id").isNotNull(), F.coalesce(F.col("links"), F.lit(0)) + F.coalesce(F.col("copies"), F.lit(1)) - 1).otherwise(0).cast("long")
    result = out.select("id", total.alias("n_links"), component.alias("component_id"))
    return result.select(F.col("id").cast(kind).alias(key), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))
