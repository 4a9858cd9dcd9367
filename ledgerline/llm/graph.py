"""Connected components and blocked comparison of groups, without collecting either."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.shared import checkpointed


PAIRS = 1 << 20  # edges that a task contracts at once


def least_reachable(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the edges (a, b), ascending, and for each the smallest node reachable."""
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = flat[: len(a)], flat[len(a) :]
    label = np.arange(len(nodes))
    while len(x):
        # labels are roots here; each goes below its least neighbour
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label[label] != label).any():
            label = label[label]
        x, y = label[x], label[y]
        apart = x != y
        x, y = x[apart], y[apart]
    return nodes, nodes[label]


def trees(parts: Iterable[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """Edges (a, b) that connect the same nodes as the edges given: of what is held at once, each node with the smallest it reaches."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    n = 0

    def flush() -> pa.RecordBatch:
        nodes, label = least_reachable(*(np.concatenate(x) for x in zip(*held, strict=True)))
        away = nodes != label
        return pa.RecordBatch.from_arrays([pa.array(label[away]), pa.array(nodes[away])], names=["a", "b"])

    for part in parts:
        held.append(part)
        n += len(part[0])
        if n >= PAIRS:
            yield flush()
            held, n = [], 0
    if n:
        yield flush()


def settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node, label of edges (a, b) that are all held here."""
    held = [tuple(batch.column(c).to_numpy() for c in range(2)) for batch in batches]
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in least_reachable(*(np.concatenate(x) for x in zip(*held, strict=True)))], names=["node", "label"])


def contracted(edges: DataFrame) -> DataFrame:
    """Edges that connect the same nodes, contracted in each task."""
    return edges.mapInArrow(lambda batches: trees((batch.column(0).to_numpy(), batch.column(1).to_numpy()) for batch in batches), "a long, b long")


def components(edges: DataFrame, contract: bool = False) -> DataFrame:
    """node, label: the smallest node reachable, for nodes of edges (a, b).

    contract: tasks contract the edges first, once these are dealt out, and again in
    as few tasks as hold PAIRS edges each, as long as that leaves fewer. One task
    for all of them leaves nothing to do; else rounds carry fewer edges and long
    chains take few rounds. Each round takes the least label among neighbours and then the label's own
    label, so stars need two rounds and chains a logarithmic number. Every step
    is an aggregate with partial sums or an equi-join that AQE can split.
    """
    edges = edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    edges = checkpointed(contracted(edges) if contract else edges)
    n = edges.count() if contract else 0
    while contract:
        if n <= PAIRS:
            # dealt out again, or all that follows would start from one partition
            return checkpointed(edges.repartition(1).mapInArrow(settled, "node long, label long").repartition(int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")), "node"))
        edges = checkpointed(contracted(edges.repartition(-(-n // PAIRS))))
        before, n = n, edges.count()
        contract = n < 0.8 * before
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = checkpointed(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")))
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("near"))
        least = labels.join(near.withColumnRenamed("a", "node"), "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        roots = labels.select(F.col("node").alias("label"), F.col("label").alias("root"))
        jumped = checkpointed(least.join(roots, "label").select("node", "old", F.least("label", "root").alias("label")))
        labels = jumped.select("node", "label")
        if jumped.where("label <> old").isEmpty():
            return labels


def dealt(members: DataFrame, size: int, weight: Column | None = None, most: int = 0, copied: bool = True) -> DataFrame:
    """Rows (id, group) copied to the pairs of blocks (group, i, j) that must meet, with their own block and the number of blocks, k; (0, 0) in a group of one block.

    copied: else each row comes once, with its pairs as an array, met.

    A group has so many blocks by hash of the id that about `size` members, and
    members with a sum of weights of about `most`, fall on each.
    """
    blocks = F.ceil(F.count("*") / size)
    if weight is not None:
        blocks = F.greatest(blocks, F.ceil(F.sum(weight) / most))
    sizes = members.groupBy("group").agg(blocks.cast("int").alias("k"), F.count("*").alias("n_")).where("n_ > 1").select("group", "k")
    held = members.join(sizes, "group").withColumn("block", F.pmod(F.xxhash64("id"), F.col("k")).cast("int"))
    others = F.filter(F.sequence(F.lit(0), F.col("k") - 1), lambda x: (F.col("k") == 1) | (x != F.col("block")))
    met = held.withColumn("met", F.transform(others, lambda x: F.struct(F.least("block", x).alias("i"), F.greatest("block", x).alias("j"))))
    return met.select("*", F.inline("met")).drop("met") if copied else met


def by_group(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """The rows of each run of equal leading key columns; input is sorted by them."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(k).to_numpy() for k in range(keys)]
        change = np.zeros(batch.num_rows, bool)
        change[0] = True
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        heads = np.flatnonzero(change)
        for a, b in zip(heads.tolist(), [*heads[1:].tolist(), batch.num_rows], strict=True):
            key = tuple(c[a] for c in cols)
            if key != last and held:
                yield pa.Table.from_batches(held)
                held = []
            last = key
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def forest(n: int, alike: Callable[[int, np.ndarray], np.ndarray]) -> np.ndarray:
    """The root (first member) of each of n members in the graph where alike(i, others) tells which others are linked to i.

    A member is compared only with those that no tree holds yet.
    """
    root = np.arange(n)
    left = np.arange(n)
    while len(left):
        first, left = int(left[0]), left[1:]
        stack = [first]
        while stack and len(left):
            hit = alike(stack.pop(), left)
            found = left[hit]
            root[found] = first
            stack += found.tolist()
            left = left[~hit]
    return root


def joined(root: np.ndarray, side: np.ndarray, alike: Callable[[int, np.ndarray], np.ndarray]) -> np.ndarray:
    """As forest, where the trees within each side are known by their roots and links across sides are sought.

    A member is compared only with those of the other side that its tree doesn't hold yet.
    """
    out = root.copy()
    left = np.arange(len(root))
    while len(left):
        first = int(left[0])  # the root of its tree
        own = root[left] == first
        stack, left = left[own].tolist(), left[~own]
        while stack and len(left):
            m = stack.pop()
            others = left[side[left] != side[m]]
            hit = np.isin(root[left], root[others[alike(m, others)]])
            out[left[hit]] = first
            stack += left[hit].tolist()
            left = left[~hit]
    return out
