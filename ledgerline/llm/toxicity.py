"""Toxicity by nearest labelled examples under exact TF-IDF cosine (operator 9).

Examples are a sample of labelled documents in order of a hash of the key,
bounded by their number and by the bytes of their terms; of near copies (equal
label, Jaccard similarity of the terms 0.8 or more) the first stays. Terms are runs of letters and digits, A-Z
lower-cased, and their first 5 to 8 bytes; the vocabulary holds those whose
document frequencies differ between the classes by a likelihood ratio of
least_ratio or more, since on long documents plain TF-IDF cosine is ruled by
rare words that say nothing about the label. The weights' document
frequencies are counted over all documents, whatever their label or fold; a
null text is a document without terms. An inverted index lists
examples by term in blocks, with the largest weight of each term in each block.
A query's bound for a block is the cosine it could reach there; blocks are
opened in order of the bound until none can change the k nearest. Votes are
weighted by similarity, beside a prior vote, and a logistic curve fitted to
the examples' own leave-one-out votes turns them into calibrated scores.

Null or empty text and texts without a known term have the prior's score. With
no usable labels, or of one class only, the score is that class's share of the
sample (0 without any). Rows with a null key or label are never examples; of
repeated labels of a key the largest counts. Every row is scored, also repeated
ones. Other columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.shared import checkpointed, collect_garbage, small_batches
from ledgerline.llm.text import NOT_TERM, Words, column, release, slices, text_buffers

EXAMPLES = 6000
MAX_BYTES = 64 << 20  # of the examples' terms that the driver gets; it holds half of it
PART = 4 << 20  # of these bytes that it gets at once
TERMS = 4096
LEAST_RATIO = 16.0  # chi-squared with one degree of freedom, p under 1e-4
HEADS = (5, 6, 7, 8)
NEAREST = 16
BLOCK = 64
PRIOR_VOTE = 2.0
NEAR_COPY = 80  # percent of the terms of either that near copies share
QUERIES = 512  # of the examples that are looked up at once
REST = 2.0  # squared weight of a word that is outside the vocabulary


def fold(key: Column, n: int) -> Column:
    """crc32 of the key as text, modulo n."""
    return F.crc32(key.cast("string").cast("binary")) % n


def terms(batch: pa.RecordBatch, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row and hash of each occurrence of a term; how many words each text has."""
    words = Words(*text_buffers(column(batch, text)), lower=True, blank=NOT_TERM, heads=HEADS)
    sizes = np.diff(words.bounds)
    row = np.repeat(np.arange(batch.num_rows), sizes)
    return np.concatenate([row, row[words.owners]]), np.concatenate([words.hashes, words.heads]), sizes


def counts_of(row: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, hash and count of each different term of each row, in order of both."""
    order = np.lexsort((hashes, row))
    r, h = row[order], hashes[order]
    heads = np.flatnonzero(np.concatenate([[True], (r[1:] != r[:-1]) | (h[1:] != h[:-1])])) if len(r) else np.zeros(0, np.int64)
    return r[heads], h[heads], np.diff(np.append(heads, len(r)))


def ranked(term_sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The different terms by rarity, and how many sets hold each. Each set gives way to its terms' places there, ascending, so that none is held twice."""
    part = np.cumsum([x.nbytes for x in term_sets], dtype=np.int64) // PART
    edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(term_sets)]
    names = np.zeros(0, np.uint64)
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        names = np.union1d(names, np.concatenate([names[:0], *term_sets[a:b]]))
    times = np.zeros(len(names), np.int32)
    for i, found in enumerate(term_sets):
        term_sets[i] = np.searchsorted(names, found).astype(np.int32)
        times[term_sets[i]] += 1
    order = np.argsort(times, kind="stable")
    rank = np.empty(len(names), np.int32)
    rank[order] = np.arange(len(names), dtype=np.int32)
    for i, found in enumerate(term_sets):
        term_sets[i] = np.sort(rank[found])
    return names[order], times[order]


def distinct_examples(term_sets: list[np.ndarray], labels: list[int], percent: int = NEAR_COPY) -> list[int]:
    """All but near copies, which would count as evidence over again: those whose term sets, in order, reach a Jaccard similarity of percent with an earlier kept example of equal label.

    Exact: with terms in order of rarity, sets that similar share one of the first size - ceil(percent * size) + 1 terms of each.
    """
    ordered = list(term_sets)
    return _distinct(ordered, ranked(ordered)[1], labels, percent)


def _distinct(ordered: list[np.ndarray], times: np.ndarray, labels: list[int], percent: int = NEAR_COPY) -> list[int]:
    """As distinct_examples, of sets in order of rarity."""
    if not len(times):
        return list(range(len(ordered)))
    single = int((times == 1).sum())  # ranks below: terms that no other example has
    leads = [o[: len(o) - -(-percent * len(o) // 100) + 1] for o in ordered]
    leads = [x[x >= single] for x in leads]
    owner = np.repeat(np.arange(len(leads), dtype=np.int32), [len(x) for x in leads])
    key = np.concatenate(leads).astype(np.int64) * 2 + np.array([bool(x) for x in labels], np.int64)[owner]
    # earlier examples of equal label with a term stand before it, between the key's start and its own place
    order = np.argsort(key, kind="stable")  # owners ascend
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    start = np.searchsorted(key[order], key)
    holders, ends = owner[order], np.cumsum([len(x) for x in leads])
    del owner, key, order
    keep = np.ones(len(leads), bool)
    for i, to in enumerate(ends.tolist()):
        at = slice(to - len(leads[i]), to)
        near = np.unique(np.concatenate([holders[a:b] for a, b in zip(start[at].tolist(), place[at].tolist(), strict=True) if a < b] or [holders[:0]]))
        keep[i] = not any(_similar(ordered[i], ordered[j], percent) for j in near[keep[near]].tolist())
    return np.flatnonzero(keep).tolist()


def _similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether sorted sets have a Jaccard similarity of percent or more."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    spot = np.minimum(np.searchsorted(b, a), len(b) - 1)
    both = int((b[spot] == a).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def likelihood_ratio(a: np.ndarray, b: np.ndarray, n: int, m: int) -> np.ndarray:
    """G-squared of frequencies a of n against b of m documents."""
    total, share = n + m, (a + b) / (n + m)

    def part(seen: np.ndarray, expected: np.ndarray) -> np.ndarray:
        return np.where(seen > 0, seen * np.log(np.maximum(seen, 1e-12) / np.maximum(expected, 1e-12)), 0.0)

    return 2 * (part(a, n * share) + part(b, m * share) + part(n - a, n * (1 - share)) + part(m - b, m * (1 - share))) * (total > 0)


def among(vocabulary: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which hashes the sorted vocabulary holds."""
    if not len(vocabulary):
        return np.zeros(len(hashes), bool)
    # most terms are unknown: a table of 16 bits of the hash sorts them out before the binary search
    table = np.zeros(1 << 16, bool)
    table[(vocabulary >> np.uint64(48)).astype(np.int64)] = True
    maybe = np.flatnonzero(table[(hashes >> np.uint64(48)).astype(np.int64)])
    spot = np.minimum(np.searchsorted(vocabulary, hashes[maybe]), len(vocabulary) - 1)
    out = np.zeros(len(hashes), bool)
    out[maybe] = vocabulary[spot] == hashes[maybe]
    return out


@dataclass
class BlockMaxIndex:
    """Examples' unit TF-IDF vectors by term, in blocks of examples."""

    vocabulary: np.ndarray  # sorted term hashes
    idf: np.ndarray
    labels: np.ndarray
    keys: np.ndarray
    block: int
    starts: np.ndarray = field(init=False)  # of the postings of (term, block)
    posted: np.ndarray = field(init=False)
    weights: np.ndarray = field(init=False)
    bounds: np.ndarray = field(init=False)  # largest weight by term and block

    def fill(self, example: np.ndarray, term: np.ndarray, weight: np.ndarray) -> BlockMaxIndex:
        self.blocks = -(-len(self.labels) // self.block)
        slot = term * self.blocks + example // self.block
        order = np.lexsort((example, slot))
        slot, self.posted, self.weights = slot[order], example[order], weight[order]
        self.starts = np.searchsorted(slot, np.arange(len(self.vocabulary) * self.blocks + 1))
        flat = np.zeros(len(self.vocabulary) * self.blocks)
        np.maximum.at(flat, slot, self.weights)
        self.bounds = flat.reshape(len(self.vocabulary), self.blocks)
        return self

    def knows(self, hashes: np.ndarray) -> np.ndarray:
        return among(self.vocabulary, hashes)

    def vectors(self, row: np.ndarray, hashes: np.ndarray, count: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, term and weight of unit vectors. words: of each row; each counts as a term outside the vocabulary that no other text has."""
        if not len(self.vocabulary):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        spot = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        known = self.vocabulary[spot] == hashes
        row, spot = row[known], spot[known]
        weight = (1 + np.log(count[known])) * self.idf[spot]
        norm = np.sqrt(np.bincount(row, weight**2, len(words)) + REST * words)
        return row, spot, weight / norm[row]

    def nearest(self, row: np.ndarray, term: np.ndarray, weight: np.ndarray, n: int, k: int, skip: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Similarities (rounded to 9 places) and examples of the k nearest to each of n queries, best first; -1 where there are fewer.

        Rows come in order. skip: an example that each query leaves out.
        """
        best, who = np.zeros((n, k)), np.full((n, k), -1)
        if not len(row):
            return best, who
        reach = np.zeros((n, self.blocks))
        np.add.at(reach, row, weight[:, None] * self.bounds[term])
        ranked = np.argsort(-reach, axis=1, kind="stable")
        at = np.searchsorted(row, np.arange(n + 1))
        for turn in range(self.blocks):
            b = ranked[:, turn]
            bound = reach[np.arange(n), b]
            live = np.flatnonzero((bound > 0) & (bound + 1e-9 >= best[:, -1]))
            if not len(live):
                break
            # the live queries' terms, then these terms' postings in the query's block
            counts = at[live + 1] - at[live]
            mine = np.arange(counts.sum()) + np.repeat(at[live] - (np.cumsum(counts) - counts), counts)
            slot = term[mine] * self.blocks + np.repeat(b[live], counts)
            lens = self.starts[slot + 1] - self.starts[slot]
            spots = np.arange(lens.sum()) + np.repeat(self.starts[slot] - (np.cumsum(lens) - lens), lens)
            cell = np.repeat(np.repeat(np.arange(len(live)), counts), lens) * self.block + self.posted[spots] % self.block
            got = np.bincount(cell, self.weights[spots] * np.repeat(weight[mine], lens), len(live) * self.block).reshape(len(live), self.block).round(9)
            names = b[live][:, None] * self.block + np.arange(self.block)
            if skip is not None:
                got[names == skip[live][:, None]] = 0
            sims = np.concatenate([best[live], got], axis=1)
            ids = np.concatenate([who[live], np.where(got > 0, names, -1)], axis=1)
            order = np.lexsort((np.where(ids < 0, np.iinfo(np.int64).max, ids), -sims), axis=1)[:, :k]
            best[live], who[live] = np.take_along_axis(sims, order, 1), np.take_along_axis(ids, order, 1)
        return best, who


@dataclass
class Model:
    index: BlockMaxIndex
    prior: float
    slope: float
    shift: float
    k: int

    def votes(self, best: np.ndarray, who: np.ndarray) -> np.ndarray:
        label = np.where(who >= 0, self.index.labels[np.maximum(who, 0)] if len(self.index.labels) else 0, 0)
        return ((best * label).sum(axis=1) + PRIOR_VOTE * self.prior) / (best.sum(axis=1) + PRIOR_VOTE)

    def scores(self, votes: np.ndarray) -> np.ndarray:
        if not self.slope:
            return np.full(len(votes), self.prior)
        return 1 / (1 + np.exp(-(self.slope * votes + self.shift)))

    def score(self, row: np.ndarray, hashes: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """row, hashes: occurrences of terms. words: how many words each text has."""
        known = self.index.knows(hashes)
        best, who = self.index.nearest(*self.index.vectors(*counts_of(row[known], hashes[known]), words), len(words), self.k)
        return self.scores(self.votes(best, who)), best, who


def fit_curve(votes: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve, with a weak pull to slope 4; Newton steps."""
    x, w = np.stack([votes, np.ones_like(votes)], axis=1), np.array([4.0, -2.0])
    pull = np.diag([0.05, 1e-6])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + pull, x.T @ (p - labels) + pull @ (w - np.array([4.0, -2.0])))
        w = w - np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(w[1])


def train(keys: list[int], labels: list[int], terms: list[np.ndarray], words: list[int], counts: Callable[[list[int], np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]], frequencies: Callable[[np.ndarray], tuple[np.ndarray, int]], k: int = NEAREST, most_terms: int = TERMS, least_ratio: float = LEAST_RATIO, block: int = BLOCK) -> Model:
    """terms, words: of each example; the list of terms is emptied. counts: of the terms of a vocabulary in some of the examples: which of these, term and count, in order of both. frequencies: how many documents hold each term of a vocabulary and how many there are."""
    names, times = ranked(terms)
    keep = _distinct(terms, times, labels)
    keys, labels, words = ([x[i] for i in keep] for x in (keys, labels, words))
    y = np.array(labels, np.float64)
    n = len(y)
    df, toxic = np.zeros(len(names), np.int32), np.zeros(len(names), np.int32)
    for i, label in zip(keep, labels, strict=True):
        df[terms[i]] += 1
        if label > 0:
            toxic[terms[i]] += 1
    terms.clear()
    often = np.flatnonzero(df >= 2)
    often = often[np.argsort(names[often])]
    names, df, toxic = names[often], df[often].astype(np.float64), toxic[often].astype(np.float64)
    positives = int(y.sum())
    ratio = likelihood_ratio(toxic, df - toxic, positives, n - positives) if 0 < positives < n else np.zeros(len(names))
    chosen = np.flatnonzero(ratio >= least_ratio)
    vocabulary = names[np.sort(chosen[np.argsort(-ratio[chosen], kind="stable")[:most_terms]])]
    del often, names, times, df, toxic, ratio
    release()
    held, documents = frequencies(vocabulary)
    index = BlockMaxIndex(vocabulary, np.log((1 + documents) / (1 + held)) + 1, y, np.array(keys, np.int64), block)
    row, term, weight = index.vectors(*counts(keep, vocabulary), np.array(words, np.float64))
    index.fill(row, term, weight)
    prior = positives / n if n else 0.0
    model = Model(index, prior, 0.0, 0.0, k)
    if 0 < positives < n:
        votes = np.zeros(n)
        for at in range(0, n, QUERIES):
            to = min(at + QUERIES, n)
            a, b = np.searchsorted(row, [at, to])
            votes[at:to] = model.votes(*index.nearest(row[a:b] - at, term[a:b], weight[a:b], to - at, k, np.arange(at, to)))
        model.slope, model.shift = fit_curve(votes, y)
    return model


def counted(texts: DataFrame, text: str, *carried: str) -> DataFrame:
    """Carried columns, terms and counts (packed) of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            *occurrences, words = terms(batch, text)
            row, found, counts = counts_of(*occurrences)
            at = np.searchsorted(row, np.arange(batch.num_rows + 1))
            pack = lambda x: pa.array([x[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([*(column(batch, c) for c in carried), pack(found), pack(counts.astype(np.int32)), pa.array(words.astype(np.int64))], names=[*carried, "terms", "counts", "words"])

    kinds = [f"{c} {texts.schema[c].dataType.simpleString()}" for c in carried]
    return texts.select(*carried, text).mapInArrow(run, ", ".join([*kinds, "terms binary", "counts binary", "words long"]))


def known_counts(rows: DataFrame, vocabulary: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, term and count of the sorted vocabulary's terms in rows as of counted; these are numbered in order of id and size."""

    if not len(vocabulary):
        return np.zeros(0, np.int64), vocabulary, np.zeros(0, np.int32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = []
            for found, times in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                hashes = np.frombuffer(found, np.uint64)
                here = among(vocabulary, hashes)
                got.append((hashes[here].tobytes(), np.frombuffer(times, np.int32)[here].tobytes()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array([x[c] for x in got], pa.binary()) for c in range(2))], names=["id", "size", "terms", "counts"])

    told = sorted(rows.select("id", "size", "terms", "counts").mapInArrow(run, "id long, size int, terms binary, counts binary").collect())  # less than the sets that the driver had
    hashes, times = (np.frombuffer(b"".join(r[c] for r in told), kind) for c, kind in (("terms", np.uint64), ("counts", np.int32)))
    return np.repeat(np.arange(len(told)), np.array([len(r["terms"]) // 8 for r in told], np.int64)), hashes, times


def document_frequencies(docs: DataFrame, vocabulary: np.ndarray, text: str = "text") -> tuple[np.ndarray, int]:
    """How many of all documents hold each term of the sorted vocabulary, and how many documents there are."""
    if not len(vocabulary):
        return np.zeros(0, np.int64), 0
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)  # bounded by TERMS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = shared.value
        held = np.zeros(len(vocabulary) + 1, np.int64)  # the last: documents
        for batch in slices(batches, text):
            row, hashes, _ = terms(batch, text)
            known = among(vocabulary, hashes)
            pairs = np.unique(row[known] * len(vocabulary) + np.searchsorted(vocabulary, hashes[known]))
            held[:-1] += np.bincount(pairs % len(vocabulary), minlength=len(vocabulary))
            held[-1] += batch.num_rows
        at = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(held[at])], names=["term", "n"])

    out = np.zeros(len(vocabulary) + 1, np.int64)
    for r in docs.select(text).mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():  # at most TERMS + 1 rows
        out[r["term"]] = r["n"]
    return out[:-1], int(out[-1])


def learn(docs: DataFrame, labels: DataFrame, label: str = "toxic", key: str = "doc_id", text: str = "text", examples: int = EXAMPLES, folds: int = 5, max_bytes: int = MAX_BYTES) -> Model:
    """From at most `examples` labelled rows outside fold 0, of at most max_bytes of different terms (8 bytes each) in all, and the document frequencies of all docs."""
    small_batches(docs.sparkSession)
    usable = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(label).cast("int").alias("label"))
    usable = usable.where(fold(F.col("id"), folds) != 0).groupBy("id").agg(F.max("label").alias("label"))
    sample = usable.orderBy(F.xxhash64("id"), "id").limit(examples)
    texts = docs.select(F.col(key).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("body"))
    met = texts.join(F.broadcast(sample), "id")  # at most `examples` rows of two numbers
    whole = counted(met, "body", "id", "label").withColumn("size", F.octet_length("terms"))
    # of rows that repeat a key with as many terms, one
    rows = checkpointed(whole.groupBy("id", "size").agg(F.min(F.struct("label", "terms", "counts", "words")).alias("m")).select("id", "size", "m.*"))
    # in the sample's order, as many whole texts as max_bytes of terms allow; a text that doesn't fit is passed over
    taken, held = [], 0
    for r in rows.select("id", "size").orderBy(F.xxhash64("id"), "id", "size").limit(examples).collect():
        if held + r["size"] <= max_bytes:
            taken.append((r["id"], r["size"]))
            held += r["size"]
    taken.sort()

    def of(some: list[tuple[int, int]]) -> DataFrame:
        return rows.join(F.broadcast(docs.sparkSession.createDataFrame(some, "id long, size int")), ["id", "size"])  # at most `examples` rows

    # part by part, and with the terms alone: a whole result would lie in the driver's JVM several times
    found = {}
    for r in of(taken).select("id", "size", "label", "words", "terms").coalesce(1 + held // PART).toLocalIterator():
        found[r["id"], r["size"]] = (r["label"], r["words"], np.frombuffer(r["terms"], np.uint64))
    labels_, words, sets = ([found[x][c] for x in taken] for c in range(3))
    del found
    collect_garbage(docs.sparkSession)

    def counts(keep: list[int], vocabulary: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return known_counts(of([taken[i] for i in keep]), vocabulary)

    model = train([i for i, _ in taken], labels_, sets, words, counts, lambda vocabulary: document_frequencies(docs, vocabulary, text))
    release()
    return model


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", folds: int = 5) -> DataFrame:
    """key, held_out, score, predicted, evidence (nearest examples: key, similarity, label)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by EXAMPLES and TERMS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in slices(batches, text):
            got, best, who = m.score(*terms(batch, text))
            ids = batch.column(0)
            out = [i is not None and zlib.crc32(str(i).encode()) % folds == 0 for i in ids.to_pylist()]
            found = (who >= 0).sum(axis=1)
            pick = who[who >= 0]
            evidence = pa.StructArray.from_arrays([pa.array(m.index.keys[pick]), pa.array(best[who >= 0]), pa.array(m.index.labels[pick].astype(np.int32))], ["key", "similarity", "label"])
            yield pa.RecordBatch.from_arrays([
                ids, pa.array(out), pa.array(got), pa.array((got >= 0.5).astype(np.int32)),
                pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(found)]).astype(np.int32)), evidence),
            ], names=[key, "held_out", "score", "predicted", "evidence"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, held_out boolean, score double, predicted int, evidence array<struct<key:long,similarity:double,label:int>>")


def without_toxic(docs: DataFrame, model: Model, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows, with all their columns, whose score is under the threshold."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by EXAMPLES and TERMS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            got, _, _ = shared.value.score(*terms(batch, text))
            yield batch.filter(pa.array(got < threshold))

    return docs.mapInArrow(run, docs.schema)
