"""Language identification by a bidirectional GRU over bytes (operator 8).

The network is trained in numpy by backpropagation through time on windows of a
bounded sample of labelled documents. For prediction a text's bytes are cut into
windows of `window` bytes; both directions start afresh in each. Every position
is labelled, and the mean of the position probabilities is the document's.
Every language is learned that a usable document outside the held-out fold
names; only the sample of each is bounded. Steps of training, and the numbers
held for a language, grow with the number of languages.

lang_pred is `und` with score 0 for null texts and texts without a letter; then
too if nothing could be learned. Rows with a null key are predicted and never
learned from nor held out. Repeated rows are predicted each on its own. Other
columns than text are not read for a prediction. An empty table gives an empty
result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.llm.text import column, slices, text_buffers
from ledgerline.llm.toxicity import fold

HIDDEN = 12
WINDOW = 256
BATCH = 2048
DOCS_PER_LANGUAGE = 200
WINDOWS_PER_DOC = 8
LEAST_DOCS = 10
SAMPLE = 12800  # documents of all languages, as long as that leaves each LEAST_DOCS
STEPS = 160
MINI_BATCH = 192
CLASSES = 64  # for more languages windows are predicted in smaller batches and training takes more steps


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


@dataclass
class Direction:
    """One GRU. table: what each byte adds to the update, reset and new gates, biases included; hidden: the same of the state."""

    table: np.ndarray
    hidden: np.ndarray

    def states(self, steps: np.ndarray):
        """The transposed states of run(), in buffers that every step uses again; units lie along rows, so each pass is contiguous."""
        size, n = self.hidden.shape[0], steps.shape[1]
        table, hidden = np.ascontiguousarray(self.table.T), np.ascontiguousarray(self.hidden.T)
        h, x, u = np.zeros((size, n), np.float32), np.empty((3 * size, n), np.float32), np.empty((3 * size, n), np.float32)
        gates, new = x[: 2 * size], x[2 * size :]
        for byte in steps:
            np.take(table, byte, axis=1, out=x, mode="clip")
            np.matmul(hidden, h, out=u)
            gates += u[: 2 * size]
            np.negative(gates, out=gates)
            np.exp(gates, out=gates)
            gates += 1
            np.reciprocal(gates, out=gates)
            u[2 * size :] *= gates[size:]
            new += u[2 * size :]
            np.tanh(new, out=new)
            h -= new
            h *= gates[:size]
            h += new
            yield h

    def run(self, steps: np.ndarray, keep: bool = False):
        """steps: bytes by time and window. Yields the state after each step, or what backward() needs."""
        size = self.hidden.shape[0]
        h = np.zeros((steps.shape[1], size), np.float32)
        for byte in steps:
            x, u = self.table[byte], h @ self.hidden
            gates = sigmoid(x[:, : 2 * size] + u[:, : 2 * size])
            z, r = gates[:, :size], gates[:, size:]
            new = np.tanh(x[:, 2 * size :] + r * u[:, 2 * size :])
            before, h = h, new + z * (h - new)
            yield (before, h, z, r, new, u[:, 2 * size :]) if keep else h

    def backward(self, steps: np.ndarray, held: list, grads: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Gradients of table and hidden, from those of the states by step."""
        size = self.hidden.shape[0]
        d_table, d_hidden, dxs = np.zeros_like(self.table), np.zeros_like(self.hidden), []
        carried = np.zeros_like(grads[0])
        for t in range(len(steps) - 1, -1, -1):
            before, _, z, r, new, un = held[t]
            dh = grads[t] + carried
            dz = dh * (before - new) * z * (1 - z)
            dn = dh * (1 - z) * (1 - new * new)
            dr = dn * un * r * (1 - r)
            dx = np.concatenate([dz, dr, dn], axis=1)
            du = np.concatenate([dz, dr, dn * r], axis=1)
            d_hidden += before.T @ du
            carried = dh * z + du @ self.hidden.T
            dxs.append(dx)
        # sums of each byte's rows: one pass over rows in order of their byte
        byte, rows = steps[::-1].ravel(), np.concatenate(dxs)
        order = np.argsort(byte, kind="stable")
        heads = np.flatnonzero(np.diff(byte[order].astype(np.int64), prepend=-1))
        d_table[byte[order][heads]] = np.add.reduceat(rows[order], heads)
        return d_table, d_hidden


@dataclass
class Network:
    forward: Direction
    back: Direction
    out: np.ndarray  # of both states
    bias: np.ndarray
    names: list[str]

    @staticmethod
    def fresh(names: list[str], hidden: int, seed: int) -> Network:
        rng = np.random.default_rng(seed)
        one = lambda: Direction((rng.normal(0, 0.3, (256, 3 * hidden))).astype(np.float32), rng.normal(0, 1 / np.sqrt(hidden), (hidden, 3 * hidden)).astype(np.float32))
        return Network(one(), one(), rng.normal(0, 0.3, (2 * hidden, len(names))).astype(np.float32), np.zeros(len(names), np.float32), names)

    def parameters(self) -> list[np.ndarray]:
        return [self.forward.table, self.forward.hidden, self.back.table, self.back.hidden, self.out, self.bias]

    def positions(self, steps: np.ndarray) -> np.ndarray:
        """Probabilities by step, language and window."""
        size = self.forward.hidden.shape[0]
        logits = np.empty((len(steps), len(self.names), steps.shape[1]), np.float32)
        ahead, behind = np.ascontiguousarray(self.out[:size].T), np.ascontiguousarray(self.out[size:].T)
        for t, h in enumerate(self.forward.states(steps)):
            np.matmul(ahead, h, out=logits[t])
        for t, h in enumerate(self.back.states(steps[::-1])):
            logits[len(steps) - 1 - t] += behind @ h
        logits += self.bias[:, None]
        logits -= logits.max(axis=1, keepdims=True)
        np.exp(logits, out=logits)
        logits /= logits.sum(axis=1, keepdims=True)
        return logits

    def gradients(self, steps: np.ndarray, real: np.ndarray, label: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Mean cross-entropy over real positions, and its gradients. real: by step and window."""
        size = self.forward.hidden.shape[0]
        ahead, behind = list(self.forward.run(steps, True)), list(self.back.run(steps[::-1], True))
        n = len(steps)
        states = np.stack([np.concatenate([ahead[t][1], behind[n - 1 - t][1]], axis=1) for t in range(n)])
        logits = states @ self.out + self.bias
        logits -= logits.max(axis=2, keepdims=True)
        p = np.exp(logits)
        p /= p.sum(axis=2, keepdims=True)
        total = max(1, int(real.sum()))
        picked = p[:, np.arange(len(label)), label]
        loss = float(-(np.log(np.maximum(picked, 1e-12)) * real).sum() / total)
        p[:, np.arange(len(label)), label] -= 1
        d = (p * (real / total)[:, :, None]).astype(np.float32)
        flat, ds = d.reshape(-1, d.shape[2]), d @ self.out.T
        one = self.forward.backward(steps, ahead, list(ds[:, :, :size]))
        two = self.back.backward(steps[::-1], behind, list(ds[::-1, :, size:]))
        return loss, [*one, *two, states.reshape(-1, 2 * size).T @ flat, flat.sum(axis=0)]


def cut(data: np.ndarray, offsets: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of the texts, padded with zeros: bytes by window, the text of each, its length."""
    lens = np.diff(offsets)
    counts = -(-lens // window)
    text = np.repeat(np.arange(len(lens)), counts)
    first = np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts, counts)
    start = offsets[text] + first * window
    size = np.minimum(offsets[text + 1] - start, window)
    spots = start[:, None] + np.arange(window)
    inside = np.arange(window) < size[:, None]
    out = np.where(inside, data[np.minimum(spots, max(len(data) - 1, 0))], 0).astype(np.uint8) if len(data) else np.zeros((0, window), np.uint8)
    return out, text, size


def predict(net: Network, data: np.ndarray, offsets: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Mean position probabilities of each text; zeros for empty ones."""
    pooled = np.zeros((len(offsets) - 1, len(net.names)))
    windows, text, size = cut(data, offsets, window)
    batch = max(1, BATCH * CLASSES // max(CLASSES, len(net.names)))
    for at in range(0, len(windows), batch):
        part, n = windows[at : at + batch], size[at : at + batch]
        p = net.positions(np.ascontiguousarray(part.T[: int(n.max())]))
        p *= (np.arange(len(p))[:, None] < n)[:, None, :]
        np.add.at(pooled, text[at : at + batch], p.sum(axis=0).T)
    return pooled / np.maximum(np.diff(offsets), 1)[:, None]


def fit(texts: list[bytes], langs: list[str], hidden: int = HIDDEN, steps: int = STEPS, window: int = 64, per_doc: int = WINDOWS_PER_DOC, seed: int = 7) -> Network:
    """Adam on mini-batches of windows taken at random places of the sample, as many of each language; of more languages than a mini-batch holds, in turn."""
    names = sorted(set(langs))
    net = Network.fresh(names, hidden, seed)
    rng = np.random.default_rng(seed)
    pools: list[list[bytes]] = [[] for _ in names]
    spot = {name: k for k, name in enumerate(names)}
    for text, lang in zip(texts, langs, strict=True):
        for _ in range(per_doc):
            at = int(rng.integers(0, max(1, len(text) - window + 1)))
            if text[at : at + window]:
                pools[spot[lang]].append(text[at : at + window])
    filled = [k for k, p in enumerate(pools) if p]
    if not filled:
        return net
    each = max(1, MINI_BATCH // len(filled))
    steps = -(-steps * max(CLASSES, len(filled)) // CLASSES)
    turns: list[int] = []
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in net.parameters()]
    for step in range(1, steps + 1):
        if len(filled) <= MINI_BATCH:
            taken = filled
        else:
            if len(turns) < MINI_BATCH:
                turns += rng.permutation(filled).tolist()
            taken, turns = turns[:MINI_BATCH], turns[MINI_BATCH:]
        chosen = [(pools[k][int(rng.integers(len(pools[k])))], k) for k in taken for _ in range(each)]
        offsets = np.concatenate([[0], np.cumsum([len(c) for c, _ in chosen])])
        data = np.frombuffer(b"".join(c for c, _ in chosen), np.uint8)
        part, _, size = cut(data, offsets, window)
        real = (np.arange(window)[:, None] < size).astype(np.float32)
        _, grads = net.gradients(np.ascontiguousarray(part.T), real, np.array([k for _, k in chosen]))
        rate = 0.03 * min(1.0, 2 * (1 - step / (steps + 1)))
        for p, g, (m, v) in zip(net.parameters(), grads, moments, strict=True):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return net


def learn(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = DOCS_PER_LANGUAGE, sample: int = SAMPLE, folds: int = 4, out: int = 2) -> Network | None:
    """From at most per_language documents of each language outside the held-out fold; fewer, but LEAST_DOCS, where all of these would be over `sample`."""
    usable = docs.where(F.col(text).isNotNull() & F.col(lang).isNotNull() & F.col(key).isNotNull() & (F.length(text) > 0)).where(fold(F.col(key), folds) != out)
    languages = usable.select(lang).distinct().count()
    if not languages:
        return None
    share = min(per_language, max(LEAST_DOCS, sample // languages))
    order = Window.partitionBy("lang").orderBy("h", "id")
    ids = usable.select(F.col(key).alias("id"), F.col(lang).alias("lang"), F.xxhash64(key).alias("h"))
    picked = ids.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= share).select("id", "lang").distinct()
    # at most share * languages keys
    rows = usable.select(F.col(key).alias("id"), F.col(text).alias("text"), F.col(lang).alias("lang")).join(F.broadcast(picked), ["id", "lang"], "left_semi")
    near = rows.select("id", "text", "lang").mapInArrow(_pieces, "id long, text binary, lang string")
    # rows of a repeated key count one by one
    near = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("id", "text"))).where(F.col("rank") <= share).orderBy("id", "lang", "text").collect()
    return fit([bytes(r["text"]) for r in near], [r["lang"] for r in near])


def _pieces(batches: Iterator[pa.RecordBatch], pieces: int = 8, size: int = 512) -> Iterator[pa.RecordBatch]:
    """For training, texts over pieces * size bytes become evenly spaced pieces, so that the sample has a size bound."""
    for batch in batches:
        texts = []
        for t in column(batch, "text").cast(pa.binary()).to_pylist():
            if len(t) > pieces * size:
                gap = (len(t) - size) // (pieces - 1)
                t = b"".join(t[k * gap : k * gap + size] for k in range(pieces))
            texts.append(t)
        yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(texts, pa.binary()), column(batch, "lang")], names=["id", "text", "lang"])


def lettered(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Which texts hold a letter."""
    ascii_ = ((data | 32) >= 97) & ((data | 32) <= 122)
    sums = np.concatenate([[0], np.cumsum(ascii_)])
    has = np.diff(sums[offsets]) > 0
    for i in np.flatnonzero(~has & (np.diff(offsets) > 0)).tolist():
        has[i] = any(c.isalpha() for c in data[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8"))
    return has


def identify(docs: DataFrame, net: Network | None, key: str = "doc_id", text: str = "text", folds: int = 4, out: int = 2) -> DataFrame:
    """key, held_out, lang_pred, score."""
    shared = docs.sparkSession.sparkContext.broadcast(net)  # some ten thousand numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in slices(batches, text):
            data, offsets = text_buffers(column(batch, text))
            ids = batch.column(0)
            held = [i is not None and zlib.crc32(str(i).encode()) % folds == out for i in ids.to_pylist()]
            if model is None:
                names, top = ["und"] * batch.num_rows, np.zeros(batch.num_rows)
            else:
                has = lettered(data, offsets)
                pooled = predict(model, data, offsets)
                names = [model.names[k] if ok else "und" for k, ok in zip(pooled.argmax(axis=1).tolist(), has.tolist(), strict=True)]
                top = np.where(has, np.clip(pooled.max(axis=1), 0, 1), 0.0)
            yield pa.RecordBatch.from_arrays([ids, pa.array(held), pa.array(names, pa.string()), pa.array(top)], names=[key, "held_out", "lang_pred", "score"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, held_out boolean, lang_pred string, score double")
