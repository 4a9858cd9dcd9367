"""SentencePiece encoding and decoding in numpy (operator 1).

Texts are cut into units at places that no piece spans, different units are
found by hash, and each is segmented once for a Python worker's whole table.

* Unigram models: batched Viterbi. Units of equal length advance together; the
  hash of each substring that ends at a position probes the sorted piece keys,
  and vectorised maxima store back-pointers.
* BPE models: their pieces result from merges in order of rank, which the best
  sum of scores doesn't give, so Viterbi can't give right results. Units of equal
  length are merged together: the keys of neighbouring symbols probe the sorted
  keys of all splits of pieces, and the least rank of each unit is merged. Units
  over LONG code points use a heap each.

Only models with identity normalisation and without user-defined or unused
pieces are taken, others are refused.

Null or empty text: no ids, empty text again. Every row is encoded on its own,
repeated ones too. Other columns are not read. An empty table gives an empty
result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ledgerline.llm.text import column, mix64, powers, slices, text_buffers
from ledgerline.llm.tokens import Table

SPACE = 0x2581
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
LONG = 48
UNKNOWN_PENALTY = 10.0


def fields(raw: bytes) -> Iterator[tuple[int, object]]:
    """The fields of a protocol buffer message, in order."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = raw[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(raw):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        elif kind == 2:
            n = varint()
            yield tag >> 3, raw[at : at + n]
            at += n
        else:
            n = 4 if kind == 5 else 8
            yield tag >> 3, raw[at : at + n]
            at += n


def hashes_of(text: np.ndarray) -> np.ndarray:
    """Prefix sums whose differences give the hash of any run of code points."""
    up, _ = powers(len(text) + 1)
    out = np.zeros(len(text) + 1, np.uint64)
    np.cumsum(mix64(text.astype(np.uint64) + np.uint64(1)) * up[: len(text)], out=out[1:])
    return out


def run_keys(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    _, down = powers(len(sums))
    return mix64((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


class Pieces:
    """What a SentencePiece model file says, and the decoder, which needs little memory. kind: take it for another type of model."""

    def __init__(self, path: str, kind: int | None = None):
        with open(path, "rb") as f:
            raw = f.read()
        self.pieces: list[str] = []
        scores, types = [], []
        self.kind, self.fallback, self.dummy, self.squeeze, self.escape, self.charsmap = UNIGRAM, False, True, True, True, b""
        for number, value in fields(raw):
            if number == 1:
                piece = dict(fields(value))
                self.pieces.append(piece.get(1, b"").decode())
                scores.append(float(np.frombuffer(piece[2], "<f4")[0]) if 2 in piece else 0.0)
                types.append(piece.get(3, NORMAL))
            elif number == 2:
                spec = dict(fields(value))
                self.kind, self.fallback = spec.get(3, UNIGRAM), bool(spec.get(35, 0))
            elif number == 3:
                spec = dict(fields(value))
                self.charsmap, self.dummy, self.squeeze, self.escape = spec.get(2, b""), bool(spec.get(3, 1)), bool(spec.get(4, 1)), bool(spec.get(5, 1))
        self.kind = kind or self.kind
        self.scores, self.types = np.array(scores), np.array(types)
        if self.charsmap or self.squeeze or not self.escape or self.kind not in (UNIGRAM, BPE) or not set(types) <= {NORMAL, UNKNOWN, CONTROL, BYTE}:
            raise ValueError("only unigram and BPE models with identity normalisation and plain pieces are supported")
        self._decoder()

    def _decoder(self) -> None:
        said = []
        for k, (piece, kind) in enumerate(zip(self.pieces, self.types.tolist(), strict=True)):
            said.append(b"" if kind == CONTROL else " ⁇ ".encode() if kind == UNKNOWN else bytes([int(piece[1:-1], 16)]) if kind == BYTE else piece.replace(chr(SPACE), " ").encode())
        self.said = np.frombuffer(b"".join(said), np.uint8)
        self.said_size = np.array([len(s) for s in said])
        self.said_at = np.cumsum(self.said_size) - self.said_size

    def decode(self, ids: np.ndarray, edges: np.ndarray) -> list[str]:
        """The text of each run of ids; bytes that are not UTF-8 become U+FFFD."""
        lens = self.said_size[ids]
        to = np.cumsum(lens)
        total = int(to[-1]) if len(to) else 0
        raw = self.said[np.arange(total) + np.repeat(self.said_at[ids] - (to - lens), lens)].tobytes()
        spots = np.concatenate([[0], to])[edges].tolist()
        texts = (raw[a:b].decode("utf-8", "replace") for a, b in zip(spots[:-1], spots[1:], strict=True))
        return [t.removeprefix(" ") if self.dummy else t for t in texts]


class Model(Pieces):
    """The encoder too. At most cache different units are held; then the table starts anew."""

    def __init__(self, path: str, kind: int | None = None, cache: int = 500_000):
        super().__init__(path, kind)
        self.unknown = int(np.flatnonzero(self.types == UNKNOWN)[0])
        self.byte_ids = {int(self.pieces[k][1:-1], 16): k for k in np.flatnonzero(self.types == BYTE).tolist()}
        self.fallback &= len(self.byte_ids) == 256
        normal = np.flatnonzero(self.types == NORMAL)
        self.ids = {self.pieces[k]: int(k) for k in normal}
        joined = [self.pieces[k] for k in normal]
        spans = any(a != chr(SPACE) and b == chr(SPACE) for p in joined for a, b in zip(p, p[1:], strict=False))
        #: code points inside longer pieces; others stand alone
        inner = np.zeros(0x110000, bool)
        for p in joined:
            if len(p) > 1:
                inner[[ord(c) for c in p]] = True
        self.inner, self.spans = inner, spans
        self.longest = max(map(len, joined), default=1)
        text = code_points("".join(joined))
        ends = np.cumsum([len(p) for p in joined])
        keys = run_keys(hashes_of(text), ends - np.array([len(p) for p in joined]), ends)
        order = np.argsort(keys)
        self.keys, self.key_ids = keys[order], normal[order]
        if self.kind == BPE:
            self._splits(joined)
        self.cache = cache
        self.reset()

    def _splits(self, joined: list[str]) -> None:
        """Sorted keys of all pairs of symbols whose concatenation is a piece. Symbols: pieces, then other single characters."""
        symbol = dict(self.ids)
        for p in joined:
            for c in p:
                symbol.setdefault(c, len(self.pieces) + len(symbol))
        self.symbols = symbol
        pairs = {}
        for p in joined:
            for k in range(1, len(p)):
                a, b = symbol.get(p[:k]), symbol.get(p[k:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = self.ids[p]
        self.pair_keys = np.array(sorted(pairs), np.int64)
        self.pair_ids = np.array([pairs[k] for k in self.pair_keys.tolist()], np.int64)
        self.pair_map = pairs
        self.rank = -self.scores
        self.character = np.full(0x110000, -1, np.int64)
        for s, k in symbol.items():
            if len(s) == 1:
                self.character[ord(s)] = k

    # -- the table of units -------------------------------------------------

    def reset(self) -> None:
        self.table = Table()
        self.flat = np.zeros(1 << 16, np.int32)
        self.at, self.sizes = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int32)
        self.rows = self.fill = 0

    def _add(self, keys: np.ndarray, ids: list[list[int]]) -> None:
        lens = np.fromiter(map(len, ids), np.int32, len(ids))
        need, total = self.rows + len(ids), int(lens.sum())
        while need > len(self.at):
            self.at, self.sizes = np.concatenate([self.at, np.zeros_like(self.at)]), np.concatenate([self.sizes, np.zeros_like(self.sizes)])
        while self.fill + total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.fill : self.fill + total] = np.fromiter((i for x in ids for i in x), np.int32, total)
        rows = np.arange(self.rows, need, dtype=np.int32)
        self.at[rows], self.sizes[rows] = self.fill + np.cumsum(lens) - lens, lens
        self.table.add(keys, rows)
        self.rows, self.fill = need, self.fill + total

    # -- segmentation of different units ------------------------------------

    def _written(self, text: str, ids: list[int]) -> list[int]:
        """Symbols as ids: unknown characters become bytes, or neighbouring ones one unknown id. ids: piece ids, or -1 - code point."""
        out: list[int] = []
        for i in ids:
            if i >= 0:
                out.append(i)
            elif self.fallback:
                out += [self.byte_ids[b] for b in chr(-1 - i).encode("utf-8")]
            elif not out or out[-1] != self.unknown:
                out.append(self.unknown)
        return out

    def _viterbi(self, units: np.ndarray) -> list[list[int]]:
        """units: code points, one unit a row, all of one length."""
        n, size = units.shape
        up, down = powers(size + 1)
        sums = np.zeros((n, size + 1), np.uint64)
        np.cumsum(mix64(units.astype(np.uint64) + np.uint64(1)) * up[:size], axis=1, out=sums[:, 1:])
        best = np.full((n, size + 1), -np.inf)
        best[:, 0] = 0
        back, piece = np.zeros((n, size + 1), np.int64), np.full((n, size + 1), -1, np.int64)
        unknown = self.scores[self.types == NORMAL].min() - UNKNOWN_PENALTY
        every = np.arange(n)
        for end in range(1, size + 1):
            lengths = np.arange(min(self.longest, end), 0, -1)
            starts = end - lengths
            keys = mix64((sums[:, end : end + 1] - sums[:, starts]) * down[starts] + lengths.astype(np.uint64))
            spot = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            found = self.keys[spot] == keys
            ids = np.where(found, self.key_ids[spot], -1)
            got = best[:, starts] + np.where(found, self.scores[ids], -np.inf)
            lone = ids[:, -1] < 0
            got[lone, -1] = best[lone, end - 1] + unknown
            top = got.argmax(axis=1)
            best[:, end], back[:, end], piece[:, end] = got[every, top], starts[top], ids[every, top]
        out = []
        for row in range(n):
            ids, at = [], size
            while at:
                ids.append(int(piece[row, at]) if piece[row, at] >= 0 else -1 - int(units[row, at - 1]))
                at = int(back[row, at])
            out.append(ids[::-1])
        return out

    def _merge(self, units: np.ndarray) -> list[list[int]]:
        n, size = units.shape
        symbols = self.character[units]
        symbols = np.where(symbols < 0, -1 - units.astype(np.int64), symbols)
        live, every = np.full(n, size), np.arange(n)
        done = symbols.copy()
        rows = every
        while size > 1 and len(rows):
            a, b = symbols[:, :-1], symbols[:, 1:]
            keys = a << 32 | b
            spot = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
            merged = np.where((a >= 0) & (b >= 0) & (self.pair_keys[spot] == keys) & (np.arange(size - 1) < live[rows, None] - 1), self.pair_ids[spot], -1)
            rank = np.where(merged >= 0, self.rank[merged], np.inf)
            at = rank.argmin(axis=1)
            can = rank[np.arange(len(rows)), at] < np.inf
            done[rows[~can], :size] = symbols[~can]
            rows, symbols, at, merged = rows[can], symbols[can], at[can], merged[can]
            mine = np.arange(len(rows))
            symbols[mine, at] = merged[mine, at]
            source = np.arange(size) + (np.arange(size) > at[:, None])
            symbols = np.take_along_axis(symbols, np.minimum(source, size - 1), axis=1)[:, : size - 1]
            live[rows] -= 1
            size -= 1
        done[rows, :size] = symbols
        return [self._known(d[:k]) for d, k in zip(done.tolist(), live.tolist(), strict=True)]

    def _known(self, symbols: list[int]) -> list[int]:
        """Symbols that are no pieces, as -1 - code point."""
        if max(symbols, default=0) < len(self.pieces):
            return symbols
        names = {k: s for s, k in self.symbols.items() if k >= len(self.pieces)}
        return [-1 - ord(names[s]) if s >= len(self.pieces) else s for s in symbols]

    def _merge_long(self, unit: np.ndarray) -> list[int]:
        """One unit by a heap of pairs, of equal ranks the leftmost first."""
        symbols = [int(self.character[c]) if self.character[c] >= 0 else -1 - int(c) for c in unit]
        n = len(symbols)
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap: list[tuple[float, int, int, int, int]] = []

        def offer(i: int) -> None:
            j = after[i]
            if j < n and symbols[i] >= 0 and symbols[j] >= 0 and (m := self.pair_map.get(symbols[i] << 32 | symbols[j])) is not None:
                heapq.heappush(heap, (self.rank[m], i, symbols[i], symbols[j], m))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, a, b, m = heapq.heappop(heap)
            j = after[i] if alive[i] else n
            if j >= n or symbols[i] != a or symbols[j] != b:
                continue
            symbols[i], alive[j], after[i] = m, False, after[j]
            if after[i] < n:
                before[after[i]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return self._known([s for s, a in zip(symbols, alive, strict=True) if a])

    def segment(self, cps: np.ndarray, start: np.ndarray, end: np.ndarray) -> list[list[int]]:
        """Ids of units [start, end) of cps. Units of equal length advance together."""
        out: list[list[int]] = [[]] * len(start)
        lens = end - start
        order = np.argsort(lens, kind="stable")
        heads = np.flatnonzero(np.concatenate([[True], np.diff(lens[order]) > 0])) if len(order) else []
        for a, b in zip(heads, [*heads[1:], len(order)], strict=True):
            size = int(lens[order[a]])
            group = max(1, (1 << 19) // (size * (self.longest if self.kind == UNIGRAM else 1)))
            for at in range(a, b, group):
                mine = order[at : min(b, at + group)]
                units = cps[start[mine][:, None] + np.arange(size)]
                got = self._viterbi(units) if self.kind == UNIGRAM else [self._merge_long(u) for u in units] if size > LONG else self._merge(units)
                for k, ids in zip(mine.tolist(), got, strict=True):
                    out[k] = self._written("", ids) if min(ids) < 0 else ids
        return out

    # -- whole columns -------------------------------------------------------

    def encode(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids and the offsets of each text's ids."""
        if self.rows > self.cache:
            self.reset()
        data, offsets = text_buffers(col)
        cps = code_points(data.tobytes().decode("utf-8"))
        bounds = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]
        if self.dummy:  # a space before each text that is not empty
            full = np.flatnonzero(np.diff(bounds) > 0)
            cps = np.insert(cps, bounds[full], 0x20)
            bounds = bounds + np.concatenate([[0], np.cumsum(np.diff(bounds) > 0)])
        cps = np.where(cps == 0x20, np.uint32(SPACE), cps)
        n = len(cps)
        if not n:
            return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
        blank, alone = cps == SPACE, ~self.inner[cps]
        cut = np.zeros(n, bool)
        cut[bounds[:-1][np.diff(bounds) > 0]] = True
        cut[1:] |= alone[1:] | alone[:-1]
        if not self.spans:
            cut[1:] |= blank[1:] & ~blank[:-1]
        if not self.fallback:  # neighbouring unknown characters become one id, so they stay in one unit
            lone = self._unseen(cps)
            inside = np.zeros(n, bool)
            inside[1:] = lone[1:] & lone[:-1]
            inside[bounds[:-1][np.diff(bounds) > 0]] = False
            cut &= ~inside
        start = np.flatnonzero(cut)
        end = np.append(start[1:], n)
        keys = run_keys(hashes_of(cps), start, end)
        rows = self.table.find(keys)
        missing = np.flatnonzero(rows < 0)
        if len(missing):
            fresh, first = np.unique(keys[missing], return_index=True)
            where = missing[first]
            self._add(fresh, self.segment(cps, start[where], end[where]))
            rows[missing] = self.table.find(keys[missing])
        lens = self.sizes[rows].astype(np.int64)
        to = np.cumsum(lens)
        ids = self.flat[np.arange(int(to[-1])) + np.repeat(self.at[rows] - (to - lens), lens)]
        return ids, np.concatenate([[0], to])[np.searchsorted(start, bounds)]

    def _unseen(self, cps: np.ndarray) -> np.ndarray:
        if not hasattr(self, "_single"):
            self._single = np.zeros(0x110000, bool)
            self._single[[ord(p) for p in self.ids if len(p) == 1]] = True
        return ~self._single[cps]


_MODELS: dict[tuple[str, int | None], Model] = {}
_PIECES: dict[tuple[str, int | None], Pieces] = {}


def model(path: str, kind: int | None = None) -> Model:
    """One for each Python worker."""
    if (path, kind) not in _MODELS:
        _MODELS[path, kind] = Model(path, kind)
    return _MODELS[path, kind]


def pieces(path: str, kind: int | None = None) -> Pieces:
    if (path, kind) not in _PIECES:
        _PIECES[path, kind] = Pieces(path, kind)
    return _PIECES[path, kind]


def encode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", kind: int | None = None) -> DataFrame:
    """key, n_ids, ids (little-endian unsigned 32-bit integers)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text, 2 << 20):
            ids, edges = model(path, kind).encode(column(batch, text))
            spots = (edges * 4).astype(np.int32)
            held = pa.BinaryArray.from_buffers(pa.binary(), batch.num_rows, [None, pa.py_buffer(spots), pa.py_buffer(ids.astype("<u4"))])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(edges)), held], names=[key, "n_ids", "ids"])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, n_ids long, ids binary")


def decode(encoded: DataFrame, path: str, key: str = "doc_id", ids: str = "ids", kind: int | None = None) -> DataFrame:
    """key, n_ids, ids and their text; null ids: empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, ids, 4 << 20):
            data, offsets = text_buffers(column(batch, ids))
            numbers = np.frombuffer(data.tobytes(), "<u4").astype(np.int64)
            texts = pieces(path, kind).decode(numbers, offsets // 4)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(offsets) // 4), column(batch, ids), pa.array(texts, pa.string())], names=[key, "n_ids", "ids", "text"])

    return encoded.select(key, ids).mapInArrow(run, f"`{key}` {encoded.schema[key].dataType.simpleString()}, n_ids long, ids binary, text string")
