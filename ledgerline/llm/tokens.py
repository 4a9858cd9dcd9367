"""Byte-level BPE over whole batches.

Texts are cut into pre-tokens by array operations on code points; each
different pre-token is encoded once and its ids are looked up by hash, so the
cost of a repeated word is a table probe.
"""

from __future__ import annotations

import json
import unicodedata

import numpy as np
import pyarrow as pa

from ledgerline.llm.text import mix64, powers, text_buffers

# The byte-level BPE pattern and the code points that count as white space in it.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
SPACE, LETTER, NUMBER, OTHER = range(4)
LONG = 64
_CLASSES: np.ndarray | None = None


def classes() -> np.ndarray:
    global _CLASSES
    if _CLASSES is None:
        kinds = np.full(0x110000, OTHER, np.uint8)
        for cp in range(0x110000):
            kind = unicodedata.category(chr(cp))[0]
            if kind == "L":
                kinds[cp] = LETTER
            elif kind == "N":
                kinds[cp] = NUMBER
        kinds[WHITE] = SPACE
        _CLASSES = kinds
    return _CLASSES


def byte_characters() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


def pretoken_starts(cps: np.ndarray, edge: np.ndarray) -> np.ndarray:
    """Where the pre-tokens of PATTERN start. edge: true where a text starts; one longer than cps."""
    n = len(cps)
    if not n:
        return np.zeros(0, bool)
    kind = classes()[cps]
    blank = kind == SPACE
    plain = cps == 0x20
    start = edge[:n].copy()
    start[1:] |= (kind[1:] != kind[:-1]) & ~(plain[:-1] & ~blank[1:])
    # of blanks before other characters, the last one stands alone or leads the next pre-token
    start[:-1] |= blank[:-1] & ~blank[1:] & ~edge[1:n]
    start |= edge[:n]
    quote = np.flatnonzero((cps == 0x27) & start)
    if len(quote):
        padded = np.concatenate([cps, [0, 0, 0]])
        lone = np.concatenate([edge, [True, True]])
        one, two = padded[quote + 1], padded[quote + 2]
        inside = ~lone[quote + 1]
        size = np.where(inside & np.isin(one, [ord(c) for c in "stmd"]), 1, 0)
        pair = (one.astype(np.int64) << 32) | two
        pairs = [(ord(a) << 32) | ord(b) for a, b in ("re", "ve", "ll")]
        size = np.where(inside & ~lone[quote + 2] & np.isin(pair, pairs), 2, size)
        quote, size = quote[size > 0], size[size > 0]
        start[quote + 1] = False
        after = quote + size + 1
        start[after[after < n]] = True
    return start


class Table:
    """An open-addressing map of 64-bit hashes to rows, probed and filled by whole arrays."""

    def __init__(self, bits: int = 16):
        self.resize(bits)
        self.used = 0

    def resize(self, bits: int) -> None:
        self.mask = np.uint64((1 << bits) - 1)
        self.keys = np.zeros(1 << bits, np.uint64)
        self.rows = np.full(1 << bits, -1, np.int32)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The row of each key, -1 where it is not held."""
        at = (keys & self.mask).astype(np.int64)
        out = self.rows[at]
        open_ = np.flatnonzero((out >= 0) & (self.keys[at] != keys))
        at = at[open_]
        while len(open_):
            at = (at + 1) & int(self.mask)
            rows = self.rows[at]
            out[open_] = rows
            more = (rows >= 0) & (self.keys[at] != keys[open_])
            open_, at = open_[more], at[more]
        return out

    def add(self, keys: np.ndarray, rows: np.ndarray) -> None:
        """Keys are different and not held yet."""
        if (self.used + len(keys)) * 2 > len(self.keys):
            held = self.rows >= 0
            old_keys, old_rows = self.keys[held], self.rows[held]
            self.resize(int(np.ceil(np.log2((self.used + len(keys)) * 4))))
            self.used = 0
            self._put(old_keys, old_rows)
        self._put(keys, rows)

    def _put(self, keys: np.ndarray, rows: np.ndarray) -> None:
        self.used += len(keys)
        at = (keys & self.mask).astype(np.int64)
        while len(keys):
            free = self.rows[at] < 0
            self.keys[at[free]] = keys[free]
            self.rows[at[free]] = rows[free]
            left = self.rows[at] != rows
            keys, rows, at = keys[left], rows[left], (at[left] + 1) & int(self.mask)


class ByteBPE:
    """Encoder for a byte-level BPE vocabulary file of the tokenizers library.

    encode() gives the ids of encode_batch(texts, add_special_tokens=False).
    At most cache different pre-tokens are held; then the table starts anew.
    """

    def __init__(self, path: str, cache: int = 800_000):
        import tiktoken
        self.path, self._whole = path, None
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_characters()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(letters[c] for c in token): k for token, k in spec["model"]["vocab"].items() if token not in self.special}
        self.single = tiktoken.Encoding("words", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.newline = self.single.encode_ordinary("\n")[0]
        self.marks = [t.encode() for t in self.special]
        self.cache = cache
        self.reset()

    @property
    def whole(self):
        """The library's own encoder, which few texts need."""
        if self._whole is None:
            from tokenizers import Tokenizer

            self._whole = Tokenizer.from_file(self.path)
        return self._whole

    def reset(self) -> None:
        self.table = Table()
        self.flat = np.zeros(1 << 16, np.int32)
        self.at = np.zeros(1 << 14, np.int64)
        self.size = np.zeros(1 << 14, np.int32)
        self.rows, self.fill = 0, 0

    def _store(self, encoded: list[list[int]]) -> np.ndarray:
        lens = np.fromiter(map(len, encoded), np.int32, len(encoded))
        need, total = self.rows + len(encoded), int(lens.sum())
        while need > len(self.at):
            self.at, self.size = np.concatenate([self.at, np.zeros_like(self.at)]), np.concatenate([self.size, np.zeros_like(self.size)])
        while self.fill + total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.fill : self.fill + total] = np.fromiter((i for ids in encoded for i in ids), np.int32, total)
        rows = np.arange(self.rows, need, dtype=np.int32)
        self.at[rows], self.size[rows] = self.fill + np.cumsum(lens) - lens, lens
        self.rows, self.fill = need, self.fill + total
        return rows

    def _singly(self, pieces: list[str]) -> list[list[int]]:
        """The ids of each pre-token. Those without inner white space go through one call, a line each."""
        lines = [k for k, p in enumerate(pieces) if not p[1:].isspace() and not p.isspace()]
        out = [None] * len(pieces)
        ids = self.single.encode_to_numpy("".join(f"{pieces[k]}\n" for k in lines), disallowed_special=())
        ends = np.flatnonzero(ids == self.newline)
        if len(ends) == len(lines):
            flat, at = ids.tolist(), 0
            for k, to in zip(lines, ends.tolist(), strict=True):
                out[k] = flat[at:to]
                at = to + 1
        return [self.single.encode_ordinary(p) if got is None else got for p, got in zip(pieces, out, strict=True)]

    def _rows(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The table row of each pre-token, and the number of pre-tokens of each text."""
        text = data.tobytes().decode("utf-8")
        cps = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        lead = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        bounds = lead[offsets]
        edge = np.zeros(len(cps) + 1, bool)
        edge[bounds] = True
        starts = np.flatnonzero(pretoken_starts(cps, edge))
        ends = np.append(starts[1:], len(cps))
        up, down = powers(len(cps) + 1)
        sums = np.zeros(len(cps) + 1, np.uint64)
        np.cumsum(mix64(cps.astype(np.uint64) + np.uint64(1)) * up[: len(cps)], out=sums[1:])
        keys = mix64((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
        rows = self.table.find(keys)
        missing = np.flatnonzero(rows < 0)
        if len(missing):
            fresh, first = np.unique(keys[missing], return_index=True)
            where = missing[first]
            got = self._store(self._singly([text[a:b] for a, b in zip(starts[where].tolist(), ends[where].tolist(), strict=True)]))
            self.table.add(fresh, got)
            rows[missing] = self.table.find(keys[missing])
        return rows, np.diff(np.searchsorted(starts, bounds))

    def encode(self, col: pa.Array, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """All ids and the offsets of each text's ids; end: an id after each text."""
        data, offsets = text_buffers(col)
        if self.rows > self.cache:
            self.reset()
        odd = self._odd(data, offsets)
        if len(odd):  # a special token's string becomes its id, which only the library's own rules decide
            keep = np.ones(len(offsets) - 1, bool)
            keep[odd] = False
            texts = [data[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8") for i in odd]
            special = self._store([e.ids for e in self.whole.encode_batch(texts, add_special_tokens=False)])
            lens = np.diff(offsets)
            data = data[np.repeat(keep, lens)]
            offsets = np.concatenate([[0], np.cumsum(np.where(keep, lens, 0))])
        rows, counts = self._rows(data, offsets)
        if len(odd):
            rows = np.insert(rows, np.cumsum(counts)[odd], special)
            counts[odd] = 1
        if end is not None:
            rows = np.insert(rows, np.cumsum(counts), self._store([[end]])[0])
            counts += 1
        lens = self.size[rows].astype(np.int64)
        to = np.cumsum(lens)
        total = int(to[-1]) if len(to) else 0
        ids = self.flat[np.arange(total) + np.repeat(self.at[rows] - (to - lens), lens)]
        edges = np.concatenate([[0], to])[np.concatenate([[0], np.cumsum(counts)])]
        return ids, edges

    def _odd(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The texts that hold a special token's string."""
        raw, hits = data.tobytes(), []
        for mark in self.marks:
            at = raw.find(mark)
            while at >= 0:
                hits.append(at)
                at = raw.find(mark, at + 1)
        return np.unique(np.searchsorted(offsets, hits, "right") - 1) if hits else np.zeros(0, np.int64)
