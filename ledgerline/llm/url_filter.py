"""URL filtering by a sorted digest array (operator 2).

Every list entry is a host suffix followed by a path prefix, such as
`example.com/en/`. The index file holds the entries' 64-bit xxhash keys in
order, their verdicts, and the full strings. Executors memory-map it, probe the
keys of all (host suffix, path prefix) forms of a batch that are no longer than
the longest entry's host and path by one binary search,
and compare the stored string, so equal digests of different strings never
match. Rules come before the list; of the rules that fit, and of the list
entries if no rule fits, the longest decides. What nothing fits is allowed.

The index lies in the shared folder (spark.checkpoint.dir) and is fetched by
SparkContext.addFile; its size is checked against max_bytes.

Null URLs and those without `://` have an empty host and path, fit no entry and
are allowed. Repeated rows give repeated results; other columns may be carried
by a join on the key. An empty table gives an empty result.
"""

from __future__ import annotations

import struct
import tempfile
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession

from ledgerline.llm.shared import publish, small_batches

Entry = tuple[str, str, str]  # host, path prefix, verdict
VERDICTS = ("allow", "block")
_LOWER = {c: c + 32 for c in range(65, 91)}
MAGIC = b"LLURLS02"
MAX_BYTES = 4 << 30


def entry_key(host: str, path: str) -> bytes:
    return f"{host}{path}".encode("utf-8", "surrogatepass")


def write_index(rules: Iterable[Entry], listed: Iterable[Entry], path: str, max_bytes: int = MAX_BYTES) -> None:
    """Of repeated entries, block wins. A verdict byte holds the rule's in its lower two bits and the list's in the next two; 0: none."""
    merged: dict[tuple[str, str], int] = {}
    for shift, entries in ((0, rules), (2, listed)):
        for host, prefix, verdict in entries:
            k = (host.translate(_LOWER), prefix)
            merged[k] = merged.get(k, 0) | (VERDICTS.index(verdict) + 1) << shift
    rows = sorted((xxhash.xxh64_intdigest(entry_key(*k)), entry_key(*k), len(k[0].encode()), v) for k, v in merged.items())
    n = len(rows)
    blob = b"".join(r[1] for r in rows)
    if n * 25 + len(blob) > max_bytes:
        raise ValueError(f"the URL list needs more than {max_bytes} bytes")
    depths = sorted({len(r[1]) - r[2] for r in rows})
    with open(path, "wb") as f:
        f.write(MAGIC + struct.pack("<QQQQ", n, len(blob), len(depths), max((r[2] for r in rows), default=0)))
        f.write(np.array(depths, "<u8").tobytes())
        f.write(np.array([r[0] for r in rows], "<u8").tobytes())
        f.write(np.concatenate([[0], np.cumsum([len(r[1]) for r in rows])]).astype("<u8").tobytes())
        f.write(np.array([r[2] for r in rows], "<u8").tobytes())
        f.write(np.array([r[3] for r in rows], "u1").tobytes())
        f.write(blob)


class Index:
    """A memory-mapped index file."""

    def __init__(self, path: str):
        raw = np.memmap(path, np.uint8, "r")
        if raw[:8].tobytes() != MAGIC:
            raise ValueError(f"{path} is no URL index")
        n, size, d, self.longest_host = struct.unpack("<QQQQ", raw[8:40].tobytes())
        at = 40
        parts = []
        for count, width in ((d, 8), (n, 8), (n + 1, 8), (n, 8), (n, 1), (size, 1)):
            part = raw[at : at + count * width]
            parts.append(part.view("<u8") if width == 8 else part)
            at += count * width
        depths, self.keys, self.at, self.host_size, self.verdict, self.blob = parts
        #: lengths in bytes of the path prefixes that occur
        self.depths = depths.tolist()

    def find(self, probes: list[tuple[bytes, int]]) -> np.ndarray:
        """The entry of each (key, bytes of its host), -1 where there is none."""
        digests = np.fromiter((xxhash.xxh64_intdigest(k) for k, _ in probes), np.uint64, len(probes))
        spot = np.searchsorted(self.keys, digests)
        out = np.full(len(probes), -1, np.int64)
        maybe = np.flatnonzero(spot < len(self.keys))
        maybe = maybe[self.keys[spot[maybe]] == digests[maybe]]
        for i in maybe.tolist():  # only digests that match; equal digests of other strings follow each other
            k, size = probes[i]
            at = int(spot[i])
            while at < len(self.keys) and self.keys[at] == digests[i]:
                if int(self.host_size[at]) == size and self.blob[int(self.at[at]) : int(self.at[at + 1])].tobytes() == k:
                    out[i] = at
                    break
                at += 1
        return out

    def text(self, at: int) -> str:
        return self.blob[int(self.at[at]) : int(self.at[at + 1])].tobytes().decode("utf-8", "surrogatepass")


def read_list(table: DataFrame) -> Iterator[Entry]:
    """The entries of a maintained list: host, and path and verdict where there are such columns (else, or null: no path, block). Rows without a host are no entries."""
    names = ("host", "path", "verdict")
    for r in table.select(*(c for c in names if c in table.columns)).where("host is not null and host != ''").toLocalIterator():
        told = r.asDict()
        yield told["host"], told.get("path") or "", told.get("verdict") or "block"


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path."""
    if url is None:
        return "", ""
    _, mark, rest = url.partition("://")
    if not mark:
        return "", ""
    end = min((at for at in map(rest.find, "/?#") if at >= 0), default=len(rest))
    host, rest = rest[:end].translate(_LOWER), rest[end:]
    end = min((at for at in map(rest.find, "?#") if at >= 0), default=len(rest))
    return host, rest[:end]


def suffixes(host: str, longest: int) -> Iterator[bytes]:
    """The host and what follows each of its dots, as far as `longest` bytes; only the end of a long host is copied."""
    raw = host[-longest - 1 :].encode("utf-8", "surrogatepass") if longest else b""  # a character has a byte or more
    if len(host) <= longest and 0 < len(raw) <= longest:
        yield raw
    at = raw.find(b".", max(0, len(raw) - longest - 1))
    while 0 <= at < len(raw) - 1:
        yield raw[at + 1 :]
        at = raw.find(b".", at + 1)


def judge(index: Index, urls: list[str | None]) -> tuple[list[str], list[str], list[str | None], list[str | None], list[str]]:
    """Hosts, paths, the deciding rule, the deciding list entry, and the verdict."""
    hosts, paths, probes, owner = [], [], [], []
    deepest = max(index.depths, default=0)  # a character has a byte or more
    for i, url in enumerate(urls):
        host, path = split_url(url)
        hosts.append(host)
        paths.append(path)
        raw = path[:deepest].encode("utf-8", "surrogatepass")
        for h in suffixes(host, index.longest_host):
            for depth in index.depths:
                if depth <= len(raw):
                    probes.append((h + raw[:depth], len(h)))
                    owner.append(i)
    found = index.find(probes)
    best = [{0: (-1, -1, -1), 2: (-1, -1, -1)} for _ in urls]
    for p in np.flatnonzero(found >= 0).tolist():
        at = int(found[p])
        for shift, top in best[owner[p]].items():
            if index.verdict[at] >> shift & 3:
                best[owner[p]][shift] = max(top, (len(probes[p][0]), probes[p][1], at))
    rules, listed, verdicts = [], [], []
    for top in best:
        rule, entry = top[0][2], top[2][2]
        rules.append(index.text(rule) if rule >= 0 else None)
        listed.append(index.text(entry) if rule < 0 <= entry else None)
        bits = index.verdict[rule] & 3 if rule >= 0 else index.verdict[entry] >> 2 & 3 if entry >= 0 else 1
        verdicts.append(VERDICTS[1] if bits & 2 else VERDICTS[0])
    return hosts, paths, rules, listed, verdicts


_OPEN: dict[str, Index] = {}


def filter_urls(spark: SparkSession, pages: DataFrame, rules: Iterable[Entry], listed: Iterable[Entry], key: str = "page_id", url: str = "url", max_bytes: int = MAX_BYTES) -> DataFrame:
    """key, host, path, rule and entry (what decides, else null), verdict (allow or block)."""
    small_batches(spark)
    with tempfile.NamedTemporaryFile(suffix=".urls") as f:
        write_index(rules, listed, f.name, max_bytes)
        name = publish(spark, f.name, "urls")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = SparkFiles.get(name)
        if path not in _OPEN:
            _OPEN[path] = Index(path)
        for batch in batches:
            told = judge(_OPEN[path], batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.string()) for x in told)], names=[key, "host", "path", "rule", "entry", "verdict"])

    kind = pages.schema[key].dataType.simpleString()
    return pages.select(key, url).mapInArrow(run, f"`{key}` {kind}, host string, path string, rule string, entry string, verdict string")
