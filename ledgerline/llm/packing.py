"""Packing tokenised documents by power-of-two decomposition (operator 3).

A document of n ids becomes n // longest pieces of the longest length and one
piece for each set bit of the remainder, longest first. Every piece is a
sequence of its own, and sequences are bucketed by length, so none crosses
documents and none needs padding. Narrow: one pass, no shuffle.

Null or empty text: one id (the end mark), so one piece of length 1. Repeated
rows and ids are packed each on its own. Other columns are ignored, whatever
their names. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.text import column, slices
from ledgerline.llm.tokens import ByteBPE

LONGEST = 2048
_ENCODERS: dict[str, ByteBPE] = {}


def encoder(path: str) -> ByteBPE:
    """One for each Python worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = ByteBPE(path)
    return _ENCODERS[path]


def decompose(lengths: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """The pieces of all documents in order: document's row, length."""
    bits = longest.bit_length() - 1
    whole = lengths >> bits
    docs, sizes = [np.repeat(np.arange(len(lengths)), whole)], [np.full(int(whole.sum()), longest, np.int64)]
    for k in range(bits - 1, -1, -1):
        own = np.flatnonzero((lengths >> k) & 1)
        docs.append(own)
        sizes.append(np.full(len(own), 1 << k, np.int64))
    doc, size = np.concatenate(docs), np.concatenate(sizes)
    order = np.argsort(doc, kind="stable")
    return doc[order], size[order]


def pack(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", longest: int = LONGEST, end_id: int = 1) -> DataFrame:
    """Sequences of the documents: key, start, length, doc_tokens, bucket (log2 of the length), sequence_id, token_ids.

    token_ids is the piece's ids as little-endian unsigned 32-bit integers.
    """
    if longest & (longest - 1) or longest < 1:
        raise ValueError("longest must be a power of two")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer).encode
        for batch in slices(batches, text, 2 << 20):
            ids, edges = encode(column(batch, text), end_id)
            lengths = np.diff(edges)
            doc, size = decompose(lengths, longest)
            to = np.cumsum(size)
            start = to - size - edges[:-1][doc]
            ids = ids.astype("<u4")
            raw = pa.py_buffer(ids)
            spots = (np.concatenate([[0], to]) * 4).astype(np.int32)
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(pa.array(doc)), pa.array(start), pa.array(size), pa.array(lengths[doc]),
                pa.array(np.log2(size).astype(np.int32)), pa.BinaryArray.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(spots), raw]),
            ], names=[key, "start", "length", "doc_tokens", "bucket", "token_ids"])

    kind = docs.schema[key].dataType.simpleString()
    out = docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, start long, length long, doc_tokens long, bucket int, token_ids binary")
    return out.withColumn("sequence_id", F.monotonically_increasing_id())


def write_buckets(sequences: DataFrame, path: str) -> None:
    """Sequences of equal length lie together, ready for batches without padding."""
    sequences.write.partitionBy("bucket").parquet(path)
