"""Scanning kernels, tokenizers and packing."""

import random
import re
import tempfile
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ledgerline.llm import packing, sentencepiece_np
from ledgerline.llm.text import WORD, Words, joined, spark_hash, text_buffers, windows, within
from ledgerline.llm.tokens import ByteBPE
from tests.conftest import SMALL

BPE, PIECES = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
ODD = st.text(alphabet=st.sampled_from("ab 's\t\nrelté1½!漢😀\u3000\x1c\u2581"), max_size=30)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), ODD), max_size=6))
def test_words(texts):
    w = Words(*text_buffers(pa.array(texts, pa.string())), lower=True)
    got = [[w.data[a:b].tobytes().decode() for a, b in zip(w.starts[i:j], w.ends[i:j], strict=True)] for i, j in zip(w.bounds[:-1], w.bounds[1:], strict=True)]
    assert got == [re.findall(WORD, t or "") for t in texts]
    flat = [x.lower() if x.isascii() else x for row in got for x in row]
    assert len(set(w.hashes.tolist())) == len({"".join(c.lower() if c.isascii() else c for c in x) for x in flat})
    assert joined(w, np.ones(len(w), bool)) == [" ".join(row).encode() for row in got]
    sizes = [len(row) for row in got]
    assert len(within(w.bounds, 3)) == sum(max(0, n - 2) for n in sizes)
    assert len(windows(w.hashes, 3)) == max(0, sum(sizes) - 2)


def test_bucket_hash_is_sparks(spark):
    q = spark.range(-50, 50).select("id", F.pmod(F.xxhash64("id"), F.lit(77)).alias("b")).toPandas()
    assert (spark_hash(q.id.to_numpy(), 77) == q.b.to_numpy()).all()


@pytest.fixture(scope="module")
def encoders():
    return ByteBPE(BPE), Tokenizer.from_file(BPE)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), ODD, ODD.map(lambda t: t + "<|endoftext|>x")), min_size=1, max_size=6))
def test_byte_bpe(encoders, texts):
    own, library = encoders
    ids, edges = own.encode(pa.array(texts, pa.string()), 1)
    want = [e.ids + [1] for e in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert [ids[a:b].tolist() for a, b in zip(edges[:-1], edges[1:], strict=True)] == want


def test_byte_bpe_on_every_kind_of_character(encoders):
    own, library = encoders
    texts = [f"a{chr(c)}b {chr(c)}1" for c in range(1, 0x3200)]
    ids, edges = own.encode(pa.array(texts))
    assert [ids[a:b].tolist() for a, b in zip(edges[:-1], edges[1:], strict=True)] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def same_pieces(model, library, texts):
    ids, edges = model.encode(pa.array(texts, pa.string()))
    got = [ids[a:b].tolist() for a, b in zip(edges[:-1], edges[1:], strict=True)]
    assert got == [library.encode(t or "") for t in texts]
    assert model.decode(ids.astype(np.int64), edges) == [library.decode(g) for g in got]


@pytest.fixture(scope="module")
def pieces():
    return sentencepiece_np.Model(PIECES), sentencepiece.SentencePieceProcessor(model_file=PIECES)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), ODD), min_size=1, max_size=6))
def test_sentencepiece_bpe(pieces, texts):
    same_pieces(*pieces, texts)


def test_sentencepiece_bpe_long_units(pieces):
    random.seed(3)
    same_pieces(*pieces, ["".join(random.choice("thein") for _ in range(n)) for n in (47, 48, 49, 400, 3000)])


def test_sentencepiece_unigram_by_viterbi():
    """The same pieces taken for a unigram model. Texts are short: the library sums in single precision."""
    with open(PIECES, "rb") as f:
        raw = f.read()
    at = raw.rindex(b"\x18\x02 \x80\xfa\x01")  # model_type and vocab_size of the trainer's fields
    with tempfile.NamedTemporaryFile(suffix=".model") as f:
        f.write(raw[:at] + b"\x18\x01" + raw[at + 2 :])
        f.flush()
        model, library = sentencepiece_np.Model(f.name), sentencepiece.SentencePieceProcessor(model_file=f.name)
        assert model.kind == sentencepiece_np.UNIGRAM
        random.seed(5)
        for _ in range(300):
            text = "".join(random.choice(["th", "ing", " ", "é", "a", "tion", "q", "\n", "1", "漢"]) for _ in range(random.randint(1, 8)))
            (mine, _), theirs = model.encode(pa.array([text])), library.encode(text)
            total = lambda ids: sum(model.scores[i] if model.types[i] == sentencepiece_np.NORMAL else 0 for i in ids)
            assert mine.tolist() == theirs or (total(mine.tolist()) == total(theirs) and model.decode(mine.astype(np.int64), np.array([0, len(mine)])) == [text])


def test_sentencepiece_round_trip(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    back = sentencepiece_np.decode(sentencepiece_np.encode(docs, PIECES), PIECES)
    assert back.join(docs.select("doc_id", F.col("text").alias("was")), "doc_id").where("text <> was").count() == 0


def test_sentencepiece_on_odd_rows(spark):
    odd = [(None, "a b", 1, "x"), (1, None, 2, "y"), (1, "", 3, "z"), (2, "the cat " * 9000, 4, "w"), (2, " lead\ttab ", 5, "v")]
    docs = spark.createDataFrame(odd, "doc_id long, text string, n_ids int, ids string")
    made = sentencepiece_np.encode(docs, PIECES)
    back = sentencepiece_np.decode(made, PIECES).collect()
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    assert sorted((str(r.doc_id), r.n_ids) for r in back) == sorted((str(i), len(library.encode(t or ""))) for i, t, *_ in odd)
    assert sorted(r.text for r in back) == sorted(library.decode(library.encode(t or "")) for _, t, *_ in odd)
    assert sentencepiece_np.decode(sentencepiece_np.encode(docs.limit(0), PIECES), PIECES).count() == 0


def test_packing(spark):
    odd = [(1, None, 5), (1, None, 5), (2, "", 5), (None, "x y", 5), (3, "the cat " * 9000, 5)]
    docs = spark.createDataFrame(odd, "doc_id long, text string, start long")
    got = packing.pack(docs, BPE).collect()
    library = Tokenizer.from_file(BPE)
    want = sorted((str(k), i) for k, t, _ in odd for i in library.encode(t or "", add_special_tokens=False).ids + [1])
    assert sorted((str(r.doc_id), int(i)) for r in got for i in np.frombuffer(r.token_ids, "<u4")) == want
    assert len({r.sequence_id for r in got}) == len(got)
    assert all(r.length == len(r.token_ids) // 4 == 1 << r.bucket <= 2048 for r in got)
    big = sorted((r.start, r.length) for r in got if r.doc_id == 3)
    assert all(a + n == b for (a, n), (b, _) in zip(big, big[1:], strict=False)) and big[0][0] == 0
    assert packing.pack(docs.limit(0), BPE).count() == 0


def test_packing_digest(spark):
    docs = spark.createDataFrame([(7, "hello world")], "doc_id long, text string")
    r = packing.pack(docs, BPE).orderBy("start").select(F.crc32("token_ids").alias("c"), "token_ids").first()
    assert r.c == zlib.crc32(bytes(r.token_ids))
