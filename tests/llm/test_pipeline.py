"""Each stage of the pipeline against brute force on its own input."""

import hashlib

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline as cp
from ledgerline.llm import secrets, toxicity
from tests.conftest import SMALL
from tests.llm.test_operators import brute_base, brute_near, brute_passages


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns = docs.columns
    for k, (name, stage) in enumerate(cp.STAGES):
        stage(spark, docs, SMALL).write.parquet(f"{tmp_path}/{k}")
        after = spark.read.parquet(f"{tmp_path}/{k}")
        was = {r.doc_id: r.text for r in docs.collect()}
        if k < 4:
            assert after.columns == columns, name
            now = {r.doc_id: r.text for r in after.collect()}
        if name == "toxicity":
            told = toxicity.score(docs, toxicity.learn(docs, spark.read.parquet(f"{SMALL}/labels.parquet")))
            assert set(now) == {r.doc_id for r in told.collect() if r.predicted == 0} and now.items() <= was.items()
        elif name == "near duplicates":
            assert set(now) == {int(i) for i, _, c in brute_near(list(was.items()), 5) if int(i) == c} and now.items() <= was.items()
        elif name == "repeated passages":
            want = {int(i): t for i, _, _, t in brute_passages(list(was.items()))}
            assert {i: " ".join(t.split()) for i, t in now.items()} == {i: " ".join(t.split()) for i, t in want.items()}
        elif name == "secrets":
            assert set(now) == set(was) and all(brute_base(t) == "" for t in now.values())
            assert all(t == was[i] for i, t in now.items() if brute_base(was[i]) == "" and secrets.MORE_RULES and "[REDACTED]" not in t)
        else:
            rows = after.collect()
            assert {r.doc_id for r in rows} == set(was) and len({r.sequence_id for r in rows}) == len(rows)
        docs = after
    whole = cp.run(spark, SMALL).collect()
    digest = lambda rows: hashlib.sha256(str(sorted((r.doc_id, r.start, r.ids_crc32) for r in rows)).encode()).hexdigest()
    assert digest(whole) == digest(docs.collect())


DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def written(spark, tmp_path, rows, labels):
    spark.createDataFrame(rows, DOCUMENTS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality long, toxic long").write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path)


def test_odd_rows(spark, tmp_path):
    """Null and repeated keys, null, empty and very long texts, and labels of nothing."""
    prose = " ".join(f"w{k}" for k in range(300))
    passage, own = " ".join(f"w{k}" for k in range(60)), " ".join(f"y{k}" for k in range(200))
    rows = [(None, prose), (None, None), (1, None), (2, ""), (3, " \n"), (4, prose), (4, prose), (5, prose), (6, " ".join(f"x{k}" for k in range(120_000))), (7, f"token=abcdefgh12 {passage} {own}"), (8, "short")]
    d = written(spark, tmp_path, [(i, t, None, "s", None) for i, t in rows], [(4, None, 0), (None, 1, 1), (99, 0, None), (8, 1, 0)])
    packed = cp.run(spark, d).collect()
    counts = {}
    for r in packed:
        counts.setdefault(r.doc_id, []).append(r)
    assert set(counts) == {None, 1, 2, 3, 4, 6, 7, 8}  # 5 is a copy of 4; a null key is nobody's copy
    assert all(r.doc_tokens == 1 for k in (1, 2) for r in counts[k])
    assert sum(r.length for r in counts[6]) == counts[6][0].doc_tokens > 120_000
    assert len({r.sequence_id for r in packed}) == len(packed)
    # the passage that 7 shares with 4 goes from 7, whose secret is redacted
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert counts[7][0].doc_tokens == 1 + len(library.encode(f"[REDACTED] {own}", add_special_tokens=False).ids)


def test_empty_tables(spark, tmp_path):
    assert cp.run(spark, written(spark, tmp_path, [], [])).count() == 0
