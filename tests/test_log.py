"""Store, engine, codec, framing and streaming against small models."""

import collections
import hashlib
import itertools

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerline.engine import EventLog, migrate
from ledgerline.functions import codec
from ledgerline.operators import append, control, framing
from ledgerline.schema import RECORDS, STREAM_NAMES, Limits, LogError
from ledgerline.sources.store import Store
from ledgerline.streaming.subscribe import follow, framed, subscribe

REQUEST = "seq long, stream_id string, event_id string, schema_id string, schema_version long, payload binary"


def requests(spark, *rows):
    return spark.createDataFrame([(k, s, e, "test.bytes", 1, p) for k, (s, e, p) in enumerate(rows)], REQUEST)


def test_append_read_and_reopen(spark, tmp_path):
    with Store(spark, f"file://{tmp_path}/log", create=True) as store:
        log = EventLog(store)
        assert log.create(["a", "b", ""]).where("error is null").count() == 2
        first = requests(spark, ("a", "1", b"x"), ("a", "1", b"x"), ("a", "1", b"y"), ("a", "2", b"\x00\xff"), ("gone", "1", b"z"))
        got = [(r.seq, r.outcome, r.error_code, r.offset) for r in log.append(first, "op-1").orderBy("seq").collect()]
        want = [(0, "Inserted", None, 1), (1, "Deduplicated", None, 1), (2, None, "IdempotencyConflict", None), (3, "Inserted", None, 2), (4, None, "StreamUnavailable", None)]
        assert got == want
        again = [(r.seq, r.outcome, r.error_code, r.offset) for r in log.append(first, "op-1").orderBy("seq").collect()]
        assert again == want and log.records().count() == 2
        with pytest.raises(LogError, match="StoreInUse"):
            Store(spark, f"file://{tmp_path}/log").acquire()
    with Store(spark, f"file://{tmp_path}/log") as store:
        log = EventLog(store, Limits(page_records=1))
        cursors = spark.createDataFrame([("a", 0, None), ("b", 0, None)], "stream_id string, after long, through long")
        page, summary = log.read_after(cursors)
        assert [bytes(r.payload) for r in page.collect()] == [b"x"]
        assert {(r.stream_id, r.next_after, r.complete, r.error) for r in summary.collect()} == {("a", 1, False, None), ("b", 0, True, None)}
        more = log.append(requests(spark, ("a", "2", b"\x00\xff"), ("a", "3", b"n")), "op-2").orderBy("seq").collect()
        assert [(r.outcome, r.offset) for r in more] == [("Deduplicated", 2), ("Inserted", 3)]
        own = log.names().where("stream_id = 'a'").first().incarnation
        asked = spark.createDataFrame([("l-1", "a", "Reset", own)], "operation_id string, stream_id string, action string, expected binary")
        assert log.change_lifecycle(asked).first().outcome == "Reset"
        assert log.change_lifecycle(asked).first().outcome == "Reset"  # the receipt again, no second reset
        assert log.records().count() == 0


def test_commit_needs_the_lock_and_a_known_format(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s", create=True)
    with pytest.raises(LogError, match="NotOwner"):
        store.commit({}, "x")
    with pytest.raises(LogError, match="StoreNotFound"):
        Store(spark, f"file://{tmp_path}/none")
    with pytest.raises(LogError, match="InvalidConfig"):
        Limits(page_records=0)


def test_subscription_resumes_without_gap_or_repeat(spark, tmp_path):
    seen = []
    take = lambda df, _: seen.extend((r.stream_id, r.offset) for r in df.orderBy("stream_id", "offset").collect())
    with Store(spark, f"file://{tmp_path}/log", create=True) as store:
        log = EventLog(store)
        log.create(["a", "b"])
        log.append(requests(spark, ("a", "1", b"x"), ("a", "2", b"x")))
        subscribe(store, take, f"file://{tmp_path}/cp", once=True).awaitTermination()
        log.append(requests(spark, ("b", "1", b"x"), ("a", "3", b"x")))
        subscribe(store, take, f"file://{tmp_path}/cp", once=True).awaitTermination()
        subscribe(store, take, f"file://{tmp_path}/cp", once=True).awaitTermination()
    assert sorted(seen) == [("a", 1), ("a", 2), ("a", 3), ("b", 1)] and len(seen) == 4


def test_a_subscription_starts_and_ends(spark, tmp_path):
    with Store(spark, f"file://{tmp_path}/log", create=True) as store:
        log = EventLog(store)
        log.create(["a", "b"])
        log.append(requests(spark, ("a", "1", b"x"), ("a", "2", b"x"), ("b", "1", b"x")))
        seen = {"Beginning": [], "Future": [], "After": []}

        def run(start, **how):
            take = lambda df, _: seen[start].extend(r.offset for r in df.orderBy("offset").collect())
            follow(log, "a", take, f"file://{tmp_path}/{start}", start, once=True, **how).awaitTermination()

        for start, how in (("Beginning", {}), ("Future", {}), ("After", {"cursor": 1})):
            run(start, **how)
        with pytest.raises(LogError, match="CursorAhead"):
            follow(log, "a", print, f"file://{tmp_path}/x", "After", cursor=9)
        with pytest.raises(LogError, match="StreamUnavailable"):
            follow(log, "none", print, f"file://{tmp_path}/y")
        log.append(requests(spark, ("a", "3", b"x"), ("b", "2", b"x")))
        for start, how in (("Beginning", {}), ("Future", {}), ("After", {"cursor": 1})):
            run(start, **how)
        assert seen == {"Beginning": [1, 2, 3], "Future": [3], "After": [2, 3]}
        # a floor above what was delivered ends the reader that lags, not the others
        log.append(requests(spark, ("a", "4", b"x"), ("a", "5", b"x")))
        run("Future")
        log.set_generations(spark.createDataFrame([("a", None)], "stream_id string, expected_current long"))
        log.advance_floors(spark.createDataFrame([("a", 0, 4)], "stream_id string, expected_floor long, new_floor long"))
        with pytest.raises(Exception, match="SubscriberLagged"):
            run("Beginning")
        run("Future")
        assert seen["Future"] == [3, 4, 5] and seen["Beginning"] == [1, 2, 3]
        # so does another lifetime
        own = log.names().where("stream_id = 'a'").first().incarnation
        log.change_lifecycle(spark.createDataFrame([("l-1", "a", "Reset", own)], "operation_id string, stream_id string, action string, expected binary"))
        with pytest.raises(Exception, match="StaleIncarnation"):
            run("Future")


def test_golden_token_and_full_range(spark):
    inc = bytes(range(16))
    rows = [("orders", inc, str(o)) for o in (0, 1, 2**63 - 1, 2**63, 2**64 - 1)] + [("é" * 128, inc, "7")]
    df = spark.createDataFrame(rows, "s string, i binary, o string").select("s", "i", F.col("o").cast(codec.U64).alias("o"))
    made = df.select("s", "o", codec.encode_token(F.col("s"), F.col("i"), F.col("o"), wide=True).alias("t")).cache()
    assert made.where(f"s = 'orders' and o = {2**64 - 1}").first().t == "esc_010000066f7264657273000102030405060708090a0b0c0d0e0fffffffffffffffff"
    for r in made.select("s", "o", codec.decode_token(F.col("t")).alias("d")).collect():
        assert (r.d.error, r.d.stream_id, r.d.incarnation, r.d.offset) == (None, r.s, inc.hex(), r.o)


def test_malformed_tokens_are_refused(spark):
    good = "esc_010000066f7264657273000102030405060708090a0b0c0d0e0fffffffffffffffff"
    bad = [good[:k] for k in range(len(good))] + [good + "0", good.upper(), good.replace("66f", "6ff"), "x" * 72, None, good.replace("6f7264657273", "ff7264657273")]
    df = spark.createDataFrame([(b,) for b in bad], "t string")
    assert df.select(codec.decode_token(F.col("t")).alias("d")).where("d.error is null").count() == 0


RAW = b"a\r\n\n\xff\xef\xbb\xbfz"


def frames(chunks, **how):
    f = framing.Framer(how.get("max_bytes", 1 << 20), how.get("crlf", framing.STRIP), how.get("empties", True), how.get("final", framing.EMIT))
    return [x for c in chunks for x in f.push(c)] + f.finish()


def test_frames_do_not_depend_on_the_cuts():
    want = [(0, 0, b"a", None), (1, 3, b"", None), (2, 4, b"\xff\xef\xbb\xbfz", None)]
    for cuts in itertools.chain.from_iterable(itertools.combinations(range(1, len(RAW)), k) for k in range(len(RAW))):
        edges = [0, *cuts, len(RAW)]
        assert frames([RAW[a:b] for a, b in zip(edges, edges[1:], strict=False)]) == want


def test_frame_policies():
    assert frames([b"x\r\n\n"], crlf=framing.PRESERVE, empties=False) == [(0, 0, b"x\r", None)]
    assert frames([b"tail"], final=framing.REJECT) == [(None, 0, None, "truncated_input")]
    assert frames([b"abc\n"], max_bytes=2) == [(None, 2, None, "frame_too_large")]
    assert frames([b"a\r\r\n"]) == [(0, 0, b"a\r", None)]


@settings(max_examples=8, deadline=None)
@given(st.lists(st.text(alphabet="ab\r\n", max_size=12), min_size=1, max_size=6), st.booleans(), st.sampled_from([3, 1 << 20]))
def test_native_and_byte_framers_agree(spark, texts, empties, limit):
    df = spark.createDataFrame(list(enumerate(texts)), "k long, t string")
    native = {(r.k, r.item_index, r.source_byte, r.frame, r.error) for r in framing.newline_frames(df, "k", "t", max_bytes=limit, empties=empties).collect()}
    model = {(k, i, b, f.decode() if f is not None else None, e) for k, t in enumerate(texts) for i, b, f, e in frames([t.encode()], empties=empties, max_bytes=limit)}
    assert native == model


def test_rows_that_repeat_a_key_are_framed_apart(spark):
    df = spark.createDataFrame([(1, "ab\ncd"), (1, "x\ny"), (2, None), (3, ""), (4, "\n" * 20_000)], "k long, t string")
    made = framing.newline_frames(df, "k", "t")
    got = sorted((r.k, r.item_index, r.source_byte, r.frame) for r in made.where("k < 4").collect())
    assert got == [(1, 0, 0, "ab"), (1, 0, 0, "x"), (1, 1, 2, "y"), (1, 1, 3, "cd")]
    assert made.where("k = 4").agg(F.count("*"), F.max("source_byte"), F.max("item_index")).first()[:] == (20_000, 19_999, 19_999)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan


def test_stateful_framing_stream(spark, tmp_path):
    for k, rows in enumerate([[("s", 0, b"ab\ncd", False), ("t", 0, b"q", True)], [("s", 5, b"e\n", True)]]):
        spark.createDataFrame(rows, "source_id string, start long, bytes binary, eof boolean").coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    out = []
    stream = spark.readStream.schema("source_id string, start long, bytes binary, eof boolean").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    keep = lambda df, _: out.extend((r.source_id, r.item_index, bytes(r.frame)) for r in df.collect())
    framed(stream).writeStream.foreachBatch(keep).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()
    assert sorted(out) == [("s", 0, b"ab"), ("s", 1, b"cde"), ("t", 0, b"q")]


@settings(max_examples=6, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("ab"), st.sampled_from("123"), st.sampled_from([b"p", b"q"])), min_size=1, max_size=30))
def test_resolve_equals_a_model(spark, rows):
    held, tails, want = {}, {"a": 0, "b": 0}, []
    for s, e, p in rows:
        if (s, e) not in held:
            tails[s] += 1
            held[s, e] = (p, tails[s])
            want.append(("Inserted", None, tails[s]))
        elif held[s, e][0] == p:
            want.append(("Deduplicated", None, held[s, e][1]))
        else:
            want.append((None, "IdempotencyConflict", None))
    empty = spark.createDataFrame([], "stream_id string, event_id string, schema_id string, schema_version long, payload binary, offset long")
    zero = spark.createDataFrame([("a", 0), ("b", 0)], "stream_id string, tail long")
    got = append.resolve(requests(spark, *rows), empty, zero).orderBy("seq").collect()
    assert [(r.outcome, r.error_code, r.offset) for r in got] == want


def test_replay_of_operations_and_upload_states(spark):
    asked = spark.createDataFrame([("1", "a"), ("2", "b"), ("3", "c")], "operation_id string, request string")
    seen = spark.createDataFrame([("1", "a", "done"), ("2", "other", "done")], "operation_id string, request string, receipt string")
    assert {(r.operation_id, r.replay) for r in control.replayed(asked, seen).collect()} == {("1", "Replayed"), ("2", "OperationConflict"), ("3", None)}
    states = spark.createDataFrame([("Uploading", "put"), ("Uploading", "publish"), ("Verified", "publish"), ("Published", "abort"), ("Verifying", "mismatch")], "s string, e string")
    assert [r[0] for r in states.select(control.upload_state(F.col("s"), F.col("e"))).collect()] == ["Uploading", None, "Published", None, "ChecksumMismatch"]


def test_snapshot_floor_and_recovery(spark, tmp_path):
    with Store(spark, f"file://{tmp_path}/log", create=True) as store:
        log = EventLog(store)
        log.create(["a"])
        log.append(requests(spark, ("a", "1", b"opened"), ("a", "2", b"approved"), ("a", "3", b"completed")))
        state, name = b"opened|approved", bytes(range(16))
        chunks = spark.createDataFrame([(k, state[k : k + 3]) for k in range(0, len(state), 3)], "offset long, bytes binary")
        with pytest.raises(LogError, match="CursorAhead"):
            log.upload_snapshot(name, "a", 4, chunks, hashlib.sha256(state).digest())
        with pytest.raises(LogError, match="ChunkGap"):
            log.upload_snapshot(name, "a", 2, chunks.where("offset <> 3"), hashlib.sha256(state).digest())
        assert log.upload_snapshot(bytes(16), "a", 2, chunks, bytes(32)) == "ChecksumMismatch"
        assert log.upload_snapshot(name, "a", 2, chunks, hashlib.sha256(state).digest()) == "Verified"
        with pytest.raises(LogError, match="SnapshotConflict"):
            log.upload_snapshot(name, "a", 1, chunks, hashlib.sha256(state).digest())
        assert log.move_snapshot(name, "publish") == log.move_snapshot(name, "publish") == "Published"
        with pytest.raises(LogError, match="InvalidTransition"):
            log.move_snapshot(name, "abort")
        asked = spark.createDataFrame([("a", 0, 3)], "stream_id string, expected_floor long, new_floor long")
        assert log.advance_floors(asked).first().error == "RetryPolicyRequired"
        assert log.set_generations(spark.createDataFrame([("a", None)], "stream_id string, expected_current long")).first().current_after == 1
        lease = log.acquire_recovery(name, 60_000)
        assert (lease["covered"], lease["through"]) == (2, 3)
        assert log.advance_floors(asked).first().error == "RecoveryProtectionActive"
        asked = spark.createDataFrame([("a", 0, 2)], "stream_id string, expected_floor long, new_floor long")
        assert log.advance_floors(asked).first().error is None
        assert log.bounds().first().asDict() == {"stream_id": "a", "floor": 2, "tail": 3}
        got, suffix = log.recover(name)
        assert b"".join(bytes(r.bytes) for r in got.orderBy("offset").collect()) == state
        assert [bytes(r.payload) for r in suffix.collect()] == [b"completed"]
        more = requests(spark, ("a", "3", b"completed"), ("a", "1", b"opened"), ("a", "4", b"closed"))
        assert {r.error_code for r in log.append(more).collect()} == {"RetryPolicyRequired"}
        again = log.append_generated(more.withColumn("generation", F.expr("CASE WHEN seq = 2 THEN 1 ELSE 0 END").cast("long"))).orderBy("seq").collect()
        assert [(r.outcome, r.offset) for r in again] == [("Deduplicated", 3), ("Deduplicated", 1), ("Inserted", 4)]  # below the floor, but its generation is accepted
        assert log.cleanup() == 0
        log.release_recovery(lease["lease_id"])
        assert log.expire_generations(spark.createDataFrame([("a", 0, 1)], "stream_id string, expected_oldest long, retain_from long")).first().error is None
        assert log.cleanup() == 2 and store.vacuum() > 0
        asked = spark.createDataFrame([("a", 2, 4)], "stream_id string, expected_floor long, new_floor long")
        assert log.advance_floors(asked).first().error is None and log.bounds().first().asDict() == {"stream_id": "a", "floor": 4, "tail": 4}
        late = spark.createDataFrame([(0, "a", 0, "1", "test.bytes", 1, b"opened"), (1, "a", 2, "9", "test.bytes", 1, b"x")], "seq long, stream_id string, generation long, event_id string, schema_id string, schema_version long, payload binary")
        assert [r.error_code for r in log.append_generated(late).orderBy("seq").collect()] == ["RetryGenerationExpired", "RetryGenerationAhead"]
        EventLog(store, audit=True)


class Stopped(Exception):
    """A writer that dies."""


@pytest.mark.parametrize("step", ["written", "claimed", "renamed"])
def test_a_dead_writer_blocks_nobody(spark, tmp_path, step):
    now = [1000]
    path = f"file://{tmp_path}/log"
    dead = Store(spark, path, create=True, lease_ms=500, clock=lambda: now[0]).acquire()
    log = EventLog(dead)
    log.create(["a"])
    log.append(requests(spark, ("a", "1", b"x")), "op-1")

    def stop(at):
        if at == step:
            raise Stopped(at)

    dead._reached = stop
    with pytest.raises(Stopped):
        log.append(requests(spark, ("a", "2", b"y")), "op-2")
    with pytest.raises(LogError, match="StoreInUse"):
        Store(spark, path, lease_ms=500, clock=lambda: now[0]).acquire()
    now[0] += 501
    with Store(spark, path, lease_ms=500, clock=lambda: now[0]) as store:
        again = EventLog(store, audit=True)
        got = again.append(requests(spark, ("a", "2", b"y")), "op-2").first()
        assert (got.outcome, got.offset) == ("Inserted", 2)
        assert again.append(requests(spark, ("a", "3", b"z"))).first().offset == 3 and again.records().count() == 3
        dead._reached = lambda at: None
        with pytest.raises(LogError, match="NotOwner"):  # its term is over
            log.append(requests(spark, ("a", "4", b"w")), "op-4")
        assert EventLog(store).records().count() == 3


def test_a_writer_that_lost_its_claim_does_not_commit(spark, tmp_path):
    now = [1000]
    path = f"file://{tmp_path}/log"
    slow = Store(spark, path, create=True, lease_ms=500, clock=lambda: now[0]).acquire()

    def overtaken(at):
        if at == "claimed":
            now[0] += 501
            with Store(spark, path, lease_ms=500, clock=lambda: now[0]) as store:
                store.commit({"t": spark.createDataFrame([(2,)], "v long")}, "second")

    slow._reached = overtaken
    with pytest.raises(LogError, match="NotOwner"):
        slow.commit({"t": spark.createDataFrame([(1,)], "v long")}, "first")
    store = Store(spark, path)
    assert [c["operation_id"] for c in store.commits()] == ["second"]


def test_commits_are_read_from_checkpoints_and_compactions(spark, tmp_path):
    path = f"file://{tmp_path}/log"
    schema = "k long, v long"
    from ledgerline.sources import store as stores

    with Store(spark, path, create=True) as store:
        from pyspark.sql.types import StructType

        kind = StructType.fromDDL(schema)
        for v in range(stores.CHECKPOINT + 2):
            store.commit({"t": spark.createDataFrame([(v % 3, v)], schema)}, f"op-{v}")
        want = {r.k: r.v for r in store.latest("t", kind, ["k"]).collect()}
        assert store.compact("t", kind, ["k"]) is not None and store.vacuum() == stores.CHECKPOINT + 2
        fresh = Store(spark, path)
        assert {r.k: r.v for r in fresh.latest("t", kind, ["k"]).collect()} == want == {0: 33, 1: 31, 2: 32}
        store.commit({"t": spark.createDataFrame([(0, 99)], schema)}, "last")
        assert {r.k: r.v for r in Store(spark, path).latest("t", kind, ["k"]).collect()}[0] == 99
        assert Store(spark, path).commits()[3]["operation_id"] == "op-3"


def test_migration_keeps_bytes_and_adds_tails(spark, tmp_path):
    path = f"file://{tmp_path}/log"
    with Store(spark, path, create=True) as store:
        store.commit({"stream_names": spark.createDataFrame([("a", bytes(16), True)], STREAM_NAMES)}, "names")
        rows = [("a", bytes(16), k, 0, f"e{k}", "s", 1, bytes([k, 255])) for k in (1, 2)]
        store.commit({"records": spark.createDataFrame(rows, RECORDS)}, "records")
        store.format = 1  # as a store of format 1 is opened
        with pytest.raises(LogError, match="MigrationRequired"):
            EventLog(store)
        log = migrate(store)
        assert log.bounds().first().asDict() == {"stream_id": "a", "floor": 0, "tail": 2}
        more = spark.createDataFrame([(0, "a", "e2", "s", 1, bytes([2, 255])), (1, "a", "e1", "s", 1, b"other"), (2, "a", "e3", "s", 1, b"")], REQUEST)
        assert [(r.outcome, r.error_code, r.offset) for r in log.append(more).orderBy("seq").collect()] == [("Deduplicated", None, 2), (None, "IdempotencyConflict", None), ("Inserted", None, 3)]
        assert sorted(bytes(r.payload) for r in log.records().collect()) == [b"", b"\x01\xff", b"\x02\xff"]


def test_the_log_is_never_the_build_side(spark):
    """A few requests against a long log: it is read once, cut down by a broadcast of the batch, and hashed after that."""
    log = spark.range(100_000).selectExpr("cast(id % 100 as string) stream_id", "cast(id as string) event_id", "'test.bytes' schema_id", "1L schema_version", "cast('p' as binary) payload", "id offset")
    tails = spark.createDataFrame([("1", 999)], "stream_id string, tail long")
    told = append.resolve(requests(spark, ("1", "101", b"p"), ("1", "102", b"q")), log, tails, n_requests=2)
    assert [(r.outcome, r.offset) for r in told.orderBy("seq").collect()] == [("Deduplicated", 101), ("Inserted", 1000)]
    plan = told._jdf.queryExecution().optimizedPlan().toString()
    lines = plan.splitlines()
    semi = next(k for k, x in enumerate(lines) if "LeftSemi" in x)
    assert "strategy=broadcast" in lines[semi] or "rightHint" in lines[semi]
    scan = next(k for k, x in enumerate(lines) if "Range (0, 100000" in x)
    assert semi < scan and not any("sha2" in x for x in lines[semi:scan])


@pytest.mark.parametrize("few", [10, 100_000])
def test_generated_requests_equal_a_model(spark, monkeypatch, few):
    """Refused, too large and legacy requests against a held log: one walk in order of seq, in large batches and small."""
    monkeypatch.setattr(append, "FEW", few)
    monkeypatch.setattr(append, "ROWS", 100, raising=False)
    kinds = list(itertools.product("abz", (0, 1, 2, 3, 4), "12", (b"p", b"q", b"x" * 400)))
    asked = [(k, *kinds[k * 37 % len(kinds)]) for k in range(500)]
    held = {("a", 0, "1"): (b"p", 1), ("a", 1, "2"): (b"q", 2), ("b", 2, "1"): (b"p", 1), ("b", 0, "2"): (b"q", 2)}
    log = spark.createDataFrame([(s, g, e, "s", 1, p, o) for (s, g, e), (p, o) in held.items()], "stream_id string, generation long, event_id string, schema_id string, schema_version long, payload binary, offset long")
    streams = spark.createDataFrame([("a", 2, 0, 3), ("b", 2, 2, 3), ("idle", 7, 0, 1)], "stream_id string, tail long, oldest long, current long")
    want, tails, oldest = [], {"a": 2, "b": 2}, {"a": 0, "b": 2}
    for k, s, g, e, p in asked:
        if s not in tails:
            continue
        if g < oldest[s] or g > 3:
            told = (None, "RetryGenerationExpired" if g < oldest[s] else "RetryGenerationAhead", None)
        elif g == 0 and (s, g, e) not in held:
            told = (None, "LegacyRetryNotFound", None)
        elif len(p) + len(e) + 1 + 128 > 300:
            told = (None, "CapacityExceeded", None)
        elif (s, g, e) not in held:
            tails[s] += 1
            held[s, g, e] = (p, tails[s])
            told = ("Inserted", None, tails[s])
        else:
            told = ("Deduplicated", None, held[s, g, e][1]) if held[s, g, e][0] == p else (None, "IdempotencyConflict", None)
        want.append((k, *told))
    requests = spark.createDataFrame([(k, s, g, e, "s", 1, p) for k, s, g, e, p in asked], "seq long, stream_id string, generation long, event_id string, schema_id string, schema_version long, payload binary")
    got = append.resolve_generated(requests, log, streams, 300).orderBy("seq").collect()
    assert [(r.seq, r.outcome, r.error_code, r.offset) for r in got] == want
    assert {r[2] for r in want} >= {"LegacyRetryNotFound", "CapacityExceeded", "RetryGenerationExpired", "RetryGenerationAhead", "IdempotencyConflict", None}


@pytest.mark.parametrize("generated", [False, True])
def test_tasks_of_large_batches_grow_in_number(spark, monkeypatch, generated):
    """However well the rows compress, a task gets a bounded number of requests, whatever partitions the other tables come in."""
    monkeypatch.setattr(append, "FEW", 100)
    monkeypatch.setattr(append, "ROWS", 500, raising=False)
    asked = spark.range(8000).selectExpr("id seq", "cast(id % 800 as string) stream_id", "1L generation", "cast(id as string) event_id", "'s' schema_id", "1L schema_version", "cast('p' as binary) payload")
    log = spark.createDataFrame([("1", 1, "801", "s", 1, b"p", 1)], "stream_id string, generation long, event_id string, schema_id string, schema_version long, payload binary, offset long")
    streams = asked.groupBy("stream_id").agg(F.expr("CASE WHEN stream_id = '1' THEN 1L ELSE 0L END tail"), F.lit(0).cast("long").alias("oldest"), F.lit(1).cast("long").alias("current"))
    told = append.resolve_generated(asked, log, streams) if generated else append.resolve(asked, log, streams.select("stream_id", "tail"))
    rows = told.withColumn("task", F.spark_partition_id()).collect()
    assert len(rows) == 8000 and [(r.outcome, r.offset) for r in rows if r.seq == 801] == [("Deduplicated", 1)]
    most = max(collections.Counter(r.task for r in rows).values())
    assert most < 2 * 500


def test_counts_since_opening(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/log", create=True).acquire()
    log = EventLog(store, Limits(batch_events=3, persistence="ProcessRestart"))
    log.create(["a"])
    log.append(requests(spark, ("a", "1", b"x"), ("a", "1", b"x"), ("a", "1", b"y")))
    with pytest.raises(LogError, match="CapacityExceeded"):
        log.append(requests(spark, *[("a", str(k), b"x") for k in range(4)]))
    assert log.diagnostics()["accepts_writes"]
    report = log.close()
    assert report == {"lifecycle": "Closed", "persistence": "ProcessRestart", "accepts_writes": False, "append_accepted": 3, "append_inserted": 1, "append_deduplicated": 1, "append_failed": 1, "append_rejected": 4}
    with pytest.raises(LogError, match="Closed"):
        log.append(requests(spark, ("a", "9", b"x")))
    with pytest.raises(LogError, match="InvalidConfig"):
        Limits(persistence="Forever")
    with Store(spark, f"file://{tmp_path}/log") as again:
        assert EventLog(again).diagnostics()["append_accepted"] == 0


def test_tokens_of_other_lifetimes_and_streams_are_refused(spark, tmp_path):
    with Store(spark, f"file://{tmp_path}/log", create=True) as store:
        log = EventLog(store)
        log.create(["a", "b"])
        log.append(requests(spark, ("a", "1", b"x"), ("a", "2", b"y"), ("b", "1", b"z")))
        own = {r.stream_id: bytes(r.incarnation) for r in log.names().collect()}
        made = spark.createDataFrame([("a", "a", own["a"], 1), ("b", "a", own["a"], 0)], "stream_id string, named string, inc binary, offset long")
        tokens = made.select("stream_id", codec.encode_token(F.col("named"), F.col("inc"), F.col("offset")).alias("token"))
        page, told = log.read_tokens(tokens)
        assert [bytes(r.payload) for r in page.collect()] == [b"y"]
        assert {(r.stream_id, r.error) for r in told.collect()} == {("a", None), ("b", "InvalidCursor")}
        cursors = spark.createDataFrame([("a", 0, None, bytes(16))], "stream_id string, after long, through long, incarnation binary")
        page, told = log.read_after(cursors)
        assert page.count() == 0 and [r.error for r in told.collect()] == ["StaleIncarnation"]
