"""Captured sources and replication, from commit to commit, with writers that die between."""

import hashlib

import pytest
from pyspark.sql import functions as F

from ledgerline.engine import EventLog
from ledgerline.ingestion import SourceJournal
from ledgerline.operators.replication import backup_digest
from ledgerline.replicate import Destination, Replicator
from ledgerline.restore import cleanup_staging, restore
from ledgerline.schema import LogError
from ledgerline.sources.store import Store

RAW = b"a\r\n\n\xff\xef\xbb\xbfz\nlast"
REQUEST = "seq long, stream_id string, event_id string, schema_id string, schema_version long, payload binary"


def segment(spark, *rows):
    return spark.createDataFrame(list(rows), "source_id string, start long, bytes binary")


def test_captured_bytes_become_events_once(spark, tmp_path):
    with Store(spark, f"file://{tmp_path}/log", create=True) as store:
        log = EventLog(store)
        log.create(["out"])
        log.set_generations(spark.createDataFrame([("out", None)], "stream_id string, expected_current long"))
        journal = SourceJournal(log)
        binding = spark.createDataFrame([("s", "lines", "out")], "source_id string, parser string, stream_id string")
        assert journal.begin(binding, "begin-1").first().error is None
        assert journal.begin(binding, "begin-1").first().error is None  # its receipt
        assert journal.begin(binding, "begin-2").first().error == "SourceBindingConflict"
        told = [journal.capture(segment(spark, ("s", a, RAW[a:b]))).first() for a, b in ((0, 5), (0, 5), (7, 9), (5, 9))]
        assert [(t.outcome, t.error) for t in told] == [("Captured", None), ("Deduplicated", None), (None, "CaptureConflict"), ("Captured", None)]

        class Stopped(Exception):
            pass

        def stop(at):
            if at == "appended":
                raise Stopped

        store._reached = stop  # the outputs are appended, the checkpoint isn't moved
        with pytest.raises(Stopped):
            journal.drive()
        store._reached = lambda at: None
        assert log.records().count() == 2 and journal.checkpoints().count() == 0
        assert journal.drive() == {"Deduplicated": 2, "remaining": 0}
        assert journal.capture(segment(spark, ("s", 9, RAW[9:]))).first().outcome == "Captured"
        assert journal.drive(work=2) == {"Inserted": 1, "remaining": 1}
        assert journal.drive() == {"remaining": 0}
        ends = spark.createDataFrame([("s", "Seal", len(RAW) - 1)], "source_id string, action string, at long")
        assert journal.seal(ends).first().error == "InvalidInput"
        assert journal.seal(ends.withColumn("at", F.lit(len(RAW)).cast("long"))).first().error is None
        assert journal.capture(segment(spark, ("s", len(RAW), b"x"))).first().error == "SourceSealed"
        assert journal.drive() == {"Inserted": 1, "remaining": 0}
        assert journal.seal(spark.createDataFrame([("s", "Finish", len(RAW))], "source_id string, action string, at long")).first().finished_after
        got = [(r.offset, r.event_id, bytes(r.payload)) for r in log.records().orderBy("offset").collect()]
        assert got == [(1, "s-0", b"a"), (2, "s-1", b""), (3, "s-2", b"\xff\xef\xbb\xbfz"), (4, "s-3", b"last")]
        floor = spark.createDataFrame([("s", 0, 9)], "source_id string, expected long, new long")
        assert journal.advance_floor(floor, "floor-1").first().error is None
        assert journal.capture(segment(spark, ("s", 5, RAW[5:9]))).first().error == "CaptureReceiptExpired"


def test_replication_survives_lost_answers(spark, tmp_path):
    with Store(spark, f"file://{tmp_path}/log", create=True) as store, Store(spark, f"file://{tmp_path}/copy", create=True) as copy:
        log = EventLog(store)
        log.create(["a"])
        log.append(spark.createDataFrame([(k, "a", f"e{k}", "s", 1, bytes([k])) for k in range(5)], REQUEST))
        there, here = Destination(copy), Replicator(log)
        asked = spark.createDataFrame([("r", "a", "FromBeginning", 1 << 20), ("r2", "a", "FromBeginning", 1)], "replica_id string, stream_id string, mode string, max_backlog_bytes long")
        assert {r.replica_id: r.error for r in here.attach(asked, there.epoch).collect()} == {"r": None, "r2": "BacklogExceeded"}
        assert here.status().first().rows_behind == 5
        assert here.replicate_once("r", "a", there, max_records=2) == 2
        lost, commit = [True], there.commit

        def uncertain(batch, records):
            receipt = commit(batch, records)
            if lost[0]:
                lost[0] = False
                raise LogError("CommitUnknown", "the answer")
            return receipt

        there.commit = uncertain
        waits = []
        assert here.replicate_with_retry("r", "a", there, sleep=waits.append, max_records=2) == 4 and waits == [0.05]
        assert here.replicate_with_retry("r", "a", there, max_records=2) == 5
        assert here.replicate_once("r", "a", there) is None
        want = [(r.offset, r.event_id, bytes(r.payload)) for r in log.records().orderBy("offset").collect()]
        assert [(r.offset, r.event_id, bytes(r.payload)) for r in there.records().orderBy("offset").collect()] == want
        log.append(spark.createDataFrame([(0, "a", "e9", "s", 1, b"n")], REQUEST))
        batch, records = here.prepare("r", "a")
        assert here.prepare("r", "a")[0] == batch  # pending until acknowledged
        for change, code in (({"epoch": "old"}, "DestinationReplaced"), ({"digest": "x"}, "InvalidInput"), ({"after": 4}, "InvalidInput")):
            with pytest.raises(LogError, match=code):
                commit({**batch, **change}, records)
        with pytest.raises(LogError, match="InvalidReceipt"):
            here.acknowledge("r", "a", batch["after"], {"batch_id": "other", "epoch": there.epoch, "through": 6})
        assert here.replicate_once("r", "a", there) == 6
        assert there.advance_floor(spark.createDataFrame([("a", there.epoch, 0, 6)], "stream_id string, epoch string, expected long, new long"), "f").first().error is None
        with pytest.raises(LogError, match="ReceiptExpired"):
            commit(batch, records)
        gone = spark.createDataFrame([("r", "a"), ("x", "a")], "replica_id string, stream_id string")
        assert {r.replica_id: r.error for r in here.detach(gone).collect()} == {"r": None, "x": "NotFound"}
        with pytest.raises(LogError, match="NeedsBootstrap"):
            here.prepare("r", "a")


def test_a_restored_store_has_new_lifetimes(spark, tmp_path):
    backup, target = f"file://{tmp_path}/log", f"file://{tmp_path}/new"
    with Store(spark, backup, create=True) as store:
        log = EventLog(store)
        log.create(["a", "empty"])
        log.append(spark.createDataFrame([(k, "a", f"e{k}", "s", 1, bytes([k])) for k in range(4)], REQUEST))
        state = b"two events"
        log.upload_snapshot(bytes(16), "a", 2, spark.createDataFrame([(0, state)], "offset long, bytes binary"), hashlib.sha256(state).digest())
        log.move_snapshot(bytes(16), "publish")
        log.acquire_recovery(bytes(16), 1000)
        Replicator(log).attach(spark.createDataFrame([("r", "a", "FromBeginning", 1 << 20)], "replica_id string, stream_id string, mode string, max_backlog_bytes long"), "old")
        old = {r.stream_id: bytes(r.incarnation) for r in log.names().collect()}
    digest = backup_digest(spark, f"{backup}/data")
    with pytest.raises(LogError, match="BackupMismatch"):
        restore(spark, backup, target, "op", "0" * 64)
    (tmp_path / "new.staging").mkdir()
    (tmp_path / "new.staging" / "_owner-other").touch()
    with pytest.raises(LogError, match="RestoreInProgress"):
        restore(spark, backup, target, "op", digest)
    assert not cleanup_staging(spark, target, "op") and cleanup_staging(spark, target, "other")
    with restore(spark, backup, target, "op", digest) as store:
        log = EventLog(store, audit=True)
        new = {r.stream_id: bytes(r.incarnation) for r in log.names().collect()}
        assert set(new) == set(old) and not set(new.values()) & set(old.values())
        assert [bytes(r.payload) for r in log.records().orderBy("offset").collect()] == [bytes([k]) for k in range(4)]
        assert {bytes(r.incarnation) for r in log.records().collect()} == {new["a"]}
        assert log.append(spark.createDataFrame([(0, "a", "e3", "s", 1, bytes([3])), (1, "a", "e4", "s", 1, b"")], REQUEST)).orderBy("seq").collect()[1].offset == 5
        held = Replicator(log).attachments().first()
        assert held.mode == "DetachedNeedsBootstrap" and held.destination_epoch != "old" and log.leases().count() == 0
        chunks, suffix = log.recover(bytes(16))
        assert bytes(chunks.first().bytes) == state and sorted(r.offset for r in suffix.collect()) == [3, 4, 5]
    with pytest.raises(LogError, match="AlreadyExists"):
        restore(spark, backup, target, "again", digest)
