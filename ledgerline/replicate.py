"""Replication of streams from one log to another store: prepare, send, acknowledge.

The origin keeps, for each attachment, the acknowledged position and the exact
pending batch; the destination commits a batch with its receipt. An answer that
was lost is asked for again: the batch is the same, and the receipt replays.
"""

from __future__ import annotations

import hashlib
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.engine import EventLog
from ledgerline.functions import codec
from ledgerline.operators import control, operations, replication
from ledgerline.operators.append import contiguous
from ledgerline.schema import ATTACHED, BATCHES, RECORDS, LogError, _table
from ledgerline.sources.store import Store

EPOCHS = _table(name=str, epoch=str)
FLOORS = _table(stream_id=str, receipt_floor=int)
UNCERTAIN = {"CommitUnknown", "StorageFailure"}  # fixed: what a retry may settle


class Destination:
    """Replicated histories in a store of their own, under an epoch that a restore would rotate."""

    def __init__(self, store: Store):
        self.store, self.spark = store, store.spark
        if not store.latest("epochs", EPOCHS, ["name"]).count():
            store.commit({"epochs": self.spark.createDataFrame([("epoch", uuid.uuid4().hex)], EPOCHS)}, "epoch")
        self.epoch: str = store.latest("epochs", EPOCHS, ["name"]).first().epoch

    def records(self) -> DataFrame:
        return self.store.read("records", RECORDS)

    def progress(self) -> DataFrame:
        """stream_id, tail, receipt_floor of the streams that have a history."""
        tails = self.store.read("batches", BATCHES).groupBy("stream_id").agg(F.max("through").alias("tail"))
        return tails.join(self.store.latest("floors", FLOORS, ["stream_id"]), "stream_id", "left").withColumn("receipt_floor", F.coalesce("receipt_floor", F.lit(0)).cast("long"))

    def commit(self, batch: dict, records: DataFrame) -> dict:
        """batch: batch_id, stream_id, epoch, after, through, digest. records must follow `after` without a gap. Gives the receipt, again for an exact repeat, or raises."""
        checked = records.select(F.lit(batch["batch_id"]).alias("batch_id"), F.lit(batch["after"]).alias("after"), "offset", "stream_id")
        told = contiguous(checked).first()
        if told is None or not told.contiguous or told.through != batch["through"] or batch_digest(records) != batch["digest"]:
            raise LogError("InvalidInput", batch["batch_id"])
        asked = self.spark.createDataFrame([tuple(batch[c] for c in ("batch_id", "stream_id", "epoch", "after", "through", "digest"))], "batch_id string, stream_id string, epoch string, after long, through long, digest string")
        streams = asked.select("stream_id").join(self.progress(), "stream_id", "left").select("stream_id", F.lit(self.epoch).alias("epoch0"), F.coalesce("tail", F.lit(0)).cast("long").alias("tail"), F.coalesce("receipt_floor", F.lit(0)).cast("long").alias("receipt_floor"))
        held = self.store.read("batches", BATCHES).select("batch_id", F.col("digest").alias("digest0"))
        verdict = replication.commit_batches(asked, streams, held).first()
        if verdict.error:
            raise LogError(verdict.error, batch["batch_id"])
        if verdict.outcome == "Committed":
            rows = records.select(*RECORDS.names)
            self.store.commit({"records": rows, "batches": asked.select(*BATCHES.names)}, f"batch-{batch['batch_id']}")
        return {"batch_id": batch["batch_id"], "epoch": self.epoch, "through": batch["through"]}

    def advance_floor(self, requests: DataFrame, operation_id: str) -> DataFrame:
        """requests: stream_id, epoch, expected, new. Batches that follow a position below the floor are refused from then on."""
        told = operations.replica_floors(requests, self.progress(), self.epoch)
        self.store.commit({"floors": told.where("error is null").select("stream_id", F.col("floor_after").cast("long").alias("receipt_floor"))}, operation_id)
        return told


def batch_digest(records: DataFrame) -> str:
    """Of the records in order: a batch holds at most a page of them."""
    rows = records.select("offset", F.sha2(F.concat_ws("|", "stream_id", F.hex("event_id"), F.hex("schema_id"), F.col("schema_version").cast("string"), F.hex("payload")), 256).alias("d")).orderBy("offset").collect()
    return hashlib.sha256("".join(f"{r.offset}:{r.d}," for r in rows).encode()).hexdigest()


class Replicator:
    """The origin's side: attachments of an EventLog's streams."""

    def __init__(self, log: EventLog, per_stream: int = 8):
        self.log, self.store, self.spark, self.per_stream = log, log.store, log.spark, per_stream

    def attachments(self) -> DataFrame:
        return self.store.latest("replicas", ATTACHED, ["replica_id", "stream_id"])

    def attach(self, requests: DataFrame, epoch: str) -> DataFrame:
        """requests: replica_id, stream_id, mode (FromBeginning, NeedsBootstrap), max_backlog_bytes."""
        sized = self.log.records().select("stream_id", codec.stored_bytes(F.col("event_id"), F.col("schema_id"), F.col("payload")).alias("b"))
        told = replication.attach(requests, self.log.bounds(), self.attachments(), sized.groupBy("stream_id").agg(F.sum("b").alias("bytes")), self.per_stream)
        good = told.where("error is null").join(requests.select("replica_id", "stream_id", "max_backlog_bytes"), ["replica_id", "stream_id"]).join(self.log.bounds().select("stream_id", "tail"), "stream_id")
        at = F.when(F.col("state") == "Required", 0).otherwise(F.col("tail")).cast("long")
        none = F.lit(None)
        self.store.commit({"replicas": good.select("replica_id", "stream_id", F.col("state").alias("mode"), at.alias("acknowledged"), F.lit(epoch).alias("destination_epoch"), F.col("max_backlog_bytes").cast("long").alias("max_backlog_bytes"), none.cast("string").alias("pending_id"), none.cast("long").alias("pending_through"))}, uuid.uuid4().hex)
        return told

    def detach(self, requests: DataFrame) -> DataFrame:
        """requests: replica_id, stream_id."""
        told = operations.detach(requests, self.attachments())
        good = self.attachments().join(told.where("error is null").select("replica_id", "stream_id"), ["replica_id", "stream_id"], "left_semi")
        none = F.lit(None)
        self.store.commit({"replicas": good.withColumns({"mode": F.lit("DetachedNeedsBootstrap"), "pending_id": none.cast("string"), "pending_through": none.cast("long")}).select(*ATTACHED.names)}, uuid.uuid4().hex)
        return told

    def status(self) -> DataFrame:
        """Attachments with what lies behind them."""
        sized = self.log.records().select("stream_id", "offset", codec.stored_bytes(F.col("event_id"), F.col("schema_id"), F.col("payload")).alias("bytes"))
        return control.backlog(self.attachments(), sized)

    def _one(self, replica_id: str, stream_id: str):
        found = self.attachments().where((F.col("replica_id") == replica_id) & (F.col("stream_id") == stream_id)).collect()
        if not found:
            raise LogError("NotFound", replica_id)
        return found[0]

    def prepare(self, replica_id: str, stream_id: str, max_records: int = 256, max_bytes: int = 1 << 20) -> tuple[dict, DataFrame] | None:
        """The pending batch, the same until it is acknowledged; None if nothing is behind."""
        held = self._one(replica_id, stream_id)
        if held.mode == "DetachedNeedsBootstrap":
            raise LogError("NeedsBootstrap", replica_id)
        ahead = self.log.records().where((F.col("stream_id") == stream_id) & (F.col("offset") > held.acknowledged))
        if held.pending_through is None:
            page = ahead.where(F.col("offset") <= held.acknowledged + max_records).withColumn("size", codec.accounted_bytes(F.col("event_id"), F.col("schema_id"), F.col("payload")))
            cut = control.bounded(page, ["stream_id"], ["offset"], F.col("size"), max_records, max_bytes).agg(F.max("offset").alias("through")).first()
            if cut.through is None:
                if ahead.isEmpty():
                    return None
                raise LogError("CapacityExceeded", "a record is larger than a batch")
            through, name = cut.through, uuid.uuid4().hex
            row = (replica_id, stream_id, held.mode, held.acknowledged, held.destination_epoch, held.max_backlog_bytes, name, through)
            self.store.commit({"replicas": self.spark.createDataFrame([row], ATTACHED)}, f"prepare-{name}")
        else:
            through, name = held.pending_through, held.pending_id
        records = ahead.where(F.col("offset") <= through)
        return {"batch_id": name, "stream_id": stream_id, "epoch": held.destination_epoch, "after": held.acknowledged, "through": through, "digest": batch_digest(records)}, records

    def acknowledge(self, replica_id: str, stream_id: str, after: int, receipt: dict) -> int:
        """The new acknowledged position, or raises."""
        held = self.attachments().where(F.col("stream_id") == stream_id)
        asked = self.spark.createDataFrame([(replica_id, receipt["batch_id"], receipt["epoch"], after, receipt["through"])], "replica_id string, batch_id string, epoch string, after long, through long")
        told = control.ack_progress(asked, held.select("replica_id", "acknowledged", "destination_epoch", "pending_id", "pending_through")).first()
        if told.error:
            raise LogError(told.error, replica_id)
        none = F.lit(None)
        row = held.where(F.col("replica_id") == replica_id).withColumns({"acknowledged": F.lit(told.acknowledged_after).cast("long"), "pending_id": none.cast("string"), "pending_through": none.cast("long")})
        self.store.commit({"replicas": row.select(*ATTACHED.names)}, f"ack-{receipt['batch_id']}")
        return told.acknowledged_after

    def replicate_once(self, replica_id: str, stream_id: str, destination: Destination, max_records: int = 256, max_bytes: int = 1 << 20) -> int | None:
        """One batch, from prepare to acknowledgement. None if nothing is behind."""
        made = self.prepare(replica_id, stream_id, max_records, max_bytes)
        if made is None:
            return None
        batch, records = made
        receipt = destination.commit(batch, records)
        return self.acknowledge(replica_id, stream_id, batch["after"], receipt)

    def replicate_with_retry(self, replica_id: str, stream_id: str, destination: Destination, attempts: int = 5, first_wait: float = 0.05, longest_wait: float = 2.0, sleep: Callable[[float], None] = time.sleep, **how: int) -> int | None:
        """replicate_once(); uncertain answers are asked for again after growing waits, other errors end it."""
        for n in range(attempts):
            try:
                return self.replicate_once(replica_id, stream_id, destination, **how)
            except LogError as e:
                if e.code not in UNCERTAIN or n + 1 == attempts:
                    raise
                sleep(min(longest_wait, first_wait * 2**n))
        return None
