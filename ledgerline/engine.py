"""The event log as one object: streams, appends, reads and lifecycle over a Store."""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.functions import codec
from ledgerline.functions.codec import valid_identifier
from ledgerline.operators import append as appends
from ledgerline.operators import control, replication
from ledgerline.operators import log as logs
from ledgerline.schema import CHUNKS, DEDUPLICATED, FLOORS, INSERTED, LEASES, OUTCOMES, POLICIES, PROFILES, RECORDS, SNAPSHOTS, STORED, STREAM_NAMES, TAILS, Limits, LogError
from ledgerline.sources.store import FORMAT_VERSION, Store

LIFE = ["stream_id", "incarnation"]


class EventLog:
    """Every change is one commit; errors of single requests are data in the result.

    Tails, floors, policies and leases are control tables that change in the same
    commit as the records, so no call scans history to find where a stream ends.
    """

    def __init__(self, store: Store, limits: Limits | None = None, audit: bool = False):
        """audit: hold records against the control tables first, and refuse a store where they differ."""
        self.store, self.limits, self.spark = store, limits or Limits(), store.spark
        if store.format != FORMAT_VERSION:
            raise LogError("MigrationRequired", f"format {store.format}")
        if audit and not self.faults().isEmpty():
            raise LogError("StoreCorrupt", store.path)
        if PROFILES.index(self.limits.persistence) > PROFILES.index(store.persistence):
            raise LogError("InvalidConfig", f"{store.persistence} storage")
        self.opened, self.rejected, self.state = store.version(), 0, "Running"

    # -- control tables ------------------------------------------------------

    def names(self) -> DataFrame:
        return self.store.latest("stream_names", STREAM_NAMES, ["stream_id"])

    def floors(self) -> DataFrame:
        return self.store.latest("floors", FLOORS, LIFE)

    def tails(self) -> DataFrame:
        return self.store.latest("tails", TAILS, LIFE)

    def policies(self) -> DataFrame:
        """oldest accepted and current retry generation of the streams that have a policy."""
        return self.store.latest("policies", POLICIES, LIFE).where("current is not null")

    def leases(self) -> DataFrame:
        """Recovery leases that have not run out or been released."""
        return self.store.latest("leases", LEASES, ["lease_id"]).where(F.col("expires") > self.store.clock())

    def stored(self) -> DataFrame:
        """Rows of the active lifetimes that a retry can meet: above the floor, or of a generation that is still accepted."""
        held = self.store.read("records", STORED)
        met = held.join(self.names().where("active").select(*LIFE), LIFE, "left_semi").join(self.floors(), LIFE, "left").join(self.policies(), LIFE, "left")
        kept = F.col("floor").isNull() | (F.col("offset") > F.col("floor")) | (F.col("generation") >= F.coalesce("oldest", F.lit(0)))
        return met.where(kept).select(*STORED.names)

    def records(self, through: int | None = None) -> DataFrame:
        """Records of the active lifetimes, above their floors."""
        held = self.store.read("records", STORED, through=through)
        above = held.join(self.floors(), LIFE, "left").where(F.col("floor").isNull() | (F.col("offset") > F.col("floor"))).select(*RECORDS.names)
        return above.join(self.names().where("active").select(*LIFE), LIFE, "left_semi")

    def bounds(self) -> DataFrame:
        """stream_id, floor, tail of the active streams; of control tables alone."""
        active = self.names().where("active").join(self.floors(), LIFE, "left").join(self.tails(), LIFE, "left")
        floor = F.coalesce("floor", F.lit(0)).cast("long")
        return active.select("stream_id", floor.alias("floor"), F.coalesce("tail", floor).alias("tail"))

    def faults(self) -> DataFrame:
        """Streams whose records are not gapless between floor and tail."""
        return replication.restore_audit(self.bounds(), self.records().select("stream_id", "offset")).where("error is not null")

    def diagnostics(self) -> dict:
        """What has become of the append requests since this log was opened; accepted ones are inserted, deduplicated or failed."""
        told = self.store.read("outcomes", OUTCOMES, after=self.opened)
        row = told.agg(F.count("*").alias("n"), F.count_if(F.col("outcome") == INSERTED).alias("i"), F.count_if(F.col("outcome") == DEDUPLICATED).alias("d"), F.count_if(F.col("error_code").isNotNull()).alias("f")).first()
        counts = {"append_accepted": row.n, "append_inserted": row.i, "append_deduplicated": row.d, "append_failed": row.f, "append_rejected": self.rejected}
        return {"lifecycle": self.state, "persistence": self.store.persistence, "accepts_writes": self.state == "Running" and self.store.owner is not None, **counts}

    def close(self) -> dict:
        """Takes no more appends, gives the final counts, and releases the store."""
        self.state = "Draining"
        report = self.diagnostics()
        self.store.close()
        self.state = "Closed"
        return {**report, "lifecycle": self.state}

    # -- streams -------------------------------------------------------------

    def create(self, stream_ids: list[str]) -> DataFrame:
        """Creates what is absent; gives stream_id, incarnation and error of each."""
        asked = self.spark.createDataFrame([(s,) for s in dict.fromkeys(stream_ids)], "stream_id string")
        met = asked.join(self.names(), "stream_id", "left")
        fresh = met.where(F.col("incarnation").isNull() & valid_identifier(F.col("stream_id"))).select("stream_id")
        made = fresh.select("stream_id", F.unhex(F.regexp_replace(F.uuid(), "-", "")).alias("incarnation"), F.lit(True).alias("active"))
        if not fresh.isEmpty():
            self.store.commit({"stream_names": made}, uuid.uuid4().hex)
        now = asked.join(self.names(), "stream_id", "left")
        error = F.when(~valid_identifier(F.col("stream_id")), "InvalidIdentifier").when(~F.col("active"), "StreamUnavailable")
        return now.select("stream_id", F.when(error.isNull(), F.col("incarnation")).alias("incarnation"), error.alias("error"))

    # -- appends -------------------------------------------------------------

    def append(self, requests: DataFrame, operation_id: str | None = None) -> DataFrame:
        """requests: seq, stream_id, event_id, schema_id, schema_version, payload. Gives them with outcome, error_code, offset.

        Outcomes are stored with the records in one commit, so a retry of the
        operation reads the same answer. Streams with a retry policy are refused.
        """
        return self._append(requests, operation_id, generated=False)

    def append_generated(self, requests: DataFrame, operation_id: str | None = None) -> DataFrame:
        """append() by (stream, generation, event), for streams with a retry policy. requests: also generation."""
        return self._append(requests, operation_id, generated=True)

    def _append(self, requests: DataFrame, operation_id: str | None, generated: bool) -> DataFrame:
        operation_id = operation_id or uuid.uuid4().hex
        known = self.store.find(operation_id)
        if known is None:
            if self.state != "Running":
                raise LogError("Closed", self.store.path)
            n = requests.count()
            if n > self.limits.batch_events:
                self.rejected += n
                raise LogError("CapacityExceeded", f"{n} requests")
            streams = self.names().where("active").join(self.policies(), LIFE, "left").join(self.bounds().select("stream_id", "tail"), "stream_id").select("stream_id", "incarnation", "tail", "oldest", "current")
            met = requests.join(streams.select("stream_id", "incarnation", "current"), "stream_id", "left")
            needs = F.col("current").isNull() if generated else F.col("current").isNotNull()
            refused = F.when(F.col("incarnation").isNull(), "StreamUnavailable").when(needs, "RetryPolicyRequired")
            told = met.withColumn("error_code", refused)
            lost = told.where("error_code is not null").select(*requests.columns, F.lit(None).cast("string").alias("outcome"), "error_code", F.lit(None).cast("long").alias("offset"))
            open_ = told.where("error_code is null").select(*requests.columns)
            if generated:
                found = appends.resolve_generated(open_, self.stored(), streams.where("current is not null"), self.limits.event_bytes, n)
            else:
                found = appends.resolve(open_, self.stored(), streams.select("stream_id", "tail"), None, self.limits.event_bytes, n)
            # written at once: outcomes, records and tails must come of one evaluation
            folder = f"{self.store.path}/_tmp/outcomes-{uuid.uuid4().hex}"
            found.unionByName(lost).write.parquet(folder)
            told = self.spark.read.parquet(folder)
            kept = told.where(F.col("outcome") == INSERTED).join(streams.select(*LIFE), "stream_id")
            generation = F.col("generation") if generated else F.lit(0)
            rows = kept.select(*LIFE, "offset", generation.cast("long").alias("generation"), "event_id", "schema_id", "schema_version", "payload", appends.content_digest().alias("content"))
            tails = kept.groupBy(*LIFE).agg(F.max("offset").alias("tail"))
            known = self.store.commit({"outcomes": told, "records": rows, "tails": tails}, operation_id)
            self.store.discard(folder)
        return self.spark.read.parquet(f"{self.store.path}/{known['files']['outcomes']}").drop("_version")

    # -- reads ---------------------------------------------------------------

    def read_after(self, cursors: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Pages and their summaries. cursors: stream_id, after, through or null for the tail, and, if they are tokens' cursors, incarnation: one of another lifetime reads nothing and is told StaleIncarnation."""
        met = cursors.join(self.bounds(), "stream_id").withColumn("through", F.coalesce("through", "tail"))
        stale = None
        if "incarnation" in cursors.columns:
            own = self.names().where("active").select("stream_id", F.col("incarnation").alias("own"))
            met = met.join(own, "stream_id")
            stale = met.where("incarnation <> own")
            met = met.where("incarnation = own")
        records = self.records()
        page = logs.pages(records, met.select("stream_id", "after", "through"), self.limits.page_records, self.limits.page_bytes)
        told = logs.page_summaries(records, met, self.limits.page_records, self.limits.page_bytes)
        if stale is not None:
            told = told.unionByName(stale.select("stream_id", F.col("after").alias("next_after"), F.lit(False).alias("complete"), F.lit("StaleIncarnation").alias("error")), allowMissingColumns=True)
        return page.where("error is null"), told

    def read_tokens(self, tokens: DataFrame) -> tuple[DataFrame, DataFrame]:
        """read_after() of cursor tokens (stream_id, token); a token that is none, or names another stream, is told in the summary."""
        parts = tokens.select("stream_id", codec.decode_token(F.col("token")).alias("t"))
        error = F.coalesce(F.col("t.error"), F.when(F.col("t.stream_id") != F.col("stream_id"), "InvalidCursor"))
        parts = parts.withColumn("refused", error)
        good = parts.where("refused is null").select("stream_id", F.col("t.offset").cast("long").alias("after"), F.lit(None).cast("long").alias("through"), F.unhex("t.incarnation").alias("incarnation"))
        page, told = self.read_after(good)
        return page, told.unionByName(parts.where("refused is not null").select("stream_id", F.col("refused").alias("error")), allowMissingColumns=True)

    # -- retention -----------------------------------------------------------

    def set_generations(self, requests: DataFrame) -> DataFrame:
        """requests: stream_id, expected_current (null: enable the policy; else advance it by one)."""
        held = self.policies().select("stream_id", "oldest", "current")
        told = replication.advance_generation(requests, held)
        good = told.where("error is null").join(self.names().where("active"), "stream_id").join(held.select("stream_id", "oldest"), "stream_id", "left")
        self.store.commit({"policies": good.select(*LIFE, F.coalesce("oldest", F.lit(0)).cast("long").alias("oldest"), F.col("current_after").alias("current"))}, uuid.uuid4().hex)
        return told

    def expire_generations(self, requests: DataFrame) -> DataFrame:
        """requests: stream_id, expected_oldest, retain_from. Identities of older generations are forgotten at the next cleanup."""
        pins = self.spark.createDataFrame([], "stream_id string, pinned long")
        told = control.expire_decisions(requests, self.policies().select("stream_id", "oldest", "current"), pins)
        good = told.where("error is null").join(self.policies().select(*LIFE, "current"), "stream_id")
        self.store.commit({"policies": good.select(*LIFE, F.col("oldest_after").cast("long").alias("oldest"), "current")}, uuid.uuid4().hex)
        return told

    def advance_floors(self, requests: DataFrame, replicas: DataFrame | None = None) -> DataFrame:
        """requests: stream_id, expected_floor, new_floor. Records at or below the floor are no longer read; live recovery leases protect what follows them. Only streams with a retry policy may."""
        replicas = replicas if replicas is not None else self.spark.createDataFrame([], "stream_id string, mode string, acknowledged long")
        active = self.names().where("active")
        streams = self.bounds().join(self.policies().select("stream_id", F.lit(True).alias("generational")), "stream_id", "left").withColumn("generational", F.coalesce("generational", F.lit(False)))
        told = control.floor_decisions(requests, streams, replicas, self.leases().join(active, LIFE, "left_semi").select("stream_id", "covered"))
        good = told.where("error is null").join(active, "stream_id")
        self.store.commit({"floors": good.select(*LIFE, F.col("floor_after").alias("floor"))}, uuid.uuid4().hex)
        return told

    def cleanup(self) -> int:
        """Removes rows that nothing can meet any more: of retired lifetimes, and those at or below a floor whose generation has expired. Gives how many."""
        held = self.store._rows("records", STORED)
        if held is None:
            return 0
        live = held.join(self.names().where("active").select(*LIFE), LIFE, "left_semi").join(self.floors(), LIFE, "left").join(self.policies(), LIFE, "left")
        kept = live.where(F.col("floor").isNull() | (F.col("offset") > F.col("floor")) | (F.col("generation") >= F.coalesce("oldest", F.lit(0)))).select(*held.columns)
        before = held.count()
        made = self.store.commit({"records": kept}, f"cleanup-{self.store.version()}", whole=True)
        return before - self.spark.read.parquet(f"{self.store.path}/{made['files']['records']}").count()

    # -- snapshots -----------------------------------------------------------

    def snapshots(self) -> DataFrame:
        return self.store.latest("snapshots", SNAPSHOTS, ["snapshot_id"])

    def upload_snapshot(self, snapshot_id: bytes, stream_id: str, covered: int, chunks: DataFrame, digest: bytes, schema_id: str = "state", schema_version: int = 1) -> str:
        """Takes all chunks (offset, bytes), verifies them and gives the state: Verified or ChecksumMismatch."""
        known = self.snapshots().where(F.col("snapshot_id") == F.lit(snapshot_id)).collect()
        if known:
            if (bytes(known[0].digest), known[0].covered, known[0].stream_id) != (digest, covered, stream_id):
                raise LogError("SnapshotConflict", snapshot_id.hex())
            return known[0].state
        own = self.names().where((F.col("stream_id") == stream_id) & F.col("active")).collect()
        bounds = self.bounds().where(F.col("stream_id") == stream_id).collect()
        if not own:
            raise LogError("StreamUnavailable", stream_id)
        if covered > bounds[0].tail:
            raise LogError("CursorAhead", str(covered))
        sized = chunks.select(F.lit(snapshot_id).alias("snapshot_id"), "offset", "bytes", F.octet_length("bytes").cast("long").alias("size"))
        total = sized.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("n"), F.max("size").alias("most"), F.min("size").alias("least")).first()
        if total.n > self.limits.snapshot_bytes or (total.most or 0) > self.limits.chunk_bytes or total.least == 0:
            raise LogError("CapacityExceeded", f"{total.n} bytes")
        if not control.chunk_faults(sized, "snapshot_id").isEmpty():
            raise LogError("ChunkGap", snapshot_id.hex())
        content = sized.groupBy("snapshot_id").agg(codec.ordered_bytes(F.col("offset"), F.col("bytes")).alias("content"))  # at most snapshot_bytes
        found = content.select(codec.digest(F.col("content")).alias("d")).collect()
        state = "Verified" if (found[0].d if found else hashlib.sha256(b"").hexdigest()) == digest.hex() else "ChecksumMismatch"
        row = (snapshot_id, stream_id, bytes(own[0].incarnation), covered, schema_id, schema_version, total.n, digest, state)
        self.store.commit({"snapshots": self.spark.createDataFrame([row], SNAPSHOTS), "snapshot_chunks": sized.select(*CHUNKS.names)}, f"snapshot-{snapshot_id.hex()}")
        return state

    def move_snapshot(self, snapshot_id: bytes, event: str) -> str:
        """publish or abort. Gives the new state; what the states don't allow is refused."""
        row = self.snapshots().where(F.col("snapshot_id") == F.lit(snapshot_id))
        told = row.withColumn("next", control.upload_state(F.col("state"), F.lit(event))).collect()
        if not told:
            raise LogError("SnapshotNotFound", snapshot_id.hex())
        if told[0].next is None:
            raise LogError("InvalidTransition", f"{told[0].state} {event}")
        if told[0].next != told[0].state:
            self.store.commit({"snapshots": row.withColumn("state", F.lit(told[0].next))}, uuid.uuid4().hex)
        return told[0].next

    def recover(self, snapshot_id: bytes) -> tuple[DataFrame, DataFrame]:
        """The chunks of a published snapshot, and the records after what it covers."""
        row = self.snapshots().where((F.col("snapshot_id") == F.lit(snapshot_id)) & (F.col("state") == "Published")).collect()
        if not row:
            raise LogError("SnapshotNotFound", snapshot_id.hex())
        floor = self.bounds().where(F.col("stream_id") == row[0].stream_id).first()
        if floor is None or row[0].covered < floor.floor:
            raise LogError("HistoryUnavailable", row[0].stream_id)
        chunks = self.store.read("snapshot_chunks", CHUNKS).where(F.col("snapshot_id") == F.lit(snapshot_id))
        return chunks, self.records().where((F.col("stream_id") == row[0].stream_id) & (F.col("offset") > row[0].covered))

    def acquire_recovery(self, snapshot_id: bytes, lifetime_ms: int) -> dict:
        """Pins what follows a published snapshot until the lease runs out or is released. Gives lease_id, covered, through, expires."""
        if not 0 < lifetime_ms <= self.limits.lease_ms:
            raise LogError("InvalidInput", f"{lifetime_ms} ms")
        found = self.snapshots().where((F.col("snapshot_id") == F.lit(snapshot_id)) & (F.col("state") == "Published")).collect()
        if not found:
            raise LogError("SnapshotNotFound", snapshot_id.hex())
        bounds = self.bounds().where(F.col("stream_id") == found[0].stream_id).collect()
        if not bounds or bounds[0].floor > found[0].covered:
            raise LogError("HistoryUnavailable", found[0].stream_id)
        row = (uuid.uuid4().hex, snapshot_id, found[0].stream_id, bytes(found[0].incarnation), found[0].covered, bounds[0].tail, self.store.clock() + lifetime_ms)
        self.store.commit({"leases": self.spark.createDataFrame([row], LEASES)}, f"lease-{row[0]}")
        return {"lease_id": row[0], "covered": row[4], "through": row[5], "expires": row[6]}

    def release_recovery(self, lease_id: str) -> None:
        """Ends a lease; one that has ended is no error."""
        held = self.leases().where(F.col("lease_id") == lease_id)
        if not held.isEmpty():
            self.store.commit({"leases": held.withColumn("expires", F.lit(0).cast("long"))}, f"release-{lease_id}")

    def change_lifecycle(self, requests: DataFrame, replicas: DataFrame | None = None) -> DataFrame:
        """requests: operation_id, stream_id, action, expected. The decision of each; accepted ones are committed."""
        fresh = requests.withColumn("fresh", F.unhex(F.substring(F.sha2(F.concat_ws("|", "operation_id", "stream_id"), 256), 1, 32)))
        none = self.spark.createDataFrame([], "stream_id string, mode string")
        told = control.lifecycle(fresh, self.names(), replicas if replicas is not None else none)
        rows = told.where("error is null").select("stream_id", F.col("incarnation_after").alias("incarnation"), F.col("active_after").alias("active"))
        operation = requests.agg(F.sha2(F.concat_ws(",", F.array_sort(F.collect_list("operation_id"))), 256)).first()[0]
        answer = self.store.commit({"stream_names": rows, "decisions": told}, f"lifecycle-{operation}")
        return self.spark.read.parquet(f"{self.store.path}/{answer['files']['decisions']}").drop("_version")


def migrate(store: Store) -> EventLog:
    """Brings a store of format 1 to the present one: digests and tails are made of its records in one commit, then the format is named. Owned stores only; again is harmless."""
    if store.format == FORMAT_VERSION:
        return EventLog(store)
    rows = store._rows("records", RECORDS)
    if rows is not None:
        tails = rows.groupBy(*LIFE).agg(F.max("offset").alias("tail"))
        store.commit({"tails": tails}, "migrate-tails")
        store.commit({"records": rows.withColumn("content", appends.content_digest()).select(*STORED.names, "_version")}, "migrate-records", whole=True)
    store.set_format(FORMAT_VERSION)
    return EventLog(store)


def raise_first(outcomes: DataFrame) -> DataFrame:
    """The facade of single calls: raises the first error, by seq."""
    bad = outcomes.where("error_code is not null").orderBy("seq").limit(1).collect()
    if bad:
        raise LogError(bad[0]["error_code"], bad[0]["event_id"])
    return outcomes
