"""State transitions of streams, retention, snapshots, journals and replicas as decisions over control tables.

Every decision is data: requests joined to the current state give an outcome or
an error name, and the caller commits the new rows. Shared rules come first:
an operation id seen with the same request returns its receipt, with another
one conflicts; then expected values are compared with current ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def replayed(requests: DataFrame, receipts: DataFrame) -> DataFrame:
    """requests with `replay`: Replayed, OperationConflict or null (not seen). Both hold operation_id and request."""
    seen = receipts.select("operation_id", F.col("request").alias("seen_request"), "receipt")
    same = F.col("seen_request") == F.col("request")
    return requests.join(seen, "operation_id", "left").withColumn("replay", F.when(same, "Replayed").when(F.col("seen_request").isNotNull(), "OperationConflict"))


# -- lifecycle ---------------------------------------------------------------


def lifecycle(requests: DataFrame, names: DataFrame, replicas: DataFrame) -> DataFrame:
    """Delete and Reset requests against stream_names.

    requests: operation_id, stream_id, action, expected (incarnation), fresh (the
    incarnation of a reset). names: stream_id, incarnation, active. replicas:
    stream_id, mode; Required and Bootstrapping ones block.
    """
    blocked = replicas.where(F.col("mode").isin("Required", "Bootstrapping")).select("stream_id").distinct().withColumn("blocked", F.lit(True))
    met = requests.join(names, "stream_id", "left").join(blocked, "stream_id", "left")
    error = (
        F.when(F.col("incarnation").isNull(), "StreamNotFound")
        .when(F.col("incarnation") != F.col("expected"), "StaleIncarnation")
        .when(F.col("active") & F.col("blocked"), "ReplicaProtectionActive")
    )
    good = error.isNull()
    delete, reset = F.col("action") == "Delete", F.col("action") == "Reset"
    outcome = F.when(~good, F.lit(None)).when(delete & F.col("active"), "Deleted").when(delete, "AlreadyDeleted").when(reset & F.col("active"), "Reset").when(reset, "Recreated")
    return met.select(
        "operation_id", "stream_id", "action", error.alias("error"), outcome.alias("outcome"),
        F.when(good, F.when(reset, F.col("fresh")).otherwise(F.col("incarnation"))).alias("incarnation_after"),
        F.when(good, reset).otherwise(F.col("active")).alias("active_after"),
        F.when(good & F.col("active"), F.col("incarnation")).alias("retired"),
    )


def retired_cleanup(records: DataFrame, retired: DataFrame, leases: DataFrame, max_rows: int, max_bytes: int) -> DataFrame:
    """The bounded prefix of each retired lifetime that may go: stops below the least position a live lease covers."""
    pins = leases.groupBy("stream_id").agg(F.min("covered").alias("pin"))
    met = records.join(retired.select("stream_id"), "stream_id").join(pins, "stream_id", "left")
    free = met.where(F.col("pin").isNull() | (F.col("offset") <= F.col("pin")))
    return bounded(free, ["stream_id"], ["offset"], F.col("bytes"), max_rows, max_bytes)


def bounded(rows: DataFrame, keys: list[str], order: list[str], charge: Column, max_rows: int, max_bytes: int) -> DataFrame:
    """The first rows of each key within a count and a running charge. The rank limit reaches the scan's side of the shuffle."""
    window = Window.partitionBy(*keys).orderBy(*order)
    ranked = rows.withColumn("rank", F.row_number().over(window).cast("long")).where(F.col("rank") <= max_rows)
    running = ranked.withColumn("cum_bytes", F.sum(charge.cast("long")).over(window.rowsBetween(Window.unboundedPreceding, 0)))
    return running.where(F.col("cum_bytes") <= max_bytes)


# -- retention ---------------------------------------------------------------


def floor_decisions(requests: DataFrame, streams: DataFrame, replicas: DataFrame, leases: DataFrame) -> DataFrame:
    """advance_retention_floor: compare and set, within the tail, replicas' acknowledged and leases' covered positions."""
    acks = replicas.where(F.col("mode").isin("Required", "Bootstrapping")).groupBy("stream_id").agg(F.min("acknowledged").alias("min_ack"))
    pins = leases.groupBy("stream_id").agg(F.min("covered").alias("min_covered"))
    met = requests.join(streams, "stream_id").join(acks, "stream_id", "left").join(pins, "stream_id", "left")
    error = (
        F.when(~F.col("generational"), "RetryPolicyRequired")
        .when(F.col("expected_floor") != F.col("floor"), "StaleFloor")
        .when(~F.col("new_floor").between(F.col("floor"), F.col("tail")), "InvalidInput")
        .when(F.col("new_floor") > F.col("min_ack"), "ReplicaProtectionActive")
        .when(F.col("new_floor") > F.col("min_covered"), "RecoveryProtectionActive")
    )
    return met.select("stream_id", "new_floor", error.alias("error"), F.when(error.isNull(), F.col("new_floor")).otherwise(F.col("floor")).alias("floor_after"), F.least("tail", "min_ack", "min_covered").alias("floor_max"))


def expire_decisions(requests: DataFrame, streams: DataFrame, pins: DataFrame) -> DataFrame:
    """expire_retry_generations: oldest <= retain_from <= current, compare and set, not above a journal's pinned generation."""
    met = requests.join(streams, "stream_id").join(pins, "stream_id", "left")
    error = (
        F.when(F.col("expected_oldest") != F.col("oldest"), "StaleGeneration")
        .when(~F.col("retain_from").between(F.col("oldest"), F.col("current")), "InvalidGeneration")
        .when(F.col("retain_from") > F.col("pinned"), "JournalProtectionActive")
    )
    return met.select("stream_id", "retain_from", error.alias("error"), F.when(error.isNull(), F.col("retain_from")).otherwise(F.col("oldest")).alias("oldest_after"))


def delete_plan(records: DataFrame, floors: DataFrame, identities: DataFrame, max_rows: int, max_bytes: int) -> DataFrame:
    """Records at or below their stream's floor whose retry identity is not retained, a bounded prefix of each stream."""
    below = records.join(floors, "stream_id").where(F.col("offset") <= F.col("floor"))
    free = below.join(identities.select("stream_id", "offset"), ["stream_id", "offset"], "left_anti")
    return bounded(free, ["stream_id"], ["offset"], F.col("bytes"), max_rows, max_bytes)


def generation_pins(markers: DataFrame, sources: DataFrame, streams: DataFrame) -> DataFrame:
    """The least generation that a source's unpublished markers hold, by output stream."""
    return markers.join(sources, "source_id").join(streams, "stream_id").groupBy("stream_id").agg(F.min("generation").alias("pinned"))


# -- snapshots ---------------------------------------------------------------


def chunk_faults(chunks: DataFrame, key: str) -> DataFrame:
    """Chunks that don't start where the one before ends, or at 0: key, offset, expected."""
    order = Window.partitionBy(key).orderBy("offset")
    expected = F.coalesce(F.lag(F.col("offset") + F.col("size")).over(order), F.lit(0)).cast("long")
    return chunks.withColumn("expected", expected).where(F.col("offset") != F.col("expected"))


def upload_state(state: Column, event: Column) -> Column:
    """The state after an event; null where it is not allowed."""
    return (
        F.when((state == "Uploading") & (event == "put"), "Uploading")
        .when((state == "Uploading") & (event == "verify"), "Verifying")
        .when((state == "Verifying") & (event == "match"), "Verified")
        .when((state == "Verifying") & (event == "mismatch"), "ChecksumMismatch")
        .when((state == "Verified") & (event == "publish"), "Published")
        .when((state == "Published") & (event == "publish"), "Published")
        .when((state != "Published") & (event == "abort"), "Aborted")
    )


# -- replicas ----------------------------------------------------------------


def backlog(replicas: DataFrame, records: DataFrame) -> DataFrame:
    """Rows and stored bytes after each replica's acknowledged position; replicas without any keep a row.

    Replicas join sums, not records: positions are cut to buckets of offsets so
    that a stream's records are summed once, however many replicas follow it.
    """
    step = 1024
    whole = F.floor((F.col("offset") - 1) / step)
    sums = records.groupBy("stream_id", whole.alias("part")).agg(F.count("*").alias("n"), F.sum("bytes").alias("b"))
    held = replicas.withColumn("cut", F.floor(F.col("acknowledged") / step))
    later = held.join(sums, "stream_id").where(F.col("part") > F.col("cut")).groupBy("replica_id").agg(F.sum("n").alias("n"), F.sum("b").alias("b"))
    edge = held.join(records, "stream_id").where((whole == F.col("cut")) & (F.col("offset") > F.col("acknowledged"))).groupBy("replica_id").agg(F.count("*").alias("n"), F.sum("bytes").alias("b"))
    total = later.unionByName(edge).groupBy("replica_id").agg(F.sum("n").alias("rows_behind"), F.sum("b").alias("bytes_behind"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return replicas.join(total, "replica_id", "left").select(*replicas.columns, zero("rows_behind"), zero("bytes_behind"))


def ack_progress(acks: DataFrame, replicas: DataFrame) -> DataFrame:
    """Acknowledgements must name the pending batch, its extent and the destination's epoch; the position moves to its end.

    acks: replica_id, batch_id, epoch, after, through. replicas: replica_id,
    acknowledged, destination_epoch, pending_id and pending_through (null: none).
    """
    met = acks.join(replicas, "replica_id", "left")
    exact = (F.col("after") == F.col("acknowledged")) & (F.col("batch_id") == F.col("pending_id")) & (F.col("epoch") == F.col("destination_epoch")) & (F.col("through") == F.col("pending_through"))
    error = F.when(F.col("acknowledged").isNull(), "NotFound").when(F.col("pending_id").isNull(), "InvalidInput").when(~exact, "InvalidReceipt")
    return met.select("replica_id", "through", error.alias("error"), F.when(error.isNull(), F.col("through")).otherwise(F.col("acknowledged")).alias("acknowledged_after"))


# -- subscriptions -----------------------------------------------------------


def start_positions(requests: DataFrame, bounds: DataFrame) -> DataFrame:
    """Where a subscription starts: Beginning (the floor), After (a cursor) or Future (the tail)."""
    met = requests.join(bounds, "stream_id")
    start = F.when(F.col("start") == "Beginning", F.col("floor")).when(F.col("start") == "Future", F.col("tail")).otherwise(F.col("cursor"))
    error = F.when(start < F.col("floor"), "HistoryUnavailable").when(start > F.col("tail"), "CursorAhead")
    return met.select("subscription_id", "stream_id", "start", error.alias("error"), F.when(error.isNull(), start).alias("last_delivered"), F.when(error.isNull(), F.col("tail")).alias("replay_high"))


def lag_verdicts(subscriptions: DataFrame, bounds: DataFrame, now_ms: int) -> DataFrame:
    """Which subscriptions end as lagged: below the floor at once; after the grace, too many records or too long behind."""
    met = subscriptions.join(bounds, "stream_id")
    behind = F.col("tail") - F.col("last_delivered")
    late = (behind > F.col("max_lag_records")) | (F.coalesce(F.lit(now_ms) - F.col("behind_since_ms"), F.lit(0)) > F.col("max_lag_ms"))
    lagged = (F.col("last_delivered") < F.col("floor")) | ((F.lit(now_ms) - F.col("created_ms") >= F.col("grace_ms")) & (behind > 0) & late)
    return met.select("subscription_id", "stream_id", behind.alias("behind"), F.when(lagged, "SubscriberLagged").alias("error"), "last_delivered", "floor", "tail")


# -- counters and upserts ----------------------------------------------------


def audit(stored: DataFrame, rows: DataFrame, keys: list[str], charge: Column) -> DataFrame:
    """Stored counters (n, charge) against recomputed ones; every key of either side."""
    real = rows.groupBy(*keys).agg(F.count("*").alias("real_n"), F.coalesce(F.sum(charge), F.lit(0)).cast("long").alias("real_charge"))
    met = stored.join(real, keys, "full")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    same = (zero("n") == zero("real_n")) & (zero("charge") == zero("real_charge"))
    return met.select(*keys, zero("n").alias("n"), zero("real_n").alias("real_n"), zero("charge").alias("charge"), zero("real_charge").alias("real_charge"), F.when(~same, "StoreCorrupt").alias("error"))


def upsert(current: DataFrame, changes: DataFrame, keys: list[str], version: str) -> DataFrame:
    """The last version of each key: an aggregate with partial maxima, no join."""
    rest = [c for c in current.columns if c not in keys]
    newest = F.max(F.struct(version, *[c for c in rest if c != version])).alias("row")
    return current.unionByName(changes).groupBy(*keys).agg(newest).select(*keys, *[F.col("row")[c].alias(c) for c in rest])
