"""Decisions of single operations on journals and replicas, and the audits that hold control tables against what they count.

Operations carry an operation_id. One that was decided before is answered from
its receipt; the same id with another request is a conflict (replayed() in
control tells which). What is left is decided here, each request against the
state as it stands.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def find_streams(keys: DataFrame, names: DataFrame) -> DataFrame:
    """keys: stream_id. The incarnation of active streams, StreamUnavailable for names whose lifetime is over, neither for unknown ones."""
    met = keys.join(names, "stream_id", "left")
    return met.select("stream_id", F.when(F.col("active"), F.col("incarnation")).alias("incarnation"), F.when(~F.col("active"), "StreamUnavailable").alias("error"))


# -- sources -----------------------------------------------------------------


def begin_sources(requests: DataFrame, sources: DataFrame, most: int) -> DataFrame:
    """requests: operation_id, source_id, parser, stream_id. A source is bound once; at most `most` are held."""
    known = sources.select("source_id", F.lit(True).alias("known"))
    full = sources.count() >= most
    met = requests.join(known, "source_id", "left")
    error = F.when(F.col("known"), "SourceBindingConflict").when(F.lit(full), "CapacityExceeded")
    zero = F.lit(0).cast("long")
    return met.select("operation_id", "source_id", error.alias("error"), F.when(error.isNull(), zero).alias("captured_end"), F.when(error.isNull(), zero).alias("receipt_floor"))


def capture_floors(requests: DataFrame, sources: DataFrame) -> DataFrame:
    """advance_capture_receipt_floor: compare and set, monotone, within what is captured. requests: source_id, expected, new. sources: source_id, captured_end, receipt_floor."""
    met = requests.join(sources, "source_id", "left")
    error = (
        F.when(F.col("captured_end").isNull(), "SourceNotFound")
        .when(F.col("expected") != F.col("receipt_floor"), "StaleCaptureReceiptFloor")
        .when(~F.col("new").between(F.col("expected"), F.col("captured_end")), "InvalidInput")
    )
    return met.select("source_id", error.alias("error"), F.when(error.isNull(), F.col("new")).otherwise(F.col("receipt_floor")).alias("floor_after"))


def source_status(sources: DataFrame, segments: DataFrame, markers: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """Progress of each source: where its bytes are held from and to, the next output, and the checkpoint that stands (null: none).

    sources: source_id, sealed. segments: source_id, start, size. markers:
    source_id, item_index. checkpoints: source_id, offset, next_index; the one
    with the largest position stands.
    """
    held = segments.groupBy("source_id").agg(F.min("start").alias("available_from"), F.max(F.col("start") + F.col("size")).alias("captured_end"))
    made = markers.groupBy("source_id").agg((F.max("item_index") + 1).alias("next_item"))
    last = checkpoints.groupBy("source_id").agg(F.max(F.struct("offset", "next_index")).alias("c")).select("source_id", F.col("c.offset").alias("checkpoint"), F.col("c.next_index").alias("checkpoint_index"))
    met = sources.join(held, "source_id", "left").join(made, "source_id", "left").join(last, "source_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    done = F.col("sealed") & F.coalesce(F.col("checkpoint") == F.coalesce("captured_end", F.lit(0)), F.lit(False))
    return met.select("source_id", zero("available_from"), zero("captured_end"), zero("next_item"), "checkpoint", "checkpoint_index", "sealed", done.alias("drained"))


# -- replicas ----------------------------------------------------------------


def detach(requests: DataFrame, replicas: DataFrame) -> DataFrame:
    """detach_replica: whatever the mode, the replica then waits for a bootstrap, protects nothing, and has no pending batch and no backlog."""
    met = requests.join(replicas.select("replica_id", "stream_id", "mode"), ["replica_id", "stream_id"], "left")
    error = F.when(F.col("mode").isNull(), "NotFound")
    zero = F.when(error.isNull(), F.lit(0).cast("long"))
    return met.select("replica_id", "stream_id", error.alias("error"), F.when(error.isNull(), "DetachedNeedsBootstrap").alias("mode_after"), zero.alias("backlog_bytes_after"))


def replica_floors(requests: DataFrame, histories: DataFrame, epoch: str) -> DataFrame:
    """advance_replica_receipt_floor at a destination. requests: stream_id, epoch, expected, new. histories: stream_id, tail, receipt_floor."""
    met = requests.join(histories, "stream_id", "left")
    error = (
        F.when(F.col("epoch") != epoch, "DestinationReplaced")
        .when(F.col("tail").isNull(), "InvalidInput")
        .when((F.col("expected") != F.col("receipt_floor")) | (F.col("new") < F.col("receipt_floor")), "StaleProgress")
        .when(F.col("new") > F.col("tail"), "InvalidInput")
    )
    return met.select("stream_id", error.alias("error"), F.when(error.isNull(), F.col("new")).otherwise(F.col("receipt_floor")).alias("floor_after"))


def begin_bootstraps(requests: DataFrame, snapshots: DataFrame, streams: DataFrame, replicas: DataFrame, records: DataFrame) -> DataFrame:
    """begin_origin_bootstrap: a published snapshot and the records up to a captured tail, for a detached replica whose backlog limit holds the suffix.

    requests: replica_id, stream_id, snapshot_id, covered, captured_tail, epoch.
    snapshots: snapshot_id, stream_id, covered, state. streams: stream_id, tail.
    replicas: replica_id, stream_id, mode, destination_epoch, max_backlog_bytes.
    records: stream_id, offset, bytes.
    """
    held = snapshots.select("snapshot_id", F.col("stream_id").alias("own_stream"), F.col("covered").alias("own_covered"), "state")
    met = requests.join(held, "snapshot_id", "left").join(streams, "stream_id", "left").join(replicas, ["replica_id", "stream_id"], "left")
    ranges = requests.select("replica_id", "stream_id", "covered", "captured_tail")
    suffix = records.join(ranges, "stream_id").where("offset > covered AND offset <= captured_tail").groupBy("replica_id", "stream_id").agg(F.count("*").alias("n"), F.sum("bytes").alias("size"))
    met = met.join(suffix, ["replica_id", "stream_id"], "left")
    size = F.coalesce("size", F.lit(0)).cast("long")
    same = (F.col("state") == "Published") & (F.col("own_stream") == F.col("stream_id")) & (F.col("own_covered") == F.col("covered"))
    error = (
        F.when((F.col("covered") > F.col("captured_tail")) | ~F.coalesce(same, F.lit(False)) | F.col("tail").isNull(), "InvalidInput")
        .when(F.col("captured_tail") > F.col("tail"), "StaleProgress")
        .when(F.col("mode").isNull(), "NotFound")
        .when(F.col("mode") != "DetachedNeedsBootstrap", "InvalidInput")
        .when(F.col("epoch") != F.col("destination_epoch"), "DestinationReplaced")
        .when(size > F.col("max_backlog_bytes"), "BacklogExceeded")
    )
    good = error.isNull()
    return met.select("replica_id", "stream_id", error.alias("error"), F.when(good, "Bootstrapping").alias("mode_after"), F.when(good, F.coalesce("n", F.lit(0)).cast("long")).alias("suffix_records"), F.when(good, size).alias("suffix_bytes"))


def acknowledge_bootstraps(requests: DataFrame, replicas: DataFrame, bootstraps: DataFrame, now: int) -> DataFrame:
    """acknowledge_origin_bootstrap: the receipt of the active attempt, whose lease still stands, makes the replica required; a lease that ran out detaches it.

    requests: replica_id, bootstrap_id, epoch, through. replicas: replica_id.
    bootstraps: replica_id, own_id, own_epoch, captured_tail, expires.
    """
    met = requests.join(replicas.select("replica_id", F.lit(True).alias("known")), "replica_id", "left").join(bootstraps, "replica_id", "left")
    exact = (F.col("bootstrap_id") == F.col("own_id")) & (F.col("epoch") == F.col("own_epoch")) & (F.col("through") == F.col("captured_tail"))
    error = (
        F.when(F.col("known").isNull(), "NotFound")
        .when(F.col("own_id").isNull(), "InvalidInput")
        .when(F.col("expires") <= now, "BootstrapProtectionExpired")
        .when(~exact, "InvalidReceipt")
    )
    mode = F.when(error.isNull(), "Required").when(error == "BootstrapProtectionExpired", "DetachedNeedsBootstrap")
    return met.select("replica_id", error.alias("error"), mode.alias("mode_after"), F.when(error.isNull(), F.col("through")).alias("acknowledged_after"))


# -- audits ------------------------------------------------------------------


def retry_identity_faults(identities: DataFrame, records: DataFrame) -> DataFrame:
    """Retry identities and records that don't answer each other. identities, records: stream_id, generation, event_id, offset."""
    keys = ["stream_id", "generation", "event_id"]
    left = identities.select(*keys, F.col("offset").alias("told"))
    met = left.join(records.select(*keys, F.col("offset").alias("held")), keys, "full_outer")
    fault = F.when(F.col("held").isNull(), "IdentityWithoutRecord").when(F.col("told").isNull(), "RecordWithoutIdentity").when(F.col("told") != F.col("held"), "OffsetMismatch")
    return met.withColumn("fault", fault).where("fault is not null").select(*keys, "fault")


def backlog_faults(replicas: DataFrame, counted: DataFrame) -> DataFrame:
    """Replicas whose stored backlog isn't what their history holds. replicas: replica_id, mode, backlog_records, backlog_bytes. counted: replica_id, rows_behind, bytes_behind. Detached ones hold none."""
    met = replicas.join(counted, "replica_id", "left")
    free = F.col("mode") == "DetachedNeedsBootstrap"
    rows = F.when(free, 0).otherwise(F.coalesce("rows_behind", F.lit(0)))
    size = F.when(free, 0).otherwise(F.coalesce("bytes_behind", F.lit(0)))
    return met.where((F.col("backlog_records") != rows) | (F.col("backlog_bytes") != size)).select("replica_id", rows.cast("long").alias("rows_due"), size.cast("long").alias("bytes_due"), F.lit("StoreCorrupt").alias("error"))


def restored_replicas(replicas: DataFrame, mapping: DataFrame, epoch: str) -> DataFrame:
    """Attachments after a restore: of the new lifetimes, detached, without backlog, bound to a fresh destination epoch. Rows without a mapping fail the audit."""
    met = replicas.join(mapping, "stream_id", "left")
    zero = F.lit(0).cast("long")
    return met.select(
        "replica_id", "stream_id", F.col("new_incarnation").alias("incarnation"), F.lit("DetachedNeedsBootstrap").alias("mode"), F.lit(epoch).alias("destination_epoch"),
        zero.alias("backlog_records"), zero.alias("backlog_bytes"), F.when(F.col("new_incarnation").isNull(), "StoreCorrupt").alias("error"),
    )


def restored_snapshots(snapshots: DataFrame, chunks: DataFrame, mapping: DataFrame) -> DataFrame:
    """Published snapshots of the new lifetimes, each verified again: size and digest of its chunks in order. snapshots: snapshot_id, stream_id, content_bytes, digest. chunks: snapshot_id, offset, bytes."""
    from ledgerline.functions import codec

    whole = chunks.groupBy("snapshot_id").agg(codec.ordered_bytes(F.col("offset"), F.col("bytes")).alias("content"))  # at most snapshot_bytes each
    found = whole.select("snapshot_id", F.octet_length("content").cast("long").alias("size"), codec.digest(F.col("content")).alias("found"))
    met = snapshots.join(found, "snapshot_id", "left").join(mapping, "stream_id", "left")
    error = F.when(F.col("new_incarnation").isNull(), "StoreCorrupt").when((F.coalesce("size", F.lit(0)) != F.col("content_bytes")) | (F.coalesce("found", F.sha2(F.lit(b""), 256)) != F.col("digest")), "ChecksumMismatch")
    return met.select("snapshot_id", "stream_id", F.col("new_incarnation").alias("incarnation"), error.alias("error"))
