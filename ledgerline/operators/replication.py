"""Decisions of journals, snapshots, replicas and restore that span several control tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerline.operators.append import admitted


def retention_status(streams: DataFrame, policies: DataFrame) -> DataFrame:
    """Bounds and retry policy of every stream; without a policy it is Lifetime."""
    met = streams.join(policies, "stream_id", "left")
    return met.select("stream_id", "floor", "tail", F.when(F.col("current").isNull(), "Lifetime").otherwise("Generational").alias("policy"), "oldest", "current")


def lookup_generated(keys: DataFrame, identities: DataFrame, records: DataFrame, policies: DataFrame) -> DataFrame:
    """keys: stream_id, generation, event_id. Finds retained retry identities and their records, also below the floor."""
    met = keys.join(policies, "stream_id", "left")
    error = F.when(F.col("generation") < F.col("oldest"), "RetryGenerationExpired").when(F.col("generation") > F.col("current"), "RetryGenerationAhead")
    held = identities.join(records.select("stream_id", "offset", "schema_id"), ["stream_id", "offset"])
    found = met.withColumn("error", error).join(held, ["stream_id", "generation", "event_id"], "left")
    return found.select("stream_id", "generation", "event_id", "error", F.when(F.col("error").isNull(), F.col("offset")).alias("offset"), F.when(F.col("error").isNull(), F.col("schema_id")).alias("schema_id"))


def advance_generation(requests: DataFrame, policies: DataFrame) -> DataFrame:
    """requests: stream_id, expected_current (null: enable the policy)."""
    met = requests.join(policies, "stream_id", "left")
    enable = F.col("expected_current").isNull()
    error = (
        F.when(enable & F.col("current").isNotNull(), "RetryPolicyConflict")
        .when(~enable & F.col("current").isNull(), "RetryPolicyRequired")
        .when(F.col("expected_current") != F.col("current"), "StaleGeneration")
    )
    after = F.when(error.isNotNull(), F.col("current")).when(enable, F.lit(1)).otherwise(F.col("current") + 1)
    return met.select("stream_id", error.alias("error"), after.cast("long").alias("current_after"))


def capture(requests: DataFrame, sources: DataFrame, receipts: DataFrame) -> DataFrame:
    """capture_segment: contiguous at the captured end, or an exact retry by (start, end, digest) of what starts at the receipt floor or later.

    requests: source_id, start, end, digest. sources: source_id, captured_end, receipt_floor, sealed. receipts: source_id, start, end, digest.
    """
    seen = receipts.select("source_id", "start", F.col("end").alias("seen_end"), F.col("digest").alias("seen_digest"))
    met = requests.join(sources, "source_id", "left").join(seen, ["source_id", "start"], "left")
    same = (F.col("seen_end") == F.col("end")) & (F.col("seen_digest") == F.col("digest"))
    error = (
        F.when(F.col("captured_end").isNull(), "SourceNotFound")
        .when(F.col("start") < F.col("receipt_floor"), "CaptureReceiptExpired")
        .when(F.col("seen_end").isNotNull() & ~same, "CaptureConflict")
        .when(same, F.lit(None))
        .when(F.col("sealed"), "SourceSealed")
        .when(F.col("start") != F.col("captured_end"), "CaptureConflict")
    )
    outcome = F.when(error.isNotNull(), F.lit(None)).when(same, "Deduplicated").otherwise("Captured")
    return met.select("source_id", "start", "end", outcome.alias("outcome"), error.alias("error"))


def append_outputs(outputs: DataFrame, sources: DataFrame, markers: DataFrame) -> DataFrame:
    """append_captured, for outputs in order of their index: past what is captured none is valid, not even a retry; a retry must equal its marker; a fresh one's index must be the next and its source byte not below the one before.

    outputs: source_id, item_index, source_byte, digest. markers: the same of
    appended ones. sources: source_id, next_item, last_byte (or null),
    captured_end, finished. Of fresh outputs the good prefix is appended.
    """
    known = markers.select("source_id", "item_index", F.col("digest").alias("seen"), F.col("source_byte").alias("seen_byte"))
    met = outputs.join(sources, "source_id").join(known, ["source_id", "item_index"], "left")
    order = Window.partitionBy("source_id").orderBy("item_index")
    fresh = F.col("seen").isNull()
    nth = F.sum(F.when(fresh, 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0))
    before = F.max(F.when(fresh, F.col("source_byte"))).over(order.rowsBetween(Window.unboundedPreceding, -1))
    early = (
        F.when(F.col("source_byte") > F.col("captured_end"), "InvalidInput")
        .when(~fresh & ((F.col("seen") != F.col("digest")) | (F.col("seen_byte") != F.col("source_byte"))), "OutputConflict")
        .when(fresh & F.col("finished"), "SourceSealed")
    )
    late = F.when(fresh & ((F.col("item_index") != F.col("next_item") + nth - 1) | F.coalesce(F.col("source_byte") < F.greatest(F.col("last_byte"), before), F.lit(False))), "OutputConflict")
    told = met.withColumns({"early": early, "late": late, "fresh": fresh})
    bad = F.col("early").isNotNull() | F.col("late").isNotNull()
    broken = F.max(F.when(F.col("fresh") & bad, 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, -1))
    # behind a refused output the next index stays where it was
    error = F.coalesce("early", F.when(F.col("fresh") & (F.coalesce(broken, F.lit(0)) == 1), "OutputConflict"), "late")
    return told.withColumn("error", error).select("source_id", "item_index", F.when(F.col("error").isNotNull(), F.lit(None)).when(F.col("fresh"), "Appended").otherwise("Deduplicated").alias("outcome"), "error")


def seal(requests: DataFrame, sources: DataFrame) -> DataFrame:
    """Seal (permanent end, at the captured end; again is the same) and Finish (parser done: its checkpoint is the one that stands, at the sealed end). requests: source_id, action, at."""
    met = requests.join(sources, "source_id")
    at_end = F.col("at") == F.col("captured_end")
    error = (
        F.when((F.col("action") == "Seal") & ~at_end, "InvalidInput")
        .when((F.col("action") == "Finish") & ~(F.col("sealed") & at_end & F.coalesce(F.col("checkpoint") == F.col("at"), F.lit(False))), "CheckpointConflict")
    )
    return met.select("source_id", "action", error.alias("error"), F.when(error.isNull(), True).otherwise(F.col("sealed")).alias("sealed_after"), (error.isNull() & (F.col("action") == "Finish")).alias("finished_after"))


def captured_pages(segments: DataFrame, key: str, lo: int, hi: int) -> DataFrame:
    """Bytes [lo, hi) of each source, whatever its segments; a reclaimed prefix is an error. segments: key, start, bytes."""
    from ledgerline.functions.codec import ordered_bytes

    end = F.col("start") + F.octet_length("bytes")
    first = segments.groupBy(key).agg(F.min("start").alias("available_from"), F.max(end).alias("captured_end"))
    skip = F.greatest(F.lit(lo) - F.col("start"), F.lit(0))
    part = F.substr("bytes", (skip + 1).cast("int"), (F.least(F.lit(hi), end) - F.col("start") - skip).cast("int"))
    page = segments.where((F.col("start") < hi) & (end > lo)).withColumn("part", part).groupBy(key).agg(ordered_bytes(F.col("start"), F.col("part")).alias("page"))
    met = first.join(page, key, "left")
    error = F.when(F.col("available_from") > lo, "MissingCapturedHistory").when(F.col("captured_end") < lo, "CursorAhead")
    return met.select(key, error.alias("error"), F.when(error.isNull(), F.coalesce("page", F.lit(b""))).alias("page"))


def attach(requests: DataFrame, streams: DataFrame, replicas: DataFrame, backlog: DataFrame, per_stream: int) -> DataFrame:
    """attach_replica: FromBeginning needs floor 0 and a backlog within its limit, NeedsBootstrap starts detached; a replica follows a stream once.

    requests: replica_id, stream_id, mode, max_backlog_bytes. replicas: replica_id,
    stream_id. backlog: stream_id, bytes of all records.
    """
    counts = replicas.groupBy("stream_id").agg(F.count("*").alias("n"))
    known = replicas.select("replica_id", "stream_id", F.lit(True).alias("known"))
    met = requests.join(streams, "stream_id", "left").join(counts, "stream_id", "left").join(backlog, "stream_id", "left").join(known, ["replica_id", "stream_id"], "left")
    whole = F.col("mode") == "FromBeginning"
    error = (
        F.when((F.col("max_backlog_bytes") <= 0) | F.col("tail").isNull(), "InvalidInput")
        .when(whole & (F.col("floor") > 0), "NeedsBootstrap")
        .when(whole & (F.coalesce("bytes", F.lit(0)) > F.col("max_backlog_bytes")), "BacklogExceeded")
        .when(F.col("known"), "InvalidInput")
        .when(F.coalesce("n", F.lit(0)) >= per_stream, "CapacityExceeded")
    )
    return met.select("replica_id", "stream_id", error.alias("error"), F.when(error.isNull(), F.when(whole, "Required").otherwise("DetachedNeedsBootstrap")).alias("state"))


def preflight(requests: DataFrame, replicas: DataFrame, now: int) -> DataFrame:
    """What the backlogs of Required and Bootstrapping replicas still take of append requests, in order of arrival: a refused one changes nothing, so a smaller later one may pass.

    requests: seq, stream_id, bytes. replicas: replica_id, stream_id, mode, room
    (bytes left), oldest (time of the oldest record behind, or null), max_age.
    Replicas are asked in order of their ids, each for bytes, then for age; an
    expired one refuses every append.
    """
    asked = replicas.where(F.col("mode").isin("Required", "Bootstrapping")).withColumn("old", F.coalesce(F.lit(now) - F.col("oldest") > F.col("max_age"), F.lit(False)))
    first = asked.where("old").groupBy("stream_id").agg(F.min("replica_id").alias("expired"))
    before = asked.join(first, "stream_id", "left").where("expired is null or replica_id <= expired")
    room = before.groupBy("stream_id").agg(F.min("room").alias("room"), F.first("expired").alias("expired"))
    met = requests.join(room, "stream_id", "left").select("seq", "stream_id", "bytes", "room", "expired")
    stale = met.where("expired is not null").select("seq", "stream_id", F.when(F.col("bytes") > F.col("room"), "ReplicaBacklogExceeded").otherwise("ReplicaBacklogExpired").alias("error"))
    open_ = met.where("expired is null").select("seq", "stream_id", "bytes", F.coalesce("room", F.lit((1 << 63) - 1)).cast("long").alias("room"))
    told = admitted(open_, "room")
    return told.select("seq", "stream_id", F.when(~F.col("admitted"), "ReplicaBacklogExceeded").alias("error")).unionByName(stale)


def commit_batches(batches: DataFrame, streams: DataFrame, receipts: DataFrame) -> DataFrame:
    """commit_replica_batch. batches: batch_id, stream_id, epoch, after, through, digest. streams: stream_id, epoch0, tail, receipt_floor. receipts: batch_id, digest0."""
    met = batches.join(streams, "stream_id").join(receipts, "batch_id", "left")
    same = F.col("digest0") == F.col("digest")
    error = (
        F.when(F.col("epoch") != F.col("epoch0"), "DestinationReplaced")
        .when(F.col("after") < F.col("receipt_floor"), "ReceiptExpired")
        .when(F.col("digest0").isNotNull() & ~same, "BatchConflict")
        .when(same, F.lit(None))
        .when(F.col("after") != F.col("tail"), "StaleProgress")
    )
    outcome = F.when(error.isNotNull(), F.lit(None)).when(same, "Replayed").otherwise("Committed")
    return met.select("batch_id", "stream_id", outcome.alias("outcome"), error.alias("error"), F.when(outcome == "Committed", F.col("through")).otherwise(F.col("tail")).alias("tail_after"))


def published_history(replica: DataFrame, bootstrap: DataFrame, suffix: DataFrame) -> DataFrame:
    """Publishing a verified bootstrap replaces its stream's history by the suffix after the covered position; others stay.

    bootstrap: stream_id, covered, digest, content_digest.
    """
    good = bootstrap.where("digest = content_digest").select("stream_id", "covered")
    fresh = suffix.join(good, "stream_id").where("offset > covered").drop("covered")
    return replica.join(good, "stream_id", "left_anti").unionByName(fresh)


def destination_cleanup(receipts: DataFrame, streams: DataFrame, chunks: DataFrame, bootstraps: DataFrame, published: DataFrame) -> DataFrame:
    """What may go: receipts at or below their stream's floor, chunks of aborted bootstraps and of those another publication superseded."""
    old = receipts.join(streams, "stream_id").where("through <= receipt_floor").select(F.lit("receipt").alias("kind"), F.col("batch_id").alias("id"))
    live = bootstraps.join(published.select("bootstrap_id"), "bootstrap_id", "left_anti").where("state IN ('Aborted', 'Superseded')")
    gone = chunks.join(live.select("bootstrap_id"), "bootstrap_id", "left_semi").select(F.lit("chunk").alias("kind"), F.col("chunk_id").alias("id"))
    return old.unionByName(gone)


def leases(requests: DataFrame, snapshots: DataFrame, streams: DataFrame, now: int, longest: int) -> DataFrame:
    """acquire_recovery: pins (covered, tail] of a published snapshot until it expires; refused below the floor."""
    met = requests.join(snapshots, "snapshot_id", "left").join(streams, "stream_id", "left")
    error = (
        F.when(F.col("state").isNull() | (F.col("state") != "Published"), "SnapshotNotFound")
        .when(F.col("lifetime") > longest, "LeaseTooLong")
        .when(F.col("covered") < F.col("floor"), "HistoryUnavailable")
    )
    good = error.isNull()
    return met.select("snapshot_id", error.alias("error"), F.when(good, F.col("covered")).alias("covered"), F.when(good, F.col("tail")).alias("through"), F.when(good, F.lit(now) + F.col("lifetime")).alias("expires"))


def remapped(rows: DataFrame, mapping: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Rows with their old incarnations replaced, in each of the columns; rows without a mapping are kept with a null, for the audit."""
    for c in columns:
        one = mapping.select(F.col(key).alias(c), F.col("new_incarnation").alias(f"_{c}"))
        rows = rows.join(one, c, "left").withColumn(c, F.col(f"_{c}")).drop(f"_{c}")
    return rows


def restore_audit(streams: DataFrame, records: DataFrame) -> DataFrame:
    """Every lifetime with its record count, extent and whether it is gapless from its floor; empty ones are kept."""
    stats = records.groupBy("stream_id").agg(F.count("*").alias("n"), F.min("offset").alias("lo"), F.max("offset").alias("hi"))
    met = streams.join(stats, "stream_id", "left")
    n = F.coalesce("n", F.lit(0))
    good = F.when(n == 0, F.col("tail") == F.col("floor")).otherwise((F.col("hi") == F.col("tail")) & (F.col("hi") - F.col("lo") + 1 == n) & (F.col("lo") == F.col("floor") + 1))
    return met.select("stream_id", n.cast("long").alias("n"), F.when(~good, "StoreCorrupt").alias("error"))


def backup_digest(spark: SparkSession, path: str) -> str:
    """SHA-256 over the sorted names, lengths and digests of a closed backup's files: one small row a file."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    told = files.select(F.concat_ws("|", F.substring_index("path", "/", -2), F.col("length").cast("string"), F.sha2("content", 256)).alias("line"))
    whole = told.agg(F.sha2(F.array_join(F.array_sort(F.collect_list("line")), "\n"), 256).alias("digest"))
    return whole.first()["digest"]


def upload_progress(events: DataFrame, state: Column | None = None) -> DataFrame:
    """Accepted bytes and state of each upload from its events: snapshot_id, seq, kind (put, verify, publish, abort), bytes.

    Once published an abort changes nothing; once aborted nothing else counts.
    """
    first = lambda kind: F.min(F.when(F.col("kind") == kind, F.col("seq")))
    seen = events.groupBy("snapshot_id").agg(F.sum(F.when(F.col("kind") == "put", F.col("bytes")).otherwise(0)).alias("accepted"), first("verify").alias("v"), first("publish").alias("p"), first("abort").alias("a"))
    aborted = F.col("a").isNotNull() & (F.col("p").isNull() | (F.col("a") < F.col("p")))
    named = F.when(aborted, "Aborted").when(F.col("p").isNotNull() & (F.col("v") < F.col("p")), "Published").when(F.col("v").isNotNull(), "Verified").otherwise("Uploading")
    return seen.select("snapshot_id", F.col("accepted").cast("long").alias("accepted"), named.alias("state"))
