"""Queries of single operations, status reads, audits and restored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.functions import codec
from ledgerline.operators import control
from ledgerline.operators import operations as ops
from ledgerline.plans import tables
from ledgerline.plans.catalogue import query
from ledgerline.plans.tables import CHUNKS, LOG, REPLICAS, read

number = lambda sql: F.expr(sql).cast("long")


@query(f"""WITH {LOG}, names AS (SELECT stream_id, md5('inc-' || stream_id) AS inc, n % 4 <> 1 AS active FROM tails), k AS (SELECT stream_id FROM tails UNION ALL SELECT 'x' || stream_id FROM tails)
SELECT k.stream_id, CASE WHEN active THEN inc END AS incarnation, CASE WHEN NOT active THEN 'StreamUnavailable' END AS error FROM k LEFT JOIN names USING (stream_id)""")
def find_stream(spark: SparkSession, d: str) -> DataFrame:
    t = tables.tails(spark, d)
    names = t.select("stream_id", F.md5(F.concat(F.lit("inc-"), "stream_id")).alias("incarnation"), F.expr("n % 4 <> 1").alias("active"))
    return ops.find_streams(t.select("stream_id").unionByName(t.select(F.concat(F.lit("x"), "stream_id").alias("stream_id"))), names)


@query("""SELECT doc_id, CASE WHEN strlen(text) <= 37 THEN text ELSE left(text, CAST(list_max(list_filter(range(0, 38), lambda k: strlen(left(text, k)) <= 37)) AS BIGINT)) END AS detail FROM documents""")
def bounded_detail(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", codec.bounded_text(F.col("text"), 37).alias("detail"))


@query(f"""WITH {CHUNKS}, u AS (SELECT lpad(CAST(conv_id AS VARCHAR), 12, '0') AS snapshot_id, sum(size) AS accepted, ['Uploading', 'Verifying', 'Verified', 'Published', 'Aborted'][conv_id % 5 + 1] AS state FROM chunks GROUP BY conv_id),
s AS (SELECT *, row_number() OVER (ORDER BY snapshot_id) AS rank, sum(192 + strlen(snapshot_id)) OVER (ORDER BY snapshot_id) AS cum FROM u WHERE state IN ('Uploading', 'Verifying', 'Verified') AND snapshot_id > '000000000003')
SELECT snapshot_id, CAST(accepted AS BIGINT) AS accepted, state FROM s WHERE rank <= 9 AND cum <= 1700""")
def snapshot_uploads_page(spark: SparkSession, d: str) -> DataFrame:
    """The next page of uploads that are neither published nor aborted."""
    name = F.lpad(F.col("conv_id").cast("string"), 12, "0")
    made = tables.chunks(spark, d).groupBy("conv_id").agg(F.sum("size").alias("accepted")).select(name.alias("snapshot_id"), number("accepted").alias("accepted"), F.expr("element_at(array('Uploading', 'Verifying', 'Verified', 'Published', 'Aborted'), cast(conv_id % 5 + 1 AS int))").alias("state"))
    # the page's rows by key first, so that running sums see no more than a page
    ahead = made.where("state IN ('Uploading', 'Verifying', 'Verified') AND snapshot_id > '000000000003'").orderBy("snapshot_id").limit(9)
    cut = control.bounded(ahead.withColumns({"all": F.lit(1), "bytes": F.octet_length("snapshot_id") + 192}), ["all"], ["snapshot_id"], F.col("bytes"), 9, 1700)
    return cut.select("snapshot_id", "accepted", "state")


@query(f"""WITH {LOG}, f AS (SELECT stream_id, CASE WHEN n % 3 = 0 THEN 0 ELSE tail // 2 END AS floor FROM tails)
SELECT stream_id, EXISTS (SELECT 1 FROM log l WHERE l.stream_id = f.stream_id AND l.pos <= f.floor AND l.pos > 16) AS remaining FROM f""")
def cleanup_remaining(spark: SparkSession, d: str) -> DataFrame:
    """Whether a cleanup of 16 rows a stream leaves more to do: a semi-join, no count."""
    floors = tables.tails(spark, d).select("stream_id", F.expr("CASE WHEN n % 3 = 0 THEN 0 ELSE tail div 2 END").alias("floor"))
    more = tables.log(spark, d).select(F.col("stream_id").alias("s"), "offset")
    left = floors.join(more, (F.col("s") == F.col("stream_id")) & (F.col("offset") <= F.col("floor")) & (F.col("offset") > 16), "left_semi").select("stream_id", F.lit(True).alias("remaining"))
    return floors.select("stream_id").join(left, "stream_id", "left").select("stream_id", F.coalesce("remaining", F.lit(False)).alias("remaining"))


@query(f"""WITH {LOG}, s AS (SELECT stream_id FROM tails WHERE n % 3 = 0), h AS (SELECT count(*) AS held FROM s)
SELECT 'op-' || t.stream_id AS operation_id, t.stream_id AS source_id, CASE WHEN s.stream_id IS NOT NULL THEN 'SourceBindingConflict' WHEN held >= 1000000 THEN 'CapacityExceeded' END AS error, CASE WHEN s.stream_id IS NULL THEN 0 END AS captured_end, CASE WHEN s.stream_id IS NULL THEN 0 END AS receipt_floor FROM tails t LEFT JOIN s USING (stream_id), h""")
def journal_begin(spark: SparkSession, d: str) -> DataFrame:
    t = tables.tails(spark, d)
    asked = t.select(F.concat(F.lit("op-"), "stream_id").alias("operation_id"), F.col("stream_id").alias("source_id"), F.lit("p1").alias("parser"), "stream_id")
    return ops.begin_sources(asked, t.where("n % 3 = 0").select(F.col("stream_id").alias("source_id")), 1_000_000)


@query(f"""WITH {CHUNKS}, s AS (SELECT conv_id, sum(size) AS e, conv_id % 4 * 5 AS f FROM chunks GROUP BY 1),
q AS (SELECT *, f + CASE WHEN conv_id % 5 = 0 THEN 1 ELSE 0 END AS expected, CASE conv_id % 3 WHEN 0 THEN f - 1 WHEN 1 THEN e ELSE e + CASE WHEN conv_id % 2 = 0 THEN 1 ELSE -1 END END AS want, conv_id % 7 = 6 AS lost FROM s),
r AS (SELECT *, CASE WHEN lost THEN 'SourceNotFound' WHEN expected <> f THEN 'StaleCaptureReceiptFloor' WHEN want < expected OR want > e THEN 'InvalidInput' END AS error FROM q)
SELECT conv_id AS source_id, error, CAST(CASE WHEN lost THEN NULL WHEN error IS NULL THEN want ELSE f END AS BIGINT) AS floor_after FROM r""")
def capture_floor_advance(spark: SparkSession, d: str) -> DataFrame:
    made = tables.chunks(spark, d).groupBy(F.col("conv_id").alias("source_id")).agg(F.sum("size").alias("captured_end")).withColumn("receipt_floor", number("source_id % 4 * 5"))
    want = number("CASE source_id % 3 WHEN 0 THEN receipt_floor - 1 WHEN 1 THEN captured_end ELSE captured_end + CASE WHEN source_id % 2 = 0 THEN 1 ELSE -1 END END")
    asked = made.select("source_id", number("receipt_floor + CASE WHEN source_id % 5 = 0 THEN 1 ELSE 0 END").alias("expected"), want.alias("new"))
    return ops.capture_floors(asked, made.where("source_id % 7 <> 6"))


@query(f"""WITH {CHUNKS}, c AS (SELECT conv_id, min(pos) AS lo, max(pos + size) AS hi, count(*) AS items FROM chunks WHERE NOT (conv_id % 6 = 0 AND turn = 0) GROUP BY 1), s AS (SELECT DISTINCT conv_id FROM chunks),
k AS (SELECT conv_id, max(pos) AS checkpoint, arg_max(turn, pos) AS at FROM (SELECT conv_id, turn, pos + size AS pos FROM chunks WHERE conv_id % 3 <> 1 AND size > 0) GROUP BY 1)
SELECT s.conv_id AS source_id, CAST(coalesce(lo, 0) AS BIGINT) AS available_from, CAST(coalesce(hi, 0) AS BIGINT) AS captured_end, CAST(coalesce(items, 0) AS BIGINT) AS next_item, CAST(checkpoint AS BIGINT) AS checkpoint, CAST(k.at AS BIGINT) AS checkpoint_index,
  s.conv_id % 2 = 0 AS sealed, s.conv_id % 2 = 0 AND coalesce(checkpoint = coalesce(hi, 0), false) AS drained FROM s LEFT JOIN c USING (conv_id) LEFT JOIN k USING (conv_id)""")
def source_progress(spark: SparkSession, d: str) -> DataFrame:
    made = tables.chunks(spark, d).withColumnRenamed("conv_id", "source_id")
    sources = made.select("source_id").distinct().withColumn("sealed", F.expr("source_id % 2 = 0"))
    held = made.where("NOT (source_id % 6 = 0 AND turn = 0)").select("source_id", F.col("offset").alias("start"), "size", "turn")
    from pyspark.sql import Window

    nth = F.row_number().over(Window.partitionBy("source_id").orderBy("start", "turn")) - 1
    marks = made.where("source_id % 3 <> 1 AND size > 0").select("source_id", (F.col("offset") + F.col("size")).alias("offset"), number("turn").alias("next_index"))
    return ops.source_status(sources, held, held.select("source_id", nth.alias("item_index")), marks)


@query(f"""WITH {LOG}, {REPLICAS}, q AS (SELECT 'r1-' || stream_id AS replica_id, stream_id FROM tails UNION ALL SELECT 'r9-' || stream_id, stream_id FROM tails)
SELECT q.replica_id, q.stream_id, CASE WHEN r.mode IS NULL THEN 'NotFound' END AS error, CASE WHEN r.mode IS NOT NULL THEN 'DetachedNeedsBootstrap' END AS mode_after, CASE WHEN r.mode IS NOT NULL THEN 0 END AS backlog_bytes_after FROM q LEFT JOIN replicas r ON r.replica_id = q.replica_id AND r.stream_id = q.stream_id""")
def replica_detach(spark: SparkSession, d: str) -> DataFrame:
    t = tables.tails(spark, d)
    asked = t.select(F.explode(F.array(F.lit("r1-"), F.lit("r9-"))).alias("p"), "stream_id").select(F.concat("p", "stream_id").alias("replica_id"), "stream_id")
    return ops.detach(asked, tables.replicas(spark, d))


@query(f"""WITH {LOG}, q AS (SELECT stream_id, n, tail, n % 4 * 3 AS floor, n % 11 = 0 AS lost, CASE WHEN n % 7 = 0 THEN 'old' ELSE 'now' END AS epoch, n % 4 * 3 + CASE WHEN n % 5 = 0 THEN 1 ELSE 0 END AS expected, CASE n % 3 WHEN 0 THEN tail + 1 WHEN 1 THEN tail ELSE 5 END AS want FROM tails),
r AS (SELECT *, CASE WHEN epoch <> 'now' THEN 'DestinationReplaced' WHEN lost THEN 'InvalidInput' WHEN expected <> floor OR want < floor THEN 'StaleProgress' WHEN want > tail THEN 'InvalidInput' END AS error FROM q)
SELECT stream_id, error, CAST(CASE WHEN error IS NULL THEN want WHEN lost THEN NULL ELSE floor END AS BIGINT) AS floor_after FROM r""")
def replica_floor_advance(spark: SparkSession, d: str) -> DataFrame:
    t = tables.tails(spark, d).withColumn("receipt_floor", number("n % 4 * 3"))
    asked = t.select("stream_id", F.expr("CASE WHEN n % 7 = 0 THEN 'old' ELSE 'now' END AS epoch"), number("receipt_floor + CASE WHEN n % 5 = 0 THEN 1 ELSE 0 END").alias("expected"), number("CASE n % 3 WHEN 0 THEN tail + 1 WHEN 1 THEN tail ELSE 5 END").alias("new"))
    return ops.replica_floors(asked, t.where("n % 11 <> 0").select("stream_id", "tail", "receipt_floor"), "now")


@query(f"""WITH {LOG}, q AS (SELECT 'r-' || stream_id AS replica_id, stream_id, n, tail, tail // 2 AS covered, CASE n % 9 WHEN 0 THEN tail // 2 - 1 WHEN 1 THEN tail + 1 ELSE tail END AS cap, CASE WHEN n % 8 = 0 THEN 'Verified' ELSE 'Published' END AS state, n % 10 = 9 AS lost, CASE WHEN n % 6 = 5 THEN 'Required' ELSE 'DetachedNeedsBootstrap' END AS mode, CASE WHEN n % 7 = 3 THEN 'old' ELSE 'now' END AS epoch FROM tails),
z AS (SELECT q.stream_id, count(*) AS n, sum(l.bytes) AS size FROM q JOIN log l ON l.stream_id = q.stream_id AND l.pos > covered AND l.pos <= cap GROUP BY 1),
r AS (SELECT q.*, z.n AS suffix, coalesce(z.size, 0) AS size, CASE WHEN covered > cap OR state <> 'Published' THEN 'InvalidInput' WHEN cap > tail THEN 'StaleProgress' WHEN lost THEN 'NotFound' WHEN mode = 'Required' THEN 'InvalidInput' WHEN epoch <> 'now' THEN 'DestinationReplaced' WHEN coalesce(z.size, 0) > 6000 THEN 'BacklogExceeded' END AS error FROM q LEFT JOIN z USING (stream_id))
SELECT replica_id, stream_id, error, CASE WHEN error IS NULL THEN 'Bootstrapping' END AS mode_after, CASE WHEN error IS NULL THEN coalesce(suffix, 0) END AS suffix_records, CAST(CASE WHEN error IS NULL THEN size END AS BIGINT) AS suffix_bytes FROM r""")
def origin_bootstrap_begin(spark: SparkSession, d: str) -> DataFrame:
    t = tables.tails(spark, d).withColumns({"replica_id": F.concat(F.lit("r-"), "stream_id"), "snapshot_id": F.concat(F.lit("s-"), "stream_id"), "covered": number("tail div 2")})
    asked = t.select("replica_id", "stream_id", "snapshot_id", "covered", number("CASE n % 9 WHEN 0 THEN tail div 2 - 1 WHEN 1 THEN tail + 1 ELSE tail END").alias("captured_tail"), F.expr("CASE WHEN n % 7 = 3 THEN 'old' ELSE 'now' END AS epoch"))
    snapshots = t.select("snapshot_id", "stream_id", "covered", F.expr("CASE WHEN n % 8 = 0 THEN 'Verified' ELSE 'Published' END AS state"))
    replicas = t.where("n % 10 <> 9").select("replica_id", "stream_id", F.expr("CASE WHEN n % 6 = 5 THEN 'Required' ELSE 'DetachedNeedsBootstrap' END AS mode"), F.lit("now").alias("destination_epoch"), F.lit(6000).alias("max_backlog_bytes"))
    return ops.begin_bootstraps(asked, snapshots, t.select("stream_id", "tail"), replicas, tables.log(spark, d).select("stream_id", "offset", "bytes"))


@query(f"""WITH {LOG}, {REPLICAS}, q AS (SELECT replica_id, ack, mode, CASE WHEN ack % 3 = 0 THEN 1000 ELSE 3000 END AS expires, ack % 5 <> 0 AS id_ok, ack % 7 <> 0 AS epoch_ok, ack + CASE WHEN ack % 11 = 0 THEN 1 ELSE 0 END AS through FROM replicas),
r AS (SELECT *, CASE WHEN mode <> 'Bootstrapping' THEN 'InvalidInput' WHEN expires <= 2000 THEN 'BootstrapProtectionExpired' WHEN NOT (id_ok AND epoch_ok AND through = ack) THEN 'InvalidReceipt' END AS error FROM q)
SELECT replica_id, error, CASE WHEN error IS NULL THEN 'Required' WHEN error = 'BootstrapProtectionExpired' THEN 'DetachedNeedsBootstrap' END AS mode_after, CASE WHEN error IS NULL THEN through END AS acknowledged_after FROM r UNION ALL SELECT 'r3-' || stream_id, 'NotFound', NULL, NULL FROM tails""")
def origin_bootstrap_ack(spark: SparkSession, d: str) -> DataFrame:
    held = tables.replicas(spark, d)
    asked = held.select("replica_id", F.expr("CASE WHEN acknowledged % 5 <> 0 THEN 'b' ELSE 'other' END AS bootstrap_id"), F.expr("CASE WHEN acknowledged % 7 <> 0 THEN 'now' ELSE 'old' END AS epoch"), number("acknowledged + CASE WHEN acknowledged % 11 = 0 THEN 1 ELSE 0 END").alias("through"))
    lost = tables.tails(spark, d).select(F.concat(F.lit("r3-"), "stream_id").alias("replica_id"), F.lit("b").alias("bootstrap_id"), F.lit("now").alias("epoch"), F.lit(0).cast("long").alias("through"))
    active = held.where("mode = 'Bootstrapping'").select("replica_id", F.lit("b").alias("own_id"), F.lit("now").alias("own_epoch"), F.col("acknowledged").alias("captured_tail"), F.expr("CASE WHEN acknowledged % 3 = 0 THEN 1000 ELSE 3000 END AS expires"))
    return ops.acknowledge_bootstraps(asked.unionByName(lost), held, active, 2000)


@query(f"""WITH {LOG}, r AS (SELECT stream_id, pos % 3 AS generation, event_id, pos FROM log), i AS (SELECT stream_id, generation, event_id, CASE WHEN pos % 13 = 0 THEN pos + 1 ELSE pos END AS told FROM r WHERE pos % 17 <> 0 UNION ALL SELECT stream_id, 9, 'ghost', 1 FROM tails)
SELECT stream_id, generation, event_id, CASE WHEN pos IS NULL THEN 'IdentityWithoutRecord' WHEN told IS NULL THEN 'RecordWithoutIdentity' ELSE 'OffsetMismatch' END AS fault FROM i FULL JOIN r USING (stream_id, generation, event_id) WHERE pos IS NULL OR told IS NULL OR told <> pos""")
def retry_identity_audit(spark: SparkSession, d: str) -> DataFrame:
    records = tables.log(spark, d).select("stream_id", number("offset % 3").alias("generation"), "event_id", "offset")
    told = records.where("offset % 17 <> 0").withColumn("offset", number("CASE WHEN offset % 13 = 0 THEN offset + 1 ELSE offset END"))
    ghosts = tables.tails(spark, d).select("stream_id", F.lit(9).cast("long").alias("generation"), F.lit("ghost").alias("event_id"), F.lit(1).cast("long").alias("offset"))
    return ops.retry_identity_faults(told.unionByName(ghosts), records)


@query(f"""WITH {LOG}, {REPLICAS}, c AS (SELECT r.replica_id, count(l.pos) AS n, coalesce(sum(l.bytes + 256), 0) AS b FROM replicas r LEFT JOIN log l ON l.stream_id = r.stream_id AND l.pos > r.ack GROUP BY 1),
s AS (SELECT r.replica_id, CASE r.mode WHEN 'Detached' THEN 'DetachedNeedsBootstrap' ELSE r.mode END AS mode, n + CASE WHEN ack % 5 = 0 THEN 1 ELSE 0 END AS rows_told, b AS bytes_told, n, b FROM replicas r JOIN c USING (replica_id)),
e AS (SELECT *, CASE WHEN mode = 'DetachedNeedsBootstrap' THEN 0 ELSE n END AS rows_due, CASE WHEN mode = 'DetachedNeedsBootstrap' THEN 0 ELSE b END AS bytes_due FROM s)
SELECT replica_id, CAST(rows_due AS BIGINT) AS rows_due, CAST(bytes_due AS BIGINT) AS bytes_due, 'StoreCorrupt' AS error FROM e WHERE rows_told <> rows_due OR bytes_told <> bytes_due""")
def restored_backlog_audit(spark: SparkSession, d: str) -> DataFrame:
    records = tables.log(spark, d).select("stream_id", "offset", (F.col("bytes") + 256).alias("bytes"))
    counted = control.backlog(tables.replicas(spark, d), records)
    told = counted.select("replica_id", F.expr("CASE mode WHEN 'Detached' THEN 'DetachedNeedsBootstrap' ELSE mode END AS mode"), number("rows_behind + CASE WHEN acknowledged % 5 = 0 THEN 1 ELSE 0 END").alias("backlog_records"), F.col("bytes_behind").alias("backlog_bytes"))
    return ops.backlog_faults(told, counted.select("replica_id", "rows_behind", "bytes_behind"))


@query(f"""WITH {LOG}, {REPLICAS}, m AS (SELECT stream_id, md5('new-' || stream_id) AS inc FROM tails WHERE n % 10 <> 0)
SELECT r.replica_id, r.stream_id, m.inc AS incarnation, 'DetachedNeedsBootstrap' AS mode, 'fresh' AS destination_epoch, 0 AS backlog_records, 0 AS backlog_bytes, CASE WHEN m.inc IS NULL THEN 'StoreCorrupt' END AS error FROM replicas r LEFT JOIN m USING (stream_id)""")
def restored_replicas(spark: SparkSession, d: str) -> DataFrame:
    mapping = tables.tails(spark, d).where("n % 10 <> 0").select("stream_id", F.md5(F.concat(F.lit("new-"), "stream_id")).alias("new_incarnation"))
    return ops.restored_replicas(tables.replicas(spark, d), mapping, "fresh")


@query(f"""WITH {CHUNKS}, s AS (SELECT conv_id, CAST(sum(size) AS BIGINT) + CASE WHEN conv_id % 9 = 0 THEN 1 ELSE 0 END AS told, sha256(string_agg(text, '' ORDER BY pos, turn)) AS digest, CAST(sum(size) AS BIGINT) AS n FROM chunks WHERE size > 0 GROUP BY 1)
SELECT CAST(conv_id AS VARCHAR) AS snapshot_id, CAST(conv_id AS VARCHAR) AS stream_id, CASE WHEN conv_id % 10 <> 3 THEN md5('new-' || conv_id) END AS incarnation, CASE WHEN conv_id % 10 = 3 THEN 'StoreCorrupt' WHEN told <> n OR conv_id % 7 = 0 THEN 'ChecksumMismatch' END AS error FROM s""")
def restored_snapshots(spark: SparkSession, d: str) -> DataFrame:
    made = tables.chunks(spark, d).where("size > 0")
    name = F.col("conv_id").cast("string")
    whole = made.groupBy("conv_id").agg(codec.ordered_bytes(F.col("offset"), F.col("bytes")).alias("content"), F.sum("size").alias("n"))
    told = whole.select(name.alias("snapshot_id"), name.alias("stream_id"), number("n + CASE WHEN conv_id % 9 = 0 THEN 1 ELSE 0 END").alias("content_bytes"), F.when(F.col("conv_id") % 7 == 0, "bad").otherwise(codec.digest(F.col("content"))).alias("digest"))
    mapping = whole.where("conv_id % 10 <> 3").select(name.alias("stream_id"), F.md5(F.concat(F.lit("new-"), name)).alias("new_incarnation"))
    return ops.restored_snapshots(told, made.select(name.alias("snapshot_id"), "offset", "bytes"), mapping)
