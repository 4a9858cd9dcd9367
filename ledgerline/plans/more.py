"""Queries of journals, leases, replicas and restore."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.operators import append, control
from ledgerline.operators import replication as ops
from ledgerline.plans import tables
from ledgerline.plans.catalogue import query
from ledgerline.plans.tables import CHUNKS, LOG, REPLICAS, read

number = lambda sql: F.expr(sql).cast("long")


def _policies(spark: SparkSession, d: str) -> DataFrame:
    return tables.tails(spark, d).where("n % 3 <> 0").select("stream_id", number("n % 4").alias("oldest"), number("n % 4 + 4").alias("current"))


_POLICIES = "policies AS (SELECT stream_id, n % 4 AS oldest, n % 4 + 4 AS cur FROM tails WHERE n % 3 <> 0)"


@query(f"""WITH {LOG}, {_POLICIES} SELECT t.stream_id, n % 5 AS floor, tail, CASE WHEN cur IS NULL THEN 'Lifetime' ELSE 'Generational' END AS policy, oldest, cur AS "current" FROM tails t LEFT JOIN policies USING (stream_id)""")
def retention_status(spark: SparkSession, d: str) -> DataFrame:
    return ops.retention_status(tables.tails(spark, d).select("stream_id", number("n % 5").alias("floor"), "tail"), _policies(spark, d))


@query(f"""WITH {LOG}, {_POLICIES}, k AS (SELECT stream_id, pos % 9 AS generation, event_id, pos, schema_id FROM log),
e AS (SELECT k.*, CASE WHEN generation < oldest THEN 'RetryGenerationExpired' WHEN generation > cur THEN 'RetryGenerationAhead' END AS error FROM k LEFT JOIN policies USING (stream_id))
SELECT stream_id, generation, event_id, error, CASE WHEN error IS NULL AND pos % 2 = 0 THEN pos END AS "offset", CASE WHEN error IS NULL AND pos % 2 = 0 THEN schema_id END AS schema_id FROM e""")
def lookup_generated(spark: SparkSession, d: str) -> DataFrame:
    records = tables.log(spark, d).withColumn("generation", F.col("offset") % 9)
    keys = records.select("stream_id", "generation", "event_id")
    identities = records.where("offset % 2 = 0").select("stream_id", "generation", "event_id", "offset")
    return ops.lookup_generated(keys, identities, records, _policies(spark, d))


@query(f"""WITH {LOG}, {_POLICIES}, q AS (SELECT stream_id, n, CASE n % 4 WHEN 0 THEN NULL WHEN 1 THEN n % 4 + 4 ELSE 4 END AS expected FROM tails), m AS (SELECT q.*, cur FROM q LEFT JOIN policies USING (stream_id)),
e AS (SELECT *, CASE WHEN expected IS NULL AND cur IS NOT NULL THEN 'RetryPolicyConflict' WHEN expected IS NOT NULL AND cur IS NULL THEN 'RetryPolicyRequired' WHEN expected <> cur THEN 'StaleGeneration' END AS error FROM m)
SELECT stream_id, error, CASE WHEN error IS NOT NULL THEN cur WHEN expected IS NULL THEN 1 ELSE cur + 1 END AS current_after FROM e""")
def generation_advance(spark: SparkSession, d: str) -> DataFrame:
    asked = tables.tails(spark, d).select("stream_id", number("CASE n % 4 WHEN 0 THEN NULL WHEN 1 THEN n % 4 + 4 ELSE 4 END").alias("expected_current"))
    return ops.advance_generation(asked, _policies(spark, d))


@query(f"""WITH {CHUNKS}, x AS (SELECT conv_id, turn, pos AS s, pos + size AS e, sha256(text) AS digest, max(pos + size) OVER (PARTITION BY conv_id) AS total, max(turn) OVER (PARTITION BY conv_id) AS last FROM chunks),
q AS (SELECT conv_id, turn, s, e, CASE WHEN turn = 1 AND conv_id % 3 = 0 THEN 'other' ELSE digest END AS digest, turn < last - 1 AND turn > 0 AS seen, digest AS d0 FROM x),
src AS (SELECT conv_id, max(CASE WHEN turn = greatest(last - 1, 0) THEN s END) AS captured FROM x GROUP BY 1),
m AS (SELECT q.*, captured, q.seen AND digest = d0 AS same, CASE WHEN s < 30 THEN 'CaptureReceiptExpired' WHEN q.seen AND digest <> d0 THEN 'CaptureConflict' WHEN q.seen THEN NULL WHEN conv_id % 4 = 0 THEN 'SourceSealed' WHEN s <> captured THEN 'CaptureConflict' END AS error FROM q JOIN src USING (conv_id))
SELECT conv_id AS source_id, s AS start, e AS "end", CASE WHEN error IS NOT NULL THEN NULL WHEN same THEN 'Deduplicated' ELSE 'Captured' END AS outcome, error FROM m""")
def capture_decisions(spark: SparkSession, d: str) -> DataFrame:
    made = tables.chunks(spark, d)
    last = made.groupBy("conv_id").agg(F.max("turn").alias("last"))
    x = made.join(last, "conv_id").select(F.col("conv_id").alias("source_id"), "turn", F.col("offset").alias("start"), (F.col("offset") + F.col("size")).alias("end"), F.sha2("bytes", 256).alias("digest"), "last")
    asked = x.select("source_id", "start", "end", F.when((F.col("turn") == 1) & (F.col("source_id") % 3 == 0), "other").otherwise(F.col("digest")).alias("digest"))
    sources = x.groupBy("source_id").agg(F.max(F.when(F.expr("turn = greatest(last - 1, 0)"), F.col("start"))).alias("captured_end")).select("source_id", "captured_end", F.lit(30).alias("receipt_floor"), F.expr("source_id % 4 = 0").alias("sealed"))
    return ops.capture(asked, sources, x.where("turn < last - 1 AND turn > 0").select("source_id", "start", "end", "digest"))


@query(f"""WITH {LOG}, m AS (SELECT stream_id, pos AS item_index, pos * 10 - CASE WHEN pos = 33 AND CAST(stream_id AS BIGINT) % 4 = 0 THEN 50 ELSE 0 END AS b, pos <= 20 AS seen, (pos = 7 AND CAST(stream_id AS BIGINT) % 5 = 0) OR (pos = 9 AND CAST(stream_id AS BIGINT) % 6 = 0) AS other, CAST(stream_id AS BIGINT) % 9 = 0 AS finished FROM log),
e AS (SELECT *, CASE WHEN b > 400 THEN 'InvalidInput' WHEN seen AND other THEN 'OutputConflict' WHEN NOT seen AND finished THEN 'SourceSealed' END AS early, CASE WHEN NOT seen AND b < greatest(200, coalesce(max(CASE WHEN NOT seen THEN b END) OVER (PARTITION BY stream_id ORDER BY item_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) THEN 'OutputConflict' END AS late FROM m),
f AS (SELECT *, coalesce(early, CASE WHEN NOT seen AND coalesce(max(CASE WHEN NOT seen AND (early IS NOT NULL OR late IS NOT NULL) THEN 1 ELSE 0 END) OVER (PARTITION BY stream_id ORDER BY item_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 THEN 'OutputConflict' END, late) AS final FROM e)
SELECT stream_id AS source_id, item_index, CASE WHEN final IS NOT NULL THEN NULL WHEN seen THEN 'Deduplicated' ELSE 'Appended' END AS outcome, final AS error FROM f""")
def captured_append(spark: SparkSession, d: str) -> DataFrame:
    records = tables.log(spark, d)
    n = F.col("stream_id").cast("long")
    byte = F.col("offset") * 10 - F.when((F.col("offset") == 33) & (n % 4 == 0), 50).otherwise(0)
    outputs = records.select(F.col("stream_id").alias("source_id"), F.col("offset").alias("item_index"), byte.alias("source_byte"), F.col("event_id").alias("digest"))
    seen = records.where("offset <= 20").select(F.col("stream_id").alias("source_id"), F.col("offset").alias("item_index"), F.when((F.col("offset") == 7) & (n % 5 == 0), "other").otherwise(F.col("event_id")).alias("digest"), (byte + F.when((F.col("offset") == 9) & (n % 6 == 0), 1).otherwise(0)).alias("source_byte"))
    sources = records.select(F.col("stream_id").alias("source_id")).distinct().select("source_id", F.lit(21).alias("next_item"), F.lit(200).alias("last_byte"), F.lit(400).alias("captured_end"), F.expr("cast(source_id AS BIGINT) % 9 = 0").alias("finished"))
    return ops.append_outputs(outputs, sources, seen)


@query(f"""WITH {LOG}, q AS (SELECT stream_id, n, CASE WHEN n % 2 = 0 THEN 'Seal' ELSE 'Finish' END AS action, n % 4 < 2 AS sealed, CASE WHEN n % 3 = 0 THEN tail - 1 ELSE tail END AS "at", CASE WHEN n % 5 = 0 THEN tail - 2 ELSE tail END AS cp, tail FROM tails),
e AS (SELECT *, CASE WHEN action = 'Seal' AND "at" <> tail THEN 'InvalidInput' WHEN action = 'Finish' AND NOT (sealed AND "at" = tail AND cp = "at") THEN 'CheckpointConflict' END AS error FROM q)
SELECT stream_id AS source_id, action, error, CASE WHEN error IS NULL THEN true ELSE sealed END AS sealed_after, error IS NULL AND action = 'Finish' AS finished_after FROM e""")
def source_finalization(spark: SparkSession, d: str) -> DataFrame:
    t = tables.tails(spark, d)
    asked = t.select(F.col("stream_id").alias("source_id"), F.when(F.expr("n % 2 = 0"), "Seal").otherwise("Finish").alias("action"), F.expr("CASE WHEN n % 3 = 0 THEN tail - 1 ELSE tail END").alias("at"))
    sources = t.select(F.col("stream_id").alias("source_id"), F.expr("n % 4 < 2").alias("sealed"), F.col("tail").alias("captured_end"), F.expr("CASE WHEN n % 5 = 0 THEN tail - 2 ELSE tail END").alias("checkpoint"))
    return ops.seal(asked, sources)


@query(f"""WITH {CHUNKS}, kept AS (SELECT * FROM chunks WHERE NOT (conv_id % 6 = 0 AND turn = 0)), f AS (SELECT conv_id, min(pos) AS lo, max(pos + size) AS hi FROM kept GROUP BY 1),
p AS (SELECT conv_id, string_agg(hex(encode(text)[greatest(5 - pos, 0) + 1 : least(90, pos + size) - pos]), '' ORDER BY pos, turn) AS page FROM kept WHERE pos < 90 AND pos + size > 5 GROUP BY 1)
SELECT f.conv_id AS source_id, CASE WHEN lo > 5 THEN 'MissingCapturedHistory' WHEN hi < 5 THEN 'CursorAhead' END AS error, CASE WHEN lo <= 5 AND hi >= 5 THEN coalesce(page, '') END AS page FROM f LEFT JOIN p USING (conv_id)""")
def captured_page(spark: SparkSession, d: str) -> DataFrame:
    kept = tables.chunks(spark, d).where("NOT (conv_id % 6 = 0 AND turn = 0)").select(F.col("conv_id").alias("source_id"), F.col("offset").alias("start"), "bytes")
    return ops.captured_pages(kept, "source_id", 5, 90).select("source_id", "error", F.hex("page").alias("page"))


@query(f"""WITH {LOG}, {REPLICAS}, x AS (SELECT r.replica_id, l.pos, l.event_id, r.ack, t.tail - 3 AS rtail FROM replicas r JOIN tails t USING (stream_id) JOIN log l USING (stream_id))
SELECT replica_id, pos AS "offset", event_id FROM x WHERE pos > ack AND pos <= rtail AND pos <= ack + 5""")
def replica_read_after(spark: SparkSession, d: str) -> DataFrame:
    """Pages of replica histories that lack their origin's last three records."""
    replicas = tables.replicas(spark, d).select("replica_id", "stream_id", "acknowledged")
    held = tables.log(spark, d).join(tables.tails(spark, d).select("stream_id", "tail"), "stream_id").where("offset <= tail - 3")
    return held.join(replicas, "stream_id").where("offset > acknowledged AND offset <= acknowledged + 5").select("replica_id", "offset", "event_id")


@query(f"""WITH {LOG}, {REPLICAS}, q AS (SELECT CASE WHEN n % 6 = 0 THEN 'r1-' || stream_id ELSE 'new-' || stream_id END AS replica_id, stream_id, CASE WHEN n % 4 = 3 THEN 'NeedsBootstrap' ELSE 'FromBeginning' END AS mode, n FROM tails),
b AS (SELECT stream_id, sum(bytes) AS b FROM log GROUP BY 1), c AS (SELECT stream_id, count(*) AS n FROM replicas WHERE NOT (stream_id LIKE '1%' AND replica_id LIKE 'r2-%') GROUP BY 1), k AS (SELECT replica_id FROM replicas WHERE NOT (stream_id LIKE '1%' AND replica_id LIKE 'r2-%')),
e AS (SELECT q.replica_id, q.stream_id, q.mode, CASE WHEN q.n % 13 = 0 THEN 'InvalidInput' WHEN mode = 'FromBeginning' AND q.n % 5 > 3 THEN 'NeedsBootstrap' WHEN mode = 'FromBeginning' AND b > 12000 THEN 'BacklogExceeded' WHEN k.replica_id IS NOT NULL THEN 'InvalidInput' WHEN coalesce(c.n, 0) >= 2 THEN 'CapacityExceeded' END AS error
  FROM q LEFT JOIN c USING (stream_id) LEFT JOIN b USING (stream_id) LEFT JOIN k ON k.replica_id = q.replica_id)
SELECT replica_id, stream_id, error, CASE WHEN error IS NULL THEN CASE mode WHEN 'FromBeginning' THEN 'Required' ELSE 'DetachedNeedsBootstrap' END END AS state FROM e""")
def replica_attach(spark: SparkSession, d: str) -> DataFrame:
    t = tables.tails(spark, d)
    name = F.when(F.expr("n % 6 = 0"), F.concat(F.lit("r1-"), "stream_id")).otherwise(F.concat(F.lit("new-"), "stream_id"))
    asked = t.select(name.alias("replica_id"), "stream_id", F.when(F.expr("n % 4 = 3"), "NeedsBootstrap").otherwise("FromBeginning").alias("mode"), F.expr("CASE WHEN n % 13 = 0 THEN 0 ELSE 12000 END").alias("max_backlog_bytes"))
    streams = t.select("stream_id", F.expr("CASE WHEN n % 5 > 3 THEN 1 ELSE 0 END").alias("floor"), "tail")
    held = tables.replicas(spark, d).where("NOT (stream_id LIKE '1%' AND replica_id LIKE 'r2-%')")
    return ops.attach(asked, streams, held, tables.log(spark, d).groupBy("stream_id").agg(F.sum("bytes").alias("bytes")), 2)


@query(f"""WITH RECURSIVE {LOG}, {REPLICAS}, r AS (SELECT replica_id, stream_id, 3000 + ack * 50 AS room, (replica_id LIKE 'r1-%' AND n % 7 = 0) OR (replica_id LIKE 'r2-%' AND n % 5 = 0) AS old FROM replicas JOIN tails USING (stream_id) WHERE mode IN ('Required', 'Bootstrapping')),
x AS (SELECT stream_id, min(CASE WHEN old THEN replica_id END) AS expired FROM r GROUP BY 1), m AS (SELECT r.stream_id, min(room) AS room, min(expired) AS expired FROM r JOIN x USING (stream_id) WHERE expired IS NULL OR replica_id <= expired GROUP BY 1),
l AS (SELECT log.stream_id, pos, bytes, coalesce(room, 1000000000) AS room, expired FROM log LEFT JOIN m USING (stream_id)),
f AS (SELECT stream_id, 0 AS pos, 0 AS used, CAST(NULL AS VARCHAR) AS error FROM tails UNION ALL
  SELECT f.stream_id, l.pos, f.used + CASE WHEN expired IS NULL AND f.used + l.bytes <= room THEN l.bytes ELSE 0 END, CASE WHEN expired IS NOT NULL THEN CASE WHEN l.bytes > room THEN 'ReplicaBacklogExceeded' ELSE 'ReplicaBacklogExpired' END WHEN f.used + l.bytes > room THEN 'ReplicaBacklogExceeded' END
  FROM f JOIN l ON l.stream_id = f.stream_id AND l.pos = f.pos + 1)
SELECT CAST(pos AS BIGINT) AS seq, stream_id, error FROM f WHERE pos > 0""")
def append_preflight(spark: SparkSession, d: str) -> DataFrame:
    old = F.expr("(replica_id LIKE 'r1-%' AND cast(stream_id AS BIGINT) % 7 = 0) OR (replica_id LIKE 'r2-%' AND cast(stream_id AS BIGINT) % 5 = 0)")
    replicas = tables.replicas(spark, d).withColumns({"room": F.col("acknowledged") * 50 + 3000, "oldest": F.when(old, F.lit(0)), "max_age": F.lit(1000)})
    return ops.preflight(tables.log(spark, d).select(F.col("offset").cast("long").alias("seq"), "stream_id", F.col("bytes").cast("long").alias("bytes")), replicas, 2000)


@query(f"""WITH {LOG}, q AS (SELECT 'b-' || stream_id AS batch_id, stream_id, n, CASE WHEN n % 7 = 0 THEN 'old' ELSE 'now' END AS epoch, CASE WHEN n % 3 = 0 THEN tail - 1 ELSE tail END AS after, tail, md5(stream_id) AS digest, CASE WHEN n % 5 = 0 THEN md5(stream_id) WHEN n % 5 = 1 THEN 'x' END AS d0 FROM tails),
e AS (SELECT *, after + 4 AS through, CASE WHEN epoch <> 'now' THEN 'DestinationReplaced' WHEN after < 55 THEN 'ReceiptExpired' WHEN d0 IS NOT NULL AND d0 <> digest THEN 'BatchConflict' WHEN d0 = digest THEN NULL WHEN after <> tail THEN 'StaleProgress' END AS error FROM q),
o AS (SELECT *, CASE WHEN error IS NOT NULL THEN NULL WHEN d0 = digest THEN 'Replayed' ELSE 'Committed' END AS outcome FROM e)
SELECT batch_id, stream_id, outcome, error, CASE WHEN outcome = 'Committed' THEN through ELSE tail END AS tail_after FROM o""")
def replica_commit_batch(spark: SparkSession, d: str) -> DataFrame:
    t = tables.tails(spark, d)
    name = F.concat(F.lit("b-"), "stream_id").alias("batch_id")
    after = F.expr("CASE WHEN n % 3 = 0 THEN tail - 1 ELSE tail END")
    batches = t.select(name, "stream_id", F.when(F.expr("n % 7 = 0"), "old").otherwise("now").alias("epoch"), after.alias("after"), (after + 4).alias("through"), F.md5("stream_id").alias("digest"))
    streams = t.select("stream_id", F.lit("now").alias("epoch0"), "tail", F.lit(55).alias("receipt_floor"))
    receipts = t.where("n % 5 IN (0, 1)").select(name, F.when(F.expr("n % 5 = 0"), F.md5("stream_id")).otherwise("x").alias("digest0"))
    return ops.commit_batches(batches, streams, receipts)


@query(f"""WITH {LOG}, b AS (SELECT stream_id, tail // 2 AS covered FROM tails WHERE n % 3 = 0 AND n % 2 = 0)
SELECT l.stream_id, l.pos AS "offset", l.event_id FROM log l LEFT JOIN b USING (stream_id) WHERE (b.covered IS NULL AND l.pos <= 30) OR l.pos > b.covered""")
def bootstrap_publish(spark: SparkSession, d: str) -> DataFrame:
    """A third of the streams have a bootstrap; of these every second one's digest doesn't match and changes nothing."""
    records = tables.log(spark, d).select("stream_id", "offset", "event_id")
    t = tables.tails(spark, d).where("n % 3 = 0")
    made = t.select("stream_id", F.expr("tail div 2").alias("covered"), F.md5("stream_id").alias("digest"), F.when(F.expr("n % 2 = 0"), F.md5("stream_id")).otherwise("bad").alias("content_digest"))
    return ops.published_history(records.where("offset <= 30"), made, records)


@query(f"""WITH {LOG}, s AS (SELECT stream_id, n % 7 * 10 AS rf FROM tails), b AS (SELECT 'bs-' || stream_id AS bootstrap_id, ['Staging', 'Aborted', 'Superseded', 'Published'][n % 4 + 1] AS state, n FROM tails)
SELECT 'receipt' AS kind, l.event_id AS id FROM log l JOIN s USING (stream_id) WHERE l.pos <= s.rf UNION ALL
SELECT 'chunk', l.event_id FROM log l JOIN b ON b.bootstrap_id = 'bs-' || l.stream_id WHERE l.pos <= 3 AND state IN ('Aborted', 'Superseded') AND n % 8 <> 1""")
def destination_cleanup(spark: SparkSession, d: str) -> DataFrame:
    records, t = tables.log(spark, d), tables.tails(spark, d)
    name = F.concat(F.lit("bs-"), "stream_id").alias("bootstrap_id")
    receipts = records.select("stream_id", F.col("offset").alias("through"), F.col("event_id").alias("batch_id"))
    state = F.element_at(F.array(*[F.lit(s) for s in ("Staging", "Aborted", "Superseded", "Published")]), (F.col("n") % 4 + 1).cast("int"))
    chunks = records.where("offset <= 3").select(name, F.col("event_id").alias("chunk_id"))
    return ops.destination_cleanup(receipts, t.select("stream_id", F.expr("n % 7 * 10").alias("receipt_floor")), chunks, t.select(name, state.alias("state")), t.where("n % 8 = 1").select(name))


@query(f"""WITH {LOG}, q AS (SELECT 'sn-' || stream_id AS snapshot_id, stream_id, n, tail, tail // 4 AS covered, n % 20 AS floor, n * 10000 AS life, n % 6 <> 0 AS published FROM tails),
e AS (SELECT *, CASE WHEN NOT published THEN 'SnapshotNotFound' WHEN life > 300000 THEN 'LeaseTooLong' WHEN covered < floor THEN 'HistoryUnavailable' END AS error FROM q)
SELECT snapshot_id, error, CASE WHEN error IS NULL THEN covered END AS covered, CASE WHEN error IS NULL THEN tail END AS through, CASE WHEN error IS NULL THEN 5000 + life END AS expires FROM e""")
def recovery_lease(spark: SparkSession, d: str) -> DataFrame:
    t = tables.tails(spark, d)
    name = F.concat(F.lit("sn-"), "stream_id").alias("snapshot_id")
    snapshots = t.select(name, "stream_id", F.expr("tail div 4").alias("covered"), F.when(F.expr("n % 6 <> 0"), "Published").otherwise("Verified").alias("state"))
    return ops.leases(t.select(name, F.expr("n * 10000").alias("lifetime")), snapshots, t.select("stream_id", F.expr("n % 20").alias("floor"), "tail"), 5000, 300_000)


@query(f"""WITH {CHUNKS}, e AS (SELECT conv_id, CAST(sum(size) AS BIGINT) AS accepted, max(turn) AS last FROM chunks GROUP BY 1)
SELECT conv_id AS snapshot_id, accepted, CASE WHEN conv_id % 5 = 0 THEN 'Aborted' WHEN conv_id % 4 = 0 THEN 'Uploading' WHEN conv_id % 4 = 1 THEN 'Verified' ELSE 'Published' END AS state FROM e""")
def snapshot_upload_progress(spark: SparkSession, d: str) -> DataFrame:
    made = tables.chunks(spark, d)
    puts = made.select(F.col("conv_id").alias("snapshot_id"), F.col("turn").alias("seq"), F.lit("put").alias("kind"), F.col("size").alias("bytes"))
    ids = made.select(F.col("conv_id").alias("snapshot_id")).distinct()
    event = lambda kind, seq, where: ids.where(where).select("snapshot_id", F.lit(seq).cast("long").alias("seq"), F.lit(kind).alias("kind"), F.lit(0).cast("long").alias("bytes"))
    events = puts.unionByName(event("verify", 1000, "snapshot_id % 4 > 0")).unionByName(event("publish", 1002, "snapshot_id % 4 > 1")).unionByName(event("abort", 1001, "snapshot_id % 5 = 0")).unionByName(event("abort", 1003, "snapshot_id % 4 = 3"))
    return ops.upload_progress(events)


@query(f"""WITH {LOG}, r AS (SELECT * FROM log WHERE NOT (CAST(stream_id AS BIGINT) % 9 = 0 AND pos = 5) AND NOT (CAST(stream_id AS BIGINT) % 10 = 3)), g AS (SELECT stream_id, count(*) AS n, max(pos) AS hi FROM r GROUP BY 1)
SELECT t.stream_id, coalesce(g.n, 0) AS n, CASE WHEN t.n % 9 = 0 AND g.n IS NOT NULL THEN 'StoreCorrupt' END AS error FROM tails t LEFT JOIN g USING (stream_id)""")
def restore_audit(spark: SparkSession, d: str) -> DataFrame:
    """One record is missing of every ninth stream; every tenth is empty and says so."""
    n = F.col("stream_id").cast("long")
    records = tables.log(spark, d).where(~((n % 9 == 0) & (F.col("offset") == 5)) & ~(n % 10 == 3))
    streams = tables.tails(spark, d).select("stream_id", F.lit(0).cast("long").alias("floor"), F.expr("CASE WHEN n % 10 = 3 THEN 0 ELSE tail END").cast("long").alias("tail"))
    return ops.restore_audit(streams, records)


@query("""WITH m AS (SELECT c_custkey AS id, md5('new-' || CAST(c_custkey AS VARCHAR)) AS new FROM customer WHERE c_custkey % 10 <> 0)
SELECT o_orderkey, a.new AS stream, b.new AS mapped_pair FROM orders o LEFT JOIN m a ON a.id = o.o_custkey LEFT JOIN m b ON b.id = o.o_custkey + 1""")
def restore_remap_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Rows that name two lifetimes; what the mapping lacks stays null for the audit."""
    mapping = read(spark, d, "customer").where("c_custkey % 10 <> 0").select(F.col("c_custkey").alias("old_id"), F.md5(F.concat(F.lit("new-"), F.col("c_custkey").cast("string"))).alias("new_incarnation"))
    rows = read(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("stream"), (F.col("o_custkey") + 1).alias("mapped_pair"))
    return ops.remapped(rows, mapping, "old_id", ["stream", "mapped_pair"])


@query(f"""WITH {LOG}, x AS (SELECT 'op-' || CAST(o_orderkey AS VARCHAR) AS operation_id, o_orderpriority AS request, CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority WHEN o_orderkey % 3 = 1 THEN 'other' END AS seen FROM orders)
SELECT operation_id, CASE WHEN seen = request THEN 'Replayed' WHEN seen IS NOT NULL THEN 'OperationConflict' END AS replay FROM x""")
def operation_replay(spark: SparkSession, d: str) -> DataFrame:
    orders = read(spark, d, "orders")
    name = F.concat(F.lit("op-"), F.col("o_orderkey").cast("string")).alias("operation_id")
    receipts = orders.where("o_orderkey % 3 < 2").select(name, F.when(F.expr("o_orderkey % 3 = 0"), F.col("o_orderpriority")).otherwise("other").alias("request"), F.lit("done").alias("receipt"))
    return control.replayed(orders.select(name, F.col("o_orderpriority").alias("request")), receipts).select("operation_id", "replay")


@query(f"""WITH {LOG}, w AS (SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY pos) AS k FROM log) SELECT stream_id, count(*) AS accepted, count(*) FILTER (bytes <= 165) AS inserted, CAST(0 AS BIGINT) AS deduplicated, count(*) FILTER (bytes > 165) AS failed FROM w GROUP BY 1""")
def append_size_limit(spark: SparkSession, d: str) -> DataFrame:
    """Requests over the size limit are refused and use up no identity and no offset."""
    records = tables.log(spark, d)
    asked = records.select(F.col("offset").alias("seq"), "stream_id", "event_id", "schema_id", "schema_version", "payload")
    empty = records.limit(0).select("stream_id", "event_id", "schema_id", "schema_version", "payload", "offset")
    zero = tables.tails(spark, d).select("stream_id", F.lit(0).cast("long").alias("tail"))
    return append.counts(append.resolve(asked, empty, zero, max_bytes=165))
