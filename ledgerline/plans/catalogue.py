"""All registered queries of the event log, with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerline.functions import codec
from ledgerline.operators import append, control, framing
from ledgerline.operators import log as logs
from ledgerline.plans import tables
from ledgerline.plans.tables import CHUNKS, FOLDED, LEASES, LOG, REPLICAS, read

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, tuple[Query, str | None]] = {}
PAGE_RECORDS, PAGE_BYTES = 16, 3000
NOW = 1_000_000


def query(sql: str | None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = (f, sql)
        return f

    return add


def queries() -> dict[str, Query]:
    return {k: f for k, (f, _) in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for k, (_, s) in _QUERIES.items() if s}


long = lambda c: F.col(c).cast("long").alias(c)

# -- reads -------------------------------------------------------------------


@query(f'WITH {LOG} SELECT stream_id, event_id, pos AS "offset" FROM log')
def log_offsets(spark: SparkSession, d: str) -> DataFrame:
    return tables.log(spark, d).select("stream_id", "event_id", "offset")


@query(f"WITH {LOG} SELECT stream_id, CAST(0 AS BIGINT) AS floor, tail FROM tails")
def log_bounds(spark: SparkSession, d: str) -> DataFrame:
    return logs.bounds(tables.log(spark, d))


@query(f"""WITH {LOG}, k AS (SELECT DISTINCT CAST(o_orderkey AS VARCHAR) AS event_id, CAST(o_custkey AS VARCHAR) AS stream_id FROM orders)
SELECT k.stream_id, k.event_id, l.pos AS "offset", l.schema_id FROM k LEFT JOIN log l ON l.stream_id = k.stream_id AND l.event_id = k.event_id""")
def log_lookup(spark: SparkSession, d: str) -> DataFrame:
    keys = read(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("stream_id"), F.col("o_orderkey").cast("string").alias("event_id")).distinct()
    return logs.lookup(tables.log(spark, d), keys).select("stream_id", "event_id", "offset", "schema_id")


def _cursors(spark: SparkSession, d: str) -> DataFrame:
    t = tables.tails(spark, d)
    return t.select("stream_id", F.expr("tail div 2").alias("after"), F.expr("tail - n % 3").alias("through"), F.lit(0).cast("long").alias("floor"), "tail")


_CURSORS = "cursors AS (SELECT stream_id, tail // 2 AS after, tail - n % 3 AS through, 0 AS floor, tail FROM tails)"


@query(f"""WITH {LOG}, {_CURSORS} SELECT l.stream_id, l.pos AS "offset", l.event_id, l.schema_id, md5(l.payload) AS payload_md5 FROM log l JOIN cursors c USING (stream_id)
WHERE l.pos > c.after AND l.pos <= c.through AND l.pos <= c.after + {PAGE_RECORDS}""")
def log_read_after(spark: SparkSession, d: str) -> DataFrame:
    page = logs.pages(tables.log(spark, d), _cursors(spark, d).select("stream_id", "after", "through"), PAGE_RECORDS, 1 << 40)
    return page.select("stream_id", "offset", "event_id", "schema_id", F.md5("payload").alias("payload_md5"))


_PAGED = f"""paged AS (SELECT l.*, c.after, c.through, l.pos - c.after AS k, CAST(sum(l.bytes) OVER (PARTITION BY l.stream_id ORDER BY l.pos) AS BIGINT) AS cum
  FROM log l JOIN cursors c USING (stream_id) WHERE l.pos > c.after AND l.pos <= c.through),
page AS (SELECT *, CASE WHEN k = 1 AND cum > {PAGE_BYTES} THEN 'CapacityExceeded' END AS error FROM paged WHERE k <= {PAGE_RECORDS} AND (cum <= {PAGE_BYTES} OR k = 1))"""


@query(f'WITH {LOG}, {_CURSORS}, {_PAGED} SELECT stream_id, pos AS "offset", event_id, CAST(bytes AS BIGINT) AS bytes, cum AS cum_bytes, error FROM page')
def log_page_bytes(spark: SparkSession, d: str) -> DataFrame:
    page = logs.pages(tables.log(spark, d), _cursors(spark, d).select("stream_id", "after", "through"), PAGE_RECORDS, PAGE_BYTES)
    return page.select("stream_id", "offset", "event_id", "bytes", "cum_bytes", "error")


@query(f"""WITH {LOG}, c0 AS (SELECT stream_id, CASE WHEN n % 5 = 0 THEN tail + 1 WHEN n % 5 = 1 THEN 1 ELSE tail // 2 END AS after, CASE WHEN n % 7 = 0 THEN 2 ELSE tail END AS through,
  CASE WHEN n % 5 = 1 THEN 2 ELSE 0 END AS floor, tail FROM tails),
c AS (SELECT *, CASE WHEN after < floor THEN 'HistoryUnavailable' WHEN after > tail OR through > tail THEN 'CursorAhead' WHEN after > through THEN 'InvalidConfig' END AS refused FROM c0),
paged AS (SELECT l.*, c.after, l.pos - c.after AS k, sum(l.bytes) OVER (PARTITION BY l.stream_id ORDER BY l.pos) AS cum FROM log l JOIN c USING (stream_id) WHERE c.refused IS NULL AND l.pos > c.after AND l.pos <= c.through),
g AS (SELECT stream_id, count(*) AS n_records, sum(bytes) AS n_bytes, max(pos) AS last FROM paged WHERE k <= {PAGE_RECORDS} AND cum <= {PAGE_BYTES} GROUP BY 1)
SELECT c.stream_id, c.refused AS error, CAST(coalesce(g.n_records, 0) AS BIGINT) AS n_records, CAST(coalesce(g.n_bytes, 0) AS BIGINT) AS n_bytes,
  CAST(CASE WHEN c.refused IS NULL THEN coalesce(g.last, c.after) END AS BIGINT) AS next_after, CAST(c.through AS BIGINT) AS through, CASE WHEN c.refused IS NULL THEN coalesce(g.last, c.after) = c.through END AS complete
FROM c LEFT JOIN g USING (stream_id)""")
def log_page_summary(spark: SparkSession, d: str) -> DataFrame:
    t = tables.tails(spark, d)
    after = F.expr("CASE WHEN n % 5 = 0 THEN tail + 1 WHEN n % 5 = 1 THEN 1 ELSE tail div 2 END").cast("long").alias("after")
    cursors = t.select("stream_id", after, F.expr("CASE WHEN n % 7 = 0 THEN 2 ELSE tail END").cast("long").alias("through"), F.expr("CASE WHEN n % 5 = 1 THEN 2 ELSE 0 END").cast("long").alias("floor"), "tail")
    return logs.page_summaries(tables.log(spark, d), cursors, PAGE_RECORDS, PAGE_BYTES)


@query("""SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, expected, l_partkey FROM (
  SELECT *, CAST(coalesce(lag(l_linenumber) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) + 1, 1) AS BIGINT) AS expected FROM lineitem) WHERE l_linenumber <> expected""")
def log_gap_audit(spark: SparkSession, d: str) -> DataFrame:
    lines = read(spark, d, "lineitem")
    found = logs.gaps(lines, ["l_orderkey"], "l_linenumber", ["l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate"])
    return found.select("l_orderkey", long("l_linenumber"), "expected", "l_partkey")


@query(f"""WITH {LOG} SELECT stream_id, pos AS "offset", event_id, CASE WHEN pos <= 20 THEN 0 ELSE 1 END AS generation FROM log""")
def log_merged_replay(spark: SparkSession, d: str) -> DataFrame:
    records = tables.log(spark, d)
    legacy = records.where("offset <= 20")
    generated = records.where("offset > 20").withColumn("generation", F.lit(1).cast("long"))
    return logs.merged(legacy, generated).select("stream_id", "offset", "event_id", F.col("generation").cast("int").alias("generation"))


# -- appends -----------------------------------------------------------------

_RESOLVED = """f AS (SELECT *, first_value(p) OVER w AS fp, min(seq) OVER (PARTITION BY s, id) AS fs FROM b WINDOW w AS (PARTITION BY s, id ORDER BY seq)),
i AS (SELECT s, id, row_number() OVER (PARTITION BY s ORDER BY fs) AS pos FROM (SELECT DISTINCT s, id, fs FROM f)),
r AS (SELECT seq, s, id, CASE WHEN seq = fs THEN 'Inserted' WHEN p = fp THEN 'Deduplicated' END AS outcome, CASE WHEN p <> fp THEN 'IdempotencyConflict' END AS error_code, CASE WHEN p = fp THEN pos END AS pos FROM f JOIN i USING (s, id))"""


def _resolved(spark: SparkSession, d: str) -> DataFrame:
    requests = tables.folded(spark, d)
    empty = spark.createDataFrame([], "stream_id string, generation long, event_id string, schema_id string, schema_version long, payload binary, offset long")
    return append.resolve(requests, empty, requests.select("stream_id").distinct().withColumn("tail", F.lit(0).cast("long")))


@query(f'WITH {FOLDED}, {_RESOLVED} SELECT seq, s AS stream_id, id AS event_id, outcome, error_code, pos AS "offset" FROM r')
def append_resolve(spark: SparkSession, d: str) -> DataFrame:
    return _resolved(spark, d).select("seq", "stream_id", "event_id", "outcome", "error_code", "offset")


@query(f"""WITH {FOLDED}, {_RESOLVED} SELECT s AS stream_id, count(*) AS accepted, count(*) FILTER (outcome = 'Inserted') AS inserted, count(*) FILTER (outcome = 'Deduplicated') AS deduplicated, count(error_code) AS failed FROM r GROUP BY 1""")
def append_outcome_counts(spark: SparkSession, d: str) -> DataFrame:
    return append.counts(_resolved(spark, d))


@query(f"""WITH {FOLDED}, m AS (SELECT max(seq) // 2 AS half FROM b), h AS (SELECT s, id, p, seq FROM b, m WHERE seq <= half), q AS (SELECT b.* FROM b, m WHERE seq > half),
hf AS (SELECT s, id, arg_min(p, seq) AS hp, min(seq) AS fs FROM h GROUP BY 1, 2), held AS (SELECT s, id, hp, row_number() OVER (PARTITION BY s ORDER BY fs) AS hpos FROM hf),
t AS (SELECT s, max(hpos) AS tail FROM held GROUP BY 1),
f AS (SELECT q.*, held.hp, held.hpos, min(seq) OVER (PARTITION BY q.s, q.id) AS fs, first_value(q.p) OVER (PARTITION BY q.s, q.id ORDER BY q.seq) AS fp FROM q LEFT JOIN held ON held.s = q.s AND held.id = q.id),
n AS (SELECT s, id, row_number() OVER (PARTITION BY s ORDER BY fs) AS k FROM (SELECT DISTINCT s, id, fs FROM f WHERE hp IS NULL))
SELECT f.seq, f.s AS stream_id, CASE WHEN f.hp IS NULL AND f.seq = f.fs THEN 'Inserted' WHEN f.p = coalesce(f.hp, f.fp) THEN 'Deduplicated' END AS outcome,
  CASE WHEN f.p <> coalesce(f.hp, f.fp) THEN 'IdempotencyConflict' END AS error_code, CAST(CASE WHEN f.p = coalesce(f.hp, f.fp) THEN coalesce(f.hpos, coalesce(t.tail, 0) + n.k) END AS BIGINT) AS "offset"
FROM f LEFT JOIN n ON n.s = f.s AND n.id = f.id LEFT JOIN t ON t.s = f.s""")
def append_batch_order(spark: SparkSession, d: str) -> DataFrame:
    """The second half of all requests against a log that holds the first half."""
    requests = tables.folded(spark, d)
    half = requests.agg(F.expr("max(seq) div 2").alias("half"))
    split = requests.crossJoin(F.broadcast(half))  # one row
    early, late = split.where("seq <= half").drop("half"), split.where("seq > half").drop("half")
    empty = spark.createDataFrame([], "stream_id string, event_id string, schema_id string, schema_version long, payload binary, offset long")
    none = requests.select("stream_id").distinct().withColumn("tail", F.lit(0).cast("long"))
    held = append.resolve(early, empty, none).where("outcome = 'Inserted'")
    now = append.resolve(late, held.select(*empty.columns), held.groupBy("stream_id").agg(F.max("offset").alias("tail")))
    return now.select("seq", "stream_id", "outcome", "error_code", "offset")


@query(f"""WITH {FOLDED}, o AS (SELECT *, CASE WHEN g < 2 THEN 'RetryGenerationExpired' WHEN g > 5 THEN 'RetryGenerationAhead' END AS refused FROM b),
f AS (SELECT *, first_value(p) OVER (PARTITION BY s, g, id ORDER BY seq) AS fp, min(seq) OVER (PARTITION BY s, g, id) AS fs FROM o WHERE refused IS NULL),
i AS (SELECT s, g, id, row_number() OVER (PARTITION BY s ORDER BY fs) AS pos FROM (SELECT DISTINCT s, g, id, fs FROM f))
SELECT seq, s AS stream_id, g AS generation, CASE WHEN seq = fs THEN 'Inserted' WHEN p = fp THEN 'Deduplicated' END AS outcome, CASE WHEN p <> fp THEN 'IdempotencyConflict' END AS error_code, CASE WHEN p = fp THEN pos END AS "offset" FROM f JOIN i USING (s, g, id)
UNION ALL SELECT seq, s, g, NULL, refused, NULL FROM o WHERE refused IS NOT NULL""")
def append_generated_resolve(spark: SparkSession, d: str) -> DataFrame:
    requests = tables.folded(spark, d)
    empty = spark.createDataFrame([], "stream_id string, generation long, event_id string, schema_id string, schema_version long, payload binary, offset long")
    number = lambda n, name: F.lit(n).cast("long").alias(name)
    streams = requests.select("stream_id").distinct().select("stream_id", number(0, "tail"), number(2, "oldest"), number(5, "current"))
    return append.resolve_generated(requests, empty, streams).select("seq", "stream_id", "generation", "outcome", "error_code", "offset")


@query(f"""WITH RECURSIVE {LOG}, f AS (SELECT stream_id, 0 AS pos, 0 AS size, 0 AS n, 0 AS used, true AS fits FROM tails UNION ALL
  SELECT f.stream_id, l.pos, l.bytes, f.n + CASE WHEN f.n < 48 AND f.used + l.bytes <= 8000 THEN 1 ELSE 0 END, f.used + CASE WHEN f.n < 48 AND f.used + l.bytes <= 8000 THEN l.bytes ELSE 0 END, f.n < 48 AND f.used + l.bytes <= 8000 FROM f JOIN log l ON l.stream_id = f.stream_id AND l.pos = f.pos + 1)
SELECT stream_id, CAST(pos AS BIGINT) AS seq, CAST(size AS BIGINT) AS bytes, fits AS admitted FROM f WHERE pos > 0""")
def append_admission(spark: SparkSession, d: str) -> DataFrame:
    """Greedy quota of each stream; a request that doesn't fit uses up nothing."""
    records = tables.log(spark, d)
    return append.admit(records.select("stream_id", F.col("offset").alias("seq"), F.col("bytes").cast("long").alias("bytes")), 48, 8000).select("stream_id", "seq", "bytes", "admitted")


@query(f"""WITH {LOG}, x AS (SELECT stream_id || '-' || CAST((pos - 1) // 16 AS VARCHAR) AS batch_id, (pos - 1) // 16 * 16 + CASE WHEN CAST(stream_id AS BIGINT) % 6 = 0 THEN 1 ELSE 0 END AS after, pos FROM log)
SELECT batch_id, after, count(*) AS n_records, max(pos) AS through, min(pos) = after + 1 AND max(pos) = after + count(*) AS contiguous FROM x GROUP BY 1, 2""")
def replica_batch_contiguity(spark: SparkSession, d: str) -> DataFrame:
    part = F.expr("(offset - 1) div 16")
    records = tables.log(spark, d).select("stream_id", "offset", F.concat("stream_id", F.lit("-"), part.cast("string")).alias("batch_id"), (part * 16 + F.expr("CASE WHEN cast(stream_id AS BIGINT) % 6 = 0 THEN 1 ELSE 0 END")).alias("after"))
    return append.contiguous(records)


# -- functions ---------------------------------------------------------------


@query(f"""WITH {LOG} SELECT stream_id, pos AS "offset", 'esc_0100' || lpad(lower(to_hex(strlen(stream_id))), 4, '0') || lower(hex(stream_id)) || inc || lpad(lower(to_hex(pos)), 16, '0') AS token FROM log""")
def cursor_encode(spark: SparkSession, d: str) -> DataFrame:
    return tables.log(spark, d).select("stream_id", "offset", codec.encode_token(F.col("stream_id"), F.col("incarnation"), F.col("offset")).alias("token"))


@query(f"""WITH {LOG}, x AS (SELECT stream_id, inc, pos, pos % 16 AS k FROM log)
SELECT stream_id AS source, pos AS "offset", CASE k WHEN 1 THEN 'InvalidPrefix' WHEN 2 THEN 'UnsupportedVersion' WHEN 3 THEN 'InvalidEncoding' WHEN 4 THEN 'InvalidLength' WHEN 5 THEN 'InvalidLength' WHEN 6 THEN 'UnsupportedVersion' WHEN 7 THEN 'UnsupportedFlags'
    WHEN 8 THEN 'InvalidEncoding' WHEN 9 THEN 'InvalidStreamId' WHEN 10 THEN 'InvalidStreamId' WHEN 11 THEN 'InvalidEncoding' WHEN 12 THEN 'InvalidLength' WHEN 13 THEN 'InvalidEncoding' WHEN 14 THEN 'InvalidEncoding' END AS error,
  CASE WHEN k IN (0, 15) THEN stream_id END AS stream_id, CASE WHEN k IN (0, 15) THEN inc END AS incarnation, CASE WHEN k IN (0, 15) THEN pos END AS decoded FROM x""")
def cursor_decode(spark: SparkSession, d: str) -> DataFrame:
    records = tables.log(spark, d)
    good = codec.encode_token(F.col("stream_id"), F.col("incarnation"), F.col("offset"))
    k = F.col("offset") % 16
    put = lambda at, new: F.concat(F.substr(good, F.lit(1), F.lit(at - 1)), F.lit(new), F.substr(good, F.lit(at + len(new))))
    end = F.substr(good, F.lit(1), F.length(good) - 1)
    token = (
        F.when(k == 1, put(1, "exc_"))
        .when(k == 2, put(5, "02"))
        .when(k == 3, put(13, "G"))  # in the id
        .when(k == 4, F.concat(good, F.lit("00")))
        .when(k == 5, end)  # an odd number of characters
        .when(k == 6, F.concat(F.lit("esc_02"), F.substr(end, F.lit(7)), F.lit("G")))  # the version shows before a bad digit
        .when(k == 7, F.concat(F.lit("esc_0101"), F.substr(end, F.lit(9)), F.lit("G")))
        .when(k == 8, put(7, "0G"))
        .when(k == 9, put(13, "ff"))  # no UTF-8
        .when(k == 10, put(13, "80"))
        .when(k == 11, F.concat(end, F.lit("G")))
        .when(k == 12, F.lit("esc_0100"))
        .when(k == 13, put(9, "000A"))
        .when(k == 14, put(5, "0\u00e9").substr(F.lit(1), F.length(good) - 1))  # two bytes in one character
        .otherwise(good)
    )
    told = records.select(F.col("stream_id").alias("source"), "offset", codec.decode_token(token).alias("t"))
    return told.select("source", "offset", "t.error", "t.stream_id", "t.incarnation", F.col("t.offset").cast("long").alias("decoded"))


@query("""SELECT doc_id, CAST(strlen(text) AS BIGINT) AS n_bytes, coalesce(strlen(text) BETWEEN 1 AND 256, false) AS valid FROM documents""")
def identifier_check(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), codec.valid_identifier(F.col("text")).alias("valid"))


@query(f'WITH {LOG} SELECT stream_id, pos AS "offset", CAST(bytes AS BIGINT) AS accounted, CAST(bytes + 256 AS BIGINT) AS stored FROM log')
def accounted_bytes(spark: SparkSession, d: str) -> DataFrame:
    columns = [F.col("event_id"), F.col("schema_id"), F.col("payload")]
    return tables.log(spark, d).select("stream_id", "offset", codec.accounted_bytes(*columns).alias("accounted"), codec.stored_bytes(*columns).alias("stored"))


@query(f"""WITH {LOG} SELECT stream_id, pos AS "offset", left(sha256(unhex(inc || lpad(to_hex(pos), 16, '0'))), 32) AS batch_id, lpad(lower(to_hex(pos)), 16, '0') AS be8 FROM log""")
def batch_identity(spark: SparkSession, d: str) -> DataFrame:
    return tables.log(spark, d).select("stream_id", "offset", F.lower(F.hex(codec.batch_id(F.col("incarnation"), F.col("offset")))).alias("batch_id"), F.lower(F.hex(codec.big_endian(F.col("offset")))).alias("be8"))


@query("""SELECT doc_id, sha256(text) AS digest, regexp_full_match(sha256(text), '[0-9a-f]{64}') AS valid FROM documents WHERE text IS NOT NULL""")
def backup_identity(spark: SparkSession, d: str) -> DataFrame:
    told = read(spark, d, "documents").where("text is not null").select("doc_id", codec.digest(F.encode("text", "UTF-8")).alias("digest"))
    return told.withColumn("valid", codec.valid_digest_text(F.col("digest")))


# -- lifecycle and retention -------------------------------------------------


@query(f"""WITH {LOG}, {REPLICAS}, names AS (SELECT stream_id, n, inc0, n % 4 <> 1 AS active FROM (SELECT stream_id, n, md5('inc-' || stream_id) AS inc0 FROM tails)),
q AS (SELECT 'op-' || stream_id AS operation_id, stream_id, CASE WHEN n % 2 = 0 THEN 'Delete' ELSE 'Reset' END AS action, CASE WHEN n % 5 = 0 THEN md5('other') ELSE inc0 END AS expected, md5('new-' || stream_id) AS fresh FROM names),
blocked AS (SELECT DISTINCT stream_id FROM replicas WHERE mode IN ('Required', 'Bootstrapping') AND ack > 20),
m AS (SELECT q.*, names.inc0, names.active, CASE WHEN inc0 <> expected THEN 'StaleIncarnation' WHEN active AND b.stream_id IS NOT NULL THEN 'ReplicaProtectionActive' END AS error FROM q JOIN names USING (stream_id) LEFT JOIN blocked b USING (stream_id))
SELECT operation_id, stream_id, action, error, CASE WHEN error IS NOT NULL THEN NULL WHEN action = 'Delete' AND active THEN 'Deleted' WHEN action = 'Delete' THEN 'AlreadyDeleted' WHEN active THEN 'Reset' ELSE 'Recreated' END AS outcome,
  CASE WHEN error IS NULL THEN CASE WHEN action = 'Reset' THEN fresh ELSE inc0 END END AS incarnation_after, CASE WHEN error IS NULL THEN action = 'Reset' ELSE active END AS active_after, CASE WHEN error IS NULL AND active THEN inc0 END AS retired FROM m""")
def lifecycle_transitions(spark: SparkSession, d: str) -> DataFrame:
    own = F.md5(F.concat(F.lit("inc-"), "stream_id"))
    t = tables.tails(spark, d)
    names = t.select("stream_id", own.alias("incarnation"), F.expr("n % 4 <> 1").alias("active"))
    action = F.when(F.col("n") % 2 == 0, "Delete").otherwise("Reset").alias("action")
    requests = t.select(F.concat(F.lit("op-"), "stream_id").alias("operation_id"), "stream_id", action, F.when(F.col("n") % 5 == 0, F.md5(F.lit("other"))).otherwise(own).alias("expected"), F.md5(F.concat(F.lit("new-"), "stream_id")).alias("fresh"))
    return control.lifecycle(requests, names, tables.replicas(spark, d).where("acknowledged > 20"))


@query(f"""WITH {LOG}, {LEASES}, x AS (SELECT l.stream_id, l.pos, l.bytes, row_number() OVER w AS rank, sum(l.bytes) OVER w AS cum FROM log l JOIN tails t USING (stream_id) LEFT JOIN leases s USING (stream_id) WHERE t.n % 2 = 0 AND (s.covered IS NULL OR l.pos <= s.covered) WINDOW w AS (PARTITION BY l.stream_id ORDER BY l.pos))
SELECT stream_id, pos AS "offset", rank, CAST(cum AS BIGINT) AS cum_bytes FROM x WHERE rank <= 32 AND cum <= 5000""")
def retired_cleanup_plan(spark: SparkSession, d: str) -> DataFrame:
    retired = tables.tails(spark, d).where("n % 2 = 0")
    plan = control.retired_cleanup(tables.log(spark, d), retired, tables.leases(spark, d), 32, 5000)
    return plan.select("stream_id", "offset", "rank", "cum_bytes")


@query(f"""WITH {LOG}, {REPLICAS}, {LEASES}, a AS (SELECT stream_id, min(ack) AS min_ack FROM replicas WHERE mode IN ('Required', 'Bootstrapping') GROUP BY 1), p AS (SELECT stream_id, min(covered) AS min_covered FROM leases GROUP BY 1),
q AS (SELECT t.stream_id, t.n, t.tail, 2 AS floor, CASE WHEN n % 7 = 0 THEN 1 ELSE 2 END AS expected, CASE n % 6 WHEN 0 THEN 1 WHEN 1 THEN tail + 1 WHEN 2 THEN tail // 2 + 1 WHEN 3 THEN tail // 3 ELSE 3 END AS want, min_ack, min_covered FROM tails t LEFT JOIN a USING (stream_id) LEFT JOIN p USING (stream_id)),
r AS (SELECT *, CASE WHEN n % 11 = 0 THEN 'RetryPolicyRequired' WHEN expected <> floor THEN 'StaleFloor' WHEN want < floor OR want > tail THEN 'InvalidInput' WHEN want > min_ack THEN 'ReplicaProtectionActive' WHEN want > min_covered THEN 'RecoveryProtectionActive' END AS error FROM q)
SELECT stream_id, CAST(want AS BIGINT) AS new_floor, error, CAST(CASE WHEN error IS NULL THEN want ELSE floor END AS BIGINT) AS floor_after, CAST(least(tail, coalesce(min_ack, tail), coalesce(min_covered, tail)) AS BIGINT) AS floor_max FROM r""")
def retention_floor_decision(spark: SparkSession, d: str) -> DataFrame:
    t = tables.tails(spark, d)
    want = F.expr("CASE n % 6 WHEN 0 THEN 1 WHEN 1 THEN tail + 1 WHEN 2 THEN tail div 2 + 1 WHEN 3 THEN tail div 3 ELSE 3 END").cast("long")
    requests = t.select("stream_id", F.expr("CASE WHEN n % 7 = 0 THEN 1 ELSE 2 END").alias("expected_floor"), want.alias("new_floor"))
    streams = t.select("stream_id", F.lit(2).cast("long").alias("floor"), "tail", F.expr("n % 11 <> 0").alias("generational"))
    return control.floor_decisions(requests, streams, tables.replicas(spark, d), tables.leases(spark, d))


@query(f"""WITH {LOG}, q AS (SELECT stream_id, n % 4 AS oldest, n % 4 + 3 AS cur, CASE WHEN n % 9 = 0 THEN 99 ELSE n % 4 END AS expected, n % 8 AS want, CASE WHEN n % 3 = 0 THEN n % 4 + 1 END AS pinned FROM tails),
r AS (SELECT *, CASE WHEN expected <> oldest THEN 'StaleGeneration' WHEN want < oldest OR want > cur THEN 'InvalidGeneration' WHEN want > pinned THEN 'JournalProtectionActive' END AS error FROM q)
SELECT stream_id, want AS retain_from, error, CASE WHEN error IS NULL THEN want ELSE oldest END AS oldest_after FROM r""")
def retention_expire_decision(spark: SparkSession, d: str) -> DataFrame:
    t = tables.tails(spark, d)
    requests = t.select("stream_id", F.expr("CASE WHEN n % 9 = 0 THEN 99 ELSE n % 4 END").cast("long").alias("expected_oldest"), F.expr("n % 8").alias("retain_from"))
    streams = t.select("stream_id", F.expr("n % 4").alias("oldest"), F.expr("n % 4 + 3").alias("current"))
    return control.expire_decisions(requests, streams, t.where("n % 3 = 0").select("stream_id", F.expr("n % 4 + 1").alias("pinned")))


@query(f"""WITH {LOG}, x AS (SELECT l.stream_id, l.pos, row_number() OVER w AS rank, sum(l.bytes) OVER w AS cum FROM log l JOIN tails t USING (stream_id) WHERE l.pos <= t.tail // 2 AND NOT (l.schema_id = 'purchase' OR l.pos % 5 = 0) WINDOW w AS (PARTITION BY l.stream_id ORDER BY l.pos))
SELECT stream_id, pos AS "offset", rank, CAST(cum AS BIGINT) AS cum_bytes FROM x WHERE rank <= 16 AND cum <= 4000""")
def retention_delete_plan(spark: SparkSession, d: str) -> DataFrame:
    records = tables.log(spark, d)
    floors = tables.tails(spark, d).select("stream_id", F.expr("tail div 2").alias("floor"))
    kept = records.where("schema_id = 'purchase' OR offset % 5 = 0")
    return control.delete_plan(records, floors, kept, 16, 4000).select("stream_id", "offset", "rank", "cum_bytes")


@query(f"""WITH {LOG} SELECT stream_id, min(pos % 9 + 1) AS pinned FROM log WHERE pos > 30 GROUP BY 1""")
def generation_pins(spark: SparkSession, d: str) -> DataFrame:
    markers = tables.log(spark, d).where("offset > 30").select(F.concat(F.lit("src-"), "stream_id").alias("source_id"), F.expr("offset % 9 + 1").alias("generation"))
    t = tables.tails(spark, d)
    return control.generation_pins(markers, t.select(F.concat(F.lit("src-"), "stream_id").alias("source_id"), "stream_id"), t.select("stream_id"))


@query(f"""WITH {LOG}, s AS (SELECT stream_id, tail + CASE WHEN n % 10 = 0 THEN 1 ELSE 0 END AS n FROM tails), r AS (SELECT stream_id, count(*) AS real_n, sum(bytes + 256) AS real_charge FROM log GROUP BY 1)
SELECT stream_id, s.n, real_n, CAST(real_charge AS BIGINT) AS charge, CAST(real_charge AS BIGINT) AS real_charge, CASE WHEN s.n <> real_n THEN 'StoreCorrupt' END AS error FROM s JOIN r USING (stream_id)""")
def counter_audit(spark: SparkSession, d: str) -> DataFrame:
    records = tables.log(spark, d)
    stored = records.groupBy("stream_id").agg(F.count("*").alias("n"), F.sum(F.col("bytes") + 256).alias("charge"))
    forged = stored.withColumn("n", F.col("n") + F.expr("CASE WHEN cast(stream_id AS BIGINT) % 10 = 0 THEN 1 ELSE 0 END"))
    return control.audit(forged, records, ["stream_id"], F.col("bytes") + 256)


@query("""SELECT c_custkey, arg_max(seg, v) AS segment, max(v) AS version FROM (SELECT c_custkey, c_mktsegment AS seg, 0 AS v FROM customer UNION ALL SELECT o_custkey, o_orderpriority, o_orderkey FROM orders) GROUP BY 1""")
def control_upsert(spark: SparkSession, d: str) -> DataFrame:
    current = read(spark, d, "customer").select("c_custkey", F.col("c_mktsegment").alias("segment"), F.lit(0).cast("long").alias("version"))
    changes = read(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderpriority").alias("segment"), F.col("o_orderkey").alias("version"))
    return control.upsert(current, changes, ["c_custkey"], "version")


# -- snapshots ---------------------------------------------------------------


@query(f"""WITH {CHUNKS}, x AS (SELECT conv_id, turn, size, pos + CASE WHEN turn = 2 AND conv_id % 5 = 0 THEN 3 ELSE 0 END AS pos FROM chunks)
SELECT conv_id, turn, CAST(pos AS BIGINT) AS "offset", expected FROM (SELECT *, CAST(coalesce(lag(pos + size) OVER (PARTITION BY conv_id ORDER BY pos), 0) AS BIGINT) AS expected FROM x) WHERE pos <> expected""")
def snapshot_chunk_contiguity(spark: SparkSession, d: str) -> DataFrame:
    moved = F.col("offset") + F.expr("CASE WHEN turn = 2 AND conv_id % 5 = 0 THEN 3 ELSE 0 END")
    return control.chunk_faults(tables.chunks(spark, d).withColumn("offset", moved), "conv_id").select("conv_id", "turn", "offset", "expected")


@query(f"""WITH {CHUNKS} SELECT conv_id, CAST(sum(size) AS BIGINT) AS content_bytes, sha256(string_agg(text, '' ORDER BY pos, turn)) AS digest FROM chunks GROUP BY 1""")
def snapshot_digest(spark: SparkSession, d: str) -> DataFrame:
    made = tables.chunks(spark, d).groupBy("conv_id").agg(F.sum("size").alias("content_bytes"), codec.ordered_bytes(F.struct("offset", "turn"), F.col("bytes")).alias("content"))
    return made.select("conv_id", "content_bytes", codec.digest(F.col("content")).alias("digest"))


@query(f"""WITH {CHUNKS}, x AS (SELECT conv_id, pos, pos + size AS stop, turn, encode(text) AS raw FROM chunks WHERE pos < 120 AND pos + size > 10)
SELECT conv_id, sha256(string_agg(hex(raw[greatest(10 - pos, 0) + 1 : least(120, stop) - pos]), '' ORDER BY pos, turn)) AS page_digest, CAST(sum(least(120, stop) - greatest(10, pos)) AS BIGINT) AS n_bytes FROM x GROUP BY 1""")
def snapshot_byte_page(spark: SparkSession, d: str) -> DataFrame:
    """Bytes [10, 120) of each snapshot, whatever its chunks."""
    some = tables.chunks(spark, d).where((F.col("offset") < 120) & (F.col("offset") + F.col("size") > 10))
    lo = F.greatest(F.lit(10) - F.col("offset"), F.lit(0))
    part = F.substr(F.col("bytes"), (lo + 1).cast("int"), (F.least(F.lit(120), F.col("offset") + F.col("size")) - F.col("offset") - lo).cast("int"))
    page = some.withColumn("part", part).groupBy("conv_id").agg(codec.ordered_bytes(F.struct("offset", "turn"), F.col("part")).alias("page"))
    return page.select("conv_id", codec.digest(F.encode(F.hex("page"), "UTF-8")).alias("page_digest"), F.octet_length("page").cast("long").alias("n_bytes"))


@query(f"""WITH {LOG}, x AS (SELECT stream_id, tail // 2 AS covered, 192 + strlen(stream_id) AS charge FROM tails), y AS (SELECT *, sum(charge) OVER (ORDER BY covered, stream_id) AS cum, row_number() OVER (ORDER BY covered, stream_id) AS k FROM x WHERE covered > 25 OR (covered = 25 AND stream_id > '3'))
SELECT stream_id, covered, CAST(charge AS BIGINT) AS charge, CAST(cum AS BIGINT) AS cum_charge FROM y WHERE k <= 40 AND cum <= 6000""")
def snapshot_keyset_page(spark: SparkSession, d: str) -> DataFrame:
    listed = tables.tails(spark, d).select("stream_id", F.expr("tail div 2").alias("covered"))
    page = logs.keyset_page(listed, ["covered", "stream_id"], (25, "3"), 40, F.octet_length("stream_id") + 192, 6000)
    return page.select("stream_id", "covered", "charge", "cum_charge")


@query(f"""WITH {LOG} SELECT l.stream_id, l.pos AS "offset", l.event_id FROM log l JOIN tails t USING (stream_id) WHERE l.pos > t.tail // 2 AND l.pos <= t.tail""")
def recovery_suffix(spark: SparkSession, d: str) -> DataFrame:
    cover = tables.tails(spark, d).select("stream_id", F.expr("tail div 2").alias("covered"))
    return tables.log(spark, d).join(cover, "stream_id").where("offset > covered").select("stream_id", "offset", "event_id")


def _folded_state(records: DataFrame) -> DataFrame:
    """The projection of a prefix: how many events, and the last schema."""
    return records.groupBy("stream_id").agg(F.count("*").alias("n"), F.max_by("schema_id", "offset").alias("last"), F.sum("bytes").alias("bytes"))


@query(f"""WITH {LOG} SELECT stream_id, count(*) AS n, arg_max(schema_id, pos) AS last, CAST(sum(bytes) AS BIGINT) AS bytes, true AS equal FROM log GROUP BY 1""")
def recovery_equals_replay(spark: SparkSession, d: str) -> DataFrame:
    """Snapshot of a prefix, folded with the suffix, against a fold of everything."""
    records = tables.log(spark, d)
    cover = tables.tails(spark, d).select("stream_id", F.expr("tail div 2").alias("covered"))
    marked = records.join(cover, "stream_id")
    early, late = _folded_state(marked.where("offset <= covered")), _folded_state(marked.where("offset > covered"))
    both = early.select("stream_id", "n", "last", "bytes", F.lit(0).alias("part")).unionByName(late.select("stream_id", "n", "last", "bytes", F.lit(1).alias("part")))
    recovered = both.groupBy("stream_id").agg(F.sum("n").alias("n"), F.max_by("last", "part").alias("last"), F.sum("bytes").alias("bytes"))
    whole = _folded_state(records).select("stream_id", F.struct("n", "last", "bytes").alias("whole"))
    return recovered.join(whole, "stream_id").select("stream_id", "n", "last", "bytes", (F.struct("n", "last", "bytes") == F.col("whole")).alias("equal"))


# -- ingestion ---------------------------------------------------------------

_FRAMES = """raw AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line, len(string_split(text, chr(10))) AS n FROM documents WHERE text IS NOT NULL),
placed AS (SELECT *, CAST(coalesce(sum(strlen(raw) + 1) OVER (PARTITION BY doc_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS source_byte FROM raw),
frames AS (SELECT * FROM placed WHERE NOT (line = n - 1 AND raw = ''))"""


def _texts(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").where("text is not null")


@query(f"""WITH {_FRAMES} SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY line) - 1 AS item_index, md5(CASE WHEN line < n - 1 THEN regexp_replace(raw, '\\r$', '') ELSE raw END) AS frame_md5 FROM frames WHERE raw NOT IN ('', chr(13)) OR (raw = chr(13) AND line = n - 1)""")
def frame_newline(spark: SparkSession, d: str) -> DataFrame:
    made = framing.newline_frames(_texts(spark, d), "doc_id", "text", empties=False)
    return made.select("doc_id", "item_index", F.md5("frame").alias("frame_md5"))


@query(f"""WITH {_FRAMES} SELECT doc_id, line AS item_index, source_byte, CAST(strlen(raw) AS BIGINT) AS n_bytes FROM frames""")
def frame_positions(spark: SparkSession, d: str) -> DataFrame:
    made = framing.newline_frames(_texts(spark, d), "doc_id", "text", crlf=framing.PRESERVE)
    return made.select("doc_id", "item_index", "source_byte", F.octet_length("frame").cast("long").alias("n_bytes"))


@query(f"""WITH {_FRAMES}, x AS (SELECT *, min(CASE WHEN strlen(raw) > 400 THEN line END) OVER (PARTITION BY doc_id) AS stop FROM frames)
SELECT doc_id, CASE WHEN line = stop THEN NULL ELSE line END AS item_index, source_byte + CASE WHEN line = stop THEN 400 ELSE 0 END AS source_byte, CASE WHEN line = stop THEN 'frame_too_large' END AS error FROM x WHERE stop IS NULL OR line <= stop""")
def frame_oversize(spark: SparkSession, d: str) -> DataFrame:
    return framing.newline_frames(_texts(spark, d), "doc_id", "text", max_bytes=400).select("doc_id", "item_index", "source_byte", "error")


@query(f"""WITH {_FRAMES} SELECT doc_id, count(*) FILTER (line < n - 1) AS n_frames, CAST(max(CASE WHEN line = n - 1 THEN source_byte END) AS BIGINT) AS truncated_at FROM frames GROUP BY 1""")
def frame_final_policy(spark: SparkSession, d: str) -> DataFrame:
    made = framing.newline_frames(_texts(spark, d), "doc_id", "text", final=framing.REJECT)
    return made.groupBy("doc_id").agg(F.count("item_index").alias("n_frames"), F.max(F.when(F.col("error") == "truncated_input", F.col("source_byte"))).alias("truncated_at"))


@query(f"""WITH {_FRAMES} SELECT doc_id, line AS item_index, source_byte, md5(raw) AS frame_md5 FROM frames""")
def frame_binary(spark: SparkSession, d: str) -> DataFrame:
    """The byte framer over texts captured as two segments."""
    whole = _texts(spark, d).select("doc_id", F.encode("text", "UTF-8").alias("b"))
    half = F.floor(F.octet_length("b") / 2).cast("int")
    one = whole.select("doc_id", F.lit(0).cast("long").alias("start"), F.substr("b", F.lit(1), half).alias("bytes"))
    two = whole.select("doc_id", half.cast("long").alias("start"), F.substr("b", half + 1, F.octet_length("b")).alias("bytes"))
    made = framing.binary_frames(one.unionByName(two), "doc_id", crlf=framing.PRESERVE)
    return made.select("doc_id", "item_index", "source_byte", F.md5("frame").alias("frame_md5"))


@query(f"""WITH {CHUNKS} SELECT conv_id AS source_id, turn, CAST(start AS BIGINT) AS start, expected FROM (SELECT *, CAST(coalesce(lag(start + size) OVER (PARTITION BY conv_id ORDER BY start), 0) AS BIGINT) AS expected FROM (SELECT conv_id, turn, size, pos - CASE WHEN turn = 3 THEN 1 ELSE 0 END AS start FROM chunks)) WHERE start <> expected""")
def capture_contiguity(spark: SparkSession, d: str) -> DataFrame:
    start = F.col("offset") - F.expr("CASE WHEN turn = 3 THEN 1 ELSE 0 END")
    segments = tables.chunks(spark, d).select(F.col("conv_id").alias("source_id"), "turn", "size", start.alias("start"))
    return framing.capture_faults(segments, "source_id").select("source_id", "turn", "start", "expected")


@query(f"""WITH {CHUNKS} SELECT conv_id AS source_id, pos AS start, pos + size AS stop, sha256(text) AS digest FROM chunks""")
def capture_digest(spark: SparkSession, d: str) -> DataFrame:
    return tables.chunks(spark, d).select(F.col("conv_id").alias("source_id"), F.col("offset").alias("start"), (F.col("offset") + F.col("size")).alias("stop"), codec.digest(F.col("bytes")).alias("digest"))


@query(f"""WITH {_FRAMES}, s AS (SELECT doc_id AS source_id, CAST(strlen(text) AS BIGINT) AS captured_end FROM documents WHERE text IS NOT NULL),
k AS (SELECT doc_id AS source_id, count(*) AS items FROM frames GROUP BY 1), p AS (SELECT s.source_id, captured_end, coalesce(items, 0) AS items, CASE s.source_id % 4 WHEN 0 THEN captured_end + 1 WHEN 1 THEN captured_end ELSE captured_end // 2 END AS "at", CASE WHEN s.source_id % 5 = 0 THEN coalesce(items, 0) + 1 ELSE coalesce(items, 0) END AS next_index, s.source_id % 17 = 0 AS standing FROM s LEFT JOIN k USING (source_id)),
q AS (SELECT *, CASE WHEN next_index > 0 THEN next_index + CASE WHEN source_id % 9 = 0 THEN 1 ELSE 0 END END AS committed, CASE WHEN standing THEN captured_end END AS at_offset, CASE WHEN standing THEN items END AS at_index, CASE WHEN standing AND items > 0 THEN items END AS at_committed FROM p),
m AS (SELECT q.source_id, count(*) AS n, max(f.source_byte) AS last_byte, arg_max(f.line + 1, f.line) AS output FROM q JOIN frames f ON f.doc_id = q.source_id WHERE f.line >= coalesce(at_index, 0) AND f.line < q.next_index AND NOT (q.source_id % 7 = 0 AND f.line = 1) GROUP BY 1),
r AS (SELECT q.*, source_id % 11 = 0 OR "at" > captured_end OR (NOT coalesce("at" = at_offset AND next_index = at_index AND committed IS NOT DISTINCT FROM at_committed, false) AND (source_id % 13 = 0 OR standing OR "at" < coalesce(at_offset, 0) OR next_index < coalesce(at_index, 0) OR next_index > items
  OR coalesce(n, 0) <> next_index - coalesce(at_index, 0) OR coalesce(last_byte > "at", false) OR committed IS DISTINCT FROM CASE WHEN next_index = coalesce(at_index, 0) THEN at_committed ELSE output END)) AS bad FROM q LEFT JOIN m USING (source_id))
SELECT source_id, CAST("at" AS BIGINT) AS "offset", CAST(next_index AS BIGINT) AS next_index, CASE WHEN bad THEN 'CheckpointConflict' END AS error, CAST(CASE WHEN bad THEN coalesce(at_offset, 0) ELSE "at" END AS BIGINT) AS offset_after FROM r""")
def checkpoint_validate(spark: SparkSession, d: str) -> DataFrame:
    made = framing.newline_frames(_texts(spark, d), "doc_id", "text", crlf=framing.PRESERVE)
    markers = made.select(F.col("doc_id").alias("source_id"), "item_index", "source_byte", (F.col("item_index") + 1).alias("committed"))
    items = markers.groupBy("source_id").agg(F.count("*").alias("items"))
    known = _texts(spark, d).select(F.col("doc_id").alias("source_id"), F.octet_length("text").cast("long").alias("captured_end")).join(items, "source_id", "left").withColumn("items", F.coalesce("items", F.lit(0)).cast("long"))
    offset = F.expr("CASE source_id % 4 WHEN 0 THEN captured_end + 1 WHEN 1 THEN captured_end ELSE captured_end div 2 END")
    asked = known.select("source_id", F.expr("CASE WHEN source_id % 11 = 0 THEN 'p2' ELSE 'p1' END AS parser"), offset.alias("offset"), F.expr("CASE WHEN source_id % 5 = 0 THEN items + 1 ELSE items END").alias("next_index"))
    requests = asked.withColumn("committed", F.expr("CASE WHEN next_index > 0 THEN next_index + CASE WHEN source_id % 9 = 0 THEN 1 ELSE 0 END END"))
    standing = F.expr("source_id % 17 = 0")
    sources = known.select(
        "source_id", F.lit("p1").alias("parser0"), (standing | F.expr("source_id % 13 = 0")).alias("finished"), F.when(standing, F.col("captured_end")).alias("at_offset"), F.when(standing, F.col("items")).alias("at_index"),
        F.when(standing & (F.col("items") > 0), F.col("items")).alias("at_committed"), "captured_end", F.col("items").alias("next_item"),
    )
    return framing.checkpoints(requests, sources, markers.where("NOT (source_id % 7 = 0 AND item_index = 1)"))


@query(f"""WITH {CHUNKS}, e AS (SELECT conv_id, sum(size) // 2 AS checkpoint FROM chunks GROUP BY 1), x AS (SELECT c.conv_id, c.pos, c.size, row_number() OVER w AS rank, sum(c.size + 128 + 8) OVER w AS cum FROM chunks c JOIN e USING (conv_id) WHERE c.pos + c.size <= e.checkpoint WINDOW w AS (PARTITION BY c.conv_id ORDER BY c.pos, c.turn))
SELECT conv_id AS source_id, pos AS start, rank, CAST(cum AS BIGINT) AS cum_bytes FROM x WHERE rank <= 3 AND cum <= 2000""")
def journal_cleanup_plan(spark: SparkSession, d: str) -> DataFrame:
    made = tables.chunks(spark, d)
    at = made.groupBy("conv_id").agg(F.expr("sum(size) div 2").alias("checkpoint"))
    free = made.join(at, "conv_id").where("offset + size <= checkpoint").withColumn("bytes", F.col("size") + 136)
    plan = control.bounded(free, ["conv_id"], ["offset", "turn"], F.col("bytes"), 3, 2000)
    return plan.select(F.col("conv_id").alias("source_id"), F.col("offset").alias("start"), "rank", "cum_bytes")


# -- replicas ----------------------------------------------------------------


@query(f"""WITH {LOG}, {REPLICAS}, x AS (SELECT r.replica_id, r.ack, l.pos, sum(l.bytes) OVER (PARTITION BY r.replica_id ORDER BY l.pos) AS cum FROM replicas r JOIN log l ON l.stream_id = r.stream_id AND l.pos > r.ack AND l.pos <= r.ack + 8)
SELECT replica_id, ack AS after, count(*) AS n_records, max(pos) AS through, CAST(max(cum) AS BIGINT) AS n_bytes FROM x WHERE cum <= 2500 GROUP BY 1, 2""")
def replica_prepare_batch(spark: SparkSession, d: str) -> DataFrame:
    replicas = tables.replicas(spark, d)
    met = replicas.join(tables.log(spark, d), "stream_id").where("offset > acknowledged AND offset <= acknowledged + 8")
    cut = control.bounded(met, ["replica_id"], ["offset"], F.col("bytes"), 8, 2500)
    return cut.groupBy("replica_id", F.col("acknowledged").alias("after")).agg(F.count("*").alias("n_records"), F.max("offset").alias("through"), F.max("cum_bytes").alias("n_bytes"))


@query(f"""WITH {LOG}, {REPLICAS} SELECT r.replica_id, r.stream_id, r.ack AS acknowledged, r.mode, count(l.pos) AS rows_behind, CAST(coalesce(sum(l.bytes + 256), 0) AS BIGINT) AS bytes_behind FROM replicas r LEFT JOIN log l ON l.stream_id = r.stream_id AND l.pos > r.ack GROUP BY 1, 2, 3, 4""")
def replica_backlog_audit(spark: SparkSession, d: str) -> DataFrame:
    records = tables.log(spark, d).select("stream_id", "offset", (F.col("bytes") + 256).alias("bytes"))
    return control.backlog(tables.replicas(spark, d), records)


@query("""SELECT CAST(s_nationkey AS BIGINT) AS stream_id, count(*) AS n FROM supplier GROUP BY 1 HAVING count(*) > 3""")
def replica_limit_having(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "supplier").groupBy(F.col("s_nationkey").cast("long").alias("stream_id")).agg(F.count("*").alias("n")).where("n > 3")


@query(f"""WITH {LOG}, {REPLICAS}, p AS (SELECT replica_id, ack, CASE WHEN mode <> 'Detached' THEN 'b-' || ack END AS pending, ack + CASE WHEN mode = 'Required' THEN 4 ELSE 5 END AS through, CASE WHEN replica_id LIKE 'r2-%' AND ack % 2 = 0 THEN ack - 1 ELSE ack END AS after, ack % 7 <> 0 AS epoch_ok, ack % 11 <> 0 AS id_ok FROM replicas),
r AS (SELECT *, CASE WHEN pending IS NULL THEN 'InvalidInput' WHEN NOT (through = ack + 4 AND after = ack AND epoch_ok AND id_ok) THEN 'InvalidReceipt' END AS error FROM p)
SELECT replica_id, through, error, CASE WHEN error IS NULL THEN through ELSE ack END AS acknowledged_after FROM r UNION ALL SELECT 'r3-' || stream_id, 1, 'NotFound', NULL FROM tails WHERE n % 6 = 0""")
def replica_ack_progress(spark: SparkSession, d: str) -> DataFrame:
    held = tables.replicas(spark, d)
    name = F.concat(F.lit("b-"), F.col("acknowledged").cast("string"))
    replicas = held.select("replica_id", "acknowledged", F.lit("now").alias("destination_epoch"), F.when(F.col("mode") != "Detached", name).alias("pending_id"), F.expr("CASE WHEN mode <> 'Detached' THEN acknowledged + 4 END AS pending_through"))
    after = F.expr("CASE WHEN replica_id LIKE 'r2-%' AND acknowledged % 2 = 0 THEN acknowledged - 1 ELSE acknowledged END")
    acks = held.select(
        "replica_id", F.when(F.expr("acknowledged % 11 <> 0"), name).otherwise("b-x").alias("batch_id"), F.expr("CASE WHEN acknowledged % 7 <> 0 THEN 'now' ELSE 'old' END AS epoch"),
        after.alias("after"), F.expr("acknowledged + CASE WHEN mode = 'Required' THEN 4 ELSE 5 END").alias("through"),
    )
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    unknown = tables.tails(spark, d).where("n % 6 = 0").select(F.concat(F.lit("r3-"), "stream_id").alias("replica_id"), F.lit("b-0").alias("batch_id"), F.lit("now").alias("epoch"), zero.alias("after"), one.alias("through"))
    return control.ack_progress(acks.unionByName(unknown), replicas)


@query(f"""WITH {LOG}, {REPLICAS} SELECT stream_id, min(ack) AS min_ack FROM replicas WHERE mode IN ('Required', 'Bootstrapping') GROUP BY 1""")
def replica_min_protection(spark: SparkSession, d: str) -> DataFrame:
    return tables.replicas(spark, d).where(F.col("mode").isin("Required", "Bootstrapping")).groupBy("stream_id").agg(F.min("acknowledged").alias("min_ack"))


@query(f"""WITH {LOG}, {REPLICAS}, b AS (SELECT replica_id FROM replicas WHERE ack % 2 = 0) SELECT replica_id, stream_id FROM replicas r WHERE mode = 'Detached' AND NOT EXISTS (SELECT 1 FROM b WHERE b.replica_id = r.replica_id)""")
def replica_detached_anti(spark: SparkSession, d: str) -> DataFrame:
    replicas = tables.replicas(spark, d)
    bootstraps = replicas.where("acknowledged % 2 = 0").select("replica_id")
    return replicas.where("mode = 'Detached'").join(bootstraps, "replica_id", "left_anti").select("replica_id", "stream_id")


# -- restore -----------------------------------------------------------------

_MAPPING = """ids AS (SELECT c_custkey AS id FROM customer UNION SELECT o_custkey FROM orders), mapping AS (SELECT id AS old_id, md5('old-' || CAST(id AS VARCHAR)) AS old_inc, md5('new-' || CAST(id AS VARCHAR)) AS new_inc FROM ids)"""


def _mapping(spark: SparkSession, d: str) -> DataFrame:
    ids = read(spark, d, "customer").select(F.col("c_custkey").alias("old_id")).union(read(spark, d, "orders").select("o_custkey")).distinct()
    name = lambda kind: F.md5(F.concat(F.lit(kind), F.col("old_id").cast("string")))
    return ids.select("old_id", name("old-").alias("old_incarnation"), name("new-").alias("new_incarnation"))


@query(f"WITH {_MAPPING} SELECT old_id, old_inc AS old_incarnation, new_inc AS new_incarnation FROM mapping")
def restore_identity_union(spark: SparkSession, d: str) -> DataFrame:
    return _mapping(spark, d)


@query(f"""WITH {_MAPPING}, x AS (SELECT *, 128 + 2 * strlen(CAST(old_id AS VARCHAR)) AS charge FROM mapping WHERE old_id > 37 OR (old_id = 37 AND old_inc > '8')), y AS (SELECT *, sum(charge) OVER w AS cum, row_number() OVER w AS k FROM x WINDOW w AS (ORDER BY old_id, old_inc))
SELECT old_id, new_inc AS new_incarnation, CAST(cum AS BIGINT) AS cum_charge FROM y WHERE k <= 64 AND cum <= 5000""")
def restore_mapping_page(spark: SparkSession, d: str) -> DataFrame:
    charge = F.octet_length(F.col("old_id").cast("string")) * 2 + 128
    return logs.keyset_page(_mapping(spark, d), ["old_id", "old_incarnation"], (37, "8"), 64, charge, 5000).select("old_id", "new_incarnation", "cum_charge")


@query(f"""WITH {_MAPPING} SELECT o.o_orderkey, m.new_inc AS incarnation, o.o_totalprice FROM orders o JOIN mapping m ON m.old_id = o.o_custkey""")
def restore_remap(spark: SparkSession, d: str) -> DataFrame:
    orders = read(spark, d, "orders")
    met = orders.join(_mapping(spark, d), orders["o_custkey"] == F.col("old_id"))
    return met.select("o_orderkey", F.col("new_incarnation").alias("incarnation"), "o_totalprice")


# -- delivery ----------------------------------------------------------------


@query(f"""WITH {LOG}, s AS (SELECT 's-' || stream_id AS subscription_id, stream_id, tail, n % 3 AS floor, CASE n % 4 WHEN 0 THEN 0 WHEN 1 THEN tail WHEN 2 THEN tail - 5 ELSE tail // 2 END AS last, {NOW} - n * 1000 AS created, {NOW} - n * 700 AS behind_since FROM tails)
SELECT subscription_id, stream_id, tail - last AS behind, CASE WHEN last < floor OR ({NOW} - created >= 30000 AND tail > last AND (tail - last > 20 OR {NOW} - behind_since > 60000)) THEN 'SubscriberLagged' END AS error, CAST(last AS BIGINT) AS last_delivered, CAST(floor AS BIGINT) AS floor, tail FROM s""")
def subscription_lag_verdict(spark: SparkSession, d: str) -> DataFrame:
    t = tables.tails(spark, d)
    subs = t.select(
        F.concat(F.lit("s-"), "stream_id").alias("subscription_id"), "stream_id", F.expr("CASE n % 4 WHEN 0 THEN 0 WHEN 1 THEN tail WHEN 2 THEN tail - 5 ELSE tail div 2 END").cast("long").alias("last_delivered"),
        (F.lit(NOW) - F.col("n") * 1000).alias("created_ms"), (F.lit(NOW) - F.col("n") * 700).alias("behind_since_ms"), F.lit(20).alias("max_lag_records"), F.lit(60000).alias("max_lag_ms"), F.lit(30000).alias("grace_ms"),
    )
    return control.lag_verdicts(subs, t.select("stream_id", F.expr("n % 3").alias("floor"), "tail"), NOW)


@query(f"""WITH {LOG}, s AS (SELECT 's-' || stream_id AS subscription_id, stream_id, ['Beginning', 'After', 'Future'][n % 3 + 1] AS start, n % 5 AS floor, tail, CASE WHEN n % 2 = 0 THEN 2 ELSE tail + n % 4 END AS cursor FROM tails),
r AS (SELECT *, CASE start WHEN 'Beginning' THEN floor WHEN 'Future' THEN tail ELSE cursor END AS "at" FROM s), e AS (SELECT *, CASE WHEN "at" < floor THEN 'HistoryUnavailable' WHEN "at" > tail THEN 'CursorAhead' END AS error FROM r)
SELECT subscription_id, stream_id, start, error, CAST(CASE WHEN error IS NULL THEN "at" END AS BIGINT) AS last_delivered, CASE WHEN error IS NULL THEN tail END AS replay_high FROM e""")
def subscription_start_resolution(spark: SparkSession, d: str) -> DataFrame:
    t = tables.tails(spark, d)
    kind = F.element_at(F.array(F.lit("Beginning"), F.lit("After"), F.lit("Future")), (F.col("n") % 3 + 1).cast("int"))
    asked = t.select(F.concat(F.lit("s-"), "stream_id").alias("subscription_id"), "stream_id", kind.alias("start"), F.expr("CASE WHEN n % 2 = 0 THEN 2 ELSE tail + n % 4 END").cast("long").alias("cursor"))
    return control.start_positions(asked, t.select("stream_id", F.expr("n % 5").alias("floor"), "tail"))


@query(f"""WITH {LOG}, bad AS (SELECT stream_id, min(pos) AS stop FROM log WHERE schema_id = 'purchase' GROUP BY 1)
SELECT t.stream_id, count(l.pos) AS applied, coalesce(max(l.pos), 0) AS checkpoint, CAST(coalesce(sum(l.bytes), 0) AS BIGINT) AS bytes, b.stop AS stopped_at FROM tails t LEFT JOIN bad b USING (stream_id) LEFT JOIN log l ON l.stream_id = t.stream_id AND (b.stop IS NULL OR l.pos < b.stop) GROUP BY 1, 5""")
def projection_fold(spark: SparkSession, d: str) -> DataFrame:
    """Apply events in order and stop at the first that the projection refuses; the checkpoint stays before it."""
    records = tables.log(spark, d)
    stop = F.min(F.when(F.col("schema_id") == "purchase", F.col("offset"))).over(Window.partitionBy("stream_id"))
    good = F.col("stopped_at").isNull() | (F.col("offset") < F.col("stopped_at"))
    marked = records.withColumn("stopped_at", stop)
    when = lambda c: F.when(good, F.col(c))
    return marked.groupBy("stream_id").agg(F.count(when("offset")).alias("applied"), F.coalesce(F.max(when("offset")), F.lit(0)).cast("long").alias("checkpoint"), F.coalesce(F.sum(when("bytes")), F.lit(0)).cast("long").alias("bytes"), F.max("stopped_at").alias("stopped_at"))


from ledgerline.plans import more, operations  # noqa: E402, F401  (add their queries)
