"""The test tables seen as an event log and its control tables.

A stream is a user of `events`, in order of (ts, event_id); an event's schema is
its type and its payload the properties. Control tables are derived from the
streams by rule, so that each decision's branches occur.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.operators import log as logs


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The record table, with bytes as charged to pages."""
    events = read(spark, sf_dir, "events")
    numbered = logs.number(events, "user_id", ["ts", "event_id"])
    records = numbered.select(
        F.col("user_id").cast("string").alias("stream_id"),
        F.unhex(F.md5(F.concat(F.lit("inc-"), F.col("user_id").cast("string")))).alias("incarnation"),
        "offset",
        F.lit(0).cast("long").alias("generation"),
        F.col("event_id").cast("string").alias("event_id"),
        F.col("event_type").alias("schema_id"),
        F.lit(1).cast("long").alias("schema_version"),
        F.encode(F.coalesce("props", F.lit("")), "UTF-8").alias("payload"),
    )
    return logs.charged(records)


LOG = """log AS (
  SELECT CAST(user_id AS VARCHAR) AS stream_id, md5('inc-' || CAST(user_id AS VARCHAR)) AS inc,
    row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos, CAST(event_id AS VARCHAR) AS event_id,
    event_type AS schema_id, coalesce(props, '') AS payload,
    strlen(coalesce(props, '')) + strlen(CAST(event_id AS VARCHAR)) + strlen(event_type) + 128 AS bytes
  FROM events),
tails AS (SELECT stream_id, CAST(stream_id AS BIGINT) AS n, max(pos) AS tail FROM log GROUP BY 1, 2)"""


def tails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """stream_id, n (the user's number), tail."""
    return log(spark, sf_dir).groupBy("stream_id").agg(F.max("offset").alias("tail")).select("stream_id", F.col("stream_id").cast("long").alias("n"), "tail")


def replicas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two replicas of each stream."""
    t = tails(spark, sf_dir)
    mode = lambda k: F.element_at(F.array(F.lit("Required"), F.lit("Bootstrapping"), F.lit("Detached")), ((F.col("n") + k) % 3 + 1).cast("int"))
    one = lambda k, ack: t.select(F.concat(F.lit(f"r{k}-"), "stream_id").alias("replica_id"), "stream_id", ack.cast("long").alias("acknowledged"), mode(k).alias("mode"))
    return one(1, F.expr("tail div 3")).unionByName(one(2, F.expr("tail * 4 div 5")))


REPLICAS = """replicas AS (
  SELECT 'r1-' || stream_id AS replica_id, stream_id, tail // 3 AS ack, ['Required', 'Bootstrapping', 'Detached'][(n + 1) % 3 + 1] AS mode FROM tails
  UNION ALL
  SELECT 'r2-' || stream_id, stream_id, tail * 4 // 5, ['Required', 'Bootstrapping', 'Detached'][(n + 2) % 3 + 1] FROM tails)"""


def leases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A recovery lease on every fourth stream."""
    return tails(spark, sf_dir).where("n % 4 = 0").select("stream_id", F.expr("tail div 2").alias("covered"))


LEASES = "leases AS (SELECT stream_id, tail // 2 AS covered FROM tails WHERE n % 4 = 0)"


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events as append requests in order of arrival; identities are folded so that retries and conflicts occur."""
    events = read(spark, sf_dir, "events")
    return events.select(
        F.col("event_id").alias("seq"),
        F.col("user_id").cast("string").alias("stream_id"),
        (F.col("event_id") % 7).cast("long").alias("generation"),
        F.concat(F.lit("e"), F.expr("event_id div 3").cast("string"), F.lit("-"), (F.col("user_id") % 5).cast("string"), F.lit("-"), F.col("event_id").cast("string").substr(F.lit(-1), F.lit(1))).alias("event_id"),
        F.col("event_type").alias("schema_id"),
        F.lit(1).cast("long").alias("schema_version"),
        F.encode(F.concat(F.lit("p"), (F.col("event_id") % 2).cast("string")), "UTF-8").alias("payload"),
    )


def folded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """requests() with few identities: many retries, equal and not."""
    return requests(spark, sf_dir).withColumns({"event_id": F.concat(F.lit("e"), (F.col("seq") % 11).cast("string")), "schema_id": F.lit("s")})


FOLDED = """b AS (
  SELECT event_id AS seq, CAST(user_id AS VARCHAR) AS s, event_id % 7 AS g, 'e' || CAST(event_id % 11 AS VARCHAR) AS id, 'p' || CAST(event_id % 2 AS VARCHAR) AS p
  FROM events)"""


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of a conversation as chunks of one snapshot: conv_id, turn, offset, size, bytes. A null text is empty."""
    from pyspark.sql import Window

    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("bytes"))
    before = Window.partitionBy("conv_id").orderBy("turn", "bytes").rowsBetween(Window.unboundedPreceding, -1)
    return turns.withColumns({"size": F.octet_length("bytes").cast("long"), "offset": F.coalesce(F.sum(F.octet_length("bytes")).over(before), F.lit(0)).cast("long")})


CHUNKS = """chunks AS (
  SELECT conv_id, turn, coalesce(text, '') AS text, CAST(strlen(coalesce(text, '')) AS BIGINT) AS size,
    CAST(coalesce(sum(strlen(coalesce(text, ''))) OVER (PARTITION BY conv_id ORDER BY turn, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS pos
  FROM conversations)"""
