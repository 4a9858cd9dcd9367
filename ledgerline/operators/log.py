"""Ordered reads of the record table: pages, bounds, lookups and audits.

Offsets are gapless from floor + 1 in each stream, so a page of n records is a
range of offsets that reaches the scan, and running sums see at most n rows of
a stream, however long the stream is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions.codec import accounted_bytes
from ledgerline.schema import CAPACITY_EXCEEDED, CURSOR_AHEAD, HISTORY_UNAVAILABLE, INVALID_CONFIG, STORE_CORRUPT

KEY = ["stream_id"]


def number(events: DataFrame, stream: str, order: list[str]) -> DataFrame:
    """Events with the offset 1, 2, 3... of each in its stream."""
    return events.withColumn("offset", F.row_number().over(Window.partitionBy(stream).orderBy(*order)).cast("long"))


def bounds(records: DataFrame, floors: DataFrame | None = None) -> DataFrame:
    """stream_id, floor, tail. floors: stream_id, floor of streams that may be empty."""
    tails = records.groupBy(*KEY).agg(F.max("offset").alias("tail"))
    if floors is None:
        return tails.select("stream_id", F.lit(0).cast("long").alias("floor"), "tail")
    return floors.join(tails, "stream_id", "left").select("stream_id", "floor", F.coalesce("tail", "floor").alias("tail"))


def lookup(records: DataFrame, keys: DataFrame) -> DataFrame:
    """The record of each (stream_id, event_id) in keys, null columns where there is none."""
    return keys.join(records, ["stream_id", "event_id"], "left")


def charged(records: DataFrame) -> DataFrame:
    return records.withColumn("bytes", accounted_bytes(F.col("event_id"), F.col("schema_id"), F.col("payload")))


def range_error(after: Column, through: Column, floor: Column, tail: Column) -> Column:
    """Why a read of (after, through] is refused, else null."""
    return F.when(after < floor, HISTORY_UNAVAILABLE).when((after > tail) | (through > tail), CURSOR_AHEAD).when(after > through, INVALID_CONFIG)


def pages(records: DataFrame, cursors: DataFrame, max_records: int, max_bytes: int) -> DataFrame:
    """Records of each cursor's page with n and cum_bytes. cursors: stream_id, after, through.

    A page is the longest prefix of (after, through] within both limits. A first
    record over max_bytes is returned with error CapacityExceeded, never cut.
    """
    ahead = (F.col("offset") > F.col("after")) & (F.col("offset") <= F.least(F.col("through"), F.col("after") + F.lit(max_records)))
    some = charged(records).join(cursors, "stream_id").where(ahead)
    running = Window.partitionBy("stream_id").orderBy("offset").rowsBetween(Window.unboundedPreceding, 0)
    counted = some.withColumns({"n": F.col("offset") - F.col("after"), "cum_bytes": F.sum("bytes").over(running)})
    first_over = (F.col("n") == 1) & (F.col("cum_bytes") > max_bytes)
    return counted.where((F.col("cum_bytes") <= max_bytes) | first_over).withColumn("error", F.when(first_over, CAPACITY_EXCEEDED))


def page_summaries(records: DataFrame, cursors: DataFrame, max_records: int, max_bytes: int) -> DataFrame:
    """One row a cursor: error, n_records, n_bytes, next_after, through, complete. cursors also hold floor and tail."""
    refused = cursors.withColumn("refused", range_error(F.col("after"), F.col("through"), F.col("floor"), F.col("tail")))
    open_ = refused.where("refused is null").select("stream_id", "after", "through")
    cut = pages(records, open_, max_records, max_bytes)
    got = cut.groupBy("stream_id").agg(
        F.max("error").alias("too_large"),
        F.sum(F.when(F.col("error").isNull(), 1).otherwise(0)).alias("n_records"),
        F.sum(F.when(F.col("error").isNull(), F.col("bytes")).otherwise(0)).alias("n_bytes"),
        F.max(F.when(F.col("error").isNull(), F.col("offset"))).alias("last"),
        F.min("offset").alias("first"),
    )
    met = refused.join(got, "stream_id", "left")
    gap = F.col("first").isNotNull() & (F.col("first") != F.col("after") + 1)
    missing = F.col("first").isNull() & (F.col("after") < F.col("through"))
    gone = F.col("last").isNotNull() & (F.col("last") - F.col("after") != F.col("n_records"))
    error = F.coalesce("refused", F.when(gap | missing | gone, STORE_CORRUPT), "too_large")
    good = error.isNull()
    next_after = F.coalesce("last", "after")
    return met.select(
        "stream_id", error.alias("error"), F.coalesce("n_records", F.lit(0)).cast("long").alias("n_records"), F.coalesce("n_bytes", F.lit(0)).cast("long").alias("n_bytes"),
        F.when(good, next_after).alias("next_after"), F.col("through"), F.when(good, next_after == F.col("through")).alias("complete"),
    )


def gaps(rows: DataFrame, keys: list[str], position: str, ties: list[str]) -> DataFrame:
    """Positions that don't follow the one before (or 1, for the first): keys, position, expected."""
    order = Window.partitionBy(*keys).orderBy(position, *ties)
    expected = F.coalesce(F.lag(position).over(order) + 1, F.lit(1)).cast("long")
    return rows.withColumn("expected", expected).where(F.col(position) != F.col("expected"))


def merged(*parts: DataFrame) -> DataFrame:
    """Record tables of one log as one; an ordered read of it needs no more than the sort."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def keyset_page(rows: DataFrame, keys: list[str], after: tuple | None, max_rows: int, charge: Column, max_bytes: int) -> DataFrame:
    """Rows that follow the key `after` in order, cut by count and by running charge. At most max_rows rows are sorted in one place."""
    if after is not None:
        left, right = F.struct(*[F.col(k) for k in keys]), F.struct(*[F.lit(v).alias(k) for k, v in zip(keys, after, strict=True)])
        rows = rows.where((F.col(keys[0]) >= F.lit(after[0])) & (left > right))
    top = rows.withColumn("charge", charge.cast("long")).orderBy(*keys).limit(max_rows)
    running = Window.partitionBy(F.lit(0)).orderBy(*keys).rowsBetween(Window.unboundedPreceding, 0)
    return top.withColumn("cum_charge", F.sum("charge").over(running)).where(F.col("cum_charge") <= max_bytes)
