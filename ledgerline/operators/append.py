"""Idempotent append: what becomes of each request of an arrival-ordered batch.

Duplicates, conflicts and offsets are closed forms over windows of one identity
or one stream of the batch. The log is first cut down to the batch's identities
by a semi-join whose build side is the batch; of a batch of at most FEW requests
it is broadcast, so history is neither shuffled nor sorted, and digests are made
of matches only. Matches go as rows beside the requests, so all is dealt out once, by
stream, to tasks that grow in number with the batch and not in memory.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.schema import CAPACITY_EXCEEDED, DEDUPLICATED, IDEMPOTENCY_CONFLICT, INSERTED

#: what must be equal for a retry to be the same request
CONTENT = ["schema_id", "schema_version", "payload"]
FEW = 100_000  # identities of at most 256 bytes each
ROWS = 1 << 18  # requests of a larger batch that a task gets at most, if streams are even; in more than 200 parts Spark's shuffle holds rows before it writes


def content_digest() -> Column:
    """Of what must be equal for a retry to be the same request."""
    return F.sha2(F.concat_ws("|", F.hex("schema_id"), F.col("schema_version").cast("string"), F.hex("payload")), 256)


def resolve(requests: DataFrame, records: DataFrame, tails: DataFrame, identity: list[str] | None = None, max_bytes: int = 1 << 20, n_requests: int | None = None) -> DataFrame:
    """requests with outcome, error_code and offset.

    requests: seq, stream_id, event_id, schema_id, schema_version, payload.
    records: the log, with the digest `content` if it is stored. tails: stream_id,
    tail. n_requests: how many requests there are, else they are counted. Later requests see earlier ones; only inserted ones take
    offsets; a request over max_bytes is refused before its identity is used.
    """
    identity = identity or ["stream_id", "event_id"]
    n = requests.count() if n_requests is None else n_requests
    told, known = _with_held(requests, records, identity, max_bytes, n), tails.select("stream_id", "tail")
    met = _dealt(told, n, "stream_id").join(_dealt(known, n, "stream_id"), "stream_id", "left")
    return _decided(met.withColumn("refused", F.lit(None).cast("string")), requests.columns, identity, F.lit(False))


def _dealt(rows: DataFrame, n: int, *keys: str) -> DataFrame:
    """rows dealt out by keys so that a task gets at most ROWS of n, give or take what chance does.

    Adaptive execution joins partitions by their compressed bytes, but leaves a stated
    number alone. Both sides of a join must state it, else the other's number may win.
    """
    if n <= FEW:
        return rows
    return rows.repartition(max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // ROWS)), *keys)


def _with_held(requests: DataFrame, records: DataFrame, identity: list[str], max_bytes: int, n: int) -> DataFrame:
    """requests (asked) and, as rows beside them, what the log holds of their identities: so no join has to move or sort them again."""
    size = F.octet_length("payload") + F.octet_length("event_id") + F.octet_length("schema_id") + 128
    sized = requests.withColumns({"fits": size <= max_bytes, "content": content_digest(), "asked": F.lit(True)})
    asked = requests.select(*identity)
    held = records.join(F.broadcast(asked) if n <= FEW else _dealt(asked, n, *identity), identity, "left_semi")
    held = held.select(*identity, F.col("offset").alias("held_offset"), (F.col("content") if "content" in records.columns else content_digest()).alias("held_content"), F.lit(False).alias("asked"))
    return sized.unionByName(held, allowMissingColumns=True)


def _decided(met: DataFrame, columns: list[str], identity: list[str], retry: Column) -> DataFrame:
    """Requests' columns with outcome, error_code and offset. met: _with_held(), with tail and refused, an error known before. retry: whether a request may only match what the log holds."""
    same = Window.partitionBy(*identity, "fits").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first = met.withColumns({"first_seq": F.min("seq").over(same), "first_content": F.first("content", ignorenulls=True).over(same)})
    every = Window.partitionBy(*identity)  # in the same order
    found = first.withColumns({"held_offset": F.max("held_offset").over(every), "held_content": F.max("held_content").over(every)}).where("asked")
    judged = found.withColumn("refused", F.coalesce("refused", F.when(retry & F.col("held_offset").isNull(), "LegacyRetryNotFound")))
    fresh = F.col("refused").isNull() & F.col("fits") & F.col("held_offset").isNull() & (F.col("seq") == F.col("first_seq"))
    marked = judged.withColumn("fresh", fresh)
    ordered = Window.partitionBy("stream_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    placed = marked.withColumn("new_offset", F.coalesce("tail", F.lit(0)) + F.sum(F.col("fresh").cast("long")).over(ordered))
    given = placed.withColumn("first_offset", F.max(F.when(F.col("fresh"), F.col("new_offset"))).over(same))
    equal = F.col("content") == F.coalesce("held_content", "first_content")
    known = F.col("refused").isNotNull()
    outcome = F.when(known | ~F.col("fits"), F.lit(None)).when(F.col("fresh"), INSERTED).when(equal, DEDUPLICATED)
    error = F.when(known, F.col("refused")).when(~F.col("fits"), CAPACITY_EXCEEDED).when(~F.col("fresh") & ~equal, IDEMPOTENCY_CONFLICT)
    offset = F.when(~known & F.col("fits") & equal, F.coalesce("held_offset", "first_offset"))
    return given.select(*columns, outcome.alias("outcome"), error.alias("error_code"), offset.cast("long").alias("offset"))


def generation_error(generation: str = "generation", oldest: str = "oldest", current: str = "current") -> F.Column:
    """Why a request's generation is refused, else null."""
    return F.when(F.col(generation) < F.col(oldest), "RetryGenerationExpired").when(F.col(generation) > F.col(current), "RetryGenerationAhead")


def resolve_generated(requests: DataFrame, records: DataFrame, streams: DataFrame, max_bytes: int = 1 << 20, n_requests: int | None = None) -> DataFrame:
    """resolve() by (stream, generation, event). streams: stream_id, tail, oldest, current. Refused generations use up nothing.

    Generation 0 holds events from before generations: it is matched, never inserted.
    """
    identity = ["stream_id", "generation", "event_id"]
    n = requests.count() if n_requests is None else n_requests
    told, known = _with_held(requests, records, identity, max_bytes, n), streams.select("stream_id", "tail", "oldest", "current")
    met = _dealt(told, n, "stream_id").join(_dealt(known, n, "stream_id"), "stream_id")
    return _decided(met.withColumn("refused", generation_error()), requests.columns, identity, F.col("generation") == 0)


def counts(resolved: DataFrame) -> DataFrame:
    """How many requests of each stream were accepted, inserted, deduplicated and refused; accepted is the sum of the others."""
    one = lambda cond: F.sum(F.when(cond, 1).otherwise(0)).cast("long")
    return resolved.groupBy("stream_id").agg(
        F.count("*").alias("accepted"), one(F.col("outcome") == INSERTED).alias("inserted"), one(F.col("outcome") == DEDUPLICATED).alias("deduplicated"), one(F.col("error_code").isNotNull()).alias("failed"),
    )


def admit(requests: DataFrame, max_records: int, max_bytes: int) -> DataFrame:
    """Greedy admission in order of arrival within each stream: a request that doesn't fit uses up nothing."""
    return admitted(requests.withColumn("room", F.lit(max_bytes).cast("long")), "room", max_records).drop("room")


def admitted(requests: DataFrame, room: str, max_records: int = (1 << 63) - 1) -> DataFrame:
    """requests (stream_id, seq, bytes, room: of the stream) with whether each fits into what earlier admitted ones left.

    A prefix sum can't express this, so streams are folded in order; streams that
    fit as a whole skip the fold. Runs that fit are taken at once.
    """
    totals = requests.groupBy("stream_id").agg(F.count("*").alias("n"), F.sum("bytes").alias("total"))
    small = (F.col("n") <= max_records) & (F.col("total") <= F.col(room))
    met = requests.join(totals, "stream_id")
    columns = requests.columns

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows come sorted by stream and seq; state is one stream's two sums."""
        stream, rows, used = None, 0, 0
        for batch in batches:
            names, sizes, rooms = batch["stream_id"].to_numpy(), batch["bytes"].to_numpy(np.int64), batch[room].to_numpy(np.int64)
            verdict = np.zeros(len(batch), bool)
            heads = [0, *(np.flatnonzero(names[1:] != names[:-1]) + 1).tolist(), len(names)]
            for a, b in zip(heads[:-1], heads[1:], strict=True):
                if names[a] != stream:
                    stream, rows, used = names[a], 0, 0
                at = a
                while at < b and rows < max_records:
                    run = np.cumsum(sizes[at:b][: min(b - at, max_records - rows)])
                    n = int(np.searchsorted(run, rooms[a] - used, "right"))
                    verdict[at : at + n] = True
                    rows, used, at = rows + n, used + (int(run[n - 1]) if n else 0), at + n
                    # what doesn't fit now never will, so on to the next that does
                    later = np.flatnonzero(sizes[at:b] <= rooms[a] - used)
                    at = at + int(later[0]) if len(later) else b
            yield batch.assign(admitted=verdict)

    near = met.where(~small).select(*columns).repartition("stream_id").sortWithinPartitions("stream_id", "seq")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in requests.schema)
    return met.where(small).select(*columns, F.lit(True).alias("admitted")).unionByName(near.mapInPandas(fold, f"{schema}, admitted boolean"))


def contiguous(batch: DataFrame) -> DataFrame:
    """Replicated batches by batch_id: whether offsets follow `after` without a gap in one stream, and their bytes."""
    stats = batch.groupBy("batch_id", "after").agg(F.count("*").alias("n"), F.min("offset").alias("lo"), F.max("offset").alias("hi"), F.count_distinct("offset").alias("d"), F.count_distinct("stream_id").alias("streams"))
    good = (F.col("streams") == 1) & (F.col("lo") == F.col("after") + 1) & (F.col("hi") == F.col("after") + F.col("n")) & (F.col("d") == F.col("n"))
    return stats.select("batch_id", "after", F.col("n").alias("n_records"), F.col("hi").alias("through"), good.alias("contiguous"))
