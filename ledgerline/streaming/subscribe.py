"""Replay-to-live delivery with Structured Streaming.

The stream follows the store's commit files, a few at a time; each micro-batch
reads the records of whole commits. The checkpoint is the subscription's
cursor, so a restart goes on without gaps or repeats of committed batches.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ledgerline.engine import EventLog
from ledgerline.operators.framing import EMIT, STRIP, Framer
from ledgerline.schema import RECORDS, LogError
from ledgerline.sources.store import Store

COMMIT = "version long, operation_id string, files map<string,string>, whole boolean"


def subscribe(store: Store, handle: Callable[[DataFrame, int], None], checkpoint: str, after_version: int = 0, commits_per_batch: int = 64, once: bool = False, empty: bool = False) -> StreamingQuery:
    """handle(records, batch_id): records of one micro-batch, of any stream and lifetime, to be taken in order of stream and offset. empty: call it also for commits without records.

    Commits that rewrite earlier records (compactions) deliver nothing.
    """
    spark, path = store.spark, store.path
    commits = spark.readStream.schema(COMMIT).option("pathGlobFilter", "*.json").option("maxFilesPerTrigger", commits_per_batch).json(f"{path}/_commits")

    def run(batch: DataFrame, batch_id: int) -> None:
        # one row a commit, at most commits_per_batch
        rows = batch.where((F.col("version") > after_version) & ~F.coalesce("whole", F.lit(False))).select(F.col("files")["records"].alias("f")).where("f is not null").collect()
        if rows:
            handle(spark.read.schema(RECORDS).parquet(*[f"{path}/{r['f']}" for r in rows]), batch_id)
        elif empty:
            handle(spark.createDataFrame([], RECORDS), batch_id)

    writer = commits.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def follow(log: EventLog, stream_id: str, handle: Callable[[DataFrame, int], None], checkpoint: str, start: str = "Beginning", cursor: int | None = None, commits_per_batch: int = 64, once: bool = False) -> StreamingQuery:
    """One stream from Beginning (the floor), After a cursor, or Future (the tail), each record once and in order of micro-batches.

    The checkpoint holds the lifetime and where the reader started; a restart
    goes on there. A micro-batch ends the subscription with an error if the
    stream's lifetime is over (StaleIncarnation, StreamUnavailable) or records
    that were not delivered have gone below the floor (SubscriberLagged).
    """
    store, spark = log.store, log.spark
    # positions of other readers are files of their own
    place = f"{checkpoint.rstrip('/')}-position"
    held = _position(store, place)
    if held is None:
        own = log.names().where((F.col("stream_id") == stream_id) & F.col("active")).collect()
        if not own:
            raise LogError("StreamUnavailable", stream_id)
        bounds = log.bounds().where(F.col("stream_id") == stream_id).first()
        at = {"Beginning": bounds.floor, "Future": bounds.tail, "After": cursor}[start]
        if at is None or at < bounds.floor:
            raise LogError("HistoryUnavailable", str(at))
        if at > bounds.tail:
            raise LogError("CursorAhead", str(at))
        held = {"incarnation": bytes(own[0].incarnation).hex(), "delivered": at}
        _position(store, place, held)

    def run(records: DataFrame, batch_id: int) -> None:
        now = _position(store, place)
        name = log.names().where(F.col("stream_id") == stream_id).collect()
        if not name or not name[0].active:
            raise LogError("StreamUnavailable", stream_id)
        if bytes(name[0].incarnation).hex() != now["incarnation"]:
            raise LogError("StaleIncarnation", stream_id)
        mine = records.where((F.col("stream_id") == stream_id) & (F.hex("incarnation") == now["incarnation"].upper()) & (F.col("offset") > now["delivered"]))
        last = mine.agg(F.max("offset")).first()[0]
        floor = log.bounds().where(F.col("stream_id") == stream_id).first().floor
        if now["delivered"] < floor:
            raise LogError("SubscriberLagged", f"delivered {now['delivered']}, floor {floor}")
        if last is not None:
            handle(mine, batch_id)
            _position(store, place, now | {"delivered": last})

    return subscribe(store, run, checkpoint, commits_per_batch=commits_per_batch, once=once, empty=True)


def _position(store: Store, path: str, value: dict | None = None) -> dict | None:
    """Reads a reader's position, or replaces it: the new file is whole before it takes the name."""
    at = store._jvm.org.apache.hadoop.fs.Path
    fs = at(path).getFileSystem(store.spark.sparkContext._jsc.hadoopConfiguration())
    if value is None:
        found = sorted(s.getPath().getName() for s in fs.listStatus(at(path))) if fs.exists(at(path)) else []
        found = [n for n in found if n.endswith(".json")]
        if not found:
            return None
        stream = fs.open(at(f"{path}/{found[-1]}"))
        raw = bytes(store._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        stream.close()
        return json.loads(raw)
    name = f"{value['delivered']:020d}"
    out = fs.create(at(f"{path}/{name}.part"), True)
    out.write(json.dumps(value).encode())
    out.close()
    fs.rename(at(f"{path}/{name}.part"), at(f"{path}/{name}.json"))
    return value


def framed(segments: DataFrame, max_bytes: int = 1 << 20, crlf: str = STRIP, empties: bool = True, final: str = EMIT) -> DataFrame:
    """Frames of a stream of segments (source_id, start, bytes, eof), with each source's framer kept as state.

    Segments of one source within a micro-batch are taken by start; across
    micro-batches they must arrive in order, and eof comes with the last one.
    """

    def step(key: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        framer = Framer(max_bytes, crlf, empties, final)
        if state.exists:
            framer.restore(state.get)
        rows = pd.concat(chunks).sort_values("start")
        out = [f for raw in rows["bytes"] for f in framer.push(bytes(raw))]
        if rows["eof"].any():
            out += framer.finish()
            if state.exists:
                state.remove()
        else:
            state.update(framer.state())
        made = pd.DataFrame(out, columns=["item_index", "source_byte", "frame", "error"])
        made.insert(0, "source_id", key[0])
        made["item_index"] = made["item_index"].astype("Int64")
        yield made

    return segments.groupBy("source_id").applyInPandasWithState(
        step, "source_id string, item_index long, source_byte long, frame binary, error string", "line_start long, item long, partial binary, failed boolean", "append", GroupStateTimeout.NoTimeout
    )
