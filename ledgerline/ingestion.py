"""Captured sources: bytes are journalled first, then framed and appended to their stream, and the parser's state is checkpointed.

Every step is one commit and can be repeated: a capture by its receipt, an
append by the identity of its events, a checkpoint by its position. After a
crash drive() starts from the last checkpoint, frames the same bytes again, and
finds the outputs it had appended.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.engine import EventLog
from ledgerline.operators import framing, operations, replication
from ledgerline.schema import CAPTURED, CAPTURES, MARKERS, PARSERS, SOURCES, LogError

WORK = 8 << 20  # bytes of a source that one drive() frames


def frame_event(rows: DataFrame) -> dict[str, Column]:
    """The event of a frame: named after its source and index, the frame as payload."""
    return {"event_id": F.concat_ws("-", "source_id", F.col("item_index").cast("string")), "schema_id": F.lit("frame"), "schema_version": F.lit(1).cast("long"), "payload": F.col("frame")}


class SourceJournal:
    """Sources of an EventLog. mapper: the event_id, schema_id, schema_version and payload of frames (source_id, item_index, source_byte, frame)."""

    def __init__(self, log: EventLog, max_bytes: int = 1 << 20, crlf: str = framing.STRIP, empties: bool = True, final: str = framing.EMIT, mapper: Callable[[DataFrame], dict[str, Column]] = frame_event, most: int = 1 << 20):
        self.log, self.store, self.spark = log, log.store, log.spark
        self.how, self.mapper, self.most = (max_bytes, crlf, empties, final), mapper, most

    def sources(self) -> DataFrame:
        return self.store.latest("sources", SOURCES, ["source_id"])

    def checkpoints(self) -> DataFrame:
        return self.store.latest("parsers", PARSERS, ["source_id"])

    def begin(self, requests: DataFrame, operation_id: str) -> DataFrame:
        """requests: source_id, parser, stream_id."""
        told = operations.begin_sources(requests.withColumn("operation_id", F.lit(operation_id)), self.sources(), self.most)
        good = requests.join(told.where("error is null").select("source_id"), "source_id", "left_semi")
        zero, none = F.lit(0).cast("long"), F.lit(None)
        rows = good.select("source_id", "parser", "stream_id", zero.alias("captured_end"), zero.alias("receipt_floor"), none.cast("long").alias("sealed_end"), F.lit(False).alias("finished"))
        return self._answered({"sources": rows}, told, operation_id)

    def _answered(self, tables: dict[str, DataFrame], told: DataFrame, operation_id: str) -> DataFrame:
        """The decisions, stored with what they change; of an operation that was decided before, its own."""
        made = self.store.commit({**tables, "decisions": told}, operation_id)
        return self.spark.read.parquet(f"{self.store.path}/{made['files']['decisions']}").drop("_version")

    def capture(self, segments: DataFrame, operation_id: str | None = None) -> DataFrame:
        """segments: source_id, start, bytes; at most one of a source in a call. Captured, Deduplicated, or why not."""
        sized = segments.withColumns({"end": F.col("start") + F.octet_length("bytes"), "digest": F.sha2("bytes", 256)})
        if not sized.groupBy("source_id").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
            raise LogError("InvalidInput", "two segments of one source")
        sources = self.sources().withColumn("sealed", F.col("sealed_end").isNotNull())
        told = replication.capture(sized.select("source_id", "start", "end", "digest"), sources.select("source_id", "captured_end", "receipt_floor", "sealed"), self.store.read("captures", CAPTURES))
        told = told.withColumn("error", F.coalesce("error", F.when(F.col("end") == F.col("start"), "InvalidInput")))
        fresh = sized.join(told.where("outcome = 'Captured' and error is null").select("source_id"), "source_id", "left_semi")
        grown = self.sources().drop("captured_end").join(fresh.select("source_id", F.col("end").alias("captured_end")), "source_id").select(*SOURCES.names)
        tables = {"captures": fresh.select(*CAPTURES.names), "captured": fresh.select(*CAPTURED.names), "sources": grown}
        return self._answered(tables, told, operation_id or uuid.uuid4().hex)

    def seal(self, requests: DataFrame, operation_id: str | None = None) -> DataFrame:
        """Seal and Finish. requests: source_id, action, at."""
        held = self.sources().join(self.checkpoints().select("source_id", F.col("offset").alias("checkpoint")), "source_id", "left")
        told = replication.seal(requests, held.withColumn("sealed", F.col("sealed_end").isNotNull()).select("source_id", "sealed", "captured_end", "checkpoint"))
        good = told.where("error is null").select("source_id", "finished_after")
        rows = self.sources().join(good, "source_id").select("source_id", "parser", "stream_id", "captured_end", "receipt_floor", F.col("captured_end").alias("sealed_end"), (F.col("finished") | F.col("finished_after")).alias("finished"))
        return self._answered({"sources": rows}, told, operation_id or uuid.uuid4().hex)

    def advance_floor(self, requests: DataFrame, operation_id: str) -> DataFrame:
        """requests: source_id, expected, new. Captures that start below the floor can't be retried any more."""
        told = operations.capture_floors(requests, self.sources().select("source_id", "captured_end", "receipt_floor"))
        rows = self.sources().drop("receipt_floor").join(told.where("error is null").select("source_id", F.col("floor_after").cast("long").alias("receipt_floor")), "source_id").select(*SOURCES.names)
        return self._answered({"sources": rows}, told, operation_id)

    def _framed(self, work: int) -> DataFrame:
        """Of each source that has bytes beyond its checkpoint: frames and errors (kind 0), and the framer's state after them (kind 1)."""
        how = self.how
        held = self.sources().where("not finished").join(self.checkpoints(), "source_id", "left")
        held = held.withColumn("offset", F.coalesce("offset", F.lit(0)))
        ending = (F.col("sealed_end") == F.col("offset")) & (F.octet_length("partial") > 0)  # a line that only the seal ends
        open_ = held.where((F.col("offset") < F.col("captured_end")) | ending)
        last = F.least(F.col("captured_end"), F.col("offset") + F.lit(work))
        ranges = open_.select("source_id", "stream_id", "offset", "sealed_end", F.col("line_start"), F.col("next_index"), "partial", "failed", last.alias("last"))
        parts = self.store.read("captured", CAPTURED).select("source_id", "start", "bytes")
        near = (F.col("start") < F.col("last")) & (F.col("start") + F.octet_length("bytes") > F.col("offset"))
        met = ranges.join(parts, "source_id", "left").where(F.col("start").isNull() | near | (F.col("last") == F.col("offset")))

        def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
            rows = rows.sort_values("start")
            top = rows.iloc[0]
            framer = framing.Framer(*how)
            if top["partial"] is not None:
                framer.restore((int(top["line_start"]), int(top["next_index"]), bytes(top["partial"]), bool(top["failed"])))
            at, out = int(top["offset"]), []
            for start, raw in zip(rows["start"], rows["bytes"], strict=True):
                if raw is None or pd.isna(start):
                    continue
                piece = bytes(raw)[max(0, at - int(start)) : int(top["last"]) - int(start)]
                out += framer.push(piece)
                at += len(piece)
            if not pd.isna(top["sealed_end"]) and at == int(top["sealed_end"]):
                out += framer.finish()
                framer.partial = b""
            line, item, partial, failed = framer.state()
            made = [(key[0], top["stream_id"], 0, i, b, f, e, None, None, None) for i, b, f, e in out]
            made.append((key[0], top["stream_id"], 1, item, line, partial, None, at, failed, len(out)))
            return pd.DataFrame(made, columns=["source_id", "stream_id", "kind", "item_index", "source_byte", "frame", "error", "at", "failed", "n"]).astype({"item_index": "Int64", "at": "Int64", "n": "Int64", "failed": "boolean"})

        return met.groupBy("source_id").applyInPandas(run, "source_id string, stream_id string, kind int, item_index long, source_byte long, frame binary, error string, at long, failed boolean, n long")

    def drive(self, work: int = WORK) -> dict[str, int]:
        """Frames what is captured beyond the checkpoints, at most `work` bytes of a source, appends the outputs, and moves the checkpoints. Gives how many frames were appended, met again, and refused, and whether bytes are left."""
        folder = f"{self.store.path}/_tmp/frames-{uuid.uuid4().hex}"
        self._framed(work).write.parquet(folder)
        found = self.spark.read.parquet(folder)
        frames = found.where("kind = 0 and error is null")
        events = frames.select("source_id", "stream_id", "item_index", "source_byte", *[c.alias(n) for n, c in self.mapper(frames).items()])
        current = self.log.policies().select("stream_id", F.col("current").alias("generation"))
        seq = F.row_number().over(_order()).cast("long")
        asked = events.join(current, "stream_id").withColumn("seq", seq)
        # the generation that a marker pinned stands for its output
        known = self.store.read("markers", MARKERS).select("source_id", "item_index", F.col("generation").alias("pinned"))
        asked = asked.join(known, ["source_id", "item_index"], "left").withColumn("generation", F.coalesce("pinned", "generation")).drop("pinned")
        told = self.log.append_generated(asked.select("seq", "stream_id", "generation", "event_id", "schema_id", "schema_version", "payload", "source_id", "item_index", "source_byte"))
        self.store._reached("appended")
        good = told.where("error_code is null")
        digest = F.sha2(F.concat_ws("|", F.hex("event_id"), F.hex("payload")), 256).alias("digest")
        marks = good.join(known, ["source_id", "item_index"], "left_anti").select("source_id", "item_index", "source_byte", digest, "generation", F.col("offset").alias("committed"))
        # a source moves on only if all its outputs stand
        bad = told.where("error_code is not null").select("source_id").distinct()
        ends = found.where("kind = 1").join(bad, "source_id", "left_anti")
        last = good.groupBy("source_id").agg(F.max_by("offset", "item_index").alias("committed"))
        before = self.checkpoints().select("source_id", F.col("committed").alias("earlier"))
        moved = ends.join(last, "source_id", "left").join(before, "source_id", "left").select(
            "source_id", F.col("at").alias("offset"), F.col("item_index").alias("next_index"), F.coalesce("committed", "earlier").alias("committed"), F.col("source_byte").alias("line_start"), F.col("frame").alias("partial"), "failed",
        )
        self.store.commit({"markers": marks, "parsers": moved}, uuid.uuid4().hex)
        counts = told.groupBy(F.coalesce("outcome", F.lit("Refused")).alias("o")).agg(F.count("*").alias("n")).collect()
        self.store.discard(folder)
        left = self.sources().join(self.checkpoints().select("source_id", "offset"), "source_id", "left").where("captured_end > coalesce(offset, 0)")
        return {r.o: r.n for r in counts} | {"remaining": int(not left.isEmpty())}


def _order():
    from pyspark.sql import Window

    return Window.partitionBy("stream_id").orderBy("source_id", "item_index")
