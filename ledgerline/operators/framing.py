"""From bytes to frames: newline framing, capture segments and parser checkpoints."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions.arrays import let, running

PRESERVE, STRIP = "Preserve", "Strip"
EMIT, REJECT = "Emit", "Reject"


def newline_frames(texts: DataFrame, key: str, text: str, max_bytes: int = 1 << 20, crlf: str = STRIP, empties: bool = True, final: str = EMIT) -> DataFrame:
    """key, item_index, source_byte, frame, error of each text's lines, in native expressions.

    Lines end at \\n; Strip removes one \\r before it. A last line without \\n is
    emitted as it is or rejected (truncated_input); an input that ends in \\n has
    no further line. A line over max_bytes, its \\r included, stops its text with
    frame_too_large at the byte after the limit; lines before it stand. Each row
    is framed on its own, within the row: nothing is shuffled, and keys may repeat.
    """
    none = F.lit(None)
    kind = "struct<item_index:bigint,source_byte:bigint,frame:string,error:string>"

    def rows(x: Column) -> Column:
        """x: lines, and stop, the place from 1 of the first line that is too large, or 0."""

        def frame(raw: Column, last: Column) -> Column:
            return F.when(last, raw).otherwise(F.regexp_replace(raw, r"\r\z", "")) if crlf == STRIP else raw

        def emitted(raw: Column, i: Column) -> Column:
            last = i == F.size(x["lines"]) - 1
            cond = ((x["stop"] == 0) | (i + 1 < x["stop"])) & ~(last & (raw == ""))
            if final == REJECT:
                cond = cond & ~last
            return cond if empties else cond & (frame(raw, last) != "")

        def row(raw: Column, i: Column, y: Column) -> Column:
            last, start, index = i == F.size(x["lines"]) - 1, F.get(y["starts"], i).cast("long"), F.get(y["items"], i).cast("long")
            found = F.when(emitted(raw, i), F.struct(index, start, frame(raw, last), none).cast(kind))
            found = found.when(i + 1 == x["stop"], F.struct(none, start + max_bytes, none, F.lit("frame_too_large")).cast(kind))
            if final == REJECT:
                found = found.when(last & (raw != "") & (x["stop"] == 0), F.struct(none, start, none, F.lit("truncated_input")).cast(kind))
            return found

        add = lambda a, v: a + v
        starts = running(F.transform(x["lines"], lambda raw: F.octet_length(raw) + 1), add)
        items = running(F.transform(x["lines"], lambda raw, i: emitted(raw, i).cast("int")), add)
        return let(F.struct(starts.alias("starts"), items.alias("items")), lambda y: F.filter(F.transform(x["lines"], lambda raw, i: row(raw, i, y)), lambda r: r.isNotNull()))

    def stop(lines: Column) -> Column:
        return F.array_position(F.transform(lines, lambda raw: F.octet_length(raw) > max_bytes), True).cast("int")

    framed = let(F.split(F.col(text), "\n", -1), lambda lines: let(F.struct(lines.alias("lines"), stop(lines).alias("stop")), rows))
    return texts.where(F.col(text).isNotNull()).select(key, F.explode(framed).alias("row")).select(key, "row.*")


def binary_frames(segments: DataFrame, key: str = "source_id", max_bytes: int = 1 << 20, crlf: str = STRIP, empties: bool = True, final: str = EMIT) -> DataFrame:
    """newline_frames of arbitrary bytes, across segments (key, start, bytes) in order; frames don't depend on how input was cut.

    Only the unfinished line of one source is held at a time.
    """
    kind = segments.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source, framer = None, None
        out: list[tuple] = []
        for batch in batches:
            for name, raw in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if framer is None or name != source:
                    if framer is not None:
                        out += [(source, *f) for f in framer.finish()]
                    source, framer = name, Framer(max_bytes, crlf, empties, final)
                out += [(name, *f) for f in framer.push(raw)]
            if out:
                yield _frames(out, batch.schema.field(0).type, key)
                out = []
        if framer is not None and (out := [(source, *f) for f in framer.finish()]):
            yield _frames(out, batch.schema.field(0).type, key)

    ordered = segments.select(key, "start", "bytes").repartition(key).sortWithinPartitions(key, "start")
    return ordered.mapInArrow(run, f"`{key}` {kind}, item_index long, source_byte long, frame binary, error string")


def _frames(rows: list[tuple], kind: pa.DataType, key: str) -> pa.RecordBatch:
    types = [kind, pa.int64(), pa.int64(), pa.binary(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=[key, "item_index", "source_byte", "frame", "error"])


class Framer:
    """An incremental newline framer with a state that can be saved between chunks."""

    def __init__(self, max_bytes: int, crlf: str, empties: bool, final: str):
        self.max_bytes, self.crlf, self.empties, self.final = max_bytes, crlf, empties, final
        self.line_start, self.item, self.partial, self.failed = 0, 0, b"", False

    def state(self) -> tuple[int, int, bytes, bool]:
        return self.line_start, self.item, self.partial, self.failed

    def restore(self, state: tuple[int, int, bytes, bool]) -> None:
        self.line_start, self.item, self.partial, self.failed = state

    def _emit(self, frame: bytes) -> list[tuple]:
        if not frame and not self.empties:
            return []
        self.item += 1
        return [(self.item - 1, self.line_start, frame, None)]

    def _too_large(self) -> list[tuple]:
        self.failed, self.partial = True, b""
        return [(None, self.line_start + self.max_bytes, None, "frame_too_large")]

    def push(self, chunk: bytes) -> list[tuple]:
        out: list[tuple] = []
        if self.failed:
            return out
        *whole, rest = chunk.split(b"\n")
        for raw in whole:
            raw = self.partial + raw
            self.partial = b""
            if len(raw) > self.max_bytes:
                return out + self._too_large()
            out += self._emit(raw[:-1] if self.crlf == STRIP and raw.endswith(b"\r") else raw)
            self.line_start += len(raw) + 1
        self.partial += rest
        return out + self._too_large() if len(self.partial) > self.max_bytes else out

    def finish(self) -> list[tuple]:
        if self.failed or not self.partial:
            return []
        if self.final == REJECT:
            return [(None, self.line_start, None, "truncated_input")]
        return self._emit(self.partial)


def capture_faults(segments: DataFrame, key: str) -> DataFrame:
    """Segments (key, start, size) that don't start at the captured end."""
    order = Window.partitionBy(key).orderBy("start")
    expected = F.coalesce(F.lag(F.col("start") + F.col("size")).over(order), F.lit(0)).cast("long")
    return segments.withColumn("expected", expected).where(F.col("start") != F.col("expected"))


def checkpoints(requests: DataFrame, sources: DataFrame, markers: DataFrame) -> DataFrame:
    """publish_parser_checkpoint: by the source's parser, monotone, within what is captured and appended; every index covered has a marker at or before the offset, and the last of them names the committed output. The standing checkpoint again is accepted; all else is a conflict.

    requests: source_id, parser, offset, next_index, committed. sources:
    source_id, parser0, finished, at_offset, at_index, at_committed (null: none
    yet), captured_end, next_item. markers: source_id, item_index, source_byte, committed.
    """
    met = requests.join(sources, "source_id")
    found = markers.select("source_id", "item_index", "source_byte", F.col("committed").alias("output"))
    covered = met.join(found, "source_id", "left").where((F.col("item_index") >= F.coalesce("at_index", F.lit(0))) & (F.col("item_index") < F.col("next_index")))
    seen = covered.groupBy("source_id").agg(F.count_distinct("item_index").alias("n"), F.max("source_byte").alias("last_byte"), F.max_by("output", "item_index").alias("output"))
    known = met.join(seen, "source_id", "left")
    old_offset, old_index = F.coalesce("at_offset", F.lit(0)), F.coalesce("at_index", F.lit(0))
    foreign = (F.col("parser") != F.col("parser0")) | (F.col("offset") > F.col("captured_end"))
    same = F.coalesce((F.col("offset") == F.col("at_offset")) & (F.col("next_index") == F.col("at_index")) & F.col("committed").eqNullSafe(F.col("at_committed")), F.lit(False))
    behind = (F.col("offset") < old_offset) | (F.col("next_index") < old_index) | (F.col("next_index") > F.col("next_item"))
    holes = (F.coalesce("n", F.lit(0)) != F.col("next_index") - old_index) | F.coalesce(F.col("last_byte") > F.col("offset"), F.lit(False))
    expected = F.when(F.col("next_index") == old_index, F.col("at_committed")).otherwise(F.col("output"))
    bad = foreign | (~same & (F.col("finished") | behind | holes | ~F.col("committed").eqNullSafe(expected)))
    error = F.when(bad, "CheckpointConflict")
    return known.select("source_id", "offset", "next_index", error.alias("error"), F.when(error.isNull(), F.col("offset")).otherwise(old_offset).alias("offset_after"))
