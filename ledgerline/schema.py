"""Table schemas, outcomes and limits of the event log."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql.types import BinaryType, BooleanType, LongType, StringType, StructField, StructType


def _table(**columns: object) -> StructType:
    kinds = {str: StringType(), bytes: BinaryType(), int: LongType(), bool: BooleanType()}
    return StructType([StructField(name, kinds[kind]) for name, kind in columns.items()])


RECORDS = _table(stream_id=str, incarnation=bytes, offset=int, generation=int, event_id=str, schema_id=str, schema_version=int, payload=bytes)
#: as stored: with the digest of what a retry must equal
STORED = StructType([*RECORDS.fields, StructField("content", StringType())])
REQUESTS = _table(seq=int, stream_id=str, incarnation=bytes, generation=int, event_id=str, schema_id=str, schema_version=int, payload=bytes)
OUTCOMES = _table(seq=int, outcome=str, error_code=str, offset=int)
STREAM_NAMES = _table(stream_id=str, incarnation=bytes, active=bool)
STREAMS = _table(stream_id=str, incarnation=bytes, floor=int, tail=int, retired=bool)
TAILS = _table(stream_id=str, incarnation=bytes, tail=int)
LEASES = _table(lease_id=str, snapshot_id=bytes, stream_id=str, incarnation=bytes, covered=int, through=int, expires=int)
POLICIES = _table(stream_id=str, incarnation=bytes, oldest=int, current=int)
FLOORS = _table(stream_id=str, incarnation=bytes, floor=int)
RECEIPTS = _table(operation_id=str, kind=str, request=str, receipt=str)
SNAPSHOTS = _table(snapshot_id=bytes, stream_id=str, incarnation=bytes, covered=int, schema_id=str, schema_version=int, content_bytes=int, digest=bytes, state=str)
CHUNKS = _table(snapshot_id=bytes, offset=int, bytes=bytes)
SOURCES = _table(source_id=str, parser=str, stream_id=str, captured_end=int, receipt_floor=int, sealed_end=int, finished=bool)
CAPTURES = _table(source_id=str, start=int, end=int, digest=str)
CAPTURED = _table(source_id=str, start=int, bytes=bytes)
MARKERS = _table(source_id=str, item_index=int, source_byte=int, digest=str, generation=int, committed=int)
PARSERS = _table(source_id=str, offset=int, next_index=int, committed=int, line_start=int, partial=bytes, failed=bool)
ATTACHED = _table(replica_id=str, stream_id=str, mode=str, acknowledged=int, destination_epoch=str, max_backlog_bytes=int, pending_id=str, pending_through=int)
BATCHES = _table(batch_id=str, stream_id=str, after=int, through=int, digest=str)
SEGMENTS = _table(source_id=str, source_incarnation=bytes, start=int, bytes=bytes)
REPLICAS = _table(replica_id=str, origin_id=bytes, stream_id=str, incarnation=bytes, acknowledged=int, max_backlog_bytes=int, mode=str)

# Names of outcomes and errors, and the sizes that decide quotas and page cuts.
INSERTED, DEDUPLICATED, REJECTED = "Inserted", "Deduplicated", "Rejected"
CAPACITY_EXCEEDED = "CapacityExceeded"
CURSOR_AHEAD = "CursorAhead"
HISTORY_UNAVAILABLE = "HistoryUnavailable"
IDEMPOTENCY_CONFLICT = "IdempotencyConflict"
INVALID_CONFIG = "InvalidConfig"
OFFSET_OVERFLOW = "OffsetOverflow"
STALE_INCARNATION = "StaleIncarnation"
STORE_CORRUPT = "StoreCorrupt"
STREAM_UNAVAILABLE = "StreamUnavailable"
EVENT_ENVELOPE = 128
RECORD_CHARGE = 256
STREAM_CHARGE = 256
RECEIPT_CHARGE = 256
SNAPSHOT_CHARGE = 192
CHUNK_CHARGE = 64
MAPPING_CHARGE = 128
SEGMENT_CHARGE = 128
MARKER_CHARGE = 192
IDENTIFIER_BYTES = 256
CURSOR_VERSION = 1
# What storage outlives, from least to most.
PROFILES = ["Ephemeral", "ProcessRestart"]


class LogError(Exception):
    """A refused request; code is one of the error names."""

    def __init__(self, code: str, detail: str = ""):
        super().__init__(f"{code}: {detail}" if detail else code)
        self.code = code


@dataclass(frozen=True)
class Limits:
    """Every limit is finite and positive."""

    event_bytes: int = 1 << 20
    page_records: int = 256
    page_bytes: int = 1 << 20
    batch_events: int = 1 << 17
    snapshot_bytes: int = 1 << 30
    chunk_bytes: int = 1 << 16
    cleanup_rows: int = 256
    cleanup_bytes: int = 2 << 20
    lease_ms: int = 300_000
    operation_receipts: int = 4096
    persistence: str = "Ephemeral"

    def __post_init__(self) -> None:
        if self.persistence not in PROFILES:
            raise LogError(INVALID_CONFIG, f"persistence={self.persistence!r}")
        for f in fields(self):
            value = getattr(self, f.name)
            if f.name != "persistence" and (not isinstance(value, int) or not 0 < value < 1 << 63):
                raise LogError(INVALID_CONFIG, f"{f.name}={value!r}")
