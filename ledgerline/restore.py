"""Restores a closed store under new lifetimes: staged, held against its audits, then published under a name that must be free.

Every incarnation is replaced, so cursors of the old store are stale in the new
one; replicas are detached and their destination epoch rotates; recovery leases
and receipts of operations are left behind. New incarnations follow from the
operation's id, so a repeated restore makes the same store.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ledgerline.engine import EventLog
from ledgerline.operators import operations, replication
from ledgerline.schema import ATTACHED, CAPTURED, CAPTURES, CHUNKS, FLOORS, MARKERS, PARSERS, POLICIES, SNAPSHOTS, SOURCES, STORED, STREAM_NAMES, TAILS, LogError
from ledgerline.sources.store import Store

#: tables by name: schema, and the keys of control tables (of the others all rows are kept)
TABLES: dict[str, tuple[StructType, list[str] | None]] = {
    "stream_names": (STREAM_NAMES, ["stream_id"]),
    "records": (STORED, None),
    "tails": (TAILS, ["stream_id", "incarnation"]),
    "floors": (FLOORS, ["stream_id", "incarnation"]),
    "policies": (POLICIES, ["stream_id", "incarnation"]),
    "snapshots": (SNAPSHOTS, ["snapshot_id"]),
    "snapshot_chunks": (CHUNKS, None),
    "sources": (SOURCES, ["source_id"]),
    "captures": (CAPTURES, None),
    "captured": (CAPTURED, None),
    "markers": (MARKERS, None),
    "parsers": (PARSERS, ["source_id"]),
    "replicas": (ATTACHED, ["replica_id", "stream_id"]),
}


def restore(spark: SparkSession, backup: str, target: str, operation_id: str, digest: str | None = None) -> Store:
    """digest: what replication.backup_digest gave for the backup. The store at `target`, which must not be there yet."""
    if digest is not None and replication.backup_digest(spark, f"{backup}/data") != digest:
        raise LogError("BackupMismatch", backup)
    source = Store(spark, backup)
    fs, at = source._fs, source._jvm.org.apache.hadoop.fs.Path
    if fs.exists(at(target)):
        raise LogError("AlreadyExists", target)
    staging = _staging(target)
    owner = f"{staging}/_owner"
    if fs.exists(at(staging)) and not fs.exists(at(f"{owner}-{operation_id}")):
        raise LogError("RestoreInProgress", staging)
    fs.delete(at(staging), True)  # of an earlier try of this operation
    fs.mkdirs(at(staging))
    fs.create(at(f"{owner}-{operation_id}"), False).close()
    with Store(spark, staging, create=True) as made:
        held = {name: _held(source, name) for name in TABLES}
        mapping = _mapping(held, operation_id)
        tables = {name: _remapped(name, rows, mapping, operation_id) for name, rows in held.items() if rows is not None}
        made.commit(tables, f"restore-{operation_id}")
        _audited(made, held["snapshots"], mapping)
    fs.delete(at(f"{owner}-{operation_id}"), False)
    if fs.exists(at(target)) or not fs.rename(at(staging), at(target)):
        raise LogError("AlreadyExists", target)
    return Store(spark, target)


def cleanup_staging(spark: SparkSession, target: str, operation_id: str) -> bool:
    """Removes what an unfinished restore of this operation left, and nothing else."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = at(target).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(at(f"{_staging(target)}/_owner-{operation_id}")):
        return False
    return bool(fs.delete(at(_staging(target)), True))


def _staging(target: str) -> str:
    return f"{target.rstrip('/')}.staging"


def _held(source: Store, name: str) -> DataFrame | None:
    schema, keys = TABLES[name]
    if source._rows(name, schema) is None:
        return None
    return source.read(name, schema) if keys is None else source.latest(name, schema, keys)


def _mapping(held: dict[str, DataFrame | None], operation_id: str) -> DataFrame:
    """Every lifetime that any table names, with its new incarnation."""
    named = [rows.select("incarnation") for rows in held.values() if rows is not None and "incarnation" in rows.columns]
    every = named[0]
    for rows in named[1:]:
        every = every.union(rows)
    fresh = F.unhex(F.substring(F.sha2(F.concat_ws("|", F.lit(operation_id), F.hex("incarnation")), 256), 1, 32))
    return every.distinct().select("incarnation", fresh.alias("fresh"))


def _remapped(name: str, rows: DataFrame, mapping: DataFrame, operation_id: str) -> DataFrame:
    schema, _ = TABLES[name]
    if "incarnation" in rows.columns:
        rows = rows.join(mapping, "incarnation").withColumn("incarnation", F.col("fresh"))
    if name == "replicas":
        none = F.lit(None)
        epoch = uuid.uuid5(uuid.NAMESPACE_OID, operation_id).hex
        rows = rows.withColumns({"mode": F.lit("DetachedNeedsBootstrap"), "destination_epoch": F.lit(epoch), "pending_id": none.cast("string"), "pending_through": none.cast("long")})
    return rows.select(*schema.names)


def _audited(made: Store, snapshots: DataFrame | None, mapping: DataFrame) -> None:
    """Gapless records between floor and tail, and published snapshots whose chunks give their digests."""
    EventLog(made, audit=True)
    if snapshots is None:
        return
    told = made.latest("snapshots", SNAPSHOTS, ["snapshot_id"]).where("state = 'Published'").withColumn("digest", F.lower(F.hex("digest")))
    lives = told.select("stream_id", F.col("incarnation").alias("new_incarnation")).distinct()
    if not operations.restored_snapshots(told, made.read("snapshot_chunks", CHUNKS), lives).where("error is not null").isEmpty():
        raise LogError("StoreCorrupt", "a snapshot differs from its digest")
