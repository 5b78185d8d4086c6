"""Change data capture: pulls, snapshots, the tombstone floor and the handshake."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from semilattice.functions import hlc
from semilattice.operators.resolve import ROW_KEY

DAY_MS = 24 * 60 * 60 * 1000
FLOOR_MS = 30 * DAY_MS


def pull(records: DataFrame, scope: str, cursor: int) -> DataFrame:
    """A scope's records above a cursor; both predicates reach the scan."""
    return records.where((F.col("scope_id") == scope) & (F.col("server_seq") > cursor))


def pull_many(records: DataFrame, cursors: DataFrame) -> DataFrame:
    """The same for many devices at once: ``cursors`` has device_id, scope_id, last_server_seq."""
    return records.join(cursors, "scope_id").where("server_seq > last_server_seq").drop("last_server_seq")


def snapshot(records: DataFrame, scope: str) -> DataFrame:
    return records.where(F.col("scope_id") == scope)


def doomed(rows: DataFrame, now_ms: Column, older_ms: int = FLOOR_MS) -> DataFrame:
    """Rows whose deletion is old enough to forget."""
    return rows.where(F.col("deleted_hlc").isNotNull() & (hlc.wall(F.col("deleted_hlc")) <= now_ms - older_ms))


def raised_floor(rows: DataFrame, scopes: DataFrame, now_ms: Column, older_ms: int = FLOOR_MS) -> DataFrame:
    """Scopes with the floor that pruning needs; it rises before anything goes."""
    top = doomed(rows, now_ms, older_ms).groupBy("scope_id").agg(F.max("server_seq").alias("_top"))
    floor = F.greatest("tombstone_floor_seq", F.coalesce("_top", F.lit(0)))
    return scopes.join(top, "scope_id", "left").withColumn("tombstone_floor_seq", floor).drop("_top")


def prune(rows: DataFrame, fields: DataFrame, now_ms: Column, older_ms: int = FLOOR_MS) -> tuple[DataFrame, DataFrame]:
    """Rows and fields without those of doomed rows."""
    gone = doomed(rows, now_ms, older_ms).select(*ROW_KEY)
    return rows.join(gone, ROW_KEY, "left_anti"), fields.join(gone, ROW_KEY, "left_anti")


def handshake(requests: DataFrame, scopes: DataFrame) -> DataFrame:
    """What each request is answered, and the schema the scope has afterwards.

    A scope without a schema takes the request's, and a greater version replaces it; a lower one, or the same
    with another hash, is a mismatch. A cursor below the floor, of another epoch or above the head must resync.
    """
    r = requests.select("scope_id", "device_id", F.col("schema_hash").alias("r_hash"), F.col("schema_version").alias("r_version"), "last_server_seq", F.col("epoch").alias("r_epoch"))
    both = r.join(scopes, "scope_id", "left")
    newer = F.col("schema_version").isNull() | (F.col("r_version") > F.col("schema_version"))
    mismatch = ~newer & ((F.col("r_version") < F.col("schema_version")) | ~F.col("r_hash").eqNullSafe(F.col("schema_hash")))
    behind = F.col("last_server_seq") < F.coalesce("tombstone_floor_seq", F.lit(0))
    foreign = F.col("r_epoch").isNotNull() & (F.col("r_epoch") != F.col("epoch"))
    ahead = F.col("last_server_seq") > F.coalesce("server_seq", F.lit(0))
    reason = F.when(mismatch, "schema_mismatch").when(behind | foreign | ahead, "resync_required")
    return both.select("scope_id", "device_id", reason.isNull().alias("ok"), reason.alias("reason"), "epoch", F.when(newer, F.col("r_hash")).otherwise(F.col("schema_hash")).alias("schema_hash"), F.when(newer, F.col("r_version")).otherwise(F.col("schema_version")).alias("schema_version"))


def set_schema(scopes: DataFrame, scope: str, schema_hash: str, version: int) -> DataFrame:
    """The operator's rollback: sets the schema of a scope that exists."""
    own = F.col("scope_id") == scope
    return scopes.withColumns({"schema_hash": F.when(own, F.lit(schema_hash)).otherwise(F.col("schema_hash")), "schema_version": F.when(own, F.lit(version)).otherwise(F.col("schema_version"))})
