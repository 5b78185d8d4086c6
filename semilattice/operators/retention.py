"""Which rows have outlived their retention, and the ops that delete them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from semilattice.functions.wire import auto_delete_days

DAY_MS = 86_400_000


def plan_deletes(rows: DataFrame, anchor_ms: Column, first_synced_ms: Column, days: Column, fallback_days: Column, now_ms: Column) -> DataFrame:
    """Rows whose time has run out, with ``expires_at``: so many days after the later of anchor and first sync.

    A row without an anchor, without a first sync or without a number of days stays.
    """
    lasting = auto_delete_days(days, fallback_days)
    expires = (F.greatest(anchor_ms, first_synced_ms) + lasting * DAY_MS).cast("long")
    known = anchor_ms.isNotNull() & first_synced_ms.isNotNull() & lasting.isNotNull()
    return rows.withColumn("expires_at", F.when(known, expires)).where(F.col("expires_at") <= now_ms)


def delete_ops(planned: DataFrame, scope: Column, table: str, row_id: Column, stamp: Column) -> DataFrame:
    """One delete for each planned row, a transaction each."""
    return planned.select(scope.alias("scope_id"), F.lit(table).alias("table_name"), row_id.alias("row_id"), F.lit("delete").alias("kind"), stamp.alias("hlc"), F.concat(F.lit("retention-"), row_id).alias("txn_id"))
