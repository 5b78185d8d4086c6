"""Op logs from event tables, so that everything that folds a log has one to fold."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from semilattice.functions import hlc, wire


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def from_events(events: DataFrame, lifecycle: bool = False, rows: int = 7) -> DataFrame:
    """Ops of the table ``activity``, one an event: scope = user, row = event modulo ``rows``, field = event type.

    With ``lifecycle`` every eleventh event deletes its row instead and every thirteenth restores it.
    """
    ms = F.expr("unix_micros(cast(ts as timestamp)) div 1000")
    eid = F.col("event_id")
    stamp = hlc.encode(ms, eid, F.concat(F.lit("dev"), (eid % 3).cast("string")))
    kind = F.lit("set")
    if lifecycle:
        kind = F.when(eid % 11 == 0, "delete").when(eid % 13 == 0, "restore").otherwise("set")
    base = events.select(
        eid.alias("pos"),
        F.col("user_id").cast("string").alias("scope_id"),
        F.lit("activity").alias("table_name"),
        F.concat(F.lit("r"), (eid % rows).cast("string")).alias("row_id"),
        kind.alias("kind"),
        F.col("event_type").alias("field"),
        F.col("value"),
        stamp.alias("hlc"),
        F.concat(F.lit("t"), F.expr("event_id div 4").cast("string")).alias("txn_id"),
    )
    sets = F.col("kind") == "set"
    value = F.when(sets, F.col("value"))
    return base.withColumns({"field": F.when(sets, F.col("field")), "value": value, "value_json": F.when(sets, wire.number_json(F.col("value")))})


def ops(spark: SparkSession, sf_dir: str, lifecycle: bool = False) -> DataFrame:
    return from_events(table(spark, sf_dir, "events"), lifecycle)


#: The same log in DuckDB SQL: a CTE named ops.
OPS_SQL = """ops AS (SELECT event_id AS pos, CAST(user_id AS VARCHAR) AS scope_id, 'activity' AS table_name, 'r' || CAST(event_id % 7 AS VARCHAR) AS row_id, 'set' AS kind, event_type AS field, value, lower(to_base(epoch_us(ts) // 1000, 36, 15)) || '-' || lower(to_base(event_id, 36, 6)) || '-dev' || CAST(event_id % 3 AS VARCHAR) AS hlc, 't' || CAST(event_id // 4 AS VARCHAR) AS txn_id FROM events)"""
LIFE_SQL = OPS_SQL.replace("ops AS (", "all_ops AS (") + ", ops AS (SELECT pos, scope_id, table_name, row_id, k AS kind, CASE WHEN k = 'set' THEN field END AS field, CASE WHEN k = 'set' THEN value END AS value, hlc, txn_id FROM (SELECT *, CASE WHEN pos % 11 = 0 THEN 'delete' WHEN pos % 13 = 0 THEN 'restore' ELSE 'set' END AS k FROM all_ops))"
