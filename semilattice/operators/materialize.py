"""From field records to typed rows and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from semilattice.functions import wire
from semilattice.operators.resolve import ROW_KEY
from semilattice.plans.schema import PREFIX, Collection


def pivot(fields: DataFrame, names: list[str], value: str = "value") -> DataFrame:
    """One row a row, one column a declared field. Partial sums on the map side: each field has one record."""
    aggs = [F.max(F.when(F.col("field") == n, F.col(value))).alias(n) for n in names]
    return fields.where(F.col("field").isin(*names)).groupBy(*ROW_KEY).agg(*aggs)


def typed(fields: DataFrame, collection: Collection) -> DataFrame:
    """Field records (``value_json``) as the collection's typed rows.

    Absent fields read as their type's default, or null where nullable; ``null_fields`` names the fields whose
    record holds an explicit null, which a wide row cannot otherwise tell from an absent one.
    """
    names = [f.name for f in collection.all_fields if f.name not in ("scope_id",)]
    own = fields.where((F.col("table_name") == collection.name) & F.col("field").isin(*names))
    aggs = [F.max(F.when(F.col("field") == n, F.col("value_json"))).alias(n) for n in names]
    nulls = F.array_sort(F.collect_list(F.when(F.col("value_json").isNull() | (F.col("value_json") == "null"), F.col("field")))).alias("null_fields")
    wide = own.groupBy("scope_id", "row_id").agg(*aggs, nulls)
    cols = [wire.decode_field(F.col(f.name), f.type, f.nullable, f.values).alias(f.name) for f in collection.all_fields if f.name not in ("scope_id", "id")]
    identity = F.coalesce(wire.decode_field(F.col("id"), "string", True), "row_id").alias("id")
    return wide.select(identity, "scope_id", *cols, "null_fields")


def melt(rows: DataFrame, names: list[str], keys: list[str]) -> DataFrame:
    """Wide rows as field records, a null value giving none."""
    pairs = F.array(*(F.struct(F.lit(n).alias("field"), F.col(n).cast("string").alias("value")) for n in names))
    return rows.select(*keys, F.explode(pairs).alias("p")).select(*keys, "p.field", "p.value").where("value is not null")


def _tree(names: list[str]) -> dict:
    out: dict = {}
    for n in names:
        at = out
        *path, leaf = n.split("__")
        for p in path:
            at = at.setdefault(p, {}) if isinstance(at.get(p, {}), dict) else at.update({p: {}}) or at[p]
        at[leaf] = n
    return out


def nest(rows: DataFrame) -> DataFrame:
    """Columns named ``a__b`` as structs ``a{b}``; a column that stands where a struct must is replaced by it."""

    def build(tree: dict) -> list[Column]:
        return [F.struct(*build(v)).alias(k) if isinstance(v, dict) else F.col(f"`{v}`").alias(k) for k, v in tree.items()]

    return rows.select(*build(_tree(rows.columns)))


def public(rows: DataFrame) -> DataFrame:
    """Without the columns that readers never see."""
    return rows.select(*(c for c in rows.columns if not c.startswith(PREFIX)))


def evolve(rows: DataFrame, collection: Collection) -> DataFrame:
    """Rows written under an older schema, with the missing declared fields as their defaults."""
    missing = {f.name: F.lit(f.default).cast(f.spark().dataType) for f in collection.all_fields if f.name not in rows.columns}
    return rows.withColumns(missing) if missing else rows
