"""Relations between collections, and values derived from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from semilattice.functions.wire import key_json


def key_text(df: DataFrame, name: str) -> Column:
    """A relation's key as text: a missing one is the text ``null``, so that 1 meets "1", 1.0 meets 1 and null meets "null"."""
    return F.coalesce(key_json(df, name), F.lit("null"))


def has_many(parents: DataFrame, children: DataFrame, local: str, foreign: str, name: str, order: list[str], keep: list[str]) -> DataFrame:
    """Parents with the array ``name`` of their children's ``keep`` columns in order; empty where there are none.

    Repeated parents get the same array each, repeated children stand in it each; children equal in ``order`` follow
    their kept columns, nulls first. Without parents the result is empty.
    """
    rows = F.array_sort(F.collect_list(F.struct(*order, *(k for k in keep if k not in order))))
    grouped = children.groupBy(key_text(children, foreign).alias("_k")).agg(rows.alias(name))
    joined = parents.join(grouped, key_text(parents, local) == F.col("_k"), "left").drop("_k")
    return joined.withColumn(name, F.coalesce(F.col(name), F.array().cast(joined.schema[name].dataType)))


def has_one(sources: DataFrame, targets: DataFrame, local: str, foreign: str, order: list[str], keep: dict[str, str]) -> DataFrame:
    """Sources with columns of the first matching target; null where there is none.

    ``order`` decides which is first; of targets that tie in it any one is taken, so it should end in a key.
    """
    first = targets.withColumn("_k", key_text(targets, foreign)).withColumn("_n", F.row_number().over(W.partitionBy("_k").orderBy(*order))).where("_n = 1")
    picked = first.select("_k", *(F.col(c).alias(a) for c, a in keep.items()))
    return sources.join(picked, key_text(sources, local) == F.col("_k"), "left").drop("_k")


def visible_children(children: DataFrame, live_parents: DataFrame, foreign: str, parent_id: str) -> DataFrame:
    """Children whose parent is live; a null key has none. Repeated children stay each."""
    return children.join(live_parents.select(F.col(parent_id).alias("_p")), F.col(foreign) == F.col("_p"), "left_semi")


def child_counts(parents: DataFrame, children: DataFrame, local: str, foreign: str, name: str) -> DataFrame:
    """Parents with the number of their children, zero where there are none; children are counted before they move."""
    n = children.groupBy(F.col(foreign).alias("_k")).agg(F.count("*").alias(name))
    return parents.join(n, F.col(local) == F.col("_k"), "left").drop("_k").withColumn(name, F.coalesce(name, F.lit(0)))


def derived_total(parents: DataFrame, children: DataFrame, local: str, foreign: str, amount: str, override: Column, name: str) -> DataFrame:
    """``name``: the override where there is one, else the sum of the children's amounts."""
    sums = children.groupBy(F.col(foreign).alias("_k")).agg(F.sum(amount).alias("_sum"))
    return parents.join(sums, F.col(local) == F.col("_k"), "left").withColumn(name, F.coalesce(override, "_sum", F.lit(0.0))).drop("_k", "_sum")


def ordered_lookup(ids: DataFrame, rows: DataFrame, place: str, keys: list[str]) -> DataFrame:
    """Rows in the order of selected ids; ids that are not held drop out."""
    return ids.join(rows, keys).orderBy(place)


def dirty(rows: DataFrame, outbox: DataFrame, quarantine: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with ``is_dirty``: whether an unsent or refused op names them."""
    named = outbox.select(*keys).unionByName(quarantine.select(*keys)).distinct().withColumn("is_dirty", F.lit(True))
    return rows.join(named, keys, "left").withColumn("is_dirty", F.coalesce("is_dirty", F.lit(False)))


def missing_from(local: DataFrame, remote: DataFrame, keys: list[str]) -> DataFrame:
    """Local rows that a snapshot does not hold; a null key is held by none."""
    return local.join(remote.select(*keys), keys, "left_anti")
