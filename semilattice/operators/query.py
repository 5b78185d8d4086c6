"""Scoped reads: query keys, a builder, result caches and the differences between results."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from semilattice.functions.wire import bind, canonical, text_order, utf16
from semilattice.plans.schema import Schema, SchemaError
from semilattice.sources.store import shared_dir


@dataclass(frozen=True)
class QueryKey:
    table: str
    fields: tuple[str, ...]
    order_by: str | None = None

    @classmethod
    def of(cls, schema: Schema, table: str, fields: list[str] | None = None, order_by: str | None = None) -> QueryKey:
        """A key whose names are declared; by default it lists every field."""
        c = schema[table]
        names = tuple(fields or (f.name for f in c.all_fields))
        for n in (*names, *([order_by] if order_by else [])):
            c.field(n)
        return cls(table, names, order_by)

    def text(self) -> str:
        return canonical({"table": self.table, "fields": sorted(self.fields, key=utf16), "orderBy": self.order_by})


def carries(fields: DataFrame, key: QueryKey) -> DataFrame:
    """Ids of the table's rows that hold a record, null or not, of every field that the key lists."""
    wanted = fields.where((F.col("table_name") == key.table) & F.col("field").isin(*key.fields))
    return wanted.groupBy("scope_id", "row_id").agg(F.count_distinct("field").alias("n")).where(F.col("n") == len(set(key.fields))).drop("n")


def in_order(rows: DataFrame, by: str | None, row_id: str = "row_id") -> DataFrame:
    """Ascending by one column's text in code-unit order, a missing one as empty, then by id."""
    keys = [text_order(F.coalesce(F.col(by).cast("string"), F.lit("")))] if by else []
    return rows.orderBy(*keys, text_order(F.col(row_id)))


def with_places(ordered: DataFrame, name: str) -> DataFrame:
    """Rows of a sorted result with their places from 1; equal keys take places in any order.

    A sort leaves each range of keys in one partition; places come from the partitions' counts and the places within
    them, so that no task sees all rows. The sorted rows are written to the shared folder first: ranges are cut by a
    sample, so that the same sort, run once for the counts and once for the rows, may cut them elsewhere.
    """
    path = f"{shared_dir(ordered.sparkSession)}/places-{uuid.uuid4().hex}"
    at = ordered.withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.shiftrightunsigned("_at", 33))
    at.write.parquet(path)
    at = ordered.sparkSession.read.schema(at.schema).parquet(path)
    counts = at.groupBy("_part").agg(F.count("*").alias("_n"))
    before = counts.select("_part", F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    placed = at.join(F.broadcast(before), "_part")  # one row a partition
    return placed.withColumn(name, F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("_at", "_part", "_before")


class Scoped:
    """Reads of one scope's table; the scope's predicate is always there and reaches the scan."""

    def __init__(self, rows: DataFrame, scope: str, column: str = "scope_id") -> None:
        self.df = rows.where(F.col(column) == F.lit(bind(scope)))
        self.column = column
        self.keys: list[Column] = []

    def _with(self, df: DataFrame) -> Scoped:
        out = object.__new__(Scoped)
        out.df, out.column, out.keys = df, self.column, self.keys
        return out

    def where(self, column: str | Column, op: str = "=", value: object = None) -> Scoped:
        if isinstance(column, Column):
            return self._with(self.df.where(column))
        c = F.col(column)
        made: dict[str, Callable[[], Column]] = {
            "=": lambda: c == F.lit(value),
            "!=": lambda: c != F.lit(value),
            "<": lambda: c < F.lit(value),
            "<=": lambda: c <= F.lit(value),
            ">": lambda: c > F.lit(value),
            ">=": lambda: c >= F.lit(value),
            "in": lambda: c.isin(*value),  # type: ignore[misc]
            "between": lambda: c.between(*value),  # type: ignore[misc]
            "like": lambda: c.ilike(str(value)),  # ASCII letters match in either case
            "is": lambda: c.eqNullSafe(F.lit(value)),
            "is not": lambda: ~c.eqNullSafe(F.lit(value)),
        }
        if op not in made:
            raise ValueError(f"unknown operator {op!r}")
        return self._with(self.df.where(made[op]()))

    def order_by(self, column: str, direction: str = "asc") -> Scoped:
        """Later calls sort within earlier ones, whatever came between. Null is the smallest value."""
        out = self._with(self.df)
        out.keys = [*self.keys, F.col(column).asc_nulls_first() if direction == "asc" else F.col(column).desc_nulls_last()]
        out.df = self.df.orderBy(*out.keys)
        return out

    def limit(self, n: int, offset: int = 0) -> Scoped:
        return self._with((self.df.offset(offset) if offset else self.df).limit(n))

    def select(self, *columns: str) -> DataFrame:
        return self.df.select(*columns)


def assert_scoped(spark: SparkSession, sql: str, column: str = "scope_id") -> None:
    """Refuses SQL that reads any table without an equality of that table's own scope column with a fixed value.

    Every leaf of the optimised plan needs it among the conjuncts of the filters right above it, where Spark puts
    what follows from joins as well. A plan that reads no rows passes.
    """

    def conjuncts(e) -> list:
        return [*conjuncts(e.left()), *conjuncts(e.right())] if e.getClass().getSimpleName() == "And" else [e]

    def items(seq) -> list:
        return [seq.apply(i) for i in range(seq.size())]

    def pins(e, ids: set[int]) -> bool:
        if e.getClass().getSimpleName() not in ("EqualTo", "EqualNullSafe"):
            return False
        sides = (e.left(), e.right())
        for a, b in (sides, sides[::-1]):
            if a.getClass().getSimpleName() == "AttributeReference" and a.exprId().id() in ids and b.foldable():
                return True
        return False

    def walk(node, above: list) -> None:
        kind = node.getClass().getSimpleName()
        below = items(node.children())
        if not below:
            if kind == "OneRowRelation" or (kind == "LocalRelation" and node.data().isEmpty()):
                return
            ids = {a.exprId().id() for a in items(node.output()) if a.name() == column}
            if not any(pins(e, ids) for e in above):
                raise ValueError(f"{node.nodeName()} is read without a fixed {column}")
        kept = [*above, *conjuncts(node.condition())] if kind == "Filter" else above if kind in ("Project", "SubqueryAlias") else []
        for child in below:
            walk(child, kept)

    walk(spark.sql(sql)._jdf.queryExecution().optimizedPlan(), [])


def execute(spark: SparkSession, sql: str, *params: object) -> DataFrame:
    """Any SQL over the registered views, with ? parameters."""
    return spark.sql(sql, args=[bind(p) for p in params])


def cache_key(sql: str, params: list[object]) -> str:
    return canonical({"sql": sql, "parameters": [bind(p) for p in params]})


def delta(before: DataFrame, after: DataFrame, keys: list[str], rev: str = "rev") -> DataFrame:
    """How one result differs from another: ``keys, change`` with added, removed or changed.

    Keys are not null and unique in each result. Revisions compare as values, null equal to null. Equal results, and
    two empty ones, give no rows.
    """
    a = before.select(*keys, F.col(rev).alias("_a"), F.lit(True).alias("_in_a"))
    b = after.select(*keys, F.col(rev).alias("_b"), F.lit(True).alias("_in_b"))
    change = F.when(F.col("_in_a").isNull(), "added").when(F.col("_in_b").isNull(), "removed").when(~F.col("_a").eqNullSafe(F.col("_b")), "changed")
    return a.join(b, keys, "full").withColumn("change", change).where("change is not null").select(*keys, "change")


def apply_delta(before: DataFrame, changes: DataFrame, after_rows: DataFrame, keys: list[str]) -> DataFrame:
    """A result moved on by a delta and the rows it added or changed."""
    kept = before.join(changes.select(*keys), keys, "left_anti")
    return kept.unionByName(after_rows.join(changes.where("change != 'removed'").select(*keys), keys, "left_semi"))


def moved(touched: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Touched keys with the rows they name now, ``removed`` where there is none."""
    return touched.select(*keys).distinct().join(rows.withColumn("_held", F.lit(True)), keys, "left").withColumn("removed", F.col("_held").isNull()).drop("_held")


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Whether two results hold the same rows as often, in any order."""
    return not a.exceptAll(b).take(1) and not b.exceptAll(a).take(1)


@dataclass(frozen=True)
class QuerySnapshot:
    """A watched query's result and how it differs from the one before: ``changes`` (keys, change), null the first time."""

    rows: DataFrame
    changes: DataFrame | None
    same: bool  # whether a reader may keep what it shows


@dataclass
class Subscriptions:
    """Watched queries: each runs once a generation, however many watch it, and all listeners hear once.

    ``keep`` stores a result, for example in the shared folder, and returns it as stored; actions on it then run no
    query again. ``keys`` and ``rev`` tell rows and their versions, as for ``delta``.
    """

    run: Callable[[str], DataFrame]
    keep: Callable[[DataFrame], DataFrame] = lambda df: df
    keys: tuple[str, ...] = ("id",)
    rev: str = "rev"
    generation: int = 0
    _watched: dict[str, int] = field(default_factory=dict)
    _results: dict[str, tuple[int, QuerySnapshot]] = field(default_factory=dict)
    _listeners: list[Callable[[int], None]] = field(default_factory=list)

    def watch(self, key: str) -> Callable[[], None]:
        self._watched[key] = self._watched.get(key, 0) + 1

        def stop() -> None:
            self._watched[key] -= 1
            if not self._watched[key]:
                del self._watched[key]
                self._results.pop(key, None)

        return stop

    def listen(self, hear: Callable[[int], None]) -> Callable[[], None]:
        self._listeners.append(hear)
        return lambda: self._listeners.remove(hear)

    def query_snapshot(self, key: str) -> QuerySnapshot:
        """The result of this generation; one that equals the last one is that same object's rows."""
        at, last = self._results.get(key, (-1, None))
        if last is not None and at == self.generation:
            return last
        rows = self.keep(self.run(key))
        changes = self.keep(delta(last.rows, rows, list(self.keys), self.rev)) if last is not None else None
        same = changes is not None and changes.isEmpty()
        out = QuerySnapshot(last.rows if same else rows, changes, same)
        if key in self._watched:
            self._results[key] = (self.generation, out)
        return out

    def snapshot(self, key: str) -> DataFrame:
        """The result alone."""
        at, last = self._results.get(key, (-1, None))
        if last is not None and at == self.generation:
            return last.rows
        if key not in self._watched:
            return self.run(key)
        if last is None:
            self._results[key] = (self.generation, QuerySnapshot(self.keep(self.run(key)), None, False))
            return self._results[key][1].rows
        return self.query_snapshot(key).rows

    def changed(self) -> None:
        self.generation += 1
        for hear in list(self._listeners):
            hear(self.generation)


def plan_fingerprint(df: DataFrame) -> str:
    """A hash of a query's canonical plan, equal for equal queries over equal sources."""
    return hashlib.sha256(str(df.semanticHash()).encode()).hexdigest()


def require(schema: Schema, table: str) -> None:
    if table not in schema._by:
        raise SchemaError(table)
