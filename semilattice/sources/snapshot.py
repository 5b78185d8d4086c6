"""Snapshots as NDJSON: a header line, field lines, row lines; content-addressed by the body's SHA-256."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from semilattice.functions.wire import json_string, number_json, quote_name, sql_literal, text_order
from semilattice.plans import schema as S

NUL = "\u0000"


class SnapshotError(ValueError):
    pass


def _key(*columns: str):
    return text_order(F.concat_ws(NUL, *columns))


def _text(c: str):
    return F.when(F.col(c).isNull(), F.lit("null")).otherwise(json_string(F.col(c)))


def _object(pairs: dict):
    parts = []
    for i, (k, v) in enumerate(pairs.items()):
        parts += [F.lit(("," if i else "{") + f'"{k}":'), v]
    return F.concat(*parts, F.lit("}"))


def field_lines(fields: DataFrame, by: str | None = None) -> DataFrame:
    """``key, line`` of field records; keys of a line are in fixed order."""
    line = _object({"type": F.lit('"field"'), "scopeId": _text("scope_id"), "tableName": _text("table_name"), "rowId": _text("row_id"), "field": _text("field"), "value": F.coalesce("value_json", F.lit("null")), "hlc": _text("hlc"), "serverSeq": F.col("server_seq").cast("string"), "txnId": _text("txn_id")})
    return fields.select(*([by] if by else []), F.lit(1).alias("part"), _key("scope_id", "table_name", "row_id", "field").alias("key"), line.alias("line"))


def row_lines(rows: DataFrame, by: str | None = None) -> DataFrame:
    line = _object({"type": F.lit('"row"'), "scopeId": _text("scope_id"), "tableName": _text("table_name"), "rowId": _text("row_id"), "firstSeenAt": F.col("first_seen_at").cast("string"), "class": _text("class"), "deletedHlc": _text("deleted_hlc"), "registerHlc": _text("register_hlc"), "serverSeq": F.col("server_seq").cast("string")})
    return rows.select(*([by] if by else []), F.lit(2).alias("part"), _key("scope_id", "table_name", "row_id").alias("key"), line.alias("line"))


def header_line(scope: DataFrame, by: str | None = None) -> DataFrame:
    line = _object({"type": F.lit('"header"'), "serverSeq": F.col("server_seq").cast("string"), "epoch": _text("epoch"), "tombstoneFloorSeq": F.col("tombstone_floor_seq").cast("string"), "schemaHash": _text("schema_hash")})
    return scope.select(*([by] if by else []), F.lit(0).alias("part"), F.encode(F.lit(""), "UTF-16BE").alias("key"), line.alias("line"))


def body_lines(scope: DataFrame, fields: DataFrame, rows: DataFrame, by: str | None = None) -> DataFrame:
    """``part, key, line``: a snapshot's lines with their places: header, fields, rows, each by key in code-unit order.

    With ``by``, a column of all three, the lines of many bodies, each with that column.
    """
    return header_line(scope, by).unionByName(field_lines(fields, by)).unionByName(row_lines(rows, by))


def to_ndjson(scope: DataFrame, fields: DataFrame, rows: DataFrame) -> DataFrame:
    """One scope's snapshot as ``line``, in the order of its body."""
    return body_lines(scope, fields, rows).orderBy("part", "key").select("line")


def write_ndjson(lines: DataFrame, path: str) -> None:
    """Range-sorted parts, in the order of their names."""
    lines.write.mode("overwrite").text(path)


def digest(lines: DataFrame, by: str | None = None) -> DataFrame:
    """SHA-256 of the body that ``part, key, line`` make up, each line ended by a newline: per group of ``by``, or of all.

    Equals that of the file that ``write_ndjson`` writes. A digest needs a body's bytes together; a body is one
    scope's snapshot, a device's own data.
    """
    in_order = F.array_sort(F.collect_list(F.struct("part", "key", "line")))
    body = F.concat(F.array_join(F.transform(in_order, lambda x: x["line"]), "\n"), F.lit("\n"))
    grouped = lines.groupBy(by) if by else lines.groupBy()
    return grouped.agg(F.sha2(body, 256).alias("digest"), F.count("*").alias("n_lines"))


def file_digest(spark: SparkSession, path: str) -> str:
    """SHA-256 of a written snapshot's bytes, its parts in the order of their names."""
    found = hashlib.sha256()
    for r in spark.read.format("binaryFile").load(f"{path.rstrip('/')}/part-*").orderBy("path").select("content").toLocalIterator():
        found.update(r.content)
    return found.hexdigest()


_FIELD = "type string, scopeId string, tableName string, rowId string, field string, value string, hlc string, serverSeq long, txnId string"
_ROW = "type string, scopeId string, tableName string, rowId string, firstSeenAt long, class string, deletedHlc string, registerHlc string, serverSeq long"


def from_ndjson(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Scope, fields and rows of a snapshot; raises SnapshotError if a line is none of the three kinds."""
    lines = spark.read.text(path).where("value != ''")
    kind = F.get_json_object("value", "$.type")
    bad = lines.where(~F.coalesce(kind.isin("header", "field", "row"), F.lit(False))).limit(1).collect()
    if bad:
        raise SnapshotError(f"not a snapshot line: {bad[0].value[:80]!r}")
    options = {"mode": "FAILFAST"}
    f = lines.where(kind == "field").select(F.from_json("value", _FIELD, options).alias("x"), F.col("value").alias("raw"))
    # a string value keeps its quotes, so that stored text stays canonical JSON
    shown = F.when(F.col("raw").rlike(r',"value":"'), json_string(F.col("x.value"))).when(F.col("x.value").isNull(), F.lit("null")).otherwise(F.col("x.value"))
    fields = f.select(F.col("x.scopeId").alias("scope_id"), F.col("x.tableName").alias("table_name"), F.col("x.rowId").alias("row_id"), F.col("x.field").alias("field"), shown.alias("value_json"), F.col("x.hlc").alias("hlc"), F.col("x.serverSeq").alias("server_seq"), F.col("x.txnId").alias("txn_id"))
    r = lines.where(kind == "row").select(F.from_json("value", _ROW, options).alias("x"))
    rows = r.select(F.col("x.scopeId").alias("scope_id"), F.col("x.tableName").alias("table_name"), F.col("x.rowId").alias("row_id"), F.col("x.firstSeenAt").alias("first_seen_at"), F.col("x.class").alias("class"), F.col("x.deletedHlc").alias("deleted_hlc"), F.col("x.registerHlc").alias("register_hlc"), F.col("x.serverSeq").alias("server_seq"))
    h = lines.where(kind == "header").select(F.from_json("value", "serverSeq long, epoch string, tombstoneFloorSeq long, schemaHash string", options).alias("x"))
    scope = h.select(F.col("x.serverSeq").alias("server_seq"), F.col("x.epoch").alias("epoch"), F.col("x.tombstoneFloorSeq").alias("tombstone_floor_seq"), F.col("x.schemaHash").alias("schema_hash"))
    return scope, fields, rows


def verify(spark: SparkSession, path: str, expected: str) -> None:
    """Raises SnapshotError if a written snapshot's bytes are not those of the digest."""
    got = file_digest(spark, path)
    if got != expected:
        raise SnapshotError(f"digest {got} is not {expected}")


def rehydrate(fields: DataFrame, rows: DataFrame | None, collection: S.Collection, deleted: bool = False) -> DataFrame:
    """A collection's typed rows from a snapshot's records, deleted rows left out unless asked for."""
    from semilattice.operators.materialize import typed
    from semilattice.operators.resolve import ROW_KEY

    if rows is not None and not deleted:
        fields = fields.join(rows.where("deleted_hlc is not null").select(*ROW_KEY), ROW_KEY, "left_anti")
    return typed(fields, collection)


def insert_script(rows: DataFrame, table: str) -> DataFrame:
    """``statement``: an INSERT for each row, columns in name order, for databases that load scripts."""
    names = sorted(rows.columns)

    def literal(name: str, kind: str):
        c = F.col(name)
        text = F.concat(F.lit("'"), F.replace(c.cast("string"), F.lit("'"), F.lit("''")), F.lit("'"))
        number = F.when(c.isNotNull(), number_json(c)) if kind in ("double", "float") else c.cast("string")
        return F.coalesce(text if kind == "string" else c.cast("int").cast("string") if kind == "boolean" else number, F.lit(sql_literal(None)))

    head = f"INSERT INTO {quote_name(table)} ({', '.join(map(quote_name, names))}) VALUES ("
    kinds = dict(rows.dtypes)
    return rows.select(F.concat(F.lit(head), F.concat_ws(", ", *(literal(n, kinds[n]) for n in names)), F.lit(");")).alias("statement"))
