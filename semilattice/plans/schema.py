"""Declared collections: fields with types and merge rules, relations, names, hashes, and how schemas evolve."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, replace
from pathlib import Path

from pyspark.sql import types as T

from semilattice.functions.wire import DEFAULTS, Wire, fold_name, wire_hash

# What a field can be, how it merges, the fields every collection starts with, reserved names.
TYPES = ("string", "number", "boolean", "date", "enum", "json")
MERGES = ("lww", "diff3", "fracIndex", "immutable")
KINDS = ("collection", "eventLog")
BASE_FIELDS = ("id", "scope_id", "created")
RESERVED = ("outbox", "outbox_quarantine", "tombstones", "sync_state")
PREFIX = "_sync_"

_SPARK = {"string": T.StringType(), "date": T.StringType(), "enum": T.StringType(), "json": T.StringType(), "number": T.DoubleType(), "boolean": T.BooleanType()}


class SchemaError(ValueError):
    pass


@dataclass(frozen=True)
class Field:
    name: str
    type: str = "string"
    merge: str = "lww"
    nullable: bool = False
    values: tuple[str, ...] = ()
    retention_anchor: bool = False
    index: bool = False

    @property
    def default(self) -> Wire:
        return None if self.nullable else self.values[0] if self.type == "enum" else DEFAULTS[self.type]

    def spark(self) -> T.StructField:
        about = {"type": self.type, "merge": self.merge, "values": list(self.values), "anchor": self.retention_anchor}
        return T.StructField(self.name, _SPARK[self.type], True, about)


@dataclass(frozen=True)
class Relation:
    name: str
    kind: str  # hasOne or hasMany
    table: str
    local: str
    foreign: str


@dataclass(frozen=True)
class Collection:
    name: str
    fields: tuple[Field, ...]
    kind: str = "collection"
    relations: tuple[Relation, ...] = ()

    @property
    def all_fields(self) -> tuple[Field, ...]:
        base = (Field("id", merge="immutable"), Field("scope_id", merge="immutable"), Field("created", "date", merge="immutable"))
        return base + self.fields

    @property
    def anchor(self) -> Field | None:
        return next((f for f in self.fields if f.retention_anchor), None)

    def field(self, name: str) -> Field:
        for f in self.all_fields:
            if f.name == name:
                return f
        raise SchemaError(f"{self.name} has no field {name!r}")

    def spark(self) -> T.StructType:
        return T.StructType([f.spark() for f in self.all_fields])


@dataclass(frozen=True)
class Schema:
    collections: tuple[Collection, ...]
    version: int = 1
    _by: dict[str, Collection] = field(default_factory=dict, compare=False, repr=False)

    def __post_init__(self) -> None:
        self._by.update({c.name: c for c in self.collections})
        check(self)

    def __getitem__(self, name: str) -> Collection:
        try:
            return self._by[name]
        except KeyError:
            raise SchemaError(f"no collection {name!r}") from None

    @property
    def hash(self) -> str:
        """SHA-256 of what matters to merging: names, kinds, fields, relations and the version; not indexes."""
        return wire_hash(
            {
                "version": self.version,
                "collections": {
                    c.name: {
                        "kind": c.kind,
                        "fields": {f.name: {"type": f.type, "merge": f.merge, "nullable": f.nullable, "values": list(f.values), "retentionAnchor": f.retention_anchor} for f in c.all_fields},
                        "relationships": {r.name: [r.kind, r.table, r.local, r.foreign] for r in c.relations},
                    }
                    for c in self.collections
                },
            }
        )

    def with_index(self, collection: str, name: str) -> Schema:
        def one(c: Collection) -> Collection:
            return replace(c, fields=tuple(replace(f, index=f.index or f.name == name) for f in c.fields)) if c.name == collection else c

        return Schema(tuple(map(one, self.collections)), self.version)


def _check_names(what: str, names: list[str]) -> None:
    seen: dict[str, str] = {}
    for n in names:
        if not n or any(ord(c) < 32 or ord(c) == 127 for c in n):
            raise SchemaError(f"{what} {n!r}: empty or with control characters")
        if fold_name(n).startswith(PREFIX):
            raise SchemaError(f"{what} {n!r}: names with {PREFIX} are reserved")
        if other := seen.get(fold_name(n)):
            raise SchemaError(f"{what} {n!r} and {other!r} differ by case alone")
        seen[fold_name(n)] = n


def check(schema: Schema) -> None:
    """Raises SchemaError for names that clash, unknown types or rules, and relations to what is not there."""
    indexes = [f"{c.name}_{f.name}_idx" for c in schema.collections for f in c.fields if f.index]
    _check_names("table", [c.name for c in schema.collections] + indexes)
    for c in schema.collections:
        if fold_name(c.name) in RESERVED:
            raise SchemaError(f"table {c.name!r} is reserved")
        if c.kind not in KINDS:
            raise SchemaError(f"{c.name}: unknown kind {c.kind!r}")
        _check_names(f"field of {c.name}", [f.name for f in c.all_fields])
        for f in c.fields:
            if f.type not in TYPES or f.merge not in MERGES:
                raise SchemaError(f"{c.name}.{f.name}: unknown type {f.type!r} or merge {f.merge!r}")
            if (f.type == "enum") != bool(f.values):
                raise SchemaError(f"{c.name}.{f.name}: an enum, and nothing else, lists its values")
            if f.merge in ("diff3", "fracIndex") and f.type != "string":
                raise SchemaError(f"{c.name}.{f.name}: {f.merge} merges strings")
        for r in c.relations:
            if r.kind not in ("hasOne", "hasMany") or r.table not in schema._by:
                raise SchemaError(f"{c.name}.{r.name}: unknown kind {r.kind!r} or table {r.table!r}")
            c.field(r.local)
            schema[r.table].field(r.foreign)


def lint_evolution(old: Schema, new: Schema) -> list[tuple[str, str]]:
    """What a new schema takes away or changes: (code, place), in order of place. Additions are no issue."""
    found: list[tuple[str, str]] = []
    if new.version < old.version:
        found.append(("version_lowered", str(new.version)))
    for c in old.collections:
        if c.name not in new._by:
            found.append(("collection_removed", c.name))
            continue
        now = new[c.name]
        if now.kind != c.kind:
            found.append(("kind_changed", c.name))
        fields = {f.name: f for f in now.fields}
        for f in c.fields:
            place = f"{c.name}.{f.name}"
            if f.name not in fields:
                found.append(("field_removed", place))
            elif fields[f.name].type != f.type or not set(f.values) <= set(fields[f.name].values):
                found.append(("type_changed", place))
            elif fields[f.name].merge != f.merge:
                found.append(("merge_changed", place))
    return sorted(found, key=lambda x: (x[1], x[0]))


def load(path: str | Path) -> Schema:
    """A schema from JSON: {"version", "collections": [{"name", "kind", "fields": [...], "relations": [...]}]}."""
    raw = json.loads(Path(path).read_text())

    def known(cls, row: dict):
        extra = set(row) - set(cls.__dataclass_fields__)
        if extra:
            raise SchemaError(f"unknown properties {sorted(extra)}")
        return cls(**{k: tuple(v) if isinstance(v, list) else v for k, v in row.items()})

    def collection(row: dict) -> Collection:
        return known(Collection, row | {"fields": [known(Field, f) for f in row.get("fields", [])], "relations": [known(Relation, r) for r in row.get("relations", [])]})

    return Schema(tuple(map(collection, raw["collections"])), int(raw.get("version", 1)))


_SQL = {"string": "TEXT", "date": "TEXT", "json": "TEXT", "enum": "TEXT", "number": "REAL", "boolean": "INTEGER"}


def client_ddl(schema: Schema) -> str:
    """CREATE TABLE statements for the typed tables of a device, with enum checks and declared indexes."""
    from semilattice.functions.wire import quote_name, sql_literal

    out = []
    for c in schema.collections:
        cols = []
        for f in c.all_fields:
            null = "" if f.nullable or f.name not in BASE_FIELDS else " NOT NULL"
            allowed = f" CHECK ({quote_name(f.name)} IN ({', '.join(map(sql_literal, f.values))}))" if f.type == "enum" else ""
            cols.append(f"{quote_name(f.name)} {_SQL[f.type]}{null}{allowed}")
        cols += [f"{quote_name(PREFIX + n)} TEXT" for n in ("field_hlc", "base", "null_fields")] + [f"{quote_name(PREFIX + 'rev')} INTEGER"]
        out.append(f"CREATE TABLE IF NOT EXISTS {quote_name(c.name)} ({', '.join(cols)}, PRIMARY KEY (scope_id, id));")
        out += [f"CREATE INDEX IF NOT EXISTS {quote_name(f'{c.name}_{f.name}_idx')} ON {quote_name(c.name)} (scope_id, {quote_name(f.name)});" for f in c.fields if f.index]
    return "\n".join(out)


def spark_ddl(schema: Schema) -> str:
    """CREATE TABLE statements for a Spark catalog, partitioned by scope."""
    return "\n".join(f"CREATE TABLE IF NOT EXISTS `{c.name}` ({', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in c.spark())}) USING parquet PARTITIONED BY (scope_id);" for c in schema.collections)


#: Columns of the relay's and the devices' tables.
def python_module(schema: Schema) -> str:
    """A module with a typed dictionary for each collection's rows and its Spark type as DDL."""
    kinds = {"number": "float", "boolean": "bool", "json": "object"}
    out = ["from typing import TypedDict", "", f"SCHEMA_HASH = {schema.hash!r}", f"SCHEMA_VERSION = {schema.version}"]
    for c in schema.collections:
        name = "".join(p.capitalize() for p in c.name.split("_"))
        out += ["", "", f"class {name}(TypedDict, total=False):"]
        out += [f"    {f.name}: {kinds.get(f.type, 'str')}{' | None' if f.nullable else ''}" for f in c.all_fields]
        out += ["", "", f"{c.name.upper()}_DDL = {', '.join(f'{f.name} {f.spark().dataType.simpleString()}' for f in c.all_fields)!r}"]
    return "\n".join(out) + "\n"


OPS = "pos long, scope_id string, table_name string, row_id string, kind string, field string, value_json string, hlc string, txn_id string, base_hash string, batch_id long"
FIELDS = "scope_id string, table_name string, row_id string, field string, value_json string, hlc string, server_seq long, txn_id string"
ROWS = "scope_id string, table_name string, row_id string, first_seen_at long, class string, deleted_hlc string, register_hlc string, server_seq long"
SCOPES = "scope_id string, server_seq long, tombstone_floor_seq long, schema_hash string, schema_version int, epoch string"
DEVICES = "scope_id string, device_id string, last_seen long"
