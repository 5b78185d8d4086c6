"""``python -m semilattice hash|ddl|server-ddl|doctor|lint|generate|rehydrate|set-schema-hash`` on schemas in JSON."""

from __future__ import annotations

import argparse
import sys

from semilattice.functions.wire import sql_literal
from semilattice.plans import schema as S


def rehydrate(schema: S.Schema, path: str, out: str, script: bool) -> None:
    """Writes every collection of a snapshot below ``out``: a parquet table each, or a script each."""
    from pyspark.sql import SparkSession

    from semilattice.sources import snapshot

    spark = SparkSession.builder.getOrCreate()
    _, fields, rows = snapshot.from_ndjson(spark, path)
    for c in schema.collections:
        typed = snapshot.rehydrate(fields, rows, c).drop("null_fields")
        if script:
            snapshot.insert_script(typed, c.name).write.mode("overwrite").text(f"{out}/{c.name}")
        else:
            typed.write.mode("overwrite").parquet(f"{out}/{c.name}")


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="semilattice")
    sub = p.add_subparsers(dest="cmd", required=True)
    for name, about in (("hash", "the schema's hash"), ("ddl", "tables of a device"), ("server-ddl", "tables of the relay and typed tables in a catalog"), ("doctor", "check a schema")):
        sub.add_parser(name, help=about).add_argument("schema")
    sub.add_parser("generate", help="a Python module with the collections' row types").add_argument("schema")
    again = sub.add_parser("rehydrate", help="typed tables from a snapshot")
    for name in ("schema", "snapshot", "out"):
        again.add_argument(name)
    again.add_argument("--script", action="store_true", help="INSERT statements instead of tables")
    fix = sub.add_parser("set-schema-hash", help="the statement that sets a scope's schema")
    for name in ("schema", "scope"):
        fix.add_argument(name)
    lint = sub.add_parser("lint", help="what a newer schema takes away")
    lint.add_argument("old")
    lint.add_argument("new")
    a = p.parse_args(args)
    try:
        if a.cmd == "lint":
            issues = S.lint_evolution(S.load(a.old), S.load(a.new))
            for code, place in issues:
                print(code, place)
            return int(bool(issues))
        schema = S.load(a.schema)
    except (S.SchemaError, KeyError, TypeError, ValueError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 2
    if a.cmd == "hash":
        print(schema.hash)
    elif a.cmd == "ddl":
        print(S.client_ddl(schema))
    elif a.cmd == "server-ddl":
        for name, cols in (("fields", S.FIELDS), ("rows", S.ROWS), ("scope_state", S.SCOPES), ("devices", S.DEVICES)):
            print(f"CREATE TABLE IF NOT EXISTS `{name}` ({cols}) USING parquet PARTITIONED BY (scope_id);")
        print(S.spark_ddl(schema))
    elif a.cmd == "generate":
        print(S.python_module(schema))
    elif a.cmd == "set-schema-hash":
        print(f"UPDATE scope_state SET schema_hash = {sql_literal(schema.hash)}, schema_version = {schema.version} WHERE scope_id = {sql_literal(a.scope)};")
    elif a.cmd == "rehydrate":
        rehydrate(schema, a.snapshot, a.out, a.script)
    else:
        print(f"ok: {len(schema.collections)} collections, version {schema.version}, hash {schema.hash}")
    return 0


if __name__ == "__main__":
    sys.exit(main())
