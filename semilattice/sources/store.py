"""A store of the relay's tables in a directory of versions: parquet files and one pointer that is moved last."""

from __future__ import annotations

import json
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from semilattice.functions.wire import canonical
from semilattice.operators.device import Device, Row
from semilattice.plans import schema as S

TABLES = {"fields": S.FIELDS, "rows": S.ROWS, "scope_state": S.SCOPES, "devices": S.DEVICES}


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares, from ``spark.checkpoint.dir``; on one machine, where that is unset, one of the session's own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = f"/tmp/checkpoints/{spark.sparkContext.applicationId}"
    return found.rstrip("/")


class Store:
    """All tables of a version appear together or not at all; a failed write leaves the version before.

    Tables are cut into buckets by a hash of the scope, and a version names the directory of each bucket, so that a
    commit writes the buckets of the scopes that it touches and keeps the others, and a scope's load reads its own.
    What no version names any more goes with the commit after the one that replaced it, so that readers of the last
    version finish. One writer at a time; any number of readers.
    """

    def __init__(self, spark: SparkSession, root: str, tables: dict[str, str] | None = None, buckets: int = 16) -> None:
        self.spark, self.root, self.tables, self.buckets = spark, root.rstrip("/"), tables or TABLES, buckets
        self._lock = threading.RLock()

    def _fs(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _pointer(self, name: str = "CURRENT") -> dict[str, str]:
        """Directories by table and bucket."""
        p, fs = self._fs(f"{self.root}/{name}")
        if not fs.exists(p):
            return {}
        lines = [r.value for r in self.spark.read.text(f"{self.root}/{name}").collect()]
        return dict(x.split("=", 1) for x in lines if x)

    def _read(self, name: str, places: list[str]) -> DataFrame:
        return self.spark.read.schema(self.tables[name]).parquet(*(f"{self.root}/{p}" for p in places)) if places else self.spark.createDataFrame([], self.tables[name])

    def _bucket_of(self, column: str = "scope_id"):
        return F.pmod(F.xxhash64(column), F.lit(self.buckets)).cast("int")

    def _buckets(self, scopes: DataFrame) -> list[int]:
        return sorted(r.b for r in scopes.select(self._bucket_of().alias("b")).distinct().collect())

    def table(self, name: str) -> DataFrame:
        return self._read(name, [v for k, v in sorted(self._pointer().items()) if k.split("/")[0] == name])

    def scope(self, scope_id: str) -> dict[str, DataFrame]:
        """A scope's records in every table."""
        own = self.spark.createDataFrame([(scope_id,)], "scope_id string")
        b, now = self._buckets(own)[0], self._pointer()
        return {n: self._read(n, [now[k]] if (k := f"{n}/{b}") in now else []).where(F.col("scope_id") == F.lit(scope_id)) for n in self.tables}

    def commit(self, **tables: DataFrame) -> None:
        """Replaces whole tables."""
        with self._lock:
            now = self._pointer()
            for name, df in tables.items():
                now = {k: v for k, v in now.items() if k.split("/")[0] != name} | self._write(name, df)
            self._publish(now)

    def commit_scopes(self, scopes: list[str], **tables: DataFrame) -> None:
        """Replaces the records of some scopes in the given tables; a scope without rows is emptied."""
        with self._lock:
            touched = self.spark.createDataFrame([(s,) for s in scopes], "scope_id string")
            buckets, now = self._buckets(touched), self._pointer()
            for name, df in tables.items():
                keys = [f"{name}/{b}" for b in buckets]
                kept = self._read(name, [now[k] for k in keys if k in now]).join(F.broadcast(touched), "scope_id", "left_anti")
                own = df.join(F.broadcast(touched), "scope_id", "left_semi")
                made = self._write(name, kept.unionByName(own.select(*kept.columns)))
                now = {k: v for k, v in now.items() if k not in keys} | made
            self._publish(now)

    def _write(self, name: str, df: DataFrame) -> dict[str, str]:
        """Writes rows by bucket; the directories of the buckets that have any."""
        at = f"{name}-{uuid.uuid4().hex}"
        bucket = "_bucket"
        rows = df.select(*(c.split()[0] for c in self.tables[name].split(", "))).withColumn(bucket, self._bucket_of())
        rows.repartition(bucket).write.partitionBy(bucket).parquet(f"{self.root}/{at}")
        p, fs = self._fs(f"{self.root}/{at}")
        found = [f.getPath().getName() for f in fs.listStatus(p) if f.isDirectory()]
        return {f"{name}/{d.split('=')[1]}": f"{at}/{d}" for d in found if "=" in d}

    def _publish(self, now: dict[str, str]) -> None:
        """Moves the pointer, then removes what neither this version nor the one before it names."""
        before, older = self._pointer(), self._pointer("PREVIOUS")
        for name, version in (("PREVIOUS", before), ("CURRENT", now)):
            text = "\n".join(f"{k}={v}" for k, v in sorted(version.items())) + "\n"
            tmp, fs = self._fs(f"{self.root}/{name}.{uuid.uuid4().hex}")
            out = fs.create(tmp, True)
            out.write(bytearray(text.encode()))
            out.close()
            target, _ = self._fs(f"{self.root}/{name}")
            jvm = self.spark.sparkContext._jvm.org.apache.hadoop.fs
            context = jvm.FileContext.getFileContext(target.toUri() if target.toUri().getScheme() else fs.getUri())
            renames = self.spark.sparkContext._gateway.new_array(jvm.Options.Rename, 1)
            renames[0] = jvm.Options.Rename.OVERWRITE
            context.rename(tmp, target, renames)
        for place in set(older.values()) - set(before.values()) - set(now.values()):
            p, fs = self._fs(f"{self.root}/{place}")
            fs.delete(p, True)

    def upsert(self, name: str, changed: DataFrame, keys: list[str], removed: DataFrame | None = None) -> DataFrame:
        """The table with changed rows in place of those of equal keys, and without removed keys; commit it to keep it."""
        kept = self.table(name).join(changed.select(*keys), keys, "left_anti")
        if removed is not None:
            kept = kept.join(removed.select(*keys), keys, "left_anti")
        return kept.unionByName(changed.select(*kept.columns))


DEVICE_TABLES = {
    "local_rows": "scope_id string, table_name string, row_id string, fields string, stamps string, bases string, first_seen_at long, rev long, is_dirty boolean",
    "tombstones": "scope_id string, table_name string, row_id string, hlc string, first_seen_at long, fields string, bases string",
    "outbox": "scope_id string, seq long, table_name string, row_id string, kind string, field string, value_json string, hlc string, txn_id string, base_hash string",
    "quarantine": "scope_id string, seq long, table_name string, row_id string, kind string, field string, value_json string, hlc string, txn_id string, base_hash string, reason string, rejected_at long, server_value string, row_identity long",
    "sync_state": "scope_id string, last_server_seq long, hlc_last string, resync_required boolean, server_epoch string, txn_count long",
}


class DeviceStore:
    """A device's state on disk. A save writes the rows that changed since the last one, the whole outbox and
    quarantine, and the sync state, all in one version."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.store = Store(spark, root, DEVICE_TABLES, buckets=1)
        self.spark = spark

    def _frame(self, name: str, rows: list[dict]) -> DataFrame:
        columns = [c.split()[0] for c in DEVICE_TABLES[name].split(", ")]
        return self.spark.createDataFrame([tuple(r.get(c) for c in columns) for r in rows], DEVICE_TABLES[name])

    def save(self, device: Device) -> None:
        s, key = device.scope_id, ["scope_id", "table_name", "row_id"]
        name = lambda k: {"scope_id": s, "table_name": k[0], "row_id": k[1]}
        touched = self.spark.createDataFrame([(s, *k) for k in sorted(device.touched)], "scope_id string, table_name string, row_id string")
        rows = [name(k) | {"fields": canonical(r.fields), "stamps": canonical(r.stamps), "bases": canonical(r.bases), "first_seen_at": r.first_seen_at, "rev": r.rev, "is_dirty": device.is_dirty(*k)} for k in sorted(device.touched) if (r := device.rows.get(k))]
        gone = [name(k) | {"hlc": t["hlc"], "first_seen_at": t["first_seen_at"], "fields": canonical(t["fields"]), "bases": canonical(t["bases"])} for k in sorted(device.touched) if (t := device.tombstones.get(k))]
        kept = {n: self.store.table(n).join(F.broadcast(touched), key, "left_anti").unionByName(self._frame(n, made)) for n, made in (("local_rows", rows), ("tombstones", gone))}
        box = {n: self._frame(n, [o | {"seq": i} | ({"server_value": canonical(o["server_value"])} if n == "quarantine" else {}) for i, o in enumerate(ops)]) for n, ops in (("outbox", device.outbox), ("quarantine", device.quarantined))}
        state = self._frame("sync_state", [{"scope_id": s, "last_server_seq": device.cursor, "hlc_last": device.clock.highest(), "resync_required": device.resync, "server_epoch": device.epoch, "txn_count": device._txn}])
        self.store.commit(**kept, **box, sync_state=state)
        device.touched.clear()

    def hydrate(self, device: Device) -> bool:
        """Fills a new device from what was saved, its clock above every stamp it has seen; False if nothing was."""
        parts = {n: t.collect() for n, t in self.store.scope(device.scope_id).items()}
        if not parts["sync_state"]:
            return False
        for r in parts["local_rows"]:
            device.rows[r.table_name, r.row_id] = Row(json.loads(r.fields), json.loads(r.stamps), json.loads(r.bases), r.first_seen_at, r.rev)
        for r in parts["tombstones"]:
            device.tombstones[r.table_name, r.row_id] = {"hlc": r.hlc, "first_seen_at": r.first_seen_at, "fields": json.loads(r.fields), "bases": json.loads(r.bases)}
        for n, into in (("outbox", device.outbox), ("quarantine", device.quarantined)):
            for r in sorted(parts[n], key=lambda r: r.seq):
                op = {k: v for k, v in r.asDict().items() if k != "seq"}
                into.append(op | ({"server_value": json.loads(op["server_value"])} if n == "quarantine" else {}))
        state = parts["sync_state"][0]
        device.cursor, device.resync, device.epoch, device._txn = state.last_server_seq, state.resync_required, state.server_epoch, state.txn_count
        stamps = [state.hlc_last, *(s for r in device.rows.values() for s in r.stamps.values()), *(o["hlc"] for o in [*device.outbox, *device.quarantined])]
        device.clock.acknowledge(max(s for s in stamps if s))
        return True

    def tombstones(self, scope_id: str) -> DataFrame:
        """A scope's deleted rows."""
        return self.store.scope(scope_id)["tombstones"]
