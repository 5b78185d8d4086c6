"""The library's queries over the driver's tables, each with DuckDB SQL where that can express it."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from semilattice.functions import hlc, merge, wire
from semilattice.operators import cdc, device, materialize, query, relations, resolve, retention
from semilattice.plans import schema as S
from semilattice.sources import snapshot
from semilattice.sources.oplog import LIFE_SQL, OPS_SQL, ops, table
from semilattice.sources.store import shared_dir
from semilattice.streaming import relay

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(sql: str | None = None):
    """Registers a query under its function's name, with its SQL if there is any."""

    def add(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return add


#: A point in time after all events, in milliseconds: 2024-02-15.
NOW_MS = 1_707_955_200_000

LWW_SQL = f"WITH {OPS_SQL}, won AS (SELECT * EXCLUDE (n) FROM (SELECT *, row_number() OVER (PARTITION BY scope_id, table_name, row_id, field ORDER BY hlc DESC, pos) AS n FROM ops) WHERE n = 1)"
REG_SQL = f"WITH {LIFE_SQL}, reg AS (SELECT scope_id, table_name, row_id, max(hlc) AS register_hlc, CASE WHEN arg_max(kind, hlc) = 'delete' THEN max(hlc) END AS deleted_hlc FROM ops WHERE kind IN ('delete', 'restore') GROUP BY ALL), seen AS (SELECT scope_id, table_name, row_id, min(pos) AS first_pos, max(hlc) AS last_hlc FROM ops GROUP BY ALL), all_rows AS (SELECT seen.*, register_hlc, deleted_hlc FROM seen LEFT JOIN reg USING (scope_id, table_name, row_id))"
VALUE_SQL = "CASE WHEN value = floor(value) THEN CAST(CAST(value AS BIGINT) AS VARCHAR) ELSE CAST(value AS VARCHAR) END"
WALL_SQL = "(epoch_us(ts) // 1000)"


# -- clocks and values


@register(f"WITH {OPS_SQL} SELECT pos, hlc FROM ops")
def hlc_encode(spark, sf):
    return ops(spark, sf).select("pos", "hlc")


@register(f"SELECT event_id AS pos, {WALL_SQL} AS wall_ms, event_id AS counter, 'dev' || CAST(event_id % 3 AS VARCHAR) AS device FROM events")
def hlc_parse(spark, sf):
    h = F.col("hlc")
    return ops(spark, sf).select("pos", hlc.wall(h).alias("wall_ms"), hlc.counter(h).alias("counter"), hlc.device(h).alias("device"))


@register("SELECT event_id AS pos, event_id % 5 <> 0 AS valid FROM events")
def hlc_valid(spark, sf):
    broken = F.when(F.col("pos") % 10 == 0, F.substring("hlc", 1, 20)).when(F.col("pos") % 5 == 0, F.upper("hlc")).otherwise(F.col("hlc"))
    return ops(spark, sf).select("pos", hlc.is_stamp(broken).alias("valid"))


@register(f"WITH {OPS_SQL}, p AS (SELECT pos, hlc, lag(hlc) OVER (PARTITION BY scope_id ORDER BY row_id, pos) AS q FROM ops) SELECT pos, CASE WHEN q IS NULL THEN 1 WHEN hlc < q THEN -1 WHEN hlc > q THEN 1 ELSE 0 END AS sign FROM p")
def hlc_compare(spark, sf):
    before = F.lag("hlc").over(W.partitionBy("scope_id").orderBy("row_id", "pos"))
    return ops(spark, sf).select("pos", hlc.compare(F.col("hlc"), before).alias("sign"))


@register(f"WITH {OPS_SQL} SELECT scope_id, max(hlc) AS highest FROM ops GROUP BY 1")
def highest_stamp(spark, sf):
    return resolve.highest_stamps(ops(spark, sf))


@register()
def clock_emission(spark, sf):
    log = ops(spark, sf).select(hlc.device(F.col("hlc")).alias("device"), "pos", hlc.wall(F.col("hlc")).alias("ms"))
    return resolve.emit_stamps(log.withColumn("ms", F.expr("ms div 60000 * 60000")), "device", "ms", "pos")


def _json_sql(text: str) -> str:
    """SQL for a text column as a JSON string."""
    out = f"replace(replace({text}, chr(92), repeat(chr(92), 2)), chr(34), chr(92) || chr(34))"
    for c in range(1, 0x20):
        out = f"replace({out}, chr({c}), '{json.dumps(chr(c))[1:-1]}')"
    return f"chr(34) || {out} || chr(34)"


@register(f"SELECT doc_id, sha256({_json_sql('text')}) AS hash FROM documents")
def wire_hash_text(spark, sf):
    return table(spark, sf, "documents").select("doc_id", wire.hash_canonical(wire.json_string(F.col("text"))).alias("hash"))


@register(f"SELECT p_partkey, sha256({_json_sql('p_name || chr(CAST(p_partkey % 31 + 1 AS INT)) || chr(34) || chr(92)')}) AS hash FROM part")
def wire_hash_controls(spark, sf):
    """Texts with every control character, quotes and backslashes."""
    text = F.concat("p_name", F.char(F.col("p_partkey") % 31 + 1), F.lit(chr(34) + chr(92)))
    return table(spark, sf, "part").select("p_partkey", wire.hash_canonical(wire.json_string(text)).alias("hash"))


@register("SELECT event_id, sha256('{\"event\":' || CAST(event_id AS VARCHAR) || ',\"user\":' || CAST(user_id AS VARCHAR) || '}') AS hash FROM events")
def wire_hash_object(spark, sf):
    text = F.concat(F.lit('{"event":'), F.col("event_id").cast("string"), F.lit(',"user":'), F.col("user_id").cast("string"), F.lit("}"))
    return table(spark, sf, "events").select("event_id", wire.hash_canonical(text).alias("hash"))


@register()
def canonical_json(spark, sf):
    return table(spark, sf, "events").select("event_id", wire.canonical_json("props").alias("canonical"))


@register(f"SELECT event_id, {VALUE_SQL} AS text FROM events")
def number_json(spark, sf):
    return table(spark, sf, "events").select("event_id", wire.number_json(F.col("value")).alias("text"))


@register("""WITH d AS (SELECT event_id, rtrim(CAST(event_id + 1 AS VARCHAR), '0') AS d, length(CAST(event_id + 1 AS VARCHAR)) + event_id % 61 - 30 AS n FROM events), k AS (SELECT *, length(d) AS k FROM d)
SELECT event_id, '-' || CASE WHEN n >= k AND n <= 21 THEN rpad(d, CAST(n AS INT), '0') WHEN n > 0 AND n <= 21 THEN d[:n] || '.' || d[n + 1:] WHEN n > -6 AND n <= 0 THEN '0.' || repeat('0', -n) || d ELSE d[1] || CASE WHEN k > 1 THEN '.' || d[2:] ELSE '' END || CASE WHEN n > 0 THEN 'e+' ELSE 'e-' END || CAST(abs(n - 1) AS VARCHAR) END AS text FROM k""")
def number_magnitudes(spark, sf):
    """Numbers from 1e-30 to 1e35, by the rules of the text itself in the SQL."""
    x = F.concat(F.lit("-"), (F.col("event_id") + 1).cast("string"), F.lit("e"), (F.col("event_id") % 61 - 30).cast("string")).cast("double")
    return table(spark, sf, "events").select("event_id", wire.number_json(x).alias("text"))


@register("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_fields(spark, sf):
    return table(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@register("SELECT o_orderkey, epoch_us(o_orderdate) // 1000 AS ms FROM orders")
def epoch_ms(spark, sf):
    iso = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")
    return table(spark, sf, "orders").select("o_orderkey", wire.epoch_ms(iso).alias("ms"))


@register("SELECT c_custkey, CASE WHEN c_acctbal >= 0 THEN c_acctbal ELSE 30.0 END AS days FROM customer")
def auto_delete_days(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", wire.auto_delete_days(F.col("c_acctbal"), F.lit(30.0)).alias("days"))


@register("SELECT n_nationkey, CAST(length(n_name) AS VARCHAR) || ':' || n_name || ':' || CAST(n_regionkey AS VARCHAR) AS key FROM nation")
def database_keys(spark, sf):
    return table(spark, sf, "nation").select("n_nationkey", wire.database_key(F.col("n_regionkey").cast("string"), F.col("n_name")).alias("key"))


def _sides(spark, sf):
    c = table(spark, sf, "conversations")
    base = F.col("text")
    # each side edits lines of the text in its own way
    edit = lambda word, n: F.array_join(F.transform(F.split(base, "\n", -1), lambda x, i: F.when(i % 3 == F.col("turn") % n, F.concat(x, F.lit(word))).otherwise(x)), "\n")
    local = edit(" (local)", 2)
    remote = F.when(F.col("conv_id") % 4 == 0, F.concat(base, F.lit("\nnew line"))).otherwise(edit(" (remote)", 3))
    return c.select("conv_id", "turn", base.alias("base"), local.alias("local"), remote.alias("remote"))


_SIDES_SQL = """WITH l AS (SELECT conv_id, turn, text AS base, string_split(text, chr(10)) AS ls FROM conversations),
s AS (SELECT conv_id, turn, base, ls, list_transform(ls, lambda x, i: CASE WHEN (i - 1) % 3 = turn % 2 THEN x || ' (local)' ELSE x END) AS ll, CASE WHEN conv_id % 4 = 0 THEN list_append(ls, 'new line') ELSE list_transform(ls, lambda x, i: CASE WHEN (i - 1) % 3 = turn % 3 THEN x || ' (remote)' ELSE x END) END AS rl FROM l),
t AS (SELECT conv_id, turn, base, array_to_string(ll, chr(10)) AS local, array_to_string(rl, chr(10)) AS remote, ls, ll, rl FROM s),
m AS (SELECT conv_id, turn, CASE WHEN local = remote OR base = remote THEN local WHEN base = local THEN remote WHEN len(ls) = len(ll) AND len(ls) = len(rl) THEN array_to_string(list_transform(ls, lambda x, i: CASE WHEN ll[i] = rl[i] OR x = rl[i] THEN ll[i] WHEN x = ll[i] THEN rl[i] ELSE '<<<<<<< LOCAL' || chr(10) || ll[i] || chr(10) || '=======' || chr(10) || rl[i] || chr(10) || '>>>>>>> REMOTE' END), chr(10)) ELSE '<<<<<<< LOCAL' || chr(10) || local || chr(10) || '=======' || chr(10) || remote || chr(10) || '>>>>>>> REMOTE' END AS merged FROM t)"""


@register(_SIDES_SQL + " SELECT conv_id, turn, merged, contains(merged, '<<<<<<< LOCAL') AND contains(merged, '>>>>>>> REMOTE') AS conflicted FROM m")
def diff3_merge(spark, sf):
    merged = _sides(spark, sf).select("conv_id", "turn", merge.merge3(F.col("base"), F.col("local"), F.col("remote")).alias("merged"))
    return merged.withColumn("conflicted", merge.has_conflict(F.col("merged")))


@register(_SIDES_SQL + " SELECT conv_id, count(*) AS n FROM m WHERE contains(merged, '<<<<<<< LOCAL') AND contains(merged, '>>>>>>> REMOTE') GROUP BY 1")
def conflict_scan(spark, sf):
    merged = _sides(spark, sf).select("conv_id", merge.merge3(F.col("base"), F.col("local"), F.col("remote")).alias("merged"))
    fields = merged.select("conv_id", F.explode(F.create_map(F.lit("note"), F.col("merged"))).alias("field", "value"))
    return fields.where(merge.has_conflict(F.col("value"))).groupBy("conv_id").agg(F.count("*").alias("n"))


@register()
def rank_between(spark, sf):
    w = W.partitionBy("p_brand").orderBy("p_partkey")
    ranked = table(spark, sf, "part").select("p_partkey", "p_brand", F.lpad(F.translate(F.conv(F.row_number().over(w).cast("string"), 10, 9), "012345678", "BDFHJLNPR"), 5, "B").alias("core"))
    ranked = ranked.withColumn("rank", F.concat("core", F.lit(":dev")))
    return ranked.select("p_partkey", "rank", merge.rank_between_udf("rank", F.lead("rank").over(w), F.lit("dev")).alias("after"))


# -- resolution


@register(LWW_SQL + " SELECT scope_id, table_name, row_id, field, value, hlc, txn_id, pos FROM won")
def lww_fields(spark, sf):
    return resolve.latest_fields(ops(spark, sf), "value")


@register(LWW_SQL + " SELECT scope_id, table_name, row_id, field, value, hlc, txn_id, pos FROM won")
def lww_after_redelivery(spark, sf):
    """Duplicates in another order change nothing."""
    log = ops(spark, sf)
    again = log.where("pos % 3 = 0").withColumn("pos", F.col("pos") + 10_000_000)
    return resolve.latest_fields(again.unionByName(log), "value")


@register(f"WITH {OPS_SQL} SELECT pos, scope_id, table_name, row_id, field, kind, hlc, txn_id, value FROM ops")
def redelivery_dedup(spark, sf):
    log = ops(spark, sf)
    return resolve.deduplicate(log.unionByName(log.where("pos % 3 = 0").withColumn("pos", F.col("pos") + 10_000_000)))


@register(REG_SQL + " SELECT * FROM reg")
def row_registers(spark, sf):
    return resolve.registers(ops(spark, sf, True))


@register(REG_SQL + " SELECT * FROM all_rows WHERE deleted_hlc IS NULL")
def live_rows(spark, sf):
    return resolve.live_rows(ops(spark, sf, True))


@register(f"WITH {OPS_SQL}, w AS (SELECT *, max(hlc) OVER (PARTITION BY scope_id, table_name, row_id, field ORDER BY -pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS winner_hlc FROM ops) SELECT pos, field, hlc, winner_hlc FROM w WHERE hlc <= winner_hlc")
def superseded_writes(spark, sf):
    late = ops(spark, sf).withColumn("pos", -F.col("pos"))  # the log arrives backwards
    return resolve.superseded(late).select((-F.col("pos")).alias("pos"), "field", "hlc", "winner_hlc")


@register(LWW_SQL + " SELECT scope_id, row_id, field, pos, row_number() OVER (PARTITION BY scope_id ORDER BY pos) AS server_seq FROM won")
def server_seq(spark, sf):
    return _records(spark, sf).select("scope_id", "row_id", "field", "pos", "server_seq")


def _records(spark, sf):
    return resolve.with_server_seq(resolve.latest_fields(ops(spark, sf), "value", "value_json"))


_SEQ_SQL = LWW_SQL + ", records AS (SELECT *, row_number() OVER (PARTITION BY scope_id ORDER BY pos) AS server_seq FROM won)"


@register(REG_SQL + ", p AS (SELECT *, row_number() OVER (ORDER BY first_pos) - 1 AS i FROM seen) SELECT scope_id, row_id, first_pos, max(1000 + first_pos // 3 - i) OVER (ORDER BY i) + i AS first_seen_at FROM p")
def first_seen(spark, sf):
    seen = resolve.rows_of(ops(spark, sf, True)).select(*resolve.ROW_KEY, "first_pos")
    return resolve.with_first_seen(seen, F.expr("1000 + first_pos div 3")).select("scope_id", "row_id", "first_pos", "first_seen_at")


@register(f"WITH {LIFE_SQL} SELECT scope_id, txn_id, min(pos) AS first_pos, count(*) AS n_ops, count(*) FILTER (kind = 'set') AS n_sets FROM ops GROUP BY 1, 2")
def transactions(spark, sf):
    return resolve.transactions(ops(spark, sf, True))


@register(f"WITH {LIFE_SQL} SELECT scope_id, txn_id, table_name, row_id, min(pos) AS first_pos FROM ops GROUP BY ALL")
def acknowledged_rows(spark, sf):
    return resolve.acknowledged_rows(ops(spark, sf, True))


@register(f"WITH {OPS_SQL}, c AS (SELECT pos, CASE WHEN scope_id <> '7' AND pos % 50 = 0 THEN 'scope_mismatch' WHEN pos % 10 = 0 THEN 'malformed_op' WHEN pos % 9 = 0 THEN 'base_field_violation' END AS r, hlc FROM ops), k AS (SELECT c.pos, CASE WHEN r IN ('scope_mismatch', 'malformed_op') THEN r WHEN epoch_us(ts) // 1000 > 1705968000000 + 300000 THEN 'clock_skew' ELSE r END AS reason FROM c JOIN events ON event_id = c.pos) SELECT coalesce(reason, 'ok') AS reason, count(*) AS n FROM k GROUP BY 1")
def stateless_validation(spark, sf):
    log = ops(spark, sf).withColumn("hlc", F.when(F.col("pos") % 10 == 0, F.substring("hlc", 2, 99)).otherwise(F.col("hlc")))
    log = log.withColumn("field", F.when(F.col("pos") % 9 == 0, F.lit("created")).otherwise(F.col("field")))
    expected = F.when((F.col("pos") % 50 == 0) & (F.col("scope_id") != "7"), F.lit("7")).otherwise(F.col("scope_id"))
    return resolve.check_ops(log, expected, F.lit(1705968000000)).groupBy(F.coalesce("reason", F.lit("ok")).alias("reason")).agg(F.count("*").alias("n"))


@register(f"WITH {OPS_SQL}, k AS (SELECT *, CASE WHEN pos % 4 = 0 THEN 'create' ELSE 'set' END AS kd, 'r' || CAST(pos // 8 AS VARCHAR) AS rid FROM ops) SELECT a.pos, a.rid AS row_id, a.txn_id FROM k a WHERE kd = 'set' AND EXISTS (SELECT 1 FROM k b WHERE b.kd = 'create' AND b.scope_id = a.scope_id AND b.rid = a.rid AND b.txn_id = a.txn_id)")
def opening_writes(spark, sf):
    log = ops(spark, sf).withColumns({"kind": F.when(F.col("pos") % 4 == 0, "create").otherwise("set"), "row_id": F.concat(F.lit("r"), F.expr("pos div 8").cast("string"))})
    return resolve.opening_writes(log).select("pos", "row_id", "txn_id")


def _pushes(spark, sf):
    """The log as pushes that create rows first, certify some writes and break some rules."""
    log = ops(spark, sf)
    first = F.row_number().over(W.partitionBy(*resolve.ROW_KEY).orderBy("pos")) == 1
    log = log.withColumn("_new", first)
    parts = F.array(*([F.struct(F.lit("create").alias("kind"), F.lit(None).cast("string").alias("field"), F.lit(None).cast("string").alias("value_json"))]), F.struct(F.lit("set").alias("kind"), F.col("field"), F.col("value_json")))
    flat = log.select("scope_id", "table_name", "row_id", "hlc", "txn_id", (F.col("pos") * 2).alias("pos"), F.expr("pos div 64").alias("batch_id"), "_new", F.posexplode(parts).alias("n", "o"))
    base = F.when((F.col("o.kind") == "set") & (F.col("pos") % 14 == 0), F.sha2(F.lit("null"), 256))
    return flat.where("_new or n = 1").select("scope_id", "table_name", "row_id", "hlc", "txn_id", (F.col("pos") + F.col("n")).alias("pos"), "batch_id", "o.kind", "o.field", "o.value_json", base.alias("base_hash"))


@register()
def ordered_fold(spark, sf):
    return resolve.fold(_pushes(spark, sf), NOW_MS)


@register()
def push_outcomes(spark, sf):
    return resolve.outcomes(_pushes(spark, sf), NOW_MS)


@register(LWW_SQL + f" SELECT scope_id, row_id, field, {VALUE_SQL} AS value_json, hlc FROM won")
def fold_equals_lww(spark, sf):
    """The ordered fold of a log without base hashes, which must be what the aggregate gives."""
    log = _pushes(spark, sf).withColumn("base_hash", F.lit(None).cast("string"))
    return resolve.fold(log, NOW_MS).where("record = 'field'").select("scope_id", "row_id", "field", "value_json", "hlc")


@register(f"WITH {OPS_SQL} SELECT scope_id, row_id, {NOW_MS} + row_number() OVER (ORDER BY min(pos)) - 1 AS first_seen_at FROM ops GROUP BY scope_id, row_id")
def fold_first_seen(spark, sf):
    """When the fold's rows were first seen: one counter over all scopes."""
    log = _pushes(spark, sf).withColumn("base_hash", F.lit(None).cast("string"))
    return resolve.fold(log, NOW_MS).where("record = 'row'").select("scope_id", "row_id", "first_seen_at")


@register(
    f"WITH {OPS_SQL}, p AS (SELECT scope_id, pos // 2048 AS batch_id, pos, 't' || CAST(pos AS VARCHAR) AS txn_id, 'n' || CAST(pos AS VARCHAR) AS row_id, CASE WHEN pos % 100 = 3 THEN 'malformed_op' WHEN pos % 100 = 7 THEN 'malformed_op' WHEN pos % 100 = 11 THEN 'row_absent' END AS reason FROM ops), f AS (SELECT *, min(CASE WHEN reason IS NOT NULL THEN pos END) OVER (PARTITION BY scope_id, batch_id) AS stop FROM p) SELECT scope_id, batch_id, txn_id, reason IS NULL AS ok, reason, CASE WHEN reason IS NOT NULL THEN row_id END AS row_id, 0 AS n_beaten FROM f WHERE stop IS NULL OR pos <= stop"
)
def refused_pushes(spark, sf):
    """Pushes of single ops, some of them malformed or naming no row: each stops at its first refusal."""
    kind = F.when(F.col("pos") % 100 == 3, "odd").when(F.col("pos") % 100 == 7, "set").when(F.col("pos") % 100 == 11, "delete").otherwise("create")
    name = lambda p: F.concat(F.lit(p), F.col("pos").cast("string"))
    none = F.lit(None).cast("string")
    log = ops(spark, sf).withColumns({"kind": kind, "field": none, "value_json": none, "base_hash": none, "row_id": name("n"), "txn_id": name("t"), "batch_id": F.expr("pos div 2048")})
    return resolve.outcomes(log, NOW_MS)


# -- change data capture


@register(_SEQ_SQL + " SELECT row_id, field, value, hlc, server_seq FROM records WHERE scope_id = '7' AND server_seq > 5")
def incremental_pull(spark, sf):
    return cdc.pull(_records(spark, sf), "7", 5).select("row_id", "field", "value", "hlc", "server_seq")


@register(_SEQ_SQL + ", cursors AS (SELECT DISTINCT 'd' || CAST(user_id % 2 AS VARCHAR) AS device_id, CAST(user_id AS VARCHAR) AS scope_id, user_id % 30 AS c FROM events) SELECT device_id, scope_id, count(*) AS n FROM records JOIN cursors USING (scope_id) WHERE server_seq > c GROUP BY 1, 2")
def pull_for_all_devices(spark, sf):
    cursors = table(spark, sf, "events").select(F.concat(F.lit("d"), (F.col("user_id") % 2).cast("string")).alias("device_id"), F.col("user_id").cast("string").alias("scope_id"), (F.col("user_id") % 30).alias("last_server_seq")).distinct()
    return cdc.pull_many(_records(spark, sf), cursors).groupBy("device_id", "scope_id").agg(F.count("*").alias("n"))


@register(_SEQ_SQL + " SELECT row_id, field, value, hlc, server_seq FROM records WHERE scope_id = '7'")
def scope_snapshot(spark, sf):
    return cdc.snapshot(_records(spark, sf), "7").select("row_id", "field", "value", "hlc", "server_seq")


_LINE_SQL = f"""'{{"type":"field","scopeId":"' || scope_id || '","tableName":"activity","rowId":"' || row_id || '","field":"' || field || '","value":' || {VALUE_SQL} || ',"hlc":"' || hlc || '","serverSeq":' || CAST(server_seq AS VARCHAR) || ',"txnId":"' || txn_id || '"}}'"""


@register(_SEQ_SQL + f" SELECT {_LINE_SQL} AS line, row_number() OVER (ORDER BY scope_id || chr(0) || table_name || chr(0) || row_id || chr(0) || field) AS place FROM records WHERE scope_id = '7'")
def snapshot_ndjson(spark, sf):
    lines = snapshot.field_lines(cdc.snapshot(_records(spark, sf), "7"))
    return lines.select("line", F.row_number().over(W.orderBy("part", "key")).cast("long").alias("place"))


_HEAD_SQL = """'{"type":"header","serverSeq":' || CAST(count(*) AS VARCHAR) || ',"epoch":"e' || scope_id || '","tombstoneFloorSeq":0,"schemaHash":null}'"""
_ROW_SQL = """'{"type":"row","scopeId":"' || scope_id || '","tableName":"activity","rowId":"' || row_id || '","firstSeenAt":' || CAST(min(pos) AS VARCHAR) || ',"class":"row","deletedHlc":null,"registerHlc":null,"serverSeq":' || CAST(max(server_seq) AS VARCHAR) || '}'"""


@register(
    _SEQ_SQL
    + f", lines AS (SELECT scope_id, 0 AS part, '' AS key, {_HEAD_SQL} AS line FROM records GROUP BY scope_id UNION ALL SELECT scope_id, 1, row_id || chr(0) || field, {_LINE_SQL} FROM records UNION ALL SELECT scope_id, 2, row_id, {_ROW_SQL} FROM records GROUP BY scope_id, row_id)"
    + " SELECT scope_id, sha256(string_agg(line, chr(10) ORDER BY part, key) || chr(10)) AS digest, count(*) AS n_lines FROM lines GROUP BY 1"
)
def snapshot_digest(spark, sf):
    """The digest of every scope's whole body: header, fields and rows."""
    records = _records(spark, sf)
    heads = records.groupBy("scope_id").agg(F.count("*").alias("server_seq")).select("scope_id", "server_seq", F.concat(F.lit("e"), "scope_id").alias("epoch"), F.lit(0).alias("tombstone_floor_seq"), F.lit(None).cast("string").alias("schema_hash"))
    none = F.lit(None).cast("string")
    rows = records.groupBy(*resolve.ROW_KEY).agg(F.min("pos").alias("first_seen_at"), F.max("server_seq").alias("server_seq")).withColumns({"class": F.lit("row"), "deleted_hlc": none, "register_hlc": none})
    return snapshot.digest(snapshot.body_lines(heads, records, rows, "scope_id"), by="scope_id").select("scope_id", "digest", "n_lines")


_DAY20 = 1_705_708_800_000  # 2024-01-20
_DEL_SQL = REG_SQL + f", rows_ AS (SELECT *, row_number() OVER (PARTITION BY scope_id ORDER BY first_pos) AS server_seq FROM all_rows), gone AS (SELECT * FROM rows_ WHERE deleted_hlc IS NOT NULL AND substr(deleted_hlc, 1, 15) <= lower(to_base({_DAY20}, 36, 15)))"


def _rows(spark, sf):
    return resolve.rows_of(ops(spark, sf, True)).withColumn("server_seq", F.row_number().over(W.partitionBy("scope_id").orderBy("first_pos")).cast("long"))


@register(_DEL_SQL + " SELECT scope_id, greatest(3, coalesce(max(server_seq) FILTER ((scope_id, row_id) IN (SELECT (scope_id, row_id) FROM gone)), 0)) AS tombstone_floor_seq FROM rows_ GROUP BY 1")
def tombstone_floor(spark, sf):
    rows = _rows(spark, sf)
    scopes = rows.select("scope_id").distinct().withColumn("tombstone_floor_seq", F.lit(3).cast("long"))
    return cdc.raised_floor(rows, scopes, F.lit(_DAY20 + cdc.FLOOR_MS)).select("scope_id", "tombstone_floor_seq")


@register(_DEL_SQL + " SELECT scope_id, row_id, field, max(hlc) AS hlc FROM ops WHERE kind = 'set' AND (scope_id, row_id) NOT IN (SELECT (scope_id, row_id) FROM gone) GROUP BY ALL")
def pruned_fields(spark, sf):
    fields = resolve.latest_fields(ops(spark, sf, True), "value")
    return cdc.prune(_rows(spark, sf), fields, F.lit(_DAY20 + cdc.FLOOR_MS))[1].select("scope_id", "row_id", "field", "hlc")


_SCOPES_SQL = "scopes AS (SELECT CAST(user_id AS VARCHAR) AS scope_id, count(*) AS server_seq, user_id % 9 AS tombstone_floor_seq, CASE WHEN user_id % 4 > 0 THEN 'h' || CAST(user_id % 3 AS VARCHAR) END AS schema_hash, CASE WHEN user_id % 4 > 0 THEN user_id % 4 END AS schema_version, 'e' || CAST(user_id % 5 AS VARCHAR) AS epoch FROM events GROUP BY user_id), requests AS (SELECT CAST(event_id AS VARCHAR) AS device_id, CAST(user_id AS VARCHAR) AS scope_id, 'h' || CAST(event_id % 3 AS VARCHAR) AS r_hash, event_id % 4 AS r_version, event_id % 100 AS cursor, CASE WHEN event_id % 7 > 0 THEN 'e' || CAST(event_id % 5 AS VARCHAR) END AS r_epoch FROM events)"


def _handshakes(spark, sf):
    e, u, i = table(spark, sf, "events"), F.col("user_id"), F.col("event_id")
    mod = lambda c, n, p: F.concat(F.lit(p), (c % n).cast("string"))
    scopes = e.groupBy("user_id").agg(F.count("*").alias("server_seq")).select(u.cast("string").alias("scope_id"), "server_seq", (u % 9).alias("tombstone_floor_seq"), F.when(u % 4 > 0, mod(u, 3, "h")).alias("schema_hash"), F.when(u % 4 > 0, u % 4).alias("schema_version"), mod(u, 5, "e").alias("epoch"))
    requests = e.select(i.cast("string").alias("device_id"), u.cast("string").alias("scope_id"), mod(i, 3, "h").alias("schema_hash"), (i % 4).alias("schema_version"), (i % 100).alias("last_server_seq"), F.when(i % 7 > 0, mod(i, 5, "e")).alias("epoch"))
    return requests, scopes


@register(f"WITH {_SCOPES_SQL}, b AS (SELECT *, schema_version IS NULL OR r_version > schema_version AS newer FROM requests JOIN scopes USING (scope_id)) SELECT device_id, CASE WHEN NOT newer AND (r_version < schema_version OR r_hash IS DISTINCT FROM schema_hash) THEN 'schema_mismatch' WHEN cursor < tombstone_floor_seq OR coalesce(r_epoch <> epoch, FALSE) OR cursor > server_seq THEN 'resync_required' END AS reason, CASE WHEN newer THEN r_version ELSE schema_version END AS schema_version FROM b")
def handshakes(spark, sf):
    return cdc.handshake(*_handshakes(spark, sf)).select("device_id", "reason", "schema_version")


@register(f"WITH {_SCOPES_SQL} SELECT device_id, scope_id, cursor AS last_server_seq FROM requests JOIN scopes USING (scope_id) WHERE cursor < tombstone_floor_seq OR cursor > server_seq OR r_epoch <> epoch")
def devices_to_resync(spark, sf):
    requests, scopes = _handshakes(spark, sf)
    return relay.needs_resync(requests, scopes).select("device_id", "scope_id", "last_server_seq")


# -- typed rows


_KINDS = ["click", "error", "purchase", "signup", "view"]


@register(LWW_SQL + " SELECT scope_id, row_id, max(value) FILTER (field = 'click') AS click, max(value) FILTER (field = 'error') AS error, max(value) FILTER (field = 'purchase') AS purchase, max(value) FILTER (field = 'signup') AS signup, max(value) FILTER (field = 'view') AS view FROM won WHERE field IN ('click', 'error', 'purchase', 'signup', 'view') GROUP BY 1, 2")
def materialize_rows(spark, sf):
    return materialize.pivot(resolve.latest_fields(ops(spark, sf), "value"), _KINDS).drop("table_name")


_CUSTOMERS = S.Collection("customers", (S.Field("name"), S.Field("balance", "number"), S.Field("segment", "enum", values=("BUILDING", "MACHINERY", "AUTOMOBILE")), S.Field("vip", "boolean"), S.Field("note", nullable=True)))


def _customer_fields(spark, sf):
    c = table(spark, sf, "customer")
    j = wire.json_string
    cells = {"id": j(F.col("c_custkey").cast("string")), "created": j(F.lit("2024-01-01")), "name": j(F.col("c_name")), "balance": F.when(F.col("c_custkey") % 5 > 0, wire.number_json(F.col("c_acctbal"))).otherwise(F.lit('"n/a"')), "segment": j(F.col("c_mktsegment")), "vip": F.when(F.col("c_custkey") % 2 == 0, "true"), "note": F.lit("null")}
    rows = c.select(F.col("c_nationkey").cast("string").alias("scope_id"), F.lit("customers").alias("table_name"), F.col("c_custkey").cast("string").alias("row_id"), F.explode(F.array(*(F.struct(F.lit(k).alias("field"), v.alias("value_json")) for k, v in cells.items()))).alias("x"))
    return rows.select("scope_id", "table_name", "row_id", "x.field", "x.value_json").where("value_json is not null")


@register("SELECT CAST(c_custkey AS VARCHAR) AS id, CAST(c_nationkey AS VARCHAR) AS scope_id, c_name AS name, CASE WHEN c_custkey % 5 > 0 THEN c_acctbal ELSE 0.0 END AS balance, CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY', 'AUTOMOBILE') THEN c_mktsegment ELSE 'BUILDING' END AS segment, c_custkey % 2 = 0 AS vip, CAST(NULL AS VARCHAR) AS note, 'note' AS nulls FROM customer")
def typed_rows(spark, sf):
    rows = materialize.typed(_customer_fields(spark, sf), _CUSTOMERS)
    return rows.select("id", "scope_id", "name", "balance", "segment", "vip", "note", F.array_join("null_fields", ",").alias("nulls"))


@register("SELECT n_nationkey, n_name AS label, n_regionkey AS region FROM nation")
def nested_rows(spark, sf):
    flat = table(spark, sf, "nation").select("n_nationkey", F.col("n_name").alias("place__name__label"), F.col("n_regionkey").alias("place__region"))
    return materialize.nest(flat).select("n_nationkey", F.col("place.name.label").alias("label"), F.col("place.region").alias("region"))


@register("SELECT CAST(c_custkey AS VARCHAR) AS id, c_name AS name, 0.0 AS balance, 'BUILDING' AS segment FROM customer")
def evolved_rows(spark, sf):
    old = table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("id"), F.col("c_name").alias("name"), F.lit("1").alias("_sync_rev"))
    return materialize.public(materialize.evolve(old, _CUSTOMERS)).select("id", "name", "balance", "segment")


@register("SELECT CAST(c_custkey AS VARCHAR) AS row_id, 'name' AS field, c_name AS value FROM customer UNION ALL SELECT CAST(c_custkey AS VARCHAR), 'segment', c_mktsegment FROM customer")
def melted_rows(spark, sf):
    rows = table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("row_id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    return materialize.melt(rows, ["name", "segment"], ["row_id"])


@register("SELECT CAST(c_custkey AS VARCHAR) AS row_id, CASE WHEN c_custkey % 2 = 0 THEN 7 ELSE 6 END AS n, 'id,name' AS q FROM customer WHERE c_custkey % 2 = 0")
def rows_carrying_fields(spark, sf):
    fields = _customer_fields(spark, sf)
    key = query.QueryKey.of(S.Schema((_CUSTOMERS,)), "customers", ["name", "vip"])
    n = fields.groupBy("scope_id", "row_id").agg(F.count("*").cast("int").alias("n"))
    return query.carries(fields, key).join(n, ["scope_id", "row_id"]).select("row_id", "n", F.lit("id,name").alias("q"))


@register("SELECT 'INSERT INTO \"customers\" (\"balance\", \"name\") VALUES (' || CASE WHEN c_acctbal = floor(c_acctbal) THEN CAST(CAST(c_acctbal AS BIGINT) AS VARCHAR) ELSE CAST(c_acctbal AS VARCHAR) END || ', ' || chr(39) || replace(c_name, chr(39), repeat(chr(39), 2)) || chr(39) || ');' AS statement FROM customer")
def insert_script(spark, sf):
    rows = table(spark, sf, "customer").select(F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"))
    return snapshot.insert_script(rows, "customers")


# -- reads


@register("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem")
def list_rows(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")


@register("SELECT c_custkey, c_name FROM customer WHERE c_nationkey = 3 AND c_custkey % 10 = 2")
def get_row(spark, sf):
    return table(spark, sf, "customer").where("c_nationkey = 3 and c_custkey % 10 = 2").select("c_custkey", "c_name")


@register("SELECT c_custkey FROM customer WHERE c_nationkey = 7 AND c_mktsegment <> 'MACHINERY' AND c_acctbal >= 100 ORDER BY c_acctbal DESC NULLS LAST, c_custkey LIMIT 10 OFFSET 2")
def scoped_page(spark, sf):
    q = query.Scoped(table(spark, sf, "customer").withColumn("scope", F.col("c_nationkey").cast("string")), "7", "scope")
    return q.where("c_mktsegment", "!=", "MACHINERY").where("c_acctbal", ">=", 100).order_by("c_acctbal", "desc").order_by("c_custkey").limit(10, 2).select("c_custkey")


@register("SELECT p_partkey FROM part WHERE p_name ILIKE '%RING%' AND p_size BETWEEN 5 AND 30 AND p_brand IN ('Brand#1', 'Brand#2', 'Brand#3') AND p_type IS NOT NULL")
def predicates(spark, sf):
    q = query.Scoped(table(spark, sf, "part").withColumn("scope", F.lit("s")), "s", "scope")
    return q.where("p_name", "like", "%RING%").where("p_size", "between", (5, 30)).where("p_brand", "in", ["Brand#1", "Brand#2", "Brand#3"]).where("p_type", "is not", None).select("p_partkey")


@register("SELECT l_returnflag, l_linestatus, CAST(sum(l_quantity) AS DOUBLE) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n FROM lineitem WHERE l_discount < 0.05 GROUP BY 1, 2")
def raw_sql(spark, sf):
    view = f"lineitem_{uuid.uuid4().hex}"
    table(spark, sf, "lineitem").createOrReplaceTempView(view)
    return query.execute(spark, f"SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n FROM {view} WHERE l_discount < ? GROUP BY 1, 2", 0.05)


@register("SELECT p_partkey, row_number() OVER (ORDER BY coalesce(p_name, ''), CAST(p_partkey AS VARCHAR)) AS place FROM part")
def code_unit_order(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", "p_name", F.col("p_partkey").cast("string").alias("row_id"))
    return query.with_places(query.in_order(p, "p_name"), "place").select("p_partkey", "place")


@register("SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC NULLS LAST, o_orderkey LIMIT 8")
def top_k(spark, sf):
    return query.Scoped(table(spark, sf, "orders").withColumn("scope", F.lit("s")), "s", "scope").order_by("o_orderdate", "desc").order_by("o_orderkey").limit(8).select("o_orderkey", "o_orderdate")


# -- relations


@register("SELECT o_orderkey, coalesce(string_agg(CAST(l_linenumber AS VARCHAR) || ':' || CAST(l_partkey AS VARCHAR), ',' ORDER BY l_linenumber, l_partkey), '') AS lines FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def has_many(spark, sf):
    out = relations.has_many(table(spark, sf, "orders"), table(spark, sf, "lineitem"), "o_orderkey", "l_orderkey", "lines", ["l_linenumber", "l_partkey"], ["l_partkey"])
    return out.select("o_orderkey", F.array_join(F.transform("lines", lambda x: F.concat_ws(":", x["l_linenumber"].cast("string"), x["l_partkey"].cast("string"))), ",").alias("lines"))


@register("SELECT o_orderkey, c_name, c_mktsegment FROM orders LEFT JOIN customer ON c_custkey = o_custkey")
def has_one(spark, sf):
    return relations.has_one(table(spark, sf, "orders"), table(spark, sf, "customer"), "o_custkey", "c_custkey", ["c_custkey"], {"c_name": "c_name", "c_mktsegment": "c_mktsegment"}).select("o_orderkey", "c_name", "c_mktsegment")


@register("SELECT n_nationkey, r_name FROM nation LEFT JOIN region ON coalesce(CAST(CASE WHEN n_nationkey % 6 > 0 THEN n_regionkey END AS VARCHAR), 'null') = coalesce(CAST(CASE WHEN r_regionkey > 0 THEN r_regionkey END AS VARCHAR), 'null')")
def key_coercion(spark, sf):
    n = table(spark, sf, "nation").withColumn("k", F.when(F.col("n_nationkey") % 6 > 0, F.col("n_regionkey").cast("long")))
    r = table(spark, sf, "region").withColumn("k2", F.when(F.col("r_regionkey") > 0, F.col("r_regionkey").cast("string")))
    return relations.has_one(n, r, "k", "k2", ["r_regionkey"], {"r_name": "r_name"}).select("n_nationkey", "r_name")


@register("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F')")
def visible_children(spark, sf):
    live = table(spark, sf, "orders").where("o_orderstatus != 'F'")
    return relations.visible_children(table(spark, sf, "lineitem"), live, "l_orderkey", "o_orderkey").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@register("SELECT c_custkey, count(o_orderkey) AS n_orders FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def child_counts(spark, sf):
    return relations.child_counts(table(spark, sf, "customer"), table(spark, sf, "orders"), "c_custkey", "o_custkey", "n_orders").select("c_custkey", "n_orders")


@register("SELECT o_orderkey, round(coalesce(CASE WHEN o_orderkey % 5 = 0 THEN o_totalprice END, s, 0), 2) AS total FROM orders LEFT JOIN (SELECT l_orderkey, sum(l_extendedprice) AS s FROM lineitem WHERE l_linestatus <> 'F' GROUP BY 1) ON l_orderkey = o_orderkey")
def derived_totals(spark, sf):
    lines = table(spark, sf, "lineitem").where("l_linestatus != 'F'")
    override = F.when(F.col("o_orderkey") % 5 == 0, F.col("o_totalprice"))
    return relations.derived_total(table(spark, sf, "orders"), lines, "o_orderkey", "l_orderkey", "l_extendedprice", override, "total").select("o_orderkey", F.round("total", 2).alias("total"))


@register("SELECT o_orderkey AS place, c_custkey, c_name FROM orders JOIN customer ON c_custkey = o_custkey")
def ordered_lookup(spark, sf):
    ids = table(spark, sf, "orders").select(F.col("o_orderkey").alias("place"), F.col("o_custkey").alias("c_custkey"))
    return relations.ordered_lookup(ids, table(spark, sf, "customer"), "place", ["c_custkey"]).select("place", "c_custkey", "c_name")


# -- devices


_BOX_SQL = f"WITH {LIFE_SQL}, outbox AS (SELECT * FROM ops WHERE pos % 6 = 1), quarantine AS (SELECT *, 'why' || CAST(pos % 3 AS VARCHAR) AS reason FROM ops WHERE pos % 17 = 3)"


def _boxes(spark, sf):
    log = ops(spark, sf, True)
    return log, log.where("pos % 6 = 1"), log.where("pos % 17 = 3").withColumn("reason", F.concat(F.lit("why"), (F.col("pos") % 3).cast("string")))


@register(_BOX_SQL + " SELECT pos, kind, field, hlc FROM outbox WHERE scope_id = '7' ORDER BY pos")
def outbox_scan(spark, sf):
    return device.queued(_boxes(spark, sf)[1], "7").select("pos", "kind", "field", "hlc")


@register(_BOX_SQL + " SELECT scope_id, row_id, field, max(pos) AS pos, arg_max(value, pos) AS value FROM outbox WHERE kind = 'set' GROUP BY ALL")
def last_queued_writes(spark, sf):
    return device.last_writes(_boxes(spark, sf)[1]).select("scope_id", "row_id", "field", "pos", "value")


@register(_BOX_SQL + " SELECT scope_id, row_id, field, max(pos) AS pos FROM quarantine WHERE kind = 'set' AND field NOT IN ('id', 'scope_id', 'created') AND txn_id NOT IN (SELECT txn_id FROM ops WHERE kind = 'restore') GROUP BY ALL")
def last_refused_writes(spark, sf):
    log, _, refused = _boxes(spark, sf)
    opening = log.where("kind = 'restore'").select("txn_id").distinct()
    return device.last_writes(refused.where(~F.col("field").isin(*S.BASE_FIELDS)).join(opening, "txn_id", "left_anti")).select("scope_id", "row_id", "field", "pos")


@register(_BOX_SQL + " SELECT scope_id, table_name, row_id, count(*) AS n_queued, count(*) FILTER (kind IN ('create', 'append')) AS n_creates FROM outbox GROUP BY ALL")
def queue_counts(spark, sf):
    return device.queue_counts(_boxes(spark, sf)[1])


@register(_BOX_SQL + ", named AS (SELECT scope_id, row_id FROM outbox UNION SELECT scope_id, row_id FROM quarantine), r AS (SELECT DISTINCT scope_id, row_id FROM ops) SELECT scope_id, row_id, (scope_id, row_id) IN (SELECT (scope_id, row_id) FROM named) AS is_dirty FROM r")
def dirty_rows(spark, sf):
    log, outbox, refused = _boxes(spark, sf)
    return relations.dirty(log.select(*resolve.ROW_KEY).distinct(), outbox, refused, resolve.ROW_KEY).drop("table_name")


@register(_BOX_SQL + " SELECT c.scope_id, c.last_server_seq, coalesce(p, 0) AS pending, coalesce(q, 0) AS quarantined, coalesce(r, '') AS reasons FROM (SELECT scope_id, max(pos) AS last_server_seq FROM ops GROUP BY 1) c LEFT JOIN (SELECT scope_id, count(*) AS p FROM outbox GROUP BY 1) USING (scope_id) LEFT JOIN (SELECT scope_id, count(*) AS q, string_agg(DISTINCT reason, ',' ORDER BY reason) AS r FROM quarantine GROUP BY 1) USING (scope_id)")
def sync_status(spark, sf):
    log, outbox, refused = _boxes(spark, sf)
    return device.status(outbox, refused, log.groupBy("scope_id").agg(F.max("pos").alias("last_server_seq")))


@register(_BOX_SQL + " SELECT pos FROM outbox WHERE pos % 4 <> 1")
def drained_outbox(spark, sf):
    outbox = _boxes(spark, sf)[1]
    return device.drain(outbox, outbox.where("pos % 4 = 1")).select("pos")


@register(_BOX_SQL + " SELECT pos, 'clock_skew' AS reason FROM outbox WHERE CAST(substr(txn_id, 2) AS BIGINT) % 5 = 0")
def quarantined_ops(spark, sf):
    outbox = _boxes(spark, sf)[1]
    refused = outbox.where("cast(substring(txn_id, 2) as bigint) % 5 = 0").select("scope_id", "txn_id").distinct().withColumn("reason", F.lit("clock_skew"))
    return device.quarantine(outbox, refused)[1].select("pos", "reason")


@register(_BOX_SQL + " SELECT DISTINCT reason FROM quarantine")
def refusal_reasons(spark, sf):
    return _boxes(spark, sf)[2].select("reason").distinct()


@register("SELECT CAST(n_nationkey AS VARCHAR) AS row_id, 0 AS n, 'create' AS kind, CAST(NULL AS VARCHAR) AS field, CAST(NULL AS VARCHAR) AS value FROM nation UNION ALL SELECT CAST(n_nationkey AS VARCHAR), 1, 'set', 'id', CAST(n_nationkey AS VARCHAR) FROM nation UNION ALL SELECT CAST(n_nationkey AS VARCHAR), 2, 'set', 'scope_id', 's' FROM nation UNION ALL SELECT CAST(n_nationkey AS VARCHAR), 3, 'set', 'created', 'h' FROM nation UNION ALL SELECT CAST(n_nationkey AS VARCHAR), 4, 'set', 'n_name', n_name FROM nation")
def create_ops(spark, sf):
    rows = table(spark, sf, "nation").select(F.col("n_nationkey").cast("string").alias("row_id"), "n_name", F.lit("h").alias("hlc"), F.lit("t").alias("txn_id"))
    return device.create_ops(rows, ["n_name"], "s", "nations").select("row_id", "n", "kind", "field", "value")


_APPLY_SQL = LWW_SQL + ", loc AS (SELECT scope_id, row_id, field, -1.0 AS value FROM won WHERE pos % 2 = 0), unsent AS (SELECT DISTINCT scope_id, row_id, field FROM ops WHERE pos % 19 = 0), gone AS (SELECT DISTINCT scope_id, row_id FROM ops WHERE pos % 101 = 0), news AS (SELECT scope_id, row_id, field, value FROM won WHERE (scope_id, row_id, field) NOT IN (SELECT (scope_id, row_id, field) FROM unsent) AND (scope_id, row_id) NOT IN (SELECT (scope_id, row_id) FROM gone)) SELECT * FROM news UNION ALL SELECT * FROM loc WHERE (scope_id, row_id, field) NOT IN (SELECT (scope_id, row_id, field) FROM news) AND (scope_id, row_id) NOT IN (SELECT (scope_id, row_id) FROM gone)"


@register(_APPLY_SQL)
def apply_batch(spark, sf):
    log = ops(spark, sf)
    won = resolve.latest_fields(log, "value").select(*resolve.FIELD_KEY, "value", "pos")
    local = won.where("pos % 2 = 0").withColumn("value", F.lit(-1.0))
    return device.apply_batch(local, won, log.where("pos % 19 = 0"), log.where("pos % 101 = 0").select(*resolve.ROW_KEY).distinct()).select("scope_id", "row_id", "field", "value")


@register(REG_SQL + ", held AS (SELECT scope_id, row_id FROM all_rows WHERE deleted_hlc IS NULL AND first_pos % 3 > 0), worked AS (SELECT DISTINCT scope_id, row_id FROM ops WHERE pos % 6 = 1) SELECT scope_id, row_id, CASE WHEN (scope_id, row_id) IN (SELECT (scope_id, row_id) FROM held) THEN 'keep' WHEN (scope_id, row_id) IN (SELECT (scope_id, row_id) FROM worked) THEN 'quarantine' ELSE 'delete' END AS fate FROM seen")
def snapshot_absence(spark, sf):
    log = ops(spark, sf, True)
    rows = resolve.rows_of(log)
    return device.apply_snapshot(rows.select(*resolve.ROW_KEY), rows.where("first_pos % 3 > 0"), log.where("pos % 6 = 1"), ["history"]).select("scope_id", "row_id", "fate")


@register(REG_SQL + " SELECT scope_id, row_id FROM seen WHERE first_pos % 3 = 0")
def missing_rows(spark, sf):
    rows = resolve.rows_of(ops(spark, sf, True))
    return relations.missing_from(rows, rows.where("first_pos % 3 > 0"), resolve.ROW_KEY).select("scope_id", "row_id")


@register("SELECT p_partkey, lag(r, 2) OVER w AS before2, lag(r) OVER w AS before1, lead(r) OVER w AS after1, lead(r, 2) OVER w AS after2 FROM (SELECT p_partkey, p_brand, lpad(CAST(p_size AS VARCHAR), 3, '0') || ':' || CAST(p_partkey AS VARCHAR) AS r FROM part) WINDOW w AS (PARTITION BY p_brand ORDER BY r)")
def neighbour_ranks(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", "p_brand", F.concat(F.lpad(F.col("p_size").cast("string"), 3, "0"), F.lit(":"), F.col("p_partkey").cast("string")).alias("r"))
    return merge.neighbour_ranks(p, ["p_brand"], "r").select("p_partkey", "before2", "before1", "after1", "after2")


_RANKED_SQL = "r AS (SELECT p_partkey, p_brand, lpad(translate(CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS VARCHAR), '0123456789', 'BDFHJLNPRT'), 6, 'B') || ':dev' AS rank FROM part)"


def _ranked(spark, sf):
    n = F.row_number().over(W.partitionBy("p_brand").orderBy("p_partkey")).cast("string")
    return table(spark, sf, "part").select("p_partkey", "p_brand", F.concat(F.lpad(F.translate(n, "0123456789", "BDFHJLNPRT"), 6, "B"), F.lit(":dev")).alias("rank"))


@register("SELECT DISTINCT p_brand, TRUE AS behind_all FROM part")
def next_ranks(spark, sf):
    """A rank behind each group's last one."""
    ranked = _ranked(spark, sf)
    last = ranked.groupBy("p_brand").agg(F.max("rank").alias("last"))
    return merge.next_ranks(ranked, ["p_brand"], "rank", "dev").join(last, "p_brand").select("p_brand", (F.col("next_rank") > F.col("last")).alias("behind_all"))


@register(f"WITH {_RANKED_SQL}, w AS (SELECT *, row_number() OVER g AS i, count(*) OVER (PARTITION BY p_brand) AS n FROM r WINDOW g AS (PARTITION BY p_brand ORDER BY rank)) SELECT p_partkey, CASE WHEN i > 1 THEN TRUE END AS up, CASE WHEN i < n THEN TRUE END AS down FROM w")
def moved_ranks(spark, sf):
    """Whether the rank of a row moved one place lies between its new neighbours."""
    moved = merge.neighbour_ranks(merge.moved_ranks(_ranked(spark, sf), ["p_brand"], "rank", "dev"), ["p_brand"], "rank")
    up = (F.col("rank_up") < F.col("before1")) & F.coalesce(F.col("rank_up") > F.col("before2"), F.lit(True))
    down = (F.col("rank_down") > F.col("after1")) & F.coalesce(F.col("rank_down") < F.col("after2"), F.lit(True))
    return moved.select("p_partkey", up.alias("up"), down.alias("down"))


# -- differences


_VERSIONS_SQL = "WITH a AS (SELECT o_orderkey AS id, o_custkey AS rev FROM orders WHERE o_orderkey % 7 > 0), b AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 11 = 0 THEN o_custkey + 1 ELSE o_custkey END AS rev FROM orders WHERE o_orderkey % 5 > 0)"


def _versions(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("rev"))
    return o.where("id % 7 > 0"), o.where("id % 5 > 0").withColumn("rev", F.when(F.col("id") % 11 == 0, F.col("rev") + 1).otherwise(F.col("rev")))


@register(_VERSIONS_SQL + " SELECT coalesce(a.id, b.id) AS id, CASE WHEN a.id IS NULL THEN 'added' WHEN b.id IS NULL THEN 'removed' ELSE 'changed' END AS change FROM a FULL JOIN b ON a.id = b.id WHERE a.id IS NULL OR b.id IS NULL OR a.rev IS DISTINCT FROM b.rev")
def result_delta(spark, sf):
    return query.delta(*_versions(spark, sf), ["id"])


@register(_VERSIONS_SQL + " SELECT * FROM b")
def applied_delta(spark, sf):
    before, after = _versions(spark, sf)
    return query.apply_delta(before, query.delta(before, after, ["id"]), after, ["id"])


@register(_VERSIONS_SQL + " SELECT a.id, b.rev, b.id IS NULL AS removed FROM a LEFT JOIN b ON a.id = b.id WHERE a.id % 3 = 0")
def moved_rows(spark, sf):
    before, after = _versions(spark, sf)
    return query.moved(before.where("id % 3 = 0"), after, ["id"])


# -- retention


_RETENTION_SQL = "WITH r AS (SELECT o_orderkey, greatest(epoch_us(o_orderdate) // 1000, 700000000000) + (CASE WHEN o_custkey % 3 = 0 THEN 30 ELSE (o_custkey % 3) * 1000 END) * 86400000 AS expires_at FROM orders WHERE o_orderkey % 13 > 0)"


def _expired(spark, sf):
    o = table(spark, sf, "orders")
    anchor = F.when(F.col("o_orderkey") % 13 > 0, F.expr("unix_micros(cast(o_orderdate as timestamp)) div 1000"))
    days = F.when(F.col("o_custkey") % 3 > 0, F.col("o_custkey") % 3 * 1000.0).otherwise(F.lit(-1.0))
    return retention.plan_deletes(o, anchor, F.lit(700_000_000_000), days, F.lit(30.0), F.lit(900_000_000_000))


@register(_RETENTION_SQL + " SELECT o_orderkey, CAST(expires_at AS BIGINT) AS expires_at FROM r WHERE expires_at <= 900000000000")
def retention_plan(spark, sf):
    return _expired(spark, sf).select("o_orderkey", "expires_at")


@register(_RETENTION_SQL + " SELECT 's' AS scope_id, CAST(o_orderkey AS VARCHAR) AS row_id, 'delete' AS kind, 'retention-' || CAST(o_orderkey AS VARCHAR) AS txn_id FROM r WHERE expires_at <= 900000000000")
def retention_ops(spark, sf):
    return retention.delete_ops(_expired(spark, sf), F.lit("s"), "orders", F.col("o_orderkey").cast("string"), F.lit("h")).select("scope_id", "row_id", "kind", "txn_id")


# -- streams


@register(LWW_SQL + " SELECT scope_id, row_id, field, value, hlc FROM won")
def streamed_lww(spark, sf):
    """The op log as a stream, folded with state and written batch by batch; equal to the batch result."""
    from semilattice.sources.oplog import from_events

    out = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    source = f"{sf}/events.parquet"
    events = spark.readStream.schema(spark.read.parquet(source).schema).parquet(source if _is_dir(spark, source) else f"{sf}/events.parquet*")
    won = relay.running_fields(from_events(events))
    q = won.writeStream.outputMode("complete").option("checkpointLocation", f"{out}/checkpoint").foreachBatch(lambda b, n: b.write.mode("overwrite").parquet(f"{out}/fields")).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"{out}/fields").select("scope_id", "row_id", "field", "value", "hlc")


def _is_dir(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


# -- the flagship


_FLAG_SQL = REG_SQL + ", live AS (SELECT scope_id, row_id, last_hlc FROM all_rows WHERE deleted_hlc IS NULL), won AS (SELECT scope_id, row_id, field, arg_max(value, hlc) AS value FROM ops WHERE kind = 'set' GROUP BY ALL), typed AS (SELECT scope_id, row_id, max(value) FILTER (field = 'click') AS click, max(value) FILTER (field = 'error') AS error, max(value) FILTER (field = 'purchase') AS purchase, max(value) FILTER (field = 'signup') AS signup, max(value) FILTER (field = 'view') AS view, count(*) AS n_fields FROM won GROUP BY ALL) SELECT scope_id, row_id, click, error, purchase, signup, view, n_fields, last_hlc FROM live JOIN typed USING (scope_id, row_id) ORDER BY last_hlc DESC LIMIT 20"


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Resolves the log: live rows with their winning values, the latest twenty."""
    log = ops(spark, sf, True)
    won = resolve.latest_fields(log, "value")
    wide = materialize.pivot(won, _KINDS)
    n = won.groupBy(*resolve.ROW_KEY).agg(F.count("*").alias("n_fields"))
    live = resolve.live_rows(log).select(*resolve.ROW_KEY, "last_hlc")
    out = live.join(wide, resolve.ROW_KEY).join(n, resolve.ROW_KEY)
    return out.orderBy(F.desc("last_hlc")).limit(20).select("scope_id", "row_id", *_KINDS, "n_fields", "last_hlc")


@register(_FLAG_SQL)
def latest_live_rows(spark, sf):
    return flagship(spark, sf)
