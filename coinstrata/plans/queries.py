"""Registered queries for the ledger's operators, each with SQL that returns the same rows."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from coinstrata.functions import config, hashing, status, text
from coinstrata.functions.amounts import amount_text
from coinstrata.operators import address, bag, changes, derive, metrics, spends, validate
from coinstrata.plans.mapping import MATURITY, ORDER, SQL, Tables, amount_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
SEEN_ORDER = ["height", "tx_idx", "vout", "value", "l_partkey", "l_quantity", "l_shipdate"]
UNDO = 48


def query(sql: str | None = None, plain: bool = False, name: str | None = None):
    """Registers a query of Tables under its function's name, with SQL after the views' (plain: alone)."""

    def register(f):
        key = name or f.__name__
        QUERIES[key] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql is not None:
            ORACLE[key] = sql if plain else SQL + sql
        return f

    return register


def hexed(df: DataFrame, *names: str) -> DataFrame:
    """BINARY columns as lower-case hex."""
    names = names or tuple(c for c, t in df.dtypes if t == "binary")
    return df.withColumns({c: F.lower(F.hex(c)) for c in names})


def whole(df: DataFrame) -> DataFrame:
    """DECIMAL sums as BIGINT."""
    return df.withColumns({c: F.col(c).cast("long") for c, t in df.dtypes if t.startswith("decimal")})


def live(t: Tables) -> DataFrame:
    return bag.utxo_set(t.outputs(), t.spends(), ORDER)


def script(n: int) -> str:
    return hashlib.sha256(f"spk:{n}".encode()).hexdigest()


def live_of(t: Tables, *numbers: int) -> DataFrame:
    """Unspent outputs of some scripts."""
    return bag.utxo_of(t.outputs(), t.spends(), [script(n) for n in numbers], ORDER)


def tip_of(t: Tables) -> int:
    return t.blocks().agg(F.max("height")).first()[0]


# --- sources -------------------------------------------------------------------------------------------------------


@query("SELECT height, block_hash, prev_hash FROM blocks WHERE block_hash = sha256('blk:1200')")
def SRC22_block_by_hash(t):
    return hexed(t.blocks().filter(F.col("block_hash") == hashing.sha256(F.lit("blk:1200"))).select("height", "block_hash", "prev_hash"))


@query("SELECT DISTINCT txid, block_hash FROM outputs WHERE txid LIKE '3f%'")
def SRC23_transactions_by_prefix(t):
    return hexed(t.outputs().filter(hashing.has_prefix(F.col("txid"), "3f")).select("txid", "block_hash").distinct())


@query("SELECT p.prev_txid, p.prev_vout FROM pending_spends p SEMI JOIN outputs o ON o.txid = p.prev_txid AND o.vout = p.prev_vout")
def SRC24_spent_probe(t):
    return hexed(t.pending_spends().join(t.outputs().select(F.col("txid").alias("prev_txid"), F.col("vout").alias("prev_vout")), ["prev_txid", "prev_vout"], "left_semi"))


@query("SELECT DISTINCT txid, vout FROM pending p WHERE EXISTS (SELECT 1 FROM outputs o WHERE o.txid = p.txid AND o.vout = p.vout)")
def SRC25_live_probe(t):
    return hexed(t.pending().select("txid", "vout").join(t.outputs().select("txid", "vout"), ["txid", "vout"], "left_semi").distinct())


@query("SELECT txid, vout, value, height FROM utxo WHERE script_hash = sha256('spk:5')")
def SRC26_outputs_of_script(t):
    return whole(hexed(live_of(t, 5).select("txid", "vout", "value", "height")))


@query("SELECT height, block_hash FROM first_seen WHERE script_hash = sha256('spk:7')")
def SRC27_first_seen_of_script(t):
    return hexed(derive.first_seen(t.outputs(), SEEN_ORDER).filter(F.col("script_hash") == hashing.sha256(F.lit("spk:7"))).select("height", "block_hash"))


@query(f"SELECT block_hash FROM blocks ORDER BY height DESC LIMIT {UNDO}")
def SRC28_window_members(t):
    return hexed(derive.last_blocks(t.blocks(), UNDO).select("block_hash"))


FAMILIES_SQL = f"""
, fam(family, key) AS (
    SELECT 'B', '42' || block_hash FROM blocks
    UNION ALL (SELECT 'N', '4e' || block_hash FROM blocks ORDER BY height DESC LIMIT {UNDO})
    UNION ALL SELECT 'O', '4f' || script_hash || txid[1:16] || printf('%08x', vout) FROM utxo
    UNION ALL SELECT 'H', '48' || txid[1:16] || printf('%08x', vout) FROM utxo
    UNION ALL SELECT 'S', '53' || script_hash FROM first_seen
    UNION ALL SELECT 'Z', '5a' || block_hash || script_hash FROM first_seen, tip WHERE height >= greatest(0, tip - {UNDO} + 1)
    UNION ALL SELECT 'W', '57' || block_hash || txid[1:16] || printf('%08x', vout) FROM outputs, tip WHERE height >= greatest(0, tip - {UNDO} + 1))"""


def _families(t: Tables) -> DataFrame:
    return derive.families(t.outputs(), t.spends(), t.blocks(), live(t), SEEN_ORDER, UNDO)


@query(FAMILIES_SQL + " SELECT family, key FROM fam WHERE key LIKE '4f0a%'")
def SRC29_scan_key_prefix(t):
    return hexed(_families(t).filter(hashing.has_prefix(F.col("key"), "4f0a")).select("family", "key"))


@query("SELECT max(height) AS height, printf('%x', max(height)) AS height_hex, sha256('blk:' || max(height)) AS block_hash FROM blocks")
def SRC30_tip_pointer(t):
    return hexed(derive.tip(t.blocks()), "block_hash")


@query("SELECT min(height) AS low, max(height) AS high, count(*) AS n FROM outputs WHERE height BETWEEN 500 AND 599")
def SRC31_height_range_scan(t):
    return t.outputs().filter("height BETWEEN 500 AND 599").agg(F.min("height").alias("low"), F.max("height").alias("high"), F.count("*").alias("n"))


@query("SELECT name, first, last FROM files WHERE name LIKE 'blocks-00001%' ORDER BY name")
def SRC19_files_by_name(t):
    return t.files().filter(F.col("name").startswith("blocks-00001"))


@query("SELECT * FROM (VALUES ('BTC', 'mainnet', 12, 0, 5, 'bc'), ('LTC', 'mainnet', 48, 48, 50, 'ltc'), ('DOGE', 'mainnet', 120, 30, 22, NULL)) v(tick, net, undo_blocks, pubkey_hash, script_hash, bech32)", plain=True)
def SRC35_coin_config(t):
    return config.config_table(t.spark).filter("net = 'mainnet'").select("tick", "net", "undo_blocks", "pubkey_hash", "script_hash", "bech32")


@query("SELECT r AS status, (SELECT count(*) FROM lineitem WHERE l_linestatus = r) = 0 AS is_empty FROM (VALUES ('F'), ('O'), ('X'), ('')) v(r)")
def SRC36_is_empty(t):
    one = lambda r: t.read("lineitem").filter(F.col("l_linestatus") == r).limit(1).agg((F.count("*") == 0).alias("is_empty")).select(F.lit(r).alias("status"), "is_empty")
    return one("F").union(one("O")).union(one("X")).union(one(""))


@query("SELECT DISTINCT txid FROM outputs UNION SELECT txid FROM pending")
def SRC42_read_your_writes(t):
    return hexed(t.outputs().select("txid").union(t.pending().select("txid")).distinct())


# --- sinks and staged changes ---------------------------------------------------------------------------------------

CHANGES = "(SELECT user_id AS k, event_id AS seq, CASE WHEN event_type IN ('error', 'click') THEN 'del' ELSE 'put' END AS op, value AS v FROM events)"


def _changes(t: Tables) -> DataFrame:
    return t.read("events").select(F.col("user_id").alias("k"), F.col("event_id").alias("seq"), F.when(F.col("event_type").isin("error", "click"), "del").otherwise("put").alias("op"), F.col("value").alias("v"))


@query(f"SELECT k, arg_max(seq, seq) AS seq, arg_max(op, seq) AS op, arg_max(v, seq) AS v FROM {CHANGES} GROUP BY k", plain=True)
def SNK1_collapse_changes(t):
    return changes.collapse(_changes(t), ["k"])


@query(f"SELECT k, arg_max(seq, seq) AS seq, arg_max(op, seq) AS op, arg_max(v, seq) AS v FROM {CHANGES} GROUP BY k HAVING NOT (arg_min(op, seq) = 'put' AND arg_max(op, seq) = 'del')", plain=True)
def SNK13_cancel_staged_puts(t):
    return changes.net(_changes(t), ["k"])


@query(f"SELECT k, max(seq) AS seq FROM {CHANGES} GROUP BY k HAVING arg_max(op, seq) = 'put'", plain=True)
def SNK2_apply_batch(t):
    c = _changes(t)
    table = changes.collapse(c.filter("seq % 2 = 0"), ["k"]).filter("op = 'put'")
    later = changes.collapse(c.filter("seq % 2 = 1"), ["k"])
    both = changes.collapse(table.unionByName(later).unionByName(changes.collapse(c.filter("seq % 2 = 0"), ["k"]).filter("op = 'del'")), ["k"])
    return changes.apply_changes(table.filter("false"), both, ["k"]).select("k", "seq")


@query("SELECT script_hash, height FROM first_seen WHERE height >= 3")
def SNK9_first_seen_if_absent(t):
    out = t.outputs()
    known = derive.first_seen(out.filter("height < 3"), SEEN_ORDER)
    return hexed(derive.first_seen(out.filter("height >= 3"), SEEN_ORDER).join(known.select("script_hash"), "script_hash", "left_anti").select("script_hash", "height"))


@query("SELECT (height // 1000)::BIGINT AS bucket, count(*) AS n FROM outputs GROUP BY 1")
def SNK29_height_buckets(t):
    return t.outputs().groupBy(F.floor(F.col("height") / 1000).alias("bucket")).agg(F.count("*").alias("n"))


# --- decode and project ----------------------------------------------------------------------------------------------


@query("SELECT height, count(DISTINCT txid) AS txs, count(*) AS outs FROM outputs GROUP BY height")
def AGG9_block_counts(t):
    return t.outputs().groupBy("height").agg(F.count_distinct("txid").alias("txs"), F.count("*").alias("outs"))


@query("SELECT height, txid, list(vout ORDER BY vout, value) AS vouts FROM outputs GROUP BY height, txid", name="DEC3_nested_blocks")
def _dec3(t):
    nested = t.outputs().groupBy("height", "txid").agg(F.array_sort(F.collect_list(F.struct("vout", "value"))).alias("outs"))
    return hexed(nested.select("height", "txid", F.transform("outs", lambda o: o["vout"]).alias("vouts")))


@query("SELECT txid, vout, value FROM outputs")
def DEC4_explode_outputs(t):
    nested = t.outputs().groupBy("height").agg(F.collect_list(F.struct("txid", "vout", "value")).alias("outs"))
    return whole(hexed(nested.select(F.explode("outs").alias("o")).select("o.*")))


@query("SELECT prev_txid, prev_vout FROM spends WHERE prev_vout <> 4294967295")
def FIL1_no_coinbase_inputs(t):
    coinbase = t.blocks().select(F.unhex(F.lit("00" * 32)).alias("prev_txid"), F.lit(4294967295).alias("prev_vout"))
    return hexed(t.spends().select("prev_txid", "prev_vout").unionByName(coinbase).filter("prev_vout <> 4294967295"))


@query("SELECT txid, coinbase FROM outputs WHERE coinbase")
def DEC7_coinbase_flag(t):
    return hexed(t.outputs().filter("coinbase").select("txid", "coinbase"))


@query("SELECT txid, vout, -1 AS height FROM pending")
def DEC6_pending_rows(t):
    return hexed(t.pending().select("txid", "vout", F.lit(-1).alias("height")))


@query("SELECT txid, lower(hex(from_hex(printf('%016x', value)))) AS value_be, printf('%08x', vout) AS vout_be FROM utxo")
def DEC11_output_codec(t):
    rows = live(t).select("txid", hashing.u64(F.col("value")).alias("value_be"), hashing.u32(F.col("vout")).alias("vout_be"), "value")
    checked = rows.withColumn("ok", F.when(hashing.from_u64(F.col("value_be")) == F.col("value"), True).otherwise(F.raise_error(F.lit("value codec"))))
    return hexed(checked.filter("ok").select("txid", "value_be", "vout_be"))


@query(FAMILIES_SQL + " SELECT family, key FROM fam")
def DEC19_derive_families(t):
    return hexed(_families(t).select("family", "key"))


@query(FAMILIES_SQL + " SELECT coalesce(family, 'TOTAL') AS family, count(*) AS n, min(len(key) // 2) AS key_min, max(len(key) // 2) AS key_max FROM fam GROUP BY ROLLUP(family)")
def AGG8_family_statistics(t):
    return derive.family_statistics(_families(t)).select("family", "n", "key_min", "key_max")


# --- filters -----------------------------------------------------------------------------------------------------------

VISIBLE = f"height <= tip AND NOT (coinbase AND tip - height + 1 < {MATURITY})"


@query(f"SELECT txid, vout, tip - height + 1 AS confirmations FROM utxo, tip WHERE {VISIBLE}")
def FIL2_FIL3_visible(t):
    return hexed(address.visible(live(t), tip_of(t), MATURITY).select("txid", "vout", "confirmations"))


@query("SELECT txid, vout, 1000 - height + 1 AS confirmations FROM utxo WHERE 1000 - height + 1 >= 0")
def FIL3_below_tip(t):
    return hexed(address.visible(live(t), 1000, 0).select("txid", "vout", "confirmations"))


@query("SELECT count(*) AS n FROM outputs")
def FIL4_require_txid(t):
    return address.require_txid(t.outputs()).filter(F.octet_length("txid") == 32).agg(F.count("*").alias("n"))


@query(f"SELECT txid, vout, script_hash FROM outputs, tip WHERE height >= greatest(0, tip - {UNDO} + 1)")
def FIL5_undo_window(t):
    return hexed(derive.in_window(t.outputs(), t.blocks(), UNDO).select("txid", "vout", "script_hash"))


@query("SELECT count(*) AS n, count(*) FILTER (coinbase) AS flagged FROM outputs")
def FIL6_legacy_flag(t):
    old = t.outputs().filter("height < 1000").withColumn("coinbase", F.when(F.col("coinbase"), F.lit(True)))
    rows = old.unionByName(t.outputs().filter("height >= 1000")).withColumn("coinbase", F.coalesce("coinbase", F.lit(False)))
    return rows.agg(F.count("*").alias("n"), F.count_if("coinbase").alias("flagged"))


@query(f"SELECT height, block_hash FROM blocks, tip WHERE height <= tip - greatest(6, {UNDO})")
def FIL8_below_safe_tip(t):
    return hexed(t.blocks().filter(F.col("height") <= tip_of(t) - max(6, UNDO)).select("height", "block_hash"))


@query(f"SELECT block_hash FROM blocks, tip WHERE height BETWEEN tip - 100 AND tip AND block_hash NOT IN (SELECT block_hash FROM blocks ORDER BY height DESC LIMIT {UNDO})")
def FIL10_cleanup_list(t):
    tip = tip_of(t)
    aged = t.blocks().filter(F.col("height") >= tip - 100).select("block_hash", "height")
    return hexed(changes.not_live(aged.union(aged), derive.last_blocks(t.blocks(), UNDO), "block_hash", "height").select("block_hash"))


@query("SELECT event_id, regexp_full_match(c, '[0-9a-f]{16}:[0-9]{1,10}') AS ok FROM (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN sha256('ev:' || event_id)[1:16] || ':' || user_id WHEN event_id % 3 = 1 THEN sha256('ev:' || event_id)[1:15] || ':1' ELSE 'x:' || user_id END AS c FROM events)", plain=True)
def FIL12_cursor_ok(t):
    h = F.sha2(F.concat(F.lit("ev:"), F.col("event_id").cast("string")), 256)
    c = F.when(F.col("event_id") % 3 == 0, F.concat_ws(":", F.substring(h, 1, 16), "user_id")).when(F.col("event_id") % 3 == 1, F.concat(F.substring(h, 1, 15), F.lit(":1"))).otherwise(F.concat(F.lit("x:"), F.col("user_id")))
    return t.read("events").select("event_id", text.cursor_ok(c).alias("ok"))


# --- joins -------------------------------------------------------------------------------------------------------------


@query("SELECT txid, vout, value, height FROM utxo")
def J1_left_anti_join(t):
    return whole(hexed(live(t).select("txid", "vout", "value", "height")))


@query("SELECT txid, vout, spender_txid, spend_height FROM matched WHERE value IS NULL")
def J2_orphan_spends(t):
    return hexed(spends.anomalies(spends.match(t.outputs(), t.spends(), ORDER)))


STATS = """SELECT sum(l)::BIGINT AS left_read, sum(r)::BIGINT AS right_read, sum(greatest(l - r, 0))::BIGINT AS emitted, sum(least(l, r))::BIGINT AS canceled, sum(greatest(r - l, 0))::BIGINT AS orphans
    FROM (SELECT txid, vout, sum(l) AS l, sum(r) AS r FROM (SELECT txid, vout, 1 AS l, 0 AS r FROM outputs UNION ALL SELECT prev_txid, prev_vout, 0, 1 FROM spends) GROUP BY txid, vout)"""


@query(STATS)
def AGG3_bag_statistics(t):
    return bag.bag_statistics(t.outputs(), bag.as_outpoint(t.spends()))


@query("SELECT (SELECT count(*) FROM outputs) AS left_read, n AS right_read, (SELECT count(*) FROM utxo) AS emitted, n AS canceled, 0::BIGINT AS orphans, TRUE AS checked FROM (SELECT count(*) AS n FROM matched WHERE value IS NOT NULL)")
def J3_orphan_gate(t):
    # from genesis the gate lets nothing pass but spends that have an output
    known = spends.match(t.outputs(), t.spends(), ORDER).filter("value IS NOT NULL").select("txid", "vout")
    return bag.orphan_gate(bag.bag_statistics(t.outputs(), known), 0)


@query("SELECT txid, vout, spend_height, spender_txid, value, height FROM matched")
def J4_spends_with_outputs(t):
    return whole(hexed(spends.match(t.outputs(), t.spends(), ORDER).select("txid", "vout", "spend_height", "spender_txid", "value", "height")))


@query("SELECT txid, vout, value, height FROM utxo")
def J6_batch_sees_itself(t):
    order = ORDER
    out, sp = t.outputs(), t.spends()
    before, batch = out.filter("height < 1200"), out.filter("height >= 1200")
    after, _ = spends.apply_batch(before, batch, sp, order)
    return whole(hexed(after.select("txid", "vout", "value", "height")))


@query("SELECT txid, vout, spend_height, height FROM matched WHERE height < spend_height")
def J7_undo_archive(t):
    return hexed(spends.archive(spends.match(t.outputs(), t.spends(), ORDER)).select("txid", "vout", "spend_height", "height"))


@query("SELECT s.spender_txid, b.block_hash FROM spends s JOIN blocks b ON b.height = s.spend_height")
def J8_spend_block(t):
    return hexed(t.spends().join(t.blocks().select(F.col("height").alias("spend_height"), "block_hash"), "spend_height").select("spender_txid", "block_hash"))


@query("SELECT txid, vout, value FROM utxo u WHERE NOT EXISTS (SELECT 1 FROM pending_spends p WHERE p.prev_txid = u.txid AND p.prev_vout = u.vout)")
def J9_not_spent_in_mempool(t):
    return whole(hexed(address.unspent(live(t), t.pending_spends()).select("txid", "vout", "value")))


@query("SELECT txid, vout, value, p.prev_txid IS NOT NULL AS spent FROM utxo u LEFT JOIN pending_spends p ON p.prev_txid = u.txid AND p.prev_vout = u.vout")
def J10_marked_spent(t):
    mark = bag.as_outpoint(t.pending_spends()).withColumn("m", F.lit(True))
    return whole(hexed(live(t).join(mark, ["txid", "vout"], "left").select("txid", "vout", "value", F.col("m").isNotNull().alias("spent"))))


@query("SELECT txid, vout FROM pending q WHERE NOT EXISTS (SELECT 1 FROM pending_spends p WHERE p.prev_txid = q.txid AND p.prev_vout = q.vout)")
def J11_pending_unspent(t):
    return hexed(address.unspent(t.pending(), t.pending_spends()).select("txid", "vout"))


@query("SELECT txid, vout, value FROM (SELECT txid, vout, value FROM pending UNION ALL SELECT txid, vout, value FROM utxo WHERE height > 2390) q WHERE NOT EXISTS (SELECT 1 FROM utxo u WHERE u.txid = q.txid AND u.vout = q.vout)")
def J12_confirmed_hides_pending(t):
    c = live(t)
    both = t.pending().unionByName(c.filter("height > 2390").select("txid", "vout", "value", "script_hash", "height", "coinbase"))
    return whole(hexed(address.pending_only(both, c).select("txid", "vout", "value")))


@query(f"SELECT block_hash, height FROM blocks ORDER BY height DESC LIMIT {UNDO}")
def J13_window_heights(t):
    hashes = derive.last_blocks(t.blocks(), UNDO).select("block_hash")
    return hexed(hashes.join(t.blocks(), "block_hash", "left").select("block_hash", F.coalesce("height", F.lit(-1)).alias("height")))


BRANCH = "(SELECT height, CASE WHEN height >= 2390 THEN sha256('alt:' || height) ELSE block_hash END AS block_hash FROM blocks, tip WHERE height <= tip - 3)"


def _branch(t: Tables) -> DataFrame:
    return t.blocks().filter(F.col("height") <= tip_of(t) - 3).withColumn("block_hash", F.when(F.col("height") >= 2390, hashing.sha256(F.concat(F.lit("alt:"), F.col("height").cast("string")))).otherwise(F.col("block_hash")))


@query(f"SELECT b.height FROM blocks b LEFT JOIN {BRANCH} n ON n.height = b.height WHERE n.block_hash IS NULL OR n.block_hash <> b.block_hash")
def J14_differs_from_node(t):
    node = _branch(t).select("height", F.col("block_hash").alias("theirs"))
    return t.blocks().join(node, "height", "left").filter(F.col("theirs").isNull() | (F.col("theirs") != F.col("block_hash"))).select("height")


EDITED = "(SELECT event_id, CASE WHEN event_id % 101 = 0 THEN event_type || '!' ELSE event_type END AS event_type FROM events WHERE event_id % 97 <> 5 UNION ALL SELECT event_id + 10000000, event_type FROM events WHERE event_id % 89 = 1)"
DIFF = f"""(SELECT coalesce(a.event_id, b.event_id) AS event_id, a.event_type AS ta, b.event_type AS tb,
    CASE WHEN b.event_id IS NULL THEN 'missing' WHEN a.event_id IS NULL THEN 'extra' WHEN a.event_type = b.event_type THEN 'match' ELSE 'diff' END AS status
    FROM (SELECT event_id, event_type FROM events) a FULL JOIN {EDITED} b ON a.event_id = b.event_id)"""


def _edited(t: Tables) -> DataFrame:
    e = t.read("events").select("event_id", "event_type")
    changed = F.when(F.col("event_id") % 101 == 0, F.concat("event_type", F.lit("!"))).otherwise(F.col("event_type"))
    return e.filter("event_id % 97 <> 5").withColumn("event_type", changed).unionByName(e.filter("event_id % 89 = 1").withColumn("event_id", F.col("event_id") + 10000000))


def _diff(t: Tables) -> DataFrame:
    return validate.diff(t.read("events").select("event_id", "event_type"), _edited(t), ["event_id"], ["event_type"])


@query(f"SELECT event_id, status FROM {DIFF}", plain=True)
def J15_full_outer_diff(t):
    return _diff(t).select("event_id", "status")


@query(f"SELECT coalesce(family, 'TOTAL') AS family, count_if(status = 'match') AS matched, count_if(status = 'diff') AS diff, count_if(status = 'missing') AS missing, count_if(status = 'extra') AS extra FROM (SELECT coalesce(ta, tb) AS family, status FROM {DIFF}) GROUP BY ROLLUP(family)", plain=True)
def AGG10_breakdown(t):
    return validate.breakdown(_diff(t), F.coalesce("a.event_type", "b.event_type"))


@query(f"SELECT event_id, status FROM {DIFF} WHERE status <> 'match' ORDER BY event_id LIMIT 20", plain=True)
def LIM5_first_differences(t):
    return validate.first_diffs(_diff(t), ["event_id"]).select("event_id", "status")


@query(f"SELECT count_if(status = 'match') AS matched, count_if(status <> 'match') AS different FROM {DIFF}", plain=True)
def V4_validate_tables(t):
    return _diff(t).agg(F.count_if(F.col("status") == "match").alias("matched"), F.count_if(F.col("status") != "match").alias("different"))


@query("SELECT txid, block_hash FROM (SELECT DISTINCT txid, block_hash FROM outputs)")
def J17_transaction_block(t):
    b = t.outputs().groupBy("height", "block_hash").agg(F.collect_set("txid").alias("tx8"))
    return hexed(derive.context(b).select(F.col("tx8").alias("txid"), "block_hash"))


@query("SELECT 0 AS only_a, 0 AS only_b, TRUE AS same", plain=True)
def J18_copy_is_equal(t):
    return bag.same_bag(t.read("events").select("event_id", "event_type"), t.read("events").repartition(4, "event_id").select("event_id", "event_type"))


# --- aggregates ------------------------------------------------------------------------------------------------------------

SPENT = "EXISTS (SELECT 1 FROM pending_spends p WHERE p.prev_txid = txid AND p.prev_vout = vout)"
INFO = f"""(SELECT script_hash, sum(c)::BIGINT AS confirmed, sum(p)::BIGINT AS pending, sum(cn)::BIGINT AS confirmed_count, sum(pn)::BIGINT AS pending_count FROM (
    SELECT script_hash, value AS c, CASE WHEN {SPENT} THEN -value ELSE 0 END AS p, 1 AS cn, 0 AS pn FROM utxo
    UNION ALL SELECT script_hash, 0, CASE WHEN {SPENT} THEN 0 ELSE value END, 0, 1 FROM pending WHERE (txid, vout) NOT IN (SELECT (txid, vout) FROM utxo)) GROUP BY script_hash)"""
UTXOS = f"""(SELECT script_hash, txid, vout, value, height, tip - height + 1 AS confirmations, 0 AS part FROM utxo, tip WHERE {VISIBLE} AND NOT {SPENT}
    UNION ALL SELECT script_hash, txid, vout, value, NULL, 0, 1 FROM pending WHERE NOT {SPENT} AND (txid, vout) NOT IN (SELECT (txid, vout) FROM utxo))"""


def _utxos_of(t: Tables, *numbers: int) -> DataFrame:
    return address.utxos(live_of(t, *numbers), t.pending(), t.pending_spends(), tip_of(t), MATURITY, [script(n) for n in numbers])


def _utxos(t: Tables, **more) -> DataFrame:
    return address.utxos(live(t), t.pending(), t.pending_spends(), tip_of(t), MATURITY, **more)


@query(f"SELECT script_hash, confirmed, pending, confirmed_count, pending_count, confirmed AS received, {amount_sql('confirmed')} AS confirmed_text, {amount_sql('pending')} AS pending_text FROM {INFO}")
def AGG1_balance_info(t):
    return whole(hexed(address.info(live(t), t.pending(), t.pending_spends())))


@query(f"SELECT script_hash, sum(value)::BIGINT AS satoshis, {amount_sql('sum(value)')} AS balance FROM {UTXOS} GROUP BY script_hash")
def AGG2_balance(t):
    return whole(hexed(address.balance(_utxos(t))))


@query("SELECT script_hash, height, block_hash FROM first_seen")
def AGG4_first_seen(t):
    return hexed(derive.first_seen(t.outputs(), SEEN_ORDER))


@query("SELECT 'spk:' || k AS script, height FROM range(3, 6) r(k) LEFT JOIN first_seen ON script_hash = sha256('spk:' || k) UNION ALL SELECT 'spk:none', NULL")
def AGG5_first_seen_of(t):
    asked = t.spark.createDataFrame([(s,) for s in ("spk:3", "spk:4", "spk:5", "spk:none")], "script string")
    return asked.join(derive.first_seen(t.outputs(), SEEN_ORDER).withColumnRenamed("script_hash", "h"), hashing.sha256(F.col("script")) == F.col("h"), "left").select("script", "height")


@query("SELECT height, block_hash FROM blocks ORDER BY height DESC LIMIT 1")
def AGG6_last_block(t):
    return hexed(derive.tip(t.blocks()).select("height", "block_hash"))


@query("SELECT printf('%x', max(height)) AS last_height, sha256('blk:' || max(height)) AS last_hash FROM blocks")
def AGG7_last_markers(t):
    return hexed(derive.tip(t.blocks()).select(F.col("height_hex").alias("last_height"), F.col("block_hash").alias("last_hash")), "last_hash")


@query("SELECT substr(txid, 1, 2) AS family, count(*) AS total FROM utxo GROUP BY 1")
def AGG12_key_prefixes(t):
    return live(t).groupBy(F.lower(F.hex(F.substring("txid", 1, 1))).alias("family")).agg(F.count("*").alias("total"))


@query("SELECT count(*) AS inputs, count(DISTINCT prev_txid) AS transactions FROM pending_spends")
def AGG13_pending_totals(t):
    return t.pending_spends().agg(F.count("*").alias("inputs"), F.count_distinct("prev_txid").alias("transactions"))


@query("SELECT tip AS node, c AS committed, n AS mempool, n = 0 AND c = tip AS ready FROM tip, (SELECT max(height) AS c FROM outputs WHERE coinbase), (SELECT count(*) AS n FROM pending)")
def AGG14_is_quiescent(t):
    one = t.blocks().agg(F.max("height").alias("node")).withColumn("committed", t.outputs().filter("coinbase").agg(F.max("height")).scalar())
    return one.withColumn("mempool", t.pending().agg(F.count("*")).scalar()).withColumn("ready", status.quiescent(F.col("node"), F.col("committed"), F.col("mempool")))


LEAVES = "(SELECT doc_id // 64 AS height, doc_id % 64 AS pos, sha256(sha256(coalesce(text, ''))) AS leaf FROM documents)"


def _leaves(t: Tables) -> DataFrame:
    leaf = hashing.sha256(F.sha2(F.coalesce("text", F.lit("")), 256))
    return t.read("documents").select(F.floor(F.col("doc_id") / 64).alias("height"), (F.col("doc_id") % 64).alias("pos"), leaf.alias("leaf"))


MERKLE = f"""
WITH RECURSIVE leaves AS (SELECT height, pos, unhex(leaf) AS h FROM {LEAVES}),
level AS (SELECT 0 AS lv, height, list(h ORDER BY pos) AS xs FROM leaves GROUP BY height
    UNION ALL SELECT lv + 1, height, list_transform(range((len(xs) + 1) // 2), lambda i: unhex(sha256(unhex(sha256(xs[2 * i + 1] || coalesce(xs[2 * i + 2], xs[2 * i + 1])))))) FROM level WHERE len(xs) > 1)
SELECT height, lower(hex(xs[1])) AS root FROM level WHERE len(xs) = 1"""


@query(MERKLE, plain=True)
def AGG15_merkle_root(t):
    return hexed(validate.merkle_root_levels(_leaves(t)))


@query(MERKLE, plain=True)
def V2_merkle_fold(t):
    return hexed(validate.merkle_roots(_leaves(t)).select("height", "root"))


@query("SELECT event_type, count(*) AS passes, sum(value) AS moved FROM events GROUP BY event_type", plain=True)
def AGG17_pass_counters(t):
    return t.read("events").groupBy("event_type").agg(F.count("*").alias("passes"), F.sum("value").alias("moved"))


# --- windows and order -------------------------------------------------------------------------------------------------


@query(f"SELECT height, block_hash FROM blocks ORDER BY height DESC LIMIT {UNDO}")
def WIN1_last_n_blocks(t):
    return hexed(derive.last_blocks(t.blocks(), UNDO).select("height", "block_hash"))


@query(f"SELECT height, block_hash FROM blocks ORDER BY height DESC LIMIT 1 OFFSET {UNDO}")
def WIN2_evicted_block(t):
    w = Window.orderBy(F.desc("height"))
    return hexed(derive.last_blocks(t.blocks(), UNDO + 1).withColumn("rn", F.row_number().over(w)).filter(F.col("rn") == UNDO + 1).select("height", "block_hash"))


@query("SELECT row_id, height, txid, vout, value FROM (SELECT *, row_number() OVER (ORDER BY height, tx_idx, vout, value, l_partkey, l_quantity, l_shipdate) - 1 AS row_id FROM outputs)")
def WIN3_row_ids(t):
    return whole(hexed(derive.with_row_id(t.outputs(), SEEN_ORDER).select("row_id", "height", "txid", "vout", "value")))


@query("SELECT height, step FROM (SELECT height, height - lag(height) OVER (ORDER BY height) AS step FROM blocks) WHERE step IS NOT NULL")
def WIN4_height_steps(t):
    return validate.lag_gaps(t.blocks())


@query("SELECT height, CASE WHEN NOT first AND before IS NULL THEN 'height' END AS error FROM (SELECT b.height, p.height AS before, b.height = (SELECT min(height) FROM blocks) AS first FROM blocks b LEFT JOIN blocks p ON p.height = b.height - 1)")
def V1_block_sequence(t):
    return validate.linkage(t.blocks()).select("height", "error")


@query("SELECT count(*) AS blocks, min(height) FILTER (bad) AS height, CASE WHEN count_if(bad) > 0 THEN 'height' END AS error FROM (SELECT b.height, p.height IS NULL AND b.height > (SELECT min(height) FROM blocks) AS bad FROM blocks b LEFT JOIN blocks p ON p.height = b.height - 1)")
def V1_first_failure(t):
    return validate.first_failure(validate.linkage(t.blocks()))


@query("SELECT name, first, last, coalesce(first = lag(last) OVER (ORDER BY first) + 1, TRUE) AS follows FROM files")
def WIN6_contiguous_files(t):
    return validate.contiguous(t.files())


@query("""SELECT height, sum(txs) OVER w AS n, avg(txs) OVER w AS per_block, CASE WHEN ts > min(ts) OVER w THEN sum(txs) OVER w / (ts - min(ts) OVER w) END AS per_second
    FROM (SELECT b.height, b.ts, count(DISTINCT txid) AS txs FROM blocks b LEFT JOIN outputs o ON o.height = b.height GROUP BY b.height, b.ts) WINDOW w AS (ORDER BY height RANGE BETWEEN 1000 PRECEDING AND CURRENT ROW)""")
def WIN7_throughput(t):
    per = t.outputs().groupBy("height").agg(F.count_distinct("txid").alias("txs"))
    return metrics.throughput(t.blocks().join(per, "height", "left").select("height", "ts", F.coalesce("txs", F.lit(0)).alias("txs")))


@query("SELECT DISTINCT txid FROM pending ORDER BY txid")
def WIN8_pending_in_order(t):
    return hexed(changes.ordered_distinct(t.pending(), "txid"))


@query("SELECT txid, vout, rn, value FROM out_n WHERE rn > 1")
def WIN9_bag_ordinals(t):
    return whole(hexed(bag.numbered(t.outputs(), bag.OUTPOINT, ORDER).filter("rn > 1").select("txid", "vout", F.col("rn").cast("long").alias("rn"), "value")))


@query("SELECT txid, vout, script_hash FROM utxo ORDER BY script_hash, txid, vout")
def SRT1_key_order(t):
    return hexed(live(t).select("txid", "vout", "script_hash").orderBy("script_hash", "txid", "vout"))


@query("SELECT txid, vout, value FROM utxo WHERE script_hash = sha256('spk:5') AND txid[1:16] > '8000000000000000' ORDER BY txid, vout, value LIMIT 25")
def LIM1_keyset_page(t):
    return whole(hexed(address.page(live_of(t, 5), 25, ("8000000000000000", (1 << 32) - 1)).select("txid", "vout", "value")))


@query("SELECT arg_max(txid[1:16] || ':' || vout, (txid, vout)) AS next_cursor FROM (SELECT txid, vout FROM utxo WHERE script_hash = sha256('spk:5') ORDER BY txid, vout, value LIMIT 40)")
def LIM3_next_cursor(t):
    return address.next_cursor(address.page(live_of(t, 5), 40, None), 40)


@query("SELECT script_hash, txid, vout, value FROM (SELECT *, sum(value) OVER (PARTITION BY script_hash ORDER BY value DESC, txid, vout ROWS UNBOUNDED PRECEDING) AS running FROM utxo) WHERE running - value < 50000000000000")
def LIM6_coin_selection(t):
    return whole(hexed(address.select_coins(live(t), 50_000_000_000_000, ["script_hash"]).select("script_hash", "txid", "vout", "value")))


@query("SELECT count(*) AS n, sum(value)::BIGINT AS total FROM utxo WHERE script_hash = sha256('spk:5')")
def LIM7_paged_drain(t):
    from coinstrata.plans.engine import materialized

    key = bytes.fromhex(script(5))
    mine = materialized(live_of(t, 5).groupBy("script_hash", "txid", "vout").agg(F.count("*").alias("copies"), F.sum("value").cast("decimal(30,0)").alias("value")))
    _, rows = address.drain(mine, key.hex(), 100)
    return rows.agg(F.sum("copies").cast("long").alias("n"), F.sum("value").cast("long").alias("total"))


@query("SELECT bucket, least(5, count(*)) AS n, least(5, count(*)) AS of_table FROM (SELECT txid[1:3] AS bucket FROM utxo) GROUP BY bucket")
def SMP1_hashed_sample(t):
    key = F.concat("txid", F.col("vout").cast("string").cast("binary"))
    rows = live(t).withColumn("bucket", F.substring(F.lower(F.hex("txid")), 1, 3))
    drawn = validate.hashed_sample(rows, ["bucket"], key, 5).withColumn("key", key)
    known = t.outputs().select(key.alias("key"), F.lit(1).alias("hit")).distinct()
    return drawn.join(known, "key", "left").groupBy("bucket").agg(F.count("*").alias("n"), F.count("hit").alias("of_table"))


@query("SELECT event_type AS family, count(*) AS sampled, count_if(event_id % 10 > 1) AS exact, count_if(event_id % 10 = 0) AS diff, count_if(event_id % 10 = 1) AS miss FROM events GROUP BY event_type", plain=True)
def V5_spot_check(t):
    # every row is drawn; the truth is wrong in one of ten rows and lacks another
    e = t.read("events").select(F.col("event_type").alias("family"), "event_id", F.col("user_id").cast("string").alias("value"))
    truth = e.filter("event_id % 10 <> 1").withColumn("value", F.when(F.col("event_id") % 10 == 0, F.lit("?")).otherwise(F.col("value")))
    drawn = validate.hashed_sample(e, ["family"], F.col("event_id"), 1 << 30)
    return validate.lookup_summary(validate.lookup(drawn, truth, ["event_id"], "value").select("family", "status"), ["family"])


# --- sets --------------------------------------------------------------------------------------------------------------


@query(f"SELECT script_hash, txid, vout, value, height, confirmations, part FROM {UTXOS}")
def SET1_confirmed_and_pending(t):
    return whole(hexed(_utxos(t).select("script_hash", "txid", "vout", "value", "height", "confirmations", "part")))


@query("SELECT 'gone' AS side, event_id FROM events WHERE ts < TIMESTAMP '2024-01-10' UNION ALL SELECT 'new', event_id FROM events WHERE ts >= TIMESTAMP '2024-01-21'", plain=True)
def SET2_mempool_diff(t):
    e = t.read("events")
    gone, new = changes.snapshot_diff(e.filter("ts < timestamp_ntz'2024-01-21 00:00:00'"), e.filter("ts >= timestamp_ntz'2024-01-10 00:00:00'"), "event_id")
    return gone.select(F.lit("gone").alias("side"), "event_id").unionAll(new.select(F.lit("new").alias("side"), "event_id"))


@query("SELECT txid, vout, count(*) AS n FROM utxo GROUP BY txid, vout")
def SET3_outputs_except_spends(t):
    keys = t.outputs().select("txid", "vout").exceptAll(t.spends().select(F.col("prev_txid").alias("txid"), F.col("prev_vout").alias("vout")))
    return hexed(keys.groupBy("txid", "vout").agg(F.count("*").alias("n")))


@query("SELECT count(*) AS n FROM outputs")
def SET4_union_of_parts(t):
    o = t.outputs()
    return o.filter("height < 800").unionByName(o.filter("height >= 800 AND height < 1600")).unionByName(o.filter("height >= 1600")).agg(F.count("*").alias("n"))


@query("SELECT user_id, min(event_id) AS event_id FROM events GROUP BY user_id", plain=True)
def SET5_distinct_in_order(t):
    return changes.distinct_in_order(t.read("events"), "user_id", "event_id")


@query("SELECT 0 AS only_a, 0 AS only_b, TRUE AS same", plain=True)
def SET6_live_equals_bulk(t):
    bulk = live(t).select("txid", "vout", "value", "height")
    half = t.outputs().filter("height < 1200")
    first, _ = spends.apply_batch(half.filter("false"), half, t.spends().filter("spend_height < 0"), ORDER)
    after, _ = spends.apply_batch(first, t.outputs().filter("height >= 1200"), t.spends(), ORDER)
    return bag.same_bag(bulk, after.select("txid", "vout", "value", "height"))


# --- scalar functions ----------------------------------------------------------------------------------------------------


@query(f"SELECT event_id, {amount_sql('(event_id - 500) * 123456789')} AS amount FROM events", plain=True)
def FN1_amount_text(t):
    return t.read("events").select("event_id", amount_text((F.col("event_id") - 500) * 123456789).alias("amount"))


@query("SELECT doc_id, sha256(text) AS script_hash, sha256(unhex(sha256(text))) AS hash256 FROM documents", plain=True)
def FN2_FN3_hashes(t):
    x = F.col("text").cast("binary")
    return hexed(t.read("documents").select("doc_id", hashing.script_hash(x).alias("script_hash"), hashing.hash256(x).alias("hash256")))


REVERSED = "list_reduce(list_reverse(regexp_extract_all({0}, '..')), lambda a, b: a || b)"


@query(f"SELECT doc_id, {REVERSED.format('sha256(unhex(sha256(text)))')} AS block_id FROM documents", plain=True)
def FN4_FN5_reversed_hash(t):
    return hexed(t.read("documents").select("doc_id", hashing.block_id(F.col("text").cast("binary")).alias("block_id")))


@query("SELECT event_id, lower(hex(unhex(sha256('ev:' || event_id)))) AS h, printf('%08x', user_id) AS u, sha256('ev:' || event_id)[1:16] AS prefix FROM events", plain=True)
def FN7_FN9_FN10_codes(t):
    h = F.sha2(F.concat(F.lit("ev:"), F.col("event_id").cast("string")), 256)
    return t.read("events").select("event_id", hashing.to_hex(hashing.from_hex(h)).alias("h"), hashing.to_hex(hashing.u32(F.col("user_id"))).alias("u"), hashing.to_hex(hashing.prefix8(F.unhex(h))).alias("prefix"))


HEIGHTS = "(SELECT event_id, CASE WHEN event_id % 11 = 0 THEN -1 ELSE event_id % 50 END AS committed, CASE WHEN event_id % 13 = 0 THEN -1 ELSE event_id % 47 + 2 END AS node, event_id % 2 = 0 AS synced, event_id % 3 = 0 AS reconverged, event_id % 29 = 0 AS halted FROM events)"


def _heights(t: Tables) -> DataFrame:
    e = F.col("event_id")
    return t.read("events").select("event_id", F.when(e % 11 == 0, -1).otherwise(e % 50).alias("committed"), F.when(e % 13 == 0, -1).otherwise(e % 47 + 2).alias("node"), (e % 2 == 0).alias("synced"), (e % 3 == 0).alias("reconverged"), (e % 29 == 0).alias("halted"))


@query(f"""SELECT event_id, lag, ok AS synced, ok AND reconverged AS mempool_ready, CASE WHEN halted THEN 'reorg' END AS halt_reason FROM
    (SELECT *, synced AND coalesce(lag >= 0, TRUE) AS ok FROM (SELECT *, CASE WHEN committed >= 0 AND node >= 0 THEN node - committed END AS lag FROM {HEIGHTS}))""", plain=True)
def FN14_freshness(t):
    f = status.freshness(F.col("committed"), F.col("node"), F.col("synced"), F.col("reconverged"), F.col("halted"), F.lit("reorg"))
    return _heights(t).select("event_id", f.alias("f")).select("event_id", "f.lag", "f.synced", "f.mempool_ready", "f.halt_reason")


@query(f"SELECT event_id, coalesce(CASE WHEN committed >= 0 AND node >= 0 THEN node - committed BETWEEN 0 AND 3 END, FALSE) AS synced FROM {HEIGHTS}", plain=True)
def FN15_synced_verdict(t):
    return _heights(t).select("event_id", status.synced_verdict(status.lag(F.col("committed"), F.col("node"))).alias("synced"))


@query(f"SELECT event_id, CASE WHEN halted THEN 'halted' WHEN synced THEN 'healthy' ELSE 'unhealthy' END AS health, CASE WHEN halted THEN 'halted' WHEN NOT synced THEN 'degraded' WHEN reconverged THEN 'stalled' ELSE 'ok' END AS status, CASE WHEN NOT halted AND synced AND NOT reconverged THEN 200 ELSE 503 END AS code FROM {HEIGHTS}", plain=True)
def FN16_API9_status(t):
    s = status.service_status(F.col("halted"), F.col("synced"), F.col("reconverged"))
    return _heights(t).select("event_id", status.health(F.col("halted"), F.col("synced")).alias("health"), s.alias("s")).select("event_id", "health", "s.status", "s.code")


@query("SELECT event_id, CASE WHEN event_id % 7 = 0 THEN FALSE ELSE 200000 - (event_id % 400) * 1000 > 150000 END AS stale FROM events", plain=True)
def FN17_node_stale(t):
    e = F.col("event_id")
    return t.read("events").select("event_id", status.node_stale(F.when(e % 7 != 0, e % 400 * 1000), F.lit(200000)).alias("stale"))


@query("SELECT event_id, printf('%dd %02dh%02dm%02d.%ds', ms // 86400000, ms // 3600000 % 24, ms // 60000 % 60, ms // 1000 % 60, ms // 100 % 10) AS clock FROM (SELECT event_id, event_id * 98765 AS ms FROM events)", plain=True)
def FN18_clock_text(t):
    return t.read("events").select("event_id", text.clock_text(F.col("event_id") * 98765).alias("clock"))


@query("SELECT event_id, CASE WHEN ms < 1000 THEN '0s' ELSE concat_ws(' ', CASE WHEN ms >= 86400000 THEN (ms // 86400000) || 'd' END, CASE WHEN ms // 3600000 % 24 > 0 THEN (ms // 3600000 % 24) || 'h' END, CASE WHEN ms // 60000 % 60 > 0 THEN (ms // 60000 % 60) || 'm' END, CASE WHEN ms // 1000 % 60 > 0 THEN (ms // 1000 % 60) || 's' END) END AS clock FROM (SELECT event_id, event_id * 98765 AS ms FROM events)", plain=True)
def FN19_short_clock_text(t):
    return t.read("events").select("event_id", text.short_clock_text(F.col("event_id") * 98765).alias("clock"))


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'BTC' WHEN 1 THEN 'LTC' WHEN 2 THEN 'DOGE' END AS tick FROM events", plain=True)
def FN20_coin_from_network(t):
    n = F.element_at(F.array(*[F.lit(x) for x in ("bitcoin-mainnet", "Litecoin-testnet", "dogecoin", "other-net")]), (F.col("event_id") % 4 + 1).cast("int"))
    return t.read("events").select("event_id", config.coin_of_column(n).alias("tick"))


@query("SELECT doc_id, lower(nullif(regexp_extract(text, '\\b[0-9a-fA-F]{64}\\b'), '')) AS checksum FROM (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN upper(sha256(text)) || '  file.tar.gz' ELSE left(sha256(text), 60) END AS text FROM documents)", plain=True)
def FN32_checksum_of(t):
    s = F.sha2("text", 256)
    return t.read("documents").select("doc_id", text.checksum_of(F.when(F.col("doc_id") % 2 == 0, F.concat(F.upper(s), F.lit("  file.tar.gz"))).otherwise(F.substring(s, 1, 60))).alias("checksum"))


@query("SELECT doc_id, left(hex, 96) || CASE WHEN len(hex) > 96 THEN '...+' || (len(hex) // 2 - 48) ELSE '' END AS short FROM (SELECT doc_id, lower(hex(encode(text))) AS hex FROM documents)", plain=True)
def FN36_hex_short(t):
    return t.read("documents").select("doc_id", text.hex_short(F.col("text").cast("binary")).alias("short"))


@query("SELECT event_id, printf('blocks-bitcoin-mainnet-%08d-%08d.xdmp', event_id * 100, event_id * 100 + 99) AS name FROM events", plain=True)
def FN37_chunk_name(t):
    e = F.col("event_id") * 100
    return t.read("events").select("event_id", text.chunk_name(F.lit("bitcoin"), F.lit("mainnet"), e, e + 99).alias("name"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE ['a' || event_id, 'b'] END AS origins FROM events", plain=True)
def FN29_origins(t):
    raw = F.when(F.col("event_id") % 3 == 0, " , ").otherwise(F.concat(F.lit("a"), F.col("event_id").cast("string"), F.lit(" ,, b")))
    return t.read("events").select("event_id", text.origins(raw).alias("origins"))


@query("SELECT DISTINCT left(key, 2) AS byte, chr(('0x' || left(key, 2))::INT) AS label FROM (SELECT txid AS key FROM utxo) WHERE ('0x' || left(key, 2))::INT BETWEEN 33 AND 126")
def FN30_key_label(t):
    rows = live(t).select(F.substring("txid", 1, 1).alias("k")).distinct()
    return rows.select(F.lower(F.hex("k")).alias("byte"), text.key_label(F.col("k")).alias("label")).filter(~F.col("label").startswith("0x"))


@query("SELECT doc_id, sha256('{\"doc_id\":' || doc_id || ',\"lang\":\"' || lang || '\"}') AS h FROM documents", plain=True)
def FN26_record_hash(t):
    return t.read("documents").select("doc_id", text.record_hash("doc_id", "lang").alias("h"))


# --- streaming state, as of a batch --------------------------------------------------------------------------------------


@query(f"SELECT min(b.height) AS fork, (SELECT tip FROM tip) - min(b.height) + 1 AS depth, TRUE AS recoverable FROM blocks b LEFT JOIN {BRANCH} n ON n.height = b.height WHERE n.block_hash IS NULL OR n.block_hash <> b.block_hash")
def STR5_rollback_plan(t):
    return spends.rollback_plan(t.blocks(), _branch(t), UNDO)


@query("SELECT txid, vout, value, height FROM out_n o WHERE height < 2000 AND NOT EXISTS (SELECT 1 FROM matched m WHERE m.txid = o.txid AND m.vout = o.vout AND m.value = o.value AND m.height = o.height AND m.spend_height < 2000 AND EXISTS (SELECT 1 FROM spend_n s WHERE s.prev_txid = o.txid AND s.prev_vout = o.vout AND s.rn = o.rn AND s.spend_height = m.spend_height))")
def STR6_undo_blocks(t):
    matched = spends.match(t.outputs(), t.spends(), ORDER)
    return whole(hexed(spends.undo_above(live(t).select("txid", "vout", "value", "height"), spends.archive(matched), 2000)))


@query("SELECT spend_height, count(*) AS n FROM matched, tip WHERE height < spend_height AND spend_height > tip - 48 GROUP BY spend_height")
def STR4_kept_undo(t):
    a = spends.archive(spends.match(t.outputs(), t.spends(), ORDER))
    return a.filter(F.col("spend_height") > tip_of(t) - UNDO).groupBy("spend_height").agg(F.count("*").alias("n"))


@query("SELECT script_hash, height FROM first_seen WHERE height < 3")
def STR9_first_seen_below_fork(t):
    return hexed(derive.first_seen(t.outputs(), SEEN_ORDER).filter("height < 3").select("script_hash", "height"))


@query("SELECT txid, vout FROM pending WHERE txid NOT IN (SELECT sha256('ev:' || event_id) FROM events WHERE event_id % 5 = 0)")
def STR16_confirmed_leave_mempool(t):
    mined = t.read("events").filter("event_id % 5 = 0").select(hashing.sha256(F.concat(F.lit("ev:"), F.col("event_id").cast("string"))).alias("txid"))
    return hexed(changes.drop_of(t.pending(), mined, "txid").select("txid", "vout"))


@query("SELECT txid, vout FROM pending WHERE txid NOT IN (SELECT sha256('ev:' || event_id) FROM events WHERE event_id % 7 = 1)")
def STR17_dropped_leave_mempool(t):
    gone = t.read("events").filter("event_id % 7 = 1").select(hashing.sha256(F.concat(F.lit("ev:"), F.col("event_id").cast("string"))).alias("txid"))
    return hexed(changes.drop_of(t.pending(), gone, "txid").select("txid", "vout"))


@query("SELECT txid, vout, spender_txid FROM matched WHERE value IS NULL")
def STR26_unknown_inputs(t):
    return hexed(spends.anomalies(spends.match(t.outputs(), t.spends(), ORDER)).select("txid", "vout", "spender_txid"))


def _store(t: Tables, undo: int = 2000):
    """A new store under the checkpoint folder."""
    import uuid

    from coinstrata.plans.engine import shared_folder
    from coinstrata.streaming.store import Store

    return Store(t.spark, f"{shared_folder(t.spark)}/store-{uuid.uuid4()}", undo)


def _commit(store, t: Tables, name: str, low: int, high: int) -> None:
    here = lambda c: (F.col(c) >= low) & (F.col(c) < high)
    store.commit(name, t.outputs().filter(here("height")), t.spends().filter(here("spend_height")), t.blocks().filter(here("height")))


@query("SELECT txid, vout, value, height FROM utxo")
def STR1_committed_batches(t):
    store = _store(t)
    for k, (low, high) in enumerate(((0, 900), (900, 1800), (1800, 1 << 20))):
        _commit(store, t, f"b{k}", low, high)
    _commit(store, t, "b2", 1800, 1 << 20)  # a batch that comes again does nothing
    return whole(hexed(store.utxo().select("txid", "vout", "value", "height")))


@query("SELECT txid, vout, value, height FROM utxo")
def STR5_reorganised_chain(t):
    store = _store(t)
    _commit(store, t, "a", 0, 1200)
    _commit(store, t, "wrong", 1200, 1600)
    store.rollback(1200)
    _commit(store, t, "right", 1200, 1 << 20)
    return whole(hexed(store.utxo().select("txid", "vout", "value", "height")))


@query("SELECT txid, vout, value, height FROM utxo")
def STR4_compacted_store(t):
    store = _store(t, 48)
    _commit(store, t, "a", 0, 1500)
    store.compact()
    _commit(store, t, "b", 1500, 1 << 20)
    store.compact()
    return whole(hexed(store.utxo().select("txid", "vout", "value", "height")))


@query("SELECT script_hash, height FROM first_seen")
def SNK9_store_first_seen(t):
    store = _store(t, 48)
    _commit(store, t, "a", 0, 2)
    _commit(store, t, "b", 2, 1 << 20)
    store.compact()
    return hexed(store.first_seen().select("script_hash", "height"))


@query("SELECT tip AS height, sha256('blk:' || tip) AS block_hash, (SELECT count(*) FROM utxo) AS outputs FROM tip")
def API11_snapshot(t):
    from coinstrata.streaming.store import Store

    store = _store(t)
    _commit(store, t, "all", 0, 1 << 20)
    store.export(f"{store.root}/snapshot")
    again = Store.restore(t.spark, f"{store.root}/snapshot", f"{store.root}/again")
    height, block_hash = again.tip()
    return again.utxo().agg(F.lit(height).alias("height"), F.lit(block_hash).alias("block_hash"), F.count("*").alias("outputs"))


@query("SELECT doc_id AS height, sha256(text) AS script_hash, n_chars AS value, FALSE AS coinbase FROM documents", plain=True)
def DEC1_decode_blocks(t):
    from collections.abc import Iterator

    from coinstrata.sources import codec, files

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            made = []
            for i, text_, n in zip(b["doc_id"], b["text"], b["n_chars"]):
                tx = codec.Tx(1, [(b"\1" * 32, int(i), b"", 0)], [(int(n), text_.encode())])
                made.append(codec.Block(codec.make_header(b"\0" * 32, tx.txid()[::-1], int(i)), [tx]).encode())
            yield pd.DataFrame({"height": b["doc_id"].astype("int32"), "block": made})

    blocks = t.read("documents").select("doc_id", "text", "n_chars").mapInPandas(encode, "height int, block binary")
    return whole(hexed(files.facts(files.decode(blocks))[0].select("height", "script_hash", "value", "coinbase")))


@query("SELECT event_id, '76a914' || sha256('ev:' || event_id)[1:40] || '88ac' AS script, 'p2pkh' AS type FROM events", plain=True)
def FN11_FN12_addresses(t):
    from coinstrata.functions import addresses

    @F.pandas_udf("string")
    def address_of(h: pd.Series) -> pd.Series:
        return h.map(lambda x: addresses.base58check_encode(b"\0" + bytes(x)[:20]))

    h = hashing.sha256(F.concat(F.lit("ev:"), F.col("event_id").cast("string")))
    rows = t.read("events").select("event_id", address_of(h).alias("a"))
    return hexed(rows.select("event_id", addresses.script_column(F.col("a"), "bitcoin-mainnet").alias("script"), addresses.type_column(F.col("a"), "bitcoin-mainnet").alias("type")))


@query("SELECT name, last, block_hash, last < 2390 AND height IS NOT NULL AS reusable FROM files LEFT JOIN blocks ON height = last")
def V8_reusable_chunks(t):
    from coinstrata.plans.archive import chunks_match

    ours = t.files().join(t.blocks().select(F.col("height").alias("last"), "block_hash"), "last", "left")
    return hexed(chunks_match(ours, _branch(t)).select("name", "last", "block_hash", "reusable"))


@query(FAMILIES_SQL + " SELECT family, count(*) AS wrong FROM fam WHERE key LIKE '4f0a%' OR key LIKE '48a0%' GROUP BY family")
def V6_record_widths(t):
    # keys of some families are cut short on the way
    bad = hashing.has_prefix(F.col("key"), "4f0a") | hashing.has_prefix(F.col("key"), "48a0")
    return validate.widths(_families(t).withColumn("key", F.when(bad, F.substring("key", 1, 9)).otherwise(F.col("key"))), derive.WIDTHS)


@query("SELECT 'K' AS family, count(*) AS n FROM matched m WHERE height < spend_height UNION ALL SELECT 'M', count(*) FROM matched m WHERE height < spend_height")
def J7_archive_families(t):
    matched = spends.archive(spends.match(t.outputs(), t.spends(), ORDER)).withColumn("spend_block_hash", hashing.sha256(F.concat(F.lit("blk:"), F.col("spend_height").cast("string"))))
    return derive.undo_archive(matched).groupBy("family").agg(F.count("*").alias("n"))


@query("SELECT depth, height FROM (SELECT row_number() OVER (ORDER BY height DESC) - 1 AS depth, height FROM blocks) WHERE depth < 48")
def STR5_walk_back(t):
    # the walk goes along previous hashes, within the undo window
    near = hexed(derive.last_blocks(t.blocks(), UNDO).select("block_hash", "prev_hash", "height"))
    tip = near.orderBy(F.desc("height")).first()["block_hash"]
    return spends.walk_back(near, tip).select("depth", "height")


LOW = """, low_o AS (SELECT *, row_number() OVER (PARTITION BY txid, vout ORDER BY height, value, script_hash, l_partkey, l_quantity, l_shipdate) AS n FROM outputs WHERE height < 1200),
low_s AS (SELECT *, row_number() OVER (PARTITION BY prev_txid, prev_vout ORDER BY spend_height, spender_txid) AS n FROM spends WHERE spend_height < 1200)
SELECT txid, vout, value, height FROM low_o o WHERE NOT EXISTS (SELECT 1 FROM low_s s WHERE s.prev_txid = o.txid AND s.prev_vout = o.vout AND s.n = o.n)"""


@query(LOW)
def STR13_follow_the_node(t):
    store = _store(t)
    _commit(store, t, "a", 0, 1200)
    _commit(store, t, "b", 1200, 1 << 20)
    other = F.when(F.col("height") < 1200, F.col("block_hash")).otherwise(hashing.sha256(F.col("block_hash")))
    store.follow(t.blocks().select("height", other.alias("block_hash")))  # the node has other blocks from 1200 on
    return whole(hexed(store.utxo().select("txid", "vout", "value", "height")))


@query("SELECT tip AS height, sha256('blk:' || tip) AS block_hash, (SELECT count(*) FROM blocks) AS blocks FROM tip")
def SNK10_tip_after_commits(t):
    store = _store(t)
    _commit(store, t, "a", 0, 1500)
    _commit(store, t, "b", 1500, 1 << 20)
    height, block_hash = store.tip()
    return store.blocks().agg(F.lit(height).alias("height"), F.lit(block_hash).alias("block_hash"), F.count("*").alias("blocks"))


_built: dict[tuple[str, str], object] = {}


def settled_store(t: Tables):
    """A store of all blocks, settled but for the last ones; built once a session and folder."""
    key = (t.spark.sparkContext.applicationId, t.sf_dir)
    if key not in _built:
        store = _store(t, 100)
        _commit(store, t, "all", 0, 1 << 20)
        store.compact()
        _built[key] = store
    return _built[key]


@query("SELECT script_hash, txid, vout, value, height FROM utxo WHERE script_hash IN (SELECT sha256('spk:' || n) FROM range(1, 51) r(n))")
def SRC26_many_scripts_of_store(t):
    rows = settled_store(t).utxo_of([script(n) for n in range(1, 51)])
    return whole(hexed(rows.select("script_hash", "txid", "vout", "value", "height")))


@query("SELECT txid, vout, value, height FROM utxo WHERE script_hash = sha256('spk:5')")
def API2_script_of_store(t):
    return whole(hexed(settled_store(t).utxo_of([script(5)]).select("txid", "vout", "value", "height")))


@query(f"SELECT txid, vout, value, height, confirmations, part FROM {UTXOS} WHERE script_hash = sha256('spk:9') AND part = 0 AND txid[1:16] > '8000000000000000'")
def LIM4_later_page(t):
    rows = address.utxos(live_of(t, 9), t.pending(), t.pending_spends(), tip_of(t), MATURITY, [script(9)], None, ("8000000000000000", (1 << 32) - 1))
    return whole(hexed(rows.select("txid", "vout", "value", "height", "confirmations", "part")))


@query("SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'diff' WHEN 1 THEN 'miss' ELSE 'exact' END AS status FROM events", plain=True)
def J16_lookup(t):
    e = t.read("events").select("event_id", "event_type")
    truth = e.filter("event_id % 3 <> 1").withColumn("event_type", F.when(F.col("event_id") % 3 == 0, F.lit(None)).otherwise(F.col("event_type")))
    return validate.lookup(e, truth, ["event_id"], "event_type").select("event_id", "status")


def _text_udf(f):
    return F.pandas_udf(lambda x: x.map(f).astype(object), "string")


@query("SELECT event_id, CASE WHEN n < 253 THEN printf('%02x', n) WHEN n < 65536 THEN printf('fd%02x%02x', n % 256, n // 256) ELSE printf('fe%02x%02x%02x%02x', n % 256, n // 256 % 256, n // 65536 % 256, n // 16777216) END AS coded, n AS back FROM (SELECT event_id, (event_id * 7919) % (CASE event_id % 3 WHEN 0 THEN 300 WHEN 1 THEN 70000 ELSE 4294967296 END) AS n FROM events)", plain=True)
def DEC8_varints(t):
    from coinstrata.sources import codec

    span = F.when(F.col("event_id") % 3 == 0, F.lit(300)).when(F.col("event_id") % 3 == 1, F.lit(70_000)).otherwise(F.lit(1 << 32))
    rows = t.read("events").select("event_id", ((F.col("event_id") * 7919) % span).alias("n"))
    coded = rows.withColumn("coded", _text_udf(lambda n: codec.varint(int(n)).hex())(F.col("n")))
    return coded.select("event_id", "coded", _text_udf(lambda x: str(codec.Reader(bytes.fromhex(x)).varint()))(F.col("coded")).cast("long").alias("back"))


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN event_id + 1 ELSE 7 END AS n FROM events", plain=True)
def FN25_env_numbers(t):
    raw = F.when(F.col("event_id") % 4 == 0, (F.col("event_id") + 1).cast("string")).when(F.col("event_id") % 4 == 1, F.lit("x1")).when(F.col("event_id") % 4 == 2, F.lit("-3")).otherwise(F.lit(""))
    return t.read("events").select("event_id", _text_udf(lambda x: str(config.env_int(x, 7, 1)))(raw).cast("long").alias("n"))


@query("SELECT event_id, '{\"a\":' || user_id || ',\"b\":[' || event_id || ',null],\"c\":\"' || event_type || '\"}' AS line FROM events", plain=True)
def FN23_canonical_json(t):
    e = F.to_json(F.struct(F.col("event_type").alias("c"), F.col("user_id").alias("a"), F.array(F.col("event_id"), F.lit(None)).alias("b")), {"ignoreNullFields": "false"})
    return t.read("events").select("event_id", _text_udf(lambda x: config.canonical_json(json.loads(x)))(e).alias("line"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN sha256('ev:' || event_id) || sha256('ev:' || event_id) END AS signature FROM events", plain=True)
def FN33_detached_signature(t):
    h = hashing.sha256(F.concat(F.lit("ev:"), F.col("event_id").cast("string")))
    word = F.when(F.col("event_id") % 3 == 0, F.lit("v1 ed25519 ")).when(F.col("event_id") % 3 == 1, F.lit("v2 ed25519 ")).otherwise(F.lit("v1 rsa "))
    return hexed(t.read("events").select("event_id", text.signature_of(F.concat(word, F.regexp_replace(F.base64(F.concat(h, h)), r"\s", ""), F.lit("\n"))).alias("signature")))


@query("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN event_id * 10 END AS original_size FROM events", plain=True)
def FN31_gzip_comment(t):
    head = F.when(F.col("event_id") % 2 == 0, F.concat(F.unhex(F.lit("1f8b0810")), F.encode(F.concat(F.lit('{"original_size": '), (F.col("event_id") * 10).cast("string"), F.lit("}")), "UTF-8"), F.unhex(F.lit("00ff")))).otherwise(F.unhex(F.lit("1f8b0800ff7b01")))
    return t.read("events").select("event_id", text.gzip_comment(head)["original_size"].alias("original_size"))


@query("SELECT txid, vout, CASE WHEN height % 5 = 0 THEN 0 ELSE (SELECT tip FROM tip) - height + 1 END AS confirmations FROM outputs")
def FN13_confirmations(t):
    height = F.when(F.col("height") % 5 != 0, F.col("height"))
    depth = status.confirmations(F.lit(tip_of(t)), height)
    return hexed(t.outputs().select("txid", "vout", F.coalesce(depth, F.lit(0)).alias("confirmations")))


# --- metrics -----------------------------------------------------------------------------------------------------------


@query("SELECT event_type, sum(greatest(value, 0)) AS value FROM events GROUP BY event_type", plain=True)
def MET1_counters(t):
    return metrics.counters(t.read("events"), ["event_type"])


@query("SELECT event_type, max(value) AS value FROM events GROUP BY event_type", plain=True)
def MET1_monotonic(t):
    return metrics.monotonic(t.read("events"), ["event_type"])


@query("SELECT event_type, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY event_type", plain=True)
def MET2_gauges(t):
    return metrics.gauges(t.read("events"), ["event_type"])


@query("SELECT event_type, count_if(value <= 1) AS le_1, count_if(value <= 10) AS le_10, count_if(value <= 50) AS le_50, count(*) AS n, sum(value) AS total FROM events GROUP BY event_type", plain=True)
def MET3_histograms(t):
    return metrics.histograms(t.read("events"), ["event_type"], [1, 10, 50])


@query("SELECT event_type, greatest(count(DISTINCT user_id) - 50, 0) AS dropped FROM events GROUP BY event_type HAVING count(DISTINCT user_id) > 50", plain=True)
def MET5_series_cap(t):
    series = t.read("events").groupBy("event_type", "user_id").agg(F.min("event_id").alias("first"))
    return metrics.capped(series, "event_type", "user_id", "first", 50)[1]


@query("SELECT event_type || '{user=\"' || user_id || '\"} ' || n AS line FROM (SELECT event_type, user_id, count(*) AS n FROM events GROUP BY ALL)", plain=True)
def MET4_exposition(t):
    series = t.read("events").groupBy("event_type", "user_id").agg(F.count("*").cast("double").alias("n"))
    return metrics.exposition(series.withColumn("user_id", F.col("user_id").cast("string")), "event_type", "user", "user_id", "n")


@query("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'user=x password=[redacted] ok' ELSE 'plain ' || event_id END AS line FROM events", plain=True)
def MET9_scrub(t):
    e = F.col("event_id")
    return t.read("events").select("event_id", text.scrub(F.when(e % 2 == 0, F.concat(F.lit("user=x password=p"), e.cast("string"), F.lit(" ok"))).otherwise(F.concat(F.lit("plain "), e.cast("string")))).alias("line"))


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN '/utxos' WHEN 1 THEN '/status' WHEN 2 THEN 'rpc' ELSE 'other' END AS route FROM events", plain=True)
def MET15_route_label(t):
    p = F.element_at(F.array(F.concat(F.lit("/utxos/"), F.col("user_id").cast("string")), F.lit("/status"), F.lit("/"), F.lit("/x")), (F.col("event_id") % 4 + 1).cast("int"))
    return t.read("events").select("event_id", text.route_label(p).alias("route"))


# --- service -------------------------------------------------------------------------------------------------------------


@query(f"SELECT txid, vout, value, height, confirmations, part, {amount_sql('value')} AS amount FROM {UTXOS} WHERE script_hash = sha256('spk:9')")
def API1_utxos(t):
    return whole(hexed(_utxos_of(t, 9).select("txid", "vout", "value", "height", "confirmations", "part", "amount")))


@query(f"SELECT {amount_sql('sum(value)')} AS balance FROM {UTXOS} WHERE script_hash = sha256('spk:9')")
def API3_balance(t):
    return address.balance(_utxos_of(t, 9)).select("balance")


@query(f"SELECT confirmed, pending, {amount_sql('pending')} AS pending_text FROM {INFO} WHERE script_hash = sha256('spk:9')")
def API4_info(t):
    rows = address.info(live_of(t, 9), t.pending(), t.pending_spends(), [script(9)])
    return whole(rows.select("confirmed", "pending", "pending_text"))


@query("SELECT tip AS committed_height, tip + 2 AS node_height, 2 AS lag, TRUE AS synced FROM tip")
def API6_sync_status(t):
    one = t.blocks().agg(F.max("height").alias("c")).withColumn("n", F.col("c") + 2)
    behind = status.lag(F.col("c"), F.col("n"))
    return one.select(F.col("c").alias("committed_height"), F.col("n").alias("node_height"), behind.alias("lag"), status.synced_verdict(behind).alias("synced"))


def holders(t: Tables) -> DataFrame:
    """Scripts with the largest unspent sums."""
    sums = live(t).groupBy("script_hash").agg(F.count("*").alias("outputs"), F.sum("value").cast("decimal(30,0)").alias("satoshis"))
    return sums.orderBy(F.desc("satoshis"), "script_hash").limit(20).select("script_hash", "outputs", "satoshis", amount_text(F.col("satoshis")).alias("amount"))


@query(f"SELECT script_hash, count(*) AS outputs, sum(value)::BIGINT AS satoshis, {amount_sql('sum(value)')} AS amount FROM utxo GROUP BY script_hash ORDER BY satoshis DESC, script_hash LIMIT 20")
def top_holders(t):
    return whole(hexed(holders(t)))
