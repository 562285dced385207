"""Registered queries of byte formats, files, node calls and arguments, each with SQL that returns the same rows.

Bytes are put together by column expressions and read by the codec, or written by the codec and read back; events stand in
for transactions and blocks.
"""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coinstrata.functions import config, hashing, text
from coinstrata.plans.engine import settled_end
from coinstrata.plans.queries import _commit, _store, _text_udf, hexed, query, whole
from coinstrata.sources import codec, files, node

#: Events of a file.
PART = 100
EV = "sha256('ev:' || event_id)"


def _id() -> Column:
    return F.col("event_id")


def _event() -> Column:
    return hashing.sha256(F.concat(F.lit("ev:"), _id().cast("string")))


def _le(n: Column, size: int = 4) -> Column:
    return hashing.reverse_bytes(hashing.u32(n) if size == 4 else hashing.u64(n))


def _raw(hex_digits: str) -> Column:
    return F.unhex(F.lit(hex_digits))


def le_sql(n: str, size: int = 4) -> str:
    return "printf('" + "%02x" * size + "', " + ", ".join(f"(({n}) // {256**i}) % 256" for i in range(size)) + ")"


def _json_udf(f: Callable, schema: str):
    """f's dict of a value, as a struct."""
    made = F.pandas_udf(lambda x: x.map(lambda v: json.dumps(f(v))).astype(object), "string")
    return lambda c: F.from_json(made(c), schema)


# --- transactions, merge-mined blocks, numbers ---------------------------------------------------------------------------

TX_SQL = f"'02000000' || '01' || {EV} || {le_sql('user_id')} || '0151' || 'feffffff' || '01' || {le_sql('event_id * 1000003', 8)} || '1976a914' || {EV}[1:40] || '88ac' || {le_sql('event_id')}"


@query(f"SELECT event_id, 2 AS version, {EV} AS prev, user_id AS idx, event_id * 1000003 AS value, '76a914' || {EV}[1:40] || '88ac' AS script, event_id AS locktime, sha256(unhex(sha256(unhex(tx)))) AS id FROM (SELECT event_id, user_id, {TX_SQL} AS tx FROM events)", plain=True)
def DEC2_transactions(t):
    def fields(data: bytes) -> dict:
        tx = codec.tx_from_bytes(bytes(data))
        (prev, idx, _, _), (value, script) = tx.ins[0], tx.outs[0]
        return {"version": tx.version, "prev": prev.hex(), "idx": idx, "value": value, "script": script.hex(), "locktime": tx.locktime, "id": tx.txid()[::-1].hex()}

    out = F.concat(_raw("1976a914"), F.substring(_event(), 1, 20), _raw("88ac"))
    value = (_id() * 1_000_003).cast("decimal(20,0)")
    tx = F.concat(_raw("0200000001"), _event(), _le(F.col("user_id")), _raw("0151feffffff01"), _le(value, 8), out, _le(_id()))
    read = _json_udf(fields, "version int, prev string, idx long, value long, script string, locktime long, id string")
    return t.read("events").select("event_id", read(tx).alias("x")).select("event_id", "x.*")


PLAIN_SQL = f"(CASE WHEN event_id % 3 = 0 THEN '01000000' ELSE '04010000' END) || {EV} || {EV} || {le_sql('event_id')} || '0000000000000000' || '00'"


@query(f"SELECT event_id, sha256(unhex({PLAIN_SQL})) AS walked, sha256(unhex({PLAIN_SQL})) AS by_length FROM events", plain=True)
def DEC9_DEC10_merge_mined_blocks(t):
    def digests(data: bytes) -> dict:
        import hashlib

        head, block = data[: int.from_bytes(data[-4:], "little")], bytes(data[:-4])
        return {"walked": hashlib.sha256(codec.strip_auxpow(block)).hexdigest(), "by_length": hashlib.sha256(codec.strip_auxpow(block, bytes(head))).hexdigest()}

    coinbase = "0100000001" + "00" * 32 + "ffffffff" + "00" + "ffffffff" + "01" + "05" + "00" * 7 + "0151" + "00000000"
    branch = F.concat(F.unhex(F.lpad(F.hex(_id() % 4), 2, "0")), F.expr("unhex(repeat(hex(unhex(sha2('x', 256))), cast(event_id % 4 as int)))"), _raw("00000000"))
    section = F.concat(_raw(coinbase + "ab" * 32), branch, _raw("00" + "00000000" + "cd" * 80))
    merged = _id() % 3 != 0
    head = F.concat(F.when(merged, _raw("04010000")).otherwise(_raw("01000000")), _event(), _event(), _le(_id()), _raw("00" * 8))
    head = F.when(merged, F.concat(head, section)).otherwise(head)
    data = F.concat(head, _raw("00"), _le(F.octet_length(head)))  # the header's length goes along
    return t.read("events").select("event_id", _json_udf(digests, "walked string, by_length string")(data).alias("x")).select("event_id", "x.*")


@query("SELECT event_id, ((event_id % 10000)::HUGEINT * 1844674407370955)::VARCHAR AS n FROM events", plain=True)
def DEC16_DEC18_unsigned_numbers(t):
    n = ((_id() % 10_000).cast("decimal(5,0)") * F.lit(1_844_674_407_370_955).cast("decimal(16,0)")).cast("decimal(20,0)")
    return t.read("events").select("event_id", _text_udf(lambda x: str(codec.Reader(bytes(x)).number(8)))(_le(n, 8)).alias("n"))


@query(f"SELECT event_id, array_to_string(list_reverse(regexp_extract_all({EV}, '..')), '') AS x FROM events", plain=True)
def FN6_reversed_bytes(t):
    return hexed(t.read("events").select("event_id", hashing.reverse_bytes(_event()).alias("x")))


# --- files -----------------------------------------------------------------------------------------------------------------


def _made(t, make: Callable[[int, list[dict]], bytes]) -> DataFrame:
    """(part, content): a file for each PART events, made by the codec; a group has at most PART rows."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        part = int(rows["part"].iloc[0])
        return pd.DataFrame({"part": [part], "content": [make(part, rows.sort_values("event_id").to_dict("records"))]})

    rows = t.read("events").select(F.floor(_id() / PART).alias("part"), "event_id", "user_id", _event().alias("h"))
    return rows.groupBy("part").applyInPandas(run, "part long, content binary")


def _dump(part: int, rows: list[dict]) -> bytes:
    return codec.raw_file(1, 1, [(r["event_id"], bytes(r["h"]), bytes(r["h"]) * (1 + r["event_id"] % 3)) for r in rows])


def _outputs(part: int, rows: list[dict]) -> bytes:
    made = [{"txid": bytes(r["h"]), "vout": r["user_id"], "value": r["event_id"] * 1_000_003, "height": r["event_id"], "script_hash": bytes(r["h"]), "block_hash": bytes(r["h"]), "coinbase": r["event_id"] % 2 == 0} for r in rows]
    return codec.outputs_file(1, 1, part * PART, part * PART + PART - 1, made, legacy=part % 3 == 0)


def _meta(part: int, rows: list[dict]) -> bytes:
    return codec.meta_file(2, 1, [{"height": r["event_id"], "ts": 1_000_000_000 + r["event_id"], "block_hash": bytes(r["h"]), "prev_hash": bytes(32), "tx8": [bytes(r["h"])[:8]] * (r["event_id"] % 4)} for r in rows])


@query(f"SELECT event_id AS height, {EV} AS block_hash, repeat({EV}, (1 + event_id % 3)::INTEGER) AS block FROM events", plain=True)
def SRC14_dump_files(t):
    return hexed(files.decoded(_made(t, _dump), files.BLOCKS, files.dump_rows).withColumn("height", F.col("height").cast("long")))


@query(f"SELECT event_id AS height, 1000000000 + event_id AS ts, {EV} AS block_hash, repeat('0', 64) AS prev_hash, repeat({EV}[1:16], (event_id % 4)::INTEGER) AS tx8 FROM events", plain=True)
def SRC15_meta_files(t):
    rows = files.decoded(_made(t, _meta), files.META, files.meta_rows)
    joined = F.lower(F.concat_ws("", F.transform("tx8", lambda x: F.hex(x))))
    return hexed(rows.select(F.col("height").cast("long").alias("height"), F.unix_timestamp("ts").alias("ts"), "block_hash", "prev_hash", joined.alias("tx8")))


@query(f"SELECT event_id AS height, {EV} AS txid, user_id AS vout, event_id * 1000003 AS value, event_id % 2 = 0 AND (event_id // 100) % 3 <> 0 AS coinbase FROM events", plain=True)
def SRC16_SRC18_record_files(t):
    rows = files.decoded(_made(t, _outputs), files.OUTPUTS, files.output_rows)
    return whole(hexed(rows.select(F.col("height").cast("long").alias("height"), "txid", "vout", "value", "coinbase")))


@query("SELECT event_id // 100 AS part, (event_id // 100) * 100 AS first, (event_id // 100) * 100 + 99 AS last, count(*) AS n, CASE WHEN (event_id // 100) % 3 = 0 THEN 120 ELSE 121 END AS width, (event_id // 100) % 4 <> 1 AS complete FROM events GROUP BY event_id // 100", plain=True)
def SRC17_V9_file_headers(t):
    def fields(data: bytes) -> dict:
        head = codec.file_header(bytes(data))
        return {"first": head.first, "last": head.last, "n": head.count, "width": head.width, "complete": codec.complete(len(data), head)}

    torn = F.when(F.col("part") % 4 == 1, F.expr("substring(content, 1, octet_length(content) - 1)")).otherwise(F.col("content"))
    read = _json_udf(fields, "first long, last long, n long, width int, complete boolean")
    return _made(t, _outputs).select("part", read(torn).alias("x")).select("part", "x.*")


@query("SELECT event_id // 200 AS pair, min(event_id // 100) * 100 AS first, max(event_id // 100) * 100 + 99 AS last, count(*) AS n, TRUE AS complete FROM events GROUP BY event_id // 200", plain=True)
def SNK19_V7_joined_files(t):
    def join(rows: pd.DataFrame) -> pd.DataFrame:
        data = codec.joined([bytes(c) for c in rows["content"]])
        head = codec.file_header(data)
        return pd.DataFrame({"pair": [int(rows["pair"].iloc[0])], "first": [head.first], "last": [head.last], "n": [head.count], "complete": [codec.complete(len(data), head)]})

    def make(part: int, rows: list[dict]) -> bytes:  # of one width, whatever the part
        return codec.outputs_file(1, 1, part * PART, part * PART + PART - 1, list(codec.records(_outputs(part, rows))))

    pairs = _made(t, make).withColumn("pair", F.floor(F.col("part") / 2))
    return pairs.groupBy("pair").applyInPandas(join, "pair long, first long, last long, n long, complete boolean")


# --- node ------------------------------------------------------------------------------------------------------------------


class EventNode:
    """A node of made-up blocks and transactions that answers batches in reverse order."""

    def call(self, method: str, params: list):
        import hashlib

        digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
        return digest(f"ev:{params[0]}") if method == "getblockhash" else digest(params[0]) if method == "getblock" else None

    def batch(self, calls: list) -> list[dict]:
        out = []
        for i, (method, params) in enumerate(calls):
            if method == "getrawtransaction":
                known = int(params[0][-1], 16) % 3 > 0
                out.append({"id": i, "result": params[0][:8]} if known else {"id": i, "result": None, "error": {"code": node.UNKNOWN_TX, "message": "gone"}})
            else:
                out.append({"id": i, "result": self.call(method, params)})
        return out[::-1]


@query(f"SELECT {EV} AS txid, CASE WHEN {EV}[64:64] NOT IN ('0', '3', '6', '9', 'c', 'f') THEN {EV}[1:8] END AS raw FROM events", plain=True)
def SRC11_pending_transactions(t):
    ids = t.read("events").select(hashing.to_hex(_event()).alias("txid"))
    return hexed(node.read_transactions(ids, EventNode, per_call=300), "raw")


@query(f"SELECT event_id AS height, {EV} AS block_hash, sha256({EV}) AS block FROM events", plain=True)
def SRC5_blocks_of_a_node(t):
    low, high = t.read("events").agg(F.min("event_id"), F.max("event_id")).first()
    rows = node.read_blocks(t.spark, EventNode, low, high, per_task=2000)
    return hexed(rows.withColumn("height", F.col("height").cast("long")))


@query("SELECT event_id, 'no answer of https://[redacted]@host:' || event_id AS line FROM events", plain=True)
def MET10_clean_errors(t):
    raw = F.concat(F.lit("no answer of https://me:pw"), _id().cast("string"), F.lit("@host:"), _id().cast("string"))
    return t.read("events").select("event_id", _text_udf(node.clean_error)(raw).alias("line"))


# --- arguments and parameters ----------------------------------------------------------------------------------------------


def _tried(f: Callable[[str], object]) -> Callable[[str], str | None]:
    """f as text, None where it refuses its argument."""

    def run(x):
        try:
            return str(f(x))
        except text.BadArgument:
            return None

    return run


@query("SELECT event_id, CASE event_id % 3 WHEN 0 THEN CASE WHEN event_id = 0 THEN NULL ELSE least(event_id * 7, 10000) END END AS n FROM events", plain=True)
def FIL11_page_limits(t):
    raw = F.when(_id() % 3 == 0, (_id() * 7).cast("string")).when(_id() % 3 == 1, F.concat(F.lit("-"), _id().cast("string"))).otherwise(F.lit("1.5"))
    return t.read("events").select("event_id", _text_udf(_tried(lambda x: text.page_options(x, None)[0]))(raw).cast("long").alias("n"))


@query(f"SELECT event_id, CASE WHEN event_id % 64 >= 32 THEN {EV}[1:(event_id % 64)::INTEGER] END AS pattern FROM events", plain=True)
def FIL13_key_patterns(t):
    raw = F.expr("substring(sha2(concat('ev:', event_id), 256), 1, cast(event_id % 64 as int))")
    return t.read("events").select("event_id", _text_udf(_tried(text.key_pattern))(F.upper(raw)).alias("pattern"))


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'store-' || event_id || '.tar.gz' WHEN 1 THEN event_id || '_x' END AS name FROM events", plain=True)
def FN34_safe_names(t):
    n = _id().cast("string")
    raw = F.when(_id() % 4 == 0, F.concat(F.lit("store-"), n, F.lit(".tar.gz"))).when(_id() % 4 == 1, F.concat(n, F.lit("_x"))).when(_id() % 4 == 2, F.concat(F.lit("../"), n)).otherwise(F.concat(n, F.lit("..x")))
    return t.read("events").select("event_id", _text_udf(_tried(text.safe_name))(raw).alias("name"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 2 THEN event_id WHEN event_id <= 88 THEN event_id END AS height FROM events", plain=True)
def FIL9_explicit_end(t):
    within = _text_udf(_tried(lambda n: settled_end(100, 12, end=int(n), within=True)))(_id())
    checked = _text_udf(_tried(lambda n: settled_end(100, 12, end=int(n))))(_id())
    return t.read("events").select("event_id", F.when(_id() % 3 == 2, within).otherwise(checked).cast("long").alias("height"))


@query("SELECT event_id, CASE WHEN event_id % 5 = 0 THEN event_id + 1 WHEN event_id % 5 = 1 THEN 33 ELSE [12, 48, 120, 12][event_id % 4 + 1] END AS n FROM events", plain=True)
def FN21_undo_blocks(t):
    def undo(n: int) -> str:
        name = ("bitcoin-mainnet", "litecoin-testnet", "dogecoin-regtest", "other-net")[n % 4]
        return str(config.undo_blocks(name, n + 1 if n % 5 == 0 else None, "33" if n % 5 < 2 else "none"))

    return t.read("events").select("event_id", _text_udf(undo)(_id()).cast("long").alias("n"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN greatest(event_id % 12, 6) ELSE event_id % 12 END AS n FROM events", plain=True)
def FN22_confirmation_depth(t):
    def depth(n: int) -> str:
        return str(config.confirmations_for(config.coin_config("BTC", ("mainnet", "testnet", "regtest")[n % 3]), n % 12))

    return t.read("events").select("event_id", _text_udf(depth)(_id()).cast("long").alias("n"))


@query("SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'a' || event_id || '|b' WHEN 1 THEN 'A' || event_id || '|B' ELSE 'A' || event_id || '||B' END AS parts FROM events", plain=True)
def FN24_coerced_lists(t):
    def parts(n: int) -> str:
        return "|".join(x or "" for x in config.coerce(f" A{n},, B", ("csv_lower", "csv", "csv_sparse")[n % 3]))

    return t.read("events").select("event_id", _text_udf(parts)(_id()).alias("parts"))


@query("SELECT event_id, ['bitcoin', 'litecoin', 'dogecoin'][event_id % 3 + 1] || '-' || ['mainnet', 'testnet', 'regtest'][event_id // 3 % 3 + 1] AS network, event_id % 3 + 1 AS chain, event_id // 3 % 3 + 1 AS net, CASE WHEN event_id // 3 % 3 = 0 THEN [0, 48, 30][event_id % 3 + 1] WHEN event_id % 9 = 5 THEN 113 ELSE 111 END AS pubkey_hash FROM events", plain=True)
def FN27_FN28_network_codes(t):
    def codes(name: str) -> dict:
        chain, net = config.codes(name)
        return {"chain": chain, "net": net, "pubkey_hash": config.network_params(name)["pubkey_hash"]}

    pick = lambda names, n: F.element_at(F.array(*map(F.lit, names)), (n % 3 + 1).cast("int"))
    name = F.concat(pick(["bitcoin", "litecoin", "dogecoin"], _id()), F.lit("-"), pick(["mainnet", "testnet", "regtest"], F.floor(_id() / 3)))
    rows = t.read("events").select("event_id", name.alias("network"))
    return rows.select("*", _json_udf(codes, "chain long, net long, pubkey_hash int")(F.col("network")).alias("x")).select("event_id", "network", "x.*")


@query("SELECT event_id, CASE WHEN event_id % 4 = 3 THEN 7 ELSE greatest(event_id - 5000, 0) END AS n FROM events", plain=True)
def FN38_row_limits(t):
    raw = F.when(_id() % 4 == 3, F.lit("many")).otherwise((_id() - 5000).cast("string"))
    return t.read("events").select("event_id", _text_udf(lambda x: str(config.row_limit(x, 7)))(raw).cast("long").alias("n"))


@query("SELECT event_id, '{\"a\":[{\"b\":' || event_id || '}],\"d\":' || user_id || '}' AS line FROM events", plain=True)
def FN40_without_notes(t):
    raw = F.concat(F.lit('{"$why":1,"d":'), F.col("user_id").cast("string"), F.lit(',"a":[{"b":'), _id().cast("string"), F.lit(',"$c":{"e":2}}]}'))
    return t.read("events").select("event_id", _text_udf(lambda x: config.canonical_json(config.without_notes(json.loads(x))))(raw).alias("line"))


@query("SELECT event_id, event_id % 3 < 2 AS named, CASE event_id % 3 WHEN 0 THEN 'a\\\"' || event_id WHEN 1 THEN 'b\\\\' || event_id ELSE 'c\\n' || event_id END AS label FROM events", plain=True)
def MET12_MET13_names_and_labels(t):
    n = _id().cast("string")
    name = F.when(_id() % 3 == 0, F.concat(F.lit("x:_"), n)).when(_id() % 3 == 1, F.concat(F.lit("_"), n)).otherwise(F.concat(n, F.lit("x")))
    label = F.when(_id() % 3 == 0, F.concat(F.lit('a"'), n)).when(_id() % 3 == 1, F.concat(F.lit("b\\"), n)).otherwise(F.concat(F.lit("c\n"), n))
    return t.read("events").select("event_id", text.metric_name_ok(name).alias("named"), text.label_text(label).alias("label"))


# --- store -----------------------------------------------------------------------------------------------------------------


@query("SELECT txid, vout, value, height FROM utxo")
def STR21_recovered_store(t):
    store = _store(t, 48)
    _commit(store, t, "s-0", 0, 1500)
    t.outputs().select("txid", "vout", "value", "height", "script_hash").write.parquet(f"{store.root}/created/v=9")  # a commit that failed
    _commit(store, t, "s-1", 1500, 1 << 20)
    store.compact()
    store.vacuum(age=0)
    _commit(store, t, "s-1", 1500, 1 << 20)  # the last batch comes again
    return whole(hexed(store.utxo().select("txid", "vout", "value", "height")))
