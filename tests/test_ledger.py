"""Codecs, files, node, store, stream and engine on small chains made here."""

import sys
from decimal import Decimal

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark import cloudpickle
from pyspark.sql import functions as F

from coinstrata.functions import addresses, config, text
from coinstrata.operators import bag, validate
from coinstrata.plans.engine import Engine, bulk_load, bulk_or_live, settled_end
from coinstrata.sources import codec, files
from coinstrata.sources.node import FailureStreak, Node, SourceTimeout, in_request_order, read_blocks, read_transactions, retried
from coinstrata.streaming.ingest import Ingest, run
from coinstrata.streaming.mempool import Mempool
from coinstrata.streaming.store import Store, Unrecoverable

cloudpickle.register_pickle_by_value(sys.modules[__name__])
NET = "bitcoin-regtest"
ADDRESSES = [addresses.base58check_encode(bytes([111]) + bytes([i]) * 20) for i in range(3)]
SCRIPTS = [addresses.output_script(a, NET) for a in ADDRESSES]
COIN = 100_000_000


def chain(spec, prev=b"\0" * 32, start=0, salt=0):
    """Blocks from lists of (kind, ...): each block pays 50 coins to an address, then spends."""
    out = []
    for k, block in enumerate(spec, start):
        txs = [codec.Tx(1, [(b"\0" * 32, codec.NO_OUTPUT, bytes([k, salt]), 0)], [(50 * COIN, SCRIPTS[block["to"]])])]
        for txid, vout, outs in block.get("spend", []):
            txs.append(codec.Tx(1, [(txid[::-1], vout, b"", 0)], [(v, SCRIPTS[a]) for a, v in outs]))
        root, _ = validate.merkle_fold([t.txid()[::-1] for t in txs])
        b = codec.Block(codec.make_header(prev, root, 1_700_000_000 + 600 * k), txs)
        out.append((k, b.hash, b.encode()))
        prev = b.hash
    return out


def spent_chain():
    first = chain([{"to": 0}])
    paid = codec.block_from_bytes(first[0][2]).txs[0].txid()
    return first + chain([{"to": 1, "spend": [(paid, 0, [(1, 10 * COIN), (0, 40 * COIN)])]}, {"to": 2}, {"to": 2}], first[0][1], 1)


class FakeClient:
    def __init__(self, blocks):
        self.blocks = blocks

    def call(self, method, params):
        by_hash = {h.hex(): d for _, h, d in self.blocks}
        if method == "getblockhash":
            return self.blocks[params[0]][1].hex()
        if method == "getblock":
            return by_hash[params[0]].hex()
        if method == "getblockheader":
            return by_hash[params[0]][:80].hex()
        return {"blocks": len(self.blocks) - 1, "headers": len(self.blocks) - 1, "verificationprogress": 1.0}

    def batch(self, calls):
        if calls[0][0] == "getrawtransaction":
            self.asked = [*getattr(self, "asked", []), len(calls)]
            known = {t.txid().hex(): t.encode().hex() for _, _, d in self.blocks for t in codec.block_from_bytes(d).txs}
            return [{"id": i, "result": known[p[0]]} if p[0] in known else {"id": i, "result": None, "error": {"code": -5, "message": "gone"}} for i, (_, p) in enumerate(calls)]
        return [{"id": i, "result": self.call(m, p)} for i, (m, p) in reversed(list(enumerate(calls)))]


@given(st.integers(0, 2**32 - 1))
def test_varint_round_trip(n):
    r = codec.Reader(codec.varint(n))
    assert r.varint() == n and r.left() == 0


@given(st.integers(0, 2**64 - 1), st.binary(max_size=300), st.integers(0, 2**32 - 1), st.booleans())
def test_transaction_round_trip(value, script, index, witness):
    tx = codec.Tx(2, [(b"\1" * 32, index, script, 7)], [(value, script)], 9, [[script, b""]] if witness else [])
    back = codec.tx_from_bytes(tx.encode())
    assert back == tx and back.txid() == tx.txid() and back.coinbase() == (index == codec.NO_OUTPUT)


def test_reader_stays_in_bounds():
    with pytest.raises(codec.CodecError):
        codec.Reader(b"\xfd\1").varint()


def test_auxpow_is_stripped_both_ways():
    tx = codec.Tx(1, [(b"\0" * 32, codec.NO_OUTPUT, b"x", 0)], [(5, b"y")])
    header = codec.make_header(b"\0" * 32, b"\2" * 32, 5, version=0x104)
    section = tx.encode() + b"\3" * 32 + codec.varint(2) + b"\4" * 64 + b"\0" * 4 + codec.varint(0) + b"\0" * 4 + b"\5" * 80
    plain = header + codec.varint(1) + tx.encode()
    merged = header + section + codec.varint(1) + tx.encode()
    assert codec.strip_auxpow(merged) == plain == codec.strip_auxpow(merged, header + section)
    assert codec.block_from_bytes(merged).txs == [tx]


def test_litecoin_extension_flag():
    tx = codec.Tx(2, [(b"\1" * 32, 0, b"", 1)], [(5, b"y")])
    body = tx.body()
    data = body[:4] + b"\x00\x08" + body[4:-4] + b"\x00" + body[-4:]
    assert codec.tx_from_bytes(data) == tx


def test_files(spark, tmp_path):
    blocks = spent_chain()
    (tmp_path / "blocks-0.xdmp").write_bytes(codec.raw_file(1, 3, blocks, 3))
    raw = files.raw_blocks(spark, str(tmp_path))
    outs, ins, meta = files.facts(files.decode(raw))
    rows = [r.asDict() for r in outs.orderBy("height", "tx_idx", "vout").collect()]
    assert len(rows) == 6 and sum(r["value"] for r in rows) == 250 * COIN and ins.count() == 1 and [r["coinbase"] for r in rows] == [True, True, False, False, True, True]
    plain = [{**r, "value": int(r["value"])} for r in rows]
    (tmp_path / "outputs-0.dat").write_bytes(codec.outputs_file(1, 3, 0, 3, plain))
    (tmp_path / "outputs-old.dat").write_bytes(codec.outputs_file(1, 3, 4, 7, plain, legacy=True))
    (tmp_path / "spends-0.dat").write_bytes(codec.spends_file(1, 3, 0, 3, [{"prev_tx8": r["prev_txid"][:8], "prev_vout": r["prev_vout"], "spender_tx8": r["spender_txid"][:8]} for r in ins.collect()]))
    (tmp_path / "meta-0.dat").write_bytes(codec.meta_file(1, 3, [{"height": r["height"], "ts": int(r["ts"].timestamp()), "block_hash": r["block_hash"], "prev_hash": r["prev_hash"], "tx8": r["tx8"]} for r in meta.orderBy("height").collect()]))
    back = files.outputs(spark, str(tmp_path))
    assert back.count() == 12 and back.filter("coinbase").count() == 4 and back.agg(F.sum("value")).first()[0] == Decimal(500 * COIN)
    assert files.spends(spark, str(tmp_path)).count() == 1
    key = lambda r: (r["txid"], r["vout"], r["value"], r["height"], r["script_hash"], r["block_hash"], r["coinbase"])
    plainly = sorted(key({**r, "value": int(r["value"])}) for n in ("0", "old") for r in codec.records((tmp_path / f"outputs-{n}.dat").read_bytes()))
    for per_task in (1, 300, files.RANGE):  # ranges of one, two and all records
        cut = files.outputs(spark, str(tmp_path), per_task=per_task)
        assert sorted(key({**{k: bytes(v) if isinstance(v, bytearray) else v for k, v in r.asDict().items()}, "value": int(r["value"])}) for r in cut.collect()) == plainly
    assert files.ranges(spark, str(tmp_path), "outputs-*.dat", 300).count() == 6
    (tmp_path / "torn").mkdir()
    (tmp_path / "torn" / "spends-1.dat").write_bytes(codec.spends_file(1, 3, 0, 3, [{"prev_tx8": b"a" * 8, "prev_vout": 1, "spender_tx8": b"b" * 8}])[:-1])
    with pytest.raises(Exception, match="the header has 1 records"):
        files.spends(spark, str(tmp_path / "torn")).count()
    assert [len(r["tx8"]) for r in files.meta(spark, str(tmp_path)).orderBy("height").collect()] == [1, 2, 1, 1]
    heads = {r["path"].rsplit("/", 1)[1]: r for r in files.headers(spark, str(tmp_path)).collect()}
    assert heads["outputs-old.dat"]["width"] == 120 and heads["outputs-0.dat"]["complete"] and heads["blocks-0.xdmp"]["kind"] == "raw"
    whole = codec.joined([codec.outputs_file(1, 3, 4, 7, plain), codec.outputs_file(1, 3, 0, 3, plain)])
    assert codec.file_header(whole).count == 12
    with pytest.raises(codec.CodecError):
        codec.joined([codec.outputs_file(1, 3, 0, 3, plain), codec.outputs_file(1, 3, 5, 7, plain)])
    with pytest.raises(codec.CodecError):
        list(codec.raw_blocks(codec.raw_file(1, 3, [blocks[0], blocks[2]])))


def test_checks_of_a_chain(spark):
    blocks = spent_chain()
    decoded = files.decode(spark.createDataFrame(blocks, "height int, block_hash binary, block binary"))
    assert validate.first_failure(validate.linkage(decoded)).first()["error"] is None
    leaves = decoded.select("height", F.posexplode(F.transform("txs", lambda t: F.reverse(t["txid"]))).alias("pos", "x")).select("height", "pos", F.unhex(F.hex("x")).alias("leaf"))
    assert leaves.count() == 5
    roots = {r["height"]: bytes(r["root"]) for r in validate.merkle_roots(spark.createDataFrame([(h, i, t.txid()[::-1]) for h, _, d in blocks for i, t in enumerate(codec.block_from_bytes(d).txs)], "height int, pos int, leaf binary")).collect()}
    assert all(roots[h] == codec.block_from_bytes(d).merkle for h, _, d in blocks)
    bad = decoded.withColumn("prev_hash", F.when(F.col("height") == 2, F.unhex(F.lit("11" * 32))).otherwise(F.col("prev_hash")))
    assert tuple(validate.first_failure(validate.linkage(bad)).first())[1:] == (2, "link")
    gap = decoded.filter("height <> 1")
    assert tuple(validate.first_failure(validate.linkage(gap)).first())[1:] == (2, "height")
    assert validate.merkle_fold([b"a" * 32, b"a" * 32])[1] and not validate.merkle_fold([b"a" * 32, b"b" * 32, b"c" * 32])[1]


def test_node(spark):
    blocks = spent_chain()
    node = Node(FakeClient(blocks))
    assert node.ready() and node.synced() and [b[2] for b in node.blocks([2, 0])] == [blocks[2][2], blocks[0][2]]
    rows = read_blocks(spark, lambda: FakeClient(blocks), 0, 3, per_task=2).orderBy("height").collect()
    assert [bytes(r["block"]) for r in rows] == [b for _, _, b in blocks]
    with pytest.raises(ValueError):
        in_request_order([{"id": 0, "result": 1}, {"id": 0, "result": 2}], 2)
    txs = [t for _, _, d in blocks for t in codec.block_from_bytes(d).txs]
    assert node.transactions([txs[1].txid().hex(), "00" * 32]) == [txs[1].encode(), None] and node.transaction("11" * 32) is None and node.client.asked == [2, 1]
    with pytest.raises(ValueError):
        in_request_order([{"id": 0, "error": {"code": -28}}], 1, -5)
    ids = spark.createDataFrame([(t.txid().hex(),) for t in txs] + [("22" * 32,)], "txid string")
    got = {r["txid"]: r["raw"] and bytes(r["raw"]) for r in read_transactions(ids, lambda: FakeClient(blocks), per_call=2).collect()}
    assert got == {**{t.txid().hex(): t.encode() for t in txs}, "22" * 32: None}
    tries = []

    def late():
        tries.append(1)
        raise SourceTimeout

    with pytest.raises(SourceTimeout):
        retried(late, 3)
    assert len(tries) == 3
    streak = FailureStreak(2, 3)
    assert not streak.failed(5, ValueError()) and streak.failed(5, ValueError())
    with pytest.raises(RuntimeError):
        streak.failed(5, ValueError())


@settings(max_examples=8, deadline=None)
@given(st.lists(st.integers(0, 4), max_size=12), st.lists(st.integers(0, 4), max_size=12))
def test_bag_anti_join(spark, left, right):
    a = spark.createDataFrame([(x,) for x in left], "k int")
    b = spark.createDataFrame([(x,) for x in right], "k int")
    s = bag.bag_statistics(a, b, ["k"]).first()
    rest = list(left)
    for x in right:
        if x in rest:
            rest.remove(x)
    assert sorted(r["k"] for r in bag.bag_anti_join(a, b, ["k"]).collect()) == sorted(rest)
    assert (s["emitted"], s["canceled"], s["orphans"]) == (len(rest), len(left) - len(rest), len(right) - len(left) + len(rest))


def _streamed(spark, tmp_path, blocks, store, name, canonical=None):
    folder = tmp_path / name
    for k in range(0, len(blocks), 2):
        files.decode(spark.createDataFrame(blocks[k : k + 2], "height int, block_hash binary, block binary")).coalesce(1).write.mode("append").parquet(str(folder))
    schema = spark.read.parquet(str(folder)).schema
    ingest = Ingest(store, canonical, compact_every=1, name=name)
    q = run(spark, str(folder), schema, ingest, str(tmp_path / f"{name}-checkpoint"))
    q.awaitTermination()
    return ingest


def _key(df):
    return sorted((bytes(r["txid"]), r["vout"], r["value"], r["height"]) for r in df.collect())


def test_stream_equals_bulk_and_rolls_back(spark, tmp_path):
    blocks = spent_chain()
    store = Store(spark, str(tmp_path / "store"), undo=12)
    assert store.tip() == (-1, None)
    _streamed(spark, tmp_path, blocks, store, "one")
    assert store.tip() == (3, blocks[3][1].hex())
    outs, ins, meta = files.facts(files.decode(spark.createDataFrame(blocks, "height int, block_hash binary, block binary")))
    live = bag.utxo_set(outs.select("txid", "vout", "value", "height"), ins, ["height"])
    assert _key(store.utxo()) == _key(live) and len(_key(live)) == 5
    before = _key(store.utxo())
    store.commit("one-0", outs, ins, meta)
    assert _key(store.utxo()) == before  # the same batch again does nothing
    other = blocks[:2] + chain([{"to": 0}, {"to": 0}, {"to": 0}], blocks[1][1], 2, salt=9)
    canonical = lambda: spark.createDataFrame([(h, i) for h, i, _ in other], "height int, block_hash binary")
    ingest = _streamed(spark, tmp_path, other[2:], store, "two", canonical)
    assert (ingest.reorgs, ingest.last_depth, store.tip()) == (1, 2, (4, other[4][1].hex()))
    outs, ins, _ = files.facts(files.decode(spark.createDataFrame(other, "height int, block_hash binary, block binary")))
    assert _key(store.utxo()) == _key(bag.utxo_set(outs.select("txid", "vout", "value", "height"), ins, ["height"]))
    store.rollback(1)  # the spent output of block 0 is back
    assert [(v, h) for _, _, v, h in _key(store.utxo())] == [(50 * COIN, 0)] and store.tip()[0] == 0


def test_compaction_keeps_the_window(spark, tmp_path):
    blocks = spent_chain()
    store = Store(spark, str(tmp_path / "store"), undo=2)
    outs, ins, meta = files.facts(files.decode(spark.createDataFrame(blocks, "height int, block_hash binary, block binary")))
    for h in range(4):
        store.commit(f"b{h}", outs.filter(F.col("height") == h), ins.filter(F.col("spend_height") == h), meta.filter(F.col("height") == h))
    before = _key(store.utxo())
    seen = sorted((bytes(r[0]), r[1]) for r in store.first_seen().collect())
    store.compact()
    assert _key(store.utxo()) == before and len(store.manifest()) == 1 and store.blocks().count() == 4
    assert sorted((bytes(r[0]), r[1]) for r in store.first_seen().collect()) == seen
    with pytest.raises(Unrecoverable):
        store.rollback(1)
    store.commit("b3", outs.filter("height = 3"), ins.filter("spend_height = 3"), meta.filter("height = 3"))
    assert _key(store.utxo()) == before  # the last batch comes again after the base that holds it
    outs.withColumn("v", F.lit(0)).drop("v").write.parquet(f"{store.root}/created/v=77")  # a commit that failed half way
    assert store.vacuum() == [] and _key(store.utxo()) == before
    gone = store.vacuum(age=0)
    assert "created/v=77" in gone and "manifest/v=0" in gone and store.vacuum(age=0) == []
    assert _key(store.utxo()) == before and store.blocks().count() == 4 and sorted((bytes(r[0]), r[1]) for r in store.first_seen().collect()) == seen
    assert store.rollback(2) == 2 and store.tip()[0] == 1 and len(_key(store.utxo())) == 3
    store.halt("reorg")
    store.compact()
    assert store.halted() == "reorg"
    store.clear_halt()
    assert store.halted() is None
    store.export(str(tmp_path / "snap"))
    again = Store.restore(spark, str(tmp_path / "snap"), str(tmp_path / "again"))
    assert _key(again.utxo()) == _key(store.utxo()) and again.tip() == store.tip()
    with pytest.raises(ValueError):
        Store.restore(spark, str(tmp_path / "snap"), str(tmp_path / "again"))


def test_engine(spark, tmp_path):
    blocks = chain([{"to": 0}])
    store, pool = Store(spark, str(tmp_path / "store")), Mempool(spark, str(tmp_path / "pool"))
    outs, ins, meta = files.facts(files.decode(spark.createDataFrame(blocks, "height int, block_hash binary, block binary")))
    assert bulk_or_live(store, 100, 6) == "bulk" and bulk_or_live(store, 5, 6) == "live"
    store.commit("a", outs, ins, meta)
    paid = codec.block_from_bytes(blocks[0][2]).txs[0].txid()
    new = codec.Tx(1, [(paid[::-1], 0, b"", 0)], [(10 * COIN, SCRIPTS[1]), (3999 * COIN // 100, SCRIPTS[0])]).txid()
    out_rows = [(new, 0, Decimal(10 * COIN), SCRIPTS[1], None, False), (new, 1, Decimal(3999 * COIN // 100), SCRIPTS[0], None, False)]
    made = spark.createDataFrame(out_rows, "txid binary, vout long, value decimal(20,0), script binary, height int, coinbase boolean").withColumn("script_hash", F.unhex(F.sha2("script", 256))).drop("script")
    used = spark.createDataFrame([(new, paid, 0)], "spender_txid binary, prev_txid binary, prev_vout long")
    node = spark.createDataFrame([(new,)], "txid binary")
    assert pool.refresh(node, lambda missing: (made.select("txid", "vout", "value", "script_hash", "height", "coinbase"), used)) == (0, 1)
    engine = Engine(store, pool, NET, maturity=0)
    engine.saw_node(0, 1000)
    a, b = engine.info(ADDRESSES[0]).first(), engine.info(ADDRESSES[1]).first()
    assert (a["confirmed_text"], a["pending_text"], a["pending_count"], a["type"]) == ("50.00000000", "-10.01000000", 1, "p2pkh")
    assert (b["confirmed_text"], b["pending_text"]) == ("0.00000000", "10.00000000")
    assert engine.balance(ADDRESSES[0]).first()["balance"] == "39.99000000" and engine.balance(ADDRESSES[2]).first()["balance"] == "0.00000000"
    rows = engine.utxos(ADDRESSES[0]).collect()
    assert [(r["value"], r["height"], r["confirmations"]) for r in rows] == [(3999 * COIN // 100, None, 0)]
    assert engine.utxos(ADDRESSES[0], limit=1).count() == 1 and engine.next_cursor(ADDRESSES[0], 1) == f"{paid[:8].hex()}:0"
    assert engine.utxos(ADDRESSES[0], limit=1, after=f"{paid[:8].hex()}:0").count() == 0
    assert engine.first_seen(ADDRESSES[0]).first()[0] == 0 and engine.first_seen(ADDRESSES[2]).first()[0] is None
    s = engine.sync_status(2000).first()
    assert (s["lag"], s["synced"], s["mempool_ready"], s["stale"]) == (0, True, True, False)
    assert tuple(engine.status(2000).first()) == ("ok", 200) and tuple(engine.status(200_000).first()) == ("stalled", 503)
    assert not engine.is_quiescent().first()["ready"] and engine.health().first()["health"] == "healthy"
    pool.confirmed(node)
    assert pool.known().count() == 0 and engine.is_quiescent().first()["ready"]
    fresh = Store(spark, str(tmp_path / "bulk"), undo=1)
    chain4 = spent_chain()
    o, i, m = files.facts(files.decode(spark.createDataFrame(chain4, "height int, block_hash binary, block binary")))
    with pytest.raises(text.BadArgument):
        bulk_load(fresh, o, i, m, 3, 1, end=3)
    assert settled_end(100, 12) == 88 and settled_end(100, 2, 6, 98) == 98 and settled_end(100, 2, 6, 99, within=True) == 99
    assert bulk_load(fresh, o, i, m, 3, 1).first()["checked"] and fresh.tip()[0] == 2


def test_addresses():
    for hrp, v, n in (("bcrt", 0, 20), ("bcrt", 0, 32), ("bcrt", 1, 32)):
        a = addresses.segwit_encode(hrp, v, bytes(range(n)))
        assert addresses.segwit_decode(a, hrp) == (v, bytes(range(n)))
        assert addresses.output_script(a, NET)[-n:] == bytes(range(n))
        assert addresses.address_type(a[:-1] + ("q" if a[-1] != "q" else "p"), NET) == "unknown"
    assert addresses.output_script("1A1zP1eP5QGefi2DMPTfTL5SLmv7DivfNa", "bitcoin-mainnet").hex() == "76a91462e907b15cbf27d5425399ebf6f0fb50ebb88f1888ac"
    assert addresses.address_type("bc1qw508d6qejxtdg4y5r3zarvary0c5xw7kv8f3t4", "bitcoin-mainnet") == "p2wpkh"
    assert addresses.address_type("3J98t1WpEZ73CNmQviecrnyiWrnqRhWNLy", "bitcoin-mainnet") == "p2sh" and addresses.address_type("", NET) == "unknown"


def test_arguments_and_config():
    assert text.page_options("20000", "00112233445566aa:7") == (10_000, ("00112233445566aa", 7))
    for bad in (("0", None), ("x", None), (None, "00:1"), (None, "00112233445566aa:4294967296")):
        with pytest.raises(text.BadArgument):
            text.page_options(*bad)
    with pytest.raises(text.BadArgument):
        text.key_pattern("ab")
    with pytest.raises(text.BadArgument):
        text.safe_name("../x")
    assert text.http_code(text.TooLarge()) == 413 and text.http_code(text.BadArgument()) == 400 and text.http_code(KeyError()) == 500
    assert config.undo_blocks("dogecoin-mainnet", env="") == 120 and config.undo_blocks("litecoin-x", 7) == 7 and config.undo_blocks("other", env="x") == 12
    c = config.coin_config("BTC", "mainnet", {"maturity": 1})
    assert c.maturity == 100 and config.coin_config("BTC", "regtest", {"maturity": 1}).maturity == 1
    config.verify_pin(c, config.consensus_hash(c))
    with pytest.raises(ValueError):
        config.verify_pin(c, "00")
    assert config.canonical_json({"b": 1, "a": [{"d": 1, "c": 2}]}) == '{"a":[{"c":2,"d":1}],"b":1}'
    assert config.coerce("a, ,B", "csv_lower") == ["a", "b"] and config.coerce("a,,b", "csv_sparse") == ["a", None, "b"]
    assert config.confirmations_for(c, 1) == 6 and config.verify_defaults("bitcoin-mainnet") == (True, True) and config.verify_defaults("x", False, True) == (True, True)
    assert config.without_notes({"$x": 1, "y": {"$z": 2, "w": 3}}) == {"y": {"w": 3}} and config.codes("dogecoin-regtest") == (3, 3)


def test_archives(tmp_path):
    import tarfile

    from coinstrata.plans import archive

    for n in ("CURRENT", "MANIFEST-1", "x.ldb"):
        (tmp_path / n).write_text(n)
    inner = tmp_path / "store.tar.gz"
    with tarfile.open(inner, "w:gz") as t:
        for n in ("CURRENT", "MANIFEST-1", "x.ldb"):
            t.add(tmp_path / n, n)
    (tmp_path / "store.tar.gz.sha256").write_text(archive.digest(inner) + "  store.tar.gz\n")
    outer = tmp_path / "wrapper.tar.gz"
    with tarfile.open(outer, "w:gz") as t:
        t.add(inner, "store.tar.gz")
        t.add(tmp_path / "store.tar.gz.sha256", "store.tar.gz.sha256")
    work = tmp_path / "work"
    work.mkdir()
    assert archive.validated(outer, work).name == "store.tar.gz" and archive.validated(inner, work) == inner
    with pytest.raises(text.BadArgument):
        archive.validated(inner, work, checksum="00")
    with pytest.raises(text.BadArgument):
        archive.validated(inner, work, verify=lambda d: False)
    assert archive.members(inner, 2) == ["CURRENT", "MANIFEST-1"] and not archive.holds_store(["x"])
    done = []
    assert archive.restored(lambda: 1 / 0, lambda: done.append(1), lambda: None) == "kept" and not done
    assert archive.restored(lambda: None, lambda: done.append(1), lambda: None) == "restored" and done


def test_metrics_and_logs():
    from coinstrata.streaming.observe import LogBuffer, Registry

    r = Registry()
    c = r.make("counter", "n_total", "rows", ("route",))
    c.add(2, route='a"b')
    c.put(1, route='a"b')
    h = r.make("histogram", "s", "seconds", (), (1, 5))
    h.observe(3)
    assert 'n_total{route="a\\"b"} 2' in r.render() and 's_bucket{le="5"} 1' in r.render() and 's_bucket{le="1"} 0' in r.render() and "s_sum 3" in r.render()
    for bad in (lambda: r.make("gauge", "n_total", ""), lambda: r.make("gauge", "1x", ""), lambda: c.add(-1, route="x"), lambda: c.add(1)):
        with pytest.raises(ValueError):
            bad()
    for i in range(600):
        c.add(1, route=str(i))
    assert len(c.series) == 500 and c.dropped == 101
    out = []
    b = LogBuffer(out.extend, most=3, batch=2)
    for i in range(5):
        b.log("info", str(i), token="x", deep={"password": "y", "ok": [1]})
    assert b.dropped == 2 and b.flush() == 3 and out[0]["fields"] == {"token": "[redacted]", "deep": {"password": "[redacted]", "ok": [1]}}


def test_registry_of_queries(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 100
