"""Index families derived from facts: outputs, spends and blocks.

Families are views: (family, key, value) rows in the store's layout are made for parity checks only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from coinstrata.functions.hashing import prefix8, u32, u64
from coinstrata.operators.bag import numbered


def window_floor(last: Column | int, undo: int) -> Column:
    """Least height of the undo window."""
    last = F.lit(last) if isinstance(last, int) else last
    return F.greatest(F.lit(0), last - undo + 1)


def in_window(rows: DataFrame, blocks: DataFrame, undo: int, height: str = "height") -> DataFrame:
    """Rows of the last `undo` heights; the tip is a scalar subquery, so the scan gets a plain bound."""
    return rows.filter(F.col(height) >= window_floor(blocks.agg(F.max("height")).scalar(), undo))


def with_row_id(outputs: DataFrame, order: list[str]) -> DataFrame:
    """Place of each output in the whole stream.  Places within a height are numbered apart and offset by a running sum
    over heights, so that no task sees all rows."""
    inner = numbered(outputs, ["height"], order, "_rn")
    sizes = outputs.groupBy("height").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.sum("_n").over(Window.orderBy("height").rowsBetween(Window.unboundedPreceding, -1))).drop("_n")
    return inner.join(before, "height").withColumn("row_id", F.coalesce("_before", F.lit(0)) + F.col("_rn") - 1).drop("_rn", "_before")


def first_seen(outputs: DataFrame, order: list[str]) -> DataFrame:
    """Height and block of each script's first output, spent ones too."""
    return outputs.groupBy("script_hash").agg(F.min_by(F.struct("height", "block_hash"), F.struct(*order)).alias("f")).select("script_hash", F.col("f.height").alias("height"), F.col("f.block_hash").alias("block_hash"))


def last_blocks(blocks: DataFrame, n: int) -> DataFrame:
    """The last n blocks, a top-k without a full sort."""
    return blocks.orderBy(F.desc("height")).limit(n)


def tip(blocks: DataFrame) -> DataFrame:
    """Height, as hex text too, and hash of the last block; -1 and null of none."""
    top = blocks.agg(F.max_by(F.struct("height", "block_hash"), F.struct("height")).alias("t"))
    height = F.coalesce("t.height", F.lit(-1))
    return top.select(height.alias("height"), F.when(height >= 0, F.lower(F.hex(height))).alias("height_hex"), F.col("t.block_hash").alias("block_hash"))


def context(blocks: DataFrame) -> DataFrame:
    """Each block's transactions with the block, from its array of prefixes."""
    return blocks.select("height", "block_hash", F.posexplode("tx8").alias("tx_idx", "tx8"))


def _family(rows: DataFrame, name: str, key: Column, value: Column) -> DataFrame:
    return rows.select(F.lit(name).alias("family"), key.alias("key"), value.alias("value"))


def families(outputs: DataFrame, spends: DataFrame, blocks: DataFrame, live: DataFrame, order: list[str], undo: int, spent_index: bool = False) -> DataFrame:
    """(family, key, value) of B, N, O, H, S, Z, W; of T, I, J too if spent outputs are kept.

    outputs has txid, vout, value, height, script_hash, block_hash, coinbase; all hashes are BINARY.
    """
    p = lambda c: F.unhex(F.hex(F.lit(c.encode())))
    nothing = F.unhex(F.lit(""))
    i32 = lambda c: F.unhex(F.lpad(F.right(F.hex(c.cast("long")), F.lit(8)), 8, "0"))
    value = F.concat(u64(F.col("value")), i32(F.col("height")), F.col("txid"), F.when(F.col("coinbase"), F.unhex(F.lit("01"))).otherwise(F.unhex(F.lit(""))))
    seen = first_seen(outputs, order)
    b = F.concat(p("B"), F.col("block_hash"))
    rows = [
        _family(blocks, "B", b, F.concat(u32(F.col("height")), u32(F.unix_timestamp("ts")), F.col("prev_hash"))),
        _family(last_blocks(blocks, undo), "N", F.concat(p("N"), F.col("block_hash")), nothing),
        _family(live, "O", F.concat(p("O"), F.col("script_hash"), prefix8(F.col("txid")), u32(F.col("vout"))), value),
        _family(live, "H", F.concat(p("H"), prefix8(F.col("txid")), u32(F.col("vout"))), F.col("script_hash")),
        _family(seen, "S", F.concat(p("S"), F.col("script_hash")), u32(F.col("height"))),
        _family(in_window(seen, blocks, undo), "Z", F.concat(p("Z"), F.col("block_hash"), F.col("script_hash")), nothing),
        _family(in_window(outputs, blocks, undo), "W", F.concat(p("W"), F.col("block_hash"), prefix8(F.col("txid")), u32(F.col("vout"))), F.col("script_hash")),
    ]
    if spent_index:
        out, spender = F.concat(prefix8(F.col("prev_txid")), u32(F.col("prev_vout"))), prefix8(F.col("spender_txid"))
        rows += [
            _family(outputs.select("txid", "block_hash").distinct(), "T", F.concat(p("T"), prefix8(F.col("txid"))), F.col("block_hash")),
            _family(spends, "I", F.concat(p("I"), out), spender),
            _family(spends, "J", F.concat(p("J"), spender, out), nothing),
        ]
    all_rows = rows[0]
    for r in rows[1:]:
        all_rows = all_rows.unionAll(r)
    return all_rows


#: Bytes of keys and values, for checks; a value of O has one more with the coinbase flag.
WIDTHS = {"B": (33, 40), "T": (9, 32), "I": (13, 8), "O": (45, 44), "H": (13, 32), "J": (21, 0), "N": (33, 0), "S": (33, 4), "W": (45, 32), "Z": (65, 0), "K": (77, 44), "M": (45, 32)}


def family_statistics(rows: DataFrame) -> DataFrame:
    """Rows, key and value widths of each family, and all together."""
    return rows.rollup("family").agg(F.count("*").alias("n"), F.min(F.octet_length("key")).alias("key_min"), F.max(F.octet_length("key")).alias("key_max"), F.min(F.octet_length("value")).alias("value_min"), F.max(F.octet_length("value")).alias("value_max")).withColumn("family", F.coalesce("family", F.lit("TOTAL")))


def undo_archive(spent: DataFrame) -> DataFrame:
    """K and M rows of spent outputs (with spend_block_hash) that an undo needs: those of an earlier block."""
    spent = spent.filter("height < spend_height")
    p = lambda c: F.unhex(F.hex(F.lit(c.encode())))
    at = F.concat(prefix8(F.col("txid")), u32(F.col("vout")))
    k = _family(spent, "K", F.concat(p("K"), F.col("spend_block_hash"), F.col("script_hash"), at), F.concat(u64(F.col("value")), u32(F.col("height")), F.col("txid")))
    return k.unionAll(_family(spent, "M", F.concat(p("M"), F.col("spend_block_hash"), at), F.col("script_hash")))
