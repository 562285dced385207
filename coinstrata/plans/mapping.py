"""The ledger's tables as views of the relational test tables, in DataFrames and in SQL.

There is no ledger data at hand, so order lines stand in for outputs, returned lines for spends, order dates for heights
and events for unconfirmed transactions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coinstrata.functions.hashing import sha256

#: Order of outputs within a height, total up to equal rows.
ORDER = ["height", "value", "script_hash", "l_partkey", "l_quantity", "l_shipdate"]
MATURITY = 100


class Tables:
    """Ledger tables of one folder; hashes are BINARY."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @staticmethod
    def height() -> F.Column:
        return F.datediff(F.col("o_orderdate").cast("date"), F.to_date(F.lit("1995-01-01")))

    def outputs(self) -> DataFrame:
        rows = self.read("lineitem").join(self.read("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
        return rows.select(
            sha256(F.concat(F.lit("tx:"), F.col("l_orderkey").cast("string"))).alias("txid"), (F.col("l_linenumber") - 1).cast("long").alias("vout"),
            (F.round(F.col("l_extendedprice") * 100).cast("decimal(20,0)") * F.lit(1_000_000)).cast("decimal(20,0)").alias("value"),
            sha256(F.concat(F.lit("spk:"), F.col("l_suppkey").cast("string"))).alias("script_hash"), self.height().alias("height"),
            sha256(F.concat(F.lit("blk:"), self.height().cast("string"))).alias("block_hash"), F.col("l_orderkey").alias("tx_idx"),
            ((F.col("l_linenumber") == 1) & (F.col("o_orderpriority") == "1-URGENT")).alias("coinbase"), "l_partkey", "l_quantity", "l_shipdate", "l_returnflag",
        )

    def spends(self) -> DataFrame:
        rows = self.outputs().filter("l_returnflag = 'R'")
        spend_height = (F.col("height") + 1 + F.col("l_partkey") % 30).cast("int")
        return rows.select(
            F.col("txid").alias("prev_txid"), (F.col("vout") + F.when(F.col("l_partkey") % 97 == 0, 7).otherwise(0)).alias("prev_vout"), spend_height.alias("spend_height"),
            sha256(F.concat_ws(":", F.lit("sx"), F.col("tx_idx").cast("string"), spend_height.cast("string"))).alias("spender_txid"),
        )

    def blocks(self) -> DataFrame:
        """One row for each present height; the previous hash is that of the previous present height."""
        heights = self.read("orders").select(self.height().alias("height")).distinct()
        from pyspark.sql import Window

        prev = F.lag("height").over(Window.orderBy("height"))  # a row a block
        h = lambda c: sha256(F.concat(F.lit("blk:"), c.cast("string")))
        return heights.select("height", h(F.col("height")).alias("block_hash"), F.coalesce(h(prev), F.unhex(F.lit("00" * 32))).alias("prev_hash"), F.timestamp_seconds(F.lit(788918400) + F.col("height") * 86400).alias("ts"))

    def scripts(self) -> int:
        return self.read("lineitem").agg(F.max("l_suppkey")).first()[0] + 1

    def pending(self) -> DataFrame:
        top = self.read("lineitem").agg((F.max("l_suppkey") + 1).alias("n"))
        rows = self.read("events").filter("event_type = 'purchase'").withColumn("n", top.scalar())
        return rows.select(
            sha256(F.concat(F.lit("ev:"), F.col("event_id").cast("string"))).alias("txid"), F.lit(0).cast("long").alias("vout"),
            (F.round(F.col("value") * 100).cast("decimal(20,0)") * F.lit(1_000_000)).cast("decimal(20,0)").alias("value"),
            sha256(F.concat(F.lit("spk:"), (F.col("user_id") % F.col("n")).cast("string"))).alias("script_hash"), F.lit(None).cast("int").alias("height"), F.lit(False).alias("coinbase"),
        )

    def pending_spends(self) -> DataFrame:
        n = self.read("orders").agg(F.count("*").alias("n"))
        rows = self.read("events").filter("event_type = 'click'").withColumn("n", n.scalar())
        return rows.select(sha256(F.concat(F.lit("tx:"), (F.col("event_id") % F.col("n")).cast("string"))).alias("prev_txid"), (F.col("user_id") % 7).alias("prev_vout")).distinct()

    def files(self) -> DataFrame:
        """Height ranges of 100 as files of a dump, those of whole multiples of seven missing."""
        h = self.blocks().select((F.floor(F.col("height") / 100)).alias("part")).distinct().filter("part % 7 <> 6")
        return h.select(F.format_string("blocks-%06d", "part").alias("name"), (F.col("part") * 100).alias("first"), (F.col("part") * 100 + 99).alias("last"))


#: The same views in SQL; hashes are hex text.
SQL = """
WITH outputs AS (
    SELECT sha256('tx:' || l_orderkey) AS txid, (l_linenumber - 1)::BIGINT AS vout, round(l_extendedprice * 100)::BIGINT * 1000000 AS value, sha256('spk:' || l_suppkey) AS script_hash,
           date_diff('day', DATE '1995-01-01', o_orderdate::DATE) AS height, sha256('blk:' || date_diff('day', DATE '1995-01-01', o_orderdate::DATE)) AS block_hash, l_orderkey AS tx_idx,
           (l_linenumber = 1 AND o_orderpriority = '1-URGENT') AS coinbase, l_partkey, l_quantity, l_shipdate, l_returnflag
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
spends AS (
    SELECT txid AS prev_txid, vout + CASE WHEN l_partkey % 97 = 0 THEN 7 ELSE 0 END AS prev_vout, height + 1 + l_partkey % 30 AS spend_height,
           sha256('sx:' || tx_idx || ':' || (height + 1 + l_partkey % 30)) AS spender_txid
    FROM outputs WHERE l_returnflag = 'R'),
blocks AS (
    SELECT height, sha256('blk:' || height) AS block_hash, coalesce(sha256('blk:' || lag(height) OVER (ORDER BY height)), repeat('0', 64)) AS prev_hash, 788918400 + height * 86400 AS ts
    FROM (SELECT DISTINCT height FROM outputs UNION SELECT date_diff('day', DATE '1995-01-01', o_orderdate::DATE) FROM orders)),
pending AS (
    SELECT sha256('ev:' || event_id) AS txid, 0::BIGINT AS vout, round(value * 100)::BIGINT * 1000000 AS value, sha256('spk:' || (user_id % (SELECT max(l_suppkey) + 1 FROM lineitem))) AS script_hash
    FROM events WHERE event_type = 'purchase'),
pending_spends AS (SELECT DISTINCT sha256('tx:' || (event_id % (SELECT count(*) FROM orders))) AS prev_txid, user_id % 7 AS prev_vout FROM events WHERE event_type = 'click'),
files AS (SELECT DISTINCT printf('blocks-%06d', height // 100) AS name, (height // 100) * 100 AS first, (height // 100) * 100 + 99 AS last FROM blocks WHERE (height // 100) % 7 <> 6),
out_n AS (SELECT *, row_number() OVER (PARTITION BY txid, vout ORDER BY height, value, script_hash, l_partkey, l_quantity, l_shipdate) AS rn FROM outputs),
spend_n AS (SELECT *, row_number() OVER (PARTITION BY prev_txid, prev_vout ORDER BY spend_height, spender_txid) AS rn FROM spends),
utxo AS (SELECT * FROM out_n o WHERE NOT EXISTS (SELECT 1 FROM spend_n s WHERE s.prev_txid = o.txid AND s.prev_vout = o.vout AND s.rn = o.rn)),
matched AS (SELECT s.prev_txid AS txid, s.prev_vout AS vout, s.spend_height, s.spender_txid, o.value, o.script_hash, o.height, o.block_hash FROM spend_n s LEFT JOIN out_n o ON s.prev_txid = o.txid AND s.prev_vout = o.vout AND s.rn = o.rn),
tip AS (SELECT max(height) AS tip FROM blocks),
first_seen AS (SELECT script_hash, height, block_hash FROM (SELECT *, row_number() OVER (PARTITION BY script_hash ORDER BY height, tx_idx, vout, value, l_partkey, l_quantity, l_shipdate) AS k FROM outputs) WHERE k = 1)
"""


def amount_sql(value: str) -> str:
    """SQL for the exact text of an integer amount below 2^63."""
    return f"(CASE WHEN ({value}) < 0 THEN '-' ELSE '' END || (abs(({value})::HUGEINT) // 100000000)::VARCHAR || '.' || lpad((abs(({value})::HUGEINT) % 100000000)::VARCHAR, 8, '0'))"
