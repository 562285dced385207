"""Spends applied to outputs, the undo archive and rollback, on tables of facts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coinstrata.operators.bag import OUTPOINT, as_outpoint, bag_anti_join, numbered


def match(outputs: DataFrame, spends: DataFrame, order: list) -> DataFrame:
    """Spends with the outputs they cancel, one for one; those without have a null value.

    outputs must hold the batch's own, so that spends of the same block or batch match in any order.
    """
    side = lambda rows, name: rows.select(*OUTPOINT, F.struct(*(c for c in rows.columns if c not in OUTPOINT)).alias(name))
    # one shuffle by outpoint serves both numberings and the pairing, which is linear in an outpoint's rows
    both = side(as_outpoint(spends), "_s").unionByName(side(outputs, "_o"), allowMissingColumns=True).repartition(*OUTPOINT)
    places = ["_s.spend_height", "_s.spender_txid", *(f"_o.{c}" for c in order if c not in OUTPOINT)]
    rows = numbered(both.withColumn("_of", F.col("_s").isNull()), [*OUTPOINT, "_of"], places)
    paired = rows.groupBy(*OUTPOINT, "rn").agg(F.first("_s", True).alias("_s"), F.first("_o", True).alias("_o"))
    return paired.filter("_s IS NOT NULL").select(*OUTPOINT, "_s.*", "_o.*")


def anomalies(matched: DataFrame) -> DataFrame:
    """Spends without an output: reported, never fatal."""
    return matched.filter(F.col("value").isNull()).select("txid", "vout", "spender_txid", "spend_height")


def archive(matched: DataFrame) -> DataFrame:
    """Spent outputs that an undo must restore: those created below the spending height."""
    return matched.filter("height < spend_height")


def undo_above(utxo: DataFrame, archived: DataFrame, fork: int) -> DataFrame:
    """The outputs as if no block from height fork on had come."""
    return utxo.filter(F.col("height") < fork).unionByName(archived.filter((F.col("spend_height") >= fork) & (F.col("height") < fork)).select(utxo.columns))


def apply_batch(utxo: DataFrame, created: DataFrame, spends: DataFrame, order: list) -> tuple[DataFrame, DataFrame]:
    """(outputs after, matched spends) of a batch of blocks."""
    both = utxo.unionByName(created)
    return bag_anti_join(both, as_outpoint(spends), OUTPOINT, order), match(both, spends, order)


def fork_height(local: DataFrame, node: DataFrame) -> DataFrame:
    """One row: the least height at which the chains differ or the node has none; null if the node has all of ours."""
    j = local.select("height", F.col("block_hash").alias("ours")).join(node.select("height", F.col("block_hash").alias("theirs")), "height", "left")
    return j.filter(F.col("theirs").isNull() | (F.col("ours") != F.col("theirs"))).agg(F.min("height").alias("fork"))


def rollback_plan(local: DataFrame, node: DataFrame, undo: int) -> DataFrame:
    """One row: fork, depth, recoverable (within the undo window)."""
    tip = local.agg(F.max("height")).scalar()
    return fork_height(local, node).select("fork", F.coalesce(tip - F.col("fork") + 1, F.lit(0)).alias("depth")).withColumn("recoverable", F.col("depth") <= undo)


def walk_back(blocks: DataFrame, tip_hash: str, view: str = "chain_blocks") -> DataFrame:
    """The chain that ends in a block, along previous hashes (hex strings block_hash, prev_hash)."""
    blocks.createOrReplaceTempView(view)
    return blocks.sparkSession.sql(f"""
        WITH RECURSIVE chain(block_hash, prev_hash, height, depth) AS (
            SELECT block_hash, prev_hash, height, 0 FROM {view} WHERE block_hash = '{tip_hash}'
            UNION ALL SELECT b.block_hash, b.prev_hash, b.height, c.depth + 1 FROM {view} b JOIN chain c ON b.block_hash = c.prev_hash)
        SELECT * FROM chain""")
