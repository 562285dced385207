"""Bag difference of outputs and spends: equal keys cancel one for one.

A plain left anti join would drop every output of a key as soon as one spend has it.  Rows of a key are numbered, earliest
first, and as many go as there are spends of the key; the latest outputs survive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OUTPOINT = ["txid", "vout"]


def numbered(rows: DataFrame, key: list[str], order: list[Column | str], name: str = "rn") -> DataFrame:
    """rows with their place among those of the same key; order must be total up to equal rows."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*key).orderBy(*order)))


def as_outpoint(spends: DataFrame) -> DataFrame:
    return spends.withColumnsRenamed({"prev_txid": "txid", "prev_vout": "vout"})


def bag_anti_join(left: DataFrame, right: DataFrame, key: list[str] = OUTPOINT, order: list | None = None) -> DataFrame:
    """Rows of left that no row of right cancels.

    Right is counted by key, with map-side aggregation, and left's rows stay from that place on.  Window and join share
    one shuffle of left by key.
    """
    counted = right.groupBy(*key).agg(F.count("*").alias("_n"))
    return numbered(left, key, order or key).join(counted, key, "left").filter(F.col("rn") > F.coalesce("_n", F.lit(0))).drop("rn", "_n")


def orphans(outputs: DataFrame, spends: DataFrame, key: list[str] = OUTPOINT, order: list | None = None) -> DataFrame:
    """Spends that cancel no output."""
    return bag_anti_join(spends, outputs, key, order)


def utxo_set(outputs: DataFrame, spends: DataFrame, order: list | None = None) -> DataFrame:
    return bag_anti_join(outputs, as_outpoint(spends), OUTPOINT, order)


def utxo_of(outputs: DataFrame, spends: DataFrame, scripts: list[str], order: list | None = None) -> DataFrame:
    """utxo_set of a few scripts (hex): only rows of outpoints that one of them has are numbered.

    The scripts' outpoints are few, so both sides are cut by a join that adaptive execution turns into a broadcast; no
    shuffle of all outputs.
    """
    hashes = [bytes.fromhex(s) for s in scripts]
    keys = outputs.filter(F.col("script_hash").isin(hashes)).select(*OUTPOINT).distinct()
    near = [rows.join(keys, OUTPOINT, "left_semi") for rows in (outputs, as_outpoint(spends))]
    return bag_anti_join(*near, OUTPOINT, order).filter(F.col("script_hash").isin(hashes))


def bag_statistics(left: DataFrame, right: DataFrame, key: list[str] = OUTPOINT) -> DataFrame:
    """One row: left_read, right_read, emitted, canceled, orphans.  A key costs a row, however often it stands."""
    sides = left.select(*key, F.lit(1).alias("l"), F.lit(0).alias("r")).unionAll(right.select(*key, F.lit(0).alias("l"), F.lit(1).alias("r")))
    each = sides.groupBy(*key).agg(F.sum("l").alias("l"), F.sum("r").alias("r"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return each.agg(total(F.col("l")).alias("left_read"), total(F.col("r")).alias("right_read"), total(F.greatest(F.col("l") - F.col("r"), F.lit(0))).alias("emitted"), total(F.least("l", "r")).alias("canceled"), total(F.greatest(F.col("r") - F.col("l"), F.lit(0))).alias("orphans"))


def orphan_gate(statistics: DataFrame, first_height: int) -> DataFrame:
    """The statistics; reading them fails if a run from genesis has orphans."""
    return statistics.withColumn("checked", F.when((F.col("orphans") > 0) & F.lit(first_height == 0), F.raise_error(F.lit("spends without an output"))).otherwise(F.lit(True)))


def same_bag(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: rows that only a or only b has, and whether there are none."""
    cols = a.columns
    only = a.exceptAll(b.select(cols)).select(F.lit(1).alias("a"), F.lit(0).alias("b")).unionAll(b.select(cols).exceptAll(a).select(F.lit(0).alias("a"), F.lit(1).alias("b")))
    return only.agg(F.coalesce(F.sum("a"), F.lit(0)).cast("long").alias("only_a"), F.coalesce(F.sum("b"), F.lit(0)).cast("long").alias("only_b")).withColumn("same", (F.col("only_a") == 0) & (F.col("only_b") == 0))
