"""The overlay of unconfirmed transactions: snapshots in, differences applied, confirmed ones dropped."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coinstrata.operators.changes import drop_of, snapshot_diff

OUTPUTS = "txid binary, vout long, value decimal(20,0), script_hash binary, height int, coinbase boolean"
SPENDS = "spender_txid binary, prev_txid binary, prev_vout long"


class Mempool:
    """Versions of two small tables under a folder; a version counts once a pass has ended."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.version, self.reconverged = spark, root.rstrip("/"), 0, False
        self._write(spark.createDataFrame([], OUTPUTS), spark.createDataFrame([], SPENDS))

    def _write(self, outputs: DataFrame, spends: DataFrame) -> None:
        new = self.version + 1
        outputs.write.mode("overwrite").parquet(f"{self.root}/outputs/v={new}")
        spends.write.mode("overwrite").parquet(f"{self.root}/spends/v={new}")
        self.version = new

    def outputs(self) -> DataFrame:
        return self.spark.read.schema(OUTPUTS).parquet(f"{self.root}/outputs/v={self.version}")

    def spends(self) -> DataFrame:
        return self.spark.read.schema(SPENDS).parquet(f"{self.root}/spends/v={self.version}")

    def known(self) -> DataFrame:
        return self.outputs().select("txid").union(self.spends().select(F.col("spender_txid").alias("txid"))).distinct()

    def refresh(self, node: DataFrame, fetch) -> tuple[int, int]:
        """Takes the node's list (txid); fetch(missing) gives (outputs, spends) of new ones.  Returns (dropped, new).

        The overlay counts as converged after a whole pass only; a failure leaves the last version in place."""
        self.reconverged = False
        gone, missing = snapshot_diff(self.known(), node, "txid")
        outs, ins = fetch(missing)
        counts = gone.count(), missing.count()
        spent = drop_of(self.spends().withColumnRenamed("spender_txid", "txid"), gone, "txid").withColumnRenamed("txid", "spender_txid")
        self._write(drop_of(self.outputs(), gone, "txid").unionByName(outs), spent.unionByName(ins))
        self.reconverged = True
        return counts

    def confirmed(self, txids: DataFrame) -> None:
        """Drops mined transactions, called after their block is committed, so that they are never in neither place."""
        spent = drop_of(self.spends().withColumnRenamed("spender_txid", "txid"), txids, "txid").withColumnRenamed("txid", "spender_txid")
        self._write(drop_of(self.outputs(), txids, "txid"), spent)
