"""Metric series from samples (name, labels, ts, value), and their text form."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from coinstrata.functions.text import label_text, number_text

#: Label sets that a metric may have.
SERIES_MOST = 500


def counters(samples: DataFrame, key: list[str]) -> DataFrame:
    """Sum of the increments; negative ones don't count."""
    return samples.groupBy(*key).agg(F.sum(F.greatest(F.col("value"), F.lit(0.0))).alias("value"))


def monotonic(samples: DataFrame, key: list[str]) -> DataFrame:
    """A counter set to absolute values; decreases don't count."""
    return samples.groupBy(*key).agg(F.max("value").alias("value"))


def gauges(samples: DataFrame, key: list[str], ts: str = "ts", tie: str = "event_id") -> DataFrame:
    """The last value."""
    return samples.groupBy(*key).agg(F.max_by("value", F.struct(ts, tie)).alias("value"))


def histograms(samples: DataFrame, key: list[str], buckets: list[float]) -> DataFrame:
    """Cumulative buckets with sum and count."""
    return samples.groupBy(*key).agg(*[F.count_if(F.col("value") <= b).alias(f"le_{str(b).replace('.', '_')}") for b in buckets], F.count("*").alias("n"), F.sum("value").alias("total"))


def capped(series: DataFrame, name: str, label: str, first: str, most: int = SERIES_MOST) -> tuple[DataFrame, DataFrame]:
    """(series kept, dropped series by metric): the first `most` label sets of a metric stay, the cap being the feature."""
    ranked = series.withColumn("_rank", F.row_number().over(Window.partitionBy(name).orderBy(first, label)))
    return ranked.filter(F.col("_rank") <= most).drop("_rank"), ranked.filter(F.col("_rank") > most).groupBy(name).agg(F.count("*").alias("dropped"))


def exposition(series: DataFrame, name: str, label_name: str, label: str, value: str) -> DataFrame:
    """One line of the text format for each series."""
    return series.select(F.concat(F.col(name), F.lit("{" + label_name + '="'), label_text(F.col(label)), F.lit('"} '), number_text(F.col(value))).alias("line"))


def throughput(blocks: DataFrame, span: int = 1000) -> DataFrame:
    """For each height the transactions of the last `span` heights, per block and per second.

    Heights are cut into ranges of span, each joined by the rows of the range before, so a window never spans the chain.
    """
    part = F.floor(F.col("height") / span)
    rows = blocks.select("height", "ts", "txs").withColumn("part", part).withColumn("own", F.lit(True))
    both = rows.unionByName(rows.withColumn("part", F.col("part") + 1).withColumn("own", F.lit(False)))
    w = Window.partitionBy("part").orderBy("height").rangeBetween(-span, 0)
    seconds = F.unix_timestamp("ts") - F.unix_timestamp(F.min("ts").over(w))
    return both.withColumn("n", F.sum("txs").over(w)).withColumn("per_block", F.avg("txs").over(w)).withColumn("seconds", seconds).filter("own").select("height", "n", "per_block", F.when(F.col("seconds") > 0, F.col("n") / F.col("seconds")).alias("per_second"))
