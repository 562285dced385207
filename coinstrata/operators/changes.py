"""Staged changes, snapshot differences and ordered sets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def collapse(changes: DataFrame, key: list[str], seq: str = "seq") -> DataFrame:
    """The last write of each key; an aggregate, so a task sends one row a key."""
    rest = [c for c in changes.columns if c not in key]
    last = changes.groupBy(*key).agg(F.max_by(F.struct(*rest), F.col(seq)).alias("last"))
    return last.select(*key, *[F.col(f"last.{c}").alias(c) for c in rest])


def net(changes: DataFrame, key: list[str], seq: str = "seq", op: str = "op") -> DataFrame:
    """Collapsed changes without keys that the batch itself both put first and deleted last: they never reach the store."""
    ends = changes.groupBy(*key).agg(F.min_by(op, seq).alias("_first"), F.max_by(op, seq).alias("_last"))
    gone = ends.filter("_first = 'put' AND _last = 'del'")
    return collapse(changes, key, seq).join(gone.select(*key), key, "left_anti")


def apply_changes(table: DataFrame, changes: DataFrame, key: list[str]) -> DataFrame:
    """table after collapsed changes (op put or del)."""
    return table.join(changes.select(*key), key, "left_anti").unionByName(changes.filter("op = 'put'").select(table.columns))


def snapshot_diff(stored: DataFrame, node: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(stored but not in the node, in the node but not stored), each key once."""
    a, b = stored.select(key).distinct(), node.select(key).distinct()
    return a.join(b, key, "left_anti"), b.join(a, key, "left_anti")


def drop_of(rows: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """rows of transactions that are not gone."""
    return rows.join(gone.select(key).distinct(), key, "left_anti")


def ordered_distinct(rows: DataFrame, key: str) -> DataFrame:
    return rows.select(key).distinct().orderBy(key)


def distinct_in_order(rows: DataFrame, key: str, seq: str) -> DataFrame:
    """Each key at its first place."""
    return rows.groupBy(key).agg(F.min(seq).alias(seq)).orderBy(seq)


def not_live(candidates: DataFrame, live: DataFrame, key: str, seq: str) -> DataFrame:
    """Keys to clean up: once each, without those that are in the window again."""
    return candidates.join(live.select(key), key, "left_anti").groupBy(key).agg(F.min(seq).alias(seq))
