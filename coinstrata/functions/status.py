"""Confirmations, freshness and health as column expressions.  -1 stands for an unknown height."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Lag that still counts as synced, blocks; age from which a node's answer is stale, milliseconds.
SYNCED_LAG = 3
NODE_STALE_MS = 150_000


def confirmations(tip: Column, height: Column) -> Column:
    return tip - height + 1


def mature(coinbase: Column, conf: Column, maturity: int) -> Column:
    """Coinbase outputs are hidden until they have maturity confirmations; 0 hides none."""
    return F.lit(maturity <= 0) | ~F.coalesce(coinbase, F.lit(False)) | (conf >= maturity)


def lag(committed: Column, node: Column) -> Column:
    """Blocks behind the node; null if either height is unknown, negative if ahead."""
    return F.when((committed >= 0) & (node >= 0), node - committed)


def synced_verdict(lag_: Column, node_stale: Column | None = None) -> Column:
    fresh = ~node_stale if node_stale is not None else F.lit(True)
    return F.coalesce(lag_.between(0, SYNCED_LAG) & fresh, F.lit(False))


def freshness(committed: Column, node: Column, synced: Column, reconverged: Column, halted: Column, reason: Column) -> Column:
    """What each answer carries: heights, lag, synced, mempool_ready, halt marker."""
    behind = lag(committed, node)
    ok = synced & F.coalesce(behind >= 0, F.lit(True))
    return F.struct(
        F.when(committed >= 0, committed).alias("committed_height"), F.when(node >= 0, node).alias("node_height"), behind.alias("lag"), ok.alias("synced"),
        (ok & reconverged).alias("mempool_ready"), F.when(halted, reason).alias("halt_reason"),
    )


def node_stale(last_ok_ms: Column, now_ms: Column, window_ms: int = NODE_STALE_MS) -> Column:
    """An unknown time is not stale."""
    return F.coalesce(now_ms - last_ok_ms > window_ms, F.lit(False))


def health(halted: Column, store_ok: Column) -> Column:
    return F.when(halted, "halted").when(store_ok, "healthy").otherwise("unhealthy")


def service_status(halted: Column, store_ok: Column, stale: Column) -> Column:
    """(status, HTTP code): halted before degraded before stalled."""
    word = F.when(halted, "halted").when(~store_ok, "degraded").when(stale, "stalled").otherwise("ok")
    return F.struct(word.alias("status"), F.when(word == "ok", 200).otherwise(503).alias("code"))


def quiescent(node: Column, committed: Column, mempool_size: Column) -> Column:
    return (node == committed) & (node >= 0) & (mempool_size == 0)
