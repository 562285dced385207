"""A node as a source of blocks and unconfirmed transactions.

A client is anything with call(method, params) and batch(calls); it is made where it is used, in the driver or in tasks.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from typing import Any, Protocol

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from coinstrata.sources import codec

TRIES = 10
READY = 0.99
#: Blocks that a headers-first node may lack when it counts as synced.
NEAR_TIP = 5
#: A node's answer code for a transaction that it doesn't have (fixed by the protocol).
UNKNOWN_TX = -5
_CREDENTIALS = re.compile(r"(://)[^/\s:@]+:[^/\s@]+@")


class Client(Protocol):
    def call(self, method: str, params: list) -> Any: ...

    def batch(self, calls: list[tuple[str, list]]) -> list[dict]: ...


class SourceTimeout(Exception):
    """An answer that didn't come in time; worth another try."""


def retried(f: Callable[[], Any], tries: int = TRIES) -> Any:
    """f(), again after a timeout only."""
    for k in range(tries):
        try:
            return f()
        except SourceTimeout:
            if k == tries - 1:
                raise


def in_request_order(answers: list[dict], n: int, absent: int | None = None) -> list:
    """Results of a batch in the order of its calls; every call must be answered exactly once.  Errors raise, but for those
    of the code absent, whose result is None."""
    by_id = {a["id"]: a for a in answers}
    if len(answers) != n or set(by_id) != set(range(n)):
        raise ValueError(f"{len(answers)} answers for {n} calls")
    for a in answers:
        error = a.get("error")
        if error and (absent is None or not isinstance(error, dict) or error.get("code") != absent):
            raise ValueError(clean_error(str(error)))
    return [by_id[i].get("result") for i in range(n)]


def clean_error(message: str) -> str:
    return _CREDENTIALS.sub(r"\1[redacted]@", message)


class Node:
    """The calls that the engine needs."""

    def __init__(self, client: Client):
        self.client = client

    def _call(self, method: str, *params):
        return retried(lambda: self.client.call(method, list(params)))

    def info(self) -> dict:
        return self._call("getblockchaininfo")

    def ready(self) -> bool:
        return self.info().get("verificationprogress", 0) >= READY

    def synced(self) -> bool:
        i = self.info()
        return i["headers"] - i["blocks"] <= NEAR_TIP

    def block_hash(self, height: int) -> str:
        return self._call("getblockhash", height)

    def header(self, block_hash: str) -> bytes:
        return bytes.fromhex(self._call("getblockheader", block_hash, False))

    def block(self, block_hash: str, auxpow: bool = True) -> bytes:
        data = bytes.fromhex(self._call("getblock", block_hash, 0))
        return data if auxpow else codec.strip_auxpow(data, self.header(block_hash))

    def block_by_parts(self, block_hash: str) -> bytes:
        """A block from its header and its transactions one by one."""
        ids = self._call("getblock", block_hash, 1)["tx"]
        return codec.reassemble(self.header(block_hash), [bytes.fromhex(self._call("getrawtransaction", i)) for i in ids])

    def blocks(self, heights: list[int], auxpow: bool = True) -> list[tuple[int, str, bytes]]:
        """(height, hash, block) in the order asked for, by two batches, or three for merge-mined chains."""
        ask = lambda calls: in_request_order(retried(lambda: self.client.batch(calls)), len(calls))
        hashes = ask([("getblockhash", [h]) for h in heights])
        data = [bytes.fromhex(x) for x in ask([("getblock", [h, 0]) for h in hashes])]
        if not auxpow:
            heads = [bytes.fromhex(x) for x in ask([("getblockheader", [h, False]) for h in hashes])]
            data = [codec.strip_auxpow(d, h) for d, h in zip(data, heads)]
        return list(zip(heights, hashes, data))

    def pending(self) -> list[str]:
        return self._call("getrawmempool")

    def transaction(self, txid: str) -> bytes | None:
        """A pending transaction, None if it is gone."""
        return self.transactions([txid])[0]

    def transactions(self, txids: list[str]) -> list[bytes | None]:
        """Pending transactions in one batch, in the order asked for; None for those that are gone."""
        calls = [("getrawtransaction", [t]) for t in txids]
        found = in_request_order(retried(lambda: self.client.batch(calls)), len(calls), UNKNOWN_TX)
        return [bytes.fromhex(x) if x else None for x in found]


def read_blocks(spark: SparkSession, connect: Callable[[], Client], first: int, last: int, per_task: int = 200, per_call: int = 25, auxpow: bool = True) -> DataFrame:
    """Blocks first to last, per_task to a task, each task with a client of its own."""
    tasks = max(1, -(-(last - first + 1) // per_task))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        node = None
        for b in batches:
            heights = b["id"].tolist()
            for i in range(0, len(heights), per_call):
                node = node or Node(connect())
                rows = node.blocks(heights[i : i + per_call], auxpow)
                yield pd.DataFrame({"height": [r[0] for r in rows], "block_hash": [bytes.fromhex(r[1]) for r in rows], "block": [r[2] for r in rows]})

    return spark.range(first, last + 1, 1, tasks).mapInPandas(run, "height int, block_hash binary, block binary")


def read_transactions(ids: DataFrame, connect: Callable[[], Client], per_call: int = 1000) -> DataFrame:
    """(txid, raw) of pending transactions, per_call to a batch; raw is null for those that are gone."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        node = None
        for b in batches:
            for i in range(0, len(b), per_call):
                node = node or Node(connect())
                part = b["txid"].iloc[i : i + per_call].tolist()
                yield pd.DataFrame({"txid": part, "raw": node.transactions(part)})

    return ids.select("txid").mapInPandas(run, "txid string, raw binary")


class FailureStreak:
    """Consecutive failures at one height; fatal at `most`, other ways to fetch from `fallback` on."""

    def __init__(self, fallback: int = 5, most: int = 20):
        self.height, self.count, self.fallback, self.most = -1, 0, fallback, most

    def failed(self, height: int, error: Exception) -> bool:
        """Whether to fetch by parts now; raises when there were too many."""
        self.count = self.count + 1 if height == self.height else 1
        self.height = height
        if self.count >= self.most:
            raise RuntimeError(f"{self.count} failures at height {height}") from error
        return self.count >= self.fallback
