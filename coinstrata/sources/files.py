"""Dump and record files as DataFrames: Spark lists the files, tasks decode them.

Files of fixed-width records are read by ranges of whole records, many tasks to a file of any size, through Arrow's file
systems (an opener of one's own may take their place).  Dumps and block rows are of variable length: there a file is a task's
work, read by binaryFile, which takes any store that Spark reads and files up to 2 GB.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from datetime import datetime, timezone
from decimal import Decimal
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coinstrata.functions.hashing import script_hash
from coinstrata.sources import codec

OUTPUTS = "txid binary, vout long, value decimal(20,0), height int, script_hash binary, block_hash binary, coinbase boolean"
SPENDS = "prev_tx8 binary, prev_vout long, spender_tx8 binary"
META = "height int, ts timestamp, block_hash binary, prev_hash binary, tx8 array<binary>"
BLOCKS = "height int, block_hash binary, block binary"
TX = "struct<txid:binary, coinbase:boolean, ins:array<struct<prev_txid:binary, prev_vout:bigint>>, outs:array<struct<value:decimal(20,0), script:binary>>>"
DECODED = f"height int, block_hash binary, prev_hash binary, ts timestamp, header binary, txs array<{TX}>"
RANGES = "path string, kind string, width int, at long, size long"
#: Bytes of a file that make a task's range, records of a batch, rows of a frame.
RANGE, RECORDS, ROWS = 64 << 20, 1 << 14, 256
HEADERS = "path string, size long, kind string, chain int, net int, first int, last int, count long, width int, complete boolean"


def _files(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)


def _frame(rows: list[dict], columns: str) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[c.split()[0] for c in columns.split(", ")])


def decoded(contents: DataFrame, columns: str, rows_of: Callable[[bytes], Iterator[dict]]) -> DataFrame:
    """Rows of whole files (content), ROWS to a frame."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for content in b["content"]:
                rows = iter(rows_of(bytes(content)))
                while some := list(islice(rows, ROWS)):
                    yield _frame(some, columns)

    return contents.select("content").mapInPandas(run, columns)


def opened(path: str):
    """A file by Hadoop's name of it, in any file system that Arrow knows."""
    from pyarrow import fs

    local = re.match(r"file:(?://)?(?=/)", path)
    if local:
        return fs.LocalFileSystem().open_input_file(path[local.end() :])
    system, name = fs.FileSystem.from_uri(re.sub("^s3[an]:", "s3:", path))
    return system.open_input_file(name)


def ranges(spark: SparkSession, path: str, pattern: str, per_task: int = RANGE, opener: Callable = opened) -> DataFrame:
    """Ranges of whole records of files whose size is what their header says; another size raises."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for p, size in zip(b["path"], b["length"]):
                with opener(p) as f:
                    head = codec.file_header(f.read(codec.FILE_HEADER))
                if not codec.complete(size, head):
                    raise codec.CodecError(f"{p}: {size} bytes, the header has {head.count} records of {head.width}")
                step = max(1, per_task // head.width) * head.width
                rows += [{"path": p, "kind": head.kind, "width": head.width, "at": at, "size": min(step, size - at)} for at in range(codec.FILE_HEADER, size, step)]
            yield _frame(rows, RANGES)

    found = _files(spark, path, pattern).select("path", "length").mapInPandas(run, RANGES)
    # a number of its own: rows here are few bytes and would be gathered into one task
    return found.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), "path", "at")


def _records(spark: SparkSession, path: str, pattern: str, columns: str, kind: str, arrays: Callable[[np.ndarray], list], per_task: int, opener: Callable) -> DataFrame:
    names = [c.split()[0] for c in columns.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                if r["kind"] != kind:
                    raise codec.CodecError(f"{r['path']} holds {r['kind']}")
                with opener(r["path"]) as f:
                    f.seek(r["at"])
                    for start in range(0, r["size"], RECORDS * r["width"]):
                        data = f.read(min(RECORDS * r["width"], r["size"] - start))
                        yield pa.RecordBatch.from_arrays(arrays(codec.record_array(data, kind, r["width"])), names=names)

    return ranges(spark, path, pattern, per_task, opener).mapInArrow(run, columns)


def _binary(x: np.ndarray) -> pa.Array:
    """BINARY of a column of bytes of one width."""
    return pa.Array.from_buffers(pa.binary(x.dtype.itemsize), len(x), [None, pa.py_buffer(x.tobytes())]).cast(pa.binary())


def _output_arrays(x: np.ndarray) -> list:
    flag = x["coinbase"] == 1 if "coinbase" in x.dtype.names else np.zeros(len(x), bool)
    value = pa.array(x["value"].astype(np.uint64)).cast(pa.decimal128(20, 0))
    return [_binary(x["txid"]), pa.array(x["vout"].astype(np.int64)), value, pa.array(x["height"].astype(np.int32)), _binary(x["script_hash"]), _binary(x["block_hash"]), pa.array(flag)]


def _spend_arrays(x: np.ndarray) -> list:
    return [_binary(x["prev_tx8"]), pa.array(x["prev_vout"].astype(np.int64)), _binary(x["spender_tx8"])]


def headers(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """The header of each file."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for p, size, head in zip(b["path"], b["length"], b["head"]):
                h = codec.file_header(bytes(head))
                rows.append({"path": p, "size": size, "kind": h.kind, "chain": h.chain, "net": h.net, "first": h.first, "last": h.last, "count": h.count, "width": h.width, "complete": codec.complete(size, h)})
            yield _frame(rows, HEADERS)

    return _files(spark, path, pattern).select("path", "length", F.substring("content", 1, codec.FILE_HEADER).alias("head")).mapInPandas(run, HEADERS)


def dump_rows(data: bytes) -> Iterator[dict]:
    return (dict(zip(("height", "block_hash", "block"), b)) for b in codec.raw_blocks(data))


def output_rows(data: bytes) -> Iterator[dict]:
    return ({**r, "value": Decimal(r["value"])} for r in codec.records(data))


def meta_rows(data: bytes) -> Iterator[dict]:
    return ({**r, "ts": datetime.fromtimestamp(r["ts"], timezone.utc).replace(tzinfo=None)} for r in codec.meta_blocks(data))


def raw_blocks(spark: SparkSession, path: str, pattern: str = "blocks-*.xdmp") -> DataFrame:
    return decoded(_files(spark, path, pattern), BLOCKS, dump_rows)


def outputs(spark: SparkSession, path: str, pattern: str = "outputs-*.dat", per_task: int = RANGE, opener: Callable = opened) -> DataFrame:
    return _records(spark, path, pattern, OUTPUTS, "outputs", _output_arrays, per_task, opener)


def spends(spark: SparkSession, path: str, pattern: str = "spends-*.dat", per_task: int = RANGE, opener: Callable = opened) -> DataFrame:
    return _records(spark, path, pattern, SPENDS, "spends", _spend_arrays, per_task, opener)


def meta(spark: SparkSession, path: str, pattern: str = "meta-*.dat") -> DataFrame:
    return decoded(_files(spark, path, pattern), META, meta_rows)


def decode(blocks: DataFrame) -> DataFrame:
    """Blocks (height, block) as nested transactions."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for height, data in zip(batch["height"], batch["block"]):
                b = codec.block_from_bytes(bytes(data))
                txs = [{"txid": t.txid(), "coinbase": t.coinbase(), "ins": [{"prev_txid": h[::-1], "prev_vout": i} for h, i, _, _ in t.ins], "outs": [{"value": Decimal(v), "script": s} for v, s in t.outs]} for t in b.txs]
                rows.append({"height": height, "block_hash": b.hash, "prev_hash": b.prev, "ts": datetime.fromtimestamp(b.time, timezone.utc).replace(tzinfo=None), "header": b.header, "txs": txs})
            yield _frame(rows, "height, block_hash, prev_hash, ts, header, txs")

    return blocks.select("height", "block").mapInPandas(run, DECODED)


def facts(decoded: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(outputs, spends, meta) of decoded blocks: every output, every input but coinbases'."""
    txs = decoded.select("height", "block_hash", F.posexplode("txs").alias("tx_idx", "tx"))
    outs = txs.select("height", "block_hash", "tx_idx", F.col("tx.txid").alias("txid"), F.col("tx.coinbase").alias("coinbase"), F.posexplode("tx.outs").alias("vout", "o"))
    outs = outs.select("txid", F.col("vout").cast("long").alias("vout"), F.col("o.value").alias("value"), "height", script_hash(F.col("o.script")).alias("script_hash"), "block_hash", "coinbase", "tx_idx")
    ins = txs.select("height", F.col("tx.txid").alias("spender_txid"), F.explode("tx.ins").alias("i")).filter(F.col("i.prev_vout") != codec.NO_OUTPUT)
    ins = ins.select(F.col("i.prev_txid").alias("prev_txid"), F.col("i.prev_vout").alias("prev_vout"), F.col("height").alias("spend_height"), "spender_txid")
    heads = decoded.select("height", "ts", "block_hash", "prev_hash", F.transform("txs", lambda t: F.substring(t["txid"], 1, 8)).alias("tx8"))
    return outs, ins, heads


def reassembled(parts: DataFrame) -> DataFrame:
    """Blocks from (height, header, pos, tx): the way round a node that can't give a whole block."""
    g = parts.groupBy("height", "header").agg(F.array_sort(F.collect_list(F.struct("pos", "tx"))).alias("l"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"height": b["height"], "block": [codec.reassemble(bytes(h), [bytes(x) for x in t]) for h, t in zip(b["header"], b["txs"])]})

    return g.select("height", "header", F.transform("l", lambda s: s["tx"]).alias("txs")).mapInPandas(run, "height int, block binary")
