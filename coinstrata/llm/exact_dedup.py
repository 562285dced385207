"""Exact duplicates by a Golomb-coded exchange of fingerprints.

1. Every partition (sender) hashes its whole texts.  The small table of ids and hashes is materialised, so that a
   sender's rows stay the same if a task runs again.
2. A sender sorts its distinct fingerprints, cuts them to about log2(rows) + 20 bits, Rice-codes the gaps and sends one
   block to each owner of a range.  A hot text is one code in each block, however many rows hold it.
3. An owner decodes its blocks, finds values that come from several rows and replies with one bitmap for each block.
4. Senders turn bitmaps into suspects; only suspects' texts are shuffled, grouped byte by byte with map-side partial
   aggregation.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coinstrata.llm._common import materialize, small_side, text_rows

#: Bits beyond log2(rows): two in a million unequal texts become suspects, which the comparison of bytes clears.
SLACK_BITS = 20
#: Fingerprints that one owner handles.
OWNER_ROWS = 2_000_000
#: Groups of equal texts, about 100 bytes each, that a broadcast may hold; with more of them joins shuffle.
GROUPS = 100_000


def rice_encode(values: np.ndarray) -> tuple[int, bytes]:
    """Sorted distinct uint64 values as the Rice parameter and the coded gaps."""
    gaps = np.diff(values, prepend=np.uint64(0))
    b = max(0, int(np.log2(max(1.0, float(gaps.astype(np.float64).mean()) * 0.69))))
    quotients = (gaps >> np.uint64(b)).astype(np.int64)
    ends = np.cumsum(quotients + 1 + b)
    bits = np.zeros(int(ends[-1]) if len(ends) else 0, dtype=np.uint8)
    stops = ends - b - 1  # the one that ends each run of zeros
    bits[stops] = 1
    for k in range(b):
        bits[stops + 1 + k] = (gaps >> np.uint64(b - 1 - k)).astype(np.uint8) & 1
    return b, np.packbits(bits).tobytes()


def rice_decode(n: int, b: int, data: bytes) -> np.ndarray:
    """The n sorted values that rice_encode coded."""
    bits = np.unpackbits(np.frombuffer(data, dtype=np.uint8))
    ones = np.flatnonzero(bits)
    # the next stop is the first one at or after the next code's start: found for all ones at once, then followed
    after = np.searchsorted(ones, ones + 1 + b).tolist()
    stop, i = np.empty(n, dtype=np.int64), 0
    for k in range(n):
        stop[k] = i
        i = after[i]
    stops = ones[stop]
    starts = stops + 1
    quotients = np.diff(starts, prepend=np.int64(-b)).astype(np.uint64) - np.uint64(1 + b)
    gaps = quotients << np.uint64(b)
    for k in range(b):
        gaps |= bits[starts + k].astype(np.uint64) << np.uint64(b - 1 - k)
    return np.cumsum(gaps, dtype=np.uint64)


def _short(fps: np.ndarray, bits: int) -> np.ndarray:
    return fps.view(np.uint64) >> np.uint64(64 - bits)


def _owner_of(values: np.ndarray, bits: int, owners: int) -> np.ndarray:
    top = values >> np.uint64(max(0, bits - 30))
    return ((top * np.uint64(owners)) >> np.uint64(min(30, bits))).astype(np.int64)


def _send(bits: int, owners: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[np.ndarray] = []
        sender = 0
        for b in batches:
            if b.num_rows:
                parts.append(np.asarray(b.column("fp"), dtype=np.int64))
                sender = b.column("sender")[0].as_py()
        if not parts:
            return
        values, counts = np.unique(_short(np.concatenate(parts), bits), return_counts=True)
        cuts = np.searchsorted(_owner_of(values, bits, owners), np.arange(owners + 1))
        rows = []
        for o, (a, z) in enumerate(zip(cuts[:-1], cuts[1:])):
            if z > a:
                b, coded = rice_encode(values[a:z])
                rows.append((o, sender, int(z - a), b, coded, np.packbits(counts[a:z] > 1).tobytes()))
        yield pa.RecordBatch.from_pylist([dict(zip(_BLOCK.names, r)) for r in rows], schema=_BLOCK)

    return run


_BLOCK = pa.schema([("owner", pa.int32()), ("sender", pa.int32()), ("n", pa.int32()), ("rice", pa.int32()), ("codes", pa.binary()), ("several", pa.binary())])
_REPLY = pa.schema([("sender", pa.int32()), ("owner", pa.int32()), ("n", pa.int32()), ("bitmap", pa.binary())])
_FOUND = pa.schema([("fp", pa.int64())])


def _own(blocks: pa.Table) -> pa.Table:
    rows = blocks.to_pylist()
    values = [rice_decode(r["n"], r["rice"], r["codes"]) for r in rows]
    several = [np.unpackbits(np.frombuffer(r["several"], dtype=np.uint8), count=r["n"]).astype(bool) for r in rows]
    distinct, where, counts = np.unique(np.concatenate(values), return_inverse=True, return_counts=True)
    shared = counts > 1
    shared |= np.bincount(where, weights=np.concatenate(several), minlength=len(distinct)) > 0
    flags = np.split(shared[where], np.cumsum([len(v) for v in values])[:-1])
    out = [{"sender": r["sender"], "owner": r["owner"], "n": r["n"], "bitmap": np.packbits(f).tobytes()} for r, f in zip(rows, flags)]
    return pa.Table.from_pylist(out, schema=_REPLY)


def _receive(bits: int):
    def run(prints: pa.Table, replies: pa.Table) -> pa.Table:
        """Fingerprints of one sender that some other row shares."""
        if not prints.num_rows:
            return _FOUND.empty_table()
        fps = np.unique(np.asarray(prints.column("fp"), dtype=np.int64).view(np.uint64))
        values, where = np.unique(_short(fps, bits), return_inverse=True)
        rows = sorted(replies.to_pylist(), key=lambda r: r["owner"])
        flags = np.concatenate([np.unpackbits(np.frombuffer(r["bitmap"], dtype=np.uint8), count=r["n"]) for r in rows]).astype(bool)
        if len(flags) != len(values):
            raise RuntimeError(f"{len(flags)} flags came back for {len(values)} fingerprints")
        return pa.table({"fp": pa.array(fps[flags[where]].view(np.int64))}, schema=_FOUND)

    return run


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the largest id stays; of rows that also share the id, one.  A null text counts as empty;
    a null id is smaller than any other.  Other columns are not read, so their names can't clash.  No rows give no rows.
    """
    rows = text_rows(docs, id_col, text_col)
    fp = F.xxhash64("text")
    prints = materialize(rows.select("doc_id", fp.alias("fp"), F.unhex(F.sha2("text", 256)).alias("sha"), F.spark_partition_id().alias("sender"), F.monotonically_increasing_id().alias("row")))
    total = prints.count()
    bits = min(64, max(1, total).bit_length() + SLACK_BITS)
    owners = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // OWNER_ROWS))
    blocks = prints.select("fp", "sender").mapInArrow(_send(bits, owners), "owner int, sender int, n int, rice int, codes binary, several binary")
    replies = blocks.groupBy("owner").applyInArrow(_own, "sender int, owner int, n int, bitmap binary")
    found = prints.select("fp", "sender").groupBy("sender").cogroup(replies.groupBy("sender")).applyInArrow(_receive(bits), "fp long")
    suspects = materialize(found.distinct())
    texts = rows.withColumn("fp", fp).join(small_side(suspects), "fp", "left_semi")
    same = materialize(texts.groupBy(F.unhex(F.sha2("text", 256)).alias("sha"), "text").agg(F.count("*").alias("n")).filter("n > 1").select("sha"))
    groups = prints.join(small_side(same, GROUPS), "sha", "left_semi").groupBy("sha").agg(F.max(F.struct("doc_id", "row")).alias("best"), F.count("*").alias("size"))
    return prints.join(small_side(materialize(groups), GROUPS), "sha", "left").select(
        "doc_id",
        F.when(F.col("best").isNull(), F.col("doc_id")).otherwise(F.col("best.doc_id")).alias("keep_id"),
        F.coalesce("size", F.lit(1)).cast("long").alias("group_size"),
        (F.col("best").isNull() | (F.col("row") == F.col("best.row"))).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows that exact_dedup drops, all columns kept.

    Rows go by id and text together, so neither null ids nor an id on several texts takes another text with it.
    """
    result = materialize(exact_dedup(docs, id_col, text_col).select("doc_id", "kept", F.unhex("text_sha256").alias("sha")))
    kept = result.filter("kept").select(F.col("doc_id").alias("_id"), F.col("sha").alias("_sha"))
    dropped = result.filter(~F.col("kept")).select("doc_id", "sha").distinct()
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("sha") == F.col("_sha"))
    gone = materialize(dropped.join(kept, same, "left_anti").toDF("_id", "_sha"))
    twice = materialize(dropped.join(kept, same, "left_semi").toDF("_id", "_sha"))
    sha = F.unhex(F.sha2(F.coalesce(F.col(text_col).cast("string"), F.lit("")), 256))
    here = F.col(id_col).eqNullSafe(F.col("_id")) & (sha == F.col("_sha"))
    rest = docs.join(small_side(gone, GROUPS), here, "left_anti")
    if not twice.isEmpty():  # rows that repeat another with its id
        twice = small_side(twice, GROUPS)
        again = rest.join(twice, here, "left_semi").withColumn("_sha", sha).dropDuplicates([id_col, "_sha"]).drop("_sha")
        rest = rest.join(twice, here, "left_anti").unionByName(again)
    return rest
