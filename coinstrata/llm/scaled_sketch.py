"""Document fingerprints: every shingle hash below a fixed fraction of all hashes.

Whether a hash is kept depends on the hash alone, so sketches of any two documents are comparable, the sketch of a union is
the union of the sketches, and the share of a short document's hashes that a long one holds estimates containment however
unequal they are.  A text with shingles of which none falls below the threshold keeps its least one.

Hashes are cut to 48 bits and written in base64 in ascending order.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coinstrata.llm._common import chunks, shingle_sets, text_rows

#: One hash in so many is kept.
SCALE = 4
BITS = 48
#: Bytes of text that are sketched at once.
PART = 1 << 20


def sketch(hashes: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """The kept part of sorted distinct 64-bit hashes, cut to 48 bits."""
    kept = hashes[: max(np.searchsorted(hashes, np.uint64((1 << 64) // scale)), min(1, len(hashes)))]
    return np.unique(kept >> np.uint64(64 - BITS))


def text_of(s: np.ndarray) -> str:
    return base64.b64encode(s.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 2:].tobytes()).decode()


def of_text(fingerprint: str) -> np.ndarray:
    raw = np.frombuffer(base64.b64decode(fingerprint), np.uint8).reshape(-1, 6)
    return np.pad(raw, ((0, 0), (2, 0))).copy().view(">u8").ravel().astype(np.uint64)


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of both documents' shingles together."""
    return np.union1d(a, b)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated Jaccard similarity; of two empty sketches 1."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    common = len(a) + len(b) - len(np.union1d(a, b))
    return common / (len(a) + len(b) - common)


def containment(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated share of a's shingles that b holds; 1 if a is empty."""
    return 1.0 if not len(a) else (len(a) + len(b) - len(np.union1d(a, b))) / len(a)


def sketches(texts: list[bytes], scale: int = SCALE) -> list[np.ndarray]:
    return [sketch(h, scale) for h in shingle_sets(texts)]


def fingerprints(docs: DataFrame, scale: int = SCALE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint for each row of docs; equal texts have equal ones, texts without words an empty one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, z, texts in chunks(batch, size=PART):
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, z - a), pa.array([text_of(s) for s in sketches(texts, scale)])], names=["doc_id", "fingerprint"])

    return text_rows(docs, id_col, text_col).mapInArrow(run, "doc_id long, fingerprint string")


def with_next(rows: DataFrame) -> DataFrame:
    """rows (doc_id, text) dealt to partitions in descending order of id, each followed by the first row of the next.

    Columns: doc_id, text, bucket, own.  Quantiles of the ids cut as many ranges as shuffles have partitions; the first
    row of each range goes to the range before it as well (own false), that of the first to the last.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = rows.withColumn("key", F.coalesce("doc_id", F.lit(-(1 << 63))))
    cuts = sorted(set(rows.select(F.col("doc_id").cast("double").alias("d")).approxQuantile("d", [i / n for i in range(1, n)], 0.2 / n)))
    if cuts:
        keyed = keyed.withColumn("place", F.col("key").cast("double"))
        keyed = Bucketizer(splits=[-float("inf"), *cuts, float("inf")], inputCol="place", outputCol="range").transform(keyed).withColumn("bucket", (F.lit(len(cuts)) - F.col("range")).cast("int")).drop("place", "range")
    else:
        keyed = keyed.withColumn("bucket", F.lit(0))
    tops = sorted((r["bucket"], r["top"]) for r in keyed.groupBy("bucket").agg(F.max("key").alias("top")).collect())  # one row a partition
    first = [(top, tops[i - 1][0]) for i, (_, top) in enumerate(tops)]
    again = keyed.drop("bucket").join(F.broadcast(rows.sparkSession.createDataFrame(first, "key long, bucket int")), "key")
    both = keyed.withColumn("own", F.lit(True)).unionByName(again.withColumn("own", F.lit(False)))
    return both.repartitionById(len(cuts) + 1, "bucket").sortWithinPartitions(F.desc("own"), F.desc("key"), "text").select("doc_id", "text", "own")


_OUT = pa.schema([
    ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()),
    ("near_edited", pa.float64()), ("near_next", pa.float64()), ("held_by_edited", pa.float64()), ("held_by_next", pa.float64()),
])


def _compare(scale: int):
    def rows_of(ids: list, texts: list[str]) -> pa.RecordBatch:
        """All but the last of consecutive documents, each with the next."""
        edited = []
        for text, after in zip(texts, texts[1:]):
            half = len(text) // 2
            edited.append((text[: len(text) - half] + after[:half]).encode())
        made = sketches([t.encode() for t in texts] + edited, scale)
        out = []
        for i, e in enumerate(edited):
            s, f, t = made[i], made[len(texts) + i], made[i + 1]
            out.append((ids[i], len(texts[i]), hashlib.sha256(e).hexdigest(), text_of(s), text_of(f), likeness(s, f), likeness(s, t), containment(s, f), containment(s, t)))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _OUT.types)], schema=_OUT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        texts: list[str] = []
        size, own_left = 0, True
        for batch in batches:
            for i, text, own in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "own"))):
                if not own and not own_left:
                    continue  # of rows that share the next range's first id, the first is the next
                own_left = own
                ids.append(i)
                texts.append(text)
                size += len(text)
                if size > PART and len(ids) > 1:
                    yield rows_of(ids, texts)
                    ids, texts = ids[-1:], texts[-1:]
                    size = len(texts[0])
        if len(ids) > 1:
            yield rows_of(ids, texts)

    return run


def compare_edited(docs: DataFrame, scale: int = SCALE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, held_by_edited,
    held_by_next for each row of docs.

    The next document is the one with the next smaller id, after the last the first; null ids come last, rows with one id
    in order of text.  The edited text ends with the first code points of the next one.  A null text is empty; a single
    row is its own next; no rows give no rows.  Other columns are not read.
    """
    return with_next(text_rows(docs, id_col, text_col)).mapInArrow(_compare(scale), "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, held_by_edited double, held_by_next double")
