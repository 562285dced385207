"""What the operators share: materialising, size-checked broadcasts, vectorised words and shingles.

Words are taken from UTF-8 bytes: white space of the contracts is ASCII, so a byte scan never splits a code point.
Hashes are 64 bits wide; a word's hash is a polynomial over random byte values, mixed afterwards.
"""

from __future__ import annotations

import ctypes
import re
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one or two longs that a broadcast may hold; beyond it the join shuffles.
BROADCAST_ROWS = 400_000
#: Bytes of text that are handled at once; a longer text is a chunk of its own.
CHUNK = 1 << 18
#: Words of a shingle.
SHINGLE = 5


def materialize(df: DataFrame, tasks: int | None = None) -> DataFrame:
    """Writes df to the shared checkpoint folder and returns it without lineage.

    tasks: no more partitions than these, for what is known to be little whatever the number of shuffle partitions.
    Without spark.checkpoint.dir a local session gets a folder of its own; a cluster raises, as executors share no disk.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not re.match(r"local(\[|$)", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoint-"))
    return (df if tasks is None else df.coalesce(tasks)).checkpoint(eager=True)


def give_back() -> None:
    """Returns freed memory to the system; an idle worker would keep it beside those that work."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def task(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, a function over a task's batches, that gives memory back when it ends."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    over.__name__ = run.__name__
    return over


def small_side(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df, hinted as a broadcast side when its counted rows are few; df must be materialised."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def text_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns that most operators read, under names of their own; a null text is empty."""
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def chunks(batch: pa.RecordBatch, column: str = "text", size: int = CHUNK) -> Iterator[tuple[int, int, list[bytes]]]:
    """(first row, end row, texts as UTF-8) of runs of rows with about size bytes."""
    texts = batch.column(column)
    lengths = np.asarray(pa.compute.binary_length(texts).fill_null(0), dtype=np.int64)
    ends = np.cumsum(lengths)
    at = 0
    while at < len(lengths):
        before = ends[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(ends, before + size, side="right")))
        yield at, end, [x or b"" for x in texts.slice(at, end - at).cast(pa.binary()).to_pylist()]
        at = end


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose output bits depend on all input bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _lower_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    return t


LOWER = _lower_table()
SPACE = np.isin(np.arange(256), [0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D])
_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_BASE = 0x5851F42D4C957F2D
_PLACES = mix(np.arange(1001, 1001 + SHINGLE, dtype=np.uint64)) | np.uint64(1)
#: Powers that are kept; the others are products of one of these and one of a multiple of STRIDE.
STRIDE = 4096


def _powers(base: int, n: int) -> np.ndarray:
    steps = np.full(max(n, 1), base, dtype=np.uint64)
    steps[0] = 1
    return np.multiply.accumulate(steps)


_INVERSE = pow(_BASE, -1, 1 << 64)
_UP, _DOWN = _powers(_BASE, STRIDE), _powers(_INVERSE, STRIDE)


def hashes_of(signs: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The hash of each stretch of bytes.  Beside the result it takes the running sums, 8 bytes a sign, and no table of its length."""
    n = len(signs)
    strides = n // STRIDE
    up, down = _powers(pow(_BASE, STRIDE, 1 << 64), strides + 1), _powers(pow(_INVERSE, STRIDE, 1 << 64), strides + 1)
    sums = np.zeros(n + 1, dtype=np.uint64)
    terms = sums[1:]
    np.take(_BYTES, signs, out=terms, mode="clip")
    whole = terms[: strides * STRIDE].reshape(strides, STRIDE)
    whole *= _UP
    whole *= up[:strides, None]
    terms[strides * STRIDE :] *= _UP[: n - strides * STRIDE] * up[strides]
    np.cumsum(terms, out=terms)
    found = sums[ends] - sums[starts]
    found *= _DOWN[starts % STRIDE]
    found *= down[starts // STRIDE]
    found += (ends - starts).astype(np.uint64)
    return mix(found)


class Words:
    """Lower-cased words of several texts.  doc_from[i] to doc_from[i + 1] are the words of text i."""

    def __init__(self, texts: list[bytes]):
        self.bytes = LOWER[np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)]
        lengths = np.fromiter((len(x) + 1 for x in texts), np.int64, len(texts))
        self.text_from = np.concatenate([[0], np.cumsum(lengths)])
        solid = ~SPACE[self.bytes]
        edges = np.diff(solid.view(np.int8), prepend=np.int8(0))
        self.starts, self.ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
        self.doc_from = np.searchsorted(self.starts, self.text_from)
        self.doc_words = np.diff(self.doc_from)

    def hashes(self) -> np.ndarray:
        return hashes_of(self.bytes, self.starts, self.ends)

    def docs(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.doc_words)), self.doc_words)


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text: of five words, or of all words if they are fewer; none without words."""
    words = Words(texts)
    w = words.hashes()
    n = max(0, len(w) - SHINGLE + 1)
    h = np.zeros(n, dtype=np.uint64)
    for k in range(SHINGLE):
        h += w[k : k + n] * _PLACES[k]
    h = mix(h)
    out = []
    for a, k in zip(words.doc_from[:-1].tolist(), words.doc_words.tolist()):
        if k >= SHINGLE:
            out.append(np.unique(h[a : a + k - SHINGLE + 1]))
        elif k:
            few = (w[a : a + k] * _PLACES[:k]).sum(dtype=np.uint64)
            out.append(mix(np.array([few + np.uint64(k)], dtype=np.uint64)))
        else:
            out.append(np.empty(0, dtype=np.uint64))
    return out


def tables(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
