"""Language ID: averaged hashed subword embeddings with a linear softmax, trained by SGD in numpy, calibrated rejection.

A text is the mean of the embeddings of its byte n-grams of one to four bytes that lie in a word or hang over one end of
it by a byte, lower-cased and hashed into buckets.  Embeddings and the linear layer are trained together on a bounded
sample of labelled rows; both are linear, so a text's logits are the mean of one row per n-gram of a table of buckets by
languages, which is all that executors need.  The table is bounded by its buckets.

Rejection is calibrated on a part of the sample that training doesn't see: a temperature turns logits into probabilities,
and a text is rejected if its probability is below what all but one in a thousand of those rows reach, or 0.4 if that is
less, or if it has no letter.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from coinstrata.llm._common import LOWER, SPACE, chunks, mix, task, text_rows

#: Labelled rows that training reads for each language; the sample is the rows with the least hashes.
SAMPLE = 600
#: Characters of a sampled text that training reads; predictions read whole texts.
CHARS = 20_000
#: Bytes whose n-grams are at hand at once.
SLICE = 1 << 18
BUCKETS = 1 << 14
DIM = 16
ORDERS = (1, 2, 3, 4)
EPOCHS = 30
RATE = 0.5
#: Share of the sample that calibrates, and of that what may be rejected.
HELD = 0.25
LOST = 0.001
UNKNOWN = "und"

_TABLE = mix(np.arange(256, dtype=np.uint64) + np.uint64(77)) | np.uint64(1)
_STEP = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9), np.uint64(0x27D4EB2F165667C5))


@dataclass
class Model:
    langs: list[str]
    table: np.ndarray  # buckets by languages
    bias: np.ndarray
    temperature: float
    least: float


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams of the texts, in order, and where each text's begin (one more for the end)."""
    raw = np.frombuffer(b" " + b" ".join(texts) + b"    ", dtype=np.uint8)
    space = SPACE[raw]
    signs = np.where(space, np.uint8(32), LOWER[raw])
    values = _TABLE[signs]
    n = len(raw) - max(ORDERS)
    ends = np.cumsum([len(t) + 1 for t in texts])
    owner = np.concatenate([[0], ends])
    h = np.zeros(n, dtype=np.uint64)
    bucket_of, at_of = [], []
    inside = np.ones(n, dtype=bool)
    for k in ORDERS:
        h = (h + values[k - 1 : k - 1 + n]) * _STEP[k - 1]
        if k >= 3:
            inside &= ~space[k - 2 : k - 2 + n]  # no white space but at the ends
        ok = inside & ~(space[:n] & space[k - 1 : k - 1 + n])
        at = np.flatnonzero(ok)
        bucket_of.append(((h[at] ^ (h[at] >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int32))
        at_of.append(at)
    cuts = [np.searchsorted(at, owner) for at in at_of]
    parts, starts, total = [], [0], 0
    for i in range(len(texts)):
        for b, c in zip(bucket_of, cuts):
            parts.append(b[c[i] : c[i + 1]])
            total += c[i + 1] - c[i]
        starts.append(int(total))
    return (np.concatenate(parts) if parts else np.empty(0, np.int32)), np.array(starts, dtype=np.int64)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(texts: list[bytes], langs: list[str], seed: int = 7) -> Model:
    """Fits and calibrates a model; the order of the rows doesn't matter, as they are sorted first."""
    rows = sorted(zip((zlib.crc32(t) for t in texts), langs, texts))
    names = sorted(set(langs))
    if not names:
        return Model([UNKNOWN], np.zeros((BUCKETS, 1), np.float32), np.zeros(1, np.float32), 1.0, 0.0)
    y = np.array([names.index(r[1]) for r in rows])
    counts = []
    for a in range(0, len(rows), 50):
        buckets, at = features([r[2] for r in rows[a : a + 50]])
        for s, e in zip(at[:-1], at[1:]):
            ids, c = np.unique(buckets[s:e], return_counts=True)
            counts.append((ids, (c / max(1, c.sum())).astype(np.float32)))
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(rows))
    held = order[: int(len(rows) * HELD)] if len(rows) >= 8 else order[:0]
    used = order[len(held) :]
    emb = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
    out = rng.normal(0, 0.1, (DIM, len(names))).astype(np.float32)
    bias = np.zeros(len(names), dtype=np.float32)
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        for i in rng.permutation(used):
            ids, share = counts[i]
            if not len(ids):
                continue
            mean = share @ emb[ids]
            p = _softmax((mean @ out + bias)[None])[0]
            p[y[i]] -= 1
            back = out @ p
            out -= rate * np.outer(mean, p)
            bias -= rate * 0.1 * p
            emb[ids] -= (rate * 20) * share[:, None] * back
    table = emb @ out
    test = held if len(held) else used
    z, t = np.array([share @ table[ids] + bias for ids, share in (counts[i] for i in test)]).reshape(-1, len(names)), y[test]
    temperature = min((0.25 * 1.2**k for k in range(20)), key=lambda s: -np.log(np.maximum(_softmax(z / s)[np.arange(len(t)), t], 1e-12)).mean())
    best = np.sort(_softmax(z / temperature).max(axis=1))
    least = min(0.4, float(best[int(len(best) * LOST)])) if len(best) else 0.0
    return Model(names, table.astype(np.float32), bias, float(temperature), least)


def has_letter(text: bytes) -> bool:
    raw = np.frombuffer(text, dtype=np.uint8)
    if ((LOWER[raw] >= 97) & (LOWER[raw] <= 122)).any():
        return True
    return not text.isascii() and any(c.isalpha() for c in text.decode("utf-8"))


def parts(text: bytes, size: int = SLICE) -> Iterator[bytes]:
    """text in stretches of about size bytes, cut at white space, so they have the same n-grams; a longer word is cut."""
    at = 0
    while len(text) - at > size:
        end = max(text.rfind(c, at, at + size) for c in (b" ", b"\n", b"\t", b"\r", b"\v", b"\f"))
        end = end if end > at else at + size
        yield text[at:end]
        at = end
    yield text[at:]


def logits(model: Model, texts: list[bytes]) -> np.ndarray:
    """The mean of the table's rows of each text's n-grams, and the bias; memory is that of a slice."""
    sums, n = np.zeros((len(texts), len(model.langs))), np.zeros(len(texts))
    slices: list[tuple[list[int], list[bytes]]] = [([], [])]
    for i, text in enumerate(texts):
        for part in parts(text):
            if sum(map(len, slices[-1][1])) + len(part) > SLICE and slices[-1][1]:
                slices.append(([], []))
            slices[-1][0].append(i)
            slices[-1][1].append(part)
    for owners, some in slices:
        buckets, at = features(some)
        np.add.at(n, owners, np.diff(at))
        for k in range(len(model.langs)):
            c = np.concatenate([[0.0], np.cumsum(model.table[:, k][buckets], dtype=np.float64)])
            np.add.at(sums[:, k], owners, c[at[1:]] - c[at[:-1]])
    return sums / np.maximum(1, n)[:, None] + model.bias


def predict(model: Model, texts: list[bytes]) -> Iterator[tuple[str, float, bool]]:
    """Language, probability, accepted of each text."""
    p = _softmax(logits(model, texts) / model.temperature)
    for text, row in zip(texts, p):
        if not has_letter(text):
            yield UNKNOWN, 0.0, False
        else:
            k = int(row.argmax())
            yield model.langs[k], float(row[k]), bool(row[k] >= model.least)


def held_out(id_col: str = "doc_id") -> F.Column:
    """Rows that training must not see."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1


def sample(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", most: int = SAMPLE) -> tuple[list[bytes], list[str]]:
    """At most `most` labelled training texts of each language, those with the least hashes, and of each the first CHARS.

    A first job counts rows by language and a second keeps the share that is needed, with some to spare, so no sort sees
    more than a few times the sample; of rows that repeat each task sends `most` at most.
    """
    rows = docs.filter(~F.coalesce(held_out(id_col), F.lit(True)) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    n = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    place = F.pmod(F.xxhash64("doc_id", "text", F.lit(11)), F.lit(1 << 30))
    share = F.create_map(*[F.lit(x) for lang, k in n.items() for x in (lang, int(min(1.0, 1.5 * (most + 50) / k) * (1 << 30)))]) if n else F.create_map()
    few = rows.withColumn("place", place).filter(F.col("place") <= share[F.col("lang")]) if n else rows.withColumn("place", place)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("place", "doc_id"))
    chosen = few.withColumn("text", F.substring("text", 1, CHARS)).withColumn("rank", rank).filter(F.col("rank") <= most).select("text", "lang").collect()
    return [r["text"].encode() for r in chosen], [r["lang"] for r in chosen]


_OUT = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64()), ("accepted", pa.bool_())])


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred, score, accepted for each row of docs.

    A null text or one without letters is `und` with score 0 and not accepted.  Rows with a null id are never learned
    from and not held out.  Without labelled rows every text with a letter is `und` with score 1.  Ties go to the
    language that comes first.  Other columns are not read; no rows give no rows.
    """
    model = train(*sample(docs, id_col, text_col, lang_col))
    sent = docs.sparkSession.sparkContext.broadcast(vars(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(**sent.value)
        for batch in batches:
            for a, z, texts in chunks(batch, size=1 << 17):
                langs, scores, ok = zip(*predict(model, texts))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, z - a), batch.column("held_out").slice(a, z - a), pa.array(langs), pa.array(scores, pa.float64()), pa.array(ok)], schema=_OUT)

    rows = text_rows(docs, id_col, text_col).withColumn("held_out", F.coalesce(held_out("doc_id"), F.lit(False)))
    return rows.mapInArrow(task(run), "doc_id long, held_out boolean, lang_pred string, score double, accepted boolean")


def keep_accepted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """docs without the rows whose language is rejected, all columns as they were; a null, empty or letterless text goes."""
    model = train(*sample(docs, id_col, text_col, lang_col))
    sent = docs.sparkSession.sparkContext.broadcast(vars(model))
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(**sent.value)
        for batch in batches:
            for a, z, texts in chunks(batch, text_col, size=1 << 17):
                ok = [accepted for *_, accepted in predict(model, texts)]
                yield batch.slice(a, z - a).filter(pa.array(ok, pa.bool_()))

    return docs.mapInArrow(task(run), schema)
