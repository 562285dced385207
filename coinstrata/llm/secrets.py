"""Secret scan: fixed patterns, and a battery of randomness tests over long tokens.

Under the hypothesis that a token is random in its inferred encoding (hex, base32, base36, base62 or base64) tests of its
signs give p-values: chi-squared of character classes and of signs, the number of runs about the median sign, and serial
correlation of neighbours.  The first two come from the same counts and cells are small, so the sum of their logarithms is
not taken for what it is of independent tests but compared with that of SIMULATED random tokens of the same alphabet and
about the same length, whose own encoding is inferred likewise.  Random tokens have uniform p-values, words have small ones.  For each band of
lengths a histogram of the p-values of the corpus's distinct tokens tells how many are random (twice those above one half)
and so how many of those above a threshold are not; the band's threshold is the least with a share of at most FALSE_SHARE
and holds for all their occurrences.  A task sends each distinct token once, as a hash; the histogram is a few hundred
numbers; the text is read twice and never shuffled.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coinstrata.llm._common import chunks, task, text_rows

#: Lower ends of the bands of token lengths.
BANDS = (20, 24, 32, 48, 80, 160)
BINS = 50
#: Share of tokens called random that may be none.
FALSE_SHARE = 0.05
#: Distinct tokens that a task holds before it sends them.
SENT = 100_000

# The patterns of the base kinds and their least lengths.
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]+")
LEAST = {"assign": 6, "access": 20, "hex": 24}
KINDS = ("assign", "access", "hex", "random")

_KEYWORDS = (b"passw", b"secret", b"token", b"api")
_SIGN = np.zeros(256, dtype=bool)
_SIGN[[*range(48, 58), *range(65, 91), *range(97, 123), *b"+/_-"]] = True

_ALPHABETS = [
    ("hex", "0123456789abcdef"), ("hex", "0123456789ABCDEF"), ("base32", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"), ("base36", "0123456789abcdefghijklmnopqrstuvwxyz"),
    ("base36", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"), ("base62", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"),
    ("base64", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz+/_-"),
]


def _places(alphabet: str) -> np.ndarray:
    out = np.zeros(256, dtype=np.int64)
    out[list(alphabet.encode())] = np.arange(len(alphabet))
    return out


def _classes(alphabet: str) -> list[str]:
    kinds = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "+/_-")
    return [x for x in ("".join(c for c in k if c in alphabet) for k in kinds) if x]


_PLACES = {a: _places(a) for _, a in _ALPHABETS}
_CLASSES = {a: _classes(a) for _, a in _ALPHABETS}


def encoding_of(token: str) -> tuple[str, str]:
    """Name and alphabet of the smallest encoding whose signs the token keeps to."""
    signs = set(token)
    return next((n, a) for n, a in _ALPHABETS if signs <= set(a))


def _normal_p(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def _chi_p(x: float, df: int) -> float:
    """Upper tail of chi-squared, by Wilson and Hilferty."""
    if df <= 0:
        return 1.0
    z = ((x / df) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df))
    return 0.5 * math.erfc(z / math.sqrt(2))


def battery(token: str) -> float:
    """The sum of the tests' negative log p-values; large for tokens that are not random."""
    _, alphabet = encoding_of(token)
    n = len(token)
    at = _PLACES[alphabet][np.frombuffer(token.encode(), dtype=np.uint8)].astype(float)
    signs = Counter(token)
    shares = [(sum(signs[c] for c in k), n * len(k) / len(alphabet)) for k in _CLASSES[alphabet]]
    by_class = _chi_p(sum((o - e) ** 2 / e for o, e in shares), len(shares) - 1)
    by_sign = _chi_p(sum(c * c for c in signs.values()) * len(alphabet) / n - n, len(alphabet) - 1)
    high = at >= len(alphabet) / 2
    a, b = int(high.sum()), int((~high).sum())
    if a and b:
        runs, mean = 1 + int((high[1:] != high[:-1]).sum()), 1 + 2 * a * b / n
        by_runs = _normal_p((runs - mean) / math.sqrt(max(1e-9, (mean - 1) * (mean - 2) / (n - 1))))
    else:
        by_runs = 2.0 ** (1 - n)
    spread = float(at.var())
    r = float(((at[:-1] - at.mean()) * (at[1:] - at.mean())).mean() / spread) if spread else 1.0
    by_serial = _normal_p(r * math.sqrt(n))
    return -sum(math.log(max(p, 1e-300)) for p in (by_class, by_sign, by_runs, by_serial))


#: Random tokens that calibrate an alphabet and length.
SIMULATED = 400
#: Lengths that are calibrated; a token is compared with those of the greatest that isn't longer.
LENGTHS = (20, 22, 24, 28, 32, 40, 48, 64, 80, 128, 160, 256)


_simulated: dict[tuple[str, int], np.ndarray] = {}


def simulated(alphabet: str, length: int) -> np.ndarray:
    """Sorted sums of the tests of random tokens; the same each time."""
    if (alphabet, length) not in _simulated:
        r = np.random.default_rng([length, len(alphabet), ord(alphabet[-1])])
        signs = np.array(list(alphabet))
        _simulated[alphabet, length] = np.sort([battery("".join(signs[r.integers(0, len(signs), length)])) for _ in range(SIMULATED)])
    return _simulated[alphabet, length]


def calibrate() -> None:
    """Simulates all alphabets and lengths, so that tasks get the results with their code."""
    for _, alphabet in _ALPHABETS:
        for length in LENGTHS:
            simulated(alphabet, length)


def randomness(token: str) -> float:
    """The p-value of a token: the share of simulated random ones whose tests sum to no less, beyond all of them falling
    as an exponential tail does; small for tokens that are not random."""
    _, alphabet = encoding_of(token)
    null = simulated(alphabet, max(x for x in LENGTHS if x <= max(len(token), LENGTHS[0])))
    x = battery(token)
    above = len(null) - int(np.searchsorted(null, x))
    return (above + 0.5) / (len(null) + 1) if above else 0.5 / (len(null) + 1) * math.exp(min(0.0, float(null[-1]) - x))


def band_of(length: int) -> int:
    return max(i for i, low in enumerate(BANDS) if length >= low)


def base_spans(text: bytes, long_runs: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """(start, kind, end) in bytes of the fixed patterns; long_runs: stretches of 20 signs or more."""
    out = []
    low = text.lower()
    if any(k in low for k in _KEYWORDS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    for a, z in long_runs:
        for kind, pattern in ((1, ACCESS), (2, HEX)):
            out += [(a + m.start(), kind, a + m.end()) for m in pattern.finditer(text[a:z]) if len(m[0]) >= LEAST[KINDS[kind]]]
    return sorted(out)


def scan(texts: list[bytes]) -> Iterator[tuple[list[tuple[int, int, int]], list[tuple[int, int, int, float]]]]:
    """Base spans and random candidates (start, end, band, p) of each text, in bytes."""
    joined = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
    edges = np.diff(_SIGN[joined].view(np.int8), prepend=np.int8(0))
    a, z = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    long_enough = z - a >= BANDS[0]
    a, z = a[long_enough], z[long_enough]
    at = np.concatenate([[0], np.cumsum([len(x) + 1 for x in texts])])
    first = np.searchsorted(a, at)
    for i, text in enumerate(texts):
        runs = [(int(s - at[i]), int(e - at[i])) for s, e in zip(a[first[i] : first[i + 1]], z[first[i] : first[i + 1]])]
        base = base_spans(text, runs)
        starts = [x for x, _, _ in base]
        ends = list(accumulate((y for _, _, y in base), max))  # the farthest end so far
        found = []
        for s, e in runs:
            before = bisect_left(starts, e)  # spans that begin before the run's end
            if not before or ends[before - 1] <= s:
                found.append((s, e, band_of(e - s), randomness(text[s:e].decode())))
        yield base, found


def thresholds(docs: DataFrame) -> list[float]:
    """The least p-value of each band that makes a token a secret, from all rows of docs (doc_id, text).

    A token counts once however often it stands, so copies of one don't move its band's threshold.
    """

    def sent(seen: dict[bytes, tuple[int, int]]) -> pa.RecordBatch:
        band, place = zip(*seen.values())
        return pa.RecordBatch.from_pydict({"token": pa.array(list(seen), pa.binary()), "band": pa.array(band, pa.int32()), "bin": pa.array(place, pa.int32())})

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, tuple[int, int]] = {}
        for batch in batches:
            for _, _, texts in chunks(batch):
                for text, (_, found) in zip(texts, scan(texts)):
                    seen.update((hashlib.blake2b(text[s:e], digest_size=16).digest(), (b, min(BINS - 1, int(p * BINS)))) for s, e, b, p in found)
                if len(seen) > SENT:
                    yield sent(seen)
                    seen = {}
        if seen:
            yield sent(seen)

    calibrate()
    tokens = docs.select("text").mapInArrow(task(distinct), "token binary, band int, bin int").distinct()
    counts = np.zeros((len(BANDS), BINS))
    for r in tokens.groupBy("band", "bin").agg(F.count("*").alias("n")).collect():
        counts[r["band"], r["bin"]] = r["n"]
    return [threshold(c) for c in counts]


def threshold(counts: np.ndarray) -> float:
    """From a histogram of p-values; 1.0 (no token) if no random ones are to be seen."""
    random = 2 * counts[BINS // 2 :].sum()
    for k in range(1, BINS // 2 + 1):
        above = counts[k:].sum()
        if above and 1 - random * (1 - k / BINS) / above <= FALSE_SHARE:
            return k / BINS
    return 1.0


def spans_of(texts: list[bytes], least: list[float]) -> Iterator[tuple[list[tuple[int, int, int]], float]]:
    """All spans (start, kind, end) of each text in code points, and the largest p-value of a random one."""
    for text, (base, found) in zip(texts, scan(texts)):
        random = [(s, 3, e, p) for s, e, b, p in found if p >= least[b]]
        spans = sorted(base + [(s, k, e) for s, k, e, _ in random])
        if spans and not text.isascii():
            starts = np.cumsum((np.frombuffer(text, dtype=np.uint8) & 0xC0) != 0x80)
            place = lambda i: int(starts[i - 1]) if i else 0
            spans = [(place(s), k, place(e)) for s, k, e in spans]
        yield spans, max((p for *_, p in random), default=0.0)


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


_OUT = pa.schema([("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in KINDS), ("base_sha256", pa.string()), ("spans", pa.string()), ("score", pa.float64())])


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_random, base_sha256, spans, score for each row of docs.

    A null or empty text has no spans; ids may be null or repeat; other columns are not read; no rows give no rows.
    A span is a whole match, in code points.  Random tokens that touch a base span are left to it.
    """
    rows = text_rows(docs, id_col, text_col)
    least = thresholds(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            for a, z, texts in chunks(batch):
                out = []
                for i, (spans, score) in zip(ids[a:z], spans_of(texts, least)):
                    base = written([s for s in spans if s[1] < 3])
                    out.append((i, *(sum(s[1] == k for s in spans) for k in range(4)), hashlib.sha256(base.encode()).hexdigest(), written(spans), score))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _OUT.types)], schema=_OUT)

    return rows.mapInArrow(task(run), "doc_id long, n_assign long, n_access long, n_hex long, n_random long, base_sha256 string, spans string, score double")


def redact(docs: DataFrame, mask: str = "[REDACTED]", id_col: str = "doc_id", text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """docs with each span of a text replaced by mask and length_col, if there is one, set anew; no row goes.

    A null text stays null and an empty one empty; spans that touch or overlap are masked once each; equal texts are masked alike.
    """
    least = thresholds(text_rows(docs, id_col, text_col))
    schema = docs.schema
    place = schema.fieldNames().index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(place).cast(pa.string()).to_pylist()
            lengths = batch.column(batch.schema.names.index(length_col)).to_pylist() if length_col in batch.schema.names else None
            for a, z, raw in chunks(batch, batch.schema.names[place]):
                for i, (spans, _) in enumerate(spans_of(raw, least), a):
                    if spans:
                        text, out, at = texts[i], [], 0
                        for s, _, e in spans:
                            if s >= at:
                                out += [text[at:s], mask]
                            at = max(at, e)
                        texts[i] = "".join([*out, text[at:]])
                        if lengths:
                            lengths[i] = len(texts[i])
            columns = list(batch.columns)
            columns[place] = pa.array(texts, batch.schema.field(place).type)
            if lengths:
                k = batch.schema.names.index(length_col)
                columns[k] = pa.array(lengths, batch.schema.field(k).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(task(run), schema)
