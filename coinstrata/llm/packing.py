"""Hierarchical packing of token sequences into windows of several lengths.

Documents are routed by length: whole windows of the longest tier leave first, the rest goes to the smallest tier that
holds it.  Tiers are packed from long to short: a window opens with its longest document and its gap is filled with the
longest shorter ones that fit, taken from the tiers below; what is then still open is filled by cutting one document.  So
every window of a tier, a power of two, is full.  A task packs its documents in blocks and hands what fills no window on
to its next block; only its last few tokens, fewer than the shortest tier, are padded.  No row leaves its task, so there
is no shuffle.

Step groups: every STEPS groups' worth of windows is dealt to that many groups, the longest first and each to the group with
the fewest tokens.  All sizes are powers of two, so groups hold equally many tokens and, within one, equally many windows of
each tier: a step's work, that of attention included, is the same for all.  A task's last groups hold what is left: all but
equally many tokens, at least a group's unless the task has fewer.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator
from heapq import heapreplace

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from coinstrata.llm._common import chunks, task, text_rows
from coinstrata.llm.bpe import PART, WordBpe, default_path, without_gc

#: Window lengths; powers of two.
TIERS = (2048, 1024, 512, 256, 128, 64)
#: The id that ends each document.
END = 1
#: Tokens of a step group.
GROUP_TOKENS = 32 * 2048
#: Groups that are balanced together.
STEPS = 16
#: Documents that are packed together.
BLOCK = 2000

_OUT = pa.schema([
    ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()),
    ("offset", pa.int64()), ("tier", pa.int64()), ("step_group", pa.int64()),
])
_DDL = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier long, step_group long"

#: A stretch of a document: length, document, start.
Piece = tuple[int, int, int]


def window(pool: list[Piece], size: int) -> list[Piece]:
    """Takes a window of exactly size tokens out of the pool, sorted by length; the pool must hold that many."""
    out, gap = [], size
    while gap:
        i = bisect_right(pool, (gap, 1 << 62, 0)) - 1
        if i >= 0:  # the longest that fits
            piece = pool.pop(i)
        else:  # cut the shortest
            n, doc, start = pool.pop(0)
            piece = (gap, doc, start)
            insort(pool, (n - gap, doc, start + gap))
        out.append(piece)
        gap -= piece[0]
    return out


def pack(pool: list[Piece], tiers: tuple[int, ...], last: bool) -> Iterator[tuple[int, list[Piece]]]:
    """(tier, pieces) of full windows; the pool keeps fewer tokens than the shortest tier, unless it is the last call."""
    left = sum(p[0] for p in pool)
    for k, tier in enumerate(tiers):
        routed = tier // 2 if k + 1 < len(tiers) else 0
        while pool and left >= tier and pool[-1][0] > routed:
            left -= tier
            yield tier, window(pool, tier)
    if last and pool:
        yield tiers[0], pool[:]
        pool.clear()


class Steps:
    """Deals one task's windows (tier, rows) to step groups."""

    def __init__(self, first: int, tokens: int = GROUP_TOKENS, steps: int = STEPS):
        self.next, self.tokens, self.steps = first, tokens, steps
        self.waiting: list[tuple[int, list[tuple]]] = []
        self.total = 0

    def add(self, tier: int, rows: list[tuple]) -> None:
        self.waiting.append((tier, rows))
        self.total += tier

    def deal(self, last: bool = False) -> Iterator[tuple]:
        """Rows with their group, of as many whole groups as there are, or of all rows if there will be no more."""
        while self.total >= self.steps * self.tokens:
            yield from self._deal(self.steps, self.total - self.steps * self.tokens)
        if last and self.waiting:
            yield from self._deal(max(1, self.total // self.tokens), 0)

    def _deal(self, groups: int, beyond: int) -> Iterator[tuple]:
        """beyond: tokens that wait for the next groups, those of the last windows that fit."""
        kept, later = [], []
        for tier, rows in reversed(self.waiting):
            if tier <= beyond:
                beyond -= tier
                later.append((tier, rows))
            else:
                kept.append((tier, rows))
        kept.sort(key=lambda w: -w[0])
        heap = [(0, g) for g in range(groups)]
        for tier, rows in kept:
            filled, g = heap[0]
            heapreplace(heap, (filled + tier, g))
            for r in rows:
                yield (*r, self.next + g)
        self.next += groups
        self.waiting = later[::-1]
        self.total = sum(tier for tier, _ in later)


class Packer:
    """Packs one task's documents."""

    def __init__(self, tiers: tuple[int, ...], first: int, tokens: int = GROUP_TOKENS):
        self.tiers, self.next = tiers, first
        self.docs: dict[int, tuple[int | None, bytes]] = {}
        self.pool: list[Piece] = []
        self.count = 0
        self.steps = Steps(first, tokens)

    def add(self, doc_id: int | None, ids: bytes) -> None:
        """Takes a document; its whole windows leave at once."""
        n, at, key = len(ids) // 4, 0, self.count
        self.docs[key] = (doc_id, ids)
        self.count += 1
        while n - at >= self.tiers[0]:
            self._window(self.tiers[0], [(self.tiers[0], key, at)])
            at += self.tiers[0]
        if at < n:
            insort(self.pool, (n - at, key, at))
        else:
            del self.docs[key]

    def flush(self, last: bool = False) -> list[tuple]:
        """Packs what waits and returns the rows of whole step groups, or all rows if it is the last call."""
        for tier, pieces in pack(self.pool, self.tiers, last):
            self._window(tier, pieces)
        open_docs = {p[1] for p in self.pool}
        self.docs = {k: v for k, v in self.docs.items() if k in open_docs}
        return list(self.steps.deal(last))

    def _window(self, tier: int, pieces: list[Piece]) -> None:
        rows, offset = [], 0
        for n, key, start in pieces:
            doc_id, ids = self.docs[key]
            rows.append((doc_id, start, n, zlib.crc32(memoryview(ids)[4 * start : 4 * (start + n)]), len(ids) // 4, self.next, offset, tier))
            offset += n
        self.next += 1
        self.steps.add(tier, rows)


def pack_documents(docs: DataFrame, path: str | None = None, tiers: tuple[int, ...] = TIERS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, tier, step_group.

    A null or empty text is a document of the end id alone.  Ids may be null or repeat: every row is packed.  A document
    of any length is cut into whole windows and one rest.  No rows give no pieces; other columns are not read.  Which pieces
    share a sequence, the sequences' and groups' ids and the padding depend on how the input is dealt to tasks; the pieces of
    each document don't lose or repeat an id whatever the deal.
    """
    path = path or default_path()
    end = END.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, packer = WordBpe(path), Packer(tiers, TaskContext.get().partitionId() << 40)
        rows: list[tuple] = []

        def done() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _OUT.types)], schema=_OUT)
            rows.clear()
            return out

        waiting = 0
        with without_gc():
            for batch in batches:
                ids = batch.column("doc_id").to_pylist()
                for a, z, texts in chunks(batch, size=PART):
                    for doc_id, (own, _) in zip(ids[a:z], bpe.encoded(texts)):
                        packer.add(doc_id, own + end)
                    waiting += z - a
                    if waiting >= BLOCK:
                        rows += packer.flush()
                        waiting = 0
                    if len(rows) > 5000:
                        yield done()
            rows += packer.flush(last=True)
            if rows:
                yield done()

    return text_rows(docs, id_col, text_col).mapInArrow(task(run), _DDL)
