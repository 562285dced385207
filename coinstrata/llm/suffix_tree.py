"""Language-model scores by a probabilistic suffix tree over words, beside exact add-one unigram scores.

Symbols are the V training tokens and one for all unknown ones; an end follows each text's words and stands before them.
A context is the token before a symbol, or the two before it.

Root: tokens of about the same count (the same up to 16, then within an eighth of an octave) share a chance, the mean of their
(c - D) / N; the unknown token has what all give up, D V / N; D = v1 / (v1 + 2 v2) by the tokens seen once and twice.
States: P(x | s) = (c(sx) + kinds(s) P(x | suffix)) / (N(s) + kinds(s)), Witten and Bell's rule, whose sums are exactly 1.
A context s is a state if the divergence of its next symbols from its longest suffix state's pays for naming each of them
once by that state and for its parameters:
    sum over x of c(sx) ln(P(x | s) / P(x | suffix)) + sum over x of ln P(x | suffix) > kinds(s) ln(N(s)) / 2.
So what followed s only once in all its kinds makes no state, one continuation seen twice does, and the answer doesn't depend
on how much else there is.  Nothing is capped: the tree grows with the text.  A symbol's chance is that of the longest suffix
state of its history.

1. Blocks: a task hashes its words; a block is its distinct hashes, frequent ones first, and its texts as places among them.
2. Counts: blocks ask owners of hash ranges, who sum the training counts and reply.
   They number the training tokens, so symbols are told apart exactly.
3. Events: a block's distinct (two tokens before, symbol) with training counts and the symbol's class of counts go to the owner
   of the newest token, who has that context and all that end in it, grows their states and replies a chance for each event.
4. Blocks add up their documents.

No owner could hold a context that occurs more than OWNER_EVENTS times, so these are counted by symbol first, where that many
are: blocks ask the owners of the symbols' hash ranges how often each symbol follows such a token or pair of tokens, and what
decides about the state is a histogram of these counts.  Then events after a hot token go to the owner of their two tokens with
the count after the newest, and blocks work out those after a hot pair themselves.  Chances are the same wherever they are
worked out, and come in steps of a fixed size, so neither OWNER_EVENTS nor the number of owners or blocks changes a score.

Blocks are not stored but made anew from the scan by each job that counts and by the job that scores, which shuffles each once
for both its uses; replies that don't fit a block raise.  Two totals of each class of counts, the size of each range and three
numbers of each hot context reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coinstrata.llm._common import Words, chunks, give_back, materialize, mix, task, text_rows

#: Events that one owner of contexts handles, and occurrences beyond which a context is hot.
OWNER_EVENTS = 1_000_000
#: Hashes that one owner of a range counts.
OWNER_HASHES = 4_000_000
#: The end token among word hashes.
END_HASH = np.uint64(0x1E0F_51AB_77C3_9D21)
#: Bytes of text that are handled at once, and words after which a block is closed.
PART = 1 << 20
BLOCK_WORDS = 1_500_000

_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93)
#: Bits of a context's hash within its owner.
_LOW = np.uint64((1 << 48) - 1)


def _packed(x: np.ndarray) -> bytes:
    """Unsigned numbers in as few bytes as they need, byte by byte in planes, compressed."""
    top = int(x.max()) if len(x) else 0
    x = x.astype("<u1" if top < 1 << 8 else "<u2" if top < 1 << 16 else "<u4" if top < 1 << 32 else "<u8")
    planes = np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T)
    return bytes([x.itemsize]) + len(x).to_bytes(8, "little") + pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def _plain(raw: bytes) -> np.ndarray:
    size, n = raw[0], int.from_bytes(raw[1:9], "little")
    planes = np.frombuffer(pa.decompress(raw[9:], decompressed_size=size * n, codec="zstd", asbytes=True), np.uint8).reshape(size, n)
    return np.ascontiguousarray(planes.T).view(f"<u{size}").ravel() if n else np.empty(0, np.uint8)


def _gaps(x: np.ndarray) -> bytes:
    """Unsigned numbers, for the most part ascending, by their differences."""
    return _packed(np.diff(x, prepend=x.dtype.type(0)))


def _sums(raw: bytes, kind: type = np.uint64) -> np.ndarray:
    return np.cumsum(_plain(raw), dtype=kind)


def _range_of(h: np.ndarray, owners: int) -> np.ndarray:
    """The owner of each hash."""
    return (h >> np.uint64(32)) * np.uint64(owners) >> np.uint64(32)


# --- blocks

_BLOCK = pa.schema([("block", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("held", pa.list_(pa.bool_())), ("tokens", pa.list_(pa.int64())), ("hashes", pa.binary()), ("seq", pa.binary()), ("kinds", pa.int64()), ("words", pa.int64())])
_BLOCK_DDL = "block long, doc_ids array<long>, held array<boolean>, tokens array<long>, hashes binary, seq binary, kinds long, words long"


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's texts in blocks: each token, the end after a text included, as its place among the distinct hashes."""
    number = TaskContext.get().partitionId() << 32
    ids, held, tokens, hashes = [], [], [], []

    def closed() -> pa.RecordBatch:
        distinct, seq, often = np.unique(np.concatenate(hashes), return_inverse=True, return_counts=True)
        order = np.argsort(-often, kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        row = {"block": number, "doc_ids": ids, "held": held, "tokens": tokens, "hashes": _gaps(distinct[order]), "seq": _packed(rank[seq]), "kinds": len(distinct), "words": len(seq)}
        return pa.RecordBatch.from_pylist([row], schema=_BLOCK)

    for batch in batches:
        all_ids, all_held = batch.column("doc_id").to_pylist(), batch.column("held_out").to_pylist()
        for a, z, texts in chunks(batch, size=PART):
            words = Words(texts)
            hashes.append(np.insert(words.hashes(), words.doc_from[1:], END_HASH))
            ids += all_ids[a:z]
            held += all_held[a:z]
            tokens += (words.doc_words + 1).tolist()
            if sum(map(len, hashes)) > BLOCK_WORDS:
                yield closed()
                number, ids, held, tokens, hashes = number + 1, [], [], [], []
    if ids:
        yield closed()


def _read(row: dict) -> dict:
    """A block's row with its hashes plain."""
    return {**row, "hashes": _sums(row["hashes"])}


def _history(r: dict, h: np.ndarray, seq: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The token before each of a block's tokens and the one before that; both are ends where the text begins."""
    end = int(np.flatnonzero(h == END_HASH)[0])
    first = np.cumsum([0, *r["tokens"]])[:-1].astype(np.int32)
    at = np.arange(len(seq), dtype=np.int32) - np.repeat(first, r["tokens"])  # the token's place in its text
    v, u = (np.where(at >= k, np.roll(seq, k), np.int32(end)) for k in (1, 2))
    return v, u


def _train(r: dict) -> np.ndarray:
    """Which tokens of a block are training tokens."""
    return np.repeat(~np.array(r["held"], dtype=bool), r["tokens"])


# --- counts

_ASK = pa.schema([("owner", pa.int32()), ("block", pa.int64()), ("hashes", pa.binary()), ("train", pa.binary())])


def _ask_counts(owners: int):
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The hashes of each block with its training counts, for the owners of ranges."""
        for batch in batches:
            for r in map(_read, batch.to_pylist()):
                h, seq = r["hashes"], _plain(r["seq"])
                n = np.bincount(seq, weights=_train(r), minlength=len(h)).astype(np.int64)
                order = np.argsort(h)
                h, n = h[order], n[order]
                cuts = np.searchsorted(_range_of(h, owners), np.arange(owners + 1))
                rows = [{"owner": o, "block": r["block"], "hashes": _gaps(h[a:z]), "train": _packed(n[a:z])} for o, (a, z) in enumerate(zip(cuts[:-1], cuts[1:])) if z > a]
                yield pa.RecordBatch.from_pylist(rows, schema=_ASK)

    return ask


_COUNTS = pa.schema([("block", pa.int64()), ("owner", pa.int32()), ("c", pa.binary()), ("number", pa.binary()), ("known", pa.binary()), ("class", pa.int32()), ("tokens", pa.int64()), ("total", pa.int64()), ("hot", pa.int64())])
_COUNTS_DDL = "block long, owner int, c binary, number binary, known binary, class int, tokens long, total long, hot long"


def class_of(c: np.ndarray) -> np.ndarray:
    """Classes of counts that share a chance at the root; 0 is that of the unknown token."""
    c = np.asarray(c, dtype=np.int64)
    return np.where(c <= 16, c, 17 + np.floor(8 * np.log2(np.maximum(c, 16) / 16))).astype(np.uint16)


def _count(most: int):
    def count(asked: pa.Table) -> pa.Table:
        """Corpus counts for the hashes of each block with the numbers of training tokens in their range, and rows (block null)
        with these tokens and their counts, the totals of the range's classes of counts, and tokens over most."""
        rows = asked.to_pylist()
        parts = [_sums(r["hashes"]) for r in rows]
        distinct, at = np.unique(np.concatenate(parts), return_inverse=True)
        c = np.bincount(at, weights=np.concatenate([_plain(r["train"]) for r in rows]), minlength=len(distinct)).astype(np.uint64)
        cuts = np.cumsum([0, *map(len, parts)])
        number, out = np.cumsum(c > 0).astype(np.uint64), []
        for r, a, z in zip(rows, cuts[:-1], cuts[1:]):
            i = at[a:z]
            out.append({"block": r["block"], "owner": r["owner"], "c": _packed(c[i]), "number": _gaps(number[i[c[i] > 0]])})
        kind = class_of(c)
        tokens, total = np.bincount(kind), np.bincount(kind, weights=c)
        out.append({"owner": rows[0]["owner"], "known": _gaps(distinct[c > 0]), "c": _packed(c[c > 0]), "tokens": int((c > 0).sum())})
        out += [{"class": k, "tokens": int(tokens[k]), "total": int(total[k])} for k in np.flatnonzero(tokens).tolist() if k]
        out += [{"hot": x} for x in distinct[c > most].view(np.int64).tolist()]
        give_back()
        return pa.Table.from_pylist(out, schema=_COUNTS)

    return count


def _known(h: np.ndarray, replies: list[dict], before: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """The counts of a block's hashes and the numbers of training tokens (0: unknown), from the number of tokens before each
    range; replies are in the hashes' sorted order, as their owners are."""
    told = sorted((r for r in replies if r["c"] is not None), key=lambda r: r["owner"])
    sent = [_plain(r["c"]) for r in told]
    if sum(map(len, sent)) != len(h):
        raise RuntimeError(f"{sum(map(len, sent))} counts came back for {len(h)} hashes: the input's rows have changed")
    order, c, number = np.argsort(h), np.empty(len(h), np.int64), np.zeros(len(h), np.uint32)
    c[order] = np.concatenate(sent)
    number[order[c[order] > 0]] = np.concatenate([_sums(r["number"]) + np.uint64(before[r["owner"]]) for r in told])
    return c, number


def root_chances(classes: dict[int, tuple[int, int]]) -> np.ndarray:
    """The root's chance of a token by its class, from the number of tokens of each class and the sum of their counts."""
    n, v = (sum(t[k] for t in classes.values()) for k in (1, 0))
    out = np.zeros(max(classes, default=0) + 1)
    v1, v2 = (classes.get(k, (0, 0))[0] for k in (1, 2))
    less = v1 / (v1 + 2 * v2) if v1 and v2 else 0.5
    for k, (tokens, total) in classes.items():
        out[k] = (total - less * tokens) / tokens / n
    out[0] = less * v / n if n else 1.0
    return out


# --- hot contexts


@dataclass
class Hot:
    """Contexts that occur too often for one owner: tokens by their hashes, ascending, then pairs of these by their places
    (the older first), ascending; and of each context how many symbols follow it, how often, and whether it is a state."""

    words: np.ndarray = field(default_factory=lambda: np.empty(0, np.uint64))
    pairs: list[tuple[int, int]] = field(default_factory=list)
    kinds: np.ndarray = field(default_factory=lambda: np.empty(0))
    total: np.ndarray = field(default_factory=lambda: np.empty(0))
    state: np.ndarray = field(default_factory=lambda: np.empty(0, bool))

    def places(self, h: np.ndarray) -> np.ndarray:
        """The place of each hash among the words, -1 for others."""
        if not len(self.words):
            return np.full(len(h), -1, np.int32)
        at = np.minimum(np.searchsorted(self.words, h), len(self.words) - 1)
        return np.where(self.words[at] == h, at, -1).astype(np.int32)

    def contexts(self, u: np.ndarray, v: np.ndarray) -> np.ndarray:
        """The pair of each two places of words as a context, -1 for others."""
        size = len(self.words)
        pairs = np.array([a * size + b for a, b in self.pairs], np.int64)
        if not len(pairs):
            return np.full(len(u), -1, np.int32)
        both = np.where((u >= 0) & (v >= 0), u.astype(np.int64) * size + v, -1)
        at = np.minimum(np.searchsorted(pairs, both), len(pairs) - 1)
        return np.where(pairs[at] == both, at + size, -1).astype(np.int32)

    def chance(self, context: np.ndarray, c: np.ndarray, lower: np.ndarray) -> np.ndarray:
        """The chance after each context of what followed it c times, by lower, its chance by the longest suffix state."""
        kinds = self.kinds[context]
        return np.where(self.state[context], (c + kinds * lower) / np.maximum(self.total[context] + kinds, 1), lower)


def _codes(r: dict, h: np.ndarray, seq: np.ndarray, hot: Hot) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What follows hot contexts in a block, as context times the number of hashes, plus symbol: the distinct ones, which of
    these each is, and the places of the symbols."""
    at = hot.places(h)
    v, u = (at[x] for x in _history(r, h, seq))
    follow = [(np.flatnonzero(x >= 0), x) for x in (v, hot.contexts(u, v))]
    place = np.concatenate([i for i, _ in follow])
    codes, which = np.unique(np.concatenate([x[i] for i, x in follow]).astype(np.int64) * len(h) + seq[place], return_inverse=True)
    return codes, which, place


def _by_owner(h: np.ndarray, codes: np.ndarray, owners: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Contexts and symbols' hashes of a block's codes in the order of the owners who are asked, that order, and where each
    owner's begin."""
    context, x = codes // len(h), h[codes % len(h)]
    owner = _range_of(x, owners)
    order = np.lexsort((x, context, owner))
    return context[order], x[order], order, np.searchsorted(owner[order], np.arange(owners + 1))


_FOLLOW = pa.schema([("owner", pa.int32()), ("block", pa.int64()), ("context", pa.binary()), ("symbol", pa.binary()), ("train", pa.binary())])


def _ask_follow(owners: int, hot: Hot):
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """What follows hot contexts in each block with its training counts, for the owners of the symbols."""
        for batch in batches:
            for r in map(_read, batch.to_pylist()):
                h, seq = r["hashes"], _plain(r["seq"]).astype(np.int32)
                codes, which, place = _codes(r, h, seq, hot)
                n = np.bincount(which, weights=_train(r)[place], minlength=len(codes)).astype(np.int64)
                context, x, order, cuts = _by_owner(h, codes, owners)
                n = n[order]
                rows = [{"owner": o, "block": r["block"], "context": _packed(context[a:z]), "symbol": _gaps(x[a:z]), "train": _packed(n[a:z])} for o, (a, z) in enumerate(zip(cuts[:-1], cuts[1:])) if z > a]
                yield pa.RecordBatch.from_pylist(rows, schema=_FOLLOW)

    return ask


_FOLLOWED = pa.schema([("block", pa.int64()), ("owner", pa.int32()), ("after", pa.binary()), ("context", pa.int32()), ("then", pa.int32()), *((k, pa.binary()) for k in ("count", "class", "lower", "kinds"))])
_FOLLOWED_DDL = "block long, owner int, after binary, context int, then int, count binary, class binary, lower binary, kinds binary"


def _merged(rows: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows, ascending, and the sums of their n."""
    order = np.lexsort(rows.T[::-1])
    rows, n = rows[order], n[order]
    first = np.flatnonzero(np.append(True, (np.diff(rows, axis=0) != 0).any(axis=1))) if len(rows) else np.empty(0, np.int64)
    return rows[first], np.add.reduceat(n, first) if len(first) else n


def _follow(hot: Hot, most: int):
    def follow(asked: pa.Table, known: pa.Table) -> pa.Table:
        """Counts for what each block asks, a histogram of each hot context (its count of a symbol, that symbol's class of counts
        at the root and count after the newest token alone; kinds: how many), and pairs of hot tokens that occur more than most times."""
        if not len(asked):
            return _FOLLOWED.empty_table()
        rows, told = asked.to_pylist(), known.to_pylist()
        parts = [_sums(r["symbol"]) for r in rows]
        context, x, n = np.concatenate([_plain(r["context"]) for r in rows]).astype(np.int64), np.concatenate(parts), np.concatenate([_plain(r["train"]) for r in rows])
        name = lambda context, x: mix(x + mix(context.astype(np.uint64) + _B))
        distinct, first, at = np.unique(name(context, x), return_index=True, return_inverse=True)
        c = np.bincount(at, weights=n).astype(np.int64)
        cuts = np.cumsum([0, *map(len, parts)])
        out = [{"block": r["block"], "owner": r["owner"], "after": _packed(c[at[a:z]])} for r, a, z in zip(rows, cuts[:-1], cuts[1:])]
        seen = np.flatnonzero(c)
        context, x, n = context[first][seen], x[first][seen], c[seen]
        if len(seen):
            words = _sums(told[0]["known"])
            kind = class_of(_plain(told[0]["c"]))[np.searchsorted(words, x)].astype(np.int64)
            newest = np.array([b for _, b in hot.pairs] + [0], np.int64)
            pair = context >= len(hot.words)
            lower = np.zeros(len(n), np.int64)
            lower[pair] = c[np.searchsorted(distinct, name(newest[context[pair] - len(hot.words)], x[pair]))]
            rows, kinds = _merged(np.stack([context, n, kind, lower], axis=1), np.ones(len(n), np.int64))
            for k in np.unique(rows[:, 0]).tolist():
                mine, packed = rows[:, 0] == k, {"context": k, "kinds": _packed(kinds[rows[:, 0] == k])}
                out.append({**packed, **{key: _packed(rows[mine, j]) for key, j in (("count", 1), ("class", 2), ("lower", 3))}})
            # nothing follows an end but the first word of another text, whose history is two ends
            then = np.where(x == END_HASH, -1, hot.places(x))
            out += [{"context": int(context[i]), "then": int(then[i])} for i in np.flatnonzero(~pair & (then >= 0) & (n > most))]
        give_back()
        return pa.Table.from_pylist(out, schema=_FOLLOWED)

    return follow


def _judge(hot: Hot, chances: np.ndarray):
    def judge(met: pa.Table) -> pa.Table:
        """kinds, total and state of one hot context."""
        rows = met.to_pylist()
        k = rows[0]["context"]
        part, kinds = _merged(*(np.concatenate([np.stack([_plain(r[key]) for key in keys], axis=-1).astype(np.int64) for r in rows]) for keys in (("count", "class", "lower"), ("kinds",))))
        c, kinds, below = part[:, 0], kinds[:, 0], chances[part[:, 1]]
        if k >= len(hot.words):
            below = hot.chance(np.full(len(c), hot.pairs[k - len(hot.words)][1]), part[:, 2], below)
        all_kinds, total = int(kinds.sum()), int((c * kinds).sum())
        p = (c + all_kinds * below) / (total + all_kinds)
        gain = (kinds * (c * np.log(p) - (c - 1) * np.log(below))).sum()
        return pa.table({"context": pa.array([k], pa.int32()), "n": pa.array([all_kinds], pa.int64()), "total": pa.array([total], pa.int64()), "state": pa.array([bool(gain > all_kinds * np.log(max(total, 2)) / 2)])})

    return judge


def _hot_contexts(blocks: DataFrame, known: DataFrame, words: list[int], owners: int, chances: np.ndarray, most: int) -> tuple[Hot, DataFrame]:
    """The hot contexts, and the counts after them that blocks asked for (block, owner, after)."""
    hot = Hot(np.sort(np.array(words, np.int64).view(np.uint64)))
    end = int(hot.places(np.array([END_HASH]))[0])
    hot.pairs = [(end, end)] if end >= 0 else []
    while True:
        asked = blocks.mapInArrow(_ask_follow(owners, hot), "owner int, block long, context binary, symbol binary, train binary")
        met = materialize(asked.groupBy("owner").cogroup(known.groupBy("owner")).applyInArrow(_follow(hot, most), _FOLLOWED_DDL))
        pairs = sorted({*hot.pairs, *((r.context, r.then) for r in met.filter("then IS NOT NULL").select("context", "then").collect())})
        if pairs == hot.pairs:
            break
        hot.pairs = pairs
    size = len(hot.words) + len(hot.pairs)
    hot.kinds, hot.total, hot.state = np.zeros(size), np.zeros(size), np.zeros(size, bool)
    for part in (F.col("context") < len(hot.words), F.col("context") >= len(hot.words)):  # a pair's state needs its newest token's
        told = met.filter(F.col("kinds").isNotNull() & part).groupBy("context").applyInArrow(_judge(hot, chances), "context int, n long, total long, state boolean")
        for r in told.collect():
            hot.kinds[r.context], hot.total[r.context], hot.state[r.context] = r.n, r.total, r.state
    return hot, met.filter("block IS NOT NULL").select("block", "owner", "after")


def _after(r: dict, hot: Hot, one: np.ndarray, pair: np.ndarray, x: np.ndarray, replies: list[dict], owners: int) -> tuple[np.ndarray, np.ndarray]:
    """How often the symbol of each event follows its newest token, if that is hot, and its pair, if that is: else 0."""
    h, out = r["hashes"], (np.zeros(len(x), np.int64), np.zeros(len(x), np.int64))
    if not len(hot.words):
        return out
    codes, *_ = _codes(r, h, _plain(r["seq"]).astype(np.int32), hot)
    sent = [_plain(y["after"]) for y in sorted((y for y in replies if y["after"] is not None), key=lambda y: y["owner"])]
    if sum(map(len, sent)) != len(codes):
        raise RuntimeError(f"{sum(map(len, sent))} counts came back for {len(codes)} pairs: the input's rows have changed")
    if len(codes):
        c = np.empty(len(codes), np.int64)
        c[_by_owner(h, codes, owners)[2]] = np.concatenate(sent)
        for to, k in zip(out, (one, pair)):
            i = np.flatnonzero(k >= 0)
            to[i] = c[np.searchsorted(codes, k[i].astype(np.int64) * len(h) + x[i])]
    return out


# --- events


def _events(r: dict, c: np.ndarray, owners: int, most: int | None = None, hot: Hot | None = None, number: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """A block's distinct events in the order of their owners and contexts: where each owner's begin (those after hot pairs,
    which have no owner, come last), context (48 bits), the number of the token before it unless the context is of both, that
    of the symbol, its place, the hot token and the hot pair that it follows, or -1; and which event each token is."""
    h, seq = np.frombuffer(r["hashes"], np.uint64), _plain(r["seq"]).astype(np.int32)
    number = np.where(c > 0, np.arange(1, len(h) + 1), 0).astype(np.uint32) if number is None else number
    v, u = _history(r, h, seq)
    known = np.where(c > 0, h, np.uint64(0))  # all unknown tokens are one symbol
    key = (known * _A)[u] + (known * _B)[v] + (known * _C)[seq]
    _, place, which = np.unique(mix(key), return_index=True, return_inverse=True)
    del key
    which = which.astype(np.int32)
    u, v, x = u[place], v[place], seq[place]
    del place
    hot = hot or Hot()
    at = hot.places(h)
    one, pair = at[v], hot.contexts(at[u], at[v])
    both = (c > (OWNER_EVENTS if most is None else most))[v]  # an owner has all that end in a token, or in two
    # what follows unknown tokens follows no context of training: any owner will do
    any_of = np.where(both, c[u] == 0, c[v] == 0)
    context = mix(known[v] + np.where(both | any_of, mix(known[u] + _B + np.where(any_of, known[x] * _C, np.uint64(0))), np.uint64(0)))
    u = np.where(both, np.uint32(0), number[u])
    del v, any_of, both
    owner = np.where(pair < 0, _range_of(context, owners), np.uint64(owners))
    order = np.lexsort((u, context & _LOW, one, owner)).astype(np.int32)
    rank = np.empty(len(order), np.int32)
    rank[order] = np.arange(len(order), dtype=np.int32)
    return np.searchsorted(owner[order], np.arange(owners + 1)), context[order] & _LOW, u[order], number[x][order], x[order], one[order], pair[order], rank[which]


_EVENTS = pa.schema([("place", pa.int32()), ("block", pa.int64()), *((k, pa.binary()) for k in ("context", "before", "symbol", "root", "train", "hot", "after"))])
_EVENTS_DDL = "place int, block long, context binary, before binary, symbol binary, root binary, train binary, hot binary, after binary"


def _ask_events(owners: int, most: int, hot: Hot, asked_owners: int, numbers: dict[int, int]):
    def ask(own: pa.Table, replies: pa.Table) -> pa.Table:
        r, back = _read(own.to_pylist()[0]), replies.to_pylist()
        c, number = _known(r["hashes"], back, numbers)
        cuts, context, before, symbol, x, one, pair, which = _events(r, c, owners, most, hot, number)
        root = class_of(c)[x]
        n = np.bincount(which, weights=_train(r), minlength=len(x)).astype(np.int64)
        after, _ = _after(r, hot, one, pair, x, back, asked_owners)
        out = []
        for o, (a, z) in enumerate(zip(cuts[:-1], cuts[1:])):
            if z > a:
                b = a + int(np.searchsorted(one[a:z], 0))  # from here on after hot tokens
                row = {"context": _packed(np.diff(context[a:z], prepend=np.uint64(0)) & _LOW), "before": _gaps(before[a:z]), "symbol": _packed(symbol[a:z]), "root": _packed(root[a:z])}
                out.append({"place": o, "block": r["block"], **row, "train": _packed(n[a:z]), "hot": _packed(one[b:z]), "after": _packed(after[b:z])})
        give_back()
        return pa.Table.from_pylist(out, schema=_EVENTS)

    return ask


def _state(context: np.ndarray, event: np.ndarray, n: np.ndarray, lower: np.ndarray) -> np.ndarray:
    """The chance of each event by its context if that is a state, else lower, its chance by the longest suffix state.

    context and event name rows' contexts and events (a context's symbols); rows of one event add up their counts n.
    """
    _, first, at = np.unique(event, return_index=True, return_inverse=True)
    c, below = np.bincount(at, weights=n), lower[first]
    _, of = np.unique(context[first], return_inverse=True)
    kinds, total = np.bincount(of, weights=c > 0), np.bincount(of, weights=c)
    p = (c + kinds[of] * below) / np.maximum(total + kinds, 1)[of]
    seen = c > 0
    gain = np.bincount(of, weights=np.where(seen, c * np.log(np.where(seen, p, 1)) - (c - 1) * np.log(below), 0))
    state = gain > kinds * np.log(np.maximum(total, 2)) / 2
    return np.where(state[of], p, below)[at]


def grow(context: np.ndarray, before: np.ndarray, symbol: np.ndarray, n: np.ndarray, root: np.ndarray, hot: np.ndarray | None = None) -> np.ndarray:
    """The chance of each event by its longest suffix state, from the events of all contexts that end alike.

    Where hot, context is of both tokens and root the chance after the newest.
    """
    one, x = mix(context.astype(np.uint64)), symbol.astype(np.uint64) * _C
    cold = slice(None) if hot is None else ~hot
    p = root.astype(np.float64)
    p[cold] = _state(one[cold], mix(one[cold] + x[cold]), n[cold], root[cold])
    two = mix(one + before.astype(np.uint64) * _A)
    return _state(two, mix(two + x), n, p)


#: Steps of a log chance, which is told in whole ones.
STEPS = 8192


def _steps(chance: np.ndarray) -> np.ndarray:
    """The log chance of each event, in steps."""
    return np.rint(-np.log10(np.minimum(chance, 1)) * STEPS).astype(np.uint32)


_REPLY = pa.schema([("block", pa.int64()), ("owner", pa.int32()), ("c", pa.binary()), ("number", pa.binary()), ("logs", pa.binary()), ("after", pa.binary())])
_REPLY_DDL = "block long, owner int, c binary, number binary, logs binary, after binary"


def _answer(chances: np.ndarray, hot: Hot):
    def answer(asked: pa.Table) -> pa.Table:
        """The log chance of each event, a reply for each block."""
        rows = asked.to_pylist()
        context = [_sums(r["context"]) & _LOW for r in rows]
        before = np.concatenate([_sums(r["before"], np.uint32) for r in rows])
        n, root = (np.concatenate([_plain(r[k]) for r in rows]).astype(np.int64) for k in ("train", "root"))
        symbol = np.concatenate([_plain(r["symbol"]) for r in rows])
        after, one = (np.concatenate([_plain(r[k]) for r in rows]).astype(np.int64) for k in ("after", "hot"))
        cuts, lower = np.cumsum([0, *map(len, context)]), chances[root]
        is_hot = np.zeros(len(n), bool)
        for r, z in zip(rows, cuts[1:]):
            is_hot[z - int.from_bytes(r["hot"][1:9], "little") : z] = True
        if len(one):
            lower[is_hot] = hot.chance(one, after, lower[is_hot])
        steps = _steps(grow(np.concatenate(context), before, symbol, n, lower, is_hot))
        out = [{"block": r["block"], "owner": r["place"], "logs": _packed(steps[a:z])} for r, a, z in zip(rows, cuts[:-1], cuts[1:])]
        give_back()
        return pa.Table.from_pylist(out, schema=_REPLY)

    return answer


# --- documents

_DOCS = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("logs", pa.float64()), ("score", pa.float64())])
_DOCS_DDL = "doc_id long, held_out boolean, n_tokens long, n_known long, logs double, score double"


def _add_up(owners: int, most: int, hot: Hot, chances: np.ndarray, asked_owners: int, numbers: dict[int, int]):
    def add_up(own: pa.Table, replies: pa.Table) -> pa.Table:
        """The documents of one block with their sums of log10(c + 1) and of the log chances of their tokens."""
        if not len(own):
            return _DOCS.empty_table()
        r, back = _read(own.to_pylist()[0]), replies.to_pylist()
        c, number = _known(r["hashes"], back, numbers)
        cuts, _, _, _, x, one, pair, which = _events(r, c, owners, most, hot, number)
        steps = [_plain(y["logs"]) for y in sorted((y for y in back if y["logs"] is not None), key=lambda y: y["owner"])]
        if sum(map(len, steps)) != cuts[-1]:
            raise RuntimeError(f"{sum(map(len, steps))} chances came back for {cuts[-1]} events: the input's rows have changed")
        if cuts[-1] < len(x):
            ones, pairs = (k[cuts[-1] :] for k in _after(r, hot, one, pair, x, back, asked_owners))
            lower = hot.chance(one[cuts[-1] :], ones, chances[class_of(c)[x[cuts[-1] :]]])
            steps.append(_steps(hot.chance(pair[cuts[-1] :], pairs, lower)))
        logs = np.concatenate(steps).astype(np.float64) / -STEPS
        seq = _plain(r["seq"])
        doc = np.repeat(np.arange(len(r["tokens"])), r["tokens"])
        base, known, score = (np.bincount(doc, weights=y, minlength=len(r["tokens"])) for y in (np.log10(c + 1)[seq], (c > 0)[seq], logs[which]))
        out = pa.table([pa.array(r["doc_ids"], pa.int64()), pa.array(r["held"], pa.bool_()), pa.array(r["tokens"], pa.int64()), pa.array(known.astype(np.int64)), pa.array(base), pa.array(score)], schema=_DOCS)
        give_back()
        return out

    return add_up


def held_out(id_col: str = "doc_id") -> F.Column:
    """Rows that training must not see."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 7 == 2


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_events: int = OWNER_EVENTS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row of docs.

    A null or empty text is the end token alone.  Rows with a null id are not held out.  Repeated rows count as often as
    they stand, and equal texts have equal scores.  Without training rows every token is the unknown one, with chance 1.  A
    text of any length lies in one block.  Other columns are not read; no rows give no rows.  owner_events bounds the work of a
    task and changes no score.
    """
    spark = docs.sparkSession
    rows = text_rows(docs, id_col, text_col).withColumn("held_out", F.coalesce(held_out("doc_id"), F.lit(False)))
    blocks = rows.select("doc_id", "text", "held_out").mapInArrow(task(_blocks), _BLOCK_DDL)
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    words = rows.agg(F.coalesce(F.sum(F.floor(F.octet_length("text") / 6) + 1), F.lit(0))).first()[0]  # about; owners follow the input
    asked_owners = max(least, -(-words // OWNER_HASHES))
    asked = blocks.mapInArrow(task(_ask_counts(asked_owners)), "owner int, block long, hashes binary, train binary")
    counted = materialize(asked.groupBy("owner").applyInArrow(_count(owner_events), _COUNTS_DDL))
    classes = {r[0]: (r[1], r[2]) for r in counted.filter("class IS NOT NULL").groupBy("class").agg(F.sum("tokens"), F.sum("total")).collect()}
    v, n = (sum(t[k] for t in classes.values()) for k in (0, 1))
    if v >= 1 << 32:
        raise ValueError(f"{v} distinct training tokens: numbers of tokens have 32 bits")
    ranges = sorted((r.owner, r.tokens) for r in counted.filter("known IS NOT NULL").select("owner", "tokens").collect())
    numbers = {o: sum_before for (o, _), sum_before in zip(ranges, accumulate((k for _, k in ranges), initial=0))}
    chances, hot = root_chances(classes), Hot()
    binary = lambda *names: [F.lit(None).cast("binary").alias(x) for x in names]
    counts = counted.filter("block IS NOT NULL").select("block", "owner", "c", "number", *binary("logs", "after"))
    often = [r.hot for r in counted.filter("hot IS NOT NULL").select("hot").collect()]
    if often:
        hot, after = _hot_contexts(blocks, counted.filter("known IS NOT NULL").select("owner", "known", "c"), often, asked_owners, chances, owner_events)
        counts = counts.union(after.select("block", "owner", *binary("c", "number", "logs"), "after"))
    owners = max(least, -(-words // owner_events))
    events = blocks.groupBy("block").cogroup(counts.groupBy("block")).applyInArrow(_ask_events(owners, owner_events, hot, asked_owners, numbers), _EVENTS_DDL)
    answers = events.groupBy("place").applyInArrow(_answer(chances, hot), _REPLY_DDL)
    met = blocks.groupBy("block").cogroup(counts.union(answers).groupBy("block")).applyInArrow(_add_up(owners, owner_events, hot, chances, asked_owners, numbers), _DOCS_DDL)
    base = F.col("logs") - F.col("n_tokens") * F.log10(F.lit(float(n + v + 1)))
    return met.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), base.alias("base_score"), "score")
