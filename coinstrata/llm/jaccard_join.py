"""Jaccard join on word shingles: size-banded tiles with bitmap signatures, then exact intersection.

Sets A and B link when 100 |A n B| >= 80 |A u B|; then 0.8 <= |A| / |B| <= 1.25 and |A n B| >= t = 0.8 |A|.  With all
hashes in one order, the first |A| - t + k of A and of B share k at least.

1. Sets: every text's sorted 64-bit shingle hashes are reduced to a size and a sum; equal sets are one class, so copies
   cost one row each from here on.
2. Sieve: senders deal the first 0.2 |A| + 0.1 |A| hashes of each class, as sorted and gap-coded blocks, to owners of hash
   ranges, who count for each class those that some other class holds too.  Classes with fewer than 0.1 |A| can't link.
3. Entries: blocks of what is left ask owners of ranges how many classes hold each hash; an owner sends one reply a block,
   and owners follow the number of hashes.  In the order of these counts, rare ones first, the first |A| - t + 1 of a class index it; those that no other class holds take part in the order
   but need no bucket, so a class with a fifth of its own hashes has none.
4. Stars: the class of a bucket with the fewest hashes of its own, which is near the middle of its copies, is compared with
   all of it, in two rounds (two ways to break ties), which is linear, and links found make components.
5. Tiles: in buckets that still hold several components, cut into blocks of at most BLOCK classes in order of size, the
   classes of any two blocks of compatible sizes meet in a tile.  Signatures are bitmaps of the hashes that other classes
   hold too; own hashes are counted.  Both bound the overlap from above: A lacks in B its own hashes and at least one for
   each bit that only a has, |A n B| <= |A| - own(A) - |a and not b|.  Pairs of different components that pass are
   intersected.
6. Components of all links; a class's documents share its component.

No pair within a component has to be looked at twice, so a group of n near copies costs about n comparisons.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coinstrata.llm._common import chunks, give_back, materialize, mix, shingle_sets, small_side, task, text_rows
from coinstrata.llm.components import components

#: Percent of the union that the intersection must reach.
LEVEL = 80
#: Classes of a block of a tile.
BLOCK = 1024
#: Bits of hashes that the sieve compares; equal cuts of unequal hashes only let a class through.
SIEVE_BITS = 44
_SEED = np.uint64(0xA24BAED4963EE407)


def needed(n: np.ndarray | int) -> np.ndarray | int:
    """The least intersection that a set of n has with any partner."""
    return (n * LEVEL + 99) // 100


def extra(n: np.ndarray | int) -> np.ndarray | int:
    """Hashes that the sieve takes beyond the prefix; a class must share one more than these."""
    return n // 10


def set_id(hashes: np.ndarray) -> tuple[int, int]:
    a, b = mix(hashes).sum(dtype=np.uint64), mix(hashes ^ _SEED).sum(dtype=np.uint64)
    return int(np.asarray(a).view(np.int64)), int(np.asarray(b).view(np.int64))


def signature(hashes: np.ndarray) -> np.ndarray:
    """A bitmap of at least twice as many bits as hashes, a power of two from 512 to 65,536, as 64-bit words."""
    bits = 1 << min(16, max(9, int(2 * len(hashes) - 1).bit_length()))
    flags = np.zeros(bits, dtype=np.uint8)
    flags[(hashes & np.uint64(bits - 1)).astype(np.int64)] = 1
    return np.packbits(flags, bitorder="little").view(np.uint64)


def fold(words: np.ndarray, width: int) -> np.ndarray:
    """Signatures (rows of words) cut to width words; a bit is set if any that falls on it was."""
    while words.shape[-1] > width:
        half = words.shape[-1] // 2
        words = words[..., :half] | words[..., half:]
    return words


def may_link(na, nb, only_a, only_b) -> np.ndarray:
    """Whether sizes and the counts of bits that only one side has leave a link possible."""
    most = np.minimum(na - only_a, nb - only_b)
    return (100 + LEVEL) * most >= LEVEL * (na + nb)


_SETS = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64())])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, z, texts in chunks(batch):
            sets = shingle_sets(texts)
            ids = [set_id(h) for h in sets]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, z - a), pa.array([len(h) for h in sets], pa.int64()), pa.array([i[0] for i in ids], pa.int64()), pa.array([i[1] for i in ids], pa.int64())], schema=_SETS)


_BLOCKS = pa.schema([("owner", pa.int32()), ("gaps", pa.binary()), ("wide", pa.bool_()), ("at", pa.binary()), ("nodes", pa.binary())])
#: Hashes that a task gathers before it sends blocks.
GATHER = 700_000


def _deal(owners: int):
    def block(hashes: list[np.ndarray], nodes: list[int]) -> pa.RecordBatch:
        h = np.concatenate(hashes) >> np.uint64(64 - SIEVE_BITS)
        at = np.repeat(np.arange(len(hashes), dtype=np.uint32), [len(x) for x in hashes])
        order = np.argsort(h, kind="stable")
        h, at = h[order], at[order]
        ids = np.array(nodes, dtype=np.int64)
        cuts = np.searchsorted((h >> np.uint64(SIEVE_BITS - 24)) * np.uint64(owners) >> np.uint64(24), np.arange(owners + 1))
        rows = []
        for o, (a, z) in enumerate(zip(cuts[:-1], cuts[1:])):
            if z > a:
                gaps = np.diff(h[a:z], prepend=np.uint64(0))
                wide = bool((gaps[1:] >> np.uint64(32)).any())
                own, short = np.unique(at[a:z], return_inverse=True)
                head = gaps[:1].tobytes()
                rows.append({"owner": o, "gaps": head + gaps[1:].astype(np.uint64 if wide else np.uint32).tobytes(), "wide": wide, "at": short.astype(np.uint32 if len(own) > 65536 else np.uint16).tobytes(), "nodes": ids[own].tobytes()})
        return pa.RecordBatch.from_pylist(rows, schema=_BLOCKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes: list[np.ndarray] = []
        nodes: list[int] = []
        seen: set[int] = set()
        size = 0
        for batch in batches:
            for _, _, texts in chunks(batch):
                for h in shingle_sets(texts):
                    n = len(h)
                    if n and (node := set_id(h)[0]) not in seen:
                        seen.add(node)
                        first = h[: n - needed(n) + 1 + extra(n)]
                        hashes.append(first.copy())
                        nodes.append(node)
                        size += len(first)
                if size >= GATHER:
                    yield block(hashes, nodes)
                    hashes, nodes, seen, size = [], [], set(), 0
        if hashes:
            yield block(hashes, nodes)

    return run


_SHARED = pa.schema([("node", pa.int64()), ("shared", pa.int64())])


def _count_shared(blocks: pa.Table) -> pa.Table:
    """For each class the number of its hashes in this range that another class holds."""
    hashes, nodes = [], []
    for r in blocks.to_pylist():
        head, rest = np.frombuffer(r["gaps"][:8], np.uint64), np.frombuffer(r["gaps"][8:], np.uint64 if r["wide"] else np.uint32)
        hashes.append(np.cumsum(np.concatenate([head, rest.astype(np.uint64)]), dtype=np.uint64))
        ids = np.frombuffer(r["nodes"], np.int64)
        nodes.append(ids[np.frombuffer(r["at"], np.uint32 if len(ids) > 65536 else np.uint16)])
    h, node = np.concatenate(hashes), np.concatenate(nodes)
    order = np.lexsort((node, h))
    h, node = h[order], node[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (node[1:] != node[:-1])
    h, node = h[new], node[new]
    same = h[1:] == h[:-1]
    shared = np.zeros(len(h), dtype=bool)
    shared[1:] |= same
    shared[:-1] |= same
    ids, counts = np.unique(node[shared], return_counts=True)
    return pa.table([pa.array(ids), pa.array(counts.astype(np.int64))], schema=_SHARED)


_CLASSES = pa.schema([("node", pa.int64()), ("n", pa.int64()), ("hashes", pa.binary())])


def _arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, _, texts in chunks(batch):
            rows = [{"node": set_id(h)[0], "n": len(h), "hashes": h.tobytes()} for h in shingle_sets(texts) if len(h)]
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=_CLASSES)


#: Hashes that one owner of a range counts.
OWNER_HASHES = 500_000

_NODES = pa.schema([("node", pa.int64()), ("n", pa.int64()), ("own", pa.int64()), ("bits", pa.binary()), ("entries", pa.list_(pa.int64()))])
_ASKED = pa.schema([("owner", pa.int32()), ("block", pa.int64()), ("h", pa.binary())])
_BLOCK_OF = pa.schema([("block", pa.int64()), ("nodes", pa.binary()), ("sizes", pa.binary()), ("h", pa.binary())])
_COUNTED = pa.schema([("block", pa.int64()), ("owner", pa.int32()), ("k", pa.binary())])


def _blocks_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[int], list[np.ndarray]]]:
    """A task's classes in blocks of about GATHER hashes: number, nodes, hashes.  The same each time a task runs."""
    number, hashes, nodes, size = TaskContext.get().partitionId() << 32, [], [], 0
    for batch in batches:
        for node, raw in zip(batch.column("node").to_pylist(), batch.column("hashes").to_pylist()):
            hashes.append(np.frombuffer(raw, np.uint64))
            nodes.append(node)
            size += len(hashes[-1])
            if size >= GATHER:
                yield number, nodes, hashes
                number, hashes, nodes, size = number + 1, [], [], 0
    if hashes:
        yield number, nodes, hashes


def _by_owner(h: np.ndarray, owners: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of hashes by owner, and where each owner's begin in it."""
    owner = (h >> np.uint64(40)) * np.uint64(owners) >> np.uint64(24)
    order = np.argsort(owner, kind="stable")
    return order, np.searchsorted(owner[order], np.arange(owners + 1))


def _ask(owners: int):
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The hashes of each block, for the owners of ranges."""
        for number, _, hashes in _blocks_of(batches):
            h = np.concatenate(hashes)
            order, cuts = _by_owner(h, owners)
            h = h[order]
            rows = [{"owner": o, "block": number, "h": h[a:z].tobytes()} for o, (a, z) in enumerate(zip(cuts[:-1], cuts[1:])) if z > a]
            yield pa.RecordBatch.from_pylist(rows, schema=_ASKED)

    return ask


def _block_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each block with its classes, for itself."""
    for number, nodes, hashes in _blocks_of(batches):
        row = {"block": number, "nodes": np.array(nodes, np.int64).tobytes(), "sizes": np.array([len(x) for x in hashes], np.int64).tobytes(), "h": np.concatenate(hashes).tobytes()}
        yield pa.RecordBatch.from_pylist([row], schema=_BLOCK_OF)


def _frequencies(asked: pa.Table) -> pa.Table:
    """For each block's hashes of this range, in the block's order, how many classes hold each: one reply a block."""
    parts = [np.frombuffer(h, np.uint64) for h in asked.column("h").to_pylist()]
    _, at, k = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
    k = k[at].astype(np.uint32)
    cuts = np.cumsum([0, *map(len, parts)]).tolist()
    return pa.table([asked.column("block"), asked.column("owner"), pa.array([k[a:z].tobytes() for a, z in zip(cuts[:-1], cuts[1:])], pa.binary())], schema=_COUNTED)


def _nodes(owners: int):
    def nodes(own: pa.Table, replies: pa.Table) -> pa.Table:
        """For each class of a block that may link its number of own hashes, the signature of the others, and its entries: the
        first hashes in order of frequency that some other class holds.  Any partner has one of them among its own first ones."""
        r = own.to_pylist()[0]
        h, sizes = np.frombuffer(r["h"], np.uint64), np.frombuffer(r["sizes"], np.int64)
        order, _ = _by_owner(h, owners)
        k = np.empty(len(h), np.uint32)
        k[order] = np.concatenate([np.frombuffer(x["k"], np.uint32) for x in sorted(replies.to_pylist(), key=lambda x: x["owner"])])
        out, at = [], 0
        for node, n in zip(np.frombuffer(r["nodes"], np.int64).tolist(), sizes.tolist()):
            on = np.flatnonzero(k[at : at + n] > 1) + at
            at += n
            own_hashes = n - len(on)
            first = n - needed(n) + 1 - own_hashes
            if first > 0:
                out.append((node, n, own_hashes, signature(h[on]).tobytes(), h[on][np.lexsort((h[on], k[on]))[:first]].view(np.int64)))
        give_back()
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out), _NODES.types)], schema=_NODES) if out else _NODES.empty_table()

    return nodes


_PAIRS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _kept(batch: pa.RecordBatch, keep: list[bool]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], schema=_PAIRS).filter(pa.array(keep, pa.bool_()))


#: Pairs whose hashes are at hand at once.
SLICE = 200


def _bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = []
        for na, nb, ua, ub, x, y in zip(*(batch.column(c).to_pylist() for c in ("n_a", "n_b", "own_a", "own_b", "bits_a", "bits_b"))):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            width = min(len(x), len(y))
            x, y = fold(x, width), fold(y, width)
            keep.append(bool(may_link(na, nb, ua + int(np.bitwise_count(x & ~y).sum()), ub + int(np.bitwise_count(y & ~x).sum()))))
        yield _kept(batch, keep)


def _intersect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = []
        for at in range(0, batch.num_rows, SLICE):
            part = batch.slice(at, SLICE)
            for x, y in zip(part.column("hashes_a").to_pylist(), part.column("hashes_b").to_pylist()):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                common = len(x) + len(y) - len(np.unique(np.concatenate([x, y])))
                keep.append(100 * common >= LEVEL * (len(x) + len(y) - common))
        yield _kept(batch, keep)


def _with(pairs: DataFrame, nodes: DataFrame, columns: list[str]) -> DataFrame:
    for side in "ab":
        pairs = pairs.join(nodes.select(F.col("node").alias(side), *(F.col(c).alias(f"{c}_{side}") for c in columns)), side)
    return pairs


def verified(pairs: DataFrame, nodes: DataFrame, classes: DataFrame, tasks: int, bounded: bool = False) -> DataFrame:
    """The pairs (a, b) that link."""
    if not bounded:
        pairs = materialize(_with(pairs, nodes, ["n", "own", "bits"]).mapInArrow(task(_bound), "a long, b long"), tasks)
    return _with(pairs, classes, ["hashes"]).mapInArrow(task(_intersect), "a long, b long")


def _compatible(x: str, y: str) -> F.Column:
    return (F.least(x, y) * 100 >= F.greatest(x, y) * LEVEL)


def _stars(entries: DataFrame, tie) -> DataFrame:
    """Distinct pairs of a bucket's head with its other classes of compatible size."""
    heads = entries.groupBy("h").agg(F.min(F.struct("own", tie.alias("tie"), "node", "n")).alias("head"), F.count("*").alias("k")).filter("k > 1").select("h", F.col("head.node").alias("a"), F.col("head.n").alias("m"))
    return entries.join(heads, "h").filter((F.col("node") != F.col("a")) & _compatible("n", "m")).select("a", F.col("node").alias("b")).distinct()


def _meet(node: np.ndarray, root: np.ndarray, n: np.ndarray, own: np.ndarray, side: np.ndarray, bits: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of one tile that may link: of its left and right block, of different components, each once."""
    signs = [np.frombuffer(b, np.uint64) for b in bits]
    width = min(len(b) for b in signs)
    words = np.stack([fold(b, width) for b in signs])
    left, right = np.flatnonzero(side < 2), np.flatnonzero(side != 1)  # side 0: both, 1: left, 2: right
    out = [(node[:0], node[:0])]
    step = max(1, (1 << 20) // max(1, len(right) * width))
    for at in range(0, len(left), step):
        i = left[at : at + step]
        a, b = words[i][:, None, :], words[right][None, :, :]
        only_a, only_b = np.bitwise_count(a & ~b).sum(axis=2, dtype=np.int64), np.bitwise_count(b & ~a).sum(axis=2, dtype=np.int64)
        ok = may_link(n[i][:, None], n[right][None, :], own[i][:, None] + only_a, own[right][None, :] + only_b) & (root[i][:, None] != root[right][None, :])
        ok &= (side[i][:, None] > 0) | (node[i][:, None] < node[right][None, :])
        x, y = np.nonzero(ok)
        out.append((node[i[x]], node[right[y]]))
    a, b = (np.concatenate(c) for c in zip(*out))
    return np.minimum(a, b), np.maximum(a, b)


def _meet_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """_meet of each tile in rows sorted by tile; a tile has two blocks of rows at most."""
    found: list[tuple[np.ndarray, np.ndarray]] = []

    def close(rows: pa.Table) -> None:
        if len(rows) > 1:
            found.append(_meet(*(np.asarray(rows.column(c)) for c in ("node", "root", "n", "own", "side")), rows.column("bits").to_pylist()))

    def sent() -> pa.RecordBatch:
        a, b = np.unique(np.stack([np.concatenate(c) for c in zip(*found)]), axis=1)
        found.clear()
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=_PAIRS)

    rest: pa.Table | None = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        rows = rows if rest is None else pa.concat_tables([rest, rows])
        rows = rows.combine_chunks()
        new = np.zeros(len(rows), dtype=bool)
        for c in ("h", "lo", "up", "i", "j"):
            x = np.asarray(rows.column(c))
            new[1:] |= x[1:] != x[:-1]
        cuts = [0, *np.flatnonzero(new).tolist()]
        for a, z in zip(cuts[:-1], cuts[1:]):
            close(rows.slice(a, z - a))
        rest = rows.slice(cuts[-1])
        if sum(len(a) for a, _ in found) > 100_000:
            yield sent()
    if rest is not None:
        close(rest)
    if found:
        yield sent()


def _tiles(open_rows: DataFrame) -> DataFrame:
    """open_rows (h, node, root, n, own, k) dealt to the tiles of their bucket: band and block by block.

    A band holds sizes within a factor of 1.25, so partners are of one band or of neighbouring ones.  A block of a band is
    a share of its nodes by their (random) number, as many as the bucket's rows need.  Tiles whose rows are all of one
    component are left out before any row is copied to them.
    """
    blocks = F.greatest(F.lit(1), F.ceil(F.col("k") / BLOCK)).cast("long")
    rows = open_rows.withColumn("band", F.floor(F.log(F.col("n").cast("double")) / np.log(100 / LEVEL) + 1e-9).cast("long")).withColumn("block", F.pmod("node", blocks))
    cells = rows.groupBy("h", "band", "block").agg(F.min("root").alias("low"), F.max("root").alias("high"))
    # all cells of a band and of the next one, in one array for each cell: a bucket has few cells, as each is a block of rows
    shown = F.struct("block", "low", "high")
    bands = cells.groupBy("h", "band").agg(F.collect_list(shown).alias("cells"))
    upper = bands.select("h", (F.col("band") - 1).alias("band"), F.col("cells").alias("above"))
    both = bands.join(upper, ["h", "band"], "left")

    def tiles_of(cell, others, up):
        mixed = F.filter(others, lambda o: F.least(cell["low"], o["low"]) != F.greatest(cell["high"], o["high"]))
        return F.transform(mixed, lambda o: F.struct(F.lit(up).alias("up"), cell["block"].alias("i"), o["block"].alias("j")))

    own = F.flatten(F.transform("cells", lambda c: tiles_of(c, F.filter("cells", lambda o: o["block"] >= c["block"]), 0)))
    next_up = F.flatten(F.transform("cells", lambda c: tiles_of(c, F.coalesce("above", F.array().cast("array<struct<block:bigint,low:bigint,high:bigint>>")), 1)))
    tiles = both.select("h", F.col("band").alias("lo"), F.explode(F.concat(own, next_up)).alias("t")).select("h", "lo", "t.*")
    # each tile's one or two cells: side 0 both, 1 left, 2 right
    left = F.struct(F.col("lo").alias("band"), F.col("i").alias("block"), F.when((F.col("up") == 0) & (F.col("i") == F.col("j")), 0).otherwise(1).alias("side"))
    right = F.struct((F.col("lo") + F.col("up")).alias("band"), F.col("j").alias("block"), F.lit(2).alias("side"))
    sides = tiles.select("*", F.explode(F.filter(F.array(left, right), lambda c: (c["side"] < 2) | (F.col("up") == 1) | (F.col("i") != F.col("j")))).alias("c")).select("h", "lo", "up", "i", "j", "c.*")
    return rows.join(sides, ["h", "band", "block"]).select("h", "node", "root", "n", "own", "lo", "up", "i", "j", "side")


def links(docs: DataFrame, sets: DataFrame, every: bool = False) -> DataFrame:
    """Links (a, b) between classes (s1 of sets) that join all classes of a component; docs has doc_id and text.

    Only enough links to connect: pairs already within a component are not looked at, so these are not all links.  With every,
    all links come, each once: no pair is left out for its component, so k near copies of one text make up to k^2 / 2 rows.
    """
    spark = docs.sparkSession
    owners = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = docs.select("text").mapInArrow(task(_deal(owners)), "owner int, gaps binary, wide boolean, at binary, nodes binary")
    shared = blocks.groupBy("owner").applyInArrow(_count_shared, "node long, shared long").groupBy("node").agg(F.sum("shared").alias("shared"))
    reps = sets.filter("n > 0").groupBy(F.col("s1").alias("node"), "n").agg(F.min("doc_id").alias("_rep"))
    left = materialize(reps.join(shared.filter("shared > 0"), "node").filter("shared > floor(n / 10)").select("_rep", "node", "n"))
    total = left.agg(F.sum("n")).first()[0] or 0
    tasks = -(-total // GATHER) + 1  # what is left may be little; it needs no more tasks than it has blocks
    chosen = small_side(left.select("_rep").distinct())
    texts = docs.join(chosen, F.col("doc_id").eqNullSafe(F.col("_rep")), "left_semi")
    arrays = texts.select("text").mapInArrow(task(_arrays), "node long, n long, hashes binary")
    classes = materialize(arrays.join(left.select("node"), "node", "left_semi").dropDuplicates(["node"]), tasks)
    few = -(-total // OWNER_HASHES) + 1
    replies = classes.select("node", "hashes").mapInArrow(task(_ask(few)), "owner int, block long, h binary").groupBy("owner").applyInArrow(_frequencies, "block long, owner int, k binary")
    own = classes.select("node", "hashes").mapInArrow(task(_block_rows), "block long, nodes binary, sizes binary, h binary")
    nodes = materialize(own.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(_nodes(few), "node long, n long, own long, bits binary, entries array<long>"), tasks)
    entries = nodes.select(F.explode("entries").alias("h"), "node", "n", "own")
    if every:  # each class is a component of its own, so every tile meets
        found = spark.createDataFrame([], "a long, b long")
        labelled = materialize(entries.withColumn("root", F.col("node")), tasks)
    else:
        found = materialize(verified(_stars(entries, F.col("node")), nodes, classes, tasks), tasks)
        pairs = _stars(entries, -F.col("node")).join(found, ["a", "b"], "left_anti")
        found = materialize(found.union(verified(pairs, nodes, classes, tasks)), tasks)
        roots = components(found)
        labelled = materialize(entries.join(roots, "node", "left").select("h", "node", "n", "own", F.coalesce("root", "node").alias("root")), tasks)
    several = labelled.groupBy("h").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("k")).filter("lo <> hi").select("h", "k")
    tile = ["h", "lo", "up", "i", "j"]
    rows = _tiles(materialize(labelled.join(several, "h"), tasks)).join(nodes.select("node", "bits"), "node")
    pairs = rows.repartition(owners, *tile).sortWithinPartitions(*tile).mapInArrow(task(_meet_all), "a long, b long").distinct()
    return found.union(verified(pairs, nodes, classes, tasks, bounded=True))


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id for each row of docs.

    A null text, an empty one and one of white space have no shingles and link with nothing: their component is their own
    id.  Texts of fewer than five words are one shingle.  component_id is the least id reachable; null ids take part in
    links and are ignored by the minimum.  Repeated rows have equal sets and link.  Other columns are not read; no rows
    give no rows.
    """
    rows = text_rows(docs, id_col, text_col)
    sets = materialize(rows.mapInArrow(task(_sets), "doc_id long, n long, s1 long, s2 long"))
    roots = components(materialize(links(rows, sets)))  # a stage each for the Python steps before and after, so no task needs two workers
    classes = sets.filter("n > 0").groupBy("s1", "s2", "n").agg(F.min("doc_id").alias("low"), F.count("*").alias("k"))
    rooted = materialize(classes.join(roots.withColumnRenamed("node", "s1"), "s1", "left").withColumn("root", F.coalesce("root", "s1")))
    lows = rooted.groupBy("root").agg(F.min("low").alias("component_id"), F.sum("k").alias("size")).filter("size > 1")
    by_class = materialize(rooted.join(lows, "root").select("s1", "s2", F.col("n").alias("m"), "component_id"))
    return sets.join(small_side(by_class, 100_000), ["s1", "s2"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce(F.when(F.col("n") > 0, F.col("component_id")), F.col("doc_id")).alias("component_id"))


def near_links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, class_id, n_links for each row of docs: every link is found, those within a component too.

    A class is the rows of one set, class_id its least id; n_links is how many other rows link with this one, those of its own
    class included.  Texts without shingles are a class each and have no links.  Null ids count as rows and are ignored by the
    minimum.  Links are held between classes, so copies cost nothing; see links() for what many near copies cost.
    """
    rows = text_rows(docs, id_col, text_col)
    sets = materialize(rows.mapInArrow(task(_sets), "doc_id long, n long, s1 long, s2 long"))
    found = materialize(links(rows, sets, every=True))
    classes = materialize(sets.filter("n > 0").groupBy("s1", "s2").agg(F.min("doc_id").alias("low"), F.count("*").alias("k")))
    ends = found.unionByName(found.select(F.col("b").alias("a"), F.col("a").alias("b")))
    others = ends.join(classes.select(F.col("s1").alias("b"), F.col("k").alias("_k")), "b").groupBy(F.col("a").alias("s1")).agg(F.sum("_k").alias("_others"))
    linked = classes.join(others, "s1", "left").withColumn("_links", F.col("k") - 1 + F.coalesce("_others", F.lit(0))).filter("_links > 0")
    by_class = materialize(linked.select("s1", "s2", "low", "_links"))
    out = sets.withColumn("_set", F.col("n") > 0).join(small_side(by_class, 100_000).withColumn("_set", F.lit(True)), ["s1", "s2", "_set"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("low", "doc_id").alias("class_id"), F.coalesce("_links", F.lit(0)).cast("long").alias("n_links"))
