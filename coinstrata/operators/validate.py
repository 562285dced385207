"""Chain checks, table diffs and samples."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from coinstrata.functions.hashing import block_id


#: Parts of a family that are sampled apart.
SALTS = 64


def linkage(blocks: DataFrame) -> DataFrame:
    """Each block with the first rule it breaks: header, height, link, genesis; null if none.

    blocks has height, block_hash, prev_hash and, where headers are at hand, header.  Neighbours meet by a join on height
    and not by a window over all blocks, so no task sees the whole chain.
    """
    before = blocks.select((F.col("height") + 1).alias("height"), F.col("block_hash").alias("_hash"))
    j = blocks.join(before, "height", "left").withColumn("_low", blocks.agg(F.min("height")).scalar())
    zero = F.unhex(F.lit("00" * 32))
    header = F.when(block_id(F.col("header")) != F.col("block_hash"), "header") if "header" in blocks.columns else F.lit(None)
    error = F.coalesce(
        header, F.when((F.col("height") == 0) & (F.col("prev_hash") != zero), "genesis"), F.when((F.col("height") > F.col("_low")) & F.col("_hash").isNull(), "height"),
        F.when(F.col("_hash") != F.col("prev_hash"), "link"),
    )
    return j.withColumn("error", error).drop("_hash", "_low")


def first_failure(checked: DataFrame) -> DataFrame:
    """One row: blocks checked, the first failing height and its error; nulls if all hold."""
    return checked.agg(F.count("*").alias("blocks"), F.min(F.when(F.col("error").isNotNull(), F.col("height"))).alias("height"), F.min_by("error", F.when(F.col("error").isNotNull(), F.col("height"))).alias("error"))


def lag_gaps(blocks: DataFrame) -> DataFrame:
    """Present heights after the first, with how far the one before is."""
    w = Window.orderBy("height")
    return blocks.select("height", (F.col("height") - F.lag("height").over(w)).alias("step")).filter("step IS NOT NULL")


def contiguous(files: DataFrame) -> DataFrame:
    """Files (name, first, last) in order, whether each follows the one before; a row a file, so one task does."""
    w = Window.orderBy("first", "name")
    return files.withColumn("follows", F.coalesce(F.col("first") == F.lag("last").over(w) + 1, F.lit(True)))


def merkle_fold(leaves: list[bytes]) -> tuple[bytes | None, bool]:
    """Root of 32-byte leaves and whether two genuine neighbours of a level are equal."""
    level, mutated = list(leaves), False
    if not level:
        return None, False
    while len(level) > 1:
        mutated |= any(level[i] == level[i + 1] for i in range(0, len(level) - 1, 2))
        if len(level) % 2:
            level.append(level[-1])
        level = [hashlib.sha256(hashlib.sha256(level[i] + level[i + 1]).digest()).digest() for i in range(0, len(level), 2)]
    return level[0], mutated


def merkle_roots(leaves: DataFrame, key: str = "height", position: str = "pos", leaf: str = "leaf") -> DataFrame:
    """(key, root, mutated, n) of ordered leaves; a block's leaves are bounded by the block's size."""
    rows = leaves.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(position).alias("p"), F.col(leaf).alias("x")))).alias("l")).select(F.col(key).cast("long").alias(key), F.col("l.x").alias("l"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(1).to_pylist()
            out = [merkle_fold(x) for x in lists]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r for r, _ in out], pa.binary()), pa.array([m for _, m in out], pa.bool_()), pa.array([len(x) for x in lists], pa.int64())], names=[key, "root", "mutated", "n"])

    return rows.mapInArrow(run, f"{key} long, root binary, mutated boolean, n long")


def merkle_root_levels(leaves: DataFrame, key: str = "height", position: str = "pos", leaf: str = "leaf") -> DataFrame:
    """As merkle_roots without Python: a level is a fold over pairs of the array."""
    def pair(xs: Column) -> Column:
        even = F.when(F.size(xs) % 2 == 1, F.concat(xs, F.array(F.element_at(xs, -1)))).otherwise(xs)
        return F.transform(F.sequence(F.lit(0), (F.size(even) / 2 - 1).cast("int")), lambda i: F.unhex(F.sha2(F.unhex(F.sha2(F.concat(F.get(even, i * 2), F.get(even, i * 2 + 1)), 256)), 256)))

    rows = leaves.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(position).alias("p"), F.col(leaf).alias("x")))), lambda s: s["x"]).alias("l"))
    depth = F.ceil(F.log2(F.size("l").cast("double"))).cast("int")
    levels = F.when(depth > 0, F.sequence(F.lit(1), F.greatest(depth, F.lit(1)))).otherwise(F.array().cast("array<int>"))
    return rows.select(key, F.aggregate(levels, F.col("l"), lambda acc, _: F.when(F.size(acc) > 1, pair(acc)).otherwise(acc), lambda acc: F.get(acc, F.lit(0))).alias("root"))


def diff(truth: DataFrame, candidate: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """Full outer diff by key: match, diff, missing (only truth), extra (only candidate)."""
    a = truth.select(*key, F.struct(*columns).alias("a"))
    b = candidate.select(*key, F.struct(*columns).alias("b"))
    status = F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "extra").when(F.col("a") == F.col("b"), "match").otherwise("diff")
    return a.join(b, key, "full_outer").withColumn("status", status)


def breakdown(diffs: DataFrame, family: Column) -> DataFrame:
    """Counts of each status by family, with a total."""
    n = lambda s: F.count_if(F.col("status") == s).alias(s if s != "match" else "matched")
    return diffs.withColumn("family", family).rollup("family").agg(n("match"), n("diff"), n("missing"), n("extra")).withColumn("family", F.coalesce("family", F.lit("TOTAL")))


def first_diffs(diffs: DataFrame, key: list[str], n: int = 20) -> DataFrame:
    """The first differences in key order."""
    return diffs.filter("status <> 'match'").orderBy(*key).limit(n)


def hashed_sample(rows: DataFrame, family: list[str], key: Column, n: int, seed: int = 0) -> DataFrame:
    """n rows of each family, those with the least hashes: the same for the same seed, whatever the partitions."""
    placed = rows.withColumn("_key", key).withColumn("_place", F.xxhash64("_key", F.lit(seed))).withColumn("_salt", F.pmod("_place", F.lit(SALTS)))
    for part in ([*family, "_salt"], family):  # a large family is ranked in parts first, so that its last task sees SALTS * n rows
        placed = placed.withColumn("_rank", F.row_number().over(Window.partitionBy(*part).orderBy("_place", "_key"))).filter(F.col("_rank") <= n)
    return placed.drop("_key", "_place", "_salt", "_rank")


def lookup(sample: DataFrame, truth: DataFrame, key: list[str], column: str) -> DataFrame:
    """Each sampled row as exact, diff or miss in truth."""
    t = truth.select(*key, F.col(column).alias("_truth"), F.lit(True).alias("_hit"))
    return sample.join(t, key, "left").withColumn("status", F.when(F.col("_hit").isNull(), "miss").when(F.col(column).eqNullSafe(F.col("_truth")), "exact").otherwise("diff")).drop("_truth", "_hit")


def lookup_summary(looked: DataFrame, family: list[str]) -> DataFrame:
    n = lambda s: F.count_if(F.col("status") == s).alias(s)
    return looked.groupBy(*family).agg(F.count("*").alias("sampled"), n("exact"), n("diff"), n("miss"))


def widths(rows: DataFrame, expected: dict[str, tuple[int, int]]) -> DataFrame:
    """Families whose keys or values have a wrong width, with how many."""
    k, v = (F.create_map(*[F.lit(x) for f, w in expected.items() for x in (f, w[i])]) for i in (0, 1))
    extra = F.when((F.col("family") == "O") & (F.octet_length("value") == 45), 1).otherwise(0)
    return rows.filter((F.octet_length("key") != k[F.col("family")]) | (F.octet_length("value") - extra != v[F.col("family")])).groupBy("family").agg(F.count("*").alias("wrong"))
