"""Connected components of a table of links, by alternating stars; nothing is collected."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coinstrata.llm._common import materialize, task

#: Links of a task in the rounds.
TASK_LINKS = 100_000
_EDGES = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links from each node to the least of its component, for links given as arrays."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, root[x], low)
        np.minimum.at(new, root[y], low)
        new = new[new]
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, root):
            break
        root = new
    moved = root != np.arange(len(nodes))
    return nodes[root[moved]], nodes[moved]


def _local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A partition's links as a forest: fewer links, the same components."""
    a, b = np.empty(0, np.int64), np.empty(0, np.int64)
    for batch in batches:
        a, b = forest(np.concatenate([a, np.asarray(batch.column("a"), np.int64)]), np.concatenate([b, np.asarray(batch.column("b"), np.int64)]))
    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=_EDGES)


def components(links: DataFrame) -> DataFrame:
    """(node, root): the least node of its component for every node of links (a, b) but the roots.

    Links may repeat, point either way or join a node to itself; null ends are ignored; no links give no rows.
    Every round contracts the links of a partition, then hangs the larger neighbours of each node (large star) and its
    smaller ones (small star) on their least.  The rounds grow as the logarithm of the longest path.
    """
    ends = links.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).filter("a <> b")
    edges = materialize(ends.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).mapInArrow(task(_local), "a long, b long"))
    tasks = edges.count() // TASK_LINKS + 1  # no round has more links than this one
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.least("a", "m").alias("a"), "b")
        large = large.filter("a <> b").distinct()
        least = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(least, "b").select(F.explode(F.array(F.struct(F.col("m").alias("a"), F.col("a").alias("b")), F.struct(F.col("m").alias("a"), F.col("b").alias("b")))).alias("e"))
        new = materialize(small.select("e.a", "e.b").filter("a <> b").distinct(), tasks)
        # done when every node hangs on one root and no root hangs on another
        heads = new.groupBy("b").agg(F.count("*").alias("n"), F.min("a").alias("a"))
        deep = heads.filter("n > 1").select("b").union(new.select(F.col("a").alias("b")).distinct().join(new.select("b").distinct(), "b", "left_semi"))
        if deep.isEmpty():
            return new.select(F.col("b").alias("node"), F.col("a").alias("root"))
        edges = materialize(new.mapInArrow(task(_local), "a long, b long"), tasks)
