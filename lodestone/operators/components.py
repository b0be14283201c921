"""Connected components of a table of links.

Links are dealt by ranges of their ids and each range is contracted by itself; ids that more than one range has then
link the ranges' components, a far smaller graph wherever near ids are linked, as on grids. That graph is contracted in
one task if it has at most ONE_TASK links, and by alternating large and small stars, joins by key only, if it has more.
The driver gets counts and checksums, never links.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import materialize, release

#: Links that one task may contract, and that a range holds at about.
ONE_TASK, A_RANGE = 500_000, 200_000


def contract(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of the links in order, and the smallest id of each one's component."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = at[: len(a)], at[len(a) :]
    root = np.arange(len(ids))
    while True:
        x, y = root[i], root[j]
        open_ = x != y
        if not open_.any():
            return ids, ids[root]
        i, j, x, y = i[open_], j[open_], x[open_], y[open_]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root != root[root]).any():
            root = root[root]


def _contracted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, root) of the links of a partition."""
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for batch in batches:
        a.append(batch["a"].to_numpy())
        b.append(batch["b"].to_numpy())
    ids, roots = contract(np.concatenate(a), np.concatenate(b))
    for k in range(0, len(ids), 100_000):
        yield pa.RecordBatch.from_arrays([pa.array(ids[k : k + 100_000]), pa.array(roots[k : k + 100_000])], names=["id", "root"])


def rooted(links: DataFrame) -> DataFrame:
    """links: long columns a and b. Gives id and root, the smallest id of its component, for all ids of links."""
    links = links.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a is not null and b is not null")
    some = materialize(links)
    count = some.count()
    if count <= ONE_TASK:
        out = materialize(some.coalesce(1).mapInArrow(_contracted, "id long, root long"))
        release(some)
        return out
    ranges = some.repartitionByRange(max(2, count // A_RANGE), "a")
    local = materialize(ranges.mapInArrow(_contracted, "id long, root long"))
    release(some)
    first = local.groupBy("id").agg(F.min("root").alias("least"), F.max("root").alias("most"))
    between = materialize(local.join(first.where("least < most").select("id", "least").hint("merge"), "id").where("root > least").select(F.col("root").alias("a"), F.col("least").alias("b")).distinct())
    far = rooted(between) if between.count() <= ONE_TASK else stars(between).select(F.col("node").alias("id"), "root")
    one = local.groupBy("id").agg(F.min("root").alias("near"))
    return one.join(far.select(F.col("id").alias("near"), F.col("root").alias("far")).hint("merge"), "near", "left").select("id", F.coalesce("far", "near").alias("root"))


def _mark(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("a", "b")), F.lit(0))).first())


def stars(links: DataFrame) -> DataFrame:
    """links: columns a, b of one type. Gives node and root, the smallest node of its component, for all nodes but the roots."""
    now = materialize(links.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = _mark(now)
    while True:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(now.select("a", "b").join(least, "a").select("a", F.col("m").alias("b")))
        large = materialize(large.where("a != b").distinct())
        lowest = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(lowest, "a").where("b != m").select(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b")).union(lowest.select("a", F.col("m").alias("b")))
        later = materialize(small.distinct())
        release(large, now)
        now, before, mark = later, mark, _mark(later)
        if mark == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
