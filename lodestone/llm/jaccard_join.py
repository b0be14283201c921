"""N-gram Jaccard join in the metric space of Jaccard distance.

A document is the set of its distinct word shingles; d(x, y) = 1 - |x & y| / |x | y| is a metric, so distances to a
pivot bound distances between documents.

First regions. Five-word shingles of unrelated texts have distance 1 to each other and to any pivot, so documents taken
as pivots at random would leave nearly everything in one region. Pivots are therefore found by content: two sets within
the radius must share one of the first n - ceil(t * n) + 1 shingles of any common order (t the similarity), so all sets
with such a shingle are in the region of one pivot, the smallest of them by hash, and no link can be missed. The order
puts frequent shingles last, the most frequent ones at the end, so that a passage that many texts share opens no region.
Which count as frequent follows from the counts themselves: as many as the order has room for (FREQUENT). A bound that
grew with the input would leave more and more shared shingles among the first ones.

Sizes are distances too (to the empty set, by the symmetric difference): linked sets have sizes within the factor t.
A region is therefore cut into classes of size, a factor 1 / t wide each, and a set is given to its own class and the
next one only; a class with sets of one class of origin that another class has as well is left out, as is a single set.

Regions first compare sketches: how many shingles a set has in each of some buckets of the hash. The buckets are pivots
too; the difference of the counts, summed, is at most the symmetric difference of the sets, so pairs beyond the radius
are ruled out without their texts, and no pair within it ever is. What may still be linked makes groups, by connected
components over all regions; each text then goes to its group.

Between tasks. A region (for sketches, whose summed difference is a metric too) or group (for texts) of more than
REGION_ROWS sets or REGION_BYTES is split by a pivot over many tasks, again and again: each of its sets is measured
against the pivot alone, sets within the radius are linked with it, and the others fall into rings one radius wide. By
the triangle inequality only sets of one ring or of neighbouring rings can be linked, so each ring is replicated into two
windows, and a window goes on only if it has sets that aren't linked yet. So a cluster of near copies of one text costs
one measurement a copy. What is still large after ROUNDS pivots is cut into blocks, and each block of sets that aren't
linked with most others meets all blocks, in tasks of bounded size.

Inside a task. Pivots split it again: the most central set and the one farthest from it. Each set goes to the nearer
pivot's cell, and also to the other's if d2 <= d1 + 2 * radius, as by the triangle inequality only then can a neighbour be
there; cells are split in the same way until they are small or no longer shrink. There, sets of different components
whose distances to the pivots differ by no more than the radius are compared exactly.

Links become connected components by key-wise joins. Equal sets are one node throughout, so copies cost nothing.

Defined results: words are split at ASCII white space, A-Z lower-cased; with fewer words than `size` the whole sequence
is the one shingle; null or empty texts have none and link with nothing (not even each other); null ids sort after all
others, and a component of null ids only has a null id; rows that repeat an id are rows of their own; an empty table
gives no rows; other columns are ignored. Shingles are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from . import bloom, common
from ..operators.components import stars as components

REGION_ROWS, REGION_BYTES = 2_000, 24 << 20
#: Pivots that split a large region between tasks one after the other.
ROUNDS = 4
LEAF = 64
#: At most this many frequent shingles are put last, the most frequent ones.
FREQUENT = 200_000
FREQUENT_SHARE = 10_000
TOGETHER = 3_000_000
_LOWER = bytes(c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))


class Shingler:
    """Sets of texts as sorted arrays of hashes."""

    def __init__(self, size: int) -> None:
        self.size, self.rolling = size, common.Rolling()

    def set_of(self, text: str | None) -> np.ndarray:
        words, _ = common.hashed_words(text.encode().translate(_LOWER) if text else b"")
        if not len(words):
            return words
        n = min(self.size, len(words))
        found = np.sort(self.rolling.windows(self.rolling.prefix(words), n))
        return found[np.concatenate([[True], found[1:] != found[:-1]])]


def node_of(shingles: np.ndarray) -> int:
    """A 64-bit hash of a set."""
    order = np.arange(1, len(shingles) + 1, dtype=np.uint64)
    h = common.mix(common.mix(shingles) + order * np.uint64(common.POLY))
    return int(common.signed(np.array([np.bitwise_xor.reduce(h) ^ np.uint64(len(shingles))], np.uint64))[0])


def least_shared(n, percent: int):
    """Of a set of n, how many shingles any set within the radius must share."""
    return (percent * n + 99) // 100


_NODES = pa.schema([("frequent", pa.bool_()), ("id", pa.int64()), ("len", pa.int32()), ("crc", pa.int64()), ("node", pa.int64()), ("n", pa.int64()), ("sketch", pa.binary())])
_FOUND = "frequent boolean, id long, len int, crc long, node long, n long, sketch binary"


def size_class(n: int, percent: int) -> int:
    return int(np.floor(np.log(max(n, 1)) / np.log(100 / percent) + 1e-9))


def buckets(k: int, percent: int) -> int:
    """Buckets of a sketch in a class of size: a power of two near a tenth of the sets' size."""
    return 1 << int(np.clip(np.ceil(k * np.log2(100 / percent) + np.log2(0.08)), 4, 14))


def _sketch_bytes(percent: int) -> Column:
    """Bytes of a sketch in class `k`."""
    return F.pow(F.lit(2.0), F.least(F.lit(14), F.greatest(F.lit(4), F.ceil(F.col("k") * float(np.log2(100 / percent)) + float(np.log2(0.08))))))


def sketch_of(shingles: np.ndarray, percent: int) -> bytes:
    m = buckets(size_class(len(shingles), percent) + 1, percent)
    return np.minimum(np.bincount((shingles & np.uint64(m - 1)).astype(np.int64), minlength=m), 255).astype(np.uint8).tobytes()


def _base(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(text_col)
    return docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"), F.coalesce(F.octet_length(text), F.lit(0)).alias("len"), F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).cast("long").alias("crc"))


def _nodes(size: int, percent: int):
    """A row for each document (node, n); and, flagged, for each shingle that many of the documents read together have (node is the shingle, n how many)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, sets, held, rows = Shingler(size), [], 0, []

        def frequent() -> pa.RecordBatch:
            values, counts = np.unique(np.concatenate(sets), return_counts=True)
            often = counts >= max(2, len(sets) // (2 * FREQUENT_SHARE))
            n = int(often.sum())
            nothing = [pa.nulls(n, t) for t in (pa.int64(), pa.int32(), pa.int64())]
            return pa.RecordBatch.from_arrays([pa.array(np.ones(n, bool)), *nothing, pa.array(common.signed(values[often])), pa.array(counts[often].astype(np.int64)), pa.nulls(n, pa.binary())], schema=_NODES)

        for id_, text, length, crc in common.rows_of(batches, "id", "text", "len", "crc"):
            sets.append(shingler.set_of(text))
            held += len(sets[-1])
            rows.append((False, id_, length, crc, node_of(sets[-1]), len(sets[-1]), sketch_of(sets[-1], percent)))
            if held >= TOGETHER:
                yield frequent()
                sets, held = [], 0
            if len(rows) >= 5_000:
                yield from common.row_batches(rows, _NODES, 5_000)
                rows = []
        yield from common.row_batches(rows, _NODES, 5_000)
        if sets:
            yield frequent()

    return run


def _prefixes(size: int, percent: int, frequent):
    """(shingle, node) of each set's prefix in the common order: frequent shingles last, by their levels, else by hash.
    frequent: a broadcast of those shingles in order and of their levels."""
    schema = pa.schema([("s", pa.int64()), ("node", pa.int64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, out, last = Shingler(size), common.Sink(schema, 200_000), frequent.value[0]
        for (text,) in common.rows_of(batches, "text"):
            s = shingler.set_of(text)
            if not len(s):
                continue
            node, k = node_of(s), len(s) - least_shared(len(s), percent) + 1
            if len(last):
                at = np.minimum(np.searchsorted(last, s), len(last) - 1)
                s = s[np.argsort(np.where(last[at] == s, frequent.value[1][at], 0), kind="stable")]
            out.add(k, common.signed(s[:k]), np.full(k, node, np.int64))
            yield from out.full()
        yield from out.rest()

    return run


class Region:
    """Sets in one task, and the components that their links make."""

    def __init__(self, sets: list[np.ndarray], percent: int) -> None:
        self.n = np.array([len(s) for s in sets], np.int64)
        self.percent, self.radius = percent, 1 - percent / 100
        self.label = np.arange(len(sets))
        values, where, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        row = np.repeat(np.arange(len(sets)), self.n)
        # A shingle that only one set has is in no intersection.
        column = np.cumsum(counts > 1) - 1
        shared = counts[where] > 1
        self.central = np.bincount(row, counts[where] * shared, len(sets)) / np.maximum(self.n, 1)
        words = int(column[-1] + 1 + 63) // 64 if len(column) else 0
        self.bits = np.zeros((len(sets), max(words, 1)), np.uint64)
        c = column[where[shared]]
        np.bitwise_or.at(self.bits, (row[shared], c >> 6), np.uint64(1) << (c & 63).astype(np.uint64))

    def common_with(self, i: int, others: np.ndarray) -> np.ndarray:
        return np.bitwise_count(self.bits[others] & self.bits[i]).sum(axis=1, dtype=np.int64)

    def distance(self, i: int, others: np.ndarray) -> np.ndarray:
        both = self.common_with(i, others)
        return 1 - both / np.maximum(self.n[i] + self.n[others] - both, 1)

    def link(self, i: int, others: np.ndarray) -> None:
        """Compare i with others and join the components of those within the radius."""
        both = self.common_with(i, others)
        near = others[100 * both >= self.percent * (self.n[i] + self.n[others] - both)]
        if len(near):
            old = np.unique(np.append(self.label[near], self.label[i]))
            self.label[np.isin(self.label, old)] = old[0]

    def join(self, members: np.ndarray) -> None:
        members = members[np.argsort(-self.central[members], kind="stable")]
        pivot = members[0]
        d1 = self.distance(pivot, members)
        self.link(pivot, members)
        if len(members) > LEAF and len(np.unique(self.label[members])) > 1:
            d2 = self.distance(members[np.argmax(d1)], members)
            first, second = d1 <= d2 + 2 * self.radius + 1e-9, d2 <= d1 + 2 * self.radius + 1e-9
            if max(first.sum(), second.sum()) < 0.9 * len(members):
                self.join(members[first])
                self.join(members[second])
                return
        for k in range(1, len(members)):
            i = members[k]
            rest = members[k + 1 :]
            low, high = np.minimum(self.n[i], self.n[rest]), np.maximum(self.n[i], self.n[rest])
            open_ = (self.label[rest] != self.label[i]) & (np.abs(d1[k + 1 :] - d1[k]) <= self.radius + 1e-9) & (100 * low >= self.percent * high)
            if open_.any():
                self.link(i, rest[open_])


_MEASURED = pa.schema([("region", pa.int64()), ("node", pa.int64()), ("label", pa.int64()), ("n", pa.int64()), ("k", pa.int32()), ("id", pa.int64()), ("len", pa.int32()), ("crc", pa.int64()), ("ring", pa.int32()), ("pivot", pa.int64())])
_DDL = {pa.int64(): "long", pa.int32(): "int"}
_EDGES = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _edges(nodes: np.ndarray, label: np.ndarray) -> pa.RecordBatch:
    """An edge from each node to the one that its label numbers."""
    moved = np.flatnonzero(label != np.arange(len(nodes)))
    return pa.RecordBatch.from_arrays([pa.array(nodes[moved]), pa.array(nodes[label[moved]])], schema=_EDGES)


def may_link(sketches: np.ndarray, n: np.ndarray, percent: int) -> np.ndarray:
    """Labels of the groups that pairs make whose sketches don't rule out a link."""
    label, wide = np.arange(len(n)), sketches.astype(np.int16)
    for i in range(len(n) - 1):
        rest = np.flatnonzero(label[i + 1 :] != label[i]) + i + 1
        if not len(rest):
            continue
        apart = np.abs(wide[rest] - wide[i]).sum(axis=1, dtype=np.int64)
        near = rest[apart * (100 + percent) <= (n[rest] + n[i]) * (100 - percent)]
        if len(near):
            old = np.unique(np.append(label[near], label[i]))
            label[np.isin(label, old)] = old[0]
    return label


def _compare_sketches(percent: int):
    def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = {node: (n, k, np.frombuffer(s, np.uint8)) for node, n, k, s in common.rows_of(batches, "node", "n", "k", "sketch")}
        if len(rows) > 1:
            sketches = np.array([_buckets_of(s, k, percent) for _, k, s in rows.values()])
            yield _edges(np.array(list(rows), np.int64), may_link(sketches, np.array([n for n, _, _ in rows.values()], np.int64), percent))

    return run


def _buckets_of(sketch: np.ndarray, k: int, percent: int) -> np.ndarray:
    """A sketch by the buckets of the class of size it is compared in."""
    return sketch.reshape(-1, buckets(k, percent)).sum(axis=0).astype(np.int64)


def _join_block(size: int, percent: int):
    """Edges from each set of a block to the first of its component there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, sets = Shingler(size), {}
        for node, text in common.rows_of(batches, "node", "text"):
            if node not in sets:
                s = shingler.set_of(text)
                if node_of(s) == node:
                    sets[node] = s
        if len(sets) > 1:
            region = Region(list(sets.values()), percent)
            region.join(np.arange(len(sets)))
            yield _edges(np.array(list(sets), np.int64), region.label)

    return run


def _measured_block(names: list[str], schema: pa.Schema, read, compare):
    """An applyInArrow function that measures the rows of a block against the pivot's row, which is in all blocks.
    read(columns of a row) gives what is compared, or None for a row that isn't the one it stands for; compare(pivot,
    other) gives the ring and whether they are linked. Rows come with their label, the pivot's if they are linked."""

    def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, pivot = {}, None
        for row in common.rows_of(batches, "block", "first", *names):
            of, value = dict(zip(names, row[2:], strict=True)), None
            if of["node"] not in found and (value := read(of)) is not None:
                found[of["node"]] = (of, value, row[0])
                if row[1]:
                    pivot = of["node"]
        if found and pivot is None:
            raise RuntimeError("a region's pivot has no row")

        def rows() -> Iterator[tuple]:
            first = found[pivot]
            for node, (of, value, block) in found.items():
                if node != pivot or block == 0:
                    ring, linked = (0, True) if node == pivot else compare(first[:2], (of, value))
                    yield tuple({**of, "label": first[0]["label"] if linked else of["label"], "ring": ring, "pivot": pivot if linked else None}[f.name] for f in schema)

        if found:
            yield from common.row_batches(rows(), schema)

    return run


def _by_sketch(percent: int):
    """Rings as wide as the largest difference that linked sets of the class may have."""

    def compare(pivot: tuple, other: tuple) -> tuple[int, bool]:
        (a, x), (b, y) = pivot, other
        apart = int(np.abs(x - y).sum())
        widest = int((100 / percent) ** (a["k"] + 1)) + 1
        return apart * (100 + percent) // (2 * widest * (100 - percent) + 1), apart * (100 + percent) <= (a["n"] + b["n"]) * (100 - percent)

    return lambda of: _buckets_of(np.frombuffer(of["sketch"], np.uint8), of["k"], percent), compare


def _by_text(size: int, percent: int):
    """Rings one radius wide, closed at the far end, so that the first one has what is linked with the pivot."""
    shingler = Shingler(size)

    def read(of: dict) -> np.ndarray | None:
        s = shingler.set_of(of["text"])
        return s if node_of(s) == of["node"] else None

    def compare(pivot: tuple, other: tuple) -> tuple[int, bool]:
        x, y = pivot[1], other[1]
        both = len(np.intersect1d(x, y, assume_unique=True))
        union = len(x) + len(y) - both
        ring = max(0, -(-((union - both) * 100) // (union * (100 - percent))) - 1)
        return ring, 100 * both >= percent * union

    return read, compare


def _split_by_pivots(members: DataFrame, weight: Column, measured) -> tuple[DataFrame, list[DataFrame]]:
    """Regions (columns region, node, label and others) after up to ROUNDS pivots, as the module's text says, and the edges
    that were found on the way. measured(rows) adds `ring` and `pivot` and sets `label`; the rows have `block`, and
    `first` marks the pivot."""
    edges, columns = [], members.columns
    for k in range(ROUNDS):
        sizes = members.groupBy("region").agg(
            F.ceil(F.greatest(F.count("*") / REGION_ROWS, F.sum(weight) / REGION_BYTES)).cast("int").alias("blocks"),
            F.min("label").alias("lo"), F.max("label").alias("hi"), F.min_by("node", F.xxhash64("node", F.lit(k))).alias("chosen"),
        )
        large = common.materialize(sizes.where("blocks > 1 and lo < hi").select("region", "blocks", "chosen"))
        if large.limit(1).count() == 0:
            return members, edges
        first = F.col("node") == F.col("chosen")
        block = F.when(first, F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(F.pmod(F.xxhash64("node", F.lit(1)), F.col("blocks")).cast("int")))
        dealt = members.join(large, "region").select(*columns, F.explode(block).alias("block"), first.alias("first"))
        ringed = common.materialize(measured(dealt))
        edges.append(ringed.where("pivot is not null and pivot <> node").select(F.col("node").alias("a"), F.col("pivot").alias("b")))
        window = F.explode(F.filter(F.array(F.col("ring") - 1, F.col("ring")), lambda w: w >= 0))
        windows = ringed.withColumn("window", window).withColumn("region", F.xxhash64("region", F.lit(k), "window")).select(*columns)
        open_ = windows.groupBy("region").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("region")
        members = common.materialize(members.join(large, "region", "left_anti").select(*columns).unionByName(windows.join(open_, "region").select(*columns)))
    return members, edges


def _classes(members: DataFrame, percent: int) -> DataFrame:
    """Members of regions by class of size, as the module's text says: adds `k`, the class."""
    own = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100.0 / percent)) + 1e-9).cast("int")
    rows = members.withColumn("own", own).withColumn("k", F.explode(F.array(F.col("own"), F.col("own") + 1)))
    counts = rows.groupBy("pivot", "k").agg(F.count_if(F.col("own") == F.col("k")).alias("here"), F.count_if(F.col("own") < F.col("k")).alias("below"))
    following = counts.select("pivot", (F.col("k") - 1).alias("k"), F.col("here").alias("above"))
    counts = counts.join(following, ["pivot", "k"], "left").where("here > 0 and here + below > 1 and (below > 0 or coalesce(above, 0) = 0)")
    return rows.join(counts.select("pivot", "k"), ["pivot", "k"]).drop("own")


def _tasks(members: DataFrame, weight: Column) -> DataFrame:
    """Adds `task`. A region of bounded size is one task. In a larger one the sets with its commonest label, which are all
    linked, and the others are cut into blocks; each block of others makes a task with each block of either kind."""
    whole = members.groupBy("region", "label").agg(F.count("*").alias("n"), F.sum(weight).alias("bytes")).groupBy("region").agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes"), F.max_by(F.struct("label", "n", "bytes"), F.struct("n", "label")).alias("main"))
    blocks = lambda n, size: F.ceil(F.greatest(n / REGION_ROWS, size / REGION_BYTES)).cast("int")
    n, size = F.col("n"), F.col("bytes")
    totals = whole.select("region", blocks(n, size).alias("blocks"), F.col("main.label").alias("main"), blocks(F.col("main.n"), F.col("main.bytes")).alias("of_main"), blocks(n - F.col("main.n"), size - F.col("main.bytes")).alias("of_rest"))
    place = lambda count: F.pmod(F.xxhash64("node", F.lit(1)), F.greatest(F.lit(1), F.col(count))).cast("int")
    task = lambda i, j, kind: F.struct("region", i.alias("i"), j.alias("j"), F.lit(kind).alias("kind"))
    each = lambda count, fn: F.when(F.col(count) > 0, F.transform(F.sequence(F.lit(0), F.greatest(F.col(count) - 1, F.lit(0))), fn))
    one = F.array(task(F.lit(0), F.lit(0), 0))
    mine = F.col("mine")
    as_main = each("of_rest", lambda i: task(i, mine, 1))
    as_rest = F.concat(each("of_rest", lambda j: task(F.least(j, mine), F.greatest(j, mine), 2)), each("of_main", lambda j: task(mine, j, 1)))
    is_main = F.col("label") == F.col("main")
    rows = members.join(totals, "region").withColumn("mine", F.when(is_main, place("of_main")).otherwise(place("of_rest")))
    return rows.withColumn("task", F.explode(F.when(F.col("blocks") <= 1, one).when(is_main, as_main).otherwise(as_rest))).select(*members.columns, "task")


def _with_texts(base: DataFrame, uses: DataFrame, columns: list[str]) -> DataFrame:
    """node, text and `columns` of uses, whose rows name a text by id, len and crc. Each text is sent once for all its uses."""
    wanted = common.materialize(uses.groupBy("node", F.col("id").alias("of"), F.col("len").alias("of_len"), F.col("crc").alias("of_crc")).agg(F.collect_list(F.struct(F.lit(0).alias("use"), *columns)).alias("uses")))
    maybe = bloom.marked(base, F.xxhash64("id", "len", "crc"), wanted, F.xxhash64("of", "of_len", "of_crc"), "maybe").where("maybe")
    same = [F.col(a).eqNullSafe(F.col(b)) for a, b in (("id", "of"), ("len", "of_len"), ("crc", "of_crc"))]
    return maybe.join(wanted, same).select("node", "text", F.explode("uses").alias("x")).select("node", "text", *[f"x.{c}" for c in columns])


def _frequent(found: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent shingles, FREQUENT at most, in order, and their levels from 1: eight to a doubling of the count."""
    counts = common.materialize(found.where("frequent").groupBy("node").agg(F.sum("n").alias("n")).select("node", F.floor(F.log2("n") * 8).cast("int").alias("level")))
    least, room = None, FREQUENT
    for level, n in sorted(counts.groupBy("level").count().collect(), reverse=True):
        if n > room:
            break
        least, room = level, room - n
    rows = counts.where(F.col("level") >= F.lit(least)).toArrow()
    common.release(counts)
    shingles, levels = rows["node"].to_numpy().view(np.uint64), np.minimum(rows["level"].to_numpy().astype(np.int64) - (least or 0) + 1, 255).astype(np.uint8)
    order = np.argsort(shingles)
    return shingles[order], levels[order]


def links(base: DataFrame, size: int, percent: int, found: DataFrame) -> DataFrame:
    """Edges (a, b) between nodes whose components are those of all links. found: what _nodes() gave."""
    sc = base.sparkSession.sparkContext
    texts, nodes = base.select("text"), found.where("not frequent and n > 0")
    last = sc.broadcast(_frequent(found))
    prefixes = texts.mapInArrow(_prefixes(size, percent, last), "s long, node long")
    # Windows, as these rows are the most that is shuffled: a sum by key and a join would each send them.
    alike = Window.partitionBy("s")
    shared = prefixes.select("node", F.min("node").over(alike).alias("pivot"), F.max("node").over(alike).alias("most")).where("pivot < most")
    regions = common.materialize(shared.select("node", "pivot").distinct())
    first = common.materialize(nodes.groupBy("node").agg(F.min(F.struct("id", "len", "crc")).alias("x"), F.first("n").alias("n"), F.first("sketch").alias("sketch")).select("node", "n", "sketch", "x.*"))
    classes = common.materialize(_classes(regions.join(first.select("node", "n"), "node"), percent))
    common.release(regions)

    def measured(fn, names: list[str]):
        fields = [f for f in _MEASURED if f.name in (*names, "label", "ring", "pivot")]
        return _measured_block(names, pa.schema(fields), *fn), ", ".join(f"{f.name} {_DDL[f.type]}" for f in fields)

    lean = classes.select(F.xxhash64("pivot", "k").alias("region"), "node", F.col("node").alias("label"), "n", "k")
    sketches = first.select("node", "sketch")
    by_sketch = measured(_by_sketch(percent), ["region", "node", "label", "n", "k", "sketch"])
    open_, edges = _split_by_pivots(lean, _sketch_bytes(percent), lambda rows: rows.join(sketches, "node").groupBy("region", "block").applyInArrow(*by_sketch))
    compared = _tasks(open_, _sketch_bytes(percent)).join(sketches, "node").groupBy("task").applyInArrow(_compare_sketches(percent), "a long, b long")
    groups = common.materialize(components(_all(compared, edges)))
    members = groups.union(groups.select("root", "root").distinct()).toDF("node", "region").join(first.select("node", "id", "len", "crc"), "node").withColumn("label", F.col("node"))
    names = ["region", "node", "label", "id", "len", "crc"]
    by_text = measured(_by_text(size, percent), [*names, "text"])
    kept: list[DataFrame] = []

    def measured_texts(rows: DataFrame) -> DataFrame:
        if not kept:  # later rounds have no other texts than the first one
            found = _with_texts(base, rows.select("node", "id", "len", "crc").distinct(), []).groupBy("node", F.xxhash64("text").alias("h")).agg(F.first("text").alias("text"))
            kept.append(common.materialize(found.select("node", "text")))
        return rows.join(kept[0], "node").groupBy("region", "block").applyInArrow(*by_text)

    open_, edges = _split_by_pivots(members.select(*names), F.col("len"), measured_texts)
    common.release(*kept)
    sent = _with_texts(base, _tasks(open_, F.col("len")), ["task"])
    return _all(sent.groupBy("task").applyInArrow(_join_block(size, percent), "a long, b long"), edges)


def _all(edges: DataFrame, more: list[DataFrame]) -> DataFrame:
    for x in more:
        edges = edges.unionByName(x)
    return edges


def _linked(docs: DataFrame, size: int, percent: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """The rows with shingles (id, n_shingles, component_id, node, and the component's `keep_node`: the smallest node of
    those with the smallest id), and the rows without (id, n)."""
    base = _base(docs, id_col, text_col)
    found = common.materialize(base.mapInArrow(_nodes(size, percent), _FOUND))
    nodes = found.where("not frequent").drop("frequent", "sketch")
    filled = nodes.where("n > 0")
    roots = components(links(base, size, percent, found))
    first = filled.groupBy("node").agg(F.min("id").alias("first"))
    rooted = first.join(roots, "node", "left").select("node", "first", F.coalesce("root", "node").alias("root"))
    lowest = rooted.groupBy("root").agg(F.min(F.struct(F.col("first").isNull().alias("none"), "first", "node")).alias("x"))
    of_node = rooted.join(lowest, "root").select("node", F.col("x.first").alias("component_id"), F.col("x.node").alias("keep_node"))
    return filled.join(of_node, "node").select("id", F.col("n").alias("n_shingles"), "component_id", "node", "keep_node"), nodes.where("n = 0").select("id", "n")


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_shingles, component_id (the smallest id that links reach)."""
    linked, bare = _linked(docs, size, percent, id_col, text_col)
    return linked.select("id", "n_shingles", "component_id").unionByName(bare.select("id", F.col("n").alias("n_shingles"), F.col("id").alias("component_id")))


def _marked(size: int, text_col: str, name: str):
    """Adds the node of the row's text; null if it has no shingles."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(size)
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                piece = batch.slice(k, 512)
                sets = (shingler.set_of(t) for t in piece.column(piece.schema.get_field_index(text_col)).to_pylist())
                yield piece.append_column(name, pa.array([node_of(s) if len(s) else None for s in sets], pa.int64()))

    return run


def drop_near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component, with its columns: a row with the smallest id, null ids last; of several such rows, one
    with the smallest node. Rows without shingles link with nothing and stay."""
    linked, _ = _linked(docs, size, percent, id_col, text_col)
    stays = F.col("id").eqNullSafe(F.col("component_id")) & (F.col("node") == F.col("keep_node"))
    found = linked.groupBy(F.col("id").alias("gone"), F.col("node").alias("mark")).agg(F.bool_and(stays).alias("stays"), F.count("*").alias("n"))
    marks = common.materialize(found.where("not stays or n > 1").drop("n"))
    return bloom.without_rows(docs, id_col, marks, lambda rows, name: rows.mapInArrow(_marked(size, text_col, name), StructType([*rows.schema.fields, StructField(name, LongType())])))


def brute_force(rows: list[tuple[int, str | None]], size: int = 5, percent: int = 80) -> list[tuple[int, int, int]]:
    """(id, n_shingles, component_id) by comparing all pairs that share a shingle, for tests."""
    sets, where = [], {}
    for k, (_, text) in enumerate(rows):
        w = text.encode().translate(_LOWER).split() if text else []
        n = min(size, len(w))
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set())
        for s in sets[-1]:
            where.setdefault(s, []).append(k)
    root = list(range(len(rows)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    for i, s in enumerate(sets):
        for j in {j for x in s for j in where[x] if j < i}:
            both = len(s & sets[j])
            if 100 * both >= percent * (len(s) + len(sets[j]) - both):
                root[find(i)] = find(j)
    lowest: dict[int, int] = {}
    for i, (id_, _) in enumerate(rows):
        lowest[find(i)] = min(lowest.get(find(i), id_), id_)
    return [(id_, len(sets[i]), lowest[find(i)]) for i, (id_, _) in enumerate(rows)]
