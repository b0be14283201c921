"""Language-model scoring by a hierarchical Pitman-Yor model.

The context of a word is the whole word before it (or the start of the text). Each context is a restaurant, a word a
dish; all context restaurants share one parent, the restaurant of the corpus, whose base spreads evenly over the known
words and one unknown word. Discounts are one half on both levels, for which the number of ways to seat n customers at
t tables has a closed form; so the tables of a dish can be drawn exactly.

Seating: a Gibbs sweep takes the customers and tables of a (context, word) pair out and draws its number of tables
anew, given all others; then the corpus's customers, one for each table below, are seated likewise. Pairs are drawn at
once, with the totals of the sweep before. A draw's random number is a hash of (seed, sweep, context, word): neither
partitions nor lost executors change a score. Pairs seen once have one table and need no draw. After the burn-in, each
sweep gives predictive probabilities, and their average scores texts.

How it runs: documents are dealt to blocks of bounded size. A block asks for its distinct pairs and words: pairs go
to parts by a range of the context's hash (contexts that are frequent in a bounded sample are spread over several
parts by the word's hash), words to shelves by a range of their own hash. Parts hold the pairs' seating, shelves the
corpus's restaurant and the tables of each context; each sweep mails tables up and totals down. At the end parts and
shelves answer the blocks, and each block scores its documents. The driver gets four sums a sweep; the model is never
broadcast or collected.

Defined results: a null or empty text is one end token; documents with null id are never held out; rows that share an
id are scored one by one; without training tokens all words have the base's probability; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import io
from collections.abc import Callable, Iterable, Iterator
from functools import partial
from itertools import repeat
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common, mail
from .mail import Letter, letter, pack
from .toxicity import in_fold

#: Bytes of text in a block, and that make a part or a shelf.
BLOCK_BYTES, PART_BYTES = 16 << 20, 16 << 20
#: Burn-in sweeps, sweeps averaged.
BURN_IN, SAMPLES = 2, 2
#: Strength of a context's restaurant and of the corpus's; both discounts are one half (see seat()).
STRENGTH, PARENT_STRENGTH, HALF = 1.0, 1.0, 0.5
#: Documents whose words show which contexts are frequent, at most about.
SAMPLE_DOCS = 2_000
#: Beyond so many customers only tables near the likeliest number are weighed (12 standard deviations to either side).
WHOLE_RANGE = 4_096
U64 = np.uint64
#: What stands for the start of a text as a context, and for its end as a word.
START, END = U64(0), U64((1 << 64) - 1)
_LOWER = bytes(c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))


def read_tokens(text: str | None) -> np.ndarray:
    """Hashes of the words of a text and of its end."""
    return np.append(common.hashed_words(text.encode().translate(_LOWER) if text else b"")[0], END)


class Layout(NamedTuple):
    """Keys of blocks, parts and shelves, and the frequent contexts with the number of parts that share each."""

    blocks: int
    parts: int
    hot: np.ndarray
    shares: np.ndarray

    def range_of(self, h: np.ndarray) -> np.ndarray:
        return ((h >> U64(32)) * U64(self.parts) >> U64(32)).astype(np.int64)

    def part(self, u: np.ndarray, w: np.ndarray) -> np.ndarray:
        found = self.range_of(u)
        if len(self.hot):
            at = np.minimum(np.searchsorted(self.hot, u), len(self.hot) - 1)
            split = np.flatnonzero(self.hot[at] == u)
            found[split] = (found[split] + (common.mix(w[split]) % self.shares[at[split]]).astype(np.int64)) % self.parts
        return found + self.blocks

    def shelf(self, w: np.ndarray) -> np.ndarray:
        return self.range_of(w) + self.blocks + self.parts


def runs(keys: np.ndarray) -> Iterator[tuple[int, slice]]:
    """The runs of equal keys of a sorted array."""
    if len(keys):
        cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
        for a, b in zip(np.concatenate([[0], cuts]), np.append(cuts, len(keys)), strict=True):
            yield int(keys[a]), slice(int(a), int(b))


class Sums(NamedTuple):
    """Training tokens, distinct ones; customers and tables of the corpus's restaurant."""

    tokens: int
    kinds: int
    customers: int = 0
    tables: int = 0

    def spread(self, tables: np.ndarray | int) -> np.ndarray:
        """What the base gives a word of the corpus's restaurant, before division by its customers."""
        return (PARENT_STRENGTH + HALF * tables) / (self.kinds + 1)


def starts_of(sizes: np.ndarray) -> np.ndarray:
    return np.cumsum(sizes) - sizes


def uniform(seed: int, sweep: int, u: np.ndarray, w: np.ndarray) -> np.ndarray:
    """A number in (0, 1) for each pair, the same in every run."""
    salt = common.mix(np.array([(seed << 20) + sweep + 1], U64))
    return ((common.mix(common.mix(u ^ salt) + w) >> U64(11)).astype(np.float64) + 0.5) / (1 << 53)


def seat(n: np.ndarray, fresh: np.ndarray, own: np.ndarray, all_: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Tables of n customers of one dish, drawn given all others, by inversion at x.

    With discount 1/2, (2n-t-1)! / ((t-1)! (n-t)! 4^(n-t)) weighs the ways to have t tables; table t+1 adds the factor
    (fresh + t/2) of this restaurant and (own + t) / (all + t) of the one above, which has seated t of them by then."""
    t = np.ones(len(n), np.int64)
    many = np.flatnonzero(n > 1)
    low = np.ones(len(n), np.int64)
    high = n.copy()
    big = many[n[many] > WHOLE_RANGE]
    if len(big):
        args = n[big], fresh[big], own[big], all_[big]
        a, b = np.ones(len(big), np.int64), n[big].copy()
        while (a < b).any():  # the least t whose successor weighs less
            mid = (a + b) // 2
            up = _ratio(np.minimum(mid, n[big] - 1), *args) > 1
            a, b = np.where((a < b) & up, mid + 1, a), np.where((a < b) & ~up, mid, b)
        reach = (64 + 12 * np.sqrt(2.0 * n[big])).astype(np.int64)
        low[big], high[big] = np.maximum(1, a - reach), np.minimum(n[big], a + reach)
    widths = (high - low)[many]
    ends = np.cumsum(widths)
    at = 0
    while at < len(many):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + 1_000_000, "right")))
        rows = many[at:to]
        w = widths[at:to]
        first = starts_of(w)
        row = np.repeat(np.arange(len(rows)), w)
        step = np.arange(int(w.sum())) - first[row] + low[rows][row]
        logs = np.log(_ratio(step, n[rows][row], fresh[rows][row], own[rows][row], all_[rows][row]))
        logs = np.cumsum(logs)
        logs -= np.where(first > 0, logs[first - 1], 0.0)[row]  # log weight of step + 1 tables, that of `low` being 0
        top = np.maximum(np.maximum.reduceat(logs, first), 0.0)
        weight = np.cumsum(np.exp(logs - top[row]))
        before = np.where(first > 0, weight[first - 1], 0.0)
        lowest = np.exp(-top)
        total = lowest + weight[first + w - 1] - before
        passed = lowest[row] + weight - before[row]
        t[rows] = low[rows] + (x[rows] * total > lowest) + np.add.reduceat((passed < (x[rows] * total)[row]).astype(np.int64), first)
        t[rows] = np.minimum(t[rows], high[rows])
        at = to
    return t


def _ratio(t: np.ndarray, n: np.ndarray, fresh: np.ndarray, own: np.ndarray, all_: np.ndarray) -> np.ndarray:
    """The weight of t + 1 tables by that of t."""
    return 4.0 * (n - t) / ((2.0 * n - t - 1) * t) * (fresh + HALF * t) * np.minimum((own + t) / (all_ + t), 1.0)


# What documents are dealt as: blobs of compressed Arrow rows, equal rows of a blob once with how often they stand


def _deal(blocks: int) -> Callable:
    kinds = pa.schema([("id", pa.int64()), ("text", pa.string()), ("learns", pa.bool_()), ("times", pa.int64())])

    def write(block: int, rows: list[pa.Table]) -> tuple:
        out = io.BytesIO()
        once = pa.concat_tables(rows).group_by(["id", "text", "learns"], use_threads=False).aggregate([([], "count_all")])
        with pa.ipc.new_stream(out, kinds, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 5))) as to:
            to.write_table(once.rename_columns(kinds.names).cast(kinds).combine_chunks())
        return letter(block, "docs", 0, out.getvalue())

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            held: dict[int, list[pa.Table]] = {}
            size = 0
            for b in batches:
                for k in range(0, b.num_rows, 512):
                    piece = pa.Table.from_batches([b.slice(k, 512)])
                    block = piece["block"].to_numpy()
                    order = np.argsort(block, kind="stable")
                    piece = piece.select(["id", "text", "learns"]).take(pa.array(order))
                    for key, part in runs(block[order]):
                        held.setdefault(key, []).append(piece.slice(part.start, part.stop - part.start))
                    size += piece.nbytes
                    if size > 32 << 20:
                        yield from (write(k, v) for k, v in held.items())
                        held, size = {}, 0
            yield from (write(k, v) for k, v in held.items())

        return mail.batches(rows())

    return run


class Block:
    """The documents of a block: tokens, distinct words and distinct pairs in the order of their parts."""

    def __init__(self, docs: list[Letter], layout: Layout) -> None:
        self.layout = layout
        ids, learns, times, tokens = [], [], [], []
        while docs:
            for b in pa.ipc.open_stream(docs.pop().blob):
                for i, text, on, n in common.rows_of([b], "id", "text", "learns", "times"):
                    ids.append(i)
                    times.append(n)
                    learns.append(n if on else 0)
                    tokens.append(read_tokens(text))
        self.ids, self.times, self.learns = ids, times, np.array(learns, np.int64)
        self.sizes = np.array([len(x) for x in tokens], np.int64)
        self.first = starts_of(self.sizes)
        tokens.append(np.array([START], U64))
        w = np.concatenate(tokens)
        tokens.clear()
        self.words, word = np.unique(w, return_inverse=True)  # the start stands first
        del w
        self.word = word[:-1].astype(np.int32)
        del word
        code = np.empty(len(self.word), np.int64)
        code[1:] = self.word[:-1]
        code[self.first] = 0
        code *= len(self.words)
        code += self.word
        code, pair = np.unique(code, return_inverse=True)
        self.pair = pair.astype(np.int32)
        del pair
        self.u, self.w = (code // len(self.words)).astype(np.int32), (code % len(self.words)).astype(np.int32)
        del code
        self.to = layout.part(self.words[self.u], self.words[self.w]).astype(np.int32)
        self.order = np.argsort(self.to, kind="stable").astype(np.int32)

    def ask(self, key: int) -> Iterator[tuple]:
        learns = np.repeat(self.learns, self.sizes).astype(float)
        n = np.bincount(self.pair, learns, len(self.u)).astype(np.int64)
        u, w, n, to = self.words[self.u[self.order]], self.words[self.w[self.order]], n[self.order], self.to[self.order]
        for part, s in runs(to):
            first = np.flatnonzero(np.concatenate([[True], u[s][1:] != u[s][:-1]]))
            yield letter(part, "ask", key, pack(u[s][first], np.diff(np.append(first, s.stop - s.start)), w[s], n[s]))
        c = np.bincount(self.word, learns, len(self.words)).astype(np.int64)
        c[0] = int(self.learns.sum())
        for shelf, s in runs(self.layout.shelf(self.words)):
            yield letter(shelf, "ask", key, pack(self.words[s], c[s]))

    def score(self, pairs: list[Letter], names: list[Letter], sums: list[Sums]) -> Iterator[tuple]:
        """id, n_tokens, n_known, base score and score of each document."""
        many = len(sums)
        k = np.empty(len(self.u), np.int64)
        k[self.order] = np.concatenate([x.arrays()[0] for x in pairs])
        parts = [x.arrays() for x in names]
        c, *rest = (np.concatenate(x) for x in zip(*parts, strict=True))
        customers = (STRENGTH + c).astype(np.float64)
        chance = np.zeros(len(self.u))
        for s, (now, own, tables) in enumerate(zip(sums, rest[::2], rest[1::2], strict=True)):
            p = (HALF * own + now.spread(now.tables)) / (PARENT_STRENGTH + now.customers)
            leak = (STRENGTH + HALF * tables) / customers
            chance += leak[self.u] * p[self.w]
        chance = chance / many + k / (2.0 * many) / customers[self.u]
        base = np.log10((c + 1.0) / (sums[0].tokens + sums[0].kinds + 1))
        total = lambda x: np.add.reduceat(x, self.first).tolist()
        rows = zip(self.ids, self.sizes.tolist(), total((c > 0).astype(np.int64)[self.word]), total(base[self.word]), total(np.log10(chance)[self.pair]), strict=True)
        for row, n in zip(rows, self.times, strict=True):
            yield from repeat(row, n)


def _merged(keys: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order that sorts by the last key first, where groups of equal keys begin, and each row's group."""
    order = np.lexsort(keys) if len(keys) > 1 else np.argsort(keys[0], kind="stable")
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k in keys:
        s = k[order]
        new[1:] |= s[1:] != s[:-1]
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(new) - 1
    return order, np.flatnonzero(new), group


def _sum_by(group: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    found = np.zeros(size, np.int64)
    np.add.at(found, group, values)
    return found


def open_part(key: int, asks: list[Letter], layout: Layout) -> Iterator[tuple]:
    """Count the pairs of a part; remember those seen more than once, each with one table, and what each block asked."""
    read = [x.arrays() for x in asks]
    u = np.concatenate([np.repeat(a[0], a[1]) for a in read])
    w, n = np.concatenate([a[2] for a in read]), np.concatenate([a[3] for a in read])
    order, first, group = _merged((w, u))
    u, w, n = u[order][first], w[order][first], np.add.reduceat(n[order], first)
    several = n > 1
    code = np.where(several, np.cumsum(several) + 1, n)[group]
    at = 0
    for x, a in zip(asks, read, strict=True):
        yield letter(key, "route", x.sub, pack(code[at : at + len(a[2])]))
        at += len(a[2])
    seen = n > 0
    names = []
    for h in (w[seen], u[seen]):
        kinds, index = np.unique(h, return_inverse=True)
        names.append((kinds, np.bincount(index[~several[seen]], minlength=len(kinds)), np.bincount(index[several[seen]], minlength=len(kinds))))
    yield from _by_shelf(key, "first", names, layout)
    us, ui = np.unique(u[several], return_inverse=True)
    ws, wi = np.unique(w[several], return_inverse=True)
    ones = np.ones(int(several.sum()), np.int64)
    yield letter(key, "seats", 0, pack(us, ws, ui, wi, n[several], ones, 0 * ones))


def _by_shelf(key: int, kind: str, names: list[tuple[np.ndarray, ...]], layout: Layout, hashes: bool = True) -> Iterator[tuple]:
    """One letter to each shelf with what belongs there of the words and of the contexts (hash first)."""
    cut = [dict(runs(layout.shelf(x[0]))) for x in names]
    none = slice(0, 0)
    for shelf in sorted({*cut[0], *cut[1]}):
        yield letter(shelf, kind, key, pack(*(y[c.get(shelf, none)] for x, c in zip(names, cut, strict=True) for y in x[0 if hashes else 1 :])))


def open_shelf(key: int, asks: list[Letter]) -> Iterator[tuple]:
    """Count the words of a shelf; remember what each block asked."""
    read = [x.arrays() for x in asks]
    w, c = np.concatenate([a[0] for a in read]), np.concatenate([a[1] for a in read])
    order, first, group = _merged((w,))
    w, c = w[order][first], np.add.reduceat(c[order], first)
    at = 0
    for x, a in zip(asks, read, strict=True):
        yield letter(key, "route", x.sub, pack(group[at : at + len(a[0])]))
        at += len(a[0])
    yield letter(key, "words", 0, pack(w, c))
    word = w != START
    yield letter(-1, "sums", key, b"", int(c[word].sum()), int((c[word] > 0).sum()))


def opened(layout: Layout, key: int, asks: list[Letter]) -> Iterator[tuple]:
    return open_part(key, asks, layout) if key < layout.blocks + layout.parts else open_shelf(key, asks)


class Shelf:
    """Words of a shelf: count, pairs seen once as a word and as a context, tables in the corpus's restaurant."""

    def __init__(self, w: np.ndarray, c: np.ndarray, once: np.ndarray, once_after: np.ndarray, tables: np.ndarray, *found: np.ndarray) -> None:
        self.w, self.c, self.once, self.once_after, self.tables, self.found = w, c, once, once_after, tables, list(found)

    def seat(self, key: int, links: dict[int, tuple[np.ndarray, np.ndarray]], up: dict[int, list[np.ndarray]], sums: Sums, sweep: int, seed: int, keeps: bool) -> Iterator[tuple]:
        """Draw the tables of each word, given the tables below, and send each part its totals."""
        below, after = self.once.copy(), self.once_after.copy()
        for part, (words, contexts) in links.items():
            below[words] += up[part][0]
            after[contexts] += up[part][1]
        live = below > 0
        fresh = PARENT_STRENGTH + HALF * (sums.tables - self.tables[live])
        even = np.full(len(fresh), 1.0 / (sums.kinds + 1))
        self.tables = self.tables.copy()
        # the base is even: own + t and all + t with huge numbers keep it so
        self.tables[live] = seat(below[live], fresh, even * 1e18, np.full(len(fresh), 1e18), uniform(seed, sweep, np.full(len(fresh), END), self.w[live]))
        if keeps:
            self.found += [2 * below - self.tables, after]
        yield letter(key, "shelf", 0, pack(self.w, self.c, self.once, self.once_after, self.tables, *self.found))
        for part, (words, contexts) in links.items():
            yield letter(key, "link", part, pack(words, contexts))
            yield letter(part, "down", key, pack(below[words], self.tables[words], after[contexts]))
        yield letter(-1, "sums", key, b"", int(below.sum()), int(self.tables.sum()))


def link_shelf(key: int, letters: list[Letter], sums: Sums, seed: int) -> Iterator[tuple]:
    """The first totals: where each part's words and contexts stand on the shelf, and one table for each word."""
    w, c = next(x for x in letters if x.kind == "words").arrays()
    once, after, links, up = np.zeros(len(w), np.int64), np.zeros(len(w), np.int64), {}, {}
    for x in letters:
        if x.kind == "first":
            words, single, several, contexts, single_after, several_after = x.arrays()
            words, contexts = np.searchsorted(w, words), np.searchsorted(w, contexts)
            once[words] += single
            after[contexts] += single_after
            if several.any() or several_after.any():
                links[x.sub] = words[several > 0], contexts[several_after > 0]
                up[x.sub] = [several[several > 0], several_after[several_after > 0]]
    return Shelf(w, c, once, after, np.zeros(len(w), np.int64)).seat(key, links, up, sums, 0, seed, False)


def sweep_part(key: int, letters: list[Letter], layout: Layout, sums: Sums, sweep: int, seed: int, keeps: bool) -> Iterator[tuple]:
    """Draw the tables of each pair of a part."""
    us, ws, ui, wi, n, t, total = next(x for x in letters if x.kind == "seats").arrays()
    if len(n):
        below, tables, after = (np.concatenate(x) for x in zip(*(x.arrays() for x in letters if x.kind == "down"), strict=True))
        others = (below[wi] - t).astype(np.float64)  # the word's customers in the corpus's restaurant, without this pair's
        left = np.where(others > 0, np.minimum(tables[wi], others), 0)
        own = others - HALF * np.maximum(left, 1) + sums.spread(sums.tables - tables[wi] + left)
        t = seat(n, STRENGTH + HALF * (after[ui] - t), own, PARENT_STRENGTH + sums.customers - t, uniform(seed, sweep, us[ui], ws[wi]))
    yield letter(key, "seats", 0, pack(us, ws, ui, wi, n, t, total + t if keeps else total))
    yield from _by_shelf(key, "up", [(ws, _sum_by(wi, t, len(ws))), (us, _sum_by(ui, t, len(us)))], layout, hashes=False)


def sweep_shelf(key: int, letters: list[Letter], sums: Sums, sweep: int, seed: int, keeps: bool) -> Iterator[tuple]:
    links = {x.sub: tuple(x.arrays()) for x in letters if x.kind == "link"}
    up = {x.sub: x.arrays() for x in letters if x.kind == "up"}
    return Shelf(*next(x for x in letters if x.kind == "shelf").arrays()).seat(key, links, up, sums, sweep, seed, keeps)


def answers(layout: Layout, samples: int, key: int, letters: list[Letter]) -> Iterator[tuple]:
    """What parts and shelves answer to each block that asked."""
    if key < layout.blocks + layout.parts:
        *_, n, _, total = next(x for x in letters if x.kind == "seats").arrays()
        worth = np.concatenate([[0, samples], 2 * samples * n - total])
        yield from (letter(x.sub, "pairs", key, pack(worth[x.arrays()[0]])) for x in letters if x.kind == "route")
    else:
        shelf = Shelf(*next(x for x in letters if x.kind == "shelf").arrays())
        for x in letters:
            if x.kind == "route":
                at = x.arrays()[0]
                yield letter(x.sub, "names", key, pack(shelf.c[at], *(y[at] for y in shelf.found)))


def _frequent(docs: DataFrame, rows: int, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Contexts that have over a quarter of a part's share of the words in a bounded sample, and how many parts share
    each. They only decide where pairs are counted, not what is counted."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [read_tokens(t)[:-1] for (t,) in common.rows_of([b], "text")]
            w, n = np.unique(np.concatenate([np.zeros(0, U64), *found]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(w.view(np.int64)), pa.array(n.astype(np.int64))], names=["w", "n"])

    some = docs.where(F.rand(5) * rows < SAMPLE_DOCS).select("text")
    words = some.mapInArrow(count, "w long, n long").groupBy("w").agg(F.sum("n").alias("n"))
    total = words.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    found = words.where(F.col("n") * 4 * parts > total).toPandas() if parts > 1 and total else None
    if found is None or found.empty:
        return np.zeros(0, U64), np.ones(0, U64)
    w = found["w"].to_numpy().view(U64)
    order = np.argsort(w)
    return w[order], np.minimum(np.ceil(found["n"].to_numpy()[order] * (4.0 * parts / total)), parts).astype(U64)


def score(docs: DataFrame, learns: Column, burn_in: int = BURN_IN, samples: int = SAMPLES, seed: int = 11, id_col: str = "doc_id", text_col: str = "text", part_bytes: int | None = None, block_bytes: int | None = None) -> DataFrame:
    """Learn from the rows for which `learns` holds and score all: id, n_tokens, n_known, base_score, score (both
    log10), train_tokens."""
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.coalesce(learns, F.lit(False)).alias("learns"))
    size, rows = base.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count("*")).first()
    blocks, parts = common.block_count(size, block_bytes or BLOCK_BYTES), common.block_count(size, part_bytes or PART_BYTES)
    layout = Layout(blocks, parts, *_frequent(base, rows, parts))
    dealt = base.withColumn("block", F.pmod(F.xxhash64("id", F.octet_length("text")), F.lit(blocks)).cast("int")).mapInArrow(_deal(blocks), mail.DDL)

    asked = mail.step(dealt, lambda key, letters: Block(letters, layout).ask(key))
    known = common.materialize(mail.step(asked, partial(opened, layout)))
    tokens, kinds = _sums(known)
    now, found = Sums(tokens, kinds), []
    routes = known.where("kind = 'route'")
    state = common.materialize(mail.step(known.where("kind in ('words', 'first')"), partial(link_shelf, sums=now, seed=seed)))
    now, seats = now._replace(**dict(zip(("customers", "tables"), _sums(state), strict=True))), known.where("kind = 'seats'")
    for sweep in range(1, burn_in + samples + 1):
        keeps = sweep > burn_in
        pairs = common.materialize(mail.step(seats.unionByName(state.where("kind = 'down'")), partial(sweep_part, layout=layout, sums=now, sweep=sweep, seed=seed, keeps=keeps)))
        after = common.materialize(mail.step(pairs.where("kind = 'up'").unionByName(state.where("kind in ('shelf', 'link')")), partial(sweep_shelf, sums=now, sweep=sweep, seed=seed, keeps=keeps)))
        if sweep > 1:
            common.release(seats)
        common.release(state)
        seats, state = pairs.where("kind = 'seats'"), after
        now = now._replace(**dict(zip(("customers", "tables"), _sums(state), strict=True)))
        found += [now] * keeps
    told = mail.step(routes.unionByName(seats).unionByName(state.where("kind = 'shelf'")), partial(answers, layout, samples))
    schema = pa.schema([("id", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])

    def rate(key: tuple, parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = {"docs": [], "pairs": [], "names": []}
        for x in mail.letters(parts):
            by[x.kind].append(x)
        return common.row_batches(Block(by["docs"], layout).score(by["pairs"], by["names"], found), schema)

    rated = told.unionByName(dealt).groupBy("key").applyInArrow(rate, "id long, n_tokens long, n_known long, base_score double, score double")
    return rated.withColumn("train_tokens", F.lit(tokens).cast("long"))


def _sums(rows: DataFrame) -> tuple[int, int]:
    return tuple(rows.where("kind = 'sums'").agg(F.coalesce(F.sum("a"), F.lit(0)), F.coalesce(F.sum("b"), F.lit(0))).first())


def score_corpus(docs: DataFrame, folds: int = 7, held_out: int = 2, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Learn from all documents outside a fold (by CRC-32 of the id as text) and score all: score()'s columns and held_out."""
    rows = score(docs, ~in_fold(F.col(id_col), folds, held_out), id_col=id_col, text_col=text_col, **options)
    return rows.withColumn("held_out", in_fold(F.col("id"), folds, held_out))


def perplexity(scored: DataFrame) -> DataFrame:
    """Perplexity a token of each row of score()."""
    return scored.select("id", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"))
