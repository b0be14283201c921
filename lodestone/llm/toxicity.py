"""Toxicity: a lexicon learnt from labels, Levenshtein automata over its trie, and context-window scores.

The lexicon's terms are whole words and word stems whose documents are toxic far more often than chance would have it
(a likelihood-ratio test). The Levenshtein automata of all terms are intersected with the lexicon's trie and
determinised as words pass: a state is the set of (trie node, edits used), its moves are remembered, and a word is
dropped as soon as no term can be reached. So misspelled terms are caught at a few table look-ups for each new word.
Each hit is scored in its context window: other hits near it, marks of quotation around it, and cues before it, words
that stand before terms in harmless documents far more often than in toxic ones. A logistic model of those scores,
fitted on the same labelled rows, separates quotation from abuse.

Bound: the labelled rows used (`max_labelled`, chosen by hash of the id; of near copies, which would make all their
words look telling, one) are the only one; the lexicon holds all terms that pass the test, and every document is scored
over its whole text.

Defined results: a null text counts as empty and is scored as such; without usable labels of both kinds all scores are
the share of toxic labels (0 without labels); labels with null id or null value are left out; rows that repeat an id
are scored one by one; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

MAX_LABELLED = 20_000
#: Letters that a stem has at least.
STEM = 3
#: By how much a term's log likelihood ratio must beat the logarithm of the number of terms tried.
MIN_GAIN = 6.0
#: Share of toxic texts among those that a stem has beyond its commonest longer form.
PURE = 0.95
#: Words in a run, and how many of the runs' smallest hashes tell near copies.
RUN, SKETCH = 3, 4
EDIT_LENGTH = 5
WINDOW = 12
WORD = re.compile(r"\w+")
#: Marks of quotation (fixed values).
QUOTE_MARKS = "\"“”„«»"
#: The last four are of exact hits.
FEATURES = ("exact words", "exact stems", "misspelt words", "misspelt stems", "densest window", "hits a word", "quoted share", "distinct terms")


class Lexicon:
    """The terms' trie and the determinised automaton over it. A term is (letters, is_stem)."""

    DEAD = 0

    def __init__(self, terms: list[tuple[str, bool]]) -> None:
        self.terms = terms
        self.children: list[dict[str, int]] = [{}]
        self.ends: list[dict[bool, int]] = [{}]
        self.depth_left = [0]
        for k, (letters, stem) in enumerate(terms):
            node = 0
            for c in letters:
                nxt = self.children[node].get(c)
                if nxt is None:
                    nxt = self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.ends.append({})
                node = nxt
            self.ends[node].setdefault(stem, k)
        self.known: dict[frozenset, int] = {frozenset(): 0}
        self.moves: list[dict[str, int]] = [{}]
        self.at_end: list[tuple | None] = [None]
        self.reached: list[tuple | None] = [None]
        self.start = self._state({(0, 0, "")})

    def _closed(self, states: set) -> set:
        """With the states that leave out a letter of a term."""
        out = set(states)
        for node, edits, _ in states:
            if edits == 0:
                out.update((child, 1, "") for child in self.children[node].values())
        return out

    def _hit(self, states: Iterable[tuple], stem: bool) -> tuple | None:
        """(edits, term) of the best term that ends in these states; edits only in terms of EDIT_LENGTH letters or more."""
        found = [(e, self.ends[n][stem]) for n, e, held in states if not held and stem in self.ends[n]]
        return min((x for x in found if x[0] == 0 or len(self.terms[x[1]][0]) >= EDIT_LENGTH), default=None)

    def _state(self, states: set) -> int:
        key = frozenset(self._closed(states))
        if key not in self.known:
            self.known[key] = len(self.moves)
            self.moves.append({})
            self.at_end.append(self._hit(key, False))
            self.reached.append(self._hit(key, True))
            self._sets = getattr(self, "_sets", {0: frozenset()})
            self._sets[self.known[key]] = key
        return self.known[key]

    def _move(self, state: int, c: str) -> int:
        out = set()
        for node, edits, held in self._sets[state]:
            if held:  # the two letters of a swap
                if held == c:
                    out.add((node, edits, ""))
                continue
            nxt = self.children[node].get(c)
            if nxt is not None:
                out.add((nxt, edits, ""))
            if edits == 0:
                out.add((node, 1, ""))
                for d, child in self.children[node].items():
                    if d != c:
                        out.add((child, 1, ""))
                        after = self.children[child].get(c)
                        if after is not None:
                            out.add((after, 1, d))
        self.moves[state][c] = nxt_state = self._state(out)
        return nxt_state

    def match(self, word: str) -> tuple[int, int] | None:
        """(edits, term) of the best term that the word is or starts with, with at most one edit."""
        state, best = self.start, None
        for c in word:
            nxt = self.moves[state].get(c)
            state = nxt if nxt is not None else self._move(state, c)
            if state == self.DEAD:
                return best
            hit = self.reached[state]
            if hit is not None and (best is None or hit < best):
                best = hit
        end = self.at_end[state]
        return end if end is not None and (best is None or end <= best) else best


class _Codes(dict):
    """0 for words without a hit, else 1 + the hit's number."""

    def __init__(self, lexicon: Lexicon) -> None:
        super().__init__()
        self.lexicon, self.hits = lexicon, {}

    def __missing__(self, word: str) -> int:
        if len(self) > 2 * common.WORD_MEMORY:
            self.clear()
        hit = self.lexicon.match(word)
        self[word] = code = 0 if hit is None else self.hits.setdefault(hit, len(self.hits) + 1)
        return code


class Reader:
    """Features of texts."""

    def __init__(self, terms: list[tuple[str, bool]], cues: Iterable[str] = ()) -> None:
        self.lexicon, self.cues = Lexicon(terms), frozenset(cues)
        self.codes = _Codes(self.lexicon)

    def before_hits(self, text: str | None) -> set[str]:
        """Words without a hit that stand shortly before one."""
        words = WORD.findall(text.lower()) if text else []
        at = [i for i, w in enumerate(words) if self.codes[w]]
        return {w for i in at for w in words[max(0, i - WINDOW // 2) : i] if not self.codes[w]}

    def features(self, text: str | None) -> list[float]:
        words = WORD.findall(text.lower()) if text else []
        code = np.fromiter(map(self.codes.__getitem__, words), np.int32, len(words))
        at = np.flatnonzero(code)
        if not len(at):
            return [0.0] * len(FEATURES)
        name = {v: k for k, v in self.codes.hits.items()}
        hits = [name[c] for c in code[at].tolist()]
        kinds = Counter((e, self.lexicon.terms[t][1]) for e, t in hits)
        at = at[[e == 0 for e, _ in hits]]
        if not len(at):
            return [0.0, 0.0, *(float(np.log1p(kinds[1, stem])) for stem in (False, True)), 0.0, 0.0, 0.0, 0.0]
        near = np.searchsorted(at, at + WINDOW, "right") - np.arange(len(at))
        quoted = self._quoted(text, words, at)
        return [
            *(float(np.log1p(kinds[k])) for k in ((0, False), (0, True), (1, False), (1, True))),
            float(np.log(near.max())), len(at) / len(words), float(quoted.mean()), float(np.log(len({t for e, t in hits if e == 0}))),
        ]

    def _quoted(self, text: str, words: list[str], at: np.ndarray) -> np.ndarray:
        """Whether each hit stands between marks of quotation or shortly after a cue."""
        said = np.cumsum([w in self.cues for w in words])
        out = said[at] - said[np.maximum(at - WINDOW // 2, 0)] > 0
        low = text.lower()
        if any(m in low for m in QUOTE_MARKS):
            starts = [m.start() for m in WORD.finditer(low)]
            for k, i in enumerate(at.tolist()):
                left = low[starts[max(0, i - WINDOW)] : starts[i]]
                right = low[starts[i] : starts[min(len(starts) - 1, i + WINDOW)] + 1]
                out[k] |= sum(left.count(m) for m in QUOTE_MARKS) % 2 == 1 and any(m in right for m in QUOTE_MARKS)
        return out


def in_fold(id_: Column, folds: int, fold: int) -> Column:
    """Whether the CRC-32 of the id as text leaves this remainder; false for null ids."""
    return F.coalesce(F.pmod(F.crc32(id_.cast("string").cast("binary")), F.lit(folds)) == fold, F.lit(False))


def _counts(terms_of):
    """A mapInArrow function: how many texts of each kind have each term that terms_of()(text) gives."""
    schema = pa.schema([("term", pa.string()), ("pos", pa.int64()), ("neg", pa.int64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pos, neg, read = Counter(), Counter(), terms_of()

        def flush():
            terms = list(pos | neg)
            yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array([pos[t] for t in terms], pa.int64()), pa.array([neg[t] for t in terms], pa.int64())], schema=schema)
            pos.clear()
            neg.clear()

        for text, toxic in common.rows_of(batches, "text", "toxic"):
            (pos if toxic else neg).update(read(text))
            if len(pos) + len(neg) > 400_000:
                yield from flush()
        if pos or neg:
            yield from flush()

    return run


def words_and_stems(text: str | None) -> set[str]:
    """'=' marks whole words."""
    words = set(WORD.findall(text.lower())) if text else set()
    return {"=" + w for w in words} | {w[:k] for w in words for k in range(STEM, len(w))}


def telling(rows: DataFrame, terms_of, share: float, kind: str) -> list[tuple[str, int, int]]:
    """(term, toxic texts, others) of the terms whose texts are of a kind ("pos" or "neg", which a share of all texts is)
    far more often than chance would have it."""
    counts = rows.mapInArrow(_counts(terms_of), "term string, pos long, neg long").groupBy("term").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    counts = common.materialize(counts)
    least = MIN_GAIN + float(np.log(max(1, counts.count())))
    own, other = F.col(kind), F.col("neg" if kind == "pos" else "pos")
    rate = own / (own + other)
    gain = own * F.log(rate / share) + F.when(other > 0, other * F.log((1 - rate) / (1 - share))).otherwise(0.0)
    best = counts.where((own > 1) & (rate > max(0.5, share))).where(gain > least).orderBy(gain.desc(), "term")
    found = [(r["term"], r["pos"], r["neg"]) for r in best.collect()]
    common.release(counts)
    return found


def _sketched(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, toxic, s0, s1 ..): the smallest of SKETCH hashes over the runs of words."""
    schema = pa.schema([("text", pa.string()), ("toxic", pa.int32()), *[(f"s{k}", pa.int64()) for k in range(SKETCH)]])
    rolling = common.Rolling()

    def row(text: str | None, toxic: int) -> tuple:
        prefix = rolling.prefix(common.hashed_words(text.lower().encode())[0] if text else np.zeros(0, np.uint64))
        runs = rolling.windows(prefix, min(RUN, len(prefix) - 1)) if len(prefix) > 1 else np.zeros(1, np.uint64)
        return text, toxic, *(int(common.signed(common.mix(runs ^ np.uint64(common.MIX_B * (k + 1) & common.MASK)).min(keepdims=True))[0]) for k in range(SKETCH))

    return common.row_batches((row(*r) for r in common.rows_of(batches, "text", "toxic")), schema, 500)


def without_near_copies(rows: DataFrame) -> DataFrame:
    """One of the texts of each kind that share the smallest hash of their runs, for each hash in turn."""
    rows = rows.mapInArrow(_sketched, "text string, toxic int, " + ", ".join(f"s{k} long" for k in range(SKETCH)))
    names = rows.columns
    for k in range(SKETCH):
        rows = rows.groupBy(f"s{k}", "toxic").agg(F.min(F.struct("text", *[f"s{j}" for j in range(SKETCH)])).alias("x")).select("toxic", "x.text", *[f"x.s{j}" for j in range(SKETCH)]).select(*names)
    return rows.select("text", "toxic")


def choose_terms(found: list[tuple[str, int, int]]) -> list[tuple[str, bool]]:
    """Of (term, toxic texts, others): words, and stems instead of the terms that start with them where a stem's further
    texts are nearly all toxic too; each once."""
    support = {(t.lstrip("=") if t[0] == "=" else t, t[0] != "="): (p, n) for t, p, n in found}
    by_letters: dict[str, list] = {}
    for (letters, stem), (p, n) in support.items():
        for k in range(1, len(letters) + 1):
            by_letters.setdefault(letters[:k], []).append((letters, stem, p, n))
    kept: list[tuple[str, bool]] = []
    for (letters, stem), (p, n) in sorted(support.items(), key=lambda x: (len(x[0][0]), not x[0][1], x[0][0])):
        if any(s and letters.startswith(k) for k, s in kept):
            continue
        longer = [(q, -m) for other, s, q, m in by_letters[letters] if len(other) > len(letters) or (stem and not s)] if stem else []
        if longer:
            q, m = max(longer)
            if q >= 0.9 * p or p - q < PURE * (p - q + n + m):
                continue
        kept.append((letters, stem))
    return kept


class Model:
    """Terms, cues, the weights of the features, and the share of toxic labels for want of both kinds."""

    def __init__(self, terms: list[tuple[str, bool]], cues: list[str], weights: np.ndarray | None, share: float) -> None:
        self.terms, self.cues, self.weights, self.share = terms, cues, weights, share

    def reader(self) -> Reader:
        return Reader(self.terms, self.cues)

    def score(self, features: list[float]) -> float:
        if self.weights is None:
            return self.share
        return float(1 / (1 + np.exp(-np.clip(self.weights[0] + np.dot(self.weights[1:], features), -30, 30))))


def fit_weights(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, steps: int = 30) -> np.ndarray:
    """Logistic regression with a small ridge, by Newton steps."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[0] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(h, x.T @ (p - y) + penalty * w)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Learn from the labelled rows given; at most about max_labelled of them, chosen by hash of the id."""
    usable = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("toxic")).dropna().groupBy("id").agg(F.max("toxic").alias("toxic"))
    total = usable.count()
    if total > max_labelled:
        usable = usable.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < F.lit(int((1 << 20) * max_labelled / total)))
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = common.materialize(without_near_copies(base.join(F.broadcast(usable), "id").select("text", "toxic")))
    n, p = rows.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if not 0 < p < n:
        common.release(rows)
        return Model([], [], None, p / n if n else 0.0)
    terms = choose_terms(telling(rows, lambda: words_and_stems, p / n, "pos"))
    cues = [t for t, _, _ in telling(rows, lambda: Reader(terms).before_hits, 1 - p / n, "neg")] if terms else []

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(terms, cues)
        schema = pa.schema([("toxic", pa.int32()), ("x", pa.list_(pa.float64()))])
        return common.row_batches(((y, reader.features(t)) for t, y in common.rows_of(batches, "text", "toxic")), schema)

    got = rows.mapInArrow(read, "toxic int, x array<double>").toPandas()
    common.release(rows)
    return Model(terms, cues, fit_weights(np.array(got["x"].tolist()), got["toxic"].to_numpy(float)), p / n)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, score and n_hits."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([("id", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        reader = model.reader()
        return common.row_batches(((i, model.score(reader.features(t))) for i, t in common.rows_of(batches, "id", "text")), schema)

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, score double")


def drop_toxic(docs: DataFrame, model: Model, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """The documents that score below the threshold, with their columns."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def keep():
        model = held.value
        reader = model.reader()
        return lambda text: model.score(reader.features(text)) < threshold

    return common.kept_rows(docs, text_col, keep)
