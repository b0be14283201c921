"""The Pitman-Yor model against a plain one written with dictionaries, and its seating against a customer-by-customer sampler."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import common, pitman_yor
from lodestone.llm.pitman_yor import END, HALF, PARENT_STRENGTH, START, STRENGTH, U64

LOW = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 7 == 2


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(8)
    vocab = ["".join(rng.choices("abcdeé", k=rng.randint(1, 4))) for _ in range(60)]
    rows = [(k, " ".join(rng.choices(vocab, weights=[1 / (j + 1) for j in range(60)], k=rng.randint(0, 80)))) for k in range(60)]
    return [*rows, (60, None), (61, ""), (62, " \t "), (None, "Aa ab"), (3, rows[3][1]), (63, "unseenword " * 3), (64, "AA bb \x0b cc")]


def tokens(text):
    words = (text or "").encode().translate(LOW)
    h = common.hashed_words(words)[0].tolist()
    return [*h, int(END)]


def plain(rows, burn_in, samples, seed):
    """The model with dictionaries, one pair after the other."""
    docs = [(i, tokens(t)) for i, t in rows]
    pairs, words, before = Counter(), Counter(), Counter()
    for i, w in docs:
        if not held(i):
            for u, x in zip([int(START), *w], w):
                pairs[u, x] += 1
                words[x] += 1
                before[u] += 1
    n, v = sum(words.values()), len(words)

    def draw(count, fresh, own, all_, x):
        logs = [0.0]
        for t in range(1, count):
            logs.append(logs[-1] + math.log(4 * (count - t) / ((2 * count - t - 1) * t) * (fresh + t / 2) * (own + t) / (all_ + t)))
        weights = [math.exp(y - max(logs)) for y in logs]
        rest = x * sum(weights)
        for t, y in enumerate(weights, 1):
            rest -= y
            if rest <= 0:
                return t
        return count

    number = lambda sweep, u, w: float(pitman_yor.uniform(seed, sweep, np.array([u], U64), np.array([w], U64))[0])
    tables = dict.fromkeys(pairs, 1)
    top = dict.fromkeys(words, 0)
    below = Counter()
    for (_, w), t in tables.items():
        below[w] += t
    customers, all_tables, kept = 0, 0, []

    def seat_words(sweep):
        nonlocal customers, all_tables, top
        new = {}
        for w in words:
            new[w] = draw(below[w], PARENT_STRENGTH + HALF * (all_tables - top[w]), 1e18 / (v + 1), 1e18, number(sweep, int(END), w))
        top = new
        customers, all_tables = sum(below.values()), sum(top.values())

    seat_words(0)
    for sweep in range(1, burn_in + samples + 1):
        after = Counter()
        for (u, _), t in tables.items():
            after[u] += t
        new = {}
        for (u, w), count in pairs.items():
            t = tables[u, w]
            others = below[w] - t
            left = min(top[w], others) if others else 0
            own = others - max(left, 1) / 2 + (PARENT_STRENGTH + (all_tables - top[w] + left) / 2) / (v + 1)
            new[u, w] = draw(count, STRENGTH + (after[u] - t) / 2, own, PARENT_STRENGTH + customers - t, number(sweep, u, w)) if count > 1 else 1
        tables = new
        below = Counter()
        for (_, w), t in tables.items():
            below[w] += t
        seat_words(sweep)
        if sweep > burn_in:
            after = Counter()
            for (u, _), t in tables.items():
                after[u] += t
            kept.append((dict(tables), Counter(below), dict(top), customers, all_tables, after))

    def chance(w, u):
        p = 0.0
        for t, low, high, c, k, after in kept:
            base = (low[w] - high.get(w, 0) / 2 + (PARENT_STRENGTH + k / 2) / (v + 1)) / (PARENT_STRENGTH + c)
            p += (max(pairs[u, w] - t.get((u, w), 0) / 2, 0) + (STRENGTH + after[u] / 2) * base) / (STRENGTH + before[u])
        return p / len(kept)

    return docs, n, v, words, chance


def test_scores_equal_the_plain_model(spark, texts):
    docs, n, v, words, chance = plain(texts, 2, 2, 11)
    got = sorted(tuple(r) for r in pitman_yor.score_corpus(spark.createDataFrame(texts, "doc_id long, text string")).select("n_tokens", "n_known", "base_score", "score", "train_tokens", F.coalesce("id", F.lit(-1)), "held_out").collect())
    want = sorted((len(w), sum(x in words for x in w), sum(math.log10((words[x] + 1) / (n + v + 1)) for x in w), sum(math.log10(chance(x, u)) for u, x in zip([int(START), *w], w)), n, -1 if i is None else i, held(i)) for i, w in docs)
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert a == pytest.approx(b, rel=1e-9)
    for u in [int(START), docs[0][1][0], 12345]:  # the known words and the unknown one
        assert sum(chance(w, u) for w in words) + chance(777, u) == pytest.approx(1)


def test_scores_do_not_depend_on_partitions(spark, texts):
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    one = pitman_yor.score_corpus(docs.repartition(1))
    many = pitman_yor.score_corpus(docs.repartition(7), part_bytes=300, block_bytes=700)
    rows = lambda d: sorted((-1 if r["id"] is None else r["id"], r["n_tokens"], round(r["score"], 8), round(r["base_score"], 8)) for r in d.collect())
    assert rows(one) == rows(many)


def test_seating_equals_a_sampler_that_moves_one_customer(spark):
    """Tables of 9 customers of one dish, all other customers fixed, by a chain that takes each customer out and seats it again."""
    rng, n, fresh, own, all_ = random.Random(5), 9, 3.0, 2.5, 20.0
    sizes, seen = [n], Counter()
    for turn in range(40_000):
        k = rng.choices(range(len(sizes)), weights=sizes)[0]  # a random customer's table
        sizes[k] -= 1
        sizes = [s for s in sizes if s]
        t = len(sizes)
        weights = [s - HALF for s in sizes] + [(fresh + HALF * t) * (own + t) / (all_ + t)]
        k = rng.choices(range(t + 1), weights=weights)[0]
        sizes = sizes + [1] if k == t else [s + (j == k) for j, s in enumerate(sizes)]
        if turn > 500:
            seen[len(sizes)] += 1
    x = np.random.default_rng(1).random(40_000)
    ones = np.ones(len(x))
    got = Counter(pitman_yor.seat(np.full(len(x), n), fresh * ones, own * ones, all_ * ones, x).tolist())
    for t in range(1, n + 1):
        assert abs(seen[t] / sum(seen.values()) - got[t] / len(x)) < 0.02


def test_large_counts_are_weighed_near_their_likeliest_number(monkeypatch):
    rng = np.random.default_rng(3)
    n = np.array([2, 5, 300, 900, 1500, 7, 1, 2000])
    fresh, own, all_, x = rng.random(8) * 40, rng.random(8) * 5, 50 + rng.random(8), rng.random(8)
    whole = pitman_yor.seat(n, fresh, own, all_, x)
    monkeypatch.setattr(pitman_yor, "WHOLE_RANGE", 100)
    assert (pitman_yor.seat(n, fresh, own, all_, x) == whole).all() and (whole >= 1).all() and (whole <= n).all()


def test_frequent_contexts_are_shared(spark):
    rows = [(k, " ".join(f"the w{k * 40 + j}" for j in range(40))) for k in range(50)]
    docs = spark.createDataFrame(rows, "id long, text string")
    hot, shares = pitman_yor._frequent(docs, 50, 8)
    assert hot.tolist() == [common.hashed_words(b"the")[0][0]] and 8 >= shares[0] >= 4
    layout = pitman_yor.Layout(3, 8, hot, shares)
    w = common.mix(np.arange(1000).astype(U64))
    assert len(set(layout.part(np.repeat(hot, 1000), w).tolist())) >= 4
    one = pitman_yor.score_corpus(docs, id_col="id")
    many = pitman_yor.score_corpus(docs, id_col="id", part_bytes=2_000, block_bytes=4_000)
    assert {r["id"]: round(r["score"], 8) for r in one.collect()} == {r["id"]: round(r["score"], 8) for r in many.collect()}


def test_equal_rows_are_dealt_once(spark):
    """Two thirds of the rows are one row: a blob has it once, and all are counted and scored."""
    rows = [(None, "same words again")] * 400 + [(k, f"other words {k}") for k in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    got = pitman_yor.score_corpus(docs, block_bytes=2_000).toPandas()
    assert len(got) == 600 and got["id"].isna().sum() == 400 and got[got["id"].isna()]["score"].nunique() == 1
    held_out = sum(held(k) for k in range(200))
    assert set(got["train_tokens"]) == {4 * 400 + 4 * (200 - held_out)}
    dealt = docs.selectExpr("doc_id as id", "text", "true as learns", "0 as block").mapInArrow(pitman_yor._deal(1), pitman_yor.mail.DDL)
    sizes = [sum(b.num_rows for b in pitman_yor.pa.ipc.open_stream(r["blob"])) for r in dealt.collect()]
    assert sum(sizes) <= 200 + len(sizes)


def test_odd_tables(spark):
    clash = spark.createDataFrame([(1, "a b", 5, "k"), (2, None, 6, "l"), (1, "a b", 5, "k")], "doc_id long, text string, key int, block string")
    assert pitman_yor.score_corpus(clash).count() == 3
    assert pitman_yor.score_corpus(clash.where("doc_id > 9")).count() == 0
    alone = pitman_yor.score(clash, F.lit(False)).collect()  # nothing to learn from
    assert [r["n_known"] for r in alone] == [0, 0, 0] and all(r["score"] == pytest.approx(0) for r in alone)
    long = spark.createDataFrame([(1, "word " * 400_000), (2, "other")], "doc_id long, text string")
    assert pitman_yor.score(long, F.lit(True)).agg(F.sum("n_tokens")).first()[0] == 400_003
