"""Operators over documents, held against brute force on small tables with every odd case."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import bpe, common, decontaminate, exact_dedup, jaccard_join, queries, sharding, substring_dedup, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, sha string, node string, shard string, key string, part string"


def words(rng, n):
    return [rng.choice("the of and alpha beta gamma delta") if rng.random() < 0.3 else "".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 7))) for _ in range(n)]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    passage = words(rng, 70)
    out = [None, "", " \n\t ", "one", "one", "One", "two words", "x" * 200_000, "a b c d e", "A B C D E"]
    base = words(rng, 120)
    for k in range(40):
        edited = list(base)
        for _ in range(k % 5):
            edited[rng.randrange(len(edited))] = "edit" + str(rng.random())
        out.append(" ".join(edited))
    for _ in range(30):
        out.append(" ".join(words(rng, rng.randint(0, 90)) + passage[rng.randint(0, 8) :] + words(rng, rng.randint(0, 90))))
    out += [out[12].replace(" ", "  \n"), out[12], " ".join(["same"] * 150), " ".join(["same"] * 120), " ".join(words(rng, 9000))]
    return [(1000 - 3 * k, t) for k, t in enumerate(out)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 1, 7, "x", "y", "z", "k", "p") for i, t in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def odd(spark):
    """Null ids, rows that repeat an id, repeated rows."""
    return spark.createDataFrame([(None, "a b"), (None, None), (1, "a  b"), (1, "a b"), (1, "c"), (2, "c"), (2, "c")], "doc_id long, text string")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")


def test_exact_dedup(docs, rows, odd, empty):
    norm = {i: re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for i, t in rows}
    got = {r["id"]: r for r in exact_dedup.exact_dedup(docs).collect()}
    assert len(got) == len(rows)
    for i, t in norm.items():
        same = [j for j, u in norm.items() if u == t]
        assert (got[i]["keep_id"], got[i]["group_size"], got[i]["kept"]) == (min(same), len(same), i == min(same))
        assert bytes(got[i]["sha"]) == hashlib.sha256(t.encode()).digest()
    found = exact_dedup.exact_dedup(odd).collect()
    assert len(found) == 7 and sum(r["kept"] for r in found) == 3
    assert exact_dedup.exact_dedup(empty).count() == 0


def test_exact_dedup_across_partitions(spark):
    many = spark.createDataFrame([(k, "same text" if k % 3 else f"t{k}") for k in range(3000)], "doc_id long, text string").repartition(7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = exact_dedup.exact_dedup(many).where("group_size > 1").agg(F.min("group_size"), F.max("group_size"), F.sum(F.col("kept").cast("int")), F.max("keep_id")).first()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert tuple(got) == (2000, 2000, 1, 1)


def test_substring_dedup(docs, rows, odd, empty):
    got = {(r["id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring_dedup.digest(substring_dedup.duplicate_spans(docs)).collect()}
    want = set(substring_dedup.brute_force(rows))
    assert got == want and sum(r[2] for r in want) > 1000
    assert substring_dedup.duplicate_spans(odd).count() == 7
    assert substring_dedup.duplicate_spans(empty).count() == 0


def test_substring_dedup_spans_keep_text(docs):
    for r in substring_dedup.duplicate_spans(docs).where("n_removed > 0").collect():
        assert sum(s["b"] - s["a"] for s in r["spans"]) == r["n_removed"]
        assert len(r["kept_text"].split()) == r["n_words"] - r["n_removed"]
        assert all(s["b"] - s["a"] >= 50 for s in r["spans"])


def test_substring_dedup_factors_are_in_their_sources(docs, rows):
    """Word for word: each window of a factor stands in the document it names, which has a smaller id, and no smaller one has it."""
    texts = {i: (t or "").split() for i, t in rows}
    windows = {i: {tuple(w[k : k + 50]) for k in range(len(w) - 49)} for i, w in texts.items()}
    seen = 0
    for r in substring_dedup.duplicate_spans(docs).where("size(factors) > 0").collect():
        w = texts[r["id"]]
        assert all(a["b"] - 50 < b["a"] for a, b in zip(r["factors"], r["factors"][1:]))
        for f in r["factors"]:
            for k in range(f["a"], f["b"] - 49):
                has = [i for i in texts if tuple(w[k : k + 50]) in windows[i]]
                assert min(has) == f["source"] < r["id"]
                seen += 1
    assert seen > 500


def test_substring_dedup_many_rows_without_id(spark, rows):
    some = [t for _, t in rows[10:60]]
    docs = spark.createDataFrame([(None if k % 2 else 5000 + k, t) for k, t in enumerate(some * 4)], "doc_id long, text string").selectExpr("*", "1 as row", "2 as anchor", "3 as whole", "4 as maybe")
    got = sorted((r["id"] or 0, r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring_dedup.digest(substring_dedup.duplicate_spans(docs)).collect())
    assert got == sorted((i or 0, *rest) for i, *rest in substring_dedup.brute_force([tuple(r) for r in docs.select("doc_id", "text").collect()]))


def test_jaccard_join(docs, rows, odd, empty):
    got = sorted((r["id"], r["n_shingles"], r["component_id"]) for r in jaccard_join.near_duplicates(docs).collect())
    assert got == sorted(jaccard_join.brute_force(rows))
    assert jaccard_join.near_duplicates(odd).count() == 7
    assert jaccard_join.near_duplicates(empty).count() == 0


def test_jaccard_join_in_blocks(monkeypatch, docs, rows):
    monkeypatch.setattr(jaccard_join, "REGION_ROWS", 5)
    monkeypatch.setattr(jaccard_join, "ROUNDS", 2)
    got = sorted((r["id"], r["n_shingles"], r["component_id"]) for r in jaccard_join.near_duplicates(docs).collect())
    assert got == sorted(jaccard_join.brute_force(rows))


def test_jaccard_join_passages_open_no_regions(monkeypatch, spark):
    """What many texts share stays out of the first shingles also where the order has little room."""
    rng, seen, classes = random.Random(5), [], jaccard_join._classes
    passages = [" ".join(f"p{rng.random()}" for _ in range(20)) for _ in range(3)]
    rows = [(k, passages[k % 3] + " " + " ".join(f"w{rng.random()}" for _ in range(40))) for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(jaccard_join, "FREQUENT", 100)
    monkeypatch.setattr(jaccard_join, "_classes", lambda members, percent: (seen.append(members.count()), classes(members, percent))[1])
    got = sorted((r["id"], r["n_shingles"], r["component_id"]) for r in jaccard_join.near_duplicates(docs).collect())
    assert got == sorted(jaccard_join.brute_force(rows))
    assert seen == [0]
    # Without any room all that is shared is compared, with the same results.
    monkeypatch.setattr(jaccard_join, "FREQUENT", 0)
    assert sorted((r["id"], r["n_shingles"], r["component_id"]) for r in jaccard_join.near_duplicates(docs).collect()) == got
    assert seen[1] > 0


def test_sketches_rule_nothing_out(rows):
    s = jaccard_join.Shingler(5)
    sets = [x for x in (s.set_of(t) for _, t in rows) if len(x)]
    rng = np.random.default_rng(0)
    for x in sets:
        y = np.sort(rng.permutation(x)[: jaccard_join.least_shared(len(x), 80)])
        k = jaccard_join.size_class(len(x), 80)
        for top in {k, jaccard_join.size_class(len(y), 80) + 1} & {k}:
            m = jaccard_join.buckets(top, 80)
            a, b = (np.frombuffer(jaccard_join.sketch_of(z, 80), np.uint8).reshape(-1, m).sum(axis=0).astype(int) for z in (x, y))
            assert np.abs(a - b).sum() * 180 <= (len(x) + len(y)) * 20


def test_decontamination(spark, docs, rows, odd, empty):
    rng = random.Random(5)
    sample = [t for _, t in rows if t and len(t.split()) > 60]
    items = [(k, " ".join(rng.choice(sample).split()[5 : 5 + rng.choice([3, 13, 30])]).upper()) for k in range(12)] + [(12, None), (13, ""), (None, "alpha"), (14, "one"), (14, "one")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    cut = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    low = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    want = set()
    for i, t in rows:
        w, hit, found = cut.findall(low(t)), set(), set()
        for item, text in items:
            b = cut.findall(low(text))
            if item is None or not b:
                continue
            n = min(13, len(b))
            windows = {tuple(b[k : k + n]) for k in range(len(b) - n + 1)}
            at = [k for k in range(len(w) - n + 1) if tuple(w[k : k + n]) in windows]
            hit |= {k + d for k in at for d in range(n)}
            found |= {str(item)} if at else set()
        want.add((i, len(w), len(hit), len(found), decontaminate.items_sha256(found), bool(hit) and 20 * len(hit) >= len(w)))
    got = {tuple(r) for r in decontaminate.digest(decontaminate.contamination(docs, bench)).collect()}
    assert got == want and any(r[5] for r in want)
    for block in (20, 10**6):
        decontaminate.BLOCK_WORDS, old = block, decontaminate.BLOCK_WORDS
        assert {tuple(r) for r in decontaminate.digest(decontaminate.contamination(docs, bench)).collect()} == want
        decontaminate.BLOCK_WORDS = old
    assert decontaminate.contamination(odd, bench).count() == 7
    assert decontaminate.contamination(empty, bench).count() == 0
    assert decontaminate.contamination(docs, bench.limit(0)).where("n_hit > 0").count() == 0


def test_removed_spans():
    text = "Say: ONE, two three! Four."
    assert decontaminate.without_spans(text, [(1, 3)]) == "Say:  three! Four."


def test_bpe(docs, rows, odd, empty):
    tokenizers = pytest.importorskip("tokenizers")
    path = queries.byte_vocabulary()
    t = tokenizers.Tokenizer.from_file(path)
    got = {r["id"]: r for r in bpe.round_trip(docs, path).collect()}
    for i, text in rows:
        ids = t.encode(text or "", add_special_tokens=False).ids
        assert got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert bpe.round_trip(odd, path).count() == 7 and bpe.round_trip(empty, path).count() == 0
    back = {r["id"]: r["text"] for r in bpe.decode(bpe.encode(docs, path), path).collect()}
    assert all(back[i] == (text or "") for i, text in rows)


def test_bpe_odd_characters():
    tokenizers = pytest.importorskip("tokenizers")
    path = queries.byte_vocabulary()
    t, b, rng = tokenizers.Tokenizer.from_file(path), bpe.Bpe(open(path, encoding="utf-8").read()), random.Random(1)
    letters = "aab  \t\n\x0b\x1c\x1f\x85\xa0 　​﻿€é日本ßﬁ٣½²Ⅷ😀1290'st're.,!<|endoftext|>"
    texts = ["", "aaaa" * 50, "<|endoftext|>", "x <|endoftext|>  y", *("".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(500))]
    for text, ids in zip(texts, b.encode_batch(texts), strict=True):
        assert ids.tolist() == t.encode(text, add_special_tokens=False).ids
        assert b.decode(ids.tolist()) == t.decode(ids.tolist(), skip_special_tokens=False)


def test_sharding(docs, rows, odd, empty):
    got = sharding.shard_rows(docs, 40).collect()
    assert len(got) == len(rows)
    text = dict(rows)
    by_shard = {}
    for r in got:
        raw = (text[r["id"]] or "").encode()
        assert (r["size"], r["text_crc32"]) == (len(raw) + 16, zlib.crc32(raw))
        assert r["grown_shard"] in (r["shard"], 40)
        by_shard.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in by_shard.values())
    found = sharding.shard_rows(odd, 2).collect()
    assert len(found) == 7 and len({(r["shard"], r["slot"]) for r in found}) == 7
    assert sharding.shard_rows(empty, 40).count() == 0


def test_jump_is_even_and_stable():
    keys = np.arange(100_000)
    a, b = sharding.jump(keys, 40), sharding.jump(keys, 41)
    assert np.bincount(a).min() > 2000 and np.bincount(a).max() < 3000
    assert ((a == b) | (b == 40)).all() and 0.015 < (a != b).mean() < 0.035

    def plain(key, shards):
        shard, after = -1, 0
        while after < shards:
            shard = after
            key = (key * sharding.LCG + 1) % 2**64
            after = int((shard + 1) * (2**31 / ((key >> 33) + 1)))
        return shard

    some = common.mix(np.arange(3000).astype(np.uint64))
    for shards in (1, 2, 40, 41, 1000):
        assert sharding.jump(some, shards).tolist() == [plain(int(k), shards) for k in some]


def test_slots_of_a_key_with_most_rows(spark):
    """Two thirds of the rows have one key or none, in equal rows."""
    docs = spark.createDataFrame([(7 if k % 3 == 0 else None if k % 3 == 1 else k, "same") for k in range(6000)], "doc_id long, text string").selectExpr("*", "1 as shard", "2 as slot", "3 as `range`")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = sharding.shard_rows(docs.repartition(5), 4).toPandas()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(got) == 6000 and got[got["id"] == 7]["shard"].nunique() == 1
    for _, part in got.groupby("shard"):
        assert sorted(part["slot"]) == list(range(len(part)))


def test_levenshtein_automaton():
    def edits(a, b):  # optimal string alignment distance
        d = [[max(i, j) if not (i and j) else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
                if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                    d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
        return d[-1][-1]

    terms = [("idiot", False), ("scum", False), ("lower", True), ("trashy", False)]
    lexicon, rng = toxicity.Lexicon(terms), random.Random(2)
    for _ in range(4000):
        word = list(rng.choice(terms)[0])
        for _ in range(rng.randint(0, 2)):
            k = rng.randrange(len(word))
            word[k : k + rng.randint(0, 2)] = rng.choice(["", "x", "o", "ti"])
            word = word or ["x"]
        word = "".join(word) + rng.choice(["", "", "s"])
        want = []
        for k, (t, stem) in enumerate(terms):
            e = min((edits(word[:j], t) for j in range(len(word) + 1)) if stem else [edits(word, t)])
            if e == 0 or e == 1 and len(t) >= toxicity.EDIT_LENGTH:
                want.append((e, k))
        assert lexicon.match(word) == (min(want) if want else None), word


def test_toxicity(spark, empty):
    rng = random.Random(4)
    rows, labels = [], []
    for k in range(1500):
        w = words(rng, 40)
        toxic = k % 5 == 0
        if toxic:
            w[rng.randrange(40)] = rng.choice(["scumbag", "morron", "vilexa" + "".join(words(rng, 1))])
        rows.append((k, " ".join(w)))
        labels.append((k, int(toxic)))
    d, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([*labels, (None, 1), (5, None)], "doc_id long, toxic int")
    model = toxicity.fit(d, lab.where("doc_id % 2 = 0"))
    got = {r["id"]: r["score"] for r in toxicity.score(d, model).collect()}
    assert sum((got[k] >= 0.5) == bool(t) for k, t in labels) >= 1470
    assert all(0 <= s <= 1 for s in got.values())
    extra = spark.createDataFrame([(1, None), (None, ""), (2, "x " * 50_000)], "doc_id long, text string")
    assert toxicity.score(extra, model).count() == 3 and toxicity.score(empty, model).count() == 0
    assert toxicity.fit(d, lab.limit(0)).score([0.0] * 8) == 0.0
    left = toxicity.drop_toxic(d, model).count()
    assert 1190 <= left <= 1230


def test_quotation_counts_as_context():
    r = toxicity.Reader([("idiot", False)])
    at = toxicity.FEATURES.index("quoted share")
    assert r.features('she said "what an idiot" aloud')[at] == 1.0
    assert r.features("what an idiot you are")[at] == 0.0
    cued = toxicity.Reader([("idiot", False)], ["reportedly"])
    assert cued.features("he was reportedly an idiot then")[at] == 1.0 and r.features("he was reportedly an idiot then")[at] == 0.0


def test_cues_are_learnt(spark):
    """Harmless texts have a term too, but after words that toxic ones don't have."""
    rng = random.Random(6)
    rows = []
    for k in range(1200):
        w = words(rng, 30)
        if k % 3 == 0:
            w[10] = "scumbag"
        elif k % 20 == 1:
            w[8:11] = ["zitiert", "als", "scumbag"]
        rows.append((k, " ".join(w), int(k % 3 == 0)))
    d = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit(d.drop("toxic"), d.where("doc_id % 4 > 0").select("doc_id", "toxic"))
    assert "zitiert" in model.cues
    got = {r["id"]: r["score"] >= 0.5 for r in toxicity.score(d, model).collect()}
    assert sum(got[k] == bool(t) for k, _, t in rows) >= 1190


def test_near_copies_do_not_make_terms(spark):
    """Forty near copies of one toxic text, and a term that toxic texts share."""
    rng = random.Random(9)
    base = [f"rare{k}" for k in range(60)]
    rows = [(k, " ".join([*base[: 10 + k % 5], f"edit{k}", *base[15:], "scumbag"]), 1) for k in range(40)]
    rows += [(100 + k, " ".join([*words(rng, 30), "scumbag"]), 1) for k in range(60)] + [(300 + k, " ".join(words(rng, 30)), 0) for k in range(400)]
    d = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit(d.drop("toxic"), d.select("doc_id", "toxic"))
    assert [t for t, _ in model.terms] == ["scumbag"] or all("scumbag".startswith(t) for t, _ in model.terms)


def test_labels_of_repeated_ids(spark):
    d = spark.createDataFrame([(1, "a b"), (1, "c d"), (None, "e"), (2, None), (2, None), (3, "x " * 60_000)], "doc_id long, text string")
    d = d.selectExpr("*", "1 as toxic", "2 as score", "3 as id")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (None, 1), (3, 0)], "doc_id long, toxic int")
    model = toxicity.fit(d, labels)
    assert toxicity.score(d, model).count() == 6 and toxicity.drop_toxic(d, model).columns == d.columns


def test_hashing_is_the_same_in_pieces(monkeypatch):
    from lodestone.llm import common

    rng = random.Random(0)
    text = " \n".join(words(rng, 500)).encode()
    whole = common.hashed_words(text)
    monkeypatch.setattr(common, "WHOLE", 100)
    for a, b in zip(whole, common.hashed_words(text), strict=True):
        assert a.tolist() == b.tolist()
