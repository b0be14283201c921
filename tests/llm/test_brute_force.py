"""The pipeline and the toxicity scores against plain versions in Python."""

import math
import random
import re

import numpy as np
import pytest

import corpus_pipeline
from lodestone.llm import decontaminate, jaccard_join, queries, toxicity

TOXIC = ["scumbag", "wretch", "vileness"]


def words(rng, n):
    return ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 8))) for _ in range(n)]


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """Documents with toxic terms, copies, near copies and benchmark passages, and odd rows."""
    rng = random.Random(12)
    bench = [(k, " ".join(words(rng, 25))) for k in range(12)]
    texts, labels = [], []
    for k in range(500):
        w = words(rng, rng.randint(30, 60))
        if k % 6 == 0:
            for _ in range(3):
                w[rng.randrange(len(w))] = rng.choice(TOXIC)
            labels.append((k, 0, 1))
        else:
            labels.append((k, 1, 0))
        if k % 25 == 1:
            w[4:4] = bench[k % 12][1].split()
        texts.append(" ".join(w))
    rows = list(enumerate(texts))
    for k in range(1, 60, 2):
        rows.append((1000 + k, texts[k].replace(" ", "  ", 3)))
        edited = texts[k].split()
        edited[rng.randrange(len(edited))] = "edited"
        rows.append((2000 + k, " ".join(edited)))
    rows += [(3000, None), (3001, ""), (3002, " \n"), (None, texts[7]), (None, None), (7, texts[7]), (3003, "One two three")]
    at = tmp_path_factory.mktemp("corpus")
    frames = {
        "documents": spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long"),
        "labels": spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), "benchmark": spark.createDataFrame([*bench, (90, None), (None, "x y")], "item_id long, text string"),
    }
    for name, df in frames.items():
        df.repartition(3).write.parquet(f"{at}/{name}.parquet")
    return str(at), rows, bench


def contaminated(text, bench, size=13):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    windows = set()
    for _, t in bench:
        w = split(t)
        n = min(size, len(w))
        windows |= {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()
    w, hit = split(text), set()
    for n in {len(x) for x in windows}:
        for i in range(len(w) - n + 1):
            if tuple(w[i : i + n]) in windows:
                hit |= set(range(i, i + n))
    return len(hit) > 0 and 20 * len(hit) >= len(w)


def test_pipeline(spark, corpus):
    from tokenizers import Tokenizer

    at, rows, bench = corpus
    toxic = lambda t: any(x in TOXIC for x in (t or "").split())
    kept = [(i, t) for i, t in rows if not toxic(t)]
    order = lambda r: (r[0] is None, r[0] or 0)
    groups = {}
    for r in sorted(kept, key=order):
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", r[1] or ""), r)
    kept = list(groups.values())
    none = 10**9
    found = jaccard_join.brute_force([(none if i is None else i, t) for i, t in kept])
    first = {}
    for r, (i, n, component) in sorted(zip(kept, found, strict=True), key=lambda x: order(x[0])):
        first.setdefault(("alone", id(r)) if not n else component, r)
    kept = [r for r in first.values() if not contaminated(r[1], bench)]
    encode = Tokenizer.from_file(queries.byte_vocabulary())
    encode.no_truncation()
    encode.no_padding()
    want = sorted((-1 if i is None else i, len(encode.encode(t or "", add_special_tokens=False).ids)) for i, t in kept)
    got = sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_tokens"]) for r in corpus_pipeline.run(spark, at).collect())
    assert got == want and 300 < len(want) < len(rows) - 100


def test_decontamination_of_the_query(spark, corpus):
    at, rows, bench = corpus
    got = {(r["doc_id"], r["n_words"]): r["contaminated"] for r in queries.op7_decontamination(spark, at).collect()}
    for i, t in rows:
        assert got[i, len(decontaminate.words(t))] == contaminated(t, bench)


def edits(a, b):
    """Optimal string alignment distance."""
    d = [[max(i, j) if not (i and j) else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


def test_toxicity_scores(spark, corpus):
    """Each score of the query from the model's terms by edit distances, windows and the logistic formula written out."""
    at, rows, _ = corpus
    model = queries.toxicity_model(spark, queries.table(spark, at, "documents"), at)
    assert {t for t, _ in model.terms} and all(any(x.startswith(t) for x in TOXIC) for t, _ in model.terms)

    def best(word):
        found = []
        for k, (t, stem) in enumerate(model.terms):
            e = min(edits(word[:j], t) for j in range(len(word) + 1)) if stem else edits(word, t)
            if e == 0 or e == 1 and len(t) >= toxicity.EDIT_LENGTH:
                found.append((e, k))
        return min(found, default=None)

    memory = {}

    def plain(text):
        w = re.findall(r"\w+", (text or "").lower())
        hits = [(i, memory[x]) for i, x in enumerate(w) if memory.setdefault(x, best(x)) is not None]
        count = lambda e, stem: sum(h[0] == e and model.terms[h[1]][1] == stem for _, h in hits)
        exact = [(i, h[1]) for i, h in hits if h[0] == 0]
        x = [math.log1p(count(e, s)) for e, s in ((0, False), (0, True), (1, False), (1, True))]
        if exact:
            x += [math.log(max(sum(i <= j <= i + toxicity.WINDOW for j, _ in exact) for i, _ in exact)), len(exact) / len(w), 0.0, math.log(len({t for _, t in exact}))]
        else:
            x += [0.0] * 4
        return 1 / (1 + math.exp(-max(-30, min(30, model.weights[0] + float(np.dot(model.weights[1:], x))))))

    some = [(i, t) for i, t in rows if i is None or i % 7 == 0 or i >= 3000]
    got = {}
    for r in queries.op6_toxicity(spark, at).collect():
        got.setdefault(r["doc_id"], []).append(r["score"])
    for i, t in some:
        assert any(s == pytest.approx(plain(t), abs=1e-9) for s in got[i])
    toxic = {i for i, t in rows if any(x in TOXIC for x in (t or "").split())}
    assert all((s >= 0.5) == (i in toxic) for i, scores in got.items() for s in scores)
