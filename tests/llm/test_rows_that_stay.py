"""Filtering stages on repeated rows, repeated ids and null ids: each row is judged for itself."""

from collections import Counter

import pytest

from lodestone.llm import decontaminate, exact_dedup, jaccard_join


@pytest.fixture(scope="module")
def frame(spark):
    return lambda rows: spark.createDataFrame([(i, t, f"s{k}") for k, (i, t) in enumerate(rows)], "doc_id long, text string, source string").repartition(3)


def pairs(df):
    return Counter((r["doc_id"], r["text"]) for r in df.collect())


def test_exact_copies(spark, frame):
    docs = frame([(None, "a b"), (None, None), (1, "a  b"), (1, "a  b"), (1, "c"), (2, "c"), (2, "c"), (None, "n"), (None, "n"), (None, "only"), (2, "alone"), (3, "x y"), (4, "x  y"), (4, "z")])
    got = exact_dedup.drop_copies(docs)
    assert got.columns == docs.columns
    assert pairs(got) == Counter([(None, None), (1, "a  b"), (1, "c"), (None, "n"), (None, "only"), (2, "alone"), (3, "x y"), (4, "z")])
    assert exact_dedup.drop_copies(docs.limit(0)).count() == 0
    named = docs.selectExpr("doc_id", "text", "source as maybe", "1 as mark", "2 as block", "3 as w0", "4 as `row`", "5 as id", "6 as gone")
    assert exact_dedup.drop_copies(named).columns == named.columns and pairs(exact_dedup.drop_copies(named)) == pairs(got)


def test_groups_cut_between_ranges(spark, frame):
    """Groups of hundreds of copies over more ranges than groups; texts that only differ far behind the splitters' prefix."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    try:
        rows = [(k, f"{'same start ' * 20}{k % 3}") for k in range(900)] + [(2000 + k, f"alone {k}") for k in range(50)]
        got = exact_dedup.exact_dedup(frame(rows)).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert all((r["keep_id"], r["group_size"], r["kept"]) == ((r["id"] % 3, 300, r["id"] < 3) if r["id"] < 900 else (r["id"], 1, True)) for r in got) and len(got) == 950


def test_contaminated_rows(spark, frame, monkeypatch):
    bad, other, clean = "k1 k2 k3 k4 k5 k6 k7 k8", "m1 m2 m3 m4 m5", "some clean words that nobody asks for"
    rows = [(None, bad), (None, clean), (None, None), (1, f"{clean} {bad}"), (1, clean), (2, other), (2, clean), (2, clean), (3, f"{bad} {other}"), (4, "")]
    docs = frame(rows)
    bench = spark.createDataFrame([(1, bad), (2, other), (3, "q r s t u v w")], "item_id long, text string")
    want = Counter(r for r in rows if "k1" not in (r[1] or "") and "m1" not in (r[1] or ""))
    for block in (5, 10**6):
        monkeypatch.setattr(decontaminate, "BLOCK_WORDS", block)
        got = decontaminate.drop_contaminated(docs, bench, size=5)
        assert got.columns == docs.columns and pairs(got) == want
    assert decontaminate.drop_contaminated(docs, bench.limit(0), size=5).count() == len(rows)
    named = docs.withColumnsRenamed({"source": "spans"}).selectExpr("*", "1 as items", "2 as id")
    assert decontaminate.drop_contaminated(named, bench, size=5).columns == named.columns
    assert pairs(decontaminate.drop_contaminated(named, bench, size=5)) == want


def test_hits_of_all_blocks_count_together(spark, frame, monkeypatch):
    """Two items hit one word in forty each: only both together are one in twenty."""
    docs = frame([(1, " ".join(["alpha", "beta", *(f"w{k}" for k in range(38))])), (1, " ".join(["alpha", *(f"w{k}" for k in range(39))]))])
    bench = spark.createDataFrame([(1, "alpha"), (2, "beta")], "item_id long, text string")
    for block in (1, 10**6):
        monkeypatch.setattr(decontaminate, "BLOCK_WORDS", block)
        assert [r["text"].split()[1] for r in decontaminate.drop_contaminated(docs, bench).collect()] == ["w0"]


def test_near_copies(spark, frame):
    def text(name, *last):
        return " ".join([f"{name}{k}" for k in range(60)] + list(last))

    a, b, c, d = text("a"), text("b"), text("c"), text("d")
    groups = [
        [(5, a), (7, text("a", "x")), (7, text("a", "y"))],
        [(1, b), (1, text("b", "x")), (1, b)],
        [(None, c), (None, text("c", "x")), (None, c)],
        [(None, d), (9, text("d", "x"))],
    ]
    alone = [(7, text("e")), (7, text("f")), (1, text("g")), (None, text("h")), (None, None), (None, None), (7, ""), (7, ""), (1, "")]
    docs = frame([r for g in groups for r in g] + alone)
    got = jaccard_join.drop_near_duplicates(docs)
    assert got.columns == docs.columns
    left = pairs(got)
    for group in groups:
        kept = [r for r in left.elements() if r in group]
        assert len(kept) == 1 and kept[0][0] == min((i for i, _ in group if i is not None), default=None)
    assert left - Counter(r for g in groups for r in g) == Counter(alone)
    assert jaccard_join.drop_near_duplicates(docs.limit(0)).count() == 0
