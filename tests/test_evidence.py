"""Pooling, bias tests and text extraction on fixtures with known results."""

import math
import random

import pytest
from pyspark.sql import functions as F

from lodestone.functions import distributions, extraction, lexicon
from lodestone.operators import evidence as E

GOLD = [(0.95, 488), (0.286, 20), (0.95, 199), (0.55, 488), (1.0, 34), (0.783, 44), (0.68, 62)]


@pytest.fixture(scope="module")
def effects(spark):
    return E.proportion_effects(spark.createDataFrame([(k, p, n) for k, (p, n) in enumerate(GOLD)], "study int, p double, n int"))


def test_pooled(effects):
    r = E.pool(effects).first()
    want = {"k": 7, "fixed": 0.8124236834296527, "fixed_lo": 0.7911003502744071, "fixed_hi": 0.832852888014906, "random": 0.7896414947470057, "random_lo": 0.5822252339004215, "random_hi": 0.9387194370577534, "q": 344.57003917617686, "df": 6, "i2": 98.25869944631714, "tau2": 0.3563442346916693}
    assert {k: r[k] for k in want} == pytest.approx(want, rel=1e-9)
    assert r["p_heterogeneity"] < 1e-60


def test_leave_one_out(effects):
    got = [r["pooled"] for r in E.leave_one_out(effects, "study").orderBy("study").collect()]
    assert got == pytest.approx([0.7530324849, 0.8500851978, 0.7534816590, 0.8311266718, 0.7361872044, 0.7914585411, 0.8065123832], abs=1e-9)
    assert E.leave_one_out(effects.limit(2), "study").count() == 0


def test_bias(effects):
    r = E.egger(effects).first()
    assert (r["intercept"], r["intercept_se"], r["p_value"]) == pytest.approx((-0.34429753020516785, 0.44637228467768003, 0.47536801797194683), rel=1e-6)
    assert r["true_intercept_se"] == pytest.approx(6.1805, abs=1e-4)
    begg = E.begg(effects).first()
    assert (begg["tau"], begg["p_value"], begg["bias_detected"]) == (pytest.approx(-0.6831300510639733), pytest.approx(0.03344063866399787), True)
    egger = E.egger(effects).first()
    assert (egger["p_value"], egger["bias_detected"]) == (pytest.approx(0.47536801797194683), False)


def test_tails():
    assert distributions.chi2_tail(3.841458820694124, 1) == pytest.approx(0.05, rel=1e-9)
    assert distributions.chi2_tail(18.307038053275146, 10) == pytest.approx(0.05, rel=1e-9)
    assert distributions.t_two_sided(2.2281388519649385, 10) == pytest.approx(0.05, rel=1e-9)
    assert distributions.normal_two_sided(1.959963984540054) == pytest.approx(0.05, rel=1e-9)


def test_ratio_pooling(spark):
    rows = spark.createDataFrame([(0.65, 0.5, 0.85), (0.8, 0.6, 1.05), (0.7, 0.7, 0.7)], "hr double, lo double, hi double")
    r = E.with_z_test(E.pool(E.ratio_effects(rows), back="ratio")).first()
    assert r["k"] == 3 and 0.64 < r["random"] < 0.76 and r["p_value"] < 0.01


def test_study_table(spark):
    texts = [
        "Of 120 patients enrolled with DLBCL, the overall response rate was 72.3% (95% CI 60.1-84.5). Median progression-free survival was 12.3 months.",
        "A randomized phase III trial: PFS improved (HR = 0.65 (95% CI 0.50-0.85)). n = 42. Neutropenia and rash were common.",
        "Complete response rate of 55% (95% CI 45-65) with rituximab and CHOP; overall survival not reached.", "", None,
    ]
    table = extraction.study_table(spark.createDataFrame([(k, "T", t) for k, t in enumerate(texts)], "id int, title string, abstract string"))
    got = table.orderBy("id").collect()
    assert len(got) == 3
    a, b, c = got
    assert (a["subtypes"], a["sample_size"], a["orr"], a["pfs_median"]) == ("DLBCL", 120, 0.723, 12.3)
    assert (b["hr_pfs"], b["hr_pfs_ci_lower"], b["hr_pfs_ci_upper"], b["sample_size"], b["is_rct"], b["adverse_events"]) == (0.65, 0.5, 0.85, 42, True, "Neutropenia; Skin")
    assert c["drugs"] == "Rituximab; CHOP" and c["cr_rate"] == 0.55 and c["sample_size"] == round(1.96**2 * 0.55 * 0.45 / 0.1**2)
    assert extraction.has_efficacy(table).count() == 3
    assert len(lexicon.THERAPIES) == 21


def test_descriptions(spark):
    rows = spark.createDataFrame([("a; b", "1"), ("b", "x"), ("", "3"), (None, None)], "tags string, n string")
    assert [tuple(r) for r in E.value_counts(rows, "tags", ";").collect()] == [("b", 2), ("a", 1)]
    assert tuple(E.describe(rows, "n").first()) == (2, 2.0, 2.0, 1.0, 3.0, 4.0)
    grouped = E.explode_groups(spark.createDataFrame([("A; Unspecified; B",)], "g string"), "g", "one")
    assert [r["one"] for r in grouped.orderBy("one").collect()] == ["A", "B"]


def test_single_group_without_spread(spark):
    one = E.proportion_effects(spark.createDataFrame([(0, 0.5, 10)], "study int, p double, n int"))
    r = E.pool(one).first()
    assert (r["i2"], r["tau2"], r["p_heterogeneity"]) == (0.0, 0.0, 1.0) and r["fixed"] == r["random"]
    assert one.select(F.round("v", 6)).first()[0] == 0.090909


def test_kendall_counts_as_all_pairs_do(spark):
    rng = random.Random(3)
    rows = [(g, k, float(rng.randint(0, 30 if g else 10_000)), float(rng.randint(0, 20 if g else 10_000))) for g in range(3) for k in range(12 if g < 2 else 70)]
    got = {r["g"]: r for r in E.kendall_tau(spark.createDataFrame([*rows, (1, 99, None, 1.0)], "g int, study int, x double, y double"), F.col("x"), F.col("y"), ["g"]).collect()}
    for g in range(3):
        p = [(x, y) for h, _, x, y in rows if h == g]
        sign = [((a > c) - (a < c), (b > d) - (b < d)) for i, (a, b) in enumerate(p) for c, d in p[:i]]
        s, nx, ny = sum(u * v for u, v in sign), sum(u * u for u, _ in sign), sum(v * v for _, v in sign)
        assert (got[g]["s"], got[g]["n_studies"]) == (s, len(p)) and got[g]["tau"] == pytest.approx(s / math.sqrt(nx * ny))
        assert 0 <= got[g]["p_value"] <= 1
    # four ranks: 1, 4, 9, 15 and 20 of 24 orders have at most 0 .. 4 discordant pairs
    assert [distributions.kendall_two_sided(s, 4, (0, 0, 0), (0, 0, 0)) for s in (6, 4, 2, 0)] == pytest.approx([2 / 24, 8 / 24, 18 / 24, 1])


@pytest.mark.parametrize("text, want", [
    ("ORR 50%. " + "x " * 100 + "The response rate was 80% and 85% ORR", 50.0), ("the response rate of 33% (95% CI 20-40), so ORR was 44 %", 44.0),
    ("ORR was 120%", None), ("Overall response rate was good", None), ("", None), ("12% CR, 34.5% ORR", 34.5),
])
def test_nearest_percentage(spark, text, want):
    got = spark.createDataFrame([(text,)], "t string").select(extraction.nearest_percentage(F.col("t"), lexicon.OUTCOMES["ORR"])).first()[0]
    assert got == want
