"""Queries of evidence synthesis over the driver's tables, with their SQL.

A study is a supplier: n is the number of its lines, p the share of returned ones, its group the region.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import extraction
from ..operators import evidence as E
from .tables import table


def studies(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("study")).agg(F.count("*").alias("n"), F.avg((F.col("l_returnflag") == "R").cast("double")).alias("p"))
    supplier, nation, region = (table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    keyed = s.join(supplier, s["study"] == supplier["s_suppkey"]).join(F.broadcast(nation), F.col("s_nationkey") == F.col("n_nationkey")).join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey"))
    return keyed.select("study", "n", "p", F.col("r_name").alias("grp"))


def ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ratio with an interval for each supplier: mean price of returned over other lines, with a spread from the counts."""
    li = table(spark, sf_dir, "lineitem")
    a, b = F.avg(F.when(F.col("l_returnflag") == "R", F.col("l_extendedprice"))), F.avg(F.when(F.col("l_returnflag") != "R", F.col("l_extendedprice")))
    r = li.groupBy(F.col("l_suppkey").alias("study")).agg((a / b).alias("hr"), F.count("*").alias("n")).where("hr > 0")
    return r.select("study", "hr", (F.col("hr") * F.exp(-2 / F.sqrt("n"))).alias("lo"), (F.col("hr") * F.exp(2 / F.sqrt("n"))).alias("hi"))


def rounded(df: DataFrame, digits: int = 8) -> DataFrame:
    """Doubles rounded, as the order of summation differs between runs."""
    return df.select(*[(F.round(c, digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def pooled_by_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = E.pool(E.proportion_effects(studies(spark, sf_dir)), ["grp"])
    return rounded(out.select("grp", "k", "q", "df", "i2", "tau2", "fixed", "fixed_lo", "fixed_hi", "random", "random_lo", "random_hi"))


def pooled_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = E.pool(E.proportion_effects(studies(spark, sf_dir)))
    return rounded(out.select("k", "q", "i2", "tau2", "fixed", "random", "random_lo", "random_hi"))


def heterogeneity_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = E.pool(E.proportion_effects(studies(spark, sf_dir)), ["grp"])
    return rounded(out.select("grp", "df", "p_heterogeneity"), 6)


def pooled_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = E.with_z_test(E.pool(E.ratio_effects(ratios(spark, sf_dir)), back="ratio"))
    return rounded(out.select("k", "q", "i2", "tau2", F.col("random").alias("hr"), F.col("random_lo").alias("hr_lo"), F.col("random_hi").alias("hr_hi"), "z"))


def weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = E.study_weights(E.proportion_effects(studies(spark, sf_dir)), ["grp"])
    return rounded(out.select("study", "grp", "weight_fixed", "weight_random", "ci_lower", "ci_upper"))


def without_each(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = E.leave_one_out(E.proportion_effects(studies(spark, sf_dir)), "study", ["grp"])
    return rounded(out.select("grp", "study", "k_remaining", "pooled", "i2"), 6)


def egger(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = E.egger(E.proportion_effects(studies(spark, sf_dir)), ["grp"])
    return rounded(out.select("grp", "n_studies", "slope", "intercept", "intercept_se", "true_intercept_se", "t_stat", "p_value", "bias_detected"), 5)


def begg(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = E.begg(E.proportion_effects(studies(spark, sf_dir)), ["grp"])
    return rounded(out.select("grp", "s", "n_studies", "tau", "p_value", "bias_detected"), 7)


def subgroup_pooling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers pooled for each word of the types of the parts that they sold most of."""
    li = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey")).groupBy(F.col("l_suppkey").alias("study"), "p_brand").agg(F.count("*").alias("c"))
    best = li.groupBy("study").agg(F.max_by("p_brand", F.struct("c", "p_brand")).alias("brand"))
    tagged = studies(spark, sf_dir).join(best, "study").withColumn("tags", F.concat(F.col("brand"), F.lit("; "), F.col("grp"), F.lit("; Unspecified")))
    return rounded(E.subgroups(tagged, "tags").select("subgroup", "k", "q", "i2", "random"), 7)


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The study table of abstracts that tell figures of orders; each figure must be found again."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    pct, size, months = F.round(F.pmod(k * 37, F.lit(1000)) / 10.0, 1), F.pmod(k * 13, F.lit(900)) + 20, F.round(F.pmod(k * 7, F.lit(300)) / 10.0 + 1, 1)
    ratio = F.round(F.pmod(k * 11, F.lit(80)) / 100.0 + 0.4, 2)
    text = F.when(k % 3 == 0, F.format_string("In this randomized phase III trial of rituximab, %d patients were enrolled. The overall response rate was %.1f%%. Nausea was seen.", size, pct)).when(
        k % 3 == 1, F.format_string("A retrospective cohort of %d patients with follicular lymphoma. Median progression-free survival was %.1f months. Placebo was the comparator.", size, months)
    ).otherwise(F.format_string("Overall survival was better with CAR-T (HR = %.2f (95%% CI %.2f-%.2f)); complete response in some. n = %d.", ratio, ratio - 0.2, ratio + 0.3, size))
    t = extraction.study_table(o.select(k.alias("id"), F.lit("T").alias("title"), text.alias("abstract")))
    return t.select("id", "sample_size", F.round("orr", 4).alias("orr"), "pfs_median", "hr_os", "hr_os_ci_lower", "hr_os_ci_upper", "subtypes", "drugs", "study_type", "adverse_events", "is_rct", "has_randomization", "has_control_group")


def funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(E.funnel(E.proportion_effects(studies(spark, sf_dir))).select("study", "t", "se"))


def describe_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(E.describe(table(spark, sf_dir, "lineitem"), "l_extendedprice", ["l_returnflag"]), 4)


def type_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.value_counts(table(spark, sf_dir, "part"), "p_type", " ")


def heat_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select("p_partkey", F.explode(F.split("p_type", " ")).alias("word"))
    rows = table(spark, sf_dir, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey"))
    rows = rows.select("word", (F.col("l_returnflag") == "R").cast("double").alias("returned"), (F.col("l_linestatus") == "O").cast("double").alias("open"))
    return rounded(E.heat_map(rows, "word", ["returned", "open"], "returned"), 4)


def order_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(F.year("o_orderdate").cast("long").alias("year"))
    return rounded(E.year_trend(orders, "year"), 4)


QUERIES = {
    "pooled_proportion_by_group": pooled_by_region, "pooled_proportion": pooled_all, "heterogeneity_p": heterogeneity_p, "pooled_hazard_ratio": pooled_ratio,
    "study_weights": weights, "leave_one_out": without_each, "subgroup_pooling": subgroup_pooling, "study_facts": facts, "egger_test": egger, "begg_test": begg, "funnel_data": funnel,
    "descriptive_statistics": describe_prices, "value_counts": type_counts, "outcome_heat_map": heat_map, "year_trend": order_years,
}

_STUDIES = """s AS (SELECT l_suppkey AS study, count(*) AS n, avg(CASE WHEN l_returnflag = 'R' THEN 1.0e0 ELSE 0.0e0 END) AS p FROM lineitem GROUP BY l_suppkey),
    e AS (SELECT study, n, p, r_name AS grp, 1.0e0 / (n + 1) AS v,
            asin(sqrt(least(greatest(p * n / (n + 1), 0.0e0), 1.0e0))) + asin(sqrt(least(greatest((p * n + 1) / (n + 1), 0.0e0), 1.0e0))) AS t
          FROM s JOIN supplier ON study = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
_POOL = """m AS (SELECT {g} AS g, count(*) AS k, sum(1 / v) AS w1, sum(1 / (v * v)) AS w2, sum(t / v) / sum(1 / v) AS tf FROM e GROUP BY 1),
    h AS (SELECT m.g AS g, any_value(k) AS k, any_value(w1) AS w1, any_value(w2) AS w2, any_value(tf) AS tf, sum((t - tf) * (t - tf) / v) AS q FROM e JOIN m ON {g} = m.g GROUP BY m.g),
    x AS (SELECT *, CASE WHEN q > k - 1 AND k > 1 THEN (q - k + 1) / q * 100 ELSE 0.0e0 END AS i2, CASE WHEN k > 1 THEN greatest(0.0e0, (q - k + 1) / (w1 - w2 / w1)) ELSE 0.0e0 END AS tau2 FROM h),
    r AS (SELECT x.g AS g, sum(1 / (v + tau2)) AS wr, sum(t / (v + tau2)) / sum(1 / (v + tau2)) AS tr FROM e JOIN x ON {g} = x.g GROUP BY x.g)"""
_BACK = "pow(sin(({0}) / 2), 2)"


def _r(sql: str, name: str, digits: int = 8) -> str:
    return f"round({sql}, {digits}) + 0.0e0 AS {name}"


_B = lambda s: _BACK.format(s)
_BASE = f"WITH {_STUDIES}, {_POOL.format(g='grp')}"
_ALL = f"WITH {_STUDIES}, {_POOL.format(g='1')}".replace("ON 1 = m.g", "ON m.g = 1").replace("ON 1 = x.g", "ON x.g = 1")
_SF, _SR = "1.96e0 * sqrt(1 / w1)", "1.96e0 * sqrt(1 / wr)"



def _integral(density: str, upper: str, steps: int = 1000) -> str:
    """Simpson's rule from 0 to `upper` for a density of {x}."""
    at = f"(i * ({upper}) / {steps}.0e0)"
    return f"({upper}) / {3 * steps}.0e0 * list_sum(list_transform(range({steps + 1}), lambda i: (CASE WHEN i = 0 OR i = {steps} THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * {density.format(x=at)}))"


def _t_p(t: str, df: str) -> str:
    inner = _integral(f"pow(1 + pow({{x}}, 2) / ({df}), -(({df}) + 1) / 2.0e0)", f"abs({t})")
    return f"greatest(0, 1 - 2 * {inner} * exp(lgamma((({df}) + 1) / 2.0e0) - lgamma(({df}) / 2.0e0)) / sqrt(({df}) * pi()))"


def _normal_p(z: str) -> str:
    return f"greatest(0, 1 - 2 * {_integral('exp(-pow({x}, 2) / 2)', f'abs({z})')} / sqrt(2 * pi()))"


def _chi2_p(q: str, df: str) -> str:
    """One less the series of the incomplete gamma function."""
    return f"CASE WHEN ({q}) <= 0 OR ({df}) = 0 THEN 1.0e0 ELSE greatest(0, 1 - list_sum(list_transform(range(2000), lambda i: exp((({df}) / 2.0e0 + i) * ln(({q}) / 2) - ({q}) / 2 - lgamma(({df}) / 2.0e0 + i + 1))))) END"


def _ties(v: str, name: str) -> str:
    return f"{name} AS (SELECT grp, sum(c * (c - 1) / 2) AS {name}0, sum(c * (c - 1) * (c - 2)) AS {name}1, sum(c * (c - 1) * (2 * c + 5)) AS {name}2 FROM (SELECT grp, {v}, count(*) AS c FROM a GROUP BY ALL) GROUP BY grp)"


_FACTS = """o AS (SELECT o_orderkey AS id, o_orderkey % 3 AS kind, round(o_orderkey * 37 % 1000 / 10.0e0, 1) AS pct, o_orderkey * 13 % 900 + 20 AS size, round(o_orderkey * 7 % 300 / 10.0e0 + 1, 1) AS months, round(o_orderkey * 11 % 80 / 100.0e0 + 0.4e0, 2) AS ratio FROM orders)"""
ORACLE_SQL = {
    "pooled_proportion_by_group": f"""{_BASE} SELECT x.g AS grp, k, {_r('q', 'q')}, k - 1 AS df, {_r('i2', 'i2')}, {_r('tau2', 'tau2')}, {_r(_B('tf'), 'fixed')}, {_r(_B(f'tf - {_SF}'), 'fixed_lo')}, {_r(_B(f'tf + {_SF}'), 'fixed_hi')},
        {_r(_B('tr'), '"random"')}, {_r(_B(f'tr - {_SR}'), 'random_lo')}, {_r(_B(f'tr + {_SR}'), 'random_hi')} FROM x JOIN r ON x.g = r.g""",
    "pooled_proportion": f"""{_ALL} SELECT k, {_r('q', 'q')}, {_r('i2', 'i2')}, {_r('tau2', 'tau2')}, {_r(_B('tf'), 'fixed')}, {_r(_B('tr'), '"random"')}, {_r(_B(f'tr - {_SR}'), 'random_lo')}, {_r(_B(f'tr + {_SR}'), 'random_hi')} FROM x JOIN r ON x.g = r.g""",
    "pooled_hazard_ratio": f"""WITH s AS (SELECT l_suppkey AS study, avg(CASE WHEN l_returnflag = 'R' THEN l_extendedprice END) / avg(CASE WHEN l_returnflag <> 'R' THEN l_extendedprice END) AS hr, count(*) AS n FROM lineitem GROUP BY l_suppkey),
        c AS (SELECT hr, hr * exp(-2 / sqrt(n)) AS lo, hr * exp(2 / sqrt(n)) AS hi FROM s WHERE hr > 0),
        e AS (SELECT ln(hr) AS t, pow(greatest((ln(hi) - ln(lo)) / 3.92e0, 1e-6), 2) AS v FROM c), {_POOL.format(g='1').replace('ON 1 = m.g', 'ON m.g = 1').replace('ON 1 = x.g', 'ON x.g = 1')}
        SELECT k, {_r('q', 'q')}, {_r('i2', 'i2')}, {_r('tau2', 'tau2')}, {_r('exp(tr)', 'hr')}, {_r(f'exp(tr - {_SR})', 'hr_lo')}, {_r(f'exp(tr + {_SR})', 'hr_hi')}, {_r('tr / sqrt(1 / wr)', 'z')} FROM x JOIN r ON x.g = r.g""",
    "study_weights": f"""{_BASE} SELECT study, grp, {_r('1 / v / w1 * 100', 'weight_fixed')}, {_r('1 / (v + tau2) / wr * 100', 'weight_random')}, {_r(_B('t - 1.96e0 * sqrt(v)'), 'ci_lower')}, {_r(_B('t + 1.96e0 * sqrt(v)'), 'ci_upper')} FROM e JOIN x ON grp = x.g JOIN r ON grp = r.g""",
    "leave_one_out": f"""WITH {_STUDIES}, o AS (SELECT a.grp AS grp, a.study AS study, b.t AS t, b.v AS v FROM e a JOIN e b ON a.grp = b.grp AND a.study <> b.study),
        m AS (SELECT grp, study, count(*) AS k, sum(1 / v) AS w1, sum(1 / (v * v)) AS w2, sum(t / v) / sum(1 / v) AS tf FROM o GROUP BY grp, study),
        x AS (SELECT grp, study, any_value(k) AS k, any_value(w1) AS w1, any_value(w2) AS w2, sum((t - tf) * (t - tf) / v) AS q FROM o JOIN m USING (grp, study) GROUP BY grp, study),
        y AS (SELECT *, CASE WHEN q > k - 1 AND k > 1 THEN (q - k + 1) / q * 100 ELSE 0.0e0 END AS i2, greatest(0.0e0, (q - k + 1) / (w1 - w2 / w1)) AS tau2 FROM x WHERE k >= 2),
        z AS (SELECT grp, study, any_value(k) AS k, any_value(i2) AS i2, sum(t / (v + tau2)) / sum(1 / (v + tau2)) AS tr FROM o JOIN y USING (grp, study) GROUP BY grp, study)
        SELECT grp, study, k AS k_remaining, {_r(_B('tr'), 'pooled', 6)}, {_r('i2', 'i2', 6)} FROM z""",
    "egger_test": f"""WITH {_STUDIES}, a AS (SELECT grp, t / sqrt(v) AS y, 1 / sqrt(v) AS x FROM e),
        b AS (SELECT grp, count(*) AS n, regr_slope(y, x) AS slope, regr_intercept(y, x) AS intercept, regr_sxx(y, x) AS sxx, regr_syy(y, x) AS syy, regr_sxy(y, x) AS sxy, avg(x) AS mx FROM a GROUP BY grp),
        c AS (SELECT *, sqrt((syy - sxy * sxy / sxx) / (n - 2) / sxx) AS se FROM b WHERE n >= 3), d AS (SELECT *, CASE WHEN se > 0 THEN intercept / se ELSE 0.0e0 END AS t FROM c), p AS (SELECT *, {_t_p('t', 'n - 2')} AS p FROM d)
        SELECT grp, n AS n_studies, {_r('slope', 'slope', 5)}, {_r('intercept', 'intercept', 5)}, {_r('se', 'intercept_se', 5)}, {_r('se * sqrt(sxx / n + mx * mx)', 'true_intercept_se', 5)}, {_r('t', 't_stat', 5)}, {_r('p', 'p_value', 5)}, p < 0.1 AS bias_detected FROM p""",
    "begg_test": f"""WITH RECURSIVE {_STUDIES}, a AS (SELECT grp, study, t / sqrt(v) AS x, v AS y FROM e),
        sg AS (SELECT a.grp AS grp, CAST(sum(sign(a.x - b.x) * sign(a.y - b.y)) AS DOUBLE) AS s FROM a JOIN a b ON a.grp = b.grp AND a.study < b.study GROUP BY a.grp),
        {_ties('x', 'tx')}, {_ties('y', 'ty')}, n AS (SELECT grp, count(*) AS n FROM a GROUP BY grp HAVING count(*) >= 4),
        f AS (SELECT 1 AS n, [1.0e0] AS c UNION ALL SELECT n + 1 AS n, list_transform(range(len(c) + n), lambda k: list_sum(c[greatest(1, k - n + 1):least(len(c), k + 1)]) / (n + 1)) AS c FROM f WHERE n < 33),
        j AS (SELECT *, n * (n - 1) / 2 AS pairs FROM sg JOIN n USING (grp) JOIN tx USING (grp) JOIN ty USING (grp)),
        z AS (SELECT j.*, f.c AS c, s / sqrt((pairs - tx0) * (pairs - ty0)) AS tau, s / sqrt((n * (n - 1) * (2 * n + 5) - tx2 - ty2) / 18 + 2 * tx0 * ty0 / (n * (n - 1)) + tx1 * ty1 / (9 * n * (n - 1) * (n - 2))) AS z FROM j LEFT JOIN f USING (n)),
        p AS (SELECT *, CASE WHEN tx0 = 0 AND ty0 = 0 AND n <= 33 THEN CASE WHEN s = 0 THEN 1 ELSE least(1, 2 * list_sum(c[1:CAST((pairs - abs(s)) / 2 AS BIGINT) + 1])) END ELSE {_normal_p('z')} END AS p FROM z)
        SELECT grp, s, n AS n_studies, {_r('tau', 'tau', 7)}, {_r('p', 'p_value', 7)}, p < 0.1 AS bias_detected FROM p""",
    "heterogeneity_p": f"{_BASE} SELECT g AS grp, k - 1 AS df, {_r(_chi2_p('q', 'k - 1'), 'p_heterogeneity', 6)} FROM x",
    "subgroup_pooling": f"""WITH {_STUDIES.replace('e AS (', 'e0 AS (')}, b AS (SELECT l_suppkey AS study, p_brand, count(*) AS c FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2),
        t AS (SELECT study, p_brand FROM b QUALIFY row_number() OVER (PARTITION BY study ORDER BY c DESC, p_brand DESC) = 1),
        e AS (SELECT study, n, p, p_brand AS grp, v, t FROM e0 JOIN t AS tags USING (study) UNION ALL SELECT study, n, p, grp, v, t FROM e0), {_POOL.format(g='grp')}
        SELECT x.g AS subgroup, k, {_r('q', 'q', 7)}, {_r('i2', 'i2', 7)}, {_r(_B('tr'), '"random"', 7)} FROM x JOIN r ON x.g = r.g""",
    "study_facts": f"""WITH {_FACTS} SELECT id, size AS sample_size, CASE kind WHEN 0 THEN round(pct / 100, 4) END AS orr, CASE kind WHEN 1 THEN months END AS pfs_median,
        CASE kind WHEN 2 THEN ratio END AS hr_os, CASE kind WHEN 2 THEN round(ratio - 0.2e0, 2) END AS hr_os_ci_lower, CASE kind WHEN 2 THEN round(ratio + 0.3e0, 2) END AS hr_os_ci_upper,
        CASE kind WHEN 1 THEN 'FL' ELSE 'Unspecified' END AS subtypes, CASE kind WHEN 0 THEN 'Rituximab' WHEN 2 THEN 'CAR-T' ELSE 'Unspecified' END AS drugs, CASE kind WHEN 0 THEN 'RCT; Phase III' WHEN 1 THEN 'Retrospective' ELSE 'Unknown' END AS study_type,
        CASE kind WHEN 0 THEN 'Nausea' ELSE 'Not reported' END AS adverse_events, kind = 0 AS is_rct, kind = 0 AS has_randomization, kind = 1 AS has_control_group FROM o""",
    "funnel_data": f"WITH {_STUDIES} SELECT study, {_r('t', 't')}, {_r('sqrt(v)', 'se')} FROM e",
    "descriptive_statistics": f"SELECT l_returnflag, count(*) AS n, {_r('median(l_extendedprice)', 'median', 4)}, {_r('avg(l_extendedprice)', 'mean', 4)}, {_r('min(l_extendedprice)', 'min', 4)}, {_r('max(l_extendedprice)', 'max', 4)}, {_r('sum(l_extendedprice)', 'sum', 4)} FROM lineitem GROUP BY l_returnflag",
    "value_counts": "SELECT trim(x) AS value, count(*) AS n FROM (SELECT unnest(string_split(p_type, ' ')) AS x FROM part) WHERE trim(x) <> '' GROUP BY 1",
    "outcome_heat_map": """WITH w AS (SELECT p_partkey, unnest(string_split(p_type, ' ')) AS word FROM part),
        m AS (SELECT word, avg(CASE WHEN l_returnflag = 'R' THEN 1.0e0 ELSE 0.0e0 END) AS a, avg(CASE WHEN l_linestatus = 'O' THEN 1.0e0 ELSE 0.0e0 END) AS b FROM lineitem JOIN w ON l_partkey = p_partkey GROUP BY word)
        SELECT word, round(round_even(a, 1) * 100, 4) + 0.0e0 AS returned, round(round_even(b, 1) * 100, 4) + 0.0e0 AS open FROM m""",
    "year_trend": f"""WITH c AS (SELECT CAST(year(o_orderdate) AS BIGINT) AS year, count(*) AS n FROM orders GROUP BY 1),
        l AS (SELECT regr_slope(n, year) AS slope, regr_intercept(n, year) AS intercept, count(*) AS k FROM c)
        SELECT year, n, {_r('slope', 'slope', 4)}, {_r('intercept', 'intercept', 4)}, {_r('CASE WHEN k > 2 THEN slope * year + intercept END', 'trend', 4)} FROM c, l""",
}
