"""The pipeline on the smallest tables: what each stage does follows from its operator, and what isn't touched stays."""

from pyspark.sql import functions as F

import corpus_pipeline
from lodestone.llm import common, decontaminate, exact_dedup, jaccard_join, queries, toxicity

SF = "/root/testdata/sf0.001"


def test_stages_keep_the_columns_and_the_rest(spark):
    docs = queries.table(spark, SF, "documents")
    columns = docs.columns
    model = queries.toxicity_model(spark, docs, SF)
    checks = [
        lambda d: toxicity.score(d, model).where("score < 0.5").select("id"),
        lambda d: exact_dedup.exact_dedup(d).where("kept").select("id"),
        lambda d: jaccard_join.near_duplicates(d).groupBy("component_id").agg(F.min("id").alias("id")).select("id"),
        lambda d: decontaminate.digest(decontaminate.contamination(d, queries.table(spark, SF, "benchmark"))).where("not contaminated").select("id"),
    ]
    for (_, stage), check in zip(corpus_pipeline.STAGES[:-1], checks, strict=True):
        want = {r[0] for r in check(docs).collect()}
        docs = common.materialize(stage(spark, docs, SF))
        assert docs.columns == columns
        assert {r[0] for r in docs.select("doc_id").collect()} == want
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert last.count() == docs.count()
    whole = {tuple(r) for r in corpus_pipeline.run(spark, SF).collect()}
    assert whole == {tuple(r) for r in last.collect()}


def test_stages_on_clashing_columns_and_empty_tables(spark):
    """Columns that are named like the operators' own stay, and an empty table gives an empty one."""
    docs = queries.table(spark, SF, "documents")
    odd = docs.limit(40).union(docs.limit(5)).union(spark.createDataFrame([(None, None, None, None, None), (None, "a b", None, "s", 3)], docs.schema))
    extra = ["id", "row", "node", "maybe", "mark", "spans", "sha", "block", "w0", "key", "toxic", "score", "n", "gone", "label", "region"]
    named = odd.selectExpr("*", *[f"{k} as `{c}`" for k, c in enumerate(extra)])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, named, SF)
        assert got.columns == named.columns, name
        assert 0 < got.count() <= named.count()
        assert got.select(*extra).distinct().collect() == named.select(*extra).distinct().collect()
        assert stage(spark, named.where("doc_id < 0"), SF).count() == 0
    last = corpus_pipeline.STAGES[-1][1]
    assert last(spark, named, SF).count() == named.count() and last(spark, named.where("doc_id < 0"), SF).count() == 0
