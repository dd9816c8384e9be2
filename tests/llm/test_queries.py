import pytest
from conftest import SMALL
from oracle import same

from verbascope.llm.queries import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, name):
    same(spark, SMALL, QUERIES[name], SQL[name])


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - SQL.keys()))
def test_runs(spark, name):
    df = QUERIES[name](spark, SMALL)
    assert df.count() > 0 and len(set(df.columns)) == len(df.columns)


def test_samples_have_their_size(spark):
    passages = spark.read.parquet(f"{SMALL}/subcorpus.parquet").selectExpr("lang", "trim(replace(docid, '\t', ' ')) docid").where("docid <> ''").distinct()
    expected = {r.lang: min(2000, r["count"]) for r in passages.groupBy("lang").count().collect()}
    got = {r.lang: r["count"] for r in QUERIES["p1_sample"](spark, SMALL).select("lang", "docid").distinct().groupBy("lang").count().collect()}
    assert got == expected


def test_budget_adds_up(spark):
    from pyspark.sql import functions as F

    total = QUERIES["p5_budget"](spark, SMALL).agg(F.sum("n_tokens"), F.sum("n_texts")).first()
    each = QUERIES["p5_tokens"](spark, SMALL).agg(F.sum("n_tokens"), F.count(F.lit(1))).first()
    own = QUERIES["p6_ids"](spark, SMALL).agg(F.sum(F.size("ids"))).first()[0]
    documents = QUERIES["p5_languages"](spark, SMALL).where("tab = 'documents'").agg(F.sum("n_tokens")).first()[0]
    assert tuple(total) == tuple(each) and own == documents
