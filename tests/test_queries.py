"""Every query of the engine against its SQL in DuckDB, on the smallest tables."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from jobs import queries as jobs
from tessera import queries

ALL, SQL = queries.QUERIES | jobs.QUERIES, queries.ORACLES | jobs.ORACLES
DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    d = duckdb.connect()
    for t in TABLES:
        d.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return d


def canonical(df):
    df = df[sorted(df.columns)]
    return sorted(map(str, df.astype(object).where(df.notna(), None).values.tolist()))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(ALL))
def test_query_equals_its_sql(spark, duck, name):
    got, want = ALL[name](spark, DATA).toPandas(), duck.sql(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got) == canonical(want)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 3
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
def test_plans_are_as_meant(spark):
    """The probe strategy has no exchange after its scan; the join reads two columns and broadcasts the small index."""
    from tessera.operators import coverage

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    own = queries.text_index(spark, DATA)
    plan = coverage.verdicts(docs, "doc_id", "text", own, 100)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "ReadSchema: struct<doc_id:bigint,text:string>" in plan
    plan = coverage.seed_hits(docs, "doc_id", "text", own)._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan and "html" not in plan


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
@pytest.mark.parametrize("name", ["split_complete", "split_paired"])
def test_records_are_decided_once(spark, name):
    plan = ALL[name](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
def test_parts_do_not_grow_with_the_table(spark, monkeypatch):
    """what a task decides, and each file that a stream reads, has a bounded number of records."""
    monkeypatch.setattr(queries, "PART_ROWS", 100)
    rows = queries.paired_reads(spark, DATA)
    n = rows.count()
    assert n > 1000 and rows.rdd.getNumPartitions() >= n / 100
    assert max(r["count"] for r in rows.groupBy(F.spark_partition_id()).count().collect()) <= 200
    back = spark.read.format("fastq").load(queries.fastq_files(spark, DATA, "bgzf")).groupBy("sample").count()
    assert max(r["count"] for r in back.collect()) <= 200


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
@pytest.mark.parametrize("name", ["coverage_score", "coverage_spaced"])
def test_an_index_that_is_mapped_gives_the_same(spark, duck, monkeypatch, name):
    """with a filter of eight bits, whose false finds are many."""
    sent = queries.dna_index
    monkeypatch.setattr(queries, "dna_index", lambda *a: sent(*a).mapped(8))
    assert canonical(ALL[name](spark, DATA).toPandas()) == canonical(duck.sql(SQL[name]).df())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
def test_rate_of_an_index_that_is_mapped(spark, duck, monkeypatch, tmp_path):
    """false finds of the filter are not counted; of no reads none are asked for."""
    sent = queries.dna_index
    monkeypatch.setattr(queries, "dna_index", lambda *a: sent(*a).mapped(8))
    assert canonical(ALL["seed_hit_rate"](spark, DATA).toPandas()) == canonical(duck.sql(SQL["seed_hit_rate"]).df())
    for t, n in (("supplier", 100), ("orders", 0)):
        spark.read.parquet(f"{DATA}/{t}.parquet").limit(n).write.parquet(f"{tmp_path}/{t}.parquet")
    assert tuple(ALL["seed_hit_rate"](spark, str(tmp_path)).first()) == (0, 0)
