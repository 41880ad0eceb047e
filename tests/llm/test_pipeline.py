import os

import pytest

import __spark_entry__
import corpus_pipeline
from tessera.llm import queries

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the test tables aren't here")


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.queries()) == list(range(1, 11))
    assert set(queries.queries()) | {"pipeline"} <= set(__spark_entry__.queries())
    assert set(queries.oracle_sql()) <= set(queries.queries())


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, FOLDER).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        if name != "packing":
            assert docs.columns == columns
            assert 0.5 * before < docs.count() <= before
            assert docs.where("n_chars <> length(text)").count() == 0
            before = docs.count()
    ids = {r.doc_id for r in docs.select("doc_id").distinct().collect()}
    assert len(ids) == before
    assert corpus_pipeline.run(spark, FOLDER).count() == docs.count()


def test_stages_on_an_empty_table(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, FOLDER)
        assert out.count() == 0


def test_sql_of_operators(spark):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in os.listdir(FOLDER):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{FOLDER}/{f}'")
    for name, text in queries.oracle_sql().items():
        df = queries.queries()[name](spark, FOLDER)
        found = con.execute(text)
        names = [c[0] for c in found.description]
        assert sorted(names) == sorted(df.columns)
        at = [names.index(c) for c in df.columns]
        assert sorted(map(str, (tuple(r) for r in df.collect()))) == sorted(str(tuple(r[i] for i in at)) for r in found.fetchall())
