import duckdb

import corpus_pipeline
from gristmill.llm import licenses, queries, sql
from tests.llm.conftest import EDGES

SF = "/root/testdata/sf0.001"


def test_oracle(spark):
    c = duckdb.connect()
    for name in ("documents", "benchmark"):
        c.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    for name, text in sql.oracle_sql().items():
        answer = c.execute(text)
        columns = [d[0] for d in answer.description]
        got = sorted((tuple(r) for r in queries.queries()[name](spark, SF).select(columns).collect()), key=repr)
        assert got == sorted(answer.fetchall(), key=repr), name


def test_licenses_edges(spark, documents):
    rows = [(10, "Released under the MIT License. MIT license"), (11, "Permission is hereby granted, free of charge, to any kind person obtaining a copy of this software"), (12, "of the of the of the under the of the")] + EDGES
    got = {r["doc_id"]: r for r in licenses.scan(documents(rows)).collect() if r["doc_id"] is not None}
    assert (got[10]["n_base"], got[10]["first_word"], got[10]["last_word"], got[10]["labels"], got[10]["score"]) == (2, 3, 5, "mit", 1.0)
    assert (got[11]["n_base"], got[11]["base_labels"], got[11]["labels"]) == (0, "", "mit") and 0.6 <= got[11]["score"] < 1
    assert got[12]["labels"] == "" and got[2]["n_words"] == 0 and got[2]["score"] == 0.0
    assert licenses.scan(documents(rows)).count() == len(rows)
    assert licenses.scan(documents(rows).where("doc_id < 0")).count() == 0


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, SF)
        assert after.columns == list(corpus_pipeline.COLUMNS)
        rows = {r["doc_id"]: r for r in after.collect()}
        old = {r["doc_id"]: r for r in before.collect()}
        assert set(rows) <= set(old)
        if name in ("line dedup", "substring dedup"):
            assert set(rows) == set(old)
        before = spark.createDataFrame([tuple(r) for r in rows.values()], after.schema)
    packed = corpus_pipeline.STAGES[-1][1](spark, before, SF)
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == set(rows)
    assert corpus_pipeline.run(spark, SF).count() == packed.count()
