"""The pipeline over a small fixture, and the registered queries over the smallest tables."""

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from forecastlab.llm import queries
from llm.conftest import as_docs, odd_pairs, prose

SMALL = "/root/testdata/sf0.001"


def write(spark, folder, docs, labels, items):
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def test_pipeline_takes_out_what_was_planted(spark, tmp_path):
    pairs = [(k, prose(k, 60)) for k in range(300)]
    toxic = {k for k in range(300) if k % 6 == 0}
    pairs = [(k, "idiot moron " + t + " idiot" if k in toxic else t) for k, t in pairs]
    item = prose(9001, 30)
    pairs += [(1000 + k, prose(7777, 90)) for k in range(20)] + [(2000 + k, prose(2000 + k, 40) + " " + item) for k in range(5)]
    pairs += [(3000, 'x token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" ' + prose(3000))] + [(None, prose(4000)), (5000, None), (5001, "")]
    labels = [(k, 1, int(k in toxic)) for k in range(300)]
    folder = write(spark, tmp_path / "sf", as_docs(spark, pairs), labels, [(1, item)])
    docs, seen = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs.columns
        stage(spark, docs, folder).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        seen[name] = {r["doc_id"] for r in docs.select("doc_id").collect()}
        assert docs.columns == before or name == "pieces"
    everything = {i for i, _ in pairs}
    assert seen["toxicity"] == everything - toxic
    assert seen["near_copies"] == seen["toxicity"] - {1000 + k for k in range(1, 20)}
    assert seen["decontamination"] == seen["near_copies"] - {2000 + k for k in range(5)}
    assert seen["secrets"] == seen["pieces"] == seen["decontamination"]
    marked = spark.read.parquet(f"{folder}/secrets").where("doc_id = 3000").first()
    assert marked["text"].startswith('x [SECRET]" ') and marked["n_chars"] == len(marked["text"])
    got = {(r["doc_id"], r["n_ids"]) for r in corpus_pipeline.run(spark, folder).collect()}
    assert got == {(r["doc_id"], r["n_ids"]) for r in docs.collect()}


@pytest.mark.parametrize("pairs", [[], odd_pairs()], ids=["empty", "odd"])
def test_pipeline_on_odd_tables(spark, tmp_path, pairs):
    folder = write(spark, tmp_path / "sf", as_docs(spark, pairs), [], [])
    rows = corpus_pipeline.run(spark, folder).collect()
    assert all(r["round_trip"] for r in rows) and bool(rows) == bool(pairs)


def test_all_are_registered():
    found = entry.queries()
    assert {q.split("_")[0] for q in queries.QUERIES} == {f"op{n}" for n in range(1, 11)} and "pipeline" in found
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_copies", "decontamination", "secrets", "pieces"]
    assert set(queries.ORACLES) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries_on_the_smallest_tables(spark, name):
    import check

    df = queries.QUERIES[name](spark, SMALL)
    if name in queries.ORACLES:
        con = duckdb.connect()
        for table in check.TABLES:
            con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SMALL}/{table}.parquet'")
        result = check.compare(df, con, queries.ORACLES[name])
        assert result.startswith("ok"), result
    else:
        assert df.count() > 0
    if "doc_id" in df.columns and name not in ("op2_decontamination",):
        assert df.count() == spark.read.parquet(f"{SMALL}/documents.parquet").count()


def test_learning_ignores_held_out_labels(spark, tmp_path):
    """Labels of held-out rows may say anything."""
    from forecastlab.llm import toxicity
    from forecastlab.llm.common import fold_of

    docs = as_docs(spark, [(k, prose(k, 30) + (" moron" if k % 4 == 0 else "")) for k in range(200)])
    right = [(k, 1, int(k % 4 == 0)) for k in range(200)]
    wrong = [(k, 1, 1 - t if fold_of(k) == 0 else t) for k, _, t in right]
    models = [toxicity.fit(docs, spark.createDataFrame(rows, "doc_id long, quality int, toxic int")) for rows in (right, wrong)]
    assert models[0] == models[1]
    assert docs.where(F.col("doc_id") >= 0).count() == 200


def test_a_worker_holds_one_operators_tables():
    """Python workers live through all stages: the tables of the last operator go before new ones are made, or when a task starts empty."""
    from forecastlab.llm import common

    made = []
    one = common.hold("one", 1, lambda: made.append("one") or [1])
    assert common.hold("one", 1, lambda: made.append("again")) is one and made == ["one"]
    common.hold("two", 1, lambda: made.append("two") or [2])
    assert common.held("one", 1) is None and common.held("two", 1) == [2] and len(common._held) == 1
    common.start_empty()
    assert not common._held
