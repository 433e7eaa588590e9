"""Repeated query rows, contradicting labels and columns whose names clash with inner ones."""

import numpy as np
from pyspark.sql import functions as F

from forecastlab.llm import bit_search, decontamination, jaccard_groups, sharding
from forecastlab.llm.common import free_name, one_label
from llm.conftest import as_docs, prose


def test_a_repeated_query_row_asks_once(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.standard_normal(16).tolist()) for i in range(400)]
    table = lambda r: spark.createDataFrame(r, "vec_id long, embedding array<float>")
    once = bit_search.nearest(table(rows), F.col("vec_id") % 20 == 0).collect()
    twice = bit_search.nearest(table([*rows, rows[20], rows[40]]).repartition(3), F.col("vec_id") % 20 == 0).filter("query_id IN (20, 40)").collect()
    own = {(r["query_id"], r["rank"], r["vec_id"]) for r in once if r["query_id"] == 20}
    got = {(r["query_id"], r["rank"], r["vec_id"]) for r in twice if r["query_id"] == 20}
    assert len(got) == 20 == len({v for _, _, v in got if v != 40}) + sum(v == 40 for _, _, v in got)
    if not any(v == 40 for _, _, v in own):
        assert got == own


def test_contradicting_labels(spark):
    rows = [(1, 0), (1, 0), (1, 1), (2, 1), (2, 0), (3, 0), (3, 0), (4, 1)]
    for shuffled in (rows, rows[::-1]):
        got = one_label(spark.createDataFrame(shuffled, "doc_id long, toxic int").repartition(4), "toxic").collect()
        assert {r["doc_id"]: r["toxic"] for r in got} == {1: 0, 2: 1, 3: 0, 4: 1}


def test_columns_of_inner_names_come_back(spark, tmp_path):
    docs = as_docs(spark, [(1, prose(1)), (2, prose(1)), (3, prose(3)), (3, prose(3))])
    named = docs.withColumn("_key", F.lit("mine")).withColumn("_content", F.lit("own")).withColumn("_CONTENT_", F.lit("too")).withColumn("shard", F.lit("kept"))
    kept = jaccard_groups.keep_one(named)
    assert kept.columns == named.columns
    assert sorted((r["doc_id"], r["_key"]) for r in kept.collect()) == [(1, "mine"), (3, "mine")]
    benchmark = spark.createDataFrame([(7, prose(3, 40))], "item_id long, text string")
    left = decontamination.remove_leaking(named, benchmark)
    assert left.columns == named.columns and {(r["doc_id"], r["_content"], r["_CONTENT_"]) for r in left.collect()} == {(1, "own", "too"), (2, "own", "too")}
    assert free_name(named, "_content") == "_content__"
    sharding.write_shards(named.dropDuplicates(["doc_id"]), str(tmp_path / "s"))
    back = spark.read.parquet(str(tmp_path / "s"))
    assert {(r["doc_id"], r["shard"], r["shard_"]) for r in back.collect()} == {(1, "kept", "all"), (2, "kept", "all"), (3, "kept", "all")}
