"""Set assembly on hand-made cases."""

import json

import pytest
from pyspark.sql import functions as F

from rowloom.operators import assembly

from .conftest import rows


def test_user_chunks_are_bounded(spark):
    df = spark.createDataFrame([("hot", i) for i in range(25)] + [("a", 100), (None, 7)], "u string, i long")
    got = {(r.u, r.chunk): r.records for r in assembly.user_chunks(df, "u", "i", 10).collect()}
    assert got == {("hot", 0): list(range(10)), ("hot", 1): list(range(10, 20)), ("hot", 2): list(range(20, 25)), ("a", 0): [100]}
    assert assembly.user_chunks(df.where("false"), "u", "i").count() == 0


def test_retrieved_profiles(spark):
    df = spark.createDataFrame([(1, ["a b", "a c", None, "d"], ["b", None]), (2, None, ["b"])], "g long, d array<string>, q array<string>")
    assert rows(assembly.retrieved_profiles(df, "g", "d", "q", (1, 2), 100)) == [(1, 0, "a b", "a b\n\nd")]
    long = spark.createDataFrame([(1, ["x" * 900], ["x"])], "g long, d array<string>, q array<string>")
    assert len(assembly.retrieved_profiles(long, "g", "d", "q", (1,), 100).first().profile_retrieval_k1) == 363


def test_parts_sets_and_tasks(spark):
    df = spark.range(11).toDF("i")
    assert assembly.validation_parts(df, "i").where("part = 'train'").count() == 9
    both = assembly.concatenated(df, spark.createDataFrame([("lol_x",), ("t",)], "task string"))
    assert both.count() == 13 and rows(assembly.wanted_tasks(both.where("task is not null")).select("task")) == [("t",)] and assembly.wanted_tasks(both, ("odd",)).count() == 0
    assert df.where("false").agg(assembly.pointwise_mean(F.col("i"))).first()[0] == 0.0


def test_sources_and_descriptions(spark):
    df = spark.createDataFrame([("p", "a\n\nb"), (None, "c")], "profile_text string, input string")
    assert [r[0] for r in df.select(assembly.profile_source(df)).collect()] == ["p", ""]
    bare = df.drop("profile_text")
    assert [r[0] for r in bare.select(assembly.profile_source(bare)).collect()] == ["a", "c"]
    told = spark.createDataFrame([(d, f"{d}{k}", k == 2) for d in "abcde" for k in range(3)], "dataset string, text string, eval boolean")
    got = assembly.description_picks(told).collect()
    assert all(sum(r.dataset == d and r.kind == k for r in got) == n for d in "abcde" for k, n in (("own", 1), ("eval", 1), ("other", 3))) and all(r.source != r.dataset for r in got if r.kind == "other")
    mixes = assembly.task_mixtures(1, 4, 2)
    assert [k for k, _ in mixes] == ["own", "other", "mix0", "mix1", "mix2"] and mixes[0][1] == [0, 1, 0, 0] and all(abs(sum(p) - 1) < 1e-9 for _, p in mixes)


def test_curated_sets(spark, tmp_path):
    (tmp_path / "v3").mkdir()
    (tmp_path / "v3" / "lamp_movie_random_test.jsonl").write_text(json.dumps({"x": 1}) + "\n")
    assert [(r.x, r.task, r.split) for r in assembly.curated(spark, str(tmp_path), "random_test").collect()] == [(1, "lamp_movie", "random_test")]
    for split, version in (("odd", "auto"), ("train", "v9")):
        with pytest.raises(ValueError):
            assembly.curated(spark, str(tmp_path), split, version)
    log = spark.createDataFrame([(1, 0.5, True), (2, 0.7, None), (3, 0.7, False), (4, None, False)], "step int, loss double, failed boolean")
    assert assembly.recovered_checkpoint(log).first().step == 2
