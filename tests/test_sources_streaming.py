import pytest
from pyspark.sql import functions as F

from rowloom.sources import files
from rowloom.streaming import incremental

from .conftest import rows


def test_jsonl_strict_and_tolerant(spark, tmp_path):
    path = tmp_path / "lamp_movie_random_test.jsonl"
    path.write_text('{"a": 1}\n\n{"a": \n{"a": 3, "b": 4}\n')
    assert rows(files.read_jsonl(spark, str(path), "a int", strict=False)) == [(1,), (3,)]
    with pytest.raises(Exception, match="MALFORMED|FAILED_READ"):
        files.read_jsonl(spark, str(path), "a int").collect()
    named = files.with_task_split(files.read_jsonl(spark, str(path), "a int", strict=False))
    assert {(r.task, r.split) for r in named.collect()} == {("lamp_movie", "random_test")}
    assert files.file_task_split("x_ood_train.jsonl") == ("x", "ood_train") and files.file_task_split("plain.json") == ("plain", None)


def test_versions(spark, tmp_path):
    for v in ("v1", "v2", "v10", "vx", "other"):
        (tmp_path / v).mkdir()
    folder = str(tmp_path)
    assert files.find_versions(spark, folder) == [10, 2, 1]
    assert files.resolve_version(spark, folder) == (f"{folder}/v10", "v3")
    assert files.resolve_version(spark, folder, "v2") == (f"{folder}/v2", "v2")
    assert files.resolve_version(spark, folder, "v1") is None and files.resolve_version(spark, folder, "v7") is None


def test_slices_and_sinks(spark, tmp_path):
    df = spark.range(100).withColumn("x", F.col("id") * 3)
    path = str(tmp_path / "t")
    assert files.write_table(df, path) and not files.write_table(df.where("false"), str(tmp_path / "none"))
    take = lambda s: sorted(r.id for r in files.read_sized(spark, path, "id", s).collect())
    assert take("[:5]") == list(range(5)) and take("[90%:]") == list(range(90, 100)) and take("[:90%]") == list(range(90)) and len(take("")) == 100
    with pytest.raises(ValueError, match="slice"):
        take("[a]")
    assert files.sniff_format(spark, path) == "parquet" and files.sniff_format(spark, "/x/y.jsonl") == "jsonl" and files.sniff_format(spark, "/x/y.bin") is None


def test_profiles_first_split_wins(spark):
    df = spark.sql("select map('a', map('u', ' one ', 'v', ''), 'b', map('u', 'two', 'w', 'three')) as profiles")
    assert rows(files.flatten_profiles(df)) == [("u", "a", "one"), ("w", "b", "three")]


def test_resumable_requests(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    answer = lambda df: df.select("custom_id", F.concat(F.lit("re: "), "body").alias("content"))
    for batch in ([("a", "1"), ("a", "1"), (None, "x")], [("a", "1"), ("b", "2")]):
        spark.createDataFrame(batch, "custom_id string, body string").write.mode("append").parquet(source)
        stream = spark.readStream.schema("custom_id string, body string").parquet(source)
        incremental.resumable(stream, answer, out, str(tmp_path / "cp")).awaitTermination(60)
    assert rows(spark.read.parquet(out)) == [("a", "re: 1"), ("b", "re: 2")]


def test_windowed_counts(spark):
    df = spark.sql("select timestamp'2024-01-01 00:10:00' ts, 1 user_id, 'x' event_type union all select timestamp'2024-01-01 00:50:00', 1, 'x' union all select timestamp'2024-01-01 01:10:00', 1, 'x'")
    assert sorted(r.n for r in incremental.windowed_counts(df).collect()) == [1, 2]
