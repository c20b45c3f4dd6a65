"""Arrow folders, split specifications and the choice of a reader."""

import pytest
from pyspark.sql import functions as F

from rowloom.sources import arrow_files

from .conftest import rows


def test_arrow_folder_round_trip(spark, tmp_path):
    df = spark.range(100).select("id", F.when(F.col("id") % 3 > 0, F.concat(F.lit("t"), F.col("id").cast("string"))).alias("t"), F.array(F.col("id").cast("double")).alias("v")).repartition(3)
    path = str(tmp_path / "set")
    assert arrow_files.write_arrow_folder(df, path) and arrow_files.is_arrow_folder(spark, path)
    back = arrow_files.read_arrow_folder(spark, path)
    assert back.columns == df.columns and sorted(map(str, back.collect())) == sorted(map(str, df.collect()))
    assert not arrow_files.write_arrow_folder(df.where("false"), str(tmp_path / "none")) and not arrow_files.is_arrow_folder(spark, str(tmp_path / "none"))
    (tmp_path / "half").mkdir()
    (tmp_path / "half" / "state.json").write_text("{}")
    with pytest.raises(ValueError, match="dataset_info"):
        arrow_files.read_arrow_folder(spark, str(tmp_path / "half"))
    assert arrow_files.open_source(spark, path).count() == 100


def test_specs_and_router(spark, tmp_path):
    splits = {"train": spark.range(20).toDF("i"), "test": spark.range(3).toDF("i")}
    for spec, expected in (("train", 20), ("train[:5]", 5), ("train[90%:]", 2), ("train[10%:20%]", 2), ("test[1:]", 2)):
        assert arrow_files.read_spec(splits, spec, "i").count() == expected, spec
    assert rows(arrow_files.read_spec(splits, "train[90%:]", "i")) == [(18,), (19,)]
    for bad in ("odd", "train[a:]", "train[:5"):
        with pytest.raises(ValueError):
            arrow_files.read_spec(splits, bad, "i")
    (tmp_path / "x.jsonl").write_text('{"a": 1}\n')
    assert arrow_files.open_source(spark, str(tmp_path / "nothing"), {"train": str(tmp_path / "x.jsonl")}, schema="a int").first().a == 1
    with pytest.raises(ValueError):
        arrow_files.open_source(spark, str(tmp_path / "nothing"))
