"""Operators that avoid one task per group: picks by threshold, positional medians, blocked search, lookups of any kind of join."""

import random

import numpy as np
from pyspark.sql import functions as F

from rowloom.operators import metrics, policies, sampling, skew, vector_search
from rowloom.session import drop_folder, scan_parts, shared_folder, spread
from rowloom.sources.arrays import read_arrays, write_arrays

from .conftest import rows


def test_picks_equal_a_full_sort(spark):
    df = spark.range(3000).select((F.col("id") % 7).alias("bucket"), F.concat(F.lit("k"), F.col("id").cast("string")).alias("k")).unionByName(spark.createDataFrame([(50, "a"), (50, "a"), (51, "b")], "bucket long, k string"))
    takes = spark.createDataFrame([(0, 5), (1, 400), (2, 9999), (3, 0), (50, 1), (99, 3)], "bucket long, take long")
    got = sampling.pick_by_bucket(df, takes, "k")
    assert got.columns == ["bucket", "k"]
    want = []
    for b, t in ((0, 5), (1, 400), (2, 9999), (50, 1)):
        want += [(b, r.k) for r in df.where(F.col("bucket") == b).orderBy(sampling.hash_order("k"), "k").limit(t).collect()]
    assert rows(got) == sorted(want)
    assert sampling.pick_by_bucket(df.where("false"), takes, "k").count() == 0


def test_median_by_position(spark):
    rng = random.Random(4)
    data = [(rng.choice(["a", "b", None]), rng.choice([None, *range(9)])) for _ in range(301)] + [("only null", None)]
    df = spark.createDataFrame([(g, None if v is None else float(v)) for g, v in data], "g string, v double")
    got = {r.g: r for r in metrics.spread(df, "v", "g").collect()}
    assert set(got) == {"a", "b", None}
    for g, r in got.items():
        own = [v for k, v in data if k == g and v is not None]
        assert r.median == np.median(own) and r.total == sum(own) and abs(r["std"] - np.std(own)) < 1e-9
    assert metrics.spread(df.where("false"), "v", "g").count() == 0 and metrics.spread(df, "v").first().median == np.median([v for _, v in data if v is not None])


def test_blocked_cosine_search(spark, monkeypatch):
    monkeypatch.setattr(vector_search, "BLOCK", 3)
    rng = np.random.default_rng(1)
    m = rng.normal(size=(60, 5))
    m[7] = 0
    m[9] = m[8]
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)] + [(60, None)], "vec_id long, embedding array<double>")
    unit = m / np.where(np.linalg.norm(m, axis=1) > 0, np.linalg.norm(m, axis=1), np.nan)[:, None]
    got = {}
    for r in vector_search.nearest_by_cosine(df.where("vec_id % 5 = 0 or vec_id in (7, 8)"), df, 4).orderBy("q", "rank").collect():
        got.setdefault(r.q, []).append((r.vec_id, r.cos))
    for q in [*range(0, 60, 5), 8]:
        cos = np.round(unit @ unit[q], 6)
        best = sorted((j for j in range(60) if j != q and np.isfinite(cos[j])), key=lambda j: (-cos[j], j))[:4]
        assert [j for j, _ in got[q]] == best
    assert 7 not in got and vector_search.nearest_by_cosine(df.where("false"), df, 4).count() == 0 and vector_search.nearest_by_cosine(df, df.where("false"), 4).count() == 0


def test_lookups_of_every_kind(spark):
    data = [("hot",)] * 300 + [(f"k{i}",) for i in range(40)] + [(None,)] * 3
    df = spark.createDataFrame(data, "k string").withColumn("x", F.lit(1))
    look = spark.createDataFrame([("hot", 1), ("k3", 2), ("zz", 3)], "k string, v int")
    for how in ("inner", "left", "left_semi", "left_anti"):
        assert skew.join_lookup(df, look, "k", how=how).count() == df.join(look, "k", how).count(), how
    assert skew.join_small(df, look, "k").count() == skew.join_small(df, look, "k", limit=1).count() == 301


def test_choices_of_users_above_the_top_k(spark):
    users = spark.range(200).select(F.col("id").cast("string").alias("user_id"))
    assert rows(policies.pick_users(users, 50)) == rows(policies.pick_users(users, 50, few=10))


def test_arrays_in_the_shared_folder(spark, tmp_path):
    uri = shared_folder(spark, "arrays")
    write_arrays(uri, "a.npz", {"x": np.arange(3)})
    assert read_arrays(uri, "a.npz")["x"].tolist() == [0, 1, 2] and read_arrays(uri, "b.npz") is None
    drop_folder(spark, uri)
    assert read_arrays(uri, "a.npz") is None
    spark.range(10).write.parquet(str(tmp_path / "t"))
    small = spark.read.parquet(str(tmp_path / "t"))
    assert scan_parts(small) >= 1 and spread(small).count() == 10
