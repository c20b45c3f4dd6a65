import math

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rowloom.operators import metrics as m
from rowloom.operators import order, retrieval, sampling

from .conftest import rows


def test_bm25_prefixes_and_edges(spark):
    corpus = spark.createDataFrame([("u", 0, "a b"), ("u", 1, "a c"), ("u", 2, "d"), ("v", 0, None)], "grp string, pos long, text string")
    queries = spark.createDataFrame([("u", 0, "b"), ("u", 1, "zz"), ("v", 0, "a"), ("w", 0, "a"), ("u", 2, None)], "grp string, qid long, text string")
    got = {(r.grp, r.qid): (r.top_k1, r.top_k2, r.top_k4) for r in retrieval.bm25_top(corpus, queries).collect()}
    assert got["u", 0][0] == "0"
    assert got["u", 1] == ("2", "2,1", "2,1,0")  # nothing found: later documents first
    assert got["v", 0] == ("0", "0", "0") and ("w", 0) not in got
    assert all(c.startswith(b) and b.startswith(a) for a, b, c in got.values())


def test_classification_and_rating(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), (None, "c"), ("x", None)], "p string, t string")
    got = m.classification_scores(df, F.col("p"), F.col("t")).first()
    assert got.n == 4 and got.accuracy == 0.5 and math.isclose(got.f1_weighted, (2 / 3 + 2 * 2 / 3) / 4)
    empty = m.classification_scores(df.where("false"), F.col("p"), F.col("t")).first()
    assert empty.accuracy == 0.0
    rated = spark.createDataFrame([(4.0, 5.0), (None, 1.0), (1.0, 1.0)], "p double, t double")
    got = m.rating_scores(rated, F.col("p"), F.col("t")).first()
    assert (got.n_read, got.mae, got.stsb) == (2, 0.5, 0.9) and math.isclose(got.rmse, math.sqrt(0.5))


def test_pass_at_k(spark):
    df = spark.createDataFrame([("t", True), ("t", False), ("s", False), ("s", False)], "task string, ok boolean")
    assert rows(m.pass_at_k(df, "task", "ok", (1, 2, 3))) == [(1, 2, 0.25), (2, 2, 0.5)]


def test_rouge(spark):
    df = spark.createDataFrame([(1, "the cat sat", "the cat ran fast"), (2, None, "x"), (3, "", "")], "k long, a string, b string")
    one = {r.k: r for r in m.unigram_rouge(df, "k", "a", "b").collect()}
    long = {r.k: r for r in m.longest_rouge(df, "k", "a", "b").collect()}
    for got in (one, long):
        assert math.isclose(got[1].p, 2 / 3) and math.isclose(got[1].r, 0.5) and got[2].f == 0 and got[3].f == 0


def test_checksum_ignores_order(spark):
    a = spark.createDataFrame([(1, "x"), (2, None)], "a int, b string")
    assert m.table_checksum(a).first() == m.table_checksum(a.orderBy(F.desc("a"))).first()


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(0, 40), min_size=1, max_size=8), st.integers(0, 60))
def test_largest_remainder(spark, caps, want):
    if not sum(caps):
        return
    df = spark.createDataFrame([(k, c) for k, c in enumerate(caps)], "bucket int, cap long")
    got = sampling.largest_remainder(df, want).collect()
    assert sum(r["take"] for r in got) == min(want, sum(caps)) and all(0 <= r["take"] <= r["cap"] for r in got)


def test_positions_bins_and_oversampling(spark):
    df = spark.createDataFrame([(i, (i * 7919) % 101) for i in range(101)], "i long, v long")
    assert rows(order.with_position(df, "v").select("v", "_pos")) == [(i, i) for i in range(101)]
    bins = sampling.quantile_bins(df, "v").groupBy("bin").count().collect()
    assert len(bins) == 10 and max(r["count"] for r in bins) <= 12
    kept = df.where("i < 3")
    assert sampling.oversample(kept, 8, "i").count() == 8 and sampling.oversample(kept.where("false"), 8, "i").count() == 0


def test_held_out_users_and_audit(spark):
    train = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "user_id string, x int")
    test = spark.createDataFrame([("a", 9), (None, 9)], "user_id string, x int")
    assert {r.x for r in sampling.drop_held_out(train, test).collect()} == {2, 3}
    both = spark.createDataFrame([("train", "p"), ("test", "p"), ("test", "p"), ("test", None)], "split string, t string")
    assert rows(sampling.overlap_audit(both, "split", F.col("t"))) == [("test", "train", 1)]
