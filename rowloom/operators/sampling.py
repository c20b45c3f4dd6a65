"""Stratified, cluster-based and proportional sampling of users and rows. Orders come from hashes, so results repeat."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowloom.functions.vectors import distance
from rowloom.operators.order import with_position
from rowloom.operators.skew import join_lookup, join_small
from rowloom.session import durable


def hash_order(*columns: Column | str, seed: int = 42) -> Column:
    """A fixed random order: part of a digest of the columns and the seed, the same in every engine."""
    return F.md5(F.concat_ws("|", *[F.col(c).cast("string") if isinstance(c, str) else c.cast("string") for c in columns], F.lit(str(seed))))


def largest_remainder(sizes: DataFrame, want: int) -> DataFrame:
    """How many to take of each bucket (`bucket`, `cap`), in proportion, by largest remainder: `want` in total, never above `cap`.

    Whole parts first; what is left goes in the order of the remainders, and a bucket takes as much of it as it holds.
    """
    share = sizes.withColumn("exact", F.lit(float(want)) * F.col("cap") / F.sum("cap").over(Window.partitionBy()))
    base = share.withColumn("base", F.least(F.floor("exact"), F.col("cap"))).withColumn("spare", F.col("cap") - F.col("base")).withColumn("rest", F.round(F.col("exact") - F.floor("exact"), 9))
    order = Window.partitionBy().orderBy(F.desc("rest"), "bucket")
    before = F.coalesce(F.sum("spare").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = F.lit(want) - F.sum("base").over(Window.partitionBy())
    extra = F.greatest(F.lit(0), F.least(F.col("spare"), left - before))
    return base.select("bucket", "cap", (F.col("base") + extra).cast("long").alias("take"))


def hash_share(*columns: Column | str, seed: int = 42) -> Column:
    """Where a row stands in `hash_order`, between 0 and 1."""
    return F.conv(F.substring(hash_order(*columns, seed=seed), 1, 12), 16, 10).cast("double") / float(16**12)


def pick_by_bucket(rows: DataFrame, takes: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """The rows picked from each bucket: the first `take` in hash order of their key.

    A bucket's rows below a threshold of their hash are candidates: as many as are wanted and some more, so only these few
    get a position in a global order. The rare bucket that has too few of them goes the same way with all its rows.
    Buckets missing in `takes` give no row.
    """
    sizes = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("_cap"))
    want = durable(takes.select("bucket", "take").join(sizes, "bucket").where("take > 0").withColumn("_below", (F.col("take") + 6 * F.sqrt("take") + 20) / F.col("_cap")))
    near = durable(join_small(rows, want, "bucket").where((F.col("_below") >= 1) | (hash_share(key, seed=seed) < F.col("_below"))))
    short = want.join(near.groupBy("bucket").agg(F.count(F.lit(1)).alias("_n")), "bucket", "left").where(F.coalesce("_n", F.lit(0)) < F.least("take", "_cap")).drop("_n")
    if not short.isEmpty():
        near = near.join(F.broadcast(short.select("bucket")), "bucket", "left_anti").unionByName(join_small(rows, short, "bucket"))
    placed = with_position(near.drop("_below", "_cap"), "bucket", hash_order(key, seed=seed), key, name="_at")
    first = placed.groupBy("bucket").agg(F.min("_at").alias("_first"))
    return join_small(placed, first, "bucket").where(F.col("_at") - F.col("_first") < F.col("take")).drop("_at", "_first", "take")


def quantile_bins(df: DataFrame, length: str, bins: int = 10) -> DataFrame:
    """Rows with their bin by quantiles of log(1 + length); equal edges are set apart, so bins stay ordered."""
    at = F.array(*[F.lit(i / bins) for i in range(bins + 1)])
    edges = df.agg(F.percentile(F.log1p(F.col(length)), at).alias("e"))
    rising = F.aggregate("e", F.array().cast("array<double>"), lambda acc, x: F.concat(acc, F.array(F.when(F.size(acc) == 0, x).otherwise(F.greatest(x, F.try_element_at(acc, F.lit(-1)) + 1e-6)))))
    inner = edges.select(F.slice(rising, 2, bins - 1)).scalar()  # a subquery that runs once
    return df.withColumn("inner", inner).withColumn("bin", F.size(F.filter("inner", lambda x: x < F.log1p(F.col(length))))).drop("inner")


def allocate(train: list[int], there: list[int], n: int) -> list[int]:
    """How many to take of each bin so that bins hold the training set's shares: rounded to even, corrected in the order of the
    remainders, never more than are there; what is missing comes from the bins with the most to spare."""
    share = np.array(train, dtype=float) / max(1, sum(train))
    exact = share * n
    want = np.round(exact).astype(int)
    rest = exact - np.floor(exact)
    gap = n - int(want.sum())
    for i in (np.argsort(rest, kind="stable")[::-1] if gap > 0 else np.argsort(rest, kind="stable"))[: abs(gap)]:
        want[i] += 1 if gap > 0 else -1
    take = np.minimum(want, there)
    left = n - int(take.sum())
    spare = np.array(there) - take
    for b in sorted(range(len(take)), key=lambda b: -spare[b]):
        more = min(left, int(spare[b]))
        take[b] += more
        left -= more
        if left <= 0:
            break
    return [int(t) for t in take]


def matched_sample(train: DataFrame, candidates: DataFrame, n: int, length: str, key: str, bins: int = 10, seed: int = 42) -> DataFrame:
    """n candidates whose lengths are distributed like those of the training rows: bins by the training set's quantiles in log space.

    The driver sees the counts of the bins only. An empty training set gives any n candidates, by digest.
    """
    at = [i / bins for i in range(bins + 1)]
    edges = train.agg(F.percentile(F.log1p(F.col(length)), F.array(*[F.lit(x) for x in at])).alias("e")).first()["e"]
    rising: list[float] = []
    for x in edges or []:
        rising.append(max(x, rising[-1] + 1e-6) if rising else x)
    inner = F.array(*[F.lit(x) for x in rising[1:-1]]) if rising else F.array().cast("array<double>")
    place = lambda df: df.withColumn("bucket", F.size(F.filter(inner, lambda x: x < F.log1p(F.col(length)))))
    counts = lambda df: {r["bucket"]: r["count"] for r in place(df).groupBy("bucket").count().collect()}
    own, there = counts(train), counts(candidates)
    take = allocate([own.get(b, 0) for b in range(bins)], [there.get(b, 0) for b in range(bins)], n)
    takes = train.sparkSession.createDataFrame(list(enumerate(take)), "bucket int, take long")
    return pick_by_bucket(place(candidates), takes, key, seed)


def user_counts(df: DataFrame, user: str = "user_id") -> DataFrame:
    return df.where(F.col(user).isNotNull()).groupBy(F.col(user).alias("user_id")).agg(F.count(F.lit(1)).alias("n"))


def drop_held_out(train: DataFrame, *tests: DataFrame, key: str = "user_id") -> DataFrame:
    """Training rows whose user is in no test set; null users stay."""
    held = tests[0].select(key)
    for t in tests[1:]:
        held = held.unionByName(t.select(key))
    return join_lookup(train, held.where(F.col(key).isNotNull()).distinct(), key, how="left_anti")


def overlap_audit(rows: DataFrame, split: str, *parts: Column) -> DataFrame:
    """Distinct fingerprints shared by each pair of splits (`split_a`, `split_b`, `n_shared`), grouped by fingerprint once."""
    mark = F.concat_ws("|", *[F.coalesce(F.substring(p, 1, 50), F.lit("")) for p in parts])
    sets = rows.select(F.sha2(mark, 256).alias("h"), F.col(split).alias("s")).groupBy("h").agg(F.sort_array(F.collect_set("s")).alias("in"))
    pairs = sets.where(F.size("in") > 1).select(F.explode(F.flatten(F.transform("in", lambda a: F.transform(F.filter(F.col("in"), lambda b: b > a), lambda b: F.struct(a.alias("split_a"), b.alias("split_b")))))).alias("p"))
    return pairs.groupBy("p.split_a", "p.split_b").agg(F.count(F.lit(1)).alias("n_shared"))


def sampling_weights(sizes: DataFrame, size: str = "n", strategy: str = "sqrt_size") -> DataFrame:
    """Weights of datasets, none under a tenth of the largest; they sum to one.

    `uniform`, `size`, `sqrt_size` or `inv_size`; an unknown strategy raises. One row per dataset.
    """
    n = F.col(size).cast("double")
    every = Window.partitionBy()
    raw = {"uniform": F.lit(1.0), "size": n, "sqrt_size": F.sqrt(n), "inv_size": F.max(n).over(every) / n}
    if strategy not in raw:
        raise ValueError(f"unknown sampling strategy: {strategy!r}")
    floored = sizes.withColumn("w", raw[strategy]).withColumn("w", F.greatest("w", 0.1 * F.max("w").over(every)))
    return floored.withColumn("weight", F.col("w") / F.sum("w").over(every)).drop("w")


def proportional_sizes(sizes: DataFrame, share: float) -> DataFrame:
    """Rows to keep of each dataset (`bucket`, `cap`): its share rounded to even, one at least."""
    return sizes.withColumn("keep", F.when(F.col("cap") == 0, F.lit(0)).otherwise(F.greatest(F.lit(1), F.bround(F.lit(share) * F.col("cap"), 0))).cast("long"))


def oversample(kept: DataFrame, want: int, key: str) -> DataFrame:
    """`kept` plus repeats of its rows, in hash order and round after round, up to `want` rows (`copy`: 0 for the original)."""
    n = kept.count()
    if not n:
        return kept.withColumn("copy", F.lit(0))
    copies = F.floor((F.lit(want - 1) - F.col("_r")) / n).cast("int")
    return with_position(kept, hash_order(key), key, name="_r").withColumn("copy", F.explode(F.sequence(F.lit(0), F.greatest(copies, F.lit(0))))).drop("_r")


def cluster_outliers(vectors: DataFrame, per_cluster: int, cluster: str = "label", vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """The members furthest from their cluster's centre (`key`, `cluster`, `rank`, `dist`)."""
    spread_ = vectors.select(key, cluster, vector)
    parts = spread_.select(cluster, F.posexplode(vector).alias("i", "x")).groupBy(cluster, "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    centres = parts.groupBy(cluster).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("centre"))
    far = spread_.join(centres, cluster).withColumn("dist", distance(F.col(vector), F.col("centre")))
    rank = F.row_number().over(Window.partitionBy(cluster).orderBy(F.desc(F.round("dist", 9)), key))
    return far.withColumn("rank", rank).where(F.col("rank") <= per_cluster).select(key, cluster, F.col("rank").cast("long").alias("rank"), "dist")


def farthest_first(vectors: DataFrame, k: int, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """A diverse set of k vectors: each next one is farthest from those chosen (k passes over a written table)."""
    rest = durable(vectors.select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("v"))).withColumn("d", F.lit(None).cast("double"))
    chosen = []
    last = rest.orderBy("key").first()
    while last is not None and len(chosen) < k:
        chosen.append((last["key"], len(chosen) + 1))
        step = distance(F.col("v"), F.array(*[F.lit(float(x)) for x in last["v"]]))
        rest = durable(rest.where(F.col("key") != last["key"]).withColumn("d", F.least("d", step)))
        last = rest.orderBy(F.desc(F.round("d", 9)), "key").first()
    return vectors.sparkSession.createDataFrame(chosen or [], f"{key} long, rank int")


def cluster_counts(n: int) -> list[int]:
    """Numbers of clusters worth a look for n vectors, in some ten steps."""
    low, high = max(5, min(10, n // 100)), min(50, max(20, n // 50))
    return sorted({*range(low, high + 1, max(1, (high - low) // 10)), high})


def coarse_cluster_counts(n: int) -> list[int]:
    """The same for small sets: every number from a twentieth (2 to 10) to a fifth (20 at most)."""
    return list(range(max(2, min(10, n // 20)), min(20, n // 5) + 1))


def kmeans_ood_split(vectors: DataFrame, n_test: int, candidates: tuple[int, ...] | None = None, least: int = 5, seed: int = 42, vector: str = "embedding", key: str = "vec_id", half: bool = False) -> DataFrame:
    """Out-of-distribution split (`key`, `cluster`, `split`): whole outlying clusters become the test set.

    The number of clusters is the candidate with the best silhouette; `cluster_counts` proposes about twenty for a table's size. Clusters rank by mean distance of their centre to the
    others over one plus their size; those with `least` members or more fill the quota, the last with its furthest members,
    and the other members of a touched cluster are left out of training. With `half`, at most half of a cluster is taken, by
    digest, and the others train.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.evaluation import ClusteringEvaluator
    from pyspark.ml.functions import array_to_vector

    data = durable(vectors.select(F.col(key).alias("key"), array_to_vector(F.col(vector).cast("array<double>")).alias("features")))
    best = None
    n = data.count()
    if n <= n_test:  # no more users than are wanted: all of them are tested
        return data.select(F.col("key").alias(key), F.lit(0).alias("cluster"), F.lit("ood_test").alias("split"))
    for k in [c for c in candidates or cluster_counts(n) if c < n] or [min(2, n)]:
        model = KMeans(k=k, seed=seed, initSteps=5).fit(data)
        score = ClusteringEvaluator().evaluate(model.transform(data)) if k > 1 else 0.0
        if best is None or score > best[0]:
            best = (score, model)
    centres = np.array(best[1].clusterCenters())
    placed = best[1].transform(data).select("key", "features", F.col("prediction").alias("cluster"))
    sizes = {r["cluster"]: r["count"] for r in placed.groupBy("cluster").count().collect()}
    gaps = np.linalg.norm(centres[:, None] - centres[None], axis=2).sum(axis=1) / max(1, len(centres) - 1)
    order = sorted((c for c in sizes if sizes[c] >= least), key=lambda c: -gaps[c] / (1 + sizes[c]))
    takes, left = [], n_test
    for c in order:
        if left <= 0:
            break
        takes.append((int(c), min(left, sizes[c] // 2 if half else sizes[c])))
        left -= takes[-1][1]
    spark = vectors.sparkSession
    quota = spark.createDataFrame(takes or [(-1, 0)], "cluster int, take long")
    middle = spark.createDataFrame([(int(c), [float(x) for x in centres[c]]) for c in range(len(centres))], "cluster int, centre array<double>")
    from pyspark.ml.functions import vector_to_array

    far = placed.join(F.broadcast(middle), "cluster").withColumn("d", distance(vector_to_array("features"), F.col("centre")))
    # only clusters of which a part is taken are ranked; whole ones are taken as they are
    counted = far.join(F.broadcast(quota), "cluster", "left").join(F.broadcast(spark.createDataFrame([(int(c), n) for c, n in sizes.items()], "cluster int, size long")), "cluster")
    order = [hash_order("key", seed=seed)] if half else [F.desc("d")]
    cut = counted.where("take < size").withColumn("r", F.row_number().over(Window.partitionBy("cluster").orderBy(*order, "key")))
    ranked = cut.unionByName(counted.where("take is null or take >= size").withColumn("r", F.lit(0)))
    split = F.when(F.col("take").isNull(), "train").when(F.col("r") <= F.col("take"), "ood_test").otherwise("train" if half else "left_out")
    return ranked.select(F.col("key").alias(key), F.col("cluster"), split.alias("split"))
