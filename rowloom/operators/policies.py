"""Split policies by data set, diverse users, and sampling across data sets."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowloom.operators.order import with_position
from rowloom.operators.sampling import hash_order, hash_share, largest_remainder, pick_by_bucket, user_counts
from rowloom.operators.skew import join_lookup

#: Users held out at random and out of distribution, by data set; shares where fewer than one.
HELD_OUT = {"lamp": (200, 200), "longlamp": (200, 200), "oq": (100, 100), "opinionqa": (100, 100), "aloe": (100, 100), "ec": (10, 10), "personalreddit": (0.1, 0.1), "default": (0.1, 0.1)}


def enough_history(df: DataFrame, least: int, history: str = "history") -> DataFrame:
    """Users' rows with at least so many history items; a null history has none."""
    return df.where(F.coalesce(F.size(history), F.lit(0)) >= least)


def pick_users(users: DataFrame, n: int, seed: int = 42, few: int = 10_000) -> DataFrame:
    """A fixed random choice of n users (`user_id`): a few are a top-k of digests, more are cut off at their global position."""
    every = users.select("user_id").distinct()
    if n <= few:
        return every.orderBy(hash_order("user_id", seed=seed), "user_id").limit(n)
    return with_position(every, hash_order("user_id", seed=seed), "user_id", name="_at").where(F.col("_at") < n).select("user_id")


def user_split(rows: DataFrame, dataset: str = "default", user: str = "user_id", seed: int = 42, outlying: Callable[[DataFrame, int], DataFrame] | None = None) -> DataFrame:
    """Rows with a `split` by the policy of a data set: users held out at random, users out of distribution, and the rest.

    `outlying` chooses the out-of-distribution users (`user_id`) from the remaining ones; without it they are the users with
    the longest histories. Sets with fewer users than a fixed number hold out a fifth of them, one at least. Null users train.
    """
    users = user_counts(rows, user)
    n = users.count()
    take_random, take_ood = (int(x * n) if x < 1 else x if n >= x else max(1, 2 * n // 10) for x in HELD_OUT.get(dataset, HELD_OUT["default"]))
    random_users = pick_users(users, take_random, seed)
    rest = users.join(random_users, "user_id", "left_anti")
    ood = outlying(rest, take_ood) if outlying else rest.orderBy(F.desc("n"), "user_id").limit(take_ood).select("user_id")
    held = random_users.withColumn("split", F.lit("random_test")).unionByName(ood.withColumn("split", F.lit("ood_test")))
    named = users.select("user_id").join(held, "user_id", "left").select("user_id", F.coalesce("split", F.lit("train")).alias("split"))
    known = join_lookup(rows.drop("split").withColumnRenamed(user, "user_id"), named, "user_id")
    unknown = rows.drop("split").withColumnRenamed(user, "user_id").where("user_id is null").withColumn("split", F.lit("train"))
    return known.unionByName(unknown.select(known.columns)).withColumnRenamed("user_id", user)


def row_split(rows: DataFrame, n_test: int, key: str, seed: int = 42) -> DataFrame:
    """Rows with a `split`: n_test of them by digest test, the others train; a smaller table is tested as a whole."""
    placed = with_position(rows.drop("split"), hash_order(key, seed=seed), key, name="_at")
    return placed.withColumn("split", F.when(F.col("_at") < n_test, "random_test").otherwise("random_train")).drop("_at")


def ratio_split(rows: DataFrame, parts: int = 5, user: str = "user_id", seed: int = 42) -> DataFrame:
    """Rows with a `split` by user: one user of `parts`, one at least, tests. Null users train."""
    n = rows.where(F.col(user).isNotNull()).select(user).distinct().count()
    held = pick_users(rows.where(F.col(user).isNotNull()).select(F.col(user).alias("user_id")), max(1, n // parts), seed).select(F.col("user_id").alias(user))
    plain = rows.drop("split")
    test = join_lookup(plain, held, user, how="left_semi").withColumn("split", F.lit("random_test"))
    return test.unionByName(join_lookup(plain, held, user, how="left_anti").withColumn("split", F.lit("random_train")))


def question_split(rows: DataFrame, n_test: int = 250, n_train: int = 10_000, user: str = "user_id", key: str = "sample_idx", seed: int = 42) -> DataFrame:
    """Rows of two splits, others left out: one question each of n_test users tests; of other users as many questions each train as
    make up n_train, one at least. Choices go by digest; null users take no part."""
    known = rows.drop("split").where(F.col(user).isNotNull())
    total = known.select(user).distinct().count()
    test_users = pick_users(known.select(F.col(user).alias("user_id")), n_test, seed).select(F.col("user_id").alias(user))
    first = Window.partitionBy(user).orderBy(hash_order(key, seed=seed), key)
    share = max(1, n_train // max(1, total))
    # ranks above the share are cut off while they are built, so a hot user's rows are not all sorted
    test = join_lookup(known, test_users, user, how="left_semi").withColumn("_r", F.row_number().over(first)).where("_r = 1").withColumn("split", F.lit("random_test"))
    train = join_lookup(known, test_users, user, how="left_anti").withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= share).withColumn("split", F.lit("random_train"))
    return test.unionByName(train).drop("_r")


#: Data sets by their earlier split rule.
BY_ROW = ("lamp_citation", "lamp_tweet", "lamp_scholarly_title", "lamp_product", "longlamp_abstract_generation", "longlamp_product_review", "longlamp_topic_writing")
BY_RATIO = ("ec", "personalreddit")


def earlier_split(rows: DataFrame, dataset: str, key: str = "sample_idx", user: str = "user_id", seed: int = 42) -> DataFrame:
    """Rows with a `split` by the earlier rule of a data set: rows, one question per user, users five to one, or users by history."""
    if dataset in BY_ROW:
        return row_split(rows, 250, key, seed)
    if dataset == "opinionqa":
        return question_split(rows, user=user, key=key, seed=seed)
    if dataset in BY_RATIO:
        return ratio_split(rows, 5, user, seed)
    return user_split(rows, dataset, user, seed)


def embedding_of(index: Column, n: int, epoch: int | None = None, seed: int = 42) -> Column:
    """Which of a task's n embeddings a sample takes: its index by n in validation, a fixed random one in each training epoch."""
    if epoch is None:
        return F.pmod(index, F.lit(n))
    return F.pmod(F.conv(F.substring(hash_order(index, F.lit(epoch), seed=seed), 1, 8), 16, 10).cast("long"), F.lit(n))


def diverse_users(placed: DataFrame, n: int, cluster: str = "cluster", key: str = "key", seed: int = 42) -> DataFrame:
    """n members spread over the clusters in proportion to their size, by largest remainder."""
    rows = placed.select(F.col(cluster).alias("bucket"), F.col(key).alias("key"))
    takes = largest_remainder(rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("cap")), n)
    return pick_by_bucket(rows, takes, "key", seed).select(F.col("key").alias(key), F.col("bucket").alias(cluster))


def weighted_draws(weights: DataFrame, n: int, seed: int = 42, name: str = "source") -> DataFrame:
    """n draws of data sets with replacement by weight (`draw`, `name`): a hash of the draw falls into a range of the cumulated weights."""
    order = Window.orderBy(name)  # one row per data set
    ranges = weights.select(name, (F.sum("weight").over(order) - F.col("weight")).alias("lo"), F.sum("weight").over(order).alias("hi"))
    draws = weights.sparkSession.range(n).select(F.col("id").alias("draw"), hash_share("id", seed=seed).alias("at"))
    # the ranges, one per data set, lie in one array that each draw is looked up in
    table = ranges.agg(F.sort_array(F.collect_list(F.struct("hi", name))).alias("t")).select("t").scalar()
    return draws.withColumn("t", table).select("draw", F.coalesce(F.get(F.filter("t", lambda x: x["hi"] > F.col("at")), 0), F.element_at("t", -1))[name].alias(name))


def swap_sides(question: str = "question_id", seed: int = 42) -> Column:
    """Whether a pair is shown to a judge in swapped order, fixed by its question."""
    return F.pmod(F.conv(F.substring(hash_order(question, seed=seed), 1, 8), 16, 10).cast("long"), F.lit(2)) == 1
