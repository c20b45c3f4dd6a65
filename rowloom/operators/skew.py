"""Per-key results where a few keys hold most rows: two-stage salted aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowloom.session import durable


def clean_id(column: Column) -> Column:
    """An id for comparison: lower case without outer white space; null and blank ids become null."""
    return F.nullif(F.lower(F.regexp_replace(column, r"(?U)^\s+|\s+$", "")), F.lit(""))


def key_counts(df: DataFrame, key: Column) -> DataFrame:
    """Rows per key (`key`, `n_rows`), null keys included.

    Counts are combined within each input partition before the shuffle, so a hot key moves one row per partition.
    """
    return df.groupBy(key.alias("key")).agg(F.count(F.lit(1)).alias("n_rows"))


def heavy_keys(df: DataFrame, key: Column, share: float) -> DataFrame:
    """Keys that hold at least `share` of all rows (`key`, `n_rows`, `n_all`).

    The share is taken of all rows, those with a null key included; a null key is never heavy.
    At most 1/share keys can qualify, so the result is bounded whatever the size of the table.
    An empty table gives no row.
    """
    counts = key_counts(df, key)
    total = counts.agg(F.sum("n_rows")).scalar()  # a subquery that runs once
    # a hair less than the product, which as a double can come out above a whole number
    return counts.withColumn("n_all", total).where(F.col("key").isNotNull() & (F.col("n_rows") >= F.lit(share * (1 - 1e-12)) * F.col("n_all")))


def join_lookup(rows: DataFrame, lookup: DataFrame, key: str, share: float = 0.01, how: str = "inner", hot: DataFrame | None = None) -> DataFrame:
    """Join of `rows` with `lookup`, which has one row per key, without a task that gets a hot key's rows.

    Keys holding at least `share` of the rows are found first (at most 1/share of them) or given as `hot` (`key`); their
    lookup rows are broadcast and joined where the rows lie. All other rows are shuffled by the key. `how`: inner, left,
    left_semi or left_anti; null keys join nothing.
    """
    hot = heavy_keys(rows, F.col(key), share) if hot is None else hot
    hot = F.broadcast(hot.select(F.col("key").alias(key)))
    hot_lookup = F.broadcast(lookup.join(hot, key, "left_semi"))  # at most 1/share rows: one per hot key
    cold = rows.join(hot, key, "left_anti").join(lookup, key, how)
    hot_rows = rows if how in ("inner", "left_semi") else rows.join(hot, key, "left_semi")
    joined = hot_rows.join(hot_lookup, key, how)
    return joined.select(cold.columns).unionByName(cold)


def join_small(rows: DataFrame, lookup: DataFrame, key: str, limit: int = 10_000) -> DataFrame:
    """Inner join of `rows` with `lookup`, which has one row per key and is expected to be small.

    The lookup is written once and counted: up to `limit` rows are broadcast, so `rows` stay where they are; a larger one is
    joined by `join_lookup`.
    """
    lookup = durable(lookup)
    if lookup.count() <= limit:
        return rows.join(F.broadcast(lookup), key)
    return join_lookup(rows, lookup, key)


def salted_user_stats(df: DataFrame, key: str = "user_id", question: str = "question_id", answer: str = "output", share: float = 0.005, salts: int = 64) -> DataFrame:
    """Per key: records, distinct questions and answer lengths, with evenly spread work.

    Stage 1 salts the rows of heavy keys (those holding at least `share` of all rows; at most 1/share of them, so their
    list is broadcast safely) by a hash of the question, and aggregates per (key, salt). All rows of one question get one
    salt, so the distinct counts of the salts add up exactly. Other keys keep the single salt 0. Stage 2 merges the partial
    results, at most `salts` rows per key.

    Keys and questions are compared without case and outer blanks. Null or blank keys give no row, null questions count
    as no question, a null answer counts as a record without a length. Repeated rows count as often as they appear. An
    empty table gives an empty result. Other columns are ignored.
    """
    rows = df.select(
        clean_id(F.col(key)).alias("key"),
        clean_id(F.col(question)).alias("question"),
        F.length(F.col(answer)).cast("long").alias("len"),
    )
    heavy = F.broadcast(heavy_keys(rows, F.col("key"), share).select("key", F.lit(True).alias("hot")))
    # rows without a question are spread by their answer length instead: they add to no distinct count
    spread = F.pmod(F.xxhash64(F.coalesce(F.col("question"), F.col("len").cast("string"))), F.lit(salts)).cast("int")
    salted = (
        rows.where(F.col("key").isNotNull())
        .join(heavy, "key", "left")
        .withColumn("salt", F.when(F.col("hot"), spread).otherwise(F.lit(0)))
    )
    # per question first: the distinct count needs no set of a whole key in one place
    per_question = salted.groupBy("key", "salt", "question").agg(
        F.count(F.lit(1)).alias("n"),
        F.count("len").alias("n_len"),
        F.sum("len").alias("sum_len"),
        F.min("len").alias("min_len"),
        F.max("len").alias("max_len"),
    )
    partial = per_question.groupBy("key", "salt").agg(
        F.sum("n").alias("n"),
        F.count("question").alias("n_questions"),
        F.sum("n_len").alias("n_len"),
        F.sum("sum_len").alias("sum_len"),
        F.min("min_len").alias("min_len"),
        F.max("max_len").alias("max_len"),
    )
    return partial.groupBy(F.col("key").alias("user_id")).agg(
        F.sum("n").cast("long").alias("n_records"),
        F.sum("n_questions").cast("long").alias("n_questions"),
        F.sum("n_len").cast("long").alias("n_answers"),
        F.coalesce(F.sum("sum_len"), F.lit(0)).cast("long").alias("answer_chars"),
        F.min("min_len").alias("answer_min"),
        F.max("max_len").alias("answer_max"),
    )
