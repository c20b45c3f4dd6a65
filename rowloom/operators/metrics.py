"""Scores of predictions and of runs."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowloom.operators.order import with_position


def accuracy(correct: Column) -> Column:
    return F.avg(correct.cast("double"))


def rating_scores(df: DataFrame, predicted: Column, target: Column, *by: str) -> DataFrame:
    """MAE, RMSE and 1 - MAE/5 over the rows whose prediction could be read; 0 where none could."""
    rows = df.select(*by, predicted.alias("p"), target.alias("t"))
    gap = F.when(F.col("p").isNotNull() & F.col("t").isNotNull(), F.abs(F.col("p") - F.col("t")))
    return rows.groupBy(*by).agg(
        F.count(gap).alias("n_read"), F.coalesce(F.avg(gap), F.lit(0.0)).alias("mae"), F.coalesce(F.sqrt(F.avg(gap * gap)), F.lit(0.0)).alias("rmse"), F.coalesce(1 - F.avg(gap) / 5, F.lit(0.0)).alias("stsb")
    )


def classification_scores(df: DataFrame, predicted: Column, target: Column) -> DataFrame:
    """Accuracy and F1 weighted by the targets' support; labels without a true or predicted row count 0."""
    rows = df.select(predicted.alias("p"), target.alias("t")).where("t is not null").withColumn("hit", F.coalesce(F.col("p") == F.col("t"), F.lit(False)))
    # one row per label from each side: no label meets another
    sides = rows.select(F.col("t").alias("label"), F.col("hit").cast("int").alias("tp"), F.lit(1).alias("support"), F.lit(0).alias("said")).unionByName(
        rows.where("p is not null").select(F.col("p").alias("label"), F.lit(0).alias("tp"), F.lit(0).alias("support"), F.lit(1).alias("said"))
    )
    per_label = sides.groupBy("label").agg(F.sum("tp").alias("tp"), F.sum("support").alias("support"), F.sum("said").alias("said"))
    f1 = F.coalesce(F.try_divide(2.0 * F.col("tp"), F.col("support") + F.col("said")), F.lit(0.0))
    return per_label.agg(
        F.sum("support").cast("long").alias("n"), F.coalesce(F.try_divide(F.sum("tp").cast("double"), F.sum("support")), F.lit(0.0)).alias("accuracy"), F.coalesce(F.try_divide(F.sum(f1 * F.col("support")), F.sum("support")), F.lit(0.0)).alias("f1_weighted")
    )


def grouped_accuracy(df: DataFrame, correct: str, *dims: str) -> DataFrame:
    """Accuracy in total and by each dimension alone, in one pass (`metric`, `n`, `acc`)."""
    columns = [F.col(d) for d in dims]
    name = F.lit("acc_total")
    for d in dims:
        own = F.lower(F.replace(F.concat(F.lit(f"acc_{d}_"), F.coalesce(F.col(d), F.lit("none"))), F.lit(" "), F.lit("_")))
        name = F.when(F.grouping(d) == 0, own).otherwise(name)
    sets = df.groupingSets([[], *[[c] for c in columns]], *columns)
    return sets.agg(name.alias("metric"), F.count(F.lit(1)).alias("n"), F.avg(F.col(correct).cast("double")).alias("acc")).select("metric", "n", "acc")


def pass_at_k(df: DataFrame, task: str, ok: str, ks: tuple[int, ...] = (1, 10, 100)) -> DataFrame:
    """Unbiased pass@k, averaged over the tasks with at least k completions (`k`, `n_tasks`, `pass_at_k`)."""
    per_task = df.groupBy(task).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(ok).cast("int")).alias("c"))
    rows = per_task.select("n", "c", F.explode(F.array(*[F.lit(k) for k in ks])).alias("k")).where("n >= k")
    miss = F.when(F.col("n") - F.col("c") < F.col("k"), F.lit(0.0)).otherwise(
        F.aggregate(F.filter(F.sequence(F.col("n") - F.col("c") + 1, F.col("n") + 1), lambda i: i <= F.col("n")), F.lit(1.0), lambda a, i: a * (1 - F.col("k") / i))
    )
    return rows.withColumn("p", 1 - miss).groupBy("k").agg(F.count(F.lit(1)).alias("n_tasks"), F.avg("p").alias("pass_at_k"))


def mean_loss(df: DataFrame, loss: str, tokens: str, *by: str) -> DataFrame:
    """Loss per token: the ratio of the sums, not the mean of the ratios."""
    return df.groupBy(*by).agg(F.try_divide(F.sum(loss), F.sum(tokens)).alias("nll"))


def spread(df: DataFrame, value: str, *by: str) -> DataFrame:
    """Mean, largest, smallest, median, population deviation and total of a measure; null values do not count.

    The exact median is read off at global positions in the order of group and value, so no task holds a group.
    """
    rows = df.where(F.col(value).isNotNull())
    stats = rows.groupBy(*by).agg(F.avg(value).alias("avg"), F.max(value).alias("max"), F.min(value).alias("min"), F.stddev_pop(value).alias("std"), F.sum(value).alias("total"))
    placed = with_position(rows.select(*by, value), *by, value, name="_at")
    ends = placed.groupBy(*by).agg(F.min("_at").alias("_lo"), F.max("_at").alias("_hi"))
    same = F.lit(True)
    for c in by:
        same = same & F.col(f"p.{c}").eqNullSafe(F.col(f"e.{c}"))
    middle = placed.alias("p").join(ends.alias("e"), same).where(F.col("_at").between(F.floor((F.col("_lo") + F.col("_hi")) / 2), F.ceil((F.col("_lo") + F.col("_hi")) / 2)))
    median = middle.groupBy(*[F.col(f"e.{c}").alias(c) for c in by]).agg(F.avg(F.col(f"p.{value}")).alias("median"))
    joined = stats.alias("s").join(median.alias("m"), reduce(lambda a, c: a & F.col(f"s.{c}").eqNullSafe(F.col(f"m.{c}")), by, F.lit(True)))
    return joined.select(*[F.col(f"s.{c}").alias(c) for c in by], "avg", "max", "min", "median", "std", "total")


def table_checksum(df: DataFrame, *by: str) -> DataFrame:
    """Checksum per group that does not depend on row order: the digest of the sorted row digests.

    A group is one small table, as the definition needs all its row digests (5 characters each) at once; for a large table
    use `large_checksum`.
    """
    row = F.substring(F.md5(F.concat_ws(",", *[F.col(c).cast("string") for c in df.columns])), 1, 5)
    return df.select(*by, row.alias("d")).groupBy(*by).agg(F.md5(F.concat_ws(",", F.sort_array(F.collect_list("d")))).alias("checksum"))


def large_checksum(df: DataFrame) -> DataFrame:
    """Checksum of a table of any size that does not depend on row order: sums of row hashes, combined before the shuffle."""
    return df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")), F.lit(0)).cast("string").alias("checksum"))


def judge_tally(df: DataFrame, winner: Column) -> DataFrame:
    """Wins, ties and win rates in percent of a pairwise comparison; null verdicts count as ties."""
    rows = df.select(F.coalesce(winner, F.lit("tie")).alias("w"))
    a, b, n = F.count_if(F.col("w") == "a"), F.count_if(F.col("w") == "b"), F.count(F.lit(1))
    rate = lambda x, y: F.round(100.0 * x / F.greatest(F.lit(1), y), 4)
    return rows.agg(a.alias("wins_a"), b.alias("wins_b"), (n - a - b).alias("ties"), rate(a, n).alias("rate_a"), rate(b, n).alias("rate_b"), rate(a, a + b).alias("rate_a_decided"), rate(b, a + b).alias("rate_b_decided"))


def word_set_meteor(a: Column, b: Column) -> Column:
    """10PR/(9P+R) over the sets of lowered words of a generated and a reference text; 0 where they share none."""
    x, y = F.array_distinct(F.split(F.lower(a), " ")), F.array_distinct(F.split(F.lower(b), " "))
    both = F.size(F.array_intersect(x, y)).cast("double")
    p, r = F.try_divide(both, F.size(x)), F.try_divide(both, F.size(y))
    return F.coalesce(F.try_divide(10 * p * r, 9 * p + r), F.lit(0.0))


def unigram_rouge(df: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """ROUGE-1 precision, recall and F of two texts per row, by multisets of lowered words; relational, without a UDF."""
    words = lambda c: F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+"), lambda w: w != "")
    base = df.select(key, words(F.col(a)).alias("x"), words(F.col(b)).alias("y"))
    counts = lambda c, n: base.select(key, F.explode(c).alias("w")).groupBy(key, "w").agg(F.count(F.lit(1)).alias(n))
    shared = counts("x", "nx").join(counts("y", "ny"), [key, "w"]).groupBy(key).agg(F.sum(F.least("nx", "ny")).alias("s"))
    rows = base.select(key, F.size("x").alias("lx"), F.size("y").alias("ly")).join(shared, key, "left").withColumn("s", F.coalesce("s", F.lit(0)).cast("double"))
    p, r = F.coalesce(F.try_divide("s", "lx"), F.lit(0.0)), F.coalesce(F.try_divide("s", "ly"), F.lit(0.0))
    return rows.select(key, p.alias("p"), r.alias("r"), F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)).alias("f"))


def longest_rouge(df: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """ROUGE-L precision, recall and F per row: the longest common subsequence of lowered words, bit-parallel in batches."""

    def common(x: list[str], y: list[str]) -> int:
        place: dict[str, int] = {}
        for i, w in enumerate(x):
            place[w] = place.get(w, 0) | 1 << i
        full = (1 << len(x)) - 1
        row = full
        for w in y:
            hit = row & place.get(w, 0)
            row = (row + hit | row - hit) & full
        return len(x) - row.bit_count()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for k, s, t in zip(batch["key"], batch["a"], batch["b"]):
                x, y = s.split(), t.split()
                n = common(x, y) if x and y else 0
                p, r = (n / len(x) if x else 0.0), (n / len(y) if y else 0.0)
                out.append((k, p, r, 2 * p * r / (p + r) if n else 0.0))
            yield pd.DataFrame(out, columns=["key", "p", "r", "f"])

    clean = lambda c: F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", " "))
    rows = df.select(F.col(key).alias("key"), clean(F.col(a)).alias("a"), clean(F.col(b)).alias("b"))
    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInPandas(run, f"key {kind}, p double, r double, f double").withColumnRenamed("key", key)
