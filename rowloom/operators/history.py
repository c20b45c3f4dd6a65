"""Operators on users' ordered histories: labels, queries, contexts, budgets."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowloom.functions.text import item_label, non_blank, one_decimal, render_item, token_estimate


def history_items(df: DataFrame, *keep: str) -> DataFrame:
    """One row per history item that is not null (`pos`: its place), with the columns of `keep`."""
    keep = keep or ("record_id", "user_id", "task")
    return df.select(*keep, F.posexplode("history").alias("pos", "item")).where("item is not null")


def running_sums(numbers: Column) -> Column:
    """Running sums of an array, by Arrow batches: linear, and without parting the row."""
    return _running(numbers)


@F.pandas_udf(T.ArrayType(T.LongType()))
def _running(numbers: pd.Series) -> pd.Series:
    return numbers.map(lambda a: np.cumsum(np.asarray(a, dtype=np.int64)), na_action="ignore")


def item_places(column: str = "history") -> Column:
    """Places of the items that are not null, in order."""
    return F.filter(F.transform(column, lambda x, i: F.when(x.isNotNull(), i.cast("long"))), lambda i: i.isNotNull())


def _item_numbers(number: Callable[[Column], Column], column: str = "history") -> Column:
    """A number of each item that is not null, in order."""
    return F.transform(F.filter(column, lambda x: x.isNotNull()), lambda x: number(x).cast("long"))


def label_distribution(df: DataFrame) -> DataFrame:
    """Per record the counts of its history's labels as text: `total=N | label=count (p.p%), …`, frequent labels first.

    Labels are trimmed; null and blank ones do not count. Ties come in label order. Records without labels give no row. All of
    it happens within the row.
    """
    labels = df.select("record_id", F.filter(F.transform("history", lambda x: item_label(x, F.col("task"))), lambda x: x.isNotNull()).alias("labels")).where(F.size("labels") > 0)
    counts = F.transform(F.array_distinct("labels"), lambda d: F.struct((-F.size(F.filter("labels", lambda x: x == d))).alias("m"), d.alias("label")))
    total = F.size("labels")
    entry = lambda x: F.concat(x["label"], F.lit("="), (-x["m"]).cast("string"), F.lit(" ("), one_decimal(F.lit(-100.0) * x["m"] / total), F.lit("%)"))
    return labels.select("record_id", F.concat(F.lit("total="), total.cast("string"), F.lit(" | "), F.array_join(F.transform(F.sort_array(counts), entry), ", ")).alias("label_distribution"))


def explode_queries(df: DataFrame) -> DataFrame:
    """One row per query with its place and question id; the gold answer is the first non-blank of gold and output."""
    rows = df.select("record_id", "user_id", "task", F.posexplode("query").alias("pos", "q")).where("q is not null")
    return rows.select(
        "record_id", F.col("pos").cast("long").alias("pos"), F.concat_ws("_", F.col("task"), F.col("user_id"), F.lit("query"), F.col("pos").cast("string")).alias("question_id"), F.col("q.input").alias("input"), non_blank("q.gold", "q.output").alias("gold")
    )


def prefix_contexts(df: DataFrame) -> DataFrame:
    """For each item the items before it: their number, rendered length and estimated tokens (running sums, no lists)."""
    chars = _item_numbers(lambda x: F.coalesce(F.length(render_item(x, F.col("task"))), F.lit(0)))
    rows = df.select("record_id", item_places().alias("at"), chars.alias("chars")).where(F.size("at") > 0).withColumn("sums", running_sums(F.col("chars")))
    items = rows.select("record_id", F.inline(F.transform("at", lambda p, i: F.struct(p.alias("pos"), i.cast("long").alias("n_before"), (F.get("sums", i) - F.get("chars", i)).alias("chars_before")))))
    return items


def round_robin(df: DataFrame, visits: int = 50) -> DataFrame:
    """Items in turns: each record's newest first, at most `visits` of a record, the first item (which has no context) left out."""
    turns = F.transform("at", lambda p, i: F.struct(p.alias("pos"), (F.size("at") - i).cast("long").alias("turn")))
    return df.select("record_id", item_places().alias("at")).select("record_id", F.inline(F.filter(turns, lambda t: (t["pos"] >= 1) & (t["turn"] <= visits))))


def _tokens(df: DataFrame) -> DataFrame:
    return df.select("record_id", item_places().alias("at"), _item_numbers(lambda x: token_estimate(render_item(x, F.col("task")))).alias("tokens")).where(F.size("at") > 0)


def keep_recent(df: DataFrame, tokens: int, share: float = 0.9) -> DataFrame:
    """The newest items whose rendered text fits into a share of the token budget: older ones are dropped from the front."""
    kept = _tokens(df).withColumn("used", F.filter(running_sums(F.reverse("tokens")), lambda u: u <= F.lit(tokens * share))).where(F.size("used") > 0)
    n = F.size("used")
    return kept.select("record_id", n.cast("long").alias("n_kept"), F.get("at", F.size("at") - n).alias("first_pos"), F.get("used", n - 1).alias("tokens"))


def pack_until_full(df: DataFrame, tokens: int) -> DataFrame:
    """The first items of a record up to, without, the first that would exceed the token budget."""
    kept = _tokens(df).withColumn("used", F.filter(running_sums(F.col("tokens")), lambda u: u <= F.lit(tokens))).where(F.size("used") > 0)
    return kept.select("record_id", F.size("used").cast("long").alias("n_packed"), F.get("used", F.size("used") - 1).alias("tokens"))


def recent_profile(df: DataFrame, last: int = 20, cap: int = 4000) -> DataFrame:
    """A profile text from the newest `last` items in their order, cut behind `cap` characters. Records without items have none."""
    shown = F.filter(F.transform("history", lambda x: render_item(x, F.col("task"))), lambda x: x.isNotNull())
    texts = F.slice(shown, F.greatest(F.size(shown) - last + 1, F.lit(1)), last)
    body = F.concat(F.lit("Recent User Activity:\n"), F.array_join(texts, " || "))
    return df.where(F.size(F.coalesce(shown, F.array().cast("array<string>"))) > 0).select("record_id", F.when(F.length(body) > cap, F.concat(F.substring(body, 1, cap), F.lit("..."))).otherwise(body).alias("profile"))


def item_keys(df: DataFrame, first: int = 10) -> DataFrame:
    """How often each field is filled among the first items of a record's history (`task`, `field`, `n`)."""
    fields = df.schema["history"].dataType.elementType.names
    items = history_items(df).where(F.col("pos") < first)
    filled = F.explode(F.filter(F.array(*[F.when(non_blank(F.col("item")[f]).isNotNull(), F.lit(f)) for f in fields]), lambda x: x.isNotNull())).alias("field")
    return items.select("task", filled).groupBy("task", "field").agg(F.count(F.lit(1)).alias("n"))


def history_length(column: Column | str = "history") -> Column:
    """Number of items; a null history has none."""
    return F.coalesce(F.size(column), F.lit(0))


def latest_delivery(df: DataFrame) -> DataFrame:
    """The last delivery of each user and task (by time, then record); null users are kept as they are."""
    last = Window.partitionBy("user_id", "task").orderBy(F.desc("received_at"), F.desc("record_id"))
    known = df.where("user_id is not null").withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n")
    return known.unionByName(df.where("user_id is null"))  # null users meet in no sort
