"""Putting training and evaluation sets together: users' records, retrieved profiles, validation parts, descriptions, mixtures."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rowloom.functions.text import strip, token_estimate
from rowloom.functions.vectors import end_points, simplex_points
from rowloom.operators.order import with_position
from rowloom.operators.retrieval import bm25_in_row
from rowloom.operators.sampling import hash_order
from rowloom.operators.skew import join_small
from rowloom.sources.files import resolve_version

#: Splits a curated data set may have, by folder layout.
CURATED_SPLITS = {"v2": ("train", "random_test", "ood_test"), "v3": ("train", "random_test", "ood_test", "ood_train", "random_train")}
#: What parts joined retrievals, and the share of the budget that they may take.
RETRIEVED_BREAK, RETRIEVED_SHARE = "\n\n", 0.9
#: Names of tasks that are left out.
LEFT_OUT = "lol_"


def user_chunks(df: DataFrame, user: str, order: str, size: int = 1000) -> DataFrame:
    """Users' records in order, in chunks of at most `size` (`user`, `chunk`, `records`): no user's records are held at once.

    A user with few records has one chunk. Null users are left out.
    """
    placed = with_position(df.where(F.col(user).isNotNull()).select(user, order), user, order, name="_at")
    first = placed.groupBy(user).agg(F.min("_at").alias("_first"))
    chunk = F.floor((F.col("_at") - F.col("_first")) / size).cast("long")
    return join_small(placed, first, user).groupBy(user, chunk.alias("chunk")).agg(F.sort_array(F.collect_list(order)).alias("records"))


def retrieved_profiles(df: DataFrame, group: str, docs: str, queries: str, ks: tuple[int, ...], budget: int) -> DataFrame:
    """For each query of a row the texts of its k best documents as one profile per k (`grp`, `qid`, `profile_retrieval_k…`).

    One document stands as it is, several are parted by blank lines; a profile of more tokens than the budget is cut at a share of it.
    """
    best = bm25_in_row(df, group, docs, queries, (max(ks),)).withColumnRenamed(f"top_k{max(ks)}", "_best")
    joined = best.join(df.select(F.col(group).alias("grp"), F.col(docs).alias("_docs")), "grp")  # a row per group
    places = F.transform(F.split("_best", ","), lambda p: p.cast("int"))
    room = int(RETRIEVED_SHARE * budget) * 4

    def profile(k: int) -> Column:
        text = F.array_join(F.transform(F.slice(places, 1, k), lambda p: F.get("_docs", p)), RETRIEVED_BREAK)
        return F.when(token_estimate(text) > budget, F.concat(F.substring(text, 1, room), F.lit("..."))).otherwise(text).alias(f"profile_retrieval_k{k}")

    return joined.select("grp", "qid", *[profile(k) for k in ks])


def asked_with_answer(question: Column, answer: Column) -> Column:
    """The query text of a retrieval that looks for a question together with its known answer."""
    return F.concat_ws(" ", question, answer)


def validation_parts(df: DataFrame, order: str, share: float = 0.9) -> DataFrame:
    """Rows with a `part`: the first share of them in order trains, the rest validates."""
    n = df.count()
    placed = with_position(df, order, name="_at")
    return placed.withColumn("part", F.when(F.col("_at") < int(n * share), "train").otherwise("validation")).drop("_at")


def concatenated(*parts: DataFrame) -> DataFrame:
    """All rows of several data sets; columns that one lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def wanted_tasks(df: DataFrame, only: tuple[str, ...] = (), task: str = "task") -> DataFrame:
    """Rows of the wanted tasks, of all if none are named, without those that are always left out."""
    kept = df.where(~F.startswith(F.col(task), F.lit(LEFT_OUT)))
    return kept.where(F.col(task).isin(*only)) if only else kept


def pointwise_mean(score: Column) -> Column:
    """Mean of a judge's scores; 0 where none could be read."""
    return F.coalesce(F.avg(score), F.lit(0.0))


def attach_by_place(results: DataFrame, completions: DataFrame, task: str, place: str) -> DataFrame:
    """Results of each task with the completion of the same place, in order of task and place; a task's id meets its own only."""
    return results.join(completions, [task, place])


def profile_source(df: DataFrame, profile: str = "profile_text", prompt: str = "input") -> Column:
    """What a data set's embedding is made of: the profile text if any row has one, else the prompt up to its first blank line.

    Looks for one filled profile, not at all rows.
    """
    has = profile in df.columns and not df.where(F.coalesce(strip(profile), F.lit("")) != "").limit(1).isEmpty()
    return F.coalesce(strip(profile), F.lit("")) if has else F.split_part(F.col(prompt), F.lit("\n\n"), F.lit(1))


def description_picks(descriptions: DataFrame, others: int = 3, seed: int = 42) -> DataFrame:
    """Descriptions that each data set is tried with (`dataset`, `kind`, `source`, `text`): one of its own, all evaluation ones, and one each of up
    to `others` other data sets, chosen by digest.

    descriptions: `dataset`, `text`, `eval` (whether it is kept for evaluation). Sets are few; of each other set a single row meets a set.
    """
    rows = descriptions.withColumn("_h", hash_order("dataset", "text", seed=seed))
    one = rows.where("not eval").groupBy("dataset").agg(F.min_by("text", "_h").alias("text"))
    own = one.select("dataset", F.lit("own").alias("kind"), F.col("dataset").alias("source"), "text")
    tested = rows.where("eval").select("dataset", F.lit("eval").alias("kind"), F.col("dataset").alias("source"), "text")
    # every set's one row in one array, from which each set takes the others with the least digests
    table = one.agg(F.sort_array(F.collect_list(F.struct("dataset", "text"))).alias("t")).select("t").scalar()
    mark = lambda x: F.md5(F.concat_ws("|", F.col("dataset"), x["dataset"], F.lit(str(seed))))
    rest = F.transform(F.filter("t", lambda x: x["dataset"] != F.col("dataset")), lambda x: F.struct(mark(x).alias("h"), x["dataset"].alias("source"), x["text"].alias("text")))
    picked = one.select("dataset").withColumn("t", table).select("dataset", F.explode(F.slice(F.sort_array(rest), 1, others)).alias("x")).select("dataset", F.lit("other").alias("kind"), "x.source", "x.text")
    return reduce(DataFrame.unionByName, [own, tested, picked])


def task_mixtures(task: int, size: int, other: int, mixes: int = 3, seed: int = 42) -> list[tuple[str, list[float]]]:
    """Mixing weights a task is tried with: its own, another task's, and random mixtures of all."""
    ends = end_points(size)
    return [("own", ends[task]), ("other", ends[other])] + [(f"mix{k}", p) for k, p in enumerate(simplex_points(mixes, size, seed))]


def chat_fields(metadata: DataFrame, values: dict[str, Column]) -> DataFrame:
    """Task configurations with their system, user and assistant texts, `{name}` placeholders replaced in all three."""

    def fill(column: str) -> Column:
        out = F.coalesce(F.col(column), F.lit(""))
        for name, value in values.items():
            out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(value, F.lit("")))
        return out

    return metadata.select("task_name", fill("system_message").alias("system"), fill("user_prompt_template").alias("user"), fill("assistant_prefill").alias("assistant"))


def recovered_checkpoint(log: DataFrame, loss: str = "loss", failed: str = "failed", step: str = "step") -> DataFrame:
    """The checkpoint of the least loss among those that did not fail; of equal ones the earlier."""
    return log.where(~F.coalesce(F.col(failed), F.lit(False)) & F.col(loss).isNotNull()).orderBy(loss, step).limit(1)


def curated(spark: SparkSession, folder: str, split: str, version: str = "auto") -> DataFrame:
    """Rows of one split of a versioned data set with their `task` from the file's name; raises for a version or split that is not there."""
    found = resolve_version(spark, folder, version)
    if found is None:
        raise ValueError(f"no version {version!r} in {folder!r}")
    path, layout = found
    if split not in CURATED_SPLITS[layout]:
        raise ValueError(f"no split {split!r} in layout {layout}")
    rows = spark.read.json(f"{path}/*_{split}.jsonl")
    name = F.regexp_replace(F.element_at(F.split(F.input_file_name(), "/"), -1), r"\.jsonl$", "")
    return rows.withColumn("task", F.regexp_replace(name, f"_{split}$", "")).withColumn("split", F.lit(split))
