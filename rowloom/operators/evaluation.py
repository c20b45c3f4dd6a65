"""Evaluation: samples from rows and task configurations, scores by the kind of a task, and the contracts that plug in."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowloom.functions import answers as an
from rowloom.functions import matching
from rowloom.functions.names import task_kind
from rowloom.functions.text import strip
from rowloom.operators.metrics import word_set_meteor

#: Parts of task names by the way they are evaluated, in order.
KINDS = [
    ("generation", ("lamp_scholarly_title", "lamp_tweet", "lamp_news_headline", "longlamp_abstract_generation", "longlamp_product_review", "longlamp_topic_writing")),
    ("rating", ("lamp_product", "lamp_3")),
    ("classification", ("lamp_movie", "lamp_citation", "lamp_news_cat")),
]
#: Problem formats that no rule can score.
UNSCORED = ("Fill-in-the-blank", "Open-ended")


def evaluation_kind(task: Column, template: Column | None = None, path: Column | None = None) -> Column:
    """How a task is evaluated: a task without a prompt template as a conversation, else by its path and name; `qa` for the others."""
    name = F.lower(task)
    parts = F.split(F.lower(F.coalesce(path if path is not None else task, F.lit(""))), "[/_-]")
    case = F.when(F.lit(False), "conversation") if template is None else F.when(template.isNull(), "conversation")
    case = case.when(F.arrays_overlap(parts, F.array(F.lit("personalreddit"), F.lit("ec"))), "generation").when(F.contains(name, F.lit("opinionqa")), "classification")
    for kind, names in KINDS:
        case = case.when(reduce(lambda a, b: a | b, [F.contains(name, F.lit(n)) for n in names]), kind)
    return case.otherwise("qa")


def build_samples(rows: DataFrame, config: DataFrame, context: str = "", field: str = "input") -> DataFrame:
    """Evaluation samples of rows and their task's configuration, joined by source and split (`sample_idx`, `task_name`, `kind`,
    `prompt`, `reference`, `user_profile`, `user_id`, `question_id`).

    The template's `{input}` is filled in behind an optional shared context; a missing answer reads `None`; the profile is the
    profile text, else the rendered history. The configuration has one row per task, and is sized before it is broadcast.
    """
    dims = config.select(F.col("source").alias("_s"), F.col("split").alias("_p"), "task_name", "user_prompt_template")
    small = dims.count() <= 10_000
    joined = rows.join(F.broadcast(dims) if small else dims, (F.col("source") == F.col("_s")) & (F.col("split") == F.col("_p")))
    prompt = F.replace(F.coalesce("user_prompt_template", F.lit("{input}")), F.lit("{input}"), F.coalesce(F.col(field), F.lit("")))
    if context:
        prompt = F.concat(F.lit(context + "\n\n"), prompt)
    profile = F.coalesce(F.nullif("profile_text", F.lit("")), "profile_all_history", F.lit(""))
    return joined.select("sample_idx", "task_name", evaluation_kind(F.col("task_name"), F.col("user_prompt_template")).alias("kind"), prompt.alias("prompt"), F.coalesce(F.col("output"), F.lit("None")).alias("reference"), profile.alias("user_profile"), "user_id", "question_id")


def zip_outputs(samples: DataFrame, outputs: DataFrame, index: str = "sample_idx") -> DataFrame:
    """Samples with the outputs of the same index; raises when executed unless there are as many of both."""
    n, m = samples.agg(F.count(F.lit(1))).scalar(), outputs.agg(F.count(F.lit(1))).scalar()
    return samples.join(outputs, index).where(F.assert_true(n == m, F.lit("samples and outputs differ in number")).isNull())


def by_text(rows: DataFrame, known: DataFrame, text: str, other: str) -> DataFrame:
    """Rows with what is known under exactly the same text, joined by digest and compared in full; rows without it stay."""
    left = rows.withColumn("_h", F.sha2(F.coalesce(F.col(text), F.lit("")), 256))
    right = known.withColumn("_k", F.sha2(F.coalesce(F.col(other), F.lit("")), 256)).withColumnRenamed(other, "_text")
    return left.join(right, (F.col("_h") == F.col("_k")) & (F.coalesce(F.col(text), F.lit("")) == F.coalesce("_text", F.lit(""))), "left").drop("_h", "_k", "_text")


def task_metrics(df: DataFrame, task: str = "task", predicted: str = "predicted", target: str = "target") -> DataFrame:
    """Scores of each task by its kind (`task`, `kind`, `metric`, `value`); rows without a target do not count.

    Classification: accuracy and F1 weighted by support, over lowered and trimmed texts. Rating: MAE and RMSE over the rows that
    can be read, 0 where none can. Generation: means of METEOR over word sets and of accuracy. All kinds pass the rows once
    each and combine before the shuffle.
    """
    bare = lambda c: F.lower(strip(c))
    rows = df.where(F.coalesce(F.col(target), F.lit("")) != "").select(F.col(task).alias("task"), task_kind(F.col(task)).alias("kind"), F.col(predicted).alias("p"), F.col(target).alias("t"))
    labels = rows.where("kind = 'classification'").select("task", "kind", bare("p").alias("p"), bare("t").alias("t"))
    hit = F.coalesce(F.col("p") == F.col("t"), F.lit(False)).cast("int")
    sides = labels.select("task", "kind", F.col("t").alias("label"), hit.alias("tp"), F.lit(1).alias("support"), F.lit(0).alias("said")).unionByName(
        labels.where("p is not null").select("task", "kind", F.col("p").alias("label"), F.lit(0).alias("tp"), F.lit(0).alias("support"), F.lit(1).alias("said"))
    )
    per_label = sides.groupBy("task", "kind", "label").agg(F.sum("tp").alias("tp"), F.sum("support").alias("support"), F.sum("said").alias("said"))
    f1 = F.coalesce(F.try_divide(2.0 * F.col("tp"), F.col("support") + F.col("said")), F.lit(0.0))
    n = F.sum("support")
    classes = per_label.groupBy("task", "kind").agg(F.try_divide(F.sum("tp").cast("double"), n).alias("accuracy"), F.try_divide(F.sum(f1 * F.col("support")), n).alias("f1_weighted"))
    gap = F.abs(an.numeric_value(F.col("p")) - an.numeric_value(F.col("t")))
    rated = rows.where("kind = 'rating'").groupBy("task", "kind").agg(F.coalesce(F.avg(gap), F.lit(0.0)).alias("mae"), F.coalesce(F.sqrt(F.avg(gap * gap)), F.lit(0.0)).alias("rmse"))
    told = rows.where("kind = 'generation'").groupBy("task", "kind").agg(
        F.avg(word_set_meteor(F.coalesce("p", F.lit("")), F.col("t"))).alias("meteor"), F.avg(matching.accuracy(F.coalesce("p", F.lit("")), F.col("t"))).alias("accuracy")
    )
    return reduce(DataFrame.unionByName, [x.unpivot(["task", "kind"], x.columns[2:], "metric", "value") for x in (classes, rated, told)])


@dataclass(frozen=True)
class Evaluation:
    """A pluggable evaluation: `prepare` makes scored rows of samples with outputs, `aggregate` makes metrics of scored rows."""

    prepare: Callable[[DataFrame], DataFrame]
    aggregate: Callable[[DataFrame], DataFrame]

    def __call__(self, samples: DataFrame, answer: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """Metrics of the answers that a model, itself a function from frames to frames, gives to the samples."""
        return self.aggregate(self.prepare(answer(samples)))


def scored_by(metric: str, generated: str = "output", target: str = "reference", by: str = "task_name") -> Evaluation:
    """The evaluation by a metric of the registry: its mean per task (`by`, `n`, `value`)."""
    return Evaluation(
        lambda df: df.withColumn("score", matching.score(metric, F.col(generated), F.col(target))), lambda df: df.groupBy(by).agg(F.count("score").alias("n"), F.avg("score").alias("value"))
    )


#: Evaluations of public benchmarks, by name.
BENCHMARKS = {name: Evaluation(lambda df, m=m: df.withColumn("score", m(F.col("output"), F.col("reference"))), lambda df: df.agg(F.count("score").alias("n"), F.avg("score").alias("value"))) for name, m in matching.TASK_METRICS.items()}
BENCHMARKS["gsm8k"] = scored_by("gsm8k_regex")


def answered(rows: DataFrame, ask: Callable[[list[str]], list[str]], prompt: str = "prompt", size: int = 64, retries: int = 1, wait: float = 0.0) -> DataFrame:
    """Rows with the `output` that a service gives to their prompts, asked in batches from the tasks.

    A batch that fails is asked again `retries` times, after `wait`, 2 `wait`, 4 `wait` … seconds; then its outputs read `Error: …`, so
    no row is lost. A task that runs again asks again.
    """
    import time

    schema = T.StructType([*rows.schema.fields, T.StructField("output", T.StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out: list[str] = []
            for lo in range(0, len(batch), size):
                asked = batch[prompt].iloc[lo : lo + size].tolist()
                for attempt in range(retries + 1):
                    try:
                        out += ask(asked)
                        break
                    except Exception as e:  # whatever the service raises
                        if attempt == retries:
                            out += [f"Error: {e}"] * len(asked)
                        elif wait:
                            time.sleep(wait * 2**attempt)
            yield batch.assign(output=out)

    return rows.mapInPandas(run, schema)


def rounds(tasks: DataFrame, step: Callable[[DataFrame, int], DataFrame], most: int, key: str = "id", limit: int = 800) -> DataFrame:
    """Tasks played in rounds: `step` gives each unfinished task an `output` and whether it is `done`; the result has the `round` it ended in.

    Outputs over `limit` characters are cut, with a notice. Unfinished tasks after `most` rounds end there with `done` false. Each
    round is written, so a later one does not repeat it.
    """
    from rowloom.session import durable

    shown = F.when(F.length("output") > limit, F.concat(F.substring("output", 1, limit - 20), F.lit("... [truncated]"))).otherwise(F.col("output"))
    left, ended = tasks, []
    for k in range(1, most + 1):
        played = durable(step(left, k).withColumn("output", shown).withColumn("round", F.lit(k)))
        over = played.where("done") if k < most else played
        ended.append(over.select(key, "output", "done", "round"))
        if k == most:
            break
        left = tasks.join(played.where("not done").select(key), key, "left_semi")
        if left.isEmpty():
            break
    return reduce(DataFrame.unionByName, ended)


def match_answer(answer: Column, equal: Column, pattern: Column, trim: bool = True) -> Column:
    """Whether an answer is the wanted text (without outer blanks if `trim`) or matches the wanted pattern; null without either."""
    bare = (lambda c: strip(c)) if trim else (lambda c: c)
    return F.when(equal.isNotNull(), F.coalesce(bare(answer) == bare(equal), F.lit(False))).when(pattern.isNotNull(), F.coalesce(F.regexp_like(answer, pattern), F.lit(False)))


def scored_problems(df: DataFrame, kind: str = "format", reply: str = "reply", answer: str = "answer") -> DataFrame:
    """Problems of the formats that can be scored, with `is_correct`."""
    return df.where(~F.col(kind).isin(*UNSCORED)).withColumn("is_correct", matching.problem_answer(F.col(kind), F.coalesce(F.col(reply), F.lit("")), F.col(answer)))


def batches(df: DataFrame, by: str, order: str, size: int) -> DataFrame:
    """Rows with the `batch` of at most `size` rows that they belong to within their group, in order.

    Positions come from one global order, so a group of any size is spread over tasks.
    """
    from rowloom.operators.order import with_position
    from rowloom.operators.skew import join_small

    placed = with_position(df, by, order, name="_at")
    first = placed.groupBy(by).agg(F.min("_at").alias("_first"))
    return join_small(placed, first, by).withColumn("batch", F.floor((F.col("_at") - F.col("_first")) / size).cast("long")).drop("_at", "_first")


def early_stop(log: DataFrame, by: str, order: str, loss: str, patience: int, delta: float = 0.0) -> DataFrame:
    """Where each run would stop (`by`, `stopped`: the first `order` at which `patience` losses have exceeded the best one; null if never).

    The count starts anew with each new best loss; a loss within `delta` of the best leaves it as it is. A run's log is small.
    """
    run = Window.partitionBy(by).orderBy(order)
    before = F.min(loss).over(run.rowsBetween(Window.unboundedPreceding, -1))
    marked = log.select(by, order, loss, before.alias("_best")).withColumn("_new", F.coalesce(F.col(loss) < F.col("_best"), F.lit(True)))
    spell = marked.withColumn("_spell", F.sum(F.col("_new").cast("int")).over(run))
    worse = (~F.col("_new") & (F.col(loss) > F.col("_best") + delta)).cast("int")
    counted = spell.withColumn("_n", F.sum(worse).over(Window.partitionBy(by, "_spell").orderBy(order)))
    return counted.groupBy(by).agg(F.min(F.when(F.col("_n") >= patience, F.col(order))).alias("stopped"))


def best_checkpoints(log: DataFrame, k: int, loss: str, *ties: str) -> DataFrame:
    """The k checkpoints of the least loss."""
    return log.where(F.col(loss).isNotNull()).orderBy(loss, *ties).limit(k)


def with_baselines(results: DataFrame, *baselines: DataFrame | None) -> DataFrame:
    """Results with the rows of those baselines that are there; columns that one lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [results, *[b for b in baselines if b is not None]])


def single_metric(results: Column, names: tuple[str, ...]) -> Column:
    """The value of the one metric of `names` that a map of results has; raises when executed unless it is exactly one."""
    own = F.map_filter(results, lambda k, v: k.isin(*names))
    return F.when(F.assert_true(F.size(own) == 1, F.lit("not exactly one of the metrics")).isNull(), F.element_at(F.map_values(own), 1))


def first_details(details: DataFrame, by: str, order: str, n: int = 10) -> DataFrame:
    """The first n details of each entry: ranks within an entry are cut off while they are built."""
    rank = F.row_number().over(Window.partitionBy(by).orderBy(order))
    return details.withColumn("_r", rank).where(F.col("_r") <= n).drop("_r")


def adapter_rank(configs: DataFrame, default: int = 64) -> DataFrame:
    """The largest rank of adapter configurations (`config`: JSON text), by the first of r, lora_r and rank that is there."""
    rank = F.coalesce(*[F.get_json_object("config", f"$.{k}").try_cast("int") for k in ("r", "lora_r", "rank")])
    return configs.agg(F.coalesce(F.max(rank), F.lit(default)).alias("rank"))


def matching_adapters(adapters: DataFrame, wanted: DataFrame, model: str) -> tuple[DataFrame, DataFrame]:
    """The adapters (`dataset`, `base_model`, `dir`) of a base model for the wanted data sets, and the data sets that have none."""
    own = adapters.where(F.col("base_model") == model)
    return wanted.join(own, "dataset"), wanted.join(own, "dataset", "left_anti")


def time_overhead(total: Column, train: Column, validate: Column) -> Column:
    """Seconds that went neither into training nor into validation; never negative."""
    return F.greatest(total - F.coalesce(train, F.lit(0.0)) - F.coalesce(validate, F.lit(0.0)), F.lit(0.0))
