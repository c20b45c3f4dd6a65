"""Results of runs: reading, merging, leaderboards, agent and database tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Shape of a result file: task to a list of runs.
RESULTS = "map<string,array<struct<split:string,lora_dir:string,results:map<string,double>,inference_time_seconds:double>>>"


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """Result files as rows (`file`, `task`, `run`, `split`, `metric`, `value`); what is no list of runs is left out."""
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")
    runs = whole.select("file", F.explode(F.from_json("value", RESULTS)).alias("task", "runs")).select("file", "task", F.posexplode("runs").alias("run", "r"))
    return runs.select("file", "task", "run", "r.split", F.explode("r.results").alias("metric", "value"))


def mean_metrics(results: DataFrame, allowed: tuple[str, ...] = ()) -> DataFrame:
    """Mean of every metric over all runs, of the allowed ones if given."""
    rows = results.where(F.col("metric").isin(*allowed)) if allowed else results
    return rows.where("value is not null").groupBy("metric").agg(F.avg("value").alias("value"), F.count(F.lit(1)).alias("n_runs"))


def leaderboard(results: DataFrame, metric: str, *rows: str) -> DataFrame:
    """One row per model and split with a column per task: the mean of a metric, and the mean over the tasks that are there."""
    means = results.where(F.col("metric") == metric).groupBy(*rows, "task").agg(F.avg("value").alias("value"))
    board = means.groupBy(*rows).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("task", "value")))).alias("tasks"), F.avg("value").alias("avg_metric"))
    return board


def read_judged(spark: SparkSession, path: str) -> DataFrame:
    """Judge input of any known layout as rows (`sample`: JSON text): a list, a task to list map, or a map with sampled details."""
    whole = spark.read.text(path, wholetext=True).select(F.expr("try_parse_json(value)").alias("v"))
    lists = F.expr(
        "coalesce(try_variant_get(v, '$', 'array<variant>'), try_variant_get(v, '$.sampled_res_details', 'array<variant>'), "
        "flatten(transform(map_values(try_variant_get(v, '$', 'map<string,variant>')), x -> coalesce(try_variant_get(x, '$', 'array<variant>'), try_variant_get(x, '$.sampled_res_details', 'array<variant>'), array()))))"
    )
    return whole.select(F.explode(lists).alias("s")).select(F.expr("to_json(s)").alias("sample"))


def instruction(sample: str = "sample") -> Column:
    """The instruction of a judged sample: first of user_instruction, user_input, last_user_input, problem, question that is not blank."""
    fields = ("user_instruction", "user_input", "last_user_input", "problem", "question")
    return F.coalesce(*[F.nullif(F.trim(F.get_json_object(sample, f"$.{f}")), F.lit("")) for f in fields], F.lit(""))


#: Kinds of database tasks that are reported.
STATEMENT_KINDS = ["other", "counting", "comparison", "ranking", "aggregation-SUM", "aggregation-MIN", "aggregation-MAX", "aggregation-AVG", "SELECT", "INSERT", "UPDATE"]


def statement_accuracy(df: DataFrame, kind: str = "type", correct: str = "correct") -> DataFrame:
    """Accuracy by kind of database task (`bucket`, `n`, `acc`), every known kind with a row, 0 without tasks.

    SELECT takes every task that neither inserts nor updates, so a counting task counts twice; `overall` is over SELECT,
    INSERT and UPDATE. A null result is a wrong one, a null kind a query.
    """
    k = F.coalesce(F.col(kind), F.lit(""))
    writes = k.isin("INSERT", "UPDATE")
    own = F.when(k.isin(*[x for x in STATEMENT_KINDS if x != "SELECT"]), k)
    buckets = F.filter(F.array(own, F.when(~writes, F.lit("SELECT")), F.lit("overall")), lambda b: b.isNotNull())
    found = df.select(F.explode(buckets).alias("bucket"), F.coalesce(F.col(correct), F.lit(False)).alias("ok")).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("ok").cast("double")).alias("acc"))
    every = df.sparkSession.createDataFrame([(b,) for b in (*STATEMENT_KINDS, "overall")], "bucket string")
    return every.join(found, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("acc", F.lit(0.0)).alias("acc"))


def same_rows(answer: Column, target: Column) -> Column:
    """Whether two JSON lists hold the same set of values; numbers are compared as such. Broken text is the single value itself."""
    read = lambda c: F.array_sort(F.array_distinct(F.transform(F.coalesce(F.from_json(c, "array<string>"), F.array(c)), lambda x: F.coalesce(x.try_cast("double").cast("string"), F.lower(F.trim(x))))))
    return F.coalesce(read(answer) == read(target), F.lit(False))


def rounds_used(df: DataFrame, history: str = "history") -> DataFrame:
    """Mean number of rounds over the rows that have any."""
    return df.where(F.size(history) > 0).agg(F.avg(F.size(history)).alias("rounds"))


def per_file(df: DataFrame, file: str = "file", passed: str = "passed") -> DataFrame:
    """Total, passed and accuracy per file and (null file) over all."""
    return df.rollup(file).agg(F.count(F.lit(1)).alias("total"), F.sum(F.col(passed).cast("int")).alias("passed"), F.avg(F.col(passed).cast("double")).alias("acc"))


def masked_loss(logp: Column, mask: Column) -> Column:
    """Negative log-likelihood over the unmasked tokens of an array."""
    return -F.aggregate(F.zip_with(logp, mask, lambda x, m: F.when(m.cast("boolean"), x).otherwise(0.0)), F.lit(0.0), lambda a, x: a + x)


def agent_action(reply: Column) -> Column:
    """The last action a reply names, in lower case; null if it names none."""
    return F.lower(F.try_element_at(F.regexp_extract_all(reply, F.lit(r"(?i)Act(?:ion)?:\s*(bash|finish|answer|operation|query)"), F.lit(1)), F.lit(-1)))


def sql_statement(reply: Column) -> Column:
    """The SQL of a reply's fenced block, its lines joined; null without one."""
    return F.nullif(F.trim(F.regexp_replace(F.regexp_extract(reply, r"(?s)```sql\n(.*?)\n```", 1), r"\s+", " ")), F.lit(""))


def final_answer(reply: Column) -> Column:
    """What follows "Final Answer:" on its line, or an <answer> tag; null if neither is there."""
    return F.coalesce(F.nullif(F.trim(F.regexp_extract(reply, r"Final Answer:\s*([^\n]+)", 1)), F.lit("")), F.nullif(F.trim(F.regexp_extract(reply, r"(?s)<answer>(.*?)</answer>", 1)), F.lit("")))


def write_report(df: DataFrame, path: str, digits: int = 5) -> None:
    """A result table as CSV with a header, doubles rounded."""
    kinds = dict(df.dtypes)
    df.select(*[F.round(c, digits).alias(c) if kinds[c] in ("double", "float") else F.col(c) for c in df.columns]).write.mode("overwrite").option("header", True).csv(path)
