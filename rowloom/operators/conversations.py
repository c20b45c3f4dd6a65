"""Operators on conversations: turns as training rows with the turns before them, chosen answers, shared filters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowloom.functions.text import non_blank
from rowloom.operators.nested import flat_turns


def chosen_answer(preferred: str = "assistant_preferred", rejected: str = "assistant_rejected"):
    """The answer that `chosen` names, else the preferred, else the rejected one; blanks do not count."""
    return F.coalesce(F.when(F.col("chosen") == "rejected", non_blank(rejected)).when(F.col("chosen") == "preferred", non_blank(preferred)), non_blank(preferred), non_blank(rejected))


def turn_rows(records: DataFrame) -> DataFrame:
    """Every turn of a user and assistant conversation as a row: the turns before it, the user's text, the preferred answer.

    Turns without a user's text or a preferred answer give no row, but a user's text and chosen answer stay context for
    later turns. One `collect_list` per conversation; a conversation is bounded by its record.
    """
    turns = flat_turns(records).where("user is not null or assistant_preferred is not null")
    told = turns.select("record_id", "user_id", F.col("parent_pos").alias("conversation"), F.col("pos"), non_blank("user").alias("said"), chosen_answer().alias("answer"), non_blank("assistant_preferred").alias("output"))
    packed = told.groupBy("record_id", "user_id", "conversation").agg(F.sort_array(F.collect_list(F.struct("pos", "said", "answer", "output"))).alias("t"))
    rows = packed.select("record_id", "user_id", "conversation", "t", F.posexplode("t").alias("i", "now")).where("now.said is not null and now.output is not null")
    lines = F.flatten(F.transform(F.slice("t", F.lit(1), F.col("i")), lambda x: F.array(F.concat(F.lit("User: "), x["said"]), F.concat(F.lit("Assistant: "), x["answer"]))))
    before = F.filter(lines, lambda x: x.isNotNull())
    text = F.array_join(F.concat(before, F.array(F.concat(F.lit("User: "), F.col("now.said")))), "\n")
    return rows.select("record_id", "conversation", F.col("now.pos").alias("pos"), F.size(before).cast("long").alias("n_before"), text.alias("input"), F.col("now.output").alias("output"))


def chosen_turns(records: DataFrame, threshold: float = 80.0, model: str = "gpt-4") -> DataFrame:
    """Chosen model turns whose score reaches the threshold (an unknown score passes) and whose model's name holds `model`."""
    turns = flat_turns(records).where("role = 'model' and if_chosen = 'true'")
    score = F.col("score").try_cast("double")
    return turns.where((score.isNull() | (score >= threshold)) & F.contains(F.lower(F.coalesce("model_name", F.lit(""))), F.lit(model.lower()))).select(
        "record_id", F.col("parent_pos").alias("conversation"), "pos", score.alias("score"), F.lower("model_name").alias("model_name")
    )


def prompt_sections(turns: DataFrame, *by: str) -> DataFrame:
    """Turns of a conversation as one text of paragraphs `role: content`, in order; null and blank contents are left out."""
    told = turns.select(*by, "pos", F.concat_ws(": ", F.col("role"), non_blank("content")).alias("line"), non_blank("content").alias("c")).where("c is not null")
    return told.groupBy(*by).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n\n").alias("dialogue"))
