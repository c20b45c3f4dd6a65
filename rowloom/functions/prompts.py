"""Prompt assembly as column builders: profile sections, chat layouts, multiple-choice problems."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rowloom.functions.text import non_blank

#: Numbers of retrieved items for which a profile column may exist, and section headings.
RETRIEVAL_KS = (1, 2, 4, 8, 12, 16, 32)
PROFILE_HEADING, HISTORY_HEADING, STATISTICS_HEADING = "## User Profile:\n", "## User History:\n", "\n\n## User History Statistics:\n"

#: The wording of problems by format.
QUESTION, OPTIONS, ASK_LETTER = "Question:", "\nOptions:\n", "\nPlease provide the answer to this question directly (a single letter):"
STATEMENT, ASK_TRUTH = "Statement:", "Please give the answer directly (true or false):"
ANSWER = "Answer:"
SUBJECTIVE, ASK_BRIEF = "This is a subjective question:", "Please provide a brief answer to this question:"


def profile_section(kind: str, profile: Column, history: Column, statistics: Column | None = None, retrieved: dict[int, Column] | None = None, k: int | None = None) -> Column:
    """The profile shown to a model: `profile`, `history` or `mix` of both under headings; `k` takes what was retrieved instead of the history.

    Blank parts are left out; the history's label statistics follow where given. An unknown kind or k raises when the plan is built.
    """
    if k is not None:
        if k not in RETRIEVAL_KS or k not in (retrieved or {}):
            raise ValueError(f"no retrieval for k={k}")
        history = retrieved[k]
    own, past = non_blank(profile), non_blank(history)
    parts = {
        "profile": own,
        "history": past,
        "mix": F.nullif(F.concat_ws("\n\n", F.concat(F.lit(PROFILE_HEADING), own), F.concat(F.lit(HISTORY_HEADING), past)), F.lit("")),
    }
    if kind not in parts:
        raise ValueError(f"unknown kind of profile: {kind!r}")
    text = F.coalesce(parts[kind], F.lit(""))
    if statistics is None:
        return text
    return F.concat(text, F.coalesce(F.concat(F.lit(STATISTICS_HEADING), non_blank(statistics)), F.lit("")))


def chat_prompt(system: Column, user: Column, prefill: Column) -> Column:
    """Messages of a request: system (if not blank), user, and a trailing assistant prefill (if not blank)."""
    message = lambda role, c: F.when(non_blank(c).isNotNull(), F.struct(F.lit(role).alias("role"), c.alias("content")))
    return F.filter(F.array(message("system", system), F.struct(F.lit("user").alias("role"), F.coalesce(user, F.lit("")).alias("content")), message("assistant_prefill", prefill)), lambda m: m.isNotNull())


def last_said(turns: Column, role: str = "user") -> Column:
    """Content of the last turn of a role; null if there is none."""
    return F.try_element_at(F.filter(turns, lambda t: t["role"] == role), F.lit(-1))["content"]


def problem_prompt(question: Column, kind: Column, choices: Column) -> Column:
    """A problem's prompt by its format: multiple choice lists its options (a map from letter to text); null for an unknown format."""
    options = F.array_join(F.transform(F.array_sort(F.map_entries(choices)), lambda e: F.concat(F.lit("("), e["key"], F.lit(")"), e["value"])), "\n")
    return (
        F.when(kind == "Multiple-choice", F.concat(F.lit(QUESTION), question, F.lit(OPTIONS), options, F.lit(ASK_LETTER)))
        .when(kind == "Assertion", F.concat(F.lit(STATEMENT), question, F.lit(ASK_TRUTH)))
        .when(kind == "Fill-in-the-blank", F.concat(F.lit(QUESTION), question, F.lit(ANSWER)))
        .when(kind == "Open-ended", F.concat(F.lit(SUBJECTIVE), question, F.lit(ASK_BRIEF)))
    )


def strip_chat_marks(text: Column) -> Column:
    """A reply without the marks of a chat layout around it."""
    marks = r"<\|(?:im_start|im_end|endoftext|begin_of_text|end_of_text|eot_id|start_header_id|end_header_id)\|>"
    return F.trim(F.regexp_replace(F.regexp_replace(text, rf"^\s*{marks}?\s*(?:assistant|model)\s*\n", ""), marks, ""))


def fenced_code(text: Column) -> Column:
    """The first fenced code block of a reply; the whole reply, trimmed, without a fence."""
    found = F.regexp_extract(text, r"(?s)```[A-Za-z]*\n(.*?)(?:```|$)", 1)
    return F.when(F.contains(text, F.lit("```")), found).otherwise(F.trim(text))
