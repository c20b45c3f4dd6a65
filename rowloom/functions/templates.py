"""Templates and their parts: placeholders, profile columns, instruction wraps, truncation, escapes."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Wording around a profile and around an instructed query.
INSTRUCT, QUERY = "Instruct: ", "\nQuery: "


def fill_braces(template: str, values: dict[str, Column]) -> Column:
    """A template with `{{ name }}` placeholders, parsed when the plan is built; null values are empty, unknown names too."""
    parts = re.split(r"\{\{\s*(\w+)\s*\}\}", template)
    made = [F.lit(p) if i % 2 == 0 else F.coalesce(values[p].cast("string"), F.lit("")) if p in values else F.lit("") for i, p in enumerate(parts)]
    return F.concat(*made)


def render_loop(items: Column, line, joiner: str = "\n") -> Column:
    """A template's loop over an array: `line` makes the text of one element."""
    return F.array_join(F.transform(items, line), joiner)


def swap_retrieval(template: Column | str, k: int) -> Column | str:
    """A template with another number of retrieved items in its profile column."""
    if isinstance(template, str):
        return re.sub(r"profile_retrieval_k\d+", f"profile_retrieval_k{k}", template)
    return F.regexp_replace(template, r"profile_retrieval_k\d+", f"profile_retrieval_k{k}")


def instructed(task: Column, query: Column) -> Column:
    """A query under the instruction of its task."""
    return F.concat(F.lit(INSTRUCT), task, F.lit(QUERY), query)


def full_stop(text: Column) -> Column:
    """The trimmed text with a point at its end, unless it has an end mark; blank texts stay as they are."""
    bare = F.trim(text)
    return F.when(bare == "", text).when(F.regexp_like(bare, F.lit(r"[.!?]$")), bare).otherwise(F.concat(bare, F.lit(".")))


def cut_tokens(text: Column, tokens: int, per_token: float = 3.7) -> Column:
    """The text cut behind its first `tokens` estimated tokens, with a mark where it is longer."""
    n = int(tokens * per_token)
    return F.when(F.floor(F.length(text) / F.lit(per_token)) > tokens, F.concat(F.substring(text, 1, n), F.lit("..."))).otherwise(text)


def keep_last(text: Column, tokens: int, per_token: int = 4) -> Column:
    """The last `tokens` estimated tokens of a text: the newest part stays."""
    n = tokens * per_token
    return F.when(F.length(text) > n, F.substring(text, -n, n)).otherwise(text)


def keep_ends(text: Column, tokens: int, per_token: int = 4) -> Column:
    """The first and the last half of `tokens` estimated tokens of a text."""
    half = tokens * per_token // 2
    return F.when(F.length(text) > 2 * half, F.concat(F.substring(text, 1, half), F.substring(text, -half, half))).otherwise(text)


def sql_name(name: Column) -> Column:
    """A name quoted for SQL."""
    return F.concat(F.lit("`"), F.replace(name, F.lit("`"), F.lit("``")), F.lit("`"))


def sql_text(value: Column) -> Column:
    """A text quoted for SQL; null reads NULL."""
    return F.coalesce(F.concat(F.lit("'"), F.replace(value, F.lit("'"), F.lit("''")), F.lit("'")), F.lit("NULL"))
