"""Text functions as column builders: Unicode-aware trimming, truncation, rendering of items and prompts."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fields of a history item by task, in order: (fields of which the first non-blank counts, display name).
ITEM_FIELDS = {
    "lamp_movie": [(["description"], "Description"), (["tag"], "Tag")],
    "lamp_news_cat": [(["text", "article"], "Article"), (["category"], "Category")],
    "lamp_news_headline": [(["text", "article"], "Article"), (["title"], "Headline")],
    "lamp_citation": [(["title"], "Paper Title"), (["citation"], "Citation")],
    "lamp_product": [(["text", "reviewText"], "Review"), (["score", "overall"], "Rating")],
    "lamp_scholarly_title": [(["abstract"], "Abstract"), (["title"], "Paper Title")],
    "lamp_tweet": [(["text"], "Tweet")],
    "longlamp_product_review": [(["description"], "Product Description"), (["overall"], "Rating"), (["summary"], "Review Summary")],
    "longlamp_abstract_generation": [(["title"], "Paper Title"), (["abstract"], "Abstract")],
    "longlamp_topic_writing": [(["summary"], "Topic"), (["content"], "Post")],
}
#: The field of a history item that is its label, by task.
LABEL_FIELDS = {"lamp_movie": ["tag"], "lamp_news_cat": ["category"], "lamp_product": ["score", "overall"]}


def strip(column: Column | str) -> Column:
    """The text without outer white space of any kind (trim takes only blanks away)."""
    return F.regexp_replace(column, r"(?U)^\s+|\s+$", "")


def non_blank(*columns: Column | str) -> Column:
    """The first text that is not null or blank, trimmed; else null."""
    return F.coalesce(*[F.nullif(strip(c), F.lit("")) for c in columns])


def one_decimal(column: Column) -> Column:
    """A number with one decimal, halves rounded to even."""
    return F.format_string("%.1f", F.bround(column.cast("double"), 1))


def truncate(column: Column, n: int, mark: str = "...") -> Column:
    """The text, cut behind n characters with a mark where it is longer."""
    return F.when(F.length(column) > n, F.concat(F.substring(column, 1, n), F.lit(mark))).otherwise(column)


def token_estimate(column: Column | str, per_token: float = 4) -> Column:
    """Estimated tokens of a text: characters by `per_token`, rounded down; null counts as empty."""
    return F.coalesce(F.floor(F.length(column) / F.lit(per_token)), F.lit(0)).cast("long")


def plain_text(column: Column | str, is_array: bool = False) -> Column:
    """A text or an array of texts as one trimmed text; null gives the empty text, null elements are left out."""
    if is_array:
        column = F.array_join(F.filter(column, lambda x: x.isNotNull()), " ")
    return F.coalesce(strip(column), F.lit(""))


def render_item(item: Column, task: Column, limit: int = 800) -> Column:
    """A history item as `Name: value | Name: value` in its task's order; null if it has none of the task's fields.

    Values are trimmed and cut behind `limit` characters; null and blank ones are left out. An unknown task gives null.
    """
    cases = None
    for name, fields in ITEM_FIELDS.items():
        parts = F.array(*[F.concat(F.lit(f"{shown}: "), truncate(non_blank(*[item[f] for f in own]), limit)) for own, shown in fields])
        text = F.nullif(F.array_join(F.filter(parts, lambda x: x.isNotNull()), " | "), F.lit(""))
        cases = F.when(task == name, text) if cases is None else cases.when(task == name, text)
    return cases


def item_label(item: Column, task: Column) -> Column:
    """The label of a history item: first non-blank of its task's label fields."""
    cases = None
    for name, fields in LABEL_FIELDS.items():
        label = non_blank(*[item[f] for f in fields])
        cases = F.when(task == name, label) if cases is None else cases.when(task == name, label)
    return cases


def render_template(template: str, columns: dict[str, Column]) -> Column:
    """A `{field}` template as one concatenation, parsed when the plan is built; null fields are empty. Unknown fields raise."""
    parts = []
    for text, field, _, _ in string.Formatter().parse(template):
        if text:
            parts.append(F.lit(text))
        if field is not None:
            if field not in columns:
                raise KeyError(f"template field {field!r} is not among {sorted(columns)}")
            parts.append(F.coalesce(columns[field].cast("string"), F.lit("")))
    return F.concat(*parts) if parts else F.lit("")


def placeholder(dataset: Column, profile: Column, length: int = 16) -> Column:
    """A stable placeholder for a profile of a dataset, from their digest; null parts are empty."""
    return F.concat(F.lit("random_profile_"), F.substring(F.sha2(F.concat(F.coalesce(dataset, F.lit("")), F.lit(":"), F.coalesce(profile, F.lit(""))), 256), 1, length))


def render_turns(turns: Column, role: str = "role", content: str = "content") -> Column:
    """Turns as paragraphs `role: content`, in order; null contents are left out."""
    return F.array_join(F.filter(F.transform(turns, lambda t: F.concat(t[role], F.lit(": "), t[content])), lambda x: x.isNotNull()), "\n\n")
