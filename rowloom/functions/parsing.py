"""Splitting task inputs into instruction and fields, as column builders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rowloom.functions.answers import first_match
from rowloom.functions.text import strip

#: The marker behind a task's instruction, and the name of what follows it.
MARKERS = {
    "lamp_movie": ("description:", "description"),
    "lamp_product": ("review:", "review_text"),
    "lamp_tweet": ("before or after it:", "original_tweet"),
    "lamp_news_headline": ("following article:", "article"),
    "lamp_news_cat": ("article:", "article"),
}
#: Instructions that are not part of the input.
SCHOLARLY_ASK = "Generate a title for the following abstract of a paper: "
REVIEW_ASK = "Generate the review text"
TOPIC_CUT, TOPIC_GUARD = " for a reddit post", "reddit post"
ITEMS_MARKER = "using the following items:"
OPINION_ASK = "Answer the following multiple choice question based on your personal opinions and demographic background."
OPINION_FALLBACK = "Answer the following question."
ARTICLE_ASK = "Read the following news article and provide your personal commentary or reaction."
REDDIT_ASK = "Respond to the following conversation or question in a personal and authentic way that reflects your background and personality."


def split_once(column: Column, marker: Column | str) -> Column:
    """Struct of `instruction` (up to and with the marker) and `body` (behind it), trimmed; without the marker all is instruction."""
    marker = F.lit(marker) if isinstance(marker, str) else marker
    at = F.position(marker, column)
    return F.when(
        at > 0,
        F.struct(strip(F.substring(column, F.lit(1), at + F.length(marker) - 1)).alias("instruction"), strip(F.substring(column, at + F.length(marker), F.length(column))).alias("body")),
    ).otherwise(F.struct(strip(column).alias("instruction"), F.lit("").alias("body")))


def citation_fields(column: Column) -> Column:
    """Struct of `title` and `options`: the quoted title, and a line per numbered option in order of first mention (of repeats the last counts)."""
    pattern = F.lit(r'\[([0-9]+)\]: "([^"]+)"')
    numbers, texts = F.regexp_extract_all(column, pattern, F.lit(1)), F.regexp_extract_all(column, pattern, F.lit(2))
    pairs = F.zip_with(numbers, texts, lambda n, t: F.struct(n.alias("n"), t.alias("t")))
    last = lambda n: F.element_at(F.filter(pairs, lambda p: p["n"] == n), -1)["t"]
    lines = F.transform(F.array_distinct(numbers), lambda n: F.concat(F.lit("["), n, F.lit(']: "'), last(n), F.lit('"')))
    return F.struct(F.coalesce(first_match(column, r'title "([^"]+)"'), F.lit("")).alias("title"), F.array_join(lines, "\n").alias("options"))


def review_fields(column: Column) -> Column:
    """Struct of `rating`, `description` and `summary` of a review request; empty where not given."""
    found = lambda p: F.coalesce(first_match(column, p), F.lit(""))
    return F.struct(
        found(r'rating of "([^"]+)"').alias("rating"), found(r'product with description "([^"]+)"').alias("description"), found(r'summary of the review text is "([^"]+)"').alias("summary")
    )


def outline_items(column: Column) -> Column:
    """The texts of numbered items, one per line, in order."""
    return F.regexp_extract_all(column, F.lit(r"[0-9]+\.\s*([^\n]+)"), F.lit(1))


def behind(column: Column, marker: str) -> Column:
    """The text behind the first mention of a marker; empty without it."""
    at = F.position(F.lit(marker), column)
    return F.when(at > 0, F.substring(column, at + len(marker), F.length(column))).otherwise(F.lit(""))


def topic_fields(column: Column) -> Column:
    """Struct of `instruction` and `topic`, parted once; null unless the input speaks of a post."""
    at = F.position(F.lit(TOPIC_CUT), column)
    cut = F.struct(
        F.concat(strip(F.when(at > 0, F.substring(column, F.lit(1), at - 1)).otherwise(column)), F.lit(TOPIC_CUT)).alias("instruction"),
        F.when(at > 0, strip(F.substring(column, at + len(TOPIC_CUT), F.length(column)))).alias("topic"),
    )
    return F.when(F.contains(column, F.lit(TOPIC_GUARD)), cut)


def opinion_fields(column: Column) -> Column:
    """Struct of `instruction`, `question` and `options` of a survey question; the last two are null in another form."""
    asked = F.contains(column, F.lit("Question:")) & F.contains(column, F.lit("Options:"))
    at = F.position(F.lit("Options:"), column)
    question = strip(F.replace(F.substring(column, F.lit(1), at - 1), F.lit("Question:"), F.lit("")))
    options = strip(F.split_part(F.substring(column, at + 8, F.length(column)), F.lit("Answer:"), F.lit(1)))
    return F.struct(F.when(asked, F.lit(OPINION_ASK)).otherwise(F.lit(OPINION_FALLBACK)).alias("instruction"), F.when(asked, question).alias("question"), F.when(asked, options).alias("options"))


def parse_input(task: Column, column: Column) -> Column:
    """Struct of `instruction` and `fields` (a map from name to text) of an input, by its task's form; the whole input where no form fits.

    One expression for all tasks: rows of different tasks may stand in one table.
    """
    made = lambda instruction, *pairs: F.struct(instruction.alias("instruction"), F.map_filter(F.create_map(*[x for n, c in pairs for x in (F.lit(n), c)]), lambda k, v: v.isNotNull()).alias("fields"))
    cases = None
    for name, (marker, field) in MARKERS.items():
        parts = split_once(column, marker)
        before = F.when(F.contains(column, F.lit(marker)), strip(F.substring(column, F.lit(1), F.position(F.lit(marker), column) - 1))).otherwise(column)
        case = made(before, (field, parts["body"]))
        cases = F.when(task == name, case) if cases is None else cases.when(task == name, case)
    citation, review, topic, opinion = citation_fields(column), review_fields(column), topic_fields(column), opinion_fields(column)
    title = F.coalesce(first_match(column, r'title "([^"]+)"'), F.lit(""))
    first_option = F.position(F.lit("[1]:"), column)
    before_options = F.when(first_option > 0, F.substring(column, F.lit(1), first_option - 1)).otherwise(column)
    return (
        cases.when(task == "lamp_citation", made(strip(before_options), ("paper_title", citation["title"]), ("options_str", citation["options"])))
        .when(task == "lamp_scholarly_title", made(F.lit(SCHOLARLY_ASK), ("abstract", strip(F.replace(column, F.lit(SCHOLARLY_ASK), F.lit(""))))))
        .when(task == "longlamp_product_review", made(F.concat(F.split_part(column, F.lit(REVIEW_ASK), F.lit(1)), F.lit(REVIEW_ASK)), ("product_description", review["description"]), ("rating", review["rating"]), ("review_summary", review["summary"])))
        .when(task == "longlamp_abstract_generation", made(F.concat(F.lit('Generate an abstract for the title "'), title, F.lit('"')), ("paper_title", title), ("key_items", F.array_join(outline_items(behind(column, ITEMS_MARKER)), "\n"))))
        .when(task == "longlamp_topic_writing", made(F.coalesce(topic["instruction"], column), ("topic_prompt", topic["topic"])))
        .when(task == "opinionqa", made(opinion["instruction"], ("question", opinion["question"]), ("options", opinion["options"])))
        .when(task == "ec", made(F.lit(ARTICLE_ASK), ("article", column)))
        .when(task == "personalreddit", made(F.lit(REDDIT_ASK), ("input_text", column)))
        .when(task.isin("prism", "aloe"), made(F.lit("").cast("string"), ("conversation", column)))
        .otherwise(made(column, ("input", F.lit(None).cast("string"))))
    )


def padded_choices(texts: Column, labels: Column, size: int = 4) -> Column:
    """Struct of `text` and `label` arrays of a problem, filled up to `size`: missing texts are N/A, labels go on as numbers or letters."""
    fill = lambda c: F.greatest(F.lit(size) - F.size(c), F.lit(0))
    more = F.filter(F.sequence(F.lit(1), F.lit(size)), lambda i: i > F.size(labels))
    named = F.transform(more, lambda i: F.when(F.get(labels, 0).rlike("^[0-9]+$"), i.cast("string")).otherwise(F.char(i + 64)))
    return F.struct(F.concat(texts, F.array_repeat(F.lit("N/A"), fill(texts))).alias("text"), F.concat(labels, named).alias("label"))


def task_definition(column: Column, answers: Column) -> Column:
    """Struct of `task_def`, `problem` and `answer` of an input that has a definition, examples and a problem to complete."""
    between = lambda c, a, b: F.split_part(F.split_part(c, F.lit(a), F.lit(2)), F.lit(b), F.lit(1))
    asked = F.concat(between(column, "Definition: ", "\n\nPositive Example"), F.lit(" Please complete the task without any explanation."))
    several = F.when(F.size(answers) > 1, F.lit("\nThe answer should be a comma-separated list of possible completions.")).otherwise(F.lit(""))
    problem = between(F.split_part(column, F.lit("Now complete the following example -"), F.lit(2)), "Input: ", "\nOutput:")
    return F.struct(F.concat(asked, several).alias("task_def"), problem.alias("problem"), F.array_join(answers, ", ").alias("answer"))


def listed_options(column: Column) -> Column:
    """The options of a question of the form `A. … B. … C. …`, in order, trimmed."""
    return F.transform(F.regexp_extract_all(column, F.lit(r"\b[A-Z]\. (.*?)(?= [A-Z]\. |$)"), F.lit(1)), lambda x: strip(x))


def bracket_list(column: Column) -> Column:
    """The comma-separated entries of the first bracketed list."""
    return F.transform(F.split(first_match(column, r"\[([^\]]+)\]"), ","), lambda x: strip(x))
