"""Curation of training and evaluation rows from users' histories, queries and conversations; all of it within the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowloom.functions.text import non_blank, render_item, strip
from rowloom.operators.history import running_sums
from rowloom.operators.nested import payload_rows

#: Limits of a value's characters tried in turn, and of those in the last resort.
VALUE_LIMITS, LEAST_VALUE = (700, 500, 300), 300
#: Tokens added for formatting, with all items and with items dropped; share of the budget used; share that needs no cut.
FORMAT_TOKENS, DROP_TOKENS, USED, UNCUT = 1000, 100, 0.9, 0.5
#: Headings and rulers of rendered histories.
ACTIVITY_HEAD, CONVERSATION_HEAD, ITEM_BREAK = "Recent User Activity:\n", "Recent Conversations:\n", " || "
BANNER = "=" * 50
RULER = "\n" + "-" * 50 + "\n"
NO_HISTORY, NO_CONTENT = "No history available.", "No conversation content"
#: The question that a history item answers, by task: text before the field, fields of the text, fields of the answer.
HISTORY_QUESTIONS = {
    "lamp_movie": (
        "Which tag does this movie relate to among the following tags? Just answer with the tag name without further explanation. tags: [sci-fi, based on a book, comedy, action, twist ending, dystopia, dark comedy, classic, psychology, fantasy, romance, thought-provoking, social commentary, violence, true story] description: ",
        ["description"], ["tag"],
    ),
    "lamp_news_cat": (
        "Which category does this article relate to among the following categories? Just answer with the category name without further explanation. categories: [travel, education, parents, style & beauty, entertainment, food & drink, science & technology, business, sports, healthy living, women, politics, crime, culture & arts, religion] article: ",
        ["text", "article"], ["category"],
    ),
    "lamp_news_headline": ("Generate a headline for the following article: ", ["text", "article"], ["title"]),
    "lamp_citation": ("Given the paper title, generate a citation for this paper. paper title: ", ["title"], ["citation"]),
    "lamp_product": ("What is the score of the following review on a scale of 1 to 5? just answer with 1, 2, 3, 4, or 5 without further explanation. review: ", ["text", "reviewText"], ["score", "overall"]),
    "lamp_scholarly_title": ("Generate a title for the following abstract of a paper: ", ["abstract"], ["title"]),
    "lamp_tweet": ("Paraphrase the following tweet without any explanation before or after it: ", ["text"], ["text"]),
    "longlamp_abstract_generation": ("Generate an abstract for a paper with the title: ", ["title"], ["abstract"]),
    "longlamp_topic_writing": ("Write content based on the following topic: ", ["summary"], ["content"]),
}
#: Tasks whose histories add no training rows, and the rows from which a task needs none.
NOT_AUGMENTED, ENOUGH_ROWS = ("lamp_citation", "lamp_tweet"), 10_000


def _fields(df: DataFrame, history: str) -> list[str]:
    return df.schema[history].dataType.elementType.names


def _value_sum(item: Column, fields: list[str], size) -> Column:
    """Sum over the item's fields that are not null of a number made of the value and the field's name."""
    total = F.lit(0)
    for f in fields:
        total = total + F.coalesce(size(item[f], len(f)), F.lit(0))
    return total


def fit_history(df: DataFrame, budget: int, history: str = "history") -> DataFrame:
    """The history cut to a token budget (`history`, with `level`: the value limit used, 0 for none, -1 where items were dropped).

    As long as the printed items take no more than UNCUT of the budget, nothing is cut. Else values are trimmed and cut at the
    limits in turn until the estimate fits into USED of it; if none fits, the oldest items are dropped as well. A token is
    four characters. If not even the newest item fits, or the history is null or empty, the result is empty or null.
    """
    fields = _fields(df, history)
    there = F.filter(F.col(history), lambda x: x.isNotNull())
    total = lambda size: F.aggregate(there, F.lit(0).cast("long"), lambda s, x: s + _value_sum(x, fields, size))
    printed = total(lambda v, k: F.length(v) + k + 8)
    sized = {n: total(lambda v, k, n=n: _cut_length(v, n) + k + 10) for n in VALUE_LIMITS}
    level = F.when(F.floor(printed / 4) <= F.lit(budget * UNCUT), F.lit(0))
    for n, chars in sized.items():
        level = level.when(F.floor(chars / 4) + FORMAT_TOKENS <= F.lit(budget * USED), F.lit(n))
    # characters of the items from each one on, in the last resort
    least = F.transform(F.reverse(there), lambda x: _value_sum(x, fields, lambda v, k: F.when(v.isNotNull(), F.least(F.length(v), F.lit(LEAST_VALUE)))).cast("long"))
    rows = df.withColumn("level", level.otherwise(F.lit(-1))).withColumn("_sums", running_sums(least))
    kept = F.size(F.filter("_sums", lambda s: F.floor(s / 4) + DROP_TOKENS <= F.lit(budget * USED)))
    limit = F.when(F.col("level") == -1, F.lit(LEAST_VALUE)).otherwise(F.col("level"))

    def cut(x: Column) -> Column:
        """An item with its values cut; in the last resort only cut values are trimmed."""
        made = lambda v: F.when(F.length(strip(v)) > limit, F.concat(F.substring(strip(v), F.lit(1), limit), F.lit("..."))).when(F.col("level") == -1, v).otherwise(strip(v))
        return F.struct(*[made(x[f]).alias(f) for f in fields])

    every = F.filter(F.col(history), lambda x: x.isNotNull())
    chosen = F.when(F.col("level") == 0, every).when(F.col("level") > 0, F.transform(every, cut)).otherwise(F.transform(F.slice(every, F.greatest(F.size(every) - kept + 1, F.lit(1)), kept), cut))
    return rows.withColumn(history, chosen).drop("_sums")


def _cut_length(value: Column, limit: int) -> Column:
    n = F.length(strip(value))
    return F.when(n > limit, F.lit(limit + 3)).otherwise(n)


def activity_text(history: Column, task: Column, budget: int, head: str = ACTIVITY_HEAD) -> Column:
    """A fitted history as one text under a heading, cut where it still exceeds the budget; empty without items."""
    shown = F.filter(F.transform(history, lambda x: render_item(x, task)), lambda t: t.isNotNull())
    text = F.concat(F.lit(head), F.array_join(shown, ITEM_BREAK))
    room = (budget - 100) * 4
    cut = F.when((F.floor(F.length(text) / 4) > budget) & (F.length(text) > room), F.concat(F.substring(text, 1, room), F.lit("..."))).otherwise(text)
    return F.when(F.size(shown) > 0, cut).otherwise(F.lit(""))


def title_case(name: str) -> str:
    """A field's name as it is shown: words with a capital."""
    return name.replace("_", " ").title()


def item_lines(item: Column, fields: list[str], first: tuple[str, ...] = (), limit: int = 300) -> Column:
    """All filled fields of an item, one `Name: value` per line, those of `first` before the others by name; null if none is filled."""
    order = [*[f for f in first if f in fields], *sorted(f for f in fields if f not in first)]
    cut = lambda c: F.when(F.length(c) > limit, F.concat(F.substring(c, 1, limit), F.lit("..."))).otherwise(c)
    lines = F.array(*[F.concat(F.lit(f"{title_case(f)}: "), cut(non_blank(item[f]))) for f in order])
    return F.nullif(F.array_join(F.filter(lines, lambda x: x.isNotNull()), "\n"), F.lit(""))


def banner_text(df: DataFrame, history: str = "history", source: str = "", first: tuple[str, ...] = ()) -> Column:
    """A history as a document: a heading between rulers, items parted by rules."""
    fields = _fields(df, history)
    shown = F.filter(F.transform(history, lambda x: item_lines(x, fields, first)), lambda t: t.isNotNull())
    head = f"\n{BANNER}\nUser History{f' (from {source})' if source else ''}\n{BANNER}\n"
    return F.when(F.size(F.coalesce(shown, F.array().cast("array<string>"))) > 0, F.concat(F.lit(head), F.array_join(shown, RULER), F.lit("\n" + BANNER))).otherwise(F.lit(NO_HISTORY))


def chosen_dialogue(turns: DataFrame) -> DataFrame:
    """Each conversation as text: the user's turns and the chosen turns of the model, one per line (`record_id`, `conversation`, `dialogue`)."""
    line = F.when(F.col("role") == "user", F.concat(F.lit("User (Turn "), F.coalesce("turn", F.lit("")), F.lit("): "), F.coalesce("content", F.lit("")))).when(
        (F.col("role") == "model") & (F.col("if_chosen") == "true"), F.concat(F.lit("Assistant (Turn "), F.coalesce("turn", F.lit("")), F.lit("): "), F.coalesce("content", F.lit("")))
    )
    told = turns.select("record_id", F.col("parent_pos").alias("conversation"), "pos", line.alias("line")).where("line is not null")
    return told.groupBy("record_id", "conversation").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n").alias("dialogue"))


def expanding_prefixes(df: DataFrame, single: bool = False, key: str = "record_id") -> DataFrame:
    """One row per prefix of a history that a profile is asked for (`key`, `custom_id`, `last`: place of its newest item, `n_items`).

    Prefixes end at each place from the fifth item on, or from the last but at most the fourth of a shorter history; `single`
    asks for the whole history only. Null and empty histories give no row; a null user is `unknown`.
    """
    n = F.size("history")
    start = F.when(F.lit(4) >= n, F.least(F.lit(3), n - 1)).otherwise(F.lit(4))
    ends = F.array(n - 1) if single else F.sequence(start, n - 1)
    rows = df.where(n > 0).select(key, F.coalesce("user_id", F.lit("unknown")).alias("u"), F.explode(ends).alias("last"))
    return rows.select(key, F.concat("u", F.lit("_"), F.col("last").cast("string")).alias("custom_id"), F.col("last").cast("long").alias("last"), (F.col("last") + 1).cast("long").alias("n_items"))


def history_question(item: Column, task: Column) -> Column:
    """Struct of `input` and `output` of the training row that a history item makes; null where a part is missing or the task is unknown."""
    filled = lambda fields: F.coalesce(*[F.nullif(item[f], F.lit("")) for f in fields])
    case = None
    for name, (asked, text, answer) in HISTORY_QUESTIONS.items():
        made = F.when(filled(text).isNotNull() & filled(answer).isNotNull(), F.struct(F.concat(F.lit(asked), filled(text)).alias("input"), filled(answer).alias("output")))
        case = F.when(task == name, made) if case is None else case.when(task == name, made)
    parts = [filled([f]) for f in ("overall", "description", "summary", "reviewText")]
    review = F.format_string('Generate the review text written by a reviewer who has a given an overall rating of "%s" for a product with description "%s". The summary of the review text is "%s".', *parts[:3])
    there = parts[0].isNotNull() & parts[1].isNotNull() & parts[2].isNotNull() & parts[3].isNotNull()
    return case.when((task == "longlamp_product_review") & there, F.struct(review.alias("input"), parts[3].alias("output")))


def augmented_rows(df: DataFrame, visits: int = 50) -> DataFrame:
    """Training rows from histories (`record_id`, `question_id`, `turn`, `n_before`, `input`, `output`), newest items of each record first.

    Tasks of NOT_AUGMENTED and tasks with ENOUGH_ROWS queries or more give none. A record is visited at most `visits` times, its
    first item never (it has no context); items without question or answer give no row but take their turn. `turn` orders rows
    of different records as if they were visited in rounds.
    """
    sizes = df.groupBy("task").agg(F.sum(F.coalesce(F.size("query"), F.lit(0))).alias("n_rows"))
    small = sizes.where(F.col("n_rows") < ENOUGH_ROWS).where(~F.col("task").isin(*NOT_AUGMENTED)).select("task")
    rows = df.join(F.broadcast(small), "task", "left_semi").where(F.size("history") > 1)  # one row per task
    items = rows.select("record_id", "user_id", "task", F.size("history").alias("n"), F.posexplode("history").alias("pos", "item"))
    turns = items.withColumn("turn", F.col("n") - F.col("pos")).where((F.col("pos") >= 1) & (F.col("turn") <= visits)).withColumn("made", history_question(F.col("item"), F.col("task"))).where("made is not null")
    question = F.concat_ws("_", F.col("task"), F.coalesce("user_id", F.lit("unknown")), F.lit("history"), F.col("pos").cast("string"))
    return turns.select("record_id", question.alias("question_id"), F.col("turn").cast("long").alias("turn"), F.col("pos").cast("long").alias("n_before"), "made.input", "made.output")


def flat_rows(df: DataFrame, prefix: str, split: Column, question: str, answer: str, *line: str) -> DataFrame:
    """Rows of a flat source as samples (`user_id`, `question_id`, `profile_text`, `input`, `output`).

    The question id is the row's own, with the split behind it; where the source has none, `prefix`, user and line number.
    """
    own = F.col("question_id") if "question_id" in df.columns else F.concat_ws("_", F.lit(prefix), F.col("user_id"), *[F.col(c).cast("string") for c in line])
    return df.select("user_id", F.concat_ws("_", own, split).alias("question_id"), F.coalesce(strip("profile_text"), F.lit("")).alias("profile_text"), F.col(question).alias("input"), F.col(answer).alias("output"))


def query_chosen(records: DataFrame, threshold: float = 80.0, model: str = "gpt-4") -> DataFrame:
    """Queries whose answer was chosen with a sufficient score and given by the wanted model (`record_id`, `pos`, `conversation`, `score`, `model_name`).

    A query names its conversation (its own place without a name). The chosen model turn with the answer's text counts, or, if that
    knows neither score nor model or is missing, the first chosen model turn. An unknown score passes; a query whose
    conversation is not there is left out. Turns are joined by record and conversation: a record bounds both.
    """
    queries = payload_rows(records, "query").selectExpr(
        "record_id", "pos", "coalesce(try_variant_get(node, '$.conversation_idx', 'long'), pos) as conversation",
        "coalesce(try_variant_get(node, '$.output.content', 'string'), try_variant_get(node, '$.output', 'string'), '') as expected",
    )
    there = payload_rows(records, "conversations").selectExpr("record_id", "pos as conversation")
    turns = payload_rows(records, "conversations.conversation_history").selectExpr(
        "record_id", "parent_pos as conversation", "pos as at", "coalesce(try_variant_get(node, '$.content', 'string'), '') as content", "try_variant_get(node, '$.score', 'double') as score",
        "try_variant_get(node, '$.model_name', 'string') as model_name", "try_variant_get(node, '$.role', 'string') as role", "coalesce(try_variant_get(node, '$.if_chosen', 'boolean'), false) as chosen",
    ).where("role = 'model' and chosen")
    asked = queries.join(there, ["record_id", "conversation"])
    met = asked.join(turns, ["record_id", "conversation"], "left")
    found = F.struct("score", "model_name")
    best = met.groupBy("record_id", "pos", "conversation").agg(
        F.min_by(found, F.when(F.col("content") == F.col("expected"), F.col("at"))).alias("exact"), F.min_by(found, "at").alias("first")
    )
    known = F.col("exact.score").isNotNull() | F.col("exact.model_name").isNotNull()
    taken = best.select("record_id", "pos", "conversation", F.when(known, F.col("exact")).otherwise(F.col("first")).alias("f"))
    good = (F.col("f.score").isNull() | (F.col("f.score") >= threshold)) & F.contains(F.lower(F.coalesce("f.model_name", F.lit(""))), F.lit(model.lower()))
    return taken.where(good).select("record_id", "pos", "conversation", F.col("f.score").alias("score"), F.lower("f.model_name").alias("model_name"))


def profile_parts(text: Column) -> Column:
    """Struct of `profile` and `personality` of a text that has either under a heading; empty where not found."""
    s = strip(text)
    quoted = lambda name: strip(F.regexp_extract(s, rf'(?is)##\s*User\s*{name}:\s*"?(.*?)"?(?:\n|$)', 1))
    bare = lambda c: F.btrim(strip(c), F.lit('"'))
    behind = lambda name: F.when(F.contains(s, F.lit(name)), F.substring(s, F.position(F.lit(name), s) + len(name), F.length(s)))
    rest = behind("User Profile:")
    profile = F.coalesce(F.nullif(quoted("Profile"), F.lit("")), bare(F.split_part(rest, F.lit("User Personality:"), F.lit(1))), F.lit(""))
    personality = F.coalesce(F.nullif(quoted("Personality"), F.lit("")), bare(behind("User Personality:")), F.lit(""))
    return F.struct(profile.alias("profile"), personality.alias("personality"))


def fill_users(rows: DataFrame, source: DataFrame, keys: tuple[str, ...], index: str, question: str = "question_id", user: str = "user_id", order: str = "sample_idx") -> DataFrame:
    """Rows with their missing users filled in: by the first of `keys` that is a known question, else by their place in the source.

    Of a question's several users the last in `order` counts, null ones left out; rows without a question are not looked up. Users that are there
    stay. `index` is the row's place, compared with `order`.
    """
    known = source.where(f"`{question}` is not null and `{user}` is not null").groupBy(F.col(question).cast("string").alias("_q")).agg(F.max_by(user, order).alias("_u"))
    placed = source.select(F.col(order).alias("_at"), F.col(user).alias("_placed"))
    missing = F.coalesce(F.col(user), F.lit("")) == ""
    out = rows.where(missing)
    for i, key in enumerate(keys):
        out = out.join(known.select(F.col("_q").alias(f"_q{i}"), F.col("_u").alias(f"_u{i}")), F.col(key).cast("string") == F.col(f"_q{i}"), "left").drop(f"_q{i}")
    out = out.join(placed, F.col(index) == F.col("_at"), "left")
    found = F.coalesce(*[F.col(f"_u{i}") for i in range(len(keys))], F.col("_placed"))
    filled = out.withColumn(user, F.coalesce(F.nullif(found, F.lit("")), F.col(user))).select(*rows.columns)
    return filled.unionByName(rows.where(~missing))
