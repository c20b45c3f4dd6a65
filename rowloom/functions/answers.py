"""Reading answers out of generated text, as column builders. All of them give null where nothing is found."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rowloom.functions.text import strip

#: Fixed value: what a number may look like when a whole text is read as one.
NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
#: A number with thousands commas; the same with a sign and a currency; any number of a rating; one of a worked solution.
GROUPED = r"[0-9]{1,3}(?:,[0-9]{3})*(?:\.[0-9]+)?"
SIGNED = r"[\$€£]?[+-]?[0-9]{1,3}(?:,[0-9]{3})*(?:\.[0-9]+)?"
RATED = r"-?[0-9]+\.?[0-9]*"
WORKED = r"-?[$0-9.,]{2,}|-?[0-9]+"
#: Patterns of a judge's score in their order, the first that fits counts.
SCORE_PATTERNS = [
    r"\[RESULT\]\s*([1-5])",
    r"(?i)\[Result\]\s*([1-5])",
    r"\*\*\[RESULT\]\*\*\s*([1-5])",
    r"RESULT:\s+([1-5])",
    r"(?i)\*\*Result\*\*:\s*([1-5])",
    r"(?i)\*\*Result:\*\*\s*([1-5])",
    r"(?i)\*\*Score\*\*:\s*([1-5])",
    r"(?i)\*\*Score:\*\*\s*([1-5])",
    r"(?i)Score:\s*([1-5])",
    r"(?i)Result:\s*([1-5])",
    r"(?i)Score:\s*\*\*([1-5])\*\*",
    r"(?i)Score\s+([1-5])",
]
#: A score that is the whole text, and one that stands alone.
ONLY_SCORE, LONE_SCORE = r"^([1-5])$", r"(?:^|[^0-9])([1-5])(?=[^0-9]|$)"
#: Verdicts of a judge in their order, and a letter that stands alone.
VERDICT_PATTERNS = [r"\[\[\s*([ABCabc])\s*\]\]", r"(?i)\[RESULT\]\s*([ABC])\b", r"(?i)(?:Result|Winner)\s*:?\s*([ABC])\b"]
LONE_VERDICT = r"(?i)(?:^|[^A-Za-z0-9_])([ABC])(?:[^A-Za-z0-9_]|$)"
#: How a class is named, and the signs around it.
CLASS_PATTERNS = ['["\']([^"\']+)["\']', r"label:\s*(\S+)", r"class:\s*(\S+)", r"category:\s*(\S+)", r"answer:\s*(\S+)", r"prediction:\s*(\S+)", r"^\s*(\S+)"]
CLASS_SIGNS = ".,!?()"
#: Signs around an answer that do not count.
ANSWER_SIGNS = ":`'\"(.) "
#: Words that stand for true and false, in their order of precedence.
BOOLEAN_WORDS = [("1", True), ("0", False), ("yes", True), ("no", False), ("true", True), ("false", False), ("positive", True), ("negative", False), ("valid", True), ("invalid", False)]


def first_match(column: Column, pattern: str, group: int = 1) -> Column:
    """What the pattern's group matches first; null without a match."""
    return F.nullif(F.regexp_extract(column, pattern, group), F.lit(""))


def whole_number(column: Column) -> Column:
    """The text as a number, if all of it is one."""
    text = strip(column)
    return F.when(text.rlike(NUMBER), text.try_cast("double"))


def first_number(column: Column) -> Column:
    """The first number, thousands commas read as such; a sign does not belong to it."""
    return F.replace(first_match(column, f"({GROUPED})"), F.lit(","), F.lit("")).try_cast("double")


def last_number(column: Column) -> Column:
    """The last number with its sign, without currency and thousands commas."""
    found = F.try_element_at(F.regexp_extract_all(column, F.lit(f"({SIGNED})"), F.lit(1)), F.lit(-1))
    return F.regexp_replace(found, r"[\$€£,]", "").try_cast("double")


def numeric_value(column: Column) -> Column:
    """The text as a number, or the first number in it."""
    return F.coalesce(whole_number(column), first_match(column, f"({RATED})").try_cast("double"))


def choice(column: Column) -> Column:
    """The letter or digit that a cleaned, lowered answer begins with."""
    return first_match(F.lower(F.btrim(column, F.lit(ANSWER_SIGNS))), r"^([a-z0-9])")


def boolean_word(column: Column, words: list[tuple[str, bool]] = BOOLEAN_WORDS) -> Column:
    """True or false by the first of the known words that the text contains, in their order of precedence."""
    text = F.lower(column)
    case = None
    for word, value in words:
        case = F.when(F.contains(text, F.lit(word)), F.lit(value)) if case is None else case.when(F.contains(text, F.lit(word)), F.lit(value))
    return case


def worked_number(column: Column) -> Column:
    """The last number of a worked solution, without outer currency signs and points and without thousands commas."""
    found = F.regexp_extract_all(column, F.lit(f"({WORKED})"), F.lit(1))
    last = F.replace(F.btrim(F.try_element_at(found, F.lit(-1)), F.lit("$.")), F.lit(","), F.lit(""))
    return F.when(last.rlike(NUMBER), last.try_cast("double"))


def judge_score(column: Column) -> Column:
    """A judge's score of 1 to 5: by the known patterns in order, a lone digit, or the last digit standing alone."""
    alone = F.try_element_at(F.regexp_extract_all(column, F.lit(LONE_SCORE), F.lit(1)), F.lit(-1))
    return F.coalesce(*[first_match(column, p) for p in SCORE_PATTERNS], first_match(strip(column), ONLY_SCORE), F.nullif(alone, F.lit(""))).cast("int")


def pairwise_winner(column: Column) -> Column:
    """A judge's verdict A, B or C: [[A]], [RESULT] A, Winner: A, or the last of the letters standing alone."""
    alone = F.try_element_at(F.regexp_extract_all(column, F.lit(LONE_VERDICT), F.lit(1)), F.lit(-1))
    return F.upper(F.coalesce(*[first_match(column, p) for p in VERDICT_PATTERNS], F.nullif(alone, F.lit(""))))


def class_label(column: Column) -> Column:
    """A class in lower case: in quotation marks, else behind the first known prefix that is there, else the first word."""
    text = F.lower(strip(column))
    quoted, *others = [first_match(text, p) for p in CLASS_PATTERNS]
    return F.coalesce(quoted, *[F.nullif(F.btrim(o, F.lit(CLASS_SIGNS)), F.lit("")) for o in others])


def similar_score(column: Column) -> Column:
    """A similarity score: the whole text as a number, else the first number in it between 0 and 5."""
    found = first_number(column)
    return F.coalesce(whole_number(column), F.when(found.between(0, 5), found))


def _as_number(generated: Column, target: Column) -> Column:
    """Whether the generated text is a number that is written like the target ("5" answers "5.0", not the other way round)."""
    return F.coalesce(whole_number(generated).cast("string") == strip(target), F.lit(False))


def exact_answer(generated: Column, target: Column) -> Column:
    """Whether two answers agree without case and outer points, or the generated number is written like the target."""
    bare = lambda c: F.lower(F.btrim(c, F.lit(".")))
    return F.coalesce(bare(generated) == bare(target), F.lit(False)) | _as_number(generated, target)


def loose_answer(generated: Column, target: Column) -> Column:
    """The same without outer blanks, quotes, colons and brackets as well."""
    bare = lambda c: F.lower(F.btrim(strip(c), F.lit(ANSWER_SIGNS)))
    return F.coalesce(bare(generated) == bare(target), F.lit(False)) | _as_number(generated, target)
