"""Scores of a generated against a target text, by name; every entry is a column builder that gives a number per row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowloom.functions import answers as an
from rowloom.functions.checks import meteor_scores, number_words, rouge_scores
from rowloom.functions.text import strip

Metric = Callable[[Column, Column], Column]

#: Class names by number of the encyclopedia classes.
CLASSES = "Company EducationalInstitution Artist Athlete OfficeHolder MeanOfTransportation Building NaturalPlace Village Animal Plant Album Film WrittenWork".split()
#: Fixed value: how a span answer is printed.
SPAN_START = "{'spans': array(['"
#: Words for true and false without valid and invalid.
SHORT_BOOLEANS = an.BOOLEAN_WORDS[:8]


def _score(condition: Column) -> Column:
    """1 where the condition holds, 0 where it does not or is unknown."""
    return F.coalesce(condition, F.lit(False)).cast("double")


def accuracy(generated: Column, target: Column) -> Column:
    return _score(an.exact_answer(generated, target))


def shared_digit(digits: str) -> Metric:
    """Accuracy, or one of the digits in both texts."""

    def score(generated: Column, target: Column) -> Column:
        both = [F.contains(generated, F.lit(d)) & F.contains(target, F.lit(d)) for d in digits]
        found = an.exact_answer(generated, target)
        for b in both:
            found = found | F.coalesce(b, F.lit(False))
        return _score(found)

    return score


def same_boolean(words: list[tuple[str, bool]]) -> Metric:
    """Whether both texts say the same in terms of true and false; unclear texts agree with nothing."""
    return lambda generated, target: _score(an.boolean_word(generated, words) == an.boolean_word(target, words))


def contains_answer(generated: Column, target: Column) -> Column:
    """Accuracy, or the target anywhere in the generated text, without case."""
    return _score(an.exact_answer(generated, target) | F.coalesce(F.contains(F.lower(generated), F.lower(target)), F.lit(False)))


def number_gap(generated: Column, target: Column) -> Column:
    """Distance of the numbers of two texts; 0, as if they agreed, where one has none."""
    return F.coalesce(F.abs(an.numeric_value(generated) - an.numeric_value(target)), F.lit(0.0))


def same_label(generated: Column, target: Column) -> Column:
    """Whether two texts are equal without case and outer blanks, or name the same class."""
    bare = lambda c: F.lower(strip(c))
    return _score((bare(generated) == bare(target)) | F.coalesce(an.class_label(generated) == an.class_label(target), F.lit(False)))


def similarity(generated: Column, target: Column) -> Column:
    """One less a fifth of the distance of two similarity scores; 0 where one is unclear."""
    return F.coalesce(1 - F.abs(an.similar_score(generated) - an.similar_score(target)) / 5, F.lit(0.0))


def worked_answer(generated: Column, target: Column) -> Column:
    return _score(an.worked_number(generated) == an.worked_number(target))


def choice_answer(generated: Column, target: Column) -> Column:
    return _score(an.choice(generated) == an.choice(target))


def class_of_number(generated: Column, target: Column) -> Column:
    """ROUGE-L of the class that the generated number stands for; other texts are compared as they are."""
    names = F.array(*[F.lit(c) for c in CLASSES])
    number = F.when(strip(generated).rlike(r"^[+-]?[0-9]+$"), strip(generated).try_cast("int"))
    at = F.when(number < 0, number + len(CLASSES)).otherwise(number)
    return rouge_scores(F.coalesce(F.get(names, at), generated), target)


def printed_span(column: Column) -> Column:
    """The first span of a printed answer, in lower case, whole numbers written as words."""
    from_bracket = F.substring(column, F.position(F.lit("["), column) + 2, F.length(column))
    span = F.lower(F.regexp_extract(from_bracket, r"^([^\]]*).\]", 1))
    return F.coalesce(number_words(span), span)


def span_answer(generated: Column, target: Column) -> Column:
    """ROUGE-L of two span answers; the generated one may be plain text. A number matches its words."""
    low = F.lower(generated)
    plain = F.coalesce(number_words(low), low)
    return rouge_scores(F.when(F.startswith(low, F.lit(SPAN_START)), printed_span(low)).otherwise(plain), printed_span(target))


def label_and_explanation(generated: Column, target: Column) -> Column:
    """ROUGE-L of the explanations of two JSON answers of a label and an explanation, 0 unless the labels agree."""
    kind = T.MapType(T.StringType(), T.StringType())
    a, b = F.from_json(generated, kind), F.from_json(target, kind)
    label = lambda m: F.element_at(F.map_values(F.map_filter(m, lambda k, v: k != "explanation")), 1)
    name = lambda m: F.element_at(F.map_keys(F.map_filter(m, lambda k, v: k != "explanation")), 1)
    valid = (F.size(a) == 2) & (F.size(b) == 2) & F.map_contains_key(a, "explanation") & F.map_contains_key(b, "explanation") & name(a).isNotNull() & name(b).isNotNull()
    return F.when(valid & (label(a) == label(b)), rouge_scores(a["explanation"], b["explanation"])).otherwise(F.lit(0.0))


#: Metrics by their public names.
METRICS: dict[str, Metric] = {
    "accuracy": accuracy,
    "rouge": rouge_scores,
    "rouge_batch": rouge_scores,
    "meteor": meteor_scores,
    "mae": number_gap,
    "rmse": number_gap,
    "f1": same_label,
    "stsb": similarity,
    "dbpedia": class_of_number,
    "drop": span_answer,
    "label_and_explanation": label_and_explanation,
    "binary_accuracy_flex": same_boolean(SHORT_BOOLEANS),
    "gsm8k_regex": worked_answer,
    "mrpc_accuracy": shared_digit("12"),
    "mnli_accuracy": shared_digit("012"),
    "hellaswag_accuracy": shared_digit("0123"),
    "customer_support_accuracy": contains_answer,
    "amazon_review_mpe": similarity,
}

#: How the answers of public benchmarks are judged, by benchmark.
TASK_METRICS: dict[str, Metric] = {
    "winogrande": choice_answer,
    "boolq": same_boolean(an.BOOLEAN_WORDS),
    "piqa": choice_answer,
    "hellaswag": choice_answer,
    "arc": choice_answer,
    "openbookqa": choice_answer,
    "opinionqa": choice_answer,
}

#: Metrics that need no Python.
NATIVE_METRICS = tuple(n for n in METRICS if n not in ("rouge", "rouge_batch", "meteor", "dbpedia", "drop", "label_and_explanation"))


def score(name: str, generated: Column, target: Column) -> Column:
    """A metric by its name; an unknown name raises when the plan is built."""
    if name not in METRICS:
        raise KeyError(f"no metric {name!r}; known are {sorted(METRICS)}")
    return METRICS[name](generated, target)


def problem_answer(kind: Column, generated: Column, answer: Column) -> Column:
    """Whether a reply answers a problem by its format: the first true or false, or the first letter A to D, standing alone; null for others."""
    truth = an.first_match(F.lower(generated), r"\b(true|false)\b")
    letter = an.first_match(generated, r"(?i)\b([ABCD])\b")
    return F.when(kind == "Assertion", F.coalesce(truth == F.lower(answer), F.lit(False))).when(kind == "Multiple-choice", F.coalesce(F.lower(letter) == F.lower(answer), F.lit(False)))
