"""Meaning of names and ids: versions, request ids, data set and task names, as column builders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Endings that a data set name may carry, and data sets whose profiles are always generated.
ENDINGS = "_random_train|_random_test|_ood_train|_ood_test|_train|_test"
GENERATED_ONLY = ("personalreddit", "prism", "aloe", "ec")
#: Parts of task names by the kind of answer.
CLASSIFICATION, RATING = ("movie", "news_cat", "citation", "opinionqa"), ("lamp_product",)


def version_number(name: Column) -> Column:
    """The number of a name v<digits>; 0 for others."""
    return F.coalesce(F.regexp_extract(name, r"^v(\d+)$", 1).try_cast("int"), F.lit(0))


def request_user(custom_id: Column) -> Column:
    """The user of a request id `<user>_<number>`; an id without a number is the user itself."""
    return F.regexp_replace(custom_id, r"_[0-9]+$", "")


def request_number(custom_id: Column) -> Column:
    return F.regexp_extract(custom_id, r"_([0-9]+)$", 1).try_cast("long")


def base_name(name: Column) -> Column:
    """A data set name in lower case, without prefixes such as RAG_ and without split endings, repeated ones included."""
    return F.regexp_replace(F.regexp_replace(F.lower(name), r"^(all_history_|rag_|pag_)+", ""), f"({ENDINGS})+$", "")


def name_split(name: Column) -> Column:
    """The split that a name ends with; null if none."""
    return F.nullif(F.regexp_replace(F.regexp_extract(F.lower(name), f"({ENDINGS})$", 1), "^_", ""), F.lit(""))


def generated_only(name: Column) -> Column:
    """Whether a part of the name (between / _ and -) is a data set with generated profiles only."""
    return F.arrays_overlap(F.split(F.lower(name), "[/_-]"), F.array(*[F.lit(x) for x in GENERATED_ONLY]))


def task_kind(name: Column) -> Column:
    """classification, rating or generation, by the name's parts; product reviews that are written out are generation."""
    case = F.when(F.contains(name, F.lit("product_review")), "generation")
    for part in RATING:
        case = case.when(F.contains(name, F.lit(part)), "rating")
    for part in CLASSIFICATION:
        case = case.when(F.contains(name, F.lit(part)), "classification")
    return case.otherwise("generation")
