import math

import pytest
from pyspark.sql import functions as F

from rowloom.functions import answers as an
from rowloom.functions import parsing, text, vectors


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(
    ("column", "value", "expected"),
    [
        (text.strip, " \n a\tb　 ", "a\tb"), (text.strip, None, None), (text.non_blank, " \t", None),
        (lambda c: text.truncate(c, 3), "abcd", "abc..."), (lambda c: text.truncate(c, 3), "abc", "abc"), (text.token_estimate, "abcdefghi", 2), (text.token_estimate, None, 0),
        (an.numeric_value, "4", 4.0), (an.numeric_value, "Score: 4.5!", 4.5), (an.numeric_value, "n/a", None), (an.whole_number, "1f", None), (an.whole_number, "1_000", None), (an.whole_number, " -2e3 ", -2000.0),
        (an.choice, "(B)", "b"), (an.choice, "10", "1"), (an.choice, "", None), (an.boolean_word, "invalid", True), (an.boolean_word, "I know", False), (an.boolean_word, "hm", None),
        (an.judge_score, "[RESULT] 4", 4), (an.judge_score, "**Score:** 3", 3), (an.judge_score, "I give 2 of 9", 2), (an.judge_score, "none", None), (an.judge_score, " 5 ", 5),
        (an.pairwise_winner, "so [[a]]", "A"), (an.pairwise_winner, "Winner: B", "B"), (an.pairwise_winner, "tie, C", "C"), (an.pairwise_winner, "", None),
        (an.worked_number, "so $1,234.", 1234.0), (an.worked_number, "is 7", 7.0), (an.last_number, "1 then -2.5", -2.5), (an.class_label, "Label: Crime, I think", "crime"), (an.similar_score, "about 9", None),
        (lambda c: parsing.split_once(c, "review:")["body"], "Rate. review: good: yes", "good: yes"), (lambda c: parsing.split_once(c, "review:")["body"], "nothing", ""),
        (parsing.bracket_list, "tags: [a, b c ,d] x", ["a", "b c", "d"]), (parsing.outline_items, "1. one\n2. two", ["one", "two"]),
    ],
)
def test_text_columns(spark, column, value, expected):
    assert one(spark, column, value) == expected


def test_one_decimal_rounds_half_even(spark):
    for value, shown in ((6.25, "6.2"), (6.75, "6.8"), (12.5, "12.5"), (33.333, "33.3"), (100.0, "100.0")):
        assert one(spark, text.one_decimal, value, "double") == shown


def test_templates(spark):
    df = spark.createDataFrame([("a", None)], "x string, y string")
    assert df.select(text.render_template("<{x}|{y}>", {"x": F.col("x"), "y": F.col("y")})).first()[0] == "<a|>"
    with pytest.raises(KeyError):
        text.render_template("{z}", {"x": F.col("x")})


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0], [0.0, 0.0])], "a array<float>, b array<float>, z array<float>")
    got = df.select(vectors.norm(F.col("a")), vectors.cosine(F.col("a"), F.col("b")), vectors.cosine(F.col("a"), F.col("z")), vectors.unit(F.col("z")), vectors.distance(F.col("a"), F.col("b")), vectors.scaled_unit(F.col("a"))).first()
    assert got[0] == 5.0 and math.isclose(got[1], 0.96) and got[2] is None and got[3] is None and math.isclose(got[4], math.sqrt(2)) and math.isclose(got[5][0], 0.6 * math.sqrt(2))
