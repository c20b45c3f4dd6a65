import json

import pytest
from pyspark.sql import functions as F

from rowloom.operators import nested, skew
from rowloom.plans import nested_skew

from .conftest import rows

HISTORY = "record_id long, user_id string, history array<struct<id:string,text:string,article:string,title:string,category:string,description:string,tag:string,citation:string,score:string,overall:string,summary:string,reviewText:string,abstract:string,content:string>>, query array<struct<id:string,input:string,gold:string,output:string>>, path string"


def item(**k):
    names = ["id", "text", "article", "title", "category", "description", "tag", "citation", "score", "overall", "summary", "reviewText", "abstract", "content"]
    return tuple(k.get(n) for n in names)


@pytest.fixture
def history(spark):
    return spark.createDataFrame(
        [(1, "u", [item(id="a"), None, item(id="b")], [("q", "i", None, "o")], "clash"), (2, None, None, [], "clash"), (2, None, None, [], "clash")], HISTORY
    )


def payloads(spark, *texts):
    return spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "record_id long, payload string, pos string")


def test_typed_elements_and_nulls(spark, history):
    assert rows(nested.typed_links(history).select("record_id", "path", "parent_pos", "pos")) == [(1, "history", -1, 0), (1, "history", -1, 2), (1, "query", -1, 0)]


@pytest.mark.parametrize(
    ("text", "found"),
    [
        (None, []), ("", []), ("   ", []), ("[1]", []), ('{"history":[{"a":1}]} {"b":2}', []), ('{"history":[{"a":1}]} x', []), ('{"history":[{"a":1}]', []), ('{"history":[{"a":1}]},{"history":[{}]}', []),
        ('{"history":[{"a":1},2,null,"s",{"b":2}]}', [("history", -1, 0), ("history", -1, 4)]),
        ('{"history":{"a":1}}', [("history", -1, 0)]),
        ('{"history":"[{\\"a\\":1},3,{}]"}', [("history", -1, 0), ("history", -1, 2)]),
        ('{"history":"no json","query":null}', []),
        ('{"query":[{"input":"[{\\"a\\":1}]"},{"input":[{"r":1},5,{"r":2}]},{"input":{"r":1}}]}', [("query", -1, 0), ("query", -1, 1), ("query", -1, 2), ("query.input", 1, 0), ("query.input", 1, 2), ("query.input", 2, 0)]),
        ('{"conversations":[0,{"conversation_history":"[{\\"u\\":1}]"}]}', [("conversations", -1, 1), ("conversations.conversation_history", 1, 0)]),
    ],
)
def test_payload_shapes(spark, text, found):
    df = nested.payload_links(payloads(spark, text))
    assert rows(df.select("path", "parent_pos", "pos")) == sorted(found)


def test_repeated_records_and_empty_tables(spark, history):
    text = json.dumps({"history": [{"a": 1}]})
    assert nested.payload_links(payloads(spark, text, text)).count() == 2
    none = payloads(spark, text).where("false")
    assert nested.nested_links(history.where("false"), none).count() == 0
    for flat in (nested.flat_turns, nested.flat_conversations, nested.flat_query_input):
        assert flat(none).count() == 0


def test_flat_tables_keep_parents(spark, history):
    text = json.dumps({"user_id": 7, "conversations": [{"conversation_id": "c", "conversation_history": [{"user": "hi", "assistant": {"preferred": "yes"}, "chosen": "preferred"}]}]})
    got = nested.flat_turns(payloads(spark, text)).select("user_id", "parent_pos", "pos", "user", "assistant_preferred", "role").collect()
    assert [tuple(r) for r in got] == [("7", 0, 0, "hi", "yes", None)]
    assert nested.flat_history(history, payloads(spark, text)).where("id = 'b'").count() == 1


def test_salted_stats_match_plain(spark):
    data = [("A " if i % 2 else "a", f"q{i % 7}", "x" * (i % 5), i) for i in range(200)] + [("b", None, None, 1), (None, "q", "yy", 2), ("  ", "q", "z", 3)]
    df = spark.createDataFrame(data, "user_id string, question_id string, output string, salt int")
    assert rows(skew.salted_user_stats(df, share=0.1)) == [("a", 200, 7, 200, sum(i % 5 for i in range(200)), 0, 4), ("b", 1, 0, 0, 0, None, None)]
    assert skew.salted_user_stats(df.where("false")).count() == 0


def test_heavy_users_come_from_the_salted_results(spark, tmp_path, monkeypatch):
    data = [("a ", "q1", "x"), ("A", None, None), ("b", "q", "y")] + [(None, "q", "z")] * 97
    spark.createDataFrame(data, "user_id string, question_id string, output string").write.parquet(str(tmp_path / "dataset_item.parquet"))
    used = []
    whole = skew.salted_user_stats
    monkeypatch.setattr(skew, "salted_user_stats", lambda *a, **k: used.append(1) or whole(*a, **k))
    assert rows(nested_skew.p6_found(spark, str(tmp_path))) == [("a",)] and used


def test_heavy_keys_at_the_limit(spark):
    df = spark.createDataFrame([("a",)] * 2 + [("b",)] + [(None,)] * 97, "k string")
    assert rows(skew.heavy_keys(df, F.col("k"), 0.02)) == [("a", 2, 100)]
    assert skew.heavy_keys(df.where("false"), F.col("k"), 0.02).count() == 0


def test_join_lookup_equals_join(spark):
    left = spark.createDataFrame([("hot", i) for i in range(50)] + [(f"k{i}", i) for i in range(30)] + [(None, 1)], "key string, v int")
    right = spark.createDataFrame([("hot", "H"), ("k1", "one"), ("zz", "no")], "key string, w string")
    assert rows(skew.join_lookup(left, right, "key", 0.2)) == rows(left.join(right, "key"))
