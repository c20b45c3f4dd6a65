"""Curation, registry, evaluation, split and source operators on hand-made cases."""

import json

import pytest
from pyspark.sql import functions as F

from rowloom.functions import checks, matching, parsing, prompts, templates, vectors
from rowloom.functions import answers as an
from rowloom.operators import curation, evaluation, policies, results, retrieval, sampling
from rowloom.sources import benchmarks

from .conftest import rows

HISTORY = "record_id long, user_id string, task string, history array<struct<description:string,tag:string,text:string,article:string,category:string,title:string,citation:string,score:string,overall:string,reviewText:string,abstract:string,summary:string,content:string,id:string>>, query array<struct<input:string>>"


def histories(spark, *data):
    names = [f.split(":")[0] for f in HISTORY.split("struct<")[1].split(">>")[0].split(",")]
    made = [(k, u, t, None if h is None else [None if x is None else tuple(x.get(n) for n in names) for x in h], [("q",)]) for k, (u, t, h) in enumerate(data)]
    return spark.createDataFrame(made, HISTORY)


def score(spark, name, g, t):
    return spark.createDataFrame([(g, t)], "g string, t string").select(matching.score(name, F.col("g"), F.col("t"))).first()[0]


@pytest.mark.parametrize(
    ("name", "generated", "target", "expected"),
    [
        ("accuracy", "Yes.", "yes", 1), ("accuracy", "5", "5.0", 1), ("accuracy", "5.0", "5", 0), ("accuracy", None, "x", 0), ("mae", "n/a", "3", 0), ("mae", "4.5 stars", "3", 1.5), ("stsb", "about 3", "5", 0.6), ("stsb", "9 of 9", "5", 0),
        ("stsb", "7", "5", 0.6), ("mrpc_accuracy", "it is 2", "2", 1), ("mrpc_accuracy", "it is 0", "0", 0), ("mnli_accuracy", "it is 0", "0", 1), ("customer_support_accuracy", "The answer: REFUND", "refund", 1),
        ("f1", "label: crime!", "Crime", 1), ("f1", "", "", 1), ("gsm8k_regex", "so $1,234.", "#### 1234", 1), ("gsm8k_regex", "none", "4", 0), ("binary_accuracy_flex", "yes", "true", 1), ("binary_accuracy_flex", "hm", "true", 0),
        ("dbpedia", "2", "Artist", 1), ("dbpedia", "-1", "WrittenWork", 1), ("drop", "1", "{'spans': array(['one'], dtype=object)}", 1), ("drop", "{'spans': array(['86598'], dtype=object)}", "{'spans': array(['86598'], dtype=object)}", 1),
        ("label_and_explanation", '{"l": 1, "explanation": "a b"}', '{"l": 1, "explanation": "a b"}', 1), ("label_and_explanation", '{"l": 2, "explanation": "a b"}', '{"l": 1, "explanation": "a b"}', 0), ("label_and_explanation", "broken", "{}", 0),
    ],
)
def test_registry(spark, name, generated, target, expected):
    assert score(spark, name, generated, target) == pytest.approx(expected)


def test_registry_is_whole(spark):
    assert len(matching.METRICS) == 18 and set(matching.TASK_METRICS) >= {"winogrande", "boolq", "piqa", "hellaswag", "arc", "openbookqa"}
    with pytest.raises(KeyError):
        matching.score("nothing", F.lit(""), F.lit(""))


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x")).alias("y")).first()["y"]


def test_numbers_and_scores(spark):
    assert one(spark, an.first_number, "pays 1,234.50 of -7") == 1234.5 and one(spark, an.first_number, "-3") == 3 and one(spark, an.last_number, "a 5 then -€2,000") == 2000
    assert one(spark, an.judge_score, "**[RESULT]** 4 then [RESULT] 3") == 3 and one(spark, an.judge_score, "Result: 2, Score: 5") == 5 and one(spark, an.judge_score, "4 5") == 5
    assert [checks.words_of_number(x) for x in ("0", "21", "105", "1000", "1234567", "-8", "x", None)] == ["zero", "twenty-one", "one hundred and five", "one thousand", "one million, two hundred and thirty-four thousand, five hundred and sixty-seven", "minus eight", None, None]


def test_problem_wording_and_answers(spark):
    df = spark.createDataFrame([("Multiple-choice", {"B": "two", "A": "one"}), ("Assertion", None), ("Fill-in-the-blank", None), ("Open-ended", None), ("other", None)], "k string, c map<string,string>")
    got = [r[0] for r in df.select(prompts.problem_prompt(F.lit("Q?"), F.col("k"), F.col("c"))).collect()]
    assert got[0].startswith("Question:Q?\nOptions:\n(A)one\n(B)two\nPlease") and got[1] == "Statement:Q?Please give the answer directly (true or false):" and got[2] == "Question:Q?Answer:" and got[4] is None
    said = spark.createDataFrame([("Assertion", "It is False, not true", "False"), ("Multiple-choice", "A cab is B", "a"), ("Multiple-choice", "cab", "a"), ("Open-ended", "x", "x")], "format string, reply string, answer string")
    assert [r.is_correct for r in evaluation.scored_problems(said).collect()] == [True, True, False]


def test_statement_kinds(spark):
    df = spark.createDataFrame([("counting", True), ("INSERT", False), ("DELETE", True), (None, None)], "type string, correct boolean")
    got = {r.bucket: (r.n, r.acc) for r in results.statement_accuracy(df).collect()}
    assert got["counting"] == (1, 1.0) and got["SELECT"] == (3, pytest.approx(2 / 3)) and got["overall"] == (4, 0.5) and got["UPDATE"] == (0, 0.0) and len(got) == 12


def test_parsers(spark):
    text = 'the title "T", pick [1]: "a" [2]: "b" [1]: "c"'
    assert tuple(one(spark, parsing.citation_fields, text)) == ("T", '[1]: "c"\n[2]: "b"')
    assert tuple(one(spark, parsing.opinion_fields, "Question: Why? Options: A. x B. y Answer:"))[1:] == ("Why?", "A. x B. y") and one(spark, parsing.opinion_fields, "hm").question is None
    assert tuple(one(spark, parsing.topic_fields, "Write it for a reddit post on ferries")) == ("Write it for a reddit post", "on ferries") and one(spark, parsing.topic_fields, "hm") is None
    assert one(spark, lambda c: parsing.parse_input(F.lit("lamp_movie"), c), "Pick. description: a b").fields == {"description": "a b"} and one(spark, lambda c: parsing.parse_input(F.lit("odd"), c), "x").instruction == "x"
    assert one(spark, lambda c: parsing.parse_input(F.lit("lamp_movie"), c), None).instruction is None
    choices = spark.createDataFrame([(["x", "y"], ["1", "2"])], "t array<string>, l array<string>").select(parsing.padded_choices(F.col("t"), F.col("l")).alias("c")).first().c
    assert choices.text == ["x", "y", "N/A", "N/A"] and choices.label == ["1", "2", "3", "4"]
    task = "Definition: Do it.\n\nPositive Example x Now complete the following example -\nInput: p\nOutput:"
    got = spark.createDataFrame([(task, ["a", "b"])], "x string, a array<string>").select(parsing.task_definition(F.col("x"), F.col("a")).alias("d")).first().d
    assert got.problem == "p" and got.answer == "a, b" and got.task_def.startswith("Do it. Please") and "comma-separated" in got.task_def


def test_fitted_histories(spark):
    long = {"description": "d" * 900, "tag": "t"}
    df = histories(spark, ("u", "lamp_movie", [long, None, *[long] * 9]), ("u", "lamp_movie", []), (None, "lamp_movie", None))
    got = {b: {r.record_id: (r.level, None if r.history is None else [len(x.description) for x in r.history]) for r in curation.fit_history(df, b).collect()} for b in (9000, 4000, 3000, 400, 50)}
    # characters of ten printed items: 9310; with values cut at 700: 7380, at 500: 5380; of the last three, at 300: 903
    assert [got[b][0] for b in (9000, 4000, 3000, 400, 50)] == [(0, [900] * 10), (700, [703] * 10), (500, [503] * 10), (-1, [303] * 3), (-1, [])]
    assert all(g[1] == (0, []) for g in got.values()) and all(g[2][1] is None for g in got.values())


def test_renderings_and_prefixes(spark):
    df = histories(spark, ("u", "lamp_movie", [{"description": "a", "tag": "x"}, None, {"tag": " "}]), (None, "lamp_movie", [{"tag": str(k)} for k in range(6)]), ("v", "lamp_tweet", None))
    text = df.orderBy("record_id").select(curation.banner_text(df)).first()[0]
    assert "Description: a\nTag: x" in text and text.count("=" * 50) == 3 and df.orderBy(F.desc("record_id")).select(curation.banner_text(df)).first()[0] == curation.NO_HISTORY
    assert rows(curation.expanding_prefixes(df)) == [(0, "u_2", 2, 3), (1, "unknown_4", 4, 5), (1, "unknown_5", 5, 6)]
    assert rows(curation.expanding_prefixes(df, single=True)) == [(0, "u_2", 2, 3), (1, "unknown_5", 5, 6)]
    made = curation.augmented_rows(histories(spark, ("u", "lamp_movie", [{"description": "a", "tag": "x"}, {"description": "b", "tag": "y"}, {"description": "c"}]), ("u", "lamp_tweet", [{"text": "a"}, {"text": "b"}]), ("u", "odd", [{"text": "a"}, {"text": "b"}]))).collect()
    assert [(r.question_id, r.turn, r.output) for r in made] == [("lamp_movie_u_history_1", 2, "y")]
    parts = one(spark, curation.profile_parts, '## User Profile: "old"\n## User Personality: "calm"')
    assert tuple(parts) == ("old", "calm") and tuple(one(spark, curation.profile_parts, "plain")) == ("", "") and tuple(one(spark, curation.profile_parts, None)) == ("", "")


def test_chosen_answers(spark):
    turns = [{"role": "user", "content": "q"}, {"role": "model", "content": "a", "score": 79, "if_chosen": True, "model_name": "gpt-4"}, {"role": "model", "content": "b", "if_chosen": True, "model_name": "GPT-4-turbo"}]
    payloads = [
        {"conversations": [{"conversation_history": turns}], "query": [{"conversation_idx": 0, "output": {"content": c}} for c in ("a", "b", "zz")] + [{"conversation_idx": 7, "output": {"content": "b"}}]},
        {"conversations": [{"conversation_history": turns[:1]}], "query": [{"output": {"content": "a"}}]},
    ]
    df = spark.createDataFrame([(k, json.dumps(p)) for k, p in enumerate(payloads)], "record_id long, payload string")
    assert rows(curation.query_chosen(df)) == [(0, 1, 0, None, "gpt-4-turbo")]  # 79 is too low, the unknown text falls back to it, index 7 is not there
    assert rows(curation.query_chosen(df, 70)) == [(0, 0, 0, 79.0, "gpt-4"), (0, 1, 0, None, "gpt-4-turbo"), (0, 2, 0, 79.0, "gpt-4")]


def test_fill_users(spark):
    source = spark.createDataFrame([(0, "q", "a"), (1, "q", "b"), (2, None, "c"), (3, "r", None), (4, "q", None)], "sample_idx long, question_id string, user_id string")
    df = spark.createDataFrame([(9, "q", None), (2, None, ""), (7, "q", "z"), (8, None, None)], "sample_id long, question_id string, user_id string")
    assert {r.sample_id: r.user_id for r in curation.fill_users(df, source, ("question_id", "sample_id"), "sample_id").collect()} == {2: "c", 7: "z", 8: None, 9: "b"}


def test_evaluation_contracts(spark):
    df = spark.createDataFrame([("lamp_movie", "a", "A"), ("lamp_movie", "b", "a"), ("lamp_product", "4", "5"), ("lamp_product", "x", "5"), ("lamp_tweet", "a b", "a b"), ("lamp_tweet", "a", "")], "task string, predicted string, target string")
    got = {(r.task, r.metric): r.value for r in evaluation.task_metrics(df).collect()}
    assert got["lamp_movie", "accuracy"] == 0.5 and got["lamp_product", "mae"] == 1.0 and got["lamp_tweet", "meteor"] == 1.0
    calls = []

    def ask(batch):
        calls.append(1)
        raise RuntimeError("down")

    failed = evaluation.answered(df.select(F.col("task").alias("prompt")), ask, retries=1).collect()
    assert len(failed) == 6 and all(r.output == "Error: down" for r in failed)
    good = evaluation.answered(df.select(F.col("task").alias("prompt")), lambda b: [x.upper() for x in b])
    assert {r.output for r in good.collect()} == {"LAMP_MOVIE", "LAMP_PRODUCT", "LAMP_TWEET"}
    tasks = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    played = evaluation.rounds(tasks, lambda left, k: left.withColumn("output", F.lit("x" * 900)).withColumn("done", F.col("id") <= k), 2)
    assert sorted((r.id, r.round, r.done) for r in played.collect()) == [(1, 1, True), (2, 2, True), (3, 2, False)] and all(len(r.output) < 800 for r in played.collect())
    log = spark.createDataFrame([("a", i, x) for i, x in enumerate([3.0, 2.0, 4.0, 4.0, 1.0, 2.0, 2.0, 2.0])] + [("b", 0, 1.0)], "run string, step long, loss double")
    assert {r.run: r.stopped for r in evaluation.early_stop(log, "run", "step", "loss", 3).collect()} == {"a": 7, "b": None}
    assert evaluation.adapter_rank(spark.createDataFrame([('{"r": 8}',), ('{"lora_r": 32}',), ("x",)], "config string")).first()[0] == 32 and evaluation.adapter_rank(spark.createDataFrame([], "config string")).first()[0] == 64
    zipped = evaluation.zip_outputs(tasks.withColumnRenamed("id", "sample_idx"), tasks.limit(2).withColumnRenamed("id", "sample_idx"))
    with pytest.raises(Exception, match="differ in number"):
        zipped.collect()


def test_splits_and_samples(spark):
    assert sampling.allocate([5, 3, 2], [100, 100, 100], 10) == [5, 3, 2] and sampling.allocate([5, 3, 2], [1, 100, 100], 10) == [1, 3, 6] and sum(sampling.allocate([1, 1, 1], [9, 9, 9], 10)) == 10 and sampling.allocate([1], [2], 10) == [2]
    df = spark.createDataFrame([(i, f"u{i % 10}") for i in range(60)] + [(99, None)], "sample_idx long, user_id string")
    by_row = policies.earlier_split(df, "lamp_tweet").groupBy("split").count().collect()
    assert {r.split: r["count"] for r in by_row} == {"random_test": 61}
    ratio = policies.earlier_split(df, "ec")
    assert ratio.count() == 61 and ratio.where("split = 'random_test'").select("user_id").distinct().count() == 2 and ratio.where("user_id is null").first().split == "random_train"
    asked = policies.question_split(df, 3, 20)
    assert asked.where("split = 'random_test'").count() == 3 and asked.where("split = 'random_train'").groupBy("user_id").count().where("count > 2").count() == 0
    assert sampling.cluster_counts(100) == list(range(5, 21)) and sampling.cluster_counts(5000)[-1] == 50 and sampling.coarse_cluster_counts(40) == [2, 3, 4, 5, 6, 7, 8]
    with pytest.raises(ValueError, match="strategy"):
        sampling.sampling_weights(df.groupBy("user_id").agg(F.count(F.lit(1)).alias("n")), strategy="odd")


def test_vectors_and_templates(spark):
    df = spark.createDataFrame([([1.0, 0.0], [0.0, 2.0])], "a array<double>, b array<double>")
    got = df.select(vectors.mixed([F.col("a"), F.col("b")], [0.5, 0.25]), vectors.nearest(F.col("a"), [(1, [0.0, 0.0]), (0, [2.0, 0.0])]), vectors.pooled(F.array(F.col("a"), F.col("b")), F.array(F.lit(1), F.lit(1), F.lit(0)))).first()
    assert tuple(got) == ([0.5, 0.5], 0, [0.0, 2.0]) and vectors.end_points(2) == [[1.0, 0.0], [0.0, 1.0]] and all(abs(sum(p) - 1) < 1e-9 for p in vectors.simplex_points(3, 4))
    assert one(spark, lambda c: templates.fill_braces("a {{ x }}{{y}}", {"x": c}), "b") == "a b" and templates.swap_retrieval("{profile_retrieval_k2}", 8) == "{profile_retrieval_k8}"
    assert one(spark, templates.full_stop, " a ") == "a." and one(spark, templates.full_stop, "a!") == "a!" and one(spark, templates.sql_text, "a'b") == "'a''b'" and one(spark, templates.sql_text, None) == "NULL"
    assert one(spark, lambda c: templates.keep_last(c, 1), "abcdefgh") == "efgh" and one(spark, lambda c: templates.keep_ends(c, 1), "abcdefgh") == "abgh" and one(spark, lambda c: templates.cut_tokens(c, 1), "abcdefgh") == "abc..."


def test_bm25_forms_agree(spark):
    corpus = spark.createDataFrame([("u", k, t) for k, t in enumerate(["a b", "a c", "d", "b b e"])], "grp string, pos long, text string")
    queries = spark.createDataFrame([("u", k, t) for k, t in enumerate(["b", "zz", "a d"])], "grp string, qid long, text string")
    held = spark.createDataFrame([("u", ["a b", "a c", "d", "b b e"], ["b", "zz", "a d"]), ("v", [None], ["a"]), ("w", None, ["a"])], "g string, d array<string>, q array<string>")
    assert rows(retrieval.bm25_in_row(held, "g", "d", "q")) == rows(retrieval.bm25_top(corpus, queries))


def test_document_sources(spark, tmp_path):
    (tmp_path / "p.jsonl").write_text('{"index": 1, "A": "a", "B": "b", "C": "c", "D": "d"}\n{"index": 2, "A": "a"}\n')
    assert {r["index"]: r.choices and r.choices["D"] for r in benchmarks.read_problems(spark, str(tmp_path / "p.jsonl")).collect()} == {1: "d", 2: None}
    (tmp_path / "c.jsonl").write_text(json.dumps({"task_id": "x", "prompt": "old"}) + "\n" + json.dumps({"task_id": "x", "prompt": 'def f():\n    """Do it."""\n', "entry_point": "f"}) + "\n")
    got = benchmarks.read_programs(spark, str(tmp_path / "c.jsonl")).first()
    assert got.instruction == "Do it." and got.prefix.startswith("def f()") and got.entry_point == "f"
    for n in ("a_train.jsonl", "b_ood_test.jsonl"):
        (tmp_path / n).write_text("")
    assert benchmarks.find_split_file(spark, str(tmp_path), "ood_test").endswith("b_ood_test.jsonl") and benchmarks.find_split_file(spark, str(tmp_path), "odd").endswith("a_train.jsonl")
    (tmp_path / "g1.json").write_text('{"data": {"u": " a ", "v": "", "w": 3}}')
    (tmp_path / "g2.json").write_text('{"u": "b"}')
    assert rows(benchmarks.read_generated_profiles(spark, str(tmp_path / "g1.json"), str(tmp_path / "g2.json"))) == [("u", "b")]
    benchmarks.write_document(spark, {"é": [1]}, str(tmp_path / "d.json"))
    assert json.loads((tmp_path / "d.json").read_text()) == {"é": [1]} and benchmarks.find_upwards(spark, str(tmp_path / "x" / "y"), "d.json").endswith("d.json") and benchmarks.find_upwards(spark, str(tmp_path), "nope") is None
    assert benchmarks.template_of({"m": "t", "default": "d"}, "RAG_m") == "t" and benchmarks.template_of({"default": "d"}, "x") == "d"
    assert benchmarks.parse_overrides(["--a-b=3", "--c=true"], {"a_b": 1, "c": False, "d": "x"}) == {"a_b": 3, "c": True, "d": "x"}
    for bad in (["--a=1", "--a=2"], ["--z=1"], ["a"]):
        with pytest.raises(ValueError):
            benchmarks.parse_overrides(bad, {"a": 1})
