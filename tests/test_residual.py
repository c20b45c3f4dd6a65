import json

import pytest
from pyspark.sql import functions as F

from rowloom.functions import checks, names, prompts
from rowloom.operators import policies, results
from rowloom.sources import configs

from .conftest import rows


@pytest.mark.parametrize(
    ("a", "b", "same"),
    [("\\frac12", "0.5", True), ("50\\%", "0.5", True), ("1,234", "1234.0", True), ("x=5", "5", True), ("(1, 2)", "(1,2.0)", True), ("\\sqrt2", "\\sqrt{2}", True), ("3", "4", False), (None, None, False), ("", "0", False), ("\\frac{1}{0}", "1", False)],
)
def test_equal_formulas(a, b, same):
    assert checks.equal_formula(a, b) is same


def test_boxed_code_meteor():
    assert checks.boxed_answer("so \\boxed{\\frac{1}{2}} and") == "\\frac{1}{2}" and checks.boxed_answer("The answer is 42.") == "42" and checks.boxed_answer("none") is None and checks.boxed_answer(None) is None
    assert checks.clean_code("```python\nimport os\ndef f(x):\n\treturn x\nprint(f(1))\n```", "f") == "import os\ndef f(x):\n    return x"
    assert checks.clean_code("def f(:\n") is None and checks.clean_code("x = 1\ny = (") == "x = 1"
    assert checks.meteor("the cat sat", "the cat sat") > 0.95 > checks.meteor("cat the sat", "the cat sat") > 0 and checks.meteor("", "a") == 0 == checks.meteor(None, None)


def test_names_and_prompts(spark):
    df = spark.createDataFrame([("RAG_lamp_movie_random_test", "u_1_10"), ("prism_train", "u")], "n string, c string")
    got = df.select(names.base_name(F.col("n")), names.name_split(F.col("n")), names.task_kind(F.col("n")), names.generated_only(F.col("n")), names.request_user(F.col("c")), names.request_number(F.col("c"))).collect()
    assert [tuple(r) for r in got] == [("lamp_movie", "random_test", "classification", False, "u_1", 10), ("prism", "train", "generation", True, "u", None)]
    with pytest.raises(ValueError, match="k=3"):
        prompts.profile_section("mix", F.lit("a"), F.lit("b"), k=3)
    assert df.select(prompts.fenced_code(F.lit("x ```py\na\n``` y"))).first()[0] == "a\n"
    assert df.select(prompts.strip_chat_marks(F.lit("<|im_start|>assistant\nhi<|im_end|>"))).first()[0] == "hi"


def test_results_files(spark, tmp_path):
    (tmp_path / "r.json").write_text(json.dumps({"t": [{"split": "s", "results": {"acc": 0.5, "f1": 1.0}}, {"results": {"acc": 1.0}}]}))
    read = results.read_results(spark, str(tmp_path / "r.json"))
    assert rows(results.mean_metrics(read, ("acc",))) == [("acc", 0.75, 2)]
    for k, layout in enumerate(([{"user_input": "a"}], {"t": [{"user_input": "a"}]}, {"sampled_res_details": [{"user_input": "a"}]}, {"t": {"sampled_res_details": [{"user_input": "a"}]}})):
        path = tmp_path / f"j{k}.json"
        path.write_text(json.dumps(layout))
        assert [r[0] for r in results.read_judged(spark, str(path)).select(results.instruction()).collect()] == ["a"], layout


def test_agent_replies(spark):
    df = spark.createDataFrame([("Think. Act: bash\nthen Action: Finish", '["1","b"]', '["b",1.0]'), ("none", None, "x")], "r string, a string, b string")
    assert [tuple(r) for r in df.select(results.agent_action(F.col("r")), results.same_rows(F.col("a"), F.col("b"))).collect()] == [("finish", True), (None, False)]


def test_policies_and_configs(spark, tmp_path):
    df = spark.createDataFrame([(f"u{i % 40}", i) for i in range(400)] + [(None, 999)], "user_id string, x int")
    got = policies.user_split(df, "lamp")
    per_user = got.groupBy("user_id").agg(F.collect_set("split").alias("s")).collect()
    assert got.count() == 401 and all(len(r.s) == 1 for r in per_user) and sum(r.s == ["random_test"] for r in per_user) == 8 == sum(r.s == ["ood_test"] for r in per_user)
    weights = spark.createDataFrame([("a", 0.75), ("b", 0.25)], "source string, weight double")
    assert 680 < policies.weighted_draws(weights, 1000).where("source = 'a'").count() < 820
    (tmp_path / "t1").mkdir()
    (tmp_path / "t1" / "metadata.yaml").write_text("response_field: output\nretrieval_k: 4\n")
    assert [(r.task_name, r.response_field, r.retrieval_k, r.split) for r in configs.read_task_configs(spark, str(tmp_path)).collect()] == [("t1", "output", 4, None)]
    calls = []
    build = lambda: calls.append(1) or spark.range(3)
    assert configs.cached(spark, str(tmp_path / "c"), ["a", {"k": 1}], build).count() == configs.cached(spark, str(tmp_path / "c"), ["a", {"k": 1}], build).count() == 3 and len(calls) == 1
    assert rows(configs.scratch_query(spark, spark.range(3), "scratch_t", "select max(id) from scratch_t")) == [("2",)]
