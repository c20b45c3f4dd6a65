"""Queries of column builders, small operators, sources and sinks; their oracle SQL beside them."""

from __future__ import annotations

from pyspark.sql import functions as F

from rowloom.functions import answers as an
from rowloom.functions import checks, names, prompts
from rowloom.functions import text as tx
from rowloom.functions import vectors as v
from rowloom.operators import evaluation, policies, results
from rowloom.session import drop_folder, durable, shared_folder
from rowloom.sources import configs, files
from rowloom.sources.tables import read_table


def _items(s, d):
    return read_table(s, d, "dataset_item")


def answer_rules(s, d):
    o = F.col("output")
    rows = _items(s, d).where("output is not null")
    reply = F.concat(F.lit("Think. Act: bash\nAction: Finish\n```sql\nSELECT 1\n  FROM t\n```\nFinal Answer: "), F.regexp_replace(o, r"\s+", " "), F.lit("\n"))
    return rows.select(
        "sample_idx", an.exact_answer(o, F.concat(F.lower(o), F.lit("."))).alias("exact"), an.loose_answer(F.concat(F.lit("'"), o, F.lit("\" ")), o).alias("loose"), an.similar_score(o).alias("similar"), an.class_label(o).alias("label"),
        results.agent_action(reply).alias("action"), results.sql_statement(reply).alias("statement"), F.md5(results.final_answer(reply)).alias("answer_digest"),
    )


def text_rules(s, d):
    rows = _items(s, d)
    listed = F.array(F.col("profile_text"), F.lit(None).cast("string"), F.col("history_stat"))
    turns = F.array(F.struct(F.lit("user").alias("role"), F.col("input").alias("content")), F.struct(F.lit("assistant").alias("role"), F.col("output").alias("content")))
    marked = F.concat(F.lit("<|im_start|>assistant\n"), F.coalesce("source", F.lit("")), F.lit("<|im_end|>"))
    version = F.concat(F.lit("v"), F.pmod("sample_idx", F.lit(7)).cast("string"))
    return rows.select(
        "sample_idx", F.md5(tx.plain_text("profile_text")).alias("plain"), F.md5(tx.plain_text(listed, True)).alias("joined"), tx.token_estimate("input", 3.7).alias("tokens"), F.md5(F.coalesce(prompts.last_said(turns), F.lit(""))).alias("said"),
        names.version_number(version).alias("version"), prompts.strip_chat_marks(marked).alias("bare"), F.md5(tx.truncate(F.coalesce("input", F.lit("")), 50)).alias("cut"), F.md5(tx.render_turns(turns)).alias("turns"),
    )


def request_ids(s, d):
    q = F.lower(F.trim("question_id"))
    return _items(s, d).where("question_id is not null").select("sample_idx", names.request_user(q).alias("user"), names.request_number(q).alias("number"), policies.swap_sides("question_id").alias("swapped"))


def instructions(s, d):
    rows = read_table(s, d, "text_generation_sample").select("sample_id", F.to_json(F.struct(F.when(F.pmod("sample_id", F.lit(2)) == 0, F.col("prompt")).alias("user_instruction"), F.lit(" ").alias("user_input"), F.col("task").alias("problem"))).alias("sample"))
    return rows.select("sample_id", F.md5(results.instruction()).alias("digest"))


def _kept(s, uri: str, df):
    """The result of reading files that are deleted then."""
    out = durable(df)
    drop_folder(s, uri)
    return out


def json_lines(s, d):
    """Payloads written as lines and read back tolerantly: broken and blank ones are gone."""
    uri = shared_folder(s, "rowloom-lines")
    lines = read_table(s, d, "raw_record").select(F.regexp_replace(F.coalesce("payload", F.lit("")), "[\r\n]", " ").alias("value"))
    lines.write.text(uri)
    return _kept(s, uri, files.read_jsonl(s, uri, "user_id string, profile_text string", strict=False).groupBy("user_id").agg(F.count(F.lit(1)).alias("n")))


def table_round_trip(s, d):
    uri = shared_folder(s, "rowloom-table")
    files.write_table(read_table(s, d, "part").select("p_partkey", "p_brand", "p_size"), uri, by=("p_size",))
    back = files.read_any(s, uri)
    return _kept(s, uri, back.groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"), F.sum("p_partkey").alias("keys"), F.max("p_size").cast("long").alias("largest")))


def report_round_trip(s, d):
    uri = shared_folder(s, "rowloom-report")
    results.write_report(read_table(s, d, "events").groupBy("event_type").agg(F.avg("value").alias("value"), F.count(F.lit(1)).alias("n")), uri)
    return _kept(s, uri, s.read.option("header", True).schema("event_type string, value double, n long").csv(uri))


def sliced(s, d):
    return files.read_sized(s, f"{d}/orders.parquet", "o_orderkey", "[90%:]").select("o_orderkey")


def cached_result(s, d):
    uri = shared_folder(s, "rowloom-cache")
    build = lambda: read_table(s, d, "nation").groupBy("n_regionkey").agg(F.count(F.lit(1)).alias("n"))
    configs.cached(s, uri, ("nation", 1), build)
    return _kept(s, uri, configs.cached(s, uri, ("nation", 1), build))


def scratch(s, d):
    return configs.scratch_query(s, read_table(s, d, "supplier"), "rowloom_scratch", "select s_nationkey, count(*) as n, max(s_name) as last from rowloom_scratch group by s_nationkey")


def profiles(s, d):
    """Profiles in maps of split to user to text, one map per user here, flattened: a user keeps the text of the first split."""
    users = _items(s, d).where("user_id is not null and profile_text is not null and split in ('train', 'random_test')").select(F.lower(F.trim("user_id")).alias("u"), "split", "profile_text", "sample_idx")
    own = lambda x: F.min_by("profile_text", F.when(F.col("split") == x, F.col("sample_idx")))
    one = users.groupBy("u").agg(own("train").alias("train"), own("random_test").alias("random_test"))
    entries = F.filter(F.array(*[F.when(F.col(x).isNotNull(), F.struct(F.lit(x).alias("split"), F.create_map("u", x).alias("users"))) for x in ("train", "random_test")]), lambda e: e.isNotNull())
    return files.flatten_profiles(one.select(F.map_from_entries(entries).alias("profiles"))).select("user_id", "split", F.md5("text").alias("digest"))


def last_profile(s, d):
    rows = _items(s, d).select(F.lower(F.trim("user_id")).alias("user_id"), "profile_text", "ingested_at", "sample_idx").where("user_id is not null")
    return files.last_per_key(rows, "user_id", "profile_text", "ingested_at", "sample_idx").select("user_id", F.md5("profile_text").alias("digest"))


def metric_means(s, d):
    rows = _items(s, d).select(F.explode(F.create_map(F.lit("chars"), F.length("output").cast("double"), F.lit("asked"), F.length("input").cast("double"), F.lit("other"), F.lit(1.0))).alias("metric", "value"))
    return results.mean_metrics(rows, ("chars", "asked")).select("metric", F.round("value", 6).alias("value"), "n_runs")


def matched(s, d):
    o = F.col("output")
    return _items(s, d).where("output is not null").select("sample_idx", evaluation.match_answer(o, F.when(F.pmod("sample_idx", F.lit(3)) == 0, F.trim(o)), F.when(F.pmod("sample_idx", F.lit(3)) == 1, F.lit("[0-9]"))).alias("matched"))


def programs(s, d):
    """Code and formulas of replies made of the answers, by Arrow batches."""
    o = F.regexp_replace(F.coalesce("output", F.lit("")), r"[^A-Za-z0-9 ]", "")
    reply = F.concat(F.lit("Sure:\n```python\nx = '"), F.substring(o, 1, 40), F.lit("'\n```\nand $\\boxed{"), F.length(o).cast("string"), F.lit("}$"))
    rows = _items(s, d).select("sample_idx", reply.alias("reply"))
    return rows.select("sample_idx", checks.clean_programs("reply").alias("code"), checks.boxed_answers("reply").alias("boxed"), prompts.fenced_code(F.col("reply")).alias("fenced"))


QUERIES = {
    "q_answer_rules": answer_rules,
    "q_text_rules": text_rules,
    "q_request_ids": request_ids,
    "q_instructions": instructions,
    "q_json_lines": json_lines,
    "q_table_round_trip": table_round_trip,
    "q_report_round_trip": report_round_trip,
    "q_sliced_read": sliced,
    "q_cached_result": cached_result,
    "q_scratch_query": scratch,
    "q_flatten_profiles": profiles,
    "q_last_profile": last_profile,
    "q_metric_means": metric_means,
    "q_match_answer": matched,
    "q_programs": programs,
    "q_enough_history": lambda s, d: policies.enough_history(read_table(s, d, "raw_user_history"), 3).select("record_id"),
    "q_first_rows": lambda s, d: configs.first_rows(_items(s, d).where("split = 'train'").select("sample_idx"), 500),
    "q_rounds_used": lambda s, d: results.rounds_used(read_table(s, d, "raw_user_history")).select(F.round("rounds", 6).alias("rounds")),
    "q_one_hot": lambda s, d: read_table(s, d, "embeddings").select("vec_id", F.array_join(F.transform(v.one_hot(F.col("label"), 10), lambda x: x.cast("string")), "").alias("hot")),
}

_BL = "' ' || chr(9) || chr(10) || chr(13)"
_STRIP = "regexp_replace(regexp_replace({0}, '^[\\s\\x{{a0}}]+', ''), '[\\s\\x{{a0}}]+$', '')"
_NUM = "'^[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?$'"
_WHOLE = "CASE WHEN regexp_matches({0}, " + _NUM + ") THEN try_cast({0} AS DOUBLE) END"
_O = _STRIP.format("output")
_FIRST = "try_cast(replace(nullif(regexp_extract(output, '([0-9]{1,3}(?:,[0-9]{3})*(?:\\.[0-9]+)?)', 1), ''), ',', '') AS DOUBLE)"
_LABELS = ["label:\\s*(\\S+)", "class:\\s*(\\S+)", "category:\\s*(\\S+)", "answer:\\s*(\\S+)", "prediction:\\s*(\\S+)", "^\\s*(\\S+)"]
_LABEL = f"coalesce(nullif(regexp_extract(lower({_O}), '[\"'']([^\"'']+)[\"'']', 1), ''), " + ", ".join(f"nullif(trim(nullif(regexp_extract(lower({_O}), '{p}', 1), ''), '.,!?()'), '')" for p in _LABELS) + ")"
_SIGNS = "':`''\"(.) '"
_CODE = "regexp_replace(coalesce(output, ''), '[^A-Za-z0-9 ]', '', 'g')"

ORACLE = {
    "q_answer_rules": f"""
        SELECT sample_idx, lower(trim(output, '.')) = lower(trim(lower(output) || '.', '.')) OR coalesce(CAST({_WHOLE.format(_O)} AS VARCHAR) = {_STRIP.format("lower(output) || '.'")}, false) AS exact,
            lower(trim({_STRIP.format("'''' || output || '\" '")}, {_SIGNS})) = lower(trim({_O}, {_SIGNS})) OR false AS loose, coalesce({_WHOLE.format(_O)}, CASE WHEN {_FIRST} BETWEEN 0 AND 5 THEN {_FIRST} END) AS similar, {_LABEL} AS label,
            'finish' AS action, 'SELECT 1 FROM t' AS statement, md5(nullif(trim(regexp_replace(output, '\\s+', ' ', 'g'), ' '), '')) AS answer_digest
        FROM dataset_item WHERE output IS NOT NULL""",
    "q_text_rules": f"""
        SELECT sample_idx, md5(coalesce({_STRIP.format('profile_text')}, '')) AS plain, md5(coalesce({_STRIP.format("concat_ws(' ', profile_text, history_stat)")}, '')) AS joined, CAST(coalesce(floor(length(input) / CAST(3.7 AS DOUBLE)), 0) AS BIGINT) AS tokens, md5(coalesce(input, '')) AS said,
            CAST(sample_idx % 7 AS INT) AS version, coalesce(source, '') AS bare, md5(CASE WHEN length(coalesce(input, '')) > 50 THEN substring(input, 1, 50) || '...' ELSE coalesce(input, '') END) AS cut, md5(concat_ws(chr(10) || chr(10), 'user: ' || input, 'assistant: ' || output)) AS turns
        FROM dataset_item""",
    "q_request_ids": """
        SELECT sample_idx, regexp_replace(lower(trim(question_id)), '_[0-9]+$', '') AS "user", try_cast(nullif(regexp_extract(lower(trim(question_id)), '_([0-9]+)$', 1), '') AS BIGINT) AS number,
            CAST('0x' || substring(md5(concat_ws('|', question_id, '42')), 1, 8) AS BIGINT) % 2 = 1 AS swapped FROM dataset_item WHERE question_id IS NOT NULL""",
    "q_instructions": f"SELECT sample_id, md5(coalesce(CASE WHEN sample_id % 2 = 0 THEN nullif(trim(prompt, ' '), '') END, nullif(trim(task, ' '), ''), '')) AS digest FROM text_generation_sample",
    "q_json_lines": """
        WITH l AS (SELECT regexp_replace(coalesce(payload, ''), '[\r\n]', ' ', 'g') AS p FROM raw_record), o AS (SELECT p FROM l WHERE json_valid(p) AND json_type(p) = 'OBJECT' AND NOT regexp_matches(p, ',\\s*\\}\\s*$'))
        SELECT p ->> '$.user_id' AS user_id, count(*) AS n FROM o GROUP BY 1""",
    "q_table_round_trip": "SELECT p_brand, count(*) AS n, CAST(sum(p_partkey) AS BIGINT) AS keys, CAST(max(p_size) AS BIGINT) AS largest FROM part GROUP BY 1",
    "q_report_round_trip": "SELECT event_type, round(avg(value), 5) AS value, count(*) AS n FROM events GROUP BY 1",
    "q_sliced_read": "SELECT o_orderkey FROM orders QUALIFY row_number() OVER (ORDER BY o_orderkey) > count(*) OVER () * 90 // 100",
    "q_cached_result": "SELECT n_regionkey, count(*) AS n FROM nation GROUP BY 1",
    "q_scratch_query": "SELECT CAST(s_nationkey AS VARCHAR) AS s_nationkey, count(*) AS n, max(s_name) AS last FROM supplier GROUP BY 1",
    "q_flatten_profiles": """
        WITH r AS (SELECT lower(trim(user_id)) AS u, split, arg_min(profile_text, sample_idx) AS t FROM dataset_item WHERE user_id IS NOT NULL AND profile_text IS NOT NULL AND split IN ('train', 'random_test') GROUP BY ALL)
        SELECT u AS user_id, split, md5(trim(t, ' ')) AS digest FROM r WHERE trim(t, ' ') <> '' QUALIFY row_number() OVER (PARTITION BY u ORDER BY split DESC) = 1""",
    "q_last_profile": "SELECT lower(trim(user_id)) AS user_id, md5(arg_max(profile_text, struct_pack(a := ingested_at, b := sample_idx))) AS digest FROM dataset_item WHERE user_id IS NOT NULL AND profile_text IS NOT NULL GROUP BY 1",
    "q_metric_means": "SELECT 'chars' AS metric, round(avg(length(output)), 6) AS value, count(output) AS n_runs FROM dataset_item UNION ALL SELECT 'asked', round(avg(length(input)), 6), count(input) FROM dataset_item",
    "q_match_answer": f"SELECT sample_idx, CASE sample_idx % 3 WHEN 0 THEN true WHEN 1 THEN regexp_matches(output, '[0-9]') END AS matched FROM dataset_item WHERE output IS NOT NULL",
    "q_programs": f"SELECT sample_idx, 'x = ''' || substring({_CODE}, 1, 40) || '''' AS code, CAST(length({_CODE}) AS VARCHAR) AS boxed, 'x = ''' || substring({_CODE}, 1, 40) || '''' || chr(10) AS fenced FROM dataset_item",
    "q_enough_history": "SELECT record_id FROM raw_user_history WHERE len(history) >= 3",
    "q_first_rows": "SELECT sample_idx FROM dataset_item WHERE split = 'train' ORDER BY sample_idx LIMIT 500",
    "q_rounds_used": "SELECT round(avg(len(history)), 6) AS rounds FROM raw_user_history WHERE len(history) > 0",
    "q_one_hot": "SELECT vec_id, array_to_string(list_transform(range(10), lambda i: CASE WHEN i = label THEN '1' ELSE '0' END), '') AS hot FROM embeddings",
}
