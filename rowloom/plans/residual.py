"""Queries on names, prompts, policies, leaderboards and checks, their oracle SQL beside them."""

from __future__ import annotations

from pyspark.sql import functions as F

from rowloom.functions import checks, names, prompts
from rowloom.operators import policies, results, sampling
from rowloom.sources.tables import read_table


def _items(s, d):
    return read_table(s, d, "dataset_item")


def name_parts(s, d):
    n = F.col("task_name")
    return read_table(s, d, "task_config").select("task_name", names.base_name(n).alias("base"), names.name_split(n).alias("split"), names.generated_only(n).alias("generated"), names.task_kind(n).alias("kind"))


def profile_sections(s, d):
    p, h = F.col("profile_text"), F.col("profile_all_history")
    shown = {k: prompts.profile_section(k, p, h, F.col("history_stat")) for k in ("profile", "history", "mix")}
    return _items(s, d).select("sample_idx", *[F.sha2(c, 256).alias(k) for k, c in shown.items()])


def chat_prompts(s, d):
    config = read_table(s, d, "task_config")
    made = prompts.chat_prompt(F.col("system_message"), F.col("user_prompt_template"), F.col("assistant_prefill"))
    return config.select("task_name", F.array_join(F.transform(made, lambda m: m["role"]), ",").alias("roles"), F.size(made).cast("long").alias("n_messages"))


def board(s, d):
    runs = _items(s, d).select("split", F.col("source").alias("task"), F.lit("length").alias("metric"), F.length("output").cast("double").alias("value"))
    return results.leaderboard(runs, "length", "split").select("split", F.round(F.element_at("tasks", F.lit("lamp_tweet")), 6).alias("lamp_tweet"), F.size("tasks").cast("long").alias("n_tasks"), F.round("avg_metric", 6).alias("avg_metric"))


def draws(s, d):
    sizes = _items(s, d).groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    got = policies.weighted_draws(sampling.sampling_weights(sizes), 2000)
    return got.groupBy("source").agg(F.count(F.lit(1)).alias("n_draws"))


def statements(s, d):
    rows = _items(s, d).select(F.element_at(F.array(F.lit("INSERT"), F.lit("UPDATE"), F.lit("SELECT"), F.lit("counting")), (F.pmod("sample_idx", F.lit(4)) + 1).cast("int")).alias("type"), (F.length("output") > 20).alias("correct"))
    return results.statement_accuracy(rows).select("bucket", "n", F.round("acc", 6).alias("acc"))


def files(s, d):
    return results.per_file(read_table(s, d, "raw_record").select(F.col("source_file").alias("file"), (F.length("payload") > 900).alias("passed"))).select(F.coalesce("file", F.lit("all")).alias("file"), "total", F.coalesce("passed", F.lit(0)).alias("passed"), F.round("acc", 6).alias("acc"))


def split_policy(s, d):
    rows = _items(s, d).select("sample_idx", F.lower(F.trim("user_id")).alias("user_id"))
    return policies.user_split(rows, "lamp").select("sample_idx", "split")


def meteors(s, d):
    rows = read_table(s, d, "text_generation_sample").where("prompt is not null and reference is not null")
    return rows.select("sample_id", F.round(checks.meteor_scores("reference", "prompt"), 6).alias("meteor"))


def formulas(s, d):
    rows = _items(s, d).where("source = 'lamp_product'")
    return rows.select("sample_idx", checks.equal_formulas("output", F.element_at(F.array(F.lit("4.0"), F.lit("5"), F.lit("\\frac{6}{2}")), (F.pmod("sample_idx", F.lit(3)) + 1).cast("int"))).alias("equal"))


def masked(s, d):
    rows = read_table(s, d, "embeddings")
    return rows.select("vec_id", F.round(results.masked_loss(F.col("embedding").cast("array<double>"), F.transform("embedding", lambda x: x > 0)), 6).alias("nll"))


QUERIES = {
    "q_task_names": name_parts,
    "q_profile_sections": profile_sections,
    "q_chat_prompts": chat_prompts,
    "q_leaderboard": board,
    "q_weighted_draws": draws,
    "q_statement_accuracy": statements,
    "q_rollup_per_file": files,
    "q_split_policy": split_policy,
    "q_meteor": meteors,
    "q_equal_formulas": formulas,
    "q_masked_loss": masked,
}

_BL = "' ' || chr(9) || chr(10) || chr(13) || chr(12) || chr(11)"
_P, _H, _S = (f"nullif(trim({c}, {_BL}), '')" for c in ("profile_text", "profile_all_history", "history_stat"))
_STAT = f"coalesce(chr(10) || chr(10) || '## User History Statistics:' || chr(10) || {_S}, '')"
_END = "_random_train|_random_test|_ood_train|_ood_test|_train|_test"

ORACLE = {
    "q_task_names": f"""
        SELECT task_name, regexp_replace(regexp_replace(lower(task_name), '^(all_history_|rag_|pag_)+', ''), '({_END})+$', '') AS base,
            nullif(regexp_replace(regexp_extract(lower(task_name), '({_END})$', 1), '^_', ''), '') AS split,
            list_has_any(regexp_split_to_array(lower(task_name), '[/_-]'), ['personalreddit', 'prism', 'aloe', 'ec']) AS generated,
            CASE WHEN contains(task_name, 'product_review') THEN 'generation' WHEN contains(task_name, 'lamp_product') THEN 'rating' WHEN contains(task_name, 'movie') OR contains(task_name, 'news_cat') OR contains(task_name, 'citation') OR contains(task_name, 'opinionqa') THEN 'classification' ELSE 'generation' END AS kind
        FROM task_config""",
    "q_profile_sections": f"""
        SELECT sample_idx, sha256(coalesce({_P}, '') || {_STAT}) AS profile, sha256(coalesce({_H}, '') || {_STAT}) AS history,
            sha256(coalesce(nullif(concat_ws(chr(10) || chr(10), '## User Profile:' || chr(10) || {_P}, '## User History:' || chr(10) || {_H}), ''), '') || {_STAT}) AS mix FROM dataset_item""",
    "q_chat_prompts": f"""
        WITH m AS (SELECT task_name, list_filter([CASE WHEN nullif(trim(system_message, {_BL}), '') IS NOT NULL THEN 'system' END, 'user', CASE WHEN nullif(trim(assistant_prefill, {_BL}), '') IS NOT NULL THEN 'assistant_prefill' END], lambda x: x IS NOT NULL) AS r FROM task_config)
        SELECT task_name, array_to_string(r, ',') AS roles, len(r) AS n_messages FROM m""",
    "q_leaderboard": """
        WITH m AS (SELECT split, source, avg(length(output)) AS v FROM dataset_item GROUP BY ALL)
        SELECT split, round(max(v) FILTER (source = 'lamp_tweet'), 6) AS lamp_tweet, count(*) AS n_tasks, round(avg(v), 6) AS avg_metric FROM m GROUP BY split""",
    "q_statement_accuracy": f"""
        WITH k AS (SELECT unnest({[*results.STATEMENT_KINDS, "overall"]}) AS bucket),
        r AS (SELECT CASE sample_idx % 4 WHEN 0 THEN 'INSERT' WHEN 1 THEN 'UPDATE' WHEN 2 THEN 'SELECT' ELSE 'counting' END AS t, coalesce(length(output) > 20, false) AS ok FROM dataset_item),
        m AS (SELECT t AS bucket, ok FROM r WHERE t <> 'SELECT' UNION ALL SELECT 'SELECT', ok FROM r WHERE t NOT IN ('INSERT', 'UPDATE') UNION ALL SELECT 'overall', ok FROM r)
        SELECT bucket, count(ok) AS n, round(coalesce(avg(CAST(ok AS INT)), 0), 6) AS acc FROM k LEFT JOIN m USING (bucket) GROUP BY bucket""",
    "q_rollup_per_file": "SELECT coalesce(source_file, 'all') AS file, count(*) AS total, CAST(coalesce(sum(CAST(length(payload) > 900 AS INT)), 0) AS BIGINT) AS passed, round(avg(CAST(length(payload) > 900 AS INT)), 6) AS acc FROM raw_record GROUP BY ROLLUP (source_file)",
    "q_split_policy": """
        WITH u AS (SELECT lower(trim(user_id)) AS user_id, count(*) AS n FROM dataset_item WHERE user_id IS NOT NULL GROUP BY 1), k AS (SELECT CASE WHEN count(*) >= 200 THEN 200 ELSE greatest(1, 2 * count(*) // 10) END AS k FROM u),
        r AS (SELECT user_id, n FROM u QUALIFY row_number() OVER (ORDER BY md5(concat_ws('|', user_id, '42')), user_id) <= (SELECT k FROM k)),
        o AS (SELECT user_id FROM u WHERE user_id NOT IN (SELECT user_id FROM r) QUALIFY row_number() OVER (ORDER BY n DESC, user_id) <= (SELECT k FROM k))
        SELECT sample_idx, CASE WHEN lower(trim(user_id)) IN (SELECT user_id FROM r) THEN 'random_test' WHEN lower(trim(user_id)) IN (SELECT user_id FROM o) THEN 'ood_test' ELSE 'train' END AS split FROM dataset_item""",
    "q_weighted_draws": """
        WITH s AS (SELECT source, sqrt(count(*)) AS w FROM dataset_item GROUP BY 1), f AS (SELECT source, greatest(w, 0.1 * max(w) OVER ()) AS w FROM s), p AS (SELECT source, w / sum(w) OVER () AS w FROM f),
        r AS (SELECT source, coalesce(sum(w) OVER (ORDER BY source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lo, sum(w) OVER (ORDER BY source) AS hi FROM p),
        d AS (SELECT CAST('0x' || substring(md5(concat_ws('|', CAST(i AS VARCHAR), '42')), 1, 12) AS BIGINT) / 281474976710656.0 AS x FROM range(2000) t(i))
        SELECT source, count(*) AS n_draws FROM d JOIN r ON x >= lo AND x < hi GROUP BY 1""",
    "q_masked_loss": "SELECT vec_id, round(-coalesce(list_sum(list_filter(list_transform(embedding, lambda x: CAST(x AS DOUBLE)), lambda x: x > 0)), 0), 6) AS nll FROM embeddings",
}
