"""Queries of set assembly; their oracle SQL beside them."""

from __future__ import annotations

from pyspark.sql import functions as F

from rowloom.functions import answers as an
from rowloom.functions import text as tx
from rowloom.operators import assembly
from rowloom.plans.histories import _ITEMS, _render
from rowloom.sources.tables import read_table

BUDGET = 120


def _items(s, d):
    return read_table(s, d, "dataset_item")


def chunks(s, d):
    rows = _items(s, d).select("sample_idx", F.lower(F.trim("user_id")).alias("user_id"))
    got = assembly.user_chunks(rows, "user_id", "sample_idx", 100)
    return got.select("user_id", "chunk", F.md5(F.array_join(F.transform("records", lambda r: r.cast("string")), ",")).alias("digest"), F.size("records").cast("long").alias("n"))


def retrieved(s, d):
    shown = F.transform("history", lambda x: F.when(x.isNotNull(), F.coalesce(tx.render_item(x, F.col("task")), F.lit(""))))
    asked = F.transform("query", lambda q: F.when(q["input"].isNotNull(), assembly.asked_with_answer(q["input"], F.coalesce(q["gold"], q["output"]))))
    rows = read_table(s, d, "raw_user_history").select("record_id", shown.alias("docs"), asked.alias("queries"))
    got = assembly.retrieved_profiles(rows, "record_id", "docs", "queries", (1, 2), BUDGET)
    return got.select("grp", "qid", F.sha2("profile_retrieval_k1", 256).alias("k1"), F.sha2("profile_retrieval_k2", 256).alias("k2"))


def parts(s, d):
    return assembly.validation_parts(_items(s, d).where("split = 'train'").select("sample_idx"), "sample_idx")


def whole(s, d):
    """All splits and the evaluation samples as one set, without left-out tasks."""
    items = _items(s, d).select("sample_idx", F.col("source").alias("task"), "split")
    samples = read_table(s, d, "text_generation_sample").select("sample_id", "task")
    return assembly.wanted_tasks(assembly.concatenated(items, samples)).groupBy("task", "split").agg(F.count(F.lit(1)).alias("n"), F.count("sample_id").alias("n_samples"))


def judged(s, d):
    rows = _items(s, d).select("source", an.judge_score(F.col("output")).alias("score"))
    return rows.groupBy("source").agg(F.count("score").alias("n"), F.round(assembly.pointwise_mean(F.col("score")), 6).alias("mean_score"))


def descriptions(s, d):
    rows = read_table(s, d, "task_config").where("user_prompt_template is not null").select(F.col("source").alias("dataset"), F.concat_ws(" ", "task_name", "user_prompt_template").alias("text"), (F.col("split") != "train").alias("eval"))
    return assembly.description_picks(rows).select("dataset", "kind", "source", F.sha2("text", 256).alias("text_digest"))


def attached(s, d):
    lines = read_table(s, d, "lineitem")
    passed = lines.select("l_orderkey", "l_linenumber", (F.col("l_returnflag") == "R").alias("ok"))
    done = lines.select("l_orderkey", "l_linenumber", F.col("l_linestatus").alias("completion"))
    return assembly.attach_by_place(passed, done, "l_orderkey", "l_linenumber").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.count_if("ok").alias("n_ok"), F.max("completion").alias("last"))


def fields(s, d):
    config = read_table(s, d, "task_config")
    made = assembly.chat_fields(config, {"input": F.col("source"), "profile_text": F.col("split")})
    return made.select("task_name", "system", F.sha2("user", 256).alias("user_digest"), "assistant")


QUERIES = {
    "q_user_chunks": chunks,
    "q_retrieved_profiles": retrieved,
    "q_validation_parts": parts,
    "q_concatenated": whole,
    "q_pointwise_mean": judged,
    "q_description_picks": descriptions,
    "q_attach_completions": attached,
    "q_chat_fields": fields,
    "q_recovered_checkpoint": lambda s, d: assembly.recovered_checkpoint(read_table(s, d, "orders").select(F.col("o_orderkey").alias("step"), F.col("o_totalprice").alias("loss"), (F.col("o_orderstatus") == "F").alias("failed"))),
}

_RANKED = f"""
    {_ITEMS}, docs AS (SELECT record_id AS g, pos, coalesce({_render(800)}, '') AS t, string_split(coalesce({_render(800)}, ''), ' ') AS words FROM items),
    qs AS (SELECT record_id AS g, i - 1 AS qid, concat_ws(' ', query[i].input, coalesce(query[i].gold, query[i].output)) AS t FROM (SELECT *, unnest(range(1, len(query) + 1)) AS i FROM raw_user_history) WHERE query[i].input IS NOT NULL),
    st AS (SELECT g, count(*) AS n, avg(len(words)) AS avgdl FROM docs GROUP BY g),
    tf AS (SELECT g, pos, dl, w, count(*) AS tf FROM (SELECT g, pos, len(words) AS dl, unnest(words) AS w FROM docs) GROUP BY ALL),
    dfr AS (SELECT g, w, ln(n - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM tf JOIN st USING (g) GROUP BY g, w, n),
    idf AS (SELECT g, w, CASE WHEN raw < 0 THEN 0.25 * avg(raw) OVER (PARTITION BY g) ELSE raw END AS idf FROM dfr),
    qt AS (SELECT g, qid, w, count(*) AS qf FROM (SELECT g, qid, unnest(string_split(t, ' ')) AS w FROM qs) GROUP BY ALL),
    hit AS (SELECT g, qid, pos, sum(qf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS s FROM qt JOIN idf USING (g, w) JOIN tf USING (g, w) JOIN st USING (g) GROUP BY ALL),
    every AS (SELECT qs.g, qs.qid, docs.pos, docs.t, coalesce(hit.s, 0) AS s FROM qs JOIN docs USING (g) LEFT JOIN hit ON hit.g = qs.g AND hit.qid = qs.qid AND hit.pos = docs.pos),
    rk AS (SELECT *, row_number() OVER (PARTITION BY g, qid ORDER BY round(s, 9) DESC, pos DESC) AS r FROM every),
    p AS (SELECT g AS grp, qid, string_agg(t, chr(10) || chr(10) ORDER BY r) FILTER (r <= 1) AS a, string_agg(t, chr(10) || chr(10) ORDER BY r) FILTER (r <= 2) AS b FROM rk GROUP BY g, qid)"""
_CUT = f"CASE WHEN floor(length({{0}}) / 4) > {BUDGET} THEN substring({{0}}, 1, {int(BUDGET * 0.9) * 4}) || '...' ELSE {{0}} END"
_FILL = "replace(replace(coalesce({0}, ''), '{{input}}', coalesce(source, '')), '{{profile_text}}', coalesce(split, ''))"

ORACLE = {
    "q_user_chunks": """
        WITH r AS (SELECT lower(trim(user_id)) AS user_id, sample_idx, (row_number() OVER (PARTITION BY lower(trim(user_id)) ORDER BY sample_idx) - 1) // 100 AS chunk FROM dataset_item WHERE user_id IS NOT NULL)
        SELECT user_id, chunk, md5(string_agg(CAST(sample_idx AS VARCHAR), ',' ORDER BY sample_idx)) AS digest, count(*) AS n FROM r GROUP BY ALL""",
    "q_retrieved_profiles": f"WITH {_RANKED} SELECT grp, qid, sha256({_CUT.format('a')}) AS k1, sha256({_CUT.format('b')}) AS k2 FROM p",
    "q_validation_parts": "SELECT sample_idx, CASE WHEN row_number() OVER (ORDER BY sample_idx) <= floor(CAST(count(*) OVER () AS DOUBLE) * 0.9) THEN 'train' ELSE 'validation' END AS part FROM dataset_item WHERE split = 'train'",
    "q_concatenated": """
        WITH u AS (SELECT source AS task, split, NULL AS s FROM dataset_item UNION ALL SELECT task, NULL, sample_id FROM text_generation_sample)
        SELECT task, split, count(*) AS n, count(s) AS n_samples FROM u WHERE task NOT LIKE 'lol\\_%' ESCAPE '\\' GROUP BY ALL""",
    "q_pointwise_mean": """
        WITH r AS (SELECT source, CAST(coalesce(nullif(regexp_extract(output, '(?i)score:\\s*([1-5])', 1), ''), nullif(regexp_extract(output, '(?i)result:\\s*([1-5])', 1), ''), nullif(regexp_extract(output, '(?i)score\\s+([1-5])', 1), ''), nullif(regexp_extract(output, '^\\s*([1-5])\\s*$', 1), ''),
            nullif(regexp_extract_all(regexp_replace(output, '([^0-9])', '\\1\\1', 'g'), '(?:^|[^0-9])([1-5])(?:[^0-9]|$)', 1)[-1], '')) AS INT) AS s FROM dataset_item)
        SELECT source, count(s) AS n, round(coalesce(avg(s), 0), 6) AS mean_score FROM r GROUP BY source""",
    "q_description_picks": """
        WITH r AS (SELECT source AS dataset, concat_ws(' ', task_name, user_prompt_template) AS text, split <> 'train' AS ev FROM task_config WHERE user_prompt_template IS NOT NULL),
        o AS (SELECT dataset, arg_min(text, md5(concat_ws('|', dataset, text, '42'))) AS text FROM r WHERE NOT ev GROUP BY dataset),
        p AS (SELECT a.dataset, b.dataset AS source, b.text, row_number() OVER (PARTITION BY a.dataset ORDER BY md5(concat_ws('|', a.dataset, b.dataset, '42')), b.dataset) AS k FROM o a JOIN o b ON a.dataset <> b.dataset)
        SELECT dataset, 'own' AS kind, dataset AS source, sha256(text) AS text_digest FROM o UNION ALL SELECT dataset, 'eval', dataset, sha256(text) FROM r WHERE ev UNION ALL SELECT dataset, 'other', source, sha256(text) FROM p WHERE k <= 3""",
    "q_attach_completions": "SELECT a.l_orderkey, count(*) AS n, count(*) FILTER (a.l_returnflag = 'R') AS n_ok, max(b.l_linestatus) AS last FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber GROUP BY 1",
    "q_chat_fields": f"SELECT task_name, {_FILL.format('system_message')} AS system, sha256({_FILL.format('user_prompt_template')}) AS user_digest, {_FILL.format('assistant_prefill')} AS assistant FROM task_config",
    "q_recovered_checkpoint": "SELECT o_orderkey AS step, o_totalprice AS loss, o_orderstatus = 'F' AS failed FROM orders WHERE o_orderstatus <> 'F' AND o_totalprice IS NOT NULL ORDER BY o_totalprice, o_orderkey LIMIT 1",
}
