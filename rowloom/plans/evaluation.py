"""Queries that read answers and score predictions and runs, their oracle SQL beside them."""

from __future__ import annotations

from pyspark.sql import functions as F

from rowloom.functions import answers as an
from rowloom.functions import parsing, text
from rowloom.operators import metrics as m
from rowloom.operators import sampling
from rowloom.sources.tables import read_table
from rowloom.streaming import incremental


def _items(s, d):
    return read_table(s, d, "dataset_item")


def answer_extraction(s, d):
    o = F.col("output")
    return _items(s, d).where(o.isNotNull()).select(
        "sample_idx", an.first_number(o).alias("first_number"), an.last_number(o).alias("last_number"), an.numeric_value(o).alias("numeric"), an.choice(o).alias("choice"), an.boolean_word(o).alias("truth"), an.judge_score(o).alias("score"), an.pairwise_winner(o).alias("winner"), an.worked_number(o).alias("worked")
    )


def parse_fields(s, d):
    i = F.col("input")
    split = parsing.split_once(i, F.lit(": "))
    return _items(s, d).select("sample_idx", split["instruction"].alias("instruction"), split["body"].alias("body"), F.array_join(parsing.bracket_list(i), "|").alias("listed"), F.size(parsing.listed_options(i)).cast("long").alias("n_options"))


def rating_metrics(s, d):
    rows = _items(s, d).where("source = 'lamp_product'")
    return m.rating_scores(rows, an.numeric_value(F.col("output")), F.pmod(F.col("sample_idx"), F.lit(5)).cast("double") + 1, "split").select("split", "n_read", *[F.round(c, 6).alias(c) for c in ("mae", "rmse", "stsb")])


def classification_metrics(s, d):
    rows = _items(s, d).where("source in ('lamp_movie', 'lamp_news_cat')")
    first = F.element_at(parsing.bracket_list(F.col("input")), (F.pmod(F.col("sample_idx"), F.lit(3)) + 1).cast("int"))
    return m.classification_scores(rows, F.lower(text.strip("output")), F.lower(first)).select("n", F.round("accuracy", 6).alias("accuracy"), F.round("f1_weighted", 6).alias("f1_weighted"))


def grouping_sets(s, d):
    rows = _items(s, d).select("source", "split", (F.length("output") > 5).alias("ok"))
    return m.grouped_accuracy(rows.withColumn("ok", F.coalesce("ok", F.lit(False))), "ok", "source", "split").select("metric", "n", F.round("acc", 6).alias("acc"))


def pass_at_k(s, d):
    rows = _items(s, d).where("user_id is not null").select(F.lower(F.trim("user_id")).alias("task"), (F.pmod(F.col("sample_idx"), F.lit(7)) == 0).alias("ok"))
    return m.pass_at_k(rows, "task", "ok").select(F.col("k").cast("long").alias("k"), "n_tasks", F.round("pass_at_k", 6).alias("pass_at_k"))


def weighted_loss(s, d):
    rows = read_table(s, d, "lineitem")
    return m.mean_loss(rows, "l_extendedprice", "l_quantity", "l_returnflag").select("l_returnflag", F.round("nll", 4).alias("nll"))


def timing_stats(s, d):
    rows = read_table(s, d, "events")
    return m.spread(rows, "value", "event_type").select("event_type", *[F.round(c, 4).alias(c) for c in ("avg", "max", "min", "median", "std", "total")])


def checksum(s, d):
    rows = read_table(s, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag")
    return m.table_checksum(rows, "l_orderkey")


def judge_wins(s, d):
    """Two judged sides meet by question; the last of a question's repeats counts; sides are swapped by a fixed rule."""
    rows = _items(s, d).where("question_id is not null").select(F.lower(text.strip("question_id")).alias("q"), "split", "sample_idx", F.length("output").alias("len"))
    last = rows.groupBy("q", F.pmod("sample_idx", F.lit(2)).alias("side")).agg(F.max_by("len", "sample_idx").alias("len"))
    a, b = last.where("side = 0").select("q", F.col("len").alias("a")), last.where("side = 1").select("q", F.col("len").alias("b"))
    winner = F.when(F.col("a") > F.col("b"), "a").when(F.col("b") > F.col("a"), "b")
    return m.judge_tally(a.join(b, "q"), winner)


def meteor(s, d):
    rows = read_table(s, d, "text_generation_sample").where("prompt is not null and reference is not null")
    return rows.select("sample_id", F.round(m.word_set_meteor(F.col("reference"), F.col("prompt")), 6).alias("meteor"))


def rouge(s, d, op=m.unigram_rouge):
    rows = op(read_table(s, d, "text_generation_sample"), "sample_id", "reference", "user_profile")
    return rows.select("sample_id", *[F.round(c, 6).alias(c) for c in ("p", "r", "f")])


def outer_merge(s, d):
    """Per user: mean answer length by split side by side (a full outer merge in one pass), and the mean over what is there."""
    rows = _items(s, d).where("user_id is not null").select(F.lower(F.trim("user_id")).alias("user_id"), "split", F.length("output").alias("n"))
    names = ["train", "random_test", "ood_test"]
    wide = rows.groupBy("user_id").agg(*[F.round(F.avg(F.when(F.col("split") == x, F.col("n"))), 6).alias(x) for x in names])
    there = F.filter(F.array(*names), lambda x: x.isNotNull())
    return wide.withColumn("avg_metric", F.round(F.try_divide(F.aggregate(there, F.lit(0.0), lambda a, x: a + x), F.size(there)), 4))


def lookup_coalesce(s, d):
    """Samples without a user get it by their question; of a question's users the last counts."""
    q, u = F.lower(F.trim("question_id")), F.lower(F.trim("user_id"))
    by_question = _items(s, d).where("question_id is not null and user_id is not null").groupBy(q.alias("q")).agg(F.max_by(u, "sample_idx").alias("found"))
    rows = read_table(s, d, "text_generation_sample").select("sample_id", u.alias("u"), q.alias("q"))
    return rows.join(by_question, "q", "left").select("sample_id", F.coalesce(F.nullif("u", F.lit("")), "found").alias("user_id"))


def json_pivot(s, d):
    rows = read_table(s, d, "events").select("event_type", F.get_json_object("props", "$.k").cast("double").alias("k"))
    return rows.groupBy("event_type").agg(F.count("k").alias("n"), F.round(F.avg("k"), 6).alias("mean_k"), F.max("k").alias("max_k"))


def placeholders(s, d):
    rows = _items(s, d)
    return rows.select("sample_idx", text.placeholder(F.col("source"), F.col("profile_text")).alias("placeholder"))


def k_expansion(s, d):
    """One row per record and k, with the profile retrieved for that k; null where the record has none."""
    rows = _items(s, d)
    return rows.select("sample_idx", F.explode(F.array(*[F.lit(k) for k in (1, 2, 4)])).alias("k"), "profile_retrieval_k1", "profile_retrieval_k2", "profile_retrieval_k4").select(
        "sample_idx", F.col("k").cast("long").alias("k"), F.sha2(F.coalesce(F.when(F.col("k") == 1, F.col("profile_retrieval_k1")).when(F.col("k") == 2, F.col("profile_retrieval_k2")).otherwise(F.col("profile_retrieval_k4")), F.lit("")), 256).alias("profile_digest")
    )


def prompt_template(s, d):
    """Prompts of the evaluation records: the task's template with the input filled in, the prefill behind it."""
    config = read_table(s, d, "task_config").where("user_prompt_template is not null").select(F.col("source").alias("src"), F.col("split").alias("spl"), "task_name", "user_prompt_template", F.coalesce("assistant_prefill", F.lit("")).alias("prefill"))
    rows = _items(s, d).where("split <> 'train' and input is not null").select("sample_idx", "source", "split", "input")
    few = config.count() <= 10_000
    joined = rows.join(F.broadcast(config) if few else config, (F.col("source") == F.col("src")) & (F.col("split") == F.col("spl")))
    return joined.select("sample_idx", "task_name", F.sha2(F.concat(F.replace("user_prompt_template", F.lit("{input}"), F.col("input")), "prefill"), 256).alias("prompt_digest"))


def distinct_profiles(s, d):
    """Records by distinct combination of profile and history: the first record and the number of them."""
    mark = F.sha2(F.concat_ws("|", F.coalesce("profile_text", F.lit("")), F.coalesce("profile_all_history", F.lit(""))), 256)
    return _items(s, d).groupBy(mark.alias("combo")).agg(F.min("sample_idx").alias("first_sample"), F.count(F.lit(1)).alias("n"))


def eval_samples(s, d):
    """Evaluation records with the profile shown to the model: the profile text, else the rendered history."""
    return _items(s, d).where("split <> 'train'").select("sample_idx", F.coalesce(F.col("output"), F.lit("None")).alias("reference"), F.sha2(F.coalesce(F.nullif("profile_text", F.lit("")), "profile_all_history", F.lit("")), 256).alias("profile_digest"))


def fewshot(s, d):
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("source").orderBy("sample_idx"))
    return _items(s, d).where("split = 'train'").select("source", "sample_idx", rank.alias("n")).where("n <= 5").select("source", "sample_idx", F.col("n").cast("long").alias("n"))


def windowed(s, d):
    rows = incremental.windowed_counts(read_table(s, d, "events"), window="1 day")
    return rows.groupBy(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type").agg(F.sum("n").alias("n"), F.countDistinct("user_id").alias("n_users"))


QUERIES = {
    "q_answer_extraction": answer_extraction,
    "q_regex_parse_fields": parse_fields,
    "q_rating_metrics": rating_metrics,
    "q_classification_metrics": classification_metrics,
    "q_grouping_sets_accuracy": grouping_sets,
    "q_pass_at_k": pass_at_k,
    "q_weighted_nll": weighted_loss,
    "q_timing_stats": timing_stats,
    "q_table_checksum": checksum,
    "q_pairwise_join_wins": judge_wins,
    "q_simple_meteor": meteor,
    "q_rouge1_overlap": rouge,
    "q_rouge_l": lambda s, d: rouge(s, d, m.longest_rouge),
    "q_outer_merge_metrics": outer_merge,
    "q_lookup_coalesce_join": lookup_coalesce,
    "q_json_extract_pivot": json_pivot,
    "q_placeholder_hash": placeholders,
    "q_k_expansion": k_expansion,
    "q_prompt_template": prompt_template,
    "q_distinct_profile_combos": distinct_profiles,
    "q_eval_samples": eval_samples,
    "q_fewshot_first_n": fewshot,
    "q_windowed_counts": windowed,
    "q_overlap_audit": lambda s, d: sampling.overlap_audit(_items(s, d), "split", F.lower("user_id"), F.col("input"), F.col("output")),
}

_BL = "' ' || chr(9) || chr(10) || chr(13)"
_NUM = "'^[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?$'"
_STRIP = "regexp_replace(regexp_replace({0}, '^[\\s\\x{{a0}}]+', ''), '[\\s\\x{{a0}}]+$', '')"
_LIST = "list_transform(string_split(nullif(regexp_extract(input, '\\[([^\\]]+)\\]', 1), ''), ','), lambda x: trim(x))"

ORACLE = {
    "q_windowed_counts": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, count(DISTINCT user_id) AS n_users FROM events GROUP BY ALL",
    "q_rating_metrics": f"""
        WITH r AS (SELECT split, coalesce(CASE WHEN regexp_matches(trim(output, {_BL}), {_NUM}) THEN try_cast(trim(output, {_BL}) AS DOUBLE) END, try_cast(nullif(regexp_extract(output, '(-?[0-9]+\\.?[0-9]*)', 1), '') AS DOUBLE)) AS p, sample_idx % 5 + 1 AS t FROM dataset_item WHERE source = 'lamp_product')
        SELECT split, count(p) AS n_read, round(coalesce(avg(abs(p - t)), 0), 6) AS mae, round(coalesce(sqrt(avg((p - t) * (p - t))), 0), 6) AS rmse, round(coalesce(1 - avg(abs(p - t)) / 5, 0), 6) AS stsb FROM r GROUP BY split""",
    "q_classification_metrics": f"""
        WITH r AS (SELECT lower({_STRIP.format('output')}) AS p, lower(({_LIST})[sample_idx % 3 + 1]) AS t FROM dataset_item WHERE source IN ('lamp_movie', 'lamp_news_cat')), g AS (SELECT * FROM r WHERE t IS NOT NULL),
        l AS (SELECT t AS label, count(*) AS support, count(*) FILTER (p = t) AS tp FROM g GROUP BY t), pr AS (SELECT p AS label, count(*) AS said FROM g WHERE p IS NOT NULL GROUP BY p)
        SELECT CAST(sum(support) AS BIGINT) AS n, round(sum(tp) / sum(support), 6) AS accuracy, round(sum(support * CAST(2 * tp AS DOUBLE) / (support + coalesce(said, 0))) / sum(support), 6) AS f1_weighted FROM l LEFT JOIN pr USING (label)""",
    "q_grouping_sets_accuracy": """
        WITH r AS (SELECT source, split, coalesce(length(output) > 5, false) AS ok FROM dataset_item)
        SELECT 'acc_total' AS metric, count(*) AS n, round(avg(CAST(ok AS INT)), 6) AS acc FROM r
        UNION ALL SELECT lower(replace('acc_source_' || coalesce(source, 'none'), ' ', '_')), count(*), round(avg(CAST(ok AS INT)), 6) FROM r GROUP BY source
        UNION ALL SELECT lower(replace('acc_split_' || coalesce(split, 'none'), ' ', '_')), count(*), round(avg(CAST(ok AS INT)), 6) FROM r GROUP BY split""",
    "q_pass_at_k": """
        WITH t AS (SELECT lower(trim(user_id)) AS task, count(*) AS n, count(*) FILTER (sample_idx % 7 = 0) AS c FROM dataset_item WHERE user_id IS NOT NULL GROUP BY 1),
        r AS (SELECT k, n, c FROM t, (VALUES (1), (10), (100)) v(k) WHERE n >= k)
        SELECT CAST(k AS BIGINT) AS k, count(*) AS n_tasks, round(avg(CASE WHEN n - c < k THEN 1.0 ELSE 1 - coalesce(list_product(list_transform(range(n - c + 1, n + 1), lambda i: CAST(1 AS DOUBLE) - CAST(k AS DOUBLE) / i)), 1) END), 6) AS pass_at_k FROM r GROUP BY k""",
    "q_weighted_nll": "SELECT l_returnflag, round(sum(l_extendedprice) / sum(l_quantity), 4) AS nll FROM lineitem GROUP BY 1",
    "q_timing_stats": "SELECT event_type, round(avg(value), 4) AS avg, round(max(value), 4) AS max, round(min(value), 4) AS min, round(median(value), 4) AS median, round(stddev_pop(value), 4) AS std, round(sum(value), 4) AS total FROM events GROUP BY 1",
    "q_table_checksum": """
        WITH r AS (SELECT l_orderkey, substring(md5(concat_ws(',', CAST(l_orderkey AS VARCHAR), CAST(l_partkey AS VARCHAR), CAST(l_suppkey AS VARCHAR), CAST(l_linenumber AS VARCHAR), l_returnflag)), 1, 5) AS d FROM lineitem)
        SELECT l_orderkey, md5(string_agg(d, ',' ORDER BY d)) AS checksum FROM r GROUP BY 1""",
    "q_pairwise_join_wins": f"""
        WITH r AS (SELECT lower({_STRIP.format('question_id')}) AS q, sample_idx % 2 AS side, sample_idx, length(output) AS len FROM dataset_item WHERE question_id IS NOT NULL),
        l AS (SELECT q, side, len FROM r QUALIFY row_number() OVER (PARTITION BY q, side ORDER BY sample_idx DESC) = 1),
        a AS (SELECT q, len AS a FROM l WHERE side = 0), b AS (SELECT q, len AS b FROM l WHERE side = 1),
        w AS (SELECT CASE WHEN a > b THEN 'a' WHEN b > a THEN 'b' ELSE 'tie' END AS w FROM a JOIN b USING (q)),
        t AS (SELECT count(*) FILTER (w = 'a') AS wa, count(*) FILTER (w = 'b') AS wb, count(*) AS n FROM w)
        SELECT wa AS wins_a, wb AS wins_b, n - wa - wb AS ties, round(100.0 * wa / greatest(1, n), 4) AS rate_a, round(100.0 * wb / greatest(1, n), 4) AS rate_b, round(100.0 * wa / greatest(1, wa + wb), 4) AS rate_a_decided, round(100.0 * wb / greatest(1, wa + wb), 4) AS rate_b_decided FROM t""",
    "q_simple_meteor": """
        WITH r AS (SELECT sample_id, list_distinct(string_split(lower(reference), ' ')) AS x, list_distinct(string_split(lower(prompt), ' ')) AS y FROM text_generation_sample WHERE prompt IS NOT NULL AND reference IS NOT NULL),
        c AS (SELECT sample_id, CAST(len(list_intersect(x, y)) AS DOUBLE) AS b, len(x) AS lx, len(y) AS ly FROM r)
        SELECT sample_id, round(CASE WHEN b = 0 THEN 0 ELSE 10 * (b / lx) * (b / ly) / (9 * (b / lx) + b / ly) END, 6) AS meteor FROM c""",
    "q_rouge1_overlap": """
        WITH r AS (SELECT sample_id, list_filter(regexp_split_to_array(lower(coalesce(reference, '')), '[^a-z0-9]+'), lambda w: w <> '') AS x, list_filter(regexp_split_to_array(lower(coalesce(user_profile, '')), '[^a-z0-9]+'), lambda w: w <> '') AS y FROM text_generation_sample),
        cx AS (SELECT sample_id, w, count(*) AS n FROM (SELECT sample_id, unnest(x) AS w FROM r) GROUP BY ALL), cy AS (SELECT sample_id, w, count(*) AS m FROM (SELECT sample_id, unnest(y) AS w FROM r) GROUP BY ALL),
        s AS (SELECT sample_id, sum(least(n, m)) AS s FROM cx JOIN cy USING (sample_id, w) GROUP BY 1),
        z AS (SELECT sample_id, CASE WHEN len(x) = 0 THEN 0 ELSE coalesce(s, 0) / CAST(len(x) AS DOUBLE) END AS p, CASE WHEN len(y) = 0 THEN 0 ELSE coalesce(s, 0) / CAST(len(y) AS DOUBLE) END AS r FROM r LEFT JOIN s USING (sample_id))
        SELECT sample_id, round(p, 6) AS p, round(r, 6) AS r, round(CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END, 6) AS f FROM z""",
    "q_outer_merge_metrics": """
        WITH r AS (SELECT lower(trim(user_id)) AS user_id, split, avg(length(output)) AS a FROM dataset_item WHERE user_id IS NOT NULL GROUP BY ALL),
        a AS (SELECT user_id, round(a, 6) AS train FROM r WHERE split = 'train'), b AS (SELECT user_id, round(a, 6) AS random_test FROM r WHERE split = 'random_test'), c AS (SELECT user_id, round(a, 6) AS ood_test FROM r WHERE split = 'ood_test'),
        u AS (SELECT DISTINCT user_id FROM r)
        SELECT user_id, train, random_test, ood_test, round(list_avg(list_filter([train, random_test, ood_test], lambda x: x IS NOT NULL)), 4) AS avg_metric
        FROM u FULL OUTER JOIN a USING (user_id) FULL OUTER JOIN b USING (user_id) FULL OUTER JOIN c USING (user_id)""",
    "q_lookup_coalesce_join": """
        WITH q AS (SELECT lower(trim(question_id)) AS q, arg_max(lower(trim(user_id)), sample_idx) AS found FROM dataset_item WHERE question_id IS NOT NULL AND user_id IS NOT NULL GROUP BY 1)
        SELECT sample_id, coalesce(nullif(lower(trim(user_id)), ''), found) AS user_id FROM text_generation_sample t LEFT JOIN q ON lower(trim(t.question_id)) = q.q""",
    "q_json_extract_pivot": "SELECT event_type, count(props ->> '$.k') AS n, round(avg(CAST(props ->> '$.k' AS DOUBLE)), 6) AS mean_k, max(CAST(props ->> '$.k' AS DOUBLE)) AS max_k FROM events GROUP BY 1",
    "q_placeholder_hash": "SELECT sample_idx, 'random_profile_' || substring(sha256(coalesce(source, '') || ':' || coalesce(profile_text, '')), 1, 16) AS placeholder FROM dataset_item",
    "q_k_expansion": "SELECT sample_idx, CAST(k AS BIGINT) AS k, sha256(coalesce(CASE k WHEN 1 THEN profile_retrieval_k1 WHEN 2 THEN profile_retrieval_k2 ELSE profile_retrieval_k4 END, '')) AS profile_digest FROM dataset_item, (VALUES (1), (2), (4)) v(k)",
    "q_prompt_template": """
        SELECT sample_idx, task_name, sha256(replace(user_prompt_template, '{input}', input) || coalesce(assistant_prefill, '')) AS prompt_digest
        FROM dataset_item i JOIN task_config c ON i.source = c.source AND i.split = c.split WHERE i.split <> 'train' AND input IS NOT NULL AND user_prompt_template IS NOT NULL""",
    "q_distinct_profile_combos": "SELECT sha256(coalesce(profile_text, '') || '|' || coalesce(profile_all_history, '')) AS combo, min(sample_idx) AS first_sample, count(*) AS n FROM dataset_item GROUP BY 1",
    "q_eval_samples": "SELECT sample_idx, coalesce(output, 'None') AS reference, sha256(coalesce(nullif(profile_text, ''), profile_all_history, '')) AS profile_digest FROM dataset_item WHERE split <> 'train'",
    "q_fewshot_first_n": "SELECT source, sample_idx, row_number() OVER (PARTITION BY source ORDER BY sample_idx) AS n FROM dataset_item WHERE split = 'train' QUALIFY n <= 5",
    "q_overlap_audit": """
        WITH r AS (SELECT DISTINCT split, sha256(concat_ws('|', coalesce(substring(lower(user_id), 1, 50), ''), coalesce(substring(input, 1, 50), ''), coalesce(substring(output, 1, 50), ''))) AS h FROM dataset_item)
        SELECT a.split AS split_a, b.split AS split_b, count(*) AS n_shared FROM r a JOIN r b ON a.h = b.h AND a.split < b.split GROUP BY ALL""",
    "q_answer_extraction": f"""
        SELECT sample_idx, try_cast(replace(nullif(regexp_extract(output, '([0-9]{{1,3}}(?:,[0-9]{{3}})*(?:\\.[0-9]+)?)', 1), ''), ',', '') AS DOUBLE) AS first_number,
            try_cast(regexp_replace(regexp_extract_all(output, '([$€£]?[+-]?[0-9]{{1,3}}(?:,[0-9]{{3}})*(?:\\.[0-9]+)?)', 1)[-1], '[$€£,]', '', 'g') AS DOUBLE) AS last_number,
            coalesce(CASE WHEN regexp_matches({_STRIP.format('output')}, {_NUM}) THEN try_cast({_STRIP.format('output')} AS DOUBLE) END, try_cast(nullif(regexp_extract(output, '(-?[0-9]+\\.?[0-9]*)', 1), '') AS DOUBLE)) AS numeric,
            nullif(regexp_extract(lower(trim(output, ' :`''"(.)')), '^([a-z0-9])', 1), '') AS choice,
            CASE WHEN contains(lower(output), '1') THEN true WHEN contains(lower(output), '0') THEN false WHEN contains(lower(output), 'yes') THEN true WHEN contains(lower(output), 'no') THEN false WHEN contains(lower(output), 'true') THEN true WHEN contains(lower(output), 'false') THEN false WHEN contains(lower(output), 'positive') THEN true WHEN contains(lower(output), 'negative') THEN false WHEN contains(lower(output), 'valid') THEN true END AS truth,
            CAST(coalesce(nullif(regexp_extract(output, '(?i)score:\\s*([1-5])', 1), ''), nullif(regexp_extract(output, '(?i)score\\s+([1-5])', 1), ''), nullif(regexp_extract(output, '^\\s*([1-5])\\s*$', 1), ''), nullif(regexp_extract_all(regexp_replace(output, '([^0-9])', '\\1\\1', 'g'), '(?:^|[^0-9])([1-5])(?:[^0-9]|$)', 1)[-1], '')) AS INT) AS score,
            upper(coalesce(nullif(regexp_extract(output, '\\[\\[\\s*([ABCabc])\\s*\\]\\]', 1), ''), nullif(regexp_extract(output, '(?i)\\[RESULT\\]\\s*([ABC])\\b', 1), ''), nullif(regexp_extract(output, '(?i)(?:Result|Winner)\\s*:?\\s*([ABC])\\b', 1), ''), nullif(regexp_extract_all(output, '(?i)(?:^|[^A-Za-z0-9_])([ABC])(?:[^A-Za-z0-9_]|$)', 1)[-1], ''))) AS winner,
            CASE WHEN regexp_matches(w, {_NUM}) THEN try_cast(w AS DOUBLE) END AS worked
        FROM (SELECT *, replace(trim(regexp_extract_all(output, '(-?[$0-9.,]{{2,}}|-?[0-9]+)', 1)[-1], '$.'), ',', '') AS w FROM dataset_item WHERE output IS NOT NULL)""",
}
