"""Queries of the metric registry, evaluations, run logs, splits and mixtures; their oracle SQL beside them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowloom.functions import matching, parsing, templates
from rowloom.functions import vectors as v
from rowloom.operators import evaluation as ev
from rowloom.operators import metrics as m
from rowloom.operators import policies, sampling
from rowloom.sources.tables import read_table


def _items(s, d):
    return read_table(s, d, "dataset_item")


def _pairs(s, d):
    """Answers with a target: the first listed option of their input, else a rating by a fixed rule."""
    target = F.coalesce(F.get(parsing.bracket_list(F.col("input")), 0), (F.pmod("sample_idx", F.lit(5)) + 1).cast("string"))
    return _items(s, d).where("output is not null").select("sample_idx", "source", F.col("output").alias("g"), target.alias("t"))


def native_metrics(s, d):
    rows = _pairs(s, d)
    means = rows.agg(*[F.round(F.avg(matching.score(n, F.col("g"), F.col("t"))), 6).alias(n) for n in matching.NATIVE_METRICS])
    return means.unpivot([], list(matching.NATIVE_METRICS), "metric", "value")


def python_metrics(s, d):
    """The metrics that need ROUGE-L or METEOR, and a printed span as the target of `drop`."""
    span = F.concat(F.lit("{'spans': array(['"), F.col("t"), F.lit("'], dtype=object)}"))
    label = lambda c: F.to_json(F.struct(F.substring(c, 1, 1).alias("label"), c.alias("explanation")))
    rows = _pairs(s, d)
    scores = {
        "rouge": matching.score("rouge", F.col("g"), F.col("t")), "meteor": matching.score("meteor", F.col("g"), F.col("t")), "dbpedia": matching.score("dbpedia", F.col("g"), F.col("t")),
        "drop": matching.score("drop", F.col("g"), span), "label_and_explanation": matching.score("label_and_explanation", label(F.col("g")), label(F.col("t"))),
    }
    return rows.select("sample_idx", *[F.round(c, 6).alias(n) for n, c in scores.items()])


def dispatch(s, d):
    rows = _pairs(s, d).select(F.col("source").alias("task"), F.col("g").alias("predicted"), F.col("t").alias("target"))
    return ev.task_metrics(rows).withColumn("value", F.round("value", 6))


def kinds(s, d):
    config = read_table(s, d, "task_config")
    return config.select("task_name", ev.evaluation_kind(F.col("task_name"), F.col("user_prompt_template")).alias("kind"))


def samples(s, d):
    made = ev.build_samples(_items(s, d).where("split <> 'train'"), read_table(s, d, "task_config"), "Answer in one word.")
    return made.select("sample_idx", "task_name", "kind", F.sha2("prompt", 256).alias("prompt_digest"), F.sha2("reference", 256).alias("reference_digest"), F.sha2("user_profile", 256).alias("profile_digest"), "question_id")


def registry_run(s, d):
    """Evaluation by a metric of the registry, the model being a rule: the answer is the reference of every other sample."""
    rows = ev.build_samples(_items(s, d).where("split <> 'train'"), read_table(s, d, "task_config"))
    answer = lambda df: df.withColumn("output", F.when(F.pmod("sample_idx", F.lit(2)) == 0, F.col("reference")).otherwise(F.lit("none")))
    return ev.scored_by("accuracy")(rows, answer).withColumn("value", F.round("value", 6))


def problems(s, d):
    kind = F.get(F.array(F.lit("Multiple-choice"), F.lit("Assertion"), F.lit("Fill-in-the-blank"), F.lit("Open-ended")), F.pmod("sample_idx", F.lit(4)).cast("int"))
    answer = F.when(kind == "Assertion", F.lit("True")).otherwise(F.lit("A"))
    rows = _items(s, d).select("sample_idx", kind.alias("format"), F.col("input").alias("reply"), answer.alias("answer"))
    return ev.scored_problems(rows).select("sample_idx", "format", "is_correct")


def gated(s, d):
    """Mean reward, and accuracy that only counts where the language is likely enough, by kind of event."""
    rows = read_table(s, d, "events").select("event_type", F.col("value").alias("reward"), (F.col("value") > 20).alias("ok"), (F.get_json_object("props", "$.k").cast("double") / 100).alias("p"))
    return rows.groupBy("event_type").agg(F.round(F.avg("reward"), 6).alias("mean_reward"), F.round(m.accuracy(F.coalesce(F.col("ok") & (F.col("p") > 0.5), F.lit(False))), 6).alias("gated"), F.round(F.sum("reward"), 4).alias("seconds"))


def batched(s, d):
    rows = ev.batches(_items(s, d).select("sample_idx", "source"), "source", "sample_idx", 100)
    return rows.groupBy("source", "batch").agg(F.count(F.lit(1)).alias("n"), F.min("sample_idx").alias("first"))


def stops(s, d):
    return ev.early_stop(read_table(s, d, "events"), "event_type", "event_id", "value", 40, 0.5)


def baselines(s, d):
    runs = _items(s, d).groupBy("source", "split").agg(F.round(F.avg(F.length("output")), 6).alias("value")).withColumn("model", F.lit("own"))
    base = _items(s, d).groupBy("source").agg(F.round(F.avg(F.length("input")), 6).alias("value")).withColumn("model", F.lit("base"))
    return ev.with_baselines(runs, base, None)


def zipped(s, d):
    rows = read_table(s, d, "text_generation_sample")
    outputs = rows.select("sample_id", F.concat("reference", F.lit("!")).alias("output"))
    return ev.zip_outputs(rows.select("sample_id", "task"), outputs, "sample_id").select("sample_id", "task", F.length("output").cast("long").alias("n"))


def profile_match(s, d):
    known = _items(s, d).where("profile_text is not null").groupBy("profile_text").agg(F.min("sample_idx").alias("first"))
    return ev.by_text(read_table(s, d, "text_generation_sample").select("sample_id", "user_profile"), known, "user_profile", "profile_text").select("sample_id", "first")


def user_vectors(s, d):
    users = read_table(s, d, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    return users.join(read_table(s, d, "embeddings"), F.col("user_id") == F.col("vec_id")).select("user_id", "n", F.round(v.norm(F.col("embedding")), 5).alias("norm"))


def strategies(s, d):
    sizes = _items(s, d).groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    parts = [sampling.sampling_weights(sizes, "n", k).select("source", F.lit(k).alias("strategy"), F.round("weight", 9).alias("weight")) for k in ("uniform", "size", "sqrt_size", "inv_size")]
    return reduce(DataFrame.unionByName, parts)


def stratified_rows(s, d):
    """A matched sample of the out-of-distribution rows: output lengths distributed as in training."""
    rows = _items(s, d).where("output is not null").select("sample_idx", "split", F.length("output").alias("n"))
    got = sampling.matched_sample(rows.where("split = 'train'"), rows.where("split <> 'train'"), 120, "n", "sample_idx")
    return got.groupBy(F.col("bucket").cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n_rows"))


def earlier(s, d, dataset):
    rows = _items(s, d).select("sample_idx", F.lower(F.trim("user_id")).alias("user_id"))
    return policies.earlier_split(rows, dataset).select("sample_idx", "split")


def chosen_embedding(s, d):
    return _items(s, d).select("sample_idx", policies.embedding_of(F.col("sample_idx"), 7).cast("long").alias("k"))


def rendered(s, d):
    config = read_table(s, d, "task_config").where("user_prompt_template is not null")
    swapped = templates.swap_retrieval(F.concat("user_prompt_template", F.lit(" {profile_retrieval_k2}")), 8)
    made = templates.fill_braces("Task {{ name }}: {{ask}}{{ nothing }}", {"name": F.col("task_name"), "ask": templates.full_stop(F.coalesce("system_message", F.lit("")))})
    return config.select("task_name", F.sha2(swapped, 256).alias("swapped"), made.alias("made"))


def truncated(s, d):
    rows = _items(s, d).where("input is not null")
    cut, last, ends = templates.cut_tokens(F.col("input"), 30), templates.keep_last(F.col("input"), 30), templates.keep_ends(F.col("input"), 30)
    return rows.select("sample_idx", F.sha2(cut, 256).alias("first"), F.sha2(last, 256).alias("last"), F.sha2(ends, 256).alias("ends"), F.length(templates.sql_text(F.col("output"))).cast("long").alias("quoted"))


def user_totals(s, d):
    """Users per split; those without one count as one unknown user."""
    return _items(s, d).groupBy("split").agg(F.countDistinct(F.coalesce(F.lower(F.trim("user_id")), F.lit("unknown"))).alias("n_users"))


def mixed(s, d):
    """A third of each of the first three vectors of every group of ids."""
    rows = read_table(s, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    parts = [rows.where(f"vec_id % 3 = {k}").select(F.floor(F.col("vec_id") / 3).alias("g"), F.col("e").alias(f"e{k}")) for k in range(3)]
    joined = parts[0].join(parts[1], "g").join(parts[2], "g")
    mix = v.mixed([F.col("e0"), F.col("e1"), F.col("e2")], [0.5, 0.25, 0.25])
    return joined.select("g", F.round(F.get(mix, 0), 6).alias("m0"), F.round(v.norm(mix), 5).alias("norm"))


QUERIES = {
    "q_native_metrics": native_metrics,
    "q_python_metrics": python_metrics,
    "q_task_dispatch": dispatch,
    "q_evaluation_kind": kinds,
    "q_build_samples": samples,
    "q_registry_run": registry_run,
    "q_scored_problems": problems,
    "q_gated_accuracy": gated,
    "q_batches": batched,
    "q_early_stop": stops,
    "q_best_checkpoints": lambda s, d: ev.best_checkpoints(read_table(s, d, "orders"), 5, "o_totalprice", "o_orderkey").select("o_orderkey", "o_totalprice"),
    "q_with_baselines": baselines,
    "q_zip_outputs": zipped,
    "q_profile_match": profile_match,
    "q_user_vectors": user_vectors,
    "q_weight_strategies": strategies,
    "q_matched_sample": stratified_rows,
    "q_split_by_row": lambda s, d: earlier(s, d, "lamp_tweet"),
    "q_split_by_ratio": lambda s, d: earlier(s, d, "ec"),
    "q_split_by_question": lambda s, d: earlier(s, d, "opinionqa"),
    "q_chosen_embedding": chosen_embedding,
    "q_templates": rendered,
    "q_truncation": truncated,
    "q_user_totals": user_totals,
    "q_mixed_vectors": mixed,
}

_BL = "' ' || chr(9) || chr(10) || chr(13)"
_STRIP = "regexp_replace(regexp_replace({0}, '^[\\s\\x{{a0}}]+', ''), '[\\s\\x{{a0}}]+$', '')"
_NUM = "'^[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?$'"
_LIST = "list_transform(string_split(nullif(regexp_extract(input, '\\[([^\\]]+)\\]', 1), ''), ','), lambda x: trim(x))"
_PAIRS = f"pairs AS (SELECT sample_idx, source, output AS g, coalesce(({_LIST})[1], CAST(sample_idx % 5 + 1 AS VARCHAR)) AS t FROM dataset_item WHERE output IS NOT NULL)"


def _whole(c: str) -> str:
    return f"CASE WHEN regexp_matches({_STRIP.format(c)}, {_NUM}) THEN try_cast({_STRIP.format(c)} AS DOUBLE) END"


def _value(c: str) -> str:
    return f"coalesce({_whole(c)}, try_cast(nullif(regexp_extract({c}, '(-?[0-9]+\\.?[0-9]*)', 1), '') AS DOUBLE))"


def _similar(c: str) -> str:
    first = f"try_cast(replace(nullif(regexp_extract({c}, '([0-9]{{1,3}}(?:,[0-9]{{3}})*(?:\\.[0-9]+)?)', 1), ''), ',', '') AS DOUBLE)"
    return f"coalesce({_whole(c)}, CASE WHEN {first} BETWEEN 0 AND 5 THEN {first} END)"


def _worked(c: str) -> str:
    last = f"replace(trim(regexp_extract_all({c}, '(-?[$0-9.,]{{2,}}|-?[0-9]+)', 1)[-1], '$.'), ',', '')"
    return f"CASE WHEN regexp_matches({last}, {_NUM}) THEN try_cast({last} AS DOUBLE) END"


def _bool(c: str) -> str:
    words = matching.SHORT_BOOLEANS
    return "CASE " + " ".join(f"WHEN contains(lower({c}), '{w}') THEN {str(b).lower()}" for w, b in words) + " END"


def _label(c: str) -> str:
    t = f"lower({_STRIP.format(c)})"
    others = [r"label:\s*(\S+)", r"class:\s*(\S+)", r"category:\s*(\S+)", r"answer:\s*(\S+)", r"prediction:\s*(\S+)", r"^\s*(\S+)"]
    return f"coalesce(nullif(regexp_extract({t}, '[\"'']([^\"'']+)[\"'']', 1), ''), " + ", ".join(f"nullif(trim(nullif(regexp_extract({t}, '{p}', 1), ''), '.,!?()'), '')" for p in others) + ")"


_EXACT = f"(coalesce(lower(trim(g, '.')) = lower(trim(t, '.')), false) OR coalesce(CAST({_whole('g')} AS VARCHAR) = {_STRIP.format('t')}, false))"
_SHARED = lambda ds: "(" + _EXACT + "".join(f" OR (contains(g, '{x}') AND contains(t, '{x}'))" for x in ds) + ")"
_GAP = f"coalesce(abs({_value('g')} - {_value('t')}), 0)"
_STSB = f"coalesce(1 - abs({_similar('g')} - {_similar('t')}) / 5, 0)"
_METRIC_SQL = {
    "accuracy": f"CAST({_EXACT} AS INT)", "mae": _GAP, "rmse": _GAP, "stsb": _STSB, "amazon_review_mpe": _STSB,
    "f1": f"CAST(coalesce(lower({_STRIP.format('g')}) = lower({_STRIP.format('t')}), false) OR coalesce({_label('g')} = {_label('t')}, false) AS INT)",
    "binary_accuracy_flex": f"CAST(coalesce({_bool('g')} = {_bool('t')}, false) AS INT)", "gsm8k_regex": f"CAST(coalesce({_worked('g')} = {_worked('t')}, false) AS INT)",
    "mrpc_accuracy": f"CAST({_SHARED('12')} AS INT)", "mnli_accuracy": f"CAST({_SHARED('012')} AS INT)", "hellaswag_accuracy": f"CAST({_SHARED('0123')} AS INT)",
    "customer_support_accuracy": f"CAST({_EXACT} OR contains(lower(g), lower(t)) AS INT)",
}
_KIND = "CASE WHEN contains(source, 'product_review') THEN 'generation' WHEN contains(source, 'lamp_product') THEN 'rating' WHEN contains(source, 'movie') OR contains(source, 'news_cat') OR contains(source, 'citation') OR contains(source, 'opinionqa') THEN 'classification' ELSE 'generation' END"
_EVAL = (
    "CASE WHEN user_prompt_template IS NULL THEN 'conversation' WHEN list_has_any(regexp_split_to_array(lower(task_name), '[/_-]'), ['personalreddit', 'ec']) THEN 'generation' WHEN contains(lower(task_name), 'opinionqa') THEN 'classification' "
    + " ".join(f"WHEN {' OR '.join(f'contains(lower(task_name), {chr(39)}{n}{chr(39)})' for n in names)} THEN '{k}'" for k, names in ev.KINDS) + " ELSE 'qa' END"
)
_U = "lower(trim(user_id))"
_HASHED = "md5(concat_ws('|', CAST({0} AS VARCHAR), '42'))"
_SAMPLES = f"""smp AS (SELECT i.sample_idx, c.task_name, {_EVAL} AS kind, replace(coalesce(user_prompt_template, '{{input}}'), '{{input}}', coalesce(input, '')) AS prompt, coalesce(output, 'None') AS reference,
    coalesce(nullif(profile_text, ''), profile_all_history, '') AS profile, question_id FROM dataset_item i JOIN task_config c ON i.source = c.source AND i.split = c.split WHERE i.split <> 'train')"""

ORACLE = {
    "q_native_metrics": f"WITH {_PAIRS}, a AS (SELECT {', '.join(f'round(avg({c}), 6) AS {n}' for n, c in _METRIC_SQL.items())} FROM pairs) SELECT metric, value FROM (UNPIVOT a ON {', '.join(_METRIC_SQL)} INTO NAME metric VALUE value)",
    "q_task_dispatch": f"""
        WITH {_PAIRS}, r AS (SELECT source AS task, {_KIND} AS kind, g AS p, t FROM pairs WHERE t <> ''),
        l AS (SELECT task, lower({_STRIP.format('p')}) AS p, lower({_STRIP.format('t')}) AS t FROM r WHERE kind = 'classification'),
        s AS (SELECT task, t AS label, count(*) AS support, count(*) FILTER (p = t) AS tp FROM l GROUP BY ALL), w AS (SELECT task, p AS label, count(*) AS said FROM l GROUP BY ALL),
        c AS (SELECT task, sum(tp) / sum(support) AS acc, sum(support * CAST(2 * tp AS DOUBLE) / (support + coalesce(said, 0))) / sum(support) AS f1 FROM s LEFT JOIN w USING (task, label) GROUP BY task),
        n AS (SELECT task, coalesce(avg(x), 0) AS mae, coalesce(sqrt(avg(x * x)), 0) AS rmse FROM (SELECT task, abs({_value('p')} - {_value('t')}) AS x FROM r WHERE kind = 'rating') GROUP BY task),
        ws AS (SELECT task, list_distinct(string_split(lower(p), ' ')) AS x, list_distinct(string_split(lower(t), ' ')) AS y, {_EXACT.replace('(g', '(p').replace("lower(trim(g", "lower(trim(p").replace('(g,', '(p,')} AS e FROM r WHERE kind = 'generation'),
        g AS (SELECT task, avg(CASE WHEN len(list_intersect(x, y)) = 0 THEN 0 ELSE 10 * (len(list_intersect(x, y)) / CAST(len(x) AS DOUBLE)) * (len(list_intersect(x, y)) / CAST(len(y) AS DOUBLE)) / (9 * (len(list_intersect(x, y)) / CAST(len(x) AS DOUBLE)) + len(list_intersect(x, y)) / CAST(len(y) AS DOUBLE)) END) AS meteor, avg(CAST(e AS INT)) AS acc FROM ws GROUP BY task)
        SELECT task, 'classification' AS kind, 'accuracy' AS metric, round(acc, 6) AS value FROM c UNION ALL SELECT task, 'classification', 'f1_weighted', round(f1, 6) FROM c UNION ALL SELECT task, 'rating', 'mae', round(mae, 6) FROM n
        UNION ALL SELECT task, 'rating', 'rmse', round(rmse, 6) FROM n UNION ALL SELECT task, 'generation', 'meteor', round(meteor, 6) FROM g UNION ALL SELECT task, 'generation', 'accuracy', round(acc, 6) FROM g""",
    "q_evaluation_kind": f"SELECT task_name, {_EVAL} AS kind FROM task_config",
    "q_build_samples": f"WITH {_SAMPLES} SELECT sample_idx, task_name, kind, sha256('Answer in one word.' || chr(10) || chr(10) || prompt) AS prompt_digest, sha256(reference) AS reference_digest, sha256(profile) AS profile_digest, question_id FROM smp",
    "q_registry_run": f"""
        WITH {_SAMPLES}, pairs AS (SELECT task_name, CASE WHEN sample_idx % 2 = 0 THEN reference ELSE 'none' END AS g, reference AS t FROM smp)
        SELECT task_name, count(*) AS n, round(avg(CAST({_EXACT} AS INT)), 6) AS value FROM pairs GROUP BY 1""",
    # letters beyond ASCII are word characters here, which the SQL engine's word boundary does not know
    "q_scored_problems": """
        WITH r AS (SELECT sample_idx, (['Multiple-choice', 'Assertion', 'Fill-in-the-blank', 'Open-ended'])[sample_idx % 4 + 1] AS format, regexp_replace(coalesce(input, ''), '[À-ɏ\\x{370}-\\x{1fff}\\x{3040}-\\x{d7ff}]', 'x', 'g') AS reply FROM dataset_item)
        SELECT sample_idx, format, CASE WHEN format = 'Assertion' THEN coalesce(nullif(regexp_extract(lower(reply), '\\b(true|false)\\b', 1), '') = 'true', false) ELSE coalesce(lower(nullif(regexp_extract(reply, '(?i)\\b([ABCD])\\b', 1), '')) = 'a', false) END AS is_correct
        FROM r WHERE format IN ('Multiple-choice', 'Assertion')""",
    "q_gated_accuracy": "SELECT event_type, round(avg(value), 6) AS mean_reward, round(avg(CAST(coalesce(value > 20 AND CAST(props ->> '$.k' AS DOUBLE) / 100 > 0.5, false) AS INT)), 6) AS gated, round(sum(value), 4) AS seconds FROM events GROUP BY 1",
    "q_batches": "WITH r AS (SELECT source, sample_idx, (row_number() OVER (PARTITION BY source ORDER BY sample_idx) - 1) // 100 AS batch FROM dataset_item) SELECT source, batch, count(*) AS n, min(sample_idx) AS first FROM r GROUP BY ALL",
    "q_early_stop": """
        WITH b AS (SELECT event_type, event_id, value, min(value) OVER (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM events),
        n AS (SELECT *, coalesce(value < best, true) AS fresh FROM b), g AS (SELECT *, sum(CAST(fresh AS INT)) OVER (PARTITION BY event_type ORDER BY event_id) AS spell FROM n),
        c AS (SELECT *, sum(CAST(NOT fresh AND value > best + 0.5 AS INT)) OVER (PARTITION BY event_type, spell ORDER BY event_id) AS k FROM g)
        SELECT event_type, min(CASE WHEN k >= 40 THEN event_id END) AS stopped FROM c GROUP BY 1""",
    "q_best_checkpoints": "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice IS NOT NULL ORDER BY o_totalprice, o_orderkey LIMIT 5",
    "q_with_baselines": "SELECT source, split, round(avg(length(output)), 6) AS value, 'own' AS model FROM dataset_item GROUP BY ALL UNION ALL SELECT source, NULL, round(avg(length(input)), 6), 'base' FROM dataset_item GROUP BY ALL",
    "q_zip_outputs": "SELECT sample_id, task, length(reference) + 1 AS n FROM text_generation_sample",
    "q_profile_match": """
        WITH k AS (SELECT profile_text AS p, min(sample_idx) AS first FROM dataset_item WHERE profile_text IS NOT NULL GROUP BY 1)
        SELECT sample_id, first FROM text_generation_sample t LEFT JOIN k ON coalesce(t.user_profile, '') = k.p""",
    "q_user_vectors": """
        WITH u AS (SELECT user_id, count(*) AS n FROM events GROUP BY 1)
        SELECT user_id, n, round(sqrt(list_sum(list_transform(embedding, lambda y: CAST(y AS DOUBLE) * y))), 5) AS norm FROM u JOIN embeddings ON user_id = vec_id""",
    "q_weight_strategies": """
        WITH s AS (SELECT source, CAST(count(*) AS DOUBLE) AS n FROM dataset_item GROUP BY 1),
        r AS (SELECT source, 'uniform' AS strategy, CAST(1.0 AS DOUBLE) AS w FROM s UNION ALL SELECT source, 'size', n FROM s UNION ALL SELECT source, 'sqrt_size', sqrt(n) FROM s UNION ALL SELECT source, 'inv_size', max(n) OVER () / n FROM s),
        f AS (SELECT source, strategy, greatest(w, 0.1 * max(w) OVER (PARTITION BY strategy)) AS w FROM r) SELECT source, strategy, round(w / sum(w) OVER (PARTITION BY strategy), 9) AS weight FROM f""",
    "q_split_by_row": f"WITH r AS (SELECT sample_idx, row_number() OVER (ORDER BY {_HASHED.format('sample_idx')}, sample_idx) AS k FROM dataset_item) SELECT sample_idx, CASE WHEN k <= 250 THEN 'random_test' ELSE 'random_train' END AS split FROM r",
    "q_split_by_ratio": f"""
        WITH u AS (SELECT DISTINCT {_U} AS u FROM dataset_item WHERE user_id IS NOT NULL), h AS (SELECT u FROM u QUALIFY row_number() OVER (ORDER BY {_HASHED.format('u')}, u) <= greatest(1, (SELECT count(*) // 5 FROM u)))
        SELECT sample_idx, CASE WHEN {_U} IN (SELECT u FROM h) THEN 'random_test' ELSE 'random_train' END AS split FROM dataset_item""",
    "q_split_by_question": f"""
        WITH i AS (SELECT sample_idx, {_U} AS u FROM dataset_item WHERE user_id IS NOT NULL), u AS (SELECT DISTINCT u FROM i), h AS (SELECT u FROM u QUALIFY row_number() OVER (ORDER BY {_HASHED.format('u')}, u) <= 250),
        r AS (SELECT sample_idx, u, u IN (SELECT u FROM h) AS held, row_number() OVER (PARTITION BY u ORDER BY {_HASHED.format('sample_idx')}, sample_idx) AS k FROM i)
        SELECT sample_idx, CASE WHEN held THEN 'random_test' ELSE 'random_train' END AS split FROM r WHERE k <= CASE WHEN held THEN 1 ELSE (SELECT greatest(1, 10000 // count(*)) FROM u) END""",
    "q_chosen_embedding": "SELECT sample_idx, sample_idx % 7 AS k FROM dataset_item",
    "q_templates": f"""
        SELECT task_name, sha256(regexp_replace(user_prompt_template || ' {{profile_retrieval_k2}}', 'profile_retrieval_k[0-9]+', 'profile_retrieval_k8', 'g')) AS swapped,
            'Task ' || task_name || ': ' || CASE WHEN trim(coalesce(system_message, '')) = '' THEN coalesce(system_message, '') WHEN regexp_matches(trim(system_message), '[.!?]$') THEN trim(system_message) ELSE trim(system_message) || '.' END AS made
        FROM task_config WHERE user_prompt_template IS NOT NULL""",
    "q_truncation": """
        SELECT sample_idx, sha256(CASE WHEN floor(length(input) / 3.7) > 30 THEN substring(input, 1, 111) || '...' ELSE input END) AS first, sha256(right(input, 120)) AS last,
            sha256(CASE WHEN length(input) > 120 THEN left(input, 60) || right(input, 60) ELSE input END) AS ends, coalesce(length(replace(output, '''', '''''')) + 2, 4) AS quoted FROM dataset_item WHERE input IS NOT NULL""",
    "q_user_totals": f"SELECT split, count(DISTINCT coalesce({_U}, 'unknown')) AS n_users FROM dataset_item GROUP BY 1",
    "q_mixed_vectors": """
        WITH e AS (SELECT vec_id // 3 AS g, vec_id % 3 AS k, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
        j AS (SELECT a.g, list_transform(range(1, len(a.e) + 1), lambda i: 0.5 * a.e[i] + 0.25 * b.e[i] + 0.25 * c.e[i]) AS m FROM e a JOIN e b ON a.g = b.g AND b.k = 1 JOIN e c ON a.g = c.g AND c.k = 2 WHERE a.k = 0)
        SELECT g, round(m[1], 6) AS m0, round(sqrt(list_sum(list_transform(m, lambda x: x * x))), 5) AS norm FROM j""",
}
