"""Queries of curation: fitted histories, renderings, prefixes, training rows, chosen answers, parsed inputs; their oracle SQL beside them."""

from __future__ import annotations

from pyspark.sql import functions as F

from rowloom.functions import parsing
from rowloom.operators import curation, nested
from rowloom.plans.histories import _BL, _FIELDS, _nb, _render
from rowloom.sources.tables import read_table

BUDGET = 1600


def _raw(s, d):
    return read_table(s, d, "raw_user_history")


def _records(s, d):
    return read_table(s, d, "raw_record")


def _digest(c):
    return F.sha2(c, 256)


def fitted(s, d):
    rows = curation.fit_history(_raw(s, d).where("history is not null"), BUDGET)
    chars = F.aggregate("history", F.lit(0).cast("long"), lambda n, x: n + sum((F.coalesce(F.length(x[f]), F.lit(0)) for f in _FIELDS), F.lit(0)))
    return rows.select("record_id", F.col("level").cast("long").alias("level"), F.size("history").cast("long").alias("n_items"), chars.alias("chars"))


def activity(s, d):
    rows = curation.fit_history(_raw(s, d).where("history is not null"), BUDGET)
    task = F.col("task")
    return rows.select("record_id", curation.activity_text(F.col("history"), task, BUDGET).alias("activity"), _digest(curation.activity_text(F.col("history"), task, BUDGET, curation.CONVERSATION_HEAD)).alias("conversation_digest"))


def banner(s, d):
    rows = _raw(s, d)
    return rows.select("record_id", _digest(curation.banner_text(rows, source="history")).alias("digest"), F.length(curation.banner_text(rows, source="history")).cast("long").alias("chars"))


def inputs(s, d):
    rows = read_table(s, d, "dataset_item").where("input is not null")
    made = rows.select("sample_idx", parsing.parse_input(F.col("source"), F.col("input")).alias("p"))
    entries = F.array_join(F.transform(F.array_sort(F.map_entries("p.fields")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), "\n")
    return made.select("sample_idx", F.col("p.instruction").alias("instruction"), _digest(entries).alias("fields_digest"), F.size("p.fields").cast("long").alias("n_fields"))


def flat(s, d):
    rows = read_table(s, d, "dataset_item").where("source in ('ec', 'opinionqa', 'personalreddit')")
    return curation.flat_rows(rows, "ec", F.col("split"), "input", "output").select("user_id", "question_id", _digest(F.col("profile_text")).alias("profile_digest"), _digest(F.coalesce("input", F.lit(""))).alias("input_digest"), "output")


def users_filled(s, d):
    samples = read_table(s, d, "text_generation_sample").select("sample_id", "question_id", "user_id")
    source = read_table(s, d, "dataset_item")
    return curation.fill_users(samples, source, ("question_id", "sample_id"), "sample_id").select("sample_id", "user_id")


def dialogue(s, d):
    return curation.chosen_dialogue(nested.flat_turns(_records(s, d)))


def personalities(s, d):
    rows = read_table(s, d, "dataset_item").where("profile_text is not null")
    marked = F.concat(F.lit("## User Profile: "), F.col("profile_text"), F.lit("\n## User Personality: \"calm\""))
    text = F.when(F.pmod("sample_idx", F.lit(2)) == 0, marked).otherwise(F.col("profile_text"))
    made = rows.select("sample_idx", curation.profile_parts(text).alias("p"))
    return made.select("sample_idx", _digest(F.col("p.profile")).alias("profile_digest"), F.col("p.personality").alias("personality"))


QUERIES = {
    "q_fit_history": fitted,
    "q_activity_text": activity,
    "q_banner_history": banner,
    "q_expanding_prefixes": lambda s, d: curation.expanding_prefixes(_raw(s, d)),
    "q_history_training_rows": lambda s, d: curation.augmented_rows(_raw(s, d)).select("record_id", "question_id", "turn", "n_before", _digest(F.col("input")).alias("input_digest"), "output"),
    "q_flat_samples": flat,
    "q_query_chosen": lambda s, d: curation.query_chosen(_records(s, d), 30.0, "gpt"),
    "q_chosen_dialogue": dialogue,
    "q_parse_inputs": inputs,
    "q_fill_users": users_filled,
    "q_profile_parts": personalities,
}

_STRIP = "regexp_replace(regexp_replace({0}, '^[\\s\\x{{a0}}]+', ''), '[\\s\\x{{a0}}]+$', '')"


def _sum(part: str) -> str:
    """SQL for a sum over the fields of `x`; {v} and {k} stand for value and the length of its name."""
    return " + ".join(f"coalesce({part.format(v='x.' + f, k=len(f))}, 0)" for f in _FIELDS)


def _cut(limit: str, value: str, keep: bool = False) -> str:
    t = f"trim({value}, {_BL})"
    return f"CASE WHEN length({t}) > {limit} THEN substring({t}, 1, {limit}) || '...' ELSE {value if keep else t} END"


_ITEMS = "items AS (SELECT record_id, task, i - 1 AS pos, history[i] AS x FROM (SELECT *, unnest(range(1, len(history) + 1)) AS i FROM raw_user_history) WHERE history[i] IS NOT NULL)"
_FIT = f"""
    {_ITEMS},
    sized AS (SELECT record_id, sum({_sum("length({v}) + {k} + 8")}) AS printed, {', '.join(f'''sum({_sum("CASE WHEN length(trim({v}, " + _BL + ")) > " + str(n) + " THEN " + str(n + 3) + " ELSE length(trim({v}, " + _BL + ")) END + {k} + 10")}) AS s{n}''' for n in curation.VALUE_LIMITS)} FROM items GROUP BY record_id),
    levels AS (SELECT record_id, CASE WHEN floor(coalesce(printed, 0) / 4) <= {BUDGET} * 0.5 THEN 0 {' '.join(f'WHEN floor(s{n} / 4) + 1000 <= {BUDGET} * 0.9 THEN {n}' for n in curation.VALUE_LIMITS)} ELSE -1 END AS level
        FROM (SELECT record_id FROM raw_user_history WHERE history IS NOT NULL) LEFT JOIN sized USING (record_id)),
    tail AS (SELECT record_id, pos, x, task, sum({_sum("CASE WHEN {v} IS NOT NULL THEN least(length({v}), 300) END")}) OVER (PARTITION BY record_id ORDER BY pos DESC) AS t FROM items),
    kept AS (SELECT record_id, task, pos, level, x FROM tail JOIN levels USING (record_id) WHERE level >= 0 OR floor(t / 4) + 100 <= {BUDGET} * 0.9),
    cut AS (SELECT record_id, task, pos, level, struct_pack({', '.join(f'"{f}" := CASE WHEN level = 0 THEN x.{f} WHEN level > 0 THEN ' + _cut('level', 'x.' + f) + ' ELSE ' + _cut('300', 'x.' + f, True) + ' END' for f in _FIELDS)}) AS item FROM kept)"""
_ACTIVITY = f"""CASE WHEN count(t) = 0 THEN '' ELSE '{{0}}' || chr(10) || string_agg(t, ' || ' ORDER BY pos) END"""


def _lines() -> str:
    cut = lambda v: f"CASE WHEN length({v}) > 300 THEN substring({v}, 1, 300) || '...' ELSE {v} END"
    return "nullif(concat_ws(chr(10), " + ", ".join(f"'{curation.title_case(f)}: ' || {cut(_nb('x.' + f))}" for f in sorted(_FIELDS)) + "), '')"


def _questions() -> tuple[str, str]:
    filled = lambda fields: "coalesce(" + ", ".join(f"nullif(x.{f}, '')" for f in fields) + ")"
    asked, answered = [], []
    for task, (text, of, answer) in curation.HISTORY_QUESTIONS.items():
        asked.append(f"WHEN task = '{task}' THEN '{text}' || {filled(of)}")
        answered.append(f"WHEN task = '{task}' THEN {filled(answer)}")
    review = "'Generate the review text written by a reviewer who has a given an overall rating of \"' || nullif(x.overall, '') || '\" for a product with description \"' || nullif(x.description, '') || '\". The summary of the review text is \"' || nullif(x.summary, '') || '\".'"
    asked.append(f"WHEN task = 'longlamp_product_review' THEN {review}")
    answered.append("WHEN task = 'longlamp_product_review' THEN nullif(x.reviewText, '')")
    return "CASE " + " ".join(asked) + " END", "CASE " + " ".join(answered) + " END"


def _array(v: str, as_text: bool = True) -> str:
    text = f" WHEN json_type({v}) = 'VARCHAR' AND json_valid({v} ->> '$') AND json_type({v} ->> '$') = 'ARRAY' THEN CAST({v} ->> '$' AS JSON)" if as_text else ""
    return f"CASE WHEN json_type({v}) = 'OBJECT' THEN json_array({v}) WHEN json_type({v}) = 'ARRAY' THEN {v}{text} ELSE CAST('[]' AS JSON) END"


_GOOD = "good AS (SELECT record_id, CAST(payload AS JSON) AS p FROM raw_record WHERE json_valid(payload) AND json_type(payload) = 'OBJECT' AND NOT regexp_matches(payload, ',\\s*\\}\\s*$'))"
_CONV = f"""{_GOOD}, ca AS (SELECT record_id, {_array("(p -> '$.conversations')")} AS a FROM good),
    cv AS (SELECT record_id, conversation, e FROM (SELECT record_id, unnest(range(0, CAST(json_array_length(a) AS BIGINT))) AS conversation, unnest(CAST(a AS JSON[])) AS e FROM ca) WHERE json_type(e) = 'OBJECT'),
    ta AS (SELECT record_id, conversation, {_array("(e -> '$.conversation_history')")} AS a FROM cv),
    tu AS (SELECT record_id, conversation, pos, e FROM (SELECT record_id, conversation, unnest(range(0, CAST(json_array_length(a) AS BIGINT))) AS pos, unnest(CAST(a AS JSON[])) AS e FROM ta) WHERE json_type(e) = 'OBJECT')"""
_IN, _OUT = _questions()

_MARKED = " ".join(
    f"WHEN source = '{t}' THEN struct_pack(i := CASE WHEN contains(input, '{m}') THEN {_STRIP.format(f"substring(input, 1, strpos(input, '{m}') - 1)")} ELSE input END, "
    f"f := '{f}=' || CASE WHEN contains(input, '{m}') THEN {_STRIP.format(f"substring(input, strpos(input, '{m}') + {len(m)})")} ELSE '' END, n := 1)"
    for t, (m, f) in parsing.MARKERS.items()
)
_TITLE = "regexp_extract(input, 'title \"([^\"]+)\"', 1)"
_NUMBERS, _TEXTS = (f"regexp_extract_all(input, '\\[([0-9]+)\\]: \"([^\"]+)\"', {g})" for g in (1, 2))
_LINES = f"array_to_string(list_transform(list_filter(range(1, len({_NUMBERS}) + 1), lambda i: list_position({_NUMBERS}, {_NUMBERS}[i]) = i), lambda i: '[' || {_NUMBERS}[i] || ']: \"' || list_filter(list_zip({_NUMBERS}, {_TEXTS}), lambda z: z[1] = {_NUMBERS}[i])[-1][2] || '\"'), chr(10))"
_BEHIND_ITEMS = f"CASE WHEN contains(input, '{parsing.ITEMS_MARKER}') THEN substring(input, strpos(input, '{parsing.ITEMS_MARKER}') + {len(parsing.ITEMS_MARKER)}) ELSE '' END"
_TOPIC = parsing.TOPIC_CUT
_OPINION = "contains(input, 'Question:') AND contains(input, 'Options:')"
_PARSED = f"""CASE {_MARKED}
    WHEN source = 'lamp_citation' THEN struct_pack(i := {_STRIP.format("CASE WHEN contains(input, '[1]:') THEN substring(input, 1, strpos(input, '[1]:') - 1) ELSE input END")}, f := 'options_str=' || {_LINES} || chr(10) || 'paper_title=' || {_TITLE}, n := 2)
    WHEN source = 'lamp_scholarly_title' THEN struct_pack(i := '{parsing.SCHOLARLY_ASK}', f := 'abstract=' || {_STRIP.format(f"replace(input, '{parsing.SCHOLARLY_ASK}', '')")}, n := 1)
    WHEN source = 'longlamp_product_review' THEN struct_pack(i := split_part(input, '{parsing.REVIEW_ASK}', 1) || '{parsing.REVIEW_ASK}', f := 'product_description=' || regexp_extract(input, 'product with description "([^"]+)"', 1) || chr(10) || 'rating=' || regexp_extract(input, 'rating of "([^"]+)"', 1)
        || chr(10) || 'review_summary=' || regexp_extract(input, 'summary of the review text is "([^"]+)"', 1), n := 3)
    WHEN source = 'longlamp_abstract_generation' THEN struct_pack(i := 'Generate an abstract for the title "' || {_TITLE} || '"', f := 'key_items=' || array_to_string(regexp_extract_all({_BEHIND_ITEMS}, '[0-9]+\\.\\s*([^\\n]+)', 1), chr(10)) || chr(10) || 'paper_title=' || {_TITLE}, n := 2)
    WHEN source = 'longlamp_topic_writing' AND contains(input, 'reddit post') AND contains(input, '{_TOPIC}') THEN struct_pack(i := {_STRIP.format(f"substring(input, 1, strpos(input, '{_TOPIC}') - 1)")} || '{_TOPIC}', f := 'topic_prompt=' || {_STRIP.format(f"substring(input, strpos(input, '{_TOPIC}') + {len(_TOPIC)})")}, n := 1)
    WHEN source = 'longlamp_topic_writing' AND contains(input, 'reddit post') THEN struct_pack(i := {_STRIP.format('input')} || '{_TOPIC}', f := '', n := 0)
    WHEN source = 'opinionqa' AND {_OPINION} THEN struct_pack(i := '{parsing.OPINION_ASK}', f := 'options=' || {_STRIP.format("split_part(substring(input, strpos(input, 'Options:') + 8), 'Answer:', 1)")} || chr(10) || 'question=' || {_STRIP.format("replace(substring(input, 1, strpos(input, 'Options:') - 1), 'Question:', '')")}, n := 2)
    WHEN source = 'opinionqa' THEN struct_pack(i := '{parsing.OPINION_FALLBACK}', f := '', n := 0)
    WHEN source = 'ec' THEN struct_pack(i := '{parsing.ARTICLE_ASK}', f := 'article=' || input, n := 1)
    WHEN source = 'personalreddit' THEN struct_pack(i := '{parsing.REDDIT_ASK}', f := 'input_text=' || input, n := 1)
    WHEN source IN ('prism', 'aloe') THEN struct_pack(i := '', f := 'conversation=' || input, n := 1)
    ELSE struct_pack(i := input, f := '', n := 0) END"""

ORACLE = {
    "q_parse_inputs": f"SELECT sample_idx, p.i AS instruction, sha256(p.f) AS fields_digest, CAST(p.n AS BIGINT) AS n_fields FROM (SELECT sample_idx, {_PARSED} AS p FROM dataset_item WHERE input IS NOT NULL)",
    "q_fit_history": f"""
        WITH {_FIT} SELECT record_id, CAST(any_value(l.level) AS BIGINT) AS level, count(pos) AS n_items, CAST(coalesce(sum({' + '.join(f'coalesce(length(item.{f}), 0)' for f in _FIELDS)}), 0) AS BIGINT) AS chars
        FROM levels l LEFT JOIN cut USING (record_id) GROUP BY record_id""",
    "q_activity_text": f"""
        WITH {_FIT}, r AS (SELECT record_id, pos, {_render(800)} AS t FROM cut),
        b AS (SELECT record_id, {_ACTIVITY.format('Recent User Activity:')} AS a, {_ACTIVITY.format('Recent Conversations:')} AS c FROM levels LEFT JOIN r USING (record_id) GROUP BY record_id)
        SELECT record_id, {'CASE WHEN floor(length(a) / 4) > 1600 AND length(a) > 6000 THEN substring(a, 1, 6000) || chr(46) || chr(46) || chr(46) ELSE a END'} AS activity,
            sha256(CASE WHEN floor(length(c) / 4) > 1600 AND length(c) > 6000 THEN substring(c, 1, 6000) || '...' ELSE c END) AS conversation_digest FROM b""",
    "q_banner_history": f"""
        WITH {_ITEMS}, r AS (SELECT record_id, pos, {_lines()} AS t FROM items),
        b AS (SELECT h.record_id, CASE WHEN count(t) = 0 THEN 'No history available.' ELSE chr(10) || repeat('=', 50) || chr(10) || 'User History (from history)' || chr(10) || repeat('=', 50) || chr(10) || string_agg(t, chr(10) || repeat('-', 50) || chr(10) ORDER BY pos) || chr(10) || repeat('=', 50) END AS b
            FROM raw_user_history h LEFT JOIN r USING (record_id) GROUP BY h.record_id)
        SELECT record_id, sha256(b) AS digest, length(b) AS chars FROM b""",
    "q_expanding_prefixes": """
        WITH r AS (SELECT record_id, coalesce(user_id, 'unknown') AS u, len(history) AS n, CASE WHEN len(history) <= 4 THEN least(3, len(history) - 1) ELSE 4 END AS st FROM raw_user_history WHERE len(history) > 0),
        e AS (SELECT record_id, u, unnest(range(st, n)) AS last FROM r) SELECT record_id, u || '_' || CAST(last AS VARCHAR) AS custom_id, last, last + 1 AS n_items FROM e""",
    "q_history_training_rows": f"""
        WITH z AS (SELECT task FROM raw_user_history GROUP BY task HAVING sum(coalesce(len(query), 0)) < 10000 AND task NOT IN ('lamp_citation', 'lamp_tweet')),
        i AS (SELECT record_id, user_id, task, len(history) AS n, i - 1 AS pos, history[i] AS x FROM (SELECT *, unnest(range(1, len(history) + 1)) AS i FROM raw_user_history WHERE len(history) > 1 AND task IN (SELECT task FROM z))),
        m AS (SELECT *, n - pos AS turn, {_IN} AS input, {_OUT} AS output FROM i WHERE pos >= 1 AND n - pos <= 50)
        SELECT record_id, concat_ws('_', task, coalesce(user_id, 'unknown'), 'history', CAST(pos AS VARCHAR)) AS question_id, turn, pos AS n_before, sha256(input) AS input_digest, output FROM m WHERE input IS NOT NULL AND output IS NOT NULL""",
    "q_flat_samples": f"""
        SELECT user_id, concat_ws('_', question_id, split) AS question_id, sha256(coalesce({_STRIP.format('profile_text')}, '')) AS profile_digest, sha256(coalesce(input, '')) AS input_digest, output
        FROM dataset_item WHERE source IN ('ec', 'opinionqa', 'personalreddit')""",
    "q_query_chosen": f"""
        WITH {_CONV}, qa AS (SELECT record_id, {_array("(p -> '$.query')")} AS a FROM good),
        q AS (SELECT record_id, pos, coalesce(try_cast(e ->> '$.conversation_idx' AS BIGINT), pos) AS conversation, coalesce(e ->> '$.output.content', e ->> '$.output', '') AS expected
            FROM (SELECT record_id, unnest(range(0, CAST(json_array_length(a) AS BIGINT))) AS pos, unnest(CAST(a AS JSON[])) AS e FROM qa) WHERE json_type(e) = 'OBJECT'),
        t AS (SELECT record_id, conversation, pos AS k, coalesce(e ->> '$.content', '') AS content, try_cast(e ->> '$.score' AS DOUBLE) AS score, e ->> '$.model_name' AS model FROM tu WHERE e ->> '$.role' = 'model' AND coalesce(try_cast(e ->> '$.if_chosen' AS BOOLEAN), false)),
        m AS (SELECT q.*, t.k, t.content, t.score, t.model FROM q JOIN (SELECT DISTINCT record_id, conversation FROM cv) c USING (record_id, conversation) LEFT JOIN t USING (record_id, conversation)),
        b AS (SELECT record_id, pos, conversation, arg_min(struct_pack(s := score, m := model), k) FILTER (content = expected) AS ex, arg_min(struct_pack(s := score, m := model), k) AS fi FROM m GROUP BY ALL),
        f AS (SELECT record_id, pos, conversation, CASE WHEN ex.s IS NOT NULL OR ex.m IS NOT NULL THEN ex ELSE fi END AS f FROM b)
        SELECT record_id, pos, conversation, f.s AS score, lower(f.m) AS model_name FROM f WHERE (f.s IS NULL OR f.s >= 30) AND contains(lower(coalesce(f.m, '')), 'gpt')""",
    "q_chosen_dialogue": f"""
        WITH {_CONV}, l AS (SELECT record_id, conversation, pos, CASE WHEN e ->> '$.role' = 'user' THEN 'User (Turn ' || coalesce(e ->> '$.turn', '') || '): ' || coalesce(e ->> '$.content', '')
            WHEN e ->> '$.role' = 'model' AND e ->> '$.if_chosen' = 'true' THEN 'Assistant (Turn ' || coalesce(e ->> '$.turn', '') || '): ' || coalesce(e ->> '$.content', '') END AS line FROM tu)
        SELECT record_id, conversation, string_agg(line, chr(10) ORDER BY pos) AS dialogue FROM l WHERE line IS NOT NULL GROUP BY ALL""",
    "q_profile_parts": f"""
        WITH r AS (SELECT sample_idx, sample_idx % 2 = 0 AS m, regexp_extract({_STRIP.format('profile_text')} || ' ', '(?is)##\\s*User', 0) AS known, profile_text AS t FROM dataset_item WHERE profile_text IS NOT NULL),
        s AS (SELECT sample_idx, m, {_STRIP.format("CASE WHEN m THEN '## User Profile: ' || t || chr(10) || '## User Personality: \"calm\"' ELSE t END")} AS s FROM r),
        q AS (SELECT sample_idx, s, {_STRIP.format("regexp_extract(s, '(?is)##\\s*User\\s*Profile:\\s*\"?(.*?)\"?(?:\\n|$)', 1)")} AS a, {_STRIP.format("regexp_extract(s, '(?is)##\\s*User\\s*Personality:\\s*\"?(.*?)\"?(?:\\n|$)', 1)")} AS b FROM s)
        SELECT sample_idx, sha256(coalesce(nullif(a, ''), CASE WHEN contains(s, 'User Profile:') THEN trim({_STRIP.format("split_part(substring(s, strpos(s, 'User Profile:') + 13), 'User Personality:', 1)")}, '"') END, '')) AS profile_digest,
            coalesce(nullif(b, ''), CASE WHEN contains(s, 'User Personality:') THEN trim({_STRIP.format("substring(s, strpos(s, 'User Personality:') + 17)")}, '"') END, '') AS personality FROM q""",
    "q_fill_users": """
        WITH k AS (SELECT CAST(question_id AS VARCHAR) AS q, arg_max(user_id, sample_idx) FILTER (user_id IS NOT NULL) AS u FROM dataset_item WHERE question_id IS NOT NULL GROUP BY 1)
        SELECT t.sample_id, CASE WHEN coalesce(t.user_id, '') <> '' THEN t.user_id ELSE coalesce(nullif(coalesce(k.u, p.user_id), ''), t.user_id) END AS user_id
        FROM text_generation_sample t LEFT JOIN k ON k.q = t.question_id LEFT JOIN dataset_item p ON p.sample_idx = t.sample_id""",
}
