"""Queries on users' histories, their oracle SQL beside them."""

from __future__ import annotations

from pyspark.sql import functions as F

from rowloom.functions import text as tx
from rowloom.operators import history as h
from rowloom.operators import retrieval
from rowloom.sources.tables import read_table


def _raw(s, d):
    return read_table(s, d, "raw_user_history")


def bm25_query(s, d):
    shown = F.transform("history", lambda x: F.when(x.isNotNull(), F.coalesce(tx.render_item(x, F.col("task")), F.lit(""))))
    rows = _raw(s, d).select("record_id", shown.alias("docs"), F.transform("query", lambda q: q["input"]).alias("queries"))
    return retrieval.bm25_in_row(rows, "record_id", "docs", "queries", (1, 2, 4))


QUERIES = {
    "q_history_label_distribution": lambda s, d: h.label_distribution(_raw(s, d)),
    "q_explode_queries": lambda s, d: h.explode_queries(_raw(s, d)),
    "q_prefix_context": lambda s, d: h.prefix_contexts(_raw(s, d)),
    "q_round_robin_augment": lambda s, d: h.round_robin(_raw(s, d), 5),
    "q_budget_truncation": lambda s, d: h.keep_recent(_raw(s, d), 400),
    "q_pack_until_full": lambda s, d: h.pack_until_full(_raw(s, d), 300),
    "q_render_item": lambda s, d: h.history_items(_raw(s, d)).select("record_id", F.col("pos").cast("long").alias("pos"), tx.render_item(F.col("item"), F.col("task"), 120).alias("rendered")),
    "q_recent_profile": lambda s, d: h.recent_profile(_raw(s, d), 6, 900),
    "q_history_field_counts": lambda s, d: h.item_keys(_raw(s, d)),
    "q_latest_delivery": lambda s, d: h.latest_delivery(_raw(s, d)).select("record_id", "user_id", "task", h.history_length().cast("long").alias("n_items")),
    "q_bm25_topk_multi": bm25_query,
}

_BL = "' ' || chr(9) || chr(10) || chr(13)"


def _nb(*columns: str) -> str:
    return "coalesce(" + ", ".join(f"nullif(trim({c}, {_BL}), '')" for c in columns) + ")"


def _render(limit: int) -> str:
    cases = []
    for task, fields in tx.ITEM_FIELDS.items():
        parts = ", ".join(
            f"'{shown}: ' || CASE WHEN length({_nb(*['item.' + f for f in own])}) > {limit} THEN substring({_nb(*['item.' + f for f in own])}, 1, {limit}) || '...' ELSE {_nb(*['item.' + f for f in own])} END" for own, shown in fields
        )
        cases.append(f"WHEN task = '{task}' THEN nullif(concat_ws(' | ', {parts}), '')")
    return "CASE " + " ".join(cases) + " END"


_LABEL = "CASE " + " ".join(f"WHEN task = '{t}' THEN {_nb(*['item.' + f for f in fs])}" for t, fs in tx.LABEL_FIELDS.items()) + " END"
_ITEMS = "items AS (SELECT record_id, user_id, task, i - 1 AS pos, history[i] AS item FROM (SELECT *, unnest(range(1, len(history) + 1)) AS i FROM raw_user_history) WHERE history[i] IS NOT NULL)"
_TOKENS = f"sized AS (SELECT record_id, pos, CAST(coalesce(floor(length({_render(800)}) / 4), 0) AS BIGINT) AS t FROM items)"
_FIELDS = ["id", "text", "article", "title", "category", "description", "tag", "citation", "score", "overall", "summary", "reviewText", "abstract", "content"]

ORACLE = {
    "q_history_label_distribution": f"""
        WITH {_ITEMS}, lab AS (SELECT record_id, {_LABEL} AS label FROM items),
        cnt AS (SELECT record_id, label, count(*) AS n FROM lab WHERE label IS NOT NULL GROUP BY ALL),
        tot AS (SELECT *, sum(n) OVER (PARTITION BY record_id) AS t FROM cnt)
        SELECT record_id, 'total=' || CAST(CAST(max(t) AS BIGINT) AS VARCHAR) || ' | ' || string_agg(label || '=' || CAST(n AS VARCHAR) || ' (' || printf('%.1f', CAST(100.0 AS DOUBLE) * n / t) || '%)', ', ' ORDER BY n DESC, label) AS label_distribution
        FROM tot GROUP BY record_id""",
    "q_explode_queries": f"""
        WITH q AS (SELECT record_id, user_id, task, i - 1 AS pos, query[i] AS q FROM (SELECT *, unnest(range(1, len(query) + 1)) AS i FROM raw_user_history) WHERE query[i] IS NOT NULL)
        SELECT record_id, pos, concat_ws('_', task, user_id, 'query', CAST(pos AS VARCHAR)) AS question_id, q.input AS input, {_nb('q.gold', 'q.output')} AS gold FROM q""",
    "q_prefix_context": f"""
        WITH {_ITEMS}, c AS (SELECT record_id, pos, coalesce(length({_render(800)}), 0) AS chars FROM items)
        SELECT record_id, pos, count(*) OVER w AS n_before, CAST(coalesce(sum(chars) OVER w, 0) AS BIGINT) AS chars_before FROM c
        WINDOW w AS (PARTITION BY record_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
    "q_round_robin_augment": f"WITH {_ITEMS}, r AS (SELECT record_id, pos, row_number() OVER (PARTITION BY record_id ORDER BY pos DESC) AS turn FROM items) SELECT record_id, pos, turn FROM r WHERE pos >= 1 AND turn <= 5",
    "q_budget_truncation": f"""
        WITH {_ITEMS}, {_TOKENS}, u AS (SELECT *, sum(t) OVER (PARTITION BY record_id ORDER BY pos DESC) AS used FROM sized)
        SELECT record_id, count(*) AS n_kept, min(pos) AS first_pos, CAST(max(used) AS BIGINT) AS tokens FROM u WHERE used <= 360 GROUP BY record_id""",
    "q_pack_until_full": f"""
        WITH {_ITEMS}, {_TOKENS}, u AS (SELECT *, sum(t) OVER (PARTITION BY record_id ORDER BY pos) AS used FROM sized)
        SELECT record_id, count(*) AS n_packed, CAST(max(used) AS BIGINT) AS tokens FROM u WHERE used <= 300 GROUP BY record_id""",
    "q_render_item": f"WITH {_ITEMS} SELECT record_id, pos, {_render(120)} AS rendered FROM items",
    "q_recent_profile": f"""
        WITH {_ITEMS}, r AS (SELECT record_id, pos, {_render(800)} AS t FROM items), k AS (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY pos DESC) AS n FROM r WHERE t IS NOT NULL),
        b AS (SELECT record_id, 'Recent User Activity:' || chr(10) || string_agg(t, ' || ' ORDER BY pos) AS body FROM k WHERE n <= 6 GROUP BY record_id)
        SELECT record_id, CASE WHEN length(body) > 900 THEN substring(body, 1, 900) || '...' ELSE body END AS profile FROM b""",
    "q_history_field_counts": f"WITH {_ITEMS} " + " UNION ALL ".join(f"SELECT task, '{f}' AS field, count(*) AS n FROM items WHERE pos < 10 AND {_nb('item.' + f)} IS NOT NULL GROUP BY task" for f in _FIELDS),
    "q_latest_delivery": """
        SELECT record_id, user_id, task, CAST(coalesce(len(history), 0) AS BIGINT) AS n_items FROM raw_user_history
        QUALIFY user_id IS NULL OR row_number() OVER (PARTITION BY user_id, task ORDER BY received_at DESC, record_id DESC) = 1""",
    "q_bm25_topk_multi": f"""
        WITH {_ITEMS}, docs AS (SELECT record_id AS g, pos, string_split(coalesce({_render(800)}, ''), ' ') AS words FROM items),
        qs AS (SELECT record_id AS g, i - 1 AS qid, query[i].input AS t FROM (SELECT *, unnest(range(1, len(query) + 1)) AS i FROM raw_user_history) WHERE query[i].input IS NOT NULL),
        st AS (SELECT g, count(*) AS n, avg(len(words)) AS avgdl FROM docs GROUP BY g),
        tf AS (SELECT g, pos, dl, w, count(*) AS tf FROM (SELECT g, pos, len(words) AS dl, unnest(words) AS w FROM docs) GROUP BY ALL),
        dfr AS (SELECT g, w, ln(n - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM tf JOIN st USING (g) GROUP BY g, w, n),
        idf AS (SELECT g, w, CASE WHEN raw < 0 THEN 0.25 * avg(raw) OVER (PARTITION BY g) ELSE raw END AS idf FROM dfr),
        qt AS (SELECT g, qid, w, count(*) AS qf FROM (SELECT g, qid, unnest(string_split(t, ' ')) AS w FROM qs) GROUP BY ALL),
        hit AS (SELECT g, qid, pos, sum(qf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS s FROM qt JOIN idf USING (g, w) JOIN tf USING (g, w) JOIN st USING (g) GROUP BY ALL),
        every AS (SELECT qs.g, qs.qid, docs.pos, coalesce(hit.s, 0) AS s FROM qs JOIN docs USING (g) LEFT JOIN hit ON hit.g = qs.g AND hit.qid = qs.qid AND hit.pos = docs.pos),
        rk AS (SELECT *, row_number() OVER (PARTITION BY g, qid ORDER BY round(s, 9) DESC, pos DESC) AS r FROM every)
        SELECT g AS grp, qid, string_agg(CAST(pos AS VARCHAR), ',' ORDER BY r) FILTER (r <= 1) AS top_k1, string_agg(CAST(pos AS VARCHAR), ',' ORDER BY r) FILTER (r <= 2) AS top_k2, string_agg(CAST(pos AS VARCHAR), ',' ORDER BY r) FILTER (r <= 4) AS top_k4
        FROM rk GROUP BY g, qid""",
}
