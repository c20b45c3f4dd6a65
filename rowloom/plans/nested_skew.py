"""Queries of the nested-record and skewed-key operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from rowloom.operators import nested, skew
from rowloom.sources.tables import read_table


def _both(spark, d):
    return read_table(spark, d, "raw_user_history"), read_table(spark, d, "raw_record")


def p5_found(spark, d):
    return nested.nested_links(*_both(spark, d))


def p6_found(spark, d):
    """Users with at least 2 % of all rows, null users' rows included in all, from the salted per-user results."""
    items = read_table(spark, d, "dataset_item")
    total = items.agg(F.count(F.lit(1))).scalar()
    return skew.salted_user_stats(items).where(F.col("n_records") * 50 >= total).select("user_id")


QUERIES = {
    "p5_found": p5_found,
    "p5_history": lambda s, d: nested.flat_history(*_both(s, d)),
    "p5_query": lambda s, d: nested.flat_query(*_both(s, d)),
    "p5_query_input": lambda s, d: nested.flat_query_input(_both(s, d)[1]),
    "p5_conversations": lambda s, d: nested.flat_conversations(_both(s, d)[1]),
    "p5_turns": lambda s, d: nested.flat_turns(_both(s, d)[1]),
    "p6_found": p6_found,
    "p6_user_stats": lambda s, d: skew.salted_user_stats(read_table(s, d, "dataset_item")),
}

_BLANKS = "' ' || chr(9) || chr(10) || chr(13)"
_ID = "nullif(lower(trim({0}, " + _BLANKS + ")), '')"

ORACLE = {
    "p6_found": f"SELECT user_id FROM (SELECT {_ID.format('user_id')} AS user_id, count(*) AS n FROM dataset_item GROUP BY 1) WHERE user_id IS NOT NULL AND n * 50 >= (SELECT count(*) FROM dataset_item)",
    "p6_user_stats": f"""
        SELECT {_ID.format('user_id')} AS user_id, count(*) AS n_records, count(DISTINCT {_ID.format('question_id')}) AS n_questions,
               count(output) AS n_answers, CAST(coalesce(sum(length(output)), 0) AS BIGINT) AS answer_chars,
               min(length(output)) AS answer_min, max(length(output)) AS answer_max
        FROM dataset_item WHERE {_ID.format('user_id')} IS NOT NULL GROUP BY 1""",
    "p5_found": """
        WITH typed AS (
            SELECT record_id, 'history' AS path, CAST(-1 AS BIGINT) AS parent_pos, CAST(i - 1 AS BIGINT) AS pos
            FROM (SELECT record_id, history AS a, unnest(range(1, len(history) + 1)) AS i FROM raw_user_history) WHERE a[i] IS NOT NULL
            UNION ALL
            SELECT record_id, 'query', -1, i - 1
            FROM (SELECT record_id, query AS a, unnest(range(1, len(query) + 1)) AS i FROM raw_user_history) WHERE a[i] IS NOT NULL
        ), good AS (
            SELECT record_id, CAST(payload AS JSON) AS p FROM raw_record WHERE json_valid(payload) AND json_type(payload) = 'OBJECT' AND NOT regexp_matches(payload, ',\\s*\\}\\s*$')
        ), tops AS (
            SELECT record_id, path, CASE
                WHEN json_type(v) = 'OBJECT' THEN json_array(v)
                WHEN json_type(v) = 'ARRAY' THEN v
                WHEN json_type(v) = 'VARCHAR' AND json_valid(v ->> '$') AND json_type(v ->> '$') = 'ARRAY' THEN CAST(v ->> '$' AS JSON)
                ELSE CAST('[]' AS JSON) END AS a
            FROM (SELECT record_id, 'history' AS path, p -> '$.history' AS v FROM good
                  UNION ALL SELECT record_id, 'query', p -> '$.query' FROM good
                  UNION ALL SELECT record_id, 'conversations', p -> '$.conversations' FROM good)
        ), level1 AS (
            SELECT record_id, path, i AS pos, e FROM (
                SELECT record_id, path, unnest(range(0, CAST(json_array_length(a) AS BIGINT))) AS i, unnest(CAST(a AS JSON[])) AS e FROM tops)
            WHERE json_type(e) = 'OBJECT'
        ), subs AS (
            SELECT record_id, path, pos AS parent_pos, CASE
                WHEN json_type(v) = 'OBJECT' THEN json_array(v)
                WHEN json_type(v) = 'ARRAY' THEN v
                WHEN path <> 'query.input' AND json_type(v) = 'VARCHAR' AND json_valid(v ->> '$') AND json_type(v ->> '$') = 'ARRAY' THEN CAST(v ->> '$' AS JSON)
                ELSE CAST('[]' AS JSON) END AS a
            FROM (SELECT record_id, 'query.input' AS path, pos, e -> '$.input' AS v FROM level1 WHERE path = 'query'
                  UNION ALL SELECT record_id, 'conversations.conversation_history', pos, e -> '$.conversation_history' FROM level1 WHERE path = 'conversations')
        ), level2 AS (
            SELECT record_id, path, parent_pos, i AS pos, e FROM (
                SELECT record_id, path, parent_pos, unnest(range(0, CAST(json_array_length(a) AS BIGINT))) AS i, unnest(CAST(a AS JSON[])) AS e FROM subs)
            WHERE json_type(e) = 'OBJECT'
        )
        SELECT record_id, path, parent_pos, pos FROM typed
        UNION ALL SELECT record_id, path, CAST(-1 AS BIGINT), CAST(pos AS BIGINT) FROM level1
        UNION ALL SELECT record_id, path, CAST(parent_pos AS BIGINT), CAST(pos AS BIGINT) FROM level2""",
}

_TYPED = "SELECT record_id, user_id, CAST(-1 AS BIGINT) AS parent_pos, CAST(i - 1 AS BIGINT) AS pos, {fields} FROM (SELECT record_id, user_id, {a} AS a, unnest(range(1, len({a}) + 1)) AS i FROM raw_user_history) WHERE a[i] IS NOT NULL"


def _elements(value: str, as_text: bool = True) -> str:
    """SQL for the elements of a JSON value: an array's own, a lone object as one, an array written as text (if wanted)."""
    text = f" WHEN json_type({value}) = 'VARCHAR' AND json_valid({value} ->> '$') AND json_type({value} ->> '$') = 'ARRAY' THEN CAST({value} ->> '$' AS JSON)" if as_text else ""
    return f"CASE WHEN json_type({value}) = 'OBJECT' THEN json_array({value}) WHEN json_type({value}) = 'ARRAY' THEN {value}{text} ELSE CAST('[]' AS JSON) END"


def _table(path: str, fields: tuple[str, ...]) -> str:
    """SQL for one target table of the payloads."""
    top, field, as_text = nested.BELOW.get(path, (path, "", True))
    good = "good AS (SELECT record_id, CAST(payload AS JSON) AS p FROM raw_record WHERE json_valid(payload) AND json_type(payload) = 'OBJECT' AND NOT regexp_matches(payload, ',\\s*\\}\\s*$'))"
    walk = f"""{good}, ta AS (SELECT record_id, p ->> '$.user_id' AS user_id, {_elements(f"(p -> '$.{top}')")} AS a FROM good),
        te AS (SELECT * FROM (SELECT record_id, user_id, CAST(-1 AS BIGINT) AS parent_pos, unnest(range(0, CAST(json_array_length(a) AS BIGINT))) AS pos, unnest(CAST(a AS JSON[])) AS e FROM ta) WHERE json_type(e) = 'OBJECT')"""
    last = "te"
    if path in nested.BELOW:
        last = "be"
        walk += f""", ba AS (SELECT record_id, user_id, pos AS parent_pos, {_elements(f"(e -> '$.{field}')", as_text)} AS a FROM te),
        be AS (SELECT * FROM (SELECT record_id, user_id, parent_pos, unnest(range(0, CAST(json_array_length(a) AS BIGINT))) AS pos, unnest(CAST(a AS JSON[])) AS e FROM ba) WHERE json_type(e) = 'OBJECT')"""
    picked = ", ".join(f"{f'try_cast(e ->> {chr(39)}$.{f}{chr(39)} AS DOUBLE)' if path.endswith('conversation_history') and f in nested.NUMERIC else f'e ->> {chr(39)}$.{f}{chr(39)}'} AS \"{f.replace('.', '_')}\"" for f in fields)
    return f"WITH {walk} SELECT record_id, user_id, parent_pos, pos, {picked} FROM {last}"


_HISTORY = ("id", "text", "article", "title", "category", "description", "tag", "citation", "score", "overall", "summary", "reviewText", "abstract", "content")
_named = lambda fields: ", ".join(f'a[i].{f} AS "{f}"' for f in fields)

ORACLE |= {
    "p5_history": f"SELECT * FROM ({_TYPED.format(a='history', fields=_named(_HISTORY))}) UNION ALL SELECT * FROM ({_table('history', _HISTORY)})",
    "p5_query_input": _table("query.input", ("role", "content")),
    "p5_conversations": _table("conversations", ("conversation_id", "conversation_type", "opening_prompt", "conversation_turns")),
    "p5_turns": _table("conversations.conversation_history", ("turn", "role", "content", "score", "if_chosen", "model_name", "user", "chosen", "assistant.preferred", "assistant.rejected")),
}
