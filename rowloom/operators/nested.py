"""Deeply nested records as related flat tables: higher-order projections with one inline per target table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Part of a wrapper around a payload; no payload can close the wrapper without knowing it.
_SEAL = "rowloom-7c1d0f52b9e84a63"

LINK = "struct<path:string,parent_pos:bigint,pos:bigint,node:variant>"


def strict_objects(df: DataFrame, payload: str, *keep: str) -> DataFrame:
    """The payloads that are, as a whole, one valid JSON object, as variants (`keep`, `v`), each parsed once.

    The JSON reader stops after the first value and ignores what follows. Inside a sealed array anything before or after
    the object breaks the array or changes its length, so broken, repeated and blank lines give no row.
    """
    parsed = df.selectExpr(*keep, f"""try_variant_get(try_parse_json(concat('["{_SEAL}",', `{payload}`, ',"{_SEAL}"]')), '$', 'array<variant>') as _a""")
    whole = f"size(_a) = 3 and try_variant_get(_a[2], '$', 'string') = '{_SEAL}' and try_variant_get(_a[1], '$', 'map<string,variant>') is not null"
    return parsed.where(whole).selectExpr(*keep, "_a[1] as v")


def is_object(column: str) -> str:
    """SQL for whether a text is, as a whole, one valid JSON object; false for null."""
    sealed = f"""try_variant_get(try_parse_json(concat('["{_SEAL}",', `{column}`, ',"{_SEAL}"]')), '$', 'array<variant>')"""
    return f"coalesce(size({sealed}) = 3 and try_variant_get({sealed}[2], '$', 'string') = '{_SEAL}' and try_variant_get({sealed}[1], '$', 'map<string,variant>') is not null, false)"


def _elements(value: str, text_arrays: bool = True) -> str:
    """SQL for the elements of a variant: an array's own, a lone object as one, an array written as JSON text (if wanted)."""
    text = f"""
        when {value} is not null and schema_of_variant({value}) = 'STRING'
        then try_variant_get(try_parse_json(concat('["{_SEAL}",', try_variant_get({value}, '$', 'string'), ',"{_SEAL}"]')), '$[1]', 'array<variant>')"""
    return f"""coalesce(case
        when try_variant_get({value}, '$', 'array<variant>') is not null then try_variant_get({value}, '$', 'array<variant>')
        when try_variant_get({value}, '$', 'map<string,variant>') is not null then array({value}){text if text_arrays else ''}
        end, array())"""


def _rows(elements: str, path: str, parent: str) -> str:
    """SQL for an array of links: one per element that is an object, with its place among all elements."""
    return f"""filter(
        transform({elements}, (x, i) -> named_struct('path', '{path}', 'parent_pos', {parent}, 'pos', cast(i as bigint),
            'node', if(try_variant_get(x, '$', 'map<string,variant>') is null, cast(null as variant), x))),
        r -> r.node is not null)"""


def _below(parents: str, field: str, path: str, text_arrays: bool) -> str:
    """SQL for the links one level down: the parent's position is attached by a nested transform, flatten joins the arrays."""
    child = f"try_variant_get(p.node, '$.{field}', 'variant')"
    return f"flatten(transform({parents}, p -> {_rows(_elements(child, text_arrays), path, 'p.pos')}))"


#: Field of each top array in a payload, and path and field of the arrays below them.
TOPS = {"history": "history", "query": "query", "conversations": "conversations"}
BELOW = {"query.input": ("query", "input", False), "conversations.conversation_history": ("conversations", "conversation_history", True)}


#: Fields that are read as numbers; all others as text.
NUMERIC = {"score": "double"}


def payload_rows(df: DataFrame, path: str, payload: str = "payload", keep: tuple[str, ...] = ("record_id",)) -> DataFrame:
    """The rows of one target table: one per array element of that path that is an object (`path`, `parent_pos`, `pos`, `node`).

    Only the arrays on the way to the path are read out of the payload; the ancestors' positions are attached by nested
    transforms, flatten joins the arrays, and one inline emits the rows. A lone object counts as an array of one; an array
    written as JSON text counts as that array, except for `query.input`, where text is a plain question. Elements that are no
    objects give no row but keep their position. Null, blank and broken payloads give no row. Repeated records keep their
    rows. `user_id` is the payload's own, as text.
    """
    top = BELOW[path][0] if path in BELOW else path
    tops = strict_objects(df, payload, *keep).selectExpr(*keep, "try_variant_get(v, '$.user_id', 'string') as user_id", f"try_variant_get(v, '$.{TOPS[top]}', 'variant') as a")
    rows = tops.selectExpr(*keep, "user_id", f"{_rows(_elements('a'), top, 'cast(-1 as bigint)')} as rows")
    if path in BELOW:
        _, field, as_text = BELOW[path]
        rows = rows.selectExpr(*keep, "user_id", f"{_below('rows', field, path, as_text)} as rows")
    return rows.selectExpr(*keep, "user_id", "inline(rows)")


def payload_links(df: DataFrame, payload: str = "payload", keep: tuple[str, ...] = ("record_id",)) -> DataFrame:
    """The rows of all five target tables of the payloads, as `payload_rows` gives each (`path`, `parent_pos`, `pos`, `node`)."""
    return reduce(DataFrame.unionByName, [payload_rows(df, path, payload, keep) for path in (*TOPS, *BELOW)])


def typed_links(df: DataFrame, arrays: tuple[str, ...] = ("history", "query"), keep: tuple[str, ...] = ("record_id", "user_id")) -> DataFrame:
    """The links of typed array columns: one row per element that is not null (`path`, `parent_pos` -1, `pos`)."""
    parts = [
        f"coalesce(filter(transform(`{a}`, (x, i) -> named_struct('path', '{a}', 'parent_pos', cast(-1 as bigint), 'pos', cast(i as bigint), 'there', x is not null)), r -> r.there), array())"
        for a in arrays
    ]
    return df.selectExpr(*keep, f"inline(concat({', '.join(parts)}))").drop("there")


def nested_links(history: DataFrame, records: DataFrame) -> DataFrame:
    """All elements of both nested tables with their parent (`record_id`, `path`, `parent_pos`, `pos`)."""
    columns = ("record_id", "path", "parent_pos", "pos")
    return typed_links(history).select(*columns).unionByName(payload_links(records).select(*columns))


def flat_history(history: DataFrame, records: DataFrame) -> DataFrame:
    """History items of both tables, one row each, under user and position; absent fields are null."""
    fields = ("id", "text", "article", "title", "category", "description", "tag", "citation", "score", "overall", "summary", "reviewText", "abstract", "content")
    return _flat_typed(history, "history", fields).unionByName(_flat_payload(records, "history", fields))


def flat_query(history: DataFrame, records: DataFrame) -> DataFrame:
    """Queries of both tables; `input` is the text, or the JSON text of nested messages (their rows are in flat_query_input)."""
    fields = ("id", "input", "gold", "output")
    return _flat_typed(history, "query", fields).unionByName(_flat_payload(records, "query", fields))


def flat_query_input(records: DataFrame) -> DataFrame:
    """Messages of the queries, under their query (`parent_pos`)."""
    return _flat_payload(records, "query.input", ("role", "content"))


def flat_conversations(records: DataFrame) -> DataFrame:
    return _flat_payload(records, "conversations", ("conversation_id", "conversation_type", "opening_prompt", "conversation_turns"))


def flat_turns(records: DataFrame) -> DataFrame:
    """Turns under their conversation (`parent_pos`), both layouts: role and content, or user and assistant answers."""
    return _flat_payload(records, "conversations.conversation_history", ("turn", "role", "content", "score", "if_chosen", "model_name", "user", "chosen", "assistant.preferred", "assistant.rejected"), numeric=True)


def _flat_payload(records: DataFrame, path: str, fields: tuple[str, ...], numeric: bool = False) -> DataFrame:
    picked = [f"try_variant_get(node, '$.{f}', '{NUMERIC.get(f, 'string') if numeric else 'string'}') as `{f.replace('.', '_')}`" for f in fields]
    return payload_rows(records, path).selectExpr("record_id", "user_id", "parent_pos", "pos", *picked)


def _flat_typed(history: DataFrame, column: str, fields: tuple[str, ...]) -> DataFrame:
    picked = ", ".join(f"'{f}', x.`{f}`" for f in fields)
    rows = f"filter(transform(`{column}`, (x, i) -> named_struct('parent_pos', cast(-1 as bigint), 'pos', cast(i as bigint), {picked}, 'there', x is not null)), r -> r.there)"
    return history.selectExpr("record_id", "user_id", f"inline({rows})").drop("there")
