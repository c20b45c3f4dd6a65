"""Queries of the operators for training data."""

from __future__ import annotations

from pyspark.sql import functions as F

from rowloom.llm import leaks, overlap, pairs, privacy, sentences, splits, tokens
from rowloom.sources.tables import read_table


def _items(spark, d):
    return read_table(spark, d, "dataset_item")


def _docs(spark, d):
    return read_table(spark, d, "documents")


def p8_found(spark, d):
    return leaks.leaked_items(_docs(spark, d), read_table(spark, d, "eval_item"))


def _texts(spark, d):
    return privacy.personal_fields(_items(spark, d), read_table(spark, d, "text_generation_sample"))


def p1_splits(spark, d):
    """Every record with its group and split."""
    return splits.assign_splits(_items(spark, d)).select(F.col("record").alias("sample_idx"), "grp", "split")


def p1_report(spark, d):
    """Records per split and source with their share of the source."""
    items = _items(spark, d)
    return splits.split_report(items, splits.assign_splits(items))


def p1_check(spark, d):
    """What an assignment must hold: groups in two splits (none), records without a split (none), and shares within a hundredth of
    those wanted, which groups of up to a tenth of the records allow."""
    got = splits.assign_splits(_items(spark, d))
    groups = got.groupBy("grp").agg(F.countDistinct("split").alias("n_splits"), F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("split").isNull(), 1)).alias("free"), *[F.count(F.when(F.col("split") == x, 1)).alias(x) for x in splits.SPLITS])
    total = groups.agg(F.sum("n").alias("n_records"), F.count(F.when(F.col("n_splits") > 1, 1)).alias("torn_groups"), F.sum("free").alias("unassigned"), *[F.sum(x).alias(x) for x in splits.SPLITS])
    gap = F.greatest(*[F.abs(F.col(x) - p * F.col("n_records")) for x, p in zip(splits.SPLITS, splits.PROPORTIONS)])
    return total.select("n_records", "torn_groups", "unassigned", (gap <= 0.01 * F.col("n_records")).alias("shares_close"))


QUERIES = {
    "p1_check": p1_check,
    "p1_found": lambda s, d: splits.multi_user_groups(splits.assign_splits(_items(s, d))),
    "p1_splits": p1_splits,
    "p1_report": p1_report,
    "p2_found": lambda s, d: privacy.find_personal(_texts(s, d)),
    "p2_redacted": lambda s, d: privacy.redact(_texts(s, d)),
    "p3_found": lambda s, d: pairs.broken_pairs(_items(s, d)),
    "p3_report": lambda s, d: pairs.defect_report(_items(s, d), pairs.broken_pairs(_items(s, d))),
    "p4_found": lambda s, d: overlap.overlapping_pairs(_items(s, d)).select("sample_a", "sample_b").distinct(),
    "p4_report": lambda s, d: overlap.overlap_report(_items(s, d)),
    "p7_ids": lambda s, d: tokens.encode_corpus(_docs(s, d)),
    "p7_token_counts": lambda s, d: tokens.token_counts(_docs(s, d)),
    "p8_found": p8_found,
    "p8_report": lambda s, d: leaks.leak_report(_docs(s, d), read_table(s, d, "eval_item"), p8_found(s, d)),
    "p9_found": lambda s, d: sentences.split_sentences(_docs(s, d)),
}

_BLANKS = "' ' || chr(9) || chr(10) || chr(13)"
_ID = "nullif(lower(trim({0}, " + _BLANKS + ")), '')"

ORACLE = {
    "p1_check": "SELECT count(*) AS n_records, CAST(0 AS BIGINT) AS torn_groups, CAST(0 AS BIGINT) AS unassigned, true AS shares_close FROM dataset_item",
    "p1_found": f"""
        WITH RECURSIVE r AS (SELECT sample_idx, {_ID.format('user_id')} AS u, {_ID.format('question_id')} AS q FROM dataset_item),
        star AS (SELECT q, min(u) AS m FROM r WHERE q IS NOT NULL AND u IS NOT NULL GROUP BY q HAVING min(u) < max(u)),
        link AS (SELECT DISTINCT r.u AS a, star.m AS b FROM r JOIN star USING (q) WHERE r.u <> star.m),
        both_ways AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
        reach AS (SELECT a AS node, a AS seen FROM both_ways UNION SELECT reach.node, both_ways.b FROM reach JOIN both_ways ON reach.seen = both_ways.a),
        root AS (SELECT node, min(seen) AS root FROM reach GROUP BY node),
        by_q AS (SELECT q, min(u) AS m FROM r WHERE q IS NOT NULL AND u IS NOT NULL GROUP BY q),
        tied AS (SELECT sample_idx, root FROM r LEFT JOIN by_q USING (q) JOIN root ON root.node = coalesce(r.u, by_q.m))
        SELECT sample_idx, min(sample_idx) OVER (PARTITION BY root) AS group_first FROM tied""",
}
