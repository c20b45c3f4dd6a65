"""Queries on joins, sampling, vectors and conversations, their oracle SQL beside them."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from rowloom.functions import vectors as v
from rowloom.operators import conversations as c
from rowloom.operators import history as h
from rowloom.operators import nested, sampling, skew, vector_search
from rowloom.plans.curation import _CONV
from rowloom.sources.tables import read_table


def _items(s, d):
    return read_table(s, d, "dataset_item")


def _users(s, d):
    return sampling.user_counts(_items(s, d).select(F.lower(F.trim("user_id")).alias("user_id"))).where("user_id is not null")


def dedupe_train(s, d):
    items = _items(s, d).select("sample_idx", F.lower(F.trim("user_id")).alias("user_id"), "split")
    return sampling.drop_held_out(items.where("split = 'train'"), items.where("split = 'random_test'"), items.where("split = 'ood_test'")).select("sample_idx", "user_id")


def profile_join(s, d):
    """Evaluation samples with the longest profile known of their user; the empty text where none is known."""
    known = _items(s, d).where("profile_text is not null and user_id is not null").groupBy(F.lower(F.trim("user_id")).alias("u")).agg(F.max(F.struct(F.length("profile_text").alias("n"), F.col("profile_text").alias("p"))).alias("best"))
    rows = read_table(s, d, "text_generation_sample").select("sample_id", F.lower(F.trim("user_id")).alias("u"))
    return skew.join_lookup(rows, known, "u", how="left").select("sample_id", F.coalesce(F.length("best.p"), F.lit(0)).cast("long").alias("profile_chars"))


def users_with_history(s, d):
    """Records of users that also deliver a history (semi-join)."""
    have = read_table(s, d, "raw_user_history").where("size(history) > 0").select(F.lower(F.trim("user_id")).alias("u"))
    items = _items(s, d).select("sample_idx", F.lower(F.trim("user_id")).alias("u"))
    return skew.join_lookup(items, have.where("u is not null").distinct(), "u", how="left_semi").select("sample_idx")


def completed(s, d):
    """Requests still to send: those without an answer (anti-join on the request id)."""
    wanted = _items(s, d).where("split <> 'train' and question_id is not null").select(F.lower(F.trim("question_id")).alias("custom_id")).distinct()
    done = read_table(s, d, "text_generation_sample").where("question_id is not null").select(F.lower(F.trim("question_id")).alias("custom_id"))
    return wanted.join(done, "custom_id", "left_anti")


def latest_profile(s, d):
    """The answer with the highest number behind its id's last underscore, per id before it."""
    rows = _items(s, d).where(r"question_id rlike '^.*_[0-9]+$' and question_id = trim(question_id)").select(F.lower("question_id").alias("q"), "sample_idx", F.length("output").alias("n"))
    base, number = F.regexp_extract("q", "^(.*)_([^_]*)$", 1), F.regexp_extract("q", "^(.*)_([^_]*)$", 2).cast("long")
    return rows.groupBy(base.alias("base")).agg(F.max(F.struct(number.alias("k"), (-F.col("sample_idx")).alias("s"))).alias("last")).select("base", F.col("last.k").alias("last_number"), (-F.col("last.s")).alias("sample_idx"))


def bins(s, d):
    users = _users(s, d)
    binned = sampling.quantile_bins(users, "n", 10)
    return binned.groupBy("bin").agg(F.count(F.lit(1)).alias("n_users"), F.min("n").alias("least"), F.max("n").alias("most")).select(F.col("bin").cast("long").alias("bin"), "n_users", "least", "most")


def allocation(s, d):
    sizes = _users(s, d).groupBy(F.least("n", F.lit(30)).alias("bucket")).agg(F.count(F.lit(1)).alias("cap"))
    return sampling.largest_remainder(sizes, 100)


def stratified(s, d):
    users = _users(s, d).withColumn("bucket", F.least("n", F.lit(30)))
    takes = sampling.largest_remainder(users.groupBy("bucket").agg(F.count(F.lit(1)).alias("cap")), 100)
    return sampling.pick_by_bucket(users, takes, "user_id").select("user_id", "bucket")


def weights(s, d):
    sizes = _items(s, d).groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    return sampling.sampling_weights(sizes).select("source", "n", F.round("weight", 9).alias("weight"))


def downsample(s, d):
    rows = _items(s, d).where("split = 'train'").select("sample_idx", F.col("source").alias("bucket"))
    keep = sampling.proportional_sizes(rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("cap")), 0.1).select("bucket", F.col("keep").alias("take"))
    return sampling.pick_by_bucket(rows, keep, "sample_idx").select("sample_idx", F.col("bucket").alias("source"))


def cluster_filter(s, d):
    """The five largest clusters kept, then repeated up to the former number of rows."""
    rows = read_table(s, d, "embeddings").select("vec_id", "label")
    sizes = rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).withColumn("r", F.row_number().over(Window.orderBy(F.desc("n"), "label"))).where("r <= 5")
    kept = rows.join(F.broadcast(sizes.select("label")), "label", "left_semi")  # five rows
    return sampling.oversample(kept, rows.count(), "vec_id").select("vec_id", "label", F.col("copy").cast("long").alias("copy"))


def normalized(s, d):
    rows = read_table(s, d, "embeddings")
    return rows.select("vec_id", F.round(v.norm(F.col("embedding")), 5).alias("norm"), F.round(v.unit(F.col("embedding"))[0], 5).alias("u0"), F.round(v.scaled_unit(F.col("embedding"))[1], 5).alias("s1"))


def cosine_top(s, d):
    """For each query vector (id divisible by 50) the five nearest others by cosine, against all vectors."""
    rows = read_table(s, d, "embeddings")
    return vector_search.nearest_by_cosine(rows.where("vec_id % 50 = 0"), rows, 5)


def similarity_stats(s, d):
    """Mean cosine between each pair of clusters, by the closed form: the dot product of their mean unit vectors."""
    rows = read_table(s, d, "embeddings").select("label", F.posexplode(v.unit(F.col("embedding"))).alias("i", "x"))
    mean = rows.groupBy("label", "i").agg(F.avg("x").alias("m"))
    a, b = mean.select(F.col("label").alias("a"), "i", F.col("m").alias("ma")), mean.select(F.col("label").alias("b"), "i", F.col("m").alias("mb"))
    return a.join(b, "i").where("a < b").groupBy("a", "b").agg(F.round(F.sum(F.col("ma") * F.col("mb")), 6).alias("mean_cos"))


def mean_std(s, d):
    rows = read_table(s, d, "embeddings").select("label", F.posexplode("embedding").alias("i", "x"))
    return rows.groupBy("label", F.col("i").cast("long").alias("i")).agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("mean"), F.round(F.stddev_samp(F.col("x").cast("double")), 6).alias("std"))


def outliers(s, d):
    return sampling.cluster_outliers(read_table(s, d, "embeddings"), 3).select("vec_id", "label", "rank", F.round("dist", 5).alias("dist"))


def dialogue(s, d):
    turns = nested.flat_turns(read_table(s, d, "raw_record")).where("role is not null")
    return c.prompt_sections(turns.withColumnRenamed("parent_pos", "conversation"), "record_id", "conversation")


QUERIES = {
    "q_dedupe_train_anti": dedupe_train,
    "q_profile_left_join": profile_join,
    "q_users_with_history_semi": users_with_history,
    "q_completed_antijoin": completed,
    "q_latest_profile_per_user": latest_profile,
    "q_quantile_bins_log1p": bins,
    "q_stratified_allocation": allocation,
    "q_stratified_sample_bins": stratified,
    "q_sampling_weights": weights,
    "q_downsample_proportional": downsample,
    "q_cluster_filter_oversample": cluster_filter,
    "q_l2_normalize": normalized,
    "q_cosine_topk": cosine_top,
    "q_similarity_stats": similarity_stats,
    "q_mean_std_vectors": mean_std,
    "q_centroid_outliers": outliers,
    "q_kmeans_ood_split": lambda s, d: sampling.kmeans_ood_split(read_table(s, d, "embeddings"), 60),
    "q_maximin_select": lambda s, d: sampling.farthest_first(read_table(s, d, "embeddings"), 8),
    "q_conversation_prefix": lambda s, d: c.turn_rows(read_table(s, d, "raw_record")),
    "q_chosen_turn_filter": lambda s, d: c.chosen_turns(read_table(s, d, "raw_record"), 50.0, "gpt"),
    "q_dialogue_render": dialogue,
    "q_query_user_lengths": lambda s, d: h.explode_queries(read_table(s, d, "raw_user_history")).groupBy("record_id").agg(F.count(F.lit(1)).alias("n_queries"), F.count("gold").alias("n_gold")),
}

_U = "lower(trim(user_id))"
_USERS = f"users AS (SELECT {_U} AS user_id, count(*) AS n FROM dataset_item WHERE user_id IS NOT NULL GROUP BY 1)"
_TAKE = """
    ex AS (SELECT bucket, cap, 100.0::DOUBLE * cap / sum(cap) OVER () AS e FROM sizes),
    ba AS (SELECT *, least(floor(e), cap) AS b, cap - least(floor(e), cap) AS spare, round(e - floor(e), 9) AS rest FROM ex),
    oo AS (SELECT *, 100 - sum(b) OVER () AS lft, coalesce(sum(spare) OVER (ORDER BY rest DESC, bucket ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM ba),
    takes AS (SELECT bucket, cap, CAST(b + greatest(0, least(spare, lft - before)) AS BIGINT) AS take FROM oo)"""
_UNIT = "unit AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE) / sqrt(list_sum(list_transform(embedding, lambda y: CAST(y AS DOUBLE) * y)))) AS u FROM embeddings)"

ORACLE = {
    "q_dedupe_train_anti": f"SELECT sample_idx, {_U} AS user_id FROM dataset_item t WHERE split = 'train' AND NOT EXISTS (SELECT 1 FROM dataset_item e WHERE e.split <> 'train' AND lower(trim(e.user_id)) = lower(trim(t.user_id)))",
    "q_profile_left_join": f"""
        WITH k AS (SELECT {_U} AS u, max(length(profile_text)) AS n FROM dataset_item WHERE profile_text IS NOT NULL AND user_id IS NOT NULL GROUP BY 1)
        SELECT sample_id, CAST(coalesce(n, 0) AS BIGINT) AS profile_chars FROM text_generation_sample t LEFT JOIN k ON k.u = lower(trim(t.user_id))""",
    "q_users_with_history_semi": f"SELECT sample_idx FROM dataset_item WHERE {_U} IN (SELECT lower(trim(user_id)) FROM raw_user_history WHERE len(history) > 0 AND user_id IS NOT NULL)",
    "q_completed_antijoin": "SELECT DISTINCT lower(trim(question_id)) AS custom_id FROM dataset_item WHERE split <> 'train' AND question_id IS NOT NULL EXCEPT SELECT lower(trim(question_id)) FROM text_generation_sample WHERE question_id IS NOT NULL",
    "q_latest_profile_per_user": """
        WITH r AS (SELECT lower(question_id) AS q, sample_idx FROM dataset_item WHERE regexp_matches(question_id, '^.*_[0-9]+$') AND question_id = trim(question_id)),
        p AS (SELECT regexp_extract(q, '^(.*)_([^_]*)$', 1) AS base, CAST(regexp_extract(q, '^(.*)_([^_]*)$', 2) AS BIGINT) AS k, sample_idx FROM r)
        SELECT base, k AS last_number, sample_idx FROM p QUALIFY row_number() OVER (PARTITION BY base ORDER BY k DESC, sample_idx) = 1""",
    "q_quantile_bins_log1p": f"""
        WITH RECURSIVE {_USERS}, e AS (SELECT quantile_cont(ln(1 + n), [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]) AS e FROM users),
        g AS (SELECT 1 AS i, e[1] AS x, e FROM e UNION ALL SELECT i + 1, greatest(e[i + 1], x + 1e-6), e FROM g WHERE i < 11),
        b AS (SELECT n, (SELECT count(*) FROM g WHERE i BETWEEN 2 AND 10 AND x < ln(1 + n)) AS bin FROM users)
        SELECT bin, count(*) AS n_users, min(n) AS least, max(n) AS most FROM b GROUP BY bin""",
    "q_stratified_allocation": f"WITH {_USERS}, sizes AS (SELECT least(n, 30) AS bucket, count(*) AS cap FROM users GROUP BY 1), {_TAKE} SELECT bucket, cap, take FROM takes",
    "q_stratified_sample_bins": f"""
        WITH {_USERS}, bk AS (SELECT user_id, least(n, 30) AS bucket FROM users), sizes AS (SELECT bucket, count(*) AS cap FROM bk GROUP BY 1), {_TAKE},
        r AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY md5(concat_ws('|', user_id, '42')), user_id) AS k FROM bk)
        SELECT user_id, bucket FROM r JOIN takes USING (bucket) WHERE k <= take""",
    "q_sampling_weights": "WITH s AS (SELECT source, count(*) AS n FROM dataset_item GROUP BY 1), w AS (SELECT *, greatest(sqrt(n), 0.1 * max(sqrt(n)) OVER ()) AS w FROM s) SELECT source, n, round(w / sum(w) OVER (), 9) AS weight FROM w",
    "q_downsample_proportional": """
        WITH r AS (SELECT sample_idx, source, row_number() OVER (PARTITION BY source ORDER BY md5(concat_ws('|', CAST(sample_idx AS VARCHAR), '42')), sample_idx) AS k, count(*) OVER (PARTITION BY source) AS cap FROM dataset_item WHERE split = 'train')
        SELECT sample_idx, source FROM r WHERE k <= greatest(1, round_even(CAST(0.1 AS DOUBLE) * cap, 0))""",
    "q_cluster_filter_oversample": """
        WITH s AS (SELECT label, count(*) AS n FROM embeddings GROUP BY 1), top AS (SELECT label FROM s ORDER BY n DESC, label LIMIT 5),
        k AS (SELECT vec_id, label, row_number() OVER (ORDER BY md5(concat_ws('|', CAST(vec_id AS VARCHAR), '42')), vec_id) - 1 AS r, count(*) OVER () AS n, (SELECT count(*) FROM embeddings) AS want FROM embeddings WHERE label IN (SELECT label FROM top))
        SELECT vec_id, label, unnest(range(0, CAST(greatest(floor((want - 1 - r) / CAST(n AS DOUBLE)), 0) AS BIGINT) + 1)) AS copy FROM k""",
    "q_l2_normalize": f"WITH {_UNIT} SELECT e.vec_id, round(sqrt(list_sum(list_transform(embedding, lambda y: CAST(y AS DOUBLE) * y))), 5) AS norm, round(u[1], 5) AS u0, round(u[2] * sqrt(len(u)), 5) AS s1 FROM embeddings e JOIN unit USING (vec_id)",
    "q_cosine_topk": f"""
        WITH {_UNIT}, n AS (SELECT a.vec_id AS q, b.vec_id, round(list_sum(list_transform(list_zip(a.u, b.u), lambda z: z[1] * z[2])), 6) AS cos FROM unit a JOIN unit b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0)
        SELECT q, vec_id, cos, row_number() OVER (PARTITION BY q ORDER BY cos DESC, vec_id) AS rank FROM n QUALIFY rank <= 5""",
    "q_similarity_stats": f"""
        WITH {_UNIT}, m AS (SELECT label, i, avg(u[i]) AS m FROM (SELECT label, u, unnest(range(1, len(u) + 1)) AS i FROM unit) GROUP BY ALL)
        SELECT x.label AS a, y.label AS b, round(sum(x.m * y.m), 6) AS mean_cos FROM m x JOIN m y ON x.i = y.i AND x.label < y.label GROUP BY ALL""",
    "q_mean_std_vectors": "SELECT label, i, round(avg(CAST(x AS DOUBLE)), 6) AS mean, round(stddev_samp(CAST(x AS DOUBLE)), 6) AS std FROM (SELECT label, unnest(range(0, len(embedding))) AS i, unnest(embedding) AS x FROM embeddings) GROUP BY ALL",
    "q_centroid_outliers": """
        WITH x AS (SELECT vec_id, label, unnest(range(0, len(embedding))) AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings), m AS (SELECT label, i, avg(x) AS m FROM x GROUP BY ALL),
        dd AS (SELECT vec_id, label, sqrt(sum((x - m) * (x - m))) AS d FROM x JOIN m USING (label, i) GROUP BY ALL)
        SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY round(d, 9) DESC, vec_id) AS rank, round(d, 5) AS dist FROM dd QUALIFY rank <= 3""",
    "q_query_user_lengths": """
        WITH q AS (SELECT record_id, query[i] AS q FROM (SELECT *, unnest(range(1, len(query) + 1)) AS i FROM raw_user_history) WHERE query[i] IS NOT NULL), b AS (SELECT record_id, coalesce(nullif(trim(q.gold, ' ' || chr(9) || chr(10) || chr(13)), ''), nullif(trim(q.output, ' ' || chr(9) || chr(10) || chr(13)), '')) AS g FROM q)
        SELECT record_id, count(*) AS n_queries, count(g) AS n_gold FROM b GROUP BY 1""",
}

_NB = "nullif(trim({0}, ' ' || chr(9) || chr(10) || chr(13)), '')"
ORACLE |= {
    "q_chosen_turn_filter": f"""
        WITH {_CONV} SELECT record_id, conversation, pos, try_cast(e ->> '$.score' AS DOUBLE) AS score, lower(e ->> '$.model_name') AS model_name FROM tu
        WHERE e ->> '$.role' = 'model' AND e ->> '$.if_chosen' = 'true' AND coalesce(try_cast(e ->> '$.score' AS DOUBLE) >= 50, true) AND contains(lower(coalesce(e ->> '$.model_name', '')), 'gpt')""",
    "q_dialogue_render": f"""
        WITH {_CONV}, l AS (SELECT record_id, conversation, pos, e ->> '$.role' AS role, {_NB.format("(e ->> '$.content')")} AS c FROM tu)
        SELECT record_id, conversation, string_agg(role || ': ' || c, chr(10) || chr(10) ORDER BY pos) AS dialogue FROM l WHERE role IS NOT NULL AND c IS NOT NULL GROUP BY ALL""",
    "q_conversation_prefix": f"""
        WITH {_CONV}, w AS (SELECT record_id, conversation, pos, {_NB.format("(e ->> '$.user')")} AS said, {_NB.format("(e ->> '$.assistant.preferred')")} AS pr, {_NB.format("(e ->> '$.assistant.rejected')")} AS re, e ->> '$.chosen' AS chosen FROM tu
            WHERE e ->> '$.user' IS NOT NULL OR e ->> '$.assistant.preferred' IS NOT NULL),
        l AS (SELECT record_id, conversation, pos, 0 AS k, 'User: ' || said AS line FROM w UNION ALL
            SELECT record_id, conversation, pos, 1, 'Assistant: ' || coalesce(CASE WHEN chosen = 'rejected' THEN re WHEN chosen = 'preferred' THEN pr END, pr, re) FROM w)
        SELECT w.record_id, w.conversation, w.pos, count(l.line) AS n_before, coalesce(string_agg(l.line, chr(10) ORDER BY l.pos, l.k) || chr(10), '') || 'User: ' || any_value(w.said) AS input, any_value(w.pr) AS output
        FROM w LEFT JOIN l ON l.record_id = w.record_id AND l.conversation = w.conversation AND l.pos < w.pos AND l.line IS NOT NULL WHERE w.said IS NOT NULL AND w.pr IS NOT NULL GROUP BY w.record_id, w.conversation, w.pos""",
}
