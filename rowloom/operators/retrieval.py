"""Retrieval of a user's own history for a query: BM25 with several k in one scoring pass."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

K1, B, FLOOR = 1.5, 0.75, 0.25


def bm25_hits(corpus: DataFrame, queries: DataFrame) -> DataFrame:
    """Score of every document that shares a word with a query of its group (`grp`, `qid`, `pos`, `score`).

    corpus: `grp`, `pos`, `text`; queries: `grp`, `qid`, `text`. Words are parted at blanks and compared as they are; a word
    repeated in a query counts each time. The weight of a word that is in more than half of the documents is FLOOR times
    the mean weight over the group's words, if it would be negative. Other documents score 0 and give no row.
    """
    docs = corpus.select("grp", "pos", F.split(F.coalesce("text", F.lit("")), " ").alias("words")).withColumn("dl", F.size("words"))
    stats = docs.groupBy("grp").agg(F.count(F.lit(1)).alias("n_docs"), F.avg("dl").alias("avg_dl"))
    tf = docs.select("grp", "pos", "dl", F.explode("words").alias("w")).groupBy("grp", "pos", "dl", "w").agg(F.count(F.lit(1)).alias("tf"))
    df_ = tf.groupBy("grp", "w").agg(F.count(F.lit(1)).alias("df")).join(stats, "grp")
    raw = df_.withColumn("raw", F.log(F.col("n_docs") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = raw.groupBy("grp").agg(F.avg("raw").alias("mean_idf"))
    idf = raw.join(mean, "grp").select("grp", "w", "avg_dl", F.when(F.col("raw") < 0, FLOOR * F.col("mean_idf")).otherwise(F.col("raw")).alias("idf"))
    terms = queries.select("grp", "qid", F.explode(F.split(F.coalesce("text", F.lit("")), " ")).alias("w")).groupBy("grp", "qid", "w").agg(F.count(F.lit(1)).alias("qf"))
    part = F.col("qf") * F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avg_dl")))
    return terms.join(idf, ["grp", "w"]).join(tf, ["grp", "w"]).groupBy("grp", "qid", "pos").agg(F.sum(part).alias("score"))


def bm25_top(corpus: DataFrame, queries: DataFrame, ks: tuple[int, ...] = (1, 2, 4)) -> DataFrame:
    """The best documents of each query for every k at once, for corpora stored apart (`grp`, `qid`, `top_k1`, …: positions in order).

    Equal scores (to nine decimals) rank the later document first. A group with fewer than k documents gives all. Only
    documents that share a word are scored; the places left are filled from the group's positions.
    """
    most = max(ks)
    places = corpus.groupBy("grp").agg(F.sort_array(F.collect_list("pos"), asc=False).alias("places"))  # one number per document
    hits = bm25_hits(corpus, queries).groupBy("grp", "qid").agg(F.collect_list(F.struct(F.round("score", 9).alias("s"), "pos")).alias("hits"))
    rows = queries.select("grp", "qid").distinct().join(places, "grp").join(hits, ["grp", "qid"], "left").withColumn("hits", F.coalesce("hits", F.array().cast("array<struct<s:double,pos:bigint>>")))
    taken = F.transform("hits", lambda h: h["pos"])
    rest = F.slice(F.array_except("places", taken), 1, most)  # as many as could be wanted
    every = F.concat(F.col("hits"), F.transform(rest, lambda p: F.struct(F.lit(0.0).alias("s"), p.alias("pos"))))
    best = rows.select("grp", "qid", F.sort_array(every, asc=False).alias("best"))
    return best.select("grp", "qid", *[F.array_join(F.transform(F.slice("best", 1, k), lambda x: x["pos"].cast("string")), ",").alias(f"top_k{k}") for k in ks])


def _score_row(docs: list[str | None], queries: list[str | None]) -> list[list[int]]:
    """Documents of one row in rank order for each of its queries."""
    words = [(d or "").split(" ") for d in docs]
    lengths = np.array([len(w) for w in words], dtype=float)
    counts = [Counter(w) for w in words]
    df = Counter(w for c in counts for w in c)
    raw = {w: math.log(len(docs) - n + 0.5) - math.log(n + 0.5) for w, n in df.items()}
    floor = FLOOR * sum(raw.values()) / max(1, len(raw))
    places: dict[str, list[tuple[int, int]]] = {}
    for i, c in enumerate(counts):
        for w, n in c.items():
            places.setdefault(w, []).append((i, n))
    scale = K1 * (1 - B + B * lengths / lengths.mean())
    out = []
    for q in queries:
        score = np.zeros(len(docs))
        for w, n in Counter((q or "").split(" ")).items():
            if w in places:
                weight = n * (floor if raw[w] < 0 else raw[w]) * (K1 + 1)
                for i, tf in places[w]:
                    score[i] += weight * tf / (tf + scale[i])
        out.append(sorted(range(len(docs)), key=lambda i: (-round(score[i], 9), -i)))
    return out


def bm25_in_row(df: DataFrame, group: str, docs: str, queries: str, ks: tuple[int, ...] = (1, 2, 4)) -> DataFrame:
    """The same where a row holds its whole corpus (`docs`: array of texts, null elements are no documents) and its queries (array of texts).

    Rows stay where they are: nothing is shuffled. `qid` and the positions are places in the arrays; null queries are left
    out, rows without documents give no row.
    """
    most = max(ks)
    kind = df.schema[group].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for g, d, q in zip(batch["grp"], batch["docs"], batch["queries"]):
                at = [i for i, x in enumerate(d) if x is not None]
                asked = [i for i, x in enumerate(q) if x is not None]
                if at and asked:
                    ranked = _score_row([d[i] for i in at], [q[i] for i in asked])
                    rows += [(g, i, [at[p] for p in best[:most]]) for i, best in zip(asked, ranked)]
            yield pd.DataFrame(rows, columns=["grp", "qid", "best"])

    held = df.where(f"size(`{docs}`) > 0 and size(`{queries}`) > 0").select(F.col(group).alias("grp"), F.col(docs).alias("docs"), F.col(queries).alias("queries"))
    best = held.mapInPandas(run, f"grp {kind}, qid long, best array<long>")
    return best.select("grp", "qid", *[F.array_join(F.transform(F.slice("best", 1, k), lambda x: x.cast("string")), ",").alias(f"top_k{k}") for k in ks])
