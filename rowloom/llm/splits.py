"""Train, validation and test splits that keep tied records together."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowloom.operators.skew import clean_id, join_lookup
from rowloom.session import durable

SPLITS = ("train", "validation", "test")
PROPORTIONS = (0.8, 0.1, 0.1)
#: The most frequent labels are balanced each by itself, all others in as many pools by their hash.
MAX_LABELS = 64
#: Share of the edges that makes a node a hub, and edges from which hubs are looked for.
HUB, FEW_EDGES = 0.01, 100_000
#: A component holding more than this share of the records is placed before all others; at most 1/HEAVY of them exist.
HEAVY = 0.0005
#: Components a task anneals at once.
PART = 20_000


def connected_components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """Nodes of an undirected graph (`a`, `b`: strings) with the smallest node of their component (`node`, `root`).

    Alternating large-star and small-star steps. A hub's links are never gathered: each step takes the minimum per node
    (combined before the shuffle) and joins it back. Every round is written to the checkpoint folder. Null ends and loops
    tie nothing; an empty graph gives no row.
    """
    edges = links.where("a is not null and b is not null and a <> b").selectExpr("greatest(a, b) as u", "least(a, b) as v").distinct()
    edges = durable(edges)
    before = None
    for _ in range(rounds):
        # large star: neighbours greater than u are linked to the smallest in u's neighbourhood
        both = edges.unionByName(edges.selectExpr("v as u", "u as v"))
        large = _with_smallest(both, "least(u, m)").where("v > u").selectExpr("v as u", "m as v").where("u <> v").distinct()
        # small star: neighbours not greater than u, and u itself, are linked to the smallest of them
        near = _with_smallest(durable(large), "m")
        edges = durable(near.selectExpr("if(v = m, u, v) as u", "m as v").distinct())
        # a star forest does not change any more
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    return edges.selectExpr("u as node", "v as root").unionByName(edges.selectExpr("v as node", "v as root").distinct())


def _with_smallest(edges: DataFrame, smallest: str) -> DataFrame:
    """Edges (`u`, `v`) with an expression of u and its smallest neighbour (`m`); hubs are joined where their edges lie.

    The minimum per node is combined before the shuffle; hubs are the at most 1/HUB nodes with that share of the edges.
    """
    low = durable(edges.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")))
    total = low.agg(F.sum("n")).first()[0] or 0
    hubs = low.where(F.col("n") >= F.lit(HUB * total))
    low = low.select("u", F.expr(smallest).alias("m"))
    # small graphs are not worth the second path
    if total < FEW_EDGES or hubs.isEmpty():
        return edges.join(low, "u")
    return join_lookup(edges, low, "u", hot=hubs.select(F.col("u").alias("key")))


def tie_records(df: DataFrame, record: str = "sample_idx", user: str = "user_id", question: str = "question_id") -> DataFrame:
    """Every record with the group it is tied to (`record`, `grp`, `multi_user`).

    Records sharing a user or a question, directly or through others, have the same `grp`. Ids are compared without case
    and outer blanks; null and blank ids tie nothing, a record with neither is its own group. `multi_user` says whether
    the group holds at least two users. Repeated rows stay. An empty table gives no row; other columns are ignored.
    """
    rows = durable(df.select(F.col(record).alias("record"), clean_id(F.col(user)).alias("u"), clean_id(F.col(question)).alias("q")))
    ends = rows.where("u is not null and q is not null").groupBy("q").agg(F.min("u").alias("m"), F.max("u").alias("x"))
    ends = durable(ends)
    # the users of a question form a star around its first one: as many links as users, never all pairs
    shared = ends.where("m <> x").select("q", "m")
    links = join_lookup(rows.where("u is not null and q is not null").select("u", "q"), shared, "q").where("u <> m").selectExpr("u as a", "m as b").distinct()
    roots = durable(connected_components(links))
    with_user = rows.where("u is not null").select("record", "u")
    tied = join_lookup(with_user, roots.withColumnRenamed("node", "u"), "u").select("record", F.concat(F.lit("u:"), "root").alias("grp"), F.lit(True).alias("multi_user"))
    free = join_lookup(with_user, roots.withColumnRenamed("node", "u"), "u", how="left_anti").select("record", F.concat(F.lit("u:"), "u").alias("grp"), F.lit(False).alias("multi_user"))
    # without a user, the question decides: its users' group, or one of its own
    by_question = (
        join_lookup(ends.withColumnRenamed("m", "node"), roots, "node", how="left").withColumnRenamed("node", "m")
        .select("q", F.concat(F.lit("u:"), F.coalesce("root", "m")).alias("grp"), F.col("root").isNotNull().alias("multi_user"))
    )
    no_user = rows.where("u is null and q is not null").select("record", "q")
    via = join_lookup(no_user, by_question, "q").select("record", "grp", "multi_user")
    only_q = join_lookup(no_user, by_question, "q", how="left_anti").select("record", F.concat(F.lit("q:"), "q").alias("grp"), F.lit(False).alias("multi_user"))
    alone = rows.where("u is null and q is null").select("record", F.concat(F.lit("r:"), F.col("record").cast("string")).alias("grp"), F.lit(False).alias("multi_user"))
    return tied.unionByName(free).unionByName(via).unionByName(only_q).unionByName(alone)


def multi_user_groups(assigned: DataFrame) -> DataFrame:
    """Records of an assignment whose group holds at least two users, with the group's smallest record (`sample_idx`, `group_first`)."""
    tied = durable(assigned.where("multi_user").select("record", "grp"))
    first = tied.groupBy("grp").agg(F.min("record").alias("group_first"))
    return join_lookup(tied, first, "grp").select(F.col("record").alias("sample_idx"), "group_first")


def _cost(size: np.ndarray, label: np.ndarray, want_size: np.ndarray, want_label: np.ndarray) -> float:
    return float(((size - want_size) ** 2).sum() + ((label - want_label) ** 2).sum())


def anneal(n: np.ndarray, labels: np.ndarray, start: np.ndarray, want_size: np.ndarray, want_label: np.ndarray, seed: int, steps: int) -> tuple[np.ndarray, float]:
    """One chain of the component swap search: moves and exchanges of whole components, the best assignment seen.

    The cost is the squared deviation of records per split plus that of records per split and label.
    """
    rng = np.random.default_rng(seed)
    k, m = len(want_size), len(n)
    at = start.copy()
    size = np.bincount(at, weights=n, minlength=k).astype(float)
    label = np.zeros((k, labels.shape[1]))
    np.add.at(label, at, labels)
    cost = _cost(size, label, want_size, want_label)
    best, best_cost = at.copy(), cost
    heat = max(float(np.mean(n.astype(float) ** 2)), 1.0)
    picks, others = rng.integers(0, m, (steps, 2)), rng.integers(1, k, steps)
    swaps, luck = rng.random(steps) < 0.5, np.log(np.maximum(rng.random(steps), 1e-300))
    for s in range(steps):
        i, j = picks[s]
        a = at[i]
        if swaps[s]:
            b = at[j]
            if a == b:
                continue
            dn, dl = n[i] - n[j], labels[i] - labels[j]
        else:
            b = (a + others[s]) % k
            dn, dl = n[i], labels[i]
        # a loses dn, b gains it: the change of the squares
        delta = 2 * dn * ((size[b] - want_size[b]) - (size[a] - want_size[a]) + dn)
        delta += 2 * float(dl @ ((label[b] - want_label[b]) - (label[a] - want_label[a]) + dl))
        temperature = heat * (1 - s / steps) ** 2
        if delta <= 0 or (temperature > 0 and -delta / temperature > luck[s]):
            at[i] = b
            if swaps[s]:
                at[j] = a
            size[a] -= dn
            size[b] += dn
            label[a] -= dl
            label[b] += dl
            cost += delta
            if cost < best_cost - 1e-9:
                best, best_cost = at.copy(), cost
    return best, best_cost


def _searcher(wants: dict, chains: int, steps: int, seed: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        return _search(pdf, wants, chains, steps, seed)

    return search


def _search(pdf: pd.DataFrame, wants: dict, chains: int, steps: int, seed: int) -> pd.DataFrame:
    """Anneal one part's components towards its share of what is wanted."""
    pdf = pdf.sort_values("grp", kind="stable").reset_index(drop=True)
    n = pdf["n"].to_numpy(dtype=float)
    labels = np.stack(pdf["counts"].to_numpy()).astype(float)
    part = int(pdf["part"].iloc[0])
    # this part's share: of every label and of the size, in the wanted ratios of what the heavy components left
    ratio_size, ratio_label = np.array(wants["size"]), np.array(wants["label"])
    want_size, want_label = ratio_size * n.sum(), ratio_label * labels.sum(axis=0)
    edges = np.cumsum(ratio_size)[:-1]
    found = []
    for c in range(chains):
        h = (pdf["h"].to_numpy() ^ (c * 0x9E3779B97F4A7C15 & 0x7FFFFFFFFFFFFFFF)) % 1_000_003 / 1_000_003
        start = np.searchsorted(edges, h, side="right")
        found.append(anneal(n, labels, start, want_size, want_label, seed * 1000 + part * 10 + c, min(steps, 200 + 60 * len(n))))
    best = min(found, key=lambda x: x[1])[0]
    return pd.DataFrame({"grp": pdf["grp"], "n": pdf["n"], "counts": pdf["counts"], "slot": best.astype("int32")})


def _ratios(left: np.ndarray, share: np.ndarray) -> np.ndarray:
    """Ratios per split of what is still wanted, never negative; the given proportions where nothing is left."""
    left = np.maximum(left, 0)
    total = left.sum(axis=0)
    return np.where(total > 0, left / np.where(total > 0, total, 1), share)


def assign_splits(df: DataFrame, label: str = "source", proportions: tuple[float, ...] = PROPORTIONS, names: tuple[str, ...] = SPLITS, chains: int = 3, steps: int = 40_000, seed: int = 42, record: str = "sample_idx", user: str = "user_id", question: str = "question_id") -> DataFrame:
    """Every record with its split (`record`, `grp`, `multi_user`, `split`): tied records share one, the proportions are come close to.

    A component swap search: from a hashed assignment, whole components are moved and exchanged by annealing in many
    tasks at once, to reduce the deviation of the splits' sizes and of the label counts in each; every task keeps the best
    of several chains. Components holding more than HEAVY of all records (at most 1/HEAVY of them) are placed first, in one task;
    the others then fill what is left, in parts of about PART components. Driver and closures only hold totals per
    split and label. The result does not depend on partitioning. Null labels count as one label; labels beyond the
    MAX_LABELS most frequent are balanced in MAX_LABELS pools. An empty table gives no row.
    """
    share = np.array(proportions, dtype=float) / sum(proportions)
    tied = durable(tie_records(df, record, user, question).select("record", "grp", "multi_user"))
    lab = df.select(F.col(record).alias("record"), F.coalesce(F.col(label), F.lit("")).alias("label"))
    top = [r["label"] for r in lab.groupBy("label").count().orderBy(F.desc("count"), "label").limit(MAX_LABELS).collect()]
    pools = MAX_LABELS if len(top) == MAX_LABELS else 1
    place = F.coalesce(*[F.when(F.col("label") == v, F.lit(i)) for i, v in enumerate(top)], F.pmod(F.xxhash64("label"), F.lit(pools)).cast("int") + len(top))
    width = len(top) + pools
    # repeated rows share their record id: labels are taken per row, groups per record
    rows = lab.join(tied.select("record", "grp").distinct(), "record").select("record", "grp", place.alias("l"))
    comps = (
        rows.groupBy("grp", "l").agg(F.count(F.lit(1)).alias("c"))
        .groupBy("grp").agg(F.sum("c").alias("n"), F.map_from_entries(F.collect_list(F.struct("l", "c"))).alias("by"))  # at most 2 MAX_LABELS entries
        .select("grp", "n", F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.coalesce(F.element_at("by", i), F.lit(0))).alias("counts"))
    )
    comps = durable(comps.withColumn("h", F.xxhash64("grp").bitwiseAND(F.lit(0x7FFFFFFFFFFFFFFF))))
    sums = comps.agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"), *[F.sum(F.col("counts")[i]).alias(f"l{i}") for i in range(width)]).first()
    schema = T.StructType([*comps.select("grp", "n", "counts").schema.fields, T.StructField("slot", T.IntegerType())])
    total, total_label = float(sums["n"] or 0), np.array([float(sums[f"l{i}"] or 0) for i in range(width)])
    heavy = F.col("n") > F.lit(HEAVY * total)
    wants = {"size": share.tolist(), "label": np.outer(share, np.ones(width)).tolist()}
    first = durable(comps.where(heavy).withColumn("part", F.lit(0)).groupBy("part").applyInPandas(_searcher(wants, 4 * chains, steps, seed), schema))
    placed = {r["slot"]: r for r in first.groupBy("slot").agg(F.sum("n").alias("n"), *[F.sum(F.col("counts")[i]).alias(f"l{i}") for i in range(width)]).collect()}
    taken = np.array([[float(placed[s][f"l{i}"]) if s in placed else 0.0 for i in range(width)] for s in range(len(share))])
    wants = {"size": _ratios(share * total - taken.sum(axis=1), share).tolist(), "label": _ratios(np.outer(share, total_label) - taken, share[:, None]).tolist()}
    parts = max(1, -(-int(sums["k"]) // PART))
    rest = comps.where(~heavy).withColumn("part", F.pmod(F.xxhash64("grp", F.lit(seed)), F.lit(parts)).cast("int") + 1)
    rest = rest.groupBy("part").applyInPandas(_searcher(wants, chains, steps, seed), schema)
    slots = durable(first.unionByName(rest).select("grp", "slot"))
    named = F.element_at(F.array(*[F.lit(x) for x in names]), F.col("slot") + 1)
    return join_lookup(tied, slots, "grp").select("record", "grp", "multi_user", named.alias("split"))


def split_report(df: DataFrame, assigned: DataFrame, label: str = "source", record: str = "sample_idx") -> DataFrame:
    """Records per split and label with their share of the label (`split`, `label`, `n`, `share`)."""
    rows = df.select(F.col(record).alias("record"), F.col(label).alias("label")).join(assigned.select("record", "split").distinct(), "record")
    counts = rows.groupBy("split", "label").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("label")))
