"""Records of evaluation splits that repeat training records: an FM-index of evaluation shards searched by training texts."""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowloom.llm import fmindex
from rowloom.llm.words import lcs_length, says_nothing, strip_markup, units, word_code
from rowloom.operators.skew import heavy_keys, join_lookup
from rowloom.session import drop_folder, durable, shared_folder, spread
from rowloom.sources.arrays import read_arrays, write_arrays

TRAIN = "train"
#: Share of the longer text's words that must stand in the other in the same order.
NEAR = 0.8
#: Words of evaluation text in one shard of the index.
SHARD_WORDS = 3_000_000
#: Buckets of the word counts that bound how many words two texts can share.
BUCKETS = 256
#: Words of a bucket that are compared as bits before the counts are.
LAYERS = 4
#: Texts searched at once, and words of training texts for which a shard is read once.
BATCH, PORTION_WORDS = 2_000, 8_000_000
#: Classes of short answers, which must be equal; and more steps than there are of sizes (2**31 words are the 96th).
CLASSES, STEPS = 64, 128
#: The least size of each step: near-same parts lie in the same step or in steps side by side.
EDGES = [1]
while EDGES[-1] < 1 << 31:
    EDGES.append(int(EDGES[-1] / NEAR + 1e-9) + 1)


def normal_text(text: str | None) -> str:
    """The words of a text (characters in Chinese and Japanese) joined by blanks, without case, marks, markup and Unicode form."""
    return " ".join(units(strip_markup(text))) if text else ""


def _cell(answer: str, first: int, second: int) -> int:
    """Where a text lies among others: the class of a short answer (0 for longer ones), and the steps of the sizes of answer and question."""
    kin = 1 + zlib.crc32(answer.encode("utf-8", "replace")) % CLASSES if second <= fmindex.EXACT else 0
    step = np.searchsorted(EDGES, (second, first), side="right").tolist()
    return (kin * STEPS + step[0]) * STEPS + step[1]


def _beside(cell: int) -> list[int]:
    """The cells in which near-same texts can lie."""
    kin, second, first = cell // STEPS**2, cell // STEPS % STEPS, cell % STEPS
    return [(kin * STEPS + y) * STEPS + x for y in ([second] if kin else range(max(0, second - 1), second + 2)) for x in range(max(0, first - 1), first + 2)]


def _deal(cells: list[tuple[str, int, int]], most: int) -> tuple[dict[tuple[str, int], tuple[int, int]], int]:
    """Deal cells (kind, cell, words) in their order out to numbered bins of `most` words; a larger cell gets some of its own.

    Gives the first bin and the number of bins per cell, and the number of all bins; a bin has texts of one kind.
    """
    out: dict[tuple[str, int], tuple[int, int]] = {}
    bins, room, last = 0, 0, None
    for kind, cell, words in sorted(cells):
        if kind == last and words <= room:
            out[kind, cell] = (bins - 1, 1)
            room -= words
        else:
            n = max(1, -(-words // most))
            out[kind, cell] = (bins, n)
            bins, room, last = bins + n, most - words, kind
    return out, bins


def _routes(cells: list[tuple[str, int]], shards: dict[tuple[str, int], tuple[int, int]]) -> dict[tuple[str, int], list[int]]:
    """The shards in which near-same texts of each cell can lie, for the cells that have any."""
    out = {}
    for kind, cell in cells:
        at = [shards[kind, c] for c in _beside(cell) if (kind, c) in shards]
        if at:
            out[kind, cell] = sorted({k for first, n in at for k in range(first, first + n)})
    return out


def _with_bin(texts: DataFrame, dealt: dict[tuple[str, int], tuple[int, int]], name: str) -> DataFrame:
    """The texts of the dealt cells with their bin."""
    table = texts.sparkSession.createDataFrame([(k, c, first, n) for (k, c), (first, n) in dealt.items()], "kind string, cell long, first_bin int, n_bins int")
    at = F.col("first_bin") + F.pmod(F.xxhash64("h"), F.col("n_bins")).cast("int")
    return texts.join(F.broadcast(table), ["kind", "cell"]).withColumn(name, at).drop("first_bin", "n_bins")


def text_units(df: DataFrame) -> DataFrame:
    """Two rows per record: its question with its answer (kind `io`), and its profile where it has one (kind `profile`).

    `text` has the words; in kind `io` a tab parts question and answer, and an answer that says nothing is one mark.
    `h` is the digest of the text: rows with the same digest are the same after normalisation. `cell` says where it lies by
    sizes and short answers, `n` how many words it has.
    """
    rows = spread(df.select("sample_idx", "source", "split", "input", "output", "profile_text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        profiles: dict[str, str] = {}  # profiles recur: normalised once
        for batch in batches:
            if len(profiles) > 20_000:
                profiles.clear()
            kinds, texts, at, cells, sizes = [], [], [], [], []
            for k, (i, o, p) in enumerate(zip(batch["input"], batch["output"], batch["profile_text"])):
                i, o, p = (x if isinstance(x, str) else None for x in (i, o, p))
                kinds.append("io")
                texts.append(normal_text(i) + "\t" + ("∅" if says_nothing(o) else normal_text(o)))
                at.append(k)
                if p is not None and p.strip():
                    if p not in profiles:
                        profiles[p] = normal_text(p)
                    kinds.append("profile")
                    texts.append(profiles[p])
                    at.append(k)
            for text in texts:
                question, _, answer = text.partition("\t")
                first, second = (x.count(" ") + 1 if x else 0 for x in (question, answer))
                cells.append(_cell(answer, first, second))
                sizes.append(first + second)
            part = batch.iloc[at]
            yield pd.DataFrame({"sample_idx": part["sample_idx"].to_numpy(), "source": part["source"].to_numpy(), "split": part["split"].to_numpy(), "kind": kinds, "text": texts, "cell": cells, "n": sizes})

    out = rows.mapInPandas(run, "sample_idx long, source string, split string, kind string, text string, cell long, n long")
    return out.withColumn("h", F.sha2(F.concat("kind", F.lit("\n"), "text"), 256).substr(1, 32))


def _words(text: str) -> tuple[list[str], int]:
    """The words of a normalised text, and how many of them are the question's (all, in a profile)."""
    question, tab, answer = text.partition("\t")
    a = question.split(" ") if question else []
    return (a + (answer.split(" ") if answer else []), len(a)) if tab else (a, len(a))


def _codes(found: list[str], store: dict, cut: int | None = None) -> np.ndarray:
    """Word codes; those behind the cut (of the answer) are never those before it."""
    out = []
    for w in found:
        c = store.get(w)
        if c is None:
            if len(store) > 500_000:
                store.clear()
            c = store[w] = word_code(w)
        out.append(c)
    codes = np.array(out, dtype=np.int64)
    if cut is not None:
        codes[cut:] += 1 << 60
    return codes


def _bags(texts: list[np.ndarray]) -> np.ndarray:
    """Words of each text counted in BUCKETS buckets; numbers below 1 are words the index lacks and count nowhere."""
    sizes = [len(t) for t in texts]
    flat = np.concatenate([*texts, np.zeros(0, dtype=np.int64)])
    cell = np.repeat(np.arange(len(texts)), sizes) * BUCKETS + (flat * 0x2545F491 >> 7) % BUCKETS
    counts = np.bincount(cell[flat > 0], minlength=len(texts) * BUCKETS)
    # counts are held whole: cut ones would no longer bound the shared words from above
    return counts.astype(np.uint16 if counts.max(initial=0) < 2**16 else np.uint32).reshape(len(texts), BUCKETS)


def _bits(bags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts as bits, one for each word up to LAYERS in a bucket, and the words beyond: they bound shared words in an eighth of the bytes."""
    layers = np.concatenate([bags > k for k in range(LAYERS)], axis=1)
    return np.packbits(layers, axis=1).view(np.uint64), np.maximum(bags.astype(np.int64) - LAYERS, 0).sum(axis=1)


def _near(a: np.ndarray, cut_a: int, b: np.ndarray, cut_b: int, n_a: int, n_b: int) -> bool:
    """Whether both parts of two texts are the same or nearly so."""
    for x, y, n, m in ((a[:cut_a], b[:cut_b], cut_a, cut_b), (a[cut_a:], b[cut_b:], n_a - cut_a, n_b - cut_b)):
        longest = max(n, m)
        if not longest or (n == m and (x == y).all() and (x > 0).all()):
            continue
        if min(n, m) < NEAR * longest - 1e-9 or lcs_length([t for t in x.tolist() if t > 0], y.tolist()) < NEAR * longest - 1e-9:
            return False
    return True


def build_shards(texts: DataFrame, uri: str) -> DataFrame:
    """Write an index for each shard of the evaluation texts (`kind`, `h`, `text`, `shard`) to the shared folder."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("h", kind="stable")
        store: dict = {}
        cut = [_words(t) for t in pdf["text"]]
        index = fmindex.build([_codes(w, store, c) for w, c in cut])
        index["cuts"] = np.array([c for _, c in cut], dtype=np.int64)
        index["bags"] = _bags([index["symbols"][a : a + m] for a, m in zip(index["start"], index["sizes"])])
        fmindex.ready(index)
        index = {k: index[k] for k in ("vocabulary", "symbols", "steps", "start", "sizes", "cuts", "bags", "group", "rank0", "rank1")}
        index["h"] = np.array(pdf["h"].tolist(), dtype="S32")
        kind, shard = pdf["kind"].iloc[0], int(pdf["shard"].iloc[0])
        write_arrays(uri, f"{kind}-{shard}.npz", index)
        return pd.DataFrame({"kind": [kind], "shard": [shard], "n_texts": [len(pdf)], "n_words": [int(index["sizes"].sum())]})

    return texts.groupBy("kind", "shard").applyInPandas(run, "kind string, shard int, n_texts long, n_words long")


def search_texts(index: dict[str, np.ndarray], codes: list[np.ndarray], cuts: list[int]) -> Iterator[tuple[int, int]]:
    """(query, text) pairs that are nearly the same, from the spans they share."""
    fmindex.ready(index)
    if "bits" not in index:
        index["bits"], index["beyond"] = _bits(index["bags"])
    sizes, cut = np.array([len(c) for c in codes], dtype=np.int64), np.array(cuts, dtype=np.int64)
    queries = np.split(fmindex.number(index, np.concatenate([*codes, np.zeros(0, dtype=np.int64)])), np.cumsum(sizes)[:-1])
    pairs = fmindex.partners(index, queries, cuts, NEAR)
    # the words that two texts have in common, in any order, bound those in the same order
    bags = _bags(queries)
    bits, beyond = _bits(bags)
    kept = []
    for lo in range(0, pairs.shape[1], 20_000):
        a, b = pairs[:, lo : lo + 20_000]
        first, second = np.maximum(cut[a], index["cuts"][b]), np.maximum(sizes[a] - cut[a], index["sizes"][b] - index["cuts"][b])
        least = fmindex.least_shared(first, NEAR) + fmindex.least_shared(second, NEAR)
        keep = np.flatnonzero(np.bitwise_count(bits[a] & index["bits"][b]).sum(axis=1, dtype=np.int64) + np.minimum(beyond[a], index["beyond"][b]) >= least)
        keep = keep[np.minimum(bags[a[keep]], index["bags"][b[keep]]).sum(axis=1, dtype=np.int64) >= least[keep]]
        kept.append(lo + keep)
    pairs = pairs[:, np.concatenate(kept)] if kept else pairs
    for a, b in sorted(pairs.T.tolist()):
        at, m = int(index["start"][b]), int(index["sizes"][b])
        if _near(queries[a], cuts[a], index["symbols"][at : at + m], int(index["cuts"][b]), len(queries[a]), m):
            yield a, b


def near_classes(units_: DataFrame) -> DataFrame:
    """Pairs of a training text and an evaluation text that are nearly, not exactly, the same (`kind`, `h_train`, `h_eval`)."""
    spark = units_.sparkSession
    uri = shared_folder(spark, "rowloom-fm")
    distinct = lambda rows: rows.groupBy("kind", "h").agg(*[F.first(c).alias(c) for c in ("text", "cell", "n")])
    held = durable(distinct(units_.where(F.col("split") != TRAIN)))
    # cells are few, whatever the number of texts: each side has CLASSES short answers and pairs of steps
    cells = [(r["kind"], r["cell"], r["n"]) for r in held.groupBy("kind", "cell").agg(F.sum("n").alias("n")).collect()]
    cores = spark.sparkContext.defaultParallelism
    shards, _ = _deal(cells, min(SHARD_WORDS, sum(n for *_, n in cells) // cores + 1))
    if not shards:
        return held.select("kind", F.col("h").alias("h_train"), F.col("h").alias("h_eval")).where("false")
    durable(build_shards(_with_bin(held, shards, "shard"), uri))
    texts = units_.where(F.col("split") == TRAIN)
    words = texts.groupBy("kind", "cell").agg((F.approx_count_distinct("h") * F.avg("n")).cast("long").alias("n")).collect()
    routes = _routes([(r["kind"], r["cell"]) for r in words], shards)
    mine = [(r["kind"], r["cell"], r["n"]) for r in words if (r["kind"], r["cell"]) in routes]
    # texts of like sizes and answers go to the same task, which reads only the shards where such texts lie
    parts, n_parts = _deal(mine, min(PORTION_WORDS, sum(n for *_, n in mine) // (4 * cores) + 1))
    training = _with_bin(distinct(texts), parts, "part").repartitionById(max(1, n_parts), F.col("part")).select("kind", "cell", "h", "text")

    def search(portion: list[tuple[str, int, str, np.ndarray, int]]) -> Iterator[pd.DataFrame]:
        wanted: dict[tuple[str, int], list] = defaultdict(list)
        for x in portion:
            for shard in routes[x[:2]]:
                wanted[x[0], shard].append(x[2:])
        for (kind, shard), mine in sorted(wanted.items(), key=lambda x: x[0]):
            index = read_arrays(uri, f"{kind}-{shard}.npz")
            if index is None:  # no text fell into this shard
                continue
            rows = []
            for lo in range(0, len(mine), BATCH):
                part = mine[lo : lo + BATCH]
                pairs = search_texts(index, [c for _, c, _ in part], [cut for *_, cut in part])
                rows += [(kind, part[a][0], index["h"][b].decode()) for a, b in pairs]
            del index  # before the next one is read
            yield pd.DataFrame([r for r in rows if r[1] != r[2]], columns=["kind", "h_train", "h_eval"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store: dict = {}
        portion: list = []
        size = 0
        for batch in batches:
            for kind, cell, h, text in zip(batch["kind"], batch["cell"].tolist(), batch["h"], batch["text"]):
                found, cut = _words(text)
                portion.append((kind, cell, h, _codes(found, store, cut), cut))
                size += len(found)
                if size >= PORTION_WORDS:  # a shard is read once for so many words
                    yield from search(portion)
                    portion, size = [], 0
        yield from search(portion)

    found = durable(training.mapInPandas(run, "kind string, h_train string, h_eval string"))
    drop_folder(spark, uri)
    return found


def linked_classes(rows: DataFrame) -> DataFrame:
    """Pairs of a training text and an evaluation text that are the same or nearly so (`kind`, `h_train`, `h_eval`), each once."""
    sides = rows.groupBy("kind", "h").agg(F.max(F.col("split") == TRAIN).alias("t"), F.max(F.col("split") != TRAIN).alias("e"))
    same = sides.where("t and e").selectExpr("kind", "h as h_train", "h as h_eval")
    return durable(near_classes(rows).unionByName(same))


def _salted_join(left: DataFrame, right: DataFrame, key: str, share: float = 0.002, salts: int = 64) -> DataFrame:
    """Inner join in which neither side's hot keys meet in one task: their right rows are dealt out over salts, their left rows go to each."""
    hot = F.broadcast(heavy_keys(right, F.col(key), share).select(F.col("key").alias(key), F.lit(True).alias("hot")))  # at most 1/share keys
    every = F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    one = F.when(F.col("hot"), F.pmod(F.xxhash64(*right.columns), F.lit(salts)).cast("int")).otherwise(F.lit(0))
    a = left.join(hot, key, "left").withColumn("salt", F.explode(every)).drop("hot")
    b = right.join(hot, key, "left").withColumn("salt", one).drop("hot")
    return a.join(b, [key, "salt"]).drop("salt")


def overlapping_pairs(df: DataFrame) -> DataFrame:
    """Pairs of a training record and a record of another split that repeat each other (`sample_a` < `sample_b`, `kind`).

    Kind `io`: question and answer are both the same or nearly so; kind `profile`: both have a profile, the same or nearly
    so. Nearly: NEAR of the longer text's words stand in the other in the same order, without case, marks, markup, spacing
    and Unicode form. Equal texts meet by digest; for others, shards of an FM-index over the distinct evaluation
    texts, one for texts of like sizes and short answers, are written to the shared folder, and the distinct training texts are
    streamed by backward search through those where near-same texts can lie;
    pairs with shared spans are verified by the longest common subsequence. Null questions and answers are empty;
    null or blank profiles take no part; rows without a split are neither side. Repeated rows each pair.
    """
    rows = durable(text_units(df.where(F.col("split").isNotNull())))
    classes = linked_classes(rows).select(F.concat_ws(":", "kind", "h_train").alias("train"), F.concat_ws(":", "kind", "h_eval").alias("held"), "kind")
    train = rows.where(F.col("split") == TRAIN).select(F.concat_ws(":", "kind", "h").alias("train"), F.col("sample_idx").alias("a"))
    held = rows.where(F.col("split") != TRAIN).select(F.concat_ws(":", "kind", "h").alias("held"), F.col("sample_idx").alias("b"))
    pairs = _salted_join(_salted_join(classes, held, "held").drop("held"), train, "train")
    return pairs.select(F.least("a", "b").alias("sample_a"), F.greatest("a", "b").alias("sample_b"), "kind")


def overlap_report(df: DataFrame) -> DataFrame:
    """Per evaluation split and source: records that repeat a training record, by kind, and the number of pairs.

    The pairs are counted from the classes of equal texts and never listed.
    """
    rows = durable(text_units(df.where(F.col("split").isNotNull())))
    copies = rows.where(F.col("split") == TRAIN).groupBy("kind", F.col("h").alias("h_train")).agg(F.count(F.lit(1)).alias("n"))
    partners = linked_classes(rows).join(copies, ["kind", "h_train"]).groupBy(F.concat_ws(":", "kind", "h_eval").alias("held")).agg(F.sum("n").alias("n"))
    held = rows.where(F.col("split") != TRAIN).select(F.concat_ws(":", "kind", "h").alias("held"), "sample_idx", "source", "split", "kind")
    per_record = join_lookup(held, partners, "held").groupBy("split", "source", "kind", "sample_idx").agg(F.sum("n").alias("n"))
    return per_record.groupBy("split", "source", "kind").agg(F.count(F.lit(1)).alias("n_records"), F.sum("n").alias("n_pairs"))
