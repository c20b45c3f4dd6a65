"""Evaluation passages inside training documents: CGK embedding, bit-sampling LSH over windows, exact verification."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowloom.llm.words import cjk_share, fold, has_cjk, word_code, words
from rowloom.session import drop_folder, durable, shared_folder, spread
from rowloom.sources.arrays import read_arrays, write_arrays

#: A leak: so many consecutive words of the passage with at most so many altered, or so many consecutive characters.
RUN_WORDS, ALTERED, RUN_CHARS = 20, 2, 50
#: Windows compared, and the step at which documents are cut. Window + step - 1 = run: every leaked run holds a whole window.
WORD_WINDOW, WORD_STEP = 16, 5
CHAR_WINDOW, CHAR_STEP = 26, 25
#: Random walks, samples of each walk, and places per sample. See tests/llm for the measured recall per window.
WALKS, SAMPLES, PLACES = 12, 4, 6
#: Item windows in one block of the index (some 60 MB); words of a piece of a long passage.
BLOCK_WINDOWS, PIECE = 100_000, 20_000
#: Characters of documents searched per reading of the blocks, and candidates handled at once.
PORTION_CHARS, PORTION = 32_000_000, 2_000_000
#: Size of the tables of marks that spare most look-ups, in bits.
SLOT_BITS = 19


def walk_signatures(codes: np.ndarray, starts: np.ndarray, width: int, walks: int = WALKS, samples: int = SAMPLES, places: int = PLACES, seed: int = 11) -> np.ndarray:
    """LSH keys (tables x windows) of the windows of `codes` that begin at `starts`.

    The CGK random walk copies a symbol of the window at each step and goes on to the next one or stays, as a random
    function of step and symbol says: two windows within a small edit distance come out within a small Hamming
    distance. Each table's key joins a few sampled places of the walk.
    """
    rng = np.random.default_rng(seed)
    steps = 2 * width
    out = np.empty((walks * samples, len(starts)), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for w in range(walks):
            odd = rng.integers(0, 2**63, steps, dtype=np.uint64) << np.uint64(1) | np.uint64(1)
            sampled = np.stack([rng.choice(steps, places, replace=False) for _ in range(samples)])
            joins = rng.integers(0, 2**63, (samples, places), dtype=np.uint64) << np.uint64(1) | np.uint64(1)
            keys = np.zeros((samples, len(starts)), dtype=np.uint64)
            at = np.zeros(len(starts), dtype=np.int64)
            uses = [[(s, p) for s in range(samples) for p in range(places) if sampled[s, p] == j] for j in range(steps)]
            for j in range(steps):
                inside = at < width
                symbol = np.where(inside, codes[starts + np.minimum(at, width - 1)], np.uint64(0))
                for s, p in uses[j]:
                    mixed = (symbol + np.uint64(p + 1)) * joins[s, p]
                    keys[s] += mixed ^ (mixed >> np.uint64(29))
                at += ((symbol * odd[j]) >> np.uint64(63)).astype(np.int64)
            out[w * samples : (w + 1) * samples] = keys
    return out


class WordCodes(dict):
    """Codes of words met before; a new word's code is worked out once."""

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        code = self[word] = word_code(word)
        return code


def _char_codes(found: list[str]) -> np.ndarray:
    return np.frombuffer("".join(found).encode("utf-32-le", "replace"), dtype=np.uint32).astype(np.uint64)


def _word_codes(found: list[str], store: WordCodes) -> np.ndarray:
    return np.fromiter(map(store.__getitem__, found), dtype=np.uint64, count=len(found))


def _text_codes(text: str, by_char: bool, store: WordCodes) -> np.ndarray:
    return _char_codes(words(text)) if by_char else _word_codes(words(text), store)


def _slots(keys: np.ndarray, bits: int = SLOT_BITS) -> np.ndarray:
    """Places of keys in a table of 2**bits marks."""
    with np.errstate(over="ignore"):
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)


def _marks(keys: np.ndarray) -> np.ndarray:
    """Marks that say which keys can be in a table: a key without a mark is not."""
    marks = np.zeros(1 << SLOT_BITS, dtype=bool)
    marks[_slots(keys)] = True
    return marks


class ItemIndex:
    """Hash tables over all windows of a block of passages of one kind (words or characters)."""

    def __init__(self, by_char: bool, ids: np.ndarray, sizes: np.ndarray, items: np.ndarray, keys: np.ndarray, order: np.ndarray):
        """ids and sizes of the passages, their codes one behind the other, and per table its sorted keys and their windows."""
        self.by_char = by_char
        self.width, self.step, self.run = (CHAR_WINDOW, CHAR_STEP, RUN_CHARS) if by_char else (WORD_WINDOW, WORD_STEP, RUN_WORDS)
        self.altered = 0 if by_char else ALTERED
        self.ids, self.sizes, self.items = ids, sizes, items
        self.base = np.r_[0, np.cumsum(sizes)]
        self.owner, self.offset = _windows(sizes, self.width, self.run)
        self.keys, self.order = keys, order
        self.known = _marks(items)
        self.marks = [_marks(k) for k in keys]

    @staticmethod
    def arrays(ids: list, codes: list[np.ndarray], by_char: bool) -> dict[str, np.ndarray]:
        """What `__init__` takes, from the passages' codes."""
        width, run = (CHAR_WINDOW, RUN_CHARS) if by_char else (WORD_WINDOW, RUN_WORDS)
        sizes = np.array([len(c) for c in codes], dtype=np.int64)
        items = np.concatenate([*codes, np.zeros(0, dtype=np.uint64)])
        owner, offset = _windows(sizes, width, run)
        starts = (np.cumsum(sizes) - sizes)[owner] + offset
        keys = walk_signatures(items, starts, width) if len(starts) else np.zeros((0, 0), dtype=np.uint64)
        order = np.argsort(keys, axis=1, kind="stable") if len(starts) else np.zeros((0, 0), dtype=np.int64)
        return {"ids": np.array(ids), "sizes": sizes, "items": items, "keys": np.take_along_axis(keys, order, axis=1) if len(starts) else keys, "order": order.astype(np.uint32)}

    @classmethod
    def of(cls, items: list[tuple[object, str]], by_char: bool) -> ItemIndex:
        store = WordCodes()
        return cls(by_char, **cls.arrays([i for i, _ in items], [_text_codes(t, by_char, store) for _, t in items], by_char))

    def search(self, docs: list[np.ndarray]) -> set[tuple[int, int]]:
        """(document, item) pairs, both by position, that pass the exact verification."""
        if not len(self.keys) or not docs:
            return set()
        base = np.cumsum([0, *map(len, docs)])
        flat = np.concatenate(docs)
        if len(flat) < self.width:
            return set()
        # a window with more foreign words than may be altered can't match
        foreign = np.r_[0, np.cumsum(~self.known[_slots(flat)])]
        starts = [np.arange(base[k], base[k + 1] - self.width + 1, self.step) for k in range(len(docs)) if len(docs[k]) >= self.run]
        if not starts:
            return set()
        starts = np.concatenate(starts)
        starts = starts[foreign[starts + self.width] - foreign[starts] <= self.altered]
        if not len(starts):
            return set()
        triples = [np.zeros((3, 0), dtype=np.int64)]
        for lo in range(0, len(starts), 50_000):
            triples += self._candidates(flat, base, starts[lo : lo + 50_000])
        triples = np.unique(np.concatenate(triples, axis=1), axis=1)
        sure, maybe = self._runs(flat, base, *triples)
        result = set(map(tuple, triples[:2, sure].T.tolist()))
        for d, i, shift in triples[:, maybe & ~sure].T.tolist():
            if (d, i) not in result and self._edited(docs[d], self.items[self.base[i] : self.base[i + 1]], shift):
                result.add((d, i))
        return result

    def _candidates(self, flat: np.ndarray, base: np.ndarray, starts: np.ndarray) -> Iterator[np.ndarray]:
        """(document, item, diagonal) columns of the windows that share a bucket; full buckets are taken in portions."""
        keys = walk_signatures(flat, starts, self.width)
        for table, own in enumerate(keys):
            some = np.flatnonzero(self.marks[table][_slots(own)])
            lo = np.searchsorted(self.keys[table], own[some], side="left")
            hi = np.searchsorted(self.keys[table], own[some], side="right")
            there = hi > lo
            some, lo, n = some[there], lo[there], (hi - lo)[there]
            part = np.cumsum(n) // PORTION
            for p in np.unique(part):
                k = part == p
                size = n[k]
                window = self.order[table][np.repeat(lo[k] - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())].astype(np.int64)
                at = np.repeat(starts[some[k]], size)
                doc = np.searchsorted(base, at, side="right") - 1
                yield np.unique(np.stack([doc, self.owner[window], at - base[doc] - self.offset[window]]), axis=1)

    def _runs(self, flat: np.ndarray, base: np.ndarray, doc: np.ndarray, item: np.ndarray, shift: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For many diagonals at once: whether a run of the item stands there with few enough words altered; and whether it
        could with words left out or put in, whose other words then all stand on a few diagonals nearby."""
        sure, maybe = np.zeros(len(doc), dtype=bool), np.zeros(len(doc), dtype=bool)
        sizes, item_base, items = self.sizes, self.base, self.items
        reach = 2 * self.altered
        for lo in range(0, len(doc), 5_000):
            d, i, sh = doc[lo : lo + 5_000], item[lo : lo + 5_000], shift[lo : lo + 5_000]
            n = sizes[i]
            first = np.r_[0, np.cumsum(n)[:-1]]
            pos = np.arange(n.sum()) - np.repeat(first, n)
            word = items[np.repeat(item_base[i], n) + pos]
            at = np.repeat(sh, n) + pos
            length, start = np.repeat(base[d + 1] - base[d], n), np.repeat(base[d], n)
            near = np.zeros(len(pos), dtype=bool)
            for step in sorted(range(-reach, reach + 1), key=abs):
                q = at + step
                equal = (q >= 0) & (q < length)
                equal[equal] = flat[(start + q)[equal]] == word[equal]
                near |= equal
                if step == 0:
                    sure[lo : lo + 5_000] = self._any_run(equal, first, n)
            maybe[lo : lo + 5_000] = self._any_run(near, first, n) if reach else False
        return sure, maybe

    def _any_run(self, hit: np.ndarray, first: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Per segment, whether some `run` places in a row hold all but `altered` hits."""
        total = np.r_[0, np.cumsum(hit)]
        last = np.maximum(np.repeat(first + n, n) - self.run, 0)
        place = np.arange(len(hit))
        good = (place <= last) & (total[np.minimum(place + self.run, len(hit))] - total[place] >= self.run - self.altered)
        return np.add.reduceat(good, first) > 0

    def _edited(self, doc: np.ndarray, item: np.ndarray, shift: int) -> bool:
        """The same with words left out or put in: greedy furthest reach per start and diagonal, for few edits."""
        k = self.altered
        size, n = self.run, len(doc)
        a, b = item.tolist(), doc.tolist()
        near = range(shift - k, shift + k + 1)
        # reach[d][i]: length of the match of the item from i along diagonal d
        reach = {}
        for d in range(shift - 2 * k, shift + 2 * k + 1):
            r = [0] * (len(a) + 1)
            for i in range(len(a) - 1, -1, -1):
                j = i + d
                r[i] = r[i + 1] + 1 if 0 <= j < n and a[i] == b[j] else 0
            reach[d] = r
        for s in range(len(a) - size + 1):
            for d0 in near:
                ends = {d0: s + reach[d0][s]}
                if ends[d0] - s < 3:
                    continue
                for _ in range(k):
                    after: dict[int, int] = {}
                    for d, i in ends.items():
                        for dd, ii in ((d, i + 1), (d - 1, i + 1), (d + 1, i)):  # altered, left out, put in
                            if dd in reach and ii <= len(a):
                                ii += reach[dd][ii]
                                after[dd] = max(after.get(dd, 0), ii)
                    ends = after
                if max(ends.values(), default=0) - s >= size:
                    return True
        return False


def _windows(sizes: np.ndarray, width: int, run: int) -> tuple[np.ndarray, np.ndarray]:
    """Passage and offset of every window of the passages that are long enough to leak."""
    n = np.where(sizes >= run, sizes - width + 1, 0)
    owner = np.repeat(np.arange(len(sizes)), n)
    return owner, np.arange(n.sum()) - (np.cumsum(n) - n)[owner]


def passage_pieces(items: DataFrame, item: str, passage: str) -> DataFrame:
    """The passages as words (`item`, `chars`, `words`, `n`), long ones in pieces that overlap by what a leaked run can span."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for i, t in zip(batch["item"], batch["text"]):
                by_char = cjk_share(fold(t)) > 0.5
                found = list("".join(words(t))) if by_char else words(t)
                step = PIECE - (RUN_CHARS if by_char else RUN_WORDS + ALTERED)
                out += [(i, by_char, " ".join(found[lo : lo + PIECE]), len(found[lo : lo + PIECE])) for lo in range(0, max(1, len(found)), step)]
            yield pd.DataFrame(out, columns=["item", "chars", "words", "n"])

    rows = items.where(F.col(passage).isNotNull()).select(F.col(item).alias("item"), F.col(passage).alias("text"))
    return rows.mapInPandas(run, f"item {items.schema[item].dataType.simpleString()}, chars boolean, words string, n long")


def build_index(items: DataFrame, item: str, passage: str, uri: str) -> list[tuple[str, bool]]:
    """Write the hash tables of the passages to the shared folder, a file per block of about BLOCK_WINDOWS windows."""
    pieces = durable(passage_pieces(items, item, passage))
    sizes = {r["chars"]: -(-r["n"] // BLOCK_WINDOWS) for r in pieces.groupBy("chars").agg(F.sum("n").alias("n")).collect() if r["n"]}
    if not sizes:
        return []
    n_blocks = F.when(F.col("chars"), F.lit(sizes.get(True, 1))).otherwise(F.lit(sizes.get(False, 1)))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        by_char, block = bool(pdf["chars"].iloc[0]), int(pdf["block"].iloc[0])
        store = WordCodes()
        codes = [_char_codes([w.replace(" ", "")]) if by_char else _word_codes(w.split(" ") if w else [], store) for w in pdf["words"]]
        name = f"{'c' if by_char else 'w'}{block}.npz"
        write_arrays(uri, name, ItemIndex.arrays(pdf["item"].tolist(), codes, by_char))
        return pd.DataFrame({"name": [name], "chars": [by_char]})

    blocks = pieces.withColumn("block", F.pmod(F.xxhash64("item", "words"), n_blocks).cast("int"))
    built = durable(blocks.groupBy("chars", "block").applyInPandas(build, "name string, chars boolean"))
    return sorted((r["name"], r["chars"]) for r in built.collect())


def leaked_items(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", passage: str = "passage") -> DataFrame:
    """Documents that repeat a passage wholly or in part (`key`, `item_id`), one row per document row and item.

    A leak is a run of RUN_WORDS words of the passage in the document with at most ALTERED of them altered, left out
    or put in; for passages in Chinese or Japanese, RUN_CHARS characters in a row. Case, marks, spacing and Unicode form do
    not count. Candidates come from bit-sampling LSH on CGK walks over windows, and each is verified exactly.
    The items are the query set: tasks write their hash tables in blocks to the shared folder, and every task over documents
    reads each block once for many documents. The documents are read once and never shuffled, but for small tables that are
    dealt out. Null, empty and short texts match nothing; repeated documents are each reported; items with equal text are
    all reported.
    """
    spark = docs.sparkSession
    rows = spread(docs.where(F.col(text).isNotNull()).select(F.col(key).alias("key"), F.col(text).alias("text")))
    kind, item_kind = rows.schema["key"].dataType.simpleString(), items.schema[item].dataType.simpleString()
    uri = shared_folder(spark, "rowloom-cgk")
    blocks = build_index(items, item, passage, uri)

    def search(portion: list[tuple[object, np.ndarray, np.ndarray | None]]) -> pd.DataFrame:
        found: dict[int, set] = defaultdict(set)
        for name, by_char in blocks:
            index = _load(uri, name, by_char)
            some = [d for d, (_, _, c) in enumerate(portion) if not by_char or c is not None]
            for lo in range(0, len(some), 1000):
                part = some[lo : lo + 1000]
                for d, i in index.search([portion[x][2 if by_char else 1] for x in part]):
                    found[part[d]].add(index.ids[i].item())
        pairs = [(portion[d][0], i) for d in sorted(found) for i in sorted(found[d])]
        return pd.DataFrame({"key": [a for a, _ in pairs], "item": [b for _, b in pairs]}).astype({} if pairs else {"key": "object"})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store = WordCodes()
        portion: list = []
        size = 0
        for batch in batches:
            for k, t in zip(batch["key"].tolist(), batch["text"]):
                found = words(t)
                portion.append((k, _word_codes(found, store), _char_codes(found) if len(t) >= RUN_CHARS and has_cjk(t) else None))
                size += len(t)
                if size >= PORTION_CHARS:
                    yield search(portion)
                    portion, size = [], 0
        if portion:
            yield search(portion)

    found = durable(rows.mapInPandas(run, f"key {kind}, item {item_kind}"))
    drop_folder(spark, uri)
    return found.withColumnsRenamed({"key": key, "item": item})


#: The block read last by this process.
_LOADED: dict[tuple[str, str], ItemIndex] = {}


def _load(uri: str, name: str, by_char: bool) -> ItemIndex:
    if (uri, name) not in _LOADED:
        if len(_LOADED) >= 2:
            _LOADED.clear()
        _LOADED[uri, name] = ItemIndex(by_char, **(read_arrays(uri, name) or {}))
    return _LOADED[uri, name]


def leak_report(docs: DataFrame, items: DataFrame, found: DataFrame, key: str = "doc_id", item: str = "item_id") -> DataFrame:
    """Per leaked item: source, split and the number of documents that repeat it."""
    per_item = found.groupBy(item).agg(F.countDistinct(key).alias("n_docs"))
    return items.select(item, "source", "split").join(per_item, item)
