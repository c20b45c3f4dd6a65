"""Encoding a corpus with a public byte-level BPE vocabulary: batched merge rounds over flat arrays."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowloom.session import spread

#: Folder of the vocabulary files; a parameter of every function that needs one.
TOKENIZERS = os.environ.get("ROWLOOM_TOKENIZERS", "/opt/tokenizers")

#: Fixed value: the pre-tokenisation pattern that belongs to the byte-level vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Distinct words kept per worker with their ids; beyond that the store starts anew.
STORE = 200_000


def merge_table(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted pair keys, their merged ids, and the id of each single byte, from a file of base64 tokens and ranks.

    A pair may merge if its joined bytes are a token; the token's id is its rank. The table has one entry per way to cut
    a token into two tokens: a few hundred thousand, bounded by the vocabulary.
    """
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    keys, ids = [], []
    for token, rank in ranks.items():
        for cut in range(1, len(token)):
            left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
            if left is not None and right is not None:
                keys.append(left << 32 | right)
                ids.append(rank)
    order = np.argsort(keys := np.array(keys, dtype=np.int64), kind="stable")
    return keys[order], np.array(ids, dtype=np.int64)[order], np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int64)


def encode_words(words: list[bytes], table: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of many words at once, as one flat array and the words' offsets.

    All symbols lie in one array. In each round every word merges its lowest-ranked pair, at all places from the left that
    do not overlap; ranks are found by binary search over the sorted pair keys, and only for pairs that have changed.
    """
    keys, ids, byte_ids = table
    none = np.iinfo(np.int64).max
    sizes = np.array([len(w) for w in words], dtype=np.int64)
    symbols = byte_ids[np.frombuffer(b"".join(words), dtype=np.uint8)]
    word = np.repeat(np.arange(len(words)), sizes)

    def ranks(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 32 | right
        at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        return np.where(keys[at] == key, ids[at], none)

    done_symbols, done_words = [], []
    rank = np.full(len(symbols), none)  # of the pair that begins at a symbol
    inner = np.flatnonzero(word[1:] == word[:-1]) if len(word) else np.empty(0, dtype=np.int64)
    rank[inner] = ranks(symbols[inner], symbols[inner + 1])
    while len(symbols):
        starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
        lowest = np.minimum.reduceat(rank, starts)
        lowest = np.repeat(lowest, np.diff(np.r_[starts, len(word)]))
        settled = lowest == none
        if settled.any():  # these words are finished and leave the array
            done_symbols.append(symbols[settled])
            done_words.append(word[settled])
            going = ~settled
            symbols, word, rank, lowest = symbols[going], word[going], rank[going], lowest[going]
            if not len(symbols):
                break
        hit = np.flatnonzero(rank == lowest)
        if len(hit) > 1:  # in a run of overlapping hits (aaa) every other one from the left merges
            fresh = np.r_[True, np.diff(hit) > 1]
            place = np.arange(len(hit)) - np.flatnonzero(fresh)[np.cumsum(fresh) - 1]
            hit = hit[place % 2 == 0]
        symbols[hit] = rank[hit]
        keep = np.ones(len(symbols), dtype=bool)
        keep[hit + 1] = False
        where = np.cumsum(keep) - 1
        symbols, word, rank = symbols[keep], word[keep], rank[keep]
        now = where[hit]
        stale = np.unique(np.r_[now, np.maximum(now - 1, 0)])
        rank[stale] = none
        stale = stale[stale + 1 < len(symbols)]
        stale = stale[word[stale] == word[stale + 1]]
        rank[stale] = ranks(symbols[stale], symbols[stale + 1])
    flat_word = np.concatenate(done_words) if done_words else np.empty(0, dtype=np.int64)
    flat = np.concatenate(done_symbols) if done_symbols else np.empty(0, dtype=np.int64)
    order = np.argsort(flat_word, kind="stable")
    return flat[order], np.r_[0, np.cumsum(np.bincount(flat_word, minlength=len(words)))]


class Encoder:
    """Encodes batches of texts; words met before are taken from a store of bounded size."""

    def __init__(self, table: tuple[np.ndarray, np.ndarray, np.ndarray]):
        self.table, self.pattern, self.store = table, regex.compile(PATTERN), {}

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        cut = [self.pattern.findall(t) if t else [] for t in texts]
        if len(self.store) > STORE:
            self.store = {}
        new = list({w for ws in cut for w in ws if w not in self.store})
        if new:
            # a lone surrogate can't be written as UTF-8; it is encoded as the replacement character
            flat, offsets = encode_words([w.encode("utf-8", "replace") for w in new], self.table)
            flat, offsets = flat.tolist(), offsets.tolist()
            self.store.update((w, flat[offsets[i] : offsets[i + 1]]) for i, w in enumerate(new))
        store = self.store
        return [[i for w in ws for i in store[w]] for ws in cut]


def encode_corpus(df: DataFrame, text: str = "text", key: str = "doc_id", vocabulary: str | None = None) -> DataFrame:
    """Token ids of every text (`key`, `ids`), without special tokens; one row per input row.

    Empty and null texts have the empty list. Texts of any length are encoded whole; repeated rows are encoded like any
    other; other columns are ignored; an empty table gives no row. The merge table is bounded by the vocabulary and sent
    once to each executor, so the file need only exist at the driver.
    """
    table = df.sparkSession.sparkContext.broadcast(merge_table(vocabulary or os.path.join(TOKENIZERS, "byte_bpe_50k.tiktoken")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = Encoder(table.value)
        for batch in batches:
            for lo in range(0, len(batch), 500):
                part = batch.iloc[lo : lo + 500]
                texts = [t if isinstance(t, str) else None for t in part["text"]]
                yield pd.DataFrame({"key": part["key"].to_numpy(), "ids": encoder.encode(texts)})

    rows = spread(df.select(F.col(key).alias("key"), F.col(text).alias("text")))
    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInPandas(run, f"key {kind}, ids array<int>").withColumnRenamed("key", key)


def token_counts(df: DataFrame, text: str = "text", key: str = "doc_id", by: str = "source", vocabulary: str | None = None) -> DataFrame:
    """Texts and tokens per value of `by` (`by`, `n_texts`, `n_tokens`)."""
    encoded = encode_corpus(df.withColumn("_row", F.struct(F.col(key), F.col(by))), text, "_row", vocabulary)
    return encoded.groupBy(F.col(f"_row.{by}").alias(by)).agg(F.count(F.lit(1)).alias("n_texts"), F.sum(F.size("ids")).cast("long").alias("n_tokens"))
