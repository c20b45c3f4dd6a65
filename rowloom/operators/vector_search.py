"""Nearest vectors of a query set against all rows, in blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rowloom.session import drop_folder, durable, shared_folder
from rowloom.sources.arrays import read_arrays, write_arrays

#: Query vectors in a block.
BLOCK = 2_000


def nearest_by_cosine(queries: DataFrame, rows: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", digits: int = 6) -> DataFrame:
    """For each query the k rows of the largest cosine, itself left out (`q`, `key`, `cos`, `rank`); equal ones by key.

    Tasks write the queries as blocks of unit vectors to the shared folder; every task over rows multiplies its rows with each
    block and keeps k per query, so only these few are shuffled. Null and zero vectors match nothing.
    """
    spark = rows.sparkSession
    uri = shared_folder(spark, "rowloom-queries")
    kind = rows.schema[key].dataType.simpleString()
    asked = queries.where(F.col(vector).isNotNull()).select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("v"))
    blocks = max(1, -(-asked.count() // BLOCK))

    def unit(vectors: pd.Series) -> tuple[np.ndarray, np.ndarray]:
        m = np.stack(vectors.to_numpy()).astype(float) if len(vectors) else np.zeros((0, 1))
        size = np.sqrt((m * m).sum(axis=1))
        good = size > 0
        return m[good] / size[good, None], good

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("key", kind="stable")
        m, good = unit(pdf["v"])
        name = f"{int(pdf['block'].iloc[0])}.npz"
        write_arrays(uri, name, {"key": pdf["key"].to_numpy()[good], "m": m})
        return pd.DataFrame({"name": [name]})

    names = sorted(r["name"] for r in durable(asked.withColumn("block", F.pmod(F.xxhash64("key"), F.lit(blocks)).cast("int")).groupBy("block").applyInPandas(build, "name string")).collect())

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            m, good = unit(batch["v"])
            keys = batch["key"].to_numpy()[good]
            for name in names if len(keys) else ():
                block = read_arrays(uri, name)
                if block is None or not len(block["key"]):
                    continue
                cos = np.round(block["m"] @ m.T, digits)
                cos[block["key"][:, None] == keys[None, :]] = -np.inf
                # the k best of each query, ties by key
                order = np.lexsort((np.broadcast_to(keys, cos.shape), -cos), axis=1)[:, :k]
                q = np.repeat(block["key"], order.shape[1])
                best = np.take_along_axis(cos, order, axis=1).ravel()
                found = pd.DataFrame({"q": q, "key": keys[order.ravel()], "cos": best})
                yield found[np.isfinite(best)]

    held = rows.where(F.col(vector).isNotNull()).select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("v"))
    partial = durable(held.mapInPandas(search, f"q {kind}, key {kind}, cos double"))
    drop_folder(spark, uri)
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("cos"), "key"))
    return partial.withColumn("rank", rank.cast("long")).where(F.col("rank") <= k).withColumnRenamed("key", key)
