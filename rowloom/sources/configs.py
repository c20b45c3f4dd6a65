"""Task configurations, run manifests and cached results."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

try:
    import yaml
except ImportError:  # only reading YAML folders needs it
    yaml = None

CONFIG = "task_name string, source string, split string, response_field string, user_prompt_template string, system_message string, assistant_prefill string, train_first_n int, retrieval_k int, prepand_profile boolean"


def read_task_configs(spark: SparkSession, folder: str, file: str = "metadata.yaml") -> DataFrame:
    """The configurations of a folder with one folder per task, as the small dimension of tasks, in name order; absent fields are null.

    The files may lie on any file system the cluster reads; there is one small one per task.
    """
    if yaml is None:
        raise RuntimeError("reading task configurations needs PyYAML")
    names = [c.split(" ")[0] for c in CONFIG.split(", ")]
    files = spark.read.text(f"{folder}/*/{file}", wholetext=True).select(F.element_at(F.split(F.input_file_name(), "/"), -2).alias("task"), "value")
    rows = []
    for r in sorted(files.collect()):
        found = yaml.safe_load(r["value"]) or {}
        rows.append(tuple({**found, "task_name": r["task"]}.get(n) for n in names))
    return spark.createDataFrame(rows, CONFIG)


def first_rows(df: DataFrame, n: int | None, order: str = "sample_idx") -> DataFrame:
    """The first n training rows in a fixed order, where a positive n is set; else all."""
    return df.orderBy(order).limit(n) if n and n > 0 else df


def cache_key(*parts: object) -> str:
    """Digest of a source with its options and metadata: equal inputs share one cached result."""
    return hashlib.sha256(json.dumps(parts, sort_keys=True, default=str).encode()).hexdigest()[:32]


def cached(spark: SparkSession, folder: str, parts: Iterable[object], build: Callable[[], DataFrame]) -> DataFrame:
    """The result of `build`, written once under the digest of `parts` and read from there afterwards; half-written ones do not count."""
    path = f"{folder}/{cache_key(*parts)}"
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def manifest(spark: SparkSession, done: Iterable[str] = (), skipped: Iterable[str] = (), failed: Iterable[str] = ()) -> DataFrame:
    """What became of each task of a run (`task`, `state`)."""
    rows = [(t, s) for s, ts in (("processed", done), ("skipped", skipped), ("failed", failed)) for t in ts]
    return spark.createDataFrame(rows, "task string, state string").orderBy("task")


def scratch_query(spark: SparkSession, table: DataFrame, name: str, query: str) -> DataFrame:
    """The result of a query over a table whose columns are all text, under a view of that name which is dropped afterwards."""
    table.select(*[F.col(c).cast("string") for c in table.columns]).createOrReplaceTempView(name)
    try:
        return spark.sql(query)
    finally:
        spark.catalog.dropTempView(name)
