"""Sources and sinks: JSON lines, versioned folders, file names that carry task and split, profile files, vectors."""

from __future__ import annotations

import re
import string
from collections.abc import Iterable

from py4j.java_gateway import JavaObject
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowloom.operators.nested import is_object
from rowloom.operators.order import with_position

#: Endings of file names that name a split, longest first.
SPLITS = ("_random_train", "_random_test", "_ood_train", "_ood_test", "_train")


def read_jsonl(spark: SparkSession, path: str, schema: str | T.StructType, strict: bool = True) -> DataFrame:
    """JSON lines with a fixed schema. Blank lines are skipped; a broken line fails the read, or is skipped if not strict.

    A line counts as broken unless the whole of it is one object, also where a valid object is followed by something else.
    """
    fields = schema if isinstance(schema, T.StructType) else T._parse_datatype_string(schema)
    if strict:
        lines = spark.read.text(path).where(F.trim("value") != "")
        whole = F.expr(is_object("value"))
        checked = lines.where(F.when(whole, F.lit(True)).otherwise(F.raise_error(F.lit("MALFORMED line: it is not one JSON object"))))
        return checked.select(F.from_json("value", fields, {"mode": "FAILFAST"}).alias("r")).select("r.*")
    lines = spark.read.text(path).where(F.expr(is_object("value")))
    return lines.select(F.from_json("value", fields).alias("r")).select("r.*")


def write_jsonl(df: DataFrame, path: str, mode: str = "error") -> None:
    df.write.mode(mode).json(path)


def write_table(df: DataFrame, path: str, by: Iterable[str] = (), mode: str = "error") -> bool:
    """Write Parquet, by partition columns if given; an empty table writes nothing. Says whether it wrote."""
    if df.isEmpty():
        return False
    df.write.mode(mode).partitionBy(*by).parquet(path)
    return True


def read_sized(spark: SparkSession, path: str, order: str, take: str = "") -> DataFrame:
    """A table or a slice of it in the order of a column: `[:500]`, `[500:]`, `[:90%]`, `[90%:]` with the usual meaning."""
    df = spark.read.parquet(path)
    m = re.fullmatch(r"\[(\d+%?)?:(\d+%?)?\]", take) if take else None
    if take and not m:
        raise ValueError(f"not a slice: {take!r}")
    if not m:
        return df
    n = df.count()
    at = [None if x is None else (n * int(x[:-1]) // 100 if x.endswith("%") else int(x)) for x in m.groups()]
    placed = with_position(df, order, name="_i")
    return placed.where((F.col("_i") >= (at[0] or 0)) & (F.col("_i") < (n if at[1] is None else at[1]))).drop("_i")


def _listing(spark: SparkSession, folder: str) -> tuple[JavaObject, list]:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return files, list(files.listStatus(path)) if files.exists(path) else []


def find_versions(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of the folders named v<digits>, highest first."""
    found = [s.getPath().getName() for s in _listing(spark, folder)[1] if s.isDirectory()]
    return sorted((int(x[1:]) for x in found if re.fullmatch(r"v\d+", x)), reverse=True)


def resolve_version(spark: SparkSession, folder: str, version: str = "auto") -> tuple[str, str] | None:
    """Folder and layout (`v2`, or `v3` for any later) of a version; `auto` takes the highest; unknown ones and v0, v1 give none."""
    versions = find_versions(spark, folder)
    wanted = versions[:1] if version == "auto" else [int(version[1:])] if re.fullmatch(r"v\d+", version) and int(version[1:]) in versions else []
    if not wanted or wanted[0] < 2:
        return None
    return f"{folder}/v{wanted[0]}", "v2" if wanted[0] == 2 else "v3"


def file_task_split(name: str) -> tuple[str, str | None]:
    """Task and split that a file name carries, e.g. `lamp_movie_random_test.jsonl`; without a known ending the split is none."""
    base = re.sub(r"\.(jsonl|jsonlines|json|parquet)$", "", name)
    for ending in SPLITS:
        if base.endswith(ending):
            return base[: -len(ending)], ending[1:]
    return base, None


def with_task_split(df: DataFrame) -> DataFrame:
    """Rows of files with `task` and `split` columns from their file's name, in the plan."""
    name = F.regexp_replace(F.element_at(F.split(F.input_file_name(), "/"), -1), r"\.(jsonl|jsonlines|json|parquet)$", "")
    pattern = "^(.*?)(" + "|".join(SPLITS) + ")$"
    split = F.nullif(F.regexp_replace(F.regexp_extract(name, pattern, 2), "^_", ""), F.lit(""))
    return df.withColumn("task", F.when(split.isNotNull(), F.regexp_extract(name, pattern, 1)).otherwise(name)).withColumn("split", split)


def sniff_format(spark: SparkSession, path: str) -> str | None:
    """`parquet` for a folder with Parquet files, `jsonl`, `json`, or none, by names only; folders of partitions are looked into."""
    _, entries = _listing(spark, path)
    names = [e.getPath().getName() for e in entries]
    parts = [n for n, e in zip(names, entries) if e.isDirectory() and "=" in n]
    if parts:
        return sniff_format(spark, f"{path}/{parts[0]}")
    if any(n.endswith(".parquet") for n in names):
        return "parquet"
    if path.endswith((".jsonl", ".jsonlines")) or (names and all(n.endswith((".jsonl", ".jsonlines")) for n in names)):
        return "jsonl"
    return "json" if path.endswith(".json") else None


def read_any(spark: SparkSession, path: str, schema: str | T.StructType | None = None) -> DataFrame:
    """Read by the sniffed format; JSON needs a schema. An unknown format raises."""
    kind = sniff_format(spark, path)
    if kind == "parquet":
        return spark.read.parquet(path)
    if kind is None or schema is None:
        raise ValueError(f"no reader for {path!r}")
    return read_jsonl(spark, path, schema) if kind == "jsonl" else spark.read.schema(schema).option("multiLine", True).json(path)


def flatten_profiles(df: DataFrame, splits: str = "profiles") -> DataFrame:
    """A map of split to a map of user to text as rows; a user of several splits keeps the first split's text; blanks are dropped."""
    rows = df.select(F.posexplode(F.map_entries(splits)).alias("o", "e")).select("o", F.col("e.key").alias("split"), F.explode(F.map_entries("e.value")).alias("u"))
    texts = rows.select(F.col("u.key").alias("user_id"), "o", "split", F.trim("u.value").alias("text")).where("text <> ''")
    first = texts.groupBy("user_id").agg(F.min(F.struct("o", "split", "text")).alias("f"))
    return first.select("user_id", "f.split", "f.text")


def last_per_key(df: DataFrame, key: str, value: str, *order: str) -> DataFrame:
    """The last value of each key by an order (later files, later lines); null values never win."""
    return df.where(F.col(value).isNotNull()).groupBy(key).agg(F.max_by(value, F.struct(*order)).alias(value))


def template_fields(template: str) -> list[str]:
    """Names of the fields of a `{field}` template, in order, each once."""
    return list(dict.fromkeys(f for _, f, _, _ in string.Formatter().parse(template) if f))
