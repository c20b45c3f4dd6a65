"""Sources of problems, templates and profiles, and small sinks for documents."""

from __future__ import annotations

import json
import re
from collections.abc import Iterable
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowloom.sources.files import _listing

#: Shape of a multiple-choice problem line; the four choices are all there or none.
PROBLEM = "index long, question string, answer string, domain string, sub_domain string, format string, tag string, A string, B string, C string, D string"


def read_problems(spark: SparkSession, path: str) -> DataFrame:
    """Problems of JSON lines with their choices as a map from letter to text, null unless all four are there."""
    rows = spark.read.schema(PROBLEM).json(path)
    letters = ("A", "B", "C", "D")
    every = F.create_map(*[x for c in letters for x in (F.lit(c), F.col(c))])
    there = F.lit(True)
    for c in letters:
        there = there & F.col(c).isNotNull()
    return rows.select(*[c.split(" ")[0] for c in PROBLEM.split(", ")[:7]], F.when(there, every).alias("choices"))


def read_programs(spark: SparkSession, path: str, key: str = "task_id") -> DataFrame:
    """Programming problems (`task_id`, `instruction`, `prefix`, `entry_point`) of JSON lines; of one id the last line counts.

    Where the prompt has a docstring, the instruction is its text and the prefix what stands before; else all of it is the instruction.
    """
    lines = spark.read.schema(f"{key} string, prompt string, entry_point string").json(path).withColumn("_at", F.struct(F.input_file_name().alias("f"), F.monotonically_increasing_id().alias("n")))
    last = lines.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct("prompt", "entry_point"), "_at").alias("p"))
    quoted = F.regexp_extract("p.prompt", r'(?s)"""(.*?)"""', 1)
    before = F.regexp_extract("p.prompt", r'(?s)^(.*?)"""', 1)
    return last.select(key, F.trim(F.when(quoted != "", quoted).otherwise(F.col("p.prompt"))).alias("instruction"), before.alias("prefix"), F.col("p.entry_point").alias("entry_point"))


def find_split_file(spark: SparkSession, folder: str, split: str, pattern: str = r"\.jsonl$") -> str | None:
    """The first file, by name, that ends with the split; else the first that ends with `_train`; else none."""
    names = sorted(s.getPath().getName() for s in _listing(spark, folder)[1] if s.isFile())
    for ending in (f"_{split}", "_train"):
        found = next((n for n in names if re.search(pattern, n) and re.sub(pattern, "", n).endswith(ending)), None)
        if found:
            return f"{folder}/{found}"
    return None


def read_generated_profiles(spark: SparkSession, *paths: str) -> DataFrame:
    """Generated profiles (`user_id`, `text`) of JSON files whose root, or its `data` or `prism_data`, maps users to texts.

    Blank values and values that are no text are left out, texts are trimmed; a user of several files has the text of the last.
    """
    parts = [spark.read.text(p, wholetext=True).select(F.lit(i).alias("o"), F.expr("try_parse_json(value)").alias("v")) for i, p in enumerate(paths)]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    root = "coalesce(try_variant_get(v, '$.data', 'map<string,variant>'), try_variant_get(v, '$.prism_data', 'map<string,variant>'), try_variant_get(v, '$', 'map<string,variant>'))"
    users = whole.select("o", F.explode(F.expr(root)).alias("user_id", "t")).where("schema_of_variant(t) = 'STRING'").select("o", "user_id", F.trim(F.expr("try_variant_get(t, '$', 'string')")).alias("text"))
    return users.where("text <> ''").groupBy("user_id").agg(F.max_by("text", "o").alias("text"))


def template_of(templates: dict[str, str], task: str, default: str = "default", prefixes: Iterable[str] = ("all_history_", "RAG_")) -> str:
    """The template of a task: under its name, under its name without a known prefix, or the default; raises without any."""
    names = [task, *[task[len(p) :] for p in prefixes if task.startswith(p)], default]
    for n in names:
        if n in templates:
            return templates[n]
    raise KeyError(f"no template for {task!r} and no {default!r}")


def read_templates(spark: SparkSession, folder: str) -> dict[str, str]:
    """Template files of a folder by their name without ending."""
    rows = spark.read.text(folder, wholetext=True).select(F.input_file_name().alias("f"), "value").collect()  # a folder of a few templates
    return {PurePosixPath(r["f"]).stem: r["value"] for r in rows}


def write_document(spark: SparkSession, value: object, path: str) -> None:
    """A small document as JSON, or as YAML by its ending, replacing an older one as a whole."""
    text = json.dumps(value, ensure_ascii=False, indent=2) if not path.endswith((".yaml", ".yml")) else _yaml(value)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark._jsc.hadoopConfiguration())
    half = spark._jvm.org.apache.hadoop.fs.Path(f"{path}.part")
    stream = files.create(half, True)
    try:
        stream.write(bytearray(text.encode("utf-8")))
    finally:
        stream.close()
    files.delete(where, False)
    files.rename(half, where)


def _yaml(value: object) -> str:
    import yaml

    return yaml.safe_dump(value, allow_unicode=True, sort_keys=False)


def parse_overrides(args: Iterable[str], known: dict[str, object]) -> dict[str, object]:
    """Settings with `--name=value` overrides, read as the kind of the setting; unknown and repeated names raise."""
    out, seen = dict(known), set()
    for a in args:
        m = re.fullmatch(r"--([\w-]+)=(.*)", a, re.S)
        if not m:
            raise ValueError(f"not an override: {a!r}")
        name = m[1].replace("-", "_")
        if name not in known or name in seen:
            raise ValueError(f"{'repeated' if name in seen else 'unknown'} setting {name!r}")
        seen.add(name)
        old = known[name]
        out[name] = m[2].lower() in ("1", "true", "yes") if isinstance(old, bool) else type(old)(m[2]) if isinstance(old, (int, float, str)) else json.loads(m[2])
    return out


def find_upwards(spark: SparkSession, folder: str, name: str, most: int = 3) -> str | None:
    """The nearest file of a name in a folder or up to `most` folders above it."""
    at = PurePosixPath(folder)
    for _ in range(most + 1):
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{at}/{name}")
        if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            return f"{at}/{name}"
        at = at.parent
    return None
