"""Folders of Arrow stream files with their description, read and written by tasks; splits with slices; the choice of a reader."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from rowloom.operators.order import with_position
from rowloom.sources.arrays import file_system
from rowloom.sources.files import _listing, read_any, sniff_format

#: Names of the two files that describe such a folder.
INFO, STATE = "dataset_info.json", "state.json"


def is_arrow_folder(spark: SparkSession, path: str) -> bool:
    """Whether a folder has both descriptions; one alone does not do."""
    names = {e.getPath().getName() for e in _listing(spark, path)[1]}
    return {INFO, STATE} <= names


def _schema(uri: str) -> pa.Schema:
    files, path = file_system(uri)
    with files.open_input_stream(path) as f, pa.ipc.open_stream(f) as reader:
        return reader.schema


def read_arrow_folder(spark: SparkSession, path: str) -> DataFrame:
    """The rows of the data files that the folder's state names, one task per file; the schema is that of the first file."""
    if not is_arrow_folder(spark, path):
        raise ValueError(f"no {INFO} and {STATE} in {path!r}")
    state = json.loads("".join(r["value"] for r in spark.read.text(f"{path}/{STATE}", wholetext=True).collect()))
    uris = [f"{path}/{f['filename']}" for f in state.get("_data_files", [])]
    if not uris:
        raise ValueError(f"no data files in {path!r}")
    schema = _schema(uris[0])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column("uri").to_pylist():
                files, at = file_system(uri)
                with files.open_input_stream(at) as f, pa.ipc.open_stream(f) as reader:
                    for found in reader:
                        yield found.select(schema.names)

    named = spark.createDataFrame([(u,) for u in uris], "uri string").repartition(len(uris), "uri")
    return named.mapInArrow(read, from_arrow_schema(schema))


def write_arrow_folder(df: DataFrame, path: str) -> bool:
    """Write a table as Arrow stream files, one per task, with their descriptions; an empty table writes nothing. Says whether it wrote."""
    if df.isEmpty():
        return False
    spark = df.sparkSession

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        name = f"data-{TaskContext.get().partitionId():05d}.arrow"
        files, at = file_system(path)
        files.create_dir(at, recursive=True)
        sink = writer = None
        rows = 0
        for batch in batches:
            if writer is None:
                sink = files.open_output_stream(f"{at}/.{name}")
                writer = pa.ipc.new_stream(sink, batch.schema)
            writer.write_batch(batch)
            rows += batch.num_rows
        if writer is not None:
            writer.close()
            sink.close()
            files.move(f"{at}/.{name}", f"{at}/{name}")
            yield pa.RecordBatch.from_pydict({"name": [name], "n": [rows]})

    written = sorted(df.mapInArrow(write, "name string, n long").collect())  # one row per file
    files, at = file_system(path)
    for name, value in ((INFO, {"features": df.columns, "num_rows": sum(r["n"] for r in written)}), (STATE, {"_data_files": [{"filename": r["name"]} for r in written]})):
        with files.open_output_stream(f"{at}/{name}") as f:
            f.write(json.dumps(value).encode())
    assert spark is not None
    return True


def read_spec(splits: dict[str, DataFrame], spec: str, order: str) -> DataFrame:
    """A split by its name with an optional slice in the order of a column: `train`, `train[:500]`, `train[90%:]`, `train[10%:20%]`."""
    m = re.fullmatch(r"(\w+)(?:\[(\d+%?)?:(\d+%?)?\])?", spec)
    if not m or m[1] not in splits:
        raise ValueError(f"no split {spec!r} among {sorted(splits)}")
    df = splits[m[1]]
    if "[" not in spec:
        return df
    n = df.count()
    at = [None if x is None else (n * int(x[:-1]) // 100 if x.endswith("%") else int(x)) for x in (m[2], m[3])]
    placed = with_position(df, order, name="_i")
    return placed.where((F.col("_i") >= (at[0] or 0)) & (F.col("_i") < (n if at[1] is None else at[1]))).drop("_i")


def open_source(spark: SparkSession, path: str, files: dict[str, str] | None = None, split: str = "train", schema: str | None = None) -> DataFrame:
    """A source by what is there: an Arrow folder, else a folder or file of a known format, else the named file of the split; raises otherwise."""
    if is_arrow_folder(spark, path):
        return read_arrow_folder(spark, path)
    if sniff_format(spark, path) is not None:
        return read_any(spark, path, schema)
    if files and split in files:
        return read_any(spark, files[split], schema)
    raise ValueError(f"nothing to read at {path!r}")
