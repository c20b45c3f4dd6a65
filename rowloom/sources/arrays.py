"""Files of arrays in the shared folder: written once by a task, read by others."""

from __future__ import annotations

import io
import uuid

import numpy as np
from pyarrow import fs


def file_system(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a Hadoop-style address of the shared folder."""
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), uri.removeprefix("file:").replace("//", "/")
    if "://" not in uri:
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri.replace("s3a://", "s3://"))


def write_arrays(uri: str, name: str, arrays: dict[str, np.ndarray]) -> None:
    """Write arrays as one file; a task that runs twice leaves one whole file."""
    files, path = file_system(uri)
    files.create_dir(path, recursive=True)
    whole = io.BytesIO()
    np.savez(whole, **arrays)
    temporary = f"{path}/.{name}-{uuid.uuid4().hex}"
    with files.open_output_stream(temporary) as f:
        f.write(whole.getbuffer())
    files.move(temporary, f"{path}/{name}")


def read_arrays(uri: str, name: str) -> dict[str, np.ndarray] | None:
    """The arrays of a file; none if no task wrote it."""
    files, path = file_system(uri)
    try:
        with files.open_input_file(f"{path}/{name}") as f:
            with np.load(io.BytesIO(f.read())) as z:
                return {k: z[k] for k in z.files}
    except FileNotFoundError:
        return None
