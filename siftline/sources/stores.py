"""Files opened by tasks, by the names that Spark lists them under."""

from __future__ import annotations

from urllib.parse import urlsplit

import pyarrow as pa
from pyarrow import fs, parquet as pq
from pyspark.sql import Column, functions as F


def store_of(path: str) -> tuple[fs.FileSystem, str]:
    """The store, of any kind that Arrow knows, and the name in it for a name that Spark has."""
    parts = urlsplit(path)
    if parts.scheme in ("", "file"):
        return fs.LocalFileSystem(), path.removeprefix("file:").removeprefix("//")
    store, root = fs.FileSystem.from_uri(f"{parts.scheme}://{parts.netloc}")
    return store, root.rstrip("/") + path.split(parts.netloc, 1)[1]


def open_file(path: str):
    """A file of any store, by the name that Spark has for it."""
    store, name = store_of(path)
    return store.open_input_file(name)


def read_folder(path: str) -> pa.Table | None:
    """The Parquet files that lie in a folder; nothing if there is no such folder."""
    store, name = store_of(path)
    found = store.get_file_info(fs.FileSelector(name, allow_not_found=True))
    files = [file.path for file in found if file.path.endswith(".parquet")]
    return pa.concat_tables(pq.read_table(file, filesystem=store, partitioning=None) for file in files) if files else None


def plain_name(path: Column) -> Column:
    """A listed file's label: its name, without the scheme of local files."""
    return F.regexp_replace(path, r"\Afile:(//)?(?=/)", "")
