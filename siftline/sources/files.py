"""Choosing a reader by file name, lists of targets, and skipping files already done."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, functions as F

from siftline.model import InputConfig
from siftline.sources.bigjson import large_json_leaves
from siftline.sources.csv import read_csv_records
from siftline.sources.documents import WHOLE_BYTES, document_records
from siftline.sources.jsonl import jsonl_records
from siftline.sources.lines import literal_path, read_lines, text_records
from siftline.sources.prepare import prepare
from siftline.sources.stores import plain_name

# File name endings of each format; any other file is text.
ENDINGS = {"jsonl": (".jsonl", ".json"), "csv": (".csv",)}


def detect_format(path: str) -> str:
    """The format a file name stands for."""
    return next((name for name, endings in ENDINGS.items() if path.endswith(endings)), "text")


def read_records(
    spark: SparkSession, paths: str | Sequence[str], config: InputConfig, line_numbers: bool = True,
    document_bytes: int = WHOLE_BYTES, **files,
) -> DataFrame:
    """Records of files and folders in the config's format, decoded and transformed.

    JSON documents of more than ``document_bytes`` are cut into parts.
    """
    if config.format == "csv":
        records = read_csv_records(spark, paths, config.csv, **files)
    else:
        lines = read_lines(spark, paths, line_numbers or config.expand_json, **files)
        if config.expand_json:
            records = document_records(spark, paths, lines, document_bytes, lambda files: _opened(spark, paths, files, document_bytes))
        else:
            records = jsonl_records(lines, config) if config.format in ("jsonl", "json") else text_records(lines)
    return prepare(records, config)


def _opened(spark: SparkSession, paths: str | Sequence[str], files: DataFrame, most: int) -> DataFrame:
    """(file, path, value) of the leaves of those labelled files that are larger than ``most`` bytes."""
    large = list_files(spark, paths).filter(F.col("length") > most).withColumn("file", plain_name(F.col("path")))
    if large.isEmpty():
        return spark.createDataFrame([], "file string, path string, value string")
    leaves = large_json_leaves(spark, large.join(files, "file", "left_semi"), most=most)
    return leaves.withColumn("file", plain_name(F.col("file")))


def read_any_records(
    spark: SparkSession, paths: str | Sequence[str], config: InputConfig = InputConfig(), **options
) -> DataFrame:
    """Records of files and folders, each file read in the format its name stands for."""
    every = [ending for endings in ENDINGS.values() for ending in endings]
    known = r"(%s)\z" % "|".join(ending.replace(".", r"\.") for ending in every)
    parts = [
        read_records(spark, paths, replace(config, format=name), glob="*{%s}" % ",".join(endings), **options)
        for name, endings in ENDINGS.items()
    ]
    records = read_records(spark, paths, replace(config, format="text"), other_than=known, **options)
    for part in parts:
        records = records.unionByName(part)
    return records


def read_target_list(spark: SparkSession, path: str) -> list[str]:
    """Paths listed in a text file, one per line, blank lines left out.

    The list is an argument for a reader, so it is wanted on the driver.  Listed names are names and
    no patterns, so characters that a reader would take for one are escaped.
    """
    rows = spark.read.option("lineSep", "\n").text(path).collect()
    return [literal_path(path) for path in (row["value"].strip() for row in rows) if path]


def list_files(spark: SparkSession, paths: str | Sequence[str], glob: str | None = None) -> DataFrame:
    """The files below some paths, without reading their content."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(paths).select("path", "length")


def remaining_files(files: DataFrame, done: DataFrame) -> DataFrame:
    """Files that are not yet in the table of files already scanned."""
    return files.join(done.select("path").distinct(), "path", "left_anti")


def done_files(files: DataFrame) -> DataFrame:
    """What to append to the table of scanned files once their findings are written."""
    return files.select("path", F.current_timestamp().alias("finished_at"))
