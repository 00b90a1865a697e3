"""Scanning as files arrive.

``scan`` and everything narrow before and after it are the batch functions, unchanged.  This
module adds the file stream, stateful uniqueness, restart from a checkpoint, and line numbers
by micro-batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from siftline.functions.text import strip_carriage_return
from siftline.model import InputConfig
from siftline.operators.classify import HIGH, TextModel, only_high_interest
from siftline.operators.patterns import Pattern
from siftline.operators.prune import KEY
from siftline.operators.scan import scan
from siftline.sources.files import read_records
from siftline.sources.jsonl import jsonl_records
from siftline.sources.lines import file_label, literal_path, text_records
from siftline.sources.prepare import prepare


def stream_lines(spark: SparkSession, folder: str, max_files: int | None = None) -> DataFrame:
    """Lines of the files that appear in a folder, as (value, file, line); ``line`` is 0."""
    reader = spark.readStream.option("lineSep", "\n").option("recursiveFileLookup", "true")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.text(folder).select(
        strip_carriage_return(F.col("value")).alias("value"),
        file_label(F.col("_metadata.file_path")).alias("file"),
        F.lit(0).cast("bigint").alias("line"),
    )


def scan_stream(lines: DataFrame, patterns: Iterable[Pattern], config: InputConfig = InputConfig()) -> DataFrame:
    """Findings of a stream of text or JSON lines; no state is kept.

    CSV and whole JSON documents are made of more than one line: ``scan_numbered`` reads them.
    """
    if config.format not in ("text", "json", "jsonl") or config.expand_json:
        raise ValueError("a stream of lines holds text or JSON lines; use scan_numbered for other formats")
    records = jsonl_records(lines, config) if config.format in ("jsonl", "json") else text_records(lines)
    return scan(prepare(records, config), patterns)


def unique_stream(findings: DataFrame, event_time: str | None = None, delay: str | None = None) -> DataFrame:
    """Each (pattern, content) once.

    Without an event time the seen-set lives as long as the query and grows with the distinct
    matches.  With one, repeats are only recognised within ``delay``, and the state is bounded.
    """
    if event_time is None:
        return findings.dropDuplicates(list(KEY))
    return findings.withWatermark(event_time, delay or "1 hour").dropDuplicatesWithinWatermark(list(KEY))


def run_available(findings: DataFrame, target: str, checkpoint: str, format: str = "parquet") -> StreamingQuery:
    """Write the findings of all files not yet done, then stop.

    The checkpoint remembers the files, so the same call after a stop goes on where it ended,
    and each file's findings are written once.
    """
    return (
        findings.writeStream.format(format).option("path", target).option("checkpointLocation", checkpoint)
        .outputMode("append").trigger(availableNow=True).start()
    )


def run_classified(findings: DataFrame, target: str, checkpoint: str, model: TextModel | None = None, wanted: str = HIGH) -> StreamingQuery:
    """Write those findings of all files not yet done whose content the model puts in the wanted class, then stop.

    A model of any size is met: each micro-batch is classified as a batch, and its findings replace those of an attempt that died.
    Read ``target`` with ``recursiveFileLookup``, for each micro-batch has a folder of its own; one is empty, so that there is something to read.
    """
    findings.sparkSession.createDataFrame([], findings.schema).write.mode("overwrite").parquet(f"{target}/batch-none")

    def batch(rows: DataFrame, number: int) -> None:
        only_high_interest(rows, model, wanted).write.mode("overwrite").parquet(f"{target}/batch-{number}")

    return findings.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_progress(query: StreamingQuery) -> tuple[int, int]:
    """Micro-batches and lines that a query has read since it was started, as far as it remembers them."""
    batches = {step["batchId"]: step["numInputRows"] for step in query.recentProgress}
    return len(batches), sum(batches.values())


def scan_numbered(
    spark: SparkSession, folder: str, patterns: Iterable[Pattern], checkpoint: str,
    sink: Callable[[DataFrame, int], None], config: InputConfig = InputConfig(), max_files: int | None = None,
) -> StreamingQuery:
    """Scan a stream of files in any format, with line numbers.

    A file never spans two micro-batches, so each batch reads its files by the two-pass batch
    reader.  ``sink`` gets the findings and the batch number and must accept a repeated batch.
    The names of one batch's files come to the driver; ``max_files`` bounds them.
    """
    reader = spark.readStream.format("binaryFile").option("recursiveFileLookup", "true")
    reader = reader.option("maxFilesPerTrigger", max_files or 1000)
    patterns = list(patterns)

    def batch(files: DataFrame, number: int) -> None:
        paths = [literal_path(row["path"]) for row in files.select("path").collect()]
        if paths:
            sink(scan(read_records(files.sparkSession, paths, config), patterns), number)

    files = reader.schema("path string, modificationTime timestamp, length bigint, content binary").load(folder)
    return (
        files.select("path").writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
