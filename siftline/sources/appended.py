"""Lines of growing files, read from where the last run stopped.

What is known of a file is a row (path, byte, line): so many bytes are done, and so many lines lie in them.  A run looks at the
lengths of the files, cuts what is new into blocks and reads nothing else.  A line belongs to the block it starts in.  A
first pass counts the lines of each block, the sums over the blocks of a file give each block's first number, and a second
pass hands out the lines: the text is never shuffled, and a file of any size is read by as many tasks as it has blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from siftline.functions.text import strip_carriage_return
from siftline.model import InputConfig
from siftline.operators.patterns import Pattern
from siftline.operators.scan import scan
from siftline.session import stored
from siftline.sinks.versions import load_version, save_version
from siftline.sources.files import list_files
from siftline.sources.jsonl import jsonl_records
from siftline.sources.lines import text_records
from siftline.sources.prepare import prepare
from siftline.sources.stores import open_file, plain_name

PROGRESS = T.StructType([T.StructField("path", T.StringType()), T.StructField("byte", T.LongType()), T.StructField("line", T.LongType())])

#: Bytes of a block, blocks that one task reads, and bytes read at a time beyond a block.
BLOCK = 8 << 20
BLOCKS_A_TASK = 16
MORE = 1 << 20

_BLOCK = "path string, line bigint, begin bigint, start bigint, stop bigint, length bigint"


def lines_of_block(path: str, begin: int, start: int, stop: int, length: int) -> tuple[int, bytes]:
    """Where the first line that starts in a block begins, and all such lines that end within the file's length.

    At ``begin`` a line is known to start.  The bytes end with a line break, or there are none.
    """
    with open_file(path) as file:
        if start > begin:
            # A line starts behind a break; one in the byte before the block counts.
            file.seek(start - 1)
            data = file.read(stop - start + 1)
            first = data.find(b"\n", 0, stop - start)
            if first < 0:
                return stop, b""
            start, data = start + first, data[first + 1 :]
        else:
            file.seek(start)
            data = file.read(stop - start)
        if data.endswith(b"\n"):
            return start, data
        pieces, at = [data], stop
        while at < length:
            more = file.read(min(MORE, length - at))
            if not more:
                break
            end = more.find(b"\n")
            if end >= 0:
                return start, b"".join([*pieces, more[: end + 1]])
            pieces.append(more)
            at += len(more)
        # The last line has no end yet: it is for a later run.
        return start, data[: data.rfind(b"\n") + 1]


def new_blocks(files: DataFrame, progress: DataFrame, block: int = BLOCK, most: int | None = None) -> DataFrame:
    """The blocks of what the files (path, length) have beyond the progress, at most ``most`` bytes of each file.

    A file that is shorter than what was read has been replaced and is read from its start.
    """
    known = files.join(progress, "path", "left")
    same = F.col("length") >= F.col("byte")
    known = known.select(
        "path", "length", F.coalesce(F.when(same, F.col("byte")), F.lit(0).cast("bigint")).alias("begin"),
        F.coalesce(F.when(same, F.col("line")), F.lit(0).cast("bigint")).alias("line"),
    ).filter("length > begin")
    end = F.least("length", F.col("begin") + most) if most else F.col("length")
    rows = known.withColumn("end", end).withColumn("start", F.explode(F.sequence("begin", F.col("end") - 1, F.lit(block).cast("bigint"))))
    return rows.select("path", "line", "begin", "start", F.least(F.col("start") + block, "end").alias("stop"), "length")


def appended_lines(
    spark: SparkSession, files: DataFrame, progress: DataFrame, block: int = BLOCK, most: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """New complete lines as (value, file, line), and the progress once they are done with."""
    blocks = stored(new_blocks(files, progress, block, most))
    tasks = max(1, -(-blocks.count() // BLOCKS_A_TASK), min(blocks.count(), spark.sparkContext.defaultParallelism))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [lines_of_block(*row) for row in _rows(batch)]
            done = [(first + len(data), data.count(b"\n")) for first, data in found]
            columns = [pa.array([item[k] for item in done], pa.int64()) for k in range(2)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*batch.schema.names, "done", "lines"])

    counted = stored(blocks.repartition(tasks, "path", "start").mapInArrow(count, f"{_BLOCK}, done bigint, lines bigint"))
    before = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    placed = counted.withColumn("line", F.col("line") + F.coalesce(F.sum("lines").over(before), F.lit(0))).filter("lines > 0")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, line in zip(_rows(batch), batch.column("line").to_pylist(), strict=True):
                values = [value.decode("utf-8", "replace") for value in lines_of_block(*row)[1].split(b"\n")[:-1]]
                numbers = pa.array(range(line + 1, line + 1 + len(values)), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(values, pa.string()), pa.repeat(row[0], len(values)), numbers], ["value", "path", "line"])

    lines = placed.select(*[name.split()[0] for name in _BLOCK.split(", ")]).repartition(tasks, "path", "start").mapInArrow(
        read, "value string, path string, line bigint",
    ).select(strip_carriage_return(F.col("value")).alias("value"), plain_name(F.col("path")).alias("file"), "line")
    # A block in which no line starts says nothing about how far the file is done.
    after = counted.groupBy("path").agg(
        F.max(F.when(F.col("lines") > 0, F.col("done")).otherwise(F.col("begin"))).alias("byte"),
        (F.min("line") + F.sum("lines")).alias("line"),
    )
    return lines, progress.join(after, "path", "left_anti").select("path", "byte", "line").unionByName(after)


def _rows(batch: pa.RecordBatch) -> Iterator[tuple[str, int, int, int, int]]:
    return zip(*(batch.column(name).to_pylist() for name in ("path", "begin", "start", "stop", "length")), strict=True)


def scan_appended(
    spark: SparkSession, paths: str, patterns: Iterable[Pattern], folder: str, sink: Callable[[DataFrame, int], None],
    config: InputConfig = InputConfig(), glob: str | None = None, block: int = BLOCK, most: int | None = None,
) -> bool:
    """Scan what the files have gained since the last run, with line numbers; True if there was anything.

    The progress lies in ``folder`` and moves on only after ``sink`` has taken the findings and the number of the run; a run
    that dies is done again under the same number, which the sink must replace.  Text and JSON lines are read; a last line without an end waits.
    """
    if config.format not in ("text", "json", "jsonl") or config.expand_json:
        raise ValueError("growing files hold text or JSON lines")
    state = load_version(spark, folder, "progress", T.StructType([*PROGRESS.fields, T.StructField("run", T.LongType())]))
    number = (state.agg(F.max("run")).first()[0] or 0) + 1
    lines, after = appended_lines(spark, list_files(spark, paths, glob), state.drop("run"), block, most)
    after = stored(after)
    if after.exceptAll(state.drop("run")).isEmpty():
        return False
    records = jsonl_records(lines, config) if config.format != "text" else text_records(lines)
    sink(scan(prepare(records, config), patterns), number)
    save_version(after.withColumn("run", F.lit(number).cast("bigint")), folder, "progress")
    return True
