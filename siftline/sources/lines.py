"""Lines of text files, numbered within their file without moving the text.

A file is read in blocks, each block by one task from front to back.  A first pass counts the
rows of every block; the counts (one small row per block) give each block's offset in its file,
and the second pass adds the offset to the row's place in its task.  Only the counts are
shuffled, and the broadcast holds one row per block, bounded by ``MAX_BLOCKS``.  Where one file alone
has more blocks, nothing is broadcast: the offsets are stored by segments of a file, and a task reads
the segments of its own blocks.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from siftline.functions.decode import percent_decode
from siftline.functions.text import strip_carriage_return
from siftline.session import configure, stored, stored_by
from siftline.sources.stores import read_folder

#: Most blocks numbered by one broadcast (64 TB in blocks of 128 MB); more files go in several parts.
MAX_BLOCKS = 500_000

#: Blocks of a segment, whose offsets a task holds at once.
SEGMENT_BLOCKS = 10_000

#: Columns that say where a line lies: its file, its block, its task and its place in the task.
PLACE = ("_path", "_block", "_part", "_index")

_INDEX_BITS = (1 << 33) - 1


def row_in_task() -> Column:
    """Place of the row among the rows of its task, from 0."""
    return F.monotonically_increasing_id().bitwiseAND(F.lit(_INDEX_BITS))


def literal_path(path: str) -> str:
    """A path for a reader, which would take ``[ ] { } * ? \\`` in it for a pattern."""
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", path)


def ignore_files(
    rows: DataFrame, extensions: Sequence[str] = (), names: Sequence[str] = (), name: Column | None = None
) -> DataFrame:
    """Drop files by extension (with or without its dot) or by name; the files are not opened."""
    name = F.col("_metadata.file_name") if name is None else name
    if names:
        rows = rows.filter(~name.isin(list(names)))
    for extension in extensions:
        rows = rows.filter(~F.endswith(name, F.lit("." + extension.lstrip("."))))
    return rows


def raw_lines(
    spark: SparkSession,
    paths: str | Sequence[str],
    glob: str | None = None,
    ignore_extensions: Sequence[str] = (),
    ignore_names: Sequence[str] = (),
    other_than: str | None = None,
) -> DataFrame:
    """Lines of files and folders (all levels) with the columns of ``PLACE`` but the index.

    ``other_than`` leaves out file names that match a regular expression.
    """
    reader = configure(spark).read.option("lineSep", "\n").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    rows = ignore_files(reader.text(paths), ignore_extensions, ignore_names)
    if other_than:
        rows = rows.filter(~F.rlike("_metadata.file_name", F.lit(other_than)))
    return rows.select(
        "value",
        F.col("_metadata.file_path").alias("_path"),
        F.col("_metadata.file_block_start").alias("_block"),
    )


def file_label(path: Column) -> Column:
    """A file's path as text, without the scheme of local files."""
    return percent_decode(F.regexp_replace(path, r"\Afile:(//)?(?=/)", ""))


def block_bound(rows: DataFrame) -> tuple[int, list[str]]:
    """An upper bound for the number of blocks, and the files; planned, not run.

    A task takes at least half of what a task may take unless it is the last one, so there
    are at most two blocks per task beyond one per file.
    """
    files = [unquote(file) for file in rows.inputFiles()]
    return len(files) + 2 * rows.rdd.getNumPartitions(), files


def in_parts(
    paths: str | Sequence[str], read: Callable[[str | Sequence[str]], DataFrame],
    number: Callable[[DataFrame, bool], DataFrame], max_blocks: int = MAX_BLOCKS,
) -> DataFrame:
    """Number the lines of all files, in several parts where one would hold too many blocks.

    ``number`` is told whether a part has more blocks than a broadcast may hold, as one very large file has.
    """
    rows = read(paths)
    bound, files = block_bound(rows)
    if bound <= max_blocks or len(files) < 2:
        return number(rows, bound > max_blocks)
    parts = -(-bound // max_blocks)
    size = -(-len(files) // parts)
    united = None
    for start in range(0, len(files), size):
        rows = read([literal_path(file) for file in files[start:start + size]])
        part = number(rows, block_bound(rows)[0] > max_blocks)
        united = part if united is None else united.unionByName(part)
    return united


def block_span(blocks: DataFrame, segment_blocks: int = SEGMENT_BLOCKS) -> int:
    """Bytes of a file that hold about ``segment_blocks`` of its blocks, for all files are cut alike."""
    files = blocks.groupBy("_path").agg(F.max("_block").alias("last"), F.count_distinct("_block").alias("n"))
    wide = files.filter("n > 1").agg(F.max(F.ceil(F.col("last") / (F.col("n") - 1)))).first()[0]
    return max(1, wide or 1) * segment_blocks


def shifts(blocks: DataFrame, span: int | None = None) -> DataFrame:
    """(_path, _block, _part, first, good) → what to add to a row's place in its task.

    ``good`` is the number of rows of the block that are numbered, ``first`` the place of its
    first row in the task.  With a ``span`` sums run over segments of so many bytes first and over the
    blocks of a segment then, so no task orders all blocks of a file.
    """
    def before(*keys: str):
        return F.coalesce(F.sum("good").over(
            Window.partitionBy(*keys[:-1]).orderBy(keys[-1]).rowsBetween(Window.unboundedPreceding, -1)
        ), F.lit(0))

    in_task = before("_part", "first")
    if span is None:
        return blocks.select("_path", "_block", "_part", (before("_path", "_block") - in_task).alias("_shift"))
    blocks = blocks.withColumn("_segment", F.floor(F.col("_block") / span))
    segments = blocks.groupBy("_path", "_segment").agg(F.sum("good").alias("good"))
    segments = segments.select("_path", "_segment", before("_path", "_segment").alias("_earlier"))
    inside = blocks.select(
        "_path", "_segment", "_block", "_part", (before("_path", "_segment", "_block") - in_task).alias("_inside")
    )
    return inside.join(segments, ["_path", "_segment"]).select(
        "_path", "_block", "_part", (F.col("_earlier") + F.col("_inside")).alias("_shift")
    )


def with_stored_shifts(rows: DataFrame, offsets: DataFrame, span: int) -> DataFrame:
    """Rows with the ``_shift`` of their block, null for an unknown block.

    The offsets are stored in a folder for each segment of a file; a task reads those of its own blocks, one
    segment at a time.  The rows stay in their tasks.
    """
    slot = F.hex(F.xxhash64("_path", F.floor(F.col("_block") / span)))
    folder = stored_by(offsets.withColumn("slot", slot), "slot")
    names = rows.columns

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, now = {}, None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            places = [batch.column(name) for name in ("_path", "_block", "_part", "_slot")]
            new = np.zeros(n, bool)
            new[0] = True
            for column in places[:3]:
                new[1:] |= pc.not_equal(column.slice(1), column.slice(0, n - 1)).to_numpy(zero_copy_only=False)
            found = []
            # One entry for each block in the batch, not for each row.
            for path, block, part, wanted in zip(*(column.take(pa.array(np.flatnonzero(new))).to_pylist() for column in places), strict=True):
                if wanted != now:
                    stored = read_folder(f"{folder}/slot={wanted}")
                    known = {} if stored is None else {
                        (row["_path"], row["_block"], row["_part"]): row["_shift"] for row in stored.to_pylist()
                    }
                    now = wanted
                found.append(known.get((path, block, part)))
            shift = pa.array(found, pa.int64()).take(pa.array(np.cumsum(new) - 1))
            yield pa.RecordBatch.from_arrays([*(batch.column(name) for name in names), shift], [*names, "_shift"])

    schema = T.StructType([*rows.schema.fields, T.StructField("_shift", T.LongType())])
    return rows.withColumn("_slot", slot).mapInArrow(find, schema)


def add_shift(rows: DataFrame, blocks: DataFrame, large: bool = False, segment_blocks: int = SEGMENT_BLOCKS) -> DataFrame:
    """``line`` for rows that hold ``_index``; a block unknown to the first pass is an error.

    ``blocks`` are those of ``shifts``; they are broadcast unless they are ``large``.
    """
    if large:
        blocks = stored(blocks)
        span = block_span(blocks, segment_blocks)
        joined = with_stored_shifts(rows, shifts(blocks, span), span)
    else:
        joined = rows.join(F.broadcast(shifts(blocks)), ["_path", "_block", "_part"], "left")
    known = F.when(F.col("_shift").isNull(), F.raise_error(F.lit("files changed between two passes")))
    line = F.coalesce(known.cast("bigint"), F.col("_index") + F.col("_shift") + 1)
    return joined.withColumn("line", line).drop("_shift")


def with_line_numbers(rows: DataFrame, large: bool = False, segment_blocks: int = SEGMENT_BLOCKS) -> DataFrame:
    """Raw lines with ``line``, the 1-based number of the line in its file."""
    placed = rows.withColumns({"_part": F.spark_partition_id(), "_index": row_in_task()})
    blocks = placed.groupBy("_path", "_block", "_part").agg(
        F.count(F.lit(1)).alias("good"), F.min("_index").alias("first")
    )
    return add_shift(placed, blocks, large, segment_blocks)


def read_lines(
    spark: SparkSession, paths: str | Sequence[str], line_numbers: bool = True, max_blocks: int = MAX_BLOCKS,
    **files,
) -> DataFrame:
    """Lines of files as (value, file, line); ``\\n`` ends a line and one ``\\r`` before it is dropped.

    Numbers cost a second pass over the files; without them ``line`` is 0.
    """
    def read(some):
        return raw_lines(spark, some, **files)

    rows = in_parts(paths, read, with_line_numbers, max_blocks) if line_numbers else (
        read(paths).withColumn("line", F.lit(0).cast("bigint"))
    )
    return rows.select(strip_carriage_return(F.col("value")).alias("value"),
                       file_label(F.col("_path")).alias("file"), "line")


def text_records(lines: DataFrame) -> DataFrame:
    """One record per line."""
    return lines.select(
        F.col("value").alias("content"), F.lit("").alias("record_id"), "line", "file",
        F.col("file").alias("source_file"), F.lit("$").alias("target"),
    )


def read_text_records(spark: SparkSession, paths: str | Sequence[str], **options) -> DataFrame:
    """One record per line of text files."""
    return text_records(read_lines(spark, paths, **options))
