"""Records from the columns of any table, and lines from long texts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from siftline.functions.text import split_lines
from siftline.model import RECORD_COLUMNS


def source_label(file: Column, record_id: Column) -> Column:
    """``file`` or, where there is an id, ``file:id``."""
    known = F.coalesce(record_id, F.lit("")) != ""
    return F.when(known, F.concat_ws(":", file, record_id)).otherwise(file)


def fan_out_targets(
    rows: DataFrame, contents: dict[str, Column], keep: Sequence[str] = (), wanted: Column | None = None
) -> DataFrame:
    """One record per target whose content is present and not empty, in the given order.

    ``rows`` must hold ``record_id``, ``line`` and ``source_file``.  Rows that are not ``wanted``
    give no record; a filter would be pushed below the parsing and make it run twice.
    """
    pairs = F.array(*[
        F.struct(F.lit(name).alias("target"), content.cast("string").alias("content"))
        for name, content in contents.items()
    ])
    present = F.filter(pairs, lambda pair: F.coalesce(pair["content"], F.lit("")) != "")
    if wanted is not None:
        present = F.when(wanted, present)
    carried = [F.col(name) for name in keep]
    exploded = rows.select("record_id", "line", "source_file", *carried, F.explode(present).alias("_record"))
    return exploded.select(
        F.col("_record.content").alias("content"),
        F.coalesce("record_id", F.lit("")).alias("record_id"),
        "line",
        source_label(F.col("source_file"), F.col("record_id")).alias("file"),
        "source_file",
        F.col("_record.target").alias("target"),
        *carried,
    )


#: Most bytes of a table that are moved to have it on all cores.
SPREAD_BYTES = 256 << 20


def spread_rows(table: DataFrame) -> DataFrame:
    """A small table in fewer pieces than there are cores, spread over all of them.

    Matching costs far more than moving such an input; a table of more than ``SPREAD_BYTES`` is
    left as it is read.  Only the plan is looked at.  To be used directly on what a reader returns.
    """
    cores = table.sparkSession.sparkContext.defaultParallelism
    if table.isStreaming:
        return table
    size = table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    if int(size) > SPREAD_BYTES or table.rdd.getNumPartitions() >= cores:
        return table
    return table.repartition(cores)


def read_table_records(
    table: DataFrame, id: str, targets: Sequence[str], source: str = "", keep: Sequence[str] = ()
) -> DataFrame:
    """Records from chosen columns of a table; ``line`` is 0, ``keep`` names columns to carry along."""
    rows = table.withColumns({
        "record_id": F.col(id).cast("string"),
        "line": F.lit(0).cast("bigint"),
        "source_file": F.lit(source),
    })
    return fan_out_targets(rows, {name: F.col(name) for name in targets}, keep)


def lines_of(records: DataFrame) -> DataFrame:
    """Each content cut into its lines, numbered from 1; other columns are carried along."""
    others = [name for name in records.columns if name not in ("content", "line")]
    cut = records.select(*others, F.posexplode(split_lines(F.col("content"))).alias("_at", "content"))
    order = [name for name in RECORD_COLUMNS if name in records.columns or name == "line"]
    extra = [name for name in others if name not in order]
    return cut.withColumn("line", (F.col("_at") + 1).cast("bigint")).select(*order, *extra)
