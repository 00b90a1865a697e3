"""Findings as text, JSON, tables and reports, and runs kept under a name."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from siftline.functions.template import render_placeholders
from siftline.model import FINDING
from siftline.operators.scan import as_findings
from siftline.session import stored
from siftline.sinks.versions import entries, load_version, save_version
from siftline.sources.lines import row_in_task

REPORT_TITLE = "# Findings report"


def to_text_lines(findings: DataFrame) -> DataFrame:
    """``[pattern] file:line: content``, then one indented line per tool output, as one text."""
    head = F.concat(
        F.lit("["), "pattern", F.lit("] "), F.coalesce("file", F.lit("")), F.lit(":"),
        F.coalesce(F.col("line"), F.lit(0)).cast("string"), F.lit(": "), "content",
    )
    # How a tool output is shown.
    shown = F.transform("tool_data", lambda output: F.concat(
        F.lit("   ↳ "), output["label"], F.lit(": "), output["value"]
    ))
    return findings.select(F.array_join(F.concat(F.array(head), shown), "\n").alias("value"))


def to_content_lines(findings: DataFrame) -> DataFrame:
    """Only the matches."""
    return findings.select(F.col("content").alias("value"))


def findings_table(findings: DataFrame) -> DataFrame:
    """The four columns of the table view."""
    return findings.select("pattern", "file", "line", "content")


def render_template(findings: DataFrame, template: str) -> DataFrame:
    """One text per finding; adds ``{{entropy}}``, with three decimals, to the slots of enrichers."""
    return findings.select(render_placeholders(template, with_entropy=True).alias("value"))


def report_entry() -> Column:
    """A finding's heading and content bullet, as one text."""
    return F.concat(
        F.lit("### ["), F.col("pattern"), F.lit("] "), F.coalesce(F.col("file"), F.lit("")),
        F.lit("\n- Content: `"), F.col("content"), F.lit("`"),
    )


def report_entries(findings: DataFrame) -> DataFrame:
    """The entries of the report without its title, in no order."""
    return findings.select(report_entry().alias("value"))


def markdown_report(findings: DataFrame, title: str = REPORT_TITLE) -> DataFrame:
    """The report's texts in reading order: the title, then entries by pattern, file and line.

    Sorting reads its input twice, so the entries are stored first, with a number that lets
    equal ones go to several tasks.
    """
    order = ("_part", "pattern", "file", "line", "content", "_row")
    entries = stored(findings.select(
        F.lit(1).alias("_part"), "pattern", "file", F.col("line").cast("bigint").alias("line"), "content",
        report_entry().alias("value"), F.monotonically_increasing_id().alias("_row"),
    ))
    head = findings.sparkSession.createDataFrame([(0, None, None, None, None, title, None)], entries.schema)
    return head.unionByName(entries).orderBy(*order).select("value")


def write_text(lines: DataFrame, path: str) -> None:
    """Write one text per row; the folder must be new."""
    lines.select("value").write.option("lineSep", "\n").text(path)


def json_rows(findings: DataFrame) -> DataFrame:
    """Findings with empty fields as NULL, which JSON leaves out."""
    rows = as_findings(findings)
    empty = {"file": "", "ext": "", "line": 0, "entropy": 0.0}
    filled = {
        name: F.nullif(F.col(name), F.lit(blank).cast(FINDING[name].dataType)) for name, blank in empty.items()
    }
    for name in ("matches", "tool_data"):
        filled[name] = F.when(F.size(name) > 0, F.col(name))
    return rows.withColumns(filled)


def write_findings_json(findings: DataFrame, path: str) -> None:
    """Findings as JSON lines, empty fields left out."""
    json_rows(findings).write.option("ignoreNullFields", "true").json(path)


def save_run(findings: DataFrame, folder: str, run_id: str) -> None:
    """Keep a scan's findings under a name; a run of the same name is replaced at once when the new one is complete."""
    save_version(as_findings(findings), folder, run_id)


def load_run(spark: SparkSession, folder: str, run_id: str) -> DataFrame:
    """The findings of one run; only its files are read."""
    return load_version(spark, folder, run_id, FINDING)


def list_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Names of the runs that were saved."""
    return entries(spark, folder).select(F.col("name").alias("run_id"))


def with_finding_ids(findings: DataFrame, order: Sequence[str]) -> DataFrame:
    """Findings numbered from 1 in the given order, which must be a total one.

    The findings are stored, sorted over many tasks and stored with their place in the task, so
    a lost executor cannot change a number and nothing is searched twice.  Only the counts per
    task are added up on the driver.
    """
    spark = findings.sparkSession
    ordered = stored(findings.drop("id")).orderBy(*order)
    placed = stored(ordered.withColumns({"_part": F.spark_partition_id(), "_index": row_in_task()}))
    before, offsets = 0, []
    for row in sorted(placed.groupBy("_part").count().collect()):
        offsets.append((row["_part"], before))
        before += row["count"]
    table = spark.createDataFrame(offsets, "_part int, _before bigint")
    numbered = placed.join(F.broadcast(table), "_part")
    return numbered.select((F.col("_before") + F.col("_index") + 1).alias("id"), *findings.drop("id").columns)
