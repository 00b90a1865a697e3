"""Findings of earlier runs, and the output of line-matching commands."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from siftline.functions.text import file_extension
from siftline.model import FINDING, TOOL_OUTPUT


def fill_blanks(findings: DataFrame) -> DataFrame:
    """Fields that were left out because they were empty, put back."""
    blanks = {
        "id": F.lit(0), "pattern": F.lit(""), "file": F.lit(""), "ext": F.lit(""), "line": F.lit(0),
        "content": F.lit(""), "matches": F.array(), "entropy": F.lit(0.0), "tool_data": F.array(),
    }
    return findings.select(*[
        F.coalesce(F.col(item.name), blanks[item.name].cast(item.dataType)).alias(item.name) for item in FINDING.fields
    ])


def read_findings(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Saved findings: JSON lines, or arrays in any layout.

    Files are read by line, so they split.  Files in which a line is no finding and no array of
    findings are read whole, one in a task; if that fails too, it is an error.
    """
    schema, options = F.lit(f"array<{FINDING.simpleString()}>"), {"maxStringLen": str(2**31 - 1)}
    path = F.col("_metadata.file_path").alias("_path")

    def parsed(rows: DataFrame) -> DataFrame:
        array = F.when(F.startswith(F.ltrim("value"), F.lit("[")), F.col("value")).otherwise(
            F.concat(F.lit("["), F.col("value"), F.lit("]"))
        )
        return rows.select("_path", F.from_json(array, schema, options).alias("_found"))

    lines = parsed(spark.read.option("lineSep", "\n").text(paths).filter(F.trim("value") != "").select("value", path))
    broken = lines.filter("_found IS NULL").select("_path").distinct()
    if broken.isEmpty():
        return fill_blanks(lines.select(F.inline("_found")))
    whole = parsed(spark.read.text(paths, wholetext=True).select("value", path).join(broken, "_path", "left_semi"))
    other = whole.filter("_found IS NULL").select("_path").first()
    if other:
        raise ValueError(f"no saved findings: {other['_path']}")
    good = lines.join(broken, "_path", "left_anti")
    return fill_blanks(good.unionByName(whole).select(F.inline("_found")))


def read_grep_output(lines: DataFrame, pattern: str = "", value: str = "value") -> DataFrame:
    """``file:line:content`` lines as findings.

    Without a colon the line is all content, with one colon it is file and content.
    """
    line = F.col(value)
    first = F.instr(line, ":")
    rest = F.substring(line, first + 1, F.length(line))
    second = F.instr(rest, ":")
    file = F.when(first > 0, F.substring(line, F.lit(1), first - 1)).otherwise("")
    both = (first > 0) & (second > 0)
    digits = F.regexp_extract(F.substring(rest, F.lit(1), second - 1), r"\A\s*([+-]?[0-9]+)", 1)
    content = F.when(both, F.substring(rest, second + 1, F.length(rest))).when(first > 0, rest).otherwise(line)
    return lines.select(
        F.lit(0).cast("bigint").alias("id"),
        F.lit(pattern).alias("pattern"),
        file.alias("file"),
        file_extension(file).alias("ext"),
        F.coalesce(F.when(both, digits.try_cast("bigint")), F.lit(0)).cast("bigint").alias("line"),
        content.alias("content"),
        F.array().cast("array<string>").alias("matches"),
        F.lit(0.0).alias("entropy"),
        F.array().cast(f"array<{TOOL_OUTPUT.simpleString()}>").alias("tool_data"),
    )
