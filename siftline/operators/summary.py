"""Counts over findings and records."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def total_hits(findings: DataFrame) -> DataFrame:
    """One row with the number of findings."""
    return findings.agg(F.count(F.lit(1)).alias("total_hits"))


def scan_progress(records: DataFrame) -> DataFrame:
    """Records and content bytes per file."""
    return records.groupBy("source_file").agg(
        F.count(F.lit(1)).alias("records"), F.sum(F.octet_length("content")).cast("bigint").alias("bytes")
    )


def scan_summary(findings: DataFrame) -> DataFrame:
    """Hits and distinct contents per pattern.

    Hits are summed per (pattern, content) first, so that a pattern with most of the findings
    is counted by many tasks.
    """
    per_content = findings.groupBy("pattern", "content").agg(F.count(F.lit(1)).alias("_hits"))
    return per_content.groupBy("pattern").agg(
        F.sum("_hits").cast("bigint").alias("hits"), F.count(F.lit(1)).alias("distinct_contents")
    )
