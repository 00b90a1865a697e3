"""Dropping findings that are weak, repeated or already known."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

#: A finding's identity for repeats.
KEY = ("pattern", "content")

#: Default order that decides which of several equal findings survives.
ORDER = ("file", "line", "target", "ordinal")


def min_entropy(findings: DataFrame, threshold: float = 3.5) -> DataFrame:
    """Findings whose entropy reaches the threshold."""
    return findings.filter(F.col("entropy") >= threshold)


def unique_findings(findings: DataFrame, order: Sequence[str] = ORDER) -> DataFrame:
    """One finding per (pattern, content): the first by ``order``.

    A streaming input keeps whichever arrives first, with a seen-set that is never evicted.
    In batch this is an aggregate, not a window: each task reduces its own repeats before
    anything is shuffled, so a match that makes up most of the input moves as one row per task.
    Columns that are not needed are best dropped before, for all of them travel along.
    """
    if findings.isStreaming:
        return findings.dropDuplicates(list(KEY))
    order = [name for name in order if name in findings.columns]
    rest = [name for name in findings.columns if name not in (*KEY, *order)]
    first = findings.groupBy(*KEY).agg(F.min(F.struct(*order, *rest)).alias("_first"))
    return first.select(*[
        F.col(name) if name in KEY else F.col("_first")[name].alias(name) for name in findings.columns
    ])


def unseen_findings(findings: DataFrame, history: DataFrame, order: Sequence[str] = ORDER) -> DataFrame:
    """Unique findings whose (pattern, content) is not in an earlier run's findings.

    Both sides are reduced to one row per key first, so no key is hot in the join.
    """
    known = history.select(*KEY).dropDuplicates()
    return unique_findings(findings, order).join(known, list(KEY), "left_anti")
