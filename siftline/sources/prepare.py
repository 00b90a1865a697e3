"""What happens to a record's content between reading and matching."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, functions as F

from siftline.functions.text import unescape
from siftline.model import WHOLE_LINE, InputConfig


def unescape_content(records: DataFrame) -> DataFrame:
    """Records with backslash escapes undone."""
    return records.withColumn("content", unescape(F.col("content")))


def transform_fields(records: DataFrame, transforms: Mapping[str, Callable[[Column], Column]]) -> DataFrame:
    """Apply each target's transform to its records; the entry ``"$"`` serves all other targets.

    Where a transform gives NULL the content stays as it was.
    """
    content = F.col("content")
    changed = transforms[WHOLE_LINE](content) if WHOLE_LINE in transforms else content
    for target, transform in transforms.items():
        if target != WHOLE_LINE:
            changed = F.when(F.col("target") == target, transform(content)).otherwise(changed)
    return records.withColumn("content", F.coalesce(changed, content))


def prepare(records: DataFrame, config: InputConfig) -> DataFrame:
    """Decoding first, transforms second, as the config asks."""
    if config.decode:
        records = unescape_content(records)
    return transform_fields(records, config.transforms) if config.transforms else records
