"""Records from JSON lines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from siftline.functions.fields import field, is_json_object, parse_json, filter_equals
from siftline.model import WHOLE_LINE, InputConfig
from siftline.session import configure
from siftline.sources.lines import read_lines
from siftline.sources.tables import fan_out_targets


def jsonl_records(lines: DataFrame, config: InputConfig) -> DataFrame:
    """Records of a DataFrame of lines (``value``, ``file``, ``line``).

    An object passes if all filters hold and gives one record per target.  A line that is not
    an object is given whole if ``"$"`` is a target, without filters or id, and else left out.
    """
    configure(lines.sparkSession)
    targets = config.target_names()
    parsed = lines.withColumn("_json", parse_json(F.col("value")))
    stage = parsed.withColumn("_object", F.coalesce(is_json_object(F.col("value"), F.col("_json")), F.lit(False)))
    is_object = F.col("_object")
    wanted = is_object & filter_equals(F.col("_json"), dict(config.filters))
    if WHOLE_LINE in targets:
        wanted = wanted | ~is_object
    names = {name: f"_target{index}" for index, name in enumerate(targets)}
    rows = stage.select(
        "line",
        F.col("file").alias("source_file"),
        F.when(is_object, field(F.col("_json"), config.id)).alias("record_id"),
        wanted.alias("_wanted"),
        *[
            (F.col("value") if name == WHOLE_LINE else F.when(is_object, field(F.col("_json"), name))).alias(column)
            for name, column in names.items()
        ],
    )
    return fan_out_targets(rows, {name: F.col(column) for name, column in names.items()}, wanted=F.col("_wanted"))


def read_jsonl_records(spark: SparkSession, paths: str | Sequence[str], config: InputConfig, **options) -> DataFrame:
    """Records of JSON lines files."""
    return jsonl_records(read_lines(spark, paths, **options), config)
