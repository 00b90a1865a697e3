"""Rewriting fields of JSON lines."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from siftline.functions.fields import field, is_json_object, parse_json
from siftline.functions.text import trim_space
from siftline.session import configure
from siftline.sources.lines import read_lines


def rewrite_fields(
    lines: DataFrame, transforms: Mapping[str, Callable[[Column], Column]], value: str = "value"
) -> DataFrame:
    """Lines with fields replaced by their transformed, trimmed text.

    A field is read by its dotted path and written as a top-level key named by the whole path.
    A field that is missing, or whose transform gives NULL, is left alone.  Lines that are no
    JSON objects pass through.  Keys come out in alphabetical order.
    """
    configure(lines.sparkSession)
    stage = lines.withColumn("_json", parse_json(F.col(value)))
    stage = stage.withColumn("_object", F.coalesce(is_json_object(F.col(value), F.col("_json")), F.lit(False)))
    entries = F.map_entries(F.try_variant_get("_json", "$", "map<string,variant>"))
    changed = []
    for path, transform in transforms.items():
        name = f"_new{len(changed)}"
        stage = stage.withColumn(name, trim_space(transform(field(F.col("_json"), path))))
        changed.append((path, F.col(name)))
    kept = entries
    for path, new in changed:
        kept = F.filter(kept, _unless(path, new))
    added = F.array(*[
        F.when(new.isNotNull(), F.struct(F.lit(path).alias("key"), new.cast("variant").alias("value")))
        for path, new in changed
    ]).cast(_ENTRIES)
    merged = F.concat(kept, F.filter(added, lambda entry: entry.isNotNull()))
    # Variants cannot be sorted, so the keys are, and the map is read back in their order.
    table = F.map_from_entries(merged)
    keys = F.sort_array(F.map_keys(table))
    ordered = F.map_from_arrays(keys, F.transform(keys, lambda key: table[key]))
    # A lone null has no entries and stays as it is.
    written = F.coalesce(F.to_json(ordered), F.trim(value))
    return stage.withColumn(value, F.when(F.col("_object"), written).otherwise(F.col(value))).select(
        *lines.columns
    )


def _unless(path: str, new: Column) -> Callable[[Column], Column]:
    return lambda entry: ~((entry["key"] == path) & new.isNotNull())


_ENTRIES = "array<struct<key:string,value:variant>>"


def rewrite_file(
    spark: SparkSession, paths: str | Sequence[str], target: str, transforms: Mapping[str, Callable[[Column], Column]]
) -> None:
    """Write rewritten copies of JSON lines files to a new folder; the input is never replaced."""
    lines = read_lines(spark, paths, line_numbers=False)
    rewrite_fields(lines, transforms).select("value").write.option("lineSep", "\n").text(target)
