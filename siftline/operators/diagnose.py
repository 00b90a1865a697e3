"""Why lines do or do not give findings: one row per verdict of every stage."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F

from siftline.functions.fields import field, is_json_object, parse_json, filter_equals
from siftline.functions.text import unescape
from siftline.model import WHOLE_LINE, InputConfig
from siftline.operators.patterns import Pattern
from siftline.operators.scan import hit_columns
from siftline.session import configure
from siftline.sources.csv import Grammar
from siftline.sources.prepare import transform_fields

VERDICT = "struct<stage:string,subject:string,outcome:string,detail:string>"


def _verdict(stage: str, subject: Column | str, outcome: Column | str, detail: Column | str = "") -> Column:
    def text(part):
        return F.lit(part) if isinstance(part, str) else part

    return F.struct(
        F.lit(stage).alias("stage"), text(subject).alias("subject"),
        text(outcome).alias("outcome"), F.coalesce(text(detail).cast("string"), F.lit("")).alias("detail"),
    )


def diagnose(lines: DataFrame, patterns: Iterable[Pattern], config: InputConfig) -> DataFrame:
    """(file, line, stage, subject, outcome, detail) for lines (``value``, ``file``, ``line``).

    Stages are ``parse`` (ok, failed, empty), ``filter`` (pass, fail, missing, with the value
    found), ``target`` (found, missing), ``decode`` (with the lengths in bytes before and after),
    ``transform`` (done) and ``pattern`` (hit, with the number of matches).  Targets are looked at
    only if all filters pass.  Patterns run exactly as in ``scan``, flags included.

    For CSV every line is taken as a row: the detail of ``parse`` is the number of cells, targets
    are cell numbers, and a line that leaves a cell open has failed.  As in the reader, the first row
    of a file sets the number of cells: it is the ``header`` if there is one, and rows of another
    number are ``ragged``; neither has targets.
    """
    configure(lines.sparkSession)
    patterns = list(patterns)
    if config.format == "csv":
        return _diagnose_csv(lines, patterns, config)
    text_only = config.format == "text"
    targets = [WHOLE_LINE] if text_only else list(config.target_names())
    stage = lines.withColumn("_json", parse_json(F.col("value")))
    stage = stage.withColumn("_object", F.coalesce(is_json_object(F.col("value"), F.col("_json")), F.lit(False)))
    is_object = F.col("_object")
    filters = {} if text_only else dict(config.filters)
    stage = stage.withColumn("_passed", ~is_object | filter_equals(F.col("_json"), filters))

    # One content column per target, before and after decoding and transforms.
    for index, target in enumerate(targets):
        raw = F.col("value") if target == WHOLE_LINE else F.when(is_object, field(F.col("_json"), target))
        stage = stage.withColumn(f"_raw{index}", F.when(F.col("_passed") & (F.col("value") != ""), raw))
        decoded = unescape(F.col(f"_raw{index}")) if config.decode else F.col(f"_raw{index}")
        stage = stage.withColumn(f"_decoded{index}", decoded)
        ready = stage.withColumns({"content": F.col(f"_decoded{index}"), "target": F.lit(target)})
        if config.transforms:
            ready = transform_fields(ready, config.transforms)
        stage = ready.withColumn(f"_ready{index}", F.col("content")).drop("content", "target")

    parsed = F.when(F.col("value") == "", "empty").when(is_object, "ok").otherwise("failed")
    verdicts = [] if text_only else [_verdict("parse", "", parsed)]
    for index, (path, text) in enumerate(filters.items()):
        stage = stage.withColumn(f"_filter{index}", field(F.col("_json"), path))
        value = F.col(f"_filter{index}")
        outcome = F.when(value.isNull(), "missing").when(value == F.lit(text), "pass").otherwise("fail")
        verdicts.append(F.when(is_object, _verdict("filter", path, outcome, value)))
    looked = F.col("_passed") & (F.col("value") != "")
    for index, target in enumerate(targets):
        raw, decoded, ready = (F.col(f"_{name}{index}") for name in ("raw", "decoded", "ready"))
        verdicts.append(F.when(looked, _verdict("target", target, F.when(raw.isNotNull(), "found").otherwise("missing"))))
        if config.decode:
            lengths = F.concat_ws(" -> ", F.octet_length(raw).cast("string"), F.octet_length(decoded).cast("string"))
            verdicts.append(F.when(raw.isNotNull(), _verdict("decode", target, "done", lengths)))
        if target in config.transforms or WHOLE_LINE in config.transforms:
            verdicts.append(F.when(raw.isNotNull(), _verdict("transform", target, "done")))
    fixed = F.filter(F.array(*verdicts).cast(f"array<{VERDICT}>"), lambda verdict: verdict.isNotNull())
    hits = []
    for index in range(len(targets)):
        columns, counts = hit_columns(F.col(f"_ready{index}"), patterns, f"_hits{index}_")
        stage = stage.withColumns(columns) if columns else stage
        hits.append(_hit_verdicts(counts))
    every = F.concat(fixed, *[F.coalesce(found, F.array().cast(f"array<{VERDICT}>")) for found in hits])
    return stage.select("file", "line", F.explode(every).alias("_verdict")).select("file", "line", "_verdict.*")


def _hit_verdicts(counts: Column) -> Column:
    return F.transform(
        F.filter(counts, lambda count: count["hits"] > 0),
        lambda count: F.struct(
            F.lit("pattern").alias("stage"), count["pattern"].alias("subject"),
            F.lit("hit").alias("outcome"), count["hits"].cast("string").alias("detail"),
        ),
    ).cast(f"array<{VERDICT}>")


def _diagnose_csv(lines: DataFrame, patterns: list[Pattern], config: InputConfig) -> DataFrame:
    """One row for the line and one per wanted cell, each of which gives its verdicts."""
    grammar, layout, value = Grammar((config.csv.separator or ",")[0]), config.csv, F.col("value")
    stage = lines.withColumn("_ok", (value != "") & grammar.complete(value))
    stage = stage.withColumn("_cells", F.when(F.col("_ok"), grammar.cells(value)))
    # One row per file.
    heads = stage.filter("_ok").groupBy("file").agg(F.min(F.struct("line", F.size("_cells").alias("width"))).alias("_head"))
    stage = stage.join(heads, "file", "left")
    header = F.lit(layout.has_header) & (F.col("line") == F.col("_head.line"))
    ragged = F.size("_cells") != F.col("_head.width")
    stage = stage.withColumn("_kind", F.when(value == "", "empty").when(~F.col("_ok"), "failed").when(header, "header")
                             .when(ragged, "ragged").otherwise("ok"))
    wanted = F.array(*[F.lit(index) for index in layout.target_indices]) if layout.target_indices else F.sequence(
        F.lit(0), F.size("_cells") - 1
    )
    cells = F.transform(wanted, lambda index: F.struct(
        index.cast("string").alias("target"), F.get(F.col("_cells"), index).alias("content")
    ))
    line = F.array(F.struct(F.lit(None).cast("string").alias("target"), F.lit(None).cast("string").alias("content")))
    rows = stage.select(
        "file", "line", "_ok", "_kind", F.size("_cells").alias("_width"),
        F.inline(F.when(F.col("_kind") == "ok", F.concat(line, cells)).otherwise(line)),
    ).withColumn("_raw", F.col("content"))
    if config.decode:
        rows = rows.withColumn("content", unescape(F.col("content")))
    rows = rows.withColumn("_decoded", F.col("content"))
    if config.transforms:
        rows = transform_fields(rows, config.transforms)
    columns, counts = hit_columns(F.col("content"), patterns, "_hits")
    rows = rows.withColumns(columns) if columns else rows

    raw, whole = F.col("_raw"), F.col("target").isNull()
    width = F.when(F.col("_ok"), F.col("_width").cast("string"))
    lengths = F.concat_ws(" -> ", F.octet_length(raw).cast("string"), F.octet_length("_decoded").cast("string"))
    target = F.col("target")

    def about(stage_name, outcome, detail=""):
        return _verdict(stage_name, target, outcome, detail)

    verdicts = [
        F.when(whole, _verdict("parse", "", F.col("_kind"), width)),
        F.when(~whole, about("target", F.when(raw.isNotNull(), "found").otherwise("missing"))),
    ]
    if config.decode:
        verdicts.append(F.when(raw.isNotNull(), about("decode", "done", lengths)))
    if config.transforms:
        named = F.lit(WHOLE_LINE in config.transforms) | target.isin(list(config.transforms))
        verdicts.append(F.when(raw.isNotNull() & named, about("transform", "done")))
    fixed = F.filter(F.array(*verdicts).cast(f"array<{VERDICT}>"), lambda verdict: verdict.isNotNull())
    every = F.concat(fixed, _hit_verdicts(counts))
    return rows.select("file", "line", F.explode(every).alias("_verdict")).select("file", "line", "_verdict.*")
