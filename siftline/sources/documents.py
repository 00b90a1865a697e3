"""Whole JSON documents opened into many scannable rows."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from siftline.functions.fields import parse_json
from siftline.session import configure, stored
from siftline.sources.lines import file_label, text_records

#: Bytes of a file that is read as one value.
WHOLE_BYTES = 64 << 20


def json_depth(document: Column) -> Column:
    """How deep the brackets of a JSON text nest, read off the text; 0 for a lone value."""
    brackets = F.regexp_replace(document, r'"(?:[^"\\]++|\\.)*+"|[^\[\]{}"]++', "")
    steps = F.split(F.translate(brackets, "{}", "[]"), "")
    count = F.aggregate(
        steps, F.struct(F.lit(0).alias("now"), F.lit(0).alias("most")),
        lambda at, step: F.struct(
            (at["now"] + F.when(step == "[", 1).when(step == "]", -1).otherwise(0)).alias("now"),
            F.greatest(at["most"], at["now"] + F.when(step == "[", 1).otherwise(0)).alias("most"),
        ),
    )
    return F.coalesce(count["most"], F.lit(0))


def expand_json_document(documents: DataFrame, document: str = "document", depth: int | None = None) -> DataFrame:
    """One row (``path``, ``value``) per leaf of each JSON document; other columns are kept.

    Every level of objects and arrays is opened.  JSON nulls and empty containers are leaves too,
    with NULL, ``{}`` or ``[]``.  Text that is no JSON gives no rows.  Without ``depth`` a pass over
    the documents finds how deep they are; with it, what lies deeper stays one leaf, as compact JSON.
    """
    configure(documents.sparkSession)
    kept = [name for name in documents.columns if name != document]
    if depth is None:
        depth = documents.agg(F.max(json_depth(F.col(document)))).first()[0] or 0
    nodes = documents.select(*kept, F.lit("$").alias("path"), parse_json(F.col(document)).alias("_node"))
    spark = documents.sparkSession
    for _ in range(depth):
        opened = nodes.lateralJoin(spark.tvf.variant_explode_outer(F.col("_node").outer()))
        leaf = F.col("pos").isNull()
        step = F.when(F.col("key").isNotNull(), F.concat(F.lit("."), F.col("key"))).otherwise(
            F.concat(F.lit("["), F.col("pos").cast("string"), F.lit("]"))
        )
        nodes = opened.select(
            *kept,
            F.when(leaf, F.col("path")).otherwise(F.concat("path", step)).alias("path"),
            F.when(leaf, F.col("_node")).otherwise(F.col("value")).alias("_node"),
        )
    nodes = nodes.filter(F.col("_node").isNotNull())
    return nodes.select(*kept, "path", F.try_variant_get("_node", "$", "string").alias("value"))


def leaf_records(documents: DataFrame, depth: int | None = None) -> DataFrame:
    """Records of documents (``document``, ``file``, ``line``): one per leaf, the path as target."""
    return _records_of(expand_json_document(documents, depth=depth))


def _records_of(leaves: DataFrame) -> DataFrame:
    return leaves.filter(F.coalesce("value", F.lit("")) != "").select(
        F.col("value").alias("content"), F.lit("").alias("record_id"), "line", "file",
        F.col("file").alias("source_file"), F.col("path").alias("target"),
    )


def document_records(
    spark: SparkSession, paths: str | Sequence[str], lines: DataFrame, most: int = WHOLE_BYTES,
    cut: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Records of files (``lines`` are theirs, numbered) that hold JSON in any layout, or text.

    Where the first line that is not blank is a JSON value, every line is a document of its own;
    else the whole file is one if it is JSON.  What is no JSON is given as text, line by line.  Files of more than
    ``most`` bytes that begin with a bracket are taken for JSON and opened by ``cut``, which gives (file, path, value) of labelled files.
    """
    blank = F.trim("value") == ""
    first = lines.filter(~blank).groupBy("file").agg(F.min_by(parse_json(F.col("value")).isNotNull(), "line").alias("_by_line"))
    # One row per file; the files that are read whole are documents that fit a task.
    several = first.filter("not _by_line").select("file")
    whole = read_json_documents(spark, paths, most if cut else None).join(several, "file", "left_semi")
    whole = stored(whole.withColumn("_json", parse_json(F.col("document")).isNotNull()))
    known = first.filter("_by_line").select("file", F.lit(True).alias("_by_line"))
    kinds = known.unionByName(whole.filter("_json").select("file", F.lit(False).alias("_by_line")))
    opened = None
    if cut:
        opened = cut(several)
        kinds = kinds.unionByName(opened.select("file").distinct().select("file", F.lit(False).alias("_by_line")))
    placed = lines.join(kinds, "file", "left")
    single = placed.withColumn("_json", F.col("_by_line") & parse_json(F.col("value")).isNotNull())
    documents = single.filter("_json").select(F.col("value").alias("document"), "line", "file").unionByName(
        whole.filter("_json").select("document", "line", "file"),
    )
    text = single.filter((F.col("_by_line").isNull() | F.col("_by_line")) & ~F.coalesce("_json", F.lit(False)))
    records = leaf_records(documents).unionByName(text_records(text))
    return records if opened is None else records.unionByName(_records_of(opened.withColumn("line", F.lit(0).cast("bigint"))))


def read_json_documents(spark: SparkSession, paths: str | Sequence[str], most: int | None = None) -> DataFrame:
    """Files that hold one JSON document each, as (document, file, line); with ``most``, those of no more bytes.

    A document is one value in one row, so it must fit a task; many documents spread over tasks.  ``large_json_leaves`` reads larger ones.
    """
    files = spark.read.text(paths if isinstance(paths, str) else list(paths), wholetext=True, recursiveFileLookup=True)
    if most is not None:
        files = files.filter(F.col("_metadata.file_size") <= most)
    return files.select(
        F.col("value").alias("document"), file_label(F.col("_metadata.file_path")).alias("file"),
        F.lit(0).cast("bigint").alias("line"),
    )
