"""Named tables whose versions replace one another as a whole.

A version is written to a folder of its own; then one line in the manifest, itself a file that appears at once or
not at all, makes it the newest.  Readers follow the newest line, so a save that dies is never seen and the
version before it stays.  Folders without a line, and older versions, are left for the folder's owner to clear.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

MANIFEST = T.StructType([
    T.StructField("name", T.StringType()), T.StructField("number", T.LongType()), T.StructField("path", T.StringType()), T.StructField("note", T.StringType()),
])


def entries(spark: SparkSession, folder: str) -> DataFrame:
    """The newest entry of each name; of two with one number the later path by name."""
    lines = _read(spark, f"{folder}/manifest", MANIFEST)
    if lines is None:
        return spark.createDataFrame([], MANIFEST)
    return lines.groupBy("name").agg(F.max(F.struct("number", "path", "note")).alias("last")).select("name", "last.*")


def _read(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame | None:
    try:
        return spark.read.schema(schema).json(path)
    except AnalysisException as problem:
        if problem.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def new_version(folder: str) -> str:
    """A folder for a version that is written by the caller."""
    return f"{folder}/version-{uuid.uuid4().hex}"


def publish(spark: SparkSession, folder: str, name: str, path: str, note: str = "") -> None:
    """Make a completely written version the newest of its name."""
    last = entries(spark, folder).filter(F.col("name") == name).first()
    line = [(name, last["number"] + 1 if last else 1, path.removeprefix(f"{folder}/"), note)]
    spark.createDataFrame(line, MANIFEST).coalesce(1).write.mode("append").json(f"{folder}/manifest")


def save_version(frame: DataFrame, folder: str, name: str) -> None:
    """Write a table as the newest version of a name."""
    path = new_version(folder)
    frame.write.parquet(path)
    publish(frame.sparkSession, folder, name, path)


def load_version(spark: SparkSession, folder: str, name: str, schema: T.StructType) -> DataFrame:
    """The newest version of a name, without rows if there is none."""
    last = entries(spark, folder).filter(F.col("name") == name).first()
    if last is None:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{folder}/{last['path']}")
