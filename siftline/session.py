"""Session settings the package relies on, and tables kept to cut lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: Whether shuffle files go at the end of the query that wrote them; nothing reads those of a table that has been written.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def configure(spark: SparkSession) -> SparkSession:
    """Settings that answers rest on.

    The last of several equal JSON keys wins.  Files are cut into the same blocks however many
    executors are up, for line numbers join two passes over them.
    """
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    if spark.conf.get("spark.sql.files.minPartitionNum", None) is None:
        spark.conf.set("spark.sql.files.minPartitionNum", str(spark.sparkContext.defaultParallelism))
    return spark


def build_session(master: str, app: str = "siftline", **settings: str) -> SparkSession:
    """A session for tests and benchmarks; clusters bring their own."""
    cores = master[6:-1] if master.startswith("local[") else ""
    builder = (
        SparkSession.builder.master(master).appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC")
    )
    if cores.isdigit():
        builder = builder.config("spark.sql.shuffle.partitions", cores)
    for name, value in settings.items():
        builder = builder.config(name, value)
    return configure(builder.getOrCreate())


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; only a local session gets one of its own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors can reach")
    if context.applicationId not in _local_folders:
        _local_folders[context.applicationId] = tempfile.mkdtemp(prefix="siftline-")
    return _local_folders[context.applicationId]


_local_folders: dict[str, str] = {}


class Passing:
    """The tables that were stored in a block, with their folders."""

    def __init__(self) -> None:
        self.tables: list[tuple[DataFrame, str]] = []
        self.outer: Passing | None = None

    def keep(self, frame: DataFrame) -> DataFrame:
        """A stored table, which now stays to the end of the block around this one, or for good."""
        for own in self._taken(frame):
            if self.outer is not None:
                self.outer.tables.append(own)
        return frame

    def drop(self, frame: DataFrame) -> None:
        """Removes a stored table that nothing reads any more."""
        for own, path in self._taken(frame):
            _removed(own.sparkSession, path)

    def _taken(self, frame: DataFrame) -> list[tuple[DataFrame, str]]:
        taken = [own for own in self.tables if own[0] is frame]
        self.tables = [own for own in self.tables if own[0] is not frame]
        return taken


_passing: ContextVar[Passing | None] = ContextVar("passing", default=None)


@contextmanager
def passing_tables() -> Iterator[Passing]:
    """A block whose stored tables are removed at its end, but for those that ``keep`` was called for.

    What leaves the block must be read from kept tables alone.
    """
    scope = Passing()
    scope.outer = _passing.get()
    token = _passing.set(scope)
    try:
        yield scope
    finally:
        _passing.reset(token)
        for own, path in scope.tables:
            _removed(own.sparkSession, path)


def _removed(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(folder, True)


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of queries that begin here go when these end, not when the driver happens to collect its garbage."""
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(SHUFFLE_CLEANUP)
        else:
            spark.conf.set(SHUFFLE_CLEANUP, before)


def stored(frame: DataFrame) -> DataFrame:
    """The DataFrame written once, as a table in the shared folder, and read back.

    What builds on it reads the table, so it is computed a single time and survives lost executors.
    """
    spark = frame.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    with shuffles_removed(spark):
        frame.write.parquet(path)
    table = spark.read.schema(frame.schema).parquet(path)
    scope = _passing.get()
    if scope is not None:
        scope.tables.append((table, path))
    return table


def stored_by(frame: DataFrame, column: str) -> str:
    """The folder of a table in the shared folder that has a folder of its own for each value of a column."""
    path = f"{shared_folder(frame.sparkSession)}/table-{uuid.uuid4().hex}"
    frame.repartition(column).write.partitionBy(column).parquet(path)
    return path
