"""Helpers of the corpus operators: tables, texts as byte arrays, rolling hashes."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.session import configure, stored

#: Odd multipliers of the rolling hash and of the mixer.
BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INVERSE = pow(int(BASE), -1, 2**64)
MIX_1 = np.uint64(0xBF58476D1CE4E5B9)
MIX_2 = np.uint64(0x94D049BB133111EB)

#: Rows and bytes of an Arrow batch, which is held a few times over by a task and its Python worker.
BATCH_ROWS = 4000
BATCH_BYTES = 8 << 20

#: Bytes of text that are worked on at once; a longer text is a slab of its own.
SLAB = 2_000_000

#: Lower-cases A-Z and turns the bytes 09-0D into blanks.
SPACED = bytes(32 if 9 <= b <= 13 else b + 32 if 65 <= b <= 90 else b for b in range(256))


def tuned(spark: SparkSession) -> SparkSession:
    """File splits pinned, so that every scan cuts a table alike, and small Arrow batches."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return configure(spark)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table."""
    return tuned(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def few_files(frame: DataFrame) -> DataFrame:
    """The rows of a narrow table that was shuffled, in no more partitions than there are cores: fewer small files."""
    return frame.coalesce(frame.sparkSession.sparkContext.defaultParallelism)


def saved(frame: DataFrame) -> DataFrame:
    """A narrow table that was shuffled, written once to the shared folder and read back."""
    return stored(few_files(frame))


def run_number() -> int:
    """A number that no other run of a function over a partition has; of several attempts one is kept."""
    return uuid.uuid4().int >> 66


def numbered(frame: DataFrame, **columns: str) -> DataFrame:
    """The named columns and ``uid``, a number of the row.

    The number rests on the file splits, so ``frame`` must come straight from stored files or from
    the driver, not from a shuffle; ``columns`` maps new names to those of ``frame``.
    """
    tuned(frame.sparkSession)
    return frame.select(
        F.monotonically_increasing_id().alias("uid"), *[F.col(f"`{old}`").alias(new) for new, old in columns.items()],
    )


def slabs(texts: pa.Array, limit: int = SLAB) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows as (first row, end row, their bytes, offsets of the rows in them); null is empty."""
    filled = pc.fill_null(texts.cast(pa.large_binary()), b"")
    if isinstance(filled, pa.ChunkedArray):
        filled = filled.combine_chunks()
    n = len(filled)
    _, offsets, data = filled.buffers()
    at = np.frombuffer(offsets, np.int64)[filled.offset : filled.offset + n + 1] if n else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        end = max(first + 1, int(np.searchsorted(at, at[first] + limit, "right")) - 1)
        yield first, end, raw[at[first] : at[end]], at[first : end + 1] - at[first]
        first = end


def mixed(x: np.ndarray) -> np.ndarray:
    """Well spread 64-bit numbers."""
    x = x ^ (x >> np.uint64(30))
    x = x * MIX_1
    x ^= x >> np.uint64(27)
    x *= MIX_2
    x ^= x >> np.uint64(31)
    return x


_tables: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """``base`` to the power of 0..n-1, modulo 2**64; kept for the next slab."""
    have = _tables.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, SLAB + 1), base, np.uint64)
        have[0] = 1
        have = np.cumprod(have, dtype=np.uint64)
        if n <= 3 * SLAB:
            _tables[base] = have
    return have[:n]


class Rolling:
    """Polynomial hashes of any spans of a byte array, modulo 2**64."""

    def __init__(self, data: np.ndarray) -> None:
        n = len(data)
        self.inverse = powers(BASE_INVERSE, n + 1)
        self.prefix = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(int(BASE), n + 1)[:n], out=self.prefix[1:])

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """A number for each span; equal bytes give equal numbers wherever they stand."""
        return (self.prefix[end] - self.prefix[start]) * self.inverse[start]


def word_spans(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each word of a slab; words are runs without 20 and 09-0D."""
    word = ~((data == 32) | ((data >= 9) & (data <= 13)))
    edge = np.zeros(len(data) + 1, bool)
    edge[at] = True
    before = np.concatenate([[False], word[:-1]]) if len(data) else word
    starts = np.flatnonzero(word & (~before | edge[:-1]))
    after = np.concatenate([word[1:], [False]]) if len(data) else word
    ends = np.flatnonzero(word & (~after | edge[1:])) + 1
    rows = np.repeat(np.arange(len(at) - 1), np.diff(np.searchsorted(starts, at)))
    return starts, ends, rows


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case."""
    return np.frombuffer(data.tobytes().translate(SPACED), np.uint8)
