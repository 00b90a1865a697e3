"""Whether a table is small enough to broadcast."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Most text a broadcast table may hold.
BROADCAST_BYTES = 256 << 20


def measure(
    table: DataFrame, max_rows: int, *more: Column, max_bytes: int = BROADCAST_BYTES
) -> tuple[bool, tuple]:
    """Whether a table is small enough to broadcast, and other aggregates, in one pass over it."""
    size = F.lit(0).cast("bigint")
    for name in table.columns:
        size = size + F.coalesce(F.octet_length(F.col(name).cast("string")), F.lit(0))
    rows, held, *others = table.agg(F.count(F.lit(1)), F.sum(size), *more).first()
    return rows <= max_rows and (held or 0) <= max_bytes, tuple(others)


def fits_broadcast(table: DataFrame, max_rows: int, max_bytes: int = BROADCAST_BYTES) -> bool:
    """Whether a table is small enough to broadcast, by one aggregate over it."""
    return measure(table, max_rows, max_bytes=max_bytes)[0]
