"""Networks as pieces of the address space, so that an address finds its longest network by its place.

Networks lie in one another or apart.  A sweep over their borders with a stack of the open ones gives pieces that do not
overlap, each with the value of the longest network that holds it.  The pieces are kept in two tables of
short sorted arrays: one row for 65,536 addresses, in steps of 256, and one for each 256 addresses that are divided further.  An address
meets at most one row of each, so looking it up is two plain joins on the findings as they come, without an aggregate: the same in
batch and on a stream.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from siftline.functions.skew import fits_broadcast
from siftline.session import stored

#: Networks shorter than this hold several rows of the coarse table.
COARSE = 16


def address_number(address: Column) -> Column:
    """A dotted quad as a number, NULL for any other text."""
    parts = F.split(address, r"\.")
    quad = F.rlike(address, F.lit(r"\A[0-9]{1,3}(?:\.[0-9]{1,3}){3}\z"))
    number = F.lit(0).cast("bigint")
    for index in range(4):
        number = number * 256 + F.get(parts, F.lit(index)).try_cast("bigint")
    valid = F.forall(parts, lambda part: part.try_cast("int") <= 255)
    return F.when(quad & valid, number)


def parsed_networks(networks: DataFrame, key: str, value: str) -> DataFrame:
    """(base, size, value) of networks written as ``10.0.0.0/8``; of equal ones the smallest value, other texts are left out."""
    size = F.coalesce(F.get(F.split("text", "/"), F.lit(1)).try_cast("int"), F.lit(32))
    rows = networks.select(F.col(key).cast("string").alias("text"), F.col(value).cast("string").alias("value")).select(
        address_number(F.get(F.split("text", "/"), F.lit(0))).alias("base"), size.alias("size"), "value",
    ).filter("base IS NOT NULL AND size BETWEEN 0 AND 32")
    first = F.call_function("shiftright", F.col("base"), 32 - F.col("size"))
    whole = rows.withColumn("base", F.call_function("shiftleft", first, 32 - F.col("size")))
    return whole.groupBy("base", "size").agg(F.min("value").alias("value"))


def pieces(networks: list[tuple[int, int, str]], end: int) -> list[tuple[int, str | None]]:
    """(low, value) of the pieces of 0 to ``end``, from (low, high, value) of networks that lie in one another or apart."""
    cuts: list[tuple[int, str | None]] = [(0, None)]
    open_: list[tuple[int, str]] = []

    def cut(low: int, value: str | None) -> None:
        if cuts[-1][0] == low:
            cuts.pop()
        cuts.append((low, value))

    for low, high, value in sorted(networks, key=lambda net: (net[0], -net[1])):
        while open_ and open_[-1][0] <= low:
            closed, _ = open_.pop()
            cut(closed, open_[-1][1] if open_ else None)
        cut(low, value)
        open_.append((high, value))
    while open_:
        closed, _ = open_.pop()
        if closed < end:
            cut(closed, open_[-1][1] if open_ else None)
    return cuts


def _rows(bucket: int, cuts: list[tuple[int, str | None]]) -> list[tuple[bool, int, list[int], list[str | None]]]:
    """(fine, key, lows, values): the coarse row of a bucket and a row for each divided 256 addresses."""
    coarse: dict[int, str | None] = {}
    fine: dict[int, list[tuple[int, str | None]]] = {}
    now = None
    for low, value in cuts:
        block, place = divmod(low, 256)
        if place:
            fine.setdefault(block, [(0, now)]).append((place, value))
            coarse[block + 1] = value
        else:
            coarse[block] = value
        now = value
    out = [(False, bucket, sorted(coarse), [coarse[block] for block in sorted(coarse)])]
    return out + [(True, bucket * 256 + block, [low for low, _ in row], [value for _, value in row]) for block, row in fine.items()]


def network_table(networks: DataFrame, key: str = "key", value: str = "value") -> DataFrame:
    """(fine, key, lows, values): the pieces of all networks, stored.

    A task sweeps the networks of 65,536 addresses, of which there are at most 131,071; shorter networks come as one
    value for each such range, the longest one's.
    """
    parsed = parsed_networks(networks, key, value)
    bucket = F.call_function("shiftright", F.col("base"), F.lit(16))
    ranges = F.sequence(bucket, bucket + F.call_function("shiftleft", F.lit(1).cast("bigint"), COARSE - F.col("size")) - 1)
    wide = parsed.filter(F.col("size") < COARSE).select(F.explode(ranges).alias("bucket"), "size", "value").groupBy("bucket").agg(
        F.max_by("value", "size").alias("value"),
    ).select("bucket", F.lit(0).cast("bigint").alias("low"), F.lit(1 << 16).cast("bigint").alias("high"), "value", F.lit(COARSE - 1).alias("size"))
    low = F.col("base").bitwiseAND(F.lit(0xFFFF).cast("bigint"))
    near = parsed.filter(F.col("size") >= COARSE).select(
        bucket.alias("bucket"), low.alias("low"), (low + F.call_function("shiftleft", F.lit(1).cast("bigint"), 32 - F.col("size"))).alias("high"), "value", "size",
    )

    def swept(found: pa.Table) -> pa.Table:
        # By size, so that of networks with equal borders the longer one comes last and wins.
        found = found.sort_by("size")
        nets = list(zip(*(found.column(c).to_pylist() for c in ("low", "high", "value")), strict=True))
        rows = _rows(found.column("bucket")[0].as_py(), pieces(nets, 1 << 16))
        kinds = (pa.bool_(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.string()))
        return pa.table([pa.array([row[k] for row in rows], kind) for k, kind in enumerate(kinds)], ["fine", "key", "lows", "values"])

    swept_rows = wide.union(near).groupBy("bucket").applyInArrow(swept, "fine boolean, key bigint, lows array<bigint>, values array<string>")
    return stored(swept_rows)


def with_network(rows: DataFrame, address: str, networks: DataFrame, found: str, max_rows: int) -> DataFrame:
    """Every row with the value of the longest network that holds its address, NULL where none does.

    ``networks`` is a ``network_table``; it is broadcast if it is small by count and size.
    """
    def part(fine: bool, key: str) -> DataFrame:
        picked = networks.filter(F.col("fine") if fine else ~F.col("fine")).select(
            F.col("key").alias(key), F.col("lows").alias(f"{key}_lows"), F.col("values").alias(f"{key}_values"),
        )
        return F.broadcast(picked) if fits_broadcast(picked, max_rows) else picked

    def value(key: str, place: Column) -> Column:
        return F.get(F.col(f"{key}_values"), F.size(F.filter(f"{key}_lows", lambda low: low <= place)) - 1)

    number = address_number(F.col(address))
    numbered = rows.withColumn("_number", number).withColumns({
        "_block": F.call_function("shiftright", F.col("_number"), F.lit(16)), "_cell": F.call_function("shiftright", F.col("_number"), F.lit(8)),
    })
    joined = numbered.join(part(False, "_coarse"), F.col("_block") == F.col("_coarse"), "left")
    joined = joined.join(part(True, "_fine"), F.col("_cell") == F.col("_fine"), "left")
    low = F.lit(255).cast("bigint")
    held = F.when(F.col("_fine").isNotNull(), value("_fine", F.col("_number").bitwiseAND(low))).otherwise(
        value("_coarse", F.col("_cell").bitwiseAND(low)),
    )
    return joined.withColumn(found, held).drop("_number", "_block", "_cell", *[f"{key}{end}" for key in ("_coarse", "_fine") for end in ("", "_lows", "_values")])
