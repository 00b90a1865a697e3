"""JSON documents that are larger than a task: cut at the members of a container, without reading the document as a whole.

A first pass looks at every block of the file for both cases, that it starts within a string and that it does not: whether the case is another
behind it, how much deeper the brackets are there, and how many commas lie at which depth.  Sums over the blocks of a file then
tell for each block where it stands.  In a second pass a member belongs to the block in which it starts, and its place in an array is the
number of commas before.  Members that are still too large are containers to be cut in the next round.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from siftline.session import stored
from siftline.sources.documents import expand_json_document
from siftline.sources.stores import open_file

#: Bytes of a block, of a member that is given as one, and read at a time behind a block; blocks of a task.
BLOCK = 8 << 20
MOST = 64 << 20
MORE = 1 << 20
BLOCKS_A_TASK = 4

_RANGE = "file string, prefix string, low bigint, high bigint"
_KEY = re.compile(rb'\s*("(?:[^"\\]|\\.)*+")\s*:', re.DOTALL)
_BLANK = b" \t\r\n"


def structure(data: bytes, inside: bool, escaped: bool) -> tuple[np.ndarray, np.ndarray, bool]:
    """Depth behind each byte, relative to the start, which bytes are commas between members, and whether the end lies in a string.

    ``inside`` tells that the start lies in a string, ``escaped`` that an odd number of backslashes stands before it.
    """
    raw = np.frombuffer(data, np.uint8)
    flips = _quotes(raw, escaped).view(np.uint8)
    string = (np.bitwise_xor.accumulate(flips) if len(raw) else flips) ^ np.uint8(inside)
    free = (string | flips) == 0
    steps = (free & ((raw == 91) | (raw == 123))).astype(np.int8) - (free & ((raw == 93) | (raw == 125)))
    return np.cumsum(steps, dtype=np.int64), free & (raw == 44), bool(string[-1]) if len(raw) else inside


def _quotes(raw: np.ndarray, escaped: bool) -> np.ndarray:
    """Which bytes are quotes without an odd number of backslashes before them."""
    quote = raw == 34
    if len(raw) and escaped:
        quote[0] = False
    slash = np.flatnonzero(raw == 92)
    if len(slash):
        new = np.append(True, np.diff(slash) > 1)
        first = np.maximum.accumulate(np.where(new, slash, 0))
        odd = (slash - first + 1 + (escaped & (first == 0))) % 2 == 1
        behind = slash[odd & (slash + 1 < len(raw))] + 1
        quote[behind] = False
    return quote


def _escaped(file, start: int, low: int) -> bool:
    """Whether an odd number of backslashes stands before a place."""
    count, at = 0, start
    while at > low:
        file.seek(max(low, at - 64))
        part = file.read(at - max(low, at - 64))
        count += len(part) - len(part.rstrip(b"\\"))
        if part.rstrip(b"\\"):
            break
        at -= len(part)
    return count % 2 == 1


def _counted(path: str, low: int, start: int, stop: int) -> list:
    """What a block does to depth and strings, and its commas by depth, for both cases."""
    with open_file(path) as file:
        escaped = _escaped(file, start, low)
        file.seek(start)
        data = file.read(stop - start)
    out: list = []
    for inside in (False, True):
        depth, comma, after = structure(data, inside, escaped)
        levels, numbers = np.unique(depth[comma], return_counts=True)
        out += [bool(after != inside), int(depth[-1]) if len(depth) else 0, levels.tolist(), numbers.tolist()]
    return out


def members_of_block(path: str, low: int, high: int, start: int, stop: int, inside: bool, depth: int, most: int) -> tuple[list, int | None]:
    """(number in the block, first byte, end or None, bytes or None) of the members that start in a block, and where the first end lies.

    The number counts the commas of the container in the block up to the member.  A member of more than ``most`` bytes has no bytes
    here, and no end if that lies in another block.
    """
    found: list = []
    begin = number = first_end = None
    commas = 0
    with open_file(path) as file:
        escaped = _escaped(file, start, low)
        file.seek(start)
        at, pieces = start, []
        while at < high:
            data = file.read((stop - start) if at == start else min(MORE, high - at))
            if not data:
                break
            levels, comma, inside = structure(data, inside, escaped)
            escaped = (len(data) - len(data.rstrip(b"\\"))) % 2 == 1
            levels = levels + depth
            before = np.concatenate([[depth], levels[:-1]])
            depth = int(levels[-1])
            marks = np.flatnonzero((comma & (levels == 1)) | ((before == 0) & (levels == 1)) | ((before == 1) & (levels == 0)))
            cut = 0
            for mark in marks.tolist():
                ends = before[mark] == 1
                if ends and first_end is None and at == start:
                    first_end = at + mark
                if ends and begin is not None:
                    pieces.append(data[cut:mark])
                    size = at + mark - begin
                    found.append((number, begin, at + mark, b"".join(pieces) if size <= most else None))
                    begin = None
                if at > start:
                    return found, first_end
                opens = levels[mark] == 1
                commas += bool(ends and opens)
                begin, number, pieces, cut = (at + mark + 1, commas, [], mark + 1) if opens else (None, None, [], 0)
            if begin is None:
                break
            pieces.append(data[cut:])
            at += len(data)
            if at - begin > most:
                found.append((number, begin, None, None))
                break
    return found, first_end


def _split(spark: SparkSession, ranges: DataFrame, block: int, most: int) -> tuple[DataFrame, DataFrame]:
    """The members of containers that lie in ranges of files: (file, path, document), and those too large as ranges of their own."""
    blocks = stored(ranges.withColumn("start", F.explode(F.sequence("low", F.col("high") - 1, F.lit(block).cast("bigint")))).withColumn(
        "stop", F.least(F.col("start") + block, "high"),
    ))
    tasks = max(1, -(-blocks.count() // BLOCKS_A_TASK), min(blocks.count(), spark.sparkContext.defaultParallelism))
    state = "odd{0} boolean, net{0} bigint, levels{0} array<bigint>, commas{0} array<bigint>"
    kinds = [pa.bool_(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())] * 2
    names = [f"{name}{case}" for case in (0, 1) for name in ("odd", "net", "levels", "commas")]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [_counted(*row) for row in zip(*(batch.column(c).to_pylist() for c in ("file", "low", "start", "stop")), strict=True)]
            arrays = [pa.array([row[k] for row in rows], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *arrays], [*batch.schema.names, *names])

    shape = f"{_RANGE}, start bigint, stop bigint"
    counted = stored(blocks.repartition(tasks, "file", "low", "start").mapInArrow(count, f"{shape}, {state.format(0)}, {state.format(1)}"))
    earlier = Window.partitionBy("file", "low").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)

    def sum_before(value):
        return F.coalesce(F.sum(value).over(earlier), F.lit(0))

    # A quote that opens or closes does so in both cases, so strings depend on the number of odd blocks before.
    placed = counted.withColumn("inside", sum_before(F.col("odd0").cast("int")) % 2 == 1)
    picked = {name: F.when(F.col("inside"), F.col(f"{name}1")).otherwise(F.col(f"{name}0")) for name in ("net", "levels", "commas")}
    placed = placed.withColumns(picked).withColumn("depth", sum_before(F.col("net")).cast("bigint"))
    own = F.get("commas", F.array_position("levels", 1 - F.col("depth")).cast("int") - 1)
    placed = placed.withColumn("own", F.coalesce(own, F.lit(0))).withColumn("before", sum_before(F.col("own")).cast("bigint"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("file", "prefix", "low", "high", "start", "stop", "inside", "depth", "before")), strict=True)
            for file, prefix, low, high, start, stop, inside, depth, before in rows:
                with open_file(file) as opened:
                    opened.seek(low)
                    head = opened.read(1)
                found, first_end = members_of_block(file, low, high, start, stop, inside, depth, most)
                out = [_member(file, prefix, head, before, *item) for item in found]
                out.append((prefix, None, None, first_end, None))
                columns = list(zip(*out, strict=True))
                parts = [pa.array(c, kind) for c, kind in zip(columns, (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.bool_()), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.repeat(file, len(out)), pa.repeat(low, len(out)), *parts], ["file", "low", "path", "document", "begin", "end", "large"],
                )

    inputs = placed.select("file", "prefix", "low", "high", "start", "stop", "inside", "depth", "before").repartition(tasks, "file", "low", "start")
    found = stored(inputs.mapInArrow(
        read, "file string, low bigint, path string, document string, begin bigint, end bigint, large boolean",
    ))
    members = found.filter("document IS NOT NULL").select("file", "path", "document")
    # The end of a large member is the first end that a later block has.
    later = Window.partitionBy("file", "low").orderBy(F.coalesce("begin", "end")).rowsBetween(1, Window.unboundedFollowing)
    places = found.filter("large OR (large IS NULL AND end IS NOT NULL)").withColumn(
        "high", F.coalesce("end", F.first(F.when(F.col("large").isNull(), F.col("end")), ignorenulls=True).over(later)),
    )
    large = places.filter("large").select("file", F.col("path").alias("prefix"), F.col("begin").alias("low"), "high")
    return members, large


def _member(file: str, prefix: str, head: bytes, before: int, number: int, begin: int, end: int | None, text: bytes | None) -> tuple:
    """(path, document, first byte of the value, end, large) of a member; all but the path is None for one that is blank."""
    if text is None:
        with open_file(file) as opened:
            opened.seek(begin)
            start = opened.read(MORE)
    else:
        start = text
    path, skipped = f"{prefix}[{before + number}]", 0
    if head == b"{" and (key := _KEY.match(start)):
        path, skipped = f"{prefix}.{json.loads(key[1])}", key.end()
    value = start[skipped:]
    skipped += len(value) - len(value.lstrip(_BLANK))
    if text is not None:
        shown = value.strip(_BLANK).decode("utf-8", "replace")
        if not shown and before + number == 0:
            # An empty container is a leaf.
            return prefix, "[]" if head == b"[" else "{}", None, None, False
        return (path, shown, None, None, False) if shown else (path, None, None, None, False)
    return path, None, begin + skipped, end, True


def first_bytes(files: DataFrame) -> DataFrame:
    """(file, prefix, low, high) of files (path, length) whose first byte that is not blank opens a container."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, length in zip(batch.column("path").to_pylist(), batch.column("length").to_pylist(), strict=True):
                with open_file(path) as file:
                    head = file.read(MORE)
                low = len(head) - len(head.lstrip(_BLANK))
                if head[low : low + 1] in (b"[", b"{"):
                    rows.append((path, "$", low, length))
            columns = list(zip(*rows, strict=True)) or [()] * 4
            parts = [pa.array(c, kind) for c, kind in zip(columns, (pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)]
            yield pa.RecordBatch.from_arrays(parts, [part.split()[0] for part in _RANGE.split(", ")])

    return files.select("path", "length").mapInArrow(look, _RANGE)


def large_json_leaves(spark: SparkSession, files: DataFrame, block: int = BLOCK, most: int = MOST, depth: int | None = None) -> DataFrame:
    """(file, path, value) of every leaf of files (path, length) that hold one JSON container each, however large.

    Memory is bounded by a block and ``most``, the bytes of a member that is opened as one.  A single string or number
    beyond that is left out with its path alone known.  Of equal keys in a container that is cut all are given; a member that is no
    JSON gives no rows.
    """
    ranges, members = stored(first_bytes(files)), None
    while not ranges.isEmpty():
        some, large = _split(spark, ranges, block, most)
        members = some if members is None else members.unionByName(some)
        ranges = stored(_containers(large))
    if members is None:
        return spark.createDataFrame([], "file string, path string, value string")
    leaves = expand_json_document(members.withColumnRenamed("path", "prefix"), "document", depth)
    return leaves.select("file", F.concat("prefix", F.expr("substring(path, 2)")).alias("path"), "value")


def _containers(ranges: DataFrame) -> DataFrame:
    """Ranges that start with a bracket."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for path, low in zip(batch.column("file").to_pylist(), batch.column("low").to_pylist(), strict=True):
                with open_file(path) as file:
                    file.seek(low)
                    kept.append(file.read(1) in (b"[", b"{"))
            yield batch.filter(pa.array(kept, pa.bool_()))

    return ranges.mapInArrow(look, _RANGE)
