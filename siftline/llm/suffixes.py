"""Removal of long repeated strings by a sparse, distributed suffix array.

Only some suffixes are sorted.  Of the ``KERNEL``-byte strings inside every ``length``-byte string the one
with the smallest hash, the leftmost of equal ones, is its *anchor*; equal strings have equal anchors at
equal places, so nothing repeated is lost by sorting the suffixes at anchors alone, about one in 64.

1.  A suffix is described by tokens: its first eight bytes, a hash of its kernel, and a hash of its
    *context*, the bytes of all strings that have this anchor.  Spark samples splitters and range-partitions
    the suffixes by their tokens, place last, so that even a frequent suffix is spread over many buckets.
    Every bucket is sorted by multikey quicksort and neighbours are compared, across bucket borders too.
    Equal contexts are repeated as a whole.  Suffixes whose kernel is unique are done.
2.  What is left are unequal contexts around equal kernels, as at the ends of a shared passage.  Their bytes
    are fetched, range-partitioned by the suffix itself, sorted in the same way, and the strings in runs with
    equal kernels are compared one by one; a run that crosses a border is compared over all its buckets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftline.llm.common import BASE, BASE_INVERSE, MIX_1, MIX_2, SLAB, Rolling, few_files, mixed, powers, run_number, saved, slabs, table, tuned

#: Bytes that a string must have to count as repeated.
LENGTH = 200
#: Kernels in a string of ``LENGTH``; a power of two.
KERNELS = 128
#: Bits that hold a place inside a slab.
PLACE_BITS = 23

_ANCHOR = "lead bigint, kernel bigint, context bigint, uid bigint, place bigint"
_U = np.uint64


def _signed(x: np.ndarray) -> np.ndarray:
    """Unsigned numbers as signed ones in the same order."""
    return (x ^ _U(1 << 63)).view(np.int64)


def anchors(data: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Row, first start, last start, place, first bytes, kernel and context of every anchor of a slab.

    A start is where a string of ``length`` bytes begins; the starts that share an anchor are consecutive.
    """
    size = length - KERNELS + 1
    n = len(data)
    if n < length:
        return (np.zeros(0, np.int64),) * 7
    rolling = Rolling(data)
    count = n - size + 1
    kernel = (rolling.prefix[size:] - rolling.prefix[:count]) * rolling.inverse[:count]
    order = kernel * MIX_1
    order ^= order >> _U(32)
    order *= MIX_2
    order >>= _U(PLACE_BITS)
    order <<= _U(PLACE_BITS)
    order |= np.arange(count, dtype=_U)
    # Minimum over KERNELS neighbours by doubling.
    step = 1
    while step < KERNELS:
        order = np.minimum(order[:-step], order[step:])
        step *= 2
    place = (order & _U((1 << PLACE_BITS) - 1)).astype(np.int64)
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))[: len(place)]
    starts = np.flatnonzero(np.arange(len(place)) + length <= at[1:][row])
    if not len(starts):
        return (np.zeros(0, np.int64),) * 7
    place, row = place[starts], row[starts]
    new = np.ones(len(starts), bool)
    new[1:] = (place[1:] != place[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(starts)) - 1
    low, high, place, row = starts[first], starts[last], place[first], row[first]
    lead = np.ascontiguousarray(data[place[:, None] + np.arange(8)]).view(">u8").ravel().astype(_U)
    context = rolling.spans(low, high + length) ^ mixed((place - low).astype(_U) << _U(32) | (high - low).astype(_U))
    return row, low, high, place, _signed(lead), kernel[place].view(np.int64), mixed(context).view(np.int64)


def _slabs(texts: pa.Array, length: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, offset in it, bytes, bounds): slabs of whole texts, and overlapping parts of longer ones."""
    for first, end, data, at in slabs(texts):
        if len(data) <= 2 * SLAB:
            yield first, 0, data, at
            continue
        # A long text alone; every start belongs to one part.
        for begin in range(0, max(1, len(data) - length + 1), SLAB):
            part = data[begin : begin + SLAB + length - 1]
            yield first, begin, part, np.array([0, len(part)])


def multikey_order(tokens: list[np.ndarray]) -> np.ndarray:
    """The order of rows by their tokens: multikey quicksort, where only ties go on to the next token."""
    order = np.argsort(tokens[0], kind="stable")
    run = np.zeros(len(order), np.int64)
    for token, after in zip(tokens, tokens[1:], strict=False):
        now = token[order]
        run[1:] = np.cumsum((now[1:] != now[:-1]) | (run[1:] != run[:-1]))
        size = np.bincount(run)
        tied = np.flatnonzero(size[run] > 1) if len(run) else run
        if not len(tied):
            break
        part = order[tied]
        order[tied] = part[np.lexsort((after[part], run[tied]))]
    return order


def _runs(*keys: np.ndarray) -> np.ndarray:
    """Number of the run of equal neighbours that a row is in."""
    new = np.zeros(len(keys[0]), bool)
    for key in keys:
        new[1:] |= key[1:] != key[:-1]
    return np.cumsum(new)


def suffixes(frame: DataFrame, length: int = LENGTH) -> DataFrame:
    """The tokens of every anchor of ``frame`` (uid, text), and its place, starts before and starts in all."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            uid = batch.column("uid").to_numpy()
            for first, offset, data, at in _slabs(batch.column("text"), length):
                row, low, high, place, lead, kernel, context = anchors(data, at, length)
                base = at[row] - offset if len(row) else row
                packed = (place - base) << 16 | (place - low) << 8 | (high - low)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(lead), pa.array(kernel), pa.array(context), pa.array(uid[first + row]), pa.array(packed)],
                    ["lead", "kernel", "context", "uid", "place"],
                )

    return frame.select("uid", "text").mapInArrow(find, _ANCHOR)


def compared_suffixes(found: DataFrame) -> DataFrame:
    """The suffixes that repeat: uid, place, ``whole`` (equal context elsewhere) and ``open`` (unequal ones too).

    Of a run of equal contexts one is open at most in each bucket, for the others add nothing to compare.
    """
    keys = ["lead", "kernel", "context"]

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = pa.Table.from_batches(list(batches), _schema(_ANCHOR))
        if not whole.num_rows:
            return
        lead, kernel, context, uid, place = (whole.column(c).to_numpy() for c in ("lead", "kernel", "context", "uid", "place"))
        order = multikey_order([lead, kernel, context])
        lead, kernel, context, uid, place = (c[order] for c in (lead, kernel, context, uid, place))
        same = _runs(lead, kernel)
        equal = _runs(lead, kernel, context)
        count = np.bincount(equal)[equal]
        head = np.ones(len(equal), bool)
        head[1:] = equal[1:] != equal[:-1]
        kinds = np.bincount(same[head])[same]
        # Runs at a border are kept until the neighbours are known.
        border = (same == same[0]) | (same == same[-1])
        keep = np.flatnonzero((count > 1) | (kinds > 1) | border)
        bucket = np.full(len(keep), run_number())
        edge = np.zeros(len(keep), np.int8)
        edge[0] |= 1
        edge[-1] |= 2
        # The others of a run of equal contexts are known to repeat, and one of them stands for all.
        shown = (border & (head | (count == 1)))[keep] | (edge > 0)
        masked = [pa.array(c[keep], mask=~shown) for c in (lead, kernel, context)]
        yield from pa.Table.from_arrays(
            [pa.array(bucket), *masked, pa.array(uid[keep]), pa.array(place[keep]), pa.array(count[keep] > 1),
             pa.array((kinds[keep] > 1) & head[keep]), pa.array(head[keep]), pa.array(edge)],
            names=["bucket", *keys, "uid", "place", "whole", "open", "head", "edge"],
        ).to_batches(max_chunksize=100_000)

    ranged = found.repartitionByRange(*keys, "uid", "place")
    kept = saved(ranged.mapInArrow(
        sort, "bucket bigint, lead bigint, kernel bigint, context bigint, uid bigint, place bigint, whole boolean, "
        "open boolean, head boolean, edge tinyint",
    ))
    # One row for each bucket and side: what the border runs of all buckets have in common.
    edges = kept.filter("edge > 0").select("bucket", "edge", *keys)
    borders = edges.groupBy(*keys).agg(F.count_distinct("bucket").alias("buckets"))
    kernels = edges.groupBy("lead", "kernel").agg(
        F.count_distinct("bucket").alias("in_buckets"), F.count_distinct("context").alias("kinds"),
    )
    at_border = kept.filter("lead IS NOT NULL")
    joined = at_border.join(F.broadcast(borders.filter("buckets > 1").select(*[F.col(k).alias(f"b_{k}") for k in keys])), [
        F.col(k) == F.col(f"b_{k}") for k in keys
    ], "left").join(F.broadcast(kernels.filter("in_buckets > 1 AND kinds > 1").select(
        F.col("lead").alias("k_lead"), F.col("kernel").alias("k_kernel"),
    )), [F.col("lead") == F.col("k_lead"), F.col("kernel") == F.col("k_kernel")], "left")
    inner = kept.filter("lead IS NULL").select("uid", "place", "whole", "open")
    return inner.union(joined.select(
        "uid", "place", (F.col("whole") | F.col("b_lead").isNotNull()).alias("whole"),
        (F.col("open") | (F.col("k_lead").isNotNull() & F.col("head"))).alias("open"),
    )).filter("whole OR open")


def _schema(columns: str) -> pa.Schema:
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    return pa.schema([(name, kinds[kind]) for name, kind in (c.split() for c in columns.split(", "))])


_CONTEXT = "suffix binary, before binary, uid bigint, low bigint"


def contexts(frame: DataFrame, open_: DataFrame, length: int = LENGTH) -> DataFrame:
    """The bytes of open contexts: from the anchor on, and before it; ``low`` is the first start."""
    wanted = open_.groupBy("uid").agg(F.collect_list("place").alias("places"))

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for uid, text, places in zip(batch.column("uid"), batch.column("text"), batch.column("places"), strict=True):
                data = text.as_py().encode()
                for packed in places.as_py():
                    place, back, more = packed >> 16, packed >> 8 & 255, packed & 255
                    low = place - back
                    out.append((data[place : low + more + length], data[low:place], uid.as_py(), low))
            yield from _rows(out, _CONTEXT)

    return frame.join(wanted, "uid").select("uid", "text", "places").mapInArrow(fetch, _CONTEXT)


def _rows(rows: list[tuple], columns: str) -> Iterator[pa.RecordBatch]:
    schema = _schema(columns)
    for first in range(0, len(rows), 20_000):
        part = list(zip(*rows[first : first + 20_000], strict=True))
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(part, schema, strict=True)], schema=schema)


_STRING = "hash bigint, second bigint, uid bigint, start bigint, found int"


def _strings(before: list[bytes], suffix: list[bytes], low: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Two hashes, row and start of every string of ``length`` bytes in the contexts."""
    data = np.frombuffer(b"".join(x for pair in zip(before, suffix, strict=True) for x in pair), np.uint8)
    size = np.array([len(a) + len(b) for a, b in zip(before, suffix, strict=True)], np.int64)
    at = np.cumsum(size) - size
    many = size - length + 1
    row = np.repeat(np.arange(len(size)), many)
    inside = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
    start = at[row] + inside
    one = Rolling(data).spans(start, start + length)
    # The second hash is of the mixed bytes.
    spread = mixed(np.arange(256, dtype=_U) + _U(11))[data]
    prefix = np.zeros(len(data) + 1, _U)
    np.cumsum(spread * powers(int(BASE), len(data) + 1)[:-1], out=prefix[1:])
    two = (prefix[start + length] - prefix[start]) * powers(BASE_INVERSE, len(data) + 1)[start]
    return mixed(one).view(np.int64), mixed(two).view(np.int64), row, low[row] + inside


def compared_strings(open_contexts: DataFrame, length: int = LENGTH) -> DataFrame:
    """uid and start of every string that is found in two contexts."""
    size = length - KERNELS + 1

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = pa.Table.from_batches(list(batches), _schema(_CONTEXT))
        n = whole.num_rows
        if not n:
            return
        suffix, before = whole.column("suffix").to_pylist(), whole.column("before").to_pylist()
        uid, low = whole.column("uid").to_numpy(), whole.column("low").to_numpy()
        wide = -(-length // 8) * 8
        tokens = np.frombuffer(b"".join(x[:wide].ljust(wide, b"\0") for x in suffix), ">u8").reshape(n, -1)
        order = multikey_order([tokens[:, k].astype(_U) for k in range(tokens.shape[1])])
        suffix, before, uid, low = [suffix[k] for k in order], [before[k] for k in order], uid[order], low[order]
        kernel = np.array([x[:size] for x in suffix], object)
        run = _runs(kernel)
        count = np.bincount(run)
        border = (run == run[0]) | (run == run[-1])
        first = 0
        while first < n:
            # As many whole runs as make about a slab of strings.
            last = int(np.searchsorted(run, run[min(n - 1, first + 20_000)], "left"))
            last = last if last > first else int(np.searchsorted(run, run[first], "right"))
            last = n if first + 20_000 >= n else last
            chosen = np.arange(first, last)
            chosen = chosen[(count[run[chosen]] > 1) | border[chosen]]
            first = last
            if not len(chosen):
                continue
            one, two, row, start = _strings([before[k] for k in chosen], [suffix[k] for k in chosen], low[chosen], length)
            sort_ = np.lexsort((two, one))
            same = _runs(one[sort_], two[sort_])
            found = (np.bincount(same) > 1)[same]
            edge = border[chosen][row[sort_]]
            # Strings of border runs are counted over all buckets, once for each bucket.
            head = np.ones(len(same), bool)
            head[1:] = same[1:] != same[:-1]
            pick = np.flatnonzero(found | edge)
            pick = sort_[pick], found[pick], edge[pick]
            at = pick[0]
            yield from pa.Table.from_arrays(
                [pa.array(one[at], mask=~pick[2]), pa.array(two[at], mask=~pick[2]), pa.array(uid[chosen][row[at]]),
                 pa.array(start[at]), pa.array(pick[1].astype(np.int32))],
                names=["hash", "second", "uid", "start", "found"],
            ).to_batches(max_chunksize=100_000)

    rows = saved(open_contexts.repartitionByRange("suffix", "uid", "low").mapInArrow(sort, _STRING))
    local = rows.filter("found = 1").select("uid", "start")
    waiting = rows.filter("found = 0")
    # Against the strings of border runs in other buckets.
    known = rows.filter("hash IS NOT NULL").groupBy("hash", "second").agg(F.count("*").alias("n")).filter("n > 1")
    across = waiting.join(known, ["hash", "second"]).select("uid", "start")
    return local.union(across)


def repeated_spans(frame: DataFrame, length: int = LENGTH) -> DataFrame:
    """For each ``uid`` of ``frame`` (uid, text) with repeats: ``spans``, byte runs (low, high) that may overlap."""
    found = saved(compared_suffixes(suffixes(frame, length)))
    place = F.col("place")
    low = F.shiftright(place, 16) - F.shiftright(place, 8).bitwiseAND(F.lit(255))
    high = low + place.bitwiseAND(F.lit(255)) + length
    whole = found.filter("whole").select("uid", low.alias("low"), high.alias("high"))
    single = compared_strings(contexts(frame, found.filter("open"), length), length)
    near = Window.partitionBy("uid").orderBy("start")
    # Neighbouring starts make one span.
    step = single.withColumn("run", F.col("start") - F.row_number().over(near))
    part = step.groupBy("uid", "run").agg(F.min("start").alias("low"), (F.max("start") + length).alias("high")).drop("run")
    return whole.union(part).groupBy("uid").agg(F.collect_list(F.struct("low", "high")).alias("spans"))


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The maximal runs that spans (low, high) cover."""
    out: list[tuple[int, int]] = []
    for low, high in sorted(spans):
        if out and low <= out[-1][1]:
            out[-1] = (out[-1][0], max(high, out[-1][1]))
        else:
            out.append((low, high))
    return out


_CUT = "n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept_text string"


def cut_repeats(documents: DataFrame, text: str = "text", length: int = LENGTH, with_text: bool = True) -> DataFrame:
    """Every row of ``documents`` as struct ``row``, with what is left without long repeats.

    A byte goes if a string of ``length`` bytes that covers it also starts elsewhere, in the same text or
    another, overlaps included; strings are judged on the input, and never cross texts.  ``n_spans`` are the
    maximal removed runs, ``kept_sha256`` is of the bytes left.  ``kept_text`` (null without ``with_text``)
    is what is left as text, without the bytes of characters that were cut in two.

    A null text is empty and is left null; a text under ``length`` bytes is left alone; repeated rows repeat
    each other and go as a whole.  ``documents`` must come straight from stored files or the driver, for rows
    are numbered by their place in the input; the text is shuffled twice, for open contexts and for the cut.
    """
    if length < KERNELS + 8:
        raise ValueError(f"strings must have {KERNELS + 8} bytes or more")
    tuned(documents.sparkSession)
    uid = F.monotonically_increasing_id().alias("uid")
    spans = repeated_spans(documents.select(uid, F.col(f"`{text}`").alias("text")), length)
    kind, place = documents.schema.simpleString(), documents.columns.index(text)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for value, found in zip(pc.struct_field(batch.column("row"), place), batch.column("spans"), strict=True):
                data = (value.as_py() or "").encode()
                runs = merged([(s["low"], s["high"]) for s in found.as_py() or ()])
                kept, end = [], 0
                for low, high in runs:
                    kept.append(data[end:low])
                    end = high
                left = b"".join([*kept, data[end:]])
                shown = left.decode(errors="ignore") if with_text and value.is_valid else None
                out.append((len(data), len(data) - len(left), len(runs), hashlib.sha256(left).hexdigest(), shown))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
            columns = [pa.array(c, k) for c, k in zip(list(zip(*out, strict=True)) or [()] * 5, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), *columns], ["row", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text"],
            )

    rows = documents.select(uid, F.struct("*").alias("row")).join(spans, "uid", "left")
    return rows.select("row", "spans").mapInArrow(cut, f"row {kind}, {_CUT}")


def documents_without_repeats(documents: DataFrame, text: str = "text", size: str | None = "n_chars", **options) -> DataFrame:
    """All documents with what is left of their texts, and its code points in column ``size`` if there is one.

    No row goes; a text that repeats as a whole is left empty, and a null one null.
    """
    cut = cut_repeats(documents, text, **options)
    kept = {text: F.col("kept_text")}
    if size in documents.columns:
        kept[size] = F.char_length("kept_text").cast(documents.schema[size].dataType)
    return cut.select(*[
        (kept[c] if c in kept else F.col("row").getField(c)).alias(c) for c in documents.columns
    ])


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without strings of 200 bytes that start elsewhere too."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    cut = cut_repeats(documents, with_text=False)
    return few_files(cut).select("row.doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
