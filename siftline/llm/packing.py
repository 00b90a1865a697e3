"""Packing of token sequences: a configuration linear program over the length histogram.

Documents become pieces of at most ``size`` tokens.  Only the histogram of their lengths (``size``
entries) reaches the driver.  There a configuration - lengths that fill one sequence - is priced by a
knapsack dynamic program and weighted by multiplicative updates until the fractional solution covers
the histogram; it is rounded down, and what is left is filled by best fit.  The plan says how many
sequences have which configuration; each piece finds its place by its length and its rank among the
pieces of that length, so no task sees more than its share.
"""

from __future__ import annotations

import base64
import json
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftline.llm.common import few_files, run_number, table
from siftline.session import stored

#: Tokens of a sequence, and the id that ends a document.
SIZE = 2048
END = 0
#: Rounds of multiplicative weights, and how much a round may change a weight.
ROUNDS = 40
SUB_ROUNDS = 4
STEP = 1.0

Config = tuple[int, ...]


@cache
def tokenizer(path: str):
    """The byte-level BPE of a tokenizers file as a function, run by tiktoken on the same vocabulary.

    The ids equal those of the file, at a quarter of the time; the names of added tokens in a text are those tokens.  A file
    whose added tokens take blanks or word borders into account is run as it is.
    """
    import public_tokenizers
    import tiktoken

    ranks_path = path.removesuffix(".json") + ".tiktoken"
    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    with open(path) as described:
        added = json.load(described)["added_tokens"]
    if any(token[flag] for token in added for flag in ("single_word", "lstrip", "rstrip", "normalized")):
        return lambda text: np.array(_whole(path).encode(text, add_special_tokens=False).ids, np.uint32)
    special = {token["content"]: token["id"] for token in added}
    quick = tiktoken.Encoding("pieces", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)

    def encode(text: str) -> np.ndarray:
        try:
            return quick.encode_to_numpy(text, allowed_special="all")
        except ValueError:
            # Its pattern gives up on very long runs of blanks.
            return np.array(_whole(path).encode(text, add_special_tokens=False).ids, np.uint32)

    return encode


@cache
def _whole(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def default_tokenizer() -> str:
    """Path of the vocabulary of the registered query."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def pieces_of(documents: DataFrame, size: int = SIZE, vocabulary: str | None = None) -> DataFrame:
    """Pieces of ``documents`` (doc_id, text): place in the document, length, checksum, task and rank.

    A document is its token ids and the id 0.  A longer one is cut from its end into pieces of ``size``,
    so the first piece takes the rest.  ``task`` and ``rank`` number the pieces of one length; a null
    text is empty and has the id 0 alone.
    """
    kind = documents.schema["doc_id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer(vocabulary or default_tokenizer())
        task, ranks = run_number(), Counter()
        for batch in batches:
            owner, rows = [], []
            for at, text in enumerate(batch.column("text")):
                ids = np.append(encode(text.as_py() or ""), END).astype("<u4")
                first = len(ids) % size or size
                bounds = [0, *range(first, len(ids) + 1, size)]
                for piece, (start, end) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
                    owner.append(at)
                    rows.append((piece, start, end - start, zlib.crc32(ids[start:end].tobytes()), task, ranks[end - start]))
                    ranks[end - start] += 1
            columns = list(zip(*rows, strict=True)) or [()] * 6
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(owner, pa.int64())), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))],
                ["doc_id", "piece", "start", "length", "ids_crc32", "task", "rank"],
            )

    return documents.select("doc_id", "text").mapInArrow(
        cut, f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, task bigint, rank bigint",
    )


def _knapsack(prices: np.ndarray, size: int) -> np.ndarray:
    """For each capacity 0..size the length taken last for the best value (0: none new); lengths may repeat."""
    lengths = np.flatnonzero(prices > 0)
    value, last = np.zeros(size + 1), np.zeros(size + 1, np.int64)
    worth = prices[lengths]
    for room in range(1, size + 1):
        fits = np.searchsorted(lengths, room, "right")
        value[room], last[room] = value[room - 1], 0
        if fits:
            tried = value[room - lengths[:fits]] + worth[:fits]
            best = int(tried.argmax())
            if tried[best] > value[room]:
                value[room], last[room] = tried[best], lengths[best]
    return last


def _trace(room: int, last: np.ndarray, back: np.ndarray) -> list[int]:
    out = []
    while True:
        room = back[room]
        if room == 0 or not last[room]:
            return out
        out.append(int(last[room]))
        room -= last[room]


def fractional(counts: np.ndarray, size: int = SIZE, rounds: int = ROUNDS, step: float = STEP) -> dict[Config, float]:
    """How often each configuration is used in an approximate solution of the linear program.

    counts[n] is the number of pieces of length n.  Each round hands out another share of the pieces.  A
    length is priced by its weight over its count; the knapsack, solved once for all capacities, gives for
    every length the dearest configuration that has it, and that is used as far as the shares of all its
    lengths go.  Lengths that lag behind get dearer by a factor, so that later configurations take them up;
    those ahead get cheaper.  What no configuration took in the end is left to the rounding.
    """
    lengths = np.flatnonzero(counts)
    used: dict[Config, float] = {}
    # At the start a length costs what it takes of a sequence: the dual of the plain volume bound.
    weight = counts * np.arange(len(counts)) / size
    covered = np.zeros(len(counts))
    for turn in range(1, rounds + 1):
        share = counts * (turn / rounds) - covered
        for _ in range(SUB_ROUNDS):
            open_ = lengths[share[lengths] > 1e-9]
            if not len(open_):
                break
            price = np.zeros(len(counts))
            price[open_] = weight[open_] / counts[open_]
            last = _knapsack(price, size)
            back = np.maximum.accumulate(np.where(last > 0, np.arange(size + 1), 0))
            for n in open_[::-1]:
                if share[n] <= 1e-9:
                    continue
                config = (int(n), *_trace(size - n, last, back))
                own = Counter(config)
                times = min(share[m] / k for m, k in own.items())
                if times > 1e-9:
                    config = tuple(sorted(config, reverse=True))
                    used[config] = used.get(config, 0.0) + times
                    for m, k in own.items():
                        share[m] -= times * k
                        covered[m] += times * k
        lag = np.zeros(len(counts))
        lag[lengths] = 1 - covered[lengths] / (counts[lengths] * (turn / rounds))
        weight *= np.exp(step * (lag - np.average(lag[lengths], weights=counts[lengths])).clip(-0.1, 0.1)) if len(lengths) else 1
    return used


def plan_packing(counts: dict[int, int], size: int = SIZE) -> list[tuple[Config, int]]:
    """Configurations and how many sequences have each; every piece has exactly one place.

    Full pieces are alone.  The fractional solution is rounded down as far as pieces are there, the most
    used configuration first; the pieces left go by best fit, longest first, into the emptiest fitting room.
    """
    left = np.zeros(size + 1, np.int64)
    for length, count in counts.items():
        left[length] += count
    plan: Counter[Config] = Counter()
    if left[size]:
        plan[(size,)] = int(left[size])
        left[size] = 0
    for config, times in sorted(fractional(left, size).items(), key=lambda x: (-x[1], x[0])):
        own = Counter(config)
        fit = min(int(times), *(int(left[n]) // k for n, k in own.items()))
        if fit > 0 and sum(config) <= size:
            plan[config] += fit
            for n, k in own.items():
                left[n] -= fit * k
    # Best fit: rooms[r] are the sequences with r tokens free.
    rooms: dict[int, list[list]] = {}
    for n in range(size, 0, -1):
        todo = int(left[n])
        while todo:
            free = min((r for r, open_ in rooms.items() if r >= n and open_), default=None)
            if free is None:
                each = min(todo, size // n)
                config, times = (n,) * each, todo // each
                todo -= each * times
            else:
                group = rooms[free][-1]
                each = min(todo, free // n)
                times = min(group[1], todo // each)
                group[1] -= times
                if not group[1]:
                    rooms[free].pop()
                config = (*group[0], *(n,) * each)
                todo -= each * times
            rooms.setdefault(size - sum(config), []).append([config, times])
    for open_ in rooms.values():
        for config, times in open_:
            plan[config] += times
    return sorted(plan.items())


def _places(plan: list[tuple[Config, int]], size: int) -> tuple[np.ndarray, ...]:
    """Runs of places of one length: key (length, first rank), first sequence and offset."""
    slots: list[tuple[int, int, int, int]] = []
    sequence = 0
    for config, times in plan:
        offset = 0
        for n in config:
            slots.append((n, times, sequence, offset))
            offset += n
        sequence += times
    slots.sort(key=lambda x: x[0])
    n, times, first, offset = (np.array(x, np.int64) for x in zip(*slots, strict=True)) if slots else [np.zeros(0, np.int64)] * 4
    run = np.cumsum(times) - times
    begin = np.searchsorted(n, np.arange(size + 2))
    rank = run - np.append(run, 0)[begin[n]] if len(n) else run
    return n * (1 << 42) + rank, first, offset, rank


def pack(pieces: DataFrame, size: int = SIZE) -> DataFrame:
    """The pieces, each with its ``sequence_id`` and ``offset``; see ``pieces_of`` for the columns."""
    pieces = stored(pieces)
    counts = pieces.groupBy("task", "length").agg(F.count("*").alias("n"))
    order = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("task", "length", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("base"))
    histogram = {row[0]: row[1] for row in counts.groupBy("length").agg(F.sum("n")).collect()}
    sent = pieces.sparkSession.sparkContext.broadcast(_places(plan_packing(histogram, size), size))
    kind = pieces.schema["doc_id"].dataType.simpleString()

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, first, offset, rank = sent.value
        for batch in batches:
            own = batch.column("length").to_numpy(zero_copy_only=False), batch.column("rank").to_numpy(zero_copy_only=False)
            slot = np.searchsorted(keys, own[0] * (1 << 42) + own[1], "right") - 1
            kept = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(first[slot] + own[1] - rank[slot]), pa.array(offset[slot])],
                ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    ranked = few_files(pieces.join(base, ["task", "length"])).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("base")).alias("rank"),
    )
    return ranked.mapInArrow(
        place, f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint",
    )


def pack_documents(documents: DataFrame, size: int = SIZE, vocabulary: str | None = None) -> DataFrame:
    """Every piece of every document with its place.

    Repeated rows and null ids are packed like any other; an empty table gives no piece.  ``documents``
    needs ``doc_id`` and ``text``, other columns are ignored.
    """
    return pack(pieces_of(documents, size, vocabulary), size)


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 2048 tokens."""
    return pack_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))
