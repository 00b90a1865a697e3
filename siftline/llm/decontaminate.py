"""Benchmark decontamination: Wu-Manber search for windows of benchmark words in documents."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.llm.common import table

#: Words of a window, words of a block, and bytes of benchmark text that are broadcast at once.
WINDOW = 10
BLOCK = 3
PART_BYTES = 16_000_000

#: Lower-cases A-Z; what is no word byte becomes a blank.
WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)

FOUND = (
    "struct<n_words: bigint, n_hit: bigint, n_items: bigint, items_sha256: string, contaminated: boolean, "
    "hit_spans: array<struct<first: int, last: int>>, item_ids: array<string>>"
)


def words_of(text: str | None) -> list[bytes]:
    """The words of a text."""
    return text.encode().translate(WORD_BYTES).split() if text else []


class WuManber:
    """Searches sequences of words for patterns that all have the same number of words.

    ``shift`` has, for each block of words in a pattern, how far the block lies from the pattern's end;
    blocks in no pattern allow the longest jump.  Where a block ends a pattern, the patterns of its
    bucket are picked by their first word and compared word by word.
    """

    def __init__(self, patterns: dict[tuple[bytes, ...], set[str]]) -> None:
        self.length = len(next(iter(patterns)))
        self.block = block = min(BLOCK, self.length)
        self.jump = self.length - block + 1
        self.shift: dict[tuple[bytes, ...], int] = {}
        self.buckets: dict[tuple[bytes, ...], dict[bytes, list[tuple[tuple[bytes, ...], set[str]]]]] = {}
        for pattern, items in patterns.items():
            for end in range(block, self.length + 1):
                part = pattern[end - block : end]
                self.shift[part] = min(self.shift.get(part, self.jump), self.length - end)
            self.buckets.setdefault(pattern[-block:], {}).setdefault(pattern[0], []).append((pattern, items))

    def search(self, words: list[bytes]) -> Iterator[tuple[int, set[str]]]:
        """First word and items of every occurrence."""
        length, block, jump, shift = self.length, self.block, self.jump, self.shift
        at, n = length, len(words)
        while at <= n:
            part = tuple(words[at - block : at])
            step = shift.get(part, jump)
            if step:
                at += step
                continue
            start = at - length
            for pattern, items in self.buckets[part].get(words[start], ()):
                if tuple(words[start:at]) == pattern:
                    yield start, items
            at += 1


def matchers(items: list[tuple[str, str | None]], window: int = WINDOW) -> list[WuManber]:
    """A search for each length of window: ``window`` words, or all words of a shorter item."""
    by_length: dict[int, dict[tuple[bytes, ...], set[str]]] = {}
    for item, text in items:
        words = words_of(text)
        length = min(window, len(words))
        for start in range(len(words) - length + 1) if words else ():
            by_length.setdefault(length, {}).setdefault(tuple(words[start : start + length]), set()).add(item)
    return [WuManber(patterns) for _, patterns in sorted(by_length.items())]


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans (first, last) that do not touch, covering the same words."""
    out: list[tuple[int, int]] = []
    for first, last in sorted(spans):
        if out and first <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(last, out[-1][1]))
        else:
            out.append((first, last))
    return out


def _judged(n_words: int, spans: list[tuple[int, int]], items: set[str]) -> tuple:
    hit = sum(last - first + 1 for first, last in spans)
    names = sorted(items)
    digest = hashlib.sha256(",".join(names).encode()).hexdigest()
    return n_words, hit, len(names), digest, hit > 0, [{"first": a, "last": b} for a, b in spans], names


def decontaminate(
    documents: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text",
    window: int = WINDOW, part_bytes: int = PART_BYTES,
) -> DataFrame:
    """Every row of ``documents`` as struct ``row``, with what it shares with the benchmark.

    Words are runs of letters, digits and bytes above 7F, A-Z in lower case.  A window is ``window``
    consecutive words of an item; an item of fewer words is one window.  ``hit_spans`` are the runs of
    document words (from 0) inside occurrences, ``item_ids`` the items that occur, sorted as strings.

    The benchmark is searched in parts of about ``part_bytes``, one broadcast after the other over the
    same rows, so its size has no limit and nothing is shuffled.

    A null or empty text has no words and is clean; a null or empty item has no window; a null item id
    counts as the empty string; repeated items count once by id; an empty benchmark leaves all clean.
    """
    spark = documents.sparkSession
    picked = benchmark.select(
        F.coalesce(F.col(f"`{item_id}`").cast("string"), F.lit("")).alias("item"), F.col(f"`{item_text}`").alias("text"),
    )
    size = picked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-size // part_bytes))
    kind = documents.schema.simpleString()
    frame = documents.select(F.struct("*").alias("row"), F.col(f"`{text}`").alias("text"))
    frame = frame.withColumn("found", F.lit(None).cast(FOUND))
    for part in range(parts):
        chosen = picked if parts == 1 else picked.filter(F.pmod(F.xxhash64("item", "text"), F.lit(parts)) == part)
        sent = spark.sparkContext.broadcast([tuple(row) for row in chosen.collect()])

        def search(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            searches = matchers(sent.value, window)
            for batch in batches:
                out = []
                before = batch.column("found").to_pylist()
                for value, known in zip(batch.column("text"), before, strict=True):
                    words = words_of(value.as_py())
                    spans = [(x["first"], x["last"]) for x in known["hit_spans"]] if known else []
                    items = set(known["item_ids"]) if known else set()
                    for search in searches:
                        for start, names in search.search(words):
                            spans.append((start, start + search.length - 1))
                            items |= names
                    out.append(dict(zip(_NAMES, _judged(len(words), merged(spans), items), strict=True)))
                found = pa.array(out, batch.schema.field("found").type)
                yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("text"), found], ["row", "text", "found"])

        frame = frame.mapInArrow(search, f"row {kind}, text string, found {FOUND}")
    return frame.select("row", "found.*")


_NAMES = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated", "hit_spans", "item_ids")


def clean_documents(documents: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents that share no window with the benchmark, all columns as they were."""
    return decontaminate(documents, benchmark, **options).filter("NOT contaminated").select("row.*")


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document held against the whole benchmark."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate(documents, table(spark, sf_dir, "benchmark"))
    return found.select("row.doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
