"""Spelling variants: frequent words that differ by one code point, by dense prefix-suffix tiling.

Two words are near if the longer one has L code points, the other L or L - 1, and their common prefix and common
suffix together reach L - 1.  So they share half of L from the front or from the back.  Every word lies in blocks of words with
equal halves, once for each L and side; a block that is too large is halved again in what is left between the shared
parts, down to blocks in which a single place is open.  Which way a pair goes is fixed by its common
prefix, so it is found in one block and no more.

In a task the words of many blocks lie in padded matrices of code points, one aligned at the front and one at the back, in tiles of some
rows.  Tiles are compared with each other, all rows with all, as far as a block reaches: the first difference in each
matrix gives common prefix and suffix.  Near words are summed up by Spark; forms are followed to their roots by joins that double
the steps.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.llm.common import saved, table, tuned
from siftline.session import stored

#: A run of these is a word; its code points and occurrences at least.
LETTERS = "A-Za-zÀ-ÿ"
SHORTEST = 5
RAREST = 3
#: One in so many occurrences has lost a code point.
DAMAGED = 97
#: Words of a block that is not halved again, unless only one place is open.
BLOCK = 256
#: Rows of a tile, and cells of tiles that are compared at a time.
TILE = 32
CELLS = 1 << 22
#: Words in the blocks of one task, roughly, and their code points.
TASK_WORDS = 60_000
TASK_CHARS = 4_000_000
#: A form has so many times the occurrences.
TIMES = 2

_NEAR = "word string, near string, near_n bigint"


def counted_words(documents: DataFrame, doc_id: str, text: str, shortest: int = SHORTEST, rarest: int = RAREST, damaged: int = DAMAGED) -> DataFrame:
    """(word, n) of frequent words, A-Z in lower case; some occurrences lose a code point by their hash."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    # Shorter runs cannot become words.
    runs = F.regexp_extract_all(F.col("text"), F.lit(f"[{LETTERS}]{{{shortest},}}"), F.lit(0))
    rows = documents.select(F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.lit("")).alias("id"), F.col(f"`{text}`").alias("text")).select(
        "id", F.explode(runs).alias("run"),
    ).select("id", F.translate("run", upper, lower).alias("run"))
    h = F.crc32(F.concat("id", F.lit(":"), "run"))
    at = F.pmod("h", F.char_length("run")).cast("int")
    less = F.concat(F.left(F.col("run"), at), F.substring("run", at + 2, F.char_length("run")))
    words = rows.withColumn("h", h).select(F.when(F.col("h") % damaged == 0, less).otherwise(F.col("run")).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("n")).filter((F.col("n") >= rarest) & (F.char_length("word") >= shortest))


def _key(kind: Column) -> Column:
    """The block: longer length, shared parts, and the way to it."""
    left, right = F.col("front"), F.col("back")
    return F.xxhash64("longer", kind, F.left(F.col("word"), left), F.right(F.col("word"), right), left, right).alias("block")


def _halved(entries: DataFrame) -> DataFrame:
    """Entries of blocks, once with more of the front shared and once with more of the back.

    ``front`` and ``back`` are the shared code points and ``way`` the choices that led there, a bit each under a leading one.
    """
    half = F.floor((F.col("longer") - F.col("front") - F.col("back")) / 2).cast("int")
    sides = F.array(
        F.struct((F.col("front") + half).alias("front"), F.col("back").alias("back"), (F.col("way") * 2).alias("way")),
        F.struct(F.col("front").alias("front"), (F.col("back") + half).alias("back"), (F.col("way") * 2 + 1).alias("way")),
    )
    return entries.select("word", "n", "longer", F.explode(sides).alias("side")).select(
        "word", "n", "longer", "side.front", "side.back", "side.way",
    ).withColumn("block", _key(F.col("way")))


def blocks(words: DataFrame, most: int = BLOCK) -> DataFrame:
    """(word, n, longer, way, block) of all blocks that hold a word of the longer length and another."""
    size = F.char_length("word")
    start = words.select(
        "word", "n", F.explode(F.array(size, size + 1)).alias("longer"), F.lit(0).alias("front"), F.lit(0).alias("back"),
        F.lit(1).cast("bigint").alias("way"),
    )
    entries, out = _halved(start), []
    while True:
        sizes = entries.groupBy("block").agg(
            F.count("*").alias("held"), F.max((F.char_length("word") == F.col("longer")).cast("int")).alias("whole"),
            F.max(F.col("longer") - F.col("front") - F.col("back")).alias("open"),
        ).filter("held > 1 AND whole = 1")
        known = stored(entries.join(sizes.select("block", "held", "open"), "block"))
        small = ((F.col("held") <= most) & (F.col("held") * F.col("longer") <= TASK_CHARS)) | (F.col("open") <= 1)
        out.append(known.filter(small).select("word", "n", "longer", "way", "block"))
        rest = known.filter(~small)
        if rest.isEmpty():
            break
        entries = _halved(rest)
    whole = out[0]
    for more in out[1:]:
        whole = whole.union(more)
    return whole


def matrices(words: list[str], longer: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of words of ``longer`` or one less, padded behind and before, and which words are shorter."""
    front = np.array(words, dtype=f"<U{longer}").view(np.uint32).reshape(len(words), longer)
    short = np.array([len(word) < longer for word in words])
    back = front.copy()
    back[short, 1:] = front[short, :-1]
    back[short, 0] = 0
    return front, back, short


def near_pairs(words: list[str], longer: int, block: np.ndarray, way: np.ndarray, cells: int = CELLS) -> tuple[np.ndarray, np.ndarray]:
    """Places of the near words of the same block, each pair once; ``words`` are sorted by ``block``.

    A pair counts only where its own way is that of the block: to the front if that much is common there.
    """
    n = len(words)
    front, back, short = matrices(words, longer)
    tiles = -(-n // TILE)
    first_of = np.arange(tiles) * TILE
    last_of = np.minimum(first_of + TILE, n) - 1
    one, other = [], []
    step = 0
    while step < tiles:
        # Tiles so far apart are compared if a block reaches from one to the other.
        pairs = np.arange(tiles - step)
        if step:
            pairs = pairs[block[last_of[pairs]] == block[first_of[pairs + step]]]
        if not len(pairs):
            break
        some = max(1, cells // (TILE * TILE * longer))
        for low in range(0, len(pairs), some):
            a = (first_of[pairs[low : low + some]][:, None] + np.arange(TILE))[:, :, None]
            b = (first_of[pairs[low : low + some] + step][:, None] + np.arange(TILE))[:, None, :]
            inside = (a < n) & (b < n) & (a < b)
            a, b = np.broadcast_arrays(np.minimum(a, n - 1), np.minimum(b, n - 1))
            inside &= (block[a] == block[b]) & ~(short[a] & short[b])
            found = _one_apart(front, back, a[inside], b[inside], longer, way, cells)
            one.append(found[0])
            other.append(found[1])
        step += 1
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *one]), np.concatenate([none, *other])


def _one_apart(front, back, a, b, longer, way, cells) -> tuple[np.ndarray, np.ndarray]:
    """Those of the pairs of rows whose common prefix and suffix reach the longer length but one."""
    kept = []
    some = max(1, cells // longer)
    for low in range(0, len(a), some):
        x, y = a[low : low + some], b[low : low + some]
        apart = front[x] != front[y]
        prefix = np.where(apart.any(1), apart.argmax(1), longer)
        apart = back[x] != back[y]
        suffix = np.where(apart.any(1), apart[:, ::-1].argmax(1), longer)
        near = np.flatnonzero((prefix + suffix >= longer - 1) & (prefix < longer))
        kept.append(low + near[_own_way(prefix[near], longer, way[x[near]])])
    at = np.concatenate(kept) if kept else np.zeros(0, np.int64)
    return a[at], b[at]


def _own_way(prefix: np.ndarray, longer: int, way: np.ndarray) -> np.ndarray:
    """Whether pairs with this common prefix go the way of the block, from the first choice on."""
    steps = np.array([int(w).bit_length() - 1 for w in way], np.int64)
    front, back = np.zeros(len(way), np.int64), np.zeros(len(way), np.int64)
    good = np.ones(len(way), bool)
    for k in range(int(steps.max(initial=0))):
        on = k < steps
        choice = (way >> np.maximum(steps - 1 - k, 0)) & 1
        half = (longer - front - back) // 2
        to_front = prefix >= front + half
        good &= ~on | (to_front == (choice == 0))
        front += np.where(on & (choice == 0), half, 0)
        back += np.where(on & (choice == 1), half, 0)
    return good


def near_words(words: DataFrame, most: int = BLOCK) -> DataFrame:
    """(word, near, near_n): every near word of each word of ``words`` (word, n)."""
    entries = blocks(words, most)
    held = entries.agg(F.count("*"), F.sum("longer")).first()
    tasks = max(1, (held[0] or 0) // TASK_WORDS, (held[1] or 0) // TASK_CHARS)

    def tiled(found: pa.Table) -> pa.Table:
        # Widths are split up, so that a matrix is no wider than its words.
        found = found.sort_by([("longer", "ascending"), ("block", "ascending")])
        width = found.column("longer").to_numpy()
        block, way, n = (found.column(c).to_numpy() for c in ("block", "way", "n"))
        names = found.column("word")
        out = []
        cuts = [0, *(np.flatnonzero(width[1:] != width[:-1]) + 1).tolist(), len(width)]
        for low, high in zip(cuts[:-1], cuts[1:], strict=True):
            a, b = near_pairs(names.slice(low, high - low).to_pylist(), int(width[low]), block[low:high], way[low:high])
            for x, y in ((a, b), (b, a)):
                out.append(pa.table({"word": names.take(pa.array(low + x)), "near": names.take(pa.array(low + y)), "near_n": pa.array(n[low + y])}))
        return pa.concat_tables(out)

    parts = entries.withColumn("task", F.pmod("block", F.lit(tasks)))
    return parts.groupBy("task").applyInArrow(tiled, _NEAR)


def roots_of(forms: DataFrame) -> DataFrame:
    """(word, root) from (word, form): forms followed to the last, in steps that double."""
    steps = stored(forms.select("word", F.col("form").alias("root")))
    while True:
        after = steps.select(F.col("word").alias("root"), F.col("root").alias("on"))
        steps_ = stored(steps.join(after, "root", "left").select("word", F.coalesce("on", "root").alias("root"), F.col("on").isNotNull().alias("moved")))
        if steps_.filter("moved").isEmpty():
            return steps_.select("word", "root")
        steps = steps_.select("word", "root")


def spelling_variants(
    documents: DataFrame, doc_id: str = "doc_id", text: str = "text", shortest: int = SHORTEST, rarest: int = RAREST, damaged: int = DAMAGED,
) -> DataFrame:
    """word, n, n_near, form, form_n, root of every frequent word.

    Words are runs of letters, A-Z in lower case; of some occurrences (a hash of id and run that ``damaged`` divides)
    one code point is left out.  The form of a word is its near word with the most occurrences (of equals the first by
    code points), if it has twice as many; the root is the end of the forms.

    Null and empty texts have no words.  A null id counts as an empty one in the hash.  Rows that repeat count each
    time.  Words of any length are compared whole.  Words of equal counts are no forms of one another.  An empty
    table gives no rows; other columns are ignored.
    """
    tuned(documents.sparkSession)
    words = stored(counted_words(documents, doc_id, text, shortest, rarest, damaged))
    best = near_words(words).groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("order"), "near")).alias("best"),
    )
    found = saved(words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), F.when(
            -F.col("best.order") >= TIMES * F.col("n"), F.struct(F.col("best.near").alias("form"), (-F.col("best.order")).alias("form_n")),
        ).alias("best"),
    ).select("word", "n", "n_near", "best.form", "best.form_n"))
    roots = roots_of(found.filter("form IS NOT NULL"))
    return found.join(roots, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All frequent words of the documents with their forms."""
    return spelling_variants(table(spark, sf_dir, "documents"))
