"""Document fingerprints: invertible Bloom lookup sketches of a text's paragraphs, in DataFrame functions only.

A *paragraph* is up to WORDS words of one line; words are runs without white space.  The set of its 64-bit
digests stands for a text.  A sketch has three rows of SIDE cells; each digest goes into one cell of every row,
and a cell holds the number of its digests, their exclusive or, and that of their check values.  Sketches of two
versions subtract cell by cell: what both have is gone.  A cell that is left with one digest gives it away
(*peeling*); taken out of its other cells it lays more of them bare.  Where peeling gets stuck, both sets are
sketched anew in more cells: in blocks, told apart by further bits of the digests, four times as many until each has
few digests, and again four for each block that still sticks.  Whatever the sizes, the outcome is exact but for equal 64-bit digests.

Everything happens within a row.  To bring a document and its successor together, the table is dealt once into
buckets of neighbouring ids; the first row of each bucket goes to the one before as well.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftline.llm.common import numbered, table, tuned

#: Words of a paragraph at most.
WORDS = 12
#: Cells of a row of the sketch that is the fingerprint, and of a block of a larger one; powers of two.
SIDE = 8
BLOCK_SIDE = 2
ROWS = 3
#: Digests of both sets for which the cells of a block are worth a try.
FEW = 4
#: Turns of peeling, after which a sketch counts as stuck; larger sketches, and the first bit that tells blocks apart.
TURNS = 4
RETRIES = 20
FIRST_BIT = 16
#: Documents of a bucket while there are not too many buckets, whose first ids the driver holds; small tables have
#: some buckets for each core.
BUCKET = 1000
BUCKETS_A_CORE = 4
MOST_BUCKETS = 1 << 16
#: Buckets that are looked up at once.
SHELF = 256

_CELL = "struct<n: int, key: bigint, check: int>"
_KEYS = "array<bigint>"
#: Row numbers are below this within a partition.
_IN_PART = (1 << 33) - 1


def paragraph_digests(text: Column, words: int = WORDS) -> Column:
    """The different digests of a text's paragraphs."""
    pieces = F.regexp_extract_all(text, F.lit(rf"[^\s]+(?:[^\S\n]+[^\s]+){{0,{words - 1}}}"), F.lit(0))
    return F.array_distinct(F.transform(pieces, lambda piece: F.xxhash64(piece)))


def _places(side: int) -> Column:
    """(mask, value) of each cell: a digest lies in it if it has this value under the mask."""
    width = side.bit_length() - 1
    return F.array(*[
        F.struct(F.lit((side - 1) << row * width).cast("bigint").alias("mask"), F.lit(place << row * width).cast("bigint").alias("value"))
        for row in range(ROWS) for place in range(side)
    ])


def _lies_in(key: Column, place: Column) -> Column:
    return key.bitwiseAND(place["mask"]) == place["value"]


def _cell(n: Column, key: Column, check: Column) -> Column:
    return F.struct(n.alias("n"), key.alias("key"), check.alias("check"))


def sketch(keys: Column, side: int = SIDE) -> Column:
    """The cells of a set of digests, row by row."""
    nothing = F.expr(f"cast(named_struct('n', 0, 'key', 0L, 'check', 0) as {_CELL})")
    return F.transform(_places(side), lambda place: F.aggregate(
        F.filter(keys, lambda key: _lies_in(key, place)), nothing, lambda cell, key: _cell(
            cell["n"] + 1, cell["key"].bitwiseXOR(key), cell["check"].bitwiseXOR(F.hash(key)),
        ),
    ))


def subtract(cells: Column, others: Column) -> Column:
    """The sketch of what only one of two sets has; ``n`` is -1 for what only the second has."""
    return F.zip_with(cells, others, lambda a, b: _cell(
        a["n"] - b["n"], a["key"].bitwiseXOR(b["key"]), a["check"].bitwiseXOR(b["check"]),
    ))


def _let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once."""
    return F.transform(F.array(value), body)[0]


def peel(cells: Column, side: int = SIDE) -> Column:
    """(done, found): whether every cell was emptied, and the cells of one digest each that came out."""
    places = _places(side)

    def turn(state: Column, _: Column) -> Column:
        bare = F.array_distinct(F.filter(state["cells"], lambda c: (F.abs(c["n"]) == 1) & (F.hash(c["key"]) == c["check"])))
        return _let(bare, lambda pure: F.when(F.size(pure) == 0, state).otherwise(F.struct(
            F.transform(state["cells"], lambda c, index: F.aggregate(
                F.filter(pure, lambda p: _lies_in(p["key"], F.get(places, index))), c, lambda left, p: _cell(
                    left["n"] - p["n"], left["key"].bitwiseXOR(p["key"]), left["check"].bitwiseXOR(p["check"]),
                ),
            )).alias("cells"),
            F.concat(state["found"], pure).alias("found"),
        )))

    start = F.struct(cells.alias("cells"), F.array().cast(f"array<{_CELL}>").alias("found"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(TURNS)), start, turn, lambda state: F.struct(
        F.forall(state["cells"], lambda c: (c["n"] == 0) & (c["key"] == 0) & (c["check"] == 0)).alias("done"),
        state["found"].alias("found"),
    ))


def _sum(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0).cast("bigint"), lambda total, number: total + number)


def _larger(keys: Column, others: Column) -> Column:
    """How many digests only the first set has, by sketches of more and more blocks."""

    def split(pair: Column, level: Column) -> Column:
        shift = level * 2 + (FIRST_BIT - 2)

        def of_block(all_: Column, block: Column) -> Column:
            return F.filter(all_, lambda key: F.call_function("shiftright", key, shift).bitwiseAND(F.lit(3).cast("bigint")) == block)

        blocks = F.transform(F.expr("array(0L, 1L, 2L, 3L)"), lambda k: F.struct(of_block(pair["a"], k).alias("a"), of_block(pair["b"], k).alias("b")))
        return F.filter(blocks, lambda p: (F.size(p["a"]) > 0) | (F.size(p["b"]) > 0))

    def outcome(pair: Column, done: Column, own: Column) -> Column:
        return F.struct(pair["a"].alias("a"), pair["b"].alias("b"), done.alias("done"), own.alias("own"))

    def tried(pair: Column) -> Column:
        # Blocks that are still too full for their cells are split again at once.
        full = F.size(pair["a"]) + F.size(pair["b"]) > FEW
        cells = subtract(sketch(pair["a"], BLOCK_SIDE), sketch(pair["b"], BLOCK_SIDE))
        return F.when(full, outcome(pair, F.lit(False), F.lit(0).cast("bigint"))).otherwise(_let(peel(cells, BLOCK_SIDE), lambda result: outcome(
            pair, result["done"], F.size(F.filter(result["found"], lambda c: c["n"] == 1)).cast("bigint"),
        )))

    def retry(state: Column, level: Column) -> Column:
        pairs = F.flatten(F.transform(state["stuck"], lambda pair: split(pair, level)))
        return F.when(F.size(state["stuck"]) == 0, state).otherwise(_let(F.transform(pairs, tried), lambda results: F.struct(
            F.transform(F.filter(results, lambda r: ~r["done"]), lambda r: F.struct(r["a"].alias("a"), r["b"].alias("b"))).alias("stuck"),
            (state["own"] + _sum(F.transform(F.filter(results, lambda r: r["done"]), lambda r: r["own"]))).alias("own"),
        )))

    start = F.struct(
        F.array(F.struct(keys.cast(_KEYS).alias("a"), others.cast(_KEYS).alias("b"))).alias("stuck"), F.lit(0).cast("bigint").alias("own"),
    )
    # What no number of blocks takes apart (digests equal in 40 bits) is compared outright.
    return F.aggregate(F.sequence(F.lit(1), F.lit(RETRIES)), start, retry, lambda state: state["own"] + _sum(
        F.transform(state["stuck"], lambda pair: F.size(F.array_except(pair["a"], pair["b"])).cast("bigint")),
    ))


def likeness(keys: Column, cells: Column, others: Column, other_cells: Column) -> Column:
    """Common paragraphs of all of two sketched sets, 0 to 1; two empty sets are alike."""
    own = _let(peel(subtract(cells, other_cells)), lambda result: F.when(
        result["done"], F.size(F.filter(result["found"], lambda c: c["n"] == 1)).cast("bigint"),
    ).otherwise(_larger(keys, others)))
    # Of n digests ``own`` are not in the other set, so that the union has ``own`` more than the other.
    return _let(own, lambda only: F.when(F.size(others) + only == 0, F.lit(1.0)).otherwise(
        (F.size(keys) - only).cast("double") / (F.size(others) + only).cast("double"),
    ))


def fingerprint_text(keys: Column, cells: Column) -> Column:
    """A sketch as text: the number of paragraphs, then number, digests and checks of every cell in hexadecimal digits."""
    return F.concat_ws(",", F.size(keys).cast("string"), F.transform(cells, lambda c: F.when(
        (c["n"] == 0) & (c["key"] == 0) & (c["check"] == 0), F.lit(""),
    ).otherwise(F.concat_ws(":", F.hex(c["n"]), F.hex(c["key"]), F.hex(c["check"])))))


def _in_buckets(documents: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(bucket, guest, uid, id, text): documents dealt by buckets of neighbouring ids; a guest is the first row of the bucket after."""
    spark = documents.sparkSession
    rows = numbered(documents, id=doc_id, text=text)
    order = [F.col("id").asc_nulls_first(), F.col("uid").asc()]
    ids = numbered(documents, id=doc_id)
    total = ids.count()
    size = max(1, min(BUCKET, -(-total // (BUCKETS_A_CORE * spark.sparkContext.defaultParallelism))), -(-total // MOST_BUCKETS))
    firsts = ids.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id()).filter(
        F.col("place").bitwiseAND(F.lit(_IN_PART)) % size == 0,
    ).select(F.to_json(F.struct("id", "uid"), {"ignoreNullFields": "false"}).alias("first")).collect()
    if not firsts:
        return rows.select(F.lit(0).cast("bigint").alias("bucket"), F.lit(False).alias("guest"), "uid", "id", F.coalesce("text", F.lit("")).alias("text"))
    kind = f"struct<id: {rows.schema['id'].dataType.simpleString()}, uid: bigint>"
    found = [json.loads(row["first"]) for row in firsts]
    shelves = [found[k : k + SHELF] for k in range(0, len(found), SHELF)]
    tops = F.from_json(F.lit(json.dumps([shelf[0] for shelf in shelves])), f"array<{kind}>")
    shelf_of = F.from_json(F.lit(json.dumps(shelves)), f"array<array<{kind}>>")
    key = F.struct("id", "uid")
    rows = rows.withColumn("shelf", F.size(F.filter(tops, lambda top: top <= key)) - 1)
    rows = rows.withColumn("own", F.get(shelf_of, F.col("shelf"))).withColumn("nth", F.size(F.filter("own", lambda first: first <= key)) - 1)
    bucket = (F.col("shelf") * SHELF + F.col("nth")).cast("bigint")
    is_first = F.get("own", F.col("nth"))["uid"] == F.col("uid")
    places = F.array(F.struct(bucket.alias("bucket"), F.lit(False).alias("guest")))
    before = F.struct(F.pmod(bucket - 1, F.lit(len(found)).cast("bigint")).alias("bucket"), F.lit(True).alias("guest"))
    return rows.select(
        F.explode(F.when(is_first, F.array_append(places, before)).otherwise(places)).alias("at"), "uid", "id", F.coalesce("text", F.lit("")).alias("text"),
    ).select("at.bucket", "at.guest", "uid", "id", "text").repartition(len(found), "bucket")


def fingerprints(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS) -> DataFrame:
    """Fingerprint of each text and of an edited one, and how alike they and the next document are.

    doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.  The edited text has
    its last half (rounded down) replaced by as many code points of the next document by ascending id, the
    last one's next being the first.  Likeness is that of the sets of paragraphs.

    A null text is empty; texts without words are alike and have the fingerprint of an empty set.  Null ids
    come first, equal ids follow one another as they lie in the files, repeated rows are rows of their own; a single document is
    its own next.  A paragraph counts once however often it stands in a text.  ``documents`` must come straight
    from stored files or the driver.
    """
    tuned(documents.sparkSession)
    own = _in_buckets(documents, doc_id, text).withColumn("keys", paragraph_digests(F.col("text"), words)).withColumn("cells", sketch(F.col("keys")))
    order = Window.partitionBy("bucket").orderBy("guest", F.col("id").asc_nulls_first(), "uid")
    pairs = own.select(
        "id", "guest", "text", "keys", "cells", F.lead("text").over(order).alias("next_text"),
        F.lead("keys").over(order).alias("next_keys"), F.lead("cells").over(order).alias("next_cells"),
    ).filter(~F.col("guest"))
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    pairs = pairs.withColumn("n", n.cast("bigint")).withColumn(
        "edited", F.concat(F.left(F.col("text"), n - half), F.left(F.col("next_text"), half)),
    ).withColumn("new_keys", paragraph_digests(F.col("edited"), words)).withColumn("new_cells", sketch(F.col("new_keys")))
    return pairs.select(
        F.col("id").alias("doc_id"), F.col("n").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint_text(F.col("keys"), F.col("cells")).alias("fingerprint"),
        fingerprint_text(F.col("new_keys"), F.col("new_cells")).alias("edited_fingerprint"),
        likeness(F.col("keys"), F.col("cells"), F.col("new_keys"), F.col("new_cells")).alias("near_edited"),
        likeness(F.col("keys"), F.col("cells"), F.col("next_keys"), F.col("next_cells")).alias("near_next"),
    )


def op13_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its fingerprint, that of its edited text and both likenesses."""
    return fingerprints(table(spark, sf_dir, "documents"))
