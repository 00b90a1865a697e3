"""Quality rules: hashed n-gram log-likelihood ratio between a trusted target and the raw corpus.

Single words and pairs of words are hashed into buckets.  Over all documents, and over trusted ones, the
buckets are counted, and the raw counts are scaled to the size of the target.  Both multinomials are smoothed
alike, so that what is rare says little, and the logarithm of their ratio is the weight of a bucket.  A document's score is the mean weight of its n-grams, and it is kept at a score of ``threshold``
or more, if the plain rules of its words and lines let it pass.

Only DataFrame functions are used.  Counting shuffles one row per bucket and task; the weights are one
array of ``buckets`` doubles; scoring shuffles nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.llm.common import table, tuned

#: Buckets of n-grams, and what is added to the count of each in both multinomials.
BUCKETS = 1 << 16
SMOOTHING = 5.0
#: Trusted rows that the target is fitted on, at most: those with the smallest hashes of their ids.
MAX_TRUSTED = 20_000
#: Mean weight under which a document goes.
THRESHOLD = -0.2

#: Fixed values of the plain rules.
MIN_WORDS = 10
REPEAT_WINDOW = 5
MAX_REPEAT_PERCENT = 20
SYMBOLS = r"[#*$%&|<>]"
BLANK = r"[\x20\x09-\x0D]+"

COLUMNS = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score",
)


def _words(text: Column) -> Column:
    return F.array_remove(F.split(text, BLANK, -1), "")


def _hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def _pairs(hashes: Column) -> Column:
    """A hash of each word and the next; the last word pairs with the end of the text."""
    return F.zip_with(hashes, F.slice(hashes, F.lit(2), F.greatest(F.size(hashes), F.lit(1))), lambda a, b: F.xxhash64(a, b))


def _bucket(hashed: Column, buckets: int) -> Column:
    return F.pmod(hashed, F.lit(buckets))


def bucket_weights(
    documents: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", buckets: int = BUCKETS,
    smoothing: float = SMOOTHING, max_trusted: int = MAX_TRUSTED,
) -> DataFrame:
    """One row: ``weights``, an array with the log ratio of every bucket.

    Trusted are documents that ``labels`` (doc_id, quality, toxic) calls good and not toxic; at most
    ``max_trusted`` ids, those with the smallest hashes, are broadcast.  The raw counts cover all documents.
    Without trusted documents all weights are 0.
    """
    trusted = labels.filter("quality = 1 AND coalesce(toxic, 0) = 0 AND doc_id IS NOT NULL").select(
        F.col("doc_id").alias("trusted"),
    ).distinct().orderBy(F.xxhash64("trusted"), "trusted").limit(max_trusted)
    words = documents.select(
        F.col(f"`{doc_id}`").alias("doc_id"), _hashes(_words(F.coalesce(F.col(f"`{text}`"), F.lit("")))).alias("hashes"),
    ).join(F.broadcast(trusted), F.col("doc_id") == F.col("trusted"), "left")
    grams = words.select(
        F.col("trusted").isNotNull().alias("good"), F.explode(F.concat("hashes", _pairs(F.col("hashes")))).alias("gram"),
    )
    counts = grams.groupBy(_bucket(F.col("gram"), buckets).cast("int").alias("bucket")).agg(
        F.count("*").alias("raw"), F.sum(F.col("good").cast("bigint")).alias("target"),
    )
    every = documents.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    filled = every.join(counts, "bucket", "left").na.fill(0, ["raw", "target"])
    # One row of ``buckets`` entries, whatever the input.
    total = filled.agg(
        F.sum("raw").alias("all_raw"), F.sum("target").alias("all_target"),
        F.array_sort(F.collect_list(F.struct("bucket", "raw", "target"))).alias("counts"),
    )
    return total.select(F.when(
        F.col("all_target") > 0,
        F.transform("counts", lambda c: F.log(
            (c["target"] + smoothing) / (c["raw"] * (F.col("all_target") / F.col("all_raw")) + smoothing)
        )),
    ).otherwise(F.array_repeat(F.lit(0.0), buckets)).alias("weights"))


def _repeated_words(frame: DataFrame) -> DataFrame:
    """Adds ``n_repeat_words``: words in windows of five that are found twice or more in the text."""
    hashes, pairs = F.col("hashes"), F.col("pairs")
    # A window is a pair, the pair two words on, and a last word.
    count = F.greatest(F.size("words") - (REPEAT_WINDOW - 1), F.lit(0))
    part = lambda values, start: F.slice(values, F.lit(start), count)
    fours = F.zip_with(part(pairs, 1), part(pairs, 3), lambda a, b: F.xxhash64(a, b))
    hashed = frame.withColumn("windows", F.zip_with(fours, part(hashes, 5), lambda a, b: F.xxhash64(a, b)))
    # Equal windows have equal hashes, so texts without equal hashes are done; the others compare the words.
    again = F.size(F.array_distinct("windows")) < F.size("windows")
    zipped = F.arrays_zip(*[part(F.col("words"), k + 1).alias(f"w{k}") for k in range(REPEAT_WINDOW)])
    ordered = hashed.withColumn("zipped", F.when(again, zipped)).withColumn("ordered", F.sort_array(F.transform(
        "zipped", lambda w, i: F.struct(F.concat_ws(" ", *[w[f"w{k}"] for k in range(REPEAT_WINDOW)]).alias("w"), i.alias("i")),
    )))
    n = F.size("ordered")
    twins = F.zip_with(
        F.slice("ordered", F.lit(1), n - 1), F.slice("ordered", F.lit(2), n - 1),
        lambda a, b: F.when(a["w"] == b["w"], F.array(a["i"], b["i"])).otherwise(F.array().cast("array<int>")),
    )
    starts = F.sort_array(F.array_distinct(F.flatten(twins)))
    covered = F.aggregate(
        starts, F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).alias("end")),
        lambda a, i: F.struct(
            (a["n"] + (i + REPEAT_WINDOW - F.greatest(i, a["end"]))).alias("n"), (i + REPEAT_WINDOW).alias("end"),
        ),
    )["n"]
    return ordered.withColumn("n_repeat_words", F.when(F.col("ordered").isNull(), F.lit(0).cast("bigint")).otherwise(covered)).drop(
        "windows", "zipped", "ordered",
    )


def judge_quality(
    documents: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", buckets: int = BUCKETS,
    threshold: float = THRESHOLD, **options,
) -> DataFrame:
    """Every row of ``documents`` as struct ``row``, with its counts, score and verdict.

    ``n_words`` counts words (runs without 20 and 09-0D), ``word_chars`` their code points, ``n_symbols``
    characters of ``#*$%&|<>``, ``n_dup_lines`` lines with a word that equal an earlier line and
    ``n_repeat_words`` words in five-word windows found twice or more.  ``base_failed``: fewer than ten
    words, or more than a fifth of them repeated.  A null or empty text has no words, scores 0 and fails.
    Repeated rows are judged alike; labels of unknown documents, and null labels, do not count.
    """
    tuned(documents.sparkSession)
    weights = bucket_weights(documents, labels, doc_id, text, buckets, **options)
    content = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    frame = documents.select(F.struct("*").alias("row"), content.alias("text")).withColumn("words", _words(F.col("text"))).withColumn("hashes", _hashes(F.col("words")))
    lines = F.filter(F.split("text", "\n", -1), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    frame = frame.withColumns({
        "n_words": F.size("words").cast("bigint"),
        "word_chars": F.char_length(F.array_join("words", "")).cast("bigint"),
        "n_symbols": F.regexp_count("text", F.lit(SYMBOLS)).cast("bigint"),
        "lines": lines, "pairs": _pairs(F.col("hashes")), "weights": weights.scalar(),
    })
    frame = frame.withColumn("n_dup_lines", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint"))
    total = F.lit(0.0)
    for grams in ("hashes", "pairs"):
        total = F.aggregate(grams, total, lambda sum_, x: sum_ + F.get("weights", _bucket(x, buckets).cast("int")))
    frame = frame.withColumn("score", F.when(F.size("hashes") == 0, F.lit(0.0)).otherwise(total / (2 * F.size("hashes"))))
    frame = _repeated_words(frame).withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (
        F.lit(100) * F.col("n_repeat_words") > F.lit(MAX_REPEAT_PERCENT) * F.col("n_words")
    ))
    # A row number is not deterministic: a filter on the verdict stays above it, or all would be computed again below.
    held = F.monotonically_increasing_id() >= 0
    frame = frame.withColumn("kept", ~F.col("base_failed") & (F.col("score") >= threshold) & held)
    return frame.select("row", *COLUMNS)


def quality_documents(documents: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The documents that are kept, all columns as they were."""
    return judge_quality(documents, labels, **options).filter("kept").select("row.*")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its counts, score and verdict."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return judge_quality(documents, table(spark, sf_dir, "labels")).select("row.doc_id", *COLUMNS)
