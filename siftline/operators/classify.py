"""A small text classifier: multinomial naive Bayes over the tokens of a text.

Definition used here: tokens are runs of non-blank characters, case-sensitive, or character
n-grams if asked for; add-``smoothing`` over the vocabulary of all classes together; a token
unknown to the model counts as seen zero times; of equal scores the class last in the alphabet
wins (``low-interest`` over ``high-interest``).

score(class | text) = log(prior) + Σ over tokens log((n(token, class) + s) / (N(class) + s·V))
"""

from __future__ import annotations

import json
import math
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from siftline.functions.skew import BROADCAST_BYTES, fits_broadcast
from siftline.session import stored

HIGH, LOW = "high-interest", "low-interest"
DEFAULT_SMOOTHING = 1.1

# Training texts of the default model.
DEFAULT_TEXTS = {
    HIGH: ["AKIA", "SECRET", "PRIVATE KEY", "mongodb://", "mysql://", "token", "password", "auth"],
    LOW: ["//", "import", "func", "<html>", "package", "var", "const", "class"],
}

#: Classes up to which each has a score column of its own, and scores and tokens that a task holds at once.
SCORE_COLUMNS = 100
SCORES = 4_000_000
SCORED_TOKENS = 500_000

#: Largest vocabulary that is broadcast, as a table of two to four slots a token; most classes that are broadcast to count them.
BROADCAST_TOKENS = 10_000_000
BROADCAST_LABELS = 1_000_000

#: Most tokens and bytes of the frequent part of a larger model, and most tokens and bytes of texts that are sent to its rest.
HEAD_TOKENS = 1 << 19
HEAD_BYTES = 64 << 20
SENT_TOKENS = 300_000
SENT_BYTES = 16 << 20


def tokens(text: Column, ngram: int = 0) -> Column:
    """The tokens of a text: words, or all runs of ``ngram`` characters."""
    if ngram:
        starts = F.sequence(F.lit(1), F.char_length(text) - ngram + 1)
        grams = F.transform(starts, lambda start: F.substring(text, start, F.lit(ngram)))
        return F.when(F.char_length(text) >= ngram, grams).otherwise(F.array(text))
    return F.filter(F.split(text, r"\s+"), lambda token: token != "")


class TokenTable:
    """The gains of a model as an open-addressed hash table in arrays.

    A token lies in the first free slot from that of its hash on; ``reach`` is how far the farthest one lies.  The last slots
    have ``reach`` more behind them, so a probe never runs over the end.  A token's gains are those of the classes it
    was seen in: ``classes`` and ``gains`` from ``bounds`` of the token on.
    """

    def __init__(self, hashes: np.ndarray, bounds: np.ndarray, classes: np.ndarray, gains: np.ndarray, labels: int) -> None:
        if len(np.unique(hashes)) < len(hashes):
            raise ValueError("two tokens of the model have the same hash")
        size = 1 << max(4, (2 * len(hashes)).bit_length())
        self.mask = np.uint64(size - 1)
        home = (hashes.view(np.uint64) & self.mask).astype(np.int64)
        order = np.argsort(home, kind="stable")
        # In the order of their slots, each token is put one behind the last or into its own slot.
        rank = np.arange(len(order))
        slot = np.maximum.accumulate(home[order] - rank) + rank if len(order) else rank
        self.reach = int((slot - home[order]).max(initial=0))
        self.keys = np.zeros(size + self.reach + 1, np.int64)
        self.token = np.full(len(self.keys), -1, np.int64)
        self.keys[slot], self.token[slot] = hashes[order], order
        self.bounds, self.classes, self.gains, self.labels = bounds, classes, gains, labels

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each hash's token; -1 for unknown ones."""
        home = (hashes.view(np.uint64) & self.mask).astype(np.int64)
        found = np.full(len(hashes), -1, np.int64)
        left = np.arange(len(hashes))
        for step in range(self.reach + 1):
            slot = home[left] + step
            hit = (self.token[slot] >= 0) & (self.keys[slot] == hashes[left])
            found[left[hit]] = self.token[slot[hit]]
            left = left[~hit & (self.token[slot] >= 0)]
            if not len(left):
                break
        return found

    def sums(self, hashes: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
        """The summed gains of the hashes of each row, by class; unknown ones add nothing."""
        return self.sums_of(self.find(hashes), row, rows)

    def sums_of(self, found: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
        """The same for tokens by their numbers."""
        known = found >= 0
        token, row = found[known], row[known]
        many = self.bounds[token + 1] - self.bounds[token]
        place = np.repeat(self.bounds[token] - (np.cumsum(many) - many), many) + np.arange(many.sum())
        key = np.repeat(row, many) * self.labels + self.classes[place]
        return np.bincount(key, self.gains[place], rows * self.labels).reshape(rows, self.labels)


@dataclass(frozen=True)
class TextModel:
    """A fitted model.

    ``entries`` has one row per token: its number ``n`` in all texts and, for each class that has it, by its number in ``labels``, how
    much more the token adds to the score than an unseen one.  ``priors`` and ``unseen`` are log values; ``size`` counts all entries.
    """

    labels: tuple[str, ...]
    priors: tuple[float, ...]
    unseen: tuple[float, ...]
    entries: DataFrame
    vocabulary: int
    size: int
    ngram: int = 0
    _sent: dict[str, Broadcast] = field(default_factory=dict, repr=False, compare=False)
    _limits: dict[int, int] = field(default_factory=dict, repr=False, compare=False)

    @property
    def gains(self) -> DataFrame:
        """(token, gains): the gains of all classes, in the order of ``labels``."""
        classes, values = F.col("entries.class"), F.col("entries.gain")
        return self.entries.select("token", F.transform(F.sequence(F.lit(0), F.lit(len(self.labels) - 1)), lambda number: F.coalesce(
            F.get(values, F.array_position(classes, number).cast("int") - 1), F.lit(0.0),
        )).alias("gains"))

    def fits(self, most: int = BROADCAST_TOKENS) -> bool:
        """Whether the model may be sent to every task, by its counted size."""
        return self.vocabulary <= most and 4 * 24 * self.vocabulary + 12 * self.size <= BROADCAST_BYTES

    def _table(self, least: int = 0) -> Broadcast:
        """The tokens found more than ``least`` times, in every task."""
        key = f"{self.entries.sparkSession.sparkContext.applicationId}-{least}"
        if key not in self._sent:
            chosen = self.entries.filter(F.col("n") > least) if least else self.entries
            rows = chosen.select(F.xxhash64("token").alias("hash"), F.col("entries.class").alias("class"), F.col("entries.gain").alias("gain")).toArrow()
            rows = rows.combine_chunks()
            classes, gains = (_flat(rows.column(name)) for name in ("class", "gain"))
            bounds = np.concatenate([[0], np.cumsum(rows.column("class").combine_chunks().value_lengths().to_numpy(zero_copy_only=False))]) if len(rows) else np.zeros(1)
            table = TokenTable(rows.column("hash").to_numpy(), bounds.astype(np.int64), classes, gains, len(self.labels))
            self._sent[key] = self.entries.sparkSession.sparkContext.broadcast(table)
        return self._sent[key]

    def score_column(self, text: Column) -> Column:
        """The scores of all classes, as an array, in an expression that serves batch and streams alike.

        Tokens are cut and hashed by Spark; the hashes go to Python as Arrow arrays, where the table is probed for many texts
        at once.  Models that do not ``fits`` are for ``classify_text`` on a batch.
        """
        if not self.fits():
            raise ValueError(f"a model of {self.vocabulary} tokens is too large to be sent to every task; use classify_text on a batch")
        table, priors, unseen = self._table(), np.array(self.priors), np.array(self.unseen)

        @F.arrow_udf("array<double>")
        def scores(hashes: pa.Array) -> pa.Array:
            return _scored(hashes, table.value, priors, unseen)[0]

        return scores(_hashes(tokens(F.coalesce(text, F.lit("")), self.ngram)))

    def head_column(self, found: Column, least: int) -> Column:
        """(scores, rest): the scores of all classes by the tokens found more than ``least`` times, and the places of the other tokens."""
        table, priors, unseen = self._table(least), np.array(self.priors), np.array(self.unseen)

        @F.arrow_udf("struct<scores:array<double>,rest:array<int>>")
        def head(hashes: pa.Array) -> pa.Array:
            return pa.StructArray.from_arrays(list(_scored(hashes, table.value, priors, unseen)), ["scores", "rest"])

        return head(_hashes(found))

    def head_limit(self, tokens: int) -> int:
        """The number of occurrences above which ``tokens`` tokens at most are found, of a size that may be sent to every task.

        A row for each different number comes to the driver; these are as few as the root of all occurrences.
        """
        if tokens not in self._limits:
            by_number = self.entries.groupBy("n").agg(F.count("*").alias("many"), F.sum(F.size("entries")).alias("size"))
            many = held = limit = 0
            for row in by_number.orderBy(F.desc("n")).collect():
                many, held = many + row["many"], held + row["size"]
                if many > tokens or 4 * 24 * many + 12 * held > HEAD_BYTES:
                    limit = row["n"]
                    break
            self._limits[tokens] = limit
        return self._limits[tokens]

    def best(self, scores: Column) -> Column:
        """The class with the highest of the scores; later classes win ties."""
        place = F.size(scores) - F.array_position(F.reverse(scores), F.array_max(scores)).cast("int")
        return F.get(F.from_json(F.lit(json.dumps(self.labels)), "array<string>"), place)

    def label_column(self, text: Column) -> Column:
        """The class of a text as an expression."""
        return F.transform(F.array(self.score_column(text)), self.best)[0]


def _hashes(found: Column) -> Column:
    return F.transform(found, lambda token: F.xxhash64(token))


def _scored(hashes: pa.Array, table: TokenTable, priors: np.ndarray, unseen: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """The scores of texts by the hashes of their tokens, and the places of unknown tokens in their texts.

    So many texts are scored at once as have ``SCORED_TOKENS`` tokens and ``SCORES`` scores together, one text at least.
    """
    ends, step = hashes.offsets.to_numpy().astype(np.int64), max(1, SCORES // len(priors))
    totals, places, counts, low = [], [], [], 0
    while low < len(hashes):
        high = min(low + step, max(low + 1, int(np.searchsorted(ends, ends[low] + SCORED_TOKENS, "right")) - 1))
        some = hashes.slice(low, high - low)
        sizes = np.diff(some.offsets.to_numpy())
        row = np.repeat(np.arange(len(sizes)), sizes)
        found = table.find(some.flatten().to_numpy())
        totals.append((priors + sizes[:, None] * unseen + table.sums_of(found, row, len(sizes))).ravel())
        unknown = np.flatnonzero(found < 0)
        places.append((unknown - (np.cumsum(sizes) - sizes)[row[unknown]]).astype(np.int32))
        counts.append(np.bincount(row[unknown], minlength=len(sizes)))
        low = high
    scores = pa.ListArray.from_arrays(pa.array(np.arange(len(hashes) + 1) * len(priors), pa.int32()), pa.array(np.concatenate([np.zeros(0), *totals])))
    bounds = np.cumsum(np.concatenate([np.zeros(1, np.int64), *counts]))
    return scores, pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int32), *places])))


def _flat(column: pa.ChunkedArray) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy() if len(column) else np.zeros(0, np.int64)


def fit_text_classifier(
    training: DataFrame, smoothing: float = DEFAULT_SMOOTHING, text: str = "text", label: str = "label", ngram: int = 0
) -> TextModel:
    """Fit a model to rows of (text, label).

    Token counts are summed before the shuffle and stored in the shared folder; only the totals
    per class come to the driver, however many classes there are.
    """
    rows = training.select(F.col(text).alias("text"), F.col(label).cast("string").alias("label")).filter(
        F.col("text").isNotNull() & F.col("label").isNotNull()
    )
    # One pass over the texts: tokens by class, and under NULL the number of texts of the class.
    found = F.array_append(tokens(F.col("text"), ngram), F.lit(None).cast("string"))
    pairs = stored(rows.select("label", F.explode(found).alias("token")).groupBy("label", "token").agg(F.count(F.lit(1)).alias("n")))
    totals = pairs.groupBy("label").agg(
        F.sum(F.when(F.col("token").isNull(), F.col("n"))).alias("texts"),
        F.coalesce(F.sum(F.when(F.col("token").isNotNull(), F.col("n"))), F.lit(0)).alias("tokens"),
    ).orderBy("label").collect()
    if not totals:
        raise ValueError("a model needs a text with a class")
    # A row per class, as many as the driver holds anyway.
    numbers = training.sparkSession.createDataFrame([(row["label"], number) for number, row in enumerate(totals)], "label string, class int")
    numbers = F.broadcast(numbers) if fits_broadcast(numbers, BROADCAST_LABELS) else numbers
    gain = F.log((F.col("n") + F.lit(smoothing)) / F.lit(smoothing))
    entries = stored(pairs.filter("token IS NOT NULL").join(numbers, "label").groupBy("token").agg(
        F.sum("n").alias("n"), F.sort_array(F.collect_list(F.struct("class", gain.alias("gain")))).alias("entries"),
    ))
    vocabulary, size = entries.agg(F.count("*"), F.coalesce(F.sum(F.size("entries")), F.lit(0))).first()
    texts = sum(row["texts"] for row in totals)
    return TextModel(
        labels=tuple(row["label"] for row in totals),
        priors=tuple(math.log(row["texts"] / texts) for row in totals),
        unseen=tuple(math.log(smoothing / (row["tokens"] + smoothing * vocabulary)) for row in totals),
        entries=entries,
        vocabulary=vocabulary,
        size=size,
        ngram=ngram,
    )


def default_model(spark: SparkSession) -> TextModel:
    """The model that tells interesting matches from code, fitted once per application."""
    application = spark.sparkContext.applicationId
    if application not in _default_models:
        rows = [(text, label) for label, texts in DEFAULT_TEXTS.items() for text in texts]
        training = spark.createDataFrame(rows, "text string, label string").coalesce(1)
        _default_models[application] = fit_text_classifier(training)
    return _default_models[application]


_default_models: dict[str, TextModel] = {}


def classify_text(
    texts: DataFrame, model: TextModel, id: Sequence[str], text: str = "text",
    broadcast_tokens: int = BROADCAST_TOKENS,
) -> DataFrame:
    """(id columns, ``label``, ``score_<class>``…) per text; ``id`` must tell the texts apart.

    With more than ``SCORE_COLUMNS`` classes there is one array ``scores`` instead, in the order of the model's labels.

    A model that is small by its counted size is a table in every task, and nothing is shuffled: that also serves streams.  Of a
    larger one the frequent tokens are such a table, and only tokens that are not among them meet the others by a join.
    """
    if model.fits(broadcast_tokens):
        scored = texts.select(*id, model.score_column(F.col(text)).alias("_scores"))
    else:
        scored = _joined_scores(texts.select(*id, F.col(text).alias("_text")), model, "_text", min(HEAD_TOKENS, broadcast_tokens), id)
    label = model.best(F.col("_scores")).alias("label")
    if len(model.labels) > SCORE_COLUMNS:
        return scored.select(*id, label, F.col("_scores").alias("scores"))
    return scored.select(*id, label, *[F.get("_scores", F.lit(index)).alias(f"score_{name}") for index, name in enumerate(model.labels)])


def _joined_scores(texts: DataFrame, model: TextModel, text: str, head_tokens: int, keep: Sequence[str]) -> DataFrame:
    """(kept columns, ``_scores``) of a batch, by a model that is too large to be sent to every task.

    Rows are stored with a number, their scores by the frequent tokens, and the other tokens.  Only these and the number are joined to
    the model, and only rows that have any are joined to the sums.
    """
    if texts.isStreaming:
        raise ValueError(f"a model of {model.vocabulary} tokens is too large for a stream; run_classified classifies its batches")
    least = model.head_limit(head_tokens)
    # The tokens are a column of their own, so that they are cut once.
    cut = texts.withColumn("_tokens", tokens(F.coalesce(F.col(text), F.lit("")), model.ngram))
    headed = cut.withColumn("_head", model.head_column(F.col("_tokens"), least))
    rows = stored(headed.select(
        *keep, F.monotonically_increasing_id().alias("_row"), F.col("_head.scores").alias("_scores"),
        F.transform("_head.rest", lambda place: F.get("_tokens", place)).alias("_rest"),
    ))
    tail = model.entries.filter(F.col("n") <= least).select("token", "entries")
    rest = rows.select("_row", F.explode("_rest").alias("token"))
    met = tail.join(F.broadcast(rest) if fits_broadcast(rest, SENT_TOKENS, SENT_BYTES) else rest, "token")
    sums = met.select("_row", F.explode("entries").alias("entry")).groupBy("_row", "entry.class").agg(F.sum("entry.gain").alias("gain"))
    gathered = sums.groupBy("_row").agg(F.collect_list(F.struct("class", "gain")).alias("_sums"))
    classes, gains = F.col("_sums.class"), F.col("_sums.gain")
    summed = F.zip_with("_scores", F.sequence(F.lit(0), F.lit(len(model.labels) - 1)), lambda score, number: score + F.coalesce(
        F.get(gains, F.array_position(classes, number).cast("int") - 1), F.lit(0.0),
    ))
    finished = rows.filter(F.size("_rest") == 0).select(*keep, "_scores")
    return finished.unionByName(rows.filter(F.size("_rest") > 0).join(gathered, "_row", "left").select(
        *keep, F.when(F.col("_sums").isNull(), F.col("_scores")).otherwise(summed).alias("_scores"),
    ))


def only_high_interest(findings: DataFrame, model: TextModel | None = None, wanted: str = HIGH) -> DataFrame:
    """Findings whose content the model puts in the wanted class, in batch and on a stream.

    A model that is small by its counted size moves no data.  With a larger one, in batch, only tokens that are not frequent and the
    findings that have them are moved; ``run_classified`` does so for the batches of a stream.
    """
    model = model or default_model(findings.sparkSession)
    if model.fits():
        return findings.filter(model.label_column(F.col("content")) == wanted)
    scored = _joined_scores(findings, model, "content", HEAD_TOKENS, findings.columns)
    return scored.filter(model.best(F.col("_scores")) == wanted).drop("_scores")
