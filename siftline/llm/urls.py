"""URL filter: rules on host and path, and a logistic regression on hashed character n-grams for the rest."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.llm.common import BASE, BASE_INVERSE, mixed, powers, table

#: Buckets that n-grams are hashed into, and the lengths of the n-grams.
BUCKETS = 1 << 16
LENGTHS = (3, 4, 5)

#: At most so many labelled rows are fitted on the driver.
MAX_LABELLED = 20_000

#: The rules of the registered query: verdict, and host with path.
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))

#: Labelled URLs of the registered query: 1 is to be blocked.
LABELLED = tuple(
    [(f"http://{pre}{name}.example.{end}/{path}", 1)
     for name, pre, end, path in (
         ("casino-win", "www.", "com", "en/12"), ("casino-win", "", "net", "fr/860.html"), ("big-casino", "", "com", "de/7"),
         ("cheap-pills", "m.", "com", "en/450"), ("cheap-pills", "blog.", "net", "es/31/"), ("pills-online", "", "net", "en/5"),
         ("free-bets", "m.", "com", "en/27"), ("free-bets", "", "net", "de/963"), ("bets-today", "www.", "com", "fr/1"),
         ("spam-farm", "www.", "com", "en/728"), ("spam-farm", "", "net", "es/14.html"), ("link-farm", "", "com", "en/99"),
         ("ads-track", "m.", "com", "en/584"), ("ads-track", "", "net", "de/3/"), ("ad-tracker", "", "net", "fr/61"),
         ("adult-x", "www.", "com", "en/61"), ("adult-x", "blog.", "net", "es/8"), ("adult-cams", "", "com", "en/2"),
         ("win-lottery", "", "com", "en/4"), ("poker-bonus", "www.", "net", "fr/90"), ("payday-loan", "", "com", "en/66"),
         ("viagra-shop", "", "net", "de/15"), ("xxx-video", "m.", "com", "en/18"), ("malware-load", "", "net", "en/71"))]
    + [(f"https://{pre}{name}.example.{end}/{path}", 0)
       for name, pre, end, path in (
           ("news", "www.", "com", "en/12"), ("garden", "blog.", "net", "de/860.html"), ("thonan", "", "com", "fr/7"),
           ("history", "m.", "com", "en/450"), ("ththre", "", "net", "es/31/"), ("library", "www.", "net", "en/5"),
           ("therha", "", "com", "en/27"), ("museum", "", "net", "de/963"), ("tionsh", "blog.", "com", "fr/1"),
           ("weather", "www.", "com", "en/728"), ("recipes", "", "net", "es/14.html"), ("inered", "m.", "com", "en/99"),
           ("science", "", "com", "en/584"), ("school", "", "net", "de/3/"), ("ereson", "blog.", "net", "fr/61"),
           ("travel", "www.", "com", "en/61"), ("music", "blog.", "net", "es/8"), ("anthly", "", "com", "en/2"),
           ("health", "", "com", "en/4"), ("books", "www.", "net", "fr/90"), ("handen", "", "com", "en/66"),
           ("city-guide", "", "net", "de/15"), ("open-source", "m.", "com", "en/18"), ("ouster", "", "net", "en/71"),
           ("river-walk", "blog.", "com", "es/640"), ("film-review", "", "net", "en/385.html"), ("ndther", "www.", "com", "de/12"))]
)


@dataclass(frozen=True)
class UrlModel:
    """Weights by bucket and the bias; a URL is blocked at a positive sum."""

    weights: np.ndarray
    bias: float


def url_host(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; else empty."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def _features(hosts: list[str], paths: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Row and bucket of every n-gram of ``^host$`` and of the path, each with its own salt."""
    rows, buckets = [], []
    for salt, texts in ((0x51ED, [f"^{x}$".encode() for x in hosts]), (0xA3B7, [x.encode() for x in paths])):
        data = np.frombuffer(b"".join(texts), np.uint8).astype(np.uint64)
        at = np.concatenate([[0], np.cumsum([len(x) for x in texts])]).astype(np.int64)
        row = np.repeat(np.arange(len(texts)), np.diff(at))
        prefix = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data + np.uint64(1)) * powers(int(BASE), len(data) + 1)[:-1], out=prefix[1:])
        for n in LENGTHS:
            start = np.arange(max(0, len(data) - n + 1))
            start = start[row[start] == row[start + n - 1]] if len(start) else start
            value = (prefix[start + n] - prefix[start]) * powers(BASE_INVERSE, len(data) + 1)[start]
            rows.append(row[start])
            buckets.append((mixed(value ^ np.uint64(salt)) % np.uint64(BUCKETS)).astype(np.int64))
    return np.concatenate(rows), np.concatenate(buckets)


def _rates(rows: np.ndarray, count: int) -> np.ndarray:
    """One over the root of the n-grams of each row."""
    return 1 / np.sqrt(np.maximum(1, np.bincount(rows, minlength=count)))


def fit_urls(labelled: Sequence[tuple[str, str, int]], steps: int = 400, rate: float = 2.0, ridge: float = 1e-4) -> UrlModel:
    """Weights by full gradient steps from zero over (host, path, label); the same rows give the same model.

    No rows give a model that blocks nothing.
    """
    if not labelled:
        return UrlModel(np.zeros(BUCKETS), -1.0)
    hosts, paths, labels = (list(x) for x in zip(*labelled, strict=True))
    rows, buckets = _features(hosts, paths)
    scale, truth = _rates(rows, len(labels)), np.array(labels, float)
    weights, bias = np.zeros(BUCKETS), 0.0
    for _ in range(steps):
        total = np.bincount(rows, weights[buckets], len(truth)) * scale + bias
        error = 1 / (1 + np.exp(-total)) - truth
        weights -= rate * (np.bincount(buckets, (error * scale)[rows], BUCKETS) / len(truth) + ridge * weights)
        bias -= rate * error.mean()
    return UrlModel(weights, bias)


def labelled_rows(labelled: DataFrame) -> list[tuple[str, str, int]]:
    """(host, path, label) of a small table with ``url`` and ``label``; raises beyond MAX_LABELLED rows."""
    found = labelled.filter("label IS NOT NULL").select(
        url_host(F.col("url")), url_path(F.col("url")), F.col("label").cast("int"),
    ).limit(MAX_LABELLED + 1).collect()
    if len(found) > MAX_LABELLED:
        raise ValueError(f"the labelled table has more than {MAX_LABELLED} rows")
    return [tuple(row) for row in found]


def score_urls(model: UrlModel, hosts: list[str], paths: list[str]) -> np.ndarray:
    """Log odds that a URL is to be blocked."""
    rows, buckets = _features(hosts, paths)
    return np.bincount(rows, model.weights[buckets], len(hosts)) * _rates(rows, len(hosts)) + model.bias


def filter_urls(
    pages: DataFrame, labelled: DataFrame, rules: Sequence[tuple[str, str]] = (), page_id: str = "page_id", url: str = "url",
) -> DataFrame:
    """Page id, host, path, rule, verdict and score of every page.

    A rule is (``allow`` or ``block``, host with path); it fits its host and the hosts below it if the
    path starts with the rule's; the longest that fits decides, the first of equal rules.  Where none
    fits, the regression fitted to ``labelled`` (``url``, ``label`` 1 for blocked) decides.

    A null URL, or one without ``://``, has an empty host and path, fits no rule and is judged by the
    bias and the n-grams of an empty host.  Repeated rows are judged alike; other columns are ignored.
    """
    model = fit_urls(labelled_rows(labelled))
    by_host: dict[str, list[tuple[str, str, str]]] = {}
    for verdict, rule in rules:
        host, slash, rest = rule.partition("/")
        by_host.setdefault(host.lower(), []).append((slash + rest, rule, verdict))
    kept = pages.sparkSession.sparkContext.broadcast((model, by_host))

    def ruled(host: str, path: str) -> tuple[str | None, str | None]:
        best: tuple[str | None, str | None] = (None, None)
        below = host
        while below:
            for start, rule, verdict in kept.value[1].get(below, ()):
                if path.startswith(start) and (best[0] is None or len(rule) > len(best[0])):
                    best = (rule, verdict)
            below = below.partition(".")[2]
        return best

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, paths = batch.column("host").to_pylist(), batch.column("path").to_pylist()
            scores = score_urls(kept.value[0], hosts, paths)
            found = [ruled(*pair) for pair in zip(hosts, paths, strict=True)]
            verdicts = [verdict or ("block" if score > 0 else "allow") for (_, verdict), score in zip(found, scores, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("host"), batch.column("path"),
                 pa.array([rule for rule, _ in found], pa.string()), pa.array(verdicts, pa.string()), pa.array(scores, pa.float64())],
                ["page_id", "host", "path", "rule", "verdict", "score"],
            )

    kind = pages.select(F.col(f"`{page_id}`")).schema[0].dataType.simpleString()
    picked = pages.select(
        F.col(f"`{page_id}`").alias("page_id"), url_host(F.col(f"`{url}`")).alias("host"), url_path(F.col(f"`{url}`")).alias("path"),
    )
    return picked.mapInArrow(judge, f"page_id {kind}, host string, path string, rule string, verdict string, score double")


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page judged by the five rules and the regression."""
    labelled = spark.createDataFrame(list(LABELLED), "url string, label int")
    return filter_urls(table(spark, sf_dir, "pages"), labelled, RULES)
