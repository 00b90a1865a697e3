import math
import re
import struct
from collections import Counter

import pytest
import xxhash

from siftline.llm.quality import BUCKETS, COLUMNS, SMOOTHING, THRESHOLD, judge_quality, quality_documents

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
    count = Counter(windows)
    repeated = {k + j for k, w in enumerate(windows) if count[w] > 1 for j in range(5)}
    lines = [line for line in text.split("\n") if WORD.search(line)]
    failed = len(words) < 10 or 100 * len(repeated) > 20 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(repeated), failed


def buckets(text):
    words = [xxhash.xxh64_intdigest(w.encode(), 42) for w in WORD.findall(text or "")]
    chained = lambda value, seed: xxhash.xxh64_intdigest(struct.pack("<Q", value), seed)
    pairs = [chained(a, 42) if b is None else chained(b, chained(a, 42)) for a, b in zip(words, [*words[1:], None])]
    return [x % BUCKETS for x in words + pairs]


def weights(rows, trusted):
    raw, target = Counter(), Counter()
    for doc, text in rows:
        grams = buckets(text)
        raw.update(grams)
        if doc in trusted:
            target.update(grams)
    n, m = sum(raw.values()), sum(target.values())
    if not m:
        return lambda bucket: 0.0
    return lambda b: math.log((target[b] + SMOOTHING) / (raw[b] * m / n + SMOOTHING))


def expected(rows, trusted):
    weight = weights(rows, trusted)
    out = []
    for doc, text in rows:
        grams = buckets(text)
        score = sum(map(weight, grams)) / len(grams) if grams else 0.0
        figures = base(text)
        out.append((doc, *figures, not figures[-1] and score >= THRESHOLD, score))
    return out


def key(row):
    return tuple((x is None, x) for x in row[:-1])


def check(found, rows, trusted):
    got = sorted((tuple(r) for r in found.select("row.doc_id", *COLUMNS).collect()), key=key)
    want = sorted(expected(rows, trusted), key=key)
    assert [g[:-1] for g in got] == [w[:-1] for w in want]
    for g, w in zip(got, want):
        assert g[-1] == pytest.approx(w[-1], abs=1e-9)


def test_quality_equals_brute_force(spark, documents, odd_rows, random_prose):
    rows = odd_rows + [(100 + k, random_prose(k, 30 + k)) for k in range(20)]
    rows += [(200 + k, " ".join(f"{w}%%%" for w in random_prose(k, 40).split())) for k in range(5)]
    labels = spark.createDataFrame(
        [(100 + k, 1, 0) for k in range(12)] + [(112, 1, 1), (113, 0, 0), (None, 1, 0), (999, 1, 0), (114, None, None), (100, 1, 0)],
        "doc_id bigint, quality int, toxic int",
    )
    check(judge_quality(documents(rows), labels), rows, {100 + k for k in range(12)})


def test_without_labels_only_the_rules_decide(spark, documents, odd_rows):
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    check(judge_quality(documents(odd_rows), labels), odd_rows, set())


def test_threshold_separates_junk(spark, documents, random_prose):
    good = [(k, random_prose(k, 120)) for k in range(60)]
    junk = [(100 + k, " | ".join(random_prose(500 + k, 60)[::-1].split())) for k in range(20)]
    labels = spark.createDataFrame([(k, 1, 0) for k in range(0, 60, 2)], "doc_id bigint, quality int, toxic int")
    frame = documents(good + junk)
    kept = quality_documents(frame, labels)
    assert kept.columns == frame.columns
    assert sorted(r.doc_id for r in kept.collect()) == list(range(60))


def test_empty_tables(spark, documents):
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id bigint, quality int, toxic int")
    assert judge_quality(documents([]), labels).collect() == []


def test_no_python_in_the_plan(spark, documents, odd_rows):
    labels = spark.createDataFrame([(6, 1, 0)], "doc_id bigint, quality int, toxic int")
    plan = judge_quality(documents(odd_rows), labels)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
