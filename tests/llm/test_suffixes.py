import hashlib
from collections import Counter

import numpy as np
import pytest

from siftline.llm.suffixes import cut_repeats, documents_without_repeats, multikey_order


def expected(rows):
    count = Counter()
    for _, text in rows:
        data = (text or "").encode()
        count.update(data[k : k + 200] for k in range(len(data) - 199))
    out = []
    for doc, text in rows:
        data = (text or "").encode()
        gone = np.zeros(len(data) + 1, bool)
        for k in range(len(data) - 199):
            if count[data[k : k + 200]] > 1:
                gone[k : k + 200] = True
        left = bytes(b for b, g in zip(data, gone) if not g)
        out.append((doc, len(data), int(gone.sum()), int((gone[1:] < gone[:-1]).sum()), hashlib.sha256(left).hexdigest()))
    return sorted(out, key=repr)


def got(frame):
    return sorted((tuple(r) for r in cut_repeats(frame).select("row.doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()), key=repr)


@pytest.fixture(scope="module")
def passages(random_prose):
    shared, other = random_prose(70, 60), "é" + random_prose(71, 45)
    rows = [(100 + k, random_prose(200 + k, 20 + k) + shared + random_prose(300 + k, 30)) for k in range(30)]
    rows += [(200 + k, random_prose(400 + k, 9) + other[k : k + 230 + k] + "." * k) for k in range(12)]
    rows += [(300, shared[:200]), (301, shared[:199]), (302, random_prose(72, 100) * 3), (303, shared + other), (304, "ab" * 300), (305, "ab" * 150 + "c" * 260)]
    return rows


def test_equals_brute_force(documents, odd_rows, passages):
    assert got(documents(odd_rows + passages)) == expected(odd_rows + passages)


def test_many_buckets(spark, documents, passages):
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = passages + [(500 + k, passages[0][1]) for k in range(40)]
        assert got(documents(rows)) == expected(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_a_text_longer_than_a_slab(documents):
    pick = np.random.default_rng(5)
    long = "".join(map(chr, pick.integers(97, 123, 4_500_000)))
    rows = [(1, long), (2, "X" * 50 + long[1_999_900:2_000_300] + "Y" * 50), (3, long[4_499_700:])]
    out = {r[0]: r[2:4] for r in got(documents(rows))}
    assert out == {1: (700, 2), 2: (400, 1), 3: (300, 1)}


def test_texts_without_repeats(spark, random_prose):
    shared = random_prose(70, 60)
    rows = [(1, "first é" + shared, 0), (2, shared + "é last", 0), (3, None, None), (4, "untouched", 9)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, n_chars bigint")
    out = documents_without_repeats(frame)
    assert out.schema.simpleString() == frame.schema.simpleString()
    kept = {r.doc_id: (r.text, r.n_chars) for r in out.collect()}
    assert kept[3] == (None, None) and kept[4] == ("untouched", 9)
    assert all(kept[k][1] == len(kept[k][0]) < 20 for k in (1, 2))


def test_empty_table(documents):
    assert got(documents([])) == []


def test_multikey_order_is_the_sorted_order():
    pick = np.random.default_rng(3)
    tokens = [pick.integers(0, 3, 500) for _ in range(6)]
    order = multikey_order(tokens)
    assert [tuple(t[k] for t in tokens) for k in order] == sorted(zip(*(t.tolist() for t in tokens)))
