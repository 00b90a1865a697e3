import hashlib
import os
import sys
from collections import defaultdict

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

import corpus_pipeline  # noqa: E402
from siftline.llm.queries import ORACLE_SQL, QUERIES  # noqa: E402

from . import test_decontaminate, test_jaccard, test_quality, test_suffixes  # noqa: E402


@pytest.fixture(scope="module")
def folder(spark, random_prose, odd_rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    shared = random_prose(70, 70)
    items = [(k, random_prose(800 + k, 30)) for k in range(5)]
    rows = [(doc, text) for doc, text in odd_rows if doc not in (6, 7, 8, 9)]
    rows += [(100 + k, random_prose(100 + k, 150)) for k in range(30)]
    rows += [(200 + k, random_prose(100 + k, 150) + " tail") for k in range(8)]
    rows += [(300 + k, random_prose(300 + k, 90) + shared + random_prose(400 + k, 40)) for k in range(6)]
    rows += [(400 + k, random_prose(500 + k, 90) + items[k][1] + random_prose(600 + k, 90)) for k in range(4)]
    rows += [(500 + k, " | ".join(random_prose(700 + k, 80)[::-1].split())) for k in range(5)]
    documents = [(doc, text, "en", "src", None if text is None else len(text)) for doc, text in rows]
    spark.createDataFrame(documents, "doc_id bigint, text string, lang string, source string, n_chars bigint").coalesce(1).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(100 + k, 1, 0) for k in range(30)], "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, rows, items


def test_stages_equal_brute_force(spark, folder):
    path, rows, items = folder
    assert [len(s) for s in corpus_pipeline.STAGES] == [2] * 5
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns = docs.columns
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        docs = spark.createDataFrame(stage(spark, docs, path).collect(), docs.schema).coalesce(1)
        assert docs.columns == columns
        got = sorted(((r.doc_id, r.text) for r in docs.collect()), key=repr)
        if number == 0:
            rows = [r for r, e in zip(rows, test_quality.expected(rows, {100 + k for k in range(30)})) if e[-2]]
        elif number == 1:
            component = {e[0]: e[2] for e in test_jaccard.expected(rows)}
            rows = [r for r in rows if component[r[0]] == r[0]]
        elif number == 2:
            left = {e[0]: e[4] for e in test_suffixes.expected(rows)}
            assert {d: hashlib.sha256((t or "").encode()).hexdigest() for d, t in got} == left
            rows = got
        else:
            dirty = {e[0] for e in test_decontaminate.expected(rows, items) if e[-1]}
            rows = [r for r in rows if r[0] not in dirty]
        assert got == sorted(rows, key=repr)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, path).collect()
    assert {r.doc_id for r in packed} == {r[0] for r in rows}
    assert {100 + k for k in range(30)} <= {r[0] for r in rows} and not any(400 <= r[0] < 404 or r[0] >= 500 for r in rows)


def test_near_duplicates_share_eight_tenths_of_five_words(spark, random_prose, tmp_path):
    rows = []
    for family in range(12):
        words = [f"{w}{n}" for n, w in enumerate(random_prose(950 + family, 100).split())]
        rows.append((1000 + 10 * family, " ".join(words)))
        for copy, changed in enumerate(((20, 70), (20, 21), (15, 40, 80), (10, 30, 50, 70))):
            other = list(words)
            for k in changed:
                other[k] = f"other{family}x{copy}x{k}"
            rows.append((1001 + 10 * family + copy, " ".join(other)))
    spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1).write.parquet(f"{tmp_path}/rows.parquet")
    kept = dict(corpus_pipeline.STAGES)["near duplicates"](spark, spark.read.parquet(f"{tmp_path}/rows.parquet"), "")
    sets = [{tuple(words[k : k + 5]) for k in range(len(words) - 4)} for words in (text.split() for _, text in rows)]
    root = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                low, high = sorted((root[a], root[b]))
                root = [low if r == high else r for r in root]
    # Two scattered words of a hundred are a duplicate here, and none by nine tenths of three words.
    assert root[1] == root[0] != root[4]
    assert {r.doc_id for r in kept.collect()} == {doc for k, (doc, _) in enumerate(rows) if root[k] == k}


def test_run_applies_all_stages(spark, folder):
    found = corpus_pipeline.run(spark, folder[0]).collect()
    ends = defaultdict(int)
    for r in found:
        ends[r.sequence_id] += r.length
    assert found and max(ends.values()) <= 2048


def test_a_query_for_every_operator():
    assert [name.split("_")[0] for name in QUERIES] == [f"op{n}" for n in range(1, 11)]
    assert set(ORACLE_SQL) <= set(QUERIES)
