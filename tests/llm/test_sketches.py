import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from siftline.llm import sketches
from siftline.llm.sketches import fingerprints, likeness, paragraph_digests, peel, sketch, subtract

PIECE = re.compile(r"[^ \t\n\x0b\f\r]+(?:[ \t\x0b\f\r]+[^ \t\n\x0b\f\r]+){0,11}")


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def expected(rows):
    """(doc_id, n_chars, edited_sha256, near_edited, near_next) by sets of paragraphs."""
    ordered = sorted(enumerate(rows), key=lambda item: (item[1][0] is not None, item[1][0] or 0, item[0]))
    texts = [(doc, text or "") for _, (doc, text) in ordered]
    out = []
    for k, (doc, text) in enumerate(texts):
        following = texts[(k + 1) % len(texts)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        own, new, nxt = (set(PIECE.findall(t)) for t in (text, edited, following))
        out.append((doc, len(text), hashlib.sha256(edited.encode()).hexdigest(), jaccard(own, new), jaccard(own, nxt)))
    return sorted(out, key=repr)


def got(frame):
    return sorted(((r.doc_id, r.n_chars, r.edited_sha256, r.near_edited, r.near_next) for r in fingerprints(frame).collect()), key=repr)


def test_equals_sets_of_paragraphs(documents, odd_rows, random_prose):
    rows = odd_rows + [(100 + k, random_prose(k, 5 + 17 * k)) for k in range(40)] + [(200, "\n".join(random_prose(k, 30) for k in range(300)))]
    assert got(documents(rows)) == expected(rows)


def test_versions_of_one_text(documents, random_prose):
    """A text and versions with some paragraphs changed, moved and left out."""
    pick = random.Random(3)
    lines = [random_prose(k, 7) .replace("\n", " ") for k in range(60)]
    rows = []
    for k in range(25):
        version = list(lines)
        for _ in range(k):
            version[pick.randrange(len(version))] = f"changed line {pick.randrange(1000)}"
        pick.shuffle(version)
        rows.append((k, "\n".join(version[: 60 - k % 7])))
    assert got(documents(rows)) == expected(rows)


def test_many_buckets(documents, random_prose, monkeypatch):
    """Successors are found over the borders of buckets and shelves."""
    monkeypatch.setattr(sketches, "BUCKET", 3)
    monkeypatch.setattr(sketches, "SHELF", 4)
    rows = [(k * 7 % 101, random_prose(k, 20)) for k in range(101)] + [(50, "again the same id"), (None, "no id")]
    assert got(documents(rows)) == expected(rows)


@pytest.mark.parametrize("rows", [[], [(1, "only one document here")], [(1, None)], [(None, None), (None, None)]])
def test_few_rows(documents, rows):
    assert got(documents(rows)) == expected(rows)


def test_equal_texts_have_equal_fingerprints(documents, random_prose):
    rows = [(1, random_prose(1, 200)), (2, random_prose(2, 200)), (3, random_prose(1, 200)), (4, ""), (5, None)]
    prints = {r.doc_id: r.fingerprint for r in fingerprints(documents(rows)).collect()}
    assert prints[1] == prints[3] != prints[2] and prints[4] == prints[5]
    # The sketch in the text is that of the digests: every cell's number and the sum of all.
    count, *cells = prints[1].split(",")
    assert len(cells) == 24 and sum(int(c.split(":")[0], 16) for c in cells if c) == 3 * int(count) > 0


def test_peeling_recovers_what_differs(spark):
    a, b = [11, -(2**62), 3, 4, 5], [4, 5, 77]
    frame = spark.createDataFrame([(a, b)], "a array<bigint>, b array<bigint>")
    result = frame.select(peel(subtract(sketch(F.col("a"), 16), sketch(F.col("b"), 16)), 16).alias("p")).first().p
    assert result.done and sorted((c.key, c.n) for c in result.found) == sorted([(11, 1), (-(2**62), 1), (3, 1), (77, -1)])


def test_digests_with_equal_bits(spark):
    """Digests that no block tells apart are compared outright."""
    high = [k << 57 for k in range(1, 30)]
    frame = spark.createDataFrame([(high, high[:9])], "a array<bigint>, b array<bigint>")
    frame = frame.select(likeness(F.col("a"), sketch(F.col("a")), F.col("b"), sketch(F.col("b"))).alias("near"))
    assert frame.first().near == 9 / 29


def test_plan_has_no_python_and_one_shuffle_of_texts(spark, random_prose, tmp_path):
    spark.createDataFrame([(k, random_prose(k, 30)) for k in range(50)], "doc_id bigint, text string").write.parquet(str(tmp_path / "d"))
    plan = fingerprints(spark.read.parquet(str(tmp_path / "d")))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan) and plan.count("Exchange ") == 1


def test_digests_of_paragraphs(spark):
    frame = spark.createDataFrame([("a b c d e f g h i j k l m\nn\n\na b c d e f g h i j k l",)], "text string")
    assert len(frame.select(paragraph_digests(F.col("text")).alias("d")).first().d) == 3
