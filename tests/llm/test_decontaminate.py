import hashlib
import re

import pytest

from siftline.llm.decontaminate import WuManber, clean_documents, decontaminate, matchers, words_of

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
COLUMNS = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def expected(rows, items):
    out = []
    split = lambda text: WORD.findall((text or "").translate(LOWER))
    windows = set()
    for item, text in items:
        words = split(text)
        n = min(10, len(words))
        windows |= {(tuple(words[k : k + n]), "" if item is None else str(item)) for k in range(len(words) - n + 1) if n}
    for doc, text in rows:
        words, hit, names = split(text), set(), set()
        for window, item in windows:
            n = len(window)
            for k in range(len(words) - n + 1):
                if tuple(words[k : k + n]) == window:
                    hit |= set(range(k, k + n))
                    names.add(item)
        digest = hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
        out.append((doc, len(words), len(hit), len(names), digest, bool(hit)))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def items(random_prose):
    return [
        (1, random_prose(50, 25)), (2, random_prose(51, 10)), (10, "Lamp, CHAIR lamp"), (3, None), (4, ""), (None, random_prose(52, 14)),
        (5, random_prose(50, 25)), (5, random_prose(50, 25)), (6, "moon"), (7, "lamp chair lamp chair lamp chair lamp chair lamp chair lamp chair"),
    ]


@pytest.fixture(scope="module")
def rows(odd_rows, random_prose):
    return [*odd_rows, (60, random_prose(3, 50) + random_prose(50, 25) + random_prose(4, 5)), (61, random_prose(52, 14).upper()),
            (62, "x " + " ".join(random_prose(50, 25).split()[3:14])), (63, " ".join(random_prose(50, 25).split()[3:12])),
            (64, "lamp chair " * 40), (65, "moon moon moonlight"), (66, "the chair, lamp; chair. lamp")]


@pytest.mark.parametrize("part_bytes", [1 << 20, 300])
def test_documents_equal_brute_force(spark, documents, rows, items, part_bytes):
    benchmark = spark.createDataFrame([(*i, "x") for i in items], "item_id bigint, text string, found string")
    found = decontaminate(documents(rows), benchmark, part_bytes=part_bytes).select("row.doc_id", *COLUMNS)
    assert sorted(map(tuple, found.collect()), key=repr) == expected(rows, items)


def test_clean_documents_keep_their_columns(spark, documents, rows, items):
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    frame = documents(rows)
    clean = clean_documents(frame, benchmark)
    assert clean.columns == frame.columns
    assert sorted((r.doc_id for r in clean.collect()), key=repr) == sorted((r[0] for r in expected(rows, items) if not r[-1]), key=repr)


def test_empty_tables(spark, documents, odd_rows):
    empty = spark.createDataFrame([], "item_id bigint, text string")
    assert not any(r.contaminated for r in decontaminate(documents(odd_rows), empty).collect())
    assert decontaminate(documents([]), empty).collect() == []


def test_search_jumps_and_finds_overlaps():
    words = words_of("a b a b a b a")
    found = WuManber({(b"a", b"b", b"a"): {"x"}, (b"b", b"a", b"b"): {"y"}})
    assert [(at, *names) for at, names in found.search(words)] == [(0, "x"), (1, "y"), (2, "x"), (3, "y"), (4, "x")]
    assert [m.length for m in matchers([("1", "a b"), ("2", "c " * 12), ("3", None)])] == [2, 10]
