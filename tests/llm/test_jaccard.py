import os
import re
from collections import defaultdict

import numpy as np
import pytest

from siftline.llm import common, jaccard
from siftline.llm.components import components
from siftline.llm.jaccard import Group, linked_documents, one_of_each_group
from siftline.session import shared_folder, stored

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def expected(rows):
    sets = []
    for _, text in rows:
        words = WORD.findall((text or "").translate(LOWER))
        sets.append({tuple(words[k : k + 3]) for k in range(len(words) - 2)} if len(words) > 2 else {tuple(words)} if words else set())
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    lowest = defaultdict(list)
    for k, (doc, _) in enumerate(rows):
        if doc is not None:
            lowest[find(k)].append(doc)
    return sorted(((doc, len(s), min(lowest[find(k)], default=None) if s else doc) for k, ((doc, _), s) in enumerate(zip(rows, sets))), key=repr)


def got(frame):
    return sorted(map(tuple, linked_documents(frame).collect()), key=repr)


@pytest.fixture(scope="module")
def families(random_prose):
    rows = []
    pick = np.random.default_rng(4)
    for family in range(12):
        words = random_prose(900 + family, 60 + 25 * family).split()
        for _ in range(int(pick.integers(1, 25))):
            copy = list(words)
            for _ in range(int(pick.integers(0, 5))):
                copy[int(pick.integers(len(copy)))] = f"new{int(pick.integers(40))}"
            rows.append((1000 + len(rows), " ".join(copy)))
    # A chain: neighbours link, the ends do not.
    chain = random_prose(999, 120).split()
    for k in range(8):
        chain[k * 15] = f"step{k}"
        rows.append((5000 - k, " ".join(chain).upper() if k % 2 else " ".join(chain)))
    return rows


def test_equals_brute_force(documents, odd_rows, families):
    assert got(documents(odd_rows + families)) == expected(odd_rows + families)


def test_short_texts_and_exact_shares(documents):
    ten = [f"w{k}" for k in range(12)]
    rows = [(1, " ".join(ten)), (2, " ".join(ten[:11])), (3, "a b"), (4, "A  b"), (5, "b a"), (6, "a b c"), (7, "a"), (8, "a"), (9, "")]
    assert got(documents(rows)) == expected(rows)


def test_one_document_of_each_group_stays(documents, odd_rows, families):
    rows = [r for r in odd_rows if r[1] != "the same id twice"] + families
    frame = documents(rows)
    kept = one_of_each_group(frame)
    assert kept.columns == frame.columns
    ids = [r.doc_id for r in kept.collect()]
    want = expected(rows)
    with_words = {c for _, n, c in want if n and c is not None}
    assert {d for d in ids if d is not None} >= with_words
    assert len(ids) == len(with_words) + sum(n == 0 for _, n, _ in want) + sum(n > 0 and c is None for _, n, c in want)


def test_empty_table(documents):
    assert got(documents([])) == []
    assert one_of_each_group(documents([])).collect() == []


def test_plans_stay_small(documents, families, monkeypatch):
    """Each table that is written comes from a plan of few shuffles, so the driver holds small plans only."""
    seen = []

    def write(frame):
        seen.append(frame._jdf.queryExecution().executedPlan().toString().count("Exchange "))
        return stored(frame)

    monkeypatch.setattr(jaccard, "stored", write)
    monkeypatch.setattr(common, "stored", write)
    got(documents(families))
    assert len(seen) > 10 and max(seen) <= 20


def test_tables_on_the_way_are_removed(documents, families, spark):
    """The shared folder holds one more table afterwards, the result."""
    folder = shared_folder(spark)
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    linked = linked_documents(documents(families))
    (left,) = set(os.listdir(folder)) - before
    assert all(f"/{left}/" in path for path in linked.inputFiles())
    assert sorted(map(tuple, linked.collect()), key=repr) == expected(families)


def test_unlike_texts_with_common_passages_are_not_opened(documents, random_prose, monkeypatch):
    """Each text shares all its shingles with its neighbours, a third or two with each, but no text is moved for that."""
    words = random_prose(3000, 800).lower().split()
    rows = [(k, " ".join(words[12 * k : 12 * k + 36])) for k in range(60)]
    # A close pair, which has to be found.
    rows.append((100, f"{rows[0][1]} more"))
    seen = defaultdict(list)

    def write(frame):
        out = stored(frame)
        seen[tuple(frame.columns)].append(out.count())
        return out

    monkeypatch.setattr(common, "stored", write)
    assert got(documents(rows)) == expected(rows)
    members, _, near = seen["gid", "part", "node", "first"]
    assert members > 10 and near <= 4


def test_pairs_are_asked_for_several_common_tokens():
    """Two sets with a share of nine tenths have that many tokens in common among their prefixes, however they are ordered."""
    pick = np.random.default_rng(8)
    for n in (1, 2, 9, 19, 20, 39, 40, 59, 60, 61, 200):
        for _ in range(30):
            lost = int(pick.integers(0, int(jaccard.missing(np.array([n]), 90)[0]) + 1))
            a, b = np.arange(n), np.arange(lost, n)
            if 100 * len(b) < 90 * n:
                continue
            rank = pick.permutation(n)
            short = [
                set(own[np.argsort(rank[own])][: int((jaccard.missing(size, 90) + jaccard.pair_surplus(size))[0])].tolist())
                for own in (a, b) for size in [np.array([len(own)])]
            ]
            least = jaccard.pair_surplus(-(-90 * np.array([n]) // 100))[0]
            assert len(short[0] & short[1]) >= least


def test_near_each_other_compares_all_of_a_group():
    sets = [set(range(40)), set(range(500, 540)), set(range(39)), set(range(500, 539)), set(range(900, 940)), set(range(900, 940))]
    bits = np.frombuffer(b"".join(jaccard.signature(np.array(sorted(s), np.uint64)) for s in sets), np.uint64).reshape(len(sets), -1)
    n = np.array([len(s) for s in sets])
    assert jaccard.near_each_other(np.array([0, 0, 0, 1, 1, 2]), bits, n, 90).tolist() == [True, False, True, False, False, False]
    assert jaccard.near_each_other(np.array([0, 0, 0, 0, 3, 3]), bits, n, 90).all()


def test_components_of_links(spark):
    pick = np.random.default_rng(2)
    links = [(int(a), int(b)) for a, b in pick.integers(0, 400, (260, 2))] + [(k, k + 1) for k in range(1000, 1100)] + [(7, 7)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    found = {r.node: r.root for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert found == {x: find(x) for x in root if any(x in link and link[0] != link[1] for link in links)}


def test_group_bounds_and_overlaps():
    sets = [np.array(sorted(s), np.uint64) for s in ({1, 2, 3}, {3, 4}, {9})]
    group = Group(sets)
    known = group.known(np.array([2, 3, 5, 9, 11], np.uint64))
    assert len(known) == 3 and group.overlaps(known).tolist() == [2, 1, 1]
    assert len(group.known(np.array([], np.uint64))) == 0 and Group([]).overlaps(np.array([], np.int64)).tolist() == []
