import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from siftline.llm import tries
from siftline.llm.tries import prefix_trie, sweep

SCHEMA = "conv_id bigint, turn bigint, role string, text string, node string, depth int, tid int, parent string, part string"


def table(spark, rows):
    return spark.createDataFrame([(*row, "x", 5, 6, "y", "z") for row in rows], SCHEMA)


def conversations(rows):
    """Turns of each conversation in order."""
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            digest = hashlib.md5(f"{len(role)}:{role}:{text}".encode()).digest()
            convs[conv].append(((turn is not None, turn or 0, digest), (role, text)))
    return {conv: [turn for _, turn in sorted(turns)] for conv, turns in convs.items()}


def rebuilt(convs):
    out = {}
    for conv, turns in convs.items():
        h = zlib.crc32(str(conv).encode()) % 6
        out[conv] = convs.get(conv - conv % 100, [])[:h] + turns[h:]
    return out


def expected(convs):
    members = defaultdict(list)
    for conv, turns in convs.items():
        for depth in range(len(turns) + 1):
            members[tuple(turns[:depth])].append(conv)
    below = defaultdict(set)
    for node in members:
        if node:
            below[node[:-1]].add(node)
    sums = {}
    for node in sorted(members, key=len, reverse=True):
        leaves = sum(sums[child][0] for child in below[node]) if below[node] else 1
        saved = (len(members[node]) - 1) * len(node[-1][1]) if node else 0
        sums[node] = leaves, saved + sum(sums[child][1] for child in below[node])
    rows = []
    for node, convs_ in members.items():
        ends = ",".join(map(str, sorted(c for c in convs_ if len(convs[c]) == len(node))))
        rows.append((
            min(convs_), len(node), min(members[node[:-1]]) if node else None, len(convs_), len(below[node]), *sums[node],
            hashlib.sha256(ends.encode()).hexdigest(),
        ))
    return sorted(rows)


def got(frame, **options):
    return sorted(tuple(row) for row in prefix_trie(frame, **options).collect())


def made(seed, count, spread=3, longest=9):
    """Conversations with common first turns, some of them equal, with ties and null fields."""
    pick = random.Random(seed)
    rows = []
    for conv in range(count):
        conv_id = conv * 37 % (4 * count)
        for turn in range(pick.randrange(longest)):
            text = pick.choice([None, "", "hi", "é漢字", "a longer answer"][: 2 + spread]) if turn > 2 else f"turn {pick.randrange(spread)}"
            rows.append((conv_id, pick.choice([turn, turn, turn, None]), pick.choice(["user", "assistant", None]) if turn > 3 else "user", text))
    return rows


LIMITS = [{}, {"most_conversations": 3}, {"most_conversations": 2, "most_turns": 4}, {"most_conversations": 0}]


@pytest.mark.parametrize("limits", LIMITS)
def test_equals_brute_force(spark, limits):
    rows = made(1, 120)
    assert got(table(spark, rows), **limits) == expected(rebuilt(conversations(rows)))


def test_plain_conversations(spark):
    rows = made(2, 80) + [(None, 1, "user", "no number"), (-5, 0, "user", "a"), (-5, 0, "user", "a")]
    assert got(table(spark, rows), rebuilt=False, most_conversations=4) == expected(conversations(rows))


def test_copies_and_long_chains(spark, monkeypatch):
    """Many copies of a long conversation, some cut short, and one that goes on alone, over several aggregates."""
    monkeypatch.setattr(tries, "CHUNK", 3)
    turns = [f"turn {k} " * (k % 4) for k in range(60)]
    rows = [(1000 + c, k, "user", turns[k]) for c in range(20) for k in range(60 if c % 3 else 40 + c)]
    rows += [(7, k, "user", turns[k] if k < 50 else "x" * k) for k in range(200)]
    convs = conversations(rows)
    for limits in ({}, {"most_conversations": 5}, {"most_turns": 100}):
        assert got(table(spark, rows), rebuilt=False, **limits) == expected(convs)
    assert got(table(spark, rows), most_conversations=4) == expected(rebuilt(convs))


def test_conversation_without_turns_left(spark):
    """A conversation of one turn whose donor is not there is a member of the root alone."""
    lonely = next(c for c in range(101, 200) if zlib.crc32(str(c).encode()) % 6 > 1)
    rows = [(lonely, 0, "user", "gone"), (301, 0, "user", "a"), (301, 1, "user", "b")]
    convs = rebuilt(conversations(rows))
    assert convs[lonely] == []
    assert got(table(spark, rows)) == expected(convs)


def test_empty_table(spark):
    assert got(table(spark, [])) == []


def test_sweep_of_one_container():
    rows = sweep([((b"a", b"b"), 4, [3, 5]), ((b"a",), 9, [3]), ((b"a", b"c"), 2, [3, 1]), ((b"a", b"b"), 3, [3, 5])], 2)
    named = {(row[0], row[1]): row for row in rows}
    assert named[2, 2][2:7] == [None, 4, 2, 2, 3 * 3 + 5]
    assert named[3, 3][2:7] == [2, 2, 0, 1, 5] and named[2, 3][2:7] == [2, 1, 0, 1, 0]
    assert named[2, 2][7] == hashlib.sha256(b"9").hexdigest() and named[3, 3][7] == hashlib.sha256(b"3,4").hexdigest()
