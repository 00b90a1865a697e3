import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from siftline.llm import spelling
from siftline.llm.spelling import near_pairs, near_words, roots_of, spelling_variants

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(rows):
    found = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-z\u00C0-\u00FF]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            found[run] += 1
    return {word: n for word, n in found.items() if len(word) >= 5 and n >= 3}


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def expected(words):
    near = {a: [b for b in words if one_edit(a, b)] for a in words}
    form = {}
    for a, others in near.items():
        best = min(others, key=lambda b: (-words[b], b), default=None)
        form[a] = best if best and words[best] >= 2 * words[a] else None
    out = []
    for a in words:
        root = a
        while form[root]:
            root = form[root]
        out.append((a, words[a], len(near[a]), form[a], words.get(form[a]), root))
    return sorted(out)


def got(frame):
    return sorted((r.word, r.n, r.n_near, r.form, r.form_n, r.root) for r in spelling_variants(frame).collect())


def family(seed, count):
    """Texts of some words, their misspellings and words with long common parts, with very different frequencies."""
    pick = random.Random(seed)
    base = ["receive", "separate", "internationale", "aaaaaa", "aaaaaaa", "abababab", "straße", "élève", "maintenance", "Ünicode"]
    base += ["prefix" + "".join(pick.choice("abc") for _ in range(3)) for _ in range(40)] + ["".join(pick.choice("xy") for _ in range(4)) + "suffix" for _ in range(20)]
    letters = "abcxyzéß"
    texts = []
    for k in range(count):
        out = []
        for _ in range(40):
            word = pick.choice(base[: 1 + int(len(base) * pick.random() ** 2)])
            at = pick.randrange(len(word))
            kind = pick.random()
            if kind < 0.1:
                word = word[:at] + word[at + 1 :]
            elif kind < 0.2:
                word = word[:at] + pick.choice(letters) + word[at:]
            elif kind < 0.3:
                word = word[:at] + pick.choice(letters) + word[at + 1 :]
            out.append(word if pick.random() < 0.9 else word.upper())
        texts.append((k, pick.choice([" ", "-", "1", "\n"]).join(out)))
    return texts


@pytest.mark.parametrize("most", [256, 4])
def test_equals_brute_force(documents, odd_rows, monkeypatch, most):
    """With large blocks, and with blocks that are halved down to single open places."""
    monkeypatch.setattr(spelling.blocks, "__defaults__", (most,))
    monkeypatch.setattr(spelling.near_words, "__defaults__", (most,))
    rows = odd_rows + family(1, 150) + [(900, "x" * 3000 + " " + "x" * 2999 + " ")] * 3
    result = expected(words_of(rows))
    assert got(documents(rows)) == result
    assert sum(form is not None for *_, form, _, _ in result) > 20 and any(root not in (word, form) for word, _, _, form, _, root in result)


def test_pairs_are_found_once(spark):
    pick = random.Random(5)
    words = sorted({"".join(pick.choice("ab") for _ in range(pick.choice((7, 8, 9)))) for _ in range(300)})
    frame = spark.createDataFrame([(word, 3) for word in words], "word string, n bigint")
    for most in (1000, 20, 2):
        found = [(r.word, r.near) for r in near_words(frame, most).collect()]
        assert sorted(found) == sorted((a, b) for a in words for b in words if one_edit(a, b))


def test_tiles_and_narrow_chunks():
    pick = random.Random(6)
    words = sorted({"".join(pick.choice("abc") for _ in range(pick.choice((5, 6)))) for _ in range(400)})
    block, way = np.zeros(len(words), np.int64), np.ones(len(words), np.int64)
    for cells in (1, 5000, 1 << 22):
        a, b = near_pairs(words, 6, block, way, cells)
        want = {(x, y) for x in range(len(words)) for y in range(x + 1, len(words)) if one_edit(words[x], words[y]) and max(len(words[x]), len(words[y])) == 6}
        assert len(a) == len(want) and set(zip(a.tolist(), b.tolist())) == want


def test_long_ways_to_the_root(spark):
    forms = [(f"w{k}", f"w{k + 1}") for k in range(37)] + [("v", "w36"), ("u", "z")]
    found = {r.word: r.root for r in roots_of(spark.createDataFrame(forms, "word string, form string")).collect()}
    assert found == {**{f"w{k}": "w37" for k in range(37)}, "v": "w37", "u": "z"}


@pytest.mark.parametrize("rows", [[], [(1, None)], [(None, "apple apple apple"), (2, "")]])
def test_few_rows(documents, rows):
    assert got(documents(rows)) == expected(words_of(rows))
