import random

import numpy as np

from siftline.llm.license_texts import TEMPLATES
from siftline.llm.licenses import Index, _confirm, _rows_of_words, find_licenses, scan_licenses, templates_of


def found(documents, rows):
    return sorted((r.doc_id, r.license, r.wording) for r in scan_licenses(documents(rows)).collect())


def test_every_wording_is_found_whole(documents, random_prose):
    rows, want = [], []
    for name, texts in TEMPLATES.items():
        for text in texts:
            rows.append((len(rows), random_prose(len(rows), 60) + "\n" + text + "\n" + random_prose(len(rows) + 99, 60)))
            want.append(name)
    got = scan_licenses(documents(rows)).collect()
    assert sorted((r.doc_id, r.license) for r in got) == list(enumerate(want))
    assert all(r.agreement == 1 and r.size_reduction > 0 for r in got)
    for row in got:
        assert rows[row.doc_id][1].encode()[row.first_byte : row.end_byte].decode() == row.wording


def test_differences_are_told(documents):
    text = TEMPLATES["BSD-2-Clause"][0].replace("forms", "shapes", 1).replace("notice, ", "", 1)
    row = scan_licenses(documents([(1, text)])).collect()[0]
    assert row.license == "BSD-2-Clause" and "shapes" in row.added and "forms" in row.missing and 0.9 <= row.agreement < 1


def test_a_near_name_is_no_licence(documents):
    assert found(documents, [(1, "Licensed under CC BY-XY 9.0."), (2, "This work is licensed under the General Rules, version 3."),
                             (3, "the license of the MIT museum")]) == []


def test_several_in_a_text_and_odd_rows(documents, odd_rows):
    two = "Released under the MIT License. " * 2 + "Licensed under the\nApache   License, version 2.0!"
    assert found(documents, odd_rows) == []
    assert [x[1] for x in found(documents, [(1, two)])] == ["Apache-2.0", "MIT", "MIT"]
    assert len(found(documents, [(1, two), (1, two), (None, two)][:2])) == 6
    assert found(documents, []) == []


def every_comparison(index, words):
    """Every template compared at every block of any template, with the same choice among what overlaps."""
    data = b" ".join(words)
    *_, token = _rows_of_words(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
    found = []
    for (low, high), _ in sorted(index.blocks(index.hits(token), token, len(words)).items()):
        for number, template in enumerate(index.templates):
            match = _confirm(template, words[low:high])
            if match:
                first, end, missing, added = match
                agreement = 1 - (len(missing) + len(added)) / len(template.words)
                found.append((-(len(template.words) - len(missing) - len(added)), -agreement, low + first, low + end, number))
    taken, out = [], []
    for _, agreement, first, end, number in sorted(found):
        if all(end <= a or first >= b for a, b in taken):
            taken.append((first, end))
            out.append((index.templates[number].license, first, end))
    return sorted(out, key=lambda row: row[1])


def test_equals_the_comparison_of_all_templates():
    """Seven wordings that share most of their words: whichever the text has is found, however it ranks."""
    pick = random.Random(4)
    base = ("this work may be copied changed and given to others by anyone under the terms of rule one provided that "
            "the name of its maker stays in every copy and no promise is made that it serves any purpose").split()
    wordings = {}
    for k in range(7):
        own = list(base)
        for place in range(3):
            own[5 + 9 * place] = f"word{k}{place}"
        wordings[f"L{k}"] = (" ".join(own),)
    index, total = Index(templates_of(wordings)), 0
    for _ in range(40):
        words = [f"x{pick.randrange(50)}" for _ in range(20)]
        for name in pick.sample(sorted(wordings), 2):
            copy = wordings[name][0].split()
            for _ in range(pick.randrange(3)):
                copy[pick.randrange(len(copy))] = "changed"
            words += copy + [f"x{pick.randrange(50)}" for _ in range(15)]
        words = [word.encode() for word in words]
        data = b" ".join(words)
        starts, ends, _, token = _rows_of_words(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
        got = find_licenses(index, data, starts, ends, token)
        place = {int(start): number for number, start in enumerate(starts)}
        want = every_comparison(index, words)
        assert [(row[0], place[row[1]]) for row in got] == [(name, first) for name, first, _ in want]
        total += len(got)
    assert total > 30


def test_ties_and_long_texts(documents, random_prose):
    """Equal wordings of two names: the first by number; a hit at the end of a long text."""
    wordings = {"B": ("one wording for two names here",), "A": ("one wording for two names here",)}
    row = scan_licenses(documents([(1, "x one wording for two names here y")]), wordings=wordings).collect()
    assert [r.license for r in row] == ["B"]
    long = random_prose(5, 400_000)
    got = scan_licenses(documents([(1, long + "\nReleased under the MIT License.")])).collect()
    assert [r.license for r in got] == ["MIT"] and got[0].first_byte > len(long.encode())
