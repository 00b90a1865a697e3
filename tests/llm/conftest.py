import random

import pytest

WORDS = "red blue green stone river cloud paper lamp chair door house tree bird fish road hill lake moon star rain snow wind fire salt".split()


def prose(pick, count):
    """Words with some punctuation and line breaks."""
    out = []
    for k in range(count):
        word = pick.choice(WORDS) + pick.choice(("", "", "s", "ed", "ing"))
        out.append(word.capitalize() + " " if k % 9 == 0 else word + pick.choice((" ", " ", " ", ", ", ".\n")))
    return "".join(out)


@pytest.fixture(scope="session")
def random_prose():
    return lambda seed, count: prose(random.Random(seed), count)


#: Columns with the names that operators use inside.
CLASHING = (
    "uid bigint, row string, words string, n_words int, kept boolean, spans string, token string, lead string, node string, found string, "
    "packed string, score double, grams string, piece int, rank int, bits int, held_out int, place string, rare string, html string"
)


@pytest.fixture(scope="session")
def documents(spark):
    """A table of (doc_id, text) rows, in two files, with columns whose names clash with those inside operators."""

    def build(rows, clashing=True):
        names = [part.split()[0] for part in CLASHING.split(", ")] if clashing else []
        schema = "doc_id bigint, text string" + (f", {CLASHING}" if clashing else "")
        filled = [(*row, *[None] * len(names)) for row in rows]
        return spark.createDataFrame(filled, schema)

    return build


@pytest.fixture(scope="session")
def odd_rows(random_prose):
    """Null and empty texts, null and repeated ids, repeated rows, long and short texts, blanks and other alphabets."""
    long = random_prose(1, 3000)
    return [
        (1, None), (2, ""), (None, "a text without an id"), (None, None), (3, "one"), (4, "two words"), (5, " \t\n "),
        (6, long), (6, long), (7, long), (8, random_prose(2, 400)), (9, random_prose(2, 400) + " and a tail"),
        (10, "é" * 500), (11, "a" * 5000), (12, "Ünïcödé wörds ßtraße 漢字 and some more of them   here"), (8, "the same id twice"),
        (13, "x\x00y \x0b\x0c\x1c z"), (14, "\n".join(["the same line again and again"] * 30)),
    ]
