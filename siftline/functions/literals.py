"""One search for the literals of many patterns.

All literals become one regular expression, a trie whose wide nodes halve their first characters until few are left, so that a
place in the text costs a few comparisons however many literals there are.  It stands in a look ahead and so is tried at every place: literals
that overlap are all found.  Of several that begin at one place the longest is told, which implies the others.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, functions as F

#: First characters that are tried one after the other; more are halved by a look at their range.
FEW = 3


def _char(char: str) -> str:
    return char if char.isascii() and char.isalnum() else f"\\x{{{ord(char):X}}}"


def _tree(words: Sequence[str]) -> str:
    """An expression for the longest of the words that the text goes on with; the empty word makes it optional."""
    heads: dict[str, list[str]] = {}
    for word in words:
        if word:
            heads.setdefault(word[0], []).append(word[1:])
    chars = sorted(heads)

    def choice(some: list[str]) -> str:
        if len(some) > FEW:
            middle = len(some) // 2
            low, high = some[:middle], some[middle:]
            return f"(?:(?=[{_char(low[0])}-{_char(low[-1])}]){choice(low)}|{choice(high)})"
        return "(?:" + "|".join(_char(char) + (_tree(heads[char]) if any(heads[char]) else "") for char in some) + ")"

    if not chars:
        return ""
    return choice(chars) + ("?" if "" in words else "")


def literal_regex(literals: Sequence[str]) -> str:
    """The expression whose first group is, place by place, the longest literal there."""
    return f"(?=({_tree(sorted(set(literals)))}))"


def numbers_found(text: Column, wanted: Mapping[str, Sequence[int]]) -> Column:
    """The numbers whose literal stands somewhere in the text, as an unsorted array."""
    literals = sorted(wanted)
    numbers = [
        sorted({number for other in literals if literal.startswith(other) for number in wanted[other]}) for literal in literals
    ]
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(literal_regex(literals)), F.lit(1)))
    lists = F.array(*[F.array(*[F.lit(number) for number in some]) for some in numbers])
    known = F.lit(literals)
    return F.flatten(F.transform(found, lambda literal: F.get(lists, F.array_position(known, literal).cast("int") - 1)))


def lines_with(wanted: Sequence[tuple[Sequence[str], bool]]) -> Callable[[pd.Series], pd.Series]:
    """For each of the wanted (ASCII literals, whether case is ignored), what it leaves of a text: the lines that hold one
    of them, and the first and the last line; nothing where none does.

    Made here so that tasks get it by value.
    """
    sought = [([literal.encode() for literal in literals], ignore) for literals, ignore in wanted]

    def folded(data: bytes) -> bytes:
        """ASCII letters in lower case, and what Spark's ``lower`` and ``scan`` fold to them."""
        data = data.lower()
        for char, lower in (("\u017f", "s"), ("\u212a", "k"), ("\u0130", "i\u0307")):
            data = data.replace(char.encode(), lower.encode())
        return data

    def breaks_of(data: bytes) -> list[int]:
        found, at = [], data.find(b"\n")
        while at >= 0:
            found.append(at)
            at = data.find(b"\n", at + 1)
        return found

    def numbers(data: bytes, breaks: list[int], literals: list[bytes]) -> set[int]:
        found = set()
        for literal in literals:
            at = data.find(literal)
            while at >= 0:
                number = bisect_left(breaks, at)
                found.add(number)
                at = data.find(literal, breaks[number]) if number < len(breaks) else -1
        return found

    def parts(data: bytes | None) -> list[bytes | None] | None:
        if data is None:
            return None
        lower, lines = folded(data), data.split(b"\n")
        # A letter may have another length in lower case, but no line break comes or goes.
        breaks, lower_breaks = breaks_of(data), breaks_of(lower)
        out = []
        for literals, ignore in sought:
            found = numbers(lower, lower_breaks, literals) if ignore else numbers(data, breaks, literals)
            out.append(b"\n".join(lines[number] for number in sorted(found | {0, len(lines) - 1})) if found else None)
        return out

    return lambda texts: texts.map(parts, na_action="ignore").astype(object)
