"""Which repeated groups of a pattern may be written possessive without another answer.

Java runs a possessive repeat of a group in a loop, while a greedy one recurses once per repetition and keeps every choice for later,
which overflows its stack on long texts and can take exponential time.  The two agree where nothing is ever given back:

* the rest of the pattern can always match nothing, or
* what a repetition may start with and what may follow the repeat have no character in common, and neither do the choices within a
  repetition (the pattern is one-unambiguous there), or
* the rest of the pattern is also how a repetition begins: then a look ahead tells whether to go on.

A repetition of a repeated class, as in ``(a*)*``, is told to take at least one character.  Patterns are judged on the tree that Python's
parser makes of their translation; what the tree does not show plainly counts as ambiguous.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, replace
from re import _constants as C

LAST = 0x10FFFF
EVERY = ((0, LAST),)

Ranges = tuple[tuple[int, int], ...]


@dataclass(frozen=True)
class Verdict:
    """How a repeated group may be written: ``plain`` possessive, with a look ahead at the ``rest``, or behind a first character of ``some``."""

    kind: str
    some: Ranges = ()
    #: Whether groups are captured in it; Java does not take back what they hold when the match fails later on.
    captures: bool = False


def _merged(ranges) -> Ranges:
    out: list[tuple[int, int]] = []
    for low, high in sorted(ranges):
        if out and low <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(out[-1][1], high))
        else:
            out.append((low, high))
    return tuple(out)


def _others(ranges: Ranges) -> Ranges:
    out, low = [], 0
    for start, end in _merged(ranges):
        if start > low:
            out.append((low, start - 1))
        low = end + 1
    return (*out, (low, LAST)) if low <= LAST else tuple(out)


def _apart(a: Ranges, b: Ranges) -> bool:
    return all(high < start or end < low for low, high in a for start, end in b)


def _cased(ranges: Ranges) -> Ranges:
    """The ranges where case is ignored; other letters than ASCII may fold to anything."""
    if any(high > 0x7F for _, high in ranges):
        return EVERY
    both = list(ranges)
    for start, end in ranges:
        for low, high, shift in ((0x41, 0x5A, 0x20), (0x61, 0x7A, -0x20)):
            if max(start, low) <= min(end, high):
                both.append((max(start, low) + shift, min(end, high) + shift))
    # The long s and the Kelvin sign fold to letters.
    both += [(other, other) for letter, other in ((0x73, 0x17F), (0x6B, 0x212A)) if not _apart(tuple(both), ((letter, letter),))]
    return _merged(both)


def _class(item) -> Ranges | None:
    """The characters of an item that takes exactly one; None for any other."""
    op, value = item
    if op is C.LITERAL:
        return ((value, value),)
    if op is C.NOT_LITERAL:
        return _others(((value, value),))
    if op is C.ANY:
        return _others(((10, 10),))
    if op is C.IN:
        negated, ranges = False, []
        for kind, part in value:
            if kind is C.NEGATE:
                negated = True
            elif kind is C.LITERAL:
                ranges.append((part, part))
            elif kind is C.RANGE:
                ranges.append(part)
            else:
                return EVERY
        return _others(tuple(ranges)) if negated else _merged(ranges)
    return None


def _ignores(flags: tuple[int, int], outer: bool) -> bool:
    add, remove = flags
    return True if add & re.IGNORECASE else False if remove & re.IGNORECASE else outer


def first(items, ignore: bool = False) -> tuple[Ranges, bool]:
    """What a sequence may start with, and whether it may match nothing."""
    found: list[tuple[int, int]] = []
    for op, value in items:
        ranges, nothing = _first_of(op, value, ignore)
        found += ranges
        if not nothing:
            return _merged(found), False
    return _merged(found), True


def _first_of(op, value, ignore: bool) -> tuple[Ranges, bool]:
    single = _class((op, value))
    if single is not None:
        return (_cased(single) if ignore else single), False
    if op is C.BRANCH:
        parts = [first(part, ignore) for part in value[1]]
        return _merged([r for ranges, _ in parts for r in ranges]), any(nothing for _, nothing in parts)
    if op is C.SUBPATTERN:
        return first(value[3], _ignores(value[1:3], ignore))
    if op in (C.MAX_REPEAT, C.MIN_REPEAT):
        ranges, nothing = first(value[2], ignore)
        return ranges, nothing or value[0] == 0
    return EVERY, False


def _clear(items, follow: Ranges, ignore: bool) -> bool:
    """Whether every choice within a sequence is told by the next character."""
    for op, value in reversed(list(items)):
        if op is C.BRANCH:
            starts = []
            for place, part in enumerate(value[1]):
                ranges, nothing = first(part, ignore)
                if nothing and place < len(value[1]) - 1:
                    # Nothing would be taken before the later choices are tried.
                    return False
                starts.append(_merged([*ranges, *follow]) if nothing else ranges)
                if not _clear(part, follow, ignore):
                    return False
            if any(not _apart(a, b) for k, a in enumerate(starts) for b in starts[:k]):
                return False
        elif op is C.SUBPATTERN:
            if not _clear(value[3], follow, _ignores(value[1:3], ignore)):
                return False
        elif op is C.MAX_REPEAT:
            low, high, body = value
            ranges, nothing = first(body, ignore)
            if (nothing and high != 1) or (low != high and not _apart(ranges, follow)):
                return False
            if not _clear(body, _merged([*ranges, *follow]) if high != 1 else follow, ignore):
                return False
        elif _class((op, value)) is None:
            return False
        ranges, nothing = _first_of(op, value, ignore)
        follow = _merged([*ranges, *follow]) if nothing else ranges
    return True


def _plain(items):
    """A sequence without groups around the whole of it, and whether case is ignored there."""
    ignore = None
    while len(items) == 1 and items[0][0] is C.SUBPATTERN:
        flags = items[0][1][1:3]
        ignore = _ignores(flags, bool(ignore)) if any(flags) else ignore
        items = items[0][1][3]
    return items, ignore


def _captures(items) -> bool:
    """Whether a group is captured somewhere in a sequence."""
    for op, value in items:
        if op is C.SUBPATTERN and (value[0] is not None or _captures(value[3])):
            return True
        if op is C.BRANCH and any(map(_captures, value[1])):
            return True
        if op in (C.MAX_REPEAT, C.MIN_REPEAT) and _captures(value[2]):
            return True
    return False


class _Judge:
    """Walks over a tree and keeps a verdict for every repeat, in the order of their signs in the text."""

    def __init__(self) -> None:
        self.verdicts: list[Verdict | None] = []
        self.looks = False

    def walk(self, items, follow: Ranges, free: bool, ignore: bool, top: bool, sure: bool = True) -> None:
        """``follow`` is what may come behind the sequence; ``free`` that it may also be nothing at all.

        ``sure`` tells that every match goes through it.
        """
        items = list(items)
        behind = []
        for op, value in reversed(items):
            behind.append((follow, free))
            ranges, nothing = _first_of(op, value, ignore)
            follow, free = (_merged([*ranges, *follow]), free) if nothing else (ranges, False)
        for place, ((op, value), (after, ends)) in enumerate(zip(items, reversed(behind), strict=True)):
            if op is C.BRANCH:
                for part in value[1]:
                    self.walk(part, after, ends, ignore, False, False)
            elif op is C.SUBPATTERN:
                self.walk(value[3], after, ends, _ignores(value[1:3], ignore), False, sure)
            elif op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT):
                low, high, body = value
                start, _ = first(body, ignore)
                self.walk(body, _merged([*start, *after]), ends and low <= 1, ignore, False, False)
                verdict = self.judge(body, after, ends, ignore, items[place + 1:] if top else None, low) if op is C.MAX_REPEAT else None
                if verdict and _captures(body):
                    verdict = replace(verdict, captures=True) if sure else None
                self.verdicts.append(verdict)
            elif op in (C.ASSERT, C.ASSERT_NOT):
                self.looks = True
                self.walk(value[1], EVERY, False, ignore, False, False)
            elif op is C.AT:
                self.looks = True

    def judge(self, body, after: Ranges, free: bool, ignore: bool, rest, low: int) -> Verdict | None:
        start, nothing = first(body, ignore)
        if low > 1:
            # The first repetitions may have to give back for the later ones.
            return Verdict("plain") if not nothing and _apart(start, after) and _clear(body, _merged([*start, *after]), ignore) else None
        inner, inside = _plain(body)
        inside = ignore if inside is None else inside
        if len(inner) == 1 and inner[0][0] is C.MAX_REPEAT and inner[0][1][1] is C.MAXREPEAT and len(inner[0][1][2]) == 1:
            # A repeated class: the first repetition takes all there is.
            if inner[0][1][0] <= 1 and _class(inner[0][1][2][0]) is not None and (free or _apart(start, after)):
                return Verdict("some", start) if nothing else Verdict("plain")
        if nothing:
            return None
        if free or (_apart(start, after) and _clear(body, _merged([*start, *after]), ignore)):
            return Verdict("plain")
        if rest and _clear(body, start, ignore) and len(inner) > len(rest) and inside == ignore:
            if not any(op is C.SUBPATTERN and value[0] is not None for op, value in rest) and repr(list(inner[: len(rest)])) == repr(rest):
                return Verdict("rest")
        return None


def repeats(expression: str) -> tuple[list[Verdict | None], bool]:
    """A verdict for each repeat sign of a pattern in Python's syntax, from left to right, and whether it looks around.

    The list is empty where the pattern cannot be parsed.
    """
    try:
        tree = re._parser.parse(expression)
    except re.error:
        return [], True
    judge = _Judge()
    judge.walk(tree, (), True, bool(tree.state.flags & re.IGNORECASE), True)
    return judge.verdicts, judge.looks


NEWLINE: Ranges = ((10, 10),)


def in_one_line(expression: str) -> bool:
    """Whether no match of a pattern in Python's syntax goes beyond its line, but for a line break as its first or as its last character.

    Not both may be one, and where a line break may be, nothing looks around it.  What holds for such a match can
    be told from its line and the line breaks beside it.
    """
    try:
        tree = re._parser.parse(expression)
    except re.error:
        return False
    borders: set[str] = set()
    return _line_bound(tree, True, True, borders) and borders in (set(), {"look"}, {"first"}, {"last"})


def _line_bound(items, first_: bool, last_: bool, borders: set[str]) -> bool:
    """Notes in ``borders`` where line breaks may match and whether it looks around; false if one may stand inside."""
    items = list(items)
    widest = [_widest(item) for item in items]
    for place, (op, value) in enumerate(items):
        leads = first_ and not any(widest[:place])
        ends = last_ and not any(widest[place + 1:])
        single = _class((op, value))
        if single is not None:
            if not _apart(single, NEWLINE):
                if not (leads or ends):
                    return False
                borders.update(["first"] * leads + ["last"] * ends)
        elif op is C.BRANCH:
            if not all([_line_bound(part, leads, ends, borders) for part in value[1]]):
                return False
        elif op is C.SUBPATTERN:
            if not _line_bound(value[3], leads, ends, borders):
                return False
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT):
            once = value[1] == 1
            if not _line_bound(value[2], leads and once, ends and once, borders):
                return False
        elif op in (C.ASSERT, C.ASSERT_NOT):
            if _widest((C.SUBPATTERN, (None, 0, 0, value[1]))) > 1:
                return False
            borders.add("look")
        elif op is not C.AT or value not in (C.AT_BEGINNING_STRING, C.AT_END_STRING):
            return False
    return True


def _widest(item) -> int:
    """The most characters that an item takes: 0, 1, or 2 for any more."""
    op, value = item
    if _class(item) is not None:
        return 1
    if op is C.SUBPATTERN:
        return min(2, sum(map(_widest, value[3])))
    if op is C.BRANCH:
        return max(sum(map(_widest, part)) for part in value[1])
    if op in (C.MAX_REPEAT, C.MIN_REPEAT):
        return min(2, value[1] * sum(map(_widest, value[2])))
    return 0 if op in (C.AT, C.ASSERT, C.ASSERT_NOT) else 2


def looks_around(expression: str) -> bool:
    """Whether a pattern in Python's syntax asks for anything but the characters it takes."""
    return repeats(expression)[1]
