"""Rewrite RE2 pattern text so that Spark's regex functions give RE2's answers.

Patterns are written in RE2 syntax, while Spark evaluates ``java.util.regex``.  The two
agree on leftmost-first matching and on capture groups, but not on ``.``, ``$``, ``\\b``,
``\\s``, case folding, stray braces and brackets.  The rewrite happens once per pattern on
the driver; rows only ever see the finished Java text.

What RE2 refuses (look-around, back-references, possessive repeats, repeats above 1000)
is refused here too, so that an unusable pattern is skipped and never half-applied.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from siftline.functions.ambiguity import in_one_line, looks_around, repeats


class PatternError(ValueError):
    """The text is not a pattern RE2 would accept."""


@dataclass(frozen=True)
class Regex:
    """A translated pattern.

    ``deep`` marks an unbounded repeat of a group that could not be written possessive (see
    ``ambiguity``).  Java recurses once per iteration for those and can overflow its stack on long texts, so ``scan`` runs
    them with ``python``.  ``inner``, where it is not empty, finds the groups in the text of a whole match: Java
    does not forget what a group in a possessive repeat held when an attempt before failed.  ``free`` tells that a whole
    match can be matched again without what stands around it, ``one_line`` that no match goes beyond its line (see ``in_one_line``).
    """

    source: str
    java: str
    python: str | None
    groups: int
    deep: bool
    inner: str = ""
    free: bool = False
    one_line: bool = False


# ASCII classes as inclusive code point ranges.
PERL_CLASSES = {
    "d": [(0x30, 0x39)],
    "w": [(0x30, 0x39), (0x41, 0x5A), (0x5F, 0x5F), (0x61, 0x7A)],
    "s": [(0x09, 0x0A), (0x0C, 0x0D), (0x20, 0x20)],
}
POSIX_CLASSES = {
    "alnum": [(0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A)],
    "alpha": [(0x41, 0x5A), (0x61, 0x7A)],
    "ascii": [(0x00, 0x7F)],
    "blank": [(0x09, 0x09), (0x20, 0x20)],
    "cntrl": [(0x00, 0x1F), (0x7F, 0x7F)],
    "digit": [(0x30, 0x39)],
    "graph": [(0x21, 0x7E)],
    "lower": [(0x61, 0x7A)],
    "print": [(0x20, 0x7E)],
    "punct": [(0x21, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7E)],
    "space": [(0x09, 0x0D), (0x20, 0x20)],
    "upper": [(0x41, 0x5A)],
    "word": PERL_CLASSES["w"],
    "xdigit": [(0x30, 0x39), (0x41, 0x46), (0x61, 0x66)],
}
CONTROL_ESCAPES = {"a": 0x07, "f": 0x0C, "t": 0x09, "n": 0x0A, "r": 0x0D, "v": 0x0B}

LAST_CODE_POINT = 0x10FFFF
MAX_REPEAT = 1000
WORD = "[0-9A-Za-z_]"
WORD_EDGE = f"(?:(?<={WORD})(?!{WORD})|(?<!{WORD})(?={WORD}))"
WORD_INNER = f"(?:(?<={WORD})(?={WORD})|(?<!{WORD})(?!{WORD}))"

#: What begins with a word character in every match: a letter that is not optional, or a group of words.
_WORD_NEXT = re.compile(r"[0-9A-Za-z_](?![*?{])|\((?:\?:)?\w+(?:\|\w+)*\)(?![*?{])", re.ASCII)
_REPEAT = re.compile(r"\{(\d+)(,(\d*))?\}")
_FLAGS = re.compile(r"\(\?([a-zA-Z]*)(?:-([a-zA-Z]+))?([:)])")
_NAMED = re.compile(r"\(\?P?<([A-Za-z0-9_]+)>")
_HEX = re.compile(r"\\x(?:\{([0-9A-Fa-f]+)\}|([0-9A-Fa-f]{2}))")
_OCTAL = re.compile(r"\\(0[0-7]{0,2}|[1-7][0-7]{1,2})")
_PROPERTY = re.compile(r"\\([pP])(?:\{(\^?)(\w+)\}|(\w))")
_CATEGORY = re.compile(r"[CLMNPSZ][a-z]?$")
_POSIX = re.compile(r"\[:(\^?)(\w+):\]")


def _complement(ranges):
    gaps, low = [], 0
    for start, end in sorted(ranges):
        if start > low:
            gaps.append((low, start - 1))
        low = max(low, end + 1)
    if low <= LAST_CODE_POINT:
        gaps.append((low, LAST_CODE_POINT))
    return gaps


def _folded(ranges):
    """The ranges with the other cases of their ASCII letters, as RE2 folds them."""
    wide = list(ranges)
    for start, end in ranges:
        for low, high, shift in ((0x41, 0x5A, 0x20), (0x61, 0x7A, -0x20)):
            if max(start, low) <= min(end, high):
                wide.append((max(start, low) + shift, min(end, high) + shift))
    # The long s and the Kelvin sign fold to letters.
    for letter, other in ((0x73, 0x17F), (0x6B, 0x212A)):
        if any(start <= letter <= end for start, end in wide):
            wide.append((other, other))
    return wide


def _java_char(code):
    char = chr(code)
    return char if char.isascii() and char.isalnum() else f"\\x{{{code:X}}}"


def _python_char(code):
    char = chr(code)
    return char if char.isascii() and char.isalnum() else f"\\U{code:08x}"


@dataclass
class _Class:
    """Contents of one bracket expression."""

    negated: bool = False
    ranges: list = field(default_factory=list)
    properties: list = field(default_factory=list)

    def render(self, char):
        body = "".join(
            char(low) if low == high else f"{char(low)}-{char(high)}" for low, high in self.ranges
        )
        return f"[{'^' if self.negated else ''}{body}{''.join(self.properties)}]"

    def java(self):
        return self.render(_java_char)

    def python(self):
        return None if self.properties else self.render(_python_char)


@dataclass
class _Scope:
    """Flags inside one group; ``outer`` is the case flag the group was opened under."""

    outer: bool
    ignore_case: bool
    multi_line: bool = False
    dot_all: bool = False
    open_flag: bool = False


class _Translator:
    def __init__(self, text):
        self.text = text
        self.at = 0
        self.java = []
        self.python = []
        self.groups = 0
        self.deep = False
        self.scopes = [_Scope(outer=False, ignore_case=False)]
        self.last = None
        # Whether an alternative of the whole pattern begins here, and where guards were put.
        self.fresh = True
        self.guards = []
        # Where open groups begin in the output, where the last one closed began, and every repeat: its sign, the
        # first part of its group, whether it is an unbounded one of a group, and whether no group is around it.
        self.opened = []
        self.closed = None
        self.signs = []
        self.inner = False
        # Whether a group is repeated without end, in whatever way it is written.
        self.repeated = False

    def run(self):
        while self.at < len(self.text):
            self.step(self.text[self.at])
        if len(self.scopes) != 1:
            raise PatternError("missing closing )")
        self.close_flag()
        python = None if None in self.python else "".join(self.python)
        if self.deep and python is not None:
            self.deep = not self.possessive(python)
        if python is None or _least_width(python) == 0:
            # After an empty match the search goes on one character later, where a run may be cut.
            for place in self.guards:
                self.java[place] = ""
        java = "".join(self.java)
        return Regex(
            self.text, java, python, self.groups, self.deep, rf"\A(?:{java})\z" if self.inner else "",
            python is not None and not self.repeated and not looks_around(python), python is not None and in_one_line(python),
        )

    def possessive(self, python):
        """Write unbounded repeats of groups so that Java runs them in a loop; False if one cannot be."""
        verdicts, looks = repeats(python)
        if len(verdicts) != len(self.signs):
            return False
        deep = [(sign, verdict) for sign, verdict in zip(self.signs, verdicts) if sign[2]]
        if any(verdict is None or (verdict.captures and looks) for _, verdict in deep):
            return False
        if any(verdict.kind == "rest" and not sign[3] for sign, verdict in deep):
            return False
        self.inner = any(verdict.captures for _, verdict in deep)
        rest = {sign[0]: "".join(self.java[sign[0] + 1:]) for sign, verdict in deep if verdict.kind == "rest"}
        for (sign, begin, _, _), verdict in deep:
            if verdict.kind == "some":
                # No repetition leaves the group empty, as an empty one would.
                self.java[begin] += f"(?={_Class(ranges=list(verdict.some)).java()})"
                self.java[sign] = "*+"
            elif verdict.kind == "rest":
                self.java[begin] = "(?:" + self.java[begin]
                self.java[sign] = f"(?={rest[sign]})){self.java[sign]}+"
            else:
                self.java[sign] += "+"
        return True

    def put(self, java, python="", kind="atom"):
        self.java.append(java)
        self.python.append(java if python == "" else python)
        self.last = kind
        self.fresh = False

    def put_char(self, code, kind="atom"):
        self.put(_java_char(code), _python_char(code), kind)

    def step(self, char):
        scope = self.scopes[-1]
        if char == "(":
            self.open_group(scope)
        elif char == ")":
            self.close_group()
        elif char == "|":
            self.close_flag()
            self.put("|", kind=None)
            self.open_flag(scope)
            self.fresh = len(self.scopes) == 1
            self.at += 1
        elif char in "*+?":
            self.repeat(char, self.at + 1, unbounded=char != "?")
        elif char == "{" and (found := _REPEAT.match(self.text, self.at)):
            self.counted_repeat(found)
        elif char == "[":
            leads = self.fresh
            content = self.bracket()
            following = self.text[self.at:self.at + 2]
            if leads and following[:1] in ("+", "*") and following[1:] != "?":
                self.guards.append(len(self.java))
                self.java.append(_run_start(content))
                self.python.append("")
            self.put(content.java(), content.python())
        elif char == "\\":
            self.escape()
        else:
            if char == "^":
                self.put(r"(?<![^\n])" if scope.multi_line else r"\A")
            elif char == "$":
                if scope.multi_line:
                    self.put(r"(?![^\n])")
                else:
                    self.put(r"\z", r"\Z")
            elif char == ".":
                every = _Class(ranges=[(0, LAST_CODE_POINT)] if scope.dot_all else _complement([(10, 10)]))
                self.put(every.java() if scope.dot_all else r"[^\n]", every.python())
            else:
                self.put_char(ord(char))
            self.at += 1

    # Groups and flags.  A flag change in the middle of a group becomes its own
    # ``(?iu:…)`` group that is closed and reopened around every ``|``.

    def open_flag(self, scope):
        if scope.ignore_case != scope.outer:
            self.put("(?iu:" if scope.ignore_case else "(?-iu:",
                     "(?i:" if scope.ignore_case else "(?-i:", kind=None)
            scope.open_flag = True

    def close_flag(self):
        scope = self.scopes[-1]
        if scope.open_flag:
            self.put(")")
            scope.open_flag = False

    def open_group(self, scope):
        self.opened.append(len(self.java))
        rest = self.text[self.at:]
        inner = _Scope(scope.ignore_case, scope.ignore_case, scope.multi_line, scope.dot_all)
        if not rest.startswith("(?"):
            self.groups += 1
            self.at += 1
        elif found := _NAMED.match(self.text, self.at):
            self.groups += 1
            self.at = found.end()
        elif found := _FLAGS.match(self.text, self.at):
            self.at = found.end()
            if found[3] == ")":
                fresh = self.fresh
                self.opened.pop()
                self.set_flags(scope, found[1], found[2] or "")
                self.close_flag()
                self.open_flag(scope)
                self.last = None
                self.fresh = fresh
            else:
                self.put("(?:", kind=None)
                self.scopes.append(inner)
                self.set_flags(inner, found[1], found[2] or "")
                self.open_flag(inner)
            return
        else:
            raise PatternError(f"unsupported group at {self.at}: {rest[:4]}")
        self.put("(", kind=None)
        self.scopes.append(inner)

    def set_flags(self, scope, on, off):
        if (on + off).strip("ims"):
            raise PatternError(f"unsupported flags: {on}-{off}")
        for letter, name in (("i", "ignore_case"), ("m", "multi_line"), ("s", "dot_all")):
            if letter in on:
                setattr(scope, name, True)
            if letter in off:
                setattr(scope, name, False)

    def close_group(self):
        if len(self.scopes) == 1:
            raise PatternError("unexpected )")
        self.close_flag()
        self.scopes.pop()
        self.closed = self.opened.pop()
        self.put(")", kind="group")
        self.at += 1

    # Repeats.

    def repeat(self, text, end, unbounded):
        if self.last in (None, "repeat"):
            raise PatternError(f"nothing to repeat at {self.at}")
        deep = unbounded and self.last == "group"
        self.deep = self.repeated = self.deep or deep
        self.signs.append((len(self.java), self.closed, deep, len(self.scopes) == 1 and not self.scopes[0].open_flag))
        if self.text[end:end + 1] == "?":
            text, end = text + "?", end + 1
        self.put(text, kind="repeat")
        self.at = end

    def counted_repeat(self, found):
        low = int(found[1])
        high = low if found[2] is None else int(found[3]) if found[3] else None
        if max(low, high or 0) > MAX_REPEAT or (high is not None and high < low):
            raise PatternError(f"bad repeat count {found[0]}")
        self.repeat(found[0], found.end(), unbounded=high is None)

    # Escapes and bracket expressions.

    def escape(self):
        following = self.text[self.at + 1:self.at + 2]
        if following in ("b", "B"):
            edge = WORD_EDGE if following == "b" else WORD_INNER
            if following == "b" and _WORD_NEXT.match(self.text, self.at + 2):
                # A word character is sure to follow, so one look back tells.
                edge = f"(?<!{WORD})"
            if self.scopes[-1].ignore_case:
                self.put(f"(?-iu:{edge})", f"(?-i:{edge})")
            else:
                self.put(edge)
            self.at += 2
        elif following == "A":
            self.put(r"\A")
            self.at += 2
        elif following == "z":
            self.put(r"\z", r"\Z")
            self.at += 2
        elif following == "Q":
            end = self.text.find(r"\E", self.at)
            body = self.text[self.at + 2:end if end >= 0 else None]
            for char in body:
                self.put_char(ord(char))
            self.at = end + 2 if end >= 0 else len(self.text)
        else:
            content = _Class()
            code = self.class_item(content)
            if code is not None:
                self.put_char(code)
            else:
                self.put(content.java(), content.python())

    def without(self, ranges):
        """All but the ranges; where case is ignored they are folded first."""
        return _complement(_folded(ranges) if self.scopes[-1].ignore_case else ranges)

    def class_item(self, content):
        """Read one character or one named class; a class is added to ``content``."""
        char = self.text[self.at]
        if char != "\\":
            self.at += 1
            return ord(char)
        following = self.text[self.at + 1:self.at + 2]
        if following.lower() in PERL_CLASSES and following:
            ranges = PERL_CLASSES[following.lower()]
            content.ranges += ranges if following.islower() else self.without(ranges)
            self.at += 2
            return None
        if found := _PROPERTY.match(self.text, self.at):
            content.properties.append(_property(found))
            self.at = found.end()
            return None
        if found := _HEX.match(self.text, self.at):
            code = int(found[1] or found[2], 16)
        elif found := _OCTAL.match(self.text, self.at):
            code = int(found[1], 8)
        elif following in CONTROL_ESCAPES:
            self.at += 2
            return CONTROL_ESCAPES[following]
        elif following and following.isascii() and not following.isalnum():
            self.at += 2
            return ord(following)
        else:
            raise PatternError(f"unsupported escape \\{following}")
        if code > LAST_CODE_POINT:
            raise PatternError(f"bad code point {found[0]}")
        self.at = found.end()
        return code

    def bracket(self):
        content = _Class()
        self.at += 1
        if self.text.startswith("^", self.at):
            content.negated = True
            self.at += 1
        first = True
        while True:
            if self.at >= len(self.text):
                raise PatternError("missing closing ]")
            if self.text[self.at] == "]" and not first:
                self.at += 1
                return content
            first = False
            if found := _POSIX.match(self.text, self.at):
                if found[2] not in POSIX_CLASSES:
                    raise PatternError(f"unknown class {found[0]}")
                ranges = POSIX_CLASSES[found[2]]
                content.ranges += self.without(ranges) if found[1] else ranges
                self.at = found.end()
                continue
            low = high = self.class_item(content)
            if low is None:
                continue
            if self.text.startswith("-", self.at) and self.text[self.at + 1:self.at + 2] not in ("]", ""):
                self.at += 1
                high = self.class_item(content)
                if high is None or high < low:
                    raise PatternError("bad character range")
            content.ranges.append((low, high))


def _run_start(content):
    """Where an alternative that starts with a repeated class may begin to match.

    The leftmost match begins where a run of the class begins, or where the search resumed:
    otherwise the character before it would begin a match too.  That holds for the first atom of
    an alternative with a greedy repeat, if no match of the pattern is empty.  Java would try every character
    of the run, which takes quadratic time on long runs.
    """
    return rf"(?:\G|(?<!{content.java()}))"


def _least_width(python):
    """The length of the shortest match; 0 where Python cannot tell."""
    try:
        return re._parser.parse(python).getwidth()[0]
    except re.error:
        return 0


def _property(found):
    name = found[3] or found[4]
    negated = (found[1] == "P") != bool(found[2])
    if name == "Any":
        raise PatternError("use [\\x{0}-\\x{10FFFF}] for any character")
    java = name if _CATEGORY.match(name) else f"Is{name}"
    return f"\\{'P' if negated else 'p'}{{{java}}}"


def translate_regex(text: str) -> Regex:
    """RE2 pattern text → :class:`Regex`; raises :class:`PatternError` if RE2 would refuse it."""
    return _Translator(text).run()
