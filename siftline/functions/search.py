"""Searching text for a translated pattern.

Patterns run inside Spark's own functions.  Only those with an unbounded repeat of a group that cannot be
written possessive, where Java recurses once per repetition, run on Python's ``re`` in Arrow batches; if such a pattern also
uses a Unicode class, which ``re`` lacks, Java it is, and ``-Xss`` sets how long a match may be.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, functions as F

from siftline.functions.regex import Regex


def runs_in_python(regex: Regex) -> bool:
    return regex.deep and regex.python is not None


def match_finder(expression: str) -> Callable[[pd.Series], pd.Series]:
    """Every match that is not empty, with its groups; made here so that tasks get it by value."""

    def find(texts: pd.Series) -> pd.Series:
        compiled = re.compile(expression)

        def matches(text):
            found, at = [], 0
            while text is not None and at <= len(text) and (match := compiled.search(text, at)):
                if match.end() > match.start():
                    found.append([group or "" for group in (match[0], *match.groups())])
                    at = match.end()
                else:
                    at = match.end() + 1
            return found

        return texts.map(matches)

    return find


def _first_finder(expression: str) -> Callable[[pd.Series], pd.Series]:
    def first(texts: pd.Series) -> pd.Series:
        compiled = re.compile(expression)
        found = (None if text is None else compiled.search(text) for text in texts)
        return pd.Series([match and match[0] for match in found], dtype=object)

    return first


def every_match(content: Column, regex: Regex) -> Column:
    """All matches with their groups, as an array of arrays, by Python."""
    return F.pandas_udf(match_finder(regex.python), "array<array<string>>")(content)


def group_arrays(content: Column, regex: Regex) -> list[Column]:
    """One array per group, the whole match first; ``""`` for a group that took no part."""
    whole = F.regexp_extract_all(content, F.lit(regex.java), F.lit(0))
    if regex.inner or regex.free:
        return [whole, *groups_within(whole, regex)]
    return [whole, *[F.regexp_extract_all(content, F.lit(regex.java), F.lit(group)) for group in range(1, regex.groups + 1)]]


def groups_within(whole: Column, regex: Regex) -> list[Column]:
    """One array per group, found in the texts of the whole matches; for patterns with ``inner`` or ``free``."""
    return [F.transform(whole, _inner(regex, group)) for group in range(1, regex.groups + 1)]


def _inner(regex: Regex, group: int) -> Callable[[Column], Column]:
    return lambda match: F.regexp_extract(match, regex.inner or rf"\A(?:{regex.java})\z", group)


def first_match(content: Column, regex: Regex) -> Column:
    """The first match; NULL or empty text if there is none."""
    if runs_in_python(regex):
        return F.pandas_udf(_first_finder(regex.python), "string")(content)
    return F.regexp_extract(content, regex.java, 0)


def has_match(content: Column, regex: Regex) -> Column:
    """Whether the pattern matches anywhere, be it without length."""
    if runs_in_python(regex):
        return first_match(content, regex).isNotNull()
    return F.rlike(content, F.lit(regex.java))


def count_matches(content: Column, regex: Regex) -> Column:
    """Number of matches that are not empty."""
    if runs_in_python(regex):
        return F.array_size(every_match(content, regex))
    return F.array_size(F.filter(group_arrays(content, regex)[0], lambda match: match != ""))
