"""Matching: records in, one row per match out."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, functions as F

from siftline.functions.literals import lines_with, numbers_found
from siftline.functions.regex import Regex, translate_regex
from siftline.functions.search import count_matches, every_match, group_arrays, groups_within, has_match, runs_in_python
from siftline.functions.text import shannon_entropy
from siftline.model import FINDING, TOOL_OUTPUT
from siftline.operators.patterns import Pattern, compile_patterns

#: So many patterns with literals are tested by one search for all of them.
MANY = 40
#: Of so many patterns that stay within a line, only lines with a literal are searched, in texts of so many bytes.
BY_LINES = 8
LONG = 500

HITS = "array<struct<pattern:string,ordinal:bigint,matches:array<string>>>"


def may_match(content: Column, pattern: Pattern) -> Column | None:
    """A cheap test that is true for every text the pattern matches; None where there is none."""
    if not pattern.needs and not pattern.sieve:
        return None
    text = fold(content) if pattern.ignore_case else content
    tests = [F.contains(text, F.lit(literal)) for literal in pattern.needs]
    any_literal = [reduce(or_, tests)] if tests else []
    sieve = [F.rlike(content, F.lit(translate_regex(pattern.sieve).java))] if pattern.sieve else []
    return reduce(and_, any_literal + sieve)


def fold(content: Column) -> Column:
    """The text in lower case, as literals are compared where case is ignored."""
    # Besides the capital letters, only two characters fold to ASCII: U+212A, which lower() turns
    # into k, and the long s.
    return F.replace(F.lower(content), F.lit("ſ"), F.lit("s"))


def by_lines(pattern: Pattern, regex: Regex) -> bool:
    """Whether lines without a literal of the pattern can be left out of a text, but for the first and the last one.

    Every match then lies in a line that has one, with at most one of the line breaks beside that.
    """
    plain = all(literal.isascii() and "\n" not in literal for literal in pattern.needs)
    return bool(pattern.needs) and plain and not pattern.sieve and regex.one_line and not runs_in_python(regex)


def scan(records: DataFrame, patterns: Iterable[Pattern], content: str = "content") -> DataFrame:
    """Every non-overlapping match of every pattern, left to right; zero-length matches are dropped.

    All other columns of ``records`` are kept, and these are added: ``pattern``, ``ordinal``
    (place among the pattern's matches in the record), ``content`` (the match itself),
    ``matches`` (the match and its groups, ``""`` for a group that took no part), ``entropy``,
    ``ext`` and an empty ``tool_data``.

    The input is read once for all patterns and nothing is shuffled, so the same function
    serves batch and streaming DataFrames.  Groups 1..n are searched only where the pattern hit.  Of many patterns
    with literals only those run whose literals one search has found in the text.  Where several stay within a
    line, the lines with their literals are found first, and only those are searched.
    """
    kept = [name for name in records.columns if name != content]
    text = F.col("_text")
    near, whole, parts, arrays = {}, {}, {}, []
    compiled = compile_patterns(patterns)
    sought = [item for item in compiled if item[0].needs and not item[1].inner and not runs_in_python(item[1])]
    if len(sought) >= MANY:
        compiled = [item for item in compiled if item not in sought]
        whole["_candidates"] = candidates(text, [pattern for pattern, _ in sought])
        arrays.append(_searched(text, F.col("_candidates"), sought))
    lined = [index for index, (pattern, regex) in enumerate(compiled) if by_lines(pattern, regex)]
    if len(lined) < BY_LINES:
        lined = []
    for index, (pattern, regex) in enumerate(compiled):
        first = f"_g{index}_0"
        hit = F.size(first) > 0
        guard = may_match(text, pattern)
        if runs_in_python(regex):
            whole[first] = every_match(text if guard is None else F.when(guard, text), regex)
            rows = F.transform(first, _hit(pattern.name, lambda match: match))
        else:
            searched = text
            if index in lined:
                searched = F.col(f"_n{index}")
                lines = F.col("_lines")[lined.index(index)].cast("string")
                near[f"_n{index}"] = F.when(F.col("_lines").isNotNull(), lines).otherwise(F.when(guard, text))
                guard = None
            groups = group_arrays(searched, regex)
            if regex.inner or regex.free:
                groups[1:] = groups_within(F.col(first), regex)
            whole[first] = groups[0] if guard is None else F.when(guard, groups[0])
            names = [f"_g{index}_{group}" for group in range(len(groups))]
            parts.update({name: F.when(hit, group) for name, group in zip(names[1:], groups[1:])})
            rows = F.transform(F.arrays_zip(*names), _hit(pattern.name, _fields(names)))
        arrays.append(F.coalesce(F.when(hit, rows).cast(HITS), F.array().cast(HITS)))
    stage = records.withColumnRenamed(content, "_text")
    if near:
        long = F.when(F.octet_length(text) >= LONG, text.cast("binary"))
        wanted = [(compiled[index][0].needs, compiled[index][0].ignore_case) for index in lined]
        stage = stage.withColumn("_lines", F.pandas_udf(lines_with(wanted), "array<binary>")(long)).withColumns(near)
    stage = stage.withColumns(whole) if whole else stage
    stage = stage.withColumns(parts) if parts else stage
    every = F.concat(*arrays) if arrays else F.array().cast(HITS)
    exploded = stage.select(*kept, F.explode(every).alias("_hit"))
    matched = F.col("_hit.matches")[0]
    return exploded.filter(matched != "").select(
        *kept,
        F.col("_hit.pattern").alias("pattern"),
        F.col("_hit.ordinal").alias("ordinal"),
        matched.alias("content"),
        F.col("_hit.matches").alias("matches"),
        shannon_entropy(matched).alias("entropy"),
        F.lit("").alias("ext"),
        F.array().cast(f"array<{TOOL_OUTPUT.simpleString()}>").alias("tool_data"),
    )


def candidates(text: Column, patterns: list[Pattern]) -> Column:
    """The numbers of the patterns that may match a text: those of which it holds a literal, in order."""
    plain: dict[str, list[int]] = {}
    folded: dict[str, list[int]] = {}
    for number, pattern in enumerate(patterns):
        for literal in pattern.needs:
            (folded if pattern.ignore_case else plain).setdefault(literal, []).append(number)
    found = [numbers_found(text, plain)] if plain else []
    if folded:
        found.append(numbers_found(F.replace(F.lower(text), F.lit("ſ"), F.lit("s")), folded))
    return F.array_sort(F.array_distinct(F.concat(*found)))


def _searched(text: Column, numbers: Column, compiled: list[tuple[Pattern, Regex]]) -> Column:
    """The hits of the patterns with these numbers; each is looked up with its text and run on its own."""
    names = F.lit([pattern.name for pattern, _ in compiled])
    expressions = F.lit([regex.java for _, regex in compiled])
    groups = F.lit([regex.groups for _, regex in compiled])

    def hits(number: Column) -> Column:
        found = F.transform(F.sequence(F.lit(0), F.get(groups, number)), lambda group: F.regexp_extract_all(text, F.get(expressions, number), group))
        return F.flatten(F.transform(F.array(found), lambda parts: F.transform(parts[0], lambda match, ordinal: F.struct(
            F.get(names, number).alias("pattern"), ordinal.cast("bigint").alias("ordinal"), F.transform(parts, lambda part: part[ordinal]).alias("matches"),
        ))))

    return F.coalesce(F.flatten(F.transform(numbers, hits)).cast(HITS), F.array().cast(HITS))


def _fields(names: list[str]) -> Callable[[Column], Column]:
    return lambda match: F.array(*[match[name] for name in names])


def _hit(name: str, groups: Callable[[Column], Column]) -> Callable[[Column, Column], Column]:
    def build(match: Column, ordinal: Column) -> Column:
        return F.struct(F.lit(name).alias("pattern"), ordinal.alias("ordinal"), groups(match).alias("matches"))

    return build


def as_findings(found: DataFrame) -> DataFrame:
    """The result of ``scan`` in the exact finding schema, missing columns filled with blanks."""
    blanks = {"id": F.lit(0), "file": F.lit(""), "line": F.lit(0), "ext": F.lit("")}
    return found.select(*[
        (F.col(item.name) if item.name in found.columns else blanks.get(item.name, F.lit(None)))
        .cast(item.dataType).alias(item.name)
        for item in FINDING.fields
    ])


def _test(content: Column, pattern: Pattern, regex: Regex) -> Column:
    guard = may_match(content, pattern)
    matched = has_match(content, regex)
    return matched if guard is None else guard & matched


def grep_lines(records: DataFrame, patterns: Iterable[Pattern], content: str = "content") -> DataFrame:
    """Whole records that match, one row per matching pattern."""
    tests, names = {}, []
    for index, (pattern, regex) in enumerate(compile_patterns(patterns)):
        tests[f"_p{index}"] = _test(F.col(content), pattern, regex)
        names.append(F.when(F.col(f"_p{index}"), F.lit(pattern.name)))
    # The tests are columns of their own, so that work they share is done once.
    tested = records.withColumns(tests) if tests else records
    matched = F.filter(F.array(*names).cast("array<string>"), lambda name: name.isNotNull())
    return tested.select(*records.columns, F.explode(matched).alias("pattern"))


def _hits(content: Column, pattern: Pattern, regex: Regex) -> Column:
    """Number of matches of a pattern in a content; zero-length matches do not count."""
    hits = F.coalesce(count_matches(content, regex), F.lit(0))
    guard = may_match(content, pattern)
    return hits if guard is None else F.when(guard, hits).otherwise(0)


def hit_columns(content: Column, patterns: Iterable[Pattern], prefix: str) -> tuple[dict[str, Column], Column]:
    """Columns that count hits, and an array of (pattern, hits) made of them."""
    counts, pairs = {}, []
    for index, (pattern, regex) in enumerate(compile_patterns(patterns)):
        counts[f"{prefix}{index}"] = _hits(content, pattern, regex)
        pairs.append(F.struct(F.lit(pattern.name).alias("pattern"), F.col(f"{prefix}{index}").alias("hits")))
    return counts, F.array(*pairs).cast("array<struct<pattern:string,hits:int>>")


def hits_per_pattern(records: DataFrame, patterns: Iterable[Pattern], content: str = "content") -> DataFrame:
    """Total matches and matching records per pattern.

    Every task sums its records into a single row; only those rows are moved.
    """
    compiled = compile_patterns(patterns)
    counts, _ = hit_columns(F.col(content), [pattern for pattern, _ in compiled], "_n")
    counted = records.select(*[count.alias(name) for name, count in counts.items()])
    sums = [F.sum(name).alias(f"hits{name}") for name in counts]
    matching = [F.sum(F.when(F.col(name) > 0, 1).otherwise(0)).alias(f"records{name}") for name in counts]
    totals = counted.agg(F.count(F.lit(1)), *sums, *matching)
    rows = F.array(*[
        F.struct(F.lit(pattern.name).alias("pattern"), *[
            F.coalesce(F.col(f"{kind}{name}"), F.lit(0)).cast("bigint").alias(kind) for kind in ("hits", "records")
        ])
        for (pattern, _), name in zip(compiled, counts)
    ]).cast("array<struct<pattern:string,hits:bigint,records:bigint>>")
    return totals.select(F.inline(rows))
