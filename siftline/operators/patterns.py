"""The pattern catalog: loading, selecting and listing."""

from __future__ import annotations

import logging
import re
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from siftline.functions.regex import PatternError, Regex, translate_regex

#: Shorter literals are too common to be worth a test.
MIN_LITERAL = 3

log = logging.getLogger(__name__)

#: Layout of a pattern definition file.
DEFINITION = T.StructType([
    T.StructField("flags", T.StringType()),
    T.StructField("pattern", T.StringType()),
    T.StructField("patterns", T.ArrayType(T.StringType())),
    T.StructField("engine", T.StringType()),
    T.StructField("tags", T.ArrayType(T.StringType())),
    T.StructField("_corrupt_record", T.StringType()),
])


@dataclass(frozen=True)
class Pattern:
    """A named pattern in RE2 syntax.

    ``needs`` lists literals of which every match contains at least one, and ``sieve`` is a
    cheaper regex, with flags of its own, that matches somewhere in every match.  They only save
    work: a text without them is not searched.  Under ``ignore_case`` the literals are lower-case
    ASCII.
    """

    name: str
    regex: str
    ignore_case: bool = False
    tags: tuple[str, ...] = ()
    needs: tuple[str, ...] = ()
    sieve: str = ""

    def __post_init__(self):
        if self.ignore_case:
            for literal in self.needs:
                if literal != literal.lower() or not literal.isascii():
                    raise ValueError(f"{self.name}: literal {literal!r} must be lower-case ASCII")

    def effective(self) -> str:
        """The regex with the ignore-case flag written into it."""
        if self.ignore_case and not self.regex.startswith("(?i)"):
            return "(?i)" + self.regex
        return self.regex


def leading_literal(regex: str) -> str:
    """The longest run of plain characters before the first group, class or escape.

    Every match holds it.  A character made optional by ``?`` or ``*`` is not part of a run, and
    a regex with ``|`` or ``{`` has none.
    """
    if "|" in regex or "{" in regex:
        return ""
    head = re.split(r"[\[(\\]", regex)[0]
    return max(re.split(r"[.^$]|\+\??|.[?*]\??", head), key=len)


#: A group of plain words, neither optional nor repeated away, and nothing but plain text around it.
_WORD_GROUP = re.compile(r"\((?:\?:)?([^()\[\]{}\\|.^$*+?]+(?:\|[^()\[\]{}\\|.^$*+?]+)+)\)(?![*?{])")


def mandatory_literals(regex: str) -> tuple[str, ...]:
    """Literals of which every match has one: the words of a group that has to match, or one run of characters."""
    single = leading_literal(regex)
    if len(single) >= MIN_LITERAL or regex.startswith("(?"):
        return (single,) if single else ()
    for found in _WORD_GROUP.finditer(regex):
        around = regex[:found.start()] + regex[found.end():]
        # No other choice and no group that this one might stand in.
        if "|" not in around and "(" not in around and ")" not in around and "[" not in regex[:found.start()]:
            return tuple(found[1].split("|"))
    return (single,) if single else ()


def literals_of(alternatives: Iterable[str], ignore_case: bool) -> tuple[str, ...]:
    """One literal per alternative, or nothing if some alternative has none of at least 3 letters."""
    lists = [mandatory_literals(item) for item in alternatives]
    found = [literal for literals in lists for literal in literals]
    if not all(lists) or any(len(literal) < MIN_LITERAL or not literal.isascii() for literal in found):
        return ()
    return tuple(dict.fromkeys(literal.lower() if ignore_case else literal for literal in found))


def pattern(name: str, regex: str | Iterable[str], flags: str = "", tags=(), needs=(), sieve: str = "") -> Pattern:
    """Build a pattern from the parts of a definition; the letter ``i`` in flags ignores case."""
    alternatives = [regex] if isinstance(regex, str) else list(regex)
    ignore_case = "i" in flags
    return Pattern(
        name=name,
        regex="|".join(alternatives),
        ignore_case=ignore_case,
        tags=tuple(tags),
        needs=tuple(needs) or literals_of(alternatives, ignore_case),
        sieve=sieve,
    )


def load_patterns(spark: SparkSession, folder: str) -> list[Pattern]:
    """Patterns defined by the ``*.json`` files of a folder, named by file stem.

    Of a definition with both ``pattern`` and ``patterns`` only the first counts; several
    ``patterns`` are joined by ``|``.  Files that are not valid JSON are left out.  The definitions are settings, a few lines each,
    so they are held on the driver; no data goes through here.
    """
    name = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.json$", 1)
    rows = (
        spark.read.schema(DEFINITION).option("multiLine", True)
        .option("columnNameOfCorruptRecord", "_corrupt_record")
        .option("pathGlobFilter", "*.json").json(folder)
        .select("*", F.url_decode(F.replace(name, F.lit("+"), F.lit("%2B"))).alias("name"))
        .filter(F.col("_corrupt_record").isNull())
        .drop("_corrupt_record")
        .orderBy("name")
        .collect()
    )
    return [
        pattern(row["name"], row["pattern"] or row["patterns"] or "", row["flags"] or "", row["tags"] or ())
        for row in rows
    ]


def select_patterns(
    catalog: Iterable[Pattern], names: Iterable[str] | str | None = None, tags: Iterable[str] | None = None
) -> list[Pattern]:
    """Patterns by name (a list, or one comma-separated string), by any common tag, or all.

    Each pattern is returned once however many of the tags it carries.
    """
    catalog = list(catalog)
    if tags is not None:
        wanted = set(tags)
        return [item for item in catalog if wanted & set(item.tags)]
    if names is None:
        return catalog
    if isinstance(names, str):
        names = names.split(",")
    by_name = {item.name: item for item in catalog}
    return [by_name[name.strip()] for name in names if name.strip() in by_name]


def list_patterns(spark: SparkSession, catalog: Iterable[Pattern]) -> DataFrame:
    """The catalog as a DataFrame, for listing."""
    rows = [(item.name, item.regex, item.ignore_case, list(item.tags)) for item in catalog]
    return spark.createDataFrame(rows, "name string, regex string, ignore_case boolean, tags array<string>")


def tag_counts(spark: SparkSession, catalog: Iterable[Pattern]) -> DataFrame:
    """Number of patterns per tag."""
    tags = list_patterns(spark, catalog).select(F.explode("tags").alias("tag"))
    return tags.groupBy("tag").agg(F.count(F.lit(1)).alias("patterns"))


def compile_patterns(catalog: Iterable[Pattern]) -> list[tuple[Pattern, Regex]]:
    """Translate the patterns; one that cannot be translated is skipped and the rest go on."""
    compiled = []
    for item in catalog:
        try:
            compiled.append((item, translate_regex(item.effective())))
        except PatternError as problem:
            log.warning("pattern %s skipped: %s", item.name, problem)
    return compiled
