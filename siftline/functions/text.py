"""Column expressions on text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from siftline.functions.fields import JSON_OPTIONS


def strip_carriage_return(line: Column) -> Column:
    """A line without the one ``\\r`` that may end it."""
    return F.when(F.endswith(line, F.lit("\r")), F.substring(line, F.lit(1), F.length(line) - 1)).otherwise(line)


def trim_space(text: Column) -> Column:
    """Text without leading and trailing Unicode white space."""
    return F.regexp_replace(text, r"(?U)\A\s++|(?<!\s)\s++\z", "")


def unescape(text: Column) -> Column:
    """Undo ``\\n \\r \\t \\"`` and then, if the result is a valid JSON string body, ``\\uXXXX``.

    The second step fails as a whole and keeps the text: one that holds a real line break or
    quote by then keeps its ``\\u`` escapes.
    """
    plain = text
    # The escapes, in the order they are replaced.
    for escape, char in (("\\n", "\n"), ("\\r", "\r"), ("\\t", "\t"), ('\\"', '"')):
        plain = F.replace(plain, F.lit(escape), F.lit(char))
    parsable = F.rlike(plain, F.lit(r'\A(?:[^\\"\x{0}-\x{1F}]++|\\["\\/bfnrt]|\\u[0-9A-Fa-f]{4})*+\z'))
    body = F.when(parsable, F.concat(F.lit('"'), plain, F.lit('"')))
    decoded = F.try_variant_get(F.from_json(body, "variant", JSON_OPTIONS), "$", "string")
    whole = F.when(F.contains(plain, F.lit("\\u")), F.coalesce(decoded, plain)).otherwise(plain)
    return F.when(F.contains(text, F.lit("\\")), whole).otherwise(text)


#: Characters that are sorted at once to count them.
ENTROPY_WINDOW = 32_768


def _runs(text: Column) -> Column:
    """Runs of equal characters of the sorted text."""
    return F.regexp_extract_all(F.array_join(F.sort_array(F.split(text, "")), ""), F.lit(r"(?s)(.)\1*+"), F.lit(0))


def shannon_entropy(text: Column) -> Column:
    """``-Σ p·log2 p`` over characters, where p is a character's count over the length in bytes.

    The sorted characters are cut into runs of equal ones, so the cost is that of a sort and no
    Python is involved; empty text gives 0.  Long texts are counted window by window and the counts
    added up, so memory is that of the text and of its different characters.
    """
    size = F.octet_length(text).cast("double")

    def share(count):
        part = count / size
        return part * F.log2(part)

    short = F.aggregate(_runs(text), F.lit(0.0), lambda total, run: total - share(F.char_length(run)))
    windows = F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{ENTROPY_WINDOW}}}"), F.lit(0))
    counts = F.sort_array(F.flatten(F.transform(windows, lambda window: F.transform(
        _runs(window), lambda run: F.struct(F.left(run, F.lit(1)).alias("char"), F.char_length(run).cast("bigint").alias("n")),
    ))))
    # Counts of one character stand together.
    start = F.struct(F.lit(None).cast("string").alias("char"), F.lit(0).cast("bigint").alias("n"), F.lit(0.0).alias("total"))
    done = F.aggregate(
        counts, start, lambda at, entry: F.when(at["char"].eqNullSafe(entry["char"]), F.struct(
            at["char"].alias("char"), (at["n"] + entry["n"]).alias("n"), at["total"].alias("total"),
        )).otherwise(F.struct(
            entry["char"].alias("char"), entry["n"].alias("n"),
            (at["total"] - F.when(at["n"] > 0, share(at["n"])).otherwise(0.0)).alias("total"),
        )),
        lambda at: at["total"] - share(at["n"]),
    )
    value = F.when(F.char_length(text) <= ENTROPY_WINDOW, short).otherwise(done)
    return F.when(size > 0, value).otherwise(F.lit(0.0))


def split_lines(text: Column) -> Column:
    """Lines as a line reader sees them: a final line break does not open another line."""
    body = F.when(F.endswith(text, F.lit("\n")), F.substring(text, F.lit(1), F.length(text) - 1)).otherwise(text)
    lines = F.transform(F.split(body, "\n"), strip_carriage_return)
    return F.when(text == "", F.array().cast("array<string>")).otherwise(lines)


def file_extension(file: Column) -> Column:
    """The last dot and what follows it in the last path step, or empty text."""
    return F.regexp_extract(file, r"(\.[^./]*)\z", 1)
