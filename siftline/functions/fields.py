"""Reading fields of JSON text by dotted path."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


#: Strict JSON, with strings of any length; the default ends at 20 million characters.
JSON_OPTIONS = {"maxStringLen": str(2**31 - 1), "allowSingleQuotes": "false", "allowNonNumericNumbers": "false"}


def parse_json(line: Column) -> Column:
    """JSON text → VARIANT, NULL where it is not exactly one JSON value.

    The parser ignores what follows a value.  A second array element, a hash of the text, tells
    whether all of the text was read as one value.
    """
    mark = F.xxhash64(line).cast("string")
    pair = F.from_json(F.concat(F.lit("["), line, F.lit(","), mark, F.lit("]")), "variant", JSON_OPTIONS)
    complete = F.try_variant_get(pair, "$[1]", "string") == mark
    return F.when(complete, F.try_variant_get(pair, "$[0]", "variant"))


def is_json_object(line: Column, parsed: Column) -> Column:
    """True for a valid JSON object; a lone ``null`` counts as an object without keys."""
    return parsed.isNotNull() & F.rlike(line, F.lit(r"\A[ \t\r\n]*(\{|null[ \t\r\n]*\z)"))


def variant_path(path: str) -> str:
    """``a.b`` → ``$["a"]["b"]``; steps are only ever split on dots."""
    steps = []
    for step in path.split("."):
        quote = "'" if '"' in step else '"'
        if quote in step:
            raise ValueError(f"field name with both kinds of quotes: {step}")
        steps.append(f"[{quote}{step}{quote}]")
    return "$" + "".join(steps)


def field(parsed: Column, path: str) -> Column:
    """The value at a path as text; NULL where it is missing or JSON null.

    Strings are raw, objects and arrays compact JSON.  Numbers keep their digits, without the
    ``.0`` that a whole double would show.
    """
    if path == "":
        return F.lit(None).cast("string")
    steps = variant_path(path)
    text = F.try_variant_get(parsed, steps, "string")
    whole = F.rlike(text, F.lit(r"\A-?[0-9]+\.0\z"))
    number = F.schema_of_variant(F.try_variant_get(parsed, steps, "variant")) != "STRING"
    return F.when(whole & number, F.substring(text, F.lit(1), F.length(text) - 2)).otherwise(text)


def filter_equals(parsed: Column, filters: dict[str, str]) -> Column:
    """True where every field equals its text; a missing field fails."""
    test = F.lit(True)
    for path, text in filters.items():
        test = test & F.coalesce(field(parsed, path) == F.lit(text), F.lit(False))
    return test
