"""Decoders used by enrichers; each gives NULL where the text is not what it decodes."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column, functions as F

from siftline.functions.fields import JSON_OPTIONS, parse_json


def percent_decode(text: Column) -> Column:
    """Percent escapes decoded as UTF-8; ``+`` and broken escapes stay as they are."""
    guarded = F.regexp_replace(text, r"%(?![0-9A-Fa-f]{2})", "%25")
    decoded = F.try_url_decode(F.replace(guarded, F.lit("+"), F.lit("%2B")))
    return F.when(F.contains(text, F.lit("%")), F.coalesce(decoded, text)).otherwise(text)


def base64_text(text: Column) -> Column:
    """Base64 → text, with U+FFFD for bytes that are not UTF-8."""
    return F.make_valid_utf8(F.try_to_binary(text, F.lit("base64")).cast("string"))


def jwt_text(text: Column) -> Column:
    """Header and payload of a JSON web token, decoded and put side by side."""
    parts = F.split(F.translate(text, "-_", "+/"), r"\.")
    return F.concat(base64_text(F.get(parts, F.lit(0))), base64_text(F.get(parts, F.lit(1))))


def normal_json(text: Column) -> Column:
    """JSON text in compact form."""
    return F.to_json(parse_json(text))


def json_value(text: Column) -> Column:
    """A JSON string's characters; any other JSON value as compact JSON."""
    return F.try_variant_get(parse_json(text), "$", "string")


def html_text(text: Column) -> Column:
    """HTML entities replaced by their characters."""
    def replaced(texts: pd.Series) -> pd.Series:
        return texts.map(html.unescape, na_action="ignore")

    # Defined here so that tasks get it by value and need no copy of this package.  Texts without
    # an ampersand, which are most, do not go through Python.
    decoded = F.pandas_udf(replaced, "string")(F.when(F.contains(text, F.lit("&")), text))
    return F.coalesce(decoded, text)


def url_part(text: Column, number: int, prefix: str = "") -> Column:
    """The n-th part between slashes of every line of the text."""
    def part(line):
        return F.concat(F.lit(prefix), F.coalesce(F.get(F.split(line, "/"), F.lit(number - 1)), F.lit("")))

    return F.array_join(F.transform(F.split(text, "\n"), part), "\n")


def dotted_quads(text: Column) -> Column:
    """All dotted quads, one per line."""
    return F.array_join(F.regexp_extract_all(text, F.lit(r"([0-9]{1,3}\.){3}[0-9]{1,3}"), F.lit(0)), "\n")


def technologies(text: Column) -> Column:
    """Elements of the ``tech`` array of a JSON object, one per line, or ``None``."""
    parsed = F.from_json(text, "struct<tech:array<string>>", {"maxStringLen": JSON_OPTIONS["maxStringLen"]})
    return F.coalesce(F.array_join(parsed["tech"], "\n"), F.lit("None"))


def hash_kind(text: Column) -> Column:
    """The kind of hash by its length."""
    # Text length of each kind.
    size = F.char_length(F.trim(text))
    return (F.when(size == 32, "MD5").when(size == 40, "SHA1").when(size == 64, "SHA256").otherwise("Unknown"))
