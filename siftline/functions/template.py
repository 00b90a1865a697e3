"""Text templates with ``{{slots}}`` filled from a finding's columns.

A template is cut once, on the driver, into literal text and slots, and becomes one ``concat``.
Slot text found inside the data is therefore never filled again.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

_SLOT = re.compile(r"\{\{(\w+|match\[\d+\]|tool:[^{}]+)\}\}")

#: Columns a slot may name directly.
COLUMNS = ("content", "file", "line", "pattern", "ext")


def main_match(matches: str = "matches", content: str = "content") -> Column:
    """The whole match if there is one, else the content."""
    return F.coalesce(F.get(F.col(matches), F.lit(0)), F.col(content))


def tool_value(name: str, tool_data: str = "tool_data") -> Column:
    """The first output recorded under a tool's id or label; NULL if there is none."""
    named = F.filter(F.col(tool_data), lambda output: (output["tool_id"] == name) | (output["label"] == name))
    return F.get(named, F.lit(0))["value"]


def render_placeholders(template: str, extracted: Column | None = None, with_entropy: bool = False) -> Column:
    """The template as a text column; slots that cannot be filled stay as they are."""
    parts, at = [], 0
    for slot in _SLOT.finditer(template):
        value = _slot_value(slot[1], extracted, with_entropy)
        if value is not None:
            parts.append(F.lit(template[at:slot.start()]))
            parts.append(F.coalesce(value.cast("string"), F.lit(slot[0])))
            at = slot.end()
    parts.append(F.lit(template[at:]))
    return F.concat(*parts)


def _slot_value(name: str, extracted: Column | None, with_entropy: bool) -> Column | None:
    if name == "extracted":
        return extracted
    if name == "match":
        return main_match()
    if name == "entropy":
        return F.format_string("%.3f", F.col("entropy")) if with_entropy else None
    if name in COLUMNS:
        return F.coalesce(F.col(name).cast("string"), F.lit("0" if name == "line" else ""))
    if name.startswith("match["):
        return F.get(F.col("matches"), F.lit(int(name[6:-1])))
    if name.startswith("tool:"):
        return tool_value(name[5:])
    return None
