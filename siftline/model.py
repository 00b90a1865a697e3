"""Schemas and settings shared by all parts of the package."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, types as T

TOOL_OUTPUT = T.StructType([
    T.StructField("tool_id", T.StringType()),
    T.StructField("label", T.StringType()),
    T.StructField("value", T.StringType()),
])

#: One match of one pattern: the shape that sinks write and readers of saved findings return.
FINDING = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("pattern", T.StringType()),
    T.StructField("file", T.StringType()),
    T.StructField("ext", T.StringType()),
    T.StructField("line", T.LongType()),
    T.StructField("content", T.StringType()),
    T.StructField("matches", T.ArrayType(T.StringType())),
    T.StructField("entropy", T.DoubleType()),
    T.StructField("tool_data", T.ArrayType(TOOL_OUTPUT)),
])

#: Columns of a record DataFrame.  ``file`` is the label shown to users, ``source_file`` the path.
RECORD_COLUMNS = ["content", "record_id", "line", "file", "source_file", "target"]

#: Name of the target that stands for the whole line.
WHOLE_LINE = "$"


@dataclass(frozen=True)
class CsvConfig:
    """Layout of a CSV input; no target index means every column."""

    separator: str = ","
    has_header: bool = False
    id_index: int = 0
    target_indices: tuple[int, ...] = ()


@dataclass(frozen=True)
class InputConfig:
    """How records are taken out of an input.

    ``transforms`` maps a target name, or ``"$"`` for every target, to a Column function that
    is applied to the content before matching.
    """

    format: str = "text"
    targets: tuple[str, ...] = ()
    id: str = ""
    decode: bool = False
    filters: Mapping[str, str] = field(default_factory=dict)
    transforms: Mapping[str, Callable[[Column], Column]] = field(default_factory=dict)
    csv: CsvConfig = CsvConfig()
    expand_json: bool = False

    def target_names(self) -> tuple[str, ...]:
        return self.targets or (WHOLE_LINE,)
