"""Records from CSV files, split over tasks even where cells hold line breaks.

Files are read by line, so any file splits.  Two regular expressions tell for each line whether
a quoted cell is open at its end, given that one was or was not open at its start.  Where no line
leaves a cell open, lines are rows.  Where some do, the answers are folded along each block, then
along the blocks of the file; with the state at its start known, each block joins its lines.

Quotes are lazy: one inside an unquoted cell, or inside a quoted cell but not before a separator
or the end of the line, is an ordinary character.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from siftline.functions.text import strip_carriage_return
from siftline.model import CsvConfig
from siftline.session import stored
from siftline.sources.lines import MAX_BLOCKS, add_shift, file_label, in_parts, literal_path, raw_lines, row_in_task

#: Rows numbered together by one window in files with multi-line cells.
ROWS_PER_GROUP = 100_000


@dataclass(frozen=True)
class Grammar:
    """Regular expressions for rows with one separator character."""

    separator: str

    @property
    def sep(self) -> str:
        return f"\\x{{{ord(self.separator):X}}}"

    @property
    def rest_of_quoted(self) -> str:
        return rf'(?:[^"]++|""|"(?!{self.sep}|\z))*+"'

    @property
    def cell(self) -> str:
        return rf'"{self.rest_of_quoted}(?={self.sep}|\z)|[^"{self.sep}][^{self.sep}]*+|'

    @property
    def more_cells(self) -> str:
        return rf"(?:{self.sep}(?:{self.cell}))*+\z"

    def complete(self, line: Column) -> Column:
        """No cell is open at the end of a line that starts a row."""
        return F.rlike(line, F.lit(rf"\A(?:{self.cell}){self.more_cells}"))

    def closes(self, line: Column) -> Column:
        """No cell is open at the end of a line that starts inside a quoted cell."""
        return F.rlike(line, F.lit(rf"\A{self.rest_of_quoted}{self.more_cells}"))

    def cells(self, row: Column) -> Column:
        """Cells of a row, quotes resolved."""
        # With a separator ahead of the first cell too, no match is empty.
        raw = F.regexp_extract_all(F.concat(F.lit(self.separator), row), F.lit(rf"{self.sep}({self.cell})"), F.lit(1))

        def plain(cell):
            inner = F.substring(cell, F.lit(2), F.length(cell) - 2)
            return F.when(F.startswith(cell, F.lit('"')), F.replace(inner, F.lit('""'), F.lit('"'))).otherwise(cell)

        return F.when(F.contains(row, F.lit('"')), F.transform(raw, plain)).otherwise(
            F.split(row, self.sep)
        )


def _tested(rows: DataFrame, grammar: Grammar) -> DataFrame:
    value = F.col("value")
    return rows.withColumns({"_complete": grammar.complete(value), "_closes": grammar.closes(value)})


def line_states(complete: np.ndarray, closes: np.ndarray, start: bool) -> np.ndarray:
    """Whether a cell is open after each line, given whether one is open before the first.

    A line sets the state, keeps it or turns it round, whatever it was: the last line that sets it and the
    number of turns since tell it.
    """
    outside, inside = ~complete, ~closes
    sets = outside == inside
    turns = np.cumsum(outside & ~inside)
    last = np.maximum.accumulate(np.where(sets, np.arange(len(sets)), -1))
    since = turns - np.where(last >= 0, turns[last], 0)
    return np.where(last >= 0, outside[last], start) ^ (since % 2 == 1)


def _block_runs(batch: pa.RecordBatch) -> list[tuple[int, int, str, int]]:
    """(first, end, path, block) of the runs of lines of one block."""
    if not batch.num_rows:
        return []
    path = batch.column("_path").dictionary_encode()
    codes, block = path.indices.to_numpy(), batch.column("_block").to_numpy()
    cuts = np.flatnonzero((codes[1:] != codes[:-1]) | (block[1:] != block[:-1])) + 1
    bounds = [0, *cuts.tolist(), batch.num_rows]
    return [(a, b, path.dictionary[int(codes[a])].as_py(), int(block[a])) for a, b in zip(bounds[:-1], bounds[1:])]


def _flags(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False).astype(bool)


def fold_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per block: whether a cell is open at its end and how many rows begin in it, for either start."""
    place, states, begun, rows = None, [False, True], [0, 0], []
    for batch in batches:
        blank, complete, closes = (_flags(batch, name) for name in ("_blank", "_complete", "_closes"))
        for first, end, *here in _block_runs(batch):
            if place != here:
                if place:
                    rows.append((*place, *states, *begun))
                place, states, begun = here, [False, True], [0, 0]
            part = slice(first, end)
            for k in (0, 1):
                after = line_states(complete[part], closes[part], states[k])
                before = np.concatenate([[states[k]], after[:-1]])
                begun[k] += int((~before & ~blank[part]).sum())
                states[k] = bool(after[-1])
    if place:
        rows.append((*place, *states, *begun))
    yield pa.RecordBatch.from_pylist([dict(zip(FOLDED.names, row)) for row in rows], FOLDED)


FOLDED = pa.schema([
    ("_path", pa.string()), ("_block", pa.int64()), ("_open0", pa.bool_()), ("_open1", pa.bool_()), ("_begun0", pa.int64()), ("_begun1", pa.int64()),
])


def chain_blocks(blocks: pa.Table) -> pa.Table:
    """For the blocks of one file: whether each starts inside a cell, and the rows begun before it."""
    inside, earlier, found = False, 0, []
    for row in blocks.sort_by("_block").to_pylist():
        found.append({"_path": row["_path"], "_block": row["_block"], "_start": inside, "_earlier": earlier})
        earlier += row["_begun1"] if inside else row["_begun0"]
        inside = row["_open1"] if inside else row["_open0"]
    return pa.Table.from_pylist(found, pa.schema(
        [("_path", pa.string()), ("_block", pa.int64()), ("_start", pa.bool_()), ("_earlier", pa.int64())]))


class _Joiner:
    """Joins the lines of blocks with known starts, keeping what is open at the end of a batch."""

    def __init__(self) -> None:
        self.place: list | None = None
        self.row, self.inside, self.crosses, self.open = 0, False, False, []

    def leave(self) -> list[tuple]:
        """The part of a row that the block leaves open."""
        found = [(*self.place, self.row, "\n".join(self.open), True, True)] if self.open else []
        self.open = []
        return found

    def lines(self, place: list, texts: pa.Array, blank: np.ndarray, complete: np.ndarray, closes: np.ndarray,
              start: bool, earlier: int) -> tuple[list[tuple], pa.Array, np.ndarray]:
        """Parts of rows that cross borders, and the texts and numbers of the whole rows of a run of lines."""
        parts: list[tuple] = []
        if self.place != place:
            if self.place:
                parts += self.leave()
            self.place, self.row, self.inside, self.crosses = place, earlier, start, start
        after = line_states(complete, closes, self.inside)
        before = np.concatenate([[self.inside], after[:-1]])
        kept = np.flatnonzero(before | ~blank)
        begins = ~before[kept]
        number = self.row + np.cumsum(begins)
        texts = texts.take(pa.array(kept))
        # Rows are runs of equal numbers; the first may have begun before, the last may go on.
        cuts = np.flatnonzero(number[1:] != number[:-1]) + 1 if len(kept) else np.zeros(0, np.int64)
        bounds = np.concatenate([[0], cuts, [len(kept)]]) if len(kept) else np.zeros(1, np.int64)
        rows = [(int(a), int(b)) for a, b in ((bounds[0], bounds[1]), (bounds[-2], bounds[-1]))] if len(kept) else []
        low, high = 0, len(bounds) - 1
        if rows and (self.open or not begins[0]):
            # Goes on from before.
            self.open += texts.slice(rows[0][0], rows[0][1] - rows[0][0]).to_pylist()
            low = 1
            if high > 1 or not after[-1]:
                text = "\n".join(self.open)
                parts.append((*place, int(number[0]), text, self.crosses, False))
                self.open, self.crosses = [], False
        if high > low and after[-1]:
            self.open = texts.slice(rows[1][0], rows[1][1] - rows[1][0]).to_pylist()
            self.crosses = False
            high -= 1
        if len(kept):
            self.row = int(number[-1])
        self.inside = bool(after[-1]) if len(after) else self.inside
        whole = bounds[low : high + 1].astype(np.int32) if high >= low else np.zeros(1, np.int32)
        lists = pa.ListArray.from_arrays(pa.array(whole, pa.int32()), texts)
        return parts, pc.binary_join(lists, "\n"), number[whole[:-1]] if len(whole) > 1 else np.zeros(0, np.int64)


JOINED = pa.schema([
    ("_path", pa.string()), ("_block", pa.int64()), ("_row", pa.int64()), ("value", pa.string()), ("_crosses", pa.bool_()), ("_open", pa.bool_()),
])


def join_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines of blocks with known starts → rows; a row that crosses blocks gives a part per block.

    Flags are worked on as arrays and texts joined as Arrow lists, so no line goes through Python.
    """
    joiner = _Joiner()

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), JOINED)], schema=JOINED)

    for batch in batches:
        complete, closes, start = (_flags(batch, name) for name in ("_complete", "_closes", "_start"))
        value, earlier = batch.column("value"), batch.column("_earlier").to_numpy(zero_copy_only=False)
        blank = pc.equal(value, "").to_numpy(zero_copy_only=False).astype(bool)
        for first, end, *here in _block_runs(batch):
            part = slice(first, end)
            rows, texts, number = joiner.lines(
                here, value.slice(first, end - first), blank[part], complete[part], closes[part], bool(start[first]), int(earlier[first]),
            )
            if rows:
                yield batch_of(rows)
            n = len(number)
            if n:
                yield pa.RecordBatch.from_arrays([
                    pa.array([here[0]] * n), pa.array(np.full(n, here[1])), pa.array(number), texts,
                    pa.array(np.zeros(n, bool)), pa.array(np.zeros(n, bool)),
                ], schema=JOINED)
    left = joiner.leave() if joiner.place else []
    if left:
        yield batch_of(left)


def assemble_rows(lines: DataFrame, grammar: Grammar) -> DataFrame:
    """(_path, _block, value) lines of whole files → (_path, _row, value) rows, blank lines left out.

    The first pass looks at two flags per line, the second joins the lines, both within the tasks that
    read them, and the rows are stored.  Only rows that cross a block border are shuffled.
    """
    tested = _tested(lines, grammar)
    flags = tested.select("_path", "_block", (F.col("value") == "").alias("_blank"), "_complete", "_closes")
    folded = flags.mapInArrow(
        fold_blocks, "_path string, _block long, _open0 boolean, _open1 boolean, _begun0 long, _begun1 long"
    )
    # One row per block, at most MAX_BLOCKS of them.
    starts = stored(folded.groupBy("_path").applyInArrow(
        chain_blocks, "_path string, _block long, _start boolean, _earlier long"
    ))
    known = tested.join(F.broadcast(starts), ["_path", "_block"], "left").withColumn(
        "_start", F.when(F.col("_start").isNull(), F.raise_error(F.lit("files changed between two passes")).cast("boolean"))
        .otherwise(F.col("_start"))
    )
    parts = stored(known.select("_path", "_block", "_start", "_earlier", "value", "_complete", "_closes").mapInArrow(
        join_lines, "_path string, _block long, _row long, value string, _crosses boolean, _open boolean"
    ))
    pieces = F.sort_array(F.collect_list(F.struct("_block", "value", "_open")))
    crossing = parts.filter("_crosses").groupBy("_path", "_row").agg(pieces.alias("_pieces"))
    text = F.array_join(F.transform("_pieces", lambda piece: piece["value"]), "\n")
    # A cell still open at the end of the file ends there.
    closed = F.concat(text, F.when(F.element_at("_pieces", -1)["_open"], F.lit('"')).otherwise(F.lit("")))
    return parts.filter("not _crosses").select("_path", "_row", "value").unionByName(
        crossing.select("_path", "_row", closed.alias("value"))
    )


def _placed(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"_part": F.spark_partition_id(), "_index": row_in_task()})


def _widths(rows: DataFrame, grammar: Grammar) -> DataFrame:
    """Number of lines of each block per number of cells, and whether a line leaves a cell open.

    A few rows per block, stored so that the files are read once for it.
    """
    value = F.col("value")
    return stored(_placed(rows).filter(value != "").groupBy(
        "_path", "_block", "_part", F.size(grammar.cells(value)).alias("_width")
    ).agg(
        F.count(F.lit(1)).alias("rows"), F.min("_index").alias("first"),
        F.max(F.contains(value, F.lit('"')) & ~grammar.complete(value)).alias("open"),
    ))


def _line_rows(lines: DataFrame, widths: DataFrame, grammar: Grammar, config: CsvConfig, large: bool) -> DataFrame:
    """Rows of files in which every line is a row: (cells, line, _path)."""
    # The first row of a file sets the number of cells of all.
    heads = widths.groupBy("_path").agg(F.min(F.struct("_block", "first", "_width")).alias("_head")).select(
        "_path", F.col("_head._width").alias("_head_width"), F.col("_head._block").alias("_head_block"),
        F.col("_head.first").alias("_head_index"),
    )
    header = (F.col("_block") == F.col("_head_block")) if config.has_header else F.lit(False)
    good = F.sum(F.when(F.col("_width") == F.col("_head_width"), F.col("rows")).otherwise(0))
    blocks = widths.join(F.broadcast(heads), "_path").groupBy("_path", "_block", "_part").agg(
        (good - F.max(F.when(header, 1).otherwise(0))).alias("good"), F.min("first").alias("first")
    )
    kept = _placed(lines).join(F.broadcast(heads), "_path").withColumn("cells", grammar.cells(F.col("value"))).filter(
        (F.col("value") != "") & (F.size("cells") == F.col("_head_width"))
    )
    if config.has_header:
        kept = kept.filter(~((F.col("_block") == F.col("_head_block")) & (F.col("_index") == F.col("_head_index"))))
    # The place is taken again among the rows that are left.
    return add_shift(kept.withColumn("_index", row_in_task()), blocks, large).select("cells", "line", "_path")


def _multi_line_rows(lines: DataFrame, grammar: Grammar, config: CsvConfig) -> DataFrame:
    """Rows of files in which some cell holds a line break: (cells, line, _path)."""
    rows = assemble_rows(lines, grammar).select("_path", "_row", grammar.cells(F.col("value")).alias("cells"))
    group = F.floor(F.col("_row") / ROWS_PER_GROUP)
    # A few rows per 100,000 rows of data.
    widths = stored(rows.groupBy("_path", group.alias("_group"), F.size("cells").alias("_width")).agg(
        F.count(F.lit(1)).alias("rows"), F.min("_row").alias("first")
    ))
    heads = widths.groupBy("_path").agg(F.min_by("_width", "first").alias("_head_width"))
    sized = widths.join(F.broadcast(heads), "_path")
    kept = rows.join(F.broadcast(heads), "_path").filter(F.size("cells") == F.col("_head_width"))
    skipped = 1 if config.has_header else 0
    if config.has_header:
        kept = kept.filter(F.col("_row") > 1)
    if sized.filter(F.col("_width") != F.col("_head_width")).isEmpty():
        return kept.select("cells", (F.col("_row") - skipped).alias("line"), "_path")
    # Ragged rows leave gaps: rank the others within groups.
    earlier = Window.partitionBy("_path").orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)
    good = F.sum(F.when(F.col("_width") == F.col("_head_width"), F.col("rows")).otherwise(0))
    before = sized.groupBy("_path", "_group").agg(good.alias("_good")).select(
        "_path", "_group", F.coalesce(F.sum("_good").over(earlier), F.lit(0)).alias("_before")
    )
    within = Window.partitionBy("_path", "_group").orderBy("_row")
    ranked = kept.withColumn("_group", group).withColumn("_rank", F.row_number().over(within))
    line = F.col("_before") + F.col("_rank") - F.when(F.col("_group") > 0, skipped).otherwise(0)
    return ranked.join(before, ["_path", "_group"]).select("cells", line.cast("bigint").alias("line"), "_path")


def csv_records(rows: DataFrame, config: CsvConfig) -> DataFrame:
    """(cells, line, _path) → one record per chosen cell that is not empty."""
    cells = F.col("cells")
    wanted = F.array(*[F.lit(index) for index in config.target_indices]) if config.target_indices else F.sequence(
        F.lit(0), F.size(cells) - 1
    )
    record_id = F.coalesce(F.get(cells, F.lit(config.id_index)), F.lit(""))
    source = file_label(F.col("_path"))
    pairs = F.transform(wanted, lambda index: F.struct(
        index.cast("string").alias("target"), F.get(F.col("cells"), index).alias("content")
    ))
    present = F.filter(pairs, lambda pair: F.coalesce(pair["content"], F.lit("")) != "")
    exploded = rows.select(
        record_id.alias("record_id"), "line", source.alias("source_file"), F.explode(present).alias("_record")
    )
    label = F.when(F.col("record_id") != "", F.concat_ws(":", "source_file", "record_id"))
    return exploded.select(
        F.col("_record.content").alias("content"), "record_id", "line",
        F.coalesce(label, "source_file").alias("file"), "source_file", F.col("_record.target").alias("target"),
    )


def read_csv_records(
    spark: SparkSession, paths: str | Sequence[str], config: CsvConfig = CsvConfig(), max_blocks: int = MAX_BLOCKS,
    **files,
) -> DataFrame:
    """One record per chosen cell; ``line`` counts the good rows of the file, without its header.

    Rows with another number of cells than the file's first row are left out, as are blank
    lines.  Building the reader runs one pass over the files and two more over those with multi-line
    cells, whose rows are stored; file names, but no data, come to the driver.
    """
    grammar = Grammar((config.separator or ",")[0])

    def read(some):
        rows = raw_lines(spark, some, **files)
        return rows.withColumn("value", strip_carriage_return(F.col("value")))

    def number(rows, large):
        widths = _widths(rows, grammar)
        kinds = widths.groupBy("_path").agg(F.max("open").alias("open")).collect()
        open_files = [literal_path(unquote(row["_path"])) for row in kinds if row["open"]]
        if not open_files:
            return _line_rows(rows, widths, grammar, config, large)
        split = _multi_line_rows(read(open_files), grammar, config)
        others = [literal_path(unquote(row["_path"])) for row in kinds if not row["open"]]
        if not others:
            return split
        rest = read(others)
        return split.unionByName(_line_rows(rest, _widths(rest, grammar), grammar, config, large))

    return csv_records(in_parts(paths, read, number, max_blocks), config)
