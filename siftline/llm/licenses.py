"""Licence scan by conditional compression.

Words that stand in a row in a template and in a text put a candidate block where the template would lie.
The block is compressed by Zstandard with each template as a raw dictionary; the more it shrinks against
plain compression, the better the template.  The best ones are confirmed by the exact differences in wording.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.llm.common import Rolling, mixed, slabs, table, word_spans
from siftline.llm.decontaminate import WORD_BYTES
from siftline.llm.license_texts import TEMPLATES

#: Words in a row that make a hit; a template of fewer words is not searched.
ROW = 3
#: How much of a template must be there word by word, and how far a block reaches beyond where the template would lie.
AGREEMENT = 0.9
SLACK = 0.15

_U = np.uint64
FOUND = (
    "license string, first_byte bigint, end_byte bigint, agreement double, size_reduction double, "
    "missing array<string>, added array<string>, wording string"
)


@dataclass(frozen=True)
class Template:
    """A wording of a licence as words, and as bytes with single blanks between them."""

    license: str
    words: tuple[bytes, ...]
    plain: bytes


def templates_of(wordings: dict[str, tuple[str, ...]]) -> list[Template]:
    """The templates; words are runs of letters, digits and bytes above 7F, A-Z in lower case."""
    out = []
    for name, texts in wordings.items():
        for text in texts:
            words = tuple(text.encode().translate(WORD_BYTES).split())
            if len(words) >= ROW:
                out.append(Template(name, words, b" ".join(words)))
    return out


def _rows_of_words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and texts of the words of a slab, and a hash of every ROW words in a row (0 where there are fewer)."""
    spaced = np.frombuffer(data.tobytes().translate(WORD_BYTES), np.uint8)
    starts, ends, rows = word_spans(spaced, at)
    word = mixed(Rolling(spaced).spans(starts, ends))
    token = np.zeros(len(word), _U)
    n = max(0, len(word) - ROW + 1)
    for k in range(ROW):
        token[:n] = mixed(token[:n] * _U(31) + word[k : k + n] + _U(k + 1))
    token[:n][rows[:n] != rows[ROW - 1 :][:n]] = 0
    token[n:] = 0
    return starts, ends, rows, token


class Index:
    """Where each row of words stands in the templates."""

    def __init__(self, templates: list[Template]) -> None:
        self.templates = templates
        self.counts = [Counter(t.words) for t in templates]
        places: dict[int, list[tuple[int, int]]] = {}
        for number, template in enumerate(templates):
            data = np.frombuffer(template.plain, np.uint8)
            *_, token = _rows_of_words(data, np.array([0, len(data)]))
            for place, value in enumerate(token[: len(template.words) - ROW + 1].tolist()):
                places.setdefault(value, []).append((number, place))
        self.places = places
        self.tokens = np.array(sorted(places), _U)
        # The dictionary must have eight bytes or more.
        self.dictionaries = [
            zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(
                t.plain.ljust(8), dict_type=zstandard.DICT_TYPE_RAWCONTENT)) for t in templates
        ]
        self.alone = zstandard.ZstdCompressor(level=3)

    def hits(self, token: np.ndarray) -> np.ndarray:
        """Places of words that begin a row of some template."""
        if not len(self.tokens):
            return np.zeros(0, np.int64)
        near = np.minimum(np.searchsorted(self.tokens, token), len(self.tokens) - 1)
        return np.flatnonzero((self.tokens[near] == token) & (token != 0))

    def blocks(self, hits: np.ndarray, token: np.ndarray, words: int) -> dict[tuple[int, int], set[int]]:
        """Blocks (first word, end word) and the templates that put them there, a block for each place of a template."""
        lines: dict[int, list[int]] = {}
        for at in hits.tolist():
            for number, place in self.places[int(token[at])]:
                lines.setdefault(number, []).append(at - place)
        out: dict[tuple[int, int], set[int]] = {}
        for number, starts in lines.items():
            length = len(self.templates[number].words)
            slack = int(SLACK * length) + 1
            last = None
            for start in sorted(starts):
                # Starts that lie closer than the slack are of one block.
                if last is None or start - last > slack:
                    out.setdefault((max(0, start - slack), min(words, start + length + slack)), set()).add(number)
                    last = start
        return out

    def shrink(self, block: bytes, number: int) -> float:
        """Share of the plainly compressed size that the template as dictionary saves."""
        alone = len(self.alone.compress(block))
        return 1 - len(self.dictionaries[number].compress(block)) / alone


def _confirm(template: Template, words: list[bytes]) -> tuple[int, int, list[bytes], list[bytes]] | None:
    """First and end word of what agrees, the template's missing words and the added ones; None if too few agree."""
    matcher = SequenceMatcher(None, template.words, words, autojunk=False)
    found = [b for b in matcher.get_matching_blocks() if b.size]
    if not found:
        return None
    first, end = found[0].b, found[-1].b + found[-1].size
    missing: list[bytes] = []
    added: list[bytes] = []
    for kind, a, b, c, d in matcher.get_opcodes():
        if kind != "equal":
            missing += template.words[a:b]
            added += words[max(c, first) : min(d, end)]
    agreement = 1 - (len(missing) + len(added)) / len(template.words)
    return (first, end, missing, added) if agreement >= AGREEMENT else None


def find_licenses(index: Index, data: bytes, starts: np.ndarray, ends: np.ndarray, token: np.ndarray) -> list[tuple]:
    """The licences of a text: of findings that overlap the one with most agreeing words stays."""
    hits = index.hits(token)
    if not len(hits):
        return []
    words = [data[a:b].translate(WORD_BYTES) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
    candidates = []
    for (low, high), put in sorted(index.blocks(hits, token, len(words)).items()):
        block = b" ".join(words[low:high])
        ranked = sorted(((index.shrink(block, number), number) for number in put), key=lambda x: (-x[0], x[1]))
        present = Counter(words[low:high])
        for reduction, number in ranked:
            # Words that the block lacks, wherever they stand, are missing in every comparison.
            lacking = sum((index.counts[number] - present).values())
            if 1 - lacking / len(index.templates[number].words) < AGREEMENT:
                continue
            found = _confirm(index.templates[number], words[low:high])
            if found:
                first, end, missing, added = found
                template = index.templates[number]
                agreement = 1 - (len(missing) + len(added)) / len(template.words)
                candidates.append((-(len(template.words) - len(missing) - len(added)), -agreement, -reduction, low + first, low + end, number, missing, added))
    out: list[tuple] = []
    taken: list[tuple[int, int]] = []
    for _, agreement, reduction, first, end, number, missing, added in sorted(candidates, key=lambda c: c[:6]):
        if all(end <= a or first >= b for a, b in taken):
            taken.append((first, end))
            low, high = int(starts[first]), int(ends[end - 1])
            out.append((
                index.templates[number].license, low, high, -agreement, -reduction, [w.decode(errors="replace") for w in missing],
                [w.decode(errors="replace") for w in added], data[low:high].decode(errors="replace"),
            ))
    return sorted(out, key=lambda x: x[1])


def scan_licenses(
    documents: DataFrame, doc_id: str = "doc_id", text: str = "text", wordings: dict[str, tuple[str, ...]] | None = None,
) -> DataFrame:
    """A row for every licence wording in every document.

    ``first_byte`` and ``end_byte`` bound it in the UTF-8 text, ``agreement`` is one less the missing and added
    words over the template's, ``size_reduction`` what the template saves in compressing the block.  Every text
    is read whole, nothing is shuffled.  A null or empty text has no row; repeated rows have theirs each; other
    columns are ignored.
    """
    templates = templates_of(TEMPLATES if wordings is None else wordings)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(templates)
        for batch in batches:
            owner, rows = [], []
            for first, _, data, at in slabs(batch.column("text")):
                starts, ends, row, token = _rows_of_words(data, at)
                begin = np.searchsorted(row, np.arange(len(at)))
                for k in np.unique(row[index.hits(token)]).tolist():
                    part = slice(begin[k], begin[k + 1])
                    found = find_licenses(index, data[at[k] : at[k + 1]].tobytes(), starts[part] - at[k], ends[part] - at[k], token[part])
                    owner += [first + k] * len(found)
                    rows += found
            columns = list(zip(*rows, strict=True)) or [()] * 8
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.string()), pa.list_(pa.string()), pa.string())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(owner, pa.int64())), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))],
                ["doc_id", *(part.split()[0] for part in FOUND.split(", "))],
            )

    picked = documents.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    kind = picked.schema["doc_id"].dataType.simpleString()
    return picked.mapInArrow(scan, f"doc_id {kind}, {FOUND}")


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every licence wording in every document."""
    return scan_licenses(table(spark, sf_dir, "documents"))
