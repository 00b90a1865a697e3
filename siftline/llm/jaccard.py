"""Exact Jaccard join of documents on word shingles, by a token-group matrix.

Two sets that are similar enough share one of their rarest tokens: of a set with n tokens the
``n - ceil(share * n) + 1`` rarest form its *prefix*, and of a prefix that is longer by k they share k more; up
to three in common are asked for.
Only sets with enough tokens of a long prefix that other sets have too are looked at; which tokens those are
is told by a filter of fixed size, and a false hit costs but a row.

Similar sets are put into groups of bounded size by the smallest (and once more by the largest) hash of
their shared prefix tokens.  Each group is joined within, together with a hub that all groups of that hash
have in common; sets without a near signature there are left out.  The links so far make classes.  The matrix
then has a row for each prefix token and group; a set is a query against a group if they share prefix tokens
there and the group has members of another class.  Signatures, which bound the difference of two sets from below, rule out most of them.  In the task of
a group, the union of its tokens bounds the overlap with each query; only groups whose bound reaches the needed
share are opened and compared set by set.  Nothing similar is missed, and a
large family of copies costs no pairs, for its members are in one class by then.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.llm.common import Rolling, lowered, mixed, numbered, saved, slabs, table, tuned, word_spans
from siftline.llm.components import components
from siftline.session import Passing, passing_tables, stored

#: Words of a shingle, and the share of common shingles in hundredths.
WORDS = 3
PERCENT = 90
#: Buckets in which tokens are counted, so that rare ones come first.
BUCKETS = 1 << 15
#: Bits of a token, bits of the level of a bucket, and rows of a slab, whose numbers stand above the token.
TOKEN_BITS = 52
LEVEL_BITS = 8
MOST_ROWS = 1 << (64 - TOKEN_BITS)
#: Bits of the filter of shared tokens, and bits set by a token.
FILTER_BITS = 1 << 26
FILTER_HASHES = 3
#: One in so many tokens is asked for in common before a set is looked at, and so many at most before two sets are.
SURPLUS = 20
PAIR_SURPLUS = 3
#: Bytes of a signature.
SIGNATURE = 256
#: Sets of a group at most on average, tokens of a group, and queries that are held against a copy of it.
GROUP_SETS = 128
GROUP_TOKENS = 400_000
GROUP_QUERIES = 1024
#: Members of groups whose signatures are held against each other by one call.
SCREEN_ROWS = 4096

_U = np.uint64
KEY = ["fa", "fb", "n"]


def shingles(data: np.ndarray, at: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of TOKEN_BITS bits and row of every shingle of a slab, repeated ones too."""
    low = lowered(data)
    starts, ends, rows = word_spans(low, at)
    word = mixed(Rolling(low).spans(starts, ends))
    count = np.bincount(rows, minlength=len(at) - 1)
    begin = np.cumsum(count) - count
    left = np.repeat(begin + count, count) - np.arange(len(rows))
    # Shingles start at words with enough words after them; a shorter text is one shingle.
    short = begin[(count > 0) & (count < words)]
    whole = np.flatnonzero(left >= words)
    token = np.zeros(len(whole) + len(short), _U)
    picked = np.concatenate([whole, short])
    for k in range(words):
        at_k = picked + k
        value = mixed(token * _U(0x2545F4914F6CDD1D) + word[np.minimum(at_k, len(word) - 1)] + _U(k + 1)) if len(word) else token
        token = value if not len(short) else np.where(left[picked] > k, value, token)
    return token >> _U(64 - TOKEN_BITS), rows[picked]


def shingle_sets(texts: pa.Array, words: int = WORDS) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, tokens, bounds of the rows in them): the sorted distinct shingle hashes of each text."""
    for first, end, data, at in _row_slabs(texts):
        token, row = shingles(data, at, words)
        key = token | row.astype(_U) << _U(TOKEN_BITS)
        key.sort()
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        key = key[new]
        bounds = np.searchsorted(key, np.arange(end - first + 1, dtype=_U) << _U(TOKEN_BITS))
        yield first, key & _U((1 << TOKEN_BITS) - 1), bounds


def _row_slabs(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Slabs of so few rows that their numbers fit above a token."""
    for low in range(0, len(texts), MOST_ROWS):
        for first, end, data, at in slabs(texts.slice(low, MOST_ROWS)):
            yield low + first, low + end, data, at


def missing(n: np.ndarray, percent: int) -> np.ndarray:
    """Tokens of a set of n that a similar set can lack."""
    return n - -(-percent * n // 100)


def surplus(n: np.ndarray) -> np.ndarray:
    """Common tokens that are asked for in a long prefix, which has as many more tokens than can be lacking."""
    return np.maximum(1, n // SURPLUS)


def pair_surplus(n: np.ndarray) -> np.ndarray:
    """Common tokens of two similar sets that are asked for in prefixes with as many more tokens than can be lacking."""
    return np.minimum(surplus(n), PAIR_SURPLUS)


def prefixes(token: np.ndarray, at: np.ndarray, counts: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the ``size`` first tokens of every set, and their sets; low levels first, then by hash."""
    n = np.diff(at)
    row = np.repeat(np.arange(len(n)), n)
    level = counts[(token & _U(len(counts) - 1)).astype(np.int64)].astype(_U)
    shift = _U(TOKEN_BITS - LEVEL_BITS)
    key = row.astype(_U) << _U(TOKEN_BITS) | level << shift | token >> _U(LEVEL_BITS)
    order = np.argsort(key)
    ordered = key[order]
    if (ordered[1:] == ordered[:-1]).any():
        order = np.lexsort((token, level, row))
    rank = np.arange(len(token)) - at[:-1][row]
    chosen = rank < size[row]
    return order[chosen], row[chosen]


def long_prefixes(token: np.ndarray, at: np.ndarray, counts: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The prefixes of which two similar sets have the smaller one's surplus in common."""
    n = np.diff(at)
    return prefixes(token, at, counts, missing(n, percent) + surplus(n))


def _filter_places(token: np.ndarray) -> list[np.ndarray]:
    return [(mixed(token + _U(k + 1)) % _U(FILTER_BITS)).astype(np.int64) for k in range(FILTER_HASHES)]


def _in_filter(words: np.ndarray, token: np.ndarray) -> np.ndarray:
    hit = np.ones(len(token), bool)
    for place in _filter_places(token):
        hit &= (words[place >> 6] >> (place & 63).astype(_U)) & _U(1) == 1
    return hit


def _batch(schema: str, *columns) -> pa.RecordBatch:
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "double": pa.float64()}
    names = [c.split() for c in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, names, strict=True)], [x for x, _ in names])


def bucket_levels(frame: DataFrame, words: int) -> np.ndarray:
    """For each bucket of tokens a level of how many shingles of ``frame`` (text) it has, in equal ratios."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for _, _, data, at in _row_slabs(batch.column("text")):
                token, _ = shingles(data, at, words)
                total += np.bincount((token & _U(BUCKETS - 1)).astype(np.int64), minlength=BUCKETS)
        seen = np.flatnonzero(total)
        yield _batch("bucket int, tokens bigint", seen.astype(np.int32), total[seen])

    found = frame.select("text").mapInArrow(count, "bucket int, tokens bigint").groupBy("bucket").agg(F.sum("tokens").alias("tokens"))
    out = np.zeros(BUCKETS, np.int64)
    rows = found.toArrow()
    out[rows.column("bucket").to_numpy()] = rows.column("tokens").to_numpy()
    return np.minimum(np.rint(4 * np.log2(out + 1.0)), (1 << LEVEL_BITS) - 1).astype(np.uint8)


def _digests(token: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two sums over the mixed tokens of each set."""
    out = []
    for salt in (0x9E6C63D0876A9A47, 0xD1B54A32D192ED03):
        total = np.zeros(len(token) + 1, _U)
        np.cumsum(mixed(token ^ _U(salt)), out=total[1:])
        out.append((total[at[1:]] - total[at[:-1]]).view(np.int64))
    return out[0], out[1]


def shared_filter(frame: DataFrame, counts: Broadcast, words: int, percent: int) -> np.ndarray:
    """The filter of the prefix tokens that two different sets of ``frame`` (text) have."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, token, at in shingle_sets(batch.column("text"), words):
                place, row = long_prefixes(token, at, counts.value, percent)
                digest, _ = _digests(token, at)
                yield _batch("token bigint, fa bigint", token[place].view(np.int64), digest[row])

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words_ = np.zeros(FILTER_BITS >> 6, _U)
        for batch in batches:
            for place in _filter_places(batch.column("token").to_numpy().view(_U)):
                np.bitwise_or.at(words_, place >> 6, _U(1) << (place & 63).astype(_U))
        seen = np.flatnonzero(words_)
        yield _batch("word int, bits bigint", seen.astype(np.int32), words_[seen].view(np.int64))

    shared = frame.select("text").mapInArrow(find, "token bigint, fa bigint").groupBy("token").agg(
        F.min("fa").alias("low"), F.max("fa").alias("high"),
    ).filter("low <> high").select("token")
    # Stored, as the shuffle of all prefix tokens then goes at once.
    rows = saved(shared.mapInArrow(places, "word int, bits bigint").groupBy("word").agg(F.bit_or("bits").alias("bits"))).toArrow()
    out = np.zeros(FILTER_BITS >> 6, _U)
    out[rows.column("word").to_numpy()] = rows.column("bits").to_numpy().view(_U)
    return out


def signature(token: np.ndarray) -> bytes:
    """A bit for each bucket of tokens, set where it has an odd number of them.

    The signatures of two sets differ in no more bits than there are tokens that one of them lacks.
    """
    odd = np.bincount((mixed(token) % _U(8 * SIGNATURE)).astype(np.int64), minlength=8 * SIGNATURE) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def may_be_similar(query: np.ndarray, members: np.ndarray, n: int, size: np.ndarray, percent: int) -> np.ndarray:
    """Which of the signatures are near enough to that of a set of n tokens."""
    apart = np.bitwise_count(members ^ query).sum(1)
    both = n + size
    return apart <= both - 2 * -(-percent * both // (100 + percent))


def similar(common: np.ndarray, n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """Whether ``common`` of n and m tokens is the share or more."""
    return (100 * common >= percent * (n + m - common)) & (common > 0)


class Group:
    """Some sets, with the union of their tokens and, for each token, the sets that have it."""

    def __init__(self, sets: list[np.ndarray]) -> None:
        self.size = np.array([len(s) for s in sets], np.int64)
        every = np.concatenate(sets) if sets else np.zeros(0, _U)
        owner = np.repeat(np.arange(len(sets)), self.size)
        order = np.argsort(every, kind="stable")
        self.owner = owner[order]
        self.union, self.at = np.unique(every[order], return_index=True)
        self.at = np.append(self.at, len(every))

    def known(self, query: np.ndarray) -> np.ndarray:
        """Which entries of the union the query has: their number bounds the overlap with every member."""
        place = np.searchsorted(self.union, query)
        inside = place < len(self.union)
        place = place[inside]
        return place[self.union[place] == query[inside]]

    def overlaps(self, known: np.ndarray) -> np.ndarray:
        """Common tokens with every member, of a query that has these entries of the union."""
        many = self.at[known + 1] - self.at[known]
        start = np.repeat(self.at[known] - (np.cumsum(many) - many), many)
        return np.bincount(self.owner[start + np.arange(len(start))], minlength=len(self.size))


def _unpacked(column: pa.Array) -> pa.Array:
    unpack = zstandard.ZstdDecompressor().decompress
    return pa.array([unpack(x.as_buffer()) for x in column], pa.large_binary())


def _sets(column: pa.ChunkedArray, words: int) -> list[np.ndarray]:
    """The tokens of packed texts."""
    return [
        token[low:high] for _, token, at in shingle_sets(_unpacked(column), words) for low, high in zip(at[:-1], at[1:], strict=True)
    ]


def _joined_within(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """For each set the smallest one that links lead to; a set that was reached is not compared again."""
    group = Group(sets)
    root = np.full(len(sets), -1)
    for first in range(len(sets)):
        if root[first] >= 0:
            continue
        root[first] = first
        todo = [first]
        while todo:
            at = todo.pop()
            linked = similar(group.overlaps(group.known(sets[at])), group.size[at], group.size, percent)
            new = np.flatnonzero(linked & (root < 0))
            root[new] = first
            todo += new.tolist()
    return root


def _spread(nodes: DataFrame, gid: str) -> DataFrame:
    """(gid, part, node): the members of a hash in parts of bounded size, each with the hub."""
    sizes = nodes.groupBy(gid).agg(
        F.count("*").alias("sets"), F.sum("n").alias("tokens"), F.min("node").alias("hub"),
    ).filter("sets > 1").withColumn("parts", F.greatest(
        F.ceil(F.col("sets") / GROUP_SETS), F.ceil(F.col("tokens") / GROUP_TOKENS),
    ).cast("int"))
    own = nodes.select("node", gid).join(sizes, gid).select(
        F.col(gid).alias("gid"), F.pmod(F.xxhash64("node"), F.col("parts")).cast("int").alias("part"), "node", "hub", "parts",
    )
    hubs = sizes.filter("parts > 1").select(
        F.col(gid).alias("gid"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("hub").alias("node"),
    )
    return own.filter("parts = 1 OR node <> hub").select("gid", "part", "node").union(hubs)


def near_each_other(group: np.ndarray, bits: np.ndarray, n: np.ndarray, percent: int) -> np.ndarray:
    """Which sets have a signature near enough to that of another set of their group; ``group`` is sorted."""
    end = np.searchsorted(group, group, "right")
    near = np.zeros(len(group), bool)
    apart = 1
    while len(left := np.flatnonzero(np.arange(apart, len(group) + apart) < end)):
        left = left[~(near[left] & near[left + apart])]
        right = left + apart
        hit = may_be_similar(bits[left], bits[right], n[left], n[right], percent)
        near[left[hit]] = near[right[hit]] = True
        apart += 1
    return near


def _near_within(parts: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The members of groups (``parts``) that have a member near enough, by signature, in their part."""

    def screen(found: pa.Table) -> pa.Table:
        first, gid, part, n = (found.column(c).to_numpy() for c in ("first", "gid", "part", "n"))
        order = np.lexsort((part, gid, first))
        first, gid, part = first[order], gid[order], part[order]
        new = (first[1:] != first[:-1]) | (gid[1:] != gid[:-1]) | (part[1:] != part[:-1])
        bits = np.frombuffer(b"".join(found.column("bits").to_pylist()), _U).reshape(-1, SIGNATURE // 8)[order]
        near = near_each_other(np.cumsum(np.append(False, new)), bits, n[order], percent)
        return found.select(["gid", "part", "node", "first"]).take(pa.array(order[near]))

    calls = max(1, -(-parts.count() // SCREEN_ROWS))
    shown = parts.join(nodes.select("node", "n", "bits"), "node").withColumn("call", F.pmod(F.xxhash64("gid", "part", "first"), F.lit(calls)))
    return shown.groupBy("call").applyInArrow(screen, "gid bigint, part int, node bigint, first boolean")


def links_within(nodes: DataFrame, sets: DataFrame, words: int, percent: int) -> DataFrame:
    """Links (a, b) of sets to the smallest one of their group that links lead to.

    ``nodes`` has node, n, bits, gid, gid2, ``sets`` node, packed; ``first`` tells links of groups by gid.  Texts
    are moved only of sets with a signature near enough to another one of their group.
    """

    def join(found: pa.Table) -> pa.Table:
        node = found.column("node").to_numpy()
        order = np.argsort(node)
        root = _joined_within(_sets(found.column("packed").take(pa.array(order)), words), percent)
        at = np.flatnonzero(root != np.arange(len(root)))
        first = found.column("first")[0]
        return pa.table({"a": pa.array(node[order][at]), "b": pa.array(node[order][root[at]]), "first": pa.repeat(first, len(at))})

    parts = saved(_spread(nodes, "gid").withColumn("first", F.lit(True))).union(
        saved(_spread(nodes.filter("gid2 <> gid"), "gid2").withColumn("first", F.lit(False))),
    )
    near = saved(_near_within(parts, nodes, percent))
    return near.join(sets, "node").groupBy("gid", "part", "first").applyInArrow(join, "a bigint, b bigint, first boolean")


def _copies(asked: DataFrame) -> DataFrame:
    """How many copies of a group its queries are held against."""
    return asked.groupBy("open").agg(F.ceil(F.count("*") / GROUP_QUERIES).cast("int").alias("copies"))


def _sides(queries: DataFrame, members: DataFrame) -> list:
    """Both sides by copy of a group, with new names for columns that they have from the same tables."""
    frames = (f.withColumns({"gid": F.col("open.gid"), "part": F.col("open.part")}).drop("open") for f in (queries, members))
    return [frame.toDF(*frame.columns).groupBy("gid", "part", "copy") for frame in frames]


def _near_groups(asked: DataFrame, own: DataFrame, percent: int) -> DataFrame:
    """The queries and groups (``asked``) with a member of a larger class whose signature is near enough."""

    def near(asking: pa.Table, members: pa.Table) -> pa.Table:
        bits = np.frombuffer(b"".join(members.column("bits").to_pylist()), _U).reshape(-1, SIGNATURE // 8)
        size, root, n = (members.column(c).to_numpy() for c in ("size", "root", "n"))
        kept = []
        for query, own_size, own_root, own_n in zip(*(asking.column(c).to_pylist() for c in ("bits", "size", "root", "n")), strict=True):
            larger = (size > own_size) | ((size == own_size) & (root > own_root))
            kept.append(bool((may_be_similar(np.frombuffer(query, _U), bits, own_n, n, percent) & larger).any()))
        return asking.select(["node", "gid", "part"]).filter(pa.array(kept, pa.bool_()))

    copies = _copies(asked)
    shown = ("node", "class.size", "class.root", "n", "bits")
    queries = asked.select("open", "node").join(copies, "open").join(own, "node").select(
        "open", F.pmod(F.xxhash64("node"), F.col("copies")).cast("int").alias("copy"), *shown,
    )
    members = own.join(copies, own["group"] == copies["open"]).select(
        "open", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"), *shown,
    )
    sides = _sides(queries, members)
    kept = sides[0].cogroup(sides[1]).applyInArrow(near, "node bigint, gid bigint, part int")
    return kept.select(F.struct("gid", "part").alias("open"), "node").join(own.select("node", "class"), "node")


def links_across(nodes: DataFrame, sets: DataFrame, tokens: DataFrame, classes: DataFrame, words: int, percent: int) -> DataFrame:
    """Links (a, b) between sets of different classes that share prefix tokens.

    A set is held against a group only if it has as many of the group's prefix tokens as its smallest possible
    partner has in common with it.  Of two classes the smaller one asks, so a large class is never held against its few neighbours.
    """
    # Every step whose result is used twice is stored, which keeps the plans small.
    own = saved(nodes.select("node", "gid", "n", "bits").join(classes, "node", "left").withColumn("root", F.coalesce("root", "node")))
    own = own.join(own.groupBy("root").agg(F.count("*").alias("size")), "root")
    many = nodes.groupBy("gid").agg(F.greatest(
        F.ceil(F.count("*") / GROUP_SETS), F.ceil(F.sum("n") / GROUP_TOKENS),
    ).cast("int").alias("parts"))
    own = saved(own.join(many, "gid").select(
        "node", "bits", F.struct("size", "root").alias("class"), F.struct(
            "gid", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int").alias("part"),
        ).alias("group"), "n",
    ))
    # The token-group matrix, of the tokens that more than one class has.
    marked = saved(tokens.join(own.select("node", "class", "group", "n"), "node"))
    cells = saved(marked.groupBy("token", "group").agg(
        F.min("class").alias("low"), F.max("class").alias("high"), F.min("n").alias("least"), F.max("n").alias("most"),
    ))
    mixed_ = cells.groupBy("token").agg(F.min("low").alias("a"), F.max("high").alias("b")).filter("a <> b").select("token")
    cells = saved(cells.join(mixed_, "token").select("token", F.col("group").alias("open"), "high", "least", "most"))
    asked = marked.join(cells, "token").filter(
        (F.col("class") < F.col("high")) & (percent * F.col("least") <= 100 * F.col("n"))
        & (100 * F.col("most") >= percent * F.col("n"))
    ).groupBy("open", "node", "class", "n").agg(F.count("*").alias("common")).filter(
        f"common >= least({PAIR_SURPLUS}, greatest(1, (({percent} * n + 99) div 100) div {SURPLUS}))"
    ).select("open", "node", "class")
    asked = saved(_near_groups(saved(asked), own, percent))
    copies = _copies(asked)
    queries = asked.join(copies, "open").join(sets, "node").select(
        "open", F.pmod(F.xxhash64("node"), F.col("copies")).cast("int").alias("copy"), "node", "class.size", "class.root", "packed",
    )
    members = own.join(copies, own["group"] == copies["open"]).join(sets, "node").select(
        "open", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"), "node", "class.size", "class.root", "packed",
    )

    def compare(asking: pa.Table, members: pa.Table) -> pa.Table:
        out: list[tuple[int, int]] = []
        group = Group(_sets(members.column("packed"), words))
        node, root = members.column("node").to_numpy(), members.column("root").to_numpy()
        size = members.column("size").to_numpy()
        columns = (asking.column(c).to_numpy() for c in ("node", "root", "size"))
        for query, own_root, own_size, tokens_ in zip(*columns, _sets(asking.column("packed"), words), strict=True):
            known = group.known(tokens_)
            if 100 * len(known) < percent * len(tokens_):
                continue
            larger = (size > own_size) | ((size == own_size) & (root > own_root))
            linked = np.flatnonzero(similar(group.overlaps(known), len(tokens_), group.size, percent) & larger)
            # One link to each class is enough.
            out += [(int(query), int(node[linked[k]])) for k in np.unique(root[linked], return_index=True)[1]]
        return pa.table({"a": pa.array([a for a, _ in out], pa.int64()), "b": pa.array([b for _, b in out], pa.int64())})

    sides = _sides(queries, members)
    return sides[0].cogroup(sides[1]).applyInArrow(compare, "a bigint, b bigint")


def linked_documents(
    documents: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT,
) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of ``documents``.

    Words are runs without 20 and 09-0D, A-Z in lower case; a text of fewer words than a shingle is one
    shingle.  Documents link at ``percent`` hundredths of common shingles; ``component_id`` is the smallest id
    reachable by links.  Shingles and sets are told apart by hashes of 52 and 128 bits.

    A null or empty text has no shingle, links with nothing and is a component of its own, as is each of
    several such rows.  Repeated rows are linked like other equal texts.  A null id counts only where a
    component has no other; then the component is null.

    The result is a stored table; what was stored on the way to it is removed.
    """
    tuned(documents.sparkSession)
    frame = documents.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    with passing_tables() as tables:
        return tables.keep(saved(_linked(frame, tables, words, percent)))


def _linked(frame: DataFrame, tables: Passing, words: int, percent: int) -> DataFrame:
    """The result of ``linked_documents`` for ``frame`` (doc_id, text), read from ``tables``."""
    context = frame.sparkSession.sparkContext
    kind = frame.schema["doc_id"].dataType.simpleString()
    counts = context.broadcast(bucket_levels(frame, words))
    shared = context.broadcast(shared_filter(frame, counts, words, percent))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            for first, token, at in shingle_sets(batch.column("text"), words):
                place, row = long_prefixes(token, at, counts.value, percent)
                n = np.diff(at)
                hits = np.bincount(row[_in_filter(shared.value, token[place])], minlength=len(n))
                # A partner has percent hundredths of the tokens at least.
                wanted = (n > 0) & (hits >= surplus(-(-percent * n // 100)))
                fa, fb = _digests(token, at)
                part = batch.slice(first, len(n))
                texts = [pack(x.as_buffer()) if w else None for x, w in zip(part.column("text"), wanted, strict=True)]
                bits = [signature(token[at[k] : at[k + 1]]) if w else None for k, w in enumerate(wanted)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(fa), pa.array(fb), pa.array(n), pa.array(texts, pa.binary()), pa.array(bits, pa.binary())],
                    ["doc_id", *KEY, "packed", "bits"],
                )

    rows = stored(frame.select("doc_id", "text").mapInArrow(
        describe, f"doc_id {kind}, fa bigint, fb bigint, n bigint, packed binary, bits binary",
    ))

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node = batch.column("node").to_numpy()
            for first, token, at in shingle_sets(_unpacked(batch.column("packed")), words):
                n = np.diff(at)
                place, row = prefixes(token, at, counts.value, missing(n, percent) + pair_surplus(n))
                hit = _in_filter(shared.value, token[place])
                yield _batch("node bigint, token bigint", node[first + row[hit]], token[place[hit]].view(np.int64))

    sets = saved(rows.filter("packed IS NOT NULL").groupBy(*KEY).agg(
        F.first("packed").alias("packed"), F.first("bits").alias("bits"),
    ).withColumn(
        "node", F.monotonically_increasing_id(),
    ))
    # The texts are in the sets now.
    packed, rows = rows, saved(rows.select("doc_id", *KEY))
    tables.drop(packed)
    found = sets.select("node", "packed").mapInArrow(keys, "node bigint, token bigint")
    twice = found.groupBy("token").agg(F.min("node").alias("low"), F.max("node").alias("high")).filter("low <> high")
    tokens = saved(found.join(twice.select("token"), "token").select("node", "token"))
    gids = tokens.groupBy("node").agg(
        F.min(F.xxhash64("token")).alias("gid"), F.max(F.xxhash64("token")).alias("gid2"),
    )
    nodes = saved(sets.select("node", "n", "bits").join(gids, "node"))
    payload = sets.select("node", "packed")
    links = saved(links_within(nodes, payload, words, percent))
    # The hub is the smallest member, so what links to it has one class in all parts of a group.
    classes = links.filter("first").groupBy("a").agg(F.min("b").alias("root")).withColumnRenamed("a", "node")
    more = links_across(nodes, payload, tokens, classes, words, percent)
    roots = components(saved(links.select("a", "b").union(more)))
    # The smallest id of each set, then of each component; sets without links are their own.
    lowest = rows.filter("n > 0").groupBy(*KEY).agg(F.min("doc_id").alias("lowest"))
    member = sets.select("node", *KEY).join(saved(roots), "node").select(*KEY, "root")
    joined = saved(lowest.join(member, KEY, "left"))
    by_root = joined.filter("root IS NOT NULL").groupBy("root").agg(F.min("lowest").alias("component"))
    by_set = joined.join(by_root, "root", "left").select(*KEY, F.coalesce("component", "lowest").alias("component"))
    return rows.join(by_set, KEY, "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id")).alias("component_id"),
    )


def one_of_each_group(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The document with the smallest id of each group of linked ones, all columns as they were.

    Of rows with equal ids the first stays, and one with an id before one without.  Documents without words link
    with nothing and all stay.  ``documents`` must come straight from stored files or the driver.
    """
    uid = F.monotonically_increasing_id().alias("uid")
    linked = linked_documents(numbered(documents, text=text), "uid", "text", **options)
    ids = numbered(documents, id=doc_id).select("uid", F.struct(F.col("id").isNull().alias("without"), "id", "uid").alias("place"))
    first = linked.select(F.col("doc_id").alias("uid"), "component_id").join(ids, "uid").groupBy("component_id").agg(F.min("place").alias("place"))
    kept = first.select(F.col("place.uid").alias("uid"))
    return documents.select(uid, F.struct("*").alias("row")).join(kept, "uid", "left_semi").select("row.*")


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the size of its set and its component."""
    return linked_documents(table(spark, sf_dir, "documents"))
