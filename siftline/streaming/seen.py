"""What earlier runs have found: a stored set of (pattern, content) that need not fit anywhere.

Keys lie in hash partitions.  Each batch adds a generation: the files of its new keys by partition, and for each a Bloom filter.  A batch asks the
filters of its own partitions first and reads only the files whose filter knows one of its hashes; those
are compared exactly.  After some generations all are merged into one.  Generations become valid by a line in the manifest, so
a batch that dies leaves nothing behind, and one that is repeated under its name does not meet its own keys.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from siftline.operators.prune import KEY, unique_findings
from siftline.session import stored
from siftline.sinks.versions import entries, new_version, publish

#: Hash partitions of the set, bits of a filter for a key, and bits that a key sets.
PARTITIONS = 64
BITS = 12
PROBES = 6
#: Generations after which all are merged.
GENERATIONS = 16

_KEYS = "pattern string, content string, hash bigint, part int"
_FILTERS = "part int, bits binary"


def _hash() -> Column:
    return F.xxhash64(*[F.coalesce(name, F.lit("")) for name in KEY], *[F.col(name).isNull() for name in KEY])


def bloom_places(hashes: np.ndarray, bits: int) -> np.ndarray:
    """The places of each hash in a filter of so many bits, one row a probe."""
    low, high = hashes.view(np.uint64) & np.uint64(0xFFFFFFFF), hashes.view(np.uint64) >> np.uint64(32) | np.uint64(1)
    return (low + np.arange(PROBES, dtype=np.uint64)[:, None] * high) % np.uint64(bits)


def bloom_filter(hashes: np.ndarray) -> bytes:
    """A filter of a power of two of bits that knows all the hashes."""
    bits = max(64, 1 << math.ceil(math.log2(BITS * max(1, len(hashes)))))
    found = np.zeros(bits, bool)
    found[bloom_places(hashes, bits).ravel()] = True
    return np.packbits(found).tobytes()


def may_know(bits: bytes, hashes: np.ndarray) -> np.ndarray:
    """Which hashes the filter may know; it knows all that were put in."""
    raw = np.frombuffer(bits, np.uint8)
    place = bloom_places(hashes, 8 * len(raw))
    return ((raw[place >> np.uint64(3)] >> (np.uint8(7) - (place & np.uint64(7)).astype(np.uint8))) & 1).all(0)


@dataclass(frozen=True)
class SeenKeys:
    """The set in a folder; ``partitions`` must stay the same as long as the folder does."""

    spark: SparkSession
    folder: str
    partitions: int = PARTITIONS
    generations: int = GENERATIONS

    def _live(self, without: str) -> list:
        """Entries of the generations that count: those since the last merge."""
        rows = sorted((row for row in entries(self.spark, self.folder).collect() if row["name"] != without), key=lambda row: row["note"])
        merges = [place for place, row in enumerate(rows) if row["note"].endswith("merged")]
        return rows[merges[-1]:] if merges else rows

    def new(self, findings: DataFrame, name: str) -> DataFrame:
        """The first finding of each key that no other batch has brought; the keys are added under the batch's ``name``.

        A null pattern or content is a value like any other.
        """
        live = self._live(name)
        firsts = unique_findings(findings).withColumns({"_hash": _hash()}).withColumn("_part", F.pmod("_hash", F.lit(self.partitions)).cast("int"))
        firsts = stored(firsts)
        paths = self.files_to_read(firsts, live)
        if paths:
            known = self.spark.read.schema(_KEYS.rsplit(",", 1)[0]).parquet(*paths)
            same = [firsts[column].eqNullSafe(known[column]) for column in KEY]
            firsts = stored(firsts.join(known, [firsts["_hash"] == known["hash"], *same], "left_anti"))
        self._add(firsts.select(*KEY, F.col("_hash").alias("hash"), F.col("_part").alias("part")), name, live)
        return firsts.drop("_hash", "_part")

    def files_to_read(self, firsts: DataFrame, live: list) -> list[str]:
        """Folders of the keys that the filters point to: at most the partitions of the generations that count."""
        if not live:
            return []
        places = [f"{self.folder}/{row['path']}" for row in live]
        filters = None
        for number, place in enumerate(places):
            part = self.spark.read.schema(_FILTERS).parquet(f"{place}/filters").withColumn("generation", F.lit(number))
            filters = part if filters is None else filters.unionByName(part)

        def ask(asked: pa.Table, known: pa.Table) -> pa.Table:
            hashes = asked.column("_hash").to_numpy()
            hit = [bool(len(hashes)) and bool(may_know(bits.as_py(), hashes).any()) for bits in known.column("bits")]
            return known.select(["generation", "part"]).filter(pa.array(hit, pa.bool_()))

        asked = firsts.select("_part", "_hash").groupBy("_part")
        hits = asked.cogroup(filters.groupBy("part")).applyInArrow(ask, "generation int, part int").collect()
        return [f"{places[row['generation']]}/keys/part={row['part']}" for row in hits]

    def _add(self, keys: DataFrame, name: str, live: list) -> None:
        merged = len(live) >= self.generations
        if merged:
            old = [self.spark.read.schema(_KEYS).parquet(f"{self.folder}/{row['path']}/keys").select(*keys.columns) for row in live]
            for part in old:
                keys = keys.unionByName(part)
        path = new_version(self.folder)
        keys.repartition(self.partitions, "part").write.partitionBy("part").parquet(f"{path}/keys")

        def build(found: pa.Table) -> pa.Table:
            return pa.table({"part": found.column("part").slice(0, 1), "bits": pa.array([bloom_filter(found.column("hash").to_numpy())], pa.binary())})

        written = self.spark.read.schema(_KEYS).parquet(f"{path}/keys")
        written.select("part", "hash").groupBy("part").applyInArrow(build, _FILTERS).write.parquet(f"{path}/filters")
        # Notes sort by the order in which generations came.
        order = max([int(row["note"].split()[0]) for row in live], default=0) + 1
        publish(self.spark, self.folder, name, path, f"{order:012d} {'merged' if merged else 'added'}")


def unique_over_runs(
    findings: DataFrame, seen: SeenKeys, run: str, checkpoint: str, sink: Callable[[DataFrame, int], None],
) -> StreamingQuery:
    """Each (pattern, content) of a stream once, over all runs that share ``seen``.

    Nothing is kept in the state of the query.  ``sink`` gets the new findings and the number of the batch and must accept a repeated
    batch; ``run`` names the checkpoint.
    """
    def batch(rows: DataFrame, number: int) -> None:
        sink(SeenKeys(rows.sparkSession, seen.folder, seen.partitions, seen.generations).new(rows, f"{run} {number}"), number)

    return findings.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
