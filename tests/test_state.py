import os
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftline.model import FINDING, InputConfig
from siftline.operators.patterns import pattern
from siftline.operators.scan import scan
from siftline.sinks import versions
from siftline.sinks.outputs import list_runs, load_run, save_run
from siftline.sources.appended import PROGRESS, appended_lines, lines_of_block, scan_appended
from siftline.sources.files import list_files
from siftline.streaming.seen import SeenKeys, bloom_filter, may_know, unique_over_runs
from siftline.streaming.streams import scan_stream, stream_lines

LINE = pattern("line", r"(?s)^.*")


# Growing files.

def lines_and_progress(spark, folder, progress=(), **options):
    rows, after = appended_lines(spark, list_files(spark, str(folder)), spark.createDataFrame(list(progress), PROGRESS), **options)
    found = sorted((r.file.rsplit("/", 1)[1], r.line, r.value) for r in rows.collect())
    return found, sorted(map(tuple, after.collect()))


def test_growing_files_are_read_on(spark, tmp_path):
    """Files that stop within a line, grow, are empty at first or are replaced, in blocks of a few bytes."""
    pick = random.Random(1)
    texts = {name: ["x" * pick.choice((0, 1, 3, 40)) + str(k) for k in range(30)] for name in ("a.txt", "b [1] %20.txt")}
    folder = tmp_path / "in"
    folder.mkdir()
    whole = {name: "\n".join(lines) + "\n" for name, lines in texts.items()}
    for block in (1, 7, 64, 1 << 20):
        progress, found = [], []
        for share in (0.0, 0.31, 0.32, 0.8, 1.0):
            for name, text in whole.items():
                (folder / name).write_text(text[: int(len(text) * share)])
            rows, progress = lines_and_progress(spark, folder, progress, block=block)
            found += rows
        assert sorted(found) == sorted((name, k + 1, line) for name, lines in texts.items() for k, line in enumerate(lines))
    (folder / "a.txt").write_text("new\r\nand short\nopen")
    rows, _ = lines_and_progress(spark, folder, progress)
    assert rows == [("a.txt", 1, "new"), ("a.txt", 2, "and short")]


def test_some_bytes_of_each_file_at_a_time(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    lines = [f"line {k} {'é' * (k % 9)}" for k in range(60)] + ["y" * 900, "", "end"]
    (folder / "f").write_text("\n".join(lines) + "\n")
    progress, found, runs = [], [], 0
    while True:
        rows, progress = lines_and_progress(spark, folder, progress, block=50, most=170)
        if not rows:
            break
        found, runs = found + rows, runs + 1
    assert [value for _, _, value in sorted(found, key=lambda row: row[1])] == lines and [n for _, n, _ in sorted(found, key=lambda r: r[1])] == list(range(1, 64))
    assert runs > 5


def test_lines_of_blocks(tmp_path):
    path = tmp_path / "f"
    path.write_bytes(b"ab\n\ncd\nopen")
    name = f"file:{path}"
    for size in range(1, 12):
        found = b"".join(lines_of_block(name, 0, low, min(low + size, 11), 11)[1] for low in range(0, 11, size))
        assert found == b"ab\n\ncd\n"


def test_scan_goes_on_after_a_failure(spark, tmp_path):
    folder, state = tmp_path / "in", str(tmp_path / "state")
    folder.mkdir()
    (folder / "log").write_text("one 1\ntwo 2\nthr")
    taken = {}

    def sink(found, number):
        taken[number] = [(r.line, r.content) for r in found.select("line", "content").orderBy("line").collect()]

    def broken(found, number):
        sink(found, number)
        raise RuntimeError("died")

    numbers = [pattern("n", r"[0-9]+")]
    with pytest.raises(RuntimeError):
        scan_appended(spark, str(folder), numbers, state, broken)
    assert scan_appended(spark, str(folder), numbers, state, sink)
    with open(folder / "log", "a") as log:
        log.write("ee 3\nfour 4\n")
    assert scan_appended(spark, str(folder), numbers, state, sink)
    assert not scan_appended(spark, str(folder), numbers, state, sink)
    assert taken == {1: [(1, "1"), (2, "2")], 2: [(3, "3"), (4, "4")]}
    with pytest.raises(ValueError):
        scan_appended(spark, str(folder), numbers, state, sink, InputConfig(format="csv"))


# Saved runs.

def test_a_save_that_dies_is_not_seen(spark, records, tmp_path, monkeypatch):
    folder = str(tmp_path / "runs")
    assert load_run(spark, folder, "one").schema == FINDING and list_runs(spark, folder).count() == 0
    save_run(scan(records("old"), [LINE]), folder, "one")
    broken = scan(records("new", "rows"), [LINE]).withColumn("content", F.when(F.col("line") == 2, F.raise_error(F.lit("died"))).otherwise(F.col("content")))
    with pytest.raises(Exception, match="died"):
        save_run(broken, folder, "one")

    def publish(*_):
        raise RuntimeError("died before the manifest")

    with monkeypatch.context() as patch:
        patch.setattr(versions, "publish", publish)
        with pytest.raises(RuntimeError):
            save_run(scan(records("new"), [LINE]), folder, "one")
    assert [r.content for r in load_run(spark, folder, "one").collect()] == ["old"]
    save_run(scan(records("newest"), [LINE]), folder, "one")
    save_run(scan(records("new").filter("false"), [LINE]), folder, "two")
    assert [r.content for r in load_run(spark, folder, "one").collect()] == ["newest"] and load_run(spark, folder, "two").count() == 0
    assert sorted(r.run_id for r in list_runs(spark, folder).collect()) == ["one", "two"]


# Seen keys.

def test_filters_know_what_was_put_in():
    pick = np.random.default_rng(1)
    for count in (0, 1, 5, 1000):
        inside, outside = pick.integers(-(2**63), 2**63, count), pick.integers(-(2**63), 2**63, 5000)
        bits = bloom_filter(inside)
        assert may_know(bits, inside).all() and may_know(bits, outside).mean() < 0.05


def findings(spark, keys):
    rows = [(number, pattern_, content) for number, (pattern_, content) in enumerate(keys)]
    return spark.createDataFrame(rows, "line bigint, pattern string, content string")


def test_seen_keys_over_generations(spark, tmp_path):
    """Nulls, repeats, a repeated batch and merged generations; each key comes once."""
    seen = SeenKeys(spark, str(tmp_path / "seen"), 8, 3)
    pick = random.Random(2)
    known, batches = set(), []
    for number in range(7):
        keys = [(pick.choice(("a", "b", None)), pick.choice((None, "", *map(str, range(40))))) for _ in range(30)]
        batches.append(keys)
        got = [(r.pattern, r.content) for r in seen.new(findings(spark, keys), f"run {number}").collect()]
        assert sorted(got, key=str) == sorted(set(keys) - known, key=str)
        if number == 4:
            again = [(r.pattern, r.content) for r in seen.new(findings(spark, keys), f"run {number}").collect()]
            assert sorted(again, key=str) == sorted(got, key=str)
        known |= set(keys)
    assert len(seen._live("")) < 7


def test_few_new_keys_read_few_files(spark, tmp_path):
    seen = SeenKeys(spark, str(tmp_path / "seen"), 32)
    for number in range(3):
        seen.new(findings(spark, [("p", f"{number} {k}") for k in range(2000)]), f"run {number}").count()
    asked = findings(spark, [("p", "1 5"), ("p", "new one")]).withColumn("_hash", F.xxhash64("pattern", "content", F.lit(False), F.lit(False)))
    asked = asked.withColumn("_part", F.pmod("_hash", F.lit(32)).cast("int"))
    paths = seen.files_to_read(asked, seen._live(""))
    every = [name for name, _, files in os.walk(tmp_path / "seen") if "/keys/part=" in name and files]
    assert len(every) == 96 and 1 <= len(paths) <= 4
    assert [(r.pattern, r.content) for r in seen.new(findings(spark, [("p", "1 5"), ("p", "new one")]), "run 3").collect()] == [("p", "new one")]


def test_unique_over_three_runs_of_a_stream(spark, tmp_path):
    folder, seen, taken = tmp_path / "in", SeenKeys(spark, str(tmp_path / "seen"), 4), []
    folder.mkdir()
    for run in range(3):
        (folder / f"{run}.txt").write_text("".join(f"{k % 7 + 3 * run}\n" for k in range(20)))
        time.sleep(0.01)
        found = scan_stream(stream_lines(spark, str(folder)), [LINE])
        unique_over_runs(found, seen, "log", str(tmp_path / "checkpoint"), lambda rows, number: taken.extend(r.content for r in rows.collect())).awaitTermination()
    assert sorted(taken, key=int) == [str(k) for k in range(13)]
