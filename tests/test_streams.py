import pytest
from pyspark.sql import functions as F

from siftline.model import CsvConfig, InputConfig
from siftline.operators.patterns import pattern
from siftline.operators.prune import unique_findings
from siftline.operators.scan import scan
from siftline.sources.files import read_records
from siftline.sources.lines import read_text_records
from siftline.streaming.streams import run_available, scan_numbered, scan_stream, stream_lines, stream_progress, unique_stream

IP = pattern("ip", r"\d+\.\d+\.\d+\.\d+")
SHOWN = ["file", "pattern", "ordinal", "content"]


def put(folder, name, text):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text(text)


def drain(rows, target, checkpoint):
    query = run_available(rows, str(target), str(checkpoint))
    query.awaitTermination()
    return query


def test_stream_equals_batch_and_goes_on_after_a_stop(spark, tmp_path):
    source, target, checkpoint = tmp_path / "in", tmp_path / "out", tmp_path / "check"
    for number in range(4):
        put(source, f"{number}.txt", f"a {number}.1.1.1\r\nb 9.9.9.9 {number}.2.2.2\n")

    def scan_all():
        drain(scan_stream(stream_lines(spark, str(source), max_files=2), [IP]).select(*SHOWN), target, checkpoint)
        return sorted(map(tuple, spark.read.parquet(str(target)).select(*SHOWN).collect()))

    def batch():
        return sorted(map(tuple, scan(read_text_records(spark, str(source)), [IP]).select(*SHOWN).collect()))

    assert scan_all() == batch() and len(batch()) == 12
    put(source, "late.txt", "7.7.7.7")
    assert scan_all() == batch() and len(batch()) == 13
    assert scan_all() == batch()


def test_unique_over_restarts(spark, tmp_path):
    source, target, checkpoint = tmp_path / "in", tmp_path / "out", tmp_path / "check"
    put(source, "a.txt", "1.1.1.1\n1.1.1.1 2.2.2.2\n")
    for more, want in (("", ["1.1.1.1", "2.2.2.2"]), ("2.2.2.2 3.3.3.3", ["1.1.1.1", "2.2.2.2", "3.3.3.3"])):
        put(source, "b.txt" if more else "a2.txt", more)
        found = scan_stream(stream_lines(spark, str(source)), [IP])
        drain(unique_findings(found).select("content"), target, checkpoint)
        assert sorted(row[0] for row in spark.read.parquet(str(target)).collect()) == want


def test_unique_within_a_delay(spark, tmp_path):
    source = tmp_path / "in"
    put(source, "a.txt", "1.1.1.1\n1.1.1.1\n")
    found = scan_stream(stream_lines(spark, str(source)), [IP]).withColumn("at", F.lit("2024-01-01").cast("timestamp"))
    drain(unique_stream(found, "at", "1 hour").select("content"), tmp_path / "out", tmp_path / "check")
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1


def test_jsonl_stream(spark, tmp_path):
    put(tmp_path / "in", "a.jsonl", '{"id": "x", "data": "1.1.1.1"}\nbad 2.2.2.2\n{"id": "y", "data": "a\\\\n3.3.3.3"}\n')
    config = InputConfig(format="jsonl", targets=("data",), id="id", decode=True)
    found = scan_stream(stream_lines(spark, str(tmp_path / "in")), [pattern("p", r"(?m)^\d\S+")], config)
    query = drain(found.select("record_id", "content"), tmp_path / "out", tmp_path / "check")
    assert stream_progress(query)[1] == 3
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect())) == [("x", "1.1.1.1"), ("y", "3.3.3.3")]


def test_line_numbers_by_batch(spark, tmp_path):
    for number in range(3):
        put(tmp_path / "in", f"{number}.txt", "x\n" * number + "5.5.5.5\n")

    def sink(found, number):
        found.select("file", "line", "content").write.mode("overwrite").parquet(str(tmp_path / "out" / f"batch={number}"))

    scan_numbered(spark, str(tmp_path / "in"), [IP], str(tmp_path / "check"), sink, max_files=2).awaitTermination()
    got = sorted((row["file"][-5:], row["line"]) for row in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [("0.txt", 1), ("1.txt", 2), ("2.txt", 3)]


@pytest.mark.parametrize("config", [
    InputConfig(), InputConfig(format="jsonl", targets=("a",)), InputConfig(format="csv", csv=CsvConfig(target_indices=(1,))),
    InputConfig(expand_json=True),
])
def test_every_format_on_a_stream_equals_batch(spark, tmp_path, config):
    source = tmp_path / "in"
    source.mkdir()
    (source / "one").write_text('{"a": "1.1.1.1", "b": ["2.2.2.2"]}\nx,"3.3.3.3\n4.4.4.4"\n')
    (source / "[2]").write_text('{\n "b": "5.5.5.5"\n}\n')
    found = []
    shown = ("content", "target", "line", "file")
    query = scan_numbered(
        spark, str(source), [IP], str(tmp_path / "checkpoint"), lambda rows, _: found.extend(rows.select(*shown).collect()), config, 1,
    )
    query.awaitTermination()
    batch = scan(read_records(spark, str(source), config), [IP]).select(*shown).collect()
    assert sorted(map(tuple, found)) == sorted(map(tuple, batch)) and batch


def test_lines_of_a_stream_are_text_or_json_lines(spark, tmp_path):
    for config in (InputConfig(format="csv"), InputConfig(expand_json=True)):
        with pytest.raises(ValueError):
            scan_stream(stream_lines(spark, str(tmp_path)), [IP], config)


def test_stream_with_a_model_too_large_for_tasks(spark, tmp_path, monkeypatch):
    """Micro-batches meet the frequent tokens as a table and the others by a join; nothing fails, and batch and stream agree."""
    from siftline.operators import classify
    from siftline.operators.classify import TextModel, fit_text_classifier, only_high_interest
    from siftline.streaming.streams import run_classified

    training = [(f"w{n} common u{n % 7}", "x" if n % 3 else "y") for n in range(300)]
    model = fit_text_classifier(spark.createDataFrame(training, "text string, label string"), 1.0)
    lines = [f"w{n} w{n + 1} common u{n % 5} new{n}" for n in range(0, 290, 4)] + ["w3", "", "common", "nothing", "w3"]
    texts = spark.createDataFrame([(line,) for line in lines if line], "content string")
    want = sorted(row["content"] for row in only_high_interest(texts, model, "y").collect())
    assert want and len(want) < len(lines) - 1
    monkeypatch.setattr(TextModel, "fits", lambda self, most=0: False)
    monkeypatch.setattr(classify, "HEAD_TOKENS", 9)
    least = model.head_limit(9)
    assert 0 < model.entries.filter(F.col("n") > least).count() <= 9 < model.vocabulary
    for limit in (classify.SENT_TOKENS, 0):
        monkeypatch.setattr(classify, "SENT_TOKENS", limit)
        assert sorted(row["content"] for row in only_high_interest(texts, model, "y").collect()) == want
    source, target = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    for part in range(3):
        (source / f"{part}.txt").write_text("\n".join(lines[part::3]) + "\n")
    rows = scan_stream(stream_lines(spark, str(source), max_files=2), [pattern("all", ".+")])
    for _ in range(2):
        run_classified(rows, target, str(tmp_path / "state"), model, "y").awaitTermination()
    got = spark.read.option("recursiveFileLookup", "true").parquet(target)
    assert sorted(row["content"] for row in got.collect()) == want
