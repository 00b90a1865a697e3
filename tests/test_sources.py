import json
import random

import pytest
from pyspark.sql import functions as F

from siftline.functions.decode import normal_json
from siftline.functions.fields import field, is_json_object, parse_json
from siftline.functions.text import split_lines, unescape
from siftline.model import CsvConfig, InputConfig
from siftline.operators.patterns import pattern
from siftline.operators.rewrite import rewrite_fields
from siftline.operators.scan import scan
from siftline.sources.csv import read_csv_records
from siftline.sources.documents import expand_json_document, leaf_records, read_json_documents
from siftline.sources.files import (
    detect_format, done_files, list_files, read_any_records, read_records, read_target_list, remaining_files,
)
from siftline.sources.findings import read_grep_output, read_findings
from siftline.sources.jsonl import jsonl_records
from siftline.sources.lines import literal_path, raw_lines, read_lines, read_text_records, with_line_numbers
from siftline.sources.prepare import transform_fields, unescape_content
from siftline.sources.presets import PRESETS
from siftline.sources.tables import lines_of, read_table_records

IP = pattern("ip", r"\d+\.\d+\.\d+\.\d+")


def write(path, text):
    path.write_bytes(text.encode())
    return str(path)


def contents(records, *columns):
    return sorted(tuple(row) for row in records.select(*(columns or ("line", "content"))).collect())


# Text.

def test_lines_end_at_newline_only(spark, tmp_path):
    path = write(tmp_path / "a.txt", "one\r\ntwo\rstill two\n\nfo ur\r\r\nlast")
    assert contents(read_lines(spark, path), "line", "value") == [
        (1, "one"), (2, "two\rstill two"), (3, ""), (4, "fo ur\r"), (5, "last")
    ]


def test_empty_file_and_odd_name(spark, tmp_path):
    write(tmp_path / "empty.txt", "")
    path = write(tmp_path / "a b+c%20é.txt", "x\n")
    found = read_text_records(spark, str(tmp_path)).collect()
    assert [(row["file"], row["line"], row["content"], row["target"]) for row in found] == [(path, 1, "x", "$")]


def test_line_numbers_over_many_blocks_and_files(small_blocks, tmp_path):
    generator = random.Random(3)
    for number in range(5):
        lines = [f"{number}:{at}:" + "x" * generator.randrange(90) for at in range(1, 80 * (number + 1))]
        write(tmp_path / f"f{number}.txt", "\n".join(lines))
    for limit in (500_000, 30):
        found = read_lines(small_blocks, str(tmp_path), max_blocks=limit)
        wrong = found.filter(F.split_part("value", F.lit(":"), F.lit(2)).cast("bigint") != F.col("line")).count()
        assert (found.count(), wrong) == (sum(80 * n - 1 for n in range(1, 6)), 0)
    assert small_blocks.read.text(str(tmp_path)).rdd.getNumPartitions() > 20


def test_line_numbers_of_one_file_of_many_blocks(small_blocks, tmp_path):
    right = F.split_part("value", F.lit(":"), F.lit(1)).cast("bigint") == F.col("line")
    for count, number in ((9000, lambda rows: with_line_numbers(rows, True, 30)), (900, None)):
        path = write(tmp_path / f"a [b] é {count}.txt", "\n".join(f"{n}:" + "x" * (n * 7 % 61) for n in range(1, count + 1)))
        name = literal_path(path)
        assert small_blocks.read.text(name).rdd.getNumPartitions() >= count // 9
        found = number(raw_lines(small_blocks, name)) if number else read_lines(small_blocks, name, max_blocks=30)
        assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
        assert [tuple(row) for row in found.groupBy(right).count().collect()] == [(True, count)]


def test_csv_rows_of_one_file_of_many_blocks(small_blocks, tmp_path):
    text = "no,word\n" + "\n".join(f"{n},{'x' * (n * 5 % 40)}" if n % 9 else "one,two,three" for n in range(1, 701))
    path = write(tmp_path / "a.csv", text)
    read = read_csv_records(small_blocks, path, CsvConfig(target_indices=(0,), has_header=True), max_blocks=10)
    assert contents(read, "line", "content") == [(k, str(n)) for k, n in enumerate((n for n in range(1, 701) if n % 9), 1)]


def test_scan_of_text_file(spark, tmp_path):
    path = write(tmp_path / "a.txt", "".join(f"{n}: {'9.9.9.%d ' % n * (n % 3)}\n" for n in range(1, 9)))
    found = scan(read_text_records(spark, path), [IP])
    assert contents(found, "line", "content", "file") == [(n, f"9.9.9.{n}", path) for n in range(1, 9) for _ in range(n % 3)]


def test_ignored_files_and_folders(spark, tmp_path):
    (tmp_path / "deep" / "er").mkdir(parents=True)
    write(tmp_path / "deep" / "er" / "a.log", "a")
    write(tmp_path / "deep" / "b.png", "b")
    write(tmp_path / "skip.txt", "c")
    read = read_text_records(spark, str(tmp_path), ignore_extensions=["png"], ignore_names=["skip.txt"])
    assert contents(read, "content") == [("a",)]
    assert contents(read_text_records(spark, str(tmp_path), glob="*.png"), "content") == [("b",)]


# JSON lines.

def lines(spark, *texts):
    return spark.createDataFrame(
        [(text, "f.jsonl", number) for number, text in enumerate(texts, 1)], "value string, file string, line bigint"
    )


def jsonl(spark, tmp_path, config, *texts):
    return read_records(spark, write(tmp_path / "f.jsonl", "\n".join(texts)), config)


def test_jsonl_ids_and_targets(spark, tmp_path):
    rows = [{"key": {"no": n}, "in": f"from {n}.0.0.{n}", "out": "to nobody" if n % 2 else f"to 10.0.0.{n}, 10.1.0.{n}"} for n in range(1, 6)]
    config = InputConfig(format="jsonl", targets=("out", "in"), id="key.no")
    found = scan(jsonl(spark, tmp_path, config, *map(json.dumps, rows)), [IP])
    path = str(tmp_path / "f.jsonl")
    want = [(f"{path}:{n}", "in", f"{n}.0.0.{n}") for n in range(1, 6)]
    want += [(f"{path}:{n}", "out", f"10.{part}.0.{n}") for n in (2, 4) for part in (0, 1)]
    assert contents(found, "file", "target", "content") == sorted(want)


def test_jsonl_bad_lines(spark, tmp_path):
    texts = ('{"v": "seven"}', "{v: seven}", "", '{"v": "se', '[{"v": "seven"}]', '{"w": "seven"}', '{"v": "seventy"}', '{"v": "seven"} seven', "null", "7")
    read = jsonl(spark, tmp_path, InputConfig(format="jsonl", targets=("v",)), *texts)
    assert contents(scan(read, [pattern("p", "seven")])) == [(1, "seven"), (7, "seven")]
    whole = jsonl(spark, tmp_path, InputConfig(format="jsonl", filters={"v": "seven"}), *texts)
    assert contents(whole) == sorted([(1, texts[0]), *((n + 1, texts[n]) for n in (1, 3, 4, 7, 9))])
    unfiltered = jsonl(spark, tmp_path, InputConfig(format="jsonl"), *texts)
    assert [row[0] for row in contents(unfiltered)] == [1, 2, 4, 5, 6, 7, 8, 9, 10]


@pytest.mark.parametrize("size", [17_000_000, 21_000_000, 100_000_000])
def test_long_values_are_read_like_short_ones(spark, size):
    """The same texts for the same fields, whatever else the line holds."""
    line = F.concat(F.lit('{"n":1e3,"f":1.0,"d":1,"d":2,"s":"'), F.repeat(F.lit("x"), size), F.lit('\\u00e9","o":{"k":1.0}}'))
    rows = spark.range(1).select(line.alias("value"), F.lit("f").alias("file"), F.lit(1).cast("bigint").alias("line"))
    read = jsonl_records(rows, InputConfig(format="jsonl", targets=("n", "f", "d", "s", "o"), filters={"f": "1"}))
    got = read.select("target", F.char_length("content").alias("size"), F.substring("content", 1, 9).alias("start")).collect()
    assert sorted(map(tuple, got)) == [("d", 1, "2"), ("f", 1, "1"), ("n", 4, "1000"), ("o", 7, '{"k":1}'), ("s", size + 1, "x" * 9)]
    if size < 50_000_000:
        text = rows.select(F.concat(F.lit("a"), F.repeat(F.lit("x"), size), F.lit("\\u00e9")).alias("content"))
        assert unescape_content(text).select(F.char_length("content")).first()[0] == size + 2
        assert rewrite_fields(rows, {"n": F.reverse}).select(F.right("value", F.lit(4))).first()[0] == 'é"}'.rjust(4, "x")
        assert rows.select(F.char_length(normal_json(F.col("value")))).first()[0] > size
        leaves = expand_json_document(rows.withColumnRenamed("value", "document")).select("path", F.char_length("value").alias("n")).collect()
        assert {row["path"]: row["n"] for row in leaves}["$.s"] == size + 1


def test_jsonl_filters_and_value_texts(spark, tmp_path):
    texts = [json.dumps(row) for row in [
        {"status": 200, "ok": True, "body": {"b": [1, "q"]}, "n": 1.5, "text": "1.0", "matched-at": "x"},
        {"status": 404, "ok": True}, {"ok": True}, {"status": "200", "ok": False, "body": ""}, {"status": 1234567, "ok": None},
    ]] + ['{"status": 1, "status": 200, "ok": true, "n": 2.0, "body": "dup"}']
    read = jsonl(spark, tmp_path, InputConfig(format="jsonl", targets=("body", "n", "text", "matched-at", "body.b"),
                                              filters={"status": "200", "ok": "true"}, id="status"), *texts)
    assert contents(read, "line", "target", "content", "record_id") == [
        (1, "body", '{"b":[1,"q"]}', "200"), (1, "body.b", '[1,"q"]', "200"), (1, "matched-at", "x", "200"), (1, "n", "1.5", "200"),
        (1, "text", "1.0", "200"), (6, "body", "dup", "200"), (6, "n", "2", "200"),
    ]
    assert jsonl(spark, tmp_path, InputConfig(format="json", targets=("status",), filters={"status": "1234567"}), *texts).count() == 1
    assert jsonl(spark, tmp_path, InputConfig(format="json", targets=("ok",), filters={"ok": "false"}), *texts).count() == 1


def test_field_paths(spark):
    text = '{"a": {"b": {"c": "deep"}, "l": [{"x": 1}]}, "a.b": "flat", "e": ""}'
    frame = spark.createDataFrame([(text,)], "v string").select(parse_json(F.col("v")).alias("j"), "v")
    got = frame.select(*[field(F.col("j"), path).alias(path.replace(".", "_") or "none") for path in ("a.b.c", "a.b", "a.l.x", "e", "", "z")],
                       is_json_object(F.col("v"), F.col("j")).alias("object")).first()
    assert list(got) == ["deep", '{"c":"deep"}', None, "", None, None, True]


def test_long_json_lines(spark, tmp_path):
    """Lines beyond what a VARIANT holds are read like any other."""
    filler = "x" * (17 << 20)
    texts = [json.dumps({"id": "a", "s": {"d": "1.1.1.1"}, "n": 7, "f": filler}), '{"s": {"d": "2.2.2.2"}, "f": "%s"} x' % filler,
             json.dumps({"id": "b", "s": {"d": "3.3.3.3"}, "n": 8, "f": filler})]
    config = InputConfig(format="jsonl", targets=("s.d", "s"), id="id", filters={"n": "7"})
    read = jsonl(spark, tmp_path, config, *texts)
    assert contents(read, "line", "target", "content", "record_id") == [(1, "s", '{"d":"1.1.1.1"}', "a"), (1, "s.d", "1.1.1.1", "a")]


def test_presets_cover_dashes_and_objects(spark):
    from siftline.sources.jsonl import jsonl_records

    read = jsonl_records(lines(spark, '{"matched-at": "http://x", "host": "h", "template-id": "t"}'), PRESETS["nuclei"])
    assert contents(read, "target", "content", "file") == [("host", "h", "f.jsonl:t"), ("matched-at", "http://x", "f.jsonl:t")]
    event = {"eventSource": "s3.amazonaws.com", "eventName": "Get", "requestParameters": {"bucketName": "b", "key": "k"}}
    read = jsonl_records(lines(spark, json.dumps(event), json.dumps({**event, "eventSource": "ec2"})), PRESETS["aws_cloudtrail"])
    assert contents(read, "line", "content") == [(1, "b"), (1, "k")]
    assert len(PRESETS) == 27


# CSV.

def csv_by_hand(text, separator=","):
    """Rows of a CSV text with lazy quotes, one character at a time."""
    lines = [line[:-1] if line.endswith("\r") else line for line in text.split("\n")]
    if lines[-1] == "":
        lines.pop()
    rows, at = [], 0
    while at < len(lines):
        line, row = lines[at], []
        at += 1
        if line == "":
            continue
        while True:
            if not line.startswith('"'):
                cell, found, line = line.partition(separator)
                row.append(cell)
                if not found:
                    break
                continue
            cell, line, done = "", line[1:], False
            while True:
                before, found, rest = line.partition('"')
                cell += before
                if not found:
                    if at == len(lines):
                        done = True
                        break
                    cell, line, at = cell + "\n", lines[at], at + 1
                elif rest.startswith('"'):
                    cell, line = cell + '"', rest[1:]
                elif rest.startswith(separator):
                    line = rest[1:]
                    break
                elif rest == "":
                    done = True
                    break
                else:
                    cell, line = cell + '"', rest
            row.append(cell)
            if done:
                break
        rows.append(row)
    return rows


def expected_records(text, config):
    rows = csv_by_hand(text, config.separator)
    width = len(rows[0]) if rows else 0
    good = [row for row in (rows[1:] if config.has_header else rows) if len(row) == width]
    return sorted(
        (line, str(index), row[index], row[config.id_index] if config.id_index < width else "")
        for line, row in enumerate(good, 1)
        for index in (config.target_indices or range(width)) if index < width and row[index] != ""
    )


def check_csv(spark, folder, texts, *configs):
    """Each text is a file; all are read at once."""
    folder.mkdir(exist_ok=True)
    for number, text in enumerate(texts):
        write(folder / f"{number}.csv", text)
    for config in configs:
        rows = read_csv_records(spark, str(folder), config).collect()
        for number, text in enumerate(texts):
            path = str(folder / f"{number}.csv")
            got = sorted((row["line"], row["target"], row["content"], row["record_id"]) for row in rows if row["source_file"] == path)
            assert got == expected_records(text, config), text


BY_HAND = [
    "id1,1.2.3.4\nid2,no-ip\nid3,5.6.7.8", "a,b\n1,2,3\n4\n5,6\n", 'a,"x ""y"" z"\nb,x"y\nc,"q"r"\n', 'a,"one\n\ntwo",z\n\nb,c,d\n',
    '"a\nb",""\n,x\n', "a;b\r\nc;d\r\n", 'a,"open\nto the end', '"""",x\n"""a",y\n"a"",z",w\n', "\n\n", "",
]


def test_csv_by_hand(spark, tmp_path):
    check_csv(spark, tmp_path / "in", BY_HAND, CsvConfig(), CsvConfig(has_header=True, id_index=1, target_indices=(0, 5)))


def test_csv_separator_of_test_files(spark, tmp_path):
    path = write(tmp_path / "t.csv", "id;data;other\n1;1.1.1.1;foo\n2;2.2.2.2;bar\n")
    read = read_csv_records(spark, path, CsvConfig(separator=";", has_header=True, target_indices=(1,)))
    assert contents(read, "line", "content", "file") == [(1, "1.1.1.1", f"{path}:1"), (2, "2.2.2.2", f"{path}:2")]


def test_csv_at_random_over_blocks(small_blocks, tmp_path):
    generator = random.Random(4)
    pieces = ["a", "bc", ",", ",", '"', '""', "\n", "\n", ",\"", "\",", "xyz" * 9, " ", "\r\n"]
    quoted, plain = [9, 9, 6, 6, 1, 2, 6, 6, 2, 2, 9, 3, 1], [9, 9, 6, 6, 0, 0, 6, 6, 0, 0, 9, 3, 1]
    texts = ["".join(generator.choices(pieces, weights, k=400)) for weights in [quoted, plain] * 8]
    check_csv(small_blocks, tmp_path / "in", texts, CsvConfig())
    check_csv(small_blocks, tmp_path / "plain", texts[1::2], CsvConfig(has_header=True))


def test_csv_multi_line_cells_over_blocks(small_blocks, tmp_path):
    generator = random.Random(11)
    rows = [f'{number},"{"line " * generator.randrange(30)}\n{"more" * generator.randrange(40)}\n",x' for number in range(120)]
    rows.insert(50, "ragged,row")
    rows.insert(80, 'big,"' + "\n".join("z" * 90 for _ in range(40)) + '",y')
    check_csv(small_blocks, tmp_path / "ragged", ["\n".join(rows)], CsvConfig(target_indices=(1, 2)))
    check_csv(small_blocks, tmp_path / "even", ["\n".join(rows[:50])], CsvConfig(has_header=True))


def test_csv_folder_with_both_kinds(small_blocks, tmp_path):
    texts = {"a": "1,2\n3,4\n5,6,7\n8,9\n" * 60, "b": 'x,"p\nq"\ny,z\n' * 40, "c": "k\nl\n" * 80}
    for name, text in texts.items():
        write(tmp_path / f"{name}.csv", text)
    read = read_csv_records(small_blocks, str(tmp_path), CsvConfig(), max_blocks=10)
    for name, text in texts.items():
        some = read.filter(F.endswith("source_file", F.lit(f"{name}.csv")))
        assert contents(some, "line", "target", "content", "record_id") == expected_records(text, CsvConfig())


# Choosing files.

def test_formats_by_name(spark, tmp_path):
    assert [detect_format(name) for name in ("a.jsonl", "b.json", "c.csv", "d.txt", "e")] == ["jsonl", "jsonl", "csv", "text", "text"]
    write(tmp_path / "a.jsonl", '{"x": "1.1.1.1"}\nplain')
    write(tmp_path / "b.csv", "id,2.2.2.2\n")
    write(tmp_path / "c.txt", "t 3.3.3.3\n")
    found = scan(read_any_records(spark, str(tmp_path)), [IP])
    assert contents(found, "content", "target") == [("1.1.1.1", "$"), ("2.2.2.2", "1"), ("3.3.3.3", "$")]
    assert contents(read_any_records(spark, [str(tmp_path / "c.txt")])) == [(1, "t 3.3.3.3")]


def test_target_list_and_resume(spark, tmp_path):
    paths = [write(tmp_path / f"{name}.txt", f"{name} 1.1.1.1\n") for name in "abc"]
    listed = write(tmp_path / "list", "\n".join(paths[:2]) + "\n\n")
    assert read_target_list(spark, listed) == paths[:2]
    assert read_text_records(spark, read_target_list(spark, listed)).count() == 2
    files = list_files(spark, str(tmp_path), glob="*.txt")
    done = done_files(files.filter(F.endswith("path", F.lit("a.txt"))))
    assert sorted(row["path"][-5:] for row in remaining_files(files, done).collect()) == ["b.txt", "c.txt"]


# Tables and transforms.

def test_table_records_and_lines(spark):
    table = spark.createDataFrame([(1, "a\nb\r\n", "x"), (2, "", None)], "id bigint, t string, u string")
    records = read_table_records(table, "id", ["t", "u"], "tab", keep=["id"])
    assert contents(records, "id", "target", "content", "file") == [(1, "t", "a\nb\r\n", "tab:1"), (1, "u", "x", "tab:1")]
    assert contents(lines_of(records), "target", "line", "content") == [("t", 1, "a"), ("t", 2, "b"), ("u", 1, "x")]
    texts = spark.createDataFrame([("",), ("\n",), ("a",), ("a\n\nb",)], "t string")
    assert [row[0] for row in texts.select(split_lines(F.col("t"))).collect()] == [[], [""], ["a"], ["a", "", "b"]]


def by_rules(text):
    """Unescaping by the rules, on the driver."""
    if "\\" not in text:
        return text
    for escape, char in (("\\n", "\n"), ("\\r", "\r"), ("\\t", "\t"), ('\\"', '"')):
        text = text.replace(escape, char)
    if "\\u" in text:
        try:
            return json.loads('"' + text + '"')
        except ValueError:
            return text
    return text


def test_unescape(spark):
    texts = ["plain", "a\\nb\\tc\\rd", "\\u00e9", "a\\nb \\u00e9", 'say \\"hi\\" \\u0041', "\\\\u0041", "\\q \\u0041", "\\/ \\u0041", "\\u00",
             "\\\\n", "tab\there \\u0041", "\\\\\\\" \\u0041", "\\b\\u0042", "\\", "é \\u00e9 日本"]
    frame = spark.createDataFrame([(text,) for text in texts], "t string")
    assert [row[0] for row in frame.select(unescape(F.col("t"))).collect()] == [by_rules(text) for text in texts]


def test_transform_by_target(spark, records):
    rows = records("Ab").unionByName(records("Cd").withColumn("target", F.lit("body")))
    only = transform_fields(rows, {"body": F.upper})
    assert contents(only, "target", "content") == [("$", "Ab"), ("body", "CD")]
    both = transform_fields(rows, {"body": F.upper, "$": F.lower})
    assert contents(both, "target", "content") == [("$", "ab"), ("body", "CD")]
    assert contents(unescape_content(records("a\\nb")), "content") == [("a\nb",)]


def test_expand_json(spark, tmp_path):
    text = '{"a": {"b": [1, {"c": "x.y"}]}, "e": {}, "n": null, "l": [], "t": true}'
    documents = spark.createDataFrame([(1, text), (2, "not json"), (3, '"leaf"')], "id int, document string")
    got = sorted(((row["id"], row["path"], row["value"]) for row in expand_json_document(documents).collect()), key=str)
    assert got == sorted([
        (1, "$.a.b[0]", "1"), (1, "$.a.b[1].c", "x.y"), (1, "$.e", "{}"), (1, "$.n", None), (1, "$.l", "[]"), (1, "$.t", "true"),
        (3, "$", "leaf"),
    ], key=str)
    shallow = expand_json_document(documents.filter("id = 1"), depth=1).filter("path = '$.a'").first()
    assert shallow["value"] == '{"b":[1,{"c":"x.y"}]}'
    write(tmp_path / "d.json", json.dumps({"k": "1.1.1.1"}, indent=2))
    found = scan(leaf_records(read_json_documents(spark, str(tmp_path / "d.json"))), [IP])
    assert contents(found, "content", "target") == [("1.1.1.1", "$.k")]
    assert read_records(spark, write(tmp_path / "one.txt", '{"k": ["2.2.2.2"]}\n'), PRESETS["beautify_json"]).first()["target"] == "$.k[0]"


def test_json_depth_is_read_off_the_data(spark):
    deep = '{"a":' * 12 + '"x]["' + "}" * 12
    documents = spark.createDataFrame([(1, deep), (2, "[" * 30 + "]" * 30), (3, '"{[{"')], "id int, document string")
    got = {row["id"]: (row["path"], row["value"]) for row in expand_json_document(documents).collect()}
    assert got == {1: ("$" + ".a" * 12, "x]["), 2: ("$" + "[0]" * 29, "[]"), 3: ("$", "{[{")}


def test_documents_in_any_layout(spark, tmp_path):
    value = {"a": {"ip": "1.1.1.1"}, "b": ["2.2.2.2"]}
    write(tmp_path / "pretty.json", "\n" + json.dumps(value, indent=2))
    write(tmp_path / "line.json", json.dumps(value) + "\nbroken 3.3.3.3\n")
    write(tmp_path / "text.txt", "4.4.4.4 is\nno json\n")
    found = scan(read_records(spark, str(tmp_path), PRESETS["beautify_json"]), [IP])
    assert contents(found, "content", "target") == sorted([("1.1.1.1", "$.a.ip"), ("2.2.2.2", "$.b[0]")] * 2 + [("3.3.3.3", "$"), ("4.4.4.4", "$")])


def test_names_with_glob_characters(spark, tmp_path):
    for name in ("a[1].csv", "b{x,y}.csv", "c*.csv"):
        write(tmp_path / name, 'id,text\n1,"two\nlines"\n2,one\n')
    read = read_csv_records(spark, str(tmp_path), CsvConfig(has_header=True, target_indices=(1,)))
    assert contents(read, "record_id", "content") == sorted([("1", "two\nlines"), ("2", "one")] * 3)
    listed = write(tmp_path / "list.txt", f"{tmp_path}/a[1].csv\n\n{tmp_path}/c*.csv\n")
    lines = read_records(spark, read_target_list(spark, listed), InputConfig())
    assert sorted({row["source_file"] for row in lines.collect()}) == [f"{tmp_path}/a[1].csv", f"{tmp_path}/c*.csv"]


# Saved findings.

def test_grep_lines(spark):
    texts = ["main.go:10:func main() {", "only content", "file.tar.gz:rest", "a/b.d/c:7:x:y", "f:x1:z", ":3:"]
    got = read_grep_output(spark.createDataFrame([(text,) for text in texts], "value string"), "p").collect()
    assert [(row["file"], row["line"], row["content"], row["ext"]) for row in got] == [
        ("main.go", 10, "func main() {", ".go"), ("", 0, "only content", ""), ("file.tar.gz", 0, "rest", ".gz"),
        ("a/b.d/c", 7, "x:y", ""), ("f", 0, "z", ""), ("", 3, "", ""),
    ]


def test_saved_findings_as_array_or_lines(spark, tmp_path):
    one = {"id": 0, "pattern": "ip", "file": "s.txt", "line": 1, "content": "1.1.1.1", "matches": ["1.1.1.1", "1.", "1", "1"],
           "entropy": 0.9852281360342515}
    two = {"id": 1, "pattern": "any", "content": "x", "tool_data": [{"tool_id": "t", "label": "l", "value": "v"}]}
    paths = [write(tmp_path / "array.json", json.dumps([one, two])), write(tmp_path / "lines.json", "\n".join(map(json.dumps, [one, two])))]
    for path in paths:
        got = read_findings(spark, path).orderBy("id").collect()
        assert (got[0]["matches"], got[0]["tool_data"], got[0]["ext"]) == (one["matches"], [], "")
        assert (got[1]["line"], got[1]["file"], got[1]["tool_data"][0]["value"]) == (0, "", "v")
    pretty = write(tmp_path / "pretty.json", json.dumps([one, two], indent=2))
    assert read_findings(spark, pretty).count() == 2
    assert read_findings(spark, [pretty, paths[1]]).count() == 4
    broken = write(tmp_path / "broken.json", json.dumps([one])[:-3])
    with pytest.raises(ValueError, match="no saved findings"):
        read_findings(spark, [broken, paths[1]]).collect()
