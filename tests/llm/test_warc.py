import base64
import glob
import hashlib
import os

import pytest
import zstandard

from siftline.llm.warc import archive_pages, page_of, parse_record, read_bundles, read_seek_table, record_bytes, write_bundles


def digest(html):
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


@pytest.fixture(scope="module")
def pages():
    return [
        (1, "http://a.example/1", "<p>one</p>"), (2, "http://a.example/2\r\nX: y", "<p>one</p>"), (3, None, None), (4, "http://é.example/", ""),
        (5, "u", "<p>Zwölf ünd</p>" * 1000), (6, "u", "<p>one</p>"), (None, "n", "<p>no id</p>"), (7, "v", "x" * 3_000_000), (8, "w", "WARC/1.1\r\n\r\n"),
    ]


def frame_of(spark, pages):
    return spark.createDataFrame([(*p, "x", 1) for p in pages], "page_id bigint, url string, html string, digest string, uid int")


def test_round_trip(spark, pages, tmp_path):
    index = archive_pages(frame_of(spark, pages), f"file://{tmp_path}/w").cache()
    assert index.count() == len(pages)
    records = read_bundles(index, f"file://{tmp_path}/w").withColumn("page_id", page_of("record_id")).withColumn("to", page_of("refers_to_id"))
    got = {r.page_id: r for r in records.collect()}
    last = {}
    for page, _, html in pages:
        last[html or ""] = max(last.get(html or "", -1), -1 if page is None else page)
    for page, _, html in pages:
        row, first = got[page], last[html or ""]
        assert (row.payload_bytes, row.payload_digest) == (len((html or "").encode()), digest(html))
        if (page or -1) == first:
            assert (row.record_type, row.to, bytes(row.payload).decode()) == ("response", None, html or "")
        else:
            assert (row.record_type, row.to, row.payload) == ("revisit", first, None)
    one = read_bundles(index.filter("record_id LIKE 'urn:page:5:%'"), f"file://{tmp_path}/w").collect()
    assert bytes(one[0].payload).decode() == pages[4][2]


def test_files_are_seekable_zstandard(spark, pages, tmp_path):
    index = archive_pages(frame_of(spark, pages), f"file://{tmp_path}/w").collect()
    for path in glob.glob(f"{tmp_path}/w/*.warc.zst"):
        with open(path, "rb") as file:
            table = read_seek_table(file)
            file.seek(0)
            whole = zstandard.ZstdDecompressor().stream_reader(file, read_across_frames=True).read()
        assert sum(plain for *_, plain in table) == len(whole)
        at, seen = 0, 0
        while at < len(whole):
            _, _, at = parse_record(whole, at)
            seen += 1
        assert seen == sum(row.bundle == os.path.basename(path) for row in index)


def test_repeated_rows_have_one_response(spark, tmp_path):
    index = archive_pages(frame_of(spark, [(9, "u", "same")] * 3), f"file://{tmp_path}/w")
    kinds = sorted(r.record_type for r in read_bundles(index, f"file://{tmp_path}/w").collect())
    assert kinds == ["response", "revisit", "revisit"]


def test_frames_and_bundles_are_cut(spark, tmp_path):
    rows = [(f"urn:page:{k}:0", "response", os.urandom(400), None, None) for k in range(50)]
    records = spark.createDataFrame(rows, "record_id string, kind string, payload binary, url string, refers_to string").coalesce(1)
    index = write_bundles(records, f"file://{tmp_path}/w", frame_bytes=2000, bundle_bytes=5000).collect()
    assert len({r.bundle for r in index}) > 3 and max(r.frame for r in index) > 0
    back = read_bundles(spark.createDataFrame(index), f"file://{tmp_path}/w").collect()
    assert {r.record_id: bytes(r.payload) for r in back} == {r[0]: r[2] for r in rows}


def test_empty_table(spark, tmp_path):
    index = archive_pages(frame_of(spark, []), f"file://{tmp_path}/w")
    assert read_bundles(index, f"file://{tmp_path}/w").collect() == []


def test_a_damaged_record_is_an_error():
    data = record_bytes("urn:page:1:0", "response", b"x")
    with pytest.raises(ValueError):
        parse_record(data[:-4] + b"abcd", 0)
