import json
import random

import numpy as np
import pytest

from siftline.model import InputConfig
from siftline.sources.bigjson import large_json_leaves, structure
from siftline.sources.files import list_files, read_records


def leaves(value, path="$"):
    if isinstance(value, dict) and value:
        return [leaf for key, item in value.items() for leaf in leaves(item, f"{path}.{key}")]
    if isinstance(value, list) and value:
        return [leaf for place, item in enumerate(value) for leaf in leaves(item, f"{path}[{place}]")]
    if value is None:
        return [(path, None)]
    return [(path, value if isinstance(value, str) else json.dumps(value, separators=(",", ":")))]


def made(pick, depth):
    roll = pick.random()
    if depth == 0 or roll < 0.3:
        return pick.choice([1, -2.5, True, None, "", "plain", 'with "quotes" and \\ and ],[{}', "\\\\", "é漢\n", [], {}])
    if roll < 0.65:
        return [made(pick, depth - 1) for _ in range(pick.randint(1, 5))]
    return {pick.choice(["a", "b,", 'c"', "d\\", "e]", "f{"]) + str(k): made(pick, depth - 1) for k in range(pick.randint(1, 5))}


@pytest.mark.parametrize("block, most", [(7, 20), (64, 40), (50, 10_000), (1 << 20, 1 << 20)])
def test_leaves_of_documents_of_any_layout(spark, tmp_path, block, most):
    """Blocks that end within strings, escapes, keys and numbers; members that are cut again and again."""
    pick = random.Random(9)
    values = {f"{k}.json": [made(pick, 4) for _ in range(6)] if k % 2 else {"x": made(pick, 4), "y": [made(pick, 3)], "z": {}} for k in range(4)}
    values |= {"empty.json": [], "hollow.json": {}}
    for name, value in values.items():
        (tmp_path / name).write_text("\n " + json.dumps(value, indent=[None, 2][len(name) % 2], ensure_ascii=bool(len(name) % 3)) + " \n")
    (tmp_path / "text.json").write_text("no document")
    found = large_json_leaves(spark, list_files(spark, str(tmp_path)), block, most)
    got = sorted(((r.file.rsplit("/", 1)[1], r.path, r.value) for r in found.collect()), key=repr)
    want = sorted(((name, *leaf) for name, value in values.items() for leaf in leaves(value)), key=repr)
    if most > 100:
        assert got == want
    else:
        # Single values beyond the bound have no rows of their own.
        missing = [row for row in want if row not in got]
        assert [row for row in got if row not in want] == [] and all(len(json.dumps(row[2], ensure_ascii=False).encode()) > most / 2 for row in missing)


def test_structure_from_both_cases():
    data = b'{"a\\"[":[1,2],"b":{"c":"]"}}'
    depth, comma, inside = structure(data, False, False)
    assert depth[-1] == 0 and not inside and depth.max() == 2
    assert [(int(k), int(depth[k])) for k in np.flatnonzero(comma)] == [(data.index(b"1,") + 1, 2), (data.index(b"],") + 1, 1)]
    for cut in range(len(data) + 1):
        escaped = (len(data[:cut]) - len(data[:cut].rstrip(b"\\"))) % 2 == 1
        first = structure(data[:cut], False, False)
        second = structure(data[cut:], first[2], escaped)
        joined = np.concatenate([first[0], second[0] + (first[0][-1] if cut else 0)])
        assert joined.tolist() == depth.tolist() and np.concatenate([first[1], second[1]]).tolist() == comma.tolist()


def test_a_document_is_read_by_many_tasks(spark, tmp_path):
    rows = [{"id": k, "text": "x" * (k % 300)} for k in range(20_000)]
    (tmp_path / "big.json").write_text(json.dumps({"head": {"n": 1}, "data": rows}, indent=1))
    found = large_json_leaves(spark, list_files(spark, str(tmp_path)), 200_000, 100_000)
    assert found.count() == 40_001
    got = {r.path: r.value for r in found.filter("path in ('$.head.n', '$.data[0].id', '$.data[19999].id', '$.data[777].text')").collect()}
    assert got == {"$.head.n": "1", "$.data[0].id": "0", "$.data[19999].id": "19999", "$.data[777].text": "x" * 177}


def test_records_of_large_documents_equal_those_of_small_ones(spark, tmp_path):
    (tmp_path / "a b.json").write_text(json.dumps({"rows": [{"id": k, "text": f"line {k}"} for k in range(50)]}, indent=2))
    (tmp_path / "lines.json").write_text("".join(json.dumps({"id": k}) + "\n" for k in range(300)))
    (tmp_path / "c.json").write_text("no json\nat all\n" * 100)
    shown = ("file", "line", "target", "content")
    whole, cut = (
        sorted(map(tuple, read_records(spark, str(tmp_path), InputConfig(expand_json=True), document_bytes=most).select(*shown).collect()))
        for most in (1 << 20, 1000)
    )
    assert whole == cut and len(whole) == 100 + 300 + 200


def test_structure_of_any_bytes():
    """Against a loop over the bytes, for both cases and with a backslash before the start."""
    pick = random.Random(5)
    for size in [0, 1, 2, 3, 7, 40] * 60:
        data = bytes(pick.choice(b'\\\\"[]{},a') for _ in range(size))
        for inside in (False, True):
            for escaped in (False, True):
                depth, string, odd, want = 0, inside, escaped, []
                for byte in data:
                    plain = not string
                    if byte == 34 and not odd:
                        string, plain = not string, False
                    depth += plain * ((byte in b"[{") - (byte in b"]}"))
                    odd = byte == 92 and not odd
                    want.append((depth, plain and byte == 44))
                got = structure(data, inside, escaped)
                assert list(zip(got[0].tolist(), got[1].tolist(), strict=True)) == want and got[2] == string
