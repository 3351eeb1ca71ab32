"""The record data source, bounded readers and streams of raw files."""

import json
import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F
from rowfacts.operators import audit, extract
from rowfacts.operators.commit import Store
from rowfacts.sources import datasource, records
from rowfacts.sources.datasource import load_records
from rowfacts.sources.records import json_array, read_records, xml
from rowfacts.sources.structure import Structure
from rowfacts.streaming.ingest import ingest_files

FILES = {
    "delimited": (Structure("delimited", encoding="utf-8"), 'ФИО;Телефон\n"Тестов\nИван";1\nПетров Пётр;2\n"x\n'),
    "fixed_width": (Structure("fixed_width", encoding="utf-8", widths=(5, 4)), "Имя  Год\nИван 1990\n\nАнна 1991\n"),
    "xml": (Structure("xml", record_path="/e/r"), "<e><skip><r/></skip>" + "<r a='1'><n>A</n><n>B</n></r><r/>" * 3 + "</e>"),
    "jsonl": (Structure("jsonl", encoding="utf-8"), '{"a":0}\n\n[1]\n{"a":{"b":1.50}}\n{\n'),
    "json_array": (Structure("json_array", encoding="utf-8"), '[{"a":1},\n {"b":{"c":[1, 2]}}, 5,\n{"a":"\\n"}\n]'),
}


def _rows(df):
    return sorted((r.file_id, r.ordinal, r.line, r.end_line, [tuple(f) for f in r.fields], r.error and tuple(r.error), r.hash) for r in df.select("file_id", "ordinal", "line", "end_line", "fields", "error", "hash").collect())


@pytest.mark.parametrize("name", list(FILES))
def test_source_equals_reader(spark, tmp_path, name):
    s, text = FILES[name]
    for k in (1, 2):
        (tmp_path / f"in/{k}").mkdir(parents=True)
        (tmp_path / f"in/{k}/f.txt").write_text(text * k if name in ("jsonl",) else text)
    expected = _rows(read_records(spark, str(tmp_path / "in"), s))
    assert _rows(load_records(spark, str(tmp_path / "in"), s)) == expected and len(expected) >= 4
    resumed = load_records(spark, str(tmp_path / "in"), s, after=1)
    assert _rows(resumed) == [r for r in expected if r[1] > 1]
    some = load_records(spark, str(tmp_path / "in"), s, after=1, files=[expected[0][0]])
    assert _rows(some) == [r for r in expected if r[1] > 1 and r[0] == expected[0][0]]
    assert _rows(load_records(spark, str(tmp_path / "in"), s).where("ordinal >= 2 AND line > 1")) == [r for r in expected if r[1] >= 2 and (r[2] or 0) > 1]


def test_pushed_filters():
    reader = datasource.RecordReader({"path": "/none", **datasource.options(FILES["jsonl"][0])})
    ds = datasource.ds
    left = list(reader.pushFilters([ds.GreaterThan(("ordinal",), 5), ds.GreaterThanOrEqual(("ordinal",), 9), ds.EqualTo(("file_id",), "f"), other := ds.EqualTo(("line",), 3)]))
    assert left == [other] and reader.after == 8 and reader.files == {"f"}


def test_skipped_records_are_not_flattened(monkeypatch):
    seen = []
    flatten = records.flatten
    monkeypatch.setattr(records, "flatten", lambda v: seen.append(v) or flatten(v))
    found = list(json_array(json.dumps([{"a": i} for i in range(10)]), Structure("json_array"), after=7))
    assert [dict(r.fields)["a"] for r in found] == ["7", "8", "9"] and len(seen) == 3
    assert [dict(r.fields)["@a"] for r in xml(b"<e>" + b"".join(b"<r a='%d'/>" % i for i in range(5)) + b"</e>", Structure("xml", record_path="e/r"), after=3)] == ["3", "4"]


def test_a_changed_file_stops_the_read(tmp_path):
    file = tmp_path / "a.jsonl"
    file.write_text('{"a":1}\n' * 3)
    (part,) = datasource.listed(str(tmp_path))
    rows = datasource._records(part, FILES["jsonl"][0], 0, False)
    file.write_text('{"a":1}\n' * 4)
    with pytest.raises(OSError):
        list(rows)


def test_json_arrays_in_blocks(monkeypatch):
    """Elements cut anywhere by blocks, numbers at a block's end, broken and endless elements."""
    s = Structure("json_array")
    values = [{"a": "x" * n, "b": [n, {"c": "é\\\"\n"}]} for n in range(40)] + [12345678, "text", None, {"n": 1e9}]
    text = "\n ".join(json.dumps(values, ensure_ascii=False, indent=1).split("\n"))
    whole = list(json_array(text, s))
    for size in (1, 7, 64):
        monkeypatch.setattr(records, "READ_CHARS", size)
        assert list(json_array(text, s)) == whole and len(whole) == len(values)
    for broken in ('[{"a":1},{"a":}, {"b":2}]', '[{"a":1},{"a":"never ends', '[{"a":1},{"a":1', '[{"a":1} x'):
        for size in (1, 1 << 18):
            monkeypatch.setattr(records, "READ_CHARS", size)
            found = list(json_array(broken, s))
            assert len(found) == 2 and found[1].error[0] == "invalid_json", broken
    assert list(json_array("{}", s))[0].error[0] == "invalid_json" and list(json_array(" [ ] ", s)) == []
    held = []
    monkeypatch.setattr(records, "READ_CHARS", 1 << 10)
    more = records._Buffer.more
    monkeypatch.setattr(records._Buffer, "more", lambda self: (more(self), held.append(len(self.text)))[0])
    assert list(json_array('[{"a":"' + "x" * 1_000_000, s, longest=10_000))[0].error[0] == "invalid_json"
    assert max(held) < 40_000


def test_memory_of_large_files_is_bounded(tmp_path):
    """A reader of 60 MB of XML and of JSON peaks near one of a small file."""
    code = """
import resource, sys
from rowfacts.sources.records import _parse_file
from rowfacts.sources.structure import Structure
n = sum(1 for _ in _parse_file(sys.argv[1], "utf-8", Structure(sys.argv[2], record_path="e/r")))
print(n, resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024)
"""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for name, head, row, tail in (("xml", "<e>", "<r><n>A</n></r><other/>", "</e>"), ("json_array", "[1", ',{"a":"b","c":[1,2]}', "]")):
        peaks = []
        for count in (1000, 60_000_000 // len(row)):
            with open(tmp_path / "f", "w") as f:
                f.write(head)
                for _ in range(count // 1000):
                    f.write(row * 1000)
                f.write(tail)
            said = subprocess.run([sys.executable, "-c", code, str(tmp_path / "f"), name], cwd=root, capture_output=True, text=True, check=True).stdout.split()
            assert int(said[0]) >= count // 1000 * 1000
            peaks.append(int(said[1]))
        assert peaks[1] < peaks[0] + 25, (name, peaks)


def test_stream_of_raw_files(spark, tmp_path):
    """Killed between batches, and with a changed file: the store ends like that of one clean run."""
    s, root = Structure("delimited", encoding="utf-8"), tmp_path / "in"
    root.mkdir()
    for k in range(4):
        (root / f"{k}.csv").write_text(f"ФИО;Телефон\nТестов Иван;+7 900 123-45-{k}0\n;\nПетров Пётр;+7 900 123-45-{k}1\n")

    def shape(df):
        return extract.verify(extract.extract_by_columns(df), F.lit("2024-01-01").cast("date"))

    class Killed(Store):
        left = 2

        def commit(self, *a, **k):
            if not self.left:
                raise RuntimeError("killed")
            self.left -= 1
            return super().commit(*a, **k)

    with pytest.raises(Exception):
        ingest_files(spark, str(root), s, shape, Killed(spark, str(tmp_path / "killed")), str(tmp_path / "c1"), files_per_batch=1)
    store, clean = Store(spark, str(tmp_path / "killed")), Store(spark, str(tmp_path / "clean"))
    assert store.read("sources").count() == 2
    assert ingest_files(spark, str(root), s, shape, store, str(tmp_path / "c1"), files_per_batch=1) == 2
    assert ingest_files(spark, str(root), s, shape, clean, str(tmp_path / "c2")) == 1
    hashed = lambda x: [tuple(audit.canonical_hash(x.read(n), c).first()) for n, c in (("person_facts", ["id", "surname", "all_json"]), ("search_docs", ["person_fact_id", "all_text"]), ("fact_values", ["fact_type", "normalized_value", "person_fact_id"]))]
    assert hashed(store) == hashed(clean) and clean.read("person_facts").count() == 8
    (root / "1.csv").write_text("ФИО;Телефон\nДругой Иван;+7 900 123-45-99\n")
    assert ingest_files(spark, str(root), s, shape, store, str(tmp_path / "c1")) == 1
    assert ingest_files(spark, str(root), s, shape, store, str(tmp_path / "c1")) == 0
    assert store.read("sources").count() == 5 and store.read("person_facts").where("surname = 'Другой'").count() == 1


@pytest.mark.parametrize("name", ["xml", "json_array"])
def test_files_without_a_byte_hold_no_records(spark, tmp_path, name):
    """Spark's XML writer leaves such a file where the first partition has no rows."""
    s, text = FILES[name]
    (tmp_path / "part-0").write_text("")
    (tmp_path / "part-1").write_text(text)
    found = _rows(load_records(spark, str(tmp_path), s))
    assert found == _rows(read_records(spark, str(tmp_path), s)) and {r[0][-6:] for r in found} == {"part-1"}
