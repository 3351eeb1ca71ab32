"""The contract of structures, samples of files and issues of a folder."""

import json
import os

import pytest

from rowfacts.operators.contract import as_structure, checked_structures

CSV = {"classification": "structured", "format": "delimited", "has_header": True, "header_row": 0, "skip_rows": 0, "delimiter": ";", "columns": ["a", "b"]}
# (changes of CSV, encoding told, errors, warnings, fields of the result)
CASES = [
    ({}, None, [], [], {"delimiter": ";", "encoding": None}),
    ({"classification": " Structured ", "format": "DELIMITED"}, "utf-8", [], [], {"classification": "structured", "format": "delimited", "encoding": "utf-8"}),
    ({"classification": "maybe", "encoding": "x", "confidence": 7}, "utf-8", ["classification_invalid"], [], {"encoding": "x", "confidence": 7.0}),
    ({"classification": "unstructured", "format": "?", "confidence": 1.5, "reason": "r" * 2001}, None, [], ["confidence_ignored"], {"confidence": None, "reason": "r" * 2000 + "…"}),
    ({"encoding": "cp1251"}, "ascii", [], ["encoding_differs"], {"encoding": "ascii"}),
    ({"encoding": "utf8"}, "utf-8-sig", [], [], {"encoding": "utf-8-sig"}),
    ({"encoding": "ebcdic"}, "koi8-r", [], ["encoding_unsupported"], {"encoding": "koi8-r"}),
    ({"delimiter": " Tab "}, None, [], [], {"delimiter": "\t"}),
    ({"delimiter": "точка с запятой"}, None, [], [], {"delimiter": ";"}),
    ({"delimiter": " "}, None, [], [], {"delimiter": " "}),
    ({"delimiter": " | "}, None, [], [], {"delimiter": "|"}),
    ({"delimiter": "||"}, None, ["delimiter_too_long"], [], {"delimiter": "||"}),
    ({"delimiter": None}, None, ["delimiter_missing"], [], {}),
    ({"delimiter": "\n"}, None, ["delimiter_line_break"], [], {}),
    ({"quote_char": "", "escape_char": ""}, None, [], [], {"quote_char": None, "escape_char": None}),
    ({"quote_char": ";", "escape_char": "\\\\"}, None, ["escape_too_long", "quote_is_delimiter"], [], {}),
    ({"escape_char": ";"}, None, ["escape_is_delimiter"], [], {}),
    ({"skip_rows": 1001, "has_header": None}, None, ["skip_rows_out_of_range"], [], {}),
    ({"skip_rows": -1}, None, ["skip_rows_out_of_range"], [], {}),
    ({"has_header": None}, None, ["has_header_missing"], [], {}),
    ({"header_row": None, "skip_rows": 2}, None, [], ["header_row_assumed"], {"header_row": 2}),
    ({"header_row": 1}, None, ["header_row_differs"], [], {}),
    ({"has_header": False, "skip_rows": None}, None, [], ["header_row_ignored"], {"header_row": None, "skip_rows": 0}),
    ({"columns": []}, None, ["columns_missing"], [], {}),
    ({"columns": ["x"] * 2001}, None, ["too_many_columns"], [], {}),
    ({"columns": ["X", " x ", "x (2)", None, ""]}, None, [], ["columns_renamed"], {"columns": ["X", "x (2)", "x (2) (2)", "Колонка 4", "Колонка 5"]}),
    ({"columns": ["n" * 300, "b"]}, None, [], ["column_name_cut"], {"columns": ["n" * 256, "b"]}),
    ({"format": "fixed_width", "fixed_widths": [3, 4], "columns": None}, None, [], ["columns_numbered"], {"columns": ["Колонка 1", "Колонка 2"]}),
    ({"format": "fixed_width", "fixed_widths": [3, 0]}, None, ["width_out_of_range"], [], {}),
    ({"format": "fixed_width", "fixed_widths": [3]}, None, ["columns_differ_from_widths"], [], {}),
    ({"format": "fixed_width", "fixed_widths": []}, None, ["widths_missing"], [], {}),
    ({"format": "fixed_width", "fixed_widths": [1] * 2001, "columns": None}, None, ["too_many_widths"], ["columns_numbered"], {}),
    ({"format": "xml", "xml_record_path": " ././файл/запись/ "}, None, [], [], {"xml_record_path": "файл/запись", "xml_namespaces": {}}),
    ({"format": "xml", "xml_record_path": "/a/b[1]"}, None, ["record_path_invalid"], [], {}),
    ({"format": "xml", "xml_record_path": "//a"}, None, ["record_path_invalid"], [], {}),
    ({"format": "xml"}, None, ["record_path_missing"], [], {}),
    ({"format": "xml", "xml_record_path": "p:a/q:b", "xml_namespaces": {"p": "urn:p"}}, None, ["prefix_undeclared"], [], {}),
    ({"format": "xml", "xml_record_path": "a", "xml_namespaces": {"1": "urn:p", "q": " "}}, None, ["namespace_invalid", "namespace_invalid"], [], {}),
    ({"format": "jsonl", "json_record_path": "$.a"}, None, ["json_record_path_unsupported"], [], {"json_record_path": None}),
    ({"format": "json_array", "json_record_path": " "}, None, [], [], {"json_record_path": None}),
    ({"format": "table"}, None, ["format_invalid"], [], {}),
    ({"format": None}, None, ["format_invalid"], [], {}),
]


def test_contract_cases(spark):
    rows = [(i, json.dumps(CSV | c[0]), c[1]) for i, c in enumerate(CASES)]
    got = {r.i: r for r in checked_structures(spark.createDataFrame(rows, "i int, answer string, told string"), "answer", "told").collect()}
    assert len(got) == len(CASES)
    for i, (change, _, errors, warnings, fields) in enumerate(CASES):
        r = got[i]
        assert [e.code for e in r.errors] == errors, change
        assert [w.code for w in r.warnings] == warnings, change
        for k, v in fields.items():
            assert r.structure[k] == v, (change, k)


def test_contract_edges(spark):
    """No answer, no JSON object, clashing columns, an empty table."""
    rows = [(1, None, "x"), (2, "no structure", "x"), (3, "[]", "x"), (4, "{}", "x"), (5, json.dumps(CSV | {"skip_rows": "many"}), "x")]
    df = spark.createDataFrame(rows, "i int, answer string, errors string")
    got = {r.i: r for r in checked_structures(df, "answer").collect()}
    assert [[e.code for e in got[i].errors] for i in range(1, 6)] == [["answer_missing"]] * 3 + [["classification_invalid"], []]
    assert got[1].structure is None and got[5].structure.skip_rows == 0
    assert checked_structures(df, "answer").columns == ["i", "answer", "structure", "errors", "warnings"]
    assert checked_structures(df.where("i > 9"), "answer").count() == 0


def test_contract_to_reader(spark, tmp_path):
    from rowfacts.sources.records import read_records

    os.makedirs(tmp_path / "in")
    (tmp_path / "in" / "a.csv").write_text("1;x\n2;y\n")
    answer = CSV | {"has_header": False, "header_row": None, "columns": ["n", "n"], "encoding": "utf8", "delimiter": "semicolon"}
    row = checked_structures(spark.createDataFrame([(json.dumps(answer),)], "answer string"), "answer").first()
    s = as_structure(row.structure)
    assert [[(f.name, f.value) for f in r.fields] for r in read_records(spark, str(tmp_path / "in"), s).orderBy("ordinal").collect()] == [[("n", "1"), ("n (2)", "x")], [("n", "2"), ("n (2)", "y")]]
    with pytest.raises(ValueError):
        as_structure({"classification": "unstructured"})


FILES = {
    "crlf.csv": b"a;b\r\n1;2\r\n",
    "lf.csv": b"a\nb\nc\nd\ne\nf\ng",
    "cr.csv": b"a\rb\rc",
    "mixed.csv": b"a\r\nb\nc\rd",
    "none.csv": b"one line",
    "empty.csv": b"",
    "mark.csv": b"\xef\xbb\xbf",
    "marked.csv": b"\xef\xbb\xbfa\n",
    "bad.csv": b"\xef\xbb\xbfa\xff\xfe\n\xd0\x90",
    "wide.csv": b"\xff\xfe" + "строка\r\nещё".encode("utf-16-le"),
    "wider.csv": b"\xff\xfe\x00\x00" + "строка\nещё".encode("utf-32-le"),
    "cp.csv": "Фамилия;Имя\nИванов;Пётр\nСидорова;Анна\n".encode("cp1251"),
    "pdf.txt": b"%PDF-1.7\n1 0 obj\n",
    "controls.txt": bytes(range(9)) * 40,
    "long.csv": b"x" * 1000 + b"\n" + b"y" * 500,
    "at_break.csv": b"x" * 1023 + b"\n" + b"y" * 500,
    "half_break.csv": b"a\n" + b"x" * 1021 + b"\r\nrest",
    "half_letter.csv": b"x" * 1023 + "яя".encode(),
    "half_pair.csv": b"\xff\xfe" + ("я" * 510 + "😀я").encode("utf-16-le"),
}


def _brute_sample(data: bytes, encoding: str, mark: int, most_bytes: int = 1024, most: int = 5):
    """Lines, truncated, truncated_line, fewer_lines, kind of line ends and replacements, letter by letter."""
    import codecs

    whole = len(data) <= most_bytes
    text = codecs.getincrementaldecoder(encoding)("replace").decode(data[:most_bytes][mark:], whole)
    lines, now, kinds, i = [], "", set(), 0
    while i < len(text):
        end = "\r\n" if text.startswith("\r\n", i) else text[i] if text[i] in "\r\n" else ""
        if end:
            if not (end == "\r" and i == len(text) - 1 and not whole):
                kinds.add({"\r\n": "crlf", "\n": "lf", "\r": "cr"}[end])
            lines.append(now)
            now = ""
        else:
            now += text[i]
        i += len(end) or 1
    ends = len(lines)
    if now:
        lines.append(now)
    short = ends < most and not whole
    return lines[:most], short, len(lines) - 1 if short and now else None, whole and len(lines) < most, None if not kinds else kinds.pop() if len(kinds) == 1 else "mixed", text.count("�")


def test_samples(spark, tmp_path):
    from rowfacts.sources.samples import sample_files

    for name, data in FILES.items():
        (tmp_path / name).write_bytes(data)
    got = {os.path.basename(r.file_id): r for r in sample_files(spark, str(tmp_path), most_bytes=1024).collect()}
    assert set(got) == set(FILES)
    told = {"wide.csv": ("utf-16-le", 2), "half_pair.csv": ("utf-16-le", 2), "wider.csv": ("utf-32-le", 4), "cp.csv": ("windows-1251", 0), "marked.csv": ("utf-8-sig", 3), "bad.csv": ("utf-8-sig", 3)}
    for name, r in got.items():
        assert (r.length, r.bytes_read, r.whole) == (len(FILES[name]), min(1024, len(FILES[name])), len(FILES[name]) <= 1024)
        if name in ("pdf.txt", "controls.txt", "empty.csv", "mark.csv"):
            assert (r.lines, r.encoding, r.line_terminator, r.truncated, r.replacement_count) == ([], None, None, False, 0)
            assert (r.is_empty, r.fewer_lines) == ((True, True) if name in ("empty.csv", "mark.csv") else (False, False))
            continue
        encoding, mark = told.get(name, ("utf-8", 0))
        assert r.encoding == encoding, name
        want = _brute_sample(FILES[name], "cp1251" if encoding == "windows-1251" else "utf-8" if mark == 3 else encoding, mark)
        assert (r.lines, r.truncated, r.truncated_line, r.fewer_lines, r.line_terminator, r.replacement_count) == want, name
    assert got["pdf.txt"].binary_kind and got["controls.txt"].binary_kind == "unknown_binary"
    given = {os.path.basename(r.file_id): r for r in sample_files(spark, str(tmp_path), 2, 1024, encoding="KOI8-R").collect()}
    assert given["cp.csv"].lines == FILES["cp.csv"].decode("koi8-r").split("\n")[:2] and given["cp.csv"].encoding_source == "override" and given["pdf.txt"].lines == []
    with pytest.raises(ValueError):
        sample_files(spark, str(tmp_path), 0)


def test_walk(spark, tmp_path):
    """Empty and hidden files, links, a cycle, a broken link, a pipe; many rounds give the same."""
    from rowfacts.sources import folders

    root = tmp_path / "top"
    for k in range(12):
        d = root / f"d{k % 3}" / ("e" * (k % 4 + 1)) / f"f{k}"
        os.makedirs(d)
        (d / f"{k}.CSV").write_text("x" * k)
    (root / "no_extension").write_text("")
    (root / ".hidden").write_text("h")
    os.makedirs(root / ".git")
    (root / ".git" / "a.txt").write_text("h")
    os.symlink(root / "d0", root / "d1" / "link")
    os.symlink(root, root / "d2" / "up")
    os.symlink(root / "nowhere", root / "broken")
    os.symlink(root / "no_extension", root / "to_file")
    os.mkfifo(root / "pipe")
    plain = {os.path.relpath(os.path.join(d, f), root): os.path.getsize(os.path.join(d, f)) for d, dirs, fs in os.walk(root) for f in fs if "/." not in os.path.join(d, f)[len(str(root)) :] and f not in ("broken", "to_file", "pipe")}
    files, issues = folders.walk(spark, str(root))
    assert {r.relative: r.length for r in files.collect()} == plain and files.count() == len(plain) == 13
    assert {(r.path.rsplit("/", 1)[1], r.issue) for r in issues.collect()} == {("link", "link_skipped"), ("up", "link_skipped"), ("broken", "link_skipped"), ("to_file", "link_skipped"), ("pipe", "not_a_file")}
    files, issues = folders.walk(spark, str(root), follow=True)
    got = {r.relative: r.length for r in files.collect()}
    assert {r.path.rsplit("/", 1)[1]: r.issue for r in issues.collect()} == {"link": "cycle", "up": "cycle", "broken": "io_error", "pipe": "not_a_file"}
    assert got == plain | {"to_file": 0}
    hidden, _ = folders.walk(spark, str(root), hidden=True)
    assert hidden.count() == 15
    flat, _ = folders.walk(spark, str(root), recursive=False)
    assert [r.name for r in flat.collect()] == ["no_extension"]
    rows = list(folders._walk([f"file:{root}"], False, True))
    assert {r[1].rsplit("/", 1)[1] for r in rows if r[0] == "folder"} == {"d0", "d1", "d2"}
    assert [folders.issue_of(OSError(n, "")) for n in (13, 36, 5)] == ["access_denied", "path_too_long", "io_error"]
    with pytest.raises(FileNotFoundError):
        folders.walk(spark, str(root / "none"))
