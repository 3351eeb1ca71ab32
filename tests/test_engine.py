import datetime
import decimal
from dataclasses import replace

import duckdb
import pytest
from pyspark.sql import functions as F
from rowfacts import catalog
from rowfacts.functions import dates, identifiers, records, text
from rowfacts.operators import batching, checks, extract
from rowfacts.operators.commit import Store
from rowfacts.plans import search
from rowfacts.sources import records as source_records
from rowfacts.sources import sniff
from rowfacts.sources.records import numbered_lines, parse, read_records, scan_folder
from rowfacts.sources.structure import Structure, unique_names
from rowfacts.streaming.ingest import ingest_stream

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def shown(v):
    if isinstance(v, (float, decimal.Decimal)):
        return f"{float(v):.6f}"
    return str(v)


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for name in TABLES:
        c.sql(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, sf_dir, duck, name):
    df = catalog.queries()[name](spark, sf_dir)
    cols = sorted(df.columns)
    expected = duck.sql(catalog.oracle_sql()[name])
    assert sorted(expected.columns) == cols
    at = [expected.columns.index(c) for c in cols]
    want = sorted(tuple(shown(r[i]) for i in at) for r in expected.fetchall())
    assert sorted(tuple(shown(v) for v in r) for r in df.select(cols).collect()) == want


def values(spark, rows, *columns):
    """Each column function applied to rows of strings."""
    df = spark.createDataFrame([tuple(r) for r in rows], ", ".join(f"c{i} string" for i in range(len(rows[0]))))
    return [tuple(r) for r in df.select(*columns).collect()]


def test_identifiers(spark):
    rows = [("phone", "+7 (900) 123-45-67"), ("phone", "123"), ("email", " A@B.org "), ("email", "a@b"), ("inn", "77 01"), ("vin", "ab-1"), ("license_plate", "а123вс 77"), ("website", "X.Org"), ("other", " Ёлка  два "), ("phone", None)]
    got = values(spark, rows, identifiers.stored_form(F.col("c0"), F.col("c1")), identifiers.search_key(F.col("c0"), F.col("c1")))
    assert got == [("+79001234567", "79001234567"), (None, None), ("a@b.org", "a@b.org"), (None, "a@b"), ("7701", "7701"), ("AB1", "AB1"), ("A123BC77", "A123BC77"), ("x.org", "x.org"), (None, "елка два"), (None, None)]
    keys = values(spark, [("8 900 1",), ("a@B",), ("ab 12",), (" ",)], identifiers.search_key_any(F.col("c0")))
    assert keys == [("89001",), ("a@b",), ("AB12",), (None,)]
    kinds = [("snils", "7701234567", "x"), ("snils", "7701234567", "СНИЛС"), ("inn", "123-456-789 01", ""), ("vehicle", "А123ВС77", ""), ("other", "WVWZZZ1KZ6W000001", ""), ("phone", "1", "")]
    assert [r[0] for r in values(spark, kinds, identifiers.corrected_type(F.col("c0"), F.col("c1"), F.col("c2")))] == ["inn", "snils", "snils", "license_plate", "vin", "phone"]


def test_birth_dates(spark):
    rows = [
        ("1990-02-15", "15.02.1990", None),
        ("1990-02-15", "born 1990-2-15", None),
        ("1990-02-15", "15 февраля 1990 г.", None),
        ("1990-02-15", "Feb 15, 1990", None),
        ("1990-02-15", "Мартин 15 1990", "no full date in the evidence"),
        ("1990-02-15", "15.02.90", "two-digit year"),
        ("1990-02-03", "02/03/1990", "ambiguous order of day and month"),
        ("1990-02-15", "02/15/1990", None),
        ("1990-02-15", "16.02.1990", "evidence has another date"),
        ("1849-02-15", "15.02.1849", "year too early"),
        ("2030-02-15", "15.02.2030", "date in the future"),
        ("1990-02-31", "31.02.1990", "not a valid ISO date"),
        ("1990-02-15", "", "no evidence"),
        ("1990-02-15", "nothing", "format of the evidence not known"),
    ]
    got = values(spark, rows, dates.check_birth_date(F.col("c0"), F.col("c1"), F.lit("2024-01-01").cast("date")).alias("r"))
    assert [r[0].reason for r in got] == [r[2] for r in rows]
    assert all((r[0].date is not None) == (x[2] is None) for r, x in zip(got, rows, strict=True))


def test_text(spark):
    rows = [("  «Ёлка»—два​ три ", "елк"), ("Иван Тестов", "Тестове"), ("a b", "")]
    got = values(spark, rows, text.normalize_text(F.col("c0")), text.plausible_variant(F.col("c1"), F.col("c0")))
    assert got == [('"елка"-два три', True), ("иван тестов", True), ("a b", False)]
    masked = values(spark, [("token=abc123 mail Anna@x.org card 4000123412341234 tel 79001234567 on 2024-05-17",)], text.mask_secrets(F.col("c0")))
    assert masked == [("token=*** mail A***@x.org card ***1234 tel ***67 on 2024-05-17",)]
    assert text.escape_like("a%b_c\\") == "a\\%b\\_c\\\\"
    assert values(spark, [("The theory",)], text.highlight(F.col("c0"), ["the", "theory"])) == [("<b>The</b> <b>theory</b>",)]
    assert values(spark, [("```json\n[1]\n```",), ("[2]",)], text.strip_code_fence(F.col("c0"))) == [("[1]",), ("[2]",)]


def test_query_compiler():
    assert search.compile_query('"Тестов Иван" T_123').condition() == '"Тестов Иван" AND "T_123"'
    assert search.compile_query("a, b*", "any").condition() == '"a" OR "b*"'
    assert search.compile_query("user@x.org 7-900.", "phrase").condition() == '"user@x.org 7-900"'
    for bad, mode in (("", "all"), ("*a", "all"), ("!!!", "all"), ("a* b", "phrase"), ("x" * 1001, "all"), ("a " * 21, "all"), ("y" * 101, "all")):
        with pytest.raises(search.SearchError):
            search.compile_query(bad, mode)


def test_encodings(spark):
    russian = "Иванов Иван Иванович, город Москва, улица Ленина; слесарь механик"
    texts = [(n, t) for n in ("windows-1251", "cp866", "koi8-r") for t in (russian, russian.upper(), russian.lower(), "ФИО;Дата\nТестов Иван;15.02.1990;+7", "номер 5 Ёлка")]
    texts += [("windows-1252", t) for t in ("naïve café déjà vu, très bien", "Müller Straße größer", "El niño mañana ÁRBOL")]
    texts += [(n, russian) for n in ("utf-8", "utf-16-le", "utf-16-be", "utf-32-le", "utf-32-be")] + [("utf-16-le", "a;b;c 1 2 3\n"), ("utf-8", "abc"), ("utf-8", "")]
    rows = [(n, None, t.encode(sniff.CODECS[n]), True) for n, t in texts]
    rows += [("utf-16-le", None, russian.encode("utf-16"), True), ("utf-8-sig", None, b"\xef\xbb\xbfa", True), ("utf-8", None, "ру".encode()[:-1], False)]
    rows += [(None, "pdf", b"%PDF-1.7", True), (None, "zip", b"PK\x03\x04x", True), (None, "mp4", b"1234ftypisom", True), (None, "unknown_binary", bytes(range(32)) * 4, True), (None, "sqlite", b"SQLite format 3\0", True)]
    rows += [(None, "bmp", b"BM" + bytes([9, 9, 9, 9, 0, 0, 0, 0, 54, 0, 0, 0, 40, 0, 0, 0]), True), ("utf-8", None, b"BM is short for it, PK too", True)]
    got = sniff.sniff(spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, want string, kind string, head binary, whole boolean"), "head", "whole").collect()
    assert [(r.i, r.encoding, r.binary_kind) for r in got if (r.encoding, r.binary_kind) != (r.want, r.kind)] == []
    names = values(spark, [(" CP1251 ", "utf-8"), ("latin_1", "utf-8-sig"), ("klingon", "windows-1251"), ("UTF16", "utf-8")], sniff.canonical_encoding(F.col("c0")), sniff.equivalent(F.col("c1"), F.lit("utf-8"), F.lit(False)), sniff.equivalent(F.col("c1"), F.lit("utf-8"), F.lit(True)))
    assert names == [("windows-1251", True, True), ("iso-8859-1", True, True), (None, False, True), ("utf-16-le", True, True)]


def test_structure_checks(spark):
    lines = [("f", 1, "a;b;c,d"), ("f", 2, "1;2;3"), ("f", 3, "4;5;6"), ("g", 1, "x"), ("g", 2, "y"), ("w", 1, "abc  def"), ("w", 2, "ab   de "), ("w", 3, " "), ("t", 1, "é" * 40), ("t", 2, "z")]
    df = spark.createDataFrame(lines, "file string, n int, text string")
    assert {tuple(r) for r in checks.delimiter_guess(df, "file", "text").collect()} == {("f", ";")}
    sampled = checks.sample_lines(df, "file", "n", "text", 2, 75).where("file IN ('f', 't')").orderBy("file", "n").collect()
    assert [(r.n, r.text, r.truncated) for r in sampled] == [(1, "a;b;c,d", False), (2, "1;2;3", False), (1, "é" * 37, True)]
    widths = spark.createDataFrame([("w", [4, 4]), ("g", [1, 2]), ("f", [7])], "file string, widths array<int>")
    assert {r.file: r.refined for r in checks.refined_widths(df, widths, "file", "text").collect()} == {"w": [5, 3], "g": [1, 2], "f": [7]}
    near = spark.createDataFrame([("u", "aa  b bb"), ("u", "aa  b bb")], "file string, text string")
    twice = spark.createDataFrame([("u", [5, 3])], "file string, widths array<int>")
    assert checks.refined_widths(near, twice, "file", "text").first().refined == [5, 3]
    counts = spark.createDataFrame([("f", 3, n) for n in (3, 3, 4, 4, 2)] + [("g", 2, 5)], "file string, declared int, n int")
    assert {tuple(r) for r in checks.field_count_mode(counts, "file", "n", "declared").collect()} == {("f", 3, 3, True), ("g", 2, 5, False)}
    bad = spark.createDataFrame([("f", i, i > 4) for i in range(1, 6)] + [("g", i, i < 3) for i in range(1, 6)] + [("h", 1, False)], "file string, n int, bad boolean")
    assert {tuple(r) for r in checks.bad_records(bad, "file", F.col("bad"), "n").collect()} == {("f", 5, 1, 5, "bad_records_present"), ("g", 5, 2, 1, "too_many_bad_records"), ("h", 1, 0, None, None)}
    odd = spark.createDataFrame([("a", "x" * 99 + "\ufffd"), ("b", "\ufffdxx"), ("c", "x")], "file string, text string")
    assert {tuple(r) for r in checks.replaced_characters(odd, "file", "text").collect()} == {("a", 1, "replacement_characters"), ("b", 1, "decode_failed"), ("c", 0, None)}
    heads = spark.createDataFrame([([" A", "b"], ["a", "B "]), (["x", "b"], ["a", "b"]), (["a"], ["a", "b"])], "found array<string>, declared array<string>")
    assert [r[0] for r in heads.select(checks.header_issue(F.col("found"), F.col("declared"))).collect()] == [None, "header_differs", "column_count_mismatch"]
    paths = spark.createDataFrame([("f", p) for p in ["r", *["r/x"] * 3, *["r/x/y"] * 3, "r/z"]] + [("g", "r")], "file string, path string")
    assert [tuple(r) for r in checks.record_path(paths, "file", "path").collect()] == [("f", "r/x", 3)]
    columns = spark.createDataFrame([("f", 0, "Номер СНИЛС"), ("f", 1, "ИНН"), ("f", 2, "Имя"), ("g", 0, "снилс")], "file string, place int, name string")
    cells = spark.createDataFrame([("f", 0, "770123456789")] * 4 + [("f", 0, "123-456-789 01"), ("f", 1, "7701234567"), ("f", 1, "7701234568"), ("g", 0, "7701234567")], "file string, place int, value string")
    assert [tuple(r) for r in checks.inferred_names(columns, cells, "file", "place", "name", "value").collect()] == [("f", 0, "Номер СНИЛС", "ИНН 2", 4, 5)]


def rows_of(content, **settings):
    return [(r.line, r.end_line, r.fields, r.error and r.error[0]) for r in parse(content if isinstance(content, bytes) else content.encode(), Structure(**settings))]


def test_parsers():
    got = rows_of('a;b;a\r\n1;"x\ny";3\n\n1;2\n1;2;3;4\nA;b;a\n1;2;"', format="delimited")
    assert got == [
        (2, 3, [("a", "1"), ("b", "x\ny"), ("a (2)", "3")], None),
        (5, 5, [], "short_record"),
        (6, 6, [], "field_count_mismatch"),
        (7, 7, [], "structure_changed"),
        (8, 8, [], "decode_error"),
    ]
    assert rows_of("Имя  Год\nИван 1990\n\nАнна 1991 и далее\n", format="fixed_width", widths=(5, 4)) == [(2, 2, [("Имя", "Иван"), ("Год", "1990")], None), (4, 4, [("Имя", "Анна"), ("Год", "1991 и далее")], None)]
    assert rows_of('{"a":{"b":1.10},"c":[1,"x"],"d":null,"e":true}\n\n[1]\n{', format="jsonl") == [(1, 1, [("a.b", "1.10"), ("c", '[1,"x"]'), ("d", None), ("e", "true")], None), (3, 3, [], "not_an_object"), (4, 4, [], "invalid_json")]
    assert rows_of('[\n{"a":1},\n{"a":\n2}, x', format="json_array") == [(2, 2, [("a", "1")], None), (3, 4, [("a", "2")], None), (4, 4, [], "invalid_json")]
    doc = '<e xmlns:p="urn:p"><p:r id="1"><n>A</n><t>1</t><t>2</t><r>in</r></p:r><p:r id="2"/></e>'
    assert [r[2] for r in rows_of(doc, format="xml", record_path="/e/q:r", namespaces={"q": "urn:p"})] == [[("@id", "1"), ("n", "A"), ("t", "1"), ("t[2]", "2"), ("r", "in")], [("@id", "2")]]
    assert rows_of('<!DOCTYPE e [<!ENTITY x "y">]><e/>', format="xml", record_path="e")[0][3] == "forbidden_entity"
    assert unique_names(["A", " a ", None, "A (2)"]) == ["A", "a (2)", "Колонка 3", "A (2) (2)"]


def test_sources_and_commit(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/people.csv").write_text("ФИО;Дата рождения;Телефон\nТестов Иван Петрович;15.02.1990;+7 900 123-45-67, 8 800 555-35-35\nПетрова Анна;31.02.1990;1\n;;\nx\n", encoding="cp1251")
    found = scan_folder(spark, str(tmp_path / "in")).collect()
    assert [(r.name, r.hint) for r in found] == [("people.csv", "text_candidate")]
    s = Structure("delimited")
    rows = read_records(spark, str(tmp_path / "in"), s)
    assert [r.ordinal for r in rows.orderBy("ordinal").collect()] == [1, 2, 3, 4]
    assert read_records(spark, str(tmp_path / "in"), s, after=2).count() == 2
    sizes = {r.ordinal: r.n for r in rows.where("error IS NULL").select("ordinal", records.record_bytes(F.col("fields")).alias("n")).collect()}
    assert sizes[2] < sizes[1]
    short = read_records(spark, str(tmp_path / "in"), s, longest=sizes[2] + records.CHUNK_OVERHEAD).orderBy("ordinal").collect()
    assert [(r.error and r.error.code, len(r.fields), r.hash is None) for r in short[:2]] == [("record_too_large", 0, True), (None, 3, False)]
    room = sizes[1] + sizes[2] + records.CHUNK_OVERHEAD
    assert [r.batch for r in batching.chunked(rows, 10, room).orderBy("ordinal").collect()] == [0, 0, 1, 1]
    assert [r.batch for r in batching.chunked(rows, 10, room - 1).orderBy("ordinal").collect()][:2] == [0, 1]
    verified = extract.verify(extract.extract_by_columns(rows), F.lit("2024-01-01").cast("date")).withColumn("extraction_version", F.lit("v1"))
    got = verified.orderBy("ordinal").collect()
    assert [r.outcome for r in got] == [1, 1, 2, 3]
    assert (got[0].surname, got[0].patronymic, got[0].birth_date) == ("Тестов", "Петрович", datetime.date(1990, 2, 15))
    assert [f.search_key for f in got[0].facts] == ["79001234567", "88005553535"]
    assert got[1].birth_date is None and [u.field for u in got[1].unresolved] == ["birth_date"]
    store = Store(spark, str(tmp_path / "store"))
    assert store.commit("c1", verified) == {"duplicate": 0, "new_rows": 4, "observations": 2, "present": 0}
    assert store.commit("c1", verified)["duplicate"] == 1
    assert store.commit("c2", verified) == {"duplicate": 0, "new_rows": 0, "observations": 0, "present": 4}
    assert [(r.saved, r.no_facts, r.errors, r.confirmed) for r in store.progress().collect()] == [(2, 1, 1, 4)]
    assert len(list((tmp_path / "store/row_outcomes").glob("bucket=*"))) == 1
    (tmp_path / "store/commit_log/part-broken.parquet").write_bytes(b"not parquet")
    with pytest.raises(Exception):
        store.commit("c3", verified)
    (tmp_path / "store/commit_log/part-broken.parquet").unlink()
    people = store.read("person_facts")
    assert search.with_identifier(people, store.read("fact_values"), "7 (900) 123 45 67").count() == 1
    assert search.with_identifier(people, store.read("fact_values"), "88005", "phone", prefix=True).count() == 1
    store.rebuild_search(str(tmp_path / "docs"))
    same = [d.select("person_fact_id", "all_text").orderBy("person_fact_id").collect() for d in (store.read("search_docs"), spark.read.parquet(str(tmp_path / "docs")))]
    assert same[0] == same[1] and len(same[0]) == 2
    lines = tmp_path / "lines.txt"
    lines.write_text("\n".join(f"l{i}" for i in range(1, 501)))
    assert all(r.value == f"l{r.ordinal}" for r in numbered_lines(spark, str(lines)).collect())


def test_stream_commits_once(spark, tmp_path):
    schema = "file_id string, extraction_version string, ordinal long, c0 string"
    source, store = str(tmp_path / "src"), Store(spark, str(tmp_path / "store"))

    def shape(df):
        fields = F.array(F.struct(F.lit("ФИО").alias("name"), F.col("c0").alias("value")))
        return extract.verify(extract.extract_by_columns(df.withColumn("fields", fields)), F.lit("2024-01-01").cast("date"))

    for k in range(2):
        spark.createDataFrame([("f", "v", 10 * k + i, "Тестов Иван") for i in range(1, 4)], schema).coalesce(1).write.mode("append").parquet(source)
        ingest_stream(spark, source, schema, shape, store, str(tmp_path / "check")).awaitTermination()
    assert store.read("row_outcomes").count() == 6 and store.read("person_facts").count() == 6
    assert store.read("commit_log").count() == 2


@pytest.mark.parametrize("batches", [1, 2])
def test_files_with_equal_ordinals(spark, tmp_path, batches):
    schema = "file_id string, extraction_version string, ordinal long, c0 string, c1 string"
    source, store = str(tmp_path / "src"), Store(spark, str(tmp_path / "store"))

    def shape(df):
        fields = F.array(*[F.struct(F.lit(n).alias("name"), F.col(c).alias("value")) for n, c in (("ФИО", "c0"), ("Телефон", "c1"))])
        return extract.verify(extract.extract_by_columns(df.withColumn("fields", fields)), F.lit("2024-01-01").cast("date"))

    files = [[(f, v, i, "Тестов Иван", f"+7 900 123-45-{k}{i}") for i in range(1, 4)] for k, (f, v) in enumerate([("b", "v"), ("a", "v"), ("a", "w")], 1)]
    for part in [sum(files, [])] if batches == 1 else [files[0], files[1] + files[2]]:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
        ingest_stream(spark, source, schema, shape, store, str(tmp_path / "check")).awaitTermination()
    people = store.read("person_facts").select("id", "file_id", "extraction_version", "ordinal")
    assert people.select("id").distinct().count() == people.count() == store.read("search_docs").count() == store.read("row_outcomes").count() == 9
    said = people.join(store.read("fact_values"), F.col("id") == F.col("person_fact_id")).select("file_id", "extraction_version", "ordinal", "normalized_value")
    assert sorted(map(tuple, said.collect())) == sorted((f, v, i, p.translate({ord(c): None for c in "+- "})) for part in files for f, v, i, _, p in part)
    assert store.read("sources").count() == store.read("sources").select("source_key").distinct().count() == 3


def test_batches_of_a_hot_group(spark):
    rows = spark.range(60000).select(F.when(F.col("id") % 3 > 0, F.col("id") % 50).alias("g"), F.col("id").alias("at"), F.when(F.col("id") % 11 > 0, F.col("id") * 7919 % 300).alias("w"))
    made = batching.greedy_batches(rows, ["g"], "at", F.col("w"), 4, 500)
    assert "collect_list" not in made._jdf.queryExecution().toString()
    want, state = [], {}
    for g, at, w in sorted(map(tuple, rows.collect()), key=lambda r: r[1]):
        batch, n, total = state.get(g, (0, 0, 0))
        both = None if w is None or total is None else total + w
        full = n and (n + 1 > 4 or both is not None and both > 500)
        state[g] = (batch + 1, 1, w) if full else (batch, n + 1, both)
        want.append((g, at, state[g][0]))
    assert sorted(map(tuple, made.collect()), key=lambda r: r[1]) == want


@pytest.mark.parametrize("few", [20_000, 0])
def test_big_files_are_split(spark, tmp_path, monkeypatch, few):
    monkeypatch.setattr(source_records, "FEW_FILES", few)
    made = {
        "d": (Structure("delimited", quote=None), "x;Имя\r\n1;a\r\n \r\n;\n1\n\"q;b\n" + "7;ж\n" * 900),
        "n": (Structure("delimited", quote=None, has_header=False, skip_rows=2), "no\n\n\n1;2\n3;4;5\n" + "7;8\n" * 900),
        "f": (Structure("fixed_width", widths=(5, 4)), "Имя  Год\nИван 1990\n\nАнна 1991 и далее\n" + "Олег 2000\n" * 900),
        "j": (Structure("jsonl", skip_rows=1), '{"a":0}\n{"a":\r1}\r\n\n[1]\n{\n' + '{"a":"ж"}\n' * 900),
        "q": (Structure("delimited"), 'x;y\n"1\n2";3\n' + "7;ж\n" * 900),
        "x": (Structure("xml", record_path="/e/r"), "<e>" + "<r><n>A</n></r>" * 900 + "</e>"),
    }
    named = {"utf-8": "utf-8", "cp1251": "windows-1251", "utf-16": "utf-16-le"}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else joins of a few rows end in one partition
    try:
        for name, (s, text) in made.items():
            for code in {"d": ("utf-8", "cp1251", "utf-16"), "f": ("cp1251",), "q": ("cp1251",)}.get(name, ("utf-8",)):
                file = tmp_path / f"{name} {code}" / "a b.txt"
                file.parent.mkdir()
                file.write_bytes(text.encode(code))
                got = read_records(spark, str(file.parent), s, after=1)
                rows = sorted((r.ordinal, r.line, r.end_line, [tuple(x) for x in r.fields], r.error and tuple(r.error)) for r in got.withColumn("part", F.spark_partition_id()).collect())
                assert rows == [(n, r.line, r.end_line, r.fields, r.error) for n, r in enumerate(parse(file.read_bytes(), s if name == "x" else replace(s, encoding=named[code])), 1) if n > 1], (name, code)
                if name in "dnfj" and code != "utf-16" and few:
                    assert got.where("ordinal > 1").select(F.spark_partition_id().alias("p")).distinct().count() > 2
                assert got.select("file_id").distinct().first()[0] == f"file:{file}"
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_helpers(spark):
    assert batching.backoff_seconds(3, 0.5) == 2.0 and batching.backoff_seconds(9, 1.0, retry_after=7.0) == 7.0
    assert spark.range(1).select(F.round(batching.calibrated(F.array(F.lit(2.0), F.lit(9.0))), 3)).first()[0] == 2.5
    assert spark.range(1).select(records.file_code(F.lit("p"), F.lit("h"))).first()[0].startswith("T_")


def test_cards_places_and_stored_index(spark, tmp_path):
    people = spark.createDataFrame([(1, "Тестов", datetime.date(1990, 2, 15), b"\x01\xff", "Тверь"), (2, "Петров", None, None, "!!! 12")], "id long, surname string, birth_date date, mark binary, birth_place string")
    docs = spark.createDataFrame([(1, "тестов тверь"), (2, "петров 12")], "person_fact_id long, all_text string")
    shown = {(r.table, r.field): r.value for r in search.card(people, docs, "id", 1).collect()}
    assert shown["person_facts", "birth_date"] == "15.02.1990" and shown["person_facts", "mark"] == "0x01FF" and shown["search_docs", "all_text"] == "тестов тверь"
    joined = people.join(docs, people.id == docs.person_fact_id)
    found, notice = search.place_search(joined, "birth_place", "all_text", "Тверь")
    assert [r.id for r in found.collect()] == [1] and notice is None
    found, notice = search.place_search(joined, "birth_place", "all_text", "!!!")
    assert [r.id for r in found.collect()] == [2] and notice
    path = str(tmp_path / "index")
    search.write_token_index(search.token_index(docs, "person_fact_id", "all_text"), path, 8)
    for words, want in (("тестов тверь", [1]), ("тест*", [1]), ("12", [2])):
        query = search.compile_query(words)
        assert [r.id for r in search.index_search(search.read_token_index(spark, path, query, 8), query, 2).collect()] == want
    with pytest.raises(search.SearchError):
        search.index_search(docs, search.compile_query('"тестов тверь"'), 2)


def test_answers(spark):
    said = ["```json\n[{\"source_row_id\":\"1\",\"persons\":[null,{\"surname\":\"Ann\"}]}]\n```", '{"rows":[{"source_row_id":"2","status":"no_facts"}]}', "no json"]
    got = [r[0] for r in spark.createDataFrame([(s,) for s in said], "a string").select(extract.parse_answer(F.col("a"))).collect()]
    assert got[0][0].persons[1].surname == "Ann" and got[1][0].status == "no_facts" and not got[2]
