"""Positions, extension points, element paths, alignment, retries, migrations and observed figures."""

import json
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from rowfacts.operators import audit, checks, extract
from rowfacts.operators.align import aligned, column_union
from rowfacts.operators.commit import Store
from rowfacts.operators.migrate import Step, migrate, migration_plan
from rowfacts.operators.retry import split_and_retry
from rowfacts.plans import extensions, positions, search
from rowfacts.plans.positions import PositionIndex, write_index
from rowfacts.sources.element_paths import element_paths
from rowfacts.sources.metrics import observed
from rowfacts.sources.records import flatten, read_records
from rowfacts.sources.structure import Structure


def test_positions_equal_the_search_of_texts(spark, tmp_path):
    rng = random.Random(6)
    words = ["ab", "abc", "b", "Ba", "c-d", "ё", "99", "a.b"]
    docs = spark.createDataFrame([(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 30)))) for i in range(120)] + [(500, None), (501, "")], "id long, text string")
    write_index(docs, "id", "text", str(tmp_path / "index"), folders=8)
    index = PositionIndex(spark, str(tmp_path / "index"), folders=8)
    queries = [("ab", "all"), ("ab*", "all"), ("b ba", "all"), ("b 99", "any"), ('"b ba"', "all"), ('"ab b ba" ё', "any"), ("ab abc", "phrase"), ('"b b" b', "all"), ("c-d", "all"), ("a.b*", "all"), ("nothing", "all"), ('"b ab*"', "all")]
    for text, mode in queries:
        query = search.compile_query(text, mode)
        expected = sorted((r.id, r.rank) for r in search.text_search(docs, "text", query).collect())
        assert sorted((r.id, r.rank) for r in index.search(query).collect()) == expected, text
        assert index.count(query) == len(expected)
    plan = index.postings(search.compile_query("ab"))._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(folder" in plan and "EqualTo(token,ab)" in plan


def test_stored_postings_are_blocks(spark, tmp_path, monkeypatch):
    texts = ["of the", "the", None, "", "- of: THE of  the!", "ё-9"] * 50
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(2)
    write_index(docs, "id", "text", str(tmp_path / "index"), folders=4)
    stored = spark.read.parquet(str(tmp_path / "index/postings"))
    assert stored.where("token = 'the'").count() <= 2  # a row a step, not a row a text
    index = PositionIndex(spark, str(tmp_path / "index"), folders=4)
    found = {(r.id, tuple(r.positions)) for r in index.postings(search.compile_query("the")).collect()}
    assert found == {(i, at) for i, t in enumerate(texts) if (at := {"of the": (1,), "the": (0,)}.get(t, (1, 3) if t and "THE" in t else ()))}
    assert index.count(search.compile_query("the")) == 150 and index.count(search.compile_query("of the", "phrase")) == 100
    monkeypatch.setattr(positions, "STEP_WORDS", 9)
    monkeypatch.setattr(positions, "BLOCK_TEXTS", 2)
    rows = pa.RecordBatch.from_pydict({"id": list(range(9)), "words": ["a b a", None, "", " ", " a ", "b a", "a", "b", "a " * 20]})
    blocks = [r for b in positions._gather([rows]) for r in b.to_pylist()]
    assert all(len(r["ids"]) == len(r["ends"]) + 1 <= 2 for r in blocks)
    read = sorted((r["token"], i, tuple(r["positions"][a:z])) for r in blocks for i, a, z in zip(r["ids"], [0, *r["ends"]], [*r["ends"], len(r["positions"])], strict=True))
    assert read == [("a", 0, (0, 2)), ("a", 4, (0,)), ("a", 5, (1,)), ("a", 6, (0,)), ("a", 8, tuple(range(20))), ("b", 0, (1,)), ("b", 5, (0,)), ("b", 7, (0,))]


def test_extractors_and_parsers(spark, tmp_path):
    def two(fields):
        for word in dict(fields).get("names", "").split():
            yield {"surname": word, "name": "Ann", "candidates": [{"type": "document", "value": word}]}

    extensions.register_extractor(spark, "names_of", two)
    records = spark.createDataFrame([(1, [("names", "Bell Cook"), ("more", "Ann")]), (2, [("names", "")]), (3, [])], "ordinal long, fields array<struct<name:string,value:string>>")
    found = extensions.extract_with(records, "names_of")
    assert sorted((r.ordinal, r.person_index, r.person and r.person.surname, len(r.candidates)) for r in found.collect()) == [(1, 0, "Bell", 1), (1, 1, "Cook", 1), (2, 0, None, 0), (3, 0, None, 0)]
    verified = extract.verify(found, F.lit("2024-01-01").cast("date")).orderBy("ordinal", "person_index").collect()
    assert [(r.surname, r.outcome) for r in verified] == [("Bell", 1), ("Cook", 1), (None, 2), (None, 2)]
    records.createOrReplaceTempView("some_records")
    assert spark.sql("SELECT ordinal, n.person.surname FROM some_records, LATERAL names_of(fields) AS n WHERE n.person IS NOT NULL").count() == 2
    assert "person" in extensions.extract_with(records).columns
    with pytest.raises(KeyError):
        extensions.extract_with(records, "unknown")
    (tmp_path / "a.txt").write_text("x\ny\n")

    def lines(file):
        with open(file.removeprefix("file:")) as f:
            for n, line in enumerate(f, 1):
                yield {"line": n, "end_line": n, "fields": [("line", line.strip())]}

    extensions.register_parser(spark, "by_line", lines)
    files = spark.createDataFrame([(f"file:{tmp_path}/a.txt",)], "file_id string")
    assert [(r.ordinal, r.fields[0].value) for r in extensions.parse_with(files, "by_line").orderBy("ordinal").collect()] == [(1, "x"), (2, "y")]


def test_element_paths(spark, tmp_path):
    (tmp_path / "a.xml").write_text("<e xmlns:p='u'><p:r><n/><n/></p:r><r/><r/></e>")
    (tmp_path / "b.xml").write_text("<e><r></e>")
    (tmp_path / "c.xml").write_text("<!DOCTYPE e [<!ENTITY x 'y'>]><e><r/></e>")
    found = element_paths(spark, str(tmp_path))
    assert sorted((r.file_id[-5:], r.path, r.n) for r in found.collect()) == [("a.xml", "e", 1), ("a.xml", "e/r", 3), ("a.xml", "e/r/n", 2), ("b.xml", "e", 1), ("b.xml", "e/r", 1)]
    assert [(r.path, r.n) for r in checks.record_path(found, "file_id", "path", "n").collect()] == [("e/r", 3)]
    assert spark.sql(f"SELECT * FROM element_paths('file:{tmp_path}/a.xml')").count() == 3


def test_aligned(spark):
    rows = [(2, [("b", "1"), ("a", None)]), (1, [("c", "x")]), (3, []), (4, [("a", "2"), ("d", "3"), ("c", "4")])]
    records = spark.createDataFrame(rows, "ordinal long, fields array<struct<name:string,value:string>>")
    made, names = aligned(records, ["ordinal"])
    assert names == ["c", "b", "a", "d"]
    assert {r.ordinal: r["values"] for r in made.collect()} == {1: ["x", None, None, None], 2: [None, "1", None, None], 3: [None] * 4, 4: ["4", None, "2", "3"]}
    assert aligned(records.limit(0), ["ordinal"])[1] == []
    with pytest.raises(ValueError):
        column_union(records, ["ordinal"], most=2)


def test_flattened_names_stay_apart():
    names = [n for n, _ in flatten(json.loads('{"a.b": 1, "a": {"b": 2}, "a.b (2)": 3}'))]
    assert len(set(names)) == 3 and names[0] == "a.b" and "a.b (2)" in names


def _extract(records, answer, rnd=0, requests=1):
    """The order of calls of split and retry, record by record; ``answer`` gives (code, missing ids)."""
    code, missing = answer(records, rnd)
    halves = [records[: len(records) // 2], records[len(records) // 2 :]] if len(records) > 1 else [records]
    if code in ("record_too_large", "output_truncated"):
        if len(records) == 1:
            return {records[0]: (code, rnd, requests)}
        return {k: v for h in halves for k, v in _extract(h, answer, rnd, requests + 1).items()}
    if code:
        if rnd >= 2:
            return {r: (code, rnd, requests) for r in records}
        return {k: v for h in halves for k, v in _extract(h, answer, rnd + 1, requests + 1).items()}
    out = {r: (None, rnd, requests) for r in records if r not in missing}
    left = [r for r in records if r in missing]
    if left:
        out |= {r: ("missing_result", rnd, requests) for r in left} if rnd >= 2 else _extract(left, answer, rnd + 1, requests + 1)
    return out


def test_split_and_retry(spark, tmp_path):
    rng = random.Random(1)
    weight = {i: rng.choice([1, 1, 2, 9]) for i in range(90)}
    lost = {i: rng.choice([0, 0, 1, 2, 3]) for i in range(90)}  # rounds in which a record is not answered
    bad = {i: rng.choice([0, 0, 0, 0, 1, 3]) for i in range(90)}  # rounds in which its batch is invalid

    def answer(records, rnd):
        if sum(weight[r] for r in records) > 8:
            return "record_too_large", ()
        if any(bad[r] > rnd for r in records):
            return "invalid_response", ()
        return None, {r for r in records if lost[r] > rnd}

    def ask(rows):
        part = rows.groupBy("_part").agg(F.sum("weight").alias("w"), F.max((F.col("bad") > F.col("_round")).cast("int")).alias("b"))
        code = F.when(F.col("w") > 8, "record_too_large").when(F.col("b") == 1, "invalid_response")
        return rows.join(part, "_part").withColumns({"_code": code, "_missing": F.col("lost") > F.col("_round")}).drop("w", "b")

    rows = spark.createDataFrame([("f", i // 13, i, weight[i], lost[i], bad[i]) for i in range(90)], "file string, batch int, id long, weight int, lost int, bad int")
    found = {r.id: (r.code, r["round"], r.requests) for r in split_and_retry(rows, ["file"], "batch", "id", ask).collect()}
    expected = {}
    for b in range(7):
        expected |= _extract([i for i in range(90) if i // 13 == b], answer)
    assert found == expected and len({c for c, _, _ in found.values()}) == 4


def test_migrations(spark, tmp_path):
    old = Store(spark, str(tmp_path))
    old.append("person_facts", spark.createDataFrame([("1", "a", "f")], "id string, surname string, file_id string"))
    steps = [Step(1, "person_facts", "reviewed", "boolean"), Step(2, "person_facts", "note", "string")]
    store, n = migrate(spark, str(tmp_path), steps, {"person_facts": {"note": "col_note"}})
    assert n == 2 and [r.version for r in migration_plan(spark, str(tmp_path), steps).collect()] == []
    store.append("person_facts", spark.createDataFrame([("2", "b", "f", True, "n")], "id string, surname string, file_id string, reviewed boolean, note string"))
    assert sorted((r.id, r.surname, r.reviewed, r.note) for r in store.read("person_facts").collect()) == [("1", "a", None, None), ("2", "b", True, "n")]
    assert "col_note" in {c for f in (tmp_path / "person_facts").rglob("*.parquet") for c in spark.read.parquet(str(f)).columns}
    again, n = migrate(spark, str(tmp_path), steps, {"person_facts": {"note": "col_note"}})
    assert n == 0 and again.read("person_facts").count() == 2
    for wrong in (Step(3, "nothing", "x", "int"), Step(3, "person_facts", "Note", "int"), Step(0, "person_facts", "x", "int")):
        with pytest.raises(ValueError):
            migrate(spark, str(tmp_path), [*steps, wrong])
    assert migration_plan(spark, str(tmp_path), [*steps, Step(3, "search_docs", "x", "int")]).collect()[0].version == 3


def test_observed(spark, tmp_path):
    (tmp_path / "a.jsonl").write_bytes(b'{"a":"x"}\n{"a":"\xff\xffyz"}\n{\n{"a":" "}\n{"a":null}\n')
    rows, figures = observed(read_records(spark, str(tmp_path), Structure("jsonl", encoding="utf-8")), "r", after=1)
    assert rows.count() == 4 and rows.agg(F.min("ordinal")).first()[0] == 2
    rows, figures = observed(read_records(spark, str(tmp_path), Structure("jsonl", encoding="utf-8")), "s", after=1)
    rows.write.format("noop").mode("overwrite").save()
    assert figures.get == {"skipped": 1, "emitted": 4, "bad": 1, "blank": 2, "replaced": 2, "characters": 5}
    rows, figures = observed(read_records(spark, str(tmp_path), Structure("jsonl", encoding="utf-8")).limit(0), "t")
    rows.write.format("noop").mode("overwrite").save()
    assert figures.get["emitted"] == 0


def test_people_search(spark):
    people = spark.createDataFrame([(1, "A"), (2, "B"), (3, "C")], "id long, surname string")
    docs = spark.createDataFrame([(1, "red apple red"), (2, "red"), (3, "blue")], "person_fact_id long, all_text string")
    found = search.people_search(people, docs, search.compile_query("red"), F.col("surname") != "B")
    assert [(r.id, r.rank) for r in found.collect()] == [(1, 2)]
    assert search.people_search(people, docs, None, F.col("surname") == "C").first()["rank"] == 0


def test_streaks_and_checkpoints_by_ranges(spark):
    rng = random.Random(9)
    rows = [(g, at, rng.random() < 0.8) for g in ("a", "b", None) for at in rng.sample(range(-50, 400), 250)] + [("c", at, True) for at in range(1, 200)]
    frame = spark.createDataFrame(rows, "g string, at long, bad boolean")
    expected = []
    for g in {r[0] for r in rows}:
        run = []
        for _, at, bad in [*sorted((r for r in rows if r[0] == g), key=lambda r: r[1]), (g, None, False)]:
            if bad:
                run.append(at)
            else:
                expected += [(g, run[0], run[-1], len(run))] if len(run) >= 4 else []
                run = []
    for width in (1, 7, 64, 1 << 16):
        assert sorted(map(repr, map(tuple, audit.error_streaks(frame, ["g"], "at", F.col("bad"), 4, width).collect()))) == sorted(map(repr, expected))
    rows = [("a", k) for k in range(1, 40)] + [("a", 44)] + [("b", 2)] + [("c", k) for k in range(1, 17)] * 2 + [("d", 0), ("d", -3)] + [("e", k) for k in range(1, 30) if k != 9] + [(None, 1)] + [("f", k) for k in range(9, 17)]
    frame = spark.createDataFrame(rows, "g string, at long")
    for width in (1, 4, 8, 1 << 16):
        assert {r.g: r.confirmed for r in audit.contiguous_checkpoint(frame, ["g"], "at", width).collect()} == {"a": 39, "b": 0, "c": 16, "d": 0, "e": 8, None: 1, "f": 0}


def test_records_of_one_row_group_are_verified_by_many_tasks(spark, sf_dir):
    from rowfacts.catalog import document_projection, extract_and_verify

    assert spark.read.parquet(f"{sf_dir}/customer.parquet").rdd.getNumPartitions() == 1
    for query in (extract_and_verify, document_projection):
        assert query(spark, sf_dir).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_detection_gathers_a_row_a_file(spark):
    rng = random.Random(5)
    rows = [(f, i, "".join(rng.choice(["a", ";", ",", "\t", "|", " "]) for _ in range(rng.randint(0, 6)))) for f in range(300) for i in range(1, 1 + rng.randint(0, 6))]
    lines = spark.createDataFrame(rows, "f int, i int, line string")
    files = spark.range(300).selectExpr("int(id) AS f", "'unknown' AS hint", "string(null) AS binary_kind")
    found = checks.detected(files, lines, "f", "i", "line")
    plan = found._jdf.queryExecution().sparkPlan().toString()
    assert "Generate" not in plan and plan.count("Join") == 1
    guessed = {r.f: r.delimiter for r in checks.delimiter_guess(checks.sample_lines(lines, "f", "i", "line"), "f", "line").collect()}
    filled = {f for f, i, x in rows if i <= 5 and x.strip(" ")}
    for r in found.collect():
        assert r.delimiter == guessed.get(r.f) and (r.reason == "empty") == (r.f not in filled)


def test_the_task_that_writes_the_measured_file_sorts_nothing(spark, monkeypatch):
    from rowfacts.catalog import queries

    plans, coalesce = [], type(spark.range(0)).coalesce

    def noted(self, n):
        plans.append(self._jdf.queryExecution().sparkPlan().toString())
        return coalesce(self, n)

    monkeypatch.setattr(type(spark.range(0)), "coalesce", noted)
    assert queries()["read_metrics"](spark, "/root/testdata/sf0.001").first().skipped == 100
    assert len(plans) == 1 and "Sort" not in plans[0]
