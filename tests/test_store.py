"""Commits of several persons, progress from deltas, deletes, swaps and schema changes."""

import datetime

import pytest
from pyspark.sql import functions as F
from rowfacts.operators import commit, extract
from rowfacts.operators.commit import Store

FACTS = "array<struct<type:string,label:string,value:string,normalized_value:string,source_column:string,evidence:string,search_key:string>>"
SCHEMA = f"file_id string, extraction_version string, ordinal long, person_index int, surname string, name string, patronymic string, birth_date date, birth_place string, facts {FACTS}, unresolved array<struct<field:string,raw_value:string,reason:string>>, identity_status string, outcome int, error struct<code:string,message:string>"


def _row(file, ordinal, person=0, outcome=1, surname="Тестов", phone=None, version="v"):
    facts = [("phone", None, phone, phone, "Телефон", None, phone)] if phone else []
    error = ("invalid_response", "bad") if outcome == 3 else None
    return (file, version, ordinal, person, surname if outcome == 1 and person >= 0 else None, "Иван", None, datetime.date(1990, 2, 15), "Тверь", facts, [], "identified", outcome, error)


def _rows():
    """Record 1 has two persons and loose facts, 2 nothing, 3 an error, 4 one person twice, 5 one person beside one of whom nothing holds."""
    return [
        _row("a", 1, 0, phone="701"), _row("a", 1, 1, surname="Сидоров", phone="702"), _row("a", 1, -1, phone="703"), _row("a", 2, 0, 2), _row("a", 3, 0, 3),
        _row("a", 4, 0, phone="704"), _row("a", 4, 0, phone="704"), _row("a", 5, 0), _row("a", 5, 1, 2), _row("b", 1, 2000, phone="701"), _row("b", 1 << 40, 0), _row(None, 1, 0),
    ]


def _content(store):
    """All rows of the store's tables but the log, by name."""
    return {n: sorted(map(repr, store.read(n).drop("commit_id").collect())) for n in commit.TABLES if n not in ("commit_log", "deleted")}


def test_several_persons_and_replays(spark, tmp_path):
    store, rows = Store(spark, str(tmp_path / "s")), spark.createDataFrame(_rows(), SCHEMA)
    assert store.commit("c1", rows, requests=2, job_id="j", input_tokens=10) == {"duplicate": 0, "new_rows": 8, "observations": 8, "present": 0}
    people = store.read("person_facts").orderBy("id").collect()
    assert [(r.file_id, r.ordinal, r.person_index) for r in people if r.file_id == "a"] == [("a", 1, -1), ("a", 1, 0), ("a", 1, 1), ("a", 4, 0), ("a", 5, 0)]
    assert [(r.ordinal, r.person_index) for r in people if r.file_id == "b"] == [(1, 2000), (1 << 40, 0)]
    assert len({r.id for r in people}) == len(people) == store.read("search_docs").count() == 8
    values = store.read("fact_values").join(store.read("person_facts"), F.col("person_fact_id") == F.col("id"))
    assert sorted((r.file_id, r.ordinal, r.person_index, r.normalized_value) for r in values.collect()) == [("a", 1, -1, "703"), ("a", 1, 0, "701"), ("a", 1, 1, "702"), ("a", 4, 0, "704"), ("b", 1, 2000, "701")]
    assert [(r.stage, r.code) for r in store.read("row_errors").collect()] == [("parse", "invalid_response")]
    assert '"kind":"unassigned"' in people[[(r.file_id, r.person_index) for r in people].index(("a", -1))].all_json and '"source_row_id":"r1"' in people[-1].all_json + people[0].all_json
    before = _content(store)
    assert store.commit("c1", rows)["duplicate"] == 1
    assert store.commit("c2", rows, requests=3, job_id="j", output_tokens=7) == {"duplicate": 0, "new_rows": 0, "observations": 0, "present": 8}
    assert _content(store) == before
    (job,) = store.job_counters().collect()
    assert (job.extracted, job.no_facts, job.errors, job.observations, job.requests, job.input_tokens, job.output_tokens) == (6, 1, 1, 8, 5, 10, 7)
    progress = {r.file_id: r for r in store.progress().collect()}
    assert (progress["a"].confirmed, progress["a"].extracted, progress["a"].no_facts, progress["a"].errors, progress["a"].observations) == (5, 3, 1, 1, 5)
    store.compact_log()
    assert {r.file_id: r for r in store.progress().collect()} == progress and store.job_counters().collect() == [job]
    assert store.commit("c2", rows)["duplicate"] == 1
    more = spark.createDataFrame([_row("a", 6), _row("a", 7, 0, 2)], SCHEMA)
    assert store.commit("c3", more)["new_rows"] == 2
    assert {r.file_id: (r.confirmed, r.extracted) for r in store.progress().collect()}["a"] == (7, 4)
    audited = {r.file_id: (r.saved, r.no_facts, r.errors, r.confirmed) for r in store.audited_progress().collect()}
    assert audited["a"] == (4, 2, 1, 7)


@pytest.fixture(scope="module")
def whole(spark, tmp_path_factory):
    """What the store holds after a commit that didn't die."""
    store = Store(spark, str(tmp_path_factory.mktemp("whole")))
    store.commit("c", spark.createDataFrame(_rows(), SCHEMA), requests=1)
    return _content(store), sorted(map(repr, store.progress().collect()))


@pytest.mark.parametrize(("dies_at", "written"), [("person_facts", False), ("fact_values", True), ("row_outcomes", False), ("commit_log", False)])
def test_commit_that_died_is_completed(spark, tmp_path, monkeypatch, whole, dies_at, written):
    rows = spark.createDataFrame(_rows(), SCHEMA)
    store = Store(spark, str(tmp_path / "s"))
    append = Store.append

    def dying(self, name, made):
        if name == dies_at:
            if written:
                append(self, name, made)
            raise RuntimeError("died")
        append(self, name, made)

    monkeypatch.setattr(Store, "append", dying)
    with pytest.raises(RuntimeError):
        store.commit("c", rows, requests=1)
    monkeypatch.setattr(Store, "append", append)
    store.commit("c", rows, requests=1)
    assert (_content(store), sorted(map(repr, store.progress().collect()))) == whole


def test_deleted_sources(spark, tmp_path, monkeypatch):
    store = Store(spark, str(tmp_path / "s"))
    rows = _rows() + [_row("a", 1, version="w", phone="9")] + [_row(f"f{k}", 1) for k in range(20)]
    store.commit("c", spark.createDataFrame(rows, SCHEMA))
    without = Store(spark, str(tmp_path / "w"))
    without.commit("c", spark.createDataFrame([r for r in rows if not (r[0] == "a" and r[1] == "v")], SCHEMA))
    dying = lambda *a: (_ for _ in ()).throw(RuntimeError("died"))
    rewrite = store.tables.rewrite
    monkeypatch.setattr(store.tables, "rewrite", lambda name, *a: dying() if name == "person_facts" else rewrite(name, *a))
    with pytest.raises(RuntimeError):
        store.delete_source("a", "v")
    assert _content(store) == _content(without)  # no reader sees half of it
    monkeypatch.setattr(store.tables, "rewrite", rewrite)
    store.finish_deletes()
    assert _content(store) == _content(without) and not (tmp_path / "s/deleted").exists()
    assert {r.file_id for r in store.progress().collect()} == {r.file_id for r in without.progress().collect()}
    for name in ("person_facts", "search_docs", "fact_values", "row_outcomes"):  # gone from the files too
        assert store.tables.read(name).count() == store.read(name).count()
    assert store.commit("again", spark.createDataFrame([r for r in rows if r[0] == "a" and r[1] == "v"], SCHEMA))["observations"] == 5
    store.delete_source("a")
    assert store.read("person_facts").where("file_id = 'a'").count() == 0


def test_swapped_projection(spark, tmp_path, monkeypatch):
    store = Store(spark, str(tmp_path / "s"))
    store.commit("c", spark.createDataFrame(_rows(), SCHEMA))
    before = sorted(map(repr, store.read("search_docs").collect()))
    failing = F.udf(lambda x: 1 / 0, "string")
    good = store.projected()
    monkeypatch.setattr(store, "projected", lambda: good.withColumn("all_text", failing("all_text")))
    with pytest.raises(Exception):
        store.rebuild_search()
    assert store.tables.version("search_docs") == 0 and sorted(map(repr, store.read("search_docs").collect())) == before
    monkeypatch.undo()
    store.rebuild_search()
    assert store.tables.version("search_docs") == 1 and sorted(map(repr, store.read("search_docs").collect())) == before
    store.commit("d", spark.createDataFrame([_row("z", 1)], SCHEMA))
    assert store.read("search_docs").count() == len(before) + 1
    store.tables.vacuum("search_docs")
    assert store.read("search_docs").count() == len(before) + 1


def test_verified_answers_are_stored_whole(spark, tmp_path):
    record = spark.createDataFrame([("f", "v", 1, "Иванов Иван; Сидоров Пётр; тел. +7 900 1112233")], "file_id string, extraction_version string, ordinal long, text string")
    record = record.select("file_id", "extraction_version", "ordinal", F.array(F.struct(F.lit("Строка").alias("name"), F.col("text").alias("value"))).alias("fields"))
    answer = '[{"source_row_id":"1","persons":[{"surname":"Иванов","name":"Иван"},{"surname":"Сидоров","name":"Пётр"},{"surname":"Никто"}],"unassigned_facts":[{"type":"phone","value":"+7 900 1112233"}]}]'
    answers = spark.range(1).select(F.explode(extract.parse_answer(F.lit(answer))).alias("a")).select(F.col("a.source_row_id").cast("long").alias("ordinal"), "a.persons", "a.unassigned_facts")
    verified = extract.verify_answers(record, answers, F.lit("2024-01-01").cast("date"), "ordinal")
    expected = verified.where("outcome = 1").count()
    store = Store(spark, str(tmp_path / "s"))
    assert store.commit("c", verified)["observations"] == expected == 3
    assert sorted(r.surname or "" for r in store.read("person_facts").collect()) == ["", "Иванов", "Сидоров"]


def test_persons_are_moved_once_by_a_commit(spark, tmp_path, monkeypatch):
    """All tables of persons get them from files of one bucket each: none is dealt by bucket again."""
    store, plans = Store(spark, str(tmp_path / "s")), {}
    append = Store.append
    monkeypatch.setattr(Store, "append", lambda self, name, made: plans.update({name: made}) or append(self, name, made))
    store.commit("c", spark.createDataFrame(_rows(), SCHEMA))
    for name in ("person_facts", "search_docs", "fact_values"):
        plan = plans[name]._jdf.queryExecution().executedPlan().toString()
        assert "bucket" in plans[name].columns and "Exchange" not in plan and "Join" not in plan
