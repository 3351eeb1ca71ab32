"""Deterministic extraction by column name, and verification of candidates against their record.

Candidates have the shape of a model's answer, so ``verify`` serves any extractor.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import parse_date, with_birth_date
from ..functions.identifiers import CODE_LIKE, corrected_type, known_type, search_key, stored_form
from ..functions.records import evidence_text
from ..functions.text import all_words_present, alnum_lower, blank_to_null, collapse_spaces, contains_alnum, contains_fragment, normalize_text, plausible_variant, strip_code_fence, words

# Parts of column names (lower case) that say what a column holds, first match first.
NAME_COLUMNS = ("фио", "full name", "fullname", "клиент", "владелец", "заявитель", "customer", "c_name")
PART_COLUMNS = {"surname": ("фамилия", "surname", "last_name", "lastname"), "name": ("имя", "first_name", "firstname"), "patronymic": ("отчество", "middle_name", "patronymic")}
BIRTH_DATE, BIRTH_PLACE = ("дата рожд", "birth_date", "dateofbirth", "birthdate"), ("место рожд", "birth_place")
FACT_COLUMNS = {
    "phone": ("телефон", "phone"),
    "email": ("mail", "почта"),
    "address": ("адрес", "address"),
    "workplace": ("организац", "место работы", "organization"),
    "position": ("должность", "position"),
    "license_plate": ("госномер", "plate"),
    "vin": ("vin",),
    "bank_account": ("номер счёта", "счет", "account"),
    "bank_card": ("карта", "card"),
    "document": ("паспорт", "passport"),
    "inn": ("инн",),
    "snils": ("снилс",),
    "website": ("сайт", "website", "url"),
}
LIMITS = {"surname": 200, "name": 200, "patronymic": 200, "birth_place": 1000}
LONGEST_FACT = 4000
CANDIDATE_FACT = "struct<type:string,label:string,value:string,source_column:string,evidence:string>"


def _is(low: Column, parts: tuple[str, ...]) -> Column:
    """Whether a name, in lower case, has one of the parts."""
    some = F.contains(low, F.lit(parts[0]))
    for p in parts[1:]:
        some = some | F.contains(low, F.lit(p))
    return some


def _first(lowered: Column, parts: tuple[str, ...]) -> Column:
    return blank_to_null(F.try_element_at(F.filter(lowered, lambda f: _is(f["low"], parts)), F.lit(1))["value"])


def fact_kind(low: Column) -> Column:
    """The fact type that a column's name, in lower case, stands for, or null."""
    chain = F
    for type_, names in FACT_COLUMNS.items():
        chain = chain.when(_is(low, names), type_)
    return chain


#: Tasks over which records are dealt at least; each has to set up the long expressions for itself.
LEAST_TASKS = 24


def spread(records: DataFrame) -> DataFrame:
    """``records`` dealt over all cores: a file of one row group is one task, and to extract from a record and verify it takes far longer than to move it."""
    return records.repartition(max(3 * records.sparkSession.sparkContext.defaultParallelism, LEAST_TASKS))


def extract_by_columns(records: DataFrame, fields: str = "fields") -> DataFrame:
    """``records`` with person and candidate facts read off the columns' names.

    A full name is surname, name and patronymic by position; a cell of several phones is split.
    """
    # In steps: names are put in lower case once a field, and a cell that several parts need is found once a record.
    lowered = F.transform(F.col(fields), lambda x: F.struct(x["name"].alias("name"), x["value"].alias("value"), F.lower(x["name"]).alias("low")))
    base = records.withColumn("_low", lowered)
    cells = {f"_{p}": _first(F.col("_low"), c) for p, c in PART_COLUMNS.items()}
    base = base.withColumns(cells | {"_full": F.split(collapse_spaces(_first(F.col("_low"), NAME_COLUMNS)), " "), "_raw": _first(F.col("_low"), BIRTH_DATE), "_place": _first(F.col("_low"), BIRTH_PLACE)})
    parts = {p: F.coalesce(F.col(f"_{p}"), F.try_element_at("_full", F.lit(i))) for i, p in enumerate(PART_COLUMNS, 1)}
    raw_date = F.col("_raw")
    # Formats are told before they are parsed: a date that does not parse costs an exception.
    iso = F.when(raw_date.rlike(r"^[+-]?\d{4,}-\d{2}-\d{2}$"), parse_date(raw_date, "yyyy-MM-dd"))
    date = F.coalesce(iso, F.when(raw_date.rlike(r"^\d{1,2}\.\d{1,2}\.\d{4}$"), parse_date(raw_date, "d.M.yyyy")))
    person = F.struct(*[parts[p].alias(p) for p in parts], F.date_format(date, "yyyy-MM-dd").alias("birth_date"), raw_date.alias("birth_evidence"), F.col("_place").alias("birth_place"))

    def candidates(x: Column) -> Column:
        values = F.when(x["kind"] == "phone", F.split(x["value"], "[,;]")).otherwise(F.array(x["value"]))
        return F.transform(F.transform(values, lambda v: F.trim(v)), lambda v: F.struct(x["kind"].alias("type"), F.lit(None).cast("string").alias("label"), v.alias("value"), x["name"].alias("source_column"), v.alias("evidence")))

    kinds = F.filter(F.transform("_low", lambda x: F.struct(x["name"].alias("name"), x["value"].alias("value"), fact_kind(x["low"]).alias("kind"))), lambda x: x["kind"].isNotNull())
    facts = F.filter(F.flatten(F.transform(kinds, candidates)), lambda c: F.length(c["value"]) > 0)
    return base.withColumns({"person": person, "candidates": facts}).drop("_low", *cells, "_full", "_raw", "_place")


def verify(records: DataFrame, today: Column, fields: str = "fields") -> DataFrame:
    """``records`` (with person and candidates) plus what their own text confirms.

    Adds surname, name, patronymic, birth_date, birth_place, facts, rejected, unresolved,
    identity_status and outcome (1 extracted, 2 no facts, 3 error).  Nothing is truncated: a value
    over its limit stays unresolved.  What several tests need is kept in columns of its own, so that
    it is computed once for each record or candidate.
    """
    base = records.withColumn("_said", evidence_text(F.col(fields)))
    base = base.withColumns({"_text": normalize_text(F.col("_said")), "_alnum": alnum_lower(F.col("_said"))} | {f"_{p}": collapse_spaces(F.col(f"person.{p}")) for p in LIMITS})
    base = base.withColumns({"_words": words(F.col("_text"))} | {f"_{p}_n": normalize_text(F.col(f"_{p}")) for p in LIMITS})

    def reason_of(p: str) -> Column:
        clean, plain = F.col(f"_{p}"), F.col(f"_{p}_n")
        held = (F.length(plain) > 0) & F.contains("_text", plain)
        return F.when(F.length(F.coalesce(clean, F.lit(""))) == 0, None).when(~F.coalesce(held, F.lit(False)), "not in the record").when(F.length(clean) > LIMITS[p], "longer than the field")

    base = base.withColumns({f"_{p}_r": reason_of(p) for p in LIMITS})
    base = base.withColumns({p: F.when(F.col(f"_{p}_r").isNull(), blank_to_null(F.col(f"_{p}"))) for p in LIMITS})
    base = with_birth_date(base, F.col("person.birth_date"), F.coalesce(F.col("person.birth_evidence"), F.col("_said")), today, "_birth")
    base = base.withColumn("_mains", F.array(*[F.when(F.col(p).isNotNull(), F.col(f"_{p}_n")).otherwise("") for p in LIMITS]))

    names = ("label", "source_column", "evidence")
    keep = lambda c, *more: [c[n].alias(n) for n in (*names, *more)]
    base = base.withColumn("_c", F.transform("candidates", lambda c: F.struct(*keep(c), F.lower(F.trim(c["type"])).alias("said"), known_type(c["type"]).alias("known"), F.trim(c["value"]).alias("value"))))
    base = base.withColumn("_c", F.transform("_c", lambda c: F.struct(*keep(c, "said", "known", "value"), corrected_type(c["known"], c["value"], c["source_column"]).alias("type"), normalize_text(c["value"]).alias("plain"))))

    def judge(c: Column) -> Column:
        value, evidence, plain = c["value"], c["evidence"], c["plain"]
        held = (F.length(plain) > 0) & F.contains("_text", plain) | (c["type"].isin(*CODE_LIKE) & contains_alnum(F.col("_alnum"), value, 5)) | (contains_fragment(F.col("_text"), evidence) & plausible_variant(value, evidence)) | all_words_present(F.col("_words"), value)
        reason = F.when(F.length(value) > LONGEST_FACT, "longer than a fact").when(~F.coalesce(held, F.lit(False)), "not in the record").when(F.array_contains("_mains", plain), "repeats a main field")
        label = F.coalesce(c["label"], F.when(c["known"] != c["said"], c["said"]))
        return F.struct(c["type"].alias("type"), label.alias("label"), value.alias("value"), stored_form(c["type"], value).alias("normalized_value"), c["source_column"].alias("source_column"), F.when(evidence != value, evidence).alias("evidence"), search_key(c["type"], value).alias("search_key"), plain.alias("plain"), reason.alias("reason"))

    base = base.withColumn("_judged", F.transform("_c", judge))
    base = base.withColumn("_good", F.filter("_judged", lambda j: j["reason"].isNull()))
    base = base.withColumn("_keys", F.transform("_good", lambda j: F.concat(j["type"], F.lit("\u0001"), F.coalesce(j["normalized_value"], j["plain"]))))
    first = F.filter("_good", lambda j, i: F.array_position("_keys", F.get("_keys", i)) == i + 1)
    facts = F.transform(first, lambda j: F.struct(*[j[n].alias(n) for n in ("type", "label", "value", "normalized_value", "source_column", "evidence", "search_key")]))
    rejected = F.transform(F.filter("_judged", lambda j: j["reason"].isNotNull()), lambda j: F.struct(j["type"].alias("name"), j["value"].alias("value"), j["reason"].alias("reason")))
    open_fields = F.array(
        *[F.struct(F.lit(p).alias("field"), F.col(f"person.{p}").alias("raw_value"), F.col(f"_{p}_r").alias("reason")) for p in LIMITS],
        F.struct(F.lit("birth_date").alias("field"), F.col("person.birth_evidence").alias("raw_value"), F.coalesce(F.col("_birth.reason"), F.when(F.col("_birth.date").isNull() & F.col("person.birth_evidence").isNotNull(), F.lit("not a date"))).alias("reason")),
    )
    out = base.withColumns({"birth_date": F.col("_birth.date"), "facts": facts, "rejected": rejected, "unresolved": F.filter(open_fields, lambda u: u["reason"].isNotNull())})
    named = F.col("surname").isNotNull() & F.col("name").isNotNull()
    some = F.coalesce("surname", "name", "patronymic").isNotNull()
    status = F.when(named, "identified").when(some, "partial").otherwise("unresolved")
    failed = F.col("error").isNotNull() if "error" in records.columns else F.lit(False)
    outcome = F.when(failed, 3).when(some | (F.size("facts") > 0) | F.col("birth_date").isNotNull(), 1).otherwise(2)
    made = ("surname", "name", "patronymic", "birth_date", "birth_place", "facts", "rejected", "unresolved")
    return out.select(*records.columns, *made, status.alias("identity_status"), outcome.alias("outcome"))


ANSWER_PERSON = f"struct<surname:string,name:string,patronymic:string,birth_date:string,birth_evidence:string,birth_place:string,facts:array<{CANDIDATE_FACT}>>"
ANSWER_ROW = f"struct<source_row_id:string,status:string,persons:array<{ANSWER_PERSON}>,unassigned_facts:array<{CANDIDATE_FACT}>>"


def parse_answer(text: Column) -> Column:
    """The rows of an answer, an array or an object with rows, in a code fence or not; null where it is no JSON."""
    inside = strip_code_fence(text)
    return F.when(inside.startswith("["), F.from_json(inside, f"array<{ANSWER_ROW}>")).otherwise(F.from_json(inside, f"rows array<{ANSWER_ROW}>")["rows"])


def verify_answers(records: DataFrame, answers: DataFrame, today: Column, id_col: str, fields: str = "fields") -> DataFrame:
    """One row for each verified person of each record, and one of person_index -1 for its facts without a person.

    ``answers`` has id_col, persons and unassigned_facts (``ANSWER_ROW``).  Persons are numbered from 0
    anew in their order, null ones left out; a record whose answer confirms nothing gives one row of
    outcome 2 with index 0; facts without a person that are all rejected give none.
    """
    asked = records.join(answers.select(F.col(id_col).alias("_id"), "persons", "unassigned_facts"), F.col(id_col) == F.col("_id"), "left").drop("_id")
    kept = F.filter(F.coalesce("persons", F.array().cast(f"array<{ANSWER_PERSON}>")), lambda p: p.isNotNull())
    nobody = F.struct(*[F.lit(None).cast("string").alias(n) for n in ("surname", "name", "patronymic", "birth_date", "birth_evidence", "birth_place")], F.coalesce("unassigned_facts", F.array().cast(f"array<{CANDIDATE_FACT}>")).alias("facts"))
    numbered = F.transform(F.concat(F.array(nobody), kept), lambda p, i: F.struct((i - 1).cast("int").alias("i"), p.alias("p")))
    each = asked.select(*records.columns, F.explode(numbered).alias("_p")).select(*records.columns, F.col("_p.i").alias("person_index"), F.col("_p.p").alias("person"), F.coalesce(F.col("_p.p.facts"), F.array().cast(f"array<{CANDIDATE_FACT}>")).alias("candidates"))
    found = verify(each, today, fields)
    # A person of whom nothing holds gets no number; the loose facts keep -1; a record without anything keeps one row.
    holds = (F.col("outcome") == 1) | (F.size("unresolved") > 0) & (F.col("person_index") >= 0)
    by = Window.partitionBy(id_col).orderBy("person_index")
    ranked = found.withColumn("_holds", holds).withColumn("_any", F.max("_holds").over(Window.partitionBy(id_col))).where(F.col("_holds") | ~F.col("_any") & (F.col("person_index") == -1))
    anew = F.when((F.col("person_index") == -1) & F.col("_any"), -1).otherwise(F.count_if((F.col("person_index") >= 0) | ~F.col("_any")).over(by.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    return ranked.withColumn("person_index", anew.cast("int")).drop("_holds", "_any", "person", "candidates")


def match_answers(sent: DataFrame, answered: DataFrame, id_col: str = "source_row_id") -> DataFrame:
    """Each id with its state: ok, missing (to ask again), duplicate (dropped and asked again) or unknown."""
    key = F.lower(F.trim(F.col(id_col)))
    a = answered.groupBy(key.alias("id")).agg(F.count("*").alias("answers"))
    s = sent.select(key.alias("id")).distinct().withColumn("sent", F.lit(True))
    state = F.when(F.col("sent").isNull(), "unknown").when(F.col("answers").isNull(), "missing").when(F.col("answers") > 1, "duplicate").otherwise("ok")
    return s.join(a, "id", "full_outer").select("id", F.coalesce("answers", F.lit(0).cast("long")).alias("answers"), state.alias("state"))
