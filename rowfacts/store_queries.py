"""Registered queries over stored tables, indexes and files that Spark writes from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .catalog import _ORDERS, _ORDERS_SQL, _W, _rank_sql, query, shared_folder, t
from .functions import records
from .operators import audit, batching, checks, contract, extract
from .operators.align import aligned
from .operators.commit import Store
from .operators.migrate import Step, migrate
from .operators.retry import split_and_retry
from .plans import extensions, search
from .plans.positions import PositionIndex, write_index
from .sources.datasource import load_records
from .sources.element_paths import element_paths
from .sources.folders import kind_hint, walk
from .sources.metrics import observed
from .sources.records import read_records
from .sources.samples import sample_files
from .sources.structure import Structure

def _checkpoints(spark) -> None:
    """Sees that checkpoints have a folder."""
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(shared_folder(spark, "rounds"))


# --- commits ------------------------------------------------------------------------------------------------


def verified_lines(spark, sf_dir) -> DataFrame:
    """Orders as records and their lines as persons, in the form that ``verify_answers`` gives: returned lines are facts of nobody, open ones hold nothing."""
    orders = t(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    lines = t(spark, sf_dir, "lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    part, empty = F.col("l_partkey").cast("string"), F.array().cast(records.UNRESOLVED)
    fact = F.struct(F.lit("document").alias("type"), F.lit(None).cast("string").alias("label"), part.alias("value"), part.alias("normalized_value"), F.lit("part").alias("source_column"), F.lit(None).cast("string").alias("evidence"), part.alias("search_key"))
    loose, nothing = F.col("l_returnflag") == "R", F.col("l_linestatus") == "O"
    return lines.select(
        F.col("o_orderpriority").alias("file_id"), F.lit("v1").alias("extraction_version"), F.col("l_orderkey").alias("ordinal"), F.when(loose, -1).otherwise(F.col("l_linenumber")).cast("int").alias("person_index"),
        F.when(~loose, F.concat(F.lit("Part"), part)).alias("surname"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("patronymic"), F.col("l_shipdate").cast("date").alias("birth_date"),
        F.array(fact).alias("facts"), empty.alias("unresolved"), F.lit("partial").alias("identity_status"), F.when(nothing, 2).otherwise(1).alias("outcome"), "l_linestatus",
    )


def _store(spark, sf_dir, *more: str) -> Store:
    """A store with all persons; ``more``: the orders with finished lines committed before, a replay, the same rows under another id."""
    rows = verified_lines(spark, sf_dir)
    store = Store(spark, shared_folder(spark, "store"))
    if "before" in more:
        store.commit("finished", rows.where("l_linestatus = 'F'"), requests=3, job_id="one", input_tokens=100)
    store.commit("all", rows, requests=4, job_id="one", output_tokens=20)
    if "replay" in more:
        store.commit("all", rows, requests=9, job_id="one")
    if "again" in more:
        store.commit("again", rows, requests=5, job_id="two")
    return store


_PEOPLE = """WITH x AS (SELECT DISTINCT o_orderpriority AS file_id, l_orderkey AS ordinal, CASE WHEN l_returnflag = 'R' THEN -1 ELSE l_linenumber END AS person_index, l_linestatus
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
    p AS (SELECT file_id, ordinal, person_index FROM x WHERE l_linestatus = 'F'), r AS (SELECT DISTINCT file_id, ordinal FROM x)"""


@query(
    f"""{_PEOPLE} SELECT r.file_id, ordinal, count(person_index) AS persons, count(person_index) FILTER (person_index < 0) AS loose, count(person_index) AS documents, count(person_index) AS fact_values,
    CASE WHEN count(person_index) > 0 THEN 1 ELSE 2 END AS outcome, count(person_index) AS observations FROM r LEFT JOIN p USING (file_id, ordinal) GROUP BY ALL"""
)
def commit_persons(spark, sf_dir):
    """Persons stored of each record, with their documents and values, after overlapping commits and a replay."""
    store = _store(spark, sf_dir, "before", "replay")
    people = store.read("person_facts").select("id", "file_id", "ordinal", "person_index")
    docs = store.read("search_docs").groupBy(F.col("person_fact_id").alias("id")).agg(F.count("*").alias("docs"))
    values = store.read("fact_values").groupBy(F.col("person_fact_id").alias("id")).agg(F.count("*").alias("n_values"))
    stored = people.join(docs, "id", "left").join(values, "id", "left").groupBy("file_id", "ordinal").agg(
        F.count("*").alias("persons"), F.count_if(F.col("person_index") < 0).alias("loose"), F.sum("docs").alias("documents"), F.sum("n_values").alias("fact_values")
    )
    none = {c: F.coalesce(c, F.lit(0).cast("long")) for c in ("persons", "loose", "documents", "fact_values")}
    return store.read("row_outcomes").select("file_id", "ordinal", "outcome", "observations").join(stored, ["file_id", "ordinal"], "left").withColumns(none)


@query(
    f"""{_PEOPLE}, o AS (SELECT r.file_id, ordinal, count(person_index) AS n FROM r LEFT JOIN p USING (file_id, ordinal) GROUP BY ALL)
    SELECT file_id, max(ordinal) AS confirmed, count(*) FILTER (n > 0) AS extracted, count(*) FILTER (n = 0) AS no_facts, 0::BIGINT AS errors, sum(n)::BIGINT AS observations FROM o GROUP BY file_id"""
)
def commit_progress(spark, sf_dir):
    """Progress of each file, folded from the log of the commits and compacted."""
    store = _store(spark, sf_dir, "before")
    store.compact_log()
    return store.progress().select("file_id", "confirmed", "extracted", "no_facts", "errors", "observations")


@query(
    f"""{_PEOPLE}, o AS (SELECT ordinal, count(person_index) AS n FROM r LEFT JOIN p USING (file_id, ordinal) GROUP BY ALL)
    SELECT 'one' AS job_id, count(*) FILTER (n > 0) AS extracted, count(*) FILTER (n = 0) AS no_facts, sum(n)::BIGINT AS observations, 7::BIGINT AS requests, 100::BIGINT AS input_tokens, 20::BIGINT AS output_tokens FROM o
    UNION ALL SELECT 'two', 0, 0, 0, 5, 0, 0"""
)
def job_counters(spark, sf_dir):
    """What each job's commits have added up to; a replay under another id counts its requests alone."""
    return _store(spark, sf_dir, "before", "replay", "again").job_counters().drop("errors")


@query(
    f"""{_PEOPLE} SELECT file_id, count(*) AS people, count(*) AS documents, count(*) AS fact_values, (SELECT count(*) FROM r WHERE r.file_id = p.file_id) AS outcomes FROM p WHERE file_id <> '1-URGENT' GROUP BY file_id"""
)
def delete_cascade(spark, sf_dir):
    """Rows of each file that are left in the tables after one file was deleted."""
    store = _store(spark, sf_dir)
    store.delete_source("1-URGENT")
    people = store.read("person_facts").select("id", "file_id")
    of = lambda name: people.join(store.read(name).select(F.col("person_fact_id").alias("id")), "id").groupBy("file_id").agg(F.count("*").alias("documents" if name == "search_docs" else name))
    outcomes = store.read("row_outcomes").groupBy("file_id").agg(F.count("*").alias("outcomes"))
    return people.groupBy("file_id").agg(F.count("*").alias("people")).join(of("search_docs"), "file_id").join(of("fact_values"), "file_id").join(outcomes, "file_id")


@query(f"{_PEOPLE} SELECT file_id, count(*) AS documents, count(*) AS unchanged FROM p GROUP BY file_id")
def rebuilt_projection(spark, sf_dir):
    """Search documents of each file after a rebuild from the observations, and how many are what the commit wrote."""
    store = _store(spark, sf_dir)
    before = store.read("search_docs").select("person_fact_id", F.col("all_text").alias("was"))  # the version before stays readable
    store.rebuild_search()
    both = store.read("search_docs").join(before, "person_fact_id")
    people = store.read("person_facts").select(F.col("id").alias("person_fact_id"), F.col("file_id").alias("file"))
    return both.join(people, "person_fact_id").groupBy(F.col("file").alias("file_id")).agg(F.count("*").alias("documents"), F.count_if(F.col("all_text") == F.col("was")).alias("unchanged"))


@query(
    """WITH h AS (SELECT sha256(c_custkey || chr(1) || c_name || chr(1) || c_mktsegment) AS s FROM customer),
    d AS (SELECT s, generate_subscripts(range(15), 1) AS i FROM h),
    v AS (SELECT sum((strpos('0123456789abcdef', substr(s, i::INT, 1)) - 1)::HUGEINT * (16::HUGEINT ** (15 - i))::HUGEINT) AS a, sum((strpos('0123456789abcdef', substr(s, i::INT + 15, 1)) - 1)::HUGEINT * (16::HUGEINT ** (15 - i))::HUGEINT) AS b FROM d)
    SELECT (SELECT count(*) FROM h) AS n, a::VARCHAR AS hash0, b::VARCHAR AS hash1 FROM v"""
)
def canonical_hash(spark, sf_dir):
    return audit.canonical_hash(t(spark, sf_dir, "customer"), ["c_custkey", "c_name", "c_mktsegment"])


# --- the stored index with positions --------------------------------------------------------------------------


def _indexed(spark, sf_dir, words: str, mode: str = "all") -> DataFrame:
    path = shared_folder(spark, "index")
    write_index(t(spark, sf_dir, "documents"), "doc_id", "text", path)
    return PositionIndex(spark, path).search(search.compile_query(words, mode)).withColumnRenamed("id", "doc_id")


@query(f"SELECT doc_id, {_rank_sql('of the')} FROM documents WHERE contains(' ' || array_to_string({_W}, ' ') || ' ', ' of the ')")
def index_phrase(spark, sf_dir):
    return _indexed(spark, sf_dir, "of the", "phrase")


@query(f"SELECT doc_id, {_rank_sql('licens')} FROM documents WHERE len(list_filter({_W}, lambda x: starts_with(x, 'licens'))) > 0")
def index_prefix(spark, sf_dir):
    return _indexed(spark, sf_dir, "licens*")


@query(
    f"""SELECT doc_id, {_rank_sql('licens lizenz of the')} FROM documents WHERE contains(' ' || array_to_string({_W}, ' ') || ' ', ' of the ') OR contains(' ' || array_to_string({_W}, ' '), ' the licens') OR list_contains({_W}, 'lizenz')"""
)
def index_mixed(spark, sf_dir):
    """A phrase, a phrase whose last word is a beginning, and a word."""
    return _indexed(spark, sf_dir, '"of the" "the licens*" lizenz', "any")


# --- files ------------------------------------------------------------------------------------------------------


def _loaded(spark, path: str, s: Structure) -> DataFrame:
    found = load_records(spark, path, s).select("error", F.map_from_entries("fields").alias("f"))
    return found.select(*[F.col("f")[c].alias(c) for c in _ORDERS], F.col("error.code").alias("error"))


def _orders(spark, sf_dir) -> DataFrame:
    return t(spark, sf_dir, "orders").select(*[F.col(c).cast("string").alias(c) for c in _ORDERS])


def in_array(batches):
    """Lines of one partition as one JSON array."""
    import pyarrow as pa

    lead = "["
    for b in batches:
        if b.num_rows:
            lines = b.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array([lead + lines[0], *("," + x for x in lines[1:])])], names=["value"])
            lead = ","
    yield pa.RecordBatch.from_arrays([pa.array(["]" if lead == "," else "[]"])], names=["value"])


@query(_ORDERS_SQL)
def read_json_array(spark, sf_dir):
    path = shared_folder(spark, "arrays")
    _orders(spark, sf_dir).select(F.to_json(F.struct(*_ORDERS)).alias("value")).mapInArrow(in_array, "value string").write.text(path)
    return _loaded(spark, path, Structure("json_array", encoding="utf-8"))


@query(_ORDERS_SQL)
def read_xml(spark, sf_dir):
    path = shared_folder(spark, "xml")
    _orders(spark, sf_dir).write.format("xml").option("rootTag", "orders").option("rowTag", "order").save(path)
    return _loaded(spark, path, Structure("xml", record_path="/orders/order"))


@query(_ORDERS_SQL)
def source_delimited(spark, sf_dir):
    """Quoted fields through the data source."""
    path = shared_folder(spark, "quoted")
    quoted = [F.concat(F.lit('"'), F.col(c), F.lit('"')) for c in _ORDERS]
    _orders(spark, sf_dir).select(F.concat_ws(",", *quoted).alias("value")).write.text(path)
    return _loaded(spark, path, Structure("delimited", encoding="utf-8", has_header=False, delimiter=",", columns=_ORDERS))


@query(
    """SELECT r_name, 'customers/customer' AS path, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name HAVING count(*) > 1"""
)
def record_path(spark, sf_dir):
    """The record path of each region's XML files, from the paths of all their elements."""
    regions = t(spark, sf_dir, "nation").join(t(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = t(spark, sf_dir, "customer").join(regions, F.col("c_nationkey") == F.col("n_nationkey")).select("r_name", F.struct("c_custkey", "c_name").alias("who"), "c_mktsegment")
    path = shared_folder(spark, "paths")
    rows.write.format("xml").option("rootTag", "customers").option("rowTag", "customer").partitionBy("r_name").save(path)
    found = element_paths(spark, path).withColumn("r_name", F.url_decode(F.regexp_extract("file_id", "/r_name=([^/]*)/", 1)))
    return checks.record_path(found, "r_name", "path", "n")


@query(
    """SELECT event_id, array_to_string(list_transform((SELECT list(name ORDER BY least, place) FROM (SELECT name, min(event_id) AS least, any_value(place) AS place FROM
        (SELECT event_id, 'event_id' AS name, 0 AS place FROM events UNION ALL SELECT event_id, event_type || '_value', 1 FROM events UNION ALL SELECT event_id, 'user_id', 2 FROM events) GROUP BY name)),
        lambda n: CASE WHEN n = 'event_id' THEN event_id::VARCHAR WHEN n = 'user_id' THEN user_id::VARCHAR WHEN n = event_type || '_value' THEN event_type ELSE '-' END), '|') AS row FROM events"""
)
def aligned_columns(spark, sf_dir):
    """JSON lines with a field that is named by the event's type, brought to the union of all columns."""
    made = F.map_from_arrays(F.array(F.lit("event_id"), F.concat("event_type", F.lit("_value")), F.lit("user_id")), F.array(F.col("event_id").cast("string"), "event_type", F.col("user_id").cast("string")))
    path = shared_folder(spark, "events")
    t(spark, sf_dir, "events").select(F.to_json(made).alias("value")).write.text(path)
    found = read_records(spark, path, Structure("jsonl", encoding="utf-8"))
    found = found.withColumn("event_id", F.filter("fields", lambda f: f["name"] == "event_id")[0]["value"].cast("long"))
    rows, _ = aligned(found, ["event_id"])
    return rows.select("event_id", F.array_join("values", "|", "-").alias("row"))


_CODE = """CASE WHEN list_bool_or(list_transform(l, lambda x: x.status = 'P')) AND round = 0 THEN 'invalid_response' WHEN list_sum(list_transform(l, lambda x: x.price)) > 400000 THEN 'output_truncated' END"""


@query(
    f"""WITH RECURSIVE o AS (SELECT o_custkey AS c, {{'id': o_orderkey, 'price': o_totalprice, 'status': o_orderstatus, 'low': o_orderpriority = '5-LOW'}} AS x, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i FROM orders),
    b AS (SELECT c, (i - 1) // 8 AS batch, list(x ORDER BY i) AS l, 0 AS round, 1 AS requests FROM o GROUP BY ALL),
    r AS (
        SELECT c, l, round, requests, {_CODE} AS code FROM b
        UNION ALL
        SELECT c, l, round, requests, {_CODE} FROM (
            SELECT c, round + CASE WHEN code = 'output_truncated' THEN 0 ELSE 1 END AS round, requests + 1 AS requests,
                unnest(CASE WHEN code IS NULL THEN [list_filter(l, lambda x: x.low)] WHEN len(l) = 1 THEN [l] ELSE [l[1 : len(l) // 2], l[len(l) // 2 + 1 :]] END) AS l
            FROM r WHERE (code IS NULL AND round = 0 AND list_bool_or(list_transform(l, lambda x: x.low))) OR (code = 'invalid_response' AND round < 2) OR (code = 'output_truncated' AND len(l) > 1)
        )
    )
    SELECT x.id AS o_orderkey, end_code AS code, round, requests FROM (
        SELECT unnest(CASE WHEN code IS NULL AND round = 0 THEN list_filter(l, lambda x: NOT x.low) ELSE l END) AS x, code AS end_code, round, requests FROM r
        WHERE code IS NULL OR (code = 'output_truncated' AND len(l) = 1)
    )"""
)
def split_batches(spark, sf_dir):
    """Batches of orders whose answers are cut off beyond a price, invalid at first where an order is pending, and leave out low priorities at first."""
    orders = t(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice", "o_orderstatus", "o_orderpriority")
    placed = batching.greedy_batches(orders, ["o_custkey"], "o_orderkey", F.lit(1), 8, 1000).select("o_orderkey", "batch")

    def ask(rows):
        part = rows.groupBy("_part").agg(F.sum("o_totalprice").alias("price"), F.max((F.col("o_orderstatus") == "P").cast("int")).alias("pending"))
        code = F.when((F.col("pending") == 1) & (F.col("_round") == 0), "invalid_response").when(F.col("price") > 400000, "output_truncated")
        return rows.join(part, "_part").withColumns({"_code": code, "_missing": (F.col("o_orderpriority") == "5-LOW") & (F.col("_round") == 0)}).drop("price", "pending")

    _checkpoints(spark)
    made = split_and_retry(orders.join(placed, "o_orderkey"), ["o_custkey"], "batch", "o_orderkey", ask)
    return made.select("o_orderkey", "code", "round", "requests")


@query(
    """SELECT 100::BIGINT AS skipped, count(*) - 100 AS emitted, count(*) FILTER (bad AND i > 100) AS bad, count(*) FILTER (blank AND i > 100) AS blank, 0::BIGINT AS replaced,
    coalesce(sum(CASE WHEN i > 100 AND NOT bad THEN CASE WHEN blank THEN 1 ELSE length(o_orderkey::VARCHAR) + length(o_orderpriority) END END), 0)::BIGINT AS characters
    FROM (SELECT o_orderkey, o_orderpriority, row_number() OVER (ORDER BY o_orderkey) AS i, o_orderstatus = 'P' AS bad, o_orderstatus = 'O' AND o_orderpriority = '5-LOW' AS blank FROM orders)"""
)
def read_metrics(spark, sf_dir):
    """Figures of one read, gathered as its rows pass: JSON lines of orders, pending ones broken, some of them blank."""
    blank = F.struct(F.lit(" ").alias("key"), F.lit("").alias("priority"))
    line = F.when(F.col("o_orderstatus") == "P", "{").when((F.col("o_orderstatus") == "O") & (F.col("o_orderpriority") == "5-LOW"), F.to_json(blank)).otherwise(F.to_json(F.struct(F.col("o_orderkey").cast("string").alias("key"), F.col("o_orderpriority").alias("priority"))))
    path = shared_folder(spark, "measured")
    # Sorted by range in many tasks and kept: the one task that writes the file sorts nothing.
    _checkpoints(spark)
    lines = t(spark, sf_dir, "orders").sort("o_orderkey").select(line.alias("value")).checkpoint()
    lines.coalesce(1).write.text(path)
    rows, figures = observed(read_records(spark, path, Structure("jsonl", encoding="utf-8")), "orders", after=100)
    rows.write.format("noop").mode("overwrite").save()
    names = ("skipped", "emitted", "bad", "blank", "replaced", "characters")
    return spark.range(1).select(*[F.lit(figures.get[n]).cast("long").alias(n) for n in names])


@query(
    f"""{_PEOPLE} SELECT file_id, count(*) AS people, 0::BIGINT AS reviewed FROM p GROUP BY file_id UNION ALL SELECT 'new', 1, 1"""
)
def migrated_store(spark, sf_dir):
    """An old store read after a column was added, with one row that has it."""
    old = _store(spark, sf_dir)
    store, _ = migrate(spark, old.root, [Step(1, "person_facts", "reviewed", "boolean"), Step(2, "search_docs", "language", "string")])
    one = old.read("person_facts").limit(1).withColumns({"id": F.lit("f" * 56), "file_id": F.lit("new"), "reviewed": F.lit(True)})
    store.append("person_facts", one)
    return store.read("person_facts").groupBy("file_id").agg(F.count("*").alias("people"), F.count("reviewed").alias("reviewed"))


def segment_extractor(fields):
    """A customer's name as surname and segment as name; no person where a field is missing."""
    said = dict(fields)
    if said.get("who") and said.get("segment"):
        yield {"surname": said["who"], "name": said["segment"].capitalize(), "candidates": [{"type": "document", "value": said["key"], "source_column": "key"}]}


@query("SELECT c_custkey, c_name AS surname, upper(c_mktsegment[1]) || lower(c_mktsegment[2:]) AS name, 1 AS n_facts, 'identified' AS identity_status FROM customer")
def named_extractor(spark, sf_dir):
    """A registered extractor in the place of extraction by column name."""
    extensions.register_extractor(spark, "by_segment", segment_extractor)
    pair = lambda n, c: F.struct(F.lit(n).alias("name"), F.col(c).cast("string").alias("value"))
    rows = t(spark, sf_dir, "customer").select("c_custkey", F.array(pair("key", "c_custkey"), pair("who", "c_name"), pair("segment", "c_mktsegment")).alias("fields"))
    made = extract.verify(extensions.extract_with(rows, "by_segment"), F.lit("2024-01-01").cast("date"))
    return made.select("c_custkey", "surname", "name", F.size("facts").alias("n_facts"), "identity_status")


@query(
    """SELECT c_custkey, n_name, c_acctbal, 1::BIGINT AS rank FROM customer JOIN nation ON c_nationkey = n_nationkey
    WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 0 AND EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)"""
)
def people_search(spark, sf_dir):
    """Customers with a positive balance joined with documents that name their segment."""
    nation = t(spark, sf_dir, "nation")
    people = t(spark, sf_dir, "customer").where("c_acctbal > 0").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name", "c_acctbal")
    text = F.concat_ws(" ", "c_name", F.lower("c_mktsegment"))
    active = t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")).distinct()
    docs = t(spark, sf_dir, "customer").join(active, "c_custkey", "left_semi").select(F.col("c_custkey").alias("person_fact_id"), text.alias("all_text"))
    found = search.people_search(people, docs, search.compile_query("Building"), id_col="c_custkey")
    return found.select("c_custkey", "n_name", "c_acctbal", "rank")


# --- structures, samples and folders ----------------------------------------------------------------------------

# What a model might say about one order each; every rule of the contract is met and broken by some.
_SAID = """SELECT o_orderkey, {told} AS told, CASE o_orderstatus WHEN 'F' THEN ' Structured' WHEN 'O' THEN 'structured' ELSE 'table' END AS classification,
    CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'delimited' WHEN '2' THEN 'Fixed_Width' WHEN '3' THEN 'xml' WHEN '4' THEN 'jsonl' ELSE 'csv' END AS format,
    CASE o_custkey % 3 WHEN 0 THEN 'cp1251' WHEN 1 THEN 'utf8' ELSE 'ebcdic' END AS encoding, CASE o_custkey % 5 WHEN 0 THEN false WHEN 1 THEN NULL ELSE true END AS has_header,
    CASE WHEN o_orderkey % 4 > 0 THEN CAST(o_orderkey % 2 AS INT) END AS header_row, CASE o_custkey % 7 WHEN 0 THEN 1001 WHEN 1 THEN NULL ELSE CAST(o_custkey % 2 AS INT) END AS skip_rows,
    CASE o_orderkey % 5 WHEN 0 THEN 'tab' WHEN 1 THEN ';' WHEN 2 THEN ' Semicolon' WHEN 3 THEN '||' END AS delimiter, CASE WHEN o_custkey % 2 = 0 THEN ';' ELSE '' END AS quote_char,
    CASE WHEN o_custkey % 4 = 0 THEN '' ELSE 'Order' || o_orderkey END AS name, CAST(o_custkey % 6 AS INT) AS width,
    CASE o_orderkey % 3 WHEN 0 THEN './orders/order/' WHEN 1 THEN '/orders/order[1]' ELSE 'o:order' END AS path, CASE WHEN o_orderkey % 2 = 1 THEN '$.x' END AS json_path,
    CAST(o_totalprice / 250000 AS DOUBLE) AS confidence FROM orders"""
_TOLD = "CASE o_orderkey % 3 WHEN 0 THEN 'utf-8' WHEN 1 THEN 'windows-1251' END"


@query(
    f"""WITH a AS ({_SAID.format(told=_TOLD)}),
    b AS (SELECT *, o_orderkey AS k, classification <> 'table' AS ok, classification <> 'table' AND format = 'delimited' AS cells, classification <> 'table' AND format = 'Fixed_Width' AS wide,
        coalesce(skip_rows, 0) AS skip, CASE delimiter WHEN 'tab' THEN chr(9) WHEN ' Semicolon' THEN ';' ELSE delimiter END AS d,
        CASE encoding WHEN 'cp1251' THEN 'windows-1251' WHEN 'utf8' THEN 'utf-8' END AS proposed FROM a),
    c AS (SELECT *, cells OR wide AS lines, (cells OR wide) AND skip <= 1000 AS head FROM b)
    SELECT o_orderkey,
        concat_ws(',', CASE WHEN NOT ok THEN 'classification_invalid' END, CASE WHEN ok AND format = 'csv' THEN 'format_invalid' END,
            CASE WHEN cells AND d IS NULL THEN 'delimiter_missing' END, CASE WHEN cells AND d = '||' THEN 'delimiter_too_long' END,
            CASE WHEN cells AND quote_char = d THEN 'quote_is_delimiter' END, CASE WHEN lines AND skip > 1000 THEN 'skip_rows_out_of_range' END,
            CASE WHEN head AND has_header IS NULL THEN 'has_header_missing' END, CASE WHEN head AND has_header AND header_row <> skip THEN 'header_row_differs' END,
            CASE WHEN wide AND width = 0 THEN 'width_out_of_range' END, CASE WHEN wide AND width = 5 THEN 'columns_differ_from_widths' END,
            CASE WHEN ok AND format = 'xml' AND contains(path, '[') THEN 'record_path_invalid' END,
            CASE WHEN ok AND format = 'jsonl' AND json_path IS NOT NULL THEN 'json_record_path_unsupported' END, CASE WHEN ok AND format = 'xml' AND path = 'o:order' THEN 'prefix_undeclared' END) AS errors,
        concat_ws(',', CASE WHEN ok AND confidence > 1 THEN 'confidence_ignored' END, CASE WHEN ok AND proposed IS NULL THEN 'encoding_unsupported' END, CASE WHEN ok AND told <> proposed THEN 'encoding_differs' END,
            CASE WHEN head AND has_header AND header_row IS NULL THEN 'header_row_assumed' END, CASE WHEN head AND NOT has_header AND header_row IS NOT NULL THEN 'header_row_ignored' END,
            CASE WHEN lines AND NOT (wide AND width = 5) THEN 'columns_renamed' END) AS warnings,
        CASE WHEN cells THEN d ELSE delimiter END AS delimiter, CASE WHEN ok THEN coalesce(told, proposed) ELSE encoding END AS encoding,
        CASE WHEN head AND has_header THEN coalesce(header_row, skip) WHEN head AND NOT has_header THEN NULL ELSE header_row END AS header_row,
        CASE WHEN lines AND NOT (wide AND width = 5) THEN CASE WHEN name = '' THEN 'Колонка 1|Колонка 2' ELSE name || '|' || lower(name) || ' (2)' END ELSE name || '|' || lower(name) END AS columns,
        CASE WHEN ok AND format = 'xml' AND path = './orders/order/' THEN 'orders/order' ELSE path END AS path, CASE WHEN NOT (ok AND confidence > 1) THEN confidence END AS confidence
    FROM c"""
)
def structure_contract(spark, sf_dir):
    """An answer for each order held against the contract of structures."""
    said = spark.sql(_SAID.format(told=_TOLD).replace("FROM orders", "FROM {orders}"), orders=t(spark, sf_dir, "orders"))
    said = said.withColumns({"columns": F.array("name", F.lower("name")), "fixed_widths": F.when(F.col("width") == 5, F.array(F.lit(5))).otherwise(F.array(F.lit(5), F.col("width")))})
    fields = ["classification", "format", "encoding", "has_header", "header_row", "skip_rows", "delimiter", "quote_char", "columns", "fixed_widths", "confidence"]
    answer = F.to_json(F.struct(*fields, F.col("path").alias("xml_record_path"), F.col("json_path").alias("json_record_path")))
    found = contract.checked_structures(said.select("o_orderkey", "told", answer.alias("answer")), "answer", "told")
    codes = lambda c: F.array_join(F.transform(c, lambda x: x["code"]), ",").alias(c)
    s = F.col("structure")
    return found.select("o_orderkey", codes("errors"), codes("warnings"), *[s[c].alias(c) for c in ("delimiter", "encoding", "header_row")], F.array_join(s["columns"], "|").alias("columns"), s["xml_record_path"].alias("path"), s["confidence"].alias("confidence"))


_ENDS = {"lf": "\n", "crlf": "\r\n", "cr": "\r"}


def _customer_files(spark, sf_dir, name: str) -> str:
    """A folder with a file for each nation, customers in order, and line ends by the nation's key; those of one key also have other ones within."""
    path = shared_folder(spark, name)
    rows = t(spark, sf_dir, "customer").select("c_nationkey", "c_custkey", F.concat_ws(";", F.col("c_custkey").cast("string"), "c_name", "c_mktsegment").alias("value"))
    rows = rows.withColumn("value", F.when(F.col("c_nationkey") % 4 == 3, F.concat("value", F.lit("\nmore"))).otherwise(F.col("value")))
    for i, (kind, end) in enumerate(_ENDS.items()):
        part = rows.where(F.col("c_nationkey") % len(_ENDS) == i).repartition("c_nationkey").sortWithinPartitions("c_nationkey", "c_custkey")
        part.select("c_nationkey", "value").write.partitionBy("c_nationkey").option("lineSep", end).text(f"{path}/{kind}")
    return path


@query(
    r"""WITH r AS (SELECT c_nationkey, c_custkey, CASE c_nationkey % 3 WHEN 0 THEN chr(10) WHEN 1 THEN chr(13) || chr(10) ELSE chr(13) END AS e,
        c_custkey || ';' || c_name || ';' || c_mktsegment || CASE WHEN c_nationkey % 4 = 3 THEN chr(10) || 'more' ELSE '' END AS v FROM customer),
    f AS (SELECT c_nationkey, string_agg(v || e, '' ORDER BY c_custkey) AS text FROM r GROUP BY c_nationkey),
    h AS (SELECT c_nationkey, length(text) AS length, substr(text, 1, 1024) AS head, length(text) <= 1024 AS whole FROM f),
    p AS (SELECT *, string_split_regex(head, '\r\n|\r|\n') AS parts, (len(head) - len(replace(head, chr(13) || chr(10), ''))) // 2 AS crlf FROM h),
    n AS (SELECT *, len(head) - len(replace(head, chr(13), '')) - crlf - CASE WHEN NOT whole AND ends_with(head, chr(13)) THEN 1 ELSE 0 END AS cr, len(head) - len(replace(head, chr(10), '')) - crlf AS lf,
        len(parts) > 20 AS full_, parts[-1] <> '' AS rest FROM p)
    SELECT c_nationkey, length, array_to_string(CASE WHEN full_ THEN parts[:20] WHEN rest THEN parts ELSE parts[:-2] END, '|') AS lines, NOT full_ AND NOT whole AS truncated,
        CASE WHEN NOT full_ AND rest AND NOT whole THEN len(parts) - 1 END AS truncated_line, whole AND NOT full_ AND len(CASE WHEN rest THEN parts ELSE parts[:-2] END) < 20 AS fewer_lines,
        CASE WHEN (crlf > 0)::INT + (lf > 0)::INT + (cr > 0)::INT > 1 THEN 'mixed' WHEN crlf > 0 THEN 'crlf' WHEN lf > 0 THEN 'lf' WHEN cr > 0 THEN 'cr' END AS line_terminator FROM n"""
)
def file_samples(spark, sf_dir):
    """The first twenty lines and 1,024 bytes of each nation's file."""
    found = sample_files(spark, _customer_files(spark, sf_dir, "samples"), 20, 1024).where(F.endswith("file_id", F.lit(".txt")))
    key = F.regexp_extract("file_id", "/c_nationkey=([0-9]+)/", 1).cast("int").alias("c_nationkey")
    return found.select(key, "length", F.array_join("lines", "|").alias("lines"), "truncated", "truncated_line", "fewer_lines", "line_terminator")


@query(
    """WITH r AS (SELECT c_nationkey, octet_length(encode(c_custkey || ';' || c_name || ';' || c_mktsegment)) + CASE WHEN c_nationkey % 4 = 3 THEN 5 ELSE 0 END + CASE WHEN c_nationkey % 3 = 1 THEN 2 ELSE 1 END AS n FROM customer)
    SELECT CASE c_nationkey % 3 WHEN 0 THEN 'lf' WHEN 1 THEN 'crlf' ELSE 'cr' END || '/c_nationkey=' || c_nationkey AS folder, 'txt' AS extension, 'text_candidate' AS hint, 1::BIGINT AS files, sum(n)::BIGINT AS bytes FROM r GROUP BY ALL"""
)
def folder_walk(spark, sf_dir):
    """Files and bytes of each folder below one."""
    files, _ = walk(spark, _customer_files(spark, sf_dir, "walked"))
    data = files.where(F.col("extension") == "txt")
    folder = F.regexp_replace("relative", "/[^/]*$", "")
    return data.groupBy(folder.alias("folder"), "extension", kind_hint(F.col("extension")).alias("hint")).agg(F.count("*").alias("files"), F.sum("length").alias("bytes"))
