"""Idempotent commits of extraction results into Parquet tables.

Keys are deterministic, so a repeated commit finds its rows and adds none.  A record's outcome is
written after all its persons, and the log entry last: a commit that died before is completed by
running it again.  A store takes one commit at a time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.records import all_json, facts_text, search_text
from .tables import Tables

KEY = ["file_id", "extraction_version", "ordinal"]
SOURCE = KEY[:2]
TABLES = {
    "sources": "file_id string, extraction_version string, source_key string",
    "row_outcomes": "file_id string, extraction_version string, ordinal long, outcome int, commit_id string, observations long",
    "person_facts": "id string, surname string, name string, patronymic string, birth_date date, birth_place string, all_json string, file_id string, ordinal long, person_index int, extraction_version string",
    "search_docs": "person_fact_id string, file_id string, all_text string, name_text string, facts_text string, place_text string",
    "fact_values": "fact_type string, normalized_value string, person_fact_id string",
    "row_errors": "file_id string, extraction_version string, ordinal long, stage string, code string, message string",
    "commit_log": "commit_id string, job_id string, file_id string, extraction_version string, to_ordinal long, rows long, extracted long, no_facts long, errors long, observations long, requests long, input_tokens long, output_tokens long",
    "deleted": "file_id string, extraction_version string, source_key string",
}
#: Folders of each table by source; a commit reads those of its own sources only.
BUCKETS = 64
ID_OF = {"person_facts": "id", "search_docs": "person_fact_id", "fact_values": "person_fact_id"}
COUNTERS = ("extracted", "no_facts", "errors", "observations", "requests", "input_tokens", "output_tokens")


def source_key(file_id: Column, version: Column) -> Column:
    """32 hex digits of a file and its extraction version; a null is not an empty string."""
    return F.substring(F.sha2(F.to_json(F.struct(file_id.alias("f"), version.alias("v"))), 256), 1, 32)


def observation_id(source: Column, ordinal: Column, person_index: Column) -> Column:
    """Source key, 16 hex digits of the ordinal and 8 of the person: sorts by ordinal and person in a source, for all longs and ints from -1 on."""
    digits = lambda x, n: F.lpad(F.lower(F.hex(x.cast("long"))), n, "0")
    return F.concat(source, digits(ordinal, 16), digits(person_index.cast("long") + 1, 8))


def bucket_of(name: str) -> Column | None:
    """The folder number of a row, from the key of its source; small tables have none."""
    key = F.substring(ID_OF[name], 1, 32) if name in ID_OF else source_key(F.col("file_id"), F.col("extraction_version")) if name in ("row_outcomes", "row_errors") else None
    return None if key is None else F.pmod(F.conv(F.substring(key, 1, 4), 16, 10).cast("int"), F.lit(BUCKETS)).cast("int")


def buckets_of(sources: DataFrame) -> list[int]:
    """The folder numbers of the rows of these sources, BUCKETS at most."""
    return [r[0] for r in sources.select(*SOURCE).distinct().select(bucket_of("row_outcomes").alias("b")).distinct().collect()]


def matched(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    """A join on keys where null equals null; the keys of ``left`` stay."""
    renamed = right.select(*[F.col(c).alias(f"_{c}" if c in keys else c) for c in right.columns])
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return left.join(renamed, on, how).drop(*[f"_{k}" for k in keys])


def projection(people: DataFrame, *more: str, facts: str = "facts", unresolved: str = "unresolved") -> DataFrame:
    """The search document of each observation, and ``more`` of its columns."""
    said = facts_text(F.col(facts), F.col(unresolved))
    whole = search_text(F.col("surname"), F.col("name"), F.col("patronymic"), F.col("birth_date"), F.col("birth_place"), said, F.col("file_id"))
    named = F.concat_ws(" ", "surname", "name", "patronymic")
    return people.select(F.col("id").alias("person_fact_id"), "file_id", whole.alias("all_text"), named.alias("name_text"), said.alias("facts_text"), F.coalesce("birth_place", F.lit("")).alias("place_text"), *more)


class Store:
    """Observations, their documents and values, outcomes, errors and the commit log below one folder."""

    def __init__(self, spark: SparkSession, root: str, schemas: dict[str, str] | None = None, mapped: dict[str, dict[str, str]] | None = None):
        self.spark, self.root = spark, root.rstrip("/")
        self.tables = Tables(spark, root, schemas or TABLES, bucket_of, mapped)

    def read(self, name: str, buckets: list[int] | None = None) -> DataFrame:
        """A table (or some of its buckets) without the rows of sources whose deletion has begun."""
        found = self.tables.read(name, buckets)
        if name == "deleted" or not self.tables.exists(self.tables.folder("deleted")):
            return found
        gone = self.tables.read("deleted").select(F.col("source_key").alias("_gone")).distinct()
        if name in ID_OF:
            return found.join(gone, F.substring(ID_OF[name], 1, 32) == F.col("_gone"), "left_anti")
        return found.join(gone, source_key(F.col("file_id"), F.col("extraction_version")) == F.col("_gone"), "left_anti")

    def append(self, name: str, rows: DataFrame) -> None:
        """Adds rows; columns that a table was given since (see ``migrate``) and the rows lack are null."""
        known = dict(c.split() for c in self.tables.schemas[name].split(", "))
        self.tables.append(name, rows.withColumns({c: F.lit(None).cast(kind) for c, kind in known.items() if c not in rows.columns}))

    def _staged(self, path: str, rows: DataFrame, *by: str) -> DataFrame:
        """Rows that a commit uses several times, evaluated once and written, in folders ``by`` a column if given."""
        made = rows.hint("rebalance", *by) if by else rows
        made.write.mode("overwrite").partitionBy(*by).parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    def _unfinished(self, buckets: list[int]) -> bool:
        """Whether a commit died before the outcomes of its persons: else the outcomes count all persons, which are written first."""
        people = self.read("person_facts", buckets).count()
        return people != (self.read("row_outcomes", buckets).agg(F.sum("observations")).first()[0] or 0)

    def commit(self, commit_id: str, verified: DataFrame, requests: int = 0, job_id: str | None = None, input_tokens: int = 0, output_tokens: int = 0) -> dict[str, int]:
        """Adds the records of ``verified`` that have no outcome yet, with all their persons; counts what was new.

        ``verified`` has a row for each person of a record (``person_index`` from 0, -1 for facts of
        nobody; 0 where the column is missing).  A record's outcome is an error (3) if one of its rows
        is one, else extracted (1) if one of them is; persons are the rows of outcome 1.  Of several rows
        of one person the one of least content hash counts.  A commit id that is logged already changes nothing; the
        same records under another id add nothing but its requests and tokens, which count for the commit's first file.
        """
        self.finish_deletes()
        log = self.read("commit_log").where(F.col("commit_id") == commit_id)
        if log.limit(1).count():
            return {"duplicate": 1, "new_rows": 0, "observations": 0, "present": 0}
        for name, kind in (("error", "struct<code:string,message:string>"), ("person_index", "int"), ("birth_place", "string"), ("stage", "string"), ("rejected", "array<struct<name:string,value:string,reason:string>>")):
            if name not in verified.columns:
                verified = verified.withColumn(name, F.lit(0 if name == "person_index" else None).cast(kind))
        path = f"{self.root}/_staged/{''.join(c if c.isalnum() else '-' for c in commit_id)}"
        rows = self._staged(f"{path}/rows", verified)
        records = rows.groupBy(*KEY).agg(F.max((F.col("outcome") == 3).cast("int")).alias("failed"), F.max((F.col("outcome") == 1).cast("int")).alias("told"), F.min_by(F.struct("error.code", "error.message", "stage"), F.when(F.col("outcome") == 3, 0).otherwise(1)).alias("fault"))
        records = records.withColumn("outcome", F.when(F.col("failed") == 1, 3).when(F.col("told") == 1, 1).otherwise(2))
        buckets = buckets_of(rows)
        known = self.read("row_outcomes", buckets).select(*KEY, F.lit(True).alias("known"))
        records = self._staged(f"{path}/records", matched(records, known, KEY, "left"))
        n = records.agg(F.count("*").alias("all"), F.count_if(F.col("known").isNull()).alias("new"), F.count_if(F.col("known").isNull() & (F.col("outcome") == 3)).alias("errors")).first()
        if n.new:  # else all persons are there too, as outcomes come after them
            self._add(commit_id, path, rows, records.where("known IS NULL"), buckets, job_id, n.errors, n.new == n.all)
        self._log(commit_id, records, buckets, job_id, requests, input_tokens, output_tokens)
        observations = self.read("commit_log").where(F.col("commit_id") == commit_id).agg(F.sum("observations")).first()[0] or 0
        self.tables.delete(path)
        return {"duplicate": 0, "new_rows": n.new, "observations": observations, "present": n.all - n.new}

    def _add(self, commit_id: str, path: str, rows: DataFrame, fresh: DataFrame, buckets: list[int], job_id: str | None, n_errors: int, all_fresh: bool) -> None:
        """Writes the persons of the ``fresh`` records, their documents, values and errors, and then their outcomes.

        Persons are staged by bucket, so that all tables get their rows from there without moving them again.
        """
        first = Window.partitionBy(*KEY, "person_index").orderBy(F.xxhash64("surname", "name", "patronymic", "birth_date", "birth_place", F.to_json("facts")))
        people = rows.where("outcome = 1")
        if n_errors or not all_fresh:
            people = matched(people, fresh.where("outcome = 1").select(*KEY), KEY, "left_semi")
        people = people.withColumn("_nth", F.row_number().over(first)).where("_nth = 1").drop("_nth")
        key = source_key(F.col("file_id"), F.col("extraction_version"))
        people = people.withColumn("id", observation_id(key, F.col("ordinal"), F.col("person_index")))
        people = self._staged(f"{path}/people", people.withColumn("bucket", bucket_of("person_facts")), "bucket")
        provenance = F.struct(F.concat(F.lit("r"), F.col("ordinal").cast("string")).alias("source_row_id"), "person_index", "extraction_version", F.lit(job_id).cast("string").alias("job_id"))
        kind = F.when(F.col("person_index") < 0, "unassigned").otherwise("person")
        observed = people.withColumn("all_json", all_json(kind, F.col("identity_status"), F.col("facts"), F.col("unresolved"), F.array().cast("array<string>"), provenance, F.col("rejected")))
        docs = projection(people, "bucket")
        said = F.array_distinct(F.transform("facts", lambda f: F.struct(f["type"].alias("fact_type"), f["search_key"].alias("normalized_value"))))
        values = people.select(F.col("id").alias("person_fact_id"), "bucket", F.inline(said)).where("normalized_value IS NOT NULL")
        if self._unfinished(buckets):
            # An earlier run has died between tables: what it wrote is not written again.
            observed = observed.join(self.read("person_facts", buckets).select("id"), "id", "left_anti")
            docs = docs.join(self.read("search_docs", buckets).select("person_fact_id"), "person_fact_id", "left_anti")
            values = matched(values, self.read("fact_values", buckets), ["fact_type", "normalized_value", "person_fact_id"], "left_anti")
        sources = fresh.select(*SOURCE).distinct().withColumn("source_key", key)
        self.append("sources", sources.join(self.read("sources").select("source_key"), "source_key", "left_anti"))
        self.append("person_facts", observed)
        self.append("search_docs", docs)
        self.append("fact_values", values)
        if n_errors:
            errors = fresh.where("outcome = 3").select(*KEY, F.coalesce("fault.stage", F.lit("parse")).alias("stage"), F.coalesce("fault.code", F.lit("unknown")).alias("code"), F.col("fault.message").alias("message"))
            self.append("row_errors", matched(errors, self.read("row_errors", buckets), [*KEY, "stage"], "left_anti"))
        held = people.groupBy(*KEY).agg(F.count("*").alias("n"))
        told = matched(fresh, held, KEY, "left").select(*KEY, "outcome", F.lit(commit_id).alias("commit_id"), F.coalesce("n", F.lit(0)).alias("observations"))
        self.append("row_outcomes", told)

    def _log(self, commit_id: str, records: DataFrame, buckets: list[int], job_id: str | None, *usage: int) -> None:
        """One entry a source: counts of the outcomes that bear the commit's id, so a repeated run logs the same."""
        mine = self.read("row_outcomes", buckets).where(F.col("commit_id") == commit_id)
        is_ = lambda k: F.count_if(F.col("outcome") == k)
        counts = mine.groupBy(*SOURCE).agg(is_(1).alias("extracted"), is_(2).alias("no_facts"), is_(3).alias("errors"), F.sum("observations").alias("observations"))
        seen = records.groupBy(*SOURCE).agg(F.max("ordinal").alias("to_ordinal"), F.count("ordinal").alias("rows"))
        both = matched(seen, counts, SOURCE, "left")
        first = F.struct(F.coalesce("file_id", F.lit("")), F.coalesce("extraction_version", F.lit("")))
        least = both.agg(F.min(first).alias("least"))
        made = both.join(F.broadcast(least), F.lit(True), "left")  # one row
        spent = {n: F.when(first == F.col("least"), F.lit(v)).otherwise(0) for n, v in zip(COUNTERS[4:], usage, strict=True)}
        made = made.withColumns(spent | {n: F.coalesce(n, F.lit(0)) for n in COUNTERS[:4]} | {"commit_id": F.lit(commit_id), "job_id": F.lit(job_id).cast("string")})
        if not buckets:
            entry = {n: F.lit(v) for n, v in zip(COUNTERS[4:], usage, strict=True)} | {n: F.lit(0) for n in ("rows", *COUNTERS[:4])} | {n: F.lit(None) for n in ("file_id", "extraction_version", "to_ordinal")}
            made = self.spark.range(1).select(*[c.alias(n) for n, c in entry.items()], F.lit(commit_id).alias("commit_id"), F.lit(job_id).cast("string").alias("job_id"))
        self.append("commit_log", made.coalesce(1))  # a row for each source of one commit, in one file

    def progress(self) -> DataFrame:
        """Progress of each source, folded from the commit log: counters add up, the confirmed ordinal only grows."""
        from .jobs import merged_progress

        log = self.read("commit_log").where("to_ordinal IS NOT NULL").withColumnsRenamed({"to_ordinal": "confirmed"})
        return merged_progress(log, SOURCE, "confirmed", list(COUNTERS)).withColumn("saved", F.col("extracted"))

    def job_counters(self) -> DataFrame:
        """What each job's commits have added up to."""
        return self.read("commit_log").groupBy("job_id").agg(*[F.sum(c).alias(c) for c in COUNTERS])

    def compact_log(self) -> None:
        """Folds the log to one entry for each job and source, and a bare entry for each commit id that must not run again."""
        log = self.read("commit_log")
        folded = log.groupBy("job_id", *SOURCE).agg(F.max("to_ordinal").alias("to_ordinal"), *[F.sum(c).alias(c) for c in ("rows", *COUNTERS)]).withColumn("commit_id", F.lit(None).cast("string"))
        ids = log.where("commit_id IS NOT NULL").select("commit_id", "job_id").distinct()
        bare = {c: F.lit(0).cast("long") for c in ("rows", *COUNTERS)} | {c: F.lit(None).cast("string") for c in SOURCE} | {"to_ordinal": F.lit(None).cast("long")}
        self.tables.swap("commit_log", folded.unionByName(ids.withColumns(bare)))

    def audited_progress(self) -> DataFrame:
        """Progress counted anew from all outcomes, and the last ordinal without a gap before it."""
        from .audit import conditional_counts, contiguous_checkpoint

        counts = conditional_counts(self.read("row_outcomes"), SOURCE, saved=F.col("outcome") == 1, no_facts=F.col("outcome") == 2, errors=F.col("outcome") == 3)
        return counts.join(contiguous_checkpoint(self.read("row_outcomes"), SOURCE, "ordinal"), SOURCE)

    def projected(self) -> DataFrame:
        """Search documents anew from the stored observations."""
        from ..functions.records import parse_all_json

        p = self.read("person_facts").withColumn("doc", parse_all_json(F.col("all_json")))
        return projection(p.withColumns({"facts": F.col("doc.facts"), "unresolved": F.col("doc.unresolved_fields")}))

    def rebuild_search(self, target: str | None = None) -> None:
        """Writes search documents anew, into ``target`` or as the store's next version, which readers see once it is whole."""
        if target is not None:
            self.projected().write.mode("overwrite").parquet(target)
        else:
            self.tables.swap("search_docs", self.projected())

    def delete_source(self, file_id: str, extraction_version: str | None = None) -> None:
        """Deletes what came from a file, or from one extraction version of it: people, documents, values, outcomes, errors, log.

        The deletion is noted first, and from then on no reader sees the rows; files are rewritten after
        that, bucket by bucket.  A deletion that died goes on with ``finish_deletes``, as every commit begins.
        """
        wanted = F.col("file_id") == file_id
        if extraction_version is not None:
            wanted = wanted & (F.col("extraction_version") == extraction_version)
        self.append("deleted", self.read("sources").where(wanted))
        self.finish_deletes()

    def finish_deletes(self) -> None:
        """Carries out the deletions that are noted."""
        if not self.tables.exists(self.tables.folder("deleted")):
            return
        gone = [tuple(r) for r in self.tables.read("deleted").select("source_key").distinct().collect()]  # sources whose deletion was asked for
        if gone:
            keys = [k for (k,) in gone]
            buckets = sorted({int(k[:4], 16) % BUCKETS for k in keys})
            for name in ("search_docs", "fact_values", "person_facts", "row_errors", "row_outcomes"):
                of = F.substring(ID_OF[name], 1, 32) if name in ID_OF else source_key(F.col("file_id"), F.col("extraction_version"))
                self.tables.rewrite(name, buckets, ~of.isin(keys))
            for name in ("commit_log", "sources"):
                self.tables.swap(name, self.read(name))
        self.tables.delete(self.tables.folder("deleted"))
