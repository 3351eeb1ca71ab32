"""Search: query compilation, predicates, ranking and pages."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.identifiers import search_key, search_key_any
from ..functions.text import words

MOST_TERMS, LONGEST_TERM, LONGEST_QUERY = 20, 100, 1000
_TERM = re.compile(r'"([^"]*)"?|([^\s"]+)')
_CHUNK = re.compile(r"(?:[^\W_]|[_\-.@+/*])+")


class SearchError(ValueError):
    """A query that cannot be run as it is; the message says why."""


@dataclass
class TextQuery:
    """Terms of a compiled query; a term is a list of tokens in a row, the last one maybe a beginning."""

    mode: str
    terms: list[str]
    notices: list[str] = field(default_factory=list)

    def condition(self) -> str:
        if self.mode == "phrase":
            return '"' + " ".join(self.terms) + '"'
        return (" OR " if self.mode == "any" else " AND ").join(f'"{t}"' for t in self.terms)


def _chunks(text: str, notices: list[str]) -> list[str]:
    out = []
    for chunk in _CHUNK.findall(text):
        word = chunk.strip(".-/+@")
        if "*" in word:
            if word.startswith("*"):
                raise SearchError("* is allowed at the end of a word only; use the substring mode to find part of a word")
            word = word.replace("*", "") and word.replace("*", "") + "*"
        if len(word) > LONGEST_TERM:
            raise SearchError(f"a word is longer than {LONGEST_TERM} characters")
        if word:
            out.append(word)
    if not out and text.strip():
        notices.append("punctuation is not searched")
    return out


def compile_query(text: str, mode: str = "all") -> TextQuery:
    """``mode``: all, any or phrase.  Quoted parts are phrases; * at the end of a word finds beginnings."""
    if not text or not text.strip():
        raise SearchError("enter words to search for")
    if len(text) > LONGEST_QUERY:
        raise SearchError(f"the query is longer than {LONGEST_QUERY} characters")
    notices: list[str] = []
    if mode == "phrase":
        terms = _chunks(text.replace('"', " "), notices)
        if any(t.endswith("*") for t in terms):
            raise SearchError("* is not supported in a phrase")
    else:
        terms = []
        for quoted, plain in _TERM.findall(text):
            found = _chunks(quoted or plain, notices)
            terms += [" ".join(found)] if quoted and found else found
        if len(terms) > MOST_TERMS:
            raise SearchError(f"too many words: {len(terms)}, at most {MOST_TERMS}")
    if not terms:
        raise SearchError("the query has no letters or digits")
    return TextQuery(mode, terms, notices)


def tokens_of(text: Column) -> Column:
    return words(F.lower(text))


def _tokens(term: str) -> list[str]:
    return re.findall(r"[^\W_]+", term.lower())


def term_matches(tokens: Column, term: str) -> Column:
    """Whether a token array has the term: a word, a beginning, or words in a row."""
    parts, prefix = _tokens(term), term.endswith("*")
    if len(parts) == 1:
        return F.exists(tokens, lambda t: t.startswith(parts[0])) if prefix else F.array_contains(tokens, parts[0])
    line = F.concat(F.lit(" "), F.array_join(tokens, " "), F.lit(" "))
    return F.contains(line, F.lit(" " + " ".join(parts) + ("" if prefix else " ")))


def text_predicate(tokens: Column, query: TextQuery) -> Column:
    if query.mode == "phrase":
        return term_matches(tokens, " ".join(query.terms))
    whole = None
    for term in query.terms:
        hit = term_matches(tokens, term)
        whole = hit if whole is None else (whole | hit if query.mode == "any" else whole & hit)
    return whole


def term_frequency(tokens: Column, query: TextQuery) -> Column:
    """How often the query's words occur in a text."""
    wanted = sorted({p for t in query.terms for p in _tokens(t)})
    return F.size(F.filter(tokens, lambda t: t.isin(*wanted))).cast("long")


def _may_match(text: Column, query: TextQuery) -> Column:
    """A cheap test that every match passes: the query's words occur as plain strings."""
    low, whole = F.lower(text), None
    for term in query.terms:
        hit = F.lit(True)
        for part in _tokens(term):
            hit = hit & F.contains(low, F.lit(part))
        whole = hit if whole is None else (whole | hit if query.mode == "any" else whole & hit)
    return whole


def text_search(docs: DataFrame, text_col: str, query: TextQuery) -> DataFrame:
    """Matching rows with their rank, the occurrences of the query's words.

    Only texts that hold the words as strings are cut into tokens, and each of them once: match and
    rank come out of one expression behind a generator, through which filters are not pushed.
    """
    ranks = F.transform(F.array(tokens_of(F.col(text_col))), lambda t: F.when(text_predicate(t, query), term_frequency(t, query)))
    return docs.where(_may_match(F.col(text_col), query)).select("*", F.explode(F.filter(ranks, lambda r: r.isNotNull())).alias("rank"))


def token_index(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(token, id, tf): the inverted index to store partitioned or bucketed by token for repeated searches."""
    return docs.select(F.col(id_col).alias("id"), F.explode(tokens_of(F.col(text_col))).alias("token")).groupBy("token", "id").agg(F.count("*").alias("tf"))


def write_token_index(index: DataFrame, path: str, buckets: int = 256) -> None:
    """Stores a token index in folders by token hash, so that a search reads those of its words only."""
    index.withColumn("bucket", F.pmod(F.xxhash64("token"), F.lit(buckets)).cast("int")).repartition("bucket").sortWithinPartitions("bucket", "token").write.partitionBy("bucket").option("buckets", buckets).parquet(path)


def read_token_index(spark: SparkSession, path: str, query: TextQuery, buckets: int = 256) -> DataFrame:
    """The part of a stored token index that a query needs; beginnings may lie in any folder."""
    index = spark.read.parquet(path)
    words = {p for t in query.terms for p in _tokens(t)}
    if any(t.endswith("*") for t in query.terms):
        return index.drop("bucket")
    wanted = [r[0] for r in spark.createDataFrame([(w,) for w in sorted(words)], "token string").select(F.pmod(F.xxhash64("token"), F.lit(buckets)).cast("int")).distinct().collect()]
    return index.where(F.col("bucket").isin(*wanted)).drop("bucket")


def index_search(index: DataFrame, query: TextQuery, documents: int) -> DataFrame:
    """(id, rank): words and beginnings looked up in the index; rank sums tf times ln(1 + documents / df) over the terms.

    The index has no places of words, so terms of several words are an error: use ``text_search``.
    """
    terms = sorted(set(query.terms))
    if query.mode == "phrase" or any(len(_tokens(t)) > 1 for t in terms):
        raise SearchError("the index holds single words; search phrases in the texts")
    named = [(t, _tokens(t)[0], t.endswith("*")) for t in terms]
    fits = F.array(*[F.when(F.col("token").startswith(w) if prefix else F.col("token") == w, F.lit(t)) for t, w, prefix in named])
    some = None
    for _, w, prefix in named:
        hit = F.col("token").startswith(w) if prefix else F.col("token") == w
        some = hit if some is None else some | hit
    hits = index.where(some).select("id", "tf", F.explode(F.filter(fits, lambda t: t.isNotNull())).alias("term")).groupBy("id", "term").agg(F.sum("tf").alias("tf"))
    df = hits.groupBy(F.col("term").alias("t")).agg(F.count("*").alias("df"))
    # One row for each query word.
    scored = hits.join(F.broadcast(df), hits.term == df.t).groupBy("id").agg(F.sum(F.col("tf") * F.log(1 + F.lit(documents) / F.col("df"))).alias("rank"), F.count("*").alias("found"))
    return scored.where(F.col("found") >= (1 if query.mode == "any" else len(terms))).drop("found")


def people_search(people: DataFrame, docs: DataFrame, query: TextQuery | None = None, where: Column | None = None, text: str = "all_text", id_col: str = "id", owner: str = "person_fact_id") -> DataFrame:
    """People joined with their search documents: rows that pass ``where`` on either table and match the query, with its rank (0 without one).

    Filters on people run before the join, and only texts that hold the query's words as strings reach it.
    """
    named = docs.withColumnRenamed(owner, "_owner")
    if query is not None:
        named = text_search(named, text, query)
    else:
        named = named.withColumn("rank", F.lit(0).cast("long"))
    joined = people.join(named.select("_owner", text, "rank"), people[id_col] == F.col("_owner")).drop("_owner")
    return joined if where is None else joined.where(where)


def place_search(docs: DataFrame, place: str, text: str, value: str) -> tuple[DataFrame, str | None]:
    """(rows whose projection has all words of a place, a notice): without a word in it, the place itself is searched as a string."""
    try:
        query = compile_query(value, "all")
    except SearchError:
        return docs.where(substring_predicate(place, value)), "the place has no words; searched as part of the field"
    return docs.where(_may_match(F.col(text), query) & text_predicate(tokens_of(F.col(text)), query) & F.contains(F.lower(place), F.lit(_tokens(query.terms[0])[0]))), None


def status_filter(jobs: DataFrame, status: str, wanted: tuple[str, ...]) -> DataFrame:
    return jobs.where(F.col(status).isin(*wanted))


def facts_by_type(values: DataFrame, id_col: str, type_col: str, value_col: str) -> DataFrame:
    """(id, type, values): a record's facts grouped by type for its card, in order."""
    return values.groupBy(id_col, type_col).agg(F.sort_array(F.collect_set(value_col)).alias("values"))


def listed(people: DataFrame, values: DataFrame, id_col: str, owner: str, type_col: str, value_col: str) -> DataFrame:
    """``people`` with facts, their ``type=value`` pairs in order, or null where there are none."""
    pair = F.concat_ws("=", type_col, value_col)
    facts = values.groupBy(F.col(owner).alias("_o")).agg(F.array_join(F.sort_array(F.collect_list(pair)), "|").alias("facts"))
    return people.join(facts, people[id_col] == facts["_o"], "left").drop("_o")


def card(people: DataFrame, docs: DataFrame, id_col: str, value, owner: str = "person_fact_id") -> DataFrame:
    """(field, value) rows of one record from both tables: bytes in hex, dates as dd.MM.yyyy, others as they are."""

    def shown(f) -> Column:
        c = F.col(f"`{f.name}`")
        kind = f.dataType.typeName()
        return F.concat(F.lit("0x"), F.hex(c)) if kind == "binary" else F.date_format(c, "dd.MM.yyyy") if kind == "date" else F.date_format(c, "dd.MM.yyyy HH:mm:ss") if kind == "timestamp" else c.cast("string") if kind not in ("array", "struct", "map") else F.to_json(c)

    def rows(df: DataFrame, key: str, name: str) -> DataFrame:
        made = F.array(*[F.struct(F.lit(name).alias("table"), F.lit(f.name).alias("field"), shown(f).alias("value")) for f in df.schema])
        return df.where(F.col(key) == value).select(F.explode(made).alias("r")).select("r.*")

    return rows(people, id_col, "person_facts").unionByName(rows(docs, owner, "search_docs"))


def starts_or_equals(column: str, value: str, exact: bool) -> Column:
    x, v = F.lower(F.col(column)), value.strip().lower()
    return x == v if exact else x.startswith(v)


def substring_predicate(column: str, value: str) -> Column:
    if len(value.strip()) < 2:
        raise SearchError("enter at least two characters")
    return F.contains(F.lower(F.col(column)), F.lit(value.lower()))


def with_identifier(people: DataFrame, values: DataFrame, value: str, type_: str | None = None, prefix: bool = False, id_col: str = "id") -> DataFrame:
    """People with a fact whose key equals ``value``'s key or begins with it."""
    spark = people.sparkSession
    key = spark.range(1).select((search_key(F.lit(type_), F.lit(value)) if type_ else search_key_any(F.lit(value))).alias("k")).first()[0]
    if not key:
        raise SearchError("the identifier has no letters or digits")
    hit = F.col("normalized_value").startswith(key) if prefix else F.col("normalized_value") == key
    found = values.where(hit & (F.col("fact_type") == type_) if type_ else hit)
    return people.join(found.select(F.col("person_fact_id").alias(id_col)), id_col, "left_semi")


def with_fact_type(people: DataFrame, values: DataFrame, type_: str, id_col: str = "id") -> DataFrame:
    return people.join(values.where(F.col("fact_type") == type_).select(F.col("person_fact_id").alias(id_col)), id_col, "left_semi")


def file_code_predicate(column: str, code: str) -> Column:
    value = code.strip().upper()
    return F.col(column) == value if re.fullmatch(r"T_\d{18}", value) else F.col(column).startswith(value)


def page(df: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """Rows of one page and one more, which tells that another page follows; sizes from 1 to 1000."""
    size = min(max(size, 1), 1000)
    return df.orderBy(*order).offset(max(number, 0) * size).limit(size + 1)


def keyset_page(df: DataFrame, id_col: str, after, size: int) -> DataFrame:
    return df.where(F.col(id_col) > after).orderBy(id_col).limit(size)
