"""A stored inverted index with positions: words, beginnings and phrases without reading any text.

``postings`` holds blocks (token, ids, ends, positions) in folders by token hash, sorted by token, so
that a search reads the folders of its words and in them the row groups whose range of tokens has one.  A
block is what a step of a task found of a word: its texts, the ends of their places in a row but the last, and the places.
``terms`` holds (token, folder, documents) sorted by token: a beginning is a range of it, and tells the folders.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import spaced_words
from .search import TextQuery, _tokens

FOLDERS = 64


def _folder(token: Column, folders: int) -> Column:
    return F.pmod(F.xxhash64(token), F.lit(folders)).cast("int")


def write_index(docs: DataFrame, id_col: str, text_col: str, path: str, folders: int = FOLDERS) -> None:
    """Writes the index of ``docs``, whose ids are unique; a text's places count from 0.

    Words are gathered where texts are read; blocks move and are sorted whole, and only a search takes them apart.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    said = docs.select(F.col(id_col).alias("id"), spaced_words(F.lower(F.col(text_col))).alias("words"))
    blocks = said.mapInArrow(_gather, f"token string, ids array<{kind}>, ends array<int>, positions array<int>").withColumn("folder", _folder(F.col("token"), folders))
    rows = blocks.hint("rebalance", "folder").sortWithinPartitions("folder", "token", F.get("ids", F.lit(0)))
    rows.write.mode("overwrite").option("compression", "zstd").option("parquet.block.size", 8 << 20).partitionBy("folder").parquet(f"{path}/postings")
    stored = docs.sparkSession.read.parquet(f"{path}/postings")
    stored.groupBy("token", "folder").agg(F.sum(F.size("ids")).alias("documents")).sort("token").write.mode("overwrite").parquet(f"{path}/terms")


#: Words of the texts that one step of a task gathers, and texts of a block.
STEP_WORDS, BLOCK_TEXTS = 1 << 20, 1 << 12


def _lists(starts: np.ndarray, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.r_[starts, len(values)].astype(np.int32)), values)


def _gather(batches):
    """(token, ids, ends, positions) of the different words of texts that are read together."""
    for b in batches:
        ids, texts = b.column(0), pc.ascii_trim_whitespace(b.column(1).cast(pa.large_string()).fill_null(""))
        # A text without words would be split into one empty word; spaces between words are single.
        counts = np.where(np.asarray(pc.binary_length(texts)) > 0, np.asarray(pc.count_substring(texts, " ")) + 1, 0)
        ends = np.cumsum(counts)
        row = 0
        while row < b.num_rows:
            stop = max(row + 1, int(np.searchsorted(ends, (ends[row - 1] if row else 0) + STEP_WORDS, "right")))
            sizes = counts[row:stop]
            owner = np.repeat(np.arange(stop - row), sizes)
            place = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            some = texts.slice(row, stop - row).filter(pa.array(sizes > 0))
            words = pc.split_pattern(some, " ").flatten().dictionary_encode()
            code = np.asarray(words.indices).astype(np.int64)
            order = np.argsort(code, kind="stable")  # within a word by text and place, as they come
            owner, code, place = owner[order], code[order], place[order]
            if len(owner):
                new = np.r_[True, code[1:] != code[:-1]]
                firsts = np.flatnonzero(new | np.r_[True, owner[1:] != owner[:-1]])  # of each posting
                begins = np.flatnonzero(new[firsts])  # the first posting of each word
                nth = np.arange(len(firsts)) - np.repeat(begins, np.diff(np.r_[begins, len(firsts)]))
                of_block = np.flatnonzero(nth % BLOCK_TEXTS == 0)  # the first posting of each block
                starts = firsts[of_block]
                documents = np.diff(np.r_[of_block, len(firsts)])
                until = np.r_[firsts[1:], len(owner)] - np.repeat(starts, documents)
                found = ids.take(pa.array(owner[firsts] + row))
                inner = np.ones(len(firsts), bool)
                inner[np.r_[of_block[1:], len(firsts)] - 1] = False  # a block's last end is the number of its places
                inner_ends = _lists(of_block - np.arange(len(of_block)), pa.array(until[inner].astype(np.int32)))
                columns = [words.dictionary.take(pa.array(code[starts])).cast(pa.string()), _lists(of_block, found), inner_ends, _lists(starts, pa.array(place.astype(np.int32)))]
                yield pa.RecordBatch.from_arrays(columns, names=["token", "ids", "ends", "positions"])
            row = stop


def _postings(blocks: DataFrame) -> DataFrame:
    """(token, id, positions) of the texts in ``blocks``."""

    def posting(i: Column) -> Column:
        start, end = F.coalesce(F.get("ends", i - 1), F.lit(0)), F.coalesce(F.get("ends", i), F.size("positions"))
        return F.struct(F.get("ids", i).alias("id"), F.slice(F.col("positions"), start + 1, end - start).alias("positions"))

    return blocks.select("token", F.explode(F.transform(F.sequence(F.lit(0), F.size("ids") - 1), posting)).alias("p")).select("token", "p.id", "p.positions")


def _between(token: Column, word: str, prefix: bool) -> Column:
    """The words that a part of a query stands for; a range first, which files are pruned by."""
    return (token >= word) & token.startswith(word) if prefix else token == word


class PositionIndex:
    def __init__(self, spark: SparkSession, path: str, folders: int = FOLDERS):
        self.spark, self.path, self.folders = spark, path, folders
        self.terms = spark.read.parquet(f"{path}/terms")
        self.blocks = spark.read.parquet(f"{path}/postings")

    def parts(self, query: TextQuery) -> list[list[tuple[str, bool]]]:
        """Each term as (word, is a beginning) parts in a row."""
        terms = [" ".join(query.terms)] if query.mode == "phrase" else query.terms
        out = []
        for term in terms:
            words = _tokens(term)
            out.append([(w, term.endswith("*") and i == len(words) - 1) for i, w in enumerate(words)])
        return out

    def postings(self, query: TextQuery) -> DataFrame:
        """The postings of all words of a query, from their folders only."""
        parts = {p for term in self.parts(query) for p in term}
        hit = [_between(F.col("token"), w, prefix) for w, prefix in sorted(parts)]
        some = hit[0]
        for h in hit[1:]:
            some = some | h
        # As many numbers as there are folders at most.
        wanted = [r[0] for r in self.terms.where(some).select("folder").distinct().collect()]
        return _postings(self.blocks.where(F.col("folder").isin(wanted) & some))

    def search(self, query: TextQuery) -> DataFrame:
        """(id, rank) of the matching texts, as ``search.text_search`` ranks them: occurrences of the query's words."""
        found = self.postings(query)
        # A text's postings are as many as the words that it has of the query.
        held = found.groupBy("id").agg(F.collect_list(F.struct("token", "positions")).alias("held"))

        def places(part: tuple[str, bool], back: int) -> Column:
            mine = F.filter("held", lambda h: _between(h["token"], *part))
            return F.flatten(F.transform(mine, lambda h: F.transform(h["positions"], lambda p: p - back)))

        whole = None
        for term in self.parts(query):
            starts = places(term[0], 0)
            for back, part in enumerate(term[1:], 1):
                starts = F.array_intersect(starts, places(part, back))
            hit = F.size(starts) > 0
            whole = hit if whole is None else (whole | hit if query.mode == "any" else whole & hit)
        words = sorted({w for term in self.parts(query) for w, _ in term})
        rank = F.aggregate(F.filter("held", lambda h: h["token"].isin(words)), F.lit(0).cast("long"), lambda n, h: n + F.size(h["positions"]))
        return held.where(whole).select("id", rank.alias("rank"))

    def count(self, query: TextQuery) -> int:
        """How many texts match; a single word is answered by its entry among the terms."""
        parts = self.parts(query)
        if len(parts) == 1 and len(parts[0]) == 1 and not parts[0][0][1]:
            return self.terms.where(F.col("token") == parts[0][0][0]).agg(F.coalesce(F.sum("documents"), F.lit(0))).first()[0]
        return self.search(query).count()
