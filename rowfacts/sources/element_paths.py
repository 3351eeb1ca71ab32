"""Element paths of XML files with their counts, by a table function that streams each file's events."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .records import _declares_entities, _open

#: Different paths of one file that are counted; a file with more is no file of records.
MOST_PATHS = 100_000


@F.udtf(returnType="path string, n long")
class ElementPaths:
    """(path, n) of a file's elements by local names; of a broken file those before the fault, of one that declares entities none."""

    def eval(self, file: str):
        from xml.etree import ElementTree

        counts: Counter = Counter()
        with _open(file) as source:
            if _declares_entities(source):
                return
            source.seek(0)
            above, names = [], []
            try:
                for event, e in ElementTree.iterparse(source, events=("start", "end")):
                    if event == "start":
                        above.append(e)
                        names.append((names[-1] + "/" if names else "") + e.tag.rpartition("}")[2])
                        counts[names[-1]] += 1
                        if len(counts) > MOST_PATHS:
                            raise ValueError(f"{file} has over {MOST_PATHS} element paths")
                    else:
                        names.pop()
                        above.pop()
                        if above:
                            above[-1].remove(e)
            except ElementTree.ParseError:
                pass
        yield from counts.items()


def element_paths(spark: SparkSession, path: str) -> DataFrame:
    """(file_id, path, n) of all XML files at ``path``; the function is also known to SQL as element_paths(file)."""
    spark.udtf.register("element_paths", ElementPaths)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select(F.col("path").alias("file_id"))
    return files.lateralJoin(ElementPaths(F.col("file_id").outer()))
