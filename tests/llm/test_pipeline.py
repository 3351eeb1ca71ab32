"""Each stage of the pipeline against a brute-force version on the rows that its predecessor kept, and edge cases of the whole."""

from collections import defaultdict

import corpus_pipeline
import numpy as np
import pytest
from llm import queries, toxicity
from tokenizers import Tokenizer

from .conftest import EDGE_ROWS, UPPER, WORDS
from .test_pairs import brute_components, brute_repeats


def brute_toxic(docs, labels, weights):
    """Ids whose score, a sum over the distinct features of the one text, is over the threshold."""
    gone = set()
    for r in docs:
        raw = np.frombuffer((r.text or "").encode(), np.uint8)
        _, features = toxicity.text_features(raw, np.array([0, len(raw)]))
        if 1 / (1 + np.exp(-(weights[-1] + weights[features].sum()))) >= toxicity.THRESHOLD:
            gone.add(r.doc_id)
    return gone


def test_stages_equal_brute_force(spark):
    sf_dir = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("length(text) < 6000 OR doc_id < 300").cache()
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "exact_dedup", "near_dedup", "substring_dedup", "packing"]

    def kept_by(name, docs):
        kept = stages[name](spark, docs, sf_dir)
        assert kept.columns == docs.columns
        return kept.cache()

    rows = docs.collect()
    known = labels.selectExpr("doc_id AS id", "CAST(toxic AS INT) AS label").where(~toxicity.held_out("id"))
    weights = toxicity.learn(docs.select("doc_id", "text").where(~toxicity.held_out("doc_id")), known)
    gone = brute_toxic(rows, labels, weights)
    clean = kept_by("toxicity", docs)
    assert gone and {r.doc_id for r in clean.collect()} == {r.doc_id for r in rows} - gone

    last = {}
    for r in sorted(clean.collect(), key=lambda r: r.doc_id):
        last[(r.text or "").translate(UPPER)] = r.doc_id
    single = kept_by("exact_dedup", clean)
    assert {r.doc_id for r in single.collect()} == set(last.values()) and len(last) < clean.count()

    rows = [(r.doc_id, r.text) for r in single.collect()]
    expected = {i for i, (_, c) in brute_components(rows, 5, 80, 100).items() if i == c}
    apart = kept_by("near_dedup", single)
    assert {r.doc_id for r in apart.collect()} == expected and len(expected) < len(rows)

    rows = {r.doc_id: r for r in apart.collect()}
    cut = kept_by("substring_dedup", apart)
    got = {r.doc_id: r for r in cut.collect()}
    repeats = brute_repeats([(i, r.text) for i, r in rows.items()], 20)
    assert set(got) == set(rows) and any(n for _, n, _ in repeats.values())
    for i, (_, removed, text) in repeats.items():
        assert got[i].text == (text if removed else rows[i].text)
        assert got[i].n_chars == len(got[i].text or "")

    library = Tokenizer.from_file(queries.tokenizer_path("word_bpe_49k.json"))
    parts, places = defaultdict(list), defaultdict(list)
    for p in stages["packing"](spark, cut, sf_dir).collect():
        parts[p.doc_id].append((p.start, p.length, p.doc_tokens))
        places[p.sequence_id].append((p.offset, p.length))
    assert set(parts) == set(got)
    for i, found in parts.items():
        size = len(library.encode(got[i].text or "", add_special_tokens=False).ids) + 1
        assert [a for a, _, _ in sorted(found)] == list(range(0, size, 2048)) and sum(n for _, n, _ in found) == size == found[0][2]
    for found in places.values():
        at = 0
        for offset, length in sorted(found):
            assert offset == at
            at += length
        assert at <= 2048


def test_pipeline_takes_edge_cases(spark, edge_docs, tmp_path):
    edge_docs.withColumnRenamed("doc_key", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 0, 0), (1, None, None), (None, 1, 1), (2, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    texts = {(r[1] or "").translate(UPPER) for r in EDGE_ROWS}
    assert len({(p.doc_id, p.doc_tokens) for p in pieces}) <= len(texts)
    assert {p.doc_id for p in pieces} >= {2, 7, 9} and any(len(WORDS.findall(r[1] or "")) for r in EDGE_ROWS)


@pytest.mark.parametrize("rows", [0])
def test_pipeline_takes_empty_tables(spark, edge_docs, tmp_path, rows):
    edge_docs.limit(rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_queries():
    assert len(queries.queries()) == 10 and set(queries.oracle_sql()) <= set(queries.queries())
