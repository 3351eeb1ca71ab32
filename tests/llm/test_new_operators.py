"""Quality classifier, whitening and conversation trie."""

import hashlib
import math
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from llm import conversation_trie, quality, whitening
from llm.queries import op11_quality_classifier, op12_embedding_whitening, op13_conversation_trie
from llm.words import steps
from pyspark.sql import functions as F

from .conftest import EDGE_ROWS, WORDS


def _moments(x, y):
    i, j = np.triu_indices(quality.SIZE)
    out = {}
    for k in (0, 1):
        of = x[y == k].astype(np.int64)
        for cell, v in enumerate([len(of), *of.sum(axis=0).tolist(), *(of.T @ of)[i, j].tolist()]):
            out[k, cell] = v
    return out


def test_discriminant_against_brute_force():
    """Scores of the cached factors equal log densities by determinants and inverses."""
    rng = np.random.default_rng(3)
    y = (rng.random(400) < 0.7).astype(int)
    x = (rng.normal(size=(400, quality.SIZE)) * (1 + y[:, None]) * 300 + 200 * y[:, None]).astype(np.int64)
    model = quality.make_model(_moments(x, y), common=0.2, sphere=0.05)
    covariance = [np.cov(x[y == k].T, bias=True) for k in (0, 1)]
    share = [np.mean(y == k) for k in (0, 1)]
    pooled = share[0] * covariance[0] + share[1] * covariance[1]
    scale = np.diag(1 / np.sqrt(np.diag(pooled)))
    density = []
    for k in (0, 1):
        v = scale @ (0.8 * covariance[k] + 0.2 * pooled) @ scale
        v = 0.95 * v + 0.05 * np.eye(len(v)) * np.trace(v) / len(v)
        z = (x - x[y == k].mean(axis=0)) @ scale
        prior = math.log(((y == k).sum() + 0.5) / 401)
        density.append(prior - 0.5 * np.linalg.slogdet(v)[1] - 0.5 * np.einsum("ni,ij,nj->n", z, np.linalg.inv(v), z))
    assert np.allclose(model.score(x), 1 / (1 + np.exp(-np.clip(density[1] - density[0], -60, 60))), atol=1e-9)


def test_statistics_by_hand():
    import pyarrow as pa

    texts = ["One two!! THREE.\nOne two!! THREE.\n|", "", None, "É9 a"]
    ((_, _, raw, offsets),) = steps(pa.array(texts))
    found = quality.text_statistics(raw, offsets) / quality.UNIT
    of = dict(zip(quality.STATISTICS, found[0], strict=True))

    def odds(part, whole):
        return math.log((part + 0.5) / (whole - part + 0.5))

    near = 1 / quality.UNIT
    assert abs(of["words"] - math.log(8)) < near and abs(of["repeated_lines"] - odds(3, 7)) < near and abs(of["capital_words"] - odds(2, 7)) < near
    assert abs(of["bare_words"] - odds(1, 7)) < near and abs(of["trailing_signs"] - odds(2, 7)) < near and abs(of["distinct"] - odds(4, 7)) < near
    assert abs(of["upper"] - odds(12, 22)) < near and abs(of["repeated_runs"] - odds(1, 5)) < near and abs(of["line_words"] - math.log1p(7 / 3)) < near
    assert (found[1] == found[2]).all() and np.isfinite(found).all()
    assert abs(dict(zip(quality.STATISTICS, found[3], strict=True))["upper"] - odds(1, 2)) < near


def test_quality_held_out(spark, sf_dir, edge_docs, no_docs):
    d = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.quality for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    rows = op11_quality_classifier(spark, d).collect()
    assert len(rows) == spark.read.parquet(f"{d}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    held = [(truth[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in truth]
    assert sum(a == b for a, b in held) >= 0.95 * len(held)
    labels = spark.createDataFrame([(1, 1), (4, 0), (5, 1), (5, 0), (7, None), (None, 1), (9, 3)], "doc_id long, quality int")
    made = quality.score_documents(edge_docs, labels)
    assert made.columns == ["doc_key", "doc_id", "held_out", "score", "predicted"]
    found = made.collect()
    assert len(found) == len(EDGE_ROWS) == len({r.doc_key for r in found}) and all(0 <= r.score <= 1 for r in found)
    assert {r.score for r in quality.score_documents(edge_docs, labels.limit(0)).collect()} == {0.5}
    assert len({r.score for r in quality.score_documents(edge_docs, labels.where("quality = 1")).collect()}) == 1
    assert quality.score_documents(no_docs, labels).count() == 0


def _whitened(rows, weights="one"):
    """rows: (id, vector); brute force with whole lists."""
    kept = [(i, tuple(math.floor(256 * float(c)) for c in v)) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    counts = defaultdict(int)
    for _, x in kept:
        counts[x] += 1
    fit = sorted(counts)
    w = np.array([1 if weights == "one" else counts[x] for x in fit])
    n, x = int(w.sum()), np.array(fit)
    s = [sum(int(k) * int(v[i]) for k, v in zip(w, fit, strict=True)) for i in range(x.shape[1])]
    centred = x - np.array(s) / n
    values, axes = np.linalg.eigh((centred * w[:, None]).T @ centred / n)
    deviation = {v: sum((n * v[i] - s[i]) ** 2 for i in range(len(s))) for v in fit}
    return kept, n, values[::-1], axes[:, ::-1], deviation, np.array(s) / n


@pytest.mark.parametrize("weights", ["one", "count"])
def test_whitening_against_brute_force(spark, weights):
    rng = np.random.default_rng(5)
    rows = [(i, [float(c) for c in rng.normal(size=6) * (1, 2, 3, 4, 5, 6) * 0.1]) for i in range(200)]
    rows += [(1000 + i, rows[3][1]) for i in range(100)]  # a hot vector
    rows += [(7, None), (8, [1.0, None] + [0.0] * 4), (9, [math.nan] + [0.0] * 5), (10, [math.inf] + [0.0] * 5), (None, rows[0][1]), (7, rows[0][1]), (11, []), (12, [1.0])]
    made = whitening.whiten(spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<float>, component int, digest string").repartition(5), weights=weights).collect()
    kept, n, values, axes, deviation, mean = _whitened([(i, None if v is None else [None if c is None else float(np.float32(c)) for c in v]) for i, v in rows if v is None or len(v) == 6], weights)
    assert len(made) == 4 * len(kept)
    by = defaultdict(list)
    for r in made:
        by[r.vec_id, r.component].append(r)
    for k in range(4):
        expected = [(i, float((np.array(x) - mean) @ axes[:, k] / math.sqrt(values[k])), deviation[x]) for i, x in kept]
        sign = np.sign(by[1, k + 1][0].whitened * next(w for i, w, _ in expected if i == 1))
        for i, w, d in expected:
            assert any(abs(r.whitened - sign * w) < 1e-9 and int(r.deviation) == d and r.n == n and abs(r.explained - values[k] / values.sum()) < 1e-9 and r.identity_error < 1e-9 for r in by[i, k + 1])


def test_whitening_edges(spark):
    def made(rows, **more):
        return whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), **more)

    assert made([]).count() == 0 and made([(1, None), (2, [])]).count() == 0
    alone = made([(1, [0.5, 1.0]), (2, [0.5, 1.0])]).collect()
    assert len(alone) == 4 and all(r.whitened is None and r.explained == 0 and r.identity_error == 0 and r.deviation == 0 and r.n == 1 for r in alone)
    flat = made([(1, [0.0, 1.0]), (2, [1.0, 1.0]), (3, [2.0, 1.0])]).collect()
    assert {(r.component, r.whitened is None) for r in flat} == {(1, False), (2, True)}
    big = made([(1, [1e15, 0.0]), (2, [-1e15, 1.0]), (3, [5.0, 3.0])]).collect()
    x = [(256 * 10**15, 0), (-256 * 10**15, 256), (1280, 768)]
    s = [sum(v[i] for v in x) for i in (0, 1)]
    assert {r.vec_id: int(r.deviation) for r in big} == {i + 1: sum((3 * v[k] - s[k]) ** 2 for k in (0, 1)) for i, v in enumerate(x)}
    with pytest.raises(ValueError):
        made([(1, [1.0])], weights="other")


def test_whitening_of_the_table(spark, sf_dir):
    rows = op12_embedding_whitening(spark, sf_dir).collect()
    source = spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()
    _, n, values, _, deviation, _ = _whitened([(r.vec_id, r.embedding) for r in source])
    assert len(rows) == 4 * len(source) and {r.n for r in rows} == {n} and max(r.identity_error for r in rows) < 1e-9
    assert sorted({r.explained for r in rows}, reverse=True) == pytest.approx((values[:4] / values.sum()).tolist())
    assert sum(r.deviation for r in rows) == 4 * sum(deviation[tuple(math.floor(256 * c) for c in r.embedding)] for r in source)


def _element(role, text):
    return hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()[:16]


def _trie(rows, family=None, heads=4):
    """Nodes by whole prefixes; rows: (conv, turn, role, text)."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, _element(role or "", text or ""), role or "", text or ""))
    own = {c: [x[3:] for x in sorted(v)] for c, v in own.items()}
    if family:
        h = {c: zlib.crc32(str(c).encode()) % heads for c in own}
        made = {c: own.get(c - int(math.fmod(c, family)), [])[: h[c]] + own[c][h[c] :] for c in own}
    else:
        made = own
    members = defaultdict(list)
    for c, v in made.items():
        for d in range(len(v) + 1):
            members[tuple(v[:d])].append(c)
    out = []
    for node, m in members.items():
        below = [x for x in members if x[: len(node)] == node]
        ends = ",".join(str(c) for c in sorted(c for c in m if len(made[c]) == len(node)))
        out.append((
            min(m), len(node), min(members[node[:-1]]) if node else None, len(m), sum(len(x) == len(node) + 1 for x in below),
            sum(not any(y[: len(x)] == x and len(y) > len(x) for y in below) for x in below),
            sum((len(members[x]) - 1) * len(WORDS.findall(x[-1][1])) for x in below if x), hashlib.sha256(ends.encode()).hexdigest(),
        ))
    return out


def _same(found, expected):
    key = lambda r: tuple((x is not None, x or 0) if not isinstance(x, str) else x for x in r)
    assert sorted((tuple(r) for r in found), key=key) == sorted(expected, key=key)


_SCHEMA = "conv_id long, turn long, role string, text string, depth int, group string"


def _frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], _SCHEMA).repartition(4)


def _random_rows(seed, convs=40, longest=9):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(-5, 200), convs):
        for t in range(rng.randint(1, longest)):
            rows.append((c, rng.choice([t, t, t, 2, None]), rng.choice(["user", "assistant", None, ""]), rng.choice(["ok", "a b  c", "", None, "x\ty"])))
    return rows


@pytest.mark.parametrize(("band", "heavy"), [(64, None), (2, 3), (1, 0)])
def test_trie_against_brute_force(spark, monkeypatch, band, heavy):
    monkeypatch.setattr(conversation_trie, "CHUNK_IDS", 2)
    for seed, family in ((1, 20), (2, None)):
        rows = _random_rows(10 * band + seed)
        turns = conversation_trie.rebuilt(_frame(spark, rows)) if family else conversation_trie.plain(_frame(spark, rows))
        _same(conversation_trie.prefix_trie(turns, band=band, heavy=heavy).collect(), _trie(rows, family))


def test_trie_of_hot_conversations(spark):
    """One very long conversation, many equal ones, one common first turn, repeated rows, turnless rebuilt ones."""
    rows = [(3, t, "user", f"w {t % 7}") for t in range(400)] + [(5, 1, "user", "same")] * 90
    rows += [(c, t, "user", f"t {t}") for c in range(100, 180) for t in range(3)] + [(c, 0, "user", "hello there") for c in range(200, 260)] + [(c, 1, "user", f"{c} b") for c in range(200, 260)]
    rows += [(None, 0, "user", "x"), (1001, 0, "user", "gone"), (1002, 0, "u", "gone"), (1003, 0, "u", "gone")]
    found = conversation_trie.prefix_trie(conversation_trie.rebuilt(_frame(spark, rows)), band=8, heavy=20).collect()
    _same(found, _trie(rows, 20))


def test_trie_edges(spark, sf_dir):
    empty = conversation_trie.prefix_trie(conversation_trie.rebuilt(_frame(spark, [])))
    assert empty.collect() == [] and empty.columns[0] == "conv_id"
    assert conversation_trie.prefix_trie(conversation_trie.rebuilt(_frame(spark, [(None, 1, "a", "b")]))).count() == 0
    turnless = next(c for c in range(20, 400) if c % 20 and zlib.crc32(str(c).encode()) % 4 == 3)
    (only,) = conversation_trie.prefix_trie(conversation_trie.rebuilt(_frame(spark, [(turnless, 0, "a", "b")]))).collect()
    assert tuple(only) == (turnless, 0, None, 1, 0, 1, 0, hashlib.sha256(str(turnless).encode()).hexdigest())
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    _same(op13_conversation_trie(spark, sf_dir).collect(), _trie(rows, 20))


def test_message_queue_spills():
    rng = random.Random(4)
    queue, expected = conversation_trie.MessageQueue(limit=16), defaultdict(lambda: [0, 0])
    for depth in range(9, 0, -1):
        for _ in range(100):
            key, leaves, saved = bytes([rng.randrange(30)] * 16), rng.randrange(5), rng.randrange(1000)
            queue.push(depth, key, leaves, saved)
            expected[depth, key][0] += leaves
            expected[depth, key][1] += saved
        for k in range(30):
            key = bytes([k] * 16)
            assert queue.take(depth, key) == tuple(expected[depth, key])
    assert queue.spilled > 10 and not queue.heap and all(r[0] is None for r in queue.runs)
