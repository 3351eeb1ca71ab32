"""Exact dedup, Jaccard join and repeated passages against brute force."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from llm import exact_dedup, jaccard_join, substring_dedup
from llm.graph import components

from .conftest import EDGE_ROWS, UPPER, WORDS


def word_texts(n, seed, vocabulary="abcdefgh", longest=40):
    rng = random.Random(seed)
    rows = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, longest))) for _ in range(n)]
    for _ in range(n // 2):  # near copies
        words = rng.choice(rows).split()
        if words:
            words[rng.randrange(len(words))] = rng.choice("xyz")
        rows.append(" ".join(words))
    return list(enumerate(rows))


def test_exact_groups(spark):
    rows = word_texts(150, 1, "aAb", 4) + [(900, None)]
    got = exact_dedup.text_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    groups = defaultdict(list)
    for i, t in rows:
        groups[(t or "").translate(UPPER)].append(i)
    expected = {i: (max(g), len(g), i == max(g)) for g in groups.values() for i in g}
    assert {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in got} == expected


def test_exact_edges(spark, edge_docs, no_docs):
    got = exact_dedup.text_groups(edge_docs).collect()
    assert len(got) == len(EDGE_ROWS)
    assert sum(r.kept for r in got) == len({(r[1] or "").translate(UPPER) for r in EDGE_ROWS})
    kept = exact_dedup.drop_copies(edge_docs)
    assert kept.columns == edge_docs.columns and kept.count() == sum(r.kept for r in got)
    assert exact_dedup.text_groups(no_docs).count() == 0


def shingles(text, k):
    words = WORDS.findall((text or "").translate(UPPER))
    if len(words) < k:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)}


def brute_components(rows, k, num, den):
    sets = {i: shingles(t, k) for i, t in rows}
    index, shared = defaultdict(list), Counter()
    for i, s in sets.items():
        for x in s:
            index[x].append(i)
    for ids in index.values():
        shared.update((a, b) for n, a in enumerate(ids) for b in ids[n + 1 :])
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (a, b), o in shared.items():
        if den * o >= num * (len(sets[a]) + len(sets[b]) - o):
            a, b = sorted((find(a), find(b)))
            parent[b] = a
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize(("k", "num", "den", "hot", "cluster"), [(4, 85, 100, 1000, 512), (2, 60, 100, 3, 4), (3, 30, 100, 5, 3)])
def test_jaccard_components(spark, monkeypatch, k, num, den, hot, cluster):
    monkeypatch.setattr(jaccard_join, "HOT_LIST", hot)
    monkeypatch.setattr(jaccard_join, "CLUSTER_ROWS", cluster)
    rows = word_texts(80, k) + [(900, None), (901, "")]
    got = jaccard_join.near_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), shingle_words=k, num=num, den=den).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_components(rows, k, num, den)


@pytest.mark.parametrize(("k", "num", "hot", "cluster"), [(4, 85, 1000, 512), (2, 60, 3, 4), (3, 30, 5, 3)])
def test_jaccard_pairs_and_links(spark, monkeypatch, k, num, hot, cluster):
    monkeypatch.setattr(jaccard_join, "HOT_LIST", hot)
    monkeypatch.setattr(jaccard_join, "CLUSTER_ROWS", cluster)
    rows = word_texts(60, k + 1)
    rows += [(500 + i, t) for i, t in rows[:40:3]] + [(900, None), (901, ""), (902, "")]
    sets = {i: shingles(t, k) for i, t in rows}
    links = {(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b])}
    first = {}
    of = {i: first.setdefault(frozenset(s), i) if s else i for i, s in sorted(sets.items())}
    classes, pairs = jaccard_join.near_pairs(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), shingle_words=k, num=num)
    assert sorted(map(tuple, pairs.collect())) == sorted({tuple(sorted((of[a], of[b]))) for a, b in links if of[a] != of[b]})
    degree = Counter(x for p in links for x in p)
    got = {r.doc_id: (r.class_key, r.n_links, r.n_shingles) for r in classes.collect()}
    assert got == {i: (of[i], degree[i], len(sets[i])) for i in sets}


def test_large_clusters_move_few_texts(spark, monkeypatch):
    """Members of one hot list that share little: their sketches rule the pairs out before texts move."""
    monkeypatch.setattr(jaccard_join, "CLUSTER_ROWS", 8)
    monkeypatch.setattr(jaccard_join, "HOT_LIST", 10)
    rng = random.Random(4)
    line = "this very line is on every page of the site"
    rows = [(i, f"{line} " + " ".join(rng.choice("abcdefghijklmnopqrstuvwxyz") * 2 for _ in range(30))) for i in range(60)]
    rows += [(100 + i, t + " end") for i, t in rows[:6]]
    got = jaccard_join.near_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), shingle_words=3, num=60).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_components(rows, 3, 60, 100)
    n = np.full(40, 100)
    sketches = [jaccard_join.sketch(np.random.default_rng(i).integers(0, 1 << 63, 100).astype(np.uint64)) for i in range(39)]
    sketches.append(sketches[0])
    block, away = np.arange(40) % 2, np.ones(40, bool)
    may = np.flatnonzero(jaccard_join.may_link(sketches, n, 80, 100, block, away)).tolist()
    assert {0, 39} <= set(may) and len(may) < 15
    assert not jaccard_join.may_link(sketches, n, 80, 100, block, ~away).any()


def test_sketches_bound_overlaps():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 4000).astype(np.uint64)
    sets = [np.unique(np.r_[base[a : a + n], rng.integers(0, 1 << 63, extra).astype(np.uint64)]) for a, n, extra in ((0, 900, 60), (20, 900, 50), (0, 1000, 0), (3000, 900, 0), (0, 30, 1), (0, 31, 0), (2000, 5, 0))]
    n = np.array([len(s) for s in sets])
    linked = [any(100 * len(np.intersect1d(a, b)) >= 80 * len(np.union1d(a, b)) for j, b in enumerate(sets) if i != j) for i, a in enumerate(sets)]
    assert linked == [True, True, True, False, True, True, False]
    assert jaccard_join.may_link([jaccard_join.sketch(s) for s in sets], n, 80, 100).tolist() == linked
    assert jaccard_join.may_link([np.zeros(0, np.uint8)] * 2, n[:2], 80, 100).all()


def test_clusters_give_a_spanning_forest():
    rng = np.random.default_rng(5)
    base = np.unique(rng.integers(0, 1 << 63, 60).astype(np.uint64))
    leader, *sets = (np.sort(rng.choice(base[a : a + 30], 24, replace=False)) for a in [0, *rng.integers(0, 30, 90)])
    home, pairs = jaccard_join.cluster_links(leader, sets, np.zeros(len(sets), int), 60, 100)
    assert len(pairs) + home.sum() <= len(sets)

    def joined(links):
        part = {i: i for i in range(len(sets) + 1)}
        for i, j in links:
            a, b = part[i], part[j]
            part = {k: min(a, b) if v in (a, b) else v for k, v in part.items()}
        return part

    every = [*sets, leader]
    linked = [(i, j) for i in range(len(every)) for j in range(i) if 100 * len(np.intersect1d(every[i], every[j])) >= 60 * len(np.union1d(every[i], every[j]))]
    assert len(linked) > len(every)
    assert joined([(len(sets), i) for i in np.flatnonzero(home)] + pairs.tolist()) == joined(linked)


def test_jaccard_edges(edge_docs, no_docs):
    got = jaccard_join.near_groups(edge_docs, shingle_words=4, num=85).collect()
    assert len(got) == len(EDGE_ROWS)
    same = {r.component_key for r in got if r.n_shingles == 5}
    assert len(same) == 1
    assert jaccard_join.drop_near_copies(edge_docs).columns == edge_docs.columns
    assert jaccard_join.near_groups(no_docs).count() == 0


def test_components(spark):
    edges = [(1, 2), (2, 3), (9, 8), (5, 5), (3, 4)] + [(100 + i, 101 + i) for i in range(40)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 8: 8, 9: 8} | {100 + i: 100 for i in range(41)}


def brute_repeats(rows, window):
    seen, out = set(), {}
    for i, t in sorted(rows):
        words = WORDS.findall(t or "")
        gone = [False] * len(words)
        for s in range(len(words) - window + 1):
            key = tuple(words[s : s + window])
            if key in seen:
                gone[s : s + window] = [True] * window
            seen.add(key)
        out[i] = len(words), sum(gone), " ".join(w for w, g in zip(words, gone, strict=True) if not g)
    return out


@pytest.mark.parametrize(("window", "combine"), [(1, 20), (3, 50), (20, 1 << 20)])
def test_repeated_passages(spark, monkeypatch, window, combine):
    monkeypatch.setattr(substring_dedup, "COMBINE_ROWS", combine)
    rng = random.Random(window)
    passage = " ".join(rng.choice("pqrst") for _ in range(30))
    rows = [(i, f"{t} {passage}" if i % 7 == 0 else t) for i, t in word_texts(60, window, "abc", 60)]
    got = substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), window=window).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in got} == brute_repeats(rows, window)


def test_covers():
    for period, cover in substring_dedup.COVERS.items():
        assert {(a - b) % period for a in cover for b in cover} == set(range(period))


def test_repeat_edges(edge_docs, no_docs):
    got = substring_dedup.remove_repeats(edge_docs, window=4).collect()
    assert len(got) == len(EDGE_ROWS)
    assert sorted((r.n_words, r.n_removed) for r in got if r.n_words == 8) == [(8, 0), (8, 6), (8, 8)]
    cut = substring_dedup.drop_repeats(edge_docs, window=4)
    assert cut.columns == edge_docs.columns and cut.count() == len(EDGE_ROWS)
    assert substring_dedup.remove_repeats(no_docs).count() == 0


def test_passages_hold_one_python_worker_a_task(edge_docs):
    def longest(node, n=0):
        """Most Python steps in a row that no shuffle divides."""
        name = node.nodeName()
        n = 0 if "SortMergeJoin" in name or "Aggregate" in name else n + (name == "MapInArrow")
        children = node.children()
        return max([n, *(longest(children.apply(i), n) for i in range(children.size()))])

    for made in (substring_dedup.remove_repeats(edge_docs, window=4), substring_dedup.drop_repeats(edge_docs, window=4)):
        assert longest(made._jdf.queryExecution().sparkPlan()) == 1


def test_clusters_of_long_texts_are_cut_by_shingles(spark, monkeypatch):
    """A cluster of few but long texts is compared in several blocks, with the links of one."""
    rng = random.Random(8)
    base = [f"w{rng.randrange(1000)}" for _ in range(3000)]
    rows = []
    for i in range(12):
        words = list(base)
        for _ in range(rng.randrange(0, 40)):
            words[rng.randrange(len(words))] = f"x{rng.randrange(99)}"
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")

    def found():
        return sorted(map(tuple, jaccard_join.near_pairs(docs)[1].collect())), sorted(map(tuple, jaccard_join.near_groups(docs).collect()))

    whole = found()
    monkeypatch.setattr(jaccard_join, "BLOCK_SHINGLES", 9000)
    assert found() == whole and len(whole[0]) > 12
