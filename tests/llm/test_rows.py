"""Packing, piece codec, classifiers, pages, chats and media."""

import bisect
import random
import time
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from llm import chat_format, html_text, language_id, mpeg_audio, packing, piece_codec, toxicity
from llm.queries import tokenizer_path
from pyspark.sql import functions as F

from .conftest import EDGE_ROWS


def test_plan_is_best_fit_decreasing():
    rng = random.Random(5)
    for _ in range(60):
        capacity = rng.randint(1, 40)
        counts = {s: rng.randint(1, 20) for s in rng.sample(range(1, capacity + 1), rng.randint(1, capacity))}
        rows, windows = defaultdict(list), defaultdict(list)
        for r in packing.plan(counts, capacity):
            rows[r[0]].append(r)
        for size, n in counts.items():
            for k in range(n):
                r = rows[size][bisect.bisect_right([x[1] for x in rows[size]], k) - 1]
                windows[r[2] + (k - r[1]) // r[3]].append((r[4] + (k - r[1]) % r[3] * size, size))
        left = []
        for v in windows.values():
            at = 0
            for offset, size in sorted(v):
                assert offset == at
                at += size
            left.append(capacity - at)
        bins: list[int] = []
        for size in sorted(counts, reverse=True):
            for _ in range(counts[size]):
                best = min((b for b in range(len(bins)) if bins[b] >= size), key=lambda b: bins[b], default=None)
                if best is None:
                    bins.append(capacity - size)
                else:
                    bins[best] -= size
        assert sorted(bins) == sorted(left) and sorted(windows) == list(range(len(windows)))


def test_packing_round_trip(spark, sf_dir, edge_docs, no_docs):
    from tokenizers import Tokenizer

    path = tokenizer_path("word_bpe_49k.json")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    pieces = packing.pack(docs, path, capacity=256, keep_ids=True).collect()
    library = Tokenizer.from_file(path)
    parts = defaultdict(list)
    for p in pieces:
        parts[p.doc_id].append((p.start, p.ids))
    for r in docs.collect():
        ids = [i for _, x in sorted(parts[r.doc_id]) for i in x]
        assert ids == [*library.encode(r.text or "", add_special_tokens=False).ids, 1]
    sequences = defaultdict(list)
    for p in pieces:
        sequences[p.sequence_id].append((p.offset, p.length))
    for v in sequences.values():
        at = 0
        for offset, length in sorted(v):
            assert offset == at
            at += length
        assert at <= 256
    total = sum(p.length for p in pieces)
    assert total / (256 * len(sequences)) > 0.97
    assert packing.pack(edge_docs, path).select("doc_key").distinct().count() == len(EDGE_ROWS)
    assert packing.pack(no_docs, path).count() == 0
    packed = packing.sequences(packing.pack(docs.limit(20), path, capacity=256, keep_ids=True), 256, 0).collect()
    assert all(len(s.ids) == len(s.segments) == 256 for s in packed)


def test_word_ids_equal_the_library():
    ids = packing.WordIds(tokenizer_path("word_bpe_49k.json"))
    rng = random.Random(2)
    signs = [" ", "\x0b", "\x1c", "\x85", "\xa0", "'s", "A", "É", "日", "🎉", "\n", "<|endoftext|>", "the", "12", " ́", ",", "###", "_"]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 20))) for _ in range(1500)]
    for t, got in zip(texts, ids.encode([t.encode() for t in texts]), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == ids.tokenizer.encode(t, add_special_tokens=False).ids


def test_texts_encoded_together_are_bounded_by_bytes():
    sizes = np.array([0, 5 << 20, 1, 0, 3 << 20, 1 << 20, 7] + [10] * 2000)
    groups = list(packing._groups(sizes))
    assert [g.start for g in groups[1:]] == [g.stop for g in groups[:-1]] and groups[-1].stop == len(sizes)
    assert all(g.stop - g.start == 1 or g.stop - g.start <= 1024 and sizes[g].sum() <= 4 << 20 for g in groups)
    assert list(packing._groups(sizes[:0])) == []


def test_known_chunks_are_looked_up_once():
    ids = packing.WordIds(tokenizer_path("word_bpe_49k.json"))
    asked, table = [], ids.young

    class Counted(dict):
        def get(self, key, other=None):
            asked.append(key)
            return super().get(key, other)

    ids.young = Counted(table)
    first = ids.encode([b"the cat the cat " * 50, b"cat"])
    assert asked.count(b"the") == asked.count(b"cat") == 1 and first == ids.encode([b"the cat the cat " * 50, b"cat"])


def test_chunks_are_looked_up_by_their_parts():
    ids = packing.WordIds(tokenizer_path("word_bpe_49k.json"))
    asked, table = [], ids.young

    class Counted(dict):
        def get(self, key, other=None):
            asked.append(key)
            return super().get(key, other)

    ids.young = Counted(table)
    texts = ["Cat, cat. CAT!? cat naïve, Naïve. don't 12.", "... cat..."]
    found = ids.encode([t.encode() for t in texts])
    assert [np.frombuffer(x, "<u4").tolist() for x in found] == [ids.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert asked.count(b"cat") == asked.count("naïve".encode()) == asked.count(b"...") == 1 and b"cat," not in asked
    assert ids.encode([b"", b" \n"]) == [b"", b""] and ids.encode([]) == []


def _joined(texts):
    data = [t.encode() for t in texts]
    return np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)])


SIGNS = [" ", "▁", "a", "b", "é", "日", "🎉", "\n", "<0x0A>", "the", "\t", "</s>", "ﬁ", "Ａ", "ａ\u0301", "½", "\u3000"]


def _odd_texts(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(SIGNS) for _ in range(rng.randint(0, 30))) for _ in range(n)]


def test_pieces_equal_the_library(spark, edge_docs, no_docs):
    model = tokenizer_path("piece_bpe_32k.model")
    codec = piece_codec.codec(model)
    texts = _odd_texts(1500, 3)
    ids, at, starts, ends = codec.encode(*_joined(texts))
    for i, t in enumerate(texts):
        part = slice(at[i], at[i + 1])
        assert ids[part].tolist() == codec.library.encode(t)
        assert t.encode() == b"".join(t.encode()[a:z] for a, z in zip(starts[part], ends[part], strict=True))
        for piece, a, z in zip(ids[part].tolist(), starts[part], ends[part], strict=True):
            said = t.encode()[a:z].replace(b" ", "▁".encode())
            name = codec.names[piece]
            shown = bytes([int(name[1:-1], 16)]) if codec.library.is_byte(piece) else name.encode()
            assert said == shown or a == 0 and said == shown[3:]  # the dummy prefix covers nothing
    rows = piece_codec.decode(piece_codec.encode(edge_docs, model, keep=("doc_id", "text")), model).collect()
    assert len(rows) == len(EDGE_ROWS)
    for r in rows:
        assert list(r.ids) == codec.library.encode(r.text or "") and r.decoded == codec.library.decode(list(r.ids))
        assert r.starts[1:] == r.ends[:-1]
    assert piece_codec.encode(no_docs, model).count() == 0
    assert piece_codec.decode(piece_codec.encode(edge_docs, model, keep=("text",)), model, text_col="text").columns[-1] == "text_1"


def test_decoding_costs_little_more_than_the_library():
    library = piece_codec.codec(tokenizer_path("piece_bpe_32k.model")).library
    ids = library.encode(" ".join(_odd_texts(1500, 4)))
    some = pa.array([[5], None, ids[:9], [], ids[3:7]], pa.list_(pa.int32())).slice(1)
    assert piece_codec.decoded(library, some) == ["", library.decode(ids[:9]), "", library.decode(ids[3:7])]
    lists = [ids] * 100
    column = pa.array(lists, pa.list_(pa.int32()))

    def took(fn):
        began = time.process_time()
        assert fn() == [library.decode(ids)] * 100
        return time.process_time() - began

    least = min(took(lambda: [library.decode(x) for x in lists]) for _ in range(3))
    assert min(took(lambda: piece_codec.decoded(library, column)) for _ in range(3)) < 3 * least


def test_few_cached_runs(monkeypatch):
    monkeypatch.setattr(piece_codec, "_CACHED_RUNS", 8)
    codec = piece_codec.Codec(tokenizer_path("piece_bpe_32k.model"))
    for seed in range(40):
        texts = _odd_texts(5, seed)
        ids, at, _, _ = codec.encode(*_joined(texts))
        assert [ids[a:z].tolist() for a, z in zip(at[:-1], at[1:], strict=True)] == [codec.library.encode(t) for t in texts]
        assert len(codec.young) <= 80


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc", "nmt_nfkc_cf"])
@pytest.mark.parametrize(("dummy", "trim", "escape"), [(True, True, True), (True, False, True), (False, True, False)])
def test_real_character_maps_and_alignment(rule, dummy, trim, escape):
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2

    library = sentencepiece.SentencePieceNormalizer(rule_name=rule, add_dummy_prefix=dummy, remove_extra_whitespaces=trim, escape_whitespaces=escape)
    proto = sentencepiece_model_pb2.ModelProto()
    proto.ParseFromString(library.serialized_model_proto())
    assert len(proto.normalizer_spec.precompiled_charsmap) > 200_000
    texts = _odd_texts(600, 5)
    raw, offsets = _joined(texts)
    out, rows, origin = piece_codec.Normalizer(proto.normalizer_spec)(raw, offsets)
    for i, t in enumerate(texts):
        got = out[rows[i] : rows[i + 1]].tobytes().decode()
        want, places = library.normalize(t, with_offsets=True)
        assert got == want
        at, mine = 0, []
        for c in got:
            mine.append(len(t.encode()[: origin[rows[i] + at] - offsets[i]].decode()))
            at += len(c.encode())
        assert mine == places[: len(mine)]


def test_spans_through_a_character_map():
    codec = piece_codec.Codec(tokenizer_path("piece_bpe_32k.model"))

    class Spec:
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc").serialized_model_proto())
        precompiled_charsmap = proto.normalizer_spec.precompiled_charsmap
        add_dummy_prefix, remove_extra_whitespaces, escape_whitespaces = True, True, True

    codec.normalize = piece_codec.Normalizer(Spec)
    text = "  ﬁne　 Ａrt x "
    ids, _, starts, ends = codec.encode(*_joined([text]))
    assert codec.library.decode(ids.tolist()) == "fine Art x"
    said = [text.encode()[a:z].decode() for a, z in zip(starts, ends, strict=True)]
    assert "".join(said) == text and said[-1] == " x "
    words = [i for i, piece in enumerate(ids.tolist()) if codec.names[piece].startswith("▁")]
    assert ["".join(said[a:z]) for a, z in zip(words, [*words[1:], len(said)], strict=True)] == ["  ﬁne", "　 Ａrt", " x "]


def test_toxicity(spark, sf_dir, edge_docs, no_docs):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{n}.parquet") for n in ("documents", "labels"))
    got = toxicity.score_documents(docs, labels).join(labels, "doc_id").where("held_out").select("predicted", "toxic").collect()
    hit = sum(r.predicted and r.toxic for r in got)
    assert hit / sum(r.predicted for r in got) > 0.95 and hit / sum(r.toxic for r in got) > 0.8
    none = labels.limit(0)
    assert toxicity.score_documents(edge_docs, none).count() == len(EDGE_ROWS)
    assert toxicity.drop_toxic(edge_docs, none).columns == edge_docs.columns
    assert toxicity.score_documents(no_docs, none).count() == 0


def test_swaps():
    assert toxicity.swap_terms("All Women and muslims, too".encode()) == b"All men and christians, too"
    assert toxicity.swap_terms("All Women".encode(), 2) == b"All people"
    assert toxicity.swap_terms(b"nothing here") is None
    features = toxicity._term_features()
    texts = ["Old men talk. The deaf sing!\nmen walk", "no term", "", "young. young. men."]
    made = toxicity.swaps(*_joined(texts), toxicity._term_hashes(), features)
    term = {t: features[i] for i, t in enumerate(toxicity._TERMS)}
    assert made[1] == made[2] == []
    # Sentence by sentence: (old, men) two ways, deaf two, men two.
    pairs = [("old men", "young women"), ("old men", "old people"), ("old men", "young people"), ("old men", "old women"), ("deaf", "blind"), ("deaf", "disabled"), ("men", "women"), ("men", "people")]
    sets = [tuple(frozenset().union(*[term[w] for w in side.split()]) for side in p) for p in pairs]
    allowed = {(tuple(sorted(a - b)), tuple(sorted(b - a))) for a, b in sets}
    assert {(tuple(a), tuple(b)) for _, a, b in made[0]} <= allowed and len(made[0]) == 6
    assert sum(x[0] for x in made[0]) == pytest.approx(1) and sorted(x[0] for x in made[3]) == pytest.approx([0.25, 0.25, 0.5])


def test_counterfactual_pairs_lower_the_change():
    rng = np.random.default_rng(1)
    # Feature 1 (a mention) goes with the label in the sample, feature 2 is its counterfactual, feature 3 is abuse.
    labels = np.array([1, 0] * 200)
    rows = [[3, 1] if y else ([4, 2] if rng.random() < 0.9 else [4, 1]) for y in labels]
    at, flat = np.arange(0, 2 * len(rows) + 1, 2), np.array(rows).ravel()
    pairs = toxicity.Pairs([[(1.0, [b], [3 - b])] for _, b in rows])
    plain = toxicity.fit(labels, at, flat)
    fair = toxicity.fit(labels, at, flat, pairs)
    assert abs(fair[1] - fair[2]) < 0.3 * abs(plain[1] - plain[2])
    assert fair[3] > fair[4]


def test_fewer_false_positives_on_neutral_mentions(spark):
    """Planted texts in which one group's mentions go with the label: the penalty frees neutral mentions."""
    rng = random.Random(11)
    plain = ["".join(rng.choice("bdfglmnprst") + rng.choice("aeiou") for _ in range(3)) for _ in range(60)]
    abuse = ["scumword", "vilething", "hatefool", "filthier", "rottenest", "dumbness"]

    def text(toxic, term):
        words = [rng.choice(plain) for _ in range(14)]
        if term:
            words.insert(rng.randrange(6), f"the {term}")
        if toxic and rng.random() < 0.75:
            words.insert(rng.randrange(9), rng.choice(abuse))
        return " ".join(words) + ". " + " ".join(rng.choice(plain) for _ in range(8)) + "."

    rows, labels = [], []
    for i in range(1500):
        toxic = i % 2
        term = ("muslims" if rng.random() < 0.85 else "christians") if toxic and rng.random() < 0.7 else rng.choice(["christians", "jews", "hindus", None, None]) if not toxic else None
        rows.append((i, text(toxic, term)))
        labels.append((i, toxic))
    neutral = {10_000 + i: text(0, "muslims") for i in range(150)}
    swapped = {20_000 + i - 10_000: toxicity.swap_terms(t.encode()).decode() for i, t in neutral.items()}
    docs = spark.createDataFrame([*rows, *neutral.items(), *swapped.items()], "doc_id long, text string")
    known = spark.createDataFrame(labels, "doc_id long, toxic int")
    wrong, change, right = {}, {}, {}
    for weight in (0.0, toxicity.COUNTERFACTUAL):
        score = {r.doc_id: (r.score, r.predicted) for r in toxicity.score_documents(docs, known, counterfactual=weight).collect()}
        wrong[weight] = sum(score[i][0] >= 0.5 for i in neutral)
        change[weight] = np.mean([abs(score[i][0] - score[i + 10_000][0]) for i in neutral])
        right[weight] = np.mean([(score[i][0] >= 0.5) == bool(y) for i, y in labels])
    fair = toxicity.COUNTERFACTUAL
    assert wrong[fair] < 0.5 * wrong[0.0] and wrong[0.0] > 50, (wrong, change, right)
    assert change[fair] < 0.3 * change[0.0], (wrong, change, right)
    assert right[fair] > 0.8, (wrong, change, right)


def test_language_id(spark, edge_docs, no_docs):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language_id.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang_pred == r.lang for r in got) / len(got) > 0.98
    edge = language_id.identify(edge_docs).collect()
    assert len(edge) == len(EDGE_ROWS)
    assert all(r.lang_pred == "und" for r in edge if r.doc_id in (3, 4, 8))
    assert language_id.identify(no_docs).count() == 0


def test_language_without_letters_ties_and_hot_rows(spark, monkeypatch):
    assert [language_id.has_letter(t) for t in ("² ½ Ⅷ 7_", "²a", "", "日", "ªx", "٣", "\u0301")] == [False, True, False, True, True, False, False]
    monkeypatch.setattr(language_id, "SAMPLE_TEXTS", 40)
    texts = {"aa": "foo bar foo", "bb": "qux zip qux"}
    rows = [(i, f"{texts[lang]} {i}", lang) for i, lang in enumerate(["aa", "bb"] * 300)] + [(-1, texts["aa"], "aa")] * 900
    rows += [(-2, "½ ² 12", "aa"), (-3, None, "aa"), (-4, "zzz", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    languages, counts = language_id.learn(docs)
    assert languages == ["aa", "bb"] and all(n.sum() < 40 * 3 * 16 for _, n in counts)
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.identify(docs).collect()}
    assert all(got[i][0] == lang for i, _, lang in rows[:600]) and got[-2] == got[-3] == ("und", 0.0)
    gram = (np.array([0x20207820, 0x20782079]), np.array([9, 9]))
    tie = language_id.predict(spark.createDataFrame([("x y",), ("q",)], "text string"), (["a", "b"], [gram, gram]), ("text",)).collect()
    assert [(r.lang_pred, r.score) for r in tie] == [("a", 0.5)] * 2


def test_code_lengths_are_exact():
    text = b"abracadabra abracadabra abrac"
    led = b"   " + text
    counts = defaultdict(int)
    for i in range(3, len(led)):
        counts[led[i - 3] << 24 | led[i - 2] << 16 | led[i - 1] << 8 | led[i]] += 1
    model = language_id.Model(["x"], [(np.array(list(counts)), np.array(list(counts.values())))])
    tree = defaultdict(lambda: defaultdict(int))
    for gram, n in counts.items():
        for order in range(4):
            tree[(gram >> 8 & 0xFFFFFF).to_bytes(3, "big")[3 - order :]][gram & 255] += n

    def share(context, byte):
        if len(context) == 3 and sum(tree[context].values()) < language_id.LEAST_CONTEXT:
            return share(context[1:], byte)
        seen = tree[context]
        below = share(context[1:], byte) if context else 1 / 256
        if not seen:
            return below
        total, different = sum(seen.values()), len(seen)
        return seen[byte] / (total + different) if seen[byte] else different / (total + different) * below

    probe = b"abracazz9"
    whole = b"   " + probe
    for seen in list(tree.values()):
        for k in [k for k, n in seen.items() if not n]:
            del seen[k]
    expected = 0.0
    for i in range(3, len(whole)):
        context = whole[i - 3 : i]
        expected -= np.log2(share(context, whole[i]))
        for seen in tree.values():
            for k in [k for k, n in seen.items() if not n]:
                del seen[k]
    got = model.bits(np.frombuffer(probe, np.uint8), np.array([0, len(probe)]))[0, 0]
    assert got == pytest.approx(expected, rel=1e-5)


PAGE = """<html><head><title>t</title><style>p{}</style></head><body><nav><ul><li><a href=a>menu</a></ul></nav>
<div class="cookie-notice">We use cookies</div><article><h1>Title &amp; more</h1><p><b>One<br>two<p>Three&nbsp;four <a href=x>link</a></p>
<aside>side</aside><div class="comments"><p>reader says</p></div></article><form><input><p>sign up</p></form><footer>&copy; x</footer>"""


def test_pages(spark, sf_dir):
    assert html_text.main_text(PAGE) == "Title & more One two Three four link"
    body = "<div id=m><a href=a>x</a> <a href=b>y</a></div><div><p>" + "many words of text here. " * 20 + "</p><p>and so on and on, with more.</p></div><div><a href=c>z</a></div>"
    assert html_text.main_text(f"<body>{body}") == " ".join(("many words of text here. " * 20 + "and so on and on, with more.").split())
    for odd in ("", "<", "<p>", "a<br>b", "<div>" * 3000 + "x", "<table><tr><td>a<td>b", "&#0;&bad;", "<!-- <p>no</p>"):
        html_text.main_text(odd)
    rows = [(1, "u", PAGE, "extra"), (2, None, None, None), (None, "u", "", None), (None, "u", "", None)]
    got = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert sorted((r.text, r.n_chars) for r in got) == [("", 0), ("", 0), ("", 0), ("Title & more One two Three four link", 36)]


def test_words_in_long_runs_of_signs():
    def features(*texts):
        data = [t.encode() for t in texts]
        rows, found = toxicity.text_features(np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)]))
        return [sorted(found[rows == i].tolist()) for i in range(len(texts))]

    words = features(*["word other"] * 5)
    assert features("word other", "!" * 9 + "word" + "*" * 30 + " other", "word" + "!" * 9 + " other", "!" * 40 + "word other" + "?" * 9, "?" * 9 + "word " + "*" * 40 + " other") == words
    assert features("", "!" * 40) == features("", "!!")


def test_pages_edges(spark):
    rows = [(1, "u", "<body>" + "<p>one more paragraph of a very long page.</p>" * 40000, "x", 5)] * 2
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int")
    got = html_text.extract(pages, keep=("page_id", "text", "n_chars"))
    assert got.columns == ["page_id", "text", "n_chars", "text_1", "n_chars_1"]
    assert [(r.text, r.n_chars, r.n_chars_1) for r in got.collect()] == [("x", 5, 40000 * 40 - 1)] * 2
    assert html_text.extract(pages.limit(0)).count() == 0


def test_density_sums_against_brute_force(sf_dir):
    """Density sums by their definition, node by node, choose the same subtree."""
    import math

    def chars(node, linked):
        total = 0
        for x in node.children:
            if isinstance(x, str):
                total += len("".join(x.split())) * (linked or not _linked(node))
            elif not x.drop:
                total += chars(x, linked)
        return total

    def _linked(node):
        while node is not None:
            if node.tag == "a":
                return True
            node = node.parent
        return False

    def tags(node):
        below = [x for x in node.walk() if x is not node and not any(u.drop for u in up(x, node))]
        return sum(x.tag not in html_text.INLINE and x.tag != "br" or x.tag == "a" for x in below), sum(x.tag == "a" for x in below)

    def up(x, top):
        while x is not top:
            yield x
            x = x.parent

    import pyarrow.parquet as pq

    for page in pq.read_table(f"{sf_dir}/pages.parquet").column("html").to_pylist()[:40]:
        if len(page) > 6000:
            continue
        builder = html_text._Builder()
        builder.feed(page.replace("<nav>", "<div>").replace("</nav>", "</div>"))
        for node in builder.root.walk():
            node.drop = node.tag in ("head", "script", "style")
        body = next(n for n in builder.root.walk() if n.tag == "body")
        density, sums, nodes = html_text._densities(body)
        c_body = chars(body, True)
        share = (c_body - chars(body, False)) / c_body
        block = [n for n in body.walk() if n.tag not in html_text.INLINE and n.tag != "br"]
        assert {id(n) for n in nodes} == {id(n) for n in block} and len(nodes) == len(block)
        for n in block:
            c = chars(n, True)
            lc, (t, lt) = c - chars(n, False), tags(n)
            t = max(t, 1)
            base = math.log(math.log(c / max(c - lc, 1) * lc + share * c + math.e) + 1e-9)
            want = c / t * max(math.log(max(c / max(lc, 1) * t / max(lt, 1), 1.0)) / max(base, 0.05), 0.0) if c else 0.0
            assert density[id(n)] == pytest.approx(want)
        for n in block:
            below = [x for x in block if x is not n and next((u for u in list(up(x, None))[1:] if u in block), None) is n]
            assert sums[id(n)] == pytest.approx(sum(density[id(x)] for x in below))


def test_pages_without_telling_names(sf_dir):
    """Given pages whose article, menu, advert and footer are all plain blocks: the densities find the article."""
    import re

    import pyarrow.parquet as pq

    pages = pq.read_table(f"{sf_dir}/pages.parquet").column("html").to_pylist()
    plain = [re.sub(r' (class|id|role)="[^"]*"', "", re.sub(r"<(/?)(article|nav|footer)\b", r"<\1div", p)) for p in pages]
    articles = [re.search("(?s)<article>.*</article>", p)[0] for p in pages]
    want = [html_text._text([_tree(a)]) for a in articles]
    assert [html_text.main_text(p) for p in pages] == want
    right = sum(html_text.main_text(p) == t for p, t in zip(plain, want, strict=True))
    assert right / len(pages) > 0.85


def _tree(html):
    builder = html_text._Builder()
    builder.feed(html)
    builder.close()
    return builder.root


LONG = ["".join(f"{w} of the {k} long passage goes on and on, " for k in range(12)).strip() for w in ("first", "second", "third")]


def test_pages_with_articles():
    p = [f"<p>{x}</p>" for x in LONG]
    teaser = "<article><h3><a href=o>Other story</a></h3><p><a href=o>read</a> it</p></article>"
    cases = [
        (f"<body><div id=content>{p[0]}{p[1]}</div>{teaser}", LONG[:2]),
        (f"<body><div><article>{p[0]}{p[1]}{p[2]}</article><article>{p[1]}<p>so.</p></article><article><p>End.</p></article>{teaser}</div>", [*LONG, LONG[1], "so.", "End."]),
        (f"<body><article>{p[0]}</article><article>{p[1]}</article><div><a href=a>x</a></div>", LONG[:2]),
        (f"<body><main><article><h1>T</h1><p>Lead.</p><article>{p[0]}{p[1]}</article><p>After.</p></article></main>", ["T", "Lead.", *LONG[:2], "After."]),
        (f"<body><article><h1>T</h1>{p[0]}{p[1]}</article><div id=comments><article class=comment-body>{p[2]}{p[2]}{p[2]}</article></div>", ["T", *LONG[:2]]),
        (f"<body><article><h1>T</h1>{p[0]}{p[1]}</article><article class='x comment'>{p[2]}{p[2]}{p[2]}</article>", ["T", *LONG[:2]]),
        (f"<body><main><h1>T</h1>{p[0]}{p[1]}</main>", ["T", *LONG[:2]]),
    ]
    for page, text in cases:
        assert html_text.main_text(page) == " ".join(text), page


def test_pages_with_telling_names():
    p = f"<p>{LONG[0]}</p>"
    kept = ['<section id="side-effects">', '<section id="comments">', '<section id="related-work">', '<h2 id="search-algorithms">', '<h2 id="search">', '<div class="side-by-side">', '<p id="form-of-the-law">', '<div class="section" id="menu">', '<div class="notice">', '<div class="header">', '<div class="has-comments">']
    for start in kept:
        tag = start[1:].split()[0].rstrip(">")
        page = f"<body><article><h1>T</h1>{p}{start}Named part.</{tag}><p>End.</p></article>"
        assert html_text.main_text(page) == f"T {LONG[0]} Named part. End.", start
    for name in ("ad", "cookie-notice", "commentList", "comments-area", "main_nav", "site-footer", "related-posts", "social-share", "searchForm", "sidebar left"):
        page = f"<body><article><h1>T</h1>{p}<div class='{name}'>Named part.</div><p>End.</p></article>"
        assert html_text.main_text(page) == f"T {LONG[0]} End.", name
    page = f"<body><article><h1>T</h1>{p}<div class=share>On: <a href=a>Some page</a> <a href=b>Other page</a></div><p>End.</p></article>"
    assert html_text.main_text(page) == f"T {LONG[0]} End."


def test_chat_round_trip(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "a\\<|end|>\\\\|<"), (2, None, None, None), (None, 3, "assistant", "x"), (None, 3, "assistant", "x"), (3, 1, "<|text|>", "</s>[INST] ok [/INST]\\")]
    messages = chat_format.linear(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = chat_format.format_trees(messages).select("tree", chat_format.turns(F.col("formatted")).alias("t"), chat_format.loss_text(F.col("formatted"), F.col("loss")).alias("loss"), "formatted", F.col("loss").alias("spans")).collect()
    said = {r.tree: [(x.role, x.text) for x in r.t] for r in got}
    assert said == {1: [("user", "hi"), ("assistant", "a\\<|end|>\\\\|<")], 2: [("", "")], None: [("assistant", "x")] * 2, 3: [("<|text|>", "</s>[INST] ok [/INST]\\")]}
    assert {r.tree: r.loss for r in got} == {1: "a\\<|end|>\\\\|<", 2: "", None: "xx", 3: ""}
    for r in got:
        cut = [r.formatted[x.start : x.end] for x in r.spans if x.start is not None]
        assert "".join(cut) == "".join(t.replace("\\", "\\\\").replace("<|end", "<\\|end") for role, t in said[r.tree] if role == "assistant")
        assert all(r.formatted.startswith(chat_format.TURN, x.turn_start) for x in r.spans) and len(r.spans) == len(r.t)
    assert all("</s>" not in r.formatted and "[INST]" not in r.formatted for r in got)
    assert chat_format.format_trees(messages.limit(0)).count() == 0


def test_reply_trees(spark):
    rows = [(1, 1, None, "u", "r", 1.0), (1, 2, 1, "a", "x", 2.0), (1, 3, 1, "a", "y", 5.0), (1, 4, 3, "u", "z", -9.0), (1, 5, 2, "u", "w", None), (2, 9, 77, "u", "o", 0.0)]
    rows += [(3, 100 + i, 99 + i if i else None, "u", str(i), 0.0) for i in range(37)]
    trees = spark.createDataFrame(rows, "tree long, node long, parent long, role string, text string, score double")
    got = {(r.tree, r.path_rank): "".join(x.text for x in r.t) for r in chat_format.format_trees(trees, None).select("tree", "path_rank", chat_format.turns(F.col("formatted")).alias("t")).collect()}
    assert got == {(1, 1): "rxw", (1, 2): "ryz", (2, 1): "o", (3, 1): "".join(map(str, range(37)))}


def test_chat_edges(spark):
    long = "so it goes on and on 🎉 " * 40000
    rows = [(1, 0, "user", long), (1, 1, "assistant", long)] + [(2, i, "assistant" if i % 2 else "user", f"[INST]{i}") for i in range(3000)]
    wide = spark.createDataFrame([(*r, 1, 2, "x") for r in rows], "conv_id long, turn long, role string, text string, leaf int, up int, loss string")
    got = {r.tree: r for r in chat_format.format_trees(chat_format.linear(wide)).select("tree", "formatted", chat_format.loss_text(F.col("formatted"), F.col("loss")).alias("said")).collect()}
    assert got[1].said == long and got[2].said == "".join(f"[INST]{i}" for i in range(1, 3000, 2))
    # Messages on a cycle have no leaf and no path; equal rows of several trees stay apart.
    rows = [(1, 1, 2, "u", "a", 0.0), (1, 2, 1, "u", "b", 0.0), (2, 3, None, "u", "same", 0.0), (3, 4, None, "u", "same", 0.0)]
    trees = spark.createDataFrame(rows, "tree long, node long, parent long, role string, text string, score double")
    assert sorted(r.tree for r in chat_format.format_trees(trees, None).collect()) == [2, 3]


def test_media(spark, edge_docs, no_docs):
    rng = random.Random(1)
    for n in (0, 1, 64, 1402, 1403, 5000, 60000):
        payload = mpeg_audio.padded(bytes(rng.choice([255, 250, 0, 7, 0xFB]) for _ in range(n)))
        media = mpeg_audio.write(payload)
        read = mpeg_audio.Stream(media)
        assert read.payload == payload and not read.bad and not read.skipped
        assert read.table["frames"] == len(read.frames) and read.samples == 1152 * len(read.frames)
        start = mpeg_audio._tags(media)[0]
        junk = b"\xff\xfbjunk\xff" * 3
        again = mpeg_audio.Stream(media[:start] + junk + media[start:] + b"TAG" + bytes(125))
        assert again.payload == payload and again.skipped == len(junk)
        broken = bytearray(media)
        broken[start + 20] ^= 1
        assert mpeg_audio.Stream(bytes(broken)).bad == 1
    for _ in range(300):
        mpeg_audio.Stream(bytes(rng.choice([255, 250, 0, 73, 68, 51]) for _ in range(rng.randint(0, 200))))
    rows = mpeg_audio.features(mpeg_audio.store(edge_docs, keep=("doc_id", "text")), keep=("doc_id", "text", "n_bytes")).collect()
    assert len(rows) == len(EDGE_ROWS)
    assert all(bytes(r.payload) == mpeg_audio.padded((r.text or "").encode()) for r in rows)
    assert mpeg_audio.store(no_docs).count() == 0
    odd = edge_docs.select("doc_id", "text", F.lit(1).alias("payload"), F.lit("f").alias("feature"), F.lit(2).alias("media"))
    kept = mpeg_audio.store(odd, keep=("doc_id", "payload", "feature", "media"))
    assert kept.columns == ["doc_id", "payload", "feature", "media", "n_bytes", "media_1"]
    read = mpeg_audio.features(kept, media_col="media_1", keep=("payload", "feature")).select("payload", "feature", "payload_1", "feature_1").collect()
    assert len(read) == len(EDGE_ROWS) and all(r.payload == 1 and r.feature == "f" and len(r.payload_1) % 64 == 0 for r in read)


def _frame_of(layer, body, protected=True, bitrate=8, mode=0, good=True):
    """An MPEG-1 frame at 44.1 kHz without padding; bitrate 0 is the free format, whose size is that of ``body``."""
    head = bytes((0xFF, 0xF8 | (4 - layer) << 1 | (not protected), bitrate << 4, mode))
    covered = {1: 16 if mode >> 6 == 3 else (32 + (4 * (mode >> 4 & 3) + 4 if mode >> 6 == 1 else 32)) // 2, 2: 0, 3: 17 if mode >> 6 == 3 else 32}[layer]
    crc = mpeg_audio.crc16(head[2:] + body[:covered]) ^ (not good)
    return head + (crc.to_bytes(2, "big") if protected else b"") + body


def test_checksums_of_layer_one():
    for mode in (0x00, 0x40, 0x50, 0x70, 0x80, 0xC0):
        size = mpeg_audio.header(bytes((0xFF, 0xFE, 8 << 4, mode))).size
        body = bytes(i * 7 % 200 for i in range(size - 6))
        for good in (True, False):
            found = mpeg_audio.Stream(_frame_of(1, body, mode=mode, good=good) * 4)
            assert (len(found.frames), found.checked, found.bad, found.skipped) == (4, 4, 0 if good else 4, 0)


def test_free_format():
    body = bytes(i * 7 % 200 for i in range(394))
    for layer in (1, 2, 3):
        data = b"junk" + _frame_of(layer, body, bitrate=0) * 4
        found = mpeg_audio.Stream(data)
        assert [s for _, s in found.frames] == [400] * 4 and found.skipped == 4 and found.samples == 4 * mpeg_audio.SAMPLES[1, layer]
    assert mpeg_audio.Stream(_frame_of(3, body, bitrate=0)).frames == []


def test_pages_keep_formulas_and_labels():
    long = "word " * 80
    page = f"<body><article><p>{long}<math><mi>x</mi><mo>=</mo><mn>1</mn></math> and <label>so</label> <output>2</output></p><p>{long}<object>shown</object></p></article><form><label>mail</label></form></body>"
    found = html_text.main_text(page)
    assert "x=1 and so 2" in found and "shown" in found and "mail" not in found


def test_deep_named_blocks_take_linear_time():
    import time

    def took(n):
        page = "<body>" + '<div class="comments"><header>' * n + "x" + "</header></div>" * n + "<p>" + "word " * 50 + "</p></body>"
        began = time.process_time()
        html_text.main_text(page)
        return time.process_time() - began

    took(500)
    assert took(16000) < 16 * max(took(4000), 0.05)


def test_clashing_names_of_decoded_and_predicted(spark):
    path = tokenizer_path("piece_bpe_32k.model")
    rows = spark.createDataFrame([([5, 6], "kept", 1.5, "text of it")], "ids array<int>, decoded string, score double, text string")
    made = piece_codec.decode(rows, path)
    assert made.columns[-1] == "decoded_1" and made.first().decoded == "kept"
    found = language_id.predict(rows, ([], []), ("score",)).first()
    assert found.score == 1.5 and found.score_1 == 0
