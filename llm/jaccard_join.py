"""Exact n-gram Jaccard join with set-relation skipping.

Every document is the set of its distinct word shingles; documents of equal sets are one
representative from the start.

Index level.  Shingles are ordered from rare to frequent (by the counts of a fixed number of hash
buckets over all documents).  Two sets that reach the threshold share a shingle among the first
``n - ceil(t n) + 1`` of each, so only those enter the inverted lists, with the set's size and the
position.  A list is cut into size bands, and whole entries are skipped when the remaining positions
of the entry and of the best partner in its band cannot reach the overlap the threshold asks for.
The band's entries then name one leader, the member of lowest rank, so a list of m entries yields
m memberships and never m * m pairs.  Any two entries of a list share its leader, so every pair
that could link meets in a leader's cluster.

Sketch level.  A set's sketch counts its shingles in hash buckets, one byte for 8 to 16 shingles; the
sums of bucket minima bound any overlap from above.  A member of a cluster whose bounds rule out
every other member leaves it before any text moves.

Answer level.  In a cluster each set is intersected with the leader once.  The answers of all other
pairs derive from that: the overlap within the leader and the small parts outside bound the pair's
overlap; pairs that both link to the leader are already connected, pairs whose bound fails are
skipped, and only the rest are counted exactly.  ``near_pairs`` lists every linking pair of different
sets.  ``near_groups`` needs to know only which rows hang together: of the links found in a task a
spanning forest goes on, at most one link for each member, which joins the same rows as all of them.

Lists of frequent shingles get their leaders by an aggregate that combines before the shuffle, and
clusters of over ``CLUSTER_ROWS`` members or ``BLOCK_SHINGLES`` shingles are compared in blocks.  All members meet the leader once;
where blocks have to meet, sketches move first, and only texts whose bounds leave a partner in the other
block follow.  Nothing is capped or sampled.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bloom import hits, repeated_plane
from .common import batch, checkpoint, col, free_name, keyed, map_arrow, ship, stored, with_key
from .graph import components
from .words import hash_runs, hash_words, mix, split_words, steps

#: log2 of the number of count buckets that order the shingles (fixed, so the broadcast is 4 MB).
BUCKET_BITS = 22
#: Lists of shingles in buckets of at least this count take the aggregated path; the result is the same.
HOT_LIST = 1000
#: Members of a cluster that one task compares at a time.
CLUSTER_ROWS = 512
#: Shingles of all members of a block, expected: bounds a task's memory where texts are long.
BLOCK_SHINGLES = 1 << 20
#: log2 of the number of buckets in the shortest and the longest sketch.
SKETCH_BITS = (4, 12)
_CHUNK = 1 << 14


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, k: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each row; a row of fewer than k words is one shingle."""
    starts, ends, first = split_words(raw, offsets)
    words = hash_words(raw, starts, ends, lower=True)
    runs = hash_runs(words, k)
    out = []
    for a, z in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if z - a >= k:
            out.append(np.unique(runs[a : z - k + 1]))
        else:
            out.append(hash_runs(words[a:z], z - a) if z > a else runs[:0])
    return out


def _bucket(shingles: np.ndarray) -> np.ndarray:
    return (mix(shingles, 31) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def _set_ids(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Two order-free 64-bit sums that identify a set."""
    sizes = np.array([len(s) for s in sets], np.int64)
    flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    out = []
    for seed in (41, 42):
        sums = np.zeros(len(flat) + 1, np.uint64)
        np.cumsum(mix(flat, seed), out=sums[1:])
        ends = np.cumsum(sizes)
        out.append(sums[ends] - sums[ends - sizes])
    return out[0], out[1]


def sketch(shingles: np.ndarray) -> np.ndarray:
    """Counts of a set's shingles by hash bucket; empty where a count does not fit, and then bounds nothing."""
    bits = min(max(len(shingles).bit_length() - 4, SKETCH_BITS[0]), SKETCH_BITS[1])
    counts = np.bincount((mix(shingles, 71) >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
    return counts.astype(np.uint8) if counts.max() < 256 else np.zeros(0, np.uint8)


def may_link(sketches: list[np.ndarray], n: np.ndarray, num: int, den: int, block: np.ndarray | None = None, away: np.ndarray | None = None) -> np.ndarray:
    """Which sets have another one in the list whose overlap, bounded by the sketches, can be enough.

    With ``block`` only pairs across its two values are asked for of which one at least is ``away``.
    """
    width = np.array([len(s) for s in sketches])
    if not width.all():
        return np.ones(len(n), bool)
    may = np.zeros(len(n), bool)
    for w in np.unique(width):
        at = np.flatnonzero(width >= w)  # wider sketches fold to this width
        counts = np.stack([sketches[i].reshape(w, -1).sum(axis=1, dtype=np.int32) for i in at])
        for i in np.flatnonzero(width[at] == w):
            ask = at != at[i]
            if block is not None:
                ask &= (block[at] != block[at[i]]) & (away[at] | away[at[i]])
            some = np.flatnonzero(ask)
            able = some[np.minimum(counts[some], counts[i]).sum(axis=1) >= _need(n[at[some]], n[at[i]], num, den)]
            may[at[able]] = True
            may[at[i]] |= len(able) > 0
    return may


def _need(a, b, num: int, den: int):
    """Least overlap of sets of sizes a and b whose Jaccard similarity is at least num / den."""
    return -((-num * (a + b)) // (num + den))


def _profile(k: int):
    def run(batches):
        counts = np.zeros(1 << BUCKET_BITS, np.int32)
        for b in batches:
            for r0, r1, raw, offsets in steps(b.column(1)):
                sets = shingle_sets(raw, offsets, k)
                f1, f2 = _set_ids(sets)
                np.add.at(counts, _bucket(np.concatenate(sets)), 1)
                n = np.array([len(s) for s in sets], np.int32)
                yield batch([("doc_key", b.column(0)[r0:r1]), ("n", n), ("f1", f1), ("f2", f2), ("sketch", pa.array([sketch(s).tobytes() for s in sets], pa.binary())), ("counts", pa.nulls(r1 - r0, pa.binary()))])
        chunks = counts.reshape(-1, _CHUNK)
        used = np.flatnonzero(chunks.any(axis=1))
        blank = pa.nulls(len(used), pa.int64())
        yield batch([("doc_key", blank), ("n", used.astype(np.int32)), ("f1", blank), ("f2", blank), ("sketch", pa.nulls(len(used), pa.binary())), ("counts", pa.array([zlib.compress(chunks[c].tobytes(), 1) for c in used], pa.binary()))])

    return run


def _sum_counts(batches):
    total: dict[int, np.ndarray] = {}
    for b in batches:
        for c, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            part = np.frombuffer(zlib.decompress(data), np.int32).astype(np.int64)
            total[c] = total[c] + part if c in total else part
    # Quarter powers of two are fine enough to order by.
    levels = [np.minimum(np.ceil(np.log2(np.maximum(v, 1)) * 4), 255).astype(np.uint8).tobytes() for v in total.values()]
    yield batch([("chunk", np.array(list(total), np.int32)), ("level", pa.array(levels, pa.binary()))])


def _prefixes(k: int, num: int, den: int, levels):
    hot_level = math.ceil(math.log2(HOT_LIST) * 4)

    def run(batches):
        seen: set[tuple[int, int]] = set()
        for b in batches:
            for r0, r1, raw, offsets in steps(b.column(1)):
                sets = shingle_sets(raw, offsets, k)
                ids = list(zip(*(x.tolist() for x in _set_ids(sets)), strict=True))
                keys = np.asarray(b.column(0)[r0:r1])
                parts = []
                for i, s in enumerate(sets):
                    if not len(s) or ids[i] in seen:
                        continue
                    seen.add(ids[i])
                    p = len(s) - -(-num * len(s) // den) + 1
                    level = levels.value[_bucket(s)]
                    rank = np.argsort(level, kind="stable")[:p]
                    parts.append((s[rank], np.full(p, keys[i]), np.full(p, len(s), np.int32), (len(s) - np.arange(p)).astype(np.int32), level[rank] >= hot_level))
                if parts:
                    yield batch([(name, np.concatenate(x)) for name, x in zip(("token", "x", "n", "r", "hot"), zip(*parts, strict=True), strict=True)])

    return run


def _band_width(num: int, den: int) -> float:
    """A little over the log of the largest ratio of sizes, so that partners are at most one band apart."""
    return math.log(den / num) * 1.0001 if num < den else 1e-12


def _lead(num: int, den: int):
    """Memberships (x, y) of the entries of each list, which arrive sorted by shingle."""
    width = _band_width(num, den)

    def of_lists(token, x, n, r):
        band = np.floor(np.log(n) / width).astype(np.int64)
        token, x, n, r = (np.concatenate([a, a]) for a in (token, x, n, r))
        order = np.lexsort((np.concatenate([band, band + 1]), token))
        token, x, n, r, band = token[order], x[order], n[order].astype(np.int64), r[order], np.concatenate([band, band + 1])[order]
        start = np.flatnonzero(np.r_[True, (token[1:] != token[:-1]) | (band[1:] != band[:-1])])
        size = np.diff(np.r_[start, len(token)])
        rank = mix(x.view(np.uint64), 51)
        least = np.repeat(np.minimum.reduceat(rank, start), size)
        leader = np.zeros(len(start), np.int64)
        at = np.flatnonzero(rank == least)
        leader[np.repeat(np.arange(len(start)), size)[at]] = x[at]
        most, small = np.repeat(np.maximum.reduceat(r, start), size), np.repeat(np.minimum.reduceat(n, start), size)
        able = np.minimum(r, most) >= _need(n, np.maximum(small, -(-num * n // den)), num, den)
        y = np.repeat(leader, size)
        keep = able & (x != y) & (np.repeat(size, size) > 1)
        return np.unique(np.stack([x[keep], y[keep]]), axis=1)

    def run(batches):
        rest = None
        for b in batches:
            cols = [np.asarray(c) for c in b.columns]
            if rest is not None:
                cols = [np.concatenate([p, c]) for p, c in zip(rest, cols, strict=True)]
            cut = int(np.searchsorted(cols[0], cols[0][-1])) if len(cols[0]) else 0
            rest = [c[cut:] for c in cols]  # the last list may go on; its length is below HOT_LIST
            if cut:
                x, y = of_lists(*(c[:cut] for c in cols))
                yield batch([("x", x), ("y", y)])
        if rest is not None and len(rest[0]):
            x, y = of_lists(*rest)
            yield batch([("x", x), ("y", y)])

    return run


def _overlaps(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Exact overlap of every set in ``left`` with every set in ``right`` (numbers of sets)."""
    both = np.union1d(left, right)
    flat = np.concatenate([sets[i] for i in both])
    row = np.repeat(both, [len(sets[i]) for i in both])
    _, element, n = np.unique(flat, return_inverse=True, return_counts=True)
    shared = n > 1
    number = np.cumsum(shared) - 1
    keep = shared[element]
    element, row = number[element[keep]], row[keep]
    out = np.zeros((len(left), len(right)), np.int64)
    at_left, at_right = (np.full(both.max() + 1, -1) for _ in range(2))
    at_left[left], at_right[right] = np.arange(len(left)), np.arange(len(right))
    width = max(256, (1 << 23) // max(len(both), 1))
    order = np.argsort(element, kind="stable")
    element, row = element[order], row[order]
    for low in range(0, int(element[-1]) + 1 if len(element) else 0, width):
        a, z = np.searchsorted(element, [low, low + width])
        e, r = element[a:z] - low, row[a:z]
        tables = []
        for place, m in ((at_left, len(left)), (at_right, len(right))):
            t = np.zeros((m, width), np.float32)
            k = place[r] >= 0
            t[place[r[k]], e[k]] = 1
            tables.append(t)
        out += np.rint(tables[0] @ tables[1].T).astype(np.int64)
    return out


def _with_leader(leader: np.ndarray, sets: list[np.ndarray]) -> np.ndarray:
    flat = np.concatenate(sets)
    at = np.searchsorted(leader, flat)
    found = (at < len(leader)) & (leader[np.minimum(at, len(leader) - 1)] == flat)
    sums = np.r_[0, np.cumsum(found)]
    ends = np.cumsum([len(s) for s in sets])
    return sums[ends] - sums[np.r_[0, ends[:-1]]]


def _forest(home: np.ndarray, away: np.ndarray, link: np.ndarray) -> np.ndarray:
    """The pairs (away[i], j) of ``link`` that join parts not yet connected, ``home`` being one part."""
    part = np.where(home, len(home), np.arange(len(home)))
    pairs = [np.zeros((0, 2), np.int64)]
    for i, row in zip(away, link, strict=True):
        near = np.flatnonzero(row)
        parts, at = np.unique(part[near], return_index=True)
        new = parts != part[i]
        if new.any():
            pairs.append(np.stack([np.full(new.sum(), i), near[at[new]]], axis=1))
            part[np.isin(part, parts[new])] = part[i]
    return np.concatenate(pairs)


def cluster_links(leader: np.ndarray, sets: list[np.ndarray], block: np.ndarray, num: int, den: int, every: bool = False):
    """(which sets link to the leader, linking pairs (i, j) within a leader's cluster).

    With ``every`` all linking pairs are listed.  Otherwise the pairs and the links to the leader are
    a spanning forest of all links, so fewer pairs than sets are listed, and no pair is asked for of
    which both link to the leader.  Where ``block`` holds two values only pairs across them are asked
    for (those within were answered before).
    """
    n = np.array([len(s) for s in sets], np.int64)
    inside = _with_leader(leader, sets)
    home = inside >= _need(n, len(leader), num, den)
    away = np.arange(len(sets)) if every else np.flatnonzero(~home)
    pairs = np.zeros((0, 2), np.int64)
    if len(away) and len(sets) > 1:
        outside = n - inside
        need = _need(n[away][:, None], n[None, :], num, den)
        bound = np.minimum(inside[away][:, None], inside[None, :]) + np.minimum(outside[away][:, None], outside[None, :])
        known = inside[away][:, None] + inside[None, :] - len(leader) >= need  # they overlap that much in the leader alone
        ask = bound >= need
        ask[np.arange(len(away)), away] = False
        if every:
            ask &= away[:, None] < np.arange(len(sets))[None, :]
        if block.min() != block.max():
            ask &= block[away][:, None] != block[None, :]
        link = ask & known
        ask &= ~known
        rows, cols = np.flatnonzero(ask.any(axis=1)), np.flatnonzero(ask.any(axis=0))
        if len(rows):
            exact = _overlaps(sets, away[rows], cols)
            link[np.ix_(rows, cols)] |= ask[np.ix_(rows, cols)] & (exact >= need[np.ix_(rows, cols)])
        pairs = np.argwhere(link) if every else _forest(home, away, link)
    return home, pairs


def _near(num: int, den: int):
    """The members of a cluster that may link with another one, and the leader with them."""

    def run(group: pa.Table) -> pa.Table:
        y, x, n = (np.asarray(group.column(c).combine_chunks()) for c in ("y", "x", "n"))
        may = may_link([np.frombuffer(s, np.uint8) for s in group.column("sketch").to_pylist()], n.astype(np.int64), num, den)
        keep = pa.array((may | (x == y)) if may.any() else may)
        return group.select(["y", "x"]).filter(keep)

    return run


def _meet(num: int, den: int):
    """The members of two blocks of a cluster that may link across them, one of the two at least being away from the leader."""

    def run(group: pa.Table) -> pa.Table:
        x, n, block, away = (np.asarray(group.column(c).combine_chunks()) for c in ("x", "n", "block", "is_away"))
        may = may_link([np.frombuffer(s, np.uint8) for s in group.column("sketch").to_pylist()], n.astype(np.int64), num, den, block, away)
        return group.select(["y", "x", "block", "lo", "hi"]).filter(pa.array(may))

    return run


def _check(k: int, num: int, den: int, every: bool):
    def run(group: pa.Table) -> pa.Table:
        y = group.column("y")[0].as_py()
        x = np.asarray(group.column("x").combine_chunks())
        sets = [s for _, _, raw, offsets in steps(group.column("text")) for s in shingle_sets(raw, offsets, k)]
        block = np.asarray(group.column("block").combine_chunks())
        who = np.flatnonzero(x == y)
        rest = np.flatnonzero(x != y)
        home, pairs = cluster_links(sets[who[0]], [sets[i] for i in rest], block[rest], num, den, every) if len(rest) else (np.zeros(0, bool), np.zeros((0, 2), int))
        x = x[rest]
        a = np.concatenate([x, x[pairs[:, 0]]])
        b = np.concatenate([np.full(len(x), y), x[pairs[:, 1]]])
        linked = np.concatenate([home, np.ones(len(pairs), bool)])
        blocks = np.concatenate([block[rest], np.full(len(pairs), -1)])
        return pa.table({"y": pa.array(np.full(len(a), y), pa.int64()), "a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "block": pa.array(blocks, pa.int32()), "linked": pa.array(linked)})

    return run


def _links(docs: DataFrame, id_col: str, text_col: str, shingle_words: int, num: int, den: int, every: bool, unique: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows with their keys; doc_key, n, rep of each row; linking pairs a, b of representatives, repeats included)."""
    if not 0 < num <= den:
        raise ValueError("the threshold num / den must be over 0 and at most 1")
    spark = docs.sparkSession
    ship(spark)
    rows = keyed(docs, id_col, text_col, unique)
    texts = rows.select("doc_key", "text")

    profile = stored(map_arrow(texts, _profile(shingle_words), "doc_key long, n int, f1 long, f2 long, sketch binary, counts binary"), "profile")
    levels = np.zeros(1 << BUCKET_BITS, np.uint8)
    parts = profile.where("counts IS NOT NULL").select("n", "counts").repartition("n")
    for chunk, data in map_arrow(parts, _sum_counts, "chunk int, level binary").toLocalIterator():
        levels[chunk * _CHUNK : (chunk + 1) * _CHUNK] = np.frombuffer(data, np.uint8)
    levels = spark.sparkContext.broadcast(levels)

    sets_of = profile.where("counts IS NULL").drop("counts", "sketch")
    same = checkpoint(sets_of.where("n > 0").groupBy("f1", "f2").agg(F.min("doc_key").alias("rep")))
    reps = checkpoint(sets_of.join(same, ["f1", "f2"], "left").select("doc_key", "n", F.coalesce("rep", "doc_key").alias("rep")))

    entries = stored(map_arrow(texts, _prefixes(shingle_words, num, den, levels), "token long, x long, n int, r int, hot boolean"), "entries")
    light = entries.where("NOT hot").drop("hot").repartition("token").sortWithinPartitions("token")
    members = map_arrow(light, _lead(num, den), "x long, y long")

    band = F.floor(F.log(F.col("n")) / F.lit(_band_width(num, den)))
    hot = entries.where("hot").select("token", "x", "n", "r", F.explode(F.array(band, band + 1)).alias("band"))
    leaders = checkpoint(
        hot.groupBy(F.col("token").alias("t"), F.col("band").alias("d"))
        .agg(F.min(F.struct(F.xxhash64("x"), "x")).alias("first"), F.max("r").alias("most"), F.min("n").alias("small"))
    )
    partner = F.greatest(F.col("small"), F.ceil(F.col("n") * F.lit(num) / F.lit(den)))
    need = F.ceil((F.col("n") + partner) * F.lit(num) / F.lit(num + den))
    joined = hot.join(leaders, (hot.token == leaders.t) & (hot.band == leaders.d))
    hot_members = joined.where(F.least("r", "most") >= need).select("x", F.col("first.x").alias("y")).where("x <> y")

    found = members.unionByName(hot_members).distinct()
    for side, more in (("x", ["n"]), ("y", [])):
        of = reps.select(F.col("doc_key").alias("k"), "rep", *more)
        found = found.join(of, F.col(side) == F.col("k")).drop(side, "k").withColumnRenamed("rep", side)
    found = checkpoint(found.where("x <> y").distinct())

    by_rows, by_shingles = F.ceil(F.count("*") / F.lit(CLUSTER_ROWS)), F.ceil(F.sum("n") / F.lit(BLOCK_SHINGLES))
    sizes = found.groupBy(F.col("y").alias("c")).agg(F.greatest(by_rows, by_shingles).cast("int").alias("blocks"))
    placed = found.join(sizes, F.col("y") == F.col("c")).select("y", "x", "blocks", F.pmod(F.xxhash64("x"), F.col("blocks")).cast("int").alias("block"))
    heads = sizes.select(F.col("c").alias("y"), F.col("c").alias("x"), "blocks", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    placed = checkpoint(placed.unionByName(heads))
    sketches = profile.where("counts IS NULL").select("doc_key", "n", "sketch")
    whole = placed.where("blocks = 1").join(sketches, F.col("x") == F.col("doc_key")).select("y", "x", "n", "sketch")
    near = whole.groupBy("y").applyInArrow(_near(num, den), "y long, x long")
    near = near.select("y", "x", F.lit(1).alias("blocks"), F.lit(0).alias("block"))
    placed = checkpoint(near.unionByName(placed.where("blocks > 1")))

    wanted = checkpoint(placed.select(F.col("x").alias("key")).distinct())
    plane, bits = repeated_plane(wanted, wanted.count(), repeated=False)
    want = spark.sparkContext.broadcast(plane)

    def wanted_texts(batches):
        for b in batches:
            yield b.filter(pa.array(hits(np.asarray(b.column(0)).view(np.uint64), want.value, bits)))

    possible = map_arrow(texts, wanted_texts, "doc_key long, text string")

    def with_text(places: DataFrame) -> DataFrame:
        """``places`` and the text of its x; texts are smaller than their sets, so they move and tasks make the sets."""
        return possible.join(places, F.col("doc_key") == F.col("x")).select(*places.columns, "text")

    schema = "y long, a long, b long, block int, linked boolean"
    first = checkpoint(with_text(placed.drop("blocks")).groupBy("y", "block").applyInArrow(_check(shingle_words, num, den, every), schema))
    edges = first.where("linked").select("a", "b")

    away = checkpoint(first.where("NOT linked").select(F.col("y").alias("wy"), F.col("a").alias("wa"), F.col("block").alias("wb")))
    large = checkpoint(placed.where("blocks > 1"))
    if large.limit(1).count():
        # Blocks of one large cluster meet only where a member that does not link to the leader is involved, or for all pairs.
        members_at = large.where("x <> y").join(away, (F.col("y") == F.col("wy")) & (F.col("x") == F.col("wa")), "left")
        is_away = F.lit(True) if every else F.col("wa").isNotNull()
        members_at = members_at.select("y", "x", "block", is_away.alias("is_away"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")).where("block <> other")
        if not every:
            open_blocks = away.select(F.col("wy").alias("oy"), F.col("wb").alias("ob")).distinct()
            members_at = members_at.join(open_blocks, (F.col("y") == F.col("oy")) & (F.col("other") == F.col("ob")), "left").where("is_away OR oy IS NOT NULL")
        members_at = members_at.select("y", "x", "block", "is_away", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"))
        # Sketches move before texts: only members with a possible partner in the other block go on.
        meeting = members_at.join(sketches, F.col("x") == F.col("doc_key")).select("y", "x", "block", "is_away", "lo", "hi", "n", "sketch")
        members_at = checkpoint(meeting.groupBy("y", "lo", "hi").applyInArrow(_meet(num, den), "y long, x long, block int, lo int, hi int"))
        pairs_of = members_at.select("y", "lo", "hi").distinct()
        tops = pairs_of.select("y", F.col("y").alias("x"), F.lit(-1).alias("block"), "lo", "hi")
        second = with_text(members_at.unionByName(tops)).groupBy("y", "lo", "hi").applyInArrow(_check(shingle_words, num, den, every), schema)
        edges = edges.unionByName(second.where("linked AND block = -1").select("a", "b"))
    return rows, reps, edges


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 5, num: int = 80, den: int = 100, unique: bool = False) -> DataFrame:
    """(doc_key, doc_id, n_shingles, component_key, component_id): one row for each row of ``docs``.

    Words are runs of bytes outside {0x20, 0x09-0x0D} after lower-casing A-Z; a text of fewer than
    ``shingle_words`` words is one shingle, and one without words, or a null, has the empty set and
    links with nothing.  Two rows link when their sets' Jaccard similarity is at least ``num / den``;
    a component is named by its smallest key (the id, see ``common.keyed`` for repeated or null
    ids).  Sets are compared by 64-bit shingle hashes.  Other columns are not read; an empty table
    gives an empty result.  ``unique`` as in ``common.keyed``.
    """
    rows, reps, edges = _links(docs, id_col, text_col, shingle_words, num, den, False, unique)
    parts = checkpoint(components(edges))
    named = reps.join(parts, reps.rep == parts.node, "left").select("doc_key", "n", F.coalesce("component", "rep").alias("component_key"))
    ids = rows.select("doc_key", "doc_id")
    named = named.join(ids, "doc_key")
    names = ids.select(F.col("doc_key").alias("ck"), F.col("doc_id").alias("component_id"))
    return named.join(names, F.col("component_key") == F.col("ck")).select("doc_key", "doc_id", F.col("n").cast("long").alias("n_shingles"), "component_key", "component_id")


def near_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 5, num: int = 80, den: int = 100) -> tuple[DataFrame, DataFrame]:
    """(classes, pairs): the whole join, in rows of classes of equal sets.

    ``classes`` is (doc_key, doc_id, n_shingles, class_key, class_size, n_links), one row for each row of
    ``docs``: rows of equal sets share the class named by its smallest key, and ``n_links`` counts
    the other rows that a row links to, those of its own class included.  ``pairs`` is (a, b) with
    a < b: every two classes whose sets link, each pair once.  Its size is that of the answer, which
    may grow with the square of a group of near copies; ``near_groups`` never lists it.  Rows without
    words are classes of their own and link with nothing.  Edge cases as in ``near_groups``.
    """
    rows, reps, edges = _links(docs, id_col, text_col, shingle_words, num, den, True, False)
    pairs = checkpoint(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    sizes = checkpoint(reps.groupBy(F.col("rep").alias("class_key")).agg(F.count("*").alias("class_size")))
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    outside = checkpoint(both.join(sizes, F.col("b") == F.col("class_key")).groupBy(F.col("a").alias("k")).agg(F.sum("class_size").alias("outside")))
    linked = sizes.join(outside, F.col("class_key") == F.col("k"), "left").select("class_key", "class_size", (F.col("class_size") - 1 + F.coalesce("outside", F.lit(0))).alias("n_links"))
    named = reps.join(linked, reps.rep == linked.class_key).join(rows.select("doc_key", "doc_id"), "doc_key")
    return named.select("doc_key", "doc_id", F.col("n").cast("long").alias("n_shingles"), "class_key", "class_size", "n_links"), pairs


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: of each component the one of the smallest key."""
    rows, key = with_key(docs, id_col, text_col)
    gone = free_name(rows.columns, "gone_key")
    dropped = near_groups(rows, key, text_col, unique=True, **settings).where("doc_key <> component_key").select(F.col("doc_key").alias(gone))
    return rows.join(dropped, col(key) == F.col(gone), "left_anti").drop(key)
