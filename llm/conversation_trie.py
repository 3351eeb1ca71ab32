"""Prefix trie of conversations, with subtree totals by time-forward processing.

A node is a distinct sequence of first turns.  Its key is the sequence's hash, a polynomial over a
prime field that running sums can build in pieces, so a conversation of any length may lie in many
partitions.  Totals go from children to parents in reverse level order: nodes are sorted by Spark,
and a pass over them keeps the messages to parents in a priority queue that spills.  That happens

1. within shards: subtrees of at most ``band`` levels below a light node,
2. across the roots of shards of one region, the subtree of a light child of a heavy node,
3. across the heavy nodes, those with over ``heavy`` members; at most HEAVY_NODES of them exist.

Then each shard runs once more with what its roots have learned.
"""

from __future__ import annotations

import hashlib
import heapq
import os
import struct
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import batch, col, map_arrow, ship, stored

#: Keys are polynomials in BASE modulo the prime 2^127 - 1; two sequences of d turns meet with probability d / 2^127.
PRIME = (1 << 127) - 1
BASE = int.from_bytes(hashlib.sha256(b"conversation trie").digest()[:15], "big")
ROOT = bytes(16)
#: Levels of a shard; nodes with more members than rows / HEAVY_NODES (LEAST_HEAVY at least) are heavy.
BAND, HEAVY_NODES, LEAST_HEAVY = 64, 1 << 16, 32
#: Messages that a queue holds in memory, rows of an output batch, ids of a chunk of a list.
QUEUE, OUT_ROWS, CHUNK_IDS = 1 << 17, 1 << 13, 1 << 16
_WORD = r"[^\x20\x09-\x0D]+"


def _turns(rows: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """(conv, turn, element, words, seq): a digest of each turn stands for its role and text, which don't move."""
    role, text = (F.coalesce(col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    said = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    element = F.unhex(F.substring(F.sha2(said.cast("binary"), 256), 1, 32))
    base = rows.select(col(conv_col).cast("long").alias("conv"), col(turn_col).cast("long").alias("turn"), element.alias("element"), F.regexp_count(text, F.lit(_WORD)).cast("long").alias("words"))
    return base.where("conv IS NOT NULL").withColumn("seq", F.monotonically_increasing_id())


def rebuilt(rows: DataFrame, family: int = 20, heads: int = 4, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, kind, turn, element, words, seq): the turns of rebuilt conversations, to be ordered by (kind, turn, element, seq).

    With h = crc32(conv) % heads, conversation c gets the first h turns of conversation
    c - c % family (kind 0), then its own turns after its first h (kind 1: null turns, kind 2: others).
    A conversation left without turns has one row of kind null.  Turns are ordered by turn, nulls first;
    those of equal turn by a digest of role and text.  Null roles and texts are empty.  Rows of null
    conversation belong to none and are left out.
    """
    turns = stored(_turns(rows, conv_col, turn_col, role_col, text_col), "turns")
    order = Window.partitionBy("conv").orderBy(F.asc_nulls_first("turn"), "element", "seq")
    # Only the first heads - 1 rows of each task and conversation move.
    first = stored(turns.select("conv", "turn", "element", "words", "seq", F.row_number().over(order).alias("rank")).where(F.col("rank") < heads), "first-turns")
    h = (F.crc32(F.col("conv").cast("string").cast("binary")) % heads).cast("int")
    convs = turns.select("conv").distinct().withColumns({"h": h, "base": F.col("conv") - F.col("conv") % family})
    base = first.select(F.col("conv").alias("base"), "element", "words", "rank")
    head = convs.join(base, "base").where("rank <= h").select("conv", F.lit(0).alias("kind"), F.col("rank").cast("long").alias("turn"), "element", "words", F.lit(0).cast("long").alias("seq"))
    replaced = first.where(F.col("rank") <= h).select("seq")
    own = turns.join(replaced, "seq", "left_anti").select("conv", F.when(F.col("turn").isNull(), 1).otherwise(2).alias("kind"), F.coalesce("turn", F.lit(0)).alias("turn"), "element", "words", "seq")
    every = head.unionByName(own)
    # Whether a conversation has turns left follows from counts: a conversation of over h turns keeps some.
    none = convs.join(every.select("conv").distinct(), "conv", "left_anti")
    empty = none.select("conv", F.lit(None).cast("int").alias("kind"), F.lit(None).cast("long").alias("turn"), F.lit(None).cast("binary").alias("element"), F.lit(None).cast("long").alias("words"), F.lit(None).cast("long").alias("seq"))
    return every.unionByName(empty)


def plain(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The turns of conversations as they are, in the form of ``rebuilt``."""
    turns = _turns(rows, conv_col, turn_col, role_col, text_col)
    return turns.select("conv", F.when(F.col("turn").isNull(), 1).otherwise(2).alias("kind"), F.coalesce("turn", F.lit(0)).alias("turn"), "element", "words", "seq")


def _key(value: int) -> bytes:
    return value.to_bytes(16, "big")


def _running(batches):
    """(part, conv, at, key, up, words): within the partition, place of each turn in its conversation and hash of the turns so far, without and with it."""
    part, conv, at, value = TaskContext.get().partitionId(), None, 0, 0
    for b in batches:
        places, keys, ups = [], [], []
        for c, e in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if c != conv:
                conv, at, value = c, 0, 0
            ups.append(_key(value))
            value = (value * BASE + int.from_bytes(e, "big") + 1) % PRIME
            at += 1
            places.append(at)
            keys.append(_key(value))
        yield batch([("part", pa.array([part] * len(keys), pa.int32())), ("conv", b.column(0)), ("at", pa.array(places, pa.int64())), ("key", pa.array(keys, pa.binary())), ("up", pa.array(ups, pa.binary())), ("words", b.column(2))])


def paths(turns: DataFrame) -> DataFrame:
    """(conv, depth, key, up, words): every turn with the keys of its node and of the node above; the root has depth 0.

    The rows are sorted by range, so one conversation may take many partitions; what a partition needs
    of those before it is one row of each, and only these rows (as many as partitions) reach the driver.
    """
    ordered = turns.where("kind IS NOT NULL").repartitionByRange("conv", "kind", "turn", "element", "seq").sortWithinPartitions("conv", "kind", "turn", "element", "seq")
    local = stored(map_arrow(ordered.select("conv", "element", "words"), _running, "part int, conv long, at long, key binary, up binary, words long"), "running")
    ends = local.groupBy("part").agg(F.min("conv").alias("first"), F.max(F.struct("conv", "at", "key")).alias("last")).orderBy("part").collect()
    carried: dict[int, tuple[int, int, int]] = {}  # part -> conversation it goes on with, turns and hash so far
    conv, at, value = None, 0, 0
    for r in ends:
        if r["first"] == conv:
            carried[r.part] = (conv, at, value)
        went_on = r["last"].conv == conv
        shift = pow(BASE, r["last"].at, PRIME)
        value = ((value * shift if went_on else 0) + int.from_bytes(r["last"].key, "big")) % PRIME
        at = (at if went_on else 0) + r["last"].at
        conv = r["last"].conv
    if not carried:
        return local.select("conv", F.col("at").alias("depth"), "key", "up", "words")
    shared = turns.sparkSession.sparkContext.broadcast(carried)

    def settle(batches):
        for b in batches:
            convs, depths, keys, ups = (b.column(k).to_pylist() for k in (1, 2, 3, 4))
            for i, p in enumerate(b.column(0).to_pylist()):
                known = shared.value.get(p)
                if known and known[0] == convs[i]:
                    shift = pow(BASE, depths[i] - 1, PRIME)
                    ups[i] = _key((known[2] * shift + int.from_bytes(ups[i], "big")) % PRIME)
                    keys[i] = _key((known[2] * shift * BASE + int.from_bytes(keys[i], "big")) % PRIME)
                    depths[i] += known[1]
            yield batch([("conv", b.column(1)), ("depth", pa.array(depths, pa.int64())), ("key", pa.array(keys, pa.binary())), ("up", pa.array(ups, pa.binary())), ("words", b.column(5))])

    return stored(map_arrow(local, settle, "conv long, depth long, key binary, up binary, words long"), "paths")


class MessageQueue:
    """Sums on their way to parents, taken in reverse level order; beyond ``limit`` they spill as sorted runs.

    Runs go to unnamed files in the folder where Spark itself spills; no other task reads them.
    """

    _RECORD = struct.Struct(">q16sqq")

    def __init__(self, limit: int = QUEUE):
        self.limit, self.heap, self.runs, self.spilled = limit, [], [], 0

    def push(self, depth: int, key: bytes, leaves: int, saved: int) -> None:
        heapq.heappush(self.heap, (-depth, key, leaves, saved))
        if len(self.heap) > self.limit:
            self._spill()

    def _spill(self) -> None:
        folder = (os.environ.get("SPARK_LOCAL_DIRS") or tempfile.gettempdir()).split(",")[0]
        file = tempfile.TemporaryFile(dir=folder if os.path.isdir(folder) else None)
        for record in self._merged(sorted(self.heap)):
            file.write(self._RECORD.pack(*record))
        file.seek(0)
        self.heap, self.spilled = [], self.spilled + 1
        run = self._read(file)
        self.runs.append([next(run), run])

    @staticmethod
    def _merged(records) -> Iterator[tuple[int, bytes, int, int]]:
        """Records of one parent as one."""
        now = None
        for r in records:
            if now and now[:2] == r[:2]:
                now = (*now[:2], now[2] + r[2], now[3] + r[3])
            else:
                if now:
                    yield now
                now = r
        if now:
            yield now

    def _read(self, file) -> Iterator[tuple[int, bytes, int, int]]:
        with file:
            while data := file.read(self._RECORD.size * 1024):
                yield from self._RECORD.iter_unpack(data)

    def take(self, depth: int, key: bytes) -> tuple[int, int]:
        """What has arrived for this node; nodes come in reverse level order, so it is first in the heap and in each run."""
        leaves = saved = 0
        at = (-depth, key)
        while self.heap and self.heap[0][:2] == at:
            r = heapq.heappop(self.heap)
            leaves, saved = leaves + r[2], saved + r[3]
        for run in self.runs:
            if run[0] and run[0][:2] == at:
                leaves, saved = leaves + run[0][2], saved + run[0][3]
                run[0] = next(run[1], None)
        return leaves, saved

    def clear(self) -> None:
        self.heap, self.runs = [], []


def _forward(roots_only: bool):
    """Totals of (group, key, depth, up, up_depth, leaves, saved) rows that come by group, depth falling and key."""

    def run(batches):
        queue, group, out = MessageQueue(), None, []
        for b in batches:
            for g, key, depth, up, up_depth, leaves, saved in zip(*(b.column(k).to_pylist() for k in range(7)), strict=True):
                if g != group:
                    queue.clear()
                    group = g
                came = queue.take(depth, key)
                leaves, saved = leaves + came[0], saved + came[1]
                if up is not None:
                    queue.push(up_depth, up, leaves, saved)
                if up is None or not roots_only:
                    out.append((key, leaves, saved))
                if len(out) >= OUT_ROWS:
                    yield _totals(out)
                    out = []
        if out:
            yield _totals(out)

    return run


def _totals(rows) -> pa.RecordBatch:
    keys, leaves, saved = zip(*rows, strict=True)
    return batch([("key", pa.array(keys, pa.binary())), ("leaves", pa.array(leaves, pa.int64())), ("saved", pa.array(saved, pa.int64()))])


def forward(nodes: DataFrame, roots_only: bool = False) -> DataFrame:
    """(key, leaves, saved) of each node of ``nodes`` (group, key, depth, up, up_depth, leaves, saved), its subtree in the group included.

    ``up`` is null for roots of a group; ``roots_only`` returns theirs alone.
    """
    columns = ("group", "key", "depth", "up", "up_depth", "leaves", "saved")
    dealt = nodes.select(*columns).repartition("group").sortWithinPartitions("group", F.desc("depth"), "key")
    return map_arrow(dealt, _forward(roots_only), "key binary, leaves long, saved long")


def _chunks(batches):
    """(key, part, k, said): decimal ids of each key joined by commas, CHUNK_IDS a row at most."""
    part, key, k, ids, out = TaskContext.get().partitionId(), None, 0, [], []
    for b in batches:
        for x, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if x != key or len(ids) >= CHUNK_IDS:
                if ids:
                    out.append((key, k, ",".join(ids)))
                k, key, ids = (k + 1 if x == key else 0), x, []
            ids.append(str(c))
        if len(out) >= OUT_ROWS:
            yield _said(part, out)
            out = []
    if ids:
        out.append((key, k, ",".join(ids)))
    if out:
        yield _said(part, out)


def _said(part, out):
    keys, ks, said = zip(*out, strict=True)
    return batch([("key", pa.array(keys, pa.binary())), ("part", pa.array([part] * len(keys), pa.int32())), ("k", pa.array(ks, pa.int32())), ("said", pa.array(said))])


def _digests(batches):
    key, state, out = None, None, []
    for b in batches:
        for x, said in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if x != key:
                if state:
                    out.append((key, state.hexdigest()))
                key, state = x, hashlib.sha256(said.encode())
            else:
                state.update(b"," + said.encode())
        if len(out) >= OUT_ROWS:
            yield _hexes(out)
            out = []
    if state:
        out.append((key, state.hexdigest()))
    if out:
        yield _hexes(out)


def _hexes(out):
    keys, hexes = zip(*out, strict=True)
    return batch([("key", pa.array(keys, pa.binary())), ("sha", pa.array(hexes))])


def list_digests(pairs: DataFrame) -> DataFrame:
    """(key, sha): SHA-256 of the ascending ids of each key, of ``pairs`` (key, conv).

    Ids are sorted and written out in chunks by range, so a key may take many partitions; only a hash's state, which is serial by its nature, passes over the chunks of one key.
    """
    ordered = pairs.repartitionByRange("key", "conv").sortWithinPartitions("key", "conv")
    chunks = map_arrow(ordered.select("key", "conv"), _chunks, "key binary, part int, k int, said string")
    return map_arrow(chunks.repartition("key").sortWithinPartitions("key", "part", "k").select("key", "said"), _digests, "key binary, sha string")


def prefix_trie(turns: DataFrame, band: int = BAND, heavy: int | None = None) -> DataFrame:
    """One row for each node of the trie of ``turns`` (from ``rebuilt`` or ``plain``), all long but the last:

    conv_id (smallest member), depth, parent_conv_id (null for the root), n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256.  Conversations without turns are members of the root only.  An empty
    table gives an empty result: there is no root without members.  Results don't depend on ``band`` and
    ``heavy`` (members beyond which a node is heavy; from the number of rows if None).
    """
    ship(turns.sparkSession)
    kept = stored(turns, "rebuilt-turns")
    rows = paths(kept)
    n_rows = rows.count()
    most = heavy if heavy is not None else max(LEAST_HEAVY, n_rows // HEAVY_NODES)
    counted = rows.groupBy("key", "depth", "up").agg(F.count("*").alias("n_convs"), F.min("conv").alias("conv_id"), F.max("words").alias("words"))
    children = rows.select("key", "up").distinct().groupBy(F.col("up").alias("key")).agg(F.count("*").alias("n_children"))
    nodes = stored(counted.join(children, "key", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long"))), "nodes")

    # Heavy nodes: at most n_rows / heavy rows, as each node takes a row of each member.
    top = nodes.where(F.col("n_convs") > most)
    weighty = F.broadcast(top.select("key"))
    deepest = rows.join(weighty, "key", "left_semi").groupBy("conv").agg(F.max("depth").alias("light_from"))
    light = nodes.join(weighty, "key", "left_anti").join(deepest.withColumnRenamed("conv", "conv_id"), "conv_id", "left")

    def root_depth(depth: Column) -> Column:
        """Depth of the root of the shard that has the node of this depth on the same conversation."""
        return F.greatest(F.col("light_from") + 1, depth - (depth - 1) % band)

    light = light.withColumn("light_from", F.coalesce("light_from", F.lit(0).cast("long"))).withColumn("root_depth", root_depth(F.col("depth")))
    # The conversation of a node's smallest member passes through the roots of its shard and region.
    cut = light.where("depth = root_depth")
    anchors = rows.select(F.col("conv").alias("conv_id"), F.col("depth").alias("root_depth"), F.col("key").alias("group"))
    light = stored(light.join(anchors, ["conv_id", "root_depth"]), "light-nodes")
    is_root = F.col("depth") == F.col("root_depth")
    own = {"leaves": (F.col("n_children") == 0).cast("long"), "saved": (F.col("n_convs") - 1) * F.col("words")}
    inside = light.withColumns(own | {"up": F.when(~is_root, F.col("up")), "up_depth": F.col("depth") - 1})

    # Within shards, then across the roots of a region's shards.
    of_roots = forward(inside, roots_only=True)
    above = F.when(F.col("depth") > F.col("light_from") + 1, root_depth(F.col("depth") - 1))
    roots = cut.select("key", "depth", "conv_id", F.col("up").alias("parent"), above.alias("up_depth"), (F.col("light_from") + 1).alias("region_depth"))
    named = anchors.select("conv_id", F.col("root_depth").alias("up_depth"), F.col("group").alias("up"))
    regions = anchors.select("conv_id", F.col("root_depth").alias("region_depth"), "group")
    roots = roots.join(named, ["conv_id", "up_depth"], "left").join(regions, ["conv_id", "region_depth"])
    roots = stored(roots.join(of_roots, "key"), "shard-roots")
    root_totals = stored(roots.select("key", "parent").join(forward(roots), "key"), "root-totals")
    sent = root_totals.groupBy(F.col("parent").alias("key")).agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
    more = {"leaves": F.col("leaves") + F.coalesce("more_leaves", F.lit(0)), "saved": F.col("saved") + F.coalesce("more_saved", F.lit(0))}

    # Across the heavy nodes and the root.
    ended = kept.where("kind IS NULL").select("conv")
    # One row from counts of conversations and of nodes of depth 1.
    seen = kept.select("conv").distinct().select("conv", F.lit(0).alias("child")).unionByName(nodes.where("depth = 1").select(F.lit(None).cast("long").alias("conv"), F.lit(1).alias("child")))
    start = seen.agg(F.count("conv").alias("n_convs"), F.min("conv").alias("conv_id"), F.sum("child").alias("n_children")).where("n_convs > 0").select(
        F.lit(ROOT).alias("key"), F.lit(0).cast("long").alias("depth"), F.lit(None).cast("binary").alias("up"), "n_convs", "conv_id", F.lit(0).cast("long").alias("words"), "n_children",
    )
    peak = stored(top.select("key", "depth", "up", "n_convs", "conv_id", "words", "n_children").unionByName(start), "heavy-nodes")
    crowned = peak.withColumns(own | {"group": F.lit(ROOT), "up_depth": F.col("depth") - 1}).join(sent, "key", "left").withColumns(more)
    # Within shards again, now with what the roots below have gathered.
    final = inside.join(sent, "key", "left").withColumns(more)
    totals = forward(final).unionByName(forward(crowned))

    # Names of parents: heavy ones are few, a light one has at most ``heavy`` children.
    names = peak.select(F.col("key").alias("up"), F.col("conv_id").alias("parent_conv_id"))
    of_light = light.select(F.col("key").alias("up"), F.col("conv_id").alias("light_parent"))
    every = light.select("key", "depth", "up", "n_convs", "conv_id", "n_children").unionByName(peak.select("key", "depth", "up", "n_convs", "conv_id", "n_children"))
    every = every.join(F.broadcast(names), "up", "left")
    under_heavy = every.where("parent_conv_id IS NOT NULL OR depth = 0")
    under_light = every.where("parent_conv_id IS NULL AND depth > 0").drop("parent_conv_id").join(of_light, "up").withColumnRenamed("light_parent", "parent_conv_id")
    every = under_heavy.unionByName(under_light)

    last = rows.groupBy("conv").agg(F.max(F.struct("depth", "key")).alias("m")).select(F.col("m.key").alias("key"), "conv")
    digests = list_digests(last.unionByName(ended.select(F.lit(ROOT).alias("key"), "conv")))
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    return every.join(totals, "key").join(digests, "key", "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("sha", nothing).alias("ends_sha256"),
    )
