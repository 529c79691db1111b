"""Near copies: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

SimHash comes first: each text has a 64-bit fingerprint of its five-word shingles, fingerprints
within `RADIUS` bits are linked by pivot distance tables (`simhash.links`), and each text is
verified by its shingles against the one it is linked to. What that settles needs no pairs later.

At a similarity of 0.8 fingerprints differ in 10 bits on average and in 20 at times, and no
tables of 64 bits lose nothing at 20. So between what SimHash left in different components
candidates are found by min-hashes in `BANDS` bands of `ROWS`: a pair at exactly 0.8 meets
in none with a probability of (1 - 0.8^5)^40 = 1.3e-7, a closer pair with less. Each
candidate pair is verified by the shingles themselves.

Nodes are distinct texts, by their lower-cased words, so exact copies cost one node. In a
bucket of more than `CROWD` nodes only neighbours by size become pairs. What this leaves in
different components is settled without pairs: nodes of crowded buckets that hold several
components gather in groups, each node once with its shingles; in a group all nodes that
aren't of its commonest component are held against all its nodes by an index of shingles,
in blocks of a bounded number of shingles, and only a spanning forest of the links found
leaves. So no candidate is left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh64_intdigest

from .common import Scratch, components, shards_for
from .simhash import RADIUS, forest, links, majority, one_each, packed_rows, runs

WIDTH, SIMILARITY = 5, 0.8
BANDS, ROWS = 40, 5
CROWD = 8
#: Nodes that a block of a group indexes.
PER_BLOCK = 2000
#: Shingles that a block indexes, and as many again for each part of the nodes that ask.
PER_INDEX = 1 << 20
#: Links that a block holds before they become a forest.
LINKS_HELD = 1 << 18
_RNG = np.random.default_rng(17)
_TIMES = _RNG.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLUS = _RNG.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)
_MIX = _RNG.integers(0, 1 << 63, ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BAND = _RNG.integers(0, 1 << 63, BANDS, dtype=np.uint64)


def shingles(text: str | None, width: int = WIDTH) -> tuple[int, np.ndarray]:
    """(node, sorted hashes of the distinct shingles); a shorter text is one shingle, one without words none."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0, np.zeros(0, np.uint64)
    joined = b" ".join(words)
    node = int(np.uint64(xxh64_intdigest(joined, 7)).view(np.int64))
    if len(words) <= width:
        return node, np.array([xxh64_intdigest(joined, 42)], np.uint64)
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size + 1) - 1
    start = end - size
    h = [xxh64_intdigest(joined[a:b], 42) for a, b in zip(start[: 1 - width].tolist(), end[width - 1 :].tolist(), strict=True)]
    return node, np.unique(np.array(h, np.uint64))


def bands(h: np.ndarray) -> np.ndarray:
    """The bucket of a set of shingles in each band."""
    low = np.full(len(_TIMES), np.iinfo(np.uint64).max, np.uint64)
    for a in range(0, len(h), 1024):
        # high bits of a product are well mixed, low ones aren't
        low = np.minimum(low, (_TIMES[:, None] * h[None, a : a + 1024] + _PLUS[:, None]).min(axis=1))
    key = _BAND.copy()
    for x, m in zip(low.reshape(BANDS, ROWS).T, _MIX, strict=True):
        key = (key ^ x) * m
        key ^= key >> np.uint64(29)
    return key.view(np.int64)


def with_nodes(docs: DataFrame) -> DataFrame:
    """(row, node, size, fp, keys): rows as structs with their node, number of distinct shingles, fingerprint, and buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [shingles(t) for t in b.column("row").field("text").to_pylist()]
            keys = pa.array([bands(h) if len(h) else [] for _, h in got], pa.list_(pa.int64()))
            fp = np.array([majority(h) for _, h in got], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array([n for n, _ in got], pa.int64()), pa.array([len(h) for _, h in got], pa.int32()), pa.array(fp), keys], names=["row", "node", "size", "fp", "keys"])

    more = [T.StructField("node", T.LongType()), T.StructField("size", T.IntegerType()), T.StructField("fp", T.LongType()), T.StructField("keys", T.ArrayType(T.LongType()))]
    rows = packed_rows(docs)
    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, *more]))


def _pairs(similarity: float):
    """Pairs (u, v) of the buckets, which come sorted by key: all of a small bucket, neighbours by size of a crowded one.

    Nodes that SimHash has put in one component (label) are no pair.
    """

    def of(key: np.ndarray, node: np.ndarray, size: np.ndarray, label: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        order = np.lexsort((node, size, key))
        key, node, size, label = key[order], node[order], size[order], label[order]
        n = np.unique(key, return_counts=True)[1]
        many = np.repeat(n, n) > CROWD
        live, shift = np.arange(len(key)), 0
        while len(live):
            shift += 1
            live = live[live + shift < len(key)]
            other = live + shift
            # rows of a bucket lie in order of size: one that is too large now stays too large
            live = live[(key[live] == key[other]) & (size[live] >= similarity * size[other] - 1e-9)]
            apart = live[label[live] != label[live + shift]]
            if len(apart):
                yield np.minimum(node[apart], node[apart + shift]), np.maximum(node[apart], node[apart + shift])
            live = live[~many[live]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def found() -> Iterator[pa.RecordBatch]:
            for u, v in of(*(np.concatenate(x) for x in zip(*held, strict=True))):
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

        for b in batches:
            cols = [b.column(c).to_numpy() for c in ("key", "node", "size", "label")]
            if n > 1 << 18 and len(b):
                # close the buckets that have ended; the last may go on
                cut = int(np.searchsorted(cols[0], held[-1][0][-1], "right"))
                if cut:
                    held.append([c[:cut] for c in cols])
                n += cut
                cols = [c[cut:] for c in cols]
                if not len(cols[0]):
                    continue
                yield from found()
                held, n = [], 0
            if len(cols[0]):
                held.append(cols)
                n += len(cols[0])
        if n:
            yield from found()

    return run


def verified(pairs: DataFrame, rows: DataFrame, similarity: float, scratch: Scratch, name: str = "near") -> DataFrame:
    """The pairs whose shingles are similar enough."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            blobs = [shingles(t)[1].tobytes() for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("node"), pa.array(blobs, pa.binary())], names=["node", "set"])

    def same(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            near = []
            for x, y in zip(b.column("x").to_pylist(), b.column("y").to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                near.append(both >= similarity * (len(x) + len(y) - both) - 1e-9)
            yield b.select(["u", "v"]).filter(pa.array(near, pa.bool_()))

    asked = pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    texts = rows.select("node", "row.text").join(asked, "node", "left_semi").groupBy("node").agg(F.first("text").alias("text"))
    held = scratch.keep(texts.mapInArrow(sets, "node long, set binary"), f"{name}-sets")
    left = held.select(F.col("node").alias("u"), F.col("set").alias("x"))
    right = held.select(F.col("node").alias("v"), F.col("set").alias("y"))
    found = scratch.keep(pairs.join(left, "u").join(right, "v").select("u", "v", "x", "y").mapInArrow(same, "u long, v long"), name)
    scratch.drop(f"{name}-sets")
    return found


def simhashed(nodes: DataFrame, rows: DataFrame, similarity: float, scratch: Scratch, radius: int) -> DataFrame:
    """(node, label) of nodes that SimHash finds and their shingles confirm; nodes: (node, fp).

    A node is held against the least node of its fingerprint, and that one against the least
    node of the fingerprint that the pivots link its own to: at most two pairs a node.
    """
    reps = scratch.keep(nodes.groupBy("fp").agg(F.min("node").alias("least")), "reps")
    to = links(reps, Scratch(rows.sparkSession, "pivots"), radius).where("u is not null").select("u", "v")
    across = to.join(reps.select(F.col("fp").alias("u"), F.col("least").alias("a")), "u").join(reps.select(F.col("fp").alias("v"), F.col("least").alias("b")), "v").select("a", "b")
    within = nodes.join(reps, "fp").where("node <> least").select(F.col("least").alias("a"), F.col("node").alias("b"))
    pairs = across.union(within).select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct()
    pairs = scratch.keep(pairs, "alike", rows=1 << 16)
    return scratch.keep(components(verified(pairs, rows, similarity, scratch, "alike-near"), Scratch(rows.sparkSession, "near")), "alike-labels")


def held_against(table: pa.Table, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Links of one block's residents (role 0) with the nodes that ask (role 1), as a forest."""
    role, node = table.column("role").to_numpy(), table.column("node").to_numpy()
    sets = [np.frombuffer(x, np.uint64) for x in table.column("set").to_pylist()]
    home = np.flatnonzero(role == 0)
    size = np.array([len(sets[i]) for i in home.tolist()])
    every = np.concatenate([np.zeros(0, np.uint64), *(sets[i] for i in home.tolist())])
    order = np.argsort(every, kind="stable")
    every, owner = every[order], np.repeat(np.arange(len(home)), size)[order]
    us, vs, n_held = [node[:0]], [node[:0]], 0

    def bound() -> tuple[np.ndarray, np.ndarray]:
        u, v = np.concatenate(us), np.concatenate(vs)
        return forest(u[u != v], v[u != v])

    for i in np.flatnonzero(role != 0).tolist():
        low, n = np.searchsorted(every, sets[i], "left"), np.searchsorted(every, sets[i], "right")
        n = n - low
        at = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())
        both = np.bincount(owner[at], minlength=len(home))
        near = home[both >= similarity * (size + len(sets[i]) - both) - 1e-9]
        us.append(np.full(len(near), node[i]))
        vs.append(node[near])
        n_held += len(near)
        if n_held > LINKS_HELD:
            u, v = bound()
            us, vs, n_held = [u], [v], 0
    return bound()


_OWN = "cast(pmod(xxhash64(node), {}) as int)"


def settled(seats: DataFrame, first: DataFrame, rows: DataFrame, similarity: float, scratch: Scratch, per_block: int, per_index: int = PER_INDEX) -> DataFrame:
    """(u, v): links between components of `first` that share a crowded bucket, as a forest."""
    known = first.select("node", F.col("label").alias("known"))
    crowd = seats.groupBy("key").count().where(F.col("count") > CROWD).select("key")
    placed = scratch.keep(seats.join(crowd, "key").join(known, "node", "left").select("key", "node", "size", F.coalesce("known", "node").alias("label")), "placed")
    mixed = placed.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.min("node").alias("hub")).where("low <> high").select("key", "hub")
    spokes = placed.join(mixed, "key")
    group = scratch.keep(components(spokes.select(F.col("node").alias("u"), F.col("hub").alias("v")), Scratch(rows.sparkSession, "crowd")), "groups")
    member = group.select("node", F.col("label").alias("crowd")).join(spokes.groupBy("node").agg(F.first("label").alias("label"), F.first("size").alias("size")), "node")
    most = member.groupBy("crowd", "label").agg(F.count("*").alias("n"), F.sum("size").alias("size")).groupBy("crowd").agg(F.max_by("label", F.struct("n", "label")).alias("common"), F.max_by("size", F.struct("n", "label")).alias("quiet"), F.sum("n").alias("n"), F.sum("size").alias("size"))
    # residents by blocks, the nodes that ask by parts
    blocks = most.selectExpr("crowd", "common", f"cast(greatest(ceil(n / {per_block}), ceil(size / {per_index})) as int) as blocks", f"cast(greatest(1, ceil((size - quiet) / {per_index})) as int) as parts")
    texts = rows.select("node", "row.text").groupBy("node").agg(F.first("text").alias("text"))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            blobs = [shingles(t)[1].tobytes() for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("node"), b.column("crowd"), b.column("label"), pa.array(blobs, pa.binary())], names=["node", "crowd", "label", "set"])

    held = scratch.keep(texts.join(member, "node").select("node", "crowd", "label", "text").mapInArrow(sets, "node long, crowd long, label long, set binary"), "members")
    live_there = f"transform(sequence(0, parts - 1), k -> named_struct('block', {_OWN.format('blocks')}, 'part', k, 'role', 0))"
    ask_all = f"transform(sequence(0, blocks - 1), k -> named_struct('block', k, 'part', {_OWN.format('parts')}, 'role', 1))"
    key = ["crowd", "block", "part"]
    dealt = held.join(blocks, "crowd").withColumn("p", F.explode(F.expr(f"if(label = common, {live_there}, concat({live_there}, {ask_all}))"))).select("crowd", "p.block", "p.part", "p.role", "node", "set")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs(batches, key):
            u, v = held_against(table, similarity)
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    parts = shards_for(held.count(), per_block)
    return scratch.keep(dealt.repartition(parts, *key).sortWithinPartitions(*key).mapInArrow(run, "u long, v long"), "settled")


def labels(rows: DataFrame, similarity: float, scratch: Scratch, per_block: int = PER_BLOCK, radius: int = RADIUS) -> DataFrame:
    """(node, label) of all nodes that have a near copy; rows as of with_nodes()."""
    nodes = rows.groupBy("node").agg(F.first("size").alias("size"), F.first("fp").alias("fp"), F.first("keys").alias("keys"))
    alike = simhashed(nodes.where("size > 0").select("node", "fp"), rows, similarity, scratch, radius)
    labelled = nodes.join(alike, "node", "left").select("keys", "node", "size", F.coalesce("label", "node").alias("label"))
    seats = scratch.keep(labelled.select(F.explode("keys").alias("key"), "node", "size", "label"), "seats")
    dealt = seats.repartition("key").sortWithinPartitions("key")
    pairs = scratch.keep(dealt.mapInArrow(_pairs(similarity), "u long, v long").distinct(), "pairs", rows=1 << 16)
    near = verified(pairs, rows, similarity, scratch)
    stars = alike.select(F.col("node").alias("u"), F.col("label").alias("v"))
    first = scratch.keep(components(near.union(stars), Scratch(rows.sparkSession, "near")), "first")
    # components only: the links found before stand as their stars
    found = first.select(F.col("node").alias("u"), F.col("label").alias("v")).union(settled(seats.drop("label"), first, rows, similarity, scratch, per_block))
    out = scratch.keep(components(found, Scratch(rows.sparkSession, "near")), "labels")
    scratch.drop("reps", "alike", "alike-near", "alike-labels", "seats", "pairs", "near", "first", "placed", "groups", "members", "settled")
    return out


def keep_one(docs: DataFrame, *, similarity: float = SIMILARITY, per_block: int = PER_BLOCK) -> DataFrame:
    """Of each component of near copies the row with the smallest doc_id (null last, then text); all columns stay.

    Texts without words, null ones too, are copies of each other. Rows without a doc_id, or
    with the same one, are told apart by their texts. Repeated rows leave one. No rows: none
    back. Names of other columns are free.
    """
    scratch = Scratch(docs.sparkSession, "copies")
    rows = scratch.keep(with_nodes(docs), "rows")
    return one_each(rows, labels(rows, similarity, scratch, per_block)).select("row.*")
