"""SimHash near-duplicates: fingerprints linked at a few differing bits, by pivot distance tables.

Reference fingerprints (pivots) come in two kinds, and each fingerprint's Hamming
distances to them are computed once.

* Dealing pivots form a product code: m words for the upper and m for the lower half, so m^2
  pivots whose distances are sums of two entries of two short tables. A fingerprint lives
  at its nearest pivot, at distance a, and visits every pivot within a + radius. Of two
  linked fingerprints the one that is farther from its own pivot visits the other's home,
  which lies at no more than a' + radius <= a + radius from it (triangle inequality): no
  link is lost, and each is met once, in the join of visitors and residents of a pivot.
* Discarding pivots give each fingerprint a row of distances that travels with it. A pair
  that meets is discarded where the largest difference between its two rows, or between
  its distances to the pivot where it meets, is over the radius. Survivors are verified.

m grows with the number of fingerprints, so that residents of a pivot don't. A crowded
pivot is split by a salt. What leaves a pivot is a spanning forest of its links, never all pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh64_intdigest

from .common import Scratch, components, pieces_of, shards_for

RADIUS = 3
#: Discarding pivots: a row of eight distances is one long.
N_PIVOTS = 24
#: Residents that a dealing pivot should have, and that a task compares at once.
PER_PIVOT, PER_BLOCK = 256, 4096
_BIT = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def majority(h: np.ndarray) -> int:
    """The bits that are set in over half of the hashes; 0 for none."""
    octets = h.view(np.uint8).reshape(-1, 8)
    ones = np.concatenate([np.bincount(octets[:, k], minlength=256) @ _BIT for k in range(8)])
    return int.from_bytes(np.packbits(ones * 2 > len(h), bitorder="little").tobytes(), "little")


def fingerprint(text: str | None, width: int = 3) -> int:
    """Unsigned SimHash of the text's word shingles; 0 for a text without words."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        h = np.array([xxh64_intdigest(joined, 42)], np.uint64)
    else:
        size = np.fromiter(map(len, words), np.int64, len(words))
        end = np.cumsum(size + 1) - 1
        start = end - size
        h = np.array([xxh64_intdigest(joined[a:b], 42) for a, b in zip(start[: 1 - width].tolist(), end[width - 1 :].tolist(), strict=True)], np.uint64)
    return majority(h)


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed long. One pass, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces_of(batches):
            fp = np.array([fingerprint(t) for t in b.column("text").to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fp)], names=["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fp long")


def references(m: int) -> tuple[np.ndarray, np.ndarray]:
    """The two codes of m words of 32 bits whose pairs are the dealing pivots."""
    words = np.array([xxh64_intdigest(f"reference {i}") for i in range(m)], np.uint64)
    return (words >> np.uint64(32)).astype(np.uint32), (words & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def pivots(n: int = N_PIVOTS) -> np.ndarray:
    """The discarding pivots: fixed pseudo-random words."""
    return np.array([xxh64_intdigest(f"pivot {i}") for i in range(n)], np.uint64)


def distance_rows(fp: np.ndarray) -> np.ndarray:
    """(n, N_PIVOTS // 8) longs that hold each fingerprint's distances to the discarding pivots, a byte each."""
    return np.ascontiguousarray(np.bitwise_count(fp[:, None] ^ pivots()[None])).view(np.int64)


def seats_of(fp: np.ndarray, m: int, radius: int) -> tuple[np.ndarray, ...]:
    """(row, pivot, role, distance to it, own distance): a fingerprint's home (role 0) and its visits (role 1)."""
    upper, lower = references(m)
    far = [np.bitwise_count((fp >> np.uint64(32)).astype(np.uint32)[:, None] ^ upper[None]), np.bitwise_count((fp & np.uint64(0xFFFFFFFF)).astype(np.uint32)[:, None] ^ lower[None])]
    home = [f.argmin(1) for f in far]
    least = [f.min(1).astype(np.int64) for f in far]
    own = least[0] + least[1]
    # list decoding: what a codeword lies beyond the best of its half, both halves together, is within the radius
    over = [f - x[:, None].astype(f.dtype) for f, x in zip(far, least, strict=True)]
    (r0, c0), (r1, c1) = (np.nonzero(x <= radius) for x in over)
    n0, n1 = np.bincount(r0, minlength=len(fp)), np.bincount(r1, minlength=len(fp))
    times = n1[r0]
    first = (np.cumsum(n1) - n1)[r0]
    at = np.repeat(first - (np.cumsum(times) - times), times) + np.arange(times.sum())
    row, left, right = np.repeat(r0, times), np.repeat(c0, times), c1[at]
    slack = over[0][row, left].astype(np.int64) + over[1][row, right]
    near = slack <= radius
    row, pivot, slack = row[near], left[near] * m + right[near], slack[near]
    every = np.arange(len(fp))
    role = np.repeat(np.array([0, 1], np.int32), [len(fp), len(row)])
    return np.concatenate([every, row]), np.concatenate([home[0] * m + home[1], pivot]), role, np.concatenate([own, own[row] + slack]), np.concatenate([own, own[row]])


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Star edges with the same components as the edges u-v."""
    node, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    label = np.arange(len(node))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    far = label != np.arange(len(node))
    return node[far], node[label[far]]


def meet(role: np.ndarray, near: np.ndarray, own: np.ndarray, fp: np.ndarray, rows: np.ndarray, radius: int, at_once: int = 1 << 20) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links between one pivot's visitors and residents as a forest (u, v), and how many pairs each test left.

    near: distance to this pivot; own: distance to the own home; rows: distances to the
    discarding pivots, a byte each. Of a pair, the resident comes first by (own, fp).
    """
    home, visit = np.flatnonzero(role == 0), np.flatnonzero(role == 1)
    home = home[np.lexsort((fp[home], near[home]))]
    low, high = np.searchsorted(near[home], near[visit] - radius, "left"), np.searchsorted(near[home], near[visit] + radius, "right")
    # residents that are farther from home than the visitor come later in the order
    high = np.minimum(high, np.searchsorted(near[home], own[visit], "right"))
    count = np.maximum(high - low, 0)
    left = np.zeros(3, np.int64)
    us, vs, held, a = [fp[:0]], [fp[:0]], 0, 0
    table = rows.astype(np.int8)
    total = np.cumsum(count)
    while a < len(visit):
        b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + at_once, "right")))
        n = count[a:b]
        i = np.repeat(visit[a:b], n)
        j = home[np.repeat(low[a:b] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        a = b
        first = (own[j] < own[i]) | (fp[j] < fp[i])
        i, j = i[first], j[first]
        left[0] += len(i)
        for k in range(table.shape[1]):
            if not len(i):
                break
            close = np.abs(table[i, k] - table[j, k]) <= radius
            i, j = i[close], j[close]
        left[1] += len(i)
        close = np.bitwise_count(fp[i] ^ fp[j]) <= radius
        i, j = i[close], j[close]
        left[2] += len(i)
        us.append(fp[i])
        vs.append(fp[j])
        held += len(i)
        if held > at_once:
            u, v = forest(np.concatenate(us), np.concatenate(vs))
            us, vs, held = [u], [v], 0
    return *forest(np.concatenate(us), np.concatenate(vs)), left


ROWS = [f"d{k}" for k in range(N_PIVOTS // 8)]
SEAT = "pivot long, role int, near int, own int, fp long, " + ", ".join(f"{c} long" for c in ROWS)


def runs(batches: Iterator[pa.RecordBatch], key: list[str]) -> Iterator[pa.Table]:
    """The rows of each key of a sorted stream, which may go on from batch to batch."""
    held, at = [], None
    for b in batches:
        if not b.num_rows:
            continue
        keys = np.stack([b.column(c).to_numpy().astype(np.int64) for c in key], axis=1)
        edge = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
        for a, z in zip(edge[:-1], edge[1:], strict=True):
            if held and keys[a].tolist() != at:
                yield pa.Table.from_batches(held)
                held = []
            at = keys[a].tolist()
            held.append(b.slice(a, z - a))
    if held:
        yield pa.Table.from_batches(held)


def links(reps: DataFrame, scratch: Scratch, radius: int = RADIUS, *, per_pivot: int = PER_PIVOT, per_block: int = PER_BLOCK) -> DataFrame:
    """(u, v, met, left, linked): links between the distinct fingerprints of reps that span their components.

    Rows with a null u only count: pairs that met, that the pivots left, and that are linked.
    """
    m = max(1, math.ceil(math.sqrt(reps.count() / per_pivot)))

    def seat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces_of(batches, max(256, (1 << 22) // m)):
            fp = b.column("fp").to_numpy().view(np.uint64)
            at, pivot, role, near, own = seats_of(fp, m, radius)
            rows = distance_rows(fp)[at]
            cols = [pa.array(pivot.astype(np.int64)), pa.array(role), pa.array(near.astype(np.int32)), pa.array(own.astype(np.int32)), pa.array(fp[at].view(np.int64))]
            yield pa.RecordBatch.from_arrays([*cols, *(pa.array(c) for c in rows.T)], names=[x.split()[0] for x in SEAT.split(", ")])

    seats = scratch.keep(reps.select("fp").mapInArrow(seat, SEAT), "seats", rows=1 << 14)
    # a crowded pivot is split: residents by salt, visitors to every part
    crowd = seats.groupBy("pivot").agg(F.sum(1 - F.col("role")).alias("h"), F.sum("role").alias("g")).where("h > 0 and g > 1")
    crowd = scratch.keep(crowd.selectExpr("pivot", f"cast(ceil(h / {per_block}) as int) as hs", f"cast(ceil(g / {8 * per_block}) as int) as gs"), "crowd")
    salt = "case when role = 0 then transform(sequence(0, gs - 1), k -> named_struct('a', cast(pmod(xxhash64(fp), hs) as int), 'b', k)) else transform(sequence(0, hs - 1), k -> named_struct('a', k, 'b', cast(pmod(xxhash64(fp), gs) as int))) end"
    key = ["pivot", "a", "b"]
    dealt = seats.join(crowd, "pivot").withColumn("s", F.explode(F.expr(salt))).select("pivot", "s.a", "s.b", "role", "near", "own", "fp", *ROWS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left = np.zeros(3, np.int64)
        kind = pa.schema([(c, pa.int64()) for c in ("u", "v", "met", "left", "linked")])
        for t in runs(batches, key):
            fp = t.column("fp").to_numpy().view(np.uint64)
            rows = np.ascontiguousarray(np.stack([t.column(c).to_numpy() for c in ROWS], axis=1)).view(np.uint8)
            u, v, n = meet(t.column("role").to_numpy(), t.column("near").to_numpy(), t.column("own").to_numpy(), fp, rows, radius)
            left += n
            if len(u):
                yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64)), *[pa.nulls(len(u), pa.int64())] * 3], schema=kind)
        yield pa.RecordBatch.from_pylist([{"met": int(left[0]), "left": int(left[1]), "linked": int(left[2])}], schema=kind)

    parts = shards_for(seats.count(), 200_000)
    found = dealt.repartition(parts, *key).sortWithinPartitions(*key).mapInArrow(run, "u long, v long, met long, left long, linked long")
    found = scratch.keep(found, "edges", rows=1 << 16, mb=64)
    scratch.drop("seats", "crowd")
    return found


def near_duplicates(docs: DataFrame, *, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fp, component_id) for each row of docs.

    Null and empty texts have fingerprint 0 and are linked like any other. Nodes are
    fingerprints, so repeated rows and rows that share a doc_id are linked only as far as
    their texts are; component_id is the smallest doc_id that is not null (null if the
    component has none). No rows: none back. Columns other than doc_id and text are not read.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    fps = scratch.keep(fingerprints(docs), "fps")
    reps = scratch.keep(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "reps")
    edges = links(reps, scratch, radius).where("u is not null").select("u", "v")
    label = scratch.keep(components(edges, scratch), "labels")
    linked = reps.join(label, F.col("fp") == F.col("node")).select("fp", "label", "least")
    low = linked.groupBy("label").agg(F.min("least").alias("component_id"))
    small = scratch.keep(linked.join(low, "label").select("fp", "component_id"), "moved")
    ids = reps.join(small, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id"))
    return fps.join(ids, "fp").select("doc_id", "fp", "component_id")


def packed_rows(docs: DataFrame) -> DataFrame:
    """(row): each row as one struct, so that its columns' names are out of the way."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))


def keep_one(docs: DataFrame, *, radius: int = RADIUS) -> DataFrame:
    """Of each component the row with the smallest doc_id (null last, then text); all columns stay.

    Rows without a doc_id, or with the same one, are told apart by their texts; null and
    empty texts are copies of each other, and repeated rows leave one. No rows: none back.
    Names of other columns are free.
    """
    scratch = Scratch(docs.sparkSession, "keep")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t) for t in b.column("row").field("text").to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(fp)], names=["row", "node"])

    rows = packed_rows(docs)
    rows = scratch.keep(rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("node", T.LongType())])), "rows")
    reps = scratch.keep(rows.select(F.col("node").alias("fp")).distinct(), "reps")
    edges = links(reps, scratch, radius).where("u is not null").select("u", "v")
    return one_each(rows, scratch.keep(components(edges, scratch), "labels")).select("row.*")


def one_each(rows: DataFrame, label: DataFrame) -> DataFrame:
    """One of the rows (row, node) of each component: the smallest doc_id (null last), then text.

    Nodes without a label are alone.
    """
    root = F.coalesce("label", "node")
    best = Window.partitionBy(root).orderBy(F.col("row.doc_id").asc_nulls_last(), "row.text")
    to = label.select(F.col("node").alias("at"), "label")
    return rows.select("row", "node").join(to, F.col("node") == F.col("at"), "left").withColumn("n", F.row_number().over(best)).where("n = 1")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash components of all documents."""
    got = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return got.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES = {"op3_simhash": op3_simhash}
ORACLES: dict[str, str] = {}
