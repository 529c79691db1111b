"""Approximate nearest neighbours by multiprobe p-stable hashing.

A table hashes a vector to the cells of `k` Gaussian projections (2-stable, so distances
of projections follow Euclidean distance), each cut at a random offset into cells `width`
standard deviations wide; k follows the logarithm of the number of rows. Of each table a
query visits its own bucket and those reached by moving some projections to the next cell,
in order of estimated success: the borders are ranked by their distance from the query,
and the sets of ranks to cross come from one list, ordered by the expected sum of squares.

How many buckets a query visits is fitted: the true neighbours of a bounded sample of
queries (`trial`) are found in all rows, and the list is cut where it would have found
the share `recall` of them; if no list of `most` buckets does, k goes down by one.

Rows are sent to (table, coarse cell), the cell of the first few projections, and a query
once to each coarse cell it visits, with the buckets there. Tasks keep the best of each query
in what they see; the candidates of all tables are merged, with exact distances in double
precision. The projections' spread is fitted on a bounded sample (`sample`); every row is
indexed. Equal vectors are one class that keeps its `top` + 1 smallest distinct ids, so a
vector that is very common costs one row; crowded cells are split by a salt. A query
that its buckets give too few rows is answered from all rows instead, in blocks of queries.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .caps import CLEAN, FINITE, matrix
from .common import Scratch, shards_for
from .simhash import runs

TABLES, WIDTH = 3, 2.5
#: Projections of a coarse cell.
COARSE = 4
#: Share of the sample's neighbours to find, queries in it, and buckets a table at most.
RECALL, TRIAL, MOST = 0.96, 48, 16_000
PER_BLOCK = 4096


def classes(base: DataFrame, keep: int, scratch: Scratch) -> DataFrame:
    """(class_id, embedding, ids): distinct vectors with their `keep` smallest distinct ids.

    Each task first keeps that many of each vector it sees, so a group below has at most
    `keep` ids from each input partition.
    """

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, set[int]] = {}

        def out() -> pa.RecordBatch:
            vec = pa.array([np.frombuffer(k, np.float32) for k in held], pa.list_(pa.float32()))
            return pa.RecordBatch.from_arrays([vec, pa.array([list(ids) for ids in held.values()], pa.list_(pa.int64()))], names=["embedding", "ids"])

        for b in batches:
            for i, v in zip(b.column("vec_id").to_pylist(), b.column("embedding"), strict=True):
                key = v.values.to_numpy().tobytes()
                ids = held.setdefault(key, set())
                ids.add(i)
                if len(ids) > 4 * keep:
                    held[key] = set(sorted(ids)[:keep])
            if len(held) > 20_000:
                yield out()
                held = {}
        if held:
            yield out()

    part = base.select("vec_id", "embedding").mapInArrow(first, "embedding array<float>, ids array<long>")
    ids = F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.slice(F.array_sort(F.array_distinct("ids")), 1, keep))))), 1, keep)
    return scratch.keep(part.groupBy("embedding").agg(ids.alias("ids")).withColumn("class_id", F.col("ids")[0]).withColumn("dim", F.size("embedding")), "classes")


def projections(dim: int, table: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng([41, dim, table])
    return rng.standard_normal((dim, k)), rng.random(k)


class Cells:
    """The hash functions of one vector length, fitted on a sample of vectors of it."""

    def __init__(self, sample: np.ndarray, tables: int, k: int, width: float, probes: int = 1):
        dim = sample.shape[1]
        self.dim, self.k, self.probes, self.tables = dim, k, probes, []
        for t in range(tables):
            a, b = projections(dim, t, k)
            y = sample @ a
            spread = np.maximum(y.std(axis=0), 1e-12 + 1e-9 * np.abs(y).max(axis=0)) * width
            self.tables.append((a / spread, b - y.mean(axis=0) / spread))

    def at(self, x: np.ndarray, table: int) -> np.ndarray:
        a, b = self.tables[table]
        return np.clip(x @ a + b, -1e15, 1e15)


def success_order(k: int, most: int) -> np.ndarray:
    """(most, 2k) of 0 and 1: the ranks of borders to cross, by falling expected success.

    Of the 2k distances to borders, in units of a cell, the square of the j-th least has
    the expectation used here where queries lie evenly in their cells; ranks j and 2k - 1 - j
    are the two borders of one projection, of which only one can be crossed.
    """
    j = np.arange(1, 2 * k + 1)
    low = j * (j + 1) / (4 * (k + 1) * (k + 2))
    rest = 2 * k + 1 - j
    cost = np.where(j <= k, low, 1 - rest / (k + 1) + rest * (rest + 1) / (4 * (k + 1) * (k + 2)))
    found: list[tuple[int, ...]] = [()]
    heap = [(float(cost[0]), (0,))]
    while heap and len(found) < most:
        score, chosen = heapq.heappop(heap)
        if len({min(x, 2 * k - 1 - x) for x in chosen}) == len(chosen):
            found.append(chosen)
        last = chosen[-1]
        if last + 1 < 2 * k:
            heapq.heappush(heap, (score - cost[last] + cost[last + 1], (*chosen[:-1], last + 1)))
            heapq.heappush(heap, (score + cost[last + 1], (*chosen, last + 1)))
    out = np.zeros((len(found), 2 * k), np.float32)
    for row, chosen in zip(out, found, strict=True):
        row[list(chosen)] = 1
    return out


def moves(order: np.ndarray, inside: np.ndarray) -> np.ndarray:
    """(probes, k) of -1, 0, 1: the steps to the cells to visit; inside: place within the own cell."""
    k = len(inside)
    by = np.argsort(np.concatenate([inside, 1 - inside]), kind="stable")
    # the two distances of a projection add up to one, so ranks j and 2k - 1 - j belong together, ties aside
    by[k:] = (by[:k][::-1] + k) % (2 * k)
    step = np.zeros((2 * k, k), np.float32)
    step[np.arange(2 * k), by % k] = np.where(by < k, -1, 1)
    return (order @ step).astype(np.int64)


def bucket(cells: np.ndarray) -> np.ndarray:
    """A 63-bit number for each row of cell coordinates."""
    h = np.full(len(cells), 1469598103934665603, np.uint64)
    for c in np.asarray(cells, np.int64).T:
        h ^= c.astype(np.uint64)
        h *= np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(31)
    return (h >> np.uint64(1)).astype(np.int64)


SEAT = "table int, coarse long, bucket long, probes binary, class_id long, embedding array<float>"
_SCHEMA = pa.schema([("table", pa.int32()), ("coarse", pa.int64()), ("bucket", pa.int64()), ("probes", pa.binary()), ("class_id", pa.int64()), ("embedding", pa.list_(pa.float32()))])


def _hash(cells: dict[int, Cells], asking: bool):
    """Rows at their bucket of each table, or queries at each coarse cell with the buckets to visit there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        orders = {dim: success_order(c.k, c.probes) for dim, c in cells.items()} if asking else {}
        for b in batches:
            dims = b.column("dim").to_numpy()
            for dim in np.unique(dims).tolist():
                part = b.filter(pa.array(dims == dim))
                x = matrix(part.column("embedding"), dim)
                for t in range(len(cells[dim].tables)):
                    y = cells[dim].at(x, t)
                    own = np.floor(y)
                    if asking:
                        at, coarse, probes = [], [], []
                        for i, (p, c) in enumerate(zip(y - own, own, strict=True)):
                            where = c + moves(orders[dim], p)
                            places = np.stack([bucket(where[:, :COARSE]), bucket(where)], axis=1)
                            places = np.unique(places[np.lexsort(places.T[::-1])], axis=0)
                            cut = np.flatnonzero(np.diff(places[:, 0])) + 1
                            for group in np.split(places, cut):
                                at.append(i)
                                coarse.append(int(group[0, 0]))
                                probes.append(np.ascontiguousarray(group[:, 1]).tobytes())
                        buckets = [None] * len(at)
                    else:
                        at, coarse, buckets = np.arange(len(x)), bucket(own[:, :COARSE]), bucket(own)
                        probes = [None] * len(x)
                    out = part.take(pa.array(at, pa.int64()))
                    cols = [np.full(len(at), t * 65536 + dim % 65536, np.int32), coarse, buckets, probes]
                    yield pa.RecordBatch.from_arrays([*(pa.array(c, f.type) for c, f in zip(cols, _SCHEMA, strict=False)), out.column("class_id"), out.column("embedding").cast(_SCHEMA.field("embedding").type)], schema=_SCHEMA)

    return run


def nearest(q: np.ndarray, x: np.ndarray, keep: int, ids: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each query the places of its `keep` nearest rows, ties to smaller ids, with exact distances."""
    rough = (x * x).sum(axis=1)[None] - 2 * (q @ x.T)
    more = min(len(x), keep + 8)
    near = np.argpartition(rough, more - 1, axis=1)[:, :more] if more < len(x) else np.tile(np.arange(len(x)), (len(q), 1))
    for i, at in enumerate(near):
        if more < len(x):
            # all rows as near as the last within rounding: ties are settled exactly
            bar = rough[i, at].max()
            at = np.flatnonzero(rough[i] <= bar + 1e-9 * max(1.0, abs(bar)))
        d = np.sqrt(((x[at] - q[i]) ** 2).sum(axis=1))
        order = np.lexsort((ids[at], d))[:keep]
        yield at[order], d[order]


class Best:
    """The nearest classes of each query seen by one task so far."""

    def __init__(self, keep: int):
        self.keep, self.held = keep, {}

    def add(self, query: int, ids: np.ndarray, d: np.ndarray) -> None:
        old = self.held.get(query)
        if old is not None:
            ids, at = np.unique(np.concatenate([old[0], ids]), return_index=True)
            d = np.concatenate([old[1], d])[at]
            order = np.lexsort((ids, d))[: self.keep]
            ids, d = ids[order], d[order]
        self.held[query] = (ids, d)

    def batch(self) -> pa.RecordBatch:
        n = [len(v[0]) for v in self.held.values()]
        cat = lambda k, t: np.concatenate([v[k] for v in self.held.values()]) if n else np.zeros(0, t)
        out = pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(list(self.held), np.int64), n)), pa.array(cat(0, np.int64)), pa.array(cat(1, np.float64))], names=["query", "found", "score"])
        self.held = {}
        return out


FOUND = "query long, found long, score double"


def _compare(keep: int, key: list[str]):
    """A sorted run of coarse cells: each one's rows against its visitors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, compared = Best(keep), 0
        for table in runs(batches, key):
            probes, ids = table.column("probes").to_pylist(), table.column("class_id").to_numpy()
            asks = [i for i, p in enumerate(probes) if p is not None]
            rows = np.array([i for i, p in enumerate(probes) if p is None], np.int64)
            if not len(rows) or not asks:
                continue
            vectors = table.column("embedding").combine_chunks()
            x = matrix(vectors, len(vectors.flatten()) // len(ids))
            at = table.column("bucket").take(pa.array(rows)).to_numpy()
            order = np.argsort(at, kind="stable")
            rows, at = rows[order], at[order]
            for q in asks:
                visits = np.frombuffer(probes[q], np.int64)
                low, n = np.searchsorted(at, visits, "left"), np.searchsorted(at, visits, "right")
                n = n - low
                here = rows[np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())]
                compared += len(here)
                if len(here):
                    ((near, d),) = nearest(x[q : q + 1], x[here], keep, ids[here])
                    best.add(int(ids[q]), ids[here][near], d)
            if len(best.held) > 50_000:
                yield best.batch()
        yield best.batch()
        yield pa.RecordBatch.from_pydict({"query": [None], "found": [compared], "score": [None]}, schema=pa.schema([("query", pa.int64()), ("found", pa.int64()), ("score", pa.float64())]))

    return run


def fitted(sample: np.ndarray, n: int, queries: np.ndarray, near: list[np.ndarray], *, tables: int, width: float, recall: float, most: int) -> Cells:
    """Cells of one vector length: k from the number of rows, probes from the queries' true neighbours."""
    k = int(np.clip(round(math.log2(max(2, n))) - 2, 1, 40))
    while True:
        cells = Cells(sample, tables, k, width)
        order = success_order(k, most)
        rank = []
        for q, found in zip(queries, near, strict=True):
            first = np.full(len(found), len(order))
            for t in range(tables if len(found) else 0):
                y = cells.at(q[None], t)[0]
                visits = bucket(np.floor(y) + moves(order, y - np.floor(y)))
                by = np.argsort(visits, kind="stable")
                want = bucket(np.floor(cells.at(found, t)))
                at = by[np.minimum(np.searchsorted(visits[by], want, "left"), len(by) - 1)]
                first = np.where(visits[at] == want, np.minimum(first, at), first)
            rank.extend(first.tolist())
        rank = np.sort(np.array(rank, np.int64))
        need = int(rank[min(len(rank) - 1, math.ceil(recall * len(rank)))]) if len(rank) else 0
        if need < len(order) or k == 1:
            cells.probes = min(len(order), need + 1)
            return cells
        k -= 1


def search(vectors: DataFrame, *, every: int = 100, top: int = 10, tables: int = TABLES, width: float = WIDTH, recall: float = RECALL, trial: int = TRIAL, most: int = MOST, sample: int = 2000, per_block: int = PER_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the nearest rows found of each row whose vec_id is divisible by `every`.

    Rows whose vec_id or vector is null, or whose vector is zero or has null or
    non-finite components, take no part; only vectors of equal length are compared. Rows
    that share a query's vec_id are not its neighbours; repeated query rows ask once.
    Ties go to the smaller vec_id. A query with fewer than `top` others gets them all. No
    rows: none back. Other columns are not read.
    """
    return found_by(vectors, every, top, tables, width, recall, trial, most, sample, per_block)[0]


def found_by(vectors: DataFrame, every: int, top: int, tables: int, width: float, recall: float, trial: int, most: int, sample: int, per_block: int) -> tuple[DataFrame, DataFrame, dict[int, Cells]]:
    """search(), a table whose rows without a query hold the pairs compared, and the cells of each vector length."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "ann")
    keep = top + 1
    base = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<float>").alias("embedding"))
    base = base.where("vec_id is not null").where(FINITE).withColumn("embedding", F.expr(CLEAN))
    cls = classes(base, keep, scratch)
    asks = base.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), "embedding").distinct()
    asks = asks.join(cls.select("class_id", "dim", "embedding"), "embedding")
    asks = scratch.keep(asks.select("query_id", "class_id", "dim", "embedding"), "asks")
    asked = scratch.keep(asks.groupBy("class_id").agg(F.first("dim").alias("dim"), F.first("embedding").alias("embedding")), "asked")
    cells = _fit(cls, asked, keep, scratch, tables, width, recall, trial, most, sample)
    columns = ["class_id", "dim", "embedding"]
    rows = cls.select(columns).mapInArrow(_hash(cells, False), SEAT)
    # a query's list of probes is long to make: few to a task, and made once
    visits = asked.select(columns).repartition(shards_for(asked.count(), 64), "class_id").mapInArrow(_hash(cells, True), SEAT)
    visits = scratch.keep(visits, "visits", rows=64)
    cell = ["table", "coarse"]
    # rows are hashed twice, which is cheaper than to write them: each comes once a table, with its vector
    crowd = rows.groupBy(*cell).agg(F.count("*").alias("h")).join(visits.groupBy(*cell).agg(F.count("*").alias("g")), cell)
    crowd = scratch.keep(crowd.selectExpr(*cell, f"cast(ceil(h / {per_block}) as int) as hs", f"cast(ceil(g / {per_block}) as int) as gs"), "crowd", rows=2000)
    salt = "case when probes is null then transform(sequence(0, gs - 1), j -> named_struct('a', cast(pmod(xxhash64(class_id), hs) as int), 'b', j)) else transform(sequence(0, hs - 1), j -> named_struct('a', j, 'b', cast(pmod(xxhash64(class_id), gs) as int))) end"
    key = [*cell, "a", "b"]
    dealt = rows.union(visits).join(crowd, cell).withColumn("s", F.explode(F.expr(salt))).select(*cell, "s.a", "s.b", "bucket", "probes", "class_id", "embedding")
    parts = shards_for(tables * cls.count(), 30_000)
    met = scratch.keep(dealt.repartition(parts, *key).sortWithinPartitions(*key).mapInArrow(_compare(keep, key), FOUND), "met", rows=2000)
    near = met.where("query is not null").groupBy("query", "found").agg(F.min("score").alias("score"))
    few_found = near.groupBy("query").count().where(F.col("count") >= keep)
    lacking = scratch.keep(asked.join(few_found, F.col("class_id") == F.col("query"), "left_anti"), "lacking")
    near = near.unionByName(_all_rows(cls, lacking, keep, scratch)).distinct()
    order = Window.partitionBy("query").orderBy("score", "found")
    near = near.withColumn("r", F.row_number().over(order)).where(F.col("r") <= keep).drop("r")
    rows = near.join(cls.select(F.col("class_id").alias("found"), "ids"), "found").select("query", "score", F.explode("ids").alias("vec_id"))
    out = asks.select("query_id", F.col("class_id").alias("query")).join(rows, "query").where("query_id <> vec_id").dropDuplicates(["query_id", "vec_id"])
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    out = out.withColumn("rank", rank).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")
    return out, met.where("query is null"), cells


def _fit(cls: DataFrame, asked: DataFrame, keep: int, scratch: Scratch, tables: int, width: float, recall: float, trial: int, most: int, sample: int) -> dict[int, Cells]:
    """Cells of each vector length. What reaches the driver is bounded by sample and trial; lengths are few."""
    pick = Window.partitionBy("dim").orderBy("h", "class_id")
    some = lambda df, n: df.select("dim", "class_id", "embedding", F.xxhash64("class_id").alias("h")).withColumn("r", F.row_number().over(pick)).where(F.col("r") <= n)
    held: dict[int, list] = {}
    for r in some(cls, sample).select("dim", "embedding").collect():
        held.setdefault(r.dim, []).append(r.embedding)
    tried = scratch.keep(some(asked, trial).select("class_id", "dim", "embedding"), "tried")
    true = _all_rows(cls, tried, keep, scratch, tag="true").where("query <> found")
    best = Window.partitionBy("query").orderBy("score", "found")
    true = true.withColumn("r", F.row_number().over(best)).where(F.col("r") < keep).join(cls.select(F.col("class_id").alias("found"), "embedding"), "found")
    near: dict[int, list] = {}
    for r in true.select("query", "embedding").collect():
        near.setdefault(r["query"], []).append(r.embedding)
    asks: dict[int, list] = {}
    for r in tried.collect():
        asks.setdefault(r.dim, []).append((r.embedding, near.get(r.class_id, [])))
    count = {r.dim: r.n for r in cls.groupBy("dim").agg(F.count("*").alias("n")).collect()}
    shaped = lambda x, dim: np.array(x, np.float64).reshape(-1, dim)
    return {dim: fitted(shaped(x, dim), count[dim], shaped([q for q, _ in asks.get(dim, [])], dim), [shaped(f, dim) for _, f in asks.get(dim, [])], tables=tables, width=width, recall=recall, most=most) for dim, x in held.items()}


def _all_rows(cls: DataFrame, lacking: DataFrame, keep: int, scratch: Scratch, block: int = 1000, tag: str = "all") -> DataFrame:
    """The nearest of all rows for queries that their buckets gave too few, a block of queries at a time."""
    n = lacking.count()
    found = cls.sparkSession.createDataFrame([], FOUND)
    blocks = shards_for(n, block / 2) if n else 0
    for i in range(blocks):
        asks = lacking.where(F.pmod(F.xxhash64("class_id"), F.lit(blocks)) == i).select("class_id", "dim", "embedding").collect()

        def run(batches: Iterator[pa.RecordBatch], asks=asks) -> Iterator[pa.RecordBatch]:
            best = Best(keep)
            for b in batches:
                dims, ids = b.column("dim").to_numpy(), b.column("class_id").to_numpy()
                for dim in np.unique(dims).tolist():
                    part = [a for a in asks if a.dim == dim]
                    if part:
                        at = np.flatnonzero(dims == dim)
                        x = np.array(b.column("embedding").take(pa.array(at)).to_pylist(), np.float64)
                        for a, (near, d) in zip(part, nearest(np.array([a.embedding for a in part], np.float64), x, keep, ids[at]), strict=True):
                            best.add(a.class_id, ids[at][near], d)
            yield best.batch()

        found = found.union(scratch.keep(cls.select("class_id", "dim", "embedding").mapInArrow(run, FOUND), f"{tag}{i}"))
    return found


def op10_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest rows found of every hundredth embedding."""
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


QUERIES = {"op10_neighbours": op10_neighbours}
ORACLES: dict[str, str] = {}
