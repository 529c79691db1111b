"""Embedding near-duplicates by spherical-cap filters.

Filters are unit vectors in a product code: the space is turned by a random rotation and
cut into two halves, each with a small random code of unit vectors, and a filter is a
pair of codewords. Its value at a vector is the sum of two inner products, so all filters
over a threshold are list-decoded from two short lists.

A vector lives at its home, the filter with the largest value, at an angle a. It visits
every filter within the angle a + r, where r is the angle of the similarity asked for. Of
two linked vectors, the one with the larger angle visits the other's home: the home lies
at no more than a' + r <= a + r from it. So no link is lost, and each is met once: in the
join on filters a visitor is compared only with residents before it in the order of
(angle, id). What meets at a filter is compared in blocks, and only counts and a
spanning forest of the links leave.

The number of filters follows the rows of the largest label, so that a filter keeps about
`per_filter` residents and the share of pairs that is compared falls as rows grow. A vector
is sent once to each first codeword that it has filters under, with the list of its second
codewords, not once to each filter. Vectors that are equal, with equal labels, are one class
with a count; crowded groups are split by a salt.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, components, shards_for
from .simhash import forest, runs

#: Residents that a filter should have, and that one task compares at once.
PER_FILTER, PER_BLOCK = 12, 4096
#: Second codewords for each first one.
SLANT = 8


def codes(dim: int, sizes: tuple[int, int], seed: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A random rotation and a code of unit vectors for each half."""
    rng = np.random.default_rng([seed, dim, *sizes])
    turn = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
    half = dim // 2
    unit = lambda n, k: (lambda m: m / np.linalg.norm(m, axis=1, keepdims=True))(rng.standard_normal((n, k)))
    return turn, unit(sizes[0], max(half, 1)), unit(sizes[1], dim - half)


def values(x: np.ndarray, dim: int, sizes: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Inner products of unit vectors with both codes; a filter's value is a sum of two."""
    turn, a, b = codes(dim, sizes)
    y = x @ turn
    half = dim // 2
    if half == 0:
        return np.zeros((len(x), sizes[0])), y @ b.T / math.sqrt(2)
    return y[:, :half] @ a.T / math.sqrt(2), y[:, half:] @ b.T / math.sqrt(2)


def matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    """A column of vectors of one length, none of them null, in double precision."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


#: Which vectors can be compared, and those with -0 as 0, so that equal ones group.
FINITE = "embedding is not null and size(embedding) > 0 and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('Infinity')) and exists(embedding, x -> x <> 0)"
CLEAN = "transform(embedding, x -> x + cast(0 as float))"


def classes(vectors: DataFrame, scratch: Scratch) -> DataFrame:
    """(class_id, label, dim, embedding, n) for usable vectors with a label; class_id: smallest vec_id."""
    live = vectors.where(f"label is not null and {FINITE}").withColumn("embedding", F.expr(CLEAN))
    return scratch.keep(live.groupBy("label", "embedding").agg(F.min("vec_id").alias("class_id"), F.count("*").alias("n")).withColumn("dim", F.size("embedding")), "classes")


SEAT = "label long, dim int, first int, home int, visits binary, class_id long, n long, angle double, embedding array<float>"
_SCHEMA = pa.schema([("label", pa.int64()), ("dim", pa.int32()), ("first", pa.int32()), ("home", pa.int32()), ("visits", pa.binary()), ("class_id", pa.int64()), ("n", pa.int64()), ("angle", pa.float64()), ("embedding", pa.list_(pa.float32()))])


def _assign(sizes: tuple[int, int], cos: float):
    """Each class once under every first codeword that it has filters of.

    home: second codeword of the home, if it is here (else -1); visits: second codewords of the filters visited.
    """
    reach = math.acos(cos)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims = b.column("dim").to_numpy()
            for dim in np.unique(dims).tolist():
                part = b.filter(pa.array(dims == dim))
                x = matrix(part.column("embedding"), dim)
                u, v = values(x / np.linalg.norm(x, axis=1, keepdims=True), dim, sizes)
                iu, iv = u.argmax(1), v.argmax(1)
                angle = np.arccos(np.clip(u.max(1) + v.max(1), -1, 1))
                bar = np.cos(np.minimum(angle + reach, np.pi)) - 1e-9
                # list decoding: the first codewords whose value, with the best of the other half, is enough
                row, first = np.nonzero(u + v.max(1)[:, None] >= bar[:, None])
                visits = [np.flatnonzero(v[i] >= bar[i] - u[i, k]).astype("<u4").tobytes() for i, k in zip(row.tolist(), first.tolist(), strict=True)]
                home = np.where(first == iu[row], iv[row], -1)
                out = part.take(pa.array(row))
                cols = [out.column("label"), out.column("dim"), pa.array(first), pa.array(home), pa.array(visits, pa.binary()), out.column("class_id"), out.column("n"), pa.array(angle[row]), out.column("embedding")]
                yield pa.RecordBatch.from_arrays([c.cast(t) for c, t in zip(cols, _SCHEMA.types, strict=True)], schema=_SCHEMA)

    return run


def meet(table: pa.Table, cos: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """Links under one first codeword: (ids, their new links; u, v of a forest; pairs compared)."""
    ids, n, angle, home, dim = (table.column(c).to_numpy() for c in ("class_id", "n", "angle", "home", "dim"))
    role = table.column("role").to_numpy()
    x = matrix(table.column("embedding"), int(dim[0]))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    lists = [np.frombuffer(b, "<u4") for b in table.column("visits").to_pylist()]
    who = np.flatnonzero(role != 0)
    visitor = np.repeat(who, [len(lists[i]) for i in who.tolist()])
    second = np.concatenate([np.zeros(0, "<u4"), *(lists[i] for i in who.tolist())]).astype(np.int64)
    order = np.argsort(second, kind="stable")
    visitor, second = visitor[order], second[order]
    resident = np.flatnonzero(role != 1)
    resident = resident[np.argsort(home[resident], kind="stable")]
    at = home[resident]
    gained = np.zeros(len(ids), np.int64)
    us, vs, held, compared = [ids[:0]], [ids[:0]], 0, 0
    for f in np.unique(at).tolist():
        here = resident[np.searchsorted(at, f, "left") : np.searchsorted(at, f, "right")]
        asks = visitor[np.searchsorted(second, f, "left") : np.searchsorted(second, f, "right")]
        step = max(1, (1 << 22) // len(here))
        for k in range(0, len(asks), step):
            w = asks[k : k + step]
            compared += len(w) * len(here)
            i, j = np.nonzero(x[w] @ x[here].T >= cos)
            i, j = w[i], here[j]
            # one class has the same angle at home and on a visit, so ids order ties alike
            before = (angle[j] < angle[i]) | ((angle[j] == angle[i]) & (ids[j] < ids[i]))
            i, j = i[before], j[before]
            np.add.at(gained, i, n[j])
            np.add.at(gained, j, n[i])
            us.append(ids[i])
            vs.append(ids[j])
            held += len(i)
            if held > 1 << 20:
                u, v = forest(np.concatenate(us), np.concatenate(vs))
                us, vs, held = [u], [v], 0
    u, v = forest(np.concatenate(us), np.concatenate(vs))
    some = gained > 0
    return ids[some], gained[some], u, v, compared


def links(cls: DataFrame, scratch: Scratch, cos: float, per_filter: int, per_block: int) -> DataFrame:
    """(u, v, gained): a forest of the classes' links where gained is null; links that class u has gained where v is.

    A row without u has the number of pairs compared.
    """
    most = cls.groupBy("label", "dim").count().agg(F.max("count")).first()[0] or 0
    first = max(1, math.ceil(math.sqrt(most / per_filter / SLANT)))
    sizes = (first, max(2, SLANT * first))
    seats = scratch.keep(cls.repartition("class_id").mapInArrow(_assign(sizes, cos), SEAT), "seats", rows=2000)
    key = ["label", "dim", "first"]
    # a crowded group is split: residents by salt, visitors to every part; a row that is both goes where it is needed
    crowd = seats.groupBy(*key).agg(F.count_if(F.col("home") >= 0).alias("h"), F.count("*").alias("g")).where("h > 0 and g > 1")
    crowd = scratch.keep(crowd.selectExpr(*key, f"cast(ceil(h / {per_block}) as int) as hs", f"cast(ceil(g / {4 * per_block}) as int) as gs"), "crowd")
    mine = "named_struct('a', cast(pmod(xxhash64(class_id), hs) as int), 'b', cast(pmod(xxhash64(class_id), gs) as int))"
    lives = "transform(sequence(0, gs - 1), k -> named_struct('a', {m}.a, 'b', k, 'role', if(k = {m}.b, 2, 0)))".replace("{m}", mine)
    calls = "transform(sequence(0, hs - 1), k -> named_struct('a', k, 'b', {m}.b, 'role', 1))".replace("{m}", mine)
    # role 0: resident, 1: visitor, 2: both
    places = f"if(home >= 0, concat({lives}, filter({calls}, p -> p.a <> {mine}.a)), {calls})"
    dealt = seats.join(crowd, key).withColumn("s", F.explode(F.expr(places))).select(*key, "s.a", "s.b", "s.role", "home", "visits", "class_id", "n", "angle", "embedding")
    key = [*key, "a", "b"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, total = pa.schema([(c, pa.int64()) for c in ("u", "v", "gained")]), 0
        for table in runs(batches, key):
            ids, gained, u, v, compared = meet(table, cos)
            total += compared
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([ids, u])), pa.array([*[None] * len(ids), *v.tolist()], pa.int64()), pa.array([*gained.tolist(), *[None] * len(u)], pa.int64())], schema=kind)
        yield pa.RecordBatch.from_pylist([{"gained": total}], schema=kind)

    parts = shards_for(seats.count(), 20_000)
    return dealt.repartition(parts, *key).sortWithinPartitions(*key).mapInArrow(run, "u long, v long, gained long")


def near_vectors(vectors: DataFrame, *, cos: float = 0.98, per_filter: int = PER_FILTER, per_block: int = PER_BLOCK) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of vectors (vec_id, embedding, label).

    Rows whose vector is null, zero, or has null or non-finite components, or whose label
    is null, link with nothing: 0 links, their own component, kept. Vectors of different
    lengths are not compared. Equal rows link with each other like any two; rows that share
    a vec_id are one node of the components. A row with a null vec_id takes no part: no
    links, a null component, kept. No rows: none back. Other columns are not read.
    """
    scratch = Scratch(vectors.sparkSession, "caps")
    base = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<float>").alias("embedding"), F.col("label").cast("long").alias("label"))
    cls = classes(base.where("vec_id is not null"), scratch)
    met = scratch.keep(links(cls, scratch, cos, per_filter, per_block), "met")
    root = components(met.where("gained is null").select("u", "v"), scratch).withColumnRenamed("label", "root")
    gained = met.where("u is not null and v is null").groupBy("u").agg(F.sum("gained").alias("gained"))
    per = cls.join(gained, F.col("class_id") == F.col("u"), "left").join(root, F.col("class_id") == F.col("node"), "left")
    per = per.select(F.col("label").alias("_l"), F.col("embedding").alias("_e"), (F.coalesce("gained", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("root", "class_id").alias("component_id"))
    per = scratch.keep(per, "per_class")
    out = base.withColumn("_k", F.expr(CLEAN)).join(per, (F.col("label") == F.col("_l")) & (F.col("_k") == F.col("_e")) & F.col("vec_id").isNotNull(), "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


def op8_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate vectors of all embeddings with equal labels."""
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


QUERIES = {"op8_caps": op8_caps}
ORACLES: dict[str, str] = {}
