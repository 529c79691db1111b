"""Mixing sources to target weights by pivotal dependent rounding (DataFrame and SQL only).

Each source gets a target in words. A document's copy count has the expectation
target / source size; its whole part is certain, its fractional part a probability.
Pivotal rounding takes two documents with fractional parts and moves words from one to
the other, in a direction drawn so that no expectation changes, until one part is 0 or 1.
The words of the pair stay the same, so a source's total changes only where the last,
unpaired document is rounded.

The pairing is a reduction tree: documents are dealt by hash to blocks of about `block`
rows, each block is folded by one `aggregate` expression and leaves at most one
fractional document, and these are the rows of the next level. A hot source has more
blocks, never larger ones. Depth is log_block(documents of the largest source).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, Scratch

#: Fractions nearer to 0 or 1 than this count as whole.
EPS = 1e-9


def source_targets(sizes: DataFrame, source: str, weights: tuple, share: float, cap: float) -> DataFrame:
    """(source, source_size, source_rows, target): share * all words dealt by weight, capped.

    Weights repeat over the sources by code point, null last. Resharing the excess of
    capped sources by weight until none is above its cap has the closed form
    min(cap, level * weight); the level follows from prefix sums over the sources in
    order of cap / weight. One row per source enters these windows, not one per document.
    """
    src = sizes.groupBy(source).agg(F.sum("size").alias("source_size"), F.count("*").alias("source_rows"))
    table = F.array(*[F.lit(float(w)) for w in weights])
    rank = F.row_number().over(Window.orderBy(F.col(source).asc_nulls_last()))
    src = src.withColumn("w", F.element_at(table, (rank - 1) % len(weights) + 1))
    src = src.withColumn("most", F.col("source_size") * F.lit(float(cap))).withColumn("ratio", F.col("most") / F.col("w"))
    order = Window.orderBy(F.col("ratio"), F.col(source).asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    total = F.sum("source_size").over(every) * F.lit(float(share))
    left_words = total - F.coalesce(F.sum("most").over(before), F.lit(0.0))
    left_weight = F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0.0))
    src = src.withColumn("level", left_words / left_weight)
    src = src.withColumn("level", F.max(F.when(F.col("level") <= F.col("ratio"), F.col("level"))).over(every))
    target = F.least("most", F.coalesce(F.col("level") * F.col("w"), F.col("most")))
    return src.select(source, "source_size", "source_rows", target.alias("target"))


def _fold(seed: int, kind: str) -> str:
    """One block: pair the carried document with the next until all but one are whole; kind: type of an id."""
    item = f"struct<neg:bigint,h:bigint,id:{kind},size:bigint,f:double>"
    whole = f"struct<size:bigint,id:{kind},up:int>"
    room = "least(s.c.size * (1 - s.c.f), x.size * x.f)"
    back = "least(x.size * (1 - x.f), s.c.size * s.c.f)"
    draw = f"(pmod(xxhash64(s.c.h, x.h, {seed}), 1073741824) / 1073741824D)"
    # d: words that move to the carried document (negative: from it)
    moved = f"element_at(transform(array(named_struct('a', {room}, 'b', {back})), d -> if({draw} * (d.a + d.b) < d.b, d.a, -d.b)), 1)"
    snap = lambda e: f"if({e} < {EPS}, 0D, if({e} > 1 - {EPS}, 1D, {e}))"
    pair = f"element_at(transform(array({moved}), m -> named_struct('c', {snap('(s.c.f + m / s.c.size)')}, 'x', {snap('(x.f - m / x.size)')})), 1)"
    is_whole = lambda e: f"({e} = 0D or {e} = 1D)"
    with_f = lambda v, f: f"named_struct('neg', {v}.neg, 'h', {v}.h, 'id', {v}.id, 'size', {v}.size, 'f', {f})"
    step = f"""element_at(transform(array({pair}), p -> named_struct(
        'c', cast(if({is_whole('p.c')}, if({is_whole('p.x')}, null, {with_f('x', 'p.x')}), {with_f('s.c', 'p.c')}) as {item}),
        'o', concat(s.o, cast(filter(array(if({is_whole('p.c')}, named_struct('size', s.c.size, 'id', s.c.id, 'up', cast(p.c as int)), null),
                                           if({is_whole('p.x')}, named_struct('size', x.size, 'id', x.id, 'up', cast(p.x as int)), null)), w -> w is not null) as array<{whole}>)))), 1)"""
    start = f"named_struct('c', cast(null as {item}), 'o', cast(array() as array<{whole}>))"
    first = f"named_struct('c', cast({with_f('x', 'x.f')} as {item}), 'o', s.o)"
    return f"aggregate(items, {start}, (s, x) -> if(s.c is null, {first}, {step}))"


def _close(kind: str) -> str:
    """The root of a source's tree: its last fractional document goes to the nearer side.

    The words this adds or takes are made good, largest first, by documents of the root
    block that fit into them, so that the source ends near its target.
    """
    whole = f"struct<size:bigint,id:{kind},up:int>"
    last = "named_struct('size', c.size, 'id', c.id, 'up', cast(c.f >= 0.5 as int))"
    lack = "if(c is null, 0D, (c.f - cast(c.f >= 0.5 as int)) * c.size)"
    flip = "((x.up = 0 and x.size <= s.d) or (x.up = 1 and x.size <= -s.d))"
    put = f"named_struct('d', if({flip}, s.d + if(x.up = 0, -x.size, x.size), s.d), 'o', concat(s.o, array(cast(named_struct('size', x.size, 'id', x.id, 'up', if({flip}, 1 - x.up, x.up)) as {whole}))))"
    start = f"named_struct('d', cast({lack} as double), 'o', cast(if(c is null, array(), array({last})) as array<{whole}>))"
    return f"aggregate(sort_array(o, false), {start}, (s, x) -> {put}, s -> s.o)"


def copies(sizes: DataFrame, scratch: Scratch, *, source: str = "source", weights: tuple = (3, 1, 2), share: float = 1.5, cap: float = 2.0, block: int = 64, seed: int = 17) -> DataFrame:
    """(row_id, size, source, copies, source_size, target) for each row of sizes (row_id, source, size long).

    row_id, of any type that can be compared, must be unique among the rows of a source and
    size. Rows of size 0, and sources of size 0, get the whole part only.
    """
    kind = sizes.schema["row_id"].dataType.simpleString()
    src = scratch.keep(source_targets(sizes, source, weights, share, cap), "sources")
    p = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rows = sizes.withColumnRenamed(source, "_s").join(src, F.col("_s").eqNullSafe(F.col(source)), "left").withColumn("p", p)
    rows = rows.withColumn("base", F.floor(F.col("p") + EPS).cast("int")).withColumn("f", F.greatest(F.col("p") - F.col("base"), F.lit(0.0)))
    rows = scratch.keep(rows.select("row_id", "size", source, "source_rows", "source_size", "target", "base", "f"), "rows")
    live = rows.where((F.col("f") > EPS) & (F.col("size") > 0)).select(F.col("row_id").alias("id"), "size", "f", source, F.ceil(F.col("source_rows") / block).alias("blocks"))
    most = src.agg(F.max("source_rows")).first()[0] or 0
    ups: DataFrame | None = None
    level = 0
    while True:
        dealt = live.select(source, "blocks", F.pmod(F.xxhash64(F.lit(seed + level), "id", "size"), F.col("blocks")).alias("block"), F.struct((-F.col("size")).alias("neg"), F.xxhash64(F.lit(seed), "id", "size").alias("h"), "id", "size", "f").alias("item"))
        folded = dealt.groupBy(source, "blocks", "block").agg(F.sort_array(F.collect_list("item")).alias("items")).select(source, "blocks", F.expr(_fold(seed + level, kind)).alias("r"))
        folded = scratch.keep(folded.select(source, "blocks", "r.c", "r.o"), f"level{level}")
        done = folded.select(F.col(source).alias("_s"), F.explode(F.when(F.col("blocks") <= 1, F.expr(_close(kind))).otherwise(F.col("o"))).alias("w")).select("_s", "w.id", F.col("w.size").alias("_n"), "w.up")
        ups = done if ups is None else ups.union(done)
        most = math.ceil(most / block)
        if most <= 1:
            break
        live = folded.where((F.col("blocks") > 1) & F.col("c").isNotNull()).select("c.id", "c.size", "c.f", source, F.ceil(F.col("blocks") / block).alias("blocks"))
        level += 1
    same = (F.col("row_id") == F.col("id")) & (F.col("size") == F.col("_n")) & F.col(source).eqNullSafe(F.col("_s"))
    return rows.join(ups, same, "left").select("row_id", "size", source, (F.col("base") + F.coalesce("up", F.lit(0))).alias("copies"), "source_size", "target")


def words_of(text: Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def mix(docs: DataFrame, *, key: str = "doc_id", text: str = "text", source: str = "source", **params) -> DataFrame:
    """(key, source, size, rep, copies, source_size, target), one row per row of docs.

    rep numbers rows that agree in key, source and size: they are alike for the mix, so a
    run over other partitions gives the same rows. Nulls: a null text has size 0 and no
    copies beyond the whole part, as an empty one; a null source is a source of its own,
    last in order; a null key is a key like others. No rows: none back. Other columns are
    not read.
    """
    scratch = Scratch(docs.sparkSession, "mix")
    alike = docs.select(F.col(key).alias("key"), F.col(source).alias("source"), words_of(F.col(text)).alias("size")).groupBy("key", "source", "size").count()
    each = alike.select("key", "source", "size", F.explode(F.sequence(F.lit(1), F.col("count").cast("int"))).alias("rep"))
    sizes = scratch.keep(each.select(F.struct("key", "rep").alias("row_id"), "source", "size"), "sizes")
    got = copies(sizes, scratch, **params)
    return got.select(F.col("row_id.key").alias(key), "source", "size", F.col("row_id.rep").alias("rep"), "copies", "source_size", "target")


def repeat(docs: DataFrame, **params) -> DataFrame:
    """docs with every row given as often as the mix takes it; the columns stay, whatever their names.

    Rows that agree in doc_id, source and size take their numbers in order of text. Null and
    empty texts, null keys and sources are handled as by mix().
    """
    plan = mix(docs.select("doc_id", "text", "source"), **params).where("copies > 0").select(F.col("doc_id").alias("_d"), F.col("source").alias("_s"), F.col("size").alias("_n"), F.col("rep").alias("_r"), "copies")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").alias("d"), F.col("source").alias("s"), words_of(F.col("text")).alias("n"))
    rows = rows.withColumn("r", F.row_number().over(Window.partitionBy("d", "s", "n").orderBy("row.text")))
    on = F.col("d").eqNullSafe(F.col("_d")) & F.col("s").eqNullSafe(F.col("_s")) & (F.col("n") == F.col("_n")) & (F.col("r") == F.col("_r"))
    many = rows.join(plan, on).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return many.select("row.*")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to weights 3, 1, 2 repeating; words taken per document."""
    got = mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return got.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source", "copies")


QUERIES = {"op2_mixing": op2_mixing}
ORACLES: dict[str, str] = {}
