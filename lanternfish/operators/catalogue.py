"""Resolution of published titles to a catalogue: keys, exact rungs, tie-breaks, fuzzy residue."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lanternfish.functions import titles as T
from lanternfish.functions.similarity import token_sort_ratio

#: Strongest first; a rung is used only where none above it found anything.
RUNGS = ("name", "alternate_name", "spacing", "qualifier_dropped", "prefix")


def row_keys(rows: DataFrame) -> DataFrame:
    """Adds parsed p, key, year and the key set of each rung to rows (kind, title, release_date, ...)."""
    r = rows.withColumn("p", T.parse(F.col("title")))
    film = F.col("kind") == "film"
    key = F.when(film, T.normalise(T.without_year(F.col("p.primary")))).otherwise(T.normalise(F.col("p.base")))
    other = F.when(film, F.transform("p.alternates", lambda a: T.normalise(T.without_year(a)))).otherwise(F.array_except(T.alternate_keys(F.col("p")), F.array(key)))
    r = r.withColumn("key", key).withColumn("year", F.coalesce("p.year", F.year("release_date")))
    bare = F.when(F.col("p.qualifier").isNotNull(), T.normalise(T.without_qualifier(F.col("p.base"))))
    plain = bare.isNotNull() & (~film | F.col("year").isNotNull() | F.contains(bare, F.lit(" ")))
    arc = ~film & F.contains(F.col("p.base"), F.lit(": "))
    one = lambda cond, value: F.when(cond, F.array(value)).otherwise(F.array().cast("array<string>"))
    return r.select(
        *rows.columns, "p", "key", "year", F.array("key").alias("name"), F.filter(other, lambda k: (k != "") & (k != F.col("key"))).alias("alternate_name"),
        F.array(T.compact(F.col("key"))).alias("spacing"), one(plain, bare).alias("qualifier_dropped"),
        one(arc, T.normalise(F.regexp_extract("p.base", r"^(.*): ", 1))).alias("prefix"))


def entities(rows: DataFrame) -> DataFrame:
    """One row per (kind, key, year), rows pooled; rows need kind, title, release_date, period, hours, views, row_no.

    A key on a stronger rung is dropped from weaker ones, but spacing neither drops nor is
    dropped: it compares compacted keys, which is another comparison.
    """
    k = row_keys(rows)
    pool = lambda c: F.array_distinct(F.flatten(F.collect_set(c)))
    g = k.groupBy("kind", "key", "year").agg(
        F.min_by("title", "row_no").alias("example_title"), *[pool(r).alias(r) for r in RUNGS],
        F.array_sort(F.collect_set(F.when((F.col("kind") == "tv") & (F.col("p.season_number") > 0), F.col("p.season_number")))).alias("seasons"),
        F.array_sort(F.collect_set("period")).alias("periods"), F.sum("hours").alias("hours"), F.sum(F.coalesce("views", F.lit(0))).alias("views"))
    seen = None
    for rung in RUNGS:
        own = F.array_sort(F.filter(rung, lambda x: x != ""))
        g = g.withColumn(rung, own if rung == "spacing" or seen is None else F.array_except(own, seen))
        if rung != "spacing":
            seen = F.col(rung) if seen is None else F.array_union(seen, F.col(rung))
    return g.withColumn("title_id", T.title_id(F.col("kind"), F.col("key"), F.col("year")))


def name_index(basics: DataFrame, akas: DataFrame | None = None) -> DataFrame:
    """(tconst, type, start_year, is_series, key, source, compact_key): every distinct name of every title.

    source is the alphabetically first of aka, original, primary that gives the name.
    """
    base = ["tconst", "type", "start_year", "is_series"]
    named = basics.select(*base, T.normalise(F.col("primary_title"), False).alias("key"), F.lit("primary").alias("source"))
    named = named.unionByName(basics.select(*base, T.normalise(F.col("original_title"), False).alias("key"), F.lit("original").alias("source")))
    if akas is not None:
        named = named.unionByName(akas.join(basics.select(*base), "tconst").select(*base, T.normalise(F.col("title"), False).alias("key"), F.lit("aka").alias("source")))
    # compact_key is kept, so the spacing rung joins on equal keys too
    return named.where("key <> ''").groupBy(*base, "key").agg(F.min("source").alias("source")).withColumn("compact_key", T.compact(F.col("key")))


def token_index(names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(token, tconst, key, is_series) of tokens over one character, and (token, df)."""
    tokens = names.select(F.explode(F.array_distinct(F.split("key", " "))).alias("token"), "tconst", "key", "is_series").where(F.length("token") > 1)
    return tokens, token_df(tokens)


def token_df(tokens: DataFrame) -> DataFrame:
    """(token, df): how many titles have the token."""
    return tokens.groupBy("token").agg(F.count_distinct("tconst").alias("df"))


def exact_hits(ents: DataFrame, names: DataFrame, ratings: DataFrame) -> DataFrame:
    """Candidates of each entity's strongest rung that has any, one row a tconst."""
    rungs = F.array(*[F.struct(F.lit(i + 1).alias("tier"), F.lit(r).alias("rung"), F.col(r).alias("keys")) for i, r in enumerate(RUNGS)])
    keys = ents.select("title_id", "year", (F.col("kind") == "tv").alias("is_series"), F.explode(rungs).alias("t")).select("title_id", "year", "is_series", "t.tier", "t.rung", F.explode("t.keys").alias("key"))
    cat = names.select("tconst", "type", "start_year", "is_series", "key", "compact_key", "source")
    plain = keys.where("rung <> 'spacing'").join(cat.drop("compact_key"), ["key", "is_series"])
    spaced = keys.where("rung = 'spacing'").join(cat.drop("key").withColumnRenamed("compact_key", "key"), ["key", "is_series"])
    hits = plain.unionByName(spaced).withColumn("best", F.min("tier").over(Window.partitionBy("title_id"))).where("tier = best")
    one = hits.groupBy("title_id", "year", "tier", "rung", "tconst", "type", "start_year").agg(F.min("source").alias("key_source"))
    return one.join(ratings.select("tconst", "votes"), "tconst", "left").withColumn("votes", F.coalesce("votes", F.lit(0)))


def exact_stage(ents: DataFrame, names: DataFrame, ratings: DataFrame) -> DataFrame:
    """One tconst per entity: the only one in its year, in its year or one off, else the most votes."""
    h = exact_hits(ents, names, ratings)
    mine = Window.partitionBy("title_id")
    h = h.withColumn("same", F.coalesce(F.col("start_year") == F.col("year"), F.lit(False))).withColumn("near", F.coalesce(F.abs(F.col("start_year") - F.col("year")) <= 1, F.lit(False)))
    h = h.withColumn("n", F.count("*").over(mine)).withColumn("n_same", F.count_if("same").over(mine)).withColumn("n_near", F.count_if("near").over(mine))
    n, n_same, n_near = (F.col(c) for c in ("n", "n_same", "n_near"))
    tie = F.when(n == 1, F.lit("none")).when(n_same == 1, F.lit("year")).when(n_near == 1, F.lit("year_within_one")).otherwise(F.lit("votes"))
    # a single one in the same year, else a single one within a year; else votes decide among those of the nearest kind
    pool = F.when(n == 1, F.lit(True)).when(n_same == 1, F.col("same")).when(n_near == 1, F.col("near")).when(n_same > 1, F.col("same")).when(n_near > 1, F.col("near")).otherwise(F.lit(True))
    by_votes = mine.orderBy(F.desc("votes"), "tconst")
    h = h.withColumn("tie_break", tie).withColumn("runner_up_votes", F.nth_value("votes", 2).over(by_votes.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    h = h.withColumn("pool", pool).where("pool")
    h = h.withColumn("r", F.row_number().over(by_votes)).where("r = 1")
    return h.select("title_id", F.concat(F.lit("catalogue_"), "rung").alias("stage"), "rung", "tie_break", "tconst", "type", "start_year", "key_source", "votes", F.col("n").alias("tconst_candidates"), F.lit(100.0).alias("score"), "runner_up_votes")


def fuzzy_pool(residue: DataFrame, tokens: DataFrame, freq: DataFrame, max_df: int = 20_000, cap: int = 4000) -> DataFrame:
    """(title_id, ent_key, tconst, key): catalogue names that share one of an entity's two rarest tokens.

    Tokens of more than max_df titles give no pool, which bounds what one token brings;
    cap keeps the first names of a pool in order of (tconst, key).
    """
    want = residue.select("title_id", F.col("key").alias("ent_key"), (F.col("kind") == "tv").alias("is_series"), F.explode(F.array_distinct(F.split("key", " "))).alias("token")).where(F.length("token") > 1)
    rare = want.join(freq.where(F.col("df") <= max_df), "token")
    rare = rare.withColumn("r", F.row_number().over(Window.partitionBy("title_id").orderBy("df", "token"))).where("r <= 2")
    hits = rare.join(tokens, ["token", "is_series"]).select("title_id", "ent_key", "tconst", "key").distinct()
    return hits.withColumn("n", F.row_number().over(Window.partitionBy("title_id").orderBy("tconst", "key"))).where(F.col("n") <= cap).drop("n")


def fuzzy_stage(residue: DataFrame, tokens: DataFrame, freq: DataFrame, threshold: float = 87.0, max_df: int = 20_000, cap: int = 4000, top: int = 3, score=token_sort_ratio) -> DataFrame:
    """The `top` nearest names of each entity's pool, ranked; rank 1 is matched from threshold on."""
    pool = fuzzy_pool(residue, tokens, freq, max_df, cap).withColumn("score", score(F.col("ent_key"), F.col("key")))
    order = Window.partitionBy("title_id").orderBy(F.desc("score"), "tconst", "key")
    pool = pool.withColumn("rank", F.row_number().over(order)).withColumn("pool", F.count("*").over(Window.partitionBy("title_id"))).where(F.col("rank") <= top)
    return pool.withColumn("stage", F.when(F.col("score") >= threshold, F.lit("catalogue_fuzzy")).otherwise(F.lit("near_miss")))


def resolve(ents: DataFrame, names: DataFrame, ratings: DataFrame, threshold: float = 87.0) -> DataFrame:
    """Every entity with how it was matched, or why not; a near miss keeps its candidate apart."""
    return resolved(ents, exact_stage(ents, names, ratings), *token_index(names), threshold)


def resolved(ents: DataFrame, exact: DataFrame, tokens: DataFrame, freq: DataFrame, threshold: float = 87.0) -> DataFrame:
    """resolve() from the exact stage and the token index, which may have been kept."""
    residue = ents.join(exact.select("title_id"), "title_id", "left_anti")
    fuzzy = fuzzy_stage(residue, tokens, freq, threshold=threshold).where("rank = 1").select("title_id", "stage", "tconst", "score")
    stages = exact.unionByName(fuzzy, allowMissingColumns=True)
    out = ents.select("title_id", "kind", "key", "year", "seasons").join(stages, "title_id", "left").withColumn("stage", F.coalesce("stage", F.lit("unmatched")))
    matched = F.startswith(F.col("stage"), F.lit("catalogue_"))
    return out.withColumn("matched", matched).withColumn("rejected_candidate", F.when(~F.col("matched"), F.col("tconst"))).withColumn("tconst", F.when(F.col("matched"), F.col("tconst")))


def validate_seasons(matched: DataFrame, episodes: DataFrame) -> DataFrame:
    """seasons_present: the catalogue lists as many seasons as were reported; null where unknown."""
    most = episodes.groupBy(F.col("parent").alias("tconst")).agg(F.max("season").alias("max_season"))
    out = matched.join(most, "tconst", "left")
    known = (F.col("kind") == "tv") & (F.size("seasons") > 0) & F.col("max_season").isNotNull()
    return out.withColumn("seasons_present", F.when(known, F.array_max("seasons") <= F.col("max_season")))
