"""Entity-resolution queries: the catalogue side is made from the same parts, named otherwise."""

from __future__ import annotations

from pyspark.sql import functions as F

from lanternfish.operators import catalogue as C
from lanternfish.operators import ladder as L

from . import analogue as A
from .analogue import SQL
from .registry import query
from .store import kept


def basics(spark, d):
    """Catalogue titles: one a part, some names hyphenated, some original names run together."""
    t = A.titles(spark, d)
    name = F.col("p_name")
    return t.select(
        F.concat(F.lit("tt"), F.lpad(F.col("part").cast("string"), 7, "0")).alias("tconst"), "part",
        F.when(F.col("kind") == "film", F.lit("movie")).otherwise(F.lit("tvSeries")).alias("type"), (1990 + F.col("part") % 20).cast("int").alias("start_year"), (F.col("kind") == "tv").alias("is_series"),
        F.when(F.col("part") % 5 == 0, F.replace(name, F.lit(" "), F.lit("-"))).otherwise(name).alias("primary_title"),
        F.when(F.col("part") % 7 == 0, F.replace(name, F.lit(" "), F.lit(""))).otherwise(name).alias("original_title"), "p_name")


def names(spark, d):
    """The name index, kept: every query that resolves reads it."""
    b = basics(spark, d)
    w = F.split("p_name", " ")
    akas = b.select("tconst", F.concat(w[1], F.lit(" "), w[0]).alias("title"))
    return kept(spark, d, "names", lambda: C.name_index(b, akas))


def tokens(spark, d):
    """The token index and document frequencies, kept beside the name index."""
    index = kept(spark, d, "tokens", lambda: C.token_index(names(spark, d))[0])
    return index, kept(spark, d, "token_df", lambda: C.token_df(index))


def ratings(spark, d):
    return basics(spark, d).select("tconst", F.when(F.col("part") % 6 != 0, F.col("part") * 37 % 500).alias("votes"))


def ents(spark, d):
    t = A.titles(spark, d).select("kind", "title", "release_date", F.concat(F.lit("199"), (F.col("part") % 5 + 5).cast("string"), F.lit("H1")).alias("period"), F.col("p_size").cast("long").alias("hours"), F.lit(1).cast("long").alias("views"), F.col("part").alias("row_no"))
    return kept(spark, d, "entities", lambda: C.entities(t.repartition(spark.sparkContext.defaultParallelism)))


CATALOGUE = (
    SQL
    + r""",
basics AS (
  SELECT part, 'tt' || lpad(CAST(part AS VARCHAR), 7, '0') AS tconst, CASE WHEN kind = 'film' THEN 'movie' ELSE 'tvSeries' END AS type, CAST(1990 + part % 20 AS INTEGER) AS start_year, kind = 'tv' AS is_series,
    CASE WHEN part % 5 = 0 THEN replace(p_name, ' ', '-') ELSE p_name END AS primary_title, CASE WHEN part % 7 = 0 THEN replace(p_name, ' ', '') ELSE p_name END AS original_title, p_name
  FROM titles),
named2 AS (
  SELECT tconst, type, start_year, is_series, primary_title AS name, 'primary' AS source FROM basics
  UNION ALL SELECT tconst, type, start_year, is_series, original_title, 'original' FROM basics
  UNION ALL SELECT tconst, type, start_year, is_series, split_part(p_name, ' ', 2) || ' ' || split_part(p_name, ' ', 1), 'aka' FROM basics),
names AS (SELECT tconst, type, start_year, is_series, trim(regexp_replace(lower(name), '[^a-z0-9]+', ' ', 'g')) AS key, min(source) AS source FROM named2 GROUP BY ALL),
ents AS (SELECT title_id, kind, name_key AS key, year FROM keyed_titles GROUP BY ALL),
keys AS (
  SELECT title_id, kind = 'tv' AS is_series, year, 1 AS tier, 'name' AS rung, key FROM ents
  UNION ALL SELECT DISTINCT title_id, kind = 'tv', year, 2, 'alternate_name', lower(split_part(title, ' // ', 2)) FROM keyed_titles WHERE part % 8 = 6 AND lower(split_part(title, ' // ', 2)) <> name_key
  UNION ALL SELECT title_id, kind = 'tv', year, 3, 'spacing', replace(key, ' ', '') FROM ents),
hits AS (
  SELECT k.*, n.tconst, n.type, n.start_year, n.source FROM keys k JOIN names n ON n.is_series = k.is_series AND n.key = k.key AND k.rung <> 'spacing'
  UNION ALL SELECT k.*, n.tconst, n.type, n.start_year, n.source FROM keys k JOIN names n ON n.is_series = k.is_series AND replace(n.key, ' ', '') = k.key AND k.rung = 'spacing'),
strongest AS (
  SELECT h.title_id, h.year, h.rung, h.tconst, h.type, h.start_year, min(h.source) AS key_source, coalesce(max(CASE WHEN b.part % 6 <> 0 THEN b.part * 37 % 500 END), 0) AS votes
  FROM hits h JOIN (SELECT title_id, min(tier) AS tier FROM hits GROUP BY 1) m USING (title_id, tier) JOIN basics b USING (tconst) GROUP BY ALL),
judged AS (
  SELECT *, count(*) OVER e AS n, coalesce(start_year = year, false) AS same, coalesce(abs(start_year - year) <= 1, false) AS near,
    count(*) FILTER (WHERE start_year = year) OVER e AS n_same, count(*) FILTER (WHERE abs(start_year - year) <= 1) OVER e AS n_near,
    nth_value(votes, 2) OVER (PARTITION BY title_id ORDER BY votes DESC, tconst ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS runner_up_votes
  FROM strongest WINDOW e AS (PARTITION BY title_id)),
exact AS (
  SELECT title_id, 'catalogue_' || rung AS stage, rung, CASE WHEN n = 1 THEN 'none' WHEN n_same = 1 THEN 'year' WHEN n_near = 1 THEN 'year_within_one' ELSE 'votes' END AS tie_break,
    tconst, type, start_year, key_source, votes, n AS tconst_candidates, runner_up_votes
  FROM judged
  WHERE n = 1 OR (n_same = 1 AND same) OR (n_same <> 1 AND n_near = 1 AND near) OR (n_same <> 1 AND n_near <> 1 AND CASE WHEN n_same > 1 THEN same WHEN n_near > 1 THEN near ELSE true END)
  QUALIFY row_number() OVER (PARTITION BY title_id ORDER BY votes DESC, tconst) = 1),
tokens AS (SELECT DISTINCT unnest(string_split(key, ' ')) AS token, tconst, key, is_series FROM names),
freq AS (SELECT token, count(DISTINCT tconst) AS df FROM tokens WHERE length(token) > 1 GROUP BY 1),
residue AS (SELECT * FROM ents WHERE title_id NOT IN (SELECT title_id FROM exact)),
want AS (SELECT DISTINCT title_id, key AS ent_key, kind = 'tv' AS is_series, unnest(string_split(key, ' ')) AS token FROM residue),
rare AS (SELECT w.*, row_number() OVER (PARTITION BY title_id ORDER BY df, token) AS r FROM want w JOIN freq USING (token) WHERE length(token) > 1),
pooled AS (SELECT *, row_number() OVER (PARTITION BY title_id ORDER BY tconst, key) AS n FROM (SELECT DISTINCT r.title_id, r.ent_key, t.tconst, t.key FROM rare r JOIN tokens t ON t.token = r.token AND t.is_series = r.is_series WHERE r.r <= 2)),
pairs AS (SELECT DISTINCT array_to_string(list_sort(string_split(ent_key, ' ')), ' ') AS a, array_to_string(list_sort(string_split(key, ' ')), ' ') AS b, ent_key, key FROM pooled WHERE n <= 4000),
lcs AS (SELECT ent_key, key, length(a) + length(b) AS total, list_reduce(list_transform(string_split(a, ''), lambda ch: [ascii(ch)]), lambda above, ch: list_reduce(list_transform(range(1, CAST(length(b) + 1 AS BIGINT)), lambda j: [CAST(j AS INTEGER)]), lambda acc, j: list_append(acc, CASE WHEN ascii(b[j[1]]) = ch[1] THEN above[j[1]] + 1 ELSE greatest(above[j[1] + 1], acc[j[1]]) END), [0]), list_transform(range(0, CAST(length(b) + 1 AS BIGINT)), lambda j: 0))[-1] AS common FROM pairs),
scored AS (
  SELECT p.title_id, p.ent_key, p.tconst, p.key, round(200.0 * l.common / l.total, 6) AS score, row_number() OVER (PARTITION BY title_id ORDER BY 200.0 * l.common / l.total DESC, tconst, key) AS rank, count(*) OVER (PARTITION BY title_id) AS pool
  FROM pooled p JOIN lcs l USING (ent_key, key) WHERE p.n <= 4000)
"""
)


@query("name_index", CATALOGUE + "SELECT tconst, type, start_year, is_series, key, source, replace(key, ' ', '') AS compact_key FROM names")
def name_index(spark, d):
    return names(spark, d).select("tconst", "type", "start_year", "is_series", "key", "source", "compact_key")


@query("token_df", CATALOGUE + "SELECT token, df FROM freq")
def token_df(spark, d):
    return tokens(spark, d)[1]


@query("entity_pool", CATALOGUE + """SELECT e.title_id, e.kind, e.key, e.year, arg_min(k.title, k.part) AS example_title, CAST(to_json(list(DISTINCT CAST(CASE WHEN k.kind = 'tv' THEN k.season_number END AS INTEGER) ORDER BY CAST(CASE WHEN k.kind = 'tv' THEN k.season_number END AS INTEGER)) FILTER (WHERE k.kind = 'tv' AND k.season_number IS NOT NULL)) AS VARCHAR) AS seasons, count(DISTINCT k.part % 5) AS n_periods, CAST(sum(k.p_size) AS BIGINT) AS hours FROM ents e JOIN keyed_titles k USING (title_id) GROUP BY ALL""")
def entity_pool(spark, d):
    e = ents(spark, d)
    return e.select("title_id", "kind", "key", "year", "example_title", F.when(F.size("seasons") > 0, F.to_json("seasons")).alias("seasons"), F.size("periods").cast("long").alias("n_periods"), "hours")


def exact(spark, d):
    return kept(spark, d, "exact", lambda: C.exact_stage(ents(spark, d), names(spark, d), ratings(spark, d)))


@query("exact_ladder", CATALOGUE + "SELECT * FROM exact")
def exact_ladder(spark, d):
    return exact(spark, d).drop("score")


@query("rung_rates", CATALOGUE + "SELECT coalesce(rung, 'none') AS rung, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 9) AS share FROM ents LEFT JOIN exact USING (title_id) GROUP BY 1")
def rung_rates(spark, d):
    j = ents(spark, d).select("title_id").join(exact(spark, d), "title_id", "left")
    return L.rate(j.select(F.coalesce("rung", F.lit("none")).alias("stage"))).select(F.col("stage").alias("rung"), "n", F.round("share", 9).alias("share"))


@query("tie_break_crosstab", CATALOGUE + "SELECT rung, count(*) FILTER (WHERE tie_break = 'none') AS none, count(*) FILTER (WHERE tie_break = 'year') AS year, count(*) FILTER (WHERE tie_break = 'year_within_one') AS year_within_one, count(*) FILTER (WHERE tie_break = 'votes') AS votes FROM exact GROUP BY 1")
def tie_break_crosstab(spark, d):
    ties = ["none", "year", "year_within_one", "votes"]
    p = exact(spark, d).groupBy("rung").pivot("tie_break", ties).count()
    return p.select("rung", *[F.coalesce(t, F.lit(0)).alias(t) for t in ties])


@query("close_contests", CATALOGUE + "SELECT title_id, tconst, votes, runner_up_votes FROM exact WHERE tie_break = 'votes' AND runner_up_votes >= 100 AND runner_up_votes > 0.1 * votes")
def close_contests(spark, d):
    return exact(spark, d).where("tie_break = 'votes' and runner_up_votes >= 100 and runner_up_votes > 0.1 * votes").select("title_id", "tconst", "votes", "runner_up_votes")


def fuzzy(spark, d):
    residue = ents(spark, d).join(exact(spark, d).select("title_id"), "title_id", "left_anti")
    return C.fuzzy_stage(residue, *tokens(spark, d))


@query("fuzzy_topk", CATALOGUE + "SELECT title_id, ent_key, tconst, key, score, CAST(rank AS INTEGER) AS rank, pool, CASE WHEN score >= 87 THEN 'catalogue_fuzzy' ELSE 'near_miss' END AS stage FROM scored WHERE rank <= 3")
def fuzzy_topk(spark, d):
    return fuzzy(spark, d).withColumn("score", F.round("score", 6)).select("title_id", "ent_key", "tconst", "key", "score", "rank", "pool", "stage")


@query("score_bands", CATALOGUE + "SELECT CAST(floor(score / 5) * 5 AS BIGINT) AS band, count(*) AS n FROM scored WHERE rank = 1 GROUP BY 1")
def score_bands(spark, d):
    band = (F.floor(F.round("score", 6) / 5) * 5).cast("long")
    return fuzzy(spark, d).where("rank = 1").groupBy(band.alias("band")).agg(F.count("*").alias("n"))


@query("threshold_sweep", CATALOGUE + "SELECT CAST(t AS BIGINT) AS threshold, count(*) FILTER (WHERE score >= t) AS accepted, count(*) FILTER (WHERE (left(key, 1) = left(ent_key, 1)) <> (score >= t)) AS disagreements FROM scored, range(70, 101) r(t) WHERE rank = 1 GROUP BY 1")
def threshold_sweep(spark, d):
    """Label stand-in: same first letter. Thresholds are 31 rows, so they are broadcast."""
    f = fuzzy(spark, d).where("rank = 1").withColumn("score", F.round("score", 6))
    t = spark.range(70, 101).withColumnRenamed("id", "threshold")
    same = F.left("key", F.lit(1)) == F.left("ent_key", F.lit(1))
    over = F.col("score") >= F.col("threshold")
    return f.crossJoin(F.broadcast(t)).groupBy("threshold").agg(F.count_if(over).alias("accepted"), F.count_if(same != over).alias("disagreements"))


@query("season_validation", CATALOGUE + """,
episodes AS (SELECT 'tt' || lpad(CAST(l_partkey AS VARCHAR), 7, '0') AS parent, l_linenumber AS season FROM lineitem),
most AS (SELECT parent AS tconst, max(season) AS max_season FROM episodes GROUP BY 1),
reported AS (SELECT title_id, max(season_number) AS top FROM keyed_titles WHERE kind = 'tv' AND season_number IS NOT NULL GROUP BY 1)
SELECT e.title_id, x.tconst, m.max_season, CASE WHEN r.top IS NOT NULL AND m.max_season IS NOT NULL THEN r.top <= m.max_season END AS seasons_present
FROM ents e JOIN exact x USING (title_id) LEFT JOIN most m USING (tconst) LEFT JOIN reported r USING (title_id)""")
def season_validation(spark, d):
    """Line items are summed by part before a part becomes a catalogue id."""
    li = A.table(spark, d, "lineitem").groupBy("l_partkey").agg(F.max("l_linenumber").alias("season"))
    episodes = li.select(F.concat(F.lit("tt"), F.lpad(F.col("l_partkey").cast("string"), 7, "0")).alias("parent"), "season")
    m = ents(spark, d).select("title_id", "kind", "seasons").join(exact(spark, d).select("title_id", "tconst"), "title_id")
    return C.validate_seasons(m, episodes).select("title_id", "tconst", "max_season", "seasons_present")


@query("resolve", CATALOGUE + """
SELECT e.title_id, coalesce(x.stage, CASE WHEN s.score >= 87 THEN 'catalogue_fuzzy' WHEN s.score IS NOT NULL THEN 'near_miss' END, 'unmatched') AS stage, x.stage IS NOT NULL OR coalesce(s.score >= 87, false) AS matched,
  CASE WHEN x.stage IS NOT NULL THEN x.tconst WHEN s.score >= 87 THEN s.tconst END AS tconst, CASE WHEN x.stage IS NULL AND s.score < 87 THEN s.tconst END AS rejected_candidate, CASE WHEN x.stage IS NOT NULL THEN 100.0::DOUBLE ELSE CAST(s.score AS DOUBLE) END AS score
FROM ents e LEFT JOIN exact x USING (title_id) LEFT JOIN (SELECT * FROM scored WHERE rank = 1) s USING (title_id)""")
def resolve(spark, d):
    """The whole resolution: exact rungs, then the fuzzy stage on the residue."""
    r = C.resolved(ents(spark, d), exact(spark, d), *tokens(spark, d))
    return r.select("title_id", "stage", "matched", "tconst", "rejected_candidate", F.round("score", 6).alias("score"))


@query("weak_rungs", SQL + r""",
one AS (SELECT p_partkey AS part FROM part WHERE p_partkey % 3 <> 0)
SELECT part, 'qualifier_dropped' AS rung, 'tt' || lpad(CAST(part AS VARCHAR), 7, '0') AS tconst FROM one WHERE part % 2 = 0
UNION ALL SELECT part, 'prefix', 'tt' || lpad(CAST(part AS VARCHAR), 7, '0') FROM one WHERE part % 2 = 1""")
def weak_rungs(spark, d):
    """The two weakest rungs: a series reported with a country, or with the name of an arc, that the catalogue lacks."""
    # the part's number makes names distinct
    one = A.table(spark, d, "part").where("p_partkey % 3 <> 0").select(F.col("p_partkey").alias("part"), F.concat("p_name", F.lit(" k"), F.col("p_partkey").cast("string")).alias("p_name"))
    title = F.when(F.col("part") % 2 == 0, F.concat("p_name", F.lit(" (Q.Z.): Season 1"))).otherwise(F.concat("p_name", F.lit(": The Qz Arc: Season 2")))
    rows = one.select(F.lit("tv").alias("kind"), title.alias("title"), F.lit(None).cast("date").alias("release_date"), F.lit("1995H1").alias("period"), F.lit(1).cast("long").alias("hours"), F.lit(1).cast("long").alias("views"), F.col("part").alias("row_no"))
    cat = one.select(F.concat(F.lit("tt"), F.lpad(F.col("part").cast("string"), 7, "0")).alias("tconst"), F.lit("tvSeries").alias("type"), F.lit(None).cast("int").alias("start_year"), F.lit(True).alias("is_series"), F.col("p_name").alias("primary_title"), F.col("p_name").alias("original_title"))
    e = C.entities(rows)
    hit = C.exact_stage(e, C.name_index(cat), cat.select("tconst", F.lit(1).alias("votes")))
    part = e.select("title_id", F.substring("example_title", 1, 1000).alias("t")).join(one.select("part", title.alias("t")), "t")
    return hit.join(part, "title_id").select("part", "rung", "tconst")


def _typo(name):
    """Every 64th part's chart name ends in a double letter: only the fuzzy rung can match it."""
    return F.when(F.col("part") % 64 == 7, F.concat(name, F.substring(name, -1, 1))).otherwise(name)


CHART = (
    SQL
    + r""",
sides AS (
  SELECT part, 'H' || (part % 2) AS period, kind, year_text, trim(regexp_replace(lower(base), '[^a-z0-9]+', ' ', 'g')) AS key,
    CASE WHEN part % 8 = 6 THEN lower(split_part(title, ' // ', 2)) END AS other,
    CASE part % 8 WHEN 0 THEN 'season|' || (p_size % 9 + 1) || '||' WHEN 1 THEN 'season|' || (p_size % 9 + 1) || '||' WHEN 2 THEN 'limited|||' WHEN 3 THEN 'part|' || (p_size % 9 + 1) || '||'
      WHEN 4 THEN 'season|' || (p_size % 9 + 1) || '|' || (p_size % 3 + 1) || '|' WHEN 5 THEN 'season|' || (p_size % 9 + 1) || '||' ELSE '|||' END AS season
  FROM named),
l AS (SELECT part AS id, period, kind, year_text AS year, other, CASE WHEN part % 8 = 2 THEN '|||' ELSE season END AS season, CASE WHEN part % 64 = 7 THEN key || right(key, 1) ELSE key END AS key FROM sides),
r AS (SELECT part AS right_id, period, kind, year_text AS r_year, key AS r_key, other AS r_other, season AS r_season FROM sides),
lk AS (SELECT id, period, kind, year, season, 0 AS pos, key AS k FROM l UNION ALL SELECT id, period, kind, year, season, 1, other FROM l WHERE other IS NOT NULL AND other <> key),
rk AS (SELECT right_id, period, kind, r_year, r_season, r_key AS k FROM r UNION ALL SELECT right_id, period, kind, r_year, r_season, r_other FROM r WHERE r_other IS NOT NULL AND r_other <> r_key),
ex AS (SELECT id, year, right_id, r_year, 'exact' AS stage FROM l JOIN r USING (period, kind) WHERE key = r_key AND season = r_season),
alt0 AS (SELECT id, year, right_id, r_year, pos, min(pos) OVER (PARTITION BY id) AS first FROM lk JOIN rk USING (period, kind, k) WHERE season = r_season AND id NOT IN (SELECT id FROM ex)),
hits0 AS (SELECT * FROM ex UNION ALL SELECT id, year, right_id, r_year, 'alternate' FROM alt0 WHERE pos = first),
hits1 AS (SELECT *, count(*) OVER (PARTITION BY id) AS n, count(*) FILTER (WHERE year <> '' AND r_year = year) OVER (PARTITION BY id) AS dated FROM hits0),
hits2 AS (SELECT id, right_id, CASE WHEN n > 1 AND dated > 0 THEN 'year' ELSE stage END AS stage, CASE WHEN n > 1 AND dated > 0 THEN dated ELSE n END AS candidates FROM hits1 WHERE NOT (n > 1 AND dated > 0) OR (year <> '' AND r_year = year)),
equiv AS (
  SELECT id, pos, count(*) AS candidates, min(right_id) AS right_id FROM lk JOIN rk USING (period, kind, k)
  WHERE id NOT IN (SELECT id FROM hits2) AND season IN ('|||', 'season|1||', 'limited|||') AND r_season IN ('|||', 'season|1||', 'limited|||') GROUP BY id, pos HAVING count(*) = 1),
settled AS (
  SELECT id, right_id, stage, candidates FROM hits2
  UNION ALL SELECT id, right_id, 'season_equiv', candidates FROM equiv QUALIFY row_number() OVER (PARTITION BY id ORDER BY pos) = 1),
sure AS (SELECT id, stage, right_id, 100.0::DOUBLE AS score, candidates, CAST(NULL AS DOUBLE) AS runner_up FROM settled QUALIFY row_number() OVER (PARTITION BY id ORDER BY right_id) = 1),
rest AS (SELECT l.*, r.right_id, r.r_key, array_to_string(list_sort(string_split(key, ' ')), ' ') AS a, array_to_string(list_sort(string_split(r_key, ' ')), ' ') AS b FROM l JOIN r USING (period, kind) WHERE season = r_season AND id NOT IN (SELECT id FROM sure)),
near AS (SELECT id, right_id, 200.0 * list_reduce(list_transform(string_split(a, ''), lambda ch: [ascii(ch)]), lambda above, ch: list_reduce(list_transform(range(1, CAST(length(b) + 1 AS BIGINT)), lambda j: [CAST(j AS INTEGER)]), lambda acc, j: list_append(acc, CASE WHEN ascii(b[j[1]]) = ch[1] THEN above[j[1]] + 1 ELSE greatest(above[j[1] + 1], acc[j[1]]) END), [0]), list_transform(range(0, CAST(length(b) + 1 AS BIGINT)), lambda j: 0))[-1] / (length(a) + length(b)) AS score FROM rest),
best AS (SELECT id, right_id, score, row_number() OVER w AS r, count(*) OVER (PARTITION BY id) AS candidates, lead(score) OVER w AS runner_up FROM near WINDOW w AS (PARTITION BY id ORDER BY score DESC, right_id)),
every AS (SELECT * FROM sure UNION ALL SELECT id, CASE WHEN score >= 87 THEN 'fuzzy' ELSE 'near_miss' END, right_id, score, candidates, runner_up FROM best WHERE r = 1)
SELECT l.id AS left_id, coalesce(stage, 'unmatched') AS stage, coalesce(stage, 'unmatched') NOT IN ('near_miss', 'unmatched') AS matched, right_id, round(score, 6) AS score, coalesce(candidates, 0) AS candidates, round(runner_up, 6) AS runner_up FROM l LEFT JOIN every USING (id)"""
)


@query("chart_ladder", CHART)
def chart_ladder(spark, d):
    """Weekly chart names matched to reported names, blocked by half-year and kind."""
    half = F.concat(F.lit("H"), (F.col("part") % 2).cast("string"))
    t = A.titles(spark, d).withColumn("period", half).repartition(spark.sparkContext.defaultParallelism)
    chart = F.when(F.col("part") % 4 == 1, F.replace("title", F.lit("Season"), F.lit("season"))).when(F.col("part") % 8 == 2, F.replace("title", F.lit(": Limited Series"), F.lit(""))).otherwise(_typo(F.col("title")))
    block = ["period", "kind"]
    side = lambda name, title: kept(spark, d, name, lambda: L.candidates(t.select(F.col("part").alias("id"), title.alias("t"), *block), "id", "t", block))
    return L.match(side("chart_left", chart), side("chart_right", F.col("title")), block).withColumn("score", F.round("score", 6)).withColumn("runner_up", F.round("runner_up", 6))
