import numpy as np
import pytest
from pyspark.sql import functions as F

from lanternfish.functions import similarity, titles as T

PARSES = [
    ("Harbour Lights (2008): Season 4", "Harbour Lights", "season", 4, None, 2008, False),
    ("Harbour Lights: Season 4: Part 3", "Harbour Lights", "season", 4, 3, None, False),
    ("Tidewater: Season 2: The Long Ebb", "Tidewater", "season", 2, None, None, False),
    ("Tidewater: S11: Oslo", "Tidewater", "season", 11, None, None, False),
    ("Tidewater: SEASON 7:", "Tidewater", "season", 7, None, None, False),
    ("Salt Road: Series 3", "Salt Road", "series", 3, None, None, False),
    ("El faro (2015): Temporada 5", "El faro", "season", 5, None, 2015, False),
    ("Der Turm: Staffel 2", "Der Turm", "season", 2, None, None, False),
    ("Night Ferry: Unit: The Ninth Season", "Night Ferry: Unit", "season", 9, None, None, False),
    ("Copper: Part 6", "Copper", "part", 6, None, None, False),
    ("Copper Part 6", "Copper", "part", 6, None, None, False),
    ("Copper: Volume 2", "Copper", "volume", 2, None, None, False),
    ("Copper: Chapter 12", "Copper", "chapter", 12, None, None, False),
    ("Copper: Collection 1", "Copper", "collection", 1, None, None, False),
    ("Quiet Girl: Limited Series // Stilles Kind: Miniserie", "Quiet Girl", "limited", None, None, None, False),
    ("Quiet Girl: Miniseries", "Quiet Girl", "limited", None, None, None, False),
    ("Main Event: May 3, 2021", "Main Event", "episode_date", None, None, None, False),
    ("Two Moons: Part 1 / Part 2", "Two Moons: Part 1 / Part 2", None, None, None, None, False),
    ("The Vikings: IV", "The Vikings", "season", 4, None, None, True),
    ("Vikings VIII", "Vikings", "season", 8, None, None, True),
    ("Vikings viii", "Vikings viii", None, None, None, None, False),
    ("Odd Company 12", "Odd Company", "season", 12, None, None, True),
    ("2046", "2046", None, None, None, None, False),
    ("Area 51 3", "Area 51 3", None, None, None, None, False),
    ("등대: 시즌2", "등대", "season", 2, None, None, False),
    ("Lamp (UK): Season 1", "Lamp (UK)", "season", 1, None, None, False),
]


def test_parse(spark):
    df = spark.createDataFrame([(i, r[0]) for i, r in enumerate(PARSES)] + [(99, None)], "i int, t string").withColumn("p", T.parse(F.col("t")))
    got = {r.i: r for r in df.select("i", "p.*").collect()}
    for i, (title, base, kind, number, part, year, bare) in enumerate(PARSES):
        r = got[i]
        assert (r.base, r.season_kind, r.season_number, r.part_number, r.year, r.bare_number) == (base, kind, number, part, year, bare), title
    assert got[14].alternates == ["Stilles Kind: Miniserie"] and got[16].episode_date == "May 3, 2021" and got[25].qualifier == "UK"


def test_fold_is_unicode_s_own(spark):
    """Every character of the basic plane but Hangul syllables and surrogates folds as its definition says, alone and in a word."""
    chars = [chr(c) for c in (*range(1, 0xAC00), *range(0xD7A4, 0xD800), *range(0xE000, 0x10000))]
    rows = [(c, f"Ax{c}") for c in chars]
    df = spark.createDataFrame(rows, "c string, w string").select("c", "w", T.fold(F.col("c")).alias("f"), T.fold(F.col("w")).alias("g"))
    wrong = [hex(ord(r.c)) for r in df.collect() if r.f != T.folded(r.c) or r.g != T.folded(r.w)]
    assert not wrong, wrong[:20]


@pytest.mark.parametrize(("text", "key"), [("Shameless (U.S.)", "shameless us"), ("Café & Bar", "cafe and bar"), ("I Am Legend", "i am legend"), ("鬼滅の刃", "鬼滅の刃"), ("S.W.A.T.", "swat"), ("Mc² ½ Straße", "mc2 1 2 strasse"), ("Mr+Mrs×Co", "mr and mrs x co"), ("", "")])
def test_normalise(spark, text, key):
    assert spark.createDataFrame([(text,)], "t string").select(T.normalise(F.col("t"))).first()[0] == key


@pytest.mark.parametrize(("kind", "key", "year", "want"), [("tv", "squid game", 2024, "t_6ca1e4f819f5"), ("tv", "stranger things", 2025, "t_b9256bee5a99"), ("film", "kpop demon hunters", 2025, "t_49a1524cb2b0"), ("tv", "wednesday", 2025, "t_64886e8c9916")])
def test_title_id(spark, kind, key, year, want):
    assert spark.range(1).select(T.title_id(F.lit(kind), F.lit(key), F.lit(year))).first()[0] == want


def test_similarity(spark):
    pairs = [("broken hearts gallery", "the broken hearts gallery", 91.3), ("tughlaq durbar telugu", "tughlaq durbar", 80.0), ("barbie a mermaid tale 2", "barbie a mermaid tale", 95.5), ("project mc2", "project c24", 90.9), ("b a", "a b", 100.0)]
    df = spark.createDataFrame(pairs, "a string, b string, want double")
    for r in df.select("want", similarity.token_sort_ratio("a", "b").alias("x"), similarity.token_sort_ratio_native(F.col("a"), F.col("b")).alias("y")).collect():
        assert round(r.x, 1) == r.want and abs(r.x - r.y) < 1e-9


def test_many_ratios_at_once():
    rng = np.random.default_rng(3)
    name = lambda: " ".join("".join(rng.choice(list("abcdé日 "), rng.integers(0, 9))) for _ in range(rng.integers(0, 14)))
    a, b = [name() for _ in range(400)] + ["", "x" * 63, "x" * 64, "y" * 90], [name() for _ in range(400)] + ["", "x" * 70, "x" * 64, "z"]
    assert max(map(len, a)) > 63 and np.array_equal(similarity.ratios(a, b), [similarity.ratio(x, y) for x, y in zip(a, b, strict=True)])
    assert len(similarity.ratios([], [])) == 0


def test_runtime(spark):
    df = spark.createDataFrame([("2:30",), ("*",), ("112:05*",), (None,)], "v string").select(T.parse_runtime(F.col("v")).alias("r")).select("r.*")
    assert [tuple(r) for r in df.collect()] == [(2.5, False, False), (None, True, False), (112 + 5 / 60, False, True), (None, False, False)]
    with pytest.raises(Exception, match="bad runtime"):
        spark.createDataFrame([("1h30",)], "v string").select(T.parse_runtime(F.col("v"))).collect()
