"""The pipeline's stages on hard rows against brute force, and what their operators promise beyond the main tests."""

import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from lanternfish.llm import mixing, near_copies, packing, passages, quality
from lanternfish.llm.common import Scratch, components

CLASH = ("size", "_size", "_copy", "_rep", "_n", "row", "node", "keys", "bundle", "to", "label", "piece", "_lanternfish_node")


@pytest.fixture(scope="module")
def hard(spark):
    """Null and shared ids, null and empty texts, repeated rows, near copies, one long text, clashing columns."""
    rng = np.random.default_rng(8)
    base = [" ".join(rng.choice([f"v{i}" for i in range(400)], 80)) for _ in range(6)]
    edit = lambda t, k: " ".join("edited" if i == k else w for i, w in enumerate(t.split()))
    rows = [(i, t) for i, t in enumerate(base)] + [(10 + i, edit(t, 79)) for i, t in enumerate(base[:3])] + [(0, base[1]), (4, base[5] + " more"), (None, base[0]), (None, "only here " + base[2][:200]), (None, None), (20, None), (21, ""), (22, " \t"), (3, base[3]), (3, base[3]), (30, " ".join(rng.choice([f"u{i}" for i in range(5000)], 60_000)))]
    df = spark.createDataFrame([(i, t, "en", f"s{k % 3}" if k % 5 else None, 1) for k, (i, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumns({c: F.lit(c) for c in CLASH}).repartition(3).cache()


def words(t):
    return (t or "").encode().split()


def test_near_copies_leave_one_row_of_each_component(spark, hard):
    rows = hard.collect()
    sets = [set(near_copies.shingles(r.text)[1].tolist()) for r in rows]
    label = list(range(len(rows)))
    for _ in rows:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if len(a & b) >= 0.8 * len(a | b) - 1e-12:
                    label[i] = label[j] = min(label[i], label[j])
    best = {}
    for r, c in zip(rows, label, strict=True):
        order = (r.doc_id is None, r.doc_id or 0, r.text is not None, r.text or "")
        best[c] = min(best.get(c, (order, r)), (order, r), key=lambda x: x[0])
    got = near_copies.keep_one(hard)
    assert got.columns == hard.columns
    assert Counter((r.doc_id, r.text) for r in got.collect()) == Counter((r.doc_id, r.text) for _, r in best.values())
    assert near_copies.keep_one(hard.limit(0)).count() == 0


def test_near_copies_begin_with_simhash(spark):
    rng = np.random.default_rng(4)
    base = [" ".join(rng.choice([f"w{i}" for i in range(3000)], 400)) for _ in range(3)]
    texts = [*base, base[0] + " more", base[1].replace(" ", "  "), "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    scratch = Scratch(spark, "test")
    rows = scratch.keep(near_copies.with_nodes(docs), "rows")
    node = {r.row.doc_id: r.node for r in rows.collect()}
    nodes = rows.where("size > 0").select("node", "fp").distinct()
    got = {r.node: r.label for r in near_copies.simhashed(nodes, rows, 0.8, scratch, 3).collect()}
    assert got == dict.fromkeys((node[0], node[3]), min(node[0], node[3])) and node[1] == node[4]
    # what shingles don't confirm is no link, however alike the fingerprints are
    assert near_copies.simhashed(nodes.select("node", F.lit(5).cast("long").alias("fp")), rows, 0.8, Scratch(spark, "test"), 3).count() in (0, 2)


def test_crowded_groups_in_bounded_blocks(spark, monkeypatch):
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 1 << 40, 40, dtype=np.uint64)) for _ in range(4)]
    near = [np.sort(np.append(sets[k % 4][:-1], np.uint64(1 << 50 | k))) for k in range(120)]
    table = pa.table({"role": [0] * 120 + [1] * 120, "node": list(range(120)) * 2, "set": [x.tobytes() for x in near] * 2})
    whole = near_copies.held_against(table, 0.8)
    held = []
    forest = near_copies.forest
    monkeypatch.setattr(near_copies, "LINKS_HELD", 50)
    monkeypatch.setattr(near_copies, "forest", lambda u, v: held.append(len(u)) or forest(u, v))
    u, v = near_copies.held_against(table, 0.8)
    assert max(held) < 50 + 30 + 120 and len(u) == 116
    assert sorted(zip(u.tolist(), v.tolist(), strict=True)) == sorted(zip(whole[0].tolist(), whole[1].tolist(), strict=True)) and all(a % 4 == b for a, b in zip(u.tolist(), v.tolist(), strict=True))
    # many blocks and parts leave the same components as one
    seats = spark.createDataFrame([(1, k, 40) for k in range(24)], "key long, node long, size int")
    text = [" ".join(f"g{k % 3}w{i}" for i in range(60)) + f" x{k}" for k in range(24)]
    rows = spark.createDataFrame([((k, t), k) for k, t in enumerate(text)], "row struct<doc_id: long, text: string>, node long")
    none = spark.createDataFrame([], "node long, label long")
    for per_block, per_index in ((2000, 1 << 20), (5, 100)):
        found = near_copies.settled(seats, none, rows, 0.8, Scratch(spark, "test"), per_block, per_index)
        assert {(r.node, r.label) for r in components(found, Scratch(spark, "test")).collect()} == {(k, k % 3) for k in range(24)}


def plain_passages(rows, window=13):
    first = {}
    for r in rows:
        w = words(r.text)
        for k in range(len(w) - window + 1):
            x = tuple(w[k : k + window])
            first[x] = min(first.get(x, math.inf), math.inf if r.doc_id is None else r.doc_id)
    out = []
    for r in rows:
        w, me = words(r.text), math.inf if r.doc_id is None else r.doc_id
        gone = set()
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < me:
                gone.update(range(k, k + window))
        out.append((r.doc_id, r.text if not gone else b" ".join(x for k, x in enumerate(w) if k not in gone).decode(), r.row))
    return Counter(out)


@pytest.mark.parametrize("bundle_mb", [0.001, 8])
def test_passages_stage(spark, hard, bundle_mb):
    got = passages.without_repeats(hard, bundle_mb=bundle_mb)
    assert got.columns == hard.columns
    assert Counter((r.doc_id, r.text, r.row) for r in got.collect()) == plain_passages(hard.collect())
    assert passages.without_repeats(hard.limit(0)).count() == 0


def test_passages_need_the_words_not_the_hash(monkeypatch):
    """With one hash for all windows, texts that share no words lose none, in a bundle and between bundles."""
    monkeypatch.setattr(passages, "window_hashes", lambda h, window: np.full(max(0, len(h) - window + 1), 7, np.uint64))
    texts = [" ".join(f"{x}{i}" for i in range(30)) for x in "abc"]
    tables = [pa.table({"bundle": pa.array([b] * len(t), pa.int32()), "shared": [False] * len(t), "doc_id": i, "text": t}) for b, i, t in ((0, [1, 2], texts[:2]), (1, [3], texts[2:]))]
    blobs = pa.concat_tables([passages._emit(13, 1)(t) for t in tables])
    answers = passages._answer(blobs)
    marks = [m for t, b in zip(tables, (0, 1), strict=True) for m in passages._survey(13, 64)(t, answers.filter(pa.compute.equal(answers["bundle"], b))).to_pylist()]
    given, runs = {m["h"]: m for m in marks if m["kind"] == passages.WORD_AT}, {m["block"]: m for m in marks if m["kind"] == passages.RUN}
    asked = [(m["bundle"], given[m["h"]]) for m in marks if m["kind"] == passages.ASK]
    assert asked, "the forced hash makes the second bundle ask"
    found = [(b, " ".join(runs[g["block"]]["words"].split()[g["at"] : g["at"] + 13]), runs[g["block"]]["doc_id"]) for b, g in asked]
    found += [(m["bundle"], m["words"], m["doc_id"]) for m in marks if m["kind"] == passages.LOCAL]
    for b, t in enumerate(tables):
        mine = [x for x in found if x[0] == b]
        phrases = pa.table({"words": pa.array([w for _, w, _ in mine], pa.string()), "owner": pa.array([o for *_, o in mine], pa.int64())})
        rows = pa.table({"row": pa.StructArray.from_arrays([t["doc_id"].combine_chunks(), t["text"].combine_chunks()], names=["doc_id", "text"])})
        assert passages._clean(13, ["doc_id", "text"], True, 1000)(rows, phrases)["n_removed"].to_pylist() == [0] * len(t)


def test_mixing_stage(spark, hard):
    took = Counter((r.doc_id, r.source, r.size, r.copies) for r in mixing.mix(hard).collect())
    got = mixing.repeat(hard)
    assert got.columns == hard.columns
    want = Counter()
    for (i, s, n, copies), rows in took.items():
        want[i, s, n] += copies * rows
    assert Counter((r.doc_id, r.source, len(words(r.text))) for r in got.collect()) == +want
    assert mixing.repeat(hard.limit(0)).count() == 0


def test_mixing_ids_that_clash_in_part(spark):
    """Rows of one id are told apart by source and size: one row out for each row in."""
    rows = spark.createDataFrame([(1, "a", 5), (1, "a", 6), (1, "b", 5), (2, "a", 5)], "row_id long, source string, size long")
    assert mixing.copies(rows, Scratch(spark, "t")).count() == 4


def test_packing_stage(spark, hard):
    got = packing.pack(hard).groupBy("doc_id").agg(F.sum("length").alias("n"), F.sum((F.col("piece") == 0).cast("int")).alias("docs")).collect()
    assert Counter({r.doc_id: r.docs for r in got}) == Counter(r.doc_id for r in hard.collect()) and all(r.n >= r.docs for r in got)


def test_components_say_when_they_do_not_settle(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)], "u long, v long")
    with pytest.raises(RuntimeError):
        components(edges, Scratch(spark, "t"), rounds=2)
    assert {r.label for r in components(edges, Scratch(spark, "t")).collect()} == {0}


def test_settings_come_back(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    Scratch(spark, "t").keep(spark.range(3), "x").count()
    assert spark.conf.get(name) == before


def test_quality_is_ftrl_on_shares_of_n_grams(spark):
    """Scores equal a plain implementation: dictionaries, one update at a time, no sparse vectors."""
    rng = np.random.default_rng(12)
    texts = [" ".join(rng.choice(["Tree", "sea", "sea", "W1nd!!", "of", "of", "A|b", "日本"], rng.integers(0, 25))) for _ in range(60)] + ["", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(60)], "doc_id long, quality int")
    bits, mask = 18, (1 << 64) - 1
    m1, m2, m3 = int(quality._M1), int(quality._M2), int(quality._M3)

    def slot(h):
        h = h * m1 & mask
        h ^= h >> 29
        return (h * m2 & mask) >> (64 - bits)

    def vector(t):
        w = [x.decode() for x in words(t)]
        f = [xxh64_intdigest(x.lower().encode(), 1) for x in w]
        s = [77 if i and w[i] == w[i - 1] else xxh64_intdigest(quality.shape(x).encode(), 2) for i, x in enumerate(w)]
        grams = f + [x * m3 & mask for x in s] + [(a * m1 + b) & mask for a, b in zip(s, s[1:])] + [((a * m2 + b) * m3 + c) & mask for a, b, c in zip(s, s[1:], s[2:])]
        n = Counter(map(slot, grams))
        return {k: quality.SCALE * c / len(grams) for k, c in n.items() if k} | {0: 1.0}

    z, n = Counter(), Counter()
    weight = lambda k: 0.0 if abs(z[k]) <= 0.02 else -(z[k] - math.copysign(0.02, z[k])) / ((1 + math.sqrt(n[k])) / 0.3 + 0.5)
    import zlib

    train = sorted((i for i in range(60) if zlib.crc32(str(i).encode()) % 5), key=lambda i: (xxh64_intdigest(str(i), 3), i))
    for _ in range(4):
        for i in train:
            x = {k: float(np.float32(v)) for k, v in vector(texts[i]).items()}
            w = {k: weight(k) for k in x}
            p = 1 / (1 + math.exp(-sum(w[k] * v for k, v in x.items())))
            for k, v in x.items():
                g = (p - int(i % 3 > 0)) * v
                sigma = (math.sqrt(n[k] + g * g) - math.sqrt(n[k])) / 0.3
                z[k] += g - sigma * w[k]
                n[k] += g * g
    got = {r.doc_id: r.score for r in quality.classify(df, labels).collect()}
    for i, t in enumerate(texts):
        x = vector(t)
        # a text's shares are of its n-grams without those in slot 0, which hold one in 2^18
        assert math.isclose(got[i], 1 / (1 + math.exp(-sum(weight(k) * v for k, v in x.items()))), abs_tol=2e-4), i
