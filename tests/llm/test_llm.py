"""The training-data operators against brute force, on small fixtures with hard rows."""

import hashlib
import itertools
import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lanternfish.llm import attention, caps, language_model, mixing, near_copies, neighbours, packing, passages, quality, simhash, token_counts, warc
from lanternfish.llm.common import Scratch, components

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    return (text or "").encode().split()


@pytest.fixture(scope="module")
def texts():
    rng = np.random.default_rng(4)
    vocab = ["the", "of", "und", "Émile", "straße", "x!", "don't", "  ", "a\x1cb", "日本", "WORD", "re", "tion", "q|z"] + [f"w{i}" for i in range(60)]
    passage = " ".join(f"p{i}" for i in range(30))
    out = [None, "", " \t\n", "one", "two words", "Two  WORDS", passage, "before " + passage + " after", passage[:60]]
    for i in range(50):
        t = " ".join(rng.choice(vocab, rng.integers(1, 120)))
        out += [t, t + " end"] if i % 5 == 0 else [t]
    out += [out[12]] * 3 + [" ".join(rng.choice(vocab, 6000))]
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "en", f"s{i % 3}" if i % 7 else None, len(t or "")) for i, t in enumerate(texts)]
    rows += [(None, texts[12], None, None, None), (None, None, "de", "s1", 0), rows[15], rows[15]]
    return spark.createDataFrame(rows, DOCS).repartition(5).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def wide(docs):
    """The rows with extra columns whose names the operators use inside."""
    return docs.withColumns({c: F.lit("x") for c in ("fp", "size", "piece", "label", "score", "held_out", "rep", "bundle", "_bundle", "row", "node", "keys", "copy", "copies", "_size", "_copy", "_rep", "_n", "n", "r", "d", "s", "shared", "words", "owner", "to", "at", "_lanternfish_node")})


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (7, 7), (200, 100), (5, 300), (300, 5)]
    got = {r.node: r.label for r in components(spark.createDataFrame(chain, "u long, v long"), Scratch(spark, "t")).collect()}
    assert all(got[i] == 0 for i in range(41)) and got[300] == 0
    assert {got[i] for i in (100, 101, 102, 200)} == {100}
    assert components(spark.createDataFrame([], "u long, v long"), Scratch(spark, "t")).count() == 0


# --- 1 WARC


@pytest.mark.parametrize(("compression", "split", "part"), [("gzip", "128m", 3000), ("gzip", "128m", 1 << 20), (None, "900", 1 << 20), (None, "5000", 700)])
def test_warc_round_trip(spark, compression, split, part):
    bait = "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    rows = [(i, f"http://x/{i % 3} a\n", ("<p>" + bait * (i % 4) + "é" * 400 * (i % 5) + "</p>") if i % 7 else None) for i in range(40)]
    rows += [(None, None, "z" * 2000), (5000, "u", "z" * 2000), (5001, "u", "y" * 999), (5002, "u", "y" * 999)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("file", F.lit(1)).coalesce(2)
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        got = warc.archive_round_trip(pages, compression=compression, part_bytes=part).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(got) == len(rows)
    keeper = {}
    for i, _, html in rows:
        if i is not None and len((html or "").encode()) >= 1000:
            keeper[html] = max(keeper.get(html, -1), i)
    want = Counter()
    for i, _, html in rows:
        raw = (html or "").encode()
        k = keeper.get(html, i) if len(raw) >= 1000 else i
        want[(i, len(raw), hashlib.sha1(raw).hexdigest(), "response" if k == i else "revisit", None if k == i else k)] += 1
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == want


def test_warc_empty(spark):
    assert warc.archive_round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


# --- 2 mixing


def test_mixing_targets(spark):
    rows = [(f"s{i}" if i else None, n) for i, n in enumerate([50, 900, 10, 0, 400, 77, 1200, 3])]
    got = {r.source: r.target for r in mixing.source_targets(spark.createDataFrame(rows, "source string, size long"), "source", (3, 1, 2), 1.5, 2.0).collect()}
    order = sorted((s for s, _ in rows if s is not None)) + [None]
    w = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    size = dict(rows)
    total, open_ = 1.5 * sum(size.values()), set(order)
    want = {}
    while True:
        level = (total - sum(want.values())) / sum(w[s] for s in open_)
        over = [s for s in open_ if level * w[s] > 2 * size[s]]
        if not over:
            break
        for s in over:
            want[s] = 2.0 * size[s]
            open_.discard(s)
    want |= {s: level * w[s] for s in open_}
    assert all(math.isclose(got[s], want[s], rel_tol=1e-12) for s in order)


def test_mixing(spark, docs, empty, wide):
    got = mixing.mix(docs).collect()
    assert len(got) == docs.count()
    assert Counter((r.doc_id, r.size) for r in got) == Counter((r.doc_id, len(words(r.text))) for r in docs.collect())
    by = {}
    for r in got:
        assert 0 <= r.copies <= 2
        by.setdefault(r.source, [0, r.target])[0] += r.copies * r.size
    assert all(abs(t - want) <= 0.06 * want + 3000 * (want > 3000) for t, want in by.values())
    again = mixing.mix(docs.repartition(2)).collect()
    key = lambda rows: sorted(map(str, ((r.doc_id, r.source, r.size, r.rep, r.copies) for r in rows)))
    assert key(got) == key(again) == key(mixing.mix(wide).collect())
    assert mixing.mix(empty).count() == 0
    assert mixing.mix(docs.where("text is null")).agg(F.sum("copies")).first()[0] == 0
    many = mixing.repeat(docs)
    assert many.columns == docs.columns and many.count() == sum(r.copies for r in got)


def test_mixing_is_unbiased(spark):
    rows = spark.range(300).select(F.col("id").alias("row_id"), (F.col("id") % 3).cast("string").alias("source"), (1 + F.col("id") % 17).alias("size"))
    took = [mixing.copies(rows, Scratch(spark, "t"), seed=s, block=8).agg(F.avg("copies")).first()[0] for s in (1, 2)]
    assert all(abs(t - 1.5) < 0.12 for t in took)


# --- 3 SimHash


def brute_components(ids, near):
    label = list(ids)
    while True:
        new = [min(label[j] for j in near[i]) for i in range(len(ids))]
        if new == label:
            return label
        label = new


def test_simhash(spark, docs, empty, wide):
    rows = [r for r in docs.collect() if r.doc_id is not None]
    fp = [simhash.fingerprint(r.text) for r in rows]
    assert simhash.fingerprint(" \t") == 0 and simhash.fingerprint("One TWO") == simhash.fingerprint("one two")
    near = [[j for j in range(len(fp)) if (fp[i] ^ fp[j]).bit_count() <= 3] for i in range(len(fp))]
    want = Counter(zip([r.doc_id for r in rows], brute_components([r.doc_id for r in rows], near), strict=True))
    for df in (docs, wide):
        got = simhash.near_duplicates(df.where("doc_id is not null")).collect()
        assert Counter((r.doc_id, r.component_id) for r in got) == want
        assert all(r.fp % (1 << 64) == f for r in got for f in {simhash.fingerprint(x.text) for x in rows if x.doc_id == r.doc_id})
    assert simhash.near_duplicates(docs).count() == docs.count()
    assert simhash.near_duplicates(empty).count() == 0
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.where("doc_id is not null").collect()) == sorted(set(want_id for _, want_id in want))


def test_keep_one_of_null_and_shared_ids(spark):
    """Rows are told apart by their texts, so unrelated ones without an id or with the same id all stay."""
    a, b, c, d, e = (" ".join(f"{x}{i}" for i in range(40)) for x in "abcde")
    rows = [(None, a), (None, b), (None, b), (7, c), (7, d), (3, d), (7, e), (None, e), (None, None), (9, "")]
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCS)
    got = Counter((r.doc_id, r.text) for r in simhash.keep_one(df).collect())
    assert got == Counter([(None, a), (None, b), (7, c), (3, d), (7, e), (9, "")])


@pytest.mark.parametrize(("per_pivot", "per_block"), [(256, 4096), (4, 3)])
def test_simhash_pivots_lose_no_link(spark, per_pivot, per_block):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**64, 60, dtype=np.uint64)
    fps = list(base)
    for b in base[:30]:
        for k in range(1, 6):
            bits = rng.choice(64, k, replace=False)
            fps.append(b ^ np.bitwise_or.reduce(np.uint64(1) << bits.astype(np.uint64)))
    fps = np.unique(np.array(fps, np.uint64))
    near = np.bitwise_count(fps[:, None] ^ fps[None]) <= 3
    want = brute_components(fps.tolist(), [np.flatnonzero(x).tolist() for x in near])
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    edges = simhash.links(df, Scratch(spark, "t"), per_pivot=per_pivot, per_block=per_block)
    got = {r.node: r.label for r in components(edges.where("u is not null").select("u", "v"), Scratch(spark, "t")).collect()}
    label = [got.get(int(x), int(x)) for x in fps.view(np.int64)]
    assert len(set(zip(label, want, strict=True))) == len(set(label)) == len(set(want))
    n = edges.agg(F.sum("met").alias("met"), F.sum("left").alias("left"), F.sum("linked").alias("linked")).first()
    # each link is met once, and the pivots discard nearly all that isn't one
    assert n.linked == (near.sum() - len(fps)) // 2 <= n.left <= n.linked + 0.02 * n.met + 5


def test_near_copies(spark):
    """Components of 5-word Jaccard 0.8, planted copies with edited words and a crowded bucket included."""
    rng = np.random.default_rng(9)
    texts = [None, "", "one", "One ", "a b c d e"]
    for i in range(12):
        base = [f"t{i}x{j}" for j in range(150)]
        texts.append(" ".join(base))
        for n in (1, 2, 3, 4, 6):
            copy = list(base)
            for at in rng.choice(150, n, replace=False):
                copy[at] = "edited"
            texts.append(" ".join(copy))
    base = [f"b{j}" for j in range(200)]
    texts += [" ".join([*base[: 150 + 3 * k], f"end{k}"]) for k in range(17)]
    sets = [set(near_copies.shingles(t)[1].tolist()) for t in texts]
    alike = lambda a, b: len(a & b) >= 0.8 * len(a | b)
    near = [[j for j, b in enumerate(sets) if alike(a, b)] for a in sets]
    want = brute_components(list(range(len(texts))), near)
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)] + [(None, texts[8], None, None, None), (None, "z y", None, None, None)], DOCS)
    for per_block in (3, 2000):
        got = near_copies.keep_one(df, per_block=per_block)
        assert Counter(r.doc_id for r in got.collect()) == Counter([*set(want), None])
    assert got.columns == df.columns
    kept = [r.doc_id for r in got.collect()]
    assert kept.count(None) == 1 and {i for i in kept if i is not None} == set(want) and len(kept) == len(set(want)) + 1
    far = [i for i in range(len(texts)) for j in near[i] if (simhash.fingerprint(texts[i]) ^ simhash.fingerprint(texts[j])).bit_count() > 3]
    assert far, "the planted copies lie beyond op3's radius"
    assert near_copies.keep_one(df.limit(0)).count() == 0


# --- 4 language model


def test_language_model_base(spark, docs, empty, wide):
    small = {"frequent": 40, "shard_mb": 0.005, "windows_each": 40}
    rows = docs.collect()
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    count = Counter()
    for r in rows:
        if not held(r.doc_id):
            count.update((r.text or "").encode().lower().split() + [None])
    n, v = sum(count.values()), len(count)
    want = Counter()
    for r in rows:
        t = (r.text or "").encode().lower().split() + [None]
        base = sum(math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t)
        want[(r.doc_id, held(r.doc_id), len(t), sum(w in count for w in t), n, round(base, 5))] += 1
    got = language_model.score_texts(wide, **small).collect()
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in got) == want
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)
    assert language_model.score_texts(empty, **small).count() == 0


def test_language_model_trains_on_all_text():
    """Every subword of every training text is predicted once, however long the text is."""
    path = packing.default_tokenizer()
    texts = [" ".join(f"w{i}" for i in range(9000)), None, "one"]
    out = list(language_model._count(path, 1)(iter([pa.RecordBatch.from_pydict({"text": texts})])))
    blobs = [x for b in out for k, x in zip(b.column("kind").to_pylist(), b.column("counts").to_pylist(), strict=True) if k == 1]
    lex = language_model.lexicon(path)
    got = np.concatenate([language_model._windows(x, lex.size) for x in blobs])
    want = np.concatenate([lex.ids(lex.numbers(t)) for t in texts])
    goals, before = got[:, 1:].ravel(), got[:, :-1].ravel()
    assert goals[goals >= 0].tolist() == want.tolist()
    assert before[goals >= 0].tolist() == [-1, *want[:-4].tolist(), -1, -1, want[-2]]


def test_language_model_rounds_make_up_all_windows(spark, monkeypatch):
    """The parts of a trainer's windows over all rounds are its windows; a scored subword sees 8 others at least, inside a text."""
    v = attention.Vocabulary(np.arange(20, 0, -1))
    w = attention.start(v, 4)
    windows = np.random.default_rng(2).integers(0, 20, (50, attention.WINDOW + 1)).astype(language_model.packed_type(v.size))
    table = pa.table({"trainer": [0, 0], "counts": [(windows[:20] + 2).tobytes(), (windows[20:] + 2).tobytes()]})
    seen = []
    monkeypatch.setattr(attention, "train", lambda v, w, part, **_: seen.append(part) or w)
    n = [language_model._learn(spark.sparkContext.broadcast((v, w)), 0.01, i, 3)(table).column("n")[0].as_py() for i in range(3)]
    assert sum(n) == 50 and sorted(map(tuple, np.concatenate(seen).tolist())) == sorted(map(tuple, windows.tolist()))
    assert attention.CONTEXT >= 8 and attention.WINDOW >= 32


def test_language_model_beats_the_base(spark):
    """On held-out texts of known words the model is likelier than word counts."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language_model.score_texts(docs).where("held_out and n_known = n_tokens and n_tokens > 1").agg(F.count("*").alias("n"), F.sum("score").alias("score"), F.sum("base_score").alias("base")).first()
    assert got.n > 20 and got.score > got.base


def test_attention_windows_and_gradient():
    rng = np.random.default_rng(0)
    counts = rng.integers(0, 9, 40)
    counts[35:] = 0
    v = attention.Vocabulary(counts)
    w = {k: x.astype(np.float64) for k, x in attention.start(v, 6).items()}
    s = attention.Scorer(v, w)
    # every next token has a distribution that sums to one, entries never met included
    h = rng.standard_normal((3, 6))
    total = sum(np.exp(s.next_log_prob(h, np.full(3, r))) for r in range(40))
    assert np.allclose(total, 1, atol=1e-5)
    # each token is scored once: the sum over one text equals the plain sum over its windows
    ids = rng.integers(0, 40, 100)
    alone = s.score(ids, np.array([100]))
    both = s.score(np.concatenate([ids[:30], ids]), np.array([30, 100]))
    assert np.allclose(alone[0], both[1]) and np.isfinite(both).all()
    plain, new = 0.0, attention.WINDOW - attention.CONTEXT
    seq = np.concatenate([[-1], ids])
    for first in range(0, 100, new):
        lo = max(0, first - attention.CONTEXT)
        rows = attention._rows(v, seq[lo : first + new])[: 100 - lo]
        x = w["emb"][rows]
        for t in range(first, min(first + new, 100)):
            q = x[t - lo] @ w["q"] / math.sqrt(6)
            k = x[: t - lo + 1] @ w["k"]
            a = k @ q + w["far"][np.arange(t - lo, -1, -1)]
            a = np.exp(a - a.max())
            state = x[t - lo] + (a / a.sum()) @ (x[: t - lo + 1] @ w["v"])
            plain += s.next_log_prob(state[None], v.rank[ids[t : t + 1]])[0]
    assert np.isclose(plain, alone[0], rtol=1e-4)
    part = np.concatenate([np.full((4, 1), -1), rng.integers(0, 35, (4, attention.WINDOW))], axis=1)

    def loss(w):
        return -sum(attention.Scorer(v, w).score(r[1:], np.array([attention.WINDOW]))[0] for r in part)

    g = attention.gradient(v, w, *attention.Goals(v, part).part(np.arange(len(part))))
    short = [r for r in part]
    assert len(short) == 4
    for name in ("cls", "out_b", "emb"):
        i = tuple(rng.integers(0, n) for n in w[name].shape)
        step = {k: x.copy() for k, x in w.items()}
        step[name][i] += 1e-4
        # the scorer cuts a window into overlapping ones; weights off the attention path agree closely
        assert abs((loss(step) - loss(w)) / 1e-4 / part[:, 1:].size - g[name][i]) < 2e-3


def test_attention_classes_follow_frequency():
    """A token needs fewer outputs than with classes of one width where few entries are frequent, and no more where none is."""

    def outputs(counts):
        v = attention.Vocabulary(counts)
        assert v.begin[0] == 0 and v.begin[-1] == v.seen and (np.diff(v.begin) > 0).all()
        width = np.diff(v.begin)
        share = np.sort(counts[counts > 0])[::-1] / counts.sum()
        return (v.classes + 1 + (np.add.reduceat(share, v.begin[:-1]) * width).sum()) / (2 * np.sqrt(v.seen))

    assert outputs((10**9 / np.arange(1, 4001) ** 1.6).astype(np.int64)) < 0.85
    assert outputs((10**7 / np.arange(1, 4001)).astype(np.int64)) < 1.02
    assert outputs(np.full(4000, 9)) < 1.02


def test_language_model_words():
    """Words of many texts at once are those of each text alone, white space of any kind between them."""
    lex = language_model.lexicon(packing.default_tokenizer())
    odd = [None, "", " \t\n", "one", " A\x0bB\x0c c\x1cd \r Éa b x İ ", "\u0085 a", "z" * 70]
    want = [[lex[w] for w in (t or "").encode().lower().split()] + [0] for t in odd]
    flat, size = lex.numbers_of(pa.array(["cut off", *odd])[1:])
    assert flat.tolist() == sum(want, []) and size.tolist() == [len(w) for w in want]
    ids, pieces = lex.pieces(flat)
    alone = [lex.enc.bpe.encode_single_piece(b" z" + b"z" * 69)]
    assert pieces.sum() == len(ids) and ids[-1 - len(alone[0]) :].tolist() == [*alone[0], lex.end_id]


# --- 5 packing


def test_packing(spark, docs, empty, wide, texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    special = spark.createDataFrame([(900, "a <|endoftext|> b", "en", "s", 1), (901, "\x1c \x85x  　 y\n\n z '", "en", "s", 1)], DOCS)
    for df in (docs.union(special), wide):
        rows = df.collect()
        ids = {(r.doc_id, r.text): tok.encode(r.text or "", add_special_tokens=False).ids + [2] for r in rows}
        got = packing.pack(df).collect()
        want = Counter()
        for r in rows:
            x = ids[(r.doc_id, r.text)]
            first = len(x) % 1024 or min(1024, len(x))
            for k, a in enumerate([0, *range(first, len(x), 1024)]):
                part = x[a : first if k == 0 else a + 1024]
                want[(r.doc_id, k, a, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))] += 1
        assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
        bins = {}
        for r in got:
            bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
        for b in bins.values():
            end = 0
            for offset, length in sorted(b):
                assert offset == end
                end += length
            assert end <= 1024
        assert len(bins) <= -(-sum(r.length for r in got) // 1024) + 2
    assert packing.pack(empty).count() == 0


def test_fullest_is_optimal():
    rng = np.random.default_rng(3)
    for _ in range(40):
        left = {int(k): int(rng.integers(1, 3)) for k in rng.integers(1, 30, 4)}
        room = int(rng.integers(1, 60))
        best = max(s for c in itertools.product(*[range(n + 1) for n in left.values()]) if (s := sum(a * b for a, b in zip(c, left, strict=True))) <= room)
        used = packing.fullest(room, left)
        assert sum(k * n for k, n in used.items()) == best and all(n <= left[k] for k, n in used.items())


# --- 6 token counts


def test_token_counts(spark, docs, empty, wide):
    from tokenizers import Tokenizer
    from tokenizers.models import Unigram

    v = token_counts.vocabulary(token_counts.default_vocabulary())
    model = Tokenizer(Unigram([("<unk>", -99.0), *v.items()], 0, False))
    trie = token_counts.Trie(v, nodes=300)
    for w in {w for r in docs.collect() for w in words(r.text)}:
        pieces = model.encode(token_counts.START + w.decode()).tokens
        if all(p in v for p in pieces):
            n, score = trie[w]
            assert math.isclose(score, sum(v[p] for p in pieces), abs_tol=1e-9) and n <= len(pieces)
    got = token_counts.count_tokens(wide).collect()
    assert len(got) == docs.count() and token_counts.count_tokens(empty).count() == 0
    full = token_counts.Trie(v)
    want = Counter((r.doc_id, len(words(r.text)), sum(full[w][0] for w in words(r.text))) for r in docs.collect())
    assert Counter((r.doc_id, r.n_words, r.n_tokens) for r in got) == want


def test_token_counts_of_a_long_word():
    v = token_counts.vocabulary(token_counts.default_vocabulary())
    word = ("straßeof日本the\u0378tion" * 400).encode()
    full, empty = token_counts.Trie(v, nodes=10**6), token_counts.Trie({})
    n, score = full[word]
    assert len(full.score) == 1 and len(word.decode()) > token_counts.LONG  # no node was made
    limit, token_counts.LONG = token_counts.LONG, 10**6
    try:
        assert (n, score) == full[word] and len(full.score) > 1 and empty[b"ab"] == empty.alone("▁ab")
    finally:
        token_counts.LONG = limit


# --- 7 passages


def brute_passages(rows, window=13):
    first = {}
    for i, t in sorted(((i if i is not None else math.inf, t) for i, t in rows), key=lambda x: x[0]):
        w = words(t)
        for k in range(len(w) - window + 1):
            first.setdefault(tuple(w[k : k + window]), i)
    out = Counter()
    for i, t in rows:
        w = words(t)
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < (i if i is not None else math.inf):
                gone[k : k + window] = [True] * window
        out[(i, len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone, strict=True) if not g)).hexdigest())] += 1
    return out


@pytest.mark.parametrize("bundle_mb", [0.002, 8])
def test_passages(spark, docs, empty, wide, bundle_mb):
    want = brute_passages([(r.doc_id, r.text) for r in docs.collect()])
    got = passages.removed_words(wide, bundle_mb=bundle_mb, automaton_words=200).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == want
    assert sum(r.n_removed for r in got) > 60
    assert passages.removed_words(empty).count() == 0
    clean = passages.without_repeats(docs, bundle_mb=bundle_mb)
    assert clean.columns == docs.columns and clean.count() == docs.count()
    assert brute_passages([(r.doc_id, r.text) for r in clean.collect()]).keys()


# --- 8 and 10 vectors


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(2)
    base = rng.standard_normal((40, 16))
    rows = [(i, x.astype(np.float32).tolist(), i % 3) for i, x in enumerate(base)]
    for i in range(40, 160):
        rows.append((i, (base[i % 40] * (1 + i % 3) + rng.standard_normal(16) * 0.04 * (i % 5)).astype(np.float32).tolist(), (i % 40) % 3))
    rows += [(200 + i, base[1].astype(np.float32).tolist(), 1) for i in range(30)]
    rows += [(300, None, 1), (301, [0.0] * 16, 1), (302, [1.0, None] * 8, 1), (303, [float("nan")] * 16, 1), (304, [float("inf")] * 16, 1), (305, rows[1][1], None), (306, [], 1), (307, [1.0, -0.0], 1), (308, [1.0, 0.0], 1), (None, rows[1][1], 1), rows[3]]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("score", F.lit(0)).repartition(4).cache()


def usable(v):
    return v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v)


def test_caps(spark, vectors):
    rows = [r for r in vectors.collect() if r.vec_id is not None]
    near = []
    for i, a in enumerate(rows):
        mine = [i]
        for j, b in enumerate(rows):
            if i != j and a.label is not None and a.label == b.label and usable(a.embedding) and usable(b.embedding) and len(a.embedding) == len(b.embedding):
                x, y = np.array(a.embedding, float), np.array(b.embedding, float)
                if x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.98:
                    mine.append(j)
        near.append(mine)
    label = brute_components([r.vec_id for r in rows], near)
    want = Counter((r.vec_id, len(n) - 1, c, r.vec_id == c) for r, n, c in zip(rows, near, label, strict=True))
    for blocks in (4096, 3):
        got = caps.near_vectors(vectors, per_filter=2, per_block=blocks).where("vec_id is not null").collect()
        assert Counter(tuple(r) for r in got) == want
    assert caps.near_vectors(vectors).where("vec_id is null").first().n_links == 0
    assert caps.near_vectors(vectors.limit(0)).count() == 0


def test_neighbours(spark, vectors):
    rows = {r.vec_id: np.array(r.embedding, float) for r in vectors.collect() if r.vec_id is not None and usable(r.embedding)}
    got = {}
    for r in neighbours.search(vectors, every=20, per_block=7).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    hit = total = 0
    for q in [i for i in rows if i % 20 == 0]:
        all_ = sorted((float(np.sqrt(((x - rows[q]) ** 2).sum())), i) for i, x in rows.items() if i != q and len(x) == len(rows[q]))[:10]
        mine = sorted(got.get(q, []))
        assert [r for r, _, _ in mine] == list(range(1, len(all_) + 1))
        assert all(s == float(np.sqrt(((rows[i] - rows[q]) ** 2).sum())) for _, i, s in mine)
        hit += len({i for _, i in all_} & {i for _, i, _ in mine})
        total += len(all_)
    assert hit >= 0.9 * total
    assert neighbours.search(vectors.limit(0)).count() == 0


def test_neighbours_of_repeated_rows(spark):
    """Rows that repeat take one place: all exact copies of a query come before other vectors."""
    rng = np.random.default_rng(6)
    far = [(100 + i, [float(x) for x in rng.standard_normal(4)]) for i in range(1, 16)]
    one = [1.0, 0.0, 0.0, 0.0]
    rows = [(0, one)] * 50 + [(i, one) for i in range(1, 8)] * 2 + far * 2
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    unit = {i: np.array(v, np.float32).astype(float) for i, v in rows}
    want = sorted((float(np.sqrt(((x - unit[0]) ** 2).sum())), i) for i, x in unit.items() if i)[:10]
    got = neighbours.search(df, every=1000).orderBy("rank").collect()
    assert [r.vec_id for r in got] == [i for _, i in want] and [r.score for r in got[:7]] == [0.0] * 7


def test_neighbours_without_luck(spark, vectors):
    """With one narrow probe most queries lack rows and are answered from all of them."""
    got = neighbours.search(vectors, every=20, tables=1, recall=0.0, width=0.2).groupBy("query_id").count().collect()
    assert {r["count"] for r in got} <= {1, 10}


def test_probe_order():
    """All moves of three projections come out once, each border crossed in the order of its rank."""
    order = neighbours.success_order(3, 99)
    inside = np.array([0.1, 0.6, 0.45])
    got = neighbours.moves(order, inside)
    assert len({tuple(m) for m in got.tolist()}) == 27 == len(got) and set(got.ravel()) == {-1, 0, 1}
    assert got[:2].tolist() == [[0, 0, 0], [-1, 0, 0]]
    # by falling success on average over queries that lie evenly in their cells
    rng, mean = np.random.default_rng(1), np.zeros(27)
    for inside in rng.random((3000, 3)):
        got = neighbours.moves(order, inside)
        mean += (np.where(got < 0, inside, np.where(got > 0, 1 - inside, 0)) ** 2).sum(axis=1)
    assert (np.diff(mean / 3000) > -0.02).all()


def test_neighbours_fit_finds_what_it_must():
    """Probes are as many as the sample's true neighbours ask for, and k gives way where no list is long enough."""
    rng = np.random.default_rng(5)
    x = rng.standard_normal((3000, 24))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    d = ((x[:40, None] - x[None]) ** 2).sum(-1)
    near = [x[np.argsort(r)[1:11]] for r in d]
    for most in (4000, 30):
        c = neighbours.fitted(x, 3000, x[:40], near, tables=3, width=2.5, recall=0.95, most=most)
        order = neighbours.success_order(c.k, c.probes)
        hit = 0
        for q, found in zip(x[:40], near, strict=True):
            seen = np.zeros(10, bool)
            for t in range(3):
                y = c.at(q[None], t)[0]
                seen |= np.isin(neighbours.bucket(np.floor(c.at(found, t))), neighbours.bucket(np.floor(y) + neighbours.moves(order, y - np.floor(y))))
            hit += seen.sum()
        assert hit >= 0.95 * 400 and c.probes <= most
    assert c.k < 10


# --- 9 quality


def test_quality(spark, docs, empty):
    rng = np.random.default_rng(7)
    good = [" ".join(rng.choice(["the", "tree", "sea.", "and", "Wind"], 60)) for _ in range(60)]
    bad = [" ".join(rng.choice(["BUY!!", "NOW!!", "x***", "|", "$$"], 60)) for _ in range(60)]
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(itertools.chain(*zip(good, bad, strict=True)))]
    df = spark.createDataFrame(rows + [(None, None, None, None, None), (500, "", None, None, None)], DOCS).withColumn("quality", F.lit("clash"))
    labels = spark.createDataFrame([(i, 1 - i % 2, 0) for i in range(120)] + [(None, 1, 0), (3, None, 0), (4, 1, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.classify(df, labels).collect()}
    assert len(got) == 122
    for i in range(120):
        assert got[i].predicted == 1 - i % 2 == int(got[i].score >= 0.3)
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0)
    assert 0 <= got[500].score <= 1 and got[None].held_out is False
    kept = quality.keep_good(df, labels)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.where("doc_id < 120").collect()) == list(range(0, 120, 2))
    assert quality.classify(empty, labels).count() == 0
    assert {r.score for r in quality.classify(df, labels.limit(0)).collect()} == {0.5}


# --- the pipeline


def test_pipeline(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, before = docs.columns, docs.count()
    scratch = Scratch(spark, "test")
    for name, stage in corpus_pipeline.STAGES:
        docs = scratch.keep(stage(spark, docs, sf), name)
        if name in ("quality", "near_duplicates"):
            assert docs.count() < before
            before = docs.count()
        if name != "packing":
            assert docs.columns == columns
    assert docs.count() == corpus_pipeline.run(spark, sf).count() > 0
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "passages", "mixing", "packing"]
