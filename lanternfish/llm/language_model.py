"""Language-model scoring: a causal self-attention model beside a word unigram base.

What is learnt from the corpus:

* word counts of all training documents, for the base. Each task counts its words by
  64-bit hash and hands them on packed, by range of the hash; each shard sums its own.
* all subwords of every training document, for the attention model: texts are cut into
  consecutive windows in which each subword is predicted once. Training is one pass over
  all these windows, dealt to trainers whose number follows that of the windows; after
  each of `rounds` equal parts of its windows the trainers' weights are averaged in a
  tree. The subword vocabulary is counted on all windows.

The score of a word mixes two distributions with fixed weights: the attention model's over
its subwords (`ATTENTION`), and the discounted training counts of frequent words, whose
discounts and rarer words' share fall back on the attention model again. Both sum to one, so
the score is a probability of the text.

Scoring passes over the documents once, in place. Words whose training count is at least
a 1/`frequent` share of all tokens are at most `frequent` in number; this bounded table
is broadcast. Of the other words each batch of documents asks the shard of their hash once
for their counts, packed, however many documents have them. No task sees more than one
shard, or one input partition's documents.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from . import attention
from .common import Scratch, shards_for
from .packing import Encoder, default_tokenizer

DIM, ROUNDS, RATE = 24, 3, 0.02
#: Weight of the attention model in a word's score, and what is taken off each word's count.
ATTENTION, DISCOUNT = 0.8, 0.5
#: Bound on the number of words whose counts are broadcast.
FREQUENT = 2_000_000
#: Text that one shard of the word counts stands for, and windows of one trainer.
SHARD_MB, WINDOWS_EACH = 16, 120_000
#: Windows of one row on their way to the trainers.
AT_ONCE = 2000
END_HASH = xxh64_intdigest(b"", 29)
REMEMBER = 1_200_000
#: Workers keep so much freed memory: each step makes arrays of a megabyte, whose pages would come anew from the system.
ALLOCATOR = {"MALLOC_MMAP_THRESHOLD_": str(32 << 20), "MALLOC_TRIM_THRESHOLD_": str(64 << 20)}


def _bytes(strings: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of strings, none of them null."""
    _, ends, data = strings.buffers()
    ends = np.frombuffer(ends, np.int64 if pa.types.is_large_string(strings.type) else np.int32)[strings.offset :][: len(strings) + 1].tolist()
    data = data.to_pybytes() if data else b""
    return [data[a:b] for a, b in zip(ends, ends[1:], strict=False)]


class Lexicon(dict):
    """Lower-cased word bytes -> number, with the word's hash and subword ids by number.

    Number 0 is the end of a text. Subwords of all words lie in one array, so pieces()
    strings them together without a loop over words; only new words are encoded one by one.
    """

    def __init__(self, path: str):
        super().__init__()
        self.enc = Encoder(path)
        self.end_id = max(self.enc.added.values(), default=0)
        self.size = self.end_id + 1
        self.clear()

    def clear(self) -> None:
        super().clear()
        self.found, self.fresh = [END_HASH], []  # all words' hashes; words not yet encoded
        self.hash = np.zeros(0, np.uint64)
        self.pool, self.ends = np.array([self.end_id], np.uint32), np.array([0, 1], np.int32)
        self[b""] = 0

    def __missing__(self, word: bytes) -> int:
        self.found.append(xxh64_intdigest(word, 29))
        self.fresh.append(word)
        self[word] = n = len(self.found) - 1
        return n

    def _encode(self) -> None:
        """The subwords of new words, each after a space; a word of letters only is one piece."""
        encode, find, ids, sizes = self.enc.bpe.encode_single_piece, self.enc.find, [], []
        for word in self.fresh:
            if word.isalpha() or (text := word.decode("utf-8", "replace")).isalpha():
                got = encode(b" " + word)
            else:
                got = [i for p in find(" " + text) for i in encode(p.encode())]
            ids += got
            sizes.append(len(got))
        self.fresh.clear()
        self.pool = np.concatenate([self.pool, np.array(ids, np.uint32)])
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(sizes, dtype=np.int32)])

    def numbers_of(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of all texts' words, an end after each text, and how many each text has; each different word is looked up once."""
        split = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
        coded = split.flatten().dictionary_encode()
        known = _bytes(coded.dictionary)
        # white space at a text's borders leaves empty words, which have the end's number
        flat = np.fromiter(map(self.__getitem__, known), np.int64, len(known))[coded.indices.to_numpy()]
        there = flat != 0
        who = np.repeat(np.arange(len(texts)), pc.list_value_length(split).to_numpy())
        size = np.bincount(who[there], minlength=len(texts)) + 1
        out = np.zeros(int(size.sum()), np.int64)
        words = np.ones(len(out), bool)
        words[np.cumsum(size) - 1] = False
        out[words] = flat[there]
        return out, size

    def numbers(self, text: str | None) -> np.ndarray:
        return self.numbers_of(pa.array([text], pa.string()))[0]

    def hashes(self) -> np.ndarray:
        if len(self.hash) < len(self.found):
            self.hash = np.concatenate([self.hash, np.array(self.found[len(self.hash) :], np.uint64)])
        return self.hash

    def pieces(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Subwords of these words, one after the other, and how many each word has."""
        if self.fresh:
            self._encode()
        begin, end = self.ends[numbers], self.ends[numbers + 1]
        size = end - begin
        after = np.cumsum(size)
        at = np.repeat(end - after, size)
        at += np.arange(len(at))
        return self.pool[at].astype(np.int64), size

    def ids(self, numbers: np.ndarray) -> np.ndarray:
        return self.pieces(numbers)[0]


_LEXICA: dict[str, Lexicon] = {}


def lexicon(path: str) -> Lexicon:
    """One a worker; what it has met stays from task to task, up to a bound."""
    if path not in _LEXICA:
        _LEXICA[path] = Lexicon(path)
    lex = _LEXICA[path]
    if len(lex) > REMEMBER:
        lex.clear()
    return lex


def _shard(h: np.ndarray, shards: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


COUNTED = "kind int, shard int, hashes binary, counts binary, windows int"


def packed_type(size: int) -> type:
    """Numbers of `size` subwords and two signs."""
    return np.uint16 if size + 2 < 1 << 16 else np.uint32


def cut(ids: np.ndarray, kind: type = np.uint32) -> np.ndarray:
    """A text's subwords as windows (n, WINDOW + 1) of inputs and the subword after the last, two higher each.

    Windows overlap by the one subword that ends a window and opens the next, so each is
    predicted once; 1 stands before the text's start, 0 after its end.
    """
    size = attention.WINDOW
    n = -(-len(ids) // size)
    seq = np.zeros(n * size + 1, kind)
    seq[0], seq[1 : len(ids) + 1] = 1, ids + 2
    return np.lib.stride_tricks.sliding_window_view(seq, size + 1)[::size]


def _count(path: str, shards: int):
    """Word counts of training documents by shard (kind 0), and all their windows (kind 1, packed)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex, total = lexicon(path), np.zeros(1 << 12, np.int64)
        names = [x.split()[0] for x in COUNTED.split(", ")]
        kind = packed_type(lex.size)
        batch = lambda k, s, h, c, n: pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(s, pa.int32()), pa.array(h, pa.binary()), pa.array(c, pa.binary()), pa.array(n, pa.int32())], names=names)

        def counts() -> pa.RecordBatch:
            at = np.flatnonzero(total)
            h, n = lex.hashes()[at], total[at]
            order = np.argsort(h)
            h, n = h[order], n[order]
            to = np.searchsorted(_shard(h, shards), np.arange(shards + 1))
            some = [s for s in range(shards) if to[s + 1] > to[s]]
            return batch([0] * len(some), some, [h[to[s] : to[s + 1]].tobytes() for s in some], [n[to[s] : to[s + 1]].astype(np.int64).tobytes() for s in some], [None] * len(some))

        for b in batches:
            if len(lex) > REMEMBER:
                yield counts()
                lex.clear()
                total[:] = 0
            if b.num_rows:
                flat, words = lex.numbers_of(b.column("text"))
                ids, size = lex.pieces(flat)
                ends = np.cumsum(size)[np.cumsum(words) - 1]
                windows = [cut(x, kind) for x in np.split(ids, ends[:-1])]
                if len(total) < len(lex.found):
                    total = np.concatenate([total, np.zeros(2 * len(lex.found) - len(total), np.int64)])
                total += np.bincount(flat, minlength=len(total))
                whole = np.concatenate(windows)
                for i in range(0, len(whole), AT_ONCE):
                    part = whole[i : i + AT_ONCE]
                    yield batch([1], [0], [None], [part.tobytes()], [len(part)])
        yield counts()

    return run


def _sum(table: pa.Table) -> pa.Table:
    """The counts of one shard's words."""
    h = np.concatenate([np.frombuffer(x, np.uint64) for x in table.column("hashes").to_pylist()])
    n = np.concatenate([np.frombuffer(x, np.int64) for x in table.column("counts").to_pylist()])
    known, at = np.unique(h, return_inverse=True)
    total = np.bincount(at, n, len(known)).astype(np.int64)
    return pa.table([table.column("shard").slice(0, 1).combine_chunks(), pa.array([known.tobytes()], pa.binary()), pa.array([total.tobytes()], pa.binary()), pa.array([len(known)]), pa.array([int(total.sum())])], names=["shard", "hashes", "counts", "words", "tokens"])


def _frequent(least: int):
    """Words of each shard with a count of at least `least`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for h, n in zip(b.column("hashes").to_pylist(), b.column("counts").to_pylist(), strict=True):
                h, n = np.frombuffer(h, np.uint64), np.frombuffer(n, np.int64)
                at = n >= least
                yield pa.RecordBatch.from_arrays([pa.array([h[at].tobytes()], pa.binary()), pa.array([n[at].tobytes()], pa.binary())], names=["hashes", "counts"])

    return run


def _windows(blob: bytes, size: int) -> np.ndarray:
    """Windows as cut() packs them: -1 before the text's start, -2 after its end."""
    return np.frombuffer(blob, packed_type(size)).reshape(-1, attention.WINDOW + 1).astype(np.int32) - 2


def _learn(sent, rate: float, turn: int, turns: int):
    """One trainer's pass over one of `turns` equal parts of its windows."""

    def run(table: pa.Table) -> pa.Table:
        v, w = sent.value
        mine = np.concatenate([_windows(x, v.size) for x in sorted(table.column("counts").to_pylist())])
        # the same order in each turn, so that the parts make up all windows
        part = mine[np.random.default_rng(len(mine)).permutation(len(mine))[turn::turns]]
        w = attention.train(v, w, part, rate=rate, seed=turn)
        return pa.table([pa.array([table.column("trainer")[0].as_py()], pa.int32()), pa.array([len(part)], pa.int64()), pa.array([pickle.dumps(w)], pa.binary())], names=["trainer", "n", "weights"])

    return run


def _mean(table: pa.Table) -> pa.Table:
    """The mean of some trainers' weights, by their windows."""
    n, total = 0, None
    for k, blob in sorted(zip(table.column("n").to_pylist(), table.column("weights").to_pylist(), strict=True)):
        part = pickle.loads(blob)
        total = {x: k * y.astype(np.float64) for x, y in part.items()} if total is None else {x: total[x] + k * y for x, y in part.items()}
        n += k
    out = {x: (y / n).astype(np.float32) for x, y in total.items()}
    return pa.table([pa.array([table.column("trainer")[0].as_py()], pa.int32()), pa.array([n], pa.int64()), pa.array([pickle.dumps(out)], pa.binary())], names=["trainer", "n", "weights"])


def fit_attention(windows: DataFrame, size: int, scratch: Scratch, *, dim: int, rounds: int, rate: float, windows_each: int) -> tuple[attention.Vocabulary, dict]:
    """Train on all windows once; the mean of the trainers' weights after each of `rounds` parts.

    The `counts` column of windows holds packed windows, `AT_ONCE` a row at most, and the
    column `windows` their number.
    """
    spark = windows.sparkSession

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(size, np.int64)
        for b in batches:
            for blob in b.column("counts").to_pylist():
                w = _windows(blob, size)[:, 1:]  # each subword once
                n += np.bincount(w[w >= 0], minlength=size)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], names=["id", "n"])

    # one row per subword of the tokenizer, which is a bound
    counts = np.zeros(size, np.int64)
    for r in windows.select("counts").mapInArrow(tally, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        counts[r.id] = r.n
    rows = windows.agg(F.sum("windows")).first()[0] or 0
    v = attention.Vocabulary(counts)
    w = attention.start(v, dim)
    trainers = shards_for(rows, windows_each)
    dealt = windows.select("counts", F.pmod(F.xxhash64("counts"), F.lit(trainers)).cast("int").alias("trainer")).repartition(trainers, "trainer")
    turns = max(1, min(rounds, rows))
    for i in range(turns if rows else 0):
        sent = spark.sparkContext.broadcast((v, w))

        kind = "trainer int, n long, weights binary"
        left, part = trainers, dealt.groupBy("trainer").applyInArrow(_learn(sent, rate / (1 + i), i, turns), kind)
        while left > 1:
            left = -(-left // 16)
            part = part.withColumn("trainer", F.col("trainer") % left).groupBy("trainer").applyInArrow(_mean, kind)
        with scratch.action():
            w = pickle.loads(part.first().weights)
    return v, w


DOC = "part long, nth long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double"
#: Rarer words of a batch of documents: their hashes in one shard, and (document, place of the hash, times) of each pair.
SCORED = "shard int, ask long, hashes binary, docs binary, places binary, times binary, " + DOC


def _score(path: str, sent, shards: int):
    """A row for each document (shard -1), and for each batch and shard a row of its rarer words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, count, tokens, v, w = sent.value
        log_count, share = np.log10(count + 0.5), np.append(np.maximum(count - DISCOUNT, 0) / max(1, tokens), 0.0)
        back = ATTENTION + (1 - ATTENTION) * (1 - share.sum())
        scorer = attention.Scorer(v, w)
        lex, part, nth = lexicon(path), TaskContext.get().partitionId(), 0
        slot = np.zeros(0, np.int64)  # of each word number its place among the frequent, or -1
        names = [x.split()[0] for x in SCORED.split(", ")]
        kinds = {"binary": pa.binary(), "int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "double": pa.float64()}
        types = [kinds[x.split()[1]] for x in SCORED.split(", ")]
        for b in batches:
            if len(lex) > REMEMBER:
                lex.clear()
                slot = slot[:0]
            n = b.num_rows
            if not n:
                continue
            flat, size = lex.numbers_of(b.column("text"))
            h = lex.hashes()
            if len(slot) < len(h):
                fresh = h[len(slot) :]
                at = np.minimum(np.searchsorted(known, fresh), len(known) - 1) if len(known) else np.zeros(len(fresh), np.int64)
                slot = np.concatenate([slot, np.where(known[at] == fresh, at, -1) if len(known) else np.full(len(fresh), -1)])
            who = np.repeat(np.arange(n), size)
            at = slot[flat]
            there = at >= 0
            base = np.bincount(who[there], log_count[at[there]], n)
            n_known = np.bincount(who[there], minlength=n)
            ids, pieces = lex.pieces(flat)
            lp = scorer.log_probs(ids, np.bincount(who, pieces, n).astype(np.int64))
            word = np.add.reduceat(lp, np.cumsum(pieces) - pieces)
            # place -1, of words that aren't frequent, has the share 0
            word = np.logaddexp(np.log(back) + word, np.log(np.maximum((1 - ATTENTION) * share[at], 1e-300)))
            score = np.bincount(who, word, n) / np.log(10)
            cols = [pa.array([-1] * n, types[0]), *(pa.nulls(n, t) for t in types[1:6]), pa.array([part] * n), pa.array(np.arange(nth, nth + n)), b.column("doc_id"), b.column("held_out"), pa.array(size), pa.array(n_known), pa.array(base), pa.array(score)]
            yield pa.RecordBatch.from_arrays([c.cast(t) for c, t in zip(cols, types, strict=True)], names=names)
            rare, doc = h[flat[~there]], who[~there] + nth
            order = np.lexsort((doc, rare))
            rare, doc = rare[order], doc[order]
            fresh = np.append(True, (rare[1:] != rare[:-1]) | (doc[1:] != doc[:-1]))[: len(rare)]
            at = np.flatnonzero(fresh)
            times, rare, doc = np.diff(at, append=len(rare)), rare[at], doc[at]
            first = np.append(True, rare[1:] != rare[:-1])[: len(rare)]
            hashes, place = rare[first], np.cumsum(first) - 1
            cut = np.searchsorted(_shard(hashes, shards), np.arange(shards + 1))
            pairs = np.searchsorted(place, cut)
            some = [s for s in range(shards) if cut[s + 1] > cut[s]]
            blob = lambda x, ends, s, kind: x[ends[s] : ends[s + 1]].astype(kind).tobytes()
            rows = [some, [nth] * len(some), [blob(hashes, cut, s, np.uint64) for s in some], [blob(doc, pairs, s, np.uint32) for s in some], [blob(place - cut[s], pairs, s, np.uint32) for s in some], [blob(times, pairs, s, np.uint32) for s in some], [part] * len(some)]
            yield pa.RecordBatch.from_arrays([*(pa.array(x, t) for x, t in zip(rows, types, strict=False)), *(pa.nulls(len(some), t) for t in types[7:])], names=names)
            nth += n

    return run


ASKED = "part long, ask long, shard int, found binary"


def _rare(asks: pa.Table, counts: pa.Table) -> pa.Table:
    """One shard: the counts of the words that each batch asks for."""
    known = np.frombuffer(counts.column("hashes")[0].as_py(), np.uint64) if counts.num_rows else np.zeros(0, np.uint64)
    n = np.frombuffer(counts.column("counts")[0].as_py(), np.int64) if counts.num_rows else np.zeros(0, np.int64)
    out = []
    for blob in asks.column("hashes").to_pylist():
        h = np.frombuffer(blob, np.uint64)
        at = np.minimum(np.searchsorted(known, h), len(known) - 1) if len(known) else None
        out.append((np.where(known[at] == h, n[at], 0) if at is not None else np.zeros(len(h), np.int64)).astype(np.int64).tobytes())
    return pa.table([asks.column("part"), asks.column("ask"), asks.column("shard"), pa.array(out, pa.binary())], names=["part", "ask", "shard", "found"])


def _finish(tokens: int, words: int):
    """One input partition's documents, with what the shards found for them."""
    each = np.log10(tokens + 0.5 * (words + 1))

    def run(rows: pa.Table, found: pa.Table) -> pa.Table:
        kind = rows.column("shard").to_numpy()
        docs, asks = rows.filter(pa.array(kind == -1)), rows.filter(pa.array(kind >= 0))
        nth = docs.column("nth").to_numpy()
        base, known = docs.column("base").to_numpy().copy(), docs.column("n_known").to_numpy().copy()
        place = np.zeros(int(nth.max()) + 1 if len(nth) else 1, np.int64)
        place[nth] = np.arange(len(nth))
        told = {(a, s): x for a, s, x in zip(*(found.column(c).to_pylist() for c in ("ask", "shard", "found")), strict=True)}
        # in one order, so that sums come out alike each time
        for a, s, d, p, t in sorted(zip(*(asks.column(c).to_pylist() for c in ("ask", "shard", "docs", "places", "times")), strict=True)):
            c = np.frombuffer(told[a, s], np.int64)[np.frombuffer(p, np.uint32)]
            at, times = place[np.frombuffer(d, np.uint32)], np.frombuffer(t, np.uint32)
            base += np.bincount(at, times * np.log10(c + 0.5), len(base))
            known += np.bincount(at, times * (c > 0), len(base)).astype(np.int64)
        size = docs.column("n_tokens").to_numpy()
        train = pa.array(np.full(len(size), tokens))
        return pa.table([docs.column("doc_id"), docs.column("held_out"), docs.column("n_tokens"), pa.array(known), train, pa.array(base - size * each), docs.column("score")], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return run


def score_texts(docs: DataFrame, *, tokenizer: str | None = None, dim: int = DIM, rounds: int = ROUNDS, rate: float = RATE, frequent: int = FREQUENT, shard_mb: float = SHARD_MB, windows_each: int = WINDOWS_EACH) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for each row of docs.

    Scores are log10 probabilities of the whole text. Null and empty texts are one token,
    the end. A null doc_id is not held out, so it trains; repeated rows train and are
    scored each. Without training rows the base knows no token and the model is uniform.
    No rows: none back. Columns other than doc_id and text are not read.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "lm")
    for name, value in ALLOCATOR.items():
        spark.sparkContext.environment.setdefault(name, value)
    path = tokenizer or default_tokenizer()
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1, F.lit(False))
    rows = docs.select("doc_id", "text", held.alias("held_out"))
    shards = shards_for(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0, shard_mb * (1 << 20))
    train = rows.where(~F.col("held_out")).select("text")
    got = scratch.keep(train.mapInArrow(_count(path, shards), COUNTED), "counted")
    summed = got.where("kind = 0").select("shard", "hashes", "counts").repartition(shards, "shard").groupBy("shard").applyInArrow(_sum, "shard int, hashes binary, counts binary, words long, tokens long")
    summed = scratch.keep(summed, "summed")
    words, tokens = (x or 0 for x in summed.agg(F.sum("words"), F.sum("tokens")).first())
    size = max(Encoder(path).added.values(), default=0) + 1
    v, w = fit_attention(got.where("kind = 1"), size, scratch, dim=dim, rounds=rounds, rate=rate, windows_each=windows_each)
    # words with at least this count are no more than `frequent`
    least = max(1, -(-tokens // frequent))
    often = summed.select("hashes", "counts").mapInArrow(_frequent(least), "hashes binary, counts binary").collect()
    known = np.concatenate([np.frombuffer(r.hashes, np.uint64) for r in often] or [np.zeros(0, np.uint64)])
    count = np.concatenate([np.frombuffer(r.counts, np.int64) for r in often] or [np.zeros(0, np.int64)])
    order = np.argsort(known)
    sent = spark.sparkContext.broadcast((known[order], count[order], tokens, v, w))
    scored = scratch.keep(rows.mapInArrow(_score(path, sent, shards), SCORED), "scored")
    asks = scored.where("shard >= 0").select("shard", "part", "ask", "hashes").repartition(shards, "shard")
    found = asks.groupBy("shard").cogroup(summed.select("shard", "hashes", "counts").groupBy("shard")).applyInArrow(_rare, ASKED)
    rows = scored.select("shard", "ask", "docs", "places", "times", *[x.split()[0] for x in DOC.split(", ")])
    return rows.groupBy("part").cogroup(found.groupBy("part")).applyInArrow(_finish(tokens, words), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op4_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attention and unigram scores of all documents."""
    return score_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op4_language_model": op4_language_model}
ORACLES: dict[str, str] = {}
