"""Substring dedup with repeated-phrase automata.

A word is removed where a window of `window` words that covers it also starts in a
document with a smaller doc_id.

1. Documents are dealt in order of doc_id to bundles of bounded text: a smaller bundle
   holds no larger doc_id. The borders come from the sizes of documents alone; each step
   below deals the texts by them anew, and nothing but text, hashes and phrases moves.
2. Each bundle hands on the 64-bit hashes of its distinct windows, packed, by range of
   the hash. Each shard answers with two bits a hash: a smaller bundle has the window,
   or this bundle is the first of several.
3. Recurring passages are confirmed by their words. A bundle covers each run of windows
   that an earlier document may have by tiles (windows at a stride of the window length,
   and the last one) and asks for their words; a bundle that is the first to have a window
   hands out its words, in blocks of a run, with the document that has them. The join
   of both is the phrase table: words as the first document has them, and that document.
4. Each bundle compiles the phrases asked for into Aho-Corasick automata, a bounded number
   of words at a time, and streams all its documents through each: every occurrence, in a
   document after the one that owns the phrase, is removed.

Hashes only say what to ask for; what is removed equals, word by word, what the automata
found. Two different windows with one hash remove nothing by that. (Where a window shares
its hash with another one before it, a repeat of it may stay; of n windows before it that
has a probability of n / 2^64.)
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import Scratch, shards_for

WINDOW = 13
#: Text of a bundle, and bundles whose hashes one shard holds.
BUNDLE_MB, BUNDLES_A_SHARD = 8, 3
#: Words in the phrases of one automaton, and windows in a block of a run.
AUTOMATON_WORDS, BLOCK = 400_000, 64
_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xFF51AFD7ED558CCD)


class Lexicon(dict):
    """Word bytes -> number; hashes() gives the words' 64-bit hashes by number."""

    def __init__(self):
        super().__init__()
        self.words: list[bytes] = []
        self.table = np.zeros(0, np.uint64)

    def __missing__(self, word: bytes) -> int:
        self.words.append(word)
        self[word] = n = len(self)
        return n

    def numbers(self, text: str | None) -> np.ndarray:
        words = (text or "").encode("utf-8", "replace").split()
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))

    def hashes(self, ids: np.ndarray) -> np.ndarray:
        if len(self.table) < len(self.words):
            fresh = [xxh64_intdigest(w, 11) for w in self.words[len(self.table) :]]
            self.table = np.concatenate([self.table, np.array(fresh, np.uint64)])
        return self.table[ids]

    def joined(self, ids: np.ndarray) -> str:
        return b" ".join([self.words[i] for i in ids.tolist()]).decode("utf-8", "replace")


def window_hashes(h: np.ndarray, window: int) -> np.ndarray:
    """A hash of each run of `window` words, given the words' hashes."""
    n = len(h) - window + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(window):
        out *= _ODD
        out += h[j : j + n]
    out ^= out >> np.uint64(32)
    out *= _MIX
    out ^= out >> np.uint64(29)
    return out


def _fresh(h: np.ndarray) -> np.ndarray:
    """Where a sorted array has a value for the first time."""
    out = np.ones(len(h), bool)
    np.not_equal(h[1:], h[:-1], out=out[1:])
    return out


def pack_sorted(h: np.ndarray) -> bytes:
    """Sorted hashes as differences, in as many bytes each as the largest needs."""
    d = np.diff(h, prepend=np.uint64(0))
    width = max(1, -(-int(d.max()).bit_length() // 8)) if len(d) else 1
    return bytes([width]) + np.ascontiguousarray(d.view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def unpack_sorted(blob: bytes) -> np.ndarray:
    width = blob[0]
    raw = np.frombuffer(blob, np.uint8, offset=1).reshape(-1, width)
    full = np.zeros((len(raw), 8), np.uint8)
    full[:, :width] = raw
    return np.cumsum(full.view(np.uint64).ravel(), dtype=np.uint64)


class Borders:
    """Which bundle a document lies in: 8 bytes of border for each bundle.

    A doc_id that fills several bundles is a border several times; its rows are dealt to
    these by a hash of the text. Rows without a doc_id fill the last bundles.
    """

    def __init__(self, docs: DataFrame, bundle_mb: float):
        room = bundle_mb * (1 << 20)
        sizes = docs.groupBy("doc_id").agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 64).alias("n"))

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = 0
            for b in batches:
                ids, n = b.column("doc_id").to_numpy(), b.column("n").to_numpy()
                level = (held + np.cumsum(n)) // room
                times = np.diff(level, prepend=held // room).astype(np.int64)
                held = held + int(n.sum())
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, times))], names=["doc_id"])

        known = sizes.where("doc_id is not null").repartitionByRange("doc_id").sortWithinPartitions("doc_id")
        self.at = np.sort(np.array([r.doc_id for r in known.mapInArrow(cut, "doc_id long").collect()], np.int64))
        nameless = sizes.where("doc_id is null").agg(F.sum("n")).first()[0] or 0
        self.last = shards_for(nameless, room) if nameless else 0
        self.n = len(self.at) + 1 + self.last

    def deal(self, docs: DataFrame, *columns) -> DataFrame:
        """(bundle, shared, columns): shared rows' doc_id may lie in several bundles."""
        at, last = self.at, self.last

        @F.pandas_udf("long")
        def place(doc_id: pd.Series, missing: pd.Series, h: pd.Series) -> pd.Series:
            ids, null, h = doc_id.to_numpy(np.int64), missing.to_numpy(bool), h.to_numpy(np.int64)
            low, high = np.searchsorted(at, ids, "left"), np.searchsorted(at, ids, "right")
            low, high = np.where(null, len(at) + 1, low), np.where(null, len(at) + last, high)
            return pd.Series(2 * (low + h % (high - low + 1)) + (high > low))

        to = place(F.coalesce("doc_id", F.lit(0).cast("long")), F.isnull("doc_id"), F.xxhash64("text"))
        dealt = docs.select(*columns, to.alias("to"))
        return dealt.select(F.floor(F.col("to") / 2).cast("int").alias("bundle"), (F.col("to") % 2 == 1).alias("shared"), *[c for c in dealt.columns if c != "to"])


def _emit(window: int, shards: int):
    """Step 2, a bundle's side: its distinct window hashes by shard."""

    def run(table: pa.Table) -> pa.Table:
        lex = Lexicon()
        numbers = [lex.numbers(t) for t in table.column("text").to_pylist()]
        h = np.concatenate([window_hashes(lex.hashes(ids), window) for ids in numbers])
        h.sort()
        h = h[_fresh(h)]
        cut = np.searchsorted(h, np.array([(s << 64) // shards for s in range(1, shards)], np.uint64))
        parts = [(s, pack_sorted(x)) for s, x in enumerate(np.split(h, cut)) if len(x)]
        bundle = table.column("bundle")[0].as_py()
        return pa.table([pa.array([s for s, _ in parts], pa.int32()), pa.array([bundle] * len(parts), pa.int32()), pa.array([b for _, b in parts], pa.binary())], names=["shard", "bundle", "blob"])

    return run


def _answer(table: pa.Table) -> pa.Table:
    """Step 2, a shard's side: for each bundle's hashes two bits, `again`: a smaller bundle has it, `opens`: first of several."""
    table = table.sort_by("bundle")
    lists = [unpack_sorted(b) for b in table.column("blob").to_pylist()]
    size = [len(x) for x in lists]
    h = np.concatenate(lists)
    del lists
    order = np.argsort(h, kind="stable")  # equal hashes stay in the order of bundles
    same = np.zeros(len(h) + 1, bool)
    s = h[order]
    np.equal(s[1:], s[:-1], out=same[1:-1])
    again, opens = np.empty(len(h), bool), np.empty(len(h), bool)
    again[order] = same[:-1]
    opens[order] = same[1:] & ~same[:-1]
    cut = np.cumsum(size)[:-1]
    bits = lambda x: pa.array([np.packbits(p).tobytes() for p in np.split(x, cut)], pa.binary())
    return pa.table([table.column("bundle"), table.column("shard"), pa.array(size, pa.int64()), bits(again), bits(opens)], names=["bundle", "shard", "n", "again", "opens"])


ANSWER = "bundle int, shard int, n long, again binary, opens binary"
ASK, WORD_AT, RUN, LOCAL = range(4)
MARK = "kind int, h long, block long, at int, words string, doc_id long, bundle int"


def ranks(ids: pa.ChunkedArray) -> np.ndarray:
    """Dense ranks of doc_ids; rows without one come after all others."""
    null = ids.is_null().to_numpy()
    value = ids.fill_null(0).to_numpy()
    known = np.unique(value[~null])
    return np.where(null, len(known), np.searchsorted(known, value)).astype(np.int64)


def tiles(open_: np.ndarray, window: int, every: bool) -> np.ndarray:
    """Windows that cover all words of the runs of open windows: each run's first, every window-th, and last."""
    at = np.flatnonzero(open_)
    if every or not len(at):
        return at
    first = np.append(True, np.diff(at) > 1)
    nth = np.arange(len(at)) - np.maximum.accumulate(np.where(first, np.arange(len(at)), 0))
    return at[(nth % window == 0) | np.append(first[1:], True)]


def _survey(window: int, block: int):
    """Step 3, a bundle's side: hashes whose words it asks for, words it hands out, and its own repeats."""

    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        bundle = docs.column("bundle")[0].as_py() if docs.num_rows else 0
        rank = ranks(docs.column("doc_id"))
        order = np.argsort(rank, kind="stable")
        lex = Lexicon()
        texts, ids, shared = (docs.column(c).to_pylist() for c in ("text", "doc_id", "shared"))
        numbers = [lex.numbers(texts[i]) for i in order.tolist()]
        hashed = [window_hashes(lex.hashes(x), window) for x in numbers]
        rank = rank[order]
        size = np.array([len(x) for x in hashed], np.int64)
        begin = np.cumsum(size) - size
        h = np.concatenate([*hashed, np.zeros(0, np.uint64)])
        del hashed
        # documents lie in order of rank, so the first of equal hashes is the first document's
        by = np.argsort(h, kind="stable")
        start = np.flatnonzero(_fresh(h[by]))
        first = by[start]
        told = sorted(zip(*(answers.column(c).to_pylist() for c in ("shard", "again", "opens", "n")), strict=True))
        flag = lambda k: np.concatenate([np.zeros(0, bool), *(np.unpackbits(np.frombuffer(x[k], np.uint8), count=x[3]).astype(bool) for x in told)])
        again, opens = flag(1), flag(2)
        if len(start) != len(again):
            raise RuntimeError(f"{len(start)} distinct windows, {len(again)} answers")
        group = np.empty(len(h), np.int64)
        group[by] = np.repeat(np.arange(len(start)), np.diff(start, append=len(h)))
        who = np.repeat(np.arange(len(size)), size)
        outside = again[group]
        open_ = outside | (rank[who[first]][group] < rank[who])
        picked = [np.zeros(0, np.int64)]
        for i in np.unique(who[open_]).tolist():
            picked.append(begin[i] + tiles(open_[begin[i] : begin[i] + size[i]], window, shared[order[i]]))
        picked = np.concatenate(picked)
        asks = np.unique(h[picked[outside[picked]]])
        local = np.unique(first[group[picked[~outside[picked]]]])
        words = lambda w, n: lex.joined(numbers[who[w]][w - begin[who[w]] : w - begin[who[w]] + n])
        given = np.sort(first[opens])
        fresh = np.append(True, (np.diff(given) > 1) | (np.diff(who[given]) > 0))[: len(given)]
        run_start = np.maximum.accumulate(np.where(fresh, np.arange(len(given)), 0)) if len(given) else given
        place = (np.arange(len(given)) - run_start) % block
        heads = np.flatnonzero(place == 0)
        name = (np.int64(bundle) << np.int64(32)) + np.cumsum(place == 0) - 1
        length = np.diff(heads, append=len(given))
        kinds = [np.full(len(asks), ASK), np.full(len(given), WORD_AT), np.full(len(heads), RUN), np.full(len(local), LOCAL)]
        null = lambda n: [None] * len(n)
        owner = lambda ws: [ids[order[who[w]]] for w in ws.tolist()]
        return pa.table(
            [
                pa.array(np.concatenate(kinds), pa.int32()),
                pa.array([*asks.view(np.int64).tolist(), *h[given].view(np.int64).tolist(), *null(heads), *null(local)], pa.int64()),
                pa.array([*null(asks), *name.tolist(), *name[heads].tolist(), *null(local)], pa.int64()),
                pa.array([*null(asks), *place.tolist(), *null(heads), *null(local)], pa.int32()),
                pa.array([*null(asks), *null(given), *(words(w, n + window - 1) for w, n in zip(given[heads].tolist(), length.tolist(), strict=True)), *(words(w, window) for w in local.tolist())], pa.string()),
                pa.array([*null(asks), *null(given), *owner(given[heads]), *owner(local)], pa.int64()),
                pa.array([bundle] * sum(map(len, kinds)), pa.int32()),
            ],
            names=[x.split()[0] for x in MARK.split(", ")],
        )

    return run


def phrase_table(marks: DataFrame, window: int) -> DataFrame:
    """(bundle, words, owner): what each bundle asked for, with the words of the first document that has it."""
    asks = marks.where(F.col("kind") == ASK).select("h", "bundle")
    given = marks.where(F.col("kind") == WORD_AT).select("h", "block", "at")
    runs = marks.where(F.col("kind") == RUN).select("block", "words", "doc_id")
    words = F.array_join(F.slice(F.split("words", " "), F.col("at") + 1, window), " ")
    found = asks.join(given, "h").select("bundle", "block", "at").join(runs, "block").select("bundle", words.alias("words"), F.col("doc_id").alias("owner"))
    return found.unionByName(marks.where(F.col("kind") == LOCAL).select("bundle", "words", F.col("doc_id").alias("owner")))


#: Symbols of a digit: an automaton's node looks through its edges one by one.
_BASE = 32


def locate(numbers: list[np.ndarray], before: list[int | float], phrases: dict[tuple, int], window: int, automaton_words: int = AUTOMATON_WORDS) -> list[np.ndarray]:
    """For each document a mask of the words that a phrase of an earlier document covers.

    phrases: word numbers -> the smallest doc_id that owns them; before: the documents' doc_ids
    (infinite where there is none).
    """
    masks = [np.zeros(len(ids), bool) for ids in numbers]
    todo = list(phrases.items())
    step = max(1, automaton_words // window)
    top = max((int(ids.max()) for ids in numbers if len(ids)), default=0) + 1
    for at in range(0, len(todo), step):
        part = todo[at : at + step]
        words = np.array([w for w, _ in part], np.int64)
        owners = [o for _, o in part]
        known, sign = np.unique(words, return_inverse=True)
        digits = 1
        while _BASE**digits <= len(known):
            digits += 1
        # a word is `digits` characters, each place with an alphabet of its own; \x01 stands for words of no phrase
        place = np.arange(1, len(known) + 1)[:, None] // _BASE ** np.arange(digits - 1, -1, -1)[None] % _BASE
        char = (2 + np.arange(digits) * _BASE + place).astype(np.uint32)
        code = np.ones((top, digits), np.uint32)
        code[known] = char
        auto = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for i, key in enumerate(char[sign.reshape(words.shape)].reshape(len(part), -1)):
            auto.add_word(key.tobytes().decode("utf-32-le"), i)
        auto.make_automaton()
        for ids, mask, doc in zip(numbers, masks, before, strict=True):
            if len(ids) < window:
                continue
            ends = [e for e, i in auto.iter(code[ids].tobytes().decode("utf-32-le")) if owners[i] < doc]
            if ends:
                cover = np.zeros(len(ids) + 1, np.int32)
                ends = np.array(ends) // digits
                np.add.at(cover, ends - window + 1, 1)
                np.add.at(cover, ends + 1, -1)
                mask |= np.cumsum(cover[:-1]) > 0
    return masks


def _clean(window: int, columns: list[str], digest: bool, automaton_words: int):
    """Step 4: a bundle's documents and its phrases."""

    def run(docs: pa.Table, phrases: pa.Table) -> pa.Table:
        rows = docs.column("row").combine_chunks()
        texts = rows.field("text").to_pylist()
        ids = rows.field("doc_id").to_pylist()
        lex = Lexicon()
        numbers = [lex.numbers(t) for t in texts]
        wanted: dict[tuple, int] = {}
        for words, owner in zip(phrases.column("words").to_pylist(), phrases.column("owner").to_pylist(), strict=True):
            key = tuple(lex.get(w, -1) for w in words.encode().split(b" "))
            # a phrase with a word that the bundle lacks had only its hash in common
            if owner is not None and min(key) >= 0 and len(key) == window:
                wanted[key] = min(owner, wanted.get(key, owner))
        masks = locate(numbers, [np.inf if i is None else i for i in ids], wanted, window, automaton_words)
        kept = [b" ".join([w for w, gone in zip((t or "").encode("utf-8", "replace").split(), m.tolist(), strict=True) if not gone]) if m.any() else None for t, m in zip(texts, masks, strict=True)]
        if digest:
            flat = (b" ".join((t or "").encode("utf-8", "replace").split()) if k is None else k for t, k in zip(texts, kept, strict=True))
            sha = [hashlib.sha256(x).hexdigest() for x in flat]
            return pa.table([rows.field("doc_id"), pa.array([len(m) for m in masks], pa.int64()), pa.array([int(m.sum()) for m in masks], pa.int64()), pa.array(sha, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])
        new = pa.array([t if k is None else k.decode("utf-8") for t, k in zip(texts, kept, strict=True)], rows.field("text").type)
        return pa.table([new if c == "text" else rows.field(c) for c in columns], names=columns)

    return run


def _deduplicate(docs: DataFrame, schema, digest: bool, *, window: int = WINDOW, bundle_mb: float = BUNDLE_MB, automaton_words: int = AUTOMATON_WORDS, block: int = BLOCK) -> DataFrame:
    scratch = Scratch(docs.sparkSession, "passages")
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    borders = Borders(narrow, bundle_mb)
    n = borders.n
    shards = shards_for(n, BUNDLES_A_SHARD)
    texts = borders.deal(narrow, "text").drop("shared").repartition(n, "bundle")
    blobs = texts.groupBy("bundle").applyInArrow(_emit(window, shards), "shard int, bundle int, blob binary")
    # one row a bundle in each group: a shard holds its share of all distinct windows
    answers = scratch.keep(blobs.repartition(shards, "shard").groupBy("shard").applyInArrow(_answer, ANSWER), "answers")
    dealt = borders.deal(narrow, "doc_id", "text").repartition(n, "bundle")
    marks = scratch.keep(dealt.groupBy("bundle").cogroup(answers.groupBy("bundle")).applyInArrow(_survey(window, block), MARK), "marks")
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    dealt = borders.deal(whole, "row").drop("shared").repartition(n, "bundle")
    out = dealt.groupBy("bundle").cogroup(phrase_table(marks, window).groupBy("bundle")).applyInArrow(_clean(window, docs.columns, digest, automaton_words), schema)
    out = scratch.keep(out, "out")
    scratch.drop("answers", "marks")
    return out


def removed_words(docs: DataFrame, **params) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) for each row of docs.

    Null and empty texts have no words; texts of fewer words than the window lose none.
    Rows with a null doc_id come after all others and, like rows that share a doc_id,
    count as one document: their windows don't remove each other. Repeated rows are each
    judged. No rows: none back. Columns other than doc_id and text are not read.
    """
    return _deduplicate(docs.select("doc_id", "text"), "doc_id long, n_words long, n_removed long, kept_sha256 string", True, **params)


def without_repeats(docs: DataFrame, **params) -> DataFrame:
    """docs, with repeated words taken out of text; a text that loses none stays as it is.

    Rows are judged as by removed_words(); none is dropped, and a text that loses all its
    words is empty. Other columns, whatever their names, stay as they are.
    """
    return _deduplicate(docs, docs.schema, False, **params)


def op7_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the words of windows that a document before them has."""
    return removed_words(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op7_passages": op7_passages}
ORACLES: dict[str, str] = {}
