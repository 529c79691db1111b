"""Quality classifier: hashed word n-gram logistic regression, trained by FTRL-proximal.

A document is a sparse vector of hashed n-grams: its words (lower case), and n-grams of
one to three word shapes, where a shape is a word with each run of capitals, small
letters, digits or one other sign put as one sign, and a repeat of the word before as
"=". Shapes let the model see how words are written where the words themselves are
rare. A feature's value is its share of the document's n-grams, scaled by `SCALE`.

Training takes a bounded sample of labelled rows (`sample_rows`, by hash of the key, so
the same rows each run); its texts are found through a join with that bounded list, and
the weights (2**bits numbers) are the only thing that is broadcast. Scoring is one pass
over the documents in place, without a shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import Scratch, pieces_of

BITS = 18
SCALE = 12.0
#: Words that a worker remembers before it forgets them all and starts again.
REMEMBER = 400_000
_RUN = re.compile(r"(.)\1+")
_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def shape(word: str) -> str:
    """'THEREON!!' -> 'A!', 'then' -> 'a', '|' -> '|'."""
    signs = "".join("A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c for c in word)
    return _RUN.sub(r"\1", signs)[:12]


class Words(dict):
    """Word bytes -> row of the hash table; grows as words are met."""

    def __init__(self):
        super().__init__()
        self.rows: list[tuple[int, int]] = []
        self.table = np.zeros((0, 2), np.uint64)

    def __missing__(self, word: bytes) -> int:
        text = word.decode("utf-8", "replace")
        self.rows.append((xxh64_intdigest(text.lower().encode(), 1), xxh64_intdigest(shape(text).encode(), 2)))
        self[word] = row = len(self)
        return row

    def hashes(self, ids: np.ndarray) -> np.ndarray:
        if len(self.table) < len(self.rows):
            self.table = np.concatenate([self.table, np.array(self.rows[len(self.table) :], np.uint64).reshape(-1, 2)])
        return self.table[ids]


def _slot(h: np.ndarray, bits: int) -> np.ndarray:
    h = h * _M1
    h ^= h >> np.uint64(29)
    return ((h * _M2) >> np.uint64(64 - bits)).astype(np.int32)


def features(text: str | None, words: Words, bits: int) -> np.ndarray:
    """Slots of the document's n-grams, repeats included; empty for no words."""
    found = (text or "").encode("utf-8", "replace").split()
    if not found:
        return np.zeros(0, np.int32)
    if len(words) > REMEMBER:
        words.__init__()
        words.clear()
    ids = np.fromiter(map(words.__getitem__, found), np.int64, len(found))
    h = words.hashes(ids)
    s = h[:, 1].copy()
    s[1:][ids[1:] == ids[:-1]] = np.uint64(77)
    grams = [h[:, 0], s * _M3]
    if len(s) > 1:
        grams.append(s[:-1] * _M1 + s[1:])
    if len(s) > 2:
        grams.append((s[:-2] * _M2 + s[1:-1]) * _M3 + s[2:])
    return _slot(np.concatenate(grams), bits)


def vector(slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct slots and their values; slot 0 with value 1 is the intercept's."""
    at, n = np.unique(slots, return_counts=True)
    value = SCALE * n / max(1, len(slots))
    return np.append(at[at > 0], 0), np.append(value[at > 0], 1.0)


def train_ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], bits: int = BITS, *, epochs: int = 4, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.02, l2: float = 0.5) -> np.ndarray:
    """Weights after per-coordinate follow-the-regularised-leader updates over the rows."""
    z, n = np.zeros(1 << bits), np.zeros(1 << bits)
    solve = lambda z, n: np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))
    for _ in range(epochs):
        for at, value, label in rows:
            w = solve(z[at], n[at])
            g = (1 / (1 + np.exp(-np.clip(w @ value, -35, 35))) - label) * value
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - sigma * w
            n[at] += g * g
    return solve(z, n)


def training_rows(docs: DataFrame, labels: DataFrame, sample_rows: int, bits: int) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """Vectors of a bounded sample of labelled documents, in order of a hash of the key."""
    spark = docs.sparkSession
    known = labels.where("doc_id is not null and quality is not null and pmod(crc32(cast(cast(doc_id as string) as binary)), 5) <> 0")
    known = known.groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("label"))
    picked = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for b in batches:
            slots = [vector(features(t, words, bits)) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("label"), pa.array([at.astype(np.int32).tobytes() for at, _ in slots], pa.binary()), pa.array([v.astype(np.float32).tobytes() for _, v in slots], pa.binary())],
                names=["doc_id", "label", "at", "value"],
            )

    # picked has sample_rows rows at most, so this broadcast is bounded by that parameter
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")
    # one text a key, the least: what reaches the driver is bounded by sample_rows too
    one = rows.groupBy("doc_id").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"), F.first("label").alias("label"))
    with Scratch(spark, "quality").action():
        found = one.mapInArrow(take, "doc_id long, label int, at binary, value binary").collect()
    found.sort(key=lambda r: (xxh64_intdigest(str(r.doc_id), 3), r.doc_id))
    return [(np.frombuffer(r.at, np.int32), np.frombuffer(r.value, np.float32).astype(float), r.label) for r in found]


def classify(docs: DataFrame, labels: DataFrame, *, sample_rows: int = 6000, bits: int = BITS, threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of docs.

    Null and empty texts get the score of a document without words (the intercept's). A
    null doc_id is not held out and never trains. Rows that repeat are scored each. With
    no usable labels every score is 0.5. Labels of one key that differ are averaged; of
    texts that share a key the least trains. No rows: none back.
    Columns other than doc_id, text and labels' doc_id, quality are not read.
    """
    weights = train_ftrl(training_rows(docs, labels, sample_rows, bits), bits)
    sent = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float32))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, words = sent.value, Words()
        for b in pieces_of(batches):
            z = np.empty(b.num_rows)
            for i, t in enumerate(b.column("text").to_pylist()):
                slots = features(t, words, bits)
                slots = slots[slots > 0]
                z[i] = w[0] + (SCALE * w[slots].sum(dtype=np.float64) / len(slots) if len(slots) else 0.0)
            p = 1 / (1 + np.exp(-np.clip(z, -35, 35)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(p), pa.array((p >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    return docs.select("doc_id", held.alias("held_out"), "text").mapInArrow(score, "doc_id long, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, labels: DataFrame, *, sample_rows: int = 6000, bits: int = BITS, threshold: float = 0.3) -> DataFrame:
    """The rows of docs that the classifier predicts 1 for, all columns as they are.

    Rows are judged as by classify(): those without words get the intercept's score,
    repeated rows stay or go together, rows without a doc_id are judged by their text.
    """
    weights = train_ftrl(training_rows(docs, labels, sample_rows, bits), bits)
    sent = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float32))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, words = sent.value, Words()
        bar = np.log(threshold / (1 - threshold))
        for b in pieces_of(batches):
            good = []
            for t in b.column("text").to_pylist():
                slots = features(t, words, bits)
                slots = slots[slots > 0]
                good.append(bool(w[0] + (SCALE * w[slots].sum(dtype=np.float64) / len(slots) if len(slots) else 0.0) >= bar))
            yield b.filter(pa.array(good, pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document, learnt from labels outside the held-out fold."""
    return classify(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


QUERIES = {"op9_quality": op9_quality}
ORACLES: dict[str, str] = {}
