"""Best-fit packing by minimum bin slack over the lengths that are left.

Pieces of at most `capacity` tokens are counted by length: at most `capacity` numbers,
whatever the corpus. The driver plans on these counts alone. For each bin it takes the
longest length left and asks a subset-sum over the other lengths, kept as one bitset,
for the fullest combination that fits beside it; that combination is removed as many
times as the counts allow, which uses up a length, so there are at most `capacity`
kinds of bin. The plan, a few thousand numbers, goes to the executors; each piece finds
its sequence and offset from its rank among the pieces of its length. Ranks come from a
count per (input partition, length) and running sums of these, not from a sort of pieces.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch

CAPACITY = 1024
END_ID = 2
#: How byte-level BPE cuts a text before merging (fixed value).
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pre-tokens that a worker remembers before it starts again.
REMEMBER = 400_000


def default_tokenizer() -> str:
    """The public byte-level BPE file."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder(dict):
    """Pre-token -> its ids as little-endian unsigned 32-bit numbers, of a byte-level BPE file.

    In such a file the ids of merged tokens are in the order of the merges, so ids serve
    as merge ranks; that is checked when the file is read.
    """

    def __init__(self, path: str):
        super().__init__()
        import tiktoken

        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        # the byte alphabet: printable bytes stand for themselves, the others follow from U+0100
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        sign = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in set(printable))}
        self.added = {t["content"]: t["id"] for t in file.get("added_tokens", [])}
        vocab = {k: v for k, v in file["model"]["vocab"].items() if k not in self.added}
        ranks = {bytes(sign[c] for c in k): v for k, v in vocab.items()}
        made = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in file["model"]["merges"]]
        if made != sorted(made) or file["pre_tokenizer"]["type"] != "ByteLevel" or file["pre_tokenizer"].get("add_prefix_space") or file.get("normalizer"):
            raise ValueError(f"{path}: not a byte-level BPE file with ids in merge order")
        self.bpe = tiktoken.Encoding("file", pat_str=PRE_TOKEN, mergeable_ranks=ranks, special_tokens={})._core_bpe
        self.find = regex.compile(PRE_TOKEN).findall
        self.special = regex.compile("(" + "|".join(map(regex.escape, self.added)) + ")") if self.added else None

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= REMEMBER:
            self.clear()
        self[piece] = got = np.array(self.bpe.encode_single_piece(piece.encode()), "<u4").tobytes()
        return got

    def packed(self, text: str) -> bytes:
        """The ids of a whole text, four bytes each; added tokens are found as the file asks."""
        if self.special is None or not self.special.search(text):
            return b"".join(map(self.__getitem__, self.find(text)))
        parts = self.special.split(text)
        return b"".join(self.added[p].to_bytes(4, "little") if i % 2 else b"".join(map(self.__getitem__, self.find(p))) for i, p in enumerate(parts))


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder a worker; it keeps what it has learnt from task to task."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def cuts(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens; only the first may be shorter than capacity."""
    first = n % capacity or min(n, capacity)
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


def pieces(docs: DataFrame, *, tokenizer: str | None, capacity: int, end_id: int) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, part, idx): idx counts the pieces of a length within an input partition."""
    path = tokenizer or default_tokenizer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, seen, end = encoder(path), TaskContext.get().partitionId(), [0] * (capacity + 1), end_id.to_bytes(4, "little")
        for b in batches:
            ids, rows = b.column("doc_id").to_pylist(), []
            for doc, text in zip(ids, b.column("text").to_pylist(), strict=True):
                packed = enc.packed(text or "") + end
                for k, (start, length) in enumerate(cuts(len(packed) // 4, capacity)):
                    rows.append((doc, k, start, length, zlib.crc32(packed[4 * start : 4 * (start + length)]), part, seen[length]))
                    seen[length] += 1
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "idx"]
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [()] * 7, kinds, strict=True)], names=names)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, part long, idx long")


def fullest(room: int, left: dict[int, int]) -> dict[int, int]:
    """The combination of available lengths whose sum is largest within room, long ones first."""
    mask, bits, steps = (1 << (room + 1)) - 1, 1, []
    for length in sorted((x for x in left if x <= room and left[x]), reverse=True):
        most, take = min(left[length], room // length), 1
        while most:
            take = min(take, most)
            steps.append((length, take, bits))
            bits |= (bits << (length * take)) & mask
            most -= take
            take *= 2
        if bits >> room & 1:
            break
    at, used = bits.bit_length() - 1, {}
    for length, take, before in reversed(steps):
        if not before >> at & 1:
            used[length] = used.get(length, 0) + take
            at -= length * take
    return used


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """(lengths of a bin with their numbers, how many such bins), until no piece is left."""
    left, bins = {k: v for k, v in counts.items() if v}, []
    while left:
        top = max(left)
        left[top] -= 1
        used = fullest(capacity - top, left)
        left[top] += 1
        used[top] = used.get(top, 0) + 1
        times = min(left[k] // n for k, n in used.items())
        bins.append((used, times))
        left = {k: v - times * used.get(k, 0) for k, v in left.items() if v > times * used.get(k, 0)}
    return bins


def _segments(bins: list[tuple[dict[int, int], int]]) -> np.ndarray:
    """Rows (length, first rank, pieces a bin, first sequence, offset), in order."""
    rank, rows, sequence = {}, [], 0
    for used, times in bins:
        offset = 0
        for length in sorted(used, reverse=True):
            first = rank.get(length, 0)
            rows.append((length, first, used[length], sequence, offset))
            rank[length] = first + used[length] * times
            offset += used[length] * length
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def pack(docs: DataFrame, *, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset): every piece in its place.

    A null or empty text is one piece, the end id alone. Repeated rows, and rows that
    share a doc_id or have none, are packed each. No rows: none back. Columns other than
    doc_id and text are not read.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "packing")
    cut = scratch.keep(pieces(docs, tokenizer=tokenizer, capacity=capacity, end_id=end_id), "pieces")
    counts = cut.groupBy("part", "length").count()
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = scratch.keep(counts.withColumn("before", F.coalesce(F.sum("count").over(before), F.lit(0))), "offsets")
    hist = {r.length: r.n for r in offsets.groupBy("length").agg(F.sum("count").alias("n")).collect()}  # capacity rows at most
    seg = _segments(plan(hist, capacity))
    key = (seg[:, 0] << 48) | seg[:, 1]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            s = seg[np.searchsorted(key, (length << 48) | rank, "right") - 1]
            nth = rank - s[:, 1]
            out = [b.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*out, pa.array(s[:, 3] + nth // s[:, 2]), pa.array(s[:, 4] + nth % s[:, 2] * length)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    # offsets grow with the input partitions, however small their file is: never broadcast
    ranked = cut.join(offsets.drop("count").hint("merge"), ["part", "length"]).withColumn("rank", F.col("idx") + F.col("before"))
    return ranked.drop("part", "idx", "before").mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 1024 tokens."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op5_packing": op5_packing}
ORACLES: dict[str, str] = {}
