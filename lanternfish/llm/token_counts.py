"""Token counts of a unigram tokenizer, by dynamic programming over a trie of pre-tokens.

A pre-token is a word with the word-start sign before it. Its token count is that of its
most likely segmentation into vocabulary pieces: at each prefix, the best over the
pieces that end there of the score of the shorter prefix plus the piece's. That forward
score depends on the prefix alone, so distinct pre-tokens are put into a trie and each
node is scored once, when it is made; a pre-token's count is read at its last node and
kept. A document's count is a sum over its words, so nothing is shuffled.

The vocabulary comes from a public file, which is never trained here. The file's own
scores are merge ranks; a piece's log probability is taken from its rank by Zipf's law.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import pieces_of

START = "▁"
#: A character without a piece falls back to its bytes, at this much below the least score.
UNKNOWN = 10.0
#: Trie nodes that a worker keeps before it starts a new trie.
NODES = 600_000
#: Signs of a word beyond which it shares no prefix with others and is scored outside the trie.
LONG = 2000


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def vocabulary(path: str) -> dict[str, float]:
    """Pieces of a sentencepiece file with log probabilities: Zipf's law over their ranks."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
    ids.sort(key=lambda i: (-sp.get_score(i), i))
    total = sum(1 / (r + 1) for r in range(len(ids)))
    return {sp.id_to_piece(i): -math.log((r + 1) * total) for r, i in enumerate(ids)}


class Trie(dict):
    """Word bytes -> (tokens, score) of the best segmentation; also the trie of all words seen."""

    def __init__(self, pieces: dict[str, float], nodes: int = NODES):
        super().__init__()
        self.pieces, self.most = pieces, nodes
        self.longest = max(map(len, pieces), default=1)
        self.unknown = min(pieces.values(), default=0.0) - UNKNOWN
        self.reset()

    def reset(self) -> None:
        self.clear()
        self.child: dict[tuple[int, str], int] = {}
        self.score, self.count = [0.0], [0]

    def alone(self, text: str) -> tuple[int, float]:
        """(tokens, score) by the same recurrence over the last prefixes only, for a word of any length."""
        pieces, keep = self.pieces, max(1, self.longest)
        score, count = [0.0] * keep, [0] * keep  # of prefix `end`, at end modulo keep
        for end, sign in enumerate(text, 1):
            best, least = -math.inf, 0
            for start in range(max(0, end - keep), end):
                s = pieces.get(text[start:end])
                if s is None:
                    if start < end - 1:
                        continue
                    s, n = self.unknown, len(sign.encode())
                else:
                    n = 1
                s, n = s + score[start % keep], n + count[start % keep]
                if s > best or (s == best and n < least):
                    best, least = s, n
            score[end % keep], count[end % keep] = best, least
        return count[len(text) % keep], score[len(text) % keep]

    def __missing__(self, word: bytes) -> tuple[int, float]:
        text = START + word.decode("utf-8", "replace")
        if len(text) > LONG:
            return self.alone(text)
        if len(self.score) > self.most:
            self.reset()
        child, score, count, pieces = self.child, self.score, self.count, self.pieces
        path, node = [0], 0
        for end, sign in enumerate(text, 1):
            nxt = child.get((node, sign))
            if nxt is None:
                best, least = -math.inf, 0
                for start in range(max(0, end - self.longest), end):
                    s = pieces.get(text[start:end])
                    if s is None:
                        if start < end - 1:
                            continue
                        s, n = self.unknown, len(sign.encode())
                    else:
                        n = 1
                    at = path[start]
                    s, n = s + score[at], n + count[at]
                    if s > best or (s == best and n < least):
                        best, least = s, n
                nxt = child[node, sign] = len(score)
                score.append(best)
                count.append(least)
            path.append(nxt)
            node = nxt
        self[word] = found = (count[node], score[node])
        return found


_TRIES: dict[tuple[str, int], Trie] = {}


def trie_of(path: str, nodes: int) -> Trie:
    """One a worker; what it has met stays from task to task, up to `nodes`."""
    if (path, nodes) not in _TRIES:
        _TRIES[path, nodes] = Trie(vocabulary(path), nodes)
    return _TRIES[path, nodes]


def count_tokens(docs: DataFrame, *, vocabulary_path: str | None = None, nodes: int = NODES) -> DataFrame:
    """(doc_id, n_words, n_tokens, score) for each row of docs.

    score is the natural log probability of the best segmentation of all words. Null
    and empty texts have 0 words, 0 tokens, score 0. Repeated rows are counted each; a
    null doc_id stays null; no rows: none back. Columns other than doc_id and text are
    not read. Of segmentations that are equally likely the one with fewer tokens counts.
    A word of over `LONG` signs is scored by the same recurrence without a place in the trie.
    """
    path = vocabulary_path or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = trie_of(path, nodes)
        for b in pieces_of(batches):
            words, tokens, scores = [], [], []
            for text in b.column("text").to_pylist():
                found = [trie[w] for w in (text or "").encode("utf-8", "replace").split()]
                words.append(len(found))
                tokens.append(sum(n for n, _ in found))
                scores.append(math.fsum(s for _, s in found))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(words, pa.int64()), pa.array(tokens, pa.int64()), pa.array(np.array(scores, np.float64))], names=["doc_id", "n_words", "n_tokens", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_words long, n_tokens long, score double")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram token counts of all documents."""
    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op6_token_counts": op6_token_counts}
ORACLES: dict[str, str] = {}
