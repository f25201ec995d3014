"""Token counts under a unigram vocabulary by dynamic programming over a trie of pre-tokens.

Distinct pre-tokens are inserted in a trie; the best forward score of a prefix is worked out once, when its node is
made, from the scores of its ancestors, so words with a common beginning share that work. A word's count is stored at
its terminal node.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"


class UnigramTrie:
    """Counts of the best segmentation: highest sum of piece scores, then fewest tokens.

    A piece's score is -log(place in the vocabulary + 2), below zero, as the public vocabulary file has ranks, no probabilities. A
    character that no piece covers becomes its UTF-8 bytes, each a token with a score below all pieces.
    """

    def __init__(self, pieces: dict[str, float], room: int = 600_000):
        self.pieces, self.room = pieces, room
        # Endings of pieces: a score for whole pieces, none for parts. A text that is no ending of any piece ends the search.
        self.endings: dict[str, float | None] = {p[k:]: None for p in pieces for k in range(len(p))} | pieces
        self.byte_score = min(pieces.values(), default=0.0) - 10.0
        self.memo: dict[str, int] = {}
        self.clear()

    def clear(self) -> None:
        self.child: dict[int, int] = {}
        self.score, self.count = [0.0], [0]

    def insert(self, word: str) -> int:
        """The terminal node's token count; new nodes get their forward scores."""
        child, score, count, endings = self.child, self.score, self.count, self.endings
        path, node = [0], 0
        for at, char in enumerate(word):
            key = node * 0x110000 + ord(char)
            found = child.get(key)
            if found is None:
                found = child[key] = len(score)
                best, fewest = -math.inf, 0
                if endings.get(char) is None:
                    n = len(char.encode("utf-8", "replace"))
                    best, fewest = score[path[at]] + n * self.byte_score, count[path[at]] + n
                for start in range(at, -1, -1):
                    piece = endings.get(word[start : at + 1], 0.0)
                    if piece == 0.0:
                        break
                    if piece is None:
                        continue
                    value, tokens = score[path[start]] + piece, count[path[start]] + 1
                    if value > best or value == best and tokens < fewest:
                        best, fewest = value, tokens
                score.append(best)
                count.append(fewest)
            node = found
            path.append(node)
        return count[node]

    def counts(self, words: list[str]) -> int:
        """Tokens of all words, each with the word mark before it."""
        memo = self.memo
        fresh = set(words).difference(memo)
        for w in fresh:
            memo[w] = self.insert(MARK + w)
        total = sum(map(memo.__getitem__, words))
        if len(memo) > self.room:  # keep what came first: the frequent words
            for w in fresh:
                del memo[w]
        if len(self.score) > self.room:
            self.clear()
        return total


@functools.lru_cache(maxsize=2)
def load(path: str) -> UnigramTrie:
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    usable = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    return UnigramTrie({model.id_to_piece(i): -math.log(k + 2.0) for k, i in enumerate(usable)})


def token_counts(df: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words and n_tokens of every whole text; words are runs of anything but ASCII white space.

    A null or empty text has neither. Repeated rows and null ids give a row each; an empty table gives an empty one;
    other columns don't matter. No shuffle; a task's trie is bounded and starts afresh when full.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = load(model_path)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                words = [[w.decode() for w in (t or "").encode().split()] for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(w) for w in words], pa.int64()), pa.array([trie.counts(w) for w in words], pa.int64())], names=["doc_id", "n_words", "n_tokens"])

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, n_words long, n_tokens long")
