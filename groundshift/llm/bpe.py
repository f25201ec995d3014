"""BPE encoding and decoding.

Encoding runs a priority queue of merge ranks over a doubly linked list of symbols and skips stale entries; decoding
joins vocabulary strings. Results equal those of the tokenizers library for byte-level vocabularies.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
import re
from array import array
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# White space of the Unicode property White_Space, as the public byte-level pattern reads \s.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
# Letters and numbers below U+0100.
LATIN_L = "A-Za-z\\xaa\\xb5\\xba\\xc0-\\xd6\\xd8-\\xf6\\xf8-\\xff"
LATIN_N = "0-9\\xb2\\xb3\\xb9\\xbc-\\xbe"
LATIN_S = "\\t-\\r \\x85\\xa0"
CONTRACTIONS = "'s|'t|'re|'ve|'m|'ll|'d"


def byte_level_patterns() -> tuple[re.Pattern, regex.Pattern]:
    """The public byte-level splitting pattern, for texts below U+0100 and for all texts."""

    def build(letters: str, numbers: str, space: str) -> str:
        return f"{CONTRACTIONS}| ?[{letters}]+| ?[{numbers}]+| ?[^{space}{letters}{numbers}]+|[{space}]+(?![^{space}])|[{space}]+"

    return re.compile(build(LATIN_L, LATIN_N, LATIN_S)), regex.compile(build("\\p{L}", "\\p{N}", SPACE))


def is_latin(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def byte_chars() -> dict[int, str]:
    """The public byte-to-character table: printable bytes stand for themselves, the others follow from U+0100."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    table = {b: chr(b) for b in shown}
    for b in range(256):
        if b not in table:
            table[b] = chr(256 + len(table) - len(shown))
    return table


class ByteBPE:
    """A byte-level BPE vocabulary with a bounded memo of pre-tokens."""

    def __init__(self, path: str, memo: int = 600_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab: dict[str, int] = spec["model"]["vocab"]
        chars = byte_chars()
        back = {c: b for b, c in chars.items()}
        self.first = [vocab[chars[b]] for b in range(256)]
        self.strings: list[bytes] = [b""] * (1 + max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])]))
        for piece, i in vocab.items():
            self.strings[i] = bytes(back[c] for c in piece)
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for content, i in self.added.items():
            self.strings[i] = content.encode()
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.merges.setdefault((vocab[a], vocab[b]), (rank, vocab[a + b]))
        self.latin, self.any = byte_level_patterns()
        self.split_added = re.compile("|".join(re.escape(c) for c in sorted(self.added, key=len, reverse=True))) if self.added else None
        self.memo, self.room = _Memo(self), memo

    def merge(self, symbols: list[int]) -> list[int]:
        """Apply the merges to a list of symbols: lowest rank first, then leftmost."""
        n, merges = len(symbols), self.merges
        if n < 2:
            return symbols
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = []
        for i in range(n - 1):
            found = merges.get((symbols[i], symbols[i + 1]))
            if found:
                queue.append((found[0], i, found[1], symbols[i], symbols[i + 1]))
        heapq.heapify(queue)
        while queue:
            _, i, new, left, right = heapq.heappop(queue)
            j = after[i]
            if symbols[i] != left or j >= n or symbols[j] != right:
                continue  # stale: one of the two symbols has changed or gone
            symbols[i], symbols[j] = new, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                found = merges.get((new, symbols[k]))
                if found:
                    heapq.heappush(queue, (found[0], i, found[1], new, symbols[k]))
            h = before[i]
            if h >= 0:
                found = merges.get((symbols[h], new))
                if found:
                    heapq.heappush(queue, (found[0], h, found[1], symbols[h], new))
        return [s for s in symbols if s >= 0]

    def encode(self, text: str) -> bytes:
        """Ids of text as little-endian unsigned 32-bit integers."""
        if self.split_added and (m := self.split_added.search(text)):
            out, at = [], 0
            while m:
                out.append(self._plain(text[at : m.start()]))
                out.append(array("I", [self.added[m.group()]]).tobytes())
                at = m.end()
                m = self.split_added.search(text, at)
            return b"".join([*out, self._plain(text[at:])])
        return self._plain(text)

    def _plain(self, text: str) -> bytes:
        pattern = self.latin if is_latin(text) else self.any
        return b"".join(map(self.memo.__getitem__, pattern.findall(text)))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.strings.__getitem__, array("I", ids)))


class _Memo(dict):
    def __init__(self, owner: ByteBPE):
        self.owner = owner

    def __missing__(self, piece: str) -> bytes:
        first = self.owner.first
        ids = array("I", self.owner.merge([first[b] for b in piece.encode()])).tobytes()
        if len(self) < self.owner.room and len(piece) < 64:
            self[piece] = ids
        return ids


@functools.lru_cache(maxsize=2)
def load(path: str) -> ByteBPE:
    return ByteBPE(path)


KINDS = {
    "ids": ("array<int>", pa.list_(pa.int32())),
    "n_tokens": ("long", pa.int64()),
    "ids_sha256": ("string", pa.string()),
    "decoded": ("string", pa.string()),
    "decoded_sha256": ("string", pa.string()),
}


def bpe_columns(df: DataFrame, vocab_path: str, outputs: tuple[str, ...] = ("ids", "decoded"), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode whole texts and, where asked for, decode the ids again.

    Returns doc_id and the outputs: ids (array<int>), n_tokens, ids_sha256 (of little-endian unsigned 32-bit ids),
    decoded, decoded_sha256. A null text counts as empty: no ids, the digests of nothing. Repeated rows, null ids and
    ties give a row each. An empty table gives an empty one. Other columns of df don't matter.
    No shuffle: each task streams over its rows; memory is the vocabulary, the bounded memo and one Arrow batch.
    """
    wanted = {k: KINDS[k] for k in outputs}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = load(vocab_path)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                cols: dict[str, list] = {k: [] for k in wanted}
                for text in part.column(1).to_pylist():
                    ids = coder.encode(text or "")
                    back = coder.decode(ids) if "decoded" in wanted or "decoded_sha256" in wanted else b""
                    for k, out in cols.items():
                        if k == "ids":
                            out.append(array("i", ids).tolist())
                        elif k == "n_tokens":
                            out.append(len(ids) // 4)
                        elif k == "ids_sha256":
                            out.append(hashlib.sha256(ids).hexdigest())
                        elif k == "decoded":
                            out.append(back.decode("utf-8", "replace"))
                        else:
                            out.append(hashlib.sha256(back).hexdigest())
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(cols[k], t) for k, (_, t) in wanted.items())], names=["doc_id", *wanted])

    source = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(run, "doc_id long, " + ", ".join(f"{k} {t}" for k, (t, _) in wanted.items()))


def decode_ids(df: DataFrame, vocab_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and text of an array of ids; null ids give null, bytes that are no UTF-8 give U+FFFD, as in the library."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = load(vocab_path)
        for batch in batches:
            texts = [None if ids is None else coder.decode(array("I", ids).tobytes()).decode("utf-8", "replace") for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids")).mapInArrow(run, "doc_id long, text string")
