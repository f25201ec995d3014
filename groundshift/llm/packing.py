"""Best-fit packing of tokenized documents into sequences of bounded length.

Hierarchical residual packing: each partition packs its own pieces best-fit and emits its nearly full bins; bins with
room go up a tree of merges as single items and are packed best-fit again, among more partitions each time.
"""

from __future__ import annotations

import functools
import json
import re
import unicodedata
import zlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundshift.llm import common
from groundshift.llm.bpe import CONTRACTIONS, LATIN_L, LATIN_N, LATIN_S, SPACE, is_latin

#: Pieces that a task keeps in memory at once (about 150 bytes each), however many make up an item.
BUFFER = 400_000


@functools.cache
def newer() -> regex.Pattern:
    """Letters and numbers younger than Unicode 3.2: Unicode versions differ on them, so the library itself splits such texts."""
    known = regex.findall(r"[\p{L}\p{N}]", "".join(chr(c) for c in range(0x100, 0x110000) if not 0xD800 <= c < 0xE000))
    codes = [ord(c) for c in known if unicodedata.ucd_3_2_0.category(c)[0] not in "LN"]
    cuts = [k for k in range(1, len(codes)) if codes[k] != codes[k - 1] + 1]
    runs = [(codes[i], codes[j - 1]) for i, j in zip([0, *cuts], [*cuts, len(codes)], strict=True)]
    return regex.compile("[" + "".join(f"\\U{a:08X}-\\U{b:08X}" for a, b in runs) + "]")


class WordBPE:
    """Ids of the public lower-casing word vocabulary, by the tokenizers library; a bounded memo of words spares most calls."""

    def __init__(self, path: str, memo: int = 600_000):
        common.quiet_threads()
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.added = [t["content"] for t in spec["added_tokens"]]
        build = lambda letters, numbers, space: f"{CONTRACTIONS}|[{letters}]+|[{numbers}]|[^{space}{letters}{numbers}]+"
        self.latin = re.compile(build(LATIN_L, LATIN_N, LATIN_S))
        self.any = regex.compile(build("\\p{L}", "\\p{N}", SPACE))
        self.memo: dict[str, bytes] = {}
        suffix = spec["model"]["end_of_word_suffix"]
        self.ending = np.zeros(1 + max(spec["model"]["vocab"].values()), bool)
        self.ending[[i for piece, i in spec["model"]["vocab"].items() if piece.endswith(suffix)]] = True
        self.room = memo

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        split: list[list[str] | None] = []
        for text in texts:
            if any(a in text for a in self.added):
                split.append(None)
            elif is_latin(text):
                split.append(self.latin.findall(text.lower()))
            elif newer().search(text):
                split.append(None)
            else:
                # The library lowers each character by itself: no final sigma.
                split.append(self.any.findall(unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()))
        present = set().union(*(words for words in split if words))
        fresh = present.difference(self.memo)
        if fresh:
            if len(self.memo) + len(fresh) > self.room:
                self.memo = {w: self.memo[w] for w in present if w in self.memo}
            self._learn(list(fresh))
        return [self._whole(t) if words is None else b"".join(map(self.memo.__getitem__, words)) for t, words in zip(texts, split, strict=True)]

    def _learn(self, words: list[str]) -> None:
        """Encode words in one call, as a text of words; tokens that end a word tell them apart."""
        ids = np.array(self.library.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, np.uint32)
        ends = np.flatnonzero(self.ending[ids]) + 1
        if len(ends) != len(words) or ends[-1] != len(ids):
            self.memo.update((w, self._whole(w)) for w in words)
            return
        flat, cuts = ids.tobytes(), (ends * 4).tolist()
        self.memo.update(zip(words, [flat[i:j] for i, j in zip([0, *cuts], cuts, strict=False)], strict=True))

    def _whole(self, text: str) -> bytes:
        return array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes()


@functools.lru_cache(maxsize=2)
def load(path: str) -> WordBPE:
    return WordBPE(path)


def best_fit(items: Iterable[tuple[int, object]], capacity: int) -> list[tuple[int, list]]:
    """Best-fit decreasing: (size, payload) items to (fill, payloads) bins. Open bins are kept by their room."""
    room: list[list[list]] = [[] for _ in range(capacity + 1)]
    mask, bins = 0, []
    for size, payload in sorted(items, key=lambda x: -x[0]):
        fits = mask >> size
        if fits:
            left = size + (fits & -fits).bit_length() - 1
            members = room[left].pop()
            if not room[left]:
                mask &= ~(1 << left)
        else:
            left, members = capacity, []
            bins.append(members)
        members.append((size, payload))
        left -= size
        if left:
            room[left].append(members)
            mask |= 1 << left
    return [(sum(s for s, _ in m), [p for _, p in m]) for m in bins]


MEMBER = pa.struct([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
BIN = pa.schema([("fill", pa.int32()), ("members", pa.list_(MEMBER)), ("task", pa.int32()), ("open", pa.bool_())])
BIN_DDL = "fill int, members array<struct<doc_id:long,piece:int,start:long,length:long,ids_crc32:long>>, task int, open boolean"


def _bins(bins: list[tuple[int, list]], capacity: int, slack: int) -> Iterator[pa.RecordBatch]:
    ctx = TaskContext.get()
    task = ctx.partitionId() if ctx else 0
    for at in range(0, len(bins), 4096):
        part = bins[at : at + 4096]
        members = [[dict(zip(("doc_id", "piece", "start", "length", "ids_crc32"), m, strict=True)) for m in ms] for _, ms in part]
        yield pa.RecordBatch.from_arrays([pa.array([f for f, _ in part], pa.int32()), pa.array(members, pa.list_(MEMBER)), pa.array([task] * len(part), pa.int32()), pa.array([f < capacity - slack for f, _ in part], pa.bool_())], schema=BIN)


def pack_documents(
    df: DataFrame, vocab_path: str, capacity: int = 2048, end_id: int = 0, slack: int = 0, fan_in: int = 8, group_bins: int = 200_000, max_rounds: int = 6, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Pack whole documents, each followed by end_id, into sequences of at most `capacity` tokens.

    Only documents longer than `capacity` are cut, into pieces of `capacity`. Returns one row for each piece: doc_id,
    piece, start, length, ids_crc32, sequence_id, offset, fill. A null or empty text is the end id alone. Repeated rows
    and null ids are packed as rows of their own. An empty table gives an empty one; other columns don't matter.

    Tokenization and the first packing are one pass without a shuffle. Bins with more than `slack` tokens of room then
    go up the tree: each round merges `fan_in` groups, packs their bins as items and stops at one group or when a
    round saves under a thousandth of the bins, after `max_rounds` rounds at the latest; nothing is lost by that, the
    sequences are only less full. A group never holds more than about `group_bins` bins, whatever the
    input, as further mixing no longer changes the fill. Each round's bins are written to the shared folder.
    """

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, end, items = load(vocab_path), array("I", [end_id]).tobytes(), []
        width = 4 * capacity
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                for doc, ids in zip(part.column(0).to_pylist(), coder.encode([t or "" for t in part.column(1).to_pylist()]), strict=True):
                    ids += end
                    for k in range(0, len(ids), width):
                        piece = ids[k : k + width]
                        items.append((len(piece) // 4, (doc, k // width, k // 4, len(piece) // 4, zlib.crc32(piece))))
            if len(items) >= BUFFER:
                yield from _bins(best_fit(items, capacity), capacity, slack)
                items = []
        yield from _bins(best_fit(items, capacity), capacity, slack)

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items: list[tuple[int, list]] = []

        def packed() -> Iterator[pa.RecordBatch]:
            merged = best_fit(items, capacity)
            yield from _bins([(f, [m for ms in parts for m in ms]) for f, parts in merged], capacity, slack)

        for batch in batches:
            items += [(f, [(m["doc_id"], m["piece"], m["start"], m["length"], m["ids_crc32"]) for m in ms]) for f, ms in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            if sum(len(ms) for _, ms in items) >= BUFFER:
                yield from packed()
                items = []
        yield from packed()

    source = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    level = common.materialize(source.mapInArrow(first, BIN_DDL), "bins0")
    done = [level.filter("not open")]
    groups = level.select("task").distinct().count()
    underfull = level.filter("open").count()
    left = level.filter("open")
    for k in range(1, max_rounds + 1):
        if underfull < 2:
            break
        groups = max(-(-groups // fan_in), -(-underfull // group_bins), 1)
        dealt = left.select("fill", "members").repartition(groups, F.xxhash64("members", F.lit(k)))
        level = common.materialize(dealt.mapInArrow(again, BIN_DDL), f"bins{k}")
        done.append(level.filter("not open"))
        left, before = level.filter("open"), underfull
        total, underfull = level.agg(F.count("*"), F.count_if("open")).first()
        if groups == 1 or before - total < before // 1000:
            break
    done.append(left)
    packed = functools.reduce(DataFrame.unionByName, (d.select("fill", "members").withColumn("round", F.lit(i)) for i, d in enumerate(done)))
    numbered = packed.select(F.monotonically_increasing_id().alias("sequence_id"), "fill", F.expr("transform(members, (m, i) -> struct(m, aggregate(slice(members, 1, i), 0L, (a, x) -> a + x.length) as offset))").alias("placed"))
    return numbered.select("sequence_id", "fill", F.explode("placed").alias("p")).select("p.m.doc_id", "p.m.piece", "p.m.start", "p.m.length", "p.m.ids_crc32", "sequence_id", F.col("p.offset").alias("offset"), F.col("fill").cast("long").alias("fill"))
