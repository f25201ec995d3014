"""Language identification by a byte convolutional network.

Filters of several widths over bytes, the greatest response of each in a fixed-length window, and a softmax over the
languages that the labels name; trained in numpy on a bounded sample, applied to batches of windows of whole texts.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW = 128
WIDTHS = (2, 3, 4)
FILTERS = 16
LETTER = regex.compile(r"\p{L}")
UNDETERMINED = "und"


def windows(text: str) -> np.ndarray:
    """The text's UTF-8 bytes, A-Z lower-cased, as rows of WINDOW bytes; the last is filled up with spaces."""
    data = text.encode("utf-8", "replace").lower()
    data += b" " * (-len(data) % WINDOW)
    return np.frombuffer(data, np.uint8).reshape(-1, WINDOW)


def held_out(id_col: Column) -> Column:
    """True for rows that training must not see: crc32 of the id as text leaves 2 modulo 4."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 4 == 2, F.lit(False))


@dataclass(frozen=True, eq=False)
class Network:
    """filters: for each width an array (width, 256, FILTERS); bias, dense and out: of the pooled features."""

    langs: tuple[str, ...]
    filters: tuple[np.ndarray, ...]
    bias: np.ndarray
    dense: np.ndarray
    out: np.ndarray

    @functools.cached_property
    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Responses by pairs of bytes: those of the first two places of all filters, and of places three and four."""
        two, three, four = self.filters
        both = lambda a, b: (a[:, None, :] + b[None, :, :]).reshape(65536, -1)
        none = np.zeros((256, FILTERS), np.float32)
        first = np.concatenate([both(two[0], two[1]), both(three[0], three[1]), both(four[0], four[1])], axis=1)
        second = np.concatenate([both(three[2], none), both(four[2], four[3])], axis=1)
        return np.ascontiguousarray(first, np.float32), np.ascontiguousarray(second, np.float32)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """Softmax over the languages for each window."""
        first, second = self.pairs
        out = np.empty((len(x), len(self.langs)), np.float32)
        for at in range(0, len(x), 64):
            w = x[at : at + 64].astype(np.int32)
            pair = w[:, :-1] * 256 + w[:, 1:]
            a = first[pair[:, :-2]]
            a[:, :, FILTERS:] += second[pair[:, 2:]]
            z = np.maximum(a.max(axis=1) + self.bias, 0) @ self.dense + self.out
            z = np.exp(z - z.max(axis=1, keepdims=True))
            out[at : at + 64] = z / z.sum(axis=1, keepdims=True)
        return out


def train(x: np.ndarray, y: np.ndarray, langs: tuple[str, ...], epochs: int = 6, batch: int = 256, rate: float = 0.01, seed: int = 5) -> Network:
    """Fit the network to windows x and labels y by Adam; the gradient of a pooled response reaches its best place only."""
    rng = np.random.default_rng(seed)
    count = FILTERS * len(WIDTHS)
    params = [rng.normal(0, 0.2, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS]
    params += [np.zeros(count, np.float32), rng.normal(0, 0.2, (count, len(langs))).astype(np.float32), np.zeros(len(langs), np.float32)]
    means, squares, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    places = WINDOW - max(WIDTHS) + 1
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for at in range(0, len(x), batch):
            rows = order[at : at + batch]
            w, n = x[rows].astype(np.int64), len(rows)
            peaks, tops = [], []
            for f in params[: len(WIDTHS)]:
                response = sum(f[j][w[:, j : j + places]] for j in range(len(f)))
                peak = response.argmax(axis=1)
                peaks.append(peak)
                tops.append(np.take_along_axis(response, peak[:, None, :], axis=1)[:, 0])
            bias, dense, out = params[len(WIDTHS) :]
            raw = np.concatenate(tops, axis=1) + bias
            h = np.maximum(raw, 0)
            z = h @ dense + out
            z = np.exp(z - z.max(axis=1, keepdims=True))
            p = z / z.sum(axis=1, keepdims=True)
            p[np.arange(n), y[rows]] -= 1
            p /= n
            back = (p @ dense.T) * (raw > 0)
            grads = []
            for i, f in enumerate(params[: len(WIDTHS)]):
                part, g = back[:, i * FILTERS : (i + 1) * FILTERS], np.zeros_like(f)
                for j in range(len(f)):
                    np.add.at(g[j], (np.take_along_axis(w, peaks[i] + j, axis=1), np.arange(FILTERS)[None]), part)
                grads.append(g)
            grads += [back.sum(axis=0), h.T @ p, p.sum(axis=0)]
            step += 1
            for q, g, m, s in zip(params, grads, means, squares, strict=True):
                m *= 0.9
                m += 0.1 * g
                s *= 0.999
                s += 0.001 * g * g
                q -= rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-7)
    return Network(langs, tuple(params[: len(WIDTHS)]), *params[len(WIDTHS) :])


def fit(df: DataFrame, per_lang: int = 1000, each: int = 6, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Network | None:
    """Train on rows with a language that are not held out.

    The sample is bounded: about `per_lang` rows of each language that a label names, picked by a hash of the id, and of
    each row `each` windows spread over its whole text. None if no row can be learned from.
    """
    known = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    known = known.filter(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull() & F.col("lang").isNotNull())
    counts = {r.lang: r.n for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return None
    share = F.create_map(*[F.lit(v) for lang, n in sorted(counts.items()) for v in (lang, min(1.0, per_lang / n))])
    picked = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < F.coalesce(F.try_element_at(share, F.col("lang")), F.lit(0.0)) * 1_000_000)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, text, lang in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if text and LETTER.search(text):
                    w = windows(text)
                    chosen = np.unique(np.linspace(0, len(w) - 1, min(each, len(w))).astype(int))
                    rows.append((doc, lang, w[chosen].tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.string(), pa.binary()))], names=["doc_id", "lang", "windows"])

    rows = picked.mapInArrow(cut, "doc_id long, lang string, windows binary").limit(2 * per_lang * len(counts)).collect()
    rows.sort(key=lambda r: (r.doc_id, r.lang, bytes(r.windows)))
    langs = tuple(sorted({r.lang for r in rows}))
    if not langs:
        return None
    x = np.concatenate([np.frombuffer(bytes(r.windows), np.uint8).reshape(-1, WINDOW) for r in rows])
    y = np.concatenate([np.full(len(r.windows) // WINDOW, langs.index(r.lang)) for r in rows])
    return train(x, y, langs)


def identify(df: DataFrame, network: Network | None, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, lang_pred and score (the mean probability of the windows, 0 to 1) of every whole text.

    `und` with score 0 for a null text, one without a letter, or if there is no network. Of equally likely languages the
    first by name is given. Repeated rows and null ids
    give a row each; an empty table gives an empty one; columns other than the two and `keep` don't matter.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                langs, scores = [], []
                texts = [t if t and network and LETTER.search(t) else None for t in batch.column(1).to_pylist()]
                parts = [windows(t) if t else np.zeros((0, WINDOW), np.uint8) for t in texts]
                p = network.probabilities(np.concatenate(parts)) if network else None
                end = 0
                for part in parts:
                    if len(part):
                        mean = p[end : end + len(part)].mean(axis=0, dtype=np.float64)
                        langs.append(network.langs[int(mean.argmax())])
                        scores.append(min(1.0, float(mean.max())))
                    else:
                        langs.append(UNDETERMINED)
                        scores.append(0.0)
                    end += len(part)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double")


def language_column(df: DataFrame, network: Network | None, text_col: str = "text") -> Column:
    """struct<lang_pred, score> of a text column, for filters that keep a table's own columns."""
    import pandas as pd

    def run(series: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in series:
            rows = []
            for t in texts:
                if t and network and LETTER.search(t):
                    mean = network.probabilities(windows(t)).mean(axis=0, dtype=np.float64)
                    rows.append((network.langs[int(mean.argmax())], min(1.0, float(mean.max()))))
                else:
                    rows.append((UNDETERMINED, 0.0))
            yield pd.DataFrame(rows, columns=["lang_pred", "score"])

    run.__annotations__ = {"series": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    return F.pandas_udf(run, "lang_pred string, score double").asNondeterministic()(F.col(text_col).cast("string"))


def predict_languages(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """fit() and identify() on one table: doc_id, held_out, lang_pred, score."""
    out = identify(df, fit(df, id_col=id_col, text_col=text_col, lang_col=lang_col), id_col, text_col)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
