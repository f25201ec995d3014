"""Odd inputs of the training-data operators: extreme ids and vectors, strange characters, foreign archives, long hosts."""

from __future__ import annotations

import gzip
import unicodedata
from array import array

import brute
import numpy as np
import pytest
from tokenizers import Tokenizer

from groundshift.llm import ann, bpe, common, langid, neardup, packing, queries, urlfilter, warc

WORDS = "one two three four five six seven eight nine ten eleven twelve"


@pytest.mark.parametrize("name, coder", [("word_bpe_49k.json", packing.load), ("byte_bpe_50k.json", bpe.load)])
def test_ids_of_every_character(name, coder):
    """Every assigned code point, and some others, between words, digits and itself."""
    path = common.tokenizer_path(name)
    library, coder = Tokenizer.from_file(path), coder(path)
    codes = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000 and (unicodedata.category(chr(c)) not in ("Cn", "Co") or c % 97 == 0 or packing.newer().match(chr(c)))]
    for at in range(0, len(codes), 20_000):
        texts = [f"a{chr(c)}1 {chr(c) * 2} b{chr(c)}" for c in codes[at : at + 20_000]]
        want = [array("I", e.ids).tobytes() for e in library.encode_batch_fast(texts, add_special_tokens=False)]
        got = coder.encode(texts) if isinstance(coder, packing.WordBPE) else [coder.encode(t) for t in texts]
        assert [hex(c) for c, a, b in zip(codes[at:], got, want, strict=False) if a != b] == []


def test_near_duplicates_of_extreme_ids(spark):
    top = 2**63 - 1
    rows = [(top, WORDS), (top - 1, WORDS + " x"), (top - 2, WORDS + " x"), (-(2**63), "alone"), (top - 3, WORDS.upper()), (-5, "a b c d e f")]
    rows += [(top - 10 - k, f"{WORDS} {WORDS[::-1]} tail{k}") for k in range(4)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute.near_duplicates(rows)


def test_near_duplicates_of_one_id_with_two_texts(spark):
    other = "red green blue white black grey pink brown teal gold lime navy rust sand plum"
    rows = [(5, WORDS), (5, other), (7, other.replace("red ", "")), (9, WORDS.replace("one ", ""))]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), percent=80).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(5, 5), (5, 5), (7, 5), (9, 5)]


@pytest.mark.parametrize("size", [1e200, 1e-200, 1.0])
def test_neighbours_of_extreme_vectors(spark, size):
    rng = np.random.default_rng(1)
    rows = [(i, (rng.normal(size=4) * size).tolist(), "x", i, 0.5) for i in range(22)]
    got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>, query_id string, rank int, score double")).collect()
    assert sorted((r.query_id, r["rank"]) for r in got) == [(q, k) for q in (0, 20) for k in range(1, 21)]
    at = {i: np.array(v) for i, v, *_ in rows}
    # Products of opposite infinite signs are no number.
    assert np.array_equal([r.score for r in got], [ann.exact_scores(at[r.vec_id][None], at[r.query_id])[0] for r in got], equal_nan=True)


def test_neighbours_where_no_probing_reaches_the_target(spark):
    """A target above any recall: every query is searched everywhere, which is exact."""
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(400)]
    got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=5, tables=1, target=1.1).collect()
    at = np.array([v for _, v in rows])
    for q in range(0, 400, 20):
        scores = ann.exact_scores(at, at[q])
        best = sorted((-s, i) for i, s in enumerate(scores.tolist()) if i != q)[:5]
        assert [r.vec_id for r in sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])] == [i for _, i in best]


def test_more_than_64_languages(spark):
    rows = [(i, chr(0x4E00 + 40 * (i % 70)) * 30, f"l{i % 70:02}") for i in range(700)]
    network = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert len(network.langs) == 70


def test_windows_by_plain_convolution():
    rng = np.random.default_rng(3)
    x, y = rng.integers(97, 123, (40, langid.WINDOW)).astype(np.uint8), rng.integers(0, 3, 40)
    net = langid.train(x, y, ("a", "b", "c"), epochs=2)
    for row, got in zip(x, net.probabilities(x), strict=True):
        pooled = []
        for f in net.filters:
            places = langid.WINDOW - max(langid.WIDTHS) + 1
            pooled.append(np.max([sum(f[j][row[p + j]] for j in range(len(f))) for p in range(places)], axis=0))
        z = np.maximum(np.concatenate(pooled) + net.bias, 0) @ net.dense + net.out
        want = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        assert np.allclose(got, want, atol=1e-4)


def test_urls_with_long_hosts(spark):
    urls = ["http://" + "a." * 30_000 + "example.com/en/x", "http://" + "." * 5000 + "com/", "http://x.com/" + "p" * 200_000, "http://..example.com./en/"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = sorted((r.page_id, r.host, r.path, r.rule, r.verdict) for r in urlfilter.judge_urls(df, queries.RULES).collect())
    assert got == [(i, *brute.judge_url(u, queries.RULES)) for i, u in enumerate(urls)]


def crawl_record(kind: str, number: int, block: bytes, content: str = "application/http; msgtype=response") -> bytes:
    return f"WARC/1.0\r\nWARC-Type: {kind}\r\nwarc-record-id: <urn:uuid:{number}>\r\nWARC-Target-URI: http://h{number}.org/\r\nWARC-Date: 2024-01-01T00:00:00Z\r\nContent-Type: {content}\r\nContent-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


@pytest.mark.parametrize("packed", ["no", "records", "whole"])
def test_archives_of_others(spark, tmp_path, packed):
    """Plain files, one gzip member for each record, and one for all; no manifest, all record types."""
    page = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n" + b"<p>\r\n\r\nbody</p>" * 50_000
    records = [
        crawl_record("warcinfo", 0, b"software: x\r\n\r\n", "application/warc-fields"), crawl_record("request", 1, b"GET / HTTP/1.1\r\nHost: h\r\n\r\n", "application/http; msgtype=request"),
        crawl_record("response", 2, page), crawl_record("metadata", 3, b"", "application/warc-fields"), crawl_record("revisit", 4, b"HTTP/1.1 200 OK\r\nContent-Length: 77\r\n\r\n"), crawl_record("resource", 5, b"\x00\x01", "image/png"),
    ]
    data = {"no": b"".join(records), "records": b"".join(map(gzip.compress, records)), "whole": gzip.compress(b"".join(records))}[packed]
    (tmp_path / ("crawl.warc" if packed == "no" else "crawl.warc.gz")).write_bytes(data)
    warc.register(spark)
    load = spark.read.format("warc").option("path", f"file://{tmp_path}").load()
    rows = {r.record_id[10:-1]: r for r in load.collect()}
    assert [rows[str(k)].record_type for k in range(6)] == ["warcinfo", "request", "response", "metadata", "revisit", "resource"]
    assert rows["2"].payload == page.partition(b"\r\n\r\n")[2] and rows["2"].payload_bytes == len(rows["2"].payload)
    assert rows["5"].payload == b"\x00\x01" and rows["3"].payload_bytes == 0 and rows["4"].payload is None and rows["4"].payload_bytes == 77 and rows["1"].payload == b""
    assert rows["2"].headers["Content-Type"].startswith("application/http") and rows["0"].target_uri == "http://h0.org/"
    assert [r.target_uri for r in load.filter("record_type = 'request'").select("target_uri").collect()] == ["http://h1.org/"]
    single = spark.read.format("warc").option("path", str(next(tmp_path.iterdir()))).load()
    assert single.count() == 6
    (tmp_path / "cut.warc").write_bytes(crawl_record("resource", 1, b"x" * 90)[:-60])
    reader = warc.WarcReader(f"{tmp_path}/cut.warc", ["record_id", "payload"])
    with pytest.raises(ValueError):
        list(reader.read(reader.partitions()[0]))


def test_archives_of_two_writers_at_once(spark, tmp_path):
    """Each write has a manifest of its own, so none loses another's files."""
    df = spark.createDataFrame([(i, None, "x" * 40, "c", "c", 7) for i in range(6)], "page_id long, url string, html string, payload string, sha string, payload_bytes int")
    for part in ("page_id < 2", "page_id >= 2"):
        warc.write_archives(df.filter(part), f"file://{tmp_path}/w")
    assert warc.read_pages(spark, f"file://{tmp_path}/w").count() == 6 and len(list((tmp_path / "w").glob("_manifest*"))) == 2
