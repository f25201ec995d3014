"""The registered queries of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from groundshift.llm import ann, bpe, common, langid, media, neardup, packing, pii, tokencounts, urlfilter, warc
from groundshift.session import ship_package


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), common.tokenizer_path("word_bpe_49k.json"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_digest(_table(spark, sf_dir, "documents"))


def op3_tokencounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencounts.token_counts(_table(spark, sf_dir, "documents"), common.tokenizer_path("piece_bpe_32k.model"))


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_table(spark, sf_dir, "documents"))


def op5_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predict_languages(_table(spark, sf_dir, "documents"))


def op6_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(_table(spark, sf_dir, "embeddings"))


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.image_copies(media.embedding_images(_table(spark, sf_dir, "embeddings")))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.bpe_columns(_table(spark, sf_dir, "documents"), common.tokenizer_path("byte_bpe_50k.json"), ("n_tokens", "ids_sha256", "decoded_sha256"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(_table(spark, sf_dir, "pages"))


#: verdict, host, path
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]


def op10_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge_urls(_table(spark, sf_dir, "pages"), RULES)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_packing, op2_pii, op3_tokencounts, op4_minhash, op5_langid, op6_ann, op7_media, op8_bpe, op9_warc, op10_urls)}


_NEAR = """with recursive w as (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w from documents),
 s as (select doc_id, unnest(case when len(w) >= 5 then list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as s from w),
 n as (select doc_id, count(*) as n from s group by 1),
 shared as (select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b on a.s = b.s and a.doc_id < b.doc_id group by 1, 2),
 link as (select a, b from shared join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 85 * (x.n + y.n - c)),
 sym as (select a, b from link union all select b, a from link),
 reach as (select doc_id, doc_id as r from documents union select reach.doc_id, sym.b from reach join sym on sym.a = reach.r)
 select d.doc_id, coalesce(n.n, 0) as n_shingles, m.component_id, d.doc_id = m.component_id as kept from documents d left join n using (doc_id) join (select doc_id, min(r) as component_id from reach group by 1) m using (doc_id)"""

_WARC = """with p as (select page_id, coalesce(html, '') as h, octet_length(encode(coalesce(html, ''))) as n from pages), t as (select h, max(page_id) as top from p where n >= 1000 group by h)
 select page_id, n as payload_bytes, sha1(h) as payload_digest, case when top <> page_id then 'revisit' else 'response' end as record_type, case when top <> page_id then top end as refers_to from p left join t using (h)"""

_URLS = f"""with rules(verdict, host, path) as (values {", ".join(str(r) for r in RULES)}),
 p as (select page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) as path from pages)
 select page_id, p.host, p.path, r.host || r.path as rule, coalesce(r.verdict, 'allow') as verdict from p left join rules r on p.host <> '' and (p.host = r.host or ends_with(p.host, '.' || r.host)) and starts_with(p.path, r.path)
 qualify row_number() over (partition by page_id order by length(r.host || r.path) desc nulls last, length(r.host) desc, r.verdict desc) = 1"""


def oracle_sql() -> dict[str, str]:
    """SQL for the operators that it can express; tokenizers, networks, tries, packing and approximate search it cannot."""
    return {"op4_minhash": _NEAR, "op9_warc": _WARC, "op10_urls": _URLS}
