"""The ten operators as queries over whole tables, and their SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gleanery.llm import byte_dedup, decontamination, link_graph, media, mixing, quality_cnn, simhash, substring_dedup, token_packing, warc
from gleanery.session import table


def op1_token_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_packing.packed(table(spark, sf_dir, "documents"))


def op2_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.round_trip(table(spark, sf_dir, "documents"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "error")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(table(spark, sf_dir, "documents"), digest=True)


def op6_link_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_graph.judged(table(spark, sf_dir, "pages"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op8_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_dedup.remove_repeats(table(spark, sf_dir, "documents"), digest=True)


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_cnn.classified(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_token_packing, op2_media_columns, op3_warc, op4_mixing, op5_substring_dedup, op6_link_graph, op7_simhash, op8_suffix_array, op9_decontamination, op10_quality_classifier)
    return {f.__name__: f for f in own}


OP3_SQL = """
with p as (select page_id, octet_length(encode(coalesce(html, ''))) as payload_bytes, sha256(coalesce(html, '')) as payload_digest from pages),
f as (select *, case when payload_bytes >= 100 then min(page_id) over (partition by payload_digest) end as first from p)
select page_id, payload_bytes::bigint as payload_bytes, payload_digest, case when first is null or page_id is not distinct from first then 'response' else 'revisit' end as record_type,
  case when first is null or page_id is not distinct from first then null else first end as refers_to, null::varchar as error
from f
"""

OP5_SQL = r"""
with d as (select row_number() over () as r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
s as (select r, doc_id, i, array_to_string(w[i : i + 12], ' ') as k from (select r, doc_id, w, unnest(range(1, len(w) - 11)) as i from d)),
m as (select k, min(doc_id) as least from s group by 1),
hit as (select distinct r, j from (select r, unnest(range(i, i + 13)) as j from s join m using (k) where least < doc_id or (doc_id is null and least is not null))),
gone as (select r, list(j) as js, count(*) as n from hit group by 1)
select doc_id, len(w)::bigint as n_words, coalesce(n, 0)::bigint as n_removed,
  sha256(array_to_string(case when n is null then w else list_transform(list_filter(list_zip(w, range(1, len(w) + 1)), lambda x: not list_contains(js, x[2])), lambda x: x[1]) end, ' ')) as kept_sha256
from d left join gone using (r)
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_warc": OP3_SQL, "op5_substring_dedup": OP5_SQL, "op6_link_graph": link_graph.oracle()}
