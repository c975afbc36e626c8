"""The queries of this subpackage: ``QUERIES`` takes (spark, sf_dir), ``ORACLES`` holds DuckDB SQL."""

from __future__ import annotations

import os

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import jaccard_groups, knn_quality, license_scan, lm_lattice, pack_pow2, paragraph_dedup, rule_cascade, scratch, spaced_seeds, token_store, warc_zip


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer(name: str) -> str:
    """A vocabulary file's place, the same on driver and executors."""
    return os.path.abspath(public_tokenizers.path(name))


def op1_lm_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    columns = F.col("doc_id"), F.col("text"), F.crc32(F.col("doc_id").cast("string")) % 10 == 0
    return lm_lattice.score(docs, lm_lattice.fit(docs, tokenizer("piece_bpe_32k.model"), *columns), *columns)


def op2_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch.scratch_path(spark, "store")
    token_store.write_store(table(spark, sf_dir, "documents"), path, tokenizer("byte_bpe_50k.json"), end_id=0)
    return token_store.read_store(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op7_spaced_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spaced_seeds.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_jaccard_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_groups.join(table(spark, sf_dir, "documents"))


def op9_pack_pow2(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack_pow2.pack(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"), end_id=2)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "bucket")


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.find(table(spark, sf_dir, "documents"))


def quality_model(docs: DataFrame, spark: SparkSession, sf_dir: str) -> knn_quality.Model:
    """Learned from the labelled rows whose crc32(doc_id as text) mod 3 is not 1."""
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label")).where(F.crc32(F.col("doc_id").cast("string")) % 3 != 1)
    return knn_quality.fit(docs, labels)


def op4_knn_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = knn_quality.score(docs, quality_model(docs, spark, sf_dir), F.col("text"), [F.col("doc_id")])
    held_out = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    return scored.select("doc_id", held_out.alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def op5_paragraph_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraph_dedup.find(table(spark, sf_dir, "documents"))


def op6_warc_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch.scratch_path(spark, "warc")
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    packages = warc_zip.write_packages(warc_zip.assign_revisits(table(spark, sf_dir, "pages"), "page_id", payload), folder)
    return warc_zip.read_packages(spark, packages, folder, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP6_SQL = """
with p as (select page_id, encode(coalesce(html, '')) as b from pages),
d as (select page_id, octet_length(b) as payload_bytes, sha1(b) as payload_digest from p),
m as (select *, max(page_id) over (partition by payload_digest) as first_id from d)
select page_id, cast(payload_bytes as bigint) as payload_bytes, payload_digest,
       case when payload_bytes >= 1000 and page_id <> first_id then 'revisit' else 'response' end as record_type,
       case when payload_bytes >= 1000 and page_id <> first_id then first_id end as refers_to
from m
"""


def op10_rule_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return rule_cascade.cascade(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


OP10_SQL = r"""
with t as (select doc_id, coalesce(text, '') as text from documents),
w as (select doc_id, text, list_filter(regexp_split_to_array(text, '[ \t\n\x0B\f\r]+'), lambda x: x <> '') as ws,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^ \t\n\x0B\f\r]')) as ls from t),
g as (select doc_id, i, list_slice(ws, i + 1, i + 5) as g
      from (select doc_id, ws, unnest(range(0, len(ws) - 4)) as i from w)),
c as (select doc_id, i, count(*) over (partition by doc_id, g) as n from g),
p as (select doc_id, least(5, i - lag(i, 1, -5) over (partition by doc_id order by i)) as k from c where n > 1),
r as (select doc_id, cast(sum(k) as bigint) as k from p group by doc_id),
m as (select w.doc_id, cast(len(ws) as bigint) as n_words, cast(length(array_to_string(ws, '')) as bigint) as word_chars,
             cast(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) as bigint) as n_symbols,
             cast(len(ls) as bigint) as n_lines, cast(len(ls) - len(list_distinct(ls)) as bigint) as n_dup_lines,
             coalesce(r.k, 0) as n_repeat_words,
             length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) as n_capitals,
             length(text) - length(regexp_replace(text, '[!?]', '', 'g')) as n_marks
      from w left join r on w.doc_id = r.doc_id),
b as (select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       not (base_failed or 100 * n_symbols > 4 * word_chars or 100 * n_dup_lines > 50 * n_lines
            or word_chars < 2 * n_words or word_chars > 20 * n_words
            or 100 * n_capitals > 40 * word_chars or 100 * n_marks > 10 * word_chars) as kept
from b
"""


QUERIES = {"op1_lm_lattice": op1_lm_lattice, "op2_token_store": op2_token_store, "op3_license_scan": op3_license_scan, "op4_knn_quality": op4_knn_quality, "op5_paragraph_dedup": op5_paragraph_dedup, "op6_warc_zip": op6_warc_zip, "op7_spaced_seeds": op7_spaced_seeds, "op8_jaccard_groups": op8_jaccard_groups, "op9_pack_pow2": op9_pack_pow2, "op10_rule_cascade": op10_rule_cascade}
ORACLES = {"op6_warc_zip": OP6_SQL, "op10_rule_cascade": OP10_SQL}
