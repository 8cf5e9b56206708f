"""The queries of the corpus operators: each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from plumbline.llm import idfile, importance, langid, media, nearest, neardup, packing, segment, sharding, transducer
from plumbline.llm.common import table


def op1_media_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media(table(spark, sf_dir, "documents"))


def op2_sampled_splitters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


def op7_n_best_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.n_best(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op3_multiprobe_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.search(table(spark, sf_dir, "embeddings"))


def op4_context_mixed_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return idfile.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op5_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), words=3, percent=85)


def op9_transducer_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transducer.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op10_byte_cnn_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.language(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_media_fingerprints, op2_sampled_splitters, op3_multiprobe_neighbours, op4_context_mixed_ids, op5_importance_resampling,
        op6_minhash_near_dedup, op7_n_best_pieces, op8_best_fit_packing, op9_transducer_token_counts, op10_byte_cnn_language,
    )
}
#: All pairs that share a shingle; the others' methods can't be put in SQL.
ORACLE_SQL: dict[str, str] = {
    "op6_minhash_near_dedup": r"""with recursive w as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') ws from documents),
sets as (select doc_id, case when len(ws) >= 3 then list_distinct(list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i:i + 2], chr(1)))) when len(ws) > 0 then [array_to_string(ws, chr(1))] else [] end s from w),
one as (select doc_id, len(s) n, unnest(s) sh from sets),
links as (select a.doc_id x, b.doc_id y from one a join one b on a.sh = b.sh and a.doc_id < b.doc_id group by a.doc_id, b.doc_id, a.n, b.n having 100 * count(*) >= 85 * (a.n + b.n - count(*))),
both_ways as (select x, y from links union all select y, x from links),
r as (select doc_id x, doc_id y from sets union select r.x, b.y from r join both_ways b on r.y = b.x)
select doc_id, len(s)::bigint n_shingles, c component_id, c = doc_id kept from sets join (select x doc_id, min(y) c from r group by x) using (doc_id)"""
}
