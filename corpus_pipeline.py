"""From ``documents`` to packed training sequences: language, quality,
near-duplicates, packing. Each stage works on all that the one before it kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import common, importance, langid, neardup, packing

#: A prediction less sure than this rejects a document, as does having no letter.
LEAST_SCORE = 0.3


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language the network knows (op 10); trained on those of
    them that aren't held out. Where these teach none, only documents without a
    letter go."""
    net = langid.fit(docs)
    if net is None:
        return docs.where(F.col("text").cast("string").rlike(r"\p{L}"))
    hidden, restored = common.aside(docs)
    scored = langid.identify(hidden, net)
    return restored(scored.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling selects (op 5)."""
    return importance.selected(docs, common.table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (op 6), by five-word
    shingles and a similarity of 0.8; rows without an id take no part and stay.
    Rows of one id are one document: of equal texts one row stays, unlike texts
    under the id that stays are all kept, so no text is lost."""
    kept = neardup.near_duplicates(docs.select("doc_id", "text"), words=5, percent=80).where("kept").select("doc_id")
    one = docs.join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return one.unionByName(docs.where("doc_id is null"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 4096 tokens and their places in sequences (op 8)."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("language", language), ("quality", quality), ("near_duplicates", near_duplicates), ("packing", packed)]

#: Training, hashing and tokenizing can't be put in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written as Parquet and read again by the next."""
    docs = common.table(spark, sf_dir, "documents")
    folder = common.shared_dir(spark)
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = common.written(spark, docs, f"{folder}/stage{k}")
    return docs
