"""The registered queries: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from adlumen.llm import pii, suffix_tree_lm
from adlumen.llm.collocations import best_phrases, mine_phrases
from adlumen.llm.common import documents, scratch_path
from adlumen.llm.decontaminate import find_contamination
from adlumen.llm.exact_dedup import mark_copies
from adlumen.llm.hard_negatives import mine_hard_negatives
from adlumen.llm.jaccard_join import link_documents
from adlumen.llm.piece_codec import digests, encode_documents
from adlumen.llm.quality_rules import apply_rules
from adlumen.llm.sharding import shard_documents
from adlumen.llm.suffix_dedup import remove_repeats
from adlumen.llm.toxicity import labels_of, score_documents
from adlumen.llm.warc import mean_payload, read_resolved, resolve_revisits, write_archives

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(function: Callable) -> Callable:
    QUERIES[function.__name__] = function
    return function


@query
def op1_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return shard_documents(documents(spark, folder))


@query
def op2_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    model = public_tokenizers.path("piece_bpe_32k.model")
    return digests(encode_documents(documents(spark, folder), model))


@query
def op3_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return score_documents(documents(spark, folder), labels_of(spark, folder))


@query
def op4_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return remove_repeats(documents(spark, folder)).drop("spans", "kept")


@query
def op5_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return mark_copies(documents(spark, folder))


@query
def op6_pii(spark: SparkSession, folder: str) -> DataFrame:
    return pii.digests(pii.find_personal_data(documents(spark, folder)))


@query
def op7_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return link_documents(documents(spark, folder))


@query
def op8_lm_scoring(spark: SparkSession, folder: str) -> DataFrame:
    return suffix_tree_lm.score_documents(documents(spark, folder))


@query
def op9_warc(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    pages = spark.read.parquet(f"{folder}/pages.parquet")
    write_archives(resolve_revisits(pages), path, mean_bytes=mean_payload(pages))
    return read_resolved(spark, path)


@query
def op10_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return find_contamination(documents(spark, folder),
                              spark.read.parquet(f"{folder}/benchmark.parquet"))


@query
def op11_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return apply_rules(documents(spark, folder))


@query
def op12_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    return mine_hard_negatives(spark.read.parquet(f"{folder}/embeddings.parquet"))


@query
def op13_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return best_phrases(mine_phrases(documents(spark, folder)))
