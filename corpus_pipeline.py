"""A corpus cleaned and encoded in stages, each written as Parquet and read again by the next."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from adlumen.llm.common import documents, forget, free_names, stored
from adlumen.llm.decontaminate import drop_contaminated
from adlumen.llm.exact_dedup import drop_copies
from adlumen.llm.jaccard_join import keep_one_of_each
from adlumen.llm.piece_codec import digests, encode_documents
from adlumen.llm.toxicity import REJECT, labels_of, train_on, with_score

# No SQL can say what the classifier does; the stages are tested against brute force.
ORACLE_SQL = None


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts that score as toxic go; the classifier learns from the labelled ones.

    Null and empty texts stay; repeated rows are judged alike.
    """
    [score] = free_names(docs, "_score")
    scored = with_score(docs, train_on(docs, labels_of(spark, sf_dir)), score)
    return scored.filter(F.col(score) < REJECT).drop(score)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the smallest id stays; null counts as empty, of repeated rows one stays."""
    return drop_copies(docs)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the smallest id stays; texts without words all stay."""
    return keep_one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts that hold a window of a benchmark item go; null and empty ones stay."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of what is left: their number and digests, and whether the library agrees.

    A row for each document; null and empty texts have no ids.
    """
    return digests(encode_documents(docs, public_tokenizers.path("piece_bpe_32k.model")))


STAGES = [
    ("toxicity", toxicity),
    ("exact_dedup", exact_dedup),
    ("jaccard_join", jaccard_join),
    ("decontamination", decontamination),
    ("sentencepiece", sentencepiece),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; each stage's input goes once it has been read."""
    docs, before = documents(spark, sf_dir), None
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
        if before is not None:
            forget(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
