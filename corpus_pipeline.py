"""From raw documents to packed sequences: quality rules, line dedup, near-duplicate removal, personal data, packing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumspark.llm import jaccard_join, line_dedup, packing, pii, quality
from vellumspark.llm.common import materialise
from vellumspark.llm.queries import vocabulary

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Sites on which a line of 50 words and more is a repeated passage: such lines do not coincide by chance.  More sites than there are.
PASSAGE_SITES, NEVER = 2, 1 << 40
Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def recounted(docs: DataFrame) -> DataFrame:
    """The columns of documents, with n_chars of the text as it is now."""
    return docs.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long")).select(*COLUMNS)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, as they are."""
    return quality.keep_quality(docs).select(*COLUMNS)


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without boilerplate lines; one that had nothing else goes, as another document keeps its lines."""
    return recounted(line_dedup.dedup_lines(docs).where("n_removed = 0 or n_removed < n_lines"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, without the long passages that one on another site keeps.

    Passages go here and not with the boilerplate, as near copies would lose most of their lines there and could no longer be matched.
    """
    kept = materialise(jaccard_join.keep_one(docs).select(*COLUMNS), "near")
    cut = line_dedup.dedup_lines(kept, min_sites=NEVER, short_sites=NEVER, long_sites=PASSAGE_SITES)
    return recounted(cut.where("n_removed = 0 or n_removed < n_lines"))


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind."""
    return recounted(pii.redact(docs))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences."""
    return packing.pack(docs, vocabulary())


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("line_dedup", drop_boilerplate),
    ("ngram_jaccard", drop_near_copies),
    ("pii", redact_pii),
    ("packing", pack_sequences),
]

#: SQL can express neither the fitted rules nor the vocabulary; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each one's result written before the next reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
