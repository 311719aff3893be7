"""A training-data pipeline over `documents`, made of operators of tabulon.llm.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next one's docs. All but the last return the columns of documents.

Defined cases: a null or empty text is scored as one without features, is near to nothing, holds no benchmark words
and no secret, and is tokenised to no ids; a null stays null until the last stage. Texts of any length are taken
whole. Repeated rows and rows that share an id are documents of their own in all stages but the second, which leaves
one row of each group of near texts. A null id is kept like any other. Empty tables give no rows, and without labels
every document scores 0.5, so the first stage keeps none. Other columns pass through, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.llm import decontaminate, nearpairs, pieces, quality, secrets
from tabulon.llm.common import Scratch, dropped_after, fresh, table


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality classifier scores below its threshold."""
    model = quality.train(docs, table(spark, sf_dir, "labels"), quality.learns())
    kept = quality.scored(docs, model).filter(F.col("score") >= quality.THRESHOLD)
    return kept.select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of near duplicates: 0.8 or more of five-word shingles.

    Each row is a document of its own, so of repeated rows, or of near texts under one id, one row stays; texts
    that differ stay under one id. A null id comes after all others. Texts without words link with nothing and stay.
    """
    scratch = Scratch(spark, "pipeline-near")
    row = fresh(docs, "row")
    rows = scratch.save(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    groups = nearpairs.near_groups(scratch, rows.select(F.col(row).alias("doc_id"), F.col("doc_id").alias("own_id"), "text"), width=5, percent=80)
    first = groups.groupBy("component_id").agg(F.min(F.struct(F.col("own_id").isNull(), "own_id", "doc_id")).alias("at"))
    stay = scratch.save(first.select(F.col("at.doc_id").alias(row)), "stay")
    return rows.join(stay.hint("merge"), row, "left_semi").select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a window of a benchmark item."""
    found = decontaminate.contamination(docs, table(spark, sf_dir, "benchmark"))
    return found.filter("n_hit = 0").select(*docs.columns)


def secret_removal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces the secrets in texts by a mark; n_chars counts the new text."""
    clean = secrets.redact(Scratch(spark, "pipeline-secrets"), docs)
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def tokenisation(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, and whether decoding them gives the text again."""
    coded = pieces.encode_decode(docs.select("doc_id", "text"))
    plain = F.replace(F.coalesce("text", F.lit("")), F.lit(pieces.SPACE), F.lit(" "))
    return coded.select("doc_id", "n_tokens", "ids", (F.col("decoded") == plain).alias("exact"))


STAGES = [
    ("quality classifier", quality_filter),
    ("MinHash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("secret scans", secret_removal),
    ("SentencePiece encoding and decoding", tokenisation),
]

#: The first stage's model and the fourth's forest have no SQL; tests hold each stage and run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage, from the table documents."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        with dropped_after():
            docs = scratch.save(stage(spark, docs, sf_dir), f"stage-{k}")
        scratch.drop(f"stage-{k - 1}")
    return docs
