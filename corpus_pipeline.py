"""A corpus pipeline of five stages over `documents`; each stage's rows are written as Parquet and read by the next.

A stage takes (spark, docs, sf_dir) and returns a DataFrame: the columns of documents, and from the last the packed
doc_id names a document; null and empty texts are kept as they are.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from addrloom.llm import common, line_dedup, ngram_join, packing, quality, toxicity

NEAR_WORDS, NEAR_SIMILARITY = 5, Fraction(4, 5)
OWNER = "pipeline"  # of the tables that a stage's result reads; the next stage, which begins once that is stored, deletes them


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on this stage's own input, accepts."""
    with common.tables_of(spark, OWNER):
        scored = quality.score(docs, quality.fit(docs))
    return scored.where(quality.accepted()).select(*docs.columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose calibrated toxicity, learned from the labels of this stage's own input, stays below 0.7."""
    with common.tables_of(spark, OWNER):
        model = toxicity.fit(docs, common.read_table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).where(F.col("score") < toxicity.PREDICT_AT).select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without the lines that repeat an earlier line (at most 3 edits apart, one for each 12 characters).

    A document whose lines all repeat earlier ones goes; one that was empty before stays, as do all lines without a doc_id.
    """
    with common.tables_of(spark, OWNER):
        return line_dedup.without_repeats(docs, line_dedup.line_classes(docs), drop_emptied=True)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document, by id, of every group of near copies: five-word shingles, similarity 0.8 or more.

    Rows without a doc_id have no place in that order: all are kept, and they stand for no group.
    """
    with common.tables_of(spark, OWNER):
        groups = ngram_join.jaccard_components(docs.where("doc_id is not null"), NEAR_WORDS, NEAR_SIMILARITY)
    first = groups.where("doc_id = component_id").select("doc_id").distinct()
    return docs.join(first, "doc_id").select(*docs.columns).unionAll(docs.where("doc_id is null"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 4096 tokens."""
    import public_tokenizers

    with common.tables_of(spark, OWNER):
        return packing.digests(packing.pack(docs, public_tokenizers.path("word_bpe_49k.json")))


STAGES = [
    ("quality", keep_quality),
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("near_copies", drop_near_copies),
    ("packing", pack),
]
ORACLE_SQL = None  # EM, boosted trees and edit joins are beyond SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows of the whole `documents`; a stage's stored rows are deleted once the next one's are.

    The rows returned read the last tables, so use them before this thread runs the pipeline again.
    """
    docs, old = common.documents(spark, sf_dir), None
    for name, stage in STAGES:
        df = stage(spark, docs, sf_dir)
        if stage is STAGES[-1][1]:
            return df
        path = f"{common.shared_dir(spark)}/addrloom-pipeline/{name}-{common.uuid.uuid4().hex}"
        df.write.parquet(path)
        docs = spark.read.schema(df.schema).parquet(path)
        if old:
            common.delete(spark, old)
        old = path
    return docs


QUERIES = {"pipeline": run}
ORACLES: dict = {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
