"""From raw documents to packed sequences: five stages, each applying one operator of ``panelmill.llm``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelmill.llm import decontaminate, jaccard, lines, packing, quality
from panelmill.llm.common import read_table, stored
from panelmill.llm.queries import find_package, tokenizer

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
KEEP_SCORE = 0.7

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores at least ``KEEP_SCORE``; it learns from all labelled documents here.

    Rows of one id are judged by the worst of them.  A row without an id has no
    label to learn from and is judged by its text alike.
    """
    find_package(spark)
    scored = quality.classify(docs, read_table(spark, sf_dir, "labels"), usable=F.col("doc_id").isNotNull())
    scored = scored.groupBy("doc_id").agg(F.min("score").alias("quality_score")).withColumnRenamed("doc_id", "scored_id")
    kept = docs.join(scored, docs["doc_id"].eqNullSafe(scored["scored_id"]))
    return kept.where(F.col("quality_score") >= KEEP_SCORE).select(*[docs[c] for c in COLUMNS])


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the lines that a later document repeats; ``n_chars`` follows the text."""
    found = lines.dedup_lines(docs.select(*COLUMNS))
    text = F.when(F.col("n_dropped") > 0, F.col("kept")).otherwise(F.col("text"))
    n_chars = F.when(F.col("n_dropped") > 0, F.char_length("kept").cast("long")).otherwise(F.col("n_chars"))
    return found.withColumns({"text": text, "n_chars": n_chars}).select(*COLUMNS)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies: five-word shingles, similarity 0.8 or more.

    Texts without words are in no group and stay, and so do rows without an id.
    """
    find_package(spark)
    found = jaccard.jaccard_components(docs, width=5, percent=80, count_links=False)
    gone = found.where(F.col("component_id") != F.col("doc_id")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*COLUMNS)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark, literally or as a paraphrase."""
    find_package(spark)
    found = decontaminate.find_leaks(docs, read_table(spark, sf_dir, "benchmark"))
    return docs.join(found.select("doc_id").distinct(), "doc_id", "left_anti").select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents and their places in sequences of at most 1,024 tokens."""
    find_package(spark)
    return packing.pack_documents(docs, tokenizer("byte_bpe_50k.json"), end_id=0)


STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", keep_quality),
    ("line dedup", drop_repeated_lines),
    ("n-gram Jaccard join", keep_one_of_near_copies),
    ("benchmark decontamination", drop_leaks),
    ("packing", pack),
]

# A classifier, a singular value decomposition and a tokenizer are no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
