"""The corpus pipeline: quality rules, line dedup, near-duplicate documents, mixing, packing.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and returns
a DataFrame, which ``run`` writes as Parquet and reads again as the next one's docs. All
but the last return the columns of documents.

Defined results, for every stage: a null or empty text has no words, so the quality rules
reject it; a null doc_id is carried along and comes after all others where the smallest
one stays; rows that repeat in full are one group of copies, of which one row stays; among
documents of equal standing the smallest doc_id stays. Very long texts are read whole. Columns
beyond those of documents pass through unchanged, whatever their names, up to the mix; the last
stage returns pieces and their places alone. An empty table gives an empty result at every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaestio.llm import jaccard, line_dedup, mixing, packing, quality
from quaestio.llm.shared import stored


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the label model reject go: null and empty texts among
    them (under 50 words). Rows that repeat are judged alike."""
    return quality.keep(docs)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines equal or near to an earlier line go; n_chars follows the text. A document
    goes only if it had lines with words and all of them went (every line of it stands
    in earlier documents)."""
    done = line_dedup.dedup(docs)
    done = done.filter(~F.col("emptied"))
    if "n_chars" in docs.columns:
        done = done.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.length("text").cast("long"))
                               .otherwise(F.col("n_chars")))
    return done.select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: documents whose sets of five-word
    shingles have a Jaccard similarity of 0.8 or more, and what they link. (op9's 3 words
    and 0.9 are that query's contract alone.)"""
    return jaccard.keep_one(docs, width=5, similarity=0.8)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix of its source takes it; a null source is a source
    of its own, ties of the hash order fall to the smaller doc_id."""
    return mixing.emit(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences of 2048 tokens; longer
    documents are cut, a null text would be its separator alone."""
    return packing.pack(docs)


STAGES = [("quality rules", quality_rules), ("line dedup", drop_lines), ("n-gram Jaccard join", near_duplicates),
          ("mixing sources", mix_sources), ("best-fit packing", pack)]

#: Tokenizing, the label model and the packing search are beyond SQL;
#: tests/llm/test_pipeline.py compares each stage with a plain version of it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return docs
