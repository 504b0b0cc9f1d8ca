"""The run from post files to profiles and annotation sheets, stage by stage through files.

Every stage writes a table and the next one reads it back (S6-S13): raw CSV -> analysed
posts (by dataset) -> questions (by dataset) -> profiles and sheets. Tables partitioned by
dataset are overwritten dynamically: a run over some datasets replaces those and keeps the
others. Quality counts are observed while the tables are written (Q3).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from quaestio.functions import text as T
from quaestio.operators import profile, rules, sampling, sentences
from quaestio.plans import jobs
from quaestio.sources import posts as P
from quaestio.sources import sinks, testdata

Annotator = Callable[[DataFrame], DataFrame]


def observed_posts(posts: DataFrame, seen: Observation) -> DataFrame:
    """Analysed posts; when they are written ``seen`` holds how many there are, how many are
    of a language without vocabulary and how many have no date (absent or not readable)."""
    return posts.observe(seen, F.count(F.lit(1)).alias("posts"), F.count_if(F.col("language") == "???").alias("unknown_language"),
                         F.count_if(F.col("created_at").isNull()).alias("no_date"))


def observed_questions(questions: DataFrame, seen: Observation) -> DataFrame:
    """Classified questions; ``seen`` counts them, those without a class and those without any
    question word."""
    return questions.observe(seen, F.count(F.lit(1)).alias("questions"), F.count_if(F.col("structure").isNull()).alias("unclassified"),
                             F.count_if(F.col("qwords_functional") == "").alias("no_question_word"))


def overwrite_datasets(df: DataFrame, path: str) -> None:
    """Replace the partitions of the datasets that ``df`` holds; others stay. Rows of a dataset are
    brought together first, large datasets in several parts: files follow the size of the
    datasets, and not every task writes a file of every dataset."""
    df.hint("rebalance", F.col("dataset")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("dataset").parquet(path)


@dataclass
class Run:
    """Where a run's tables are, and what was observed while they were written."""
    posts: str
    questions: str
    sheets: str
    quality: dict[str, int] = field(default_factory=dict)


def run(spark: SparkSession, raw: DataFrame, out: str, annotator: Annotator, single_annotator: Annotator) -> Run:
    """Raw posts -> tables and sheets under ``out``."""
    done = Run(f"{out}/posts", f"{out}/questions", f"{out}/sheets")
    seen = Observation()
    overwrite_datasets(observed_posts(jobs.analysed_posts_from_raw(raw), seen), done.posts)
    done.quality |= seen.get
    posts = P.read_table(spark, done.posts)
    seen = Observation()
    classified = jobs.classify_questions(sentences.question_candidates(testdata.dealt(posts)), annotator)
    overwrite_datasets(observed_questions(classified, seen), done.questions)
    done.quality |= seen.get
    questions = P.read_table(spark, done.questions)
    lines = classification_lines(questions, single_annotator).unionByName(jobs.feature_sheet(questions))
    sinks.write_sheets(lines, done.sheets, mode="overwrite")
    return done


def classification_lines(questions: DataFrame, single_annotator: Annotator, k: int = sampling.PER_CLASS) -> DataFrame:
    """A14 from a question table without parses: the sampled texts are parsed again in
    single-sentence mode and rendered with the tags and structure found then (P30)."""
    picked = sampling.classification_sample(questions, k).withColumnRenamed("structure", "sampled_structure").withColumnRenamed("use", "sampled_use")
    parsed = rules.classified(picked, single_annotator, results=["tokens", "structure"])
    return parsed.select("language", F.lit("classification").alias("sheet"), F.concat_ws("/", "sampled_structure", "sampled_use").alias("section"),
                         "rank", T.render_tagged_line(F.col("tokens"), F.col("structure")).alias("line"))


def summary(spark: SparkSession, done: Run) -> DataFrame:
    """What a run wrote, read back: rows and a digest per dataset of each table, and per sheet."""
    def table(path: str, kind: str, content: list[str]) -> DataFrame:
        digest = F.conv(F.substring(F.md5(F.concat_ws("|", *content)), 1, 8), 16, 10).cast("bigint")
        return (P.read_table(spark, path).groupBy(F.col("dataset").alias("name"))
                .agg(F.count(F.lit(1)).alias("num_rows"), F.sum(digest).alias("digest"))
                .select(F.lit(kind).alias("kind"), "name", "num_rows", "digest"))
    value = F.conv(F.substring(F.md5("value"), 1, 8), 16, 10).cast("bigint")
    sheets = (spark.read.text(done.sheets, recursiveFileLookup=False).groupBy("language", "sheet")
              .agg(F.count(F.lit(1)).alias("num_rows"), F.sum(value).alias("digest"))
              .select(F.lit("sheet").alias("kind"), F.concat_ws("/", "language", "sheet").alias("name"), "num_rows", "digest"))
    return table(done.posts, "posts", ["id", "full_text"]).unionByName(
        table(done.questions, "questions", ["id", "text", "structure", "use", "qwords_functional"])).unionByName(sheets)


def profiles(spark: SparkSession, done: Run) -> dict[str, DataFrame]:
    """The profiles of a run's tables."""
    posts, questions = P.read_table(spark, done.posts), P.read_table(spark, done.questions)
    return {"posts_per_dataset": profile.posts_per_dataset(posts), "dates": profile.date_histogram(posts), "hashtags": profile.top_hashtags(posts),
            "columns": profile.schema_listing(posts), "samples": sampling.sample_posts(posts),
            "questions_per_dataset": profile.questions_per_dataset(questions), "feature_means": profile.question_feature_means(questions),
            "structure_use": profile.structure_use_counts(questions), "question_words": profile.top_functional_qwords(questions)}
