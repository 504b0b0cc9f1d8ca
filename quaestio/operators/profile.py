"""Profiles: counts, shares, histograms, top-k and distinct values.

All aggregations are plain ``groupBy`` with partial (map-side) aggregation, so a hot
dataset or hot hashtag costs one pre-aggregated row per task before the shuffle.
Top-k per group uses ``row_number() <= k``, which Spark plans as a partial
``WindowGroupLimit`` before the exchange, so at most k rows per group and task move.
NULL group keys are dropped first, as pandas ``groupby`` does (Q18).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _share(c: str) -> F.Column:
    return F.avg(F.col(c).cast("int"))


def posts_per_dataset(posts: DataFrame) -> DataFrame:
    """A1 + A2 + A3 + A4 (+ the negation share) per dataset."""
    return (posts.filter(F.col("dataset").isNotNull()).groupBy("dataset").agg(
        F.count("id").alias("num_posts"),
        _share("has_question").alias("share_question"),
        _share("has_disinfo_hashtags").alias("share_disinfo_hashtags"),
        _share("has_disinfo_text").alias("share_disinfo_text"),
        _share("has_negation").alias("share_negation"),
    ))


def date_histogram(posts: DataFrame, unit: str | None = None) -> DataFrame:
    """A5: posts per (created_at, dataset); ``unit`` ('week', 'month', ...) bins the date."""
    d = F.col("created_at")
    key = d if unit is None else F.date_trunc(unit, d).cast("date")
    return (posts.filter(d.isNotNull() & F.col("dataset").isNotNull())
            .groupBy(key.alias("created_at"), "dataset").agg(F.count(F.lit(1)).alias("num_posts")))


def top_hashtags(posts: DataFrame, k: int = 100) -> DataFrame:
    """A6 (with G3): the k most frequent hashtags per dataset, every occurrence counted;
    ties broken by tag ascending (Q15)."""
    counts = (posts.filter(F.col("dataset").isNotNull())
              .select("dataset", F.explode("hashtags").alias("hashtag"))
              .groupBy("dataset", "hashtag").agg(F.count(F.lit(1)).alias("num")))
    w = Window.partitionBy("dataset").orderBy(F.col("num").desc(), F.col("hashtag"))
    return (counts.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k))


def questions_per_dataset(questions: DataFrame) -> DataFrame:
    """A7."""
    return (questions.filter(F.col("dataset").isNotNull()).groupBy("dataset")
            .agg(F.count("id").alias("num_questions")))


QUESTION_FEATURES = ["has_negation", "has_ref_to_other", "has_ref_to_group", "has_conjunction", "has_leveler",
                     "has_question_mark", "subj_verb_inversion"]


def question_feature_means(questions: DataFrame) -> DataFrame:
    """Mean of the seven boolean features per dataset; NULL is skipped, all-NULL -> NULL."""
    return (questions.filter(F.col("dataset").isNotNull()).groupBy("dataset")
            .agg(*[_share(c).alias(f"mean_{c}") for c in QUESTION_FEATURES]))


def structure_use_counts(questions: DataFrame) -> DataFrame:
    """Questions per dataset x structure x use."""
    keys = ["dataset", "structure", "use"]
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).isNotNull()
    return questions.filter(cond).groupBy(*keys).agg(F.count("id").alias("num_questions"))


def top_functional_qwords(questions: DataFrame, k: int = 10) -> DataFrame:
    """A10: the k most frequent (dataset, qwords_functional) pairs over all datasets;
    '' is a value; ties by keys ascending (Q15). Planned as TakeOrderedAndProject."""
    return (questions.filter(F.col("dataset").isNotNull() & F.col("qwords_functional").isNotNull())
            .groupBy("dataset", "qwords_functional").agg(F.count("id").alias("num_questions"))
            .orderBy(F.col("num_questions").desc(), "dataset", "qwords_functional").limit(k))


def distinct_datasets(df: DataFrame) -> DataFrame:
    """A11."""
    return df.select("dataset").filter(F.col("dataset").isNotNull()).distinct()


def schema_listing(df: DataFrame) -> DataFrame:
    """The columns, their types and how many of their values are not NULL."""
    counted = df.agg(*[F.count(F.col(c)).alias(c) for c in df.columns])
    entries = [F.struct(F.lit(i).alias("position"), F.lit(c).alias("column_name"), F.lit(t).alias("data_type"),
                        F.col(c).alias("num_values")) for i, (c, t) in enumerate(df.dtypes)]
    return counted.select(F.inline(F.array(*entries)))


def union_datasets(frames: list[DataFrame]) -> DataFrame:
    """Union all by column name (missing columns become NULL)."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out
