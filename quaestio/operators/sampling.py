"""Stratified, hash-ordered samples (A13-A15, F5, A12) and annotation sheet rows.

A sample of ``k`` rows per group is ``row_number() over (partition by group order by
md5(seed || key)) <= k``: deterministic, identical in any engine with md5, and planned
with a partial ``WindowGroupLimit`` so each task ships at most k rows per group to the
shuffle, however large (or skewed) a group is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quaestio.functions import text as T

DEFAULT_SEED = "12345"
MAX_CHARS = 70            # F5: keep texts shorter than this, unless the caller says otherwise
PER_CLASS = 20            # A14
PER_FEATURE = 50          # A15
SHEET_FEATURES = ["has_negation", "has_ref_to_other", "has_ref_to_group", "has_conjunction", "has_leveler"]


def sample_key(key: Column, seed: str = DEFAULT_SEED) -> Column:
    return F.md5(F.concat(F.lit(seed), key.cast("string")))


def sample_per_group(df: DataFrame, group_cols: list[str], k: int, key_col: str,
                     seed: str = DEFAULT_SEED) -> DataFrame:
    """At most ``k`` rows per group, chosen by the hash order of ``key_col``; adds ``rank``."""
    w = Window.partitionBy(*group_cols).orderBy(sample_key(F.col(key_col), seed), F.col(key_col))
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def sample_posts(posts: DataFrame, k: int = 10, flag: str = "has_disinfo_text_or_hashtags",
                 seed: str = DEFAULT_SEED) -> DataFrame:
    """A13 (+F4): up to k posts per dataset and flag value. Only ids are ranked; the texts
    are joined to the ids that were picked (at most k a group, so the join's one side stays
    small whatever the posts hold)."""
    groups = ["dataset", "flag"]
    base = (posts.filter(F.col("dataset").isNotNull())
            .withColumn("flag", F.coalesce(F.col(flag), F.lit(False))).select(*groups, "id", "full_text"))
    picked = sample_per_group(base.select(*groups, "id"), groups, k, "id", seed).drop("rank").distinct()
    return sample_per_group(base.join(picked, [*groups, "id"]), groups, k, "id", seed)


def short_distinct_texts(questions: DataFrame, group_cols: list[str], max_chars: int = MAX_CHARS) -> DataFrame:
    """A12 + F5: distinct texts per group, shorter than ``max_chars`` characters."""
    return (questions.filter(F.length("text") < max_chars)
            .select(*group_cols, "text").dropDuplicates([*group_cols, "text"]))


def classification_sample(questions: DataFrame, k: int = PER_CLASS, seed: str = DEFAULT_SEED) -> DataFrame:
    """Per language, structure and use, up to k distinct short texts (the rows of a
    classification sheet before they are parsed again, see plans/file_job.py)."""
    keys = ["language", "structure", "use"]
    base = short_distinct_texts(questions.filter(F.col("structure").isNotNull() & F.col("use").isNotNull()), keys)
    return sample_per_group(base, keys, k, "text", seed)


def feature_sample(questions: DataFrame, k: int = PER_FEATURE, features: list[str] = SHEET_FEATURES,
                   seed: str = DEFAULT_SEED, max_chars: int = MAX_CHARS) -> DataFrame:
    """Per (language, feature, value) up to k distinct short texts. NULL feature values are skipped
    (pandas groupby). A text is shuffled once, with the values it has of every feature; the rows
    a feature and value are distinct then, and only sampled ones move again."""
    values = (questions.filter(F.length("text") < max_chars)
              .select("language", "text", *[F.col(f).cast("boolean").alias(f) for f in features]).groupBy("language", "text")
              .agg(*[x for f in features for x in (F.min(f).alias(f"min_{f}"), F.max(f).alias(f"max_{f}"))]))
    base = (values.select("language", "text", *[F.array_distinct(F.array_compact(F.array(f"min_{f}", f"max_{f}"))).alias(f) for f in features])
            .unpivot(["language", "text"], features, "feature", "values")
            .select("language", "feature", F.explode("values").alias("value"), "text"))
    return sample_per_group(base, ["language", "feature", "value"], k, "text", seed)


def feature_sheet_lines(sample: DataFrame) -> DataFrame:
    """S13 body: section header per (feature, value) and one line per sampled text."""
    body = sample.select("language", F.replace(F.col("feature"), F.lit("_"), F.lit("-")).alias("sheet"),
                         F.col("value").cast("string").alias("section"), "rank", T.one_line(F.col("text")).alias("line"))
    headers = (sample.select("language", "feature", "value").distinct()
               .select("language", F.replace(F.col("feature"), F.lit("_"), F.lit("-")).alias("sheet"),
                       F.col("value").cast("string").alias("section"), F.lit(0).alias("rank"),
                       F.concat(F.lit("// These questions are predicted to have "), F.col("feature"), F.lit(" == "),
                                F.initcap(F.col("value").cast("string")), F.lit(":")).alias("line")))
    return headers.unionByName(body)
