"""Post sources (S1-S5, S7, S14) and the normalisation applied at load time.

A post table has the D1 columns ``id, created_at, full_text, quoted_text, hashtags,
favorite_count, retweet_count``; any other columns pass through untouched.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaestio.functions import text as T
from quaestio.sources import csv_splits

CSV_OPTIONS = {
    "header": "true",
    "multiLine": "true",
    "quote": '"',
    "escape": '"',
    "mode": "PERMISSIVE",
}

#: Types of the columns that the stages add, for tables read back from CSV.
STAGE_TYPES = {
    **{c: "boolean" for c in ("has_question", "has_disinfo_hashtags", "has_disinfo_text", "has_disinfo_text_or_hashtags", "has_negation",
                              "has_ref_to_other", "has_ref_to_group", "has_conjunction", "has_leveler", "has_question_mark",
                              "subj_verb_inversion")},
    **{c: "int" for c in ("num_questions", "tweet_num_questions", "j", "offset")},
    "tweet_has_question": "boolean",
}

POST_TEXT_COLUMNS = ("full_text", "quoted_text")


def read_posts_csv(spark: SparkSession, path: str) -> DataFrame:
    """S1 + S3: CSV scan of raw posts, every column as text, then typed.

    ``created_at`` goes through P1, ``hashtags`` through P2 and the two text columns
    get NULL -> ''. Quoted line breaks do not keep a file from being split (see
    :mod:`quaestio.sources.csv_splits`). There is no row cap: ``limit`` on the result is the
    user's to add.
    """
    return type_posts(csv_splits.read_csv(spark, path))


def type_posts(raw: DataFrame) -> DataFrame:
    """Apply the two per-column converters and the NULL -> '' fill."""
    cols = set(raw.columns)
    out = raw
    if "hashtags" in cols and dict(raw.dtypes)["hashtags"] == "string":
        out = out.withColumn("hashtags", T.parse_hashtag_list(F.col("hashtags")))
    if "created_at" in cols and dict(raw.dtypes)["created_at"] == "string":
        out = out.withColumn("created_at", T.parse_date(F.col("created_at")))
    for c in ("favorite_count", "retweet_count"):
        if c in cols and dict(raw.dtypes)[c] == "string":
            out = out.withColumn(c, F.col(c).try_cast("bigint"))
    fill = [c for c in POST_TEXT_COLUMNS if c in cols]
    if fill:
        out = out.fillna("", fill)
    return out


def normalise_posts(posts: DataFrame, dataset: str | None = None) -> DataFrame:
    """P3 on both text columns, S4 provenance tag and S5 language."""
    out = posts
    for c in POST_TEXT_COLUMNS:
        if c in out.columns:
            out = out.withColumn(c, T.repair_whitespace(F.col(c)))
    if dataset is not None:
        out = out.withColumn("dataset", F.lit(dataset))
    return out.withColumn("language", T.language_from_dataset(F.col("dataset")))


def load_raw_posts(spark: SparkSession, dataset_paths: dict[str, str]) -> DataFrame:
    """Read every named CSV, tag it with its dataset name and stack them by column name."""
    frames = [normalise_posts(read_posts_csv(spark, path), name) for name, path in dataset_paths.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def read_table(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Re-read a stage output. Parquet keeps arrays and '' (Q20); the CSV
    variant re-parses list text with P2 and casts the stages' known columns (STAGE_TYPES), in one
    pass over the file; other columns stay text."""
    if fmt == "parquet":
        return spark.read.parquet(path)
    df = type_posts(csv_splits.read_csv(spark, path))
    return df.withColumns({c: F.col(c).try_cast(t) for c, t in STAGE_TYPES.items() if dict(df.dtypes).get(c) == "string"})
