"""Post-level features (P10-P19 on posts, D2) and the flagged / unflagged split."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaestio.functions import keywords as K
from quaestio.functions import text as T


def flag_posts(posts: DataFrame, question_count_mode: str = "chars") -> DataFrame:
    """Add ``num_questions, has_question, has_disinfo_hashtags, has_disinfo_text,
    has_disinfo_text_or_hashtags, has_negation``.

    Text keywords use the hashtag table (Q2: the two tables are the same object in
    the reference).
    An unknown language gives NULL flags (Q3).
    """
    text = F.col("full_text")
    lang = F.col("language")
    return (
        posts.withColumn("num_questions", T.num_questions(text, question_count_mode))
        .withColumn("has_question", F.col("num_questions") > 0)
        .withColumn("has_disinfo_hashtags", K.has_any_tag_by_language(F.col("hashtags"), lang, "disinfo_hashtags"))
        .withColumn("has_disinfo_text", K.has_any_keyword_by_language(text, lang, "disinfo_hashtags"))
        .withColumn("has_disinfo_text_or_hashtags", F.col("has_disinfo_text") | F.col("has_disinfo_hashtags"))
        .withColumn("has_negation", K.has_any_keyword_by_language(text, lang, "negations"))
    )


QUESTION_TEXT_FLAGS = {
    "has_negation": "negations",            # P19
    "has_ref_to_other": "pronouns_other",   # P22
    "has_ref_to_group": "pronouns_group",   # P23
    "has_conjunction": "conjunctions",      # P21
    "has_leveler": "levelers",              # P20
}


def flag_question_text(df: DataFrame, text_col: str = "text", language_col: str = "language") -> DataFrame:
    """The five keyword features of a question (P19-P23) in one projection."""
    t, lang = F.col(text_col), F.col(language_col)
    return df.withColumns({name: K.has_any_keyword_by_language(t, lang, cat)
                           for name, cat in QUESTION_TEXT_FLAGS.items()})


def split_by_flag(df: DataFrame, flag: str = "has_disinfo_text_or_hashtags") -> tuple[DataFrame, DataFrame]:
    """rows with the flag set, rows without it (NULL counts as not set)."""
    cond = F.coalesce(F.col(flag), F.lit(False))
    return df.filter(cond), df.filter(~cond)
