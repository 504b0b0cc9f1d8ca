"""Sentence split and question candidates.

G1 is rule-based: a sentence ends after a run of terminators (``. ! ? …``), optional
closing quotes/brackets and at least one space, TAB or newline. The text is cut right
after that whitespace, so the pieces concatenate back to the input exactly; each
piece's start offset is the sum of the earlier pieces' lengths and its text is the
piece without the trailing whitespace. Everything is per-row array work: no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaestio.functions import keywords as K
from quaestio.functions import text as T

SENTENCE_END = r"""([.!?…]+["'”’)\]]*)([ \t\n]+)"""
_MARK = "\u0001"
SPLIT_BLOCK = 32

KEEP_POST_KEYS = ["created_at", "favorite_count", "retweet_count", "dataset", "language"]


def split_sentences(text: Column) -> Column:
    """G1: ``array<struct<start INT, text STRING>>`` in text order.

    The running offset is carried over blocks of SPLIT_BLOCK pieces: appending copies an
    array, so pieces are appended to short arrays, which are joined at the end.
    """
    marked = F.regexp_replace(text, SENTENCE_END, "$1$2" + _MARK)
    empty = F.array().cast("array<struct<start:int,text:string>>")

    def piece(acc, s):
        return F.struct(
            F.array_append(acc["out"], F.struct(acc["pos"].alias("start"),
                                                F.rtrim(s, F.lit(" \t\n")).alias("text"))).alias("out"),
            (acc["pos"] + F.length(s)).alias("pos"))

    def block(acc, b, pieces):
        one = F.aggregate(F.slice(pieces, b * SPLIT_BLOCK + 1, F.lit(SPLIT_BLOCK)),
                          F.struct(empty.alias("out"), acc["pos"].alias("pos")), piece)
        return F.get(F.transform(F.array(one), lambda x: F.struct(
            F.array_append(acc["out"], x["out"]).alias("out"), x["pos"].alias("pos"))), 0)

    def blocks(pieces):
        numbers = F.sequence(F.lit(0), F.floor((F.size(pieces) - 1) / SPLIT_BLOCK).cast("int"))
        start = F.struct(F.array().cast("array<array<struct<start:int,text:string>>>").alias("out"), F.lit(0).alias("pos"))
        return F.flatten(F.aggregate(numbers, start, lambda acc, b: block(acc, b, pieces), lambda acc: acc["out"]))
    return F.when(text.isNotNull(), F.get(F.transform(F.array(F.split(marked, _MARK)), blocks), 0))


def is_candidate(sentence_text: Column, language: Column) -> Column:
    """ends with a question mark (P12) or holds any question word of the language."""
    return T.ends_with_question_mark(sentence_text) | K.has_any_keyword_by_language(
        sentence_text, language, "wh_words_all")


def sentences(posts: DataFrame, text_col: str = "full_text") -> DataFrame:
    """All sentences of all posts, one row each: ``id, sent_no, start, text`` (+ language)."""
    return (posts.select("id", "language", F.posexplode_outer(split_sentences(F.col(text_col))).alias("sent_no", "s"))
            .filter(F.col("sent_no").isNotNull())
            .select("id", "language", "sent_no", F.col("s.start").alias("start"), F.col("s.text").alias("text")))


def question_candidates(posts: DataFrame, include_post_text: bool = False) -> DataFrame:
    """G2 + F1 + F2 + P9 + P26 + P27 + P28: post rows -> candidate question rows.

    The ordinal ``j`` counts F1 candidates within the post and is not renumbered
    when F2 drops an empty cleaned text (Q6). Post columns other than the kept keys
    are prefixed ``tweet_``; the two post text columns are dropped unless
    ``include_post_text`` (S11).
    """
    lang = F.col("language")
    # cleaned inside the array: a filter on a column would be pushed below the clean-up and repeat it
    cands = F.transform(F.filter(split_sentences(F.col("full_text")), lambda s: is_candidate(s["text"], lang)),
                        lambda s: F.struct(s["start"].alias("start"), T.clean_sentence(s["text"], lang).alias("text")))
    prefixed = [F.col(c).alias(c if c in KEEP_POST_KEYS else "tweet_" + c) for c in posts.columns]
    # The outer form keeps Catalyst from inferring a ``size(_cands) > 0`` filter that it
    # would push below the projection, evaluating the split twice; posts without
    # candidates give one NULL row, removed right after the generator.
    exploded = (posts.withColumn("_cands", cands)
                .select(*prefixed, F.posexplode_outer("_cands").alias("j", "cand"))
                .filter(F.col("j").isNotNull()))
    out = (exploded
           .withColumn("text", F.col("cand.text"))
           .filter(F.col("text") != "")
           .withColumn("id", T.question_id(F.col("tweet_id"), F.col("j")))
           .withColumn("offset", F.col("cand.start"))
           .withColumn("sent_start", F.col("cand.start"))
           .drop("cand"))
    if not include_post_text:
        out = out.drop("tweet_full_text", "tweet_quoted_text")
    return out


def order_question_columns(questions: DataFrame) -> DataFrame:
    """``id``, ``text`` first, then question columns, ``tweet_*`` last (stable), no parse."""
    cols = [c for c in questions.columns if c not in ("tokens", "sentences", "parse")]
    head = [c for c in ("id", "text") if c in cols]
    rest = sorted((c for c in cols if c not in head), key=lambda c: c.startswith("tweet_"))
    return questions.select(*head, *rest)
