"""Scalar column expressions for dates, text clean-up and small lookups.

Every function takes and returns a :class:`Column`; nothing here leaves the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Python's str.strip() whitespace: \s (ASCII) + separators + the C0 group separators + NEL.
PY_WS = r"[\t\n\x0B\f\r\x1C-\x1F\x{85}\p{Z}]"
#: The same characters one by one.
PY_WS_CHARACTERS = "\t\n\x0b\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"

LANGUAGE_CODES = {"nl": "dutch", "fr": "french", "it": "italian", "en": "english"}


def py_strip(c: Column) -> Column:
    """Remove leading and trailing whitespace the way ``str.strip()`` does (Q19). Trimming looks
    at the ends alone; a pattern would be tried at every character."""
    return F.btrim(c, F.lit(PY_WS_CHARACTERS))


def parse_date(c: Column) -> Column:
    """``yyyy-MM-dd HH:mm:ss``, else ``yyyy-MM-dd``, else NULL; keep the date part.
    Months, days and times of one digit are fine."""
    return F.coalesce(
        F.try_to_timestamp(c, F.lit("yyyy-M-d H:m:s")),
        F.try_to_timestamp(c, F.lit("yyyy-M-d")),
    ).cast("date")


def parse_hashtag_list(c: Column) -> Column:
    """List text ``['A', "b"]`` -> lower-case array, empties dropped; NULL -> []."""
    parts = F.split(F.btrim(F.coalesce(c, F.lit("")), F.lit("[]")), ",")
    cleaned = F.transform(parts, lambda x: F.lower(F.btrim(x, F.lit(" \"'"))))
    return F.filter(cleaned, lambda x: x != "")


def repair_whitespace(c: Column) -> Column:
    """Carriage return -> space, then runs of three or more spaces -> TAB."""
    return F.regexp_replace(F.regexp_replace(c, "\r", " "), "   +", "\t")


def strip_mentions(c: Column) -> Column:
    """P4."""
    return py_strip(F.regexp_replace(c, "@[A-Za-z0-9_]+", ""))


def normalize_hashtags(c: Column) -> Column:
    """P5: drop the ``#`` sign, keep the word."""
    return py_strip(F.replace(c, F.lit("#"), F.lit("")))


# FIXED VALUES: characters deleted from sentences (right arrow, variation selector-16).
DELETED_CHARACTERS = "➡️"


def delete_characters(c: Column) -> Column:
    """P6."""
    return F.translate(c, DELETED_CHARACTERS, "")


def french_hyphen(c: Column) -> Column:
    """A hyphen between ASCII letters gets a space before it."""
    return F.regexp_replace(c, "(?<=[A-Za-z])-(?=[A-Za-z])", " -")


def french_mojibake(c: Column) -> Column:
    """Two literal substitutions, in this order."""
    return F.replace(F.replace(c, F.lit("Ã©"), F.lit("é")), F.lit("Ã"), F.lit("à"))


def clean_sentence(c: Column, language: Column) -> Column:
    """P9 = P4, P5, P6, then P7 + P8 for French, then strip."""
    base = delete_characters(normalize_hashtags(strip_mentions(c)))
    return py_strip(F.when(language == "french", french_mojibake(french_hyphen(base))).otherwise(base))


def count_char(c: Column, ch: str) -> Column:
    """Number of occurrences of one character."""
    return F.length(c) - F.length(F.replace(c, F.lit(ch), F.lit("")))


def num_questions(c: Column, mode: str = "chars") -> Column:
    """P10. ``chars`` counts question marks (the intent). ``whole_text`` reproduces the
    observed behaviour of counting 1-tuples equal to ``'?'`` (Q1): 1 iff the text is ``?``."""
    if mode == "whole_text":
        return F.when(c == "?", 1).otherwise(0)
    return count_char(c, "?").cast("int")


def ends_with_question_mark(c: Column) -> Column:
    """Strip ``!`` at both ends, then ends with ``?``."""
    return F.btrim(c, F.lit("!")).endswith("?")


def language_from_dataset(dataset: Column) -> Column:
    """Language from the dataset-name prefix, ``'???'`` otherwise (last match wins)."""
    expr = F.lit("???")
    for lang in ("dutch", "italian", "french", "english"):
        expr = F.when(dataset.startswith(lang), F.lit(lang)).otherwise(expr)
    return expr


def language_of_code(code: Column) -> Column:
    """P25: ISO code -> language name (NULL when unknown)."""
    m = F.create_map(*[F.lit(x) for kv in LANGUAGE_CODES.items() for x in kv])
    return F.try_element_at(m, code)


def question_id(post_id: Column, ordinal: Column) -> Column:
    """P26."""
    return F.concat(F.lit("Q"), post_id.cast("string"), F.lit("."), ordinal.cast("string"))


def join_words(arr: Column) -> Column:
    """P29."""
    return F.array_join(arr, "|")


def one_line(c: Column) -> Column:
    """Line breaks as spaces, so that a text is one line of a sheet."""
    return F.regexp_replace(c, "[\r\n]+", " ")


def render_tagged_line(tokens: Column, structure: Column) -> Column:
    """``word[tag]`` after every tagged token (any non-NULL tag), plus `` | structure``.

    ``tokens`` is an array of structs with ``text``, ``ws`` and ``qtype``; the last
    token's trailing whitespace is dropped, as a sentence's text does.
    """
    n = F.size(tokens)
    pieces = F.transform(
        tokens,
        lambda t, k: F.concat(
            t["text"],
            F.when(t["qtype"].isNotNull() & (t["qtype"] != ""), F.concat(F.lit("["), t["qtype"], F.lit("]")))
            .otherwise(F.lit("")),
            F.when(k < n - 1, t["ws"]).otherwise(F.lit("")),
        ),
    )
    return one_line(F.concat(F.array_join(pieces, ""), F.lit(" | "), F.coalesce(structure, F.lit("None"))))


def tag_summary(tokens: Column) -> Column:
    """``word-tag`` for tokens tagged other than ``no``, joined with ``|``."""
    tagged = F.filter(tokens, lambda t: t["qtype"].isNotNull() & (t["qtype"] != "") & (t["qtype"] != "no"))
    return F.array_join(F.transform(tagged, lambda t: F.concat(t["text"], F.lit("-"), t["qtype"])), "|")
