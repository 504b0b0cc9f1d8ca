"""Whole-word search of large vocabularies (P13, P14, P24) by a join.

A pattern of all terms suits a few hundred of them (:mod:`quaestio.functions.keywords`).
For more, the terms are a table: a term's key is the sequence of its word runs, a text's keys
are its sequences of word runs of the lengths that terms have, and equal keys meet in a join.
What stands between and around the runs is compared afterwards, literally. Each key meets
only the terms spelled from the very same words, so no frequent word multiplies the join. Where
the join shuffles, a text asks once for a sequence that it holds at several places with the same
surroundings; repeats are dropped by a hash aggregate, as comparing the sequences of one text
with each other grows with the square of its length.
Terms are broadcast only if their counted size allows it; otherwise the join shuffles.

The boundary rules are those of the pattern: a term's edge that is a word character needs a
non-word character or the text's edge beside it; one that is not needs a word character.
Terms are literal text here (the pattern builder takes them as regular expressions); terms
without a word character are searched with the pattern.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaestio.functions.keywords import WORD_CLASS

#: A side of a join is broadcast only when its counted bytes stay under this.
BROADCAST_BYTES = 16 << 20
_RUN = rf"[{WORD_CLASS}]+"


def term_table(terms: DataFrame) -> DataFrame:
    """``terms`` (language, term) with key, n (runs), lead, middle and tail (what stands before,
    between and behind the runs), lower-cased; duplicates and terms without a run are left out."""
    low = F.lower("term")
    runs = F.regexp_extract_all(low, F.lit(rf"({_RUN})"), F.lit(1))
    gaps = F.split(low, _RUN)
    return (terms.filter("term IS NOT NULL").select("language", "term", low.alias("low"), runs.alias("runs"), gaps.alias("gaps"))
            .filter(F.size("runs") > 0).dropDuplicates(["language", "low"])
            .select("language", "term", F.size("runs").alias("n"), F.array_join("runs", " ").alias("key"),
                    F.get("gaps", 0).alias("lead"), F.array_join(F.expr("slice(gaps, 2, size(gaps) - 2)"), "\u0001").alias("middle"),
                    F.try_element_at("gaps", F.lit(-1)).alias("tail")))


def _sequences(texts: DataFrame, key: list[str], text_col: str, lengths: list[int], lead: int, tail: int) -> DataFrame:
    """The run sequences of texts: key columns, n, key, middle, before, after. ``before`` and
    ``after`` hold as many characters around the sequence as terms can compare, and one more."""
    low = F.lower(F.col(text_col))
    # gap k stands before run k, the last one behind the last run
    runs = texts.select(*key, F.regexp_extract_all(low, F.lit(rf"({_RUN})"), F.lit(1)).alias("rs"), F.split(low, _RUN).alias("gs"))
    rs, gs = F.col("rs"), F.col("gs")

    def at(n: int):
        return lambda k: sequence_at(k, n)

    def sequence_at(k: Column, n: int) -> Column:
        # the characters before: of the gap, and a word character if a run stands before it; single
        # elements are taken, as a slice would copy the whole array for every sequence
        before = F.concat(F.when(k > 0, F.lit("w")).otherwise(F.lit("")), F.get(gs, k))
        after = F.concat(F.get(gs, k + n), F.when(k + n < F.size(rs), F.lit("w")).otherwise(F.lit("")))
        return F.struct(F.lit(n).alias("n"), F.concat_ws(" ", *[F.get(rs, k + i) for i in range(n)]).alias("key"),
                        F.concat_ws("\u0001", *[F.get(gs, k + i) for i in range(1, n)]).alias("middle"),
                        F.right(before, F.lit(lead + 1)).alias("before"), F.left(after, F.lit(tail + 1)).alias("after"))
    every = F.flatten(F.array(*[
        F.transform(F.when(F.size(rs) >= n, F.sequence(F.lit(0), F.size(rs) - n)).otherwise(F.array().cast("array<int>")),
                    at(n)) for n in lengths]))
    return runs.select(*key, F.explode(every).alias("s")).select(*key, "s.*")


def find_terms(texts: DataFrame, terms: DataFrame, key: list[str], text_col: str = "text",
               language_col: str | None = "language") -> DataFrame:
    """(key columns, term): the terms that texts hold as whole words, in any case. With
    ``language_col`` a text is searched for the terms of its language only (P24)."""
    table = term_table(terms if language_col else terms.withColumn("language", F.lit("")))
    shape = table.agg(F.collect_set("n"), F.max(F.length("lead")), F.max(F.length("tail")),
                      F.sum(F.octet_length("key") + F.octet_length("term") + 64)).first()
    lengths, lead, tail, size = sorted(shape[0]), shape[1] or 0, shape[2] or 0, shape[3] or 0
    if not lengths:
        return texts.select(*key, F.lit("").alias("term")).limit(0)
    source = texts if language_col else texts.withColumn("language", F.lit(""))
    if language_col and language_col != "language":
        source = source.withColumn("language", F.col(language_col))
    keys = key if "language" in key else [*key, "language"]
    asked = _sequences(source, keys, text_col, lengths, lead, tail)
    on = ["language", "n", "key", "middle"]
    met = asked.join(F.broadcast(table), on) if size <= BROADCAST_BYTES else asked.distinct().join(table, on)
    # a lead (or tail) needs its own characters and a word character beyond; none needs no word character beside it
    word = rf"[{WORD_CLASS}]"
    left = (F.when(F.col("lead") == "", ~F.right("before", F.lit(1)).rlike(word))
            .otherwise(F.col("before").endswith(F.concat(F.lit("w"), F.col("lead")))))
    right = (F.when(F.col("tail") == "", ~F.left("after", F.lit(1)).rlike(word))
             .otherwise(F.col("after").startswith(F.concat(F.col("tail"), F.lit("w")))))
    return met.filter(left & right).select(*key, "term").distinct()
