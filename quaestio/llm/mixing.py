"""Operator 1: mixing sources to target weights.

Every document gets a hash-random key. Within each source the documents are range-sorted
by key, word counts are summed up by a distributed prefix sum (per key range, then within
the range), and the mix is cut at the source's budget exactly: whole passes over the
source, then the first words in key order until the budget is used up.

Nulls and odd input: a null text has no words; a null source is a source of its own,
ordered last; a null doc_id is hashed as the text ``null``. Rows that repeat in full
share a key, and which of them comes first makes no difference. Empty tables give empty
results. Further columns of the input are ignored by ``mix`` and kept by ``emit``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quaestio.llm.shared import stored
from quaestio.llm.words import WORD_PATTERN

#: Rows that a key range holds on average; bounds the rows of a window group.
RANGE_ROWS = 8192


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def random_key(doc_id: Column, size: Column, seed: str) -> Column:
    """A 60-bit number from md5 of seed, id and size: the same in every run and engine."""
    name = F.concat_ws(":", F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("null")), size.cast("string"))
    return F.conv(F.substring(F.md5(name.cast("binary")), 1, 15), 16, 10).cast("long")


def targets(sized: DataFrame, weights: tuple[int, ...], share: float, max_epochs: int) -> DataFrame:
    """One row per source: its words, its target in words, whole passes and the rest.

    Sources weigh ``weights`` in turn, in code-point order, null last. Targets stop at
    ``max_epochs`` times the source; the excess goes to the others by weight until none
    is above. Sorted by limit over weight, the sources at their limit come first, so two
    running sums over the table of sources (one row each) settle it at once.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    per = per.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights) + 1).cast("int"))
                         .cast("double"))
    per = per.withColumn("limit", max_epochs * F.col("source_size").cast("double"))
    every = Window.partitionBy()
    order = Window.orderBy(F.col("limit") / F.col("w"), F.col("source").asc_nulls_last())
    per = (per.withColumn("total", share * F.sum(F.col("source_size").cast("double")).over(every))
           .withColumn("before", F.coalesce(F.sum("limit").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
           .withColumn("w_left", F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing))))
    per = per.withColumn("full", F.col("limit") * F.col("w_left") <= (F.col("total") - F.col("before")) * F.col("w"))
    per = (per.withColumn("spent", F.sum(F.when(F.col("full"), F.col("limit")).otherwise(0.0)).over(every))
           .withColumn("w_open", F.sum(F.when(F.col("full"), 0.0).otherwise(F.col("w"))).over(every)))
    per = per.withColumn("target", F.when(F.col("full"), F.col("limit")).otherwise(
        F.col("w") * (F.col("total") - F.col("spent")) / F.col("w_open")))
    passes = F.when(F.col("source_size") > 0, F.floor(F.floor("target") / F.col("source_size"))).otherwise(0)
    return (per.withColumn("passes", passes.cast("long"))
            .withColumn("rest", F.floor("target").cast("long") - F.col("passes") * F.col("source_size"))
            .select("source", "source_size", "n_docs", "target", "passes", "rest"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, max_epochs: int = 2,
        seed: str = "mix") -> DataFrame:
    """Per document: doc_id, source, size, source_size, target, taken (words), passes and
    ``whole``: how often the mix takes it when documents stay whole (a document that the
    cut runs through counts if at least half of it is inside), and its key."""
    size = n_words(F.col("text"))
    sized = stored(docs.select("doc_id", "source", size.alias("size"))
                   .withColumn("key", random_key(F.col("doc_id"), F.col("size"), seed)), "mix-sizes")
    plan = stored(targets(sized, weights, share, max_epochs), "mix-plan")
    # no range is larger than RANGE_ROWS documents on average, whatever the source holds
    n_ranges = F.ceil(F.col("n_docs") / RANGE_ROWS).cast("long")
    rows = (sized.withColumnRenamed("source", "src").join(plan, F.col("src").eqNullSafe(F.col("source")))
            .withColumn("range", F.shiftright(F.shiftright("key", 30) * n_ranges, 30)).drop("src", "n_docs"))
    sums = rows.groupBy("source", "range").agg(F.sum("size").alias("range_size"))
    upto = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = (sums.withColumn("range_start", F.coalesce(F.sum("range_size").over(upto), F.lit(0)))
            .select(F.col("source").alias("src"), F.col("range").alias("rng"), "range_start"))
    rows = rows.join(sums, F.col("source").eqNullSafe(F.col("src")) & (F.col("range") == F.col("rng"))).drop("src", "rng")
    inside = (Window.partitionBy("source", "range").orderBy("key", F.col("doc_id").asc_nulls_first(), "size")
              .rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("start", F.col("range_start") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("start")))
    return (rows.withColumn("part", part.cast("long"))
            .withColumn("taken", F.col("passes") * F.col("size") + F.col("part"))
            .withColumn("in_part", F.when(F.col("size") == 0, F.col("start") < F.col("rest"))
                        .otherwise(2 * F.col("part") >= F.col("size")))
            .withColumn("whole", F.col("passes") + F.col("in_part").cast("long"))
            .select("doc_id", "source", "size", "source_size", "target", "taken", "passes", "whole", "in_part", "key"))


def emit(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, max_epochs: int = 2,
         seed: str = "mix") -> DataFrame:
    """The mixed corpus: every row of ``docs`` as often as the mix takes it whole.

    The cut is one key per source, so the texts need no shuffle: each row compares its own
    key with its source's cut.
    """
    mixed = mix(docs, weights, share, max_epochs, seed)
    at = F.struct(F.col("key"), F.coalesce(F.col("doc_id"), F.lit(-(1 << 63))).alias("id"), F.col("size"))
    cuts = stored(mixed.groupBy("source").agg(F.max("passes").alias("_passes"),
                                              F.max(F.when(F.col("in_part"), at)).alias("_cut"))
                  .withColumnRenamed("source", "_src"), "mix-cuts")
    rows = docs.join(cuts, docs["source"].eqNullSafe(cuts["_src"]))
    size = n_words(F.col("text"))
    own = F.struct(random_key(docs["doc_id"], size, seed).alias("key"),
                   F.coalesce(docs["doc_id"], F.lit(-(1 << 63))).alias("id"), size.alias("size"))
    times = F.col("_passes") + F.coalesce(own <= F.col("_cut"), F.lit(False)).cast("long")
    return (rows.withColumn("_copy", F.explode(F.array_repeat(F.lit(1), times.cast("int"))))
            .select(*[docs[c] for c in docs.columns]))


#: DuckDB twin of the query (the same keys, targets and cut).
ORACLE = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
  FROM documents),
keyed AS (
  SELECT *, CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || CAST(size AS VARCHAR)), 1, 15) AS BIGINT) AS key
  FROM sized),
per AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT *, CAST([5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS DOUBLE) AS w,
    2 * CAST(source_size AS DOUBLE) AS cap, 1.5::DOUBLE * CAST(sum(source_size) OVER () AS DOUBLE) AS total FROM per),
run AS (
  SELECT *, coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
    sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS w_left FROM weighed),
flagged AS (SELECT *, cap * w_left <= (total - before) * w AS is_full FROM run),
spread AS (
  SELECT *, sum(CASE WHEN is_full THEN cap ELSE 0 END) OVER () AS spent,
    sum(CASE WHEN is_full THEN 0 ELSE w END) OVER () AS w_open FROM flagged),
plan AS (
  SELECT source, source_size, CASE WHEN is_full THEN cap ELSE w * (total - spent) / w_open END AS target FROM spread),
cut AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(floor(target) / source_size) AS BIGINT) ELSE 0 END AS passes FROM plan),
placed AS (
  SELECT k.doc_id, k.source, k.size, c.source_size, c.target, c.passes,
    CAST(floor(c.target) AS BIGINT) - c.passes * c.source_size AS rest,
    coalesce(sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id NULLS FIRST, k.size
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM keyed k JOIN cut c ON k.source IS NOT DISTINCT FROM c.source)
SELECT doc_id, size, source_size, target,
  CAST(passes * size + greatest(0, least(size, rest - start)) AS BIGINT) AS taken
FROM placed
"""
