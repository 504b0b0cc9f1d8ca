"""Scoring against hand-tagged text.

Gold line grammar: ``sentence with word[tag] | structure // comment``. Structure and
comment are optional; lines starting ``//`` are comments, ``// <language>`` opens a
section and ``// stop`` ends the file.

E1 needs line order within a file; it is kept per file split (see
:func:`gold_lines`), so large corpora are not funnelled into one task. E2-E4 are per-row expressions: the gold tags and the parse of
the untagged sentence sit in the same row, so comparing them needs no join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quaestio.functions import text as T
from quaestio.operators.tokens import let

W = r"\p{L}\p{N}_"
TAG = rf"\[[{W}]+\]"
SECTION_LANGUAGES = ["dutch", "english", "french", "italian"]


def read_corpus(spark: SparkSession, paths) -> DataFrame:
    """Every line of every file: ``path, block, seq, line``.

    Lines are read with the ordinary (splittable) text source; ``block`` is the place of
    the file split a line came from and ``seq`` increases in reading order inside a
    split, so ``(path, block, seq)`` is the line order and no file has to pass through
    one task whole. The part files that a Spark job wrote into one folder are one text, in the
    order of their numbers: ``path`` is their folder.
    """
    raw = spark.read.text(paths)
    file, part = F.col("_metadata.file_path"), r"/part-(\d+)-[^/]*$"
    written = file.rlike(part)
    block = F.struct(F.when(written, F.regexp_extract(file, part, 1).cast("long")).alias("part"), file.alias("file"),
                     F.col("_metadata.file_block_start").alias("start"))
    return raw.select(F.when(written, F.regexp_replace(file, "/[^/]*$", "")).otherwise(file).alias("path"), block.alias("block"),
                      F.monotonically_increasing_id().alias("seq"), F.col("value").alias("line"))


def gold_lines(lines: DataFrame) -> DataFrame:
    """Drop blank and comment lines, carry the section language forward, stop at
    ``// stop``; adds ``language`` and the 0-based ``line_no`` within the file.

    The carry-forward crosses split boundaries through a per-split summary (one row
    per split: line count, last section header, any stop line), scanned in order per
    text; the per-line windows are partitioned by split, so a task never holds more
    than one split's lines.
    """
    line = F.col("line")
    comment = line.startswith("//")
    content = F.lower(F.btrim(line, F.lit("/ ")))
    flagged = (lines
               .withColumn("_lang", F.when(comment & content.isin(*SECTION_LANGUAGES), content))
               .withColumn("_stop", F.when(comment & (content == "stop"), 1).otherwise(0)))
    blocks = (flagged.groupBy("path", "block").agg(
        F.count(F.lit(1)).alias("_n"),
        F.max_by(F.col("_lang"), F.when(F.col("_lang").isNotNull(), F.col("seq"))).alias("_last_lang"),
        F.max("_stop").alias("_any_stop")))
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(
        "path", "block",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_lines_before"),
        F.last("_last_lang", ignorenulls=True).over(before).alias("_lang_before"),
        F.coalesce(F.max("_any_stop").over(before), F.lit(0)).alias("_stop_before"))
    w = (Window.partitionBy("path", "block").orderBy("seq")
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return (flagged.join(blocks, ["path", "block"])
            .withColumn("line_no", (F.col("_lines_before") + F.row_number().over(
                Window.partitionBy("path", "block").orderBy("seq")) - 1).cast("int"))
            .withColumn("language", F.coalesce(F.last("_lang", ignorenulls=True).over(w), F.col("_lang_before")))
            .withColumn("_stopped", F.greatest(F.max("_stop").over(w), F.col("_stop_before")))
            .filter((F.col("_stopped") == 0) & ~comment & (T.py_strip(line) != ""))
            .drop("_lang", "_stop", "_stopped", "_lines_before", "_lang_before", "_stop_before", "block", "seq"))


def split_line(line: Column, language: Column) -> Column:
    """``struct<sentence, structure, comment>``. The comment starts at the first ``//``
    not preceded by ``:`` (so URLs stay in the sentence, Q14); the sentence is cleaned
    with the section language (Q13) and then split at the first ``|``."""
    pattern = r"(?s)^(.*?)(?<!:)//(.*)$"
    has_comment = line.rlike(pattern)
    body = F.when(has_comment, F.regexp_extract(line, pattern, 1)).otherwise(line)
    comment = F.when(has_comment, T.py_strip(F.regexp_extract(line, pattern, 2)))

    def parts(cleaned):
        bar = F.instr(cleaned, "|")
        sentence = F.when(bar > 0, T.py_strip(cleaned.substr(F.lit(1), bar - 1))).otherwise(cleaned)
        structure = F.when(bar > 0, T.py_strip(cleaned.substr(bar + 1, F.length(cleaned))))
        return F.struct(sentence.alias("sentence"), structure.alias("structure"), comment.alias("comment"))
    return let(T.clean_sentence(T.py_strip(body), language), parts)


def extract_tags(tagged: Column) -> Column:
    """``struct<untagged STRING, tags ARRAY<STRUCT<start INT, tag STRING>>>``.

    A tag ``[name]`` belongs to the word run (letters, digits, ``_``, ``'``) right before
    it, starting at its first word character; ``start`` is that word's offset in the text
    with all tags removed. A tag with no such word is removed from the text but yields
    no entry (and, as in the reference, still counts towards later offsets).
    """
    word = rf"([{W}][{W}']*)$"
    empty = F.array().cast("array<struct<start:int,tag:string>>")

    def located(x):
        parts, names = x["parts"], x["names"]

        def step(acc, k):
            part = F.get(parts, k)
            tag = F.get(names, k)
            token = F.regexp_extract(part, word, 1)
            matched = token != ""
            start = acc["pos"] + acc["unmatched"] + F.length(part) - F.length(token)
            out = F.when(matched, F.array_append(acc["out"], F.struct(start.cast("int").alias("start"), tag.alias("tag")))) \
                   .otherwise(acc["out"])
            unmatched = acc["unmatched"] + F.when(matched, 0).otherwise(F.length(tag) + 2)
            return F.struct(out.alias("out"), (acc["pos"] + F.length(part)).alias("pos"), unmatched.alias("unmatched"))

        init = F.struct(empty.alias("out"), F.lit(0).alias("pos"), F.lit(0).alias("unmatched"))
        tags = F.aggregate(F.sequence(F.lit(0), F.size(names) - 1), init, step, lambda acc: acc["out"])
        return F.struct(F.array_join(parts, "").alias("untagged"), F.when(F.size(names) > 0, tags).otherwise(empty).alias("tags"))

    # split once a line, not once a tag; the text without tags is its parts
    names = F.regexp_extract_all(tagged, F.lit(rf"\[([{W}]+)\]"), F.lit(1))
    return let(F.struct(F.split(tagged, TAG).alias("parts"), names.alias("names")), located)


def parse_gold(lines: DataFrame) -> DataFrame:
    """E2 + E3 over E1 output: adds ``sentence, structure, comment, text, tags``
    (``text`` is the untagged sentence, ready for the annotator)."""
    return (lines.withColumn("_s", split_line(F.col("line"), F.col("language")))
            .withColumn("gold_structure", F.col("_s.structure"))
            .withColumn("comment", F.col("_s.comment"))
            .withColumn("_t", extract_tags(F.col("_s.sentence")))
            .withColumn("text", F.col("_t.untagged"))
            .withColumn("gold_tags", F.col("_t.tags"))
            .drop("_s", "_t"))


def tag_comparison(classified: DataFrame, key: str = "id") -> DataFrame:
    """E4 in rows: predicted and gold tags joined by (key, start), each side kept: ``key,
    start, gold, predicted, has_token, differs``. A gold tag without a token at its start
    stands alone, as do tokens without a gold tag; NULL tags compare as equal. Both sides come
    from the stored rows, so the parse and the classes behind them are computed once."""
    from quaestio.session import stored
    spans = F.transform("tokens", lambda t: F.struct(t["idx"].alias("idx"), t["qtype"].alias("qtype")))
    classified = stored(classified.select(key, spans.alias("tokens"), "gold_tags"), "tag-comparison")
    predicted = classified.select(key, F.explode("tokens").alias("t")).select(
        key, F.col("t.idx").alias("start"), F.col("t.qtype").alias("predicted"), F.lit(True).alias("has_token"))
    gold = classified.select(key, F.explode("gold_tags").alias("g")).select(key, F.col("g.start").alias("start"), F.col("g.tag").alias("gold"))
    return (predicted.join(gold, [key, "start"], "full")
            .select(key, "start", "gold", "predicted", F.coalesce("has_token", F.lit(False)).alias("has_token"),
                    (~F.col("gold").eqNullSafe(F.col("predicted"))).alias("differs")))


def score(classified: DataFrame) -> DataFrame:
    """E4 per line: a tag error for every start where predicted and gold tag differ (a token
    without a gold tag, or a gold tag without a token, counts as NULL there), plus a
    structure error when a non-empty gold structure differs from the predicted one. A line
    without a parse is ``unparsed`` and has every gold tag and a non-empty gold structure
    as errors. The tags of a line are in its row, so nothing is joined; the sums equal those of
    :func:`tag_comparison`."""
    tok_gold = lambda t: F.get(F.filter("gold_tags", lambda g: g["start"] == t["idx"]), 0)["tag"]
    unparsed = F.col("tokens").isNull()
    without_token = F.size(F.filter("gold_tags", lambda g: ~F.exists("tokens", lambda t: t["idx"] == g["start"])))
    tag_errors = F.when(unparsed, F.size("gold_tags")).otherwise(
        F.size(F.filter("tokens", lambda t: ~t["qtype"].eqNullSafe(tok_gold(t)))) + without_token)
    gs = F.col("gold_structure")
    structure_error = F.coalesce(gs.isNotNull() & (gs != "") & ~gs.eqNullSafe(F.col("structure")), F.lit(False))
    return (classified.withColumn("unparsed", unparsed).withColumn("tag_errors", tag_errors.cast("int"))
            .withColumn("structure_error", structure_error)
            .withColumn("errors", F.col("tag_errors") + F.col("structure_error").cast("int")))


def total_errors(scored: DataFrame) -> DataFrame:
    """A17."""
    return scored.agg(F.sum("errors").alias("errors"), F.sum("tag_errors").alias("tag_errors"),
                      F.sum(F.col("structure_error").cast("int")).alias("structure_errors"),
                      F.sum(F.col("unparsed").cast("int")).alias("unparsed"), F.count(F.lit(1)).alias("lines"))


def confusion(scored: DataFrame) -> DataFrame:
    """Token-level confusion counts (gold tag x predicted tag), tagged tokens only."""
    pairs = F.transform("tokens", lambda t: F.struct(
        F.get(F.filter("gold_tags", lambda g: g["start"] == t["idx"]), 0)["tag"].alias("gold"),
        t["qtype"].alias("predicted")))
    return (scored.select(F.explode(pairs).alias("p"))
            .filter(F.col("p.gold").isNotNull() | F.col("p.predicted").isNotNull())
            .groupBy(F.col("p.gold").alias("gold"), F.col("p.predicted").alias("predicted"))
            .agg(F.count(F.lit(1)).alias("tokens")))
