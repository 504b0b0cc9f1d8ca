"""End-to-end jobs, each a chain of ``DataFrame -> DataFrame`` stages.

* :func:`analysed_posts`  — posts -> analysed posts (load normalisation + flags)
* :func:`question_candidates` — analysed posts -> candidate questions (G1, F1, G2, F2)
* :func:`questions` — candidates -> parsed, classified questions (L0, G4, L2-L28, F3)
* annotation sheets and gold scoring live in :mod:`quaestio.operators.sampling`
  and :mod:`quaestio.operators.evaluate`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quaestio.operators import post_features
from quaestio.sources import posts as P
from quaestio.sources import testdata


def analysed_posts_from_raw(raw: DataFrame, question_count_mode: str = "chars") -> DataFrame:
    """Raw post rows (text columns as scanned, with a ``dataset`` column) -> D2."""
    typed = P.type_posts(raw)
    return post_features.flag_posts(P.normalise_posts(typed), question_count_mode)


def analysed_posts(spark: SparkSession, sf_dir: str, small_texts: bool = False) -> DataFrame:
    """D2 over the driver's documents table (see :mod:`quaestio.sources.testdata`)."""
    return analysed_posts_from_raw(testdata.raw_posts(spark, sf_dir, small_texts))


def question_candidates(spark: SparkSession, sf_dir: str, include_post_text: bool = False) -> DataFrame:
    """Analysed posts -> candidate question rows (G1, F1, G2, F2, P9, P26-P28). With the post text each of its
    candidates repeats it, so parts are kept small enough for a file to hold it once."""
    from quaestio.operators import sentences
    return sentences.question_candidates(analysed_posts(spark, sf_dir, small_texts=include_post_text), include_post_text)


def classify_questions(candidates: DataFrame, annotator, keep_tokens: bool = False,
                       remove_nonquestions: bool = True) -> DataFrame:
    """Candidates -> questions (3.2): L0 + G4, the keyword features on the (possibly
    shortened) text, P12, L2-L26, P29, then F3 and the S8 column order.

    ``annotator`` maps a DataFrame with ``text, language`` to the same rows with a
    ``tokens`` column (see :mod:`quaestio.operators.annotate`); a ``PythonAnnotator`` classifies in the pass
    that parses. Questions without a parse
    or in a language without vocabulary have NULL structure and use, and stay.
    """
    from pyspark.sql import functions as F

    from quaestio.functions import text as T
    from quaestio.operators import rules, sentences
    results = [*(["tokens"] if keep_tokens else []), "subj_verb_inversion", "structure", "use", "qwords_literal", "qwords_functional"]
    classified = rules.classified(candidates, annotator, results=results, remove_nonquestions=remove_nonquestions)
    out = (post_features.flag_question_text(classified)
           .select(*candidates.columns, *post_features.QUESTION_TEXT_FLAGS, *results)
           .withColumn("has_question_mark", T.ends_with_question_mark(F.col("text")))
           .withColumn("qwords_literal", T.join_words(F.col("qwords_literal")))
           .withColumn("qwords_functional", T.join_words(F.col("qwords_functional"))))
    if keep_tokens:
        return out
    return sentences.order_question_columns(out.drop("sent_start"))


def questions(spark: SparkSession, sf_dir: str, annotator, keep_tokens: bool = False, columns: list[str] | None = None) -> DataFrame:
    """D3 over the driver tables; with ``columns`` only these of the candidates' own columns (and those a
    parse needs) are computed and handed through the annotator."""
    candidates = question_candidates(spark, sf_dir)
    if columns is not None:
        candidates = candidates.select(*dict.fromkeys(["id", "language", "text", "offset", *columns]))
    return classify_questions(candidates, annotator, keep_tokens)


def classification_sheet(questions_with_tokens: DataFrame, k: int = 20, seed: str = "12345",
                         max_chars: int = 70) -> DataFrame:
    """A14 + F5 + P30 -> S12 lines: up to k distinct short texts per (language, structure,
    use), each rendered with its predicted word tags."""
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    from quaestio.operators import sampling
    from quaestio.functions import text as T
    keys = ["language", "structure", "use"]
    # render first: the shuffles below then move one short line per question, not its parse
    short = (questions_with_tokens.filter((F.length("text") < max_chars) & F.col("structure").isNotNull())
             .select(*keys, "text", T.render_tagged_line(F.col("tokens"), F.col("structure")).alias("line"))
             .dropDuplicates([*keys, "text"]))
    w = Window.partitionBy(*keys).orderBy(sampling.sample_key(F.col("text"), seed), "text")
    picked = short.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    return picked.select("language", F.lit("classification").alias("sheet"),
                         F.concat_ws("/", "structure", "use").alias("section"), "rank", "line")


def feature_sheet(questions: DataFrame, k: int = 50, seed: str = "12345") -> DataFrame:
    """A15 + F5 -> S13 lines."""
    from quaestio.operators import sampling
    return sampling.feature_sheet_lines(sampling.feature_sample(questions, k, seed=seed))


def gold_lines_of(questions_with_tokens: DataFrame) -> DataFrame:
    """Questions rendered as tagged lines with their structure (P30) and a comment."""
    from pyspark.sql import functions as F

    from quaestio.functions import text as T
    return questions_with_tokens.select(
        "id", "language", F.concat(T.render_tagged_line(F.col("tokens"), F.col("structure")), F.lit(" // from "), F.col("id")).alias("line"))


def scored_lines(lines: DataFrame, annotator) -> DataFrame:
    """E2-E4 over tagged lines: the untagged text is parsed again in single-sentence mode,
    classified, and scored against the tags written into the line. ``annotator`` maps
    (text, language) rows to rows with ``tokens``; a line without a parse stays, marked
    ``unparsed``."""
    from quaestio.operators import evaluate, rules
    return evaluate.score(rules.classified(evaluate.parse_gold(lines), annotator, results=["tokens", *rules.RESULT_COLUMNS]))


def roundtrip_scores(questions_with_tokens: DataFrame, annotator) -> DataFrame:
    """E2-E4 over gold lines rendered from classified questions."""
    return scored_lines(gold_lines_of(questions_with_tokens), annotator)


CORPUS_FILES = 8
#: Part files for each part of the scan of the stored lines: what one task sorts stays a fixed share of a scan's part.
PARTS_PER_SCAN = 4


def write_corpus(candidates: DataFrame, path: str, files: int = CORPUS_FILES) -> None:
    """Candidates as a corpus of tagged lines: each post's language opens a section
    (``// language``), its candidates follow as ``Word[probe] ... | polar // note id``, with
    blank lines and remarks between; some posts end reading (``// stop``). One ordered text
    a value of ``bucket`` (post id modulo ``files``), in as many part files as its size asks for: their
    numbers follow the order of the lines, and :func:`evaluate.read_corpus` reads them as one text. The lines are
    stored first, since the bounds of the parts are found in a pass of its own."""
    from pyspark.sql import functions as F

    from quaestio.session import stored
    number = F.col("tweet_id").cast("bigint")
    text = F.regexp_replace(F.col("text"), "[\r\n]", " ")
    line = F.concat(F.regexp_replace(text, r"^([\p{L}\p{N}_]+)", "$1[probe]"), F.lit(" | polar // note "), F.col("id"))
    no = F.lit(None).cast("string")
    parts = F.array(F.when(F.col("j") == 0, F.concat(F.lit("// "), F.initcap("language"))).otherwise(no),
                    F.when(F.col("j") % 3 == 1, F.lit("// a remark")).otherwise(no), line,
                    F.when(F.col("j") % 2 == 1, F.lit("")).otherwise(no),
                    F.when((number % 401 == 400) & (F.col("j") == 0), F.lit("// stop")).otherwise(no))
    rows = (candidates.select((number % files).alias("bucket"), number.alias("number"), "j", F.posexplode(parts).alias("part", "line"))
            .filter(F.col("line").isNotNull()))
    rows = stored(rows, "corpus-lines")
    parts = max(files, rows.sparkSession.sparkContext.defaultParallelism, PARTS_PER_SCAN * rows.rdd.getNumPartitions())
    order = ["bucket", "number", "j", "part"]
    rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("bucket", "line").write.partitionBy("bucket").text(path)
