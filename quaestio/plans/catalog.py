"""Registry of runnable queries (one per operator group of the inventory) and their
DuckDB oracle SQL. Every query reads the driver tables at ``sf_dir`` in full."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaestio.functions import keywords as K
from quaestio.functions import text as T
from quaestio.operators import annotate, closed_class, post_features, profile
from quaestio.plans import jobs
from quaestio.plans import oracle as O

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


#: Rows with ``tokens`` by the library's shallow parser (L0 + G4), and the same in single-sentence mode.
_parsed = annotate.PythonAnnotator(closed_class.ClosedClassProvider)
_parsed_single = annotate.PythonAnnotator(closed_class.single_sentence)


# ---------------------------------------------------------------- posts (3.1)

@register("s1_p1_p3_typed_posts", O.with_posts("""
SELECT id, dataset, language, created_at, array_to_string(hashtags, '|') AS hashtags_text,
       CAST(len(hashtags) AS INTEGER) AS num_hashtags, full_text, quoted_text, favorite_count, retweet_count
FROM typed"""))
def q_typed_posts(spark, sf_dir):
    p = jobs.analysed_posts(spark, sf_dir)
    return p.select("id", "dataset", "language", "created_at",
                    F.array_join("hashtags", "|").alias("hashtags_text"),
                    F.size("hashtags").alias("num_hashtags"), "full_text", "quoted_text",
                    "favorite_count", "retweet_count")


@register("p4_p9_clean_text", O.with_posts(f"""
SELECT id, language, {O.clean_sql('full_text', 'language')} AS clean_text FROM typed"""))
def q_clean_text(spark, sf_dir):
    p = jobs.analysed_posts(spark, sf_dir)
    return p.select("id", "language", T.clean_sentence(F.col("full_text"), F.col("language")).alias("clean_text"))


@register("p10_p19_post_flags", O.with_posts("""
SELECT id, dataset, language, num_questions, has_question, has_disinfo_hashtags, has_disinfo_text,
       has_disinfo_text_or_hashtags, has_negation FROM aposts"""))
def q_post_flags(spark, sf_dir):
    p = jobs.analysed_posts(spark, sf_dir)
    return p.select("id", "dataset", "language", "num_questions", "has_question", "has_disinfo_hashtags",
                    "has_disinfo_text", "has_disinfo_text_or_hashtags", "has_negation")


def _keyword_flags_sql():
    cols = ", ".join(f"{K.duckdb_keyword_case('full_text', 'language', cat)} AS {name}"
                     for name, cat in post_features.QUESTION_TEXT_FLAGS.items())
    return O.with_posts(f"SELECT id, language, {cols} FROM typed")


@register("p20_p23_keyword_flags", _keyword_flags_sql())
def q_keyword_flags(spark, sf_dir):
    p = jobs.analysed_posts(spark, sf_dir)
    return post_features.flag_question_text(p, "full_text").select(
        "id", "language", *post_features.QUESTION_TEXT_FLAGS)


@register("a1_a4_posts_per_dataset", O.with_posts("""
SELECT dataset, count(id) AS num_posts,
       avg(CAST(has_question AS INTEGER)) AS share_question,
       avg(CAST(has_disinfo_hashtags AS INTEGER)) AS share_disinfo_hashtags,
       avg(CAST(has_disinfo_text AS INTEGER)) AS share_disinfo_text,
       avg(CAST(has_negation AS INTEGER)) AS share_negation
FROM aposts WHERE dataset IS NOT NULL GROUP BY dataset"""))
def q_posts_per_dataset(spark, sf_dir):
    return profile.posts_per_dataset(jobs.analysed_posts(spark, sf_dir))


@register("a5_date_histogram", O.with_posts("""
SELECT created_at, dataset, count(*) AS num_posts FROM aposts
WHERE created_at IS NOT NULL AND dataset IS NOT NULL GROUP BY created_at, dataset"""))
def q_date_histogram(spark, sf_dir):
    return profile.date_histogram(jobs.analysed_posts(spark, sf_dir))


@register("a6_top_hashtags", O.with_posts("""
SELECT dataset, hashtag, num, rank FROM (
  SELECT dataset, hashtag, num, row_number() OVER (PARTITION BY dataset ORDER BY num DESC, hashtag) AS rank
  FROM (SELECT dataset, hashtag, count(*) AS num
        FROM (SELECT dataset, unnest(hashtags) AS hashtag FROM aposts WHERE dataset IS NOT NULL)
        GROUP BY dataset, hashtag))
WHERE rank <= 100"""))
def q_top_hashtags(spark, sf_dir):
    return profile.top_hashtags(jobs.analysed_posts(spark, sf_dir), 100).withColumn("rank", F.col("rank").cast("bigint"))


@register("a11_distinct_datasets", O.with_posts("SELECT DISTINCT dataset FROM aposts WHERE dataset IS NOT NULL"))
def q_distinct_datasets(spark, sf_dir):
    return profile.distinct_datasets(jobs.analysed_posts(spark, sf_dir))


# ---------------------------------------------------------------- sentences and candidates (3.2)

from quaestio.operators import sampling, sentences  # noqa: E402


@register("g1_sentences", O.with_questions("SELECT id, sent_no, start, text FROM sent"))
def q_sentences(spark, sf_dir):
    return sentences.sentences(jobs.analysed_posts(spark, sf_dir)).select("id", "sent_no", "start", "text")


@register("g2_f1_f2_question_candidates", O.with_questions("""
SELECT qid AS id, tweet_id, dataset, language, created_at, favorite_count, retweet_count, j, "offset", qtext AS text
FROM questions"""))
def q_candidates(spark, sf_dir):
    c = jobs.question_candidates(spark, sf_dir)
    return c.select("id", "tweet_id", "dataset", "language", "created_at", "favorite_count", "retweet_count",
                    "j", "offset", "text")


def _candidate_flags_sql():
    cols = ", ".join(f"{K.duckdb_keyword_case('qtext', 'language', cat)} AS {name}"
                     for name, cat in post_features.QUESTION_TEXT_FLAGS.items())
    return O.with_questions(f"""SELECT qid AS id, language, {cols},
        ends_with(trim(qtext, '!'), '?') AS has_question_mark FROM questions""")


@register("p12_p19_p23_candidate_features", _candidate_flags_sql())
def q_candidate_flags(spark, sf_dir):
    c = post_features.flag_question_text(jobs.question_candidates(spark, sf_dir))
    return c.select("id", "language", *post_features.QUESTION_TEXT_FLAGS,
                    T.ends_with_question_mark(F.col("text")).alias("has_question_mark"))


@register("a13_f4_sample_posts", O.with_posts("""
SELECT dataset, flag, id, full_text, rank FROM (
  SELECT dataset, flag, id, full_text,
         row_number() OVER (PARTITION BY dataset, flag ORDER BY md5('12345' || id), id) AS rank
  FROM (SELECT dataset, coalesce(has_disinfo_text_or_hashtags, FALSE) AS flag, id, full_text
        FROM aposts WHERE dataset IS NOT NULL))
WHERE rank <= 10"""))
def q_sample_posts(spark, sf_dir):
    s = sampling.sample_posts(jobs.analysed_posts(spark, sf_dir), 10)
    return s.withColumn("rank", F.col("rank").cast("bigint"))


@register("a12_f5_u2_short_distinct_candidates", O.with_questions("""
SELECT DISTINCT language, qtext AS text FROM questions WHERE length(qtext) < 70"""))
def q_short_distinct(spark, sf_dir):
    return sampling.short_distinct_texts(jobs.question_candidates(spark, sf_dir), ["language"])


def _feature_sample_sql():
    cols = ", ".join(f"{K.duckdb_keyword_case('qtext', 'language', cat)} AS {name}"
                     for name, cat in post_features.QUESTION_TEXT_FLAGS.items()
                     if name in sampling.SHEET_FEATURES)
    feats = ", ".join(sampling.SHEET_FEATURES)
    return O.with_questions(f"""
SELECT language, feature, value, text, rank FROM (
  SELECT language, feature, value, text,
         row_number() OVER (PARTITION BY language, feature, value ORDER BY md5('12345' || text), text) AS rank
  FROM (SELECT DISTINCT language, feature, value, text FROM (
          UNPIVOT (SELECT language, qtext AS text, {cols} FROM questions)
          ON {feats} INTO NAME feature VALUE value)
        WHERE value IS NOT NULL AND length(text) < 70))
WHERE rank <= 50""")


@register("a15_feature_sample_candidates", _feature_sample_sql())
def q_feature_sample(spark, sf_dir):
    c = post_features.flag_question_text(jobs.question_candidates(spark, sf_dir))
    return sampling.feature_sample(c).withColumn("rank", F.col("rank").cast("bigint"))


# ---------------------------------------------------------------- parsed questions (3.2-3.4)

from quaestio.operators import evaluate, rules, token_table  # noqa: E402
from quaestio.plans import parse_oracle as R  # noqa: E402
from quaestio.sources import testdata  # noqa: E402

_FLAGS = ", ".join(f"{K.duckdb_keyword_case('c.stext', 'c.language', cat)} AS {name}"
                   for name, cat in post_features.QUESTION_TEXT_FLAGS.items())
#: The question table (D3) without the posts' own columns, classes included.
_QUESTIONS = f"""
q3 AS MATERIALIZED (
  SELECT q.qid AS id, c.stext AS text, q.tweet_id, q.created_at, q.favorite_count, q.retweet_count, q.dataset, q.language, q.j,
         CAST(q."offset" + p.shift AS INTEGER) AS "offset", {_FLAGS}, c.inv AS subj_verb_inversion, k.structure, k.use,
         coalesce(array_to_string(k.literal, '|'), '') AS qwords_literal, coalesce(array_to_string(k.functional, '|'), '') AS qwords_functional,
         c.qm AS has_question_mark
  FROM questions AS q JOIN parsed AS p USING (qid) JOIN clause AS c ON c.sid = q.qid LEFT JOIN classed AS k
       ON k.sid = q.qid AND q.language IN ('dutch', 'english', 'french', 'italian')
  WHERE k.use IS NULL OR k.use <> 'no'
)"""


def _with_questions(select: str) -> str:
    return R.with_parses(f", {_QUESTIONS} {select}")


def _texts(spark, sf_dir) -> DataFrame:
    """The candidates' columns that a parse needs: nothing else goes through Python, or is computed."""
    return jobs.question_candidates(spark, sf_dir).select("id", "language", "text", "offset")


@register("l0_g4_annotated_candidates", R.with_parses("""
SELECT qid AS id, language, stext AS text, CAST("offset" + shift AS INTEGER) AS "offset", n AS num_tokens
FROM questions JOIN parsed USING (qid)"""))
def q_annotated(spark, sf_dir):
    a = _parsed(_texts(spark, sf_dir))
    return a.select("id", "language", "text", "offset", F.size("tokens").alias("num_tokens"))


_TOKEN_LIST = "id, i, idx, text, lemma, pos, dep, head"


@register("l0_d4_tokens", R.with_parses("SELECT sid AS id, i, idx, word AS text, lemma, pos, dep, head FROM tok"))
def q_tokens(spark, sf_dir):
    t = token_table.token_rows(_parsed(_texts(spark, sf_dir)))
    return t.select(*_TOKEN_LIST.split(", "))


@register("l2_l9_l16_l18_word_facts", R.with_parses("""
SELECT sid AS id, i, clemma, verblike, adr, spk, exist, imp, who, neg, emb, negated, wanted, present, pqw, only_emb FROM word"""))
def q_word_facts(spark, sf_dir):
    t = token_table.token_rows(_parsed(_texts(spark, sf_dir)))
    return token_table.word_facts(t, columns=["id", "i"])


@register("l12_finite_verbs", R.with_parses("SELECT sid AS id, i, word AS text FROM word WHERE fin AND NOT skipped"))
def q_finite_verbs(spark, sf_dir):
    return token_table.finite_verbs(token_table.token_rows(_parsed(_texts(spark, sf_dir))))


@register("l1_l19_ancestors", R.with_parses(""",
up AS (WITH RECURSIVE step AS (
    SELECT sid, i, i AS at_node, 0 AS depth, CAST([i] AS BIGINT[]) AS path, CAST(NULL AS BIGINT) AS nearest FROM word
    UNION ALL
    SELECT s.sid, s.i, x.head, s.depth + 1, list_append(s.path, x.head), coalesce(s.nearest, CASE WHEN h.emb THEN x.head END)
    FROM step AS s JOIN word AS x ON x.sid = s.sid AND x.i = s.at_node JOIN word AS h ON h.sid = x.sid AND h.i = x.head
    WHERE x.head <> x.i) SELECT * FROM step)
SELECT sid AS id, i, max(depth) AS depth, arg_max(at_node, depth) AS root, array_to_string(arg_max(path, depth), '>') AS path,
       arg_max(coalesce(nearest, -1), depth) AS nearest_embedder
FROM up GROUP BY sid, i"""))
def q_ancestors(spark, sf_dir):
    t = token_table.token_rows(_parsed(_texts(spark, sf_dir)))
    up = token_table.ancestors(token_table.word_facts(t, columns=["id", "i", "head"]).select("id", "i", "head", "emb"), "id", "emb")
    return up.select("id", "i", "depth", "root", F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("path"),
                     F.coalesce("nearest", F.lit(-1)).alias("nearest_embedder"))


@register("l13_l15_sentence_analysis", R.with_parses("""
SELECT q.qid AS id, q.language, c.mv AS matrix_verb, c.ms AS matrix_subject, c.inv AS subj_verb_inversion, c.tagq AS has_tag_question,
       c.qm AS ends_with_question_mark, k.structure, k.use
FROM questions AS q JOIN clause AS c ON c.sid = q.qid LEFT JOIN classed AS k
     ON k.sid = q.qid AND q.language IN ('dutch', 'english', 'french', 'italian')"""))
def q_sentence_analysis(spark, sf_dir):
    out = rules.classified(_texts(spark, sf_dir), _parsed)
    return out.select("id", "language", "matrix_verb", "matrix_subject", "subj_verb_inversion", "has_tag_question",
                      "ends_with_question_mark", "structure", "use")


@register("l25_p31_word_tags", R.with_parses("""
SELECT q.qid AS id, coalesce(string_agg(x.word || '-' || t.tag, '|' ORDER BY t.i) FILTER (t.tag <> 'no'), '') AS summary,
       coalesce(string_agg(CAST(t.i AS VARCHAR) || ':' || t.tag, ',' ORDER BY t.i), '') AS tags
FROM questions AS q LEFT JOIN tagged AS t ON t.sid = q.qid LEFT JOIN word AS x ON x.sid = t.sid AND x.i = t.i GROUP BY q.qid"""))
def q_word_tags(spark, sf_dir):
    out = rules.classified(_texts(spark, sf_dir), _parsed, results=["tokens"])
    tagged = F.filter("tokens", lambda t: t["qtype"].isNotNull())
    return out.select("id", T.tag_summary(F.col("tokens")).alias("summary"), F.array_join(F.transform(
        tagged, lambda t: F.concat(t["i"].cast("string"), F.lit(":"), t["qtype"])), ",").alias("tags"))


@register("l27_rising_declaratives", R.with_parses("""
SELECT q.qid AS id, c.qm AND NOT coalesce(c.inv, FALSE) AS is_rising_declarative FROM questions AS q JOIN clause AS c ON c.sid = q.qid"""))
def q_rising(spark, sf_dir):
    out = rules.classified(_texts(spark, sf_dir), _parsed, results=["ends_with_question_mark", "subj_verb_inversion"])
    return rules.is_rising_declarative(out).select("id", "is_rising_declarative")


def _questions(spark, sf_dir, keep_tokens: bool = False, columns: list[str] | None = None) -> DataFrame:
    return jobs.questions(spark, sf_dir, _parsed, keep_tokens, columns)


_QUESTION_COLUMNS = ["id", "text", "tweet_id", "created_at", "favorite_count", "retweet_count", "dataset", "language", "j", "offset",
                     *post_features.QUESTION_TEXT_FLAGS, "has_question_mark", "subj_verb_inversion", "structure", "use", "qwords_literal",
                     "qwords_functional"]


#: Those that the candidates have before the parse.
_CANDIDATE_COLUMNS = ["tweet_id", "created_at", "favorite_count", "retweet_count", "dataset", "j"]


@register("l2_l28_f3_s8_questions", _with_questions("SELECT " + ", ".join(f'"{c}"' for c in _QUESTION_COLUMNS) + " FROM q3"))
def q_questions(spark, sf_dir):
    return _questions(spark, sf_dir, columns=_CANDIDATE_COLUMNS).select(*_QUESTION_COLUMNS)


@register("p27_s8_question_columns", O.with_questions("""
SELECT q.qid AS id, a.id AS tweet_id, CAST(a.num_questions AS INTEGER) AS tweet_num_questions, a.has_question AS tweet_has_question,
       a.has_disinfo_hashtags AS tweet_has_disinfo_hashtags, a.has_disinfo_text AS tweet_has_disinfo_text,
       a.has_disinfo_text_or_hashtags AS tweet_has_disinfo_text_or_hashtags, a.has_negation AS tweet_has_negation, a.source AS tweet_source,
       array_to_string(a.hashtags, '|') AS tweet_hashtags, a.full_text AS tweet_full_text, a.quoted_text AS tweet_quoted_text
FROM questions AS q JOIN aposts AS a ON a.id = q.tweet_id"""))
def q_prefixed_columns(spark, sf_dir):
    c = jobs.question_candidates(spark, sf_dir, include_post_text=True)
    return c.select("id", *[F.array_join("tweet_hashtags", "|").alias(x) if x == "tweet_hashtags" else F.col(x)
                            for x in c.columns if x.startswith("tweet_")])


@register("a7_questions_per_dataset", _with_questions("SELECT dataset, count(id) AS num_questions FROM q3 WHERE dataset IS NOT NULL GROUP BY dataset"))
def q_questions_per_dataset(spark, sf_dir):
    return profile.questions_per_dataset(_questions(spark, sf_dir, columns=["dataset"]))


@register("a8_question_feature_means", _with_questions(
    "SELECT dataset, " + ", ".join(f"avg(CAST({c} AS INTEGER)) AS mean_{c}" for c in profile.QUESTION_FEATURES)
    + " FROM q3 WHERE dataset IS NOT NULL GROUP BY dataset"))
def q_feature_means(spark, sf_dir):
    return profile.question_feature_means(_questions(spark, sf_dir, columns=["dataset"]))


@register("a9_structure_use_counts", _with_questions("""
SELECT dataset, structure, use, count(id) AS num_questions FROM q3
WHERE dataset IS NOT NULL AND structure IS NOT NULL AND use IS NOT NULL GROUP BY dataset, structure, use"""))
def q_structure_use(spark, sf_dir):
    return profile.structure_use_counts(_questions(spark, sf_dir, columns=["dataset"]))


@register("a10_top_functional_qwords", _with_questions("""
SELECT dataset, qwords_functional, count(id) AS num_questions FROM q3 WHERE dataset IS NOT NULL AND qwords_functional IS NOT NULL
GROUP BY dataset, qwords_functional ORDER BY num_questions DESC, dataset, qwords_functional LIMIT 10"""))
def q_top_qwords(spark, sf_dir):
    return profile.top_functional_qwords(_questions(spark, sf_dir, columns=["dataset"]), 10)


#: The words of a question with their tags, and its structure.
_LINES = r"""
lines AS (
  SELECT q.id, q.language, q.structure, q.use, q.text,
         regexp_replace(string_agg(x.word || coalesce('[' || t.tag || ']', '') || CASE WHEN x.i = x.n - 1 THEN '' ELSE x.ws END, '' ORDER BY x.i)
                        || ' | ' || coalesce(any_value(q.structure), 'None'), '[\r\n]+', ' ', 'g') AS line
  FROM q3 AS q JOIN word AS x ON x.sid = q.id LEFT JOIN tagged AS t ON t.sid = x.sid AND t.i = x.i
  GROUP BY q.id, q.language, q.structure, q.use, q.text
)"""


@register("a14_p30_s12_classification_sheet", R.with_parses(f""", {_QUESTIONS}, {_LINES},
short AS (SELECT language, structure, use, text, min(line) AS line FROM lines WHERE length(text) < 70 AND structure IS NOT NULL
          GROUP BY language, structure, use, text)
SELECT language, 'classification' AS sheet, structure || '/' || use AS section, rank, line FROM (
  SELECT *, row_number() OVER (PARTITION BY language, structure, use ORDER BY md5('12345' || text), text) AS rank FROM short) WHERE rank <= 20"""))
def q_classification_sheet(spark, sf_dir):
    sheet = jobs.classification_sheet(_questions(spark, sf_dir, keep_tokens=True, columns=[]))
    return sheet.withColumn("rank", F.col("rank").cast("bigint"))


def _feature_sheet_sql():
    feats = ", ".join(sampling.SHEET_FEATURES)
    return _with_questions(f""",
picked AS (SELECT language, feature, value, text, rank FROM (
  SELECT language, feature, value, text, row_number() OVER (PARTITION BY language, feature, value ORDER BY md5('12345' || text), text) AS rank
  FROM (SELECT DISTINCT language, feature, value, text FROM (
          UNPIVOT (SELECT language, text, {feats} FROM q3) ON {feats} INTO NAME feature VALUE value)
        WHERE value IS NOT NULL AND length(text) < 70)) WHERE rank <= 50)
SELECT language, replace(feature, '_', '-') AS sheet, CAST(value AS VARCHAR) AS section, rank,
       regexp_replace(text, '[\\r\\n]+', ' ', 'g') AS line FROM picked
UNION ALL
SELECT DISTINCT language, replace(feature, '_', '-'), CAST(value AS VARCHAR), 0,
       '// These questions are predicted to have ' || feature || ' == ' || CASE WHEN value THEN 'True' ELSE 'False' END || ':' FROM picked""")


@register("a15_s13_feature_sheet", _feature_sheet_sql())
def q_feature_sheet(spark, sf_dir):
    return jobs.feature_sheet(_questions(spark, sf_dir, columns=[])).withColumn("rank", F.col("rank").cast("bigint"))


# ---------------------------------------------------------------- more sources

from quaestio.sources.testdata import DUCKDB_RAW_CONVERSATION_POSTS, DUCKDB_RAW_POSTS  # noqa: E402


@register("s4_u1_two_sources_per_dataset", O.with_posts("""
SELECT dataset, count(id) AS num_posts,
       avg(CAST(has_question AS INTEGER)) AS share_question,
       avg(CAST(has_disinfo_hashtags AS INTEGER)) AS share_disinfo_hashtags,
       avg(CAST(has_disinfo_text AS INTEGER)) AS share_disinfo_text,
       avg(CAST(has_negation AS INTEGER)) AS share_negation
FROM aposts WHERE dataset IS NOT NULL GROUP BY dataset""",
    raw=f"{DUCKDB_RAW_POSTS} UNION ALL BY NAME {DUCKDB_RAW_CONVERSATION_POSTS}"))
def q_two_sources(spark, sf_dir):
    docs = testdata.raw_posts(spark, sf_dir)
    conv = testdata.raw_posts_from_conversations(testdata.table(spark, sf_dir, "conversations"))
    raw = profile.union_datasets([docs, conv])
    return profile.posts_per_dataset(jobs.analysed_posts_from_raw(raw))


@register("a5_event_histogram", """
SELECT CAST(ts AS DATE) AS created_at, event_type AS dataset, count(*) AS num_posts
FROM events WHERE ts IS NOT NULL AND event_type IS NOT NULL GROUP BY 1, 2""")
def q_event_histogram(spark, sf_dir):
    ev = testdata.table(spark, sf_dir, "events").select(
        F.col("event_id").cast("string").alias("id"), F.col("ts").cast("date").alias("created_at"),
        F.col("event_type").alias("dataset"))
    return profile.date_histogram(ev)


# ---------------------------------------------------------------- gold-line parsing with a DuckDB twin

def _gold_lines(candidates):
    """Tagged lines: the first word of each candidate gets a tag, every third
    line an extra tag with no word before it, then a structure and a comment."""
    text = F.regexp_replace(F.col("text"), "[\r\n]", " ")
    tagged = F.regexp_replace(text, r"^([\p{L}\p{N}_]+)", "$1[probe]")
    extra = F.when(F.length(text) % 3 == 0, F.lit(" [late]")).otherwise(F.lit(""))
    return candidates.select("id", "language", F.concat(tagged, extra, F.lit(" | polar // note "), F.col("id"))
                             .alias("line"))


#: E2-E3 in SQL: from ``lines`` (id, language, line) to ``gparts`` (sentence, gold_structure,
#: comment), ``located`` (one row a tag) and ``gold`` (one row a line).
_GOLD = r"""
gsplit AS (
  SELECT id, language, line,
         CASE WHEN regexp_matches(line, '^(.*?)(^|[^:])//(.*)$')
              THEN regexp_extract(line, '^(.*?)(^|[^:])//(.*)$', 1) || regexp_extract(line, '^(.*?)(^|[^:])//(.*)$', 2)
              ELSE line END AS body,
         CASE WHEN regexp_matches(line, '^(.*?)(^|[^:])//(.*)$')
              THEN """ + O.strip_sql("regexp_extract(line, '^(.*?)(^|[^:])//(.*)$', 3)") + r""" END AS comment
  FROM lines
), cleaned AS (
  SELECT id, language, comment, """ + O.clean_sql(O.strip_sql("body"), "language") + r""" AS c FROM gsplit
), gparts AS (
  SELECT id, language, comment,
         CASE WHEN strpos(c, '|') > 0 THEN """ + O.strip_sql("substr(c, 1, strpos(c, '|') - 1)") + r""" ELSE c END AS sentence,
         CASE WHEN strpos(c, '|') > 0 THEN """ + O.strip_sql("substr(c, strpos(c, '|') + 1)") + r""" END AS gold_structure
  FROM cleaned
), tagparts AS (
  SELECT id, regexp_split_to_array(sentence, '\[[\p{L}\p{N}_]+\]') AS ps,
         regexp_extract_all(sentence, '\[([\p{L}\p{N}_]+)\]', 1) AS names
  FROM gparts
), per_tag AS (
  SELECT id, k, names[k] AS tag, ps[k] AS part,
         regexp_extract(ps[k], '([\p{L}\p{N}_][\p{L}\p{N}_'']*)$', 1) AS token
  FROM (SELECT id, ps, names, unnest(range(1, len(names) + 1)) AS k FROM tagparts)
), located AS (
  SELECT id, k, tag, token,
         coalesce(sum(length(part)) OVER w, 0)
           + coalesce(sum(CASE WHEN token = '' THEN length(tag) + 2 ELSE 0 END) OVER w, 0)
           + length(part) - length(token) AS start
  FROM per_tag
  WINDOW w AS (PARTITION BY id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), gold AS (
  SELECT id, language, regexp_replace(sentence, '\[[\p{L}\p{N}_]+\]', '', 'g') AS text, gold_structure, comment FROM gparts
)"""


@register("e2_e3_gold_line_parsing", O.with_questions(r"""
, lines AS (
  SELECT qid AS id, language,
         regexp_replace(replace(replace(qtext, chr(13), ' '), chr(10), ' '), '^([\p{L}\p{N}_]+)', '\1[probe]')
           || CASE WHEN length(replace(replace(qtext, chr(13), ' '), chr(10), ' ')) % 3 = 0 THEN ' [late]' ELSE '' END
           || ' | polar // note ' || qid AS line
  FROM questions
), """ + _GOLD + r""", tag_text AS (
  SELECT id, string_agg(CAST(start AS VARCHAR) || ':' || tag, '|' ORDER BY k) AS tags
  FROM located WHERE token <> '' GROUP BY id
)
SELECT p.id, p.language, p.text, p.gold_structure, p.comment, coalesce(t.tags, '') AS tags
FROM gold p LEFT JOIN tag_text t ON p.id = t.id"""))
def q_gold_line_parsing(spark, sf_dir):
    lines = _gold_lines(jobs.question_candidates(spark, sf_dir))
    g = evaluate.parse_gold(lines)
    return g.select("id", "language", "text", "gold_structure", "comment",
                    F.array_join(F.transform("gold_tags", lambda x: F.concat(x["start"].cast("string"), F.lit(":"),
                                                                               x["tag"])), "|").alias("tags"))


#: The candidates' corpus (see jobs.write_corpus) as ordered rows, and E1 as windows over them.
_CORPUS = O.SENTENCES_CTE + rf""",
corpus AS (
  SELECT number % {jobs.CORPUS_FILES} AS bucket, number, j, part, line FROM (
    SELECT CAST(tweet_id AS BIGINT) AS number, j, unnest([0, 1, 2, 3, 4]) AS part, unnest([
             CASE WHEN j = 0 THEN '// ' || upper(left(language, 1)) || lower(substr(language, 2)) END,
             CASE WHEN j % 3 = 1 THEN '// a remark' END,
             regexp_replace(replace(replace(qtext, chr(13), ' '), chr(10), ' '), '^([\p{{L}}\p{{N}}_]+)', '\1[probe]') || ' | polar // note ' || qid,
             CASE WHEN j % 2 = 1 THEN '' END, CASE WHEN CAST(tweet_id AS BIGINT) % 401 = 400 AND j = 0 THEN '// stop' END]) AS line
    FROM questions) WHERE line IS NOT NULL
),
sections AS (
  SELECT bucket, line, row_number() OVER o - 1 AS line_no,
         last_value(CASE WHEN lower(trim(line, '/ ')) IN ('dutch', 'english', 'french', 'italian') AND starts_with(line, '//')
                         THEN lower(trim(line, '/ ')) END IGNORE NULLS) OVER o AS language,
         max(CASE WHEN starts_with(line, '//') AND lower(trim(line, '/ ')) = 'stop' THEN 1 ELSE 0 END) OVER o AS stopped
  FROM corpus WINDOW o AS (PARTITION BY bucket ORDER BY number, j, part ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
),
corpus_lines AS (
  SELECT bucket, CAST(line_no AS INTEGER) AS line_no, language, line FROM sections
  WHERE stopped = 0 AND NOT starts_with(line, '//') AND {O.strip_sql('line')} <> ''
)"""


def _corpus_lines(spark, sf_dir):
    from quaestio.session import scratch_path
    path = scratch_path(spark, "corpus")
    jobs.write_corpus(jobs.question_candidates(spark, sf_dir), path)
    bucket = F.regexp_extract("path", r"bucket=(\d+)", 1).cast("bigint")
    return evaluate.gold_lines(evaluate.read_corpus(spark, path)).withColumn("bucket", bucket)


@register("s15_e1_corpus_lines", f"WITH {O.posts_cte()}, {_CORPUS} SELECT bucket, line_no, language, line FROM corpus_lines")
def q_corpus_lines(spark, sf_dir):
    """Tagged lines written as ordered files and read back by splits, sections carried on."""
    return _corpus_lines(spark, sf_dir).select("bucket", "line_no", "language", "line")


def _scored_sql(lines: str, select: str) -> str:
    """The untagged texts of ``lines`` are parsed and classified again, and their tags compared."""
    return f"""{lines}, {_GOLD},
again AS MATERIALIZED (
  WITH RECURSIVE questions AS (SELECT id AS qid, language, text AS qtext, 0 AS "offset" FROM gold WHERE language IS NOT NULL), {R.PARSE_SINGLE}, {R.RULES}
  SELECT w.sid AS id, w.idx AS start, t.tag AS predicted, CASE WHEN w.language IN ('dutch', 'english', 'french', 'italian') THEN k.structure END AS structure
  FROM word AS w LEFT JOIN tagged AS t ON t.sid = w.sid AND t.i = w.i LEFT JOIN classed AS k ON k.sid = w.sid
),
compared AS (
  SELECT coalesce(a.id, g.id) AS id, coalesce(a.start, g.start) AS start, g.tag AS gold, a.predicted, a.id IS NOT NULL AS has_token,
         g.tag IS DISTINCT FROM a.predicted AS differs
  FROM again AS a FULL OUTER JOIN (SELECT id, start, tag FROM located WHERE token <> '') AS g ON g.id = a.id AND g.start = a.start
),
scores AS (
  SELECT g.id, g.language, g.text, s.structure, g.gold_structure, s.id IS NULL AS unparsed,
         CAST(coalesce(e.n, 0) AS INTEGER) AS tag_errors,
         coalesce(g.gold_structure <> '' AND g.gold_structure IS DISTINCT FROM s.structure, FALSE) AS structure_error
  FROM gold AS g LEFT JOIN (SELECT id, any_value(structure) AS structure FROM again GROUP BY id) AS s USING (id)
       LEFT JOIN (SELECT id, count(*) FILTER (differs) AS n FROM compared GROUP BY id) AS e USING (id)
) {select}"""


_ROUNDTRIP = R.with_parses(f", {_QUESTIONS}, {_LINES.replace('lines AS', 'rendered AS', 1)}, "
                           "lines AS (SELECT id, language, line || ' // from ' || id AS line FROM rendered)")


@register("e2_e4_roundtrip_scores", _scored_sql(_ROUNDTRIP, """SELECT id, language, text, structure, gold_structure, tag_errors, structure_error,
       tag_errors + CAST(structure_error AS INTEGER) AS errors FROM scores"""))
def q_roundtrip(spark, sf_dir):
    s = jobs.roundtrip_scores(_questions(spark, sf_dir, keep_tokens=True, columns=[]), _parsed_single)
    return s.select("id", "language", "text", "structure", "gold_structure", "tag_errors", "structure_error", "errors")


#: The lines of the corpus files, with errors: their tag is none a parser gives.
_CORPUS_GOLD = (f"WITH RECURSIVE {O.posts_cte()}, {_CORPUS}, lines AS (SELECT CAST(bucket AS VARCHAR) || '-' || CAST(line_no AS VARCHAR) AS id, "
                "language, line FROM corpus_lines)")


def _corpus_gold(spark, sf_dir):
    lines = _corpus_lines(spark, sf_dir)
    return lines.select(F.concat_ws("-", F.col("bucket").cast("string"), F.col("line_no").cast("string")).alias("id"), "language", "line")


@register("e4_tag_comparison", _scored_sql(_CORPUS_GOLD, "SELECT id, start, gold, predicted, has_token, differs FROM compared "
                                           "WHERE gold IS NOT NULL OR predicted IS NOT NULL"))
def q_tag_comparison(spark, sf_dir):
    """The gold run over files: read, sections, tags, parse, classes, comparison per start."""
    parsed = rules.classified(evaluate.parse_gold(_corpus_gold(spark, sf_dir)), _parsed_single, results=["tokens"])
    return evaluate.tag_comparison(parsed).filter(F.col("gold").isNotNull() | F.col("predicted").isNotNull())


@register("a17_total_errors", _scored_sql(_CORPUS_GOLD, """
SELECT CAST(sum(tag_errors + CAST(structure_error AS INTEGER)) AS BIGINT) AS errors, CAST(sum(tag_errors) AS BIGINT) AS tag_errors,
       CAST(sum(CAST(structure_error AS INTEGER)) AS BIGINT) AS structure_errors, CAST(sum(CAST(unparsed AS INTEGER)) AS BIGINT) AS unparsed,
       count(*) AS lines FROM scores"""))
def q_total_errors(spark, sf_dir):
    return evaluate.total_errors(jobs.scored_lines(_corpus_gold(spark, sf_dir), _parsed_single))


@register("p25_language_codes", """
SELECT doc_id, lang, CASE lang WHEN 'nl' THEN 'dutch' WHEN 'fr' THEN 'french' WHEN 'it' THEN 'italian'
                               WHEN 'en' THEN 'english' END AS language
FROM documents""")
def q_language_codes(spark, sf_dir):
    d = testdata.table(spark, sf_dir, "documents")
    return d.select("doc_id", "lang", T.language_of_code(F.col("lang")).alias("language"))


# ---------------------------------------------------------------- files (3.1-3.3), listings, large vocabularies

from quaestio.operators import term_search  # noqa: E402
from quaestio.plans import file_job  # noqa: E402
from quaestio.sources import posts as P  # noqa: E402
from quaestio.sources import sinks  # noqa: E402

_TYPED = """SELECT id, dataset, language, created_at, array_to_string(hashtags, '|') AS hashtags_text, full_text, quoted_text,
       favorite_count, retweet_count FROM typed"""


@register("s1_s4_csv_posts", O.with_posts(_TYPED))
def q_csv_posts(spark, sf_dir):
    """Raw posts written as CSV (quoted line breaks and all) and read back by splits."""
    from quaestio.session import scratch_path
    path = scratch_path(spark, "posts-csv")
    sinks.write_table(testdata.raw_posts(spark, sf_dir), path, "csv")
    posts = P.normalise_posts(P.read_posts_csv(spark, path))
    return posts.select("id", "dataset", "language", "created_at", F.array_join("hashtags", "|").alias("hashtags_text"),
                        "full_text", "quoted_text", "favorite_count", "retweet_count")


_LISTED = [("id", "string"), ("created_at", "date"), ("full_text", "string"), ("quoted_text", "string"), ("hashtags", "array<string>"),
           ("favorite_count", "bigint"), ("retweet_count", "bigint"), ("dataset", "string"), ("source", "string"), ("language", "string"),
           ("num_questions", "int"), ("has_question", "boolean"), ("has_disinfo_hashtags", "boolean"), ("has_disinfo_text", "boolean"),
           ("has_disinfo_text_or_hashtags", "boolean"), ("has_negation", "boolean")]


@register("a16_schema_listing", O.with_posts(" UNION ALL ".join(
    f"SELECT {i} AS position, '{c}' AS column_name, '{t}' AS data_type, count({c}) AS num_values FROM aposts"
    for i, (c, t) in enumerate(_LISTED))))
def q_schema_listing(spark, sf_dir):
    return profile.schema_listing(jobs.analysed_posts(spark, sf_dir))


def _header_rows(template: str, sheet: str) -> str:
    """The header lines of a sheet in each language that has one, as SQL rows."""
    sql = []
    for line in template.split("\n"):
        value = "'" + line.replace("'", "''") + "'"
        sql.append(f"SELECT language, '{sheet}' AS sheet, replace(replace({value}, '{{Language}}', upper(left(language, 1)) || substr(language, 2)), "
                   f"'{{language}}', language) AS line FROM (SELECT DISTINCT language FROM sheet_lines WHERE sheet = '{sheet}')")
    return " UNION ALL ".join(sql)


_DIGEST = "CAST(sum(CAST('0x' || substr(md5({}), 1, 8) AS BIGINT)) AS BIGINT)"


def _file_job_sql() -> str:
    sheet = _feature_sheet_sql()
    feature = sheet[sheet.index("picked AS ("):].replace("picked", "feature_picked")
    feature_ctes, feature_rows = feature.split("\nSELECT language, replace(feature", 1)
    return R.with_parses(f""", {_QUESTIONS},
{feature_ctes},
picked AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY language, structure, use ORDER BY md5('12345' || text), text) AS rank
  FROM (SELECT DISTINCT language, structure, use, text FROM q3 WHERE length(text) < 70 AND structure IS NOT NULL AND use IS NOT NULL)) WHERE rank <= 20),
again AS MATERIALIZED (
  WITH RECURSIVE questions AS (SELECT language || '/' || structure || '/' || use || '/' || rank AS qid, language, text AS qtext, 0 AS "offset" FROM picked),
  {R.PARSE_SINGLE}, {R.RULES}
  SELECT w.language, regexp_replace(string_agg(w.word || coalesce('[' || t.tag || ']', '') || CASE WHEN w.i = w.n - 1 THEN '' ELSE w.ws END, '' ORDER BY w.i)
                        || ' | ' || any_value(k.structure), '[\\r\\n]+', ' ', 'g') AS line
  FROM word AS w LEFT JOIN tagged AS t ON t.sid = w.sid AND t.i = w.i JOIN classed AS k ON k.sid = w.sid GROUP BY w.sid, w.language
),
sheet_lines AS (
  SELECT language, 'classification' AS sheet, line FROM again
  UNION ALL SELECT language, sheet, line FROM (SELECT language, replace(feature{feature_rows})
),
all_lines AS (SELECT * FROM sheet_lines UNION ALL {_header_rows(sinks.CLASSIFICATION_HEADER, 'classification')}
  {" ".join("UNION ALL " + _header_rows(sinks.FEATURE_HEADER, f.replace("_", "-")) for f in sampling.SHEET_FEATURES)})
SELECT 'posts' AS kind, dataset AS name, count(*) AS num_rows, {_DIGEST.format("concat_ws('|', id, full_text)")} AS digest FROM aposts GROUP BY dataset
UNION ALL SELECT 'questions', dataset, count(*), {_DIGEST.format("concat_ws('|', id, text, structure, use, qwords_functional)")} FROM q3 GROUP BY dataset
UNION ALL SELECT 'sheet', language || '/' || sheet, count(*), {_DIGEST.format('line')} FROM all_lines GROUP BY language, sheet
UNION ALL SELECT 'quality', 'posts', count(*), 0 FROM aposts
UNION ALL SELECT 'quality', 'unknown_language', count(*) FILTER (language = '???'), 0 FROM aposts
UNION ALL SELECT 'quality', 'no_date', count(*) FILTER (created_at IS NULL), 0 FROM aposts
UNION ALL SELECT 'quality', 'questions', count(*), 0 FROM q3
UNION ALL SELECT 'quality', 'unclassified', count(*) FILTER (structure IS NULL), 0 FROM q3
UNION ALL SELECT 'quality', 'no_question_word', count(*) FILTER (qwords_functional = ''), 0 FROM q3""")


@register("s6_s13_q3_file_job", _file_job_sql())
def q_file_job(spark, sf_dir):
    """The run through files, read back: rows and digests of its tables and sheets, and the
    quality counts observed on the way."""
    from quaestio.session import scratch_path
    done = file_job.run(spark, testdata.raw_posts(spark, sf_dir), scratch_path(spark, "run"), _parsed, _parsed_single)
    quality = spark.createDataFrame([("quality", k, v, 0) for k, v in done.quality.items()], "kind string, name string, num_rows long, digest long")
    return file_job.summary(spark, done).unionByName(quality)


_W = r"\p{L}\p{N}_"


@register("p13_p24_large_vocabulary", rf"""
WITH item AS (SELECT regexp_extract_all(lower(text), '[{_W}]+') AS w FROM benchmark),
terms AS (SELECT DISTINCT term FROM (
  SELECT w[i] AS term FROM item, unnest(range(1, len(w) + 1)) AS t(i) UNION ALL SELECT w[i] || ' ' || w[i + 1] FROM item, unnest(range(1, len(w))) AS t(i))),
piece AS (SELECT doc_id, i, regexp_extract(p, '[{_W}]+$') AS run, regexp_replace(p, '[{_W}]+$', '') AS gap
  FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[^{_W}]*[{_W}]+')) AS p, generate_subscripts(regexp_extract_all(lower(text), '[^{_W}]*[{_W}]+'), 1) AS i
        FROM documents)),
held AS (SELECT doc_id, run AS term FROM piece UNION SELECT a.doc_id, a.run || ' ' || b.run FROM piece AS a JOIN piece AS b
         ON b.doc_id = a.doc_id AND b.i = a.i + 1 AND b.gap = ' ')
SELECT doc_id, count(*) AS num_terms, CAST(sum(length(term)) AS BIGINT) AS num_chars FROM (SELECT DISTINCT doc_id, term FROM held JOIN terms USING (term))
GROUP BY doc_id""")
def q_large_vocabulary(spark, sf_dir):
    """Documents against a vocabulary taken from the benchmark's words and pairs of words."""
    runs = F.regexp_extract_all(F.lower("text"), F.lit(rf"([{_W}]+)"), F.lit(1))
    words = testdata.table(spark, sf_dir, "benchmark").select(runs.alias("w"))
    pairs = F.transform(F.arrays_zip(F.col("w").alias("a"), F.slice("w", 2, F.size("w")).alias("b")), lambda p: F.concat_ws(" ", p["a"], p["b"]))
    terms = words.select(F.explode(F.concat("w", F.slice(pairs, 1, F.greatest(F.size("w") - 1, F.lit(0))))).alias("term")).distinct()
    found = term_search.find_terms(testdata.dealt(testdata.table(spark, sf_dir, "documents").select("doc_id", "text")), terms, ["doc_id"], language_col=None)
    return found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("num_terms"), F.sum(F.length("term")).alias("num_chars"))
