"""DuckDB twins of the SQL-expressible stages, as composable CTE text.

Used only as the correctness oracle (``oracle_sql()`` in ``__spark_entry__``). The
regular expressions come from the same builder as the Spark side, in RE2 dialect.
"""

from __future__ import annotations

from quaestio.functions import keywords as K
from quaestio.sources.testdata import DUCKDB_RAW_POSTS

WS = r"[\t\n\x0B\f\r\x1C-\x1F\x{85}\p{Z}]"


def strip_sql(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def clean_sql(x: str, lang: str) -> str:
    """P9 in DuckDB. P7 uses no look-around: the two-pass form gives the same result."""
    no_mentions = strip_sql(f"regexp_replace({x}, '@[A-Za-z0-9_]+', '', 'g')")
    no_hash = strip_sql(f"replace({no_mentions}, '#', '')")
    base = f"replace(replace({no_hash}, chr(10145), ''), chr(65039), '')"
    hy =f"regexp_replace(regexp_replace({base}, '([A-Za-z])-([A-Za-z])', '\\1 -\\2', 'g'), '([A-Za-z])-([A-Za-z])', '\\1 -\\2', 'g')"
    fr = f"replace(replace({hy}, 'Ã©', 'é'), 'Ã', 'à')"
    return strip_sql(f"CASE WHEN {lang} = 'french' THEN {fr} ELSE {base} END")


def ends_qm_sql(x: str) -> str:
    return f"ends_with(trim({x}, '!'), '?')"


def language_sql(ds: str) -> str:
    return (f"CASE WHEN starts_with({ds}, 'english') THEN 'english' WHEN starts_with({ds}, 'french') THEN 'french' "
            f"WHEN starts_with({ds}, 'italian') THEN 'italian' WHEN starts_with({ds}, 'dutch') THEN 'dutch' "
            f"ELSE '???' END")


POSTS_CTE = """
raw AS ({raw}),
typed AS (
  SELECT id,
         CAST(coalesce(try_strptime(created_at, '%Y-%m-%d %H:%M:%S'), try_strptime(created_at, '%Y-%m-%d')) AS DATE) AS created_at,
         regexp_replace(regexp_replace(coalesce(full_text, ''), '\\r', ' ', 'g'), '   +', chr(9), 'g') AS full_text,
         regexp_replace(regexp_replace(coalesce(quoted_text, ''), '\\r', ' ', 'g'), '   +', chr(9), 'g') AS quoted_text,
         list_filter(list_transform(string_split(trim(coalesce(hashtags, ''), '[]'), ','),
                                    lambda x: lower(trim(x, ' "'''))), lambda x: x <> '') AS hashtags,
         favorite_count, retweet_count, dataset, source,
         {language} AS language
  FROM raw
),
posts AS (
  SELECT *,
         num_questions > 0 AS has_question,
         {tag} AS has_disinfo_hashtags,
         {text} AS has_disinfo_text,
         {neg} AS has_negation
  FROM (SELECT *, CAST(length(full_text) - length(replace(full_text, '?', '')) AS INTEGER) AS num_questions FROM typed)
),
aposts AS (
  SELECT *, has_disinfo_text OR has_disinfo_hashtags AS has_disinfo_text_or_hashtags FROM posts
)
"""


def posts_cte(raw: str = DUCKDB_RAW_POSTS) -> str:
    return POSTS_CTE.format(
        raw=raw, language=language_sql("dataset"),
        tag=K.duckdb_tag_case("hashtags", "language", "disinfo_hashtags"),
        text=K.duckdb_keyword_case("full_text", "language", "disinfo_hashtags"),
        neg=K.duckdb_keyword_case("full_text", "language", "negations"))


def with_posts(select: str, raw: str = DUCKDB_RAW_POSTS) -> str:
    return f"WITH {posts_cte(raw)} {select}"


SENTENCE_END_SQL = r"""([.!?…]+["''”’)\]]*)([ \t\n]+)"""

SENTENCES_CTE = f"""
pieces AS (
  SELECT *, string_split(regexp_replace(full_text, '{SENTENCE_END_SQL}', '\\1\\2' || chr(1), 'g'), chr(1)) AS parts
  FROM aposts
),
exploded AS (
  SELECT id, language, dataset, created_at, favorite_count, retweet_count,
         unnest(parts) AS piece, generate_subscripts(parts, 1) AS pos
  FROM pieces
),
sent AS (
  SELECT id, language, dataset, created_at, favorite_count, retweet_count, CAST(pos - 1 AS INTEGER) AS sent_no,
         CAST(coalesce(sum(length(piece)) OVER (PARTITION BY id ORDER BY pos
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INTEGER) AS start,
         regexp_replace(piece, '[ \\t\\n]+$', '') AS text
  FROM exploded
),
cand AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY id ORDER BY sent_no) - 1 AS INTEGER) AS j
  FROM sent
  WHERE {ends_qm_sql('text')} OR {K.duckdb_keyword_case('text', 'language', 'wh_words_all')}
),
questions AS (
  SELECT * FROM (
    SELECT 'Q' || id || '.' || CAST(j AS VARCHAR) AS qid, id AS tweet_id, language, dataset, created_at,
           favorite_count, retweet_count, j, start AS "offset", text AS raw_text,
           {clean_sql('text', 'language')} AS qtext
    FROM cand)
  WHERE qtext <> ''
)
"""


def with_questions(select: str) -> str:
    return f"WITH {posts_cte()}, {SENTENCES_CTE} {select}"
