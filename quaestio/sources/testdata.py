"""Stand-in inputs derived from the driver's tables.

The driver's tables hold no posts, so these functions only *reshape* rows into the
schemas the jobs expect (raw post columns as text, like a CSV scan would give). They
do none of the jobs' work: dates and hashtag lists stay unparsed text, languages stay
implied by the dataset name, and every feature is computed later by the library.
Each stand-in has a DuckDB twin so the oracle reads exactly the same input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Closing remarks of the stand-in posts, by the language their dataset is named after. They
#: put the things that post features and clean-up look for (and look-alikes) into the rows.
REMARKS = {
    "english": ["No one knows this plandemic! Do they?", "Nothing\rwas said   here, and that is not all.", "Nothings and hoaxes ➡️ here.",
                "Why is it always her or us?"],
    "french": ["Tout le monde dit non, est-ce vrai?", "C'est dÃ©jÃ  un hoax ou pas.", "Viens-tu avec nous et elle?", "Rien\rde    nouveau ➡️ jamais."],
    "italian": ["Non è un hoax, vero?", "Chi viene con noi o con lei?", "Niente\rdi    nuovo ➡️ sempre.", "Tutti e nessuno!"],
    "dutch": ["Waarom gelooft niemand haar of ons?", "Het is geen plandemie, toch?", "Nooit\riets    nieuws ➡️ en niks.", "Wij wel!"],
    "other": ["Warum nicht?", "Nada de eso."],
}


def raw_posts_from_documents(documents: DataFrame) -> DataFrame:
    """documents -> raw post rows (text columns as a CSV scan would give them)."""
    d = F.col("doc_id")
    day = F.lpad((d % 28 + 1).cast("string"), 2, "0")
    lang_name = (F.when(F.col("lang") == "en", "english").when(F.col("lang") == "fr", "french")
                 .when((F.col("lang") == "nl") | (d % 3 == 0), "dutch").when((F.col("lang") == "it") | (d % 3 == 1), "italian")
                 .otherwise(F.col("lang")))
    remark = F.get(F.array(*map(F.lit, REMARKS["other"])), (d % len(REMARKS["other"])).cast("int"))
    for language in ("english", "french", "italian", "dutch"):
        options = REMARKS[language]
        remark = F.when(lang_name == language, F.get(F.array(*map(F.lit, options)), (d % len(options)).cast("int"))).otherwise(remark)
    first_word = F.split_part(F.col("text"), F.lit(" "), F.lit(1))
    second_word = F.split_part(F.col("text"), F.lit(" "), F.lit(2))
    return documents.select(
        d.cast("string").alias("id"),
        F.when(d % 3 == 0, F.concat(F.lit("2024-01-"), day, F.lit(" 08:30:00")))
        .when(d % 6 == 1, F.concat(F.lit("2024-02-"), day))
        .when(d % 6 == 4, F.concat(F.lit("2024-3-"), (d % 28 + 1).cast("string")))
        .otherwise(F.lit("unknown")).alias("created_at"),
        F.concat(F.lit("@user"), (d % 7).cast("string"), F.lit(" #"),
                 F.replace(F.col("text"), F.lit(","), F.lit("?")), F.lit(" "), remark).alias("full_text"),
        F.when(d % 4 == 0, F.lit(None).cast("string")).otherwise(F.lit("")).alias("quoted_text"),
        F.concat(F.lit("['"), first_word, F.lit("', '"), second_word,
                 F.when(d % 10 == 0, F.lit("', 'Hoax']")).otherwise(F.lit("']"))).alias("hashtags"),
        (F.col("n_chars") % 100).alias("favorite_count"),
        (d % 17).alias("retweet_count"),
        F.concat(lang_name, F.lit("_"), F.col("source")).alias("dataset"),
        F.col("source").alias("source"),
    )


_LANG_NAME_SQL = """CASE WHEN lang = 'en' THEN 'english' WHEN lang = 'fr' THEN 'french'
                 WHEN lang = 'nl' OR doc_id % 3 = 0 THEN 'dutch' WHEN lang = 'it' OR doc_id % 3 = 1 THEN 'italian' ELSE lang END"""


def _remark_sql(language: str) -> str:
    def quoted(x: str) -> str:
        return "'" + x.replace("'", "''").replace("\r", "' || chr(13) || '") + "'"
    return f"([{', '.join(map(quoted, REMARKS[language]))}])[doc_id % {len(REMARKS[language])} + 1]"


DUCKDB_RAW_POSTS = f"""
SELECT CAST(doc_id AS VARCHAR) AS id,
       CASE WHEN doc_id % 3 = 0 THEN '2024-01-' || lpad(CAST(doc_id % 28 + 1 AS VARCHAR), 2, '0') || ' 08:30:00'
            WHEN doc_id % 6 = 1 THEN '2024-02-' || lpad(CAST(doc_id % 28 + 1 AS VARCHAR), 2, '0')
            WHEN doc_id % 6 = 4 THEN '2024-3-' || CAST(doc_id % 28 + 1 AS VARCHAR)
            ELSE 'unknown' END AS created_at,
       '@user' || CAST(doc_id % 7 AS VARCHAR) || ' #' || replace(text, ',', '?') || ' ' ||
         CASE {_LANG_NAME_SQL} {' '.join(f"WHEN '{x}' THEN {_remark_sql(x)}" for x in ('dutch', 'italian', 'french', 'english'))}
              ELSE {_remark_sql('other')} END AS full_text,
       CASE WHEN doc_id % 4 = 0 THEN NULL ELSE '' END AS quoted_text,
       '[''' || split_part(text, ' ', 1) || ''', ''' || split_part(text, ' ', 2)
             || CASE WHEN doc_id % 10 = 0 THEN ''', ''Hoax'']' ELSE ''']' END AS hashtags,
       n_chars % 100 AS favorite_count,
       doc_id % 17 AS retweet_count,
       {_LANG_NAME_SQL} || '_' || source AS dataset,
       source
FROM documents
"""


def raw_posts(spark: SparkSession, sf_dir: str, small_texts: bool = False) -> DataFrame:
    """With ``small_texts`` a part holds about PART_TEXT_BYTES of text (see :func:`dealt`)."""
    return raw_posts_from_documents(dealt(table(spark, sf_dir, "documents"), "text" if small_texts else None))


#: Text of a part in bytes, where rows repeat the text of their post. A Parquet file holds each value once as
#: long as its different values are under 1 MB (``parquet.dictionary.page.size``), and from then on every copy;
#: half of that leaves room for parts that get more than their share.
PART_TEXT_BYTES = 512 * 1024


def dealt(df: DataFrame, text: str | None = None) -> DataFrame:
    """The rows dealt out evenly: a table may be one file with one row group, i.e. one task.
    The number of parts follows the scan's, so tasks stay as small when the table grows. With ``text`` it also
    follows that column's size, added up in a pass of its own, and a part has about PART_TEXT_BYTES of it."""
    parts = 4 * max(df.sparkSession.sparkContext.defaultParallelism, df.rdd.getNumPartitions())
    if text is not None:
        parts = max(parts, -(-(df.agg(F.sum(F.octet_length(text))).first()[0] or 0) // PART_TEXT_BYTES))
    return df.repartition(parts)


def raw_posts_from_conversations(conversations: DataFrame) -> DataFrame:
    """conversations -> raw post rows: one post per turn, dataset named after the role."""
    return conversations.select(
        F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string")).alias("id"),
        F.lit(None).cast("string").alias("created_at"),
        F.col("text").alias("full_text"),
        F.lit("").alias("quoted_text"),
        F.lit("[]").alias("hashtags"),
        F.lit(0).cast("bigint").alias("favorite_count"),
        F.col("turn").cast("bigint").alias("retweet_count"),
        F.concat(F.lit("french_conv_"), F.col("role")).alias("dataset"),
    )


DUCKDB_RAW_CONVERSATION_POSTS = """
SELECT 'c' || CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR) AS id, CAST(NULL AS VARCHAR) AS created_at,
       text AS full_text, '' AS quoted_text, '[]' AS hashtags, CAST(0 AS BIGINT) AS favorite_count,
       CAST(turn AS BIGINT) AS retweet_count, 'french_conv_' || role AS dataset, CAST(NULL AS VARCHAR) AS source
FROM conversations
"""
