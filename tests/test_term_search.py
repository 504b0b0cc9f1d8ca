"""Term search by join against the pattern, with terms of all shapes and a large vocabulary."""

import random
import time

from pyspark.sql import functions as F

from quaestio.functions import keywords as K
from quaestio.functions import vocab
from quaestio.operators import term_search


def test_equal_to_the_pattern(spark):
    rnd = random.Random(1)
    words = ["a", "ab", "Été", "qu", "n", "t", "no", "one", "perché", "x1", "_u"]
    seps = [" ", "'", "-", ", ", "  ", "’", ".", "\n", ""]
    terms = sorted({"".join(rnd.choice(words) + rnd.choice(seps[:4]) for _ in range(rnd.randint(1, 3))).strip(" ") for _ in range(150)}
                   | {"qu'", "n't", "'t", "no one", "Été"})
    terms = [t for t in terms if t.strip()]
    texts = [(i, "".join(rnd.choice(words) + rnd.choice(seps) for _ in range(rnd.randrange(12)))) for i in range(400)]
    texts += [(900, ""), (901, None), (902, "no one"), (903, "NO ONE"), (904, "qu'il"), (905, "qu' il"), (906, "do n't"), (907, "don't")]
    df = spark.createDataFrame(texts, "id int, text string")
    got = {tuple(r) for r in term_search.find_terms(df, spark.createDataFrame([(t,) for t in terms], "term string"), ["id"], language_col=None).collect()}
    import re
    flags = df.select("id", *[F.coalesce(K.has_any_keyword(F.col("text"), [re.escape(t)]), F.lit(False)).alias(f"t{k}") for k, t in enumerate(terms)]).collect()
    low = {}
    for t in terms:
        low.setdefault(t.lower(), t)
    want = {(r.id, t.lower()) for r in flags for k, t in enumerate(terms) if r[f"t{k}"]}
    assert {(i, t.lower()) for i, t in got} == want and len(want) > 300


def test_vocabularies_by_language(spark):
    rows = [(i, lang, text) for i, (lang, text) in enumerate(
        (lang, text) for lang in (*vocab.LANGUAGES, "klingon") for text in
        ("No one knows", "Tout le monde dit non", "o forse niente", "niet geen of", "qu'il n't", "Perché no?", ""))]
    df = spark.createDataFrame(rows, "id int, language string, text string")
    for category in ("negations", "levelers", "conjunctions", "wh_words_all"):
        terms = spark.createDataFrame([(lang, t) for lang, ts in vocab.terms_by_language(category).items() for t in ts], "language string, term string")
        found = {r.id for r in term_search.find_terms(df, terms, ["id"]).collect()}
        flags = {r.id for r in df.filter(K.has_any_keyword_by_language(F.col("text"), F.col("language"), category)).collect()}
        assert found == flags, category


def test_hundred_thousand_terms(spark, monkeypatch):
    terms = spark.range(100_000).select(F.concat(F.lit("w"), F.col("id"), F.when(F.col("id") % 3 == 0, F.lit(" tail")).otherwise(F.lit(""))).alias("term"))
    texts = spark.range(2000).select("id", F.concat(F.lit("The W"), F.col("id") * 50, F.lit(" tail w"), F.col("id"), F.lit(", x")).alias("text"))
    want = {(i, f"w{i * 50}" + (" tail" if i * 50 % 3 == 0 else "")) for i in range(2000)} | {(i, f"w{i}") for i in range(2000) if i % 3}
    for limit in (term_search.BROADCAST_BYTES, 0):
        monkeypatch.setattr(term_search, "BROADCAST_BYTES", limit)
        got = {tuple(r) for r in term_search.find_terms(texts, terms, ["id"], language_col=None).collect()}
        assert got == want


def test_empty(spark):
    none = spark.createDataFrame([], "term string")
    texts = spark.createDataFrame([(1, "a")], "id int, text string")
    assert term_search.find_terms(texts, none, ["id"], language_col=None).count() == 0
    assert term_search.find_terms(texts.limit(0), spark.createDataFrame([("a",)], "term string"), ["id"], language_col=None).count() == 0


def test_sequences_of_a_text_are_not_compared_with_each_other(spark, monkeypatch):
    """One text of 60,000 different words: time grows with its words, not with their pairs."""
    text = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(60_000)) + " w7 w8")], "id int, text string")
    terms = spark.createDataFrame([("w7 w8",), ("w59999",), ("w8 w7",)], "term string")
    for limit in (term_search.BROADCAST_BYTES, 0):
        monkeypatch.setattr(term_search, "BROADCAST_BYTES", limit)
        began = time.monotonic()
        assert {r.term for r in term_search.find_terms(text, terms, ["id"], language_col=None).collect()} == {"w7 w8", "w59999"}
        assert time.monotonic() - began < 60
    plan = term_search._sequences(text.withColumn("language", F.lit("")), ["id", "language"], "text", [1, 2], 0, 0)._jdf.queryExecution().optimizedPlan().toString()
    assert "array_distinct" not in plan
