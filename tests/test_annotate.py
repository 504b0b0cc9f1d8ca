"""Annotator hook (L0) and the last-sentence rule (G4) through all three entry points."""

import sys

from pyspark import cloudpickle
from pyspark.sql import functions as F

from quaestio.operators import annotate
import standin_parse as testdata


class SplitOnQuestionMark(annotate.ParseProvider):
    """Toy provider: whitespace tokens, a sentence ends after a token ending in '?'."""

    def parse(self, texts, language):
        out = []
        for text in texts:
            sents, cur, pos = [], [], 0
            for word in text.split(" "):
                start = text.index(word, pos)
                pos = start + len(word)
                cur.append({"i": len(cur), "idx": start, "text": word, "ws": " ", "lemma": word.lower(),
                            "pos": "X", "dep": "dep", "head": 0, "morph": {}})
                if word.endswith("?"):
                    sents.append(cur)
                    cur = []
            if cur:
                sents.append(cur)
            for s in sents:
                base = s[0]["i"]
                for t in s:
                    t["i"] -= base
            out.append(sents)
        return out


cloudpickle.register_pickle_by_value(sys.modules[__name__])


def frame(spark):
    return spark.createDataFrame([("a", "english", "Really? You came?", 10), ("b", "english", "Fine?", 0)],
                                 "id string, language string, text string, offset int")


def test_python_provider_keeps_last_sentence(spark):
    out = annotate.annotate_with_python(frame(spark), SplitOnQuestionMark)
    got = {r["id"]: (r["text"], r["offset"], [t["text"] for t in r["tokens"]], [t["idx"] for t in r["tokens"]])
           for r in out.collect()}
    assert got["a"] == ("You came?", 18, ["You", "came?"], [0, 4])
    assert got["b"] == ("Fine?", 0, ["Fine?"], [0])


def test_expression_parse_keeps_last_sentence(spark):
    out = annotate.annotate_with_expression(frame(spark), testdata.standin_parse)
    got = {r["id"]: (r["text"], r["offset"], [t["text"] for t in r["tokens"]]) for r in out.collect()}
    assert got["a"] == ("You came?", 18, ["You", "came", "?"])
    assert got["b"] == ("Fine?", 0, ["Fine", "?"])
    toks = out.filter(F.col("id") == "a").first()["tokens"]
    roots = [t for t in toks if t["head"] == t["i"]]
    assert len(roots) == 1 and roots[0]["dep"] == "ROOT"
    assert all(t["head"] < t["i"] or t["head"] == roots[0]["i"] for t in toks if t["head"] != t["i"])


def test_lookup_parse(spark):
    sents = testdata.standin_parse(F.col("text"), F.col("language"))
    table = spark.createDataFrame([("english", "Really? You came?"), ("english", "You came?"), ("english", "Fine?")],
                                  "language string, text string").withColumn("parse", sents)
    out = annotate.annotate_with_lookup(frame(spark), table)
    got = {r["id"]: (r["text"], r["offset"], len(r["tokens"])) for r in out.collect()}
    assert got == {"a": ("You came?", 18, 3), "b": ("Fine?", 0, 2)}


def test_lookup_keeps_texts_without_a_parse(spark):
    sents = testdata.standin_parse(F.col("text"), F.col("language"))
    table = spark.createDataFrame([("english", "Fine?"), ("english", "Fine?")], "language string, text string").withColumn("parse", sents)
    got = {r["id"]: r["tokens"] for r in annotate.annotate_with_lookup(frame(spark), table).collect()}
    assert got.keys() == {"a", "b"} and got["a"] is None and got["b"] is not None


def test_providers_of_different_factories_stay_apart(spark):
    def factory(name):
        class Named(annotate.ParseProvider):
            def parse(self, texts, language):
                return [[[{"i": 0, "idx": 0, "text": name, "ws": "", "lemma": name, "pos": "X", "dep": "ROOT", "head": 0, "morph": {}}]]
                        for _ in texts]
        return lambda: Named()
    for k in range(8):
        out = annotate.annotate_with_python(frame(spark), factory(f"p{k}")).collect()
        assert {t["text"] for r in out for t in r["tokens"]} == {f"p{k}"}


def test_questions_without_parse_or_vocabulary_have_no_class(spark):
    from quaestio.operators import rules
    sents = F.try_element_at(testdata.standin_parse_single(F.col("text"), F.col("language")), F.lit(1))
    df = spark.createDataFrame([("a", "english", "You came?"), ("b", "???", "You came?"), ("c", "english", "You came?")],
                               "id string, language string, text string")
    df = df.withColumn("tokens", F.when(F.col("id") != "c", sents))
    got = {r["id"]: (r["structure"], r["use"]) for r in rules.classify_sentences(df).collect()}
    assert got["a"][0] and got["a"][1] and got["b"] == got["c"] == (None, None)
