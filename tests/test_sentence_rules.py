"""The rules in the Python worker against the expressions over a token column, and the pass that parses and classifies."""

import random

import pytest
from pyspark.sql import functions as F

from parse_fixtures import SENT_SCHEMA
from quaestio.functions import vocab
from quaestio.operators import annotate, closed_class, rules, sentence_rules
from quaestio.plans import catalog, jobs
from test_rules_differential import conjoined, sentence

NAMES = ["i", "idx", "text", "ws", "lemma", "pos", "dep", "head", "morph"]


def odd(rnd, token, n):
    """Null fields, heads that are missing, out of the sentence or in a cycle."""
    token = list(token)
    if rnd.random() < 0.08:
        token[rnd.choice([4, 5, 6])] = None
    if rnd.random() < 0.06:
        token[7] = rnd.choice([None, -1, 99, rnd.randrange(n)])
    if rnd.random() < 0.08:
        token[8] = rnd.choice([None, {"Number": None}])
    return tuple(token)


@pytest.mark.parametrize("accept_upper_neg, spaced_est_ce", [(False, False), (True, True)])
def test_equal_to_the_expressions(spark, accept_upper_neg, spaced_est_ce):
    rnd, rows = random.Random(5), []
    for language in (*vocab.LANGUAGES, "german"):
        for k in range(500):
            text, tokens = (conjoined if k % 25 == 0 else sentence)(rnd, "dutch" if language == "german" else language)
            if k % 3 == 0:
                tokens = [odd(rnd, t, len(tokens)) for t in tokens]
            own = [(*t[:8], None if t[8] is None else {a: None if b is None else b.split(",") for a, b in t[8].items()}) for t in tokens]
            rows.append((f"{language}{k}", language, text, own))
    rows += [("none", "french", "Est-ce vrai ?", None), ("empty", "french", "C'est vrai ou non?", []), ("unknown", None, "right?", None)]
    out = rules.classify_sentences(spark.createDataFrame(rows, SENT_SCHEMA).repartition(4), accept_upper_neg=accept_upper_neg, spaced_est_ce=spaced_est_ce)
    want = {r.sent_id: r for r in out.select("sent_id", *rules.RESULT_COLUMNS, F.transform("tokens", lambda t: t["qtype"]).alias("tags")).collect()}
    tagged = 0
    for sid, language, text, tokens in rows:
        parse = None if tokens is None else [dict(zip(NAMES, t)) for t in tokens]
        got = sentence_rules.classify(language, text, parse, accept_upper_neg, spaced_est_ce)
        assert got[:-1] == tuple(want[sid][c] for c in rules.RESULT_COLUMNS), (sid, text)
        assert (None if tokens is None else [dict(got[-1]).get(i) for i in range(len(tokens))]) == want[sid].tags, (sid, text)
        tagged += len(got[-1] or ())
    assert tagged > 1000


TEXTS = [("a", "english", "So? Who knows why?", 3), ("b", None, "Who?", 0), ("c", "english", None, None), ("d", "german", "Wer weiß wo?", 1),
         ("a", "english", "So? Who knows why?", 3), (None, "dutch", "Ik weet niet waarom.", 2), ("e", "french", "Est-ce vrai ou non?", 0),
         ("f", "italian", "", 5), ("g", "italian", "Chi viene con noi!", 6), ("h", "english", "He left.", 7), ("i", "english", "!!", 8)]


@pytest.mark.parametrize("remove_nonquestions", [False, True])
def test_one_pass_equals_two(spark, remove_nonquestions):
    df = spark.createDataFrame(TEXTS, "id string, language string, text string, offset int").repartition(3)
    results = ["tokens", *rules.RESULT_COLUMNS]
    one = rules.classified(df, annotate.PythonAnnotator(closed_class.ClosedClassProvider), results=results, remove_nonquestions=remove_nonquestions)
    two = rules.classified(df, lambda x: annotate.annotate_with_python(x, closed_class.ClosedClassProvider), results=results,
                           remove_nonquestions=remove_nonquestions)
    slim = F.transform("tokens", lambda t: F.struct(*[t[c].alias(c) for c in ("i", "idx", "text", "ws", "qtype")])).alias("tokens")
    both = [sorted(map(repr, x.select(*df.columns, slim, *rules.RESULT_COLUMNS).collect())) for x in (one, two)]
    assert both[0] == both[1] and one.columns == two.columns and dict(one.drop("tokens").dtypes) == dict(two.drop("tokens").dtypes)
    uses = [r.use for r in one.collect()]
    assert ("no" in uses) != remove_nonquestions and None in uses and (len(uses) == len(TEXTS)) != remove_nonquestions
    none = rules.classified(df.limit(0), annotate.PythonAnnotator(closed_class.ClosedClassProvider), results=results)
    assert none.collect() == [] and none.columns == one.columns


def test_parses_of_questions_stay_in_the_worker(spark, tmp_path):
    docs = [(i, text, "en", "web", len(text)) for i, text in enumerate(["Who knows why, he left. Nothing was said.", "What do you want, or not"])]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("a9_structure_use_counts", "l25_p31_word_tags", "l27_rising_declaratives", "l13_l15_sentence_analysis"):
        plan = catalog.QUERIES[name](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
        assert plan.count("MapInArrow") == 1 and "tokens[" not in plan and "inline_outer" not in plan
    got = jobs.questions(spark, str(tmp_path), catalog._parsed).select("text", "structure", "use").collect()
    assert any(r.structure == "wh" and r.use == "direct" for r in got) and all(r.use != "no" for r in got)


def test_rare_words_share_what_they_say():
    """As many different words as a table has cost no more than frequent ones."""
    provider, kept = closed_class.ClosedClassProvider(), len(sentence_rules._WORDS)
    texts = [f"Who{k}s knows why{k} {k} Word{k} - -x{k}'?" for k in range(3000)]
    parses = [sents[-1] for sents in provider.parse(texts, "english")]
    for text, tokens in zip(texts, parses):
        sentence_rules.classify("english", text, tokens)
        for t in tokens:
            lemma, pos, morph = closed_class.lookup("english", t["text"], t["i"] == 0)
            assert (t["lemma"], t["pos"], "|".join(f"{a}={','.join(b)}" for a, b in t["morph"].items())) == (lemma, pos, morph)
            assert text[t["idx"]:].startswith(t["text"] + t["ws"])
    assert len({t["text"] for tokens in parses for t in tokens}) > 12_000
    assert len({id(t["morph"]) for tokens in parses for t in tokens}) < 10 and len(sentence_rules._WORDS) - kept < 20
    assert [t["pos"] for t in parses[7]] == ["NOUN", "VERB", "NOUN", "NUM", "PROPN", "PUNCT", "NOUN", "PUNCT"]
