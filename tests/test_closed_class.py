"""The shallow parser: tokens, trees, and parses of real questions through every entry point."""

import random

import pytest
from pyspark.sql import functions as F

from quaestio.functions import vocab
from quaestio.operators import annotate, closed_class, rules, token_table
from quaestio.operators.closed_class import ClosedClassProvider, attach

QUESTIONS = [  # language, text, structure, use
    ("english", "Do you know who said it?", "polar", "indirect"), ("english", "Who said it?", "wh", "direct"),
    ("english", "They left?", "risingdecl", "direct"), ("english", "Tomorrow?", "elliptic", "direct"),
    ("dutch", "Weet je wie het heeft gezien?", "polar", "indirect"), ("dutch", "Wat wil je weten?", "wh", "direct"),
    ("french", "Sais-tu qui a dit rien?", None, None), ("italian", "Chi viene con noi?", "wh", "direct")]


def test_tokens_cover_the_text():
    rnd = random.Random(1)
    provider, single = ClosedClassProvider(), closed_class.single_sentence()
    for _ in range(300):
        text = "".join(rnd.choice(["a", "Été", "qu'", "-ce", "!", "?", ".", " ", "\n", " ", "…", "日", "_1", ",", "’"]) for _ in range(rnd.randrange(25)))
        sentences = provider.parse([text], "french")[0]
        flat = [t for s in sentences for t in s]
        assert all(text[t["idx"]:t["idx"] + len(t["text"])] == t["text"] for t in flat)
        assert "".join(t["text"] + t["ws"] for t in flat) == text.lstrip(" \n ")
        assert [[t["text"] for s in p for t in s] for p in (sentences, single.parse([text], "french")[0])] in ([[t["text"] for t in flat]] * 2,)
        assert len(single.parse([text], "french")[0]) <= 1


def test_every_path_ends_at_the_root():
    rnd = random.Random(2)
    parts = ["VERB", "AUX", "NOUN", "PRON", "ADJ", "ADV", "DET", "ADP", "SCONJ", "CCONJ", "PART", "PUNCT", "PROPN", "NUM"]
    for language in vocab.LANGUAGES:
        words = vocab.wh_words_all[language] + ["x", ",", "y"]
        for _ in range(500):
            n = rnd.randint(1, 12)
            links = attach(language, [rnd.choice(parts) for _ in range(n)], [rnd.choice(words) for _ in range(n)])
            assert sum(dep == "ROOT" for dep, _ in links) == 1
            for i in range(n):
                at, steps = i, 0
                while links[at][1] != at:
                    at, steps = links[at][1], steps + 1
                    assert steps <= n
                assert links[at][0] == "ROOT"


@pytest.fixture(scope="module")
def frame(spark):
    rows = [(k, lang, text, 5) for k, (lang, text, *_) in enumerate(QUESTIONS)]
    return spark.createDataFrame([*rows, (50, "english", "It is so. Is it?", 7), (51, "english", None, 0), (52, None, "no language?", 0)],
                                 "id int, language string, text string, offset int")


def test_questions(frame):
    out = {r.id: r for r in rules.classify_sentences(annotate.annotate_with_python(frame, ClosedClassProvider)).collect()}
    for k, (_, text, structure, use) in enumerate(QUESTIONS):
        if structure:
            assert (out[k].structure, out[k].use) == (structure, use), (text, out[k].structure, out[k].use, out[k].tokens)
    assert (out[50].text, out[50].offset) == ("Is it?", 17)
    assert out[52].tokens is None and out[52].structure is None




def test_cache_parses_once(spark, frame, tmp_path):
    path = str(tmp_path / "parses")
    assert annotate.fill_parse_cache(frame, path, ClosedClassProvider) == len(QUESTIONS) + 1 + 1  # and the last sentence of one
    assert annotate.fill_parse_cache(frame, path, ClosedClassProvider) == 0
    more = frame.union(spark.createDataFrame([(60, "dutch", "Nieuw?", 0)], frame.schema))
    assert annotate.fill_parse_cache(more, path, ClosedClassProvider) == 1
    direct = {r.id: r for r in annotate.annotate_with_python(frame, ClosedClassProvider).select("id", "text", "offset", "tokens").collect()}
    cached = {r.id: r for r in annotate.annotate_with_cache(frame, path, ClosedClassProvider).select("id", "text", "offset", "tokens").collect()}
    assert direct.keys() == cached.keys()
    for k, r in direct.items():
        assert (r.text, r.offset) == (cached[k].text, cached[k].offset)
        assert [t.asDict() for t in r.tokens or []] == [t.asDict() for t in cached[k].tokens or []]


def test_single_sentence_mode_in_every_entry(spark, frame, tmp_path):
    asked = frame.filter("id = 50")
    path = str(tmp_path / "single")
    python = annotate.annotate_with_python(asked, closed_class.single_sentence).first()
    cached = annotate.annotate_with_cache(asked, path, closed_class.single_sentence, single_sentence=True).first()
    table = annotate.read_parse_cache(spark, path)
    looked = annotate.annotate_with_lookup(asked, table, single_sentence=True).first()
    bare = annotate.annotate_with_lookup(asked, table.drop("single_sentence", "key"), single_sentence=True).first()
    assert annotate.annotate_with_lookup(asked, table).first().tokens is None  # no parse of the other mode
    for r in (python, cached, looked, bare):
        assert (r.text, r.offset, len(r.tokens)) == ("It is so. Is it?", 7, 7)


def test_ancestors_errors_and_marks(spark):
    chain = [("a", i, max(i - 1, 0), i == 3) for i in range(9)]
    got = {(r.id, r.i): r for r in token_table.ancestors(spark.createDataFrame([*chain, ("b", 0, 0, True)], "id string, i int, head int, m boolean"),
                                                         marked="m").collect()}
    assert list(got["a", 8].path) == list(range(8, -1, -1)) and got["a", 8].depth == 8 and got["a", 8].nearest == 3
    assert got["a", 3].nearest is None and got["b", 0].depth == 0 and list(got["b", 0].path) == [0]
    for rows in ([("a", 0, 1, False), ("a", 1, 0, False)], [("a", 0, 7, False)]):
        with pytest.raises(ValueError):
            token_table.ancestors(spark.createDataFrame(rows, "id string, i int, head int, m boolean"))


def test_both_spellings_of_est_ce(spark):
    df = spark.createDataFrame([(1, "french", "Est -ce vrai?"), (2, "french", "Est-ce vrai?")], "id int, language string, text string")
    parsed = annotate.annotate_with_python(df, ClosedClassProvider)
    literal, both = ({r.id: r.subj_verb_inversion for r in rules.classify_sentences(parsed, spaced_est_ce=x).collect()} for x in (False, True))
    assert literal[2] is True and both == {1: True, 2: True}
