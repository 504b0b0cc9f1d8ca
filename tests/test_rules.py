"""Token-tree rules on hand-written parses; expected values were traced by hand through
the rule definitions (each case fires some rules and leaves others silent)."""

import pytest
from pyspark.sql import functions as F

from parse_fixtures import (DO_THEY_KNOW, EST_CE_QUE, I_WONDER_WHY, IK_VRAAG_ME_AF, SUCRE_OU_CITRON, TOMORROW,
                            WAT_EEN_ROMMEL, WHAT_DO_YOU_WANT, YOU_ARE_COMING, YOU_CAME_DIDNT_YOU, frame)
from quaestio.operators import rules

CASES = [
    # id, language, sentence, structure, use, inversion, tag question, matrix (verb, subj), tags
    ("do_they_know", "english", DO_THEY_KNOW, "polar", "direct", True, False, (0, 1),
     [None, None, None, "no", None]),
    ("what_want", "english", WHAT_DO_YOU_WANT, "wh", "direct", True, False, (1, 2),
     ["fronted", None, None, None, None]),
    ("i_wonder", "english", I_WONDER_WHY, "decl", "indirect", False, False, (1, 0),
     [None, None, "indirect", None, None, None]),
    ("tag_q", "english", YOU_CAME_DIDNT_YOU, "tag", "direct", False, True, (1, 0),
     [None] * 7),
    ("elliptic", "english", TOMORROW, "elliptic", "direct", None, False, (None, None), [None, None]),
    ("rising", "english", YOU_ARE_COMING, "risingdecl", "direct", False, False, (1, 0), [None] * 4),
    ("wat_een", "dutch", WAT_EEN_ROMMEL, "decl", "no", False, False, (3, 2),
     ["no", None, None, None, None, None]),
    ("vraag_af", "dutch", IK_VRAAG_ME_AF, "decl", "indirect", False, False, (1, 0),
     [None, None, None, None, "indirect", None, None, None]),
    ("est_ce", "french", EST_CE_QUE, "insitu", "direct", True, False, (0, 1),
     [None, None, "insitu", None, None, None]),
    ("sucre_ou_citron", "french", SUCRE_OU_CITRON, "risingdecl", "direct", False, False, (2, 0),
     [None, None, None, None, "no", None, None]),
]


@pytest.fixture(scope="module")
def classified(spark):
    df = frame(spark, [(c[0], c[1], c[2]) for c in CASES])
    out = rules.classify_sentences(df).select(
        "sent_id", "structure", "use", "subj_verb_inversion", "has_tag_question", "matrix_verb", "matrix_subject",
        "qwords_literal", "qwords_functional", F.transform("tokens", lambda t: t["qtype"]).alias("tags"),
        F.transform("tokens", lambda t: t["clemma"]).alias("clemmas"))
    return {r["sent_id"]: r for r in out.collect()}


@pytest.mark.parametrize("case", CASES, ids=[c[0] for c in CASES])
def test_classification(classified, case):
    sid, _lang, _s, structure, use, inv, tagq, (mv, ms), tags = case
    r = classified[sid]
    assert r["structure"] == structure
    assert r["use"] == use
    assert r["subj_verb_inversion"] == inv
    assert r["has_tag_question"] == tagq
    assert (r["matrix_verb"], r["matrix_subject"]) == (mv, ms)
    assert list(r["tags"]) == tags


def test_question_words(classified):
    assert list(classified["what_want"]["qwords_literal"]) == ["what"]
    assert list(classified["what_want"]["qwords_functional"]) == ["what"]
    assert list(classified["i_wonder"]["qwords_literal"]) == []
    assert list(classified["i_wonder"]["qwords_functional"]) == ["why"]
    assert list(classified["vraag_af"]["qwords_functional"]) == ["wie"]


def test_corrected_lemma(classified):
    # particle verb: lemma gets the particle as a prefix
    assert classified["vraag_af"]["clemmas"][1] == "af_vragen"
    assert classified["do_they_know"]["clemmas"][0] == "do"


def test_corrected_lemma_cases(spark):
    from parse_fixtures import SENT_SCHEMA, tokens
    text = "merkken af_vragen"
    spec = [("merkken", "merkken", "VERB", "ROOT", 0), ("af_vragen", "af_vragen", "VERB", "conj", 0)]
    df = spark.createDataFrame([("x", "dutch", text, tokens(text, spec))], SENT_SCHEMA)
    r = rules.classify_sentences(df).select(F.transform("tokens", lambda t: t["clemma"]).alias("c")).first()
    assert list(r["c"]) == ["merken", "vragen"]


def test_domains(classified):
    for r in classified.values():
        assert r["structure"] in rules.STRUCTURES
        assert r["use"] in rules.USES
        assert all(t is None or t in rules.QTYPES for t in r["tags"])


def test_filter_on_results_keeps_plan_small(spark):
    df = frame(spark, [(c[0], c[1], c[2]) for c in CASES])
    out = rules.classify_sentences(df).filter(F.col("use") != "no").filter(F.col("structure") == "wh")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert len(plan) < 200_000
    assert [r["sent_id"] for r in out.collect()] == ["what_want"]


def test_rising_declarative(classified, spark):
    df = frame(spark, [("rising", "english", YOU_ARE_COMING), ("elliptic", "english", TOMORROW)])
    out = rules.is_rising_declarative(rules.classify_sentences(df))
    got = {r["sent_id"]: r["is_rising_declarative"] for r in out.collect()}
    assert got == {"rising": True, "elliptic": True}
