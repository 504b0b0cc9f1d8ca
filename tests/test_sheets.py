"""Classification sheet lines (A14 + P30) and the vocabulary frame."""

from parse_fixtures import DO_THEY_KNOW, I_WONDER_WHY, WHAT_DO_YOU_WANT, frame
from quaestio.functions import vocab
from quaestio.operators import rules
from quaestio.plans import jobs


def test_classification_sheet_lines(spark):
    df = frame(spark, [("a", "english", DO_THEY_KNOW), ("b", "english", WHAT_DO_YOU_WANT),
                       ("c", "english", I_WONDER_WHY), ("d", "english", WHAT_DO_YOU_WANT)])
    lines = jobs.classification_sheet(rules.classify_sentences(df), k=20)
    got = sorted((r["section"], r["line"]) for r in lines.collect())
    assert got == [("decl/indirect", "I wonder why[indirect] he left. | decl"),
                   ("polar/direct", "Do they know why[no]? | polar"),
                   ("wh/direct", "What[fronted] do you want? | wh")]  # duplicate text kept once


def test_vocab_frame(spark):
    df = vocab.vocab_frame(spark)
    rows = {(r["category"], r["language"], r["term"]) for r in df.collect()}
    assert ("wh_words_all", "dutch", "of") in rows
    assert ("french_il_drop_verbs", "french", "faut") in rows
    n_negations = df.filter("category = 'negations'").count()
    assert n_negations == sum(len(v) for v in vocab.negations.values())
