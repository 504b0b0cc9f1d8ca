"""The token rules against their relational twin on random trees: 5,000 sentences a
language, every rule both fired and not fired, all results equal."""

import random
from collections import Counter

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from parse_fixtures import SENT_SCHEMA
from quaestio.functions import vocab
from quaestio.operators import rules, token_table, tokens
from quaestio.plans import parse_oracle as P

PER_LANGUAGE = 5000
DEPS = ["nsubj", "obj", "obl", "advmod", "mark", "cc", "conj", "ccomp", "acl:relcl", "xcomp", "aux", "cop", "parataxis", "nmod", "csubj",
        "iobj", "advcl", "expl", "nummod", "fixed", "dep", "det", "neg", "nmod:poss", "aux:pass", "compound:prt", "punct", "num", "nsubj:pass"]
POS = ["VERB", "AUX", "ADJ", "NOUN", "PRON", "SCONJ", "CCONJ", "DET", "ADV", "PROPN", "PART", "PUNCT"]
MORPH = {"VerbForm": ["Fin", "Fin", "Inf", "Part"], "Tense": ["Pres", "Past", "Past,Pres"], "Number": ["Plur", "Sing"], "Person": ["1", "2", "3", "1,2"],
         "Polarity": ["neg", "Neg"], "PronType": ["Rel", "Int"], "Aspect": ["Prog"]}
EXTRA = {"dutch": ["wat", "een", "waar", "er", "bedoeld", "merkken", "vraag", "vragen", "af_vragen", "af", "Toch", "of"],
         "french": ["à", "ce", "est", "-ce", "-il", "ou", "que", "quand", "même", "bien", "faut", "veut", "non", "ou non", "est-ce"],
         "english": ["right", "you", "that", "it", "have", "see", "question", "mystery"], "italian": ["vero", "no", "la", "avere", "vedere"]}
ENDS = ["?", "?", "?", "!", ".", "", "?!", " toch?", " ou non?", " right?", " vero?", "…"]


def sentence(rnd, language):
    n = rnd.choice([1, 2, 3, 4, 5, 6, 7, 8, 9, 12])
    wh = vocab.wh_words_all[language]
    lemmas = vocab.all_embedders[language] + vocab.verbs_like_want[language]
    closed = (vocab.personal_existentials[language] + vocab.impersonals[language] + vocab.neutral_pronouns[language] + vocab.complementizers[language]
              + vocab.negations[language] + vocab.perfect_auxiliaries[language] + vocab.who_like[language])
    order = list(range(n))
    rnd.shuffle(order)
    heads = [0] * n
    for k, i in enumerate(order):  # a random tree: every token hangs from one placed before it
        heads[i] = order[rnd.randrange(k)] if k else i
        if k and rnd.random() < 0.4:
            heads[i] = order[0]
    out, at = [], 0
    for i in range(n):
        word = rnd.choice(rnd.choice([wh, wh, closed, EXTRA[language], lemmas, ["x", "Huis", "dogs", ","]]))
        word = word.capitalize() if rnd.random() < 0.1 else word
        lemma = word if rnd.random() < 0.5 else rnd.choice(rnd.choice([lemmas, closed, wh, EXTRA[language]]))
        dep = ("ROOT" if rnd.random() < 0.9 else rnd.choice(DEPS)) if heads[i] == i else rnd.choice(DEPS)
        pos = "PUNCT" if word == "," and rnd.random() < 0.8 else rnd.choice(POS)
        morph = {k: rnd.choice(v) for k, v in MORPH.items() if rnd.random() < (0.45 if k in ("VerbForm", "Tense", "Number") else 0.2)}
        ws = rnd.choice([" ", " ", " ", "", "  "])
        out.append((i, at, word, ws, lemma, pos, dep, heads[i], morph))
        at += len(word) + len(ws)
    if rnd.random() < 0.15 and n >= 4:  # the shape of an English tag question
        tail = ["AUX", "PART", "PRON", "PUNCT"][-rnd.choice([3, 4]):] if rnd.random() < 0.5 else ["AUX", "PRON", "PUNCT"]
        for k, p in enumerate(tail):
            i = n - len(tail) + k
            out[i] = (*out[i][:5], p, *out[i][6:])
    return "".join(w + ws for _, _, w, ws, *_ in out).rstrip() + rnd.choice(ENDS), out


def conjoined(rnd, language):
    """Two conjoined clauses, each with a question word: the case that reads earlier tags."""
    wh = [w for w in vocab.wh_words[language] if w.isalpha()]
    spec = [(rnd.choice(wh), "ADV", "advmod", 1, {}), ("x", "VERB", "ROOT", 1, {"VerbForm": "Fin", "Tense": "Pres"}), ("y", "PRON", "nsubj", 1, {"Person": "2"}),
            ("z", "CCONJ", "cc", 5, {}), (rnd.choice(wh), "ADV", rnd.choice(["advmod", "obj"]), 5, {}),
            ("w", "VERB", "conj", 1, {"VerbForm": rnd.choice(["Fin", "Part"])})]
    out, at = [], 0
    for i, (word, pos, dep, head, morph) in enumerate(spec):
        out.append((i, at, word, " ", word, pos, dep, head, morph))
        at += len(word) + 1
    return " ".join(w for w, *_ in spec) + rnd.choice(["?", ""]), out


@pytest.fixture(scope="module")
def both(spark):
    rnd = random.Random(7)
    rows = [(f"{language}{k}", language, *(conjoined if k % 50 == 0 else sentence)(rnd, language)) for language in vocab.LANGUAGES for k in range(PER_LANGUAGE)]
    flat = [(sid, language, text, len(toks), i, idx, word, ws, lemma, pos, "|".join(f"{a}={b}" for a, b in morph.items()), dep, head)
            for sid, language, text, toks in rows for i, idx, word, ws, lemma, pos, dep, head, morph in toks]
    names = ["sid", "language", "stext", "n", "i", "idx", "word", "ws", "lemma", "pos", "morph", "dep", "head"]
    tok = pa.table(dict(zip(names, map(list, zip(*flat)))))
    con = duckdb.connect()
    con.register("tok", tok)
    for name in ("word", "subj", "clause", "heads_question", "qword", "way", "options", "pair", "ready", "tagged", "classed"):
        con.execute(f"CREATE TABLE got_{name} AS WITH RECURSIVE {P.RULES} SELECT * FROM {name}")
    parsed = [(sid, language, text, [(*t[:8], {k: v.split(",") for k, v in t[8].items()}) for t in toks]) for sid, language, text, toks in rows]
    df = rules.classify_sentences(spark.createDataFrame(parsed, SENT_SCHEMA).repartition(8)).select(
        "sent_id", "matrix_verb", "matrix_subject", "subj_verb_inversion", "has_tag_question", "structure", "use", "qwords_literal",
        "qwords_functional", "ends_with_question_mark", F.transform("tokens", lambda t: t["qtype"]).alias("tags"),
        F.transform("tokens", lambda t: t["clemma"]).alias("clemmas"))
    return con, {r.sent_id: r for r in df.collect()}, rows


def differing(got, want):
    assert got.keys() == want.keys()
    return [(k, got[k], want[k]) for k in got if got[k] != want[k]]


def test_clause_and_class(both):
    con, spark_rows, rows = both
    want = {r[0]: tuple(r[1:]) for r in con.execute(
        "SELECT sid, mv, ms, inv, tagq, structure, use, literal, functional, qm FROM got_classed").fetchall()}
    got = {k: tuple(list(r)[1:7]) + (list(r.qwords_literal), list(r.qwords_functional), r.ends_with_question_mark) for k, r in spark_rows.items()}
    assert len(got) == len(rows) == 4 * PER_LANGUAGE
    assert not differing(got, want)[:5]


def test_word_tags_and_lemmas(both):
    con, spark_rows, rows = both
    tags = {(s, i): t for s, i, t in con.execute("SELECT sid, i, tag FROM got_tagged").fetchall()}
    got = {(k, i): t for k, r in spark_rows.items() for i, t in enumerate(r.tags) if t is not None}
    assert not differing(got, tags)[:5]
    lemmas = {(s, i): t for s, i, t in con.execute("SELECT sid, i, clemma FROM got_word").fetchall()}
    assert not differing({(k, i): t for k, r in spark_rows.items() for i, t in enumerate(r.clemmas)}, lemmas)[:5]


def test_every_rule_fires_and_does_not(both):
    con, spark_rows, _ = both
    for table, columns in {"word": "verblike adr spk exist imp who neg negated wanted emb present skipped fin pqw only_emb", "ready": "notq relc conjoined before_verb mnc direct cc rest",
                           "clause": "tagq qm exclaims", "heads_question": "likely", "pair": "pre"}.items():
        for c in columns.split():
            n = dict(con.execute(f"SELECT {c}, count(*) FROM got_{table} WHERE {c} IS NOT NULL GROUP BY 1").fetchall())
            assert n.get(True) and n.get(False), (table, c, n)
    for expression, least in {"a IS NOT NULL": 100, "b IS NOT NULL AND a IS NULL": 100, "walk_kind = 'verb'": 100, "walk_kind = 'noun'": 100}.items():
        assert con.execute(f"SELECT count(*) FROM got_options WHERE {expression}").fetchone()[0] >= least
    assert {r.structure for r in spark_rows.values()} == set(rules.STRUCTURES) and {r.use for r in spark_rows.values()} == set(rules.USES)
    for language in vocab.LANGUAGES:
        tags = Counter(t for k, r in spark_rows.items() if k.startswith(language) for t in r.tags)
        assert all(tags[t] > 20 for t in rules.QTYPES), (language, tags)
        inv = Counter(r.subj_verb_inversion for k, r in spark_rows.items() if k.startswith(language))
        assert all(inv[x] > 20 for x in (True, False, None)), (language, inv)


def test_paths_to_the_root(spark, both):
    """L1 of the token arrays against the recursive walk."""
    con, _, rows = both
    part = rows[::10]
    df = spark.createDataFrame([(sid, language, text, [(*t[:8], {}) for t in toks]) for sid, language, text, toks in part], SENT_SCHEMA)
    tree = tokens.Tree(F.col("tokens"), F.col("language"))
    got = {r.sent_id: [list(p) for p in r.paths] for r in df.select("sent_id", F.transform("tokens", tree.path_to_root).alias("paths")).collect()}
    for sid, _, _, toks in part:
        heads = [t[7] for t in toks]
        for i, path in enumerate(got[sid]):
            want = [i]
            while heads[want[-1]] != want[-1]:
                want.append(heads[want[-1]])
            assert path == want


def test_word_facts_of_token_rows(spark, both):
    """L2-L9, L16, L18 by joins over token rows, and L12, against the twin."""
    con, _, rows = both
    part = rows[::8]
    df = spark.createDataFrame([(sid, language, text, [(*t[:8], {k: v.split(",") for k, v in t[8].items()}) for t in toks])
                                for sid, language, text, toks in part], SENT_SCHEMA)
    flat = token_table.token_rows(df, "sent_id")
    got = {(r[0], r[1]): tuple(r[2:]) for r in token_table.word_facts(flat, "sent_id").select("sent_id", "i", *token_table.FACTS).collect()}
    kept = {r[0] for r in part}
    want = {(r[0], r[1]): tuple(r[2:]) for r in con.execute(f"SELECT sid, i, {', '.join(token_table.FACTS)} FROM got_word").fetchall() if r[0] in kept}
    assert not differing(got, want)[:5] and len(got) > 10_000
    finite = {(r.sent_id, r.i) for r in token_table.finite_verbs(flat, "sent_id").collect()}
    assert finite == {tuple(r) for r in con.execute("SELECT sid, i FROM got_word WHERE fin AND NOT skipped").fetchall() if r[0] in kept}
