"""Sentence classification rules (L10-L28) as staged per-row expressions.

Order of stages follows the component order of the analysis: corrected lemma, question
mark, matrix subject and verb, inversion, tag question, question-word tags, question
class. Every stage is one ``withColumn`` over the token array, so Catalyst keeps the
plan flat; all work stays inside one narrow stage of the job.

The question-word tags need a left-to-right pass: two rules read the tags of earlier
tokens (L20's conjunction veto and L23's conjoined-fronting case). Everything that does
not depend on tags is precomputed per token; the final ``aggregate`` over the tokens
then only evaluates those two tag-dependent tests.
"""

from __future__ import annotations

import functools
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaestio.functions import text as T
from quaestio.functions import vocab
from quaestio.operators.tokens import (CCOMPLIKE_DEPS, MISPARSED_SUBJECT_DEPS, OBJECTLIKE_DEPS,
                                       SUBJECTLIKE_DEPS, VERBLIKE_POS, Tree, enrich_tokens,
                                       enrich_tokens_2, let, with_children)

NON_WORD = r"[^\p{L}\p{N}_]"
QTYPES = ("fronted", "insitu", "indirect", "no")
STRUCTURES = ("tag", "wh", "insitu", "risingdecl", "polar", "elliptic", "decl")
USES = ("direct", "indirect", "no")


# ----------------------------------------------------------------------------- L10, L11

def is_subject_of(tree: Tree, t: Column, v: Column) -> Column:
    """Is token ``t`` a subject of verb ``v``? (ten alternative patterns)."""
    h = tree.head(t)
    nxt = tree.tok(t["i"] + 1)
    same_head = (t["head"] == v["i"]) | (v["dep"].isin("aux", "aux:tense", "aux:pass") & (t["head"] == v["head"]))
    french = tree.lang == "french"
    fr_pron = ((t["pos"] == "PRON") & t["text"].startswith("-")) | (t["text"] == "ce")
    cond = (
        ((v["dep"] == "parataxis") & (t["i"] == v["i"] + 1) & t["dep"].isin(*SUBJECTLIKE_DEPS))
        | ((t["pos"] == "NOUN") & Tree.has_morph(t, "Number", "Plur") & (t["dep"] == "advmod")
           & (h["dep"] == "ROOT") & (t["i"] == h["i"] - 1) & Tree.has_morph(h, "Number", "Plur"))
        | (same_head & t["dep"].isin(*SUBJECTLIKE_DEPS))
        | (same_head & t["dep"].isin(*MISPARSED_SUBJECT_DEPS) & ~t["head_has_subj"])
        | ((v["dep"] == "cop") & (t["i"] == v["head"]) & (Tree.morph(v, "Number") == Tree.morph(t, "Number")))
        | ((v["dep"] == "cop") & (t["head"] == v["head"]) & t["dep"].isin(*SUBJECTLIKE_DEPS))
        | (french & fr_pron & (((t["i"] == v["i"] + 2) & F.coalesce(nxt["text"].startswith("-"), F.lit(False)))
                               | (t["i"] == v["i"] + 1)))
        | (french & (t["pos"] == "PRON") & (t["dep"] == "ROOT") & (v["dep"] == "dep") & (v["head"] == t["i"]))
        | (french & (v["i"] == 0) & (t["i"] == 1) & (t["pos"] == "PRON") & (v["head"] == t["head"]))
    )
    return F.coalesce(cond, F.lit(False))


def subject_candidates(tree: Tree, v: Column, plural_nouns: Column) -> Column:
    """Positions that can satisfy L10 for verb ``v``, ascending and distinct: every
    pattern ties the subject to ``v``'s children, its head's children, its head, the two
    following positions, position 1, or the verb-independent plural-noun pattern."""
    empty = F.array().cast("array<int>")
    cands = F.concat(F.coalesce(v["children"], empty), F.coalesce(tree.head(v)["children"], empty),
                     F.array(v["head"], v["i"] + 1, v["i"] + 2, F.lit(1)), plural_nouns)
    return F.array_sort(F.array_distinct(F.filter(cands, lambda ci: ci.isNotNull() & (ci >= 0) & (ci < tree.n))))


def subject_of(tree: Tree, v: Column, plural_nouns: Column) -> Column:
    """Position of the verb's subject (first match in sentence order, not
    PronType=Rel; French may take the second when it directly follows the verb and is
    ``ce`` or a hyphen pronoun). Only the structural candidates are tested."""
    def pick(m):
        second = F.get(m, 1)
        take_second = ((tree.lang == "french") & (second["i"] == v["i"] + 1)
                       & ((second["text"] == "ce") | ((second["pos"] == "PRON") & second["text"].startswith("-"))))
        return F.when(F.coalesce(take_second, F.lit(False)), second["i"]).otherwise(F.get(m, 0)["i"])
    toks = F.transform(subject_candidates(tree, v, plural_nouns), lambda ci: tree.tok(ci))
    return let(F.filter(toks, lambda t: is_subject_of(tree, t, v) & ~Tree.has_morph(t, "PronType", "Rel")), pick)


# ----------------------------------------------------------------------------- L12, L13

def finite_verbs(tree: Tree, lo: Column, hi: Column) -> Column:
    """L12 on the span [lo, hi): positions of finite verbs (a Dutch ``be…d`` ROOT verb is
    added as well, so a token can appear twice)."""
    dutch = tree.lang == "dutch"
    sel = F.filter(tree.toks, lambda t: (t["i"] >= lo) & (t["i"] < hi) & ~t["skipfv"])
    return F.flatten(F.transform(sel, lambda t: F.concat(
        F.when(t["fin"], F.array(t["i"])).otherwise(F.array().cast("array<int>")),
        F.when(dutch & (t["dep"] == "ROOT") & (t["pos"] == "VERB") & t["text"].startswith("be")
               & t["text"].endswith("d"), F.array(t["i"])).otherwise(F.array().cast("array<int>")))))


def matrix_subject_and_verb(tree: Tree, plural_nouns: Column | None = None) -> Column:
    """``struct<verb INT, subj INT>`` (NULLs when undetermined)."""
    if plural_nouns is None:
        plural_nouns = plural_noun_subjects(tree)
    toks, n = tree.toks, tree.n
    root = tree.root()
    commas = F.filter(toks, lambda t: (t["i"] >= 1) & (t["i"] <= n - 2) & (t["pos"] == "PUNCT") & (t["text"] == ","))
    sconj_start = (F.coalesce(tree.tok(F.lit(0))["pos"] == "SCONJ", F.lit(False))
                   | F.coalesce(tree.tok(F.lit(1))["pos"] == "SCONJ", F.lit(False)))
    first_comma = F.when(sconj_start, F.get(commas, 0)["i"])
    fv = let(first_comma, lambda fc: F.when(
        fc.isNotNull(), F.concat(finite_verbs(tree, fc, n), finite_verbs(tree, F.lit(0), fc)))
        .otherwise(finite_verbs(tree, F.lit(0), n)))

    def info(vi):
        v = tree.tok(vi)
        h = tree.head(v)
        para = ((v["dep"] == "parataxis") & (h["dep"] == "ROOT") & Tree.has_morph(h, "VerbForm", "Fin")
                & (h["i"] - v["i"] < 3))
        sub = v["dep"].isin(*CCOMPLIKE_DEPS) | (v["dep"].isin("aux", "aux:tense") & h["dep"].isin(*CCOMPLIKE_DEPS))
        marked = F.exists(tree.before(v["i"]), lambda m: (m["dep"] == "mark") & (m["pos"] == "SCONJ") & (
            (tree.tok(tree.head(m)["head"])["i"] == v["i"]) | ((v["head"] == m["head"]) & (v["i"] != m["head"]))))
        ok = ~F.coalesce(para, F.lit(False)) & ~F.coalesce(sub, F.lit(False)) & ~F.coalesce(marked, F.lit(False))
        no_cc = lambda x: ~F.coalesce(x["cc_child"], F.lit(False))
        override = ((v["dep"] == "conj") & no_cc(v)) | (F.coalesce(h["dep"] == "conj", F.lit(False)) & no_cc(h))
        drop = (tree.lang == "french") & F.lower(v["text"]).isin(*vocab.french_il_drop_verbs)
        return F.struct(vi.alias("v"), ok.alias("ok"), subject_of(tree, v, plural_nouns).alias("cs"),
                        F.coalesce(override, F.lit(False)).alias("override"),
                        F.coalesce(drop, F.lit(False)).alias("drop"))

    init = F.struct(F.lit(None).cast("int").alias("verb"), F.lit(None).cast("int").alias("subj"))

    def step(acc, x):
        take = x["ok"] & x["cs"].isNotNull() & (acc["verb"].isNull() | x["override"])
        nxt = F.when(take, F.struct(x["v"].alias("verb"), x["cs"].alias("subj"))).otherwise(acc)
        return F.when(x["ok"] & x["cs"].isNull() & x["drop"],
                      F.struct(x["v"].alias("verb"), nxt["subj"].alias("subj"))).otherwise(nxt)

    folded = F.aggregate(F.transform(fv, info), init, step)
    return F.when(F.coalesce(root["dep"] == "ROOT", F.lit(False)), folded).otherwise(init)


# ----------------------------------------------------------------------------- L14, L15

def inversion(tree: Tree, text: Column, verb: Column, subj: Column, spaced_est_ce: bool = False) -> Column:
    """Nullable subject-verb inversion. Clean-up writes ``est -ce`` (P7), which the literal
    test for ``est-ce`` does not meet (Q22); ``spaced_est_ce`` accepts both spellings."""
    begin = F.substring(F.lower(text), 1, 20)
    est = begin.contains("est-ce")
    if spaced_est_ce:
        est = est | begin.contains("est -ce")
    est = (tree.lang == "french") & est
    v = tree.tok(verb)
    s = tree.tok(subj)
    inv1 = (verb < subj) | F.coalesce(s["v_whlemma"], F.lit(False))
    adv = tree.any_child(v, lambda c: (c["i"] < verb) & (c["dep"] == "advmod"))
    inv2 = F.when(inv1 & (tree.lang == "dutch") & adv, F.lit(False)).otherwise(inv1)
    subord = F.exists(tree.before(verb), lambda m: (m["dep"] == "mark") & (m["pos"] == "SCONJ") & (m["head"] == verb))
    return (F.when(est, F.lit(True))
            .when(verb.isNull() | subj.isNull(), F.lit(None).cast("boolean"))
            .when(subord, F.lit(None).cast("boolean"))
            .otherwise(inv2))


def tag_question(tree: Tree, text: Column, ends_qm: Column, inv: Column) -> Column:
    """L15."""
    poss = F.transform(tree.toks, lambda t: t["pos"])
    english = (tree.lang == "english") & (
        (F.slice(poss, -4, 4) == F.array(*[F.lit(x) for x in ("AUX", "PART", "PRON", "PUNCT")]))
        | (F.slice(poss, -3, 3) == F.array(*[F.lit(x) for x in ("AUX", "PRON", "PUNCT")])))
    tags_map = F.create_map(*[x for lang in vocab.LANGUAGES for x in (
        F.lit(lang), F.array(*[F.lit(t) for t in vocab.tag_questions[lang]]))])

    def decide(stripped):
        ends_tag = F.exists(F.coalesce(F.element_at(tags_map, tree.lang), F.array().cast("array<string>")),
                            lambda tag: stripped.endswith(tag))
        return (F.when(english, F.lit(True))
                .when((tree.lang == "french") & stripped.endswith(" ou non"), ~F.coalesce(inv, F.lit(False)))
                .when(ends_qm & ends_tag, F.lit(True))
                .otherwise(F.lit(False)))
    return let(F.regexp_replace(text, f"^{NON_WORD}+|{NON_WORD}+$", ""), decide)


# ----------------------------------------------------------------------------- L17, L21, L22, L24

def not_a_question_word(tree: Tree, t: Column) -> Column:
    """L17 (sentence starts at position 0)."""
    low = F.lower(t["text"])
    nxt, prv, prv2 = tree.tok(t["i"] + 1), tree.tok(t["i"] - 1), tree.tok(t["i"] - 2)
    h = tree.head(t)
    dutch = ((t["i"] <= 1) & (low == "wat") & (tree.n > t["i"] + 1) & (F.lower(nxt["text"]) == "een")) \
        | (((t["pos"] == "DET") | (t["dep"] == "det")) & (t["i"] < tree.n - 1) & (nxt["pos"] == "NOUN")
           & Tree.has_morph(nxt, "Number", "Plur")) \
        | ((t["text"] == "waar") & (t["pos"] == "ADJ") & tree.any_child(t, lambda c: c["dep"] == "cop"))
    preceding = F.lower(T.py_strip(F.array_join(F.transform(tree.before(t["i"]),
                                                            lambda x: F.concat(x["text"], x["ws"])), "")))
    following = F.lower(T.py_strip(F.array_join(F.transform(F.slice(tree.toks, t["i"] + 1, tree.n),
                                                            lambda x: F.concat(x["text"], x["ws"])), "")))
    french = ((t["i"] > 2) & (F.lower(prv2["text"]) == "à") & (F.lower(prv["text"]) == "ce")) \
        | let(preceding, lambda p: p.endswith("est -ce") | p.endswith("est ce")) \
        | ((t["text"] == "ou") & (t["pos"] == "CCONJ") & (t["dep"] == "cc")) \
        | ((low == "que") & (h["dep"] == "dep") & ~tree.any_child(h, lambda c: c["pos"].isin(*VERBLIKE_POS))) \
        | let(following, lambda f: f.startswith("quand même") | f.startswith("quand bien même"))
    return F.coalesce(F.when(tree.lang == "dutch", dutch).when(tree.lang == "french", french).otherwise(False),
                      F.lit(False))


def might_not_be_complementizer(tree: Tree, t: Column) -> Column:
    """L21."""
    return F.coalesce(t["dep"].isin(*OBJECTLIKE_DEPS) & (tree.head(t)["dep"] != "ccomp"), F.lit(False))


def is_noun_like(tree: Tree, t: Column) -> Column:
    hh = tree.tok(tree.head(t)["head"])
    return (hh["pos"] == "NOUN") | ((hh["pos"] == "ADJ") & (hh["i"] > 1) & (tree.tok(hh["i"] - 1)["pos"] == "DET"))


def ordinary_relclause(tree: Tree, t: Column, root_i: Column) -> Column:
    """L22 (with is_noun_like)."""
    h = tree.head(t)
    hh = tree.tok(h["head"])
    prv = tree.tok(t["i"] - 1)
    nxt = tree.tok(t["i"] + 1)
    at_root = t["head"] == root_i
    cop_child = tree.any_child(h, lambda c: c["dep"] == "cop")
    obj_cop = tree.any_child(h, lambda c: (c["dep"] == "obj") & tree.any_child(c, lambda g: g["dep"] == "cop"))
    expr = (F.when(t["dep"] == "ROOT", False)
            .when((t["dep"] == "nsubj") & (h["dep"] == "ROOT"), False)
            .when(at_root & (cop_child | obj_cop), True)
            .when((t["dep"] == "advmod") & (h["dep"] == "acl:relcl") & (hh["pos"] == "NOUN"), True)
            .when(t["dep"].isin(*(SUBJECTLIKE_DEPS + OBJECTLIKE_DEPS)) & (h["dep"] == "acl:relcl")
                  & F.coalesce(is_noun_like(tree, t), F.lit(False)), True)
            .when(h["dep"].isin("csubj", "nsubj"), True)
            .when((h["dep"] == "acl:relcl") & (hh["pos"] == "NOUN") & (t["i"] - 1 == hh["i"]), True)
            .when((t["dep"] == "mark") & (h["dep"] == "advcl"), True)
            .when((t["dep"] == "mark") & (t["i"] > 0) & (prv["dep"] == "mark") & (t["head"] == prv["head"]), True)
            .when((tree.lang == "dutch") & (t["lemma"] == "wat") & (t["i"] < tree.n - 1) & (nxt["lemma"] == "er"), True)
            .otherwise(False))
    return F.coalesce(expr, F.lit(False))


def plural_noun_subjects(tree: Tree) -> Column:
    """Positions matching L10's verb-independent pattern (a plural NOUN ``advmod`` right
    before its plural ROOT head): such a token counts as a subject of every verb."""
    def hit(t):
        h = tree.head(t)
        return ((t["pos"] == "NOUN") & Tree.has_morph(t, "Number", "Plur") & (t["dep"] == "advmod")
                & (h["dep"] == "ROOT") & (t["i"] == h["i"] - 1) & Tree.has_morph(h, "Number", "Plur"))
    return F.transform(F.filter(tree.toks, lambda t: F.coalesce(hit(t), F.lit(False))), lambda t: t["i"])


def likely_indirect_head(tree: Tree, e: Column, is_question: Column, plural_nouns: Column) -> Column:
    """L24 for embedder ``e`` (``is_question`` = question mark and no tag question).

    Every L10 pattern ties the subject to ``e``'s children, its head's children, its
    head, the two following positions, position 1, or the verb-independent plural-noun
    pattern; only those candidates are tested, in one pass that collects all the
    subject facts the rule needs."""
    empty = F.array().cast("array<int>")
    h = tree.head(e)
    cands = F.concat(F.coalesce(e["children"], empty), F.coalesce(h["children"], empty),
                     F.array(e["head"], e["i"] + 1, e["i"] + 2, F.lit(1)), plural_nouns)
    init = F.struct(*[F.lit(False).alias(k) for k in ("any", "ex", "imp", "who", "spk", "adr")])

    def step(acc, ci):
        t = tree.tok(ci)
        hit = is_subject_of(tree, t, e)
        return F.struct(*[(acc[k] | (hit & F.coalesce(t[f], F.lit(False)) if f else acc[k] | hit)).alias(k)
                          for k, f in (("any", None), ("ex", "exist"), ("imp", "imp"), ("who", "who"),
                                       ("spk", "spk"), ("adr", "adr"))])
    return let(F.aggregate(cands, init, step), lambda subj: _indirect_head_decision(tree, e, is_question, subj))


def _indirect_head_decision(tree: Tree, e: Column, is_question: Column, subj: Column) -> Column:
    ex, imp, who, adr = subj["ex"], subj["imp"], subj["who"], subj["adr"]
    none = ~subj["any"]
    spk = subj["spk"] | none
    pres = F.coalesce(e["pres"], F.lit(False))
    q, nq = is_question, ~is_question
    know = e["v_know"] & (
        (q & pres & (who | adr | ex | imp)) | (nq & spk & e["negated"] & pres) | e["wanted"])
    see = e["v_see"] & q & ~pres & (who | adr | ex)
    wonder = e["v_wonder"] & (
        (nq & (spk | imp | none) & pres) | (q & (ex | imp | adr) & pres))
    noun_q = e["v_qnoun"] & nq & pres & ~Tree.has_morph(e, "Number", "Plur")
    noun_info = e["v_info"] & pres
    ask = e["v_ask"] & nq & (ex | spk | imp)
    sconj_before = tree.any_child(e, lambda c: (c["pos"] == "SCONJ") & (c["i"] < e["i"]))
    return F.coalesce((know | see | wonder | noun_q | noun_info | ask) & ~sconj_before, F.lit(False))


# ----------------------------------------------------------------------------- L19, L20, L23 (tag-free parts)

def embedder_precompute(tree: Tree, t: Column, root: Column) -> Column:
    """L19 parts that do not depend on tags: (a) the parataxis/nsubj shortcut, (b) the
    candidate from local patterns, (c) the first decisive ancestor of the upward walk."""
    h = tree.head(t)
    hh = tree.tok(h["head"])
    hhh = tree.tok(hh["head"])
    first_verb = F.get(F.filter(tree.before(t["i"]), lambda y: (y["pos"] == "VERB") & y["dep"].isin("nsubj", "parataxis")), 0)
    a = let(first_verb, lambda first: F.when(F.coalesce(first["emb"], F.lit(False)), first["i"]))
    objish = ["obj", "advcl"] + CCOMPLIKE_DEPS
    aux_emb = F.get(F.filter(tree.children(h), lambda c: c["dep"].isin("aux", "aux:tense") & c["emb"]), 0)
    b = (F.when((t["dep"] == "advmod") & (t["head"] == root["i"]) & root["emb"] & (root["i"] < t["i"]), root["i"])
         .when((h["dep"] == "acl:relcl") & h["verblike"] & (hh["dep"] == "obj") & hhh["emb"], hhh["i"])
         .when(h["dep"].isin(*objish) & h["verblike"] & hh["emb"], hh["i"])
         .when(t["dep"].isin(*objish) & h["emb"] & ~h["dep"].isin(*CCOMPLIKE_DEPS), h["i"])
         .when(F.lit("nummod").contains(t["dep"]) & hh["emb"] & (h["dep"] == "parataxis"), hh["i"])
         .when((h["dep"] == "ROOT") & ~h["emb"], aux_emb["i"]))

    path = F.slice(tree.path_to_root(t), 2, tree.n)
    init = F.struct(F.lit(False).alias("done"), F.lit(None).cast("string").alias("kind"),
                    F.lit(None).cast("int").alias("idx"))

    def step(acc, pi):
        x = tree.tok(pi)
        verb_case = (x["verblike"] & ~is_subject_of(tree, t, x) & x["emb"]
                     & ~((t["head"] == x["i"]) & (t["dep"] == "mark")) & ~x["dep"].isin(*CCOMPLIKE_DEPS))
        nouns = F.filter(tree.children(tree.head(x)), lambda c: c["dep"].isin(*OBJECTLIKE_DEPS)
                         & (c["pos"] == "NOUN") & c["emb"])
        obl_case = (x["dep"] == "obl") & (F.size(nouns) > 0)
        nmod_case = (x["dep"] == "nmod") & F.coalesce(tree.head(x)["emb"], F.lit(False))
        decided = (F.when(F.coalesce(verb_case, F.lit(False)),
                          F.struct(F.lit(True).alias("done"), F.lit("verb").alias("kind"), x["i"].alias("idx")))
                   .when(F.coalesce(obl_case, F.lit(False)),
                         F.struct(F.lit(True).alias("done"), F.lit("noun").alias("kind"), F.get(nouns, 0)["i"].alias("idx")))
                   .when(nmod_case,
                         F.struct(F.lit(True).alias("done"), F.lit("noun").alias("kind"), x["head"].alias("idx")))
                   .otherwise(acc))
        return F.when(acc["done"], acc).otherwise(decided)

    def assemble(pth):
        return let(F.aggregate(pth, init, step), lambda walk: F.struct(
            a.alias("a"), b.alias("b"), walk["kind"].alias("walk_kind"), walk["idx"].alias("walk_idx"),
            F.exists(pth, lambda pi: tree.tok(pi)["dep"] == "ccomp").alias("ccomp_above")))
    return let(path, assemble)


def fronted_precompute(tree: Tree, t: Column, mv: Column, ccomp_above: Column) -> Column:
    """L23 without tags: ``conj`` (the case that asks about earlier fronted words) and
    ``base`` (the answer otherwise)."""
    h = tree.head(t)
    hh = tree.tok(h["head"])
    v = tree.tok(mv)
    conj = ((h["dep"] == "conj") & ((hh["i"] == mv) | ((v["head"] == hh["i"]) & (mv != hh["i"])))
            & tree.any_child(h, lambda c: (c["pos"] == "CCONJ") & (c["dep"] == "cc") & (mv < c["i"]) & (c["i"] < t["i"])))
    base = (F.when(mv.isNotNull(), t["i"] < mv)
            .when(ccomp_above, False)
            .when((h["dep"] == "acl:relcl") & (hh["i"] < t["i"]) & hh["pos"].isin(*VERBLIKE_POS), False)
            .otherwise(True))
    return F.struct(F.coalesce(mv.isNotNull() & conj, F.lit(False)).alias("conj"),
                    F.coalesce(base, F.lit(False)).alias("base"))


# ----------------------------------------------------------------------------- L20 (+ tags), L25

def complementizer_rules(tree: Tree, x: Column, e: Column, earlier_hit: Column) -> Column:
    """L20 for token ``x`` and embedder ``e``; ``earlier_hit`` = some earlier token tagged
    ``indirect`` might itself be a complementizer of ``e`` (the recursive clause)."""
    r1 = tree.any_child(e, lambda c: c["v_neutral"] & c["dep"].isin(*OBJECTLIKE_DEPS) & (c["i"] != x["i"]))
    r2 = (x["dep"] == "mark") & (tree.tok(tree.head(x)["head"])["i"] == e["i"])
    r3 = tree.any_child(e, lambda c: tree.any_child(c, lambda g: (g["dep"] == "mark") & (g["i"] != x["i"])
                                                     & g["v_compl"]))
    r4 = tree.any_child(e, lambda c: (c["dep"] == "mark") & c["v_compl"] & (c["i"] != x["i"]))
    cc = (x["dep"] == "cc") & (x["pos"] == "CCONJ")
    return (F.when(r1, False).when(r2, True).when(r3, False).when(r4, False)
            .when(cc & earlier_hit, False)
            .when(cc & (tree.head(x)["dep"] == "conj"), False)
            .when((x["pos"] == "CCONJ") & (x["dep"] == "fixed"), False)
            .when((x["dep"] == "xcomp") & (x["i"] == 0), False)
            .when((x["dep"] == "advmod") & (x["i"] == 0) & (x["i"] == tree.head(x)["i"] - 1)
                  & tree.any_child(tree.head(x), lambda c: c["dep"].isin(*OBJECTLIKE_DEPS)), False)
            .otherwise(True))


def might_be_complementizer(tree: Tree, t: Column, e: Column, done: Column) -> Column:
    """L20 with the recursive clause resolved left to right over earlier tokens
    (``done`` = positions and tags of the question words before ``t``; other tokens have none)."""
    def hit_step(hit, d):
        return hit | ((d["qtype"] == "indirect") & F.coalesce(complementizer_rules(tree, tree.tok(d["i"]), e, hit), F.lit(False)))
    cc = (t["dep"] == "cc") & (t["pos"] == "CCONJ")
    earlier = F.when(cc, F.aggregate(done, F.lit(False), hit_step)).otherwise(F.lit(False))
    return F.coalesce(complementizer_rules(tree, t, e, earlier), F.lit(False))


def word_tag(tree: Tree, t: Column, done: Column, ends_qm: Column, exclamative: Column) -> Column:
    """L25 for question word ``t`` given positions and tags of those before it (``done``)."""
    pre = t["pre"]
    b_tok = tree.tok(pre["b"])
    w_tok = tree.tok(pre["walk_idx"])
    embedder_expr = (F.when(pre["a"].isNotNull(), pre["a"])
                     .when(pre["b"].isNotNull() & might_be_complementizer(tree, t, b_tok, done), pre["b"])
                     .when(pre["walk_kind"] == "verb",
                           F.when(might_be_complementizer(tree, t, w_tok, done), pre["walk_idx"]))
                     .when(pre["walk_kind"] == "noun", pre["walk_idx"]))
    can_direct = ends_qm & ~t["only_emb"]
    fronted = F.when(t["fr"]["conj"], F.exists(done, lambda x: x["qtype"] == "fronted")).otherwise(t["fr"]["base"])

    def decide(embedder):
        mnc = embedder.isNull() | t["mnc"]
        lih = F.coalesce(tree.tok(embedder)["lih"], F.lit(False))
        return (F.when(can_direct & fronted & ~t["relc"] & mnc, F.lit("fronted"))
                .when(embedder.isNotNull() & lih & ~exclamative, F.lit("indirect"))
                .when(can_direct & ~t["relc"] & mnc, F.lit("insitu"))
                .otherwise(F.lit("no")))
    return (F.when(~t["pqw"], F.lit(None).cast("string"))
            .when(t["notq"], F.lit("no"))
            .otherwise(let(embedder_expr, decide)))


# ----------------------------------------------------------------------------- the job

def classify_sentences(df: DataFrame, tokens_col: str = "tokens", text_col: str = "text",
                       language_col: str = "language", accept_upper_neg: bool = False,
                       spaced_est_ce: bool = False, results: list[str] | None = None) -> DataFrame:
    """L2-L27 over parsed sentences. Adds ``ends_with_question_mark, matrix_verb,
    matrix_subject, subj_verb_inversion, has_tag_question, structure, use,
    qwords_literal, qwords_functional`` and a ``qtype`` field on every token. With ``results`` only
    these of the added columns (``tokens_col`` for the tags among them) leave, and stages that none of
    them reads are pruned: the fence hides from Catalyst which results are read later."""
    try:
        app = df.sparkSession.sparkContext.applicationId
    except Exception:  # noqa: BLE001 - no SparkContext handle (Connect): build per call
        app = uuid.uuid4().hex
    out = df
    for name, column in _stage_columns(app, tokens_col, text_col, language_col, accept_upper_neg, spaced_est_ce):
        out = out.withColumn(name, column)
    out = out.drop("_facts", "_ctx", "_exclamative", "_matrix")
    return fence(out, [c for c in df.columns if c != tokens_col], [c for c in (tokens_col, *RESULT_COLUMNS) if results is None or c in results])


@functools.lru_cache(maxsize=16)
def _stage_columns(_app: str, tokens_col: str, text_col: str, language_col: str, accept_upper_neg: bool,
                   spaced_est_ce: bool) -> tuple[tuple[str, Column], ...]:
    """The staged column expressions, built once per application: constructing them
    issues many thousands of JVM calls, while the expressions themselves are plain,
    session-independent trees that can be reused by every query."""
    lang = F.col(language_col)
    text = F.col(text_col)
    tc = F.col(tokens_col)

    def tree():
        return Tree(F.col(tokens_col), lang, accept_upper_neg)

    steps = [(tokens_col, with_children(tc)), (tokens_col, enrich_tokens(tree()))]
    tr = tree()
    root = tr.root()
    sent_facts = F.struct(F.coalesce(Tree.has_morph(root, "Tense", "Pres"), F.lit(False)).alias("root_pres"),
                          F.exists(tc, lambda t: Tree.has_morph(t, "Tense", "Past")).alias("any_past"),
                          root["i"].alias("root_i"), plural_noun_subjects(tr).alias("plural_nouns"))
    steps += [
        ("_facts", sent_facts),
        (tokens_col, let(F.col("_facts"), lambda f: enrich_tokens_2(tree(), f["root_pres"], f["any_past"]))),
        ("ends_with_question_mark", T.ends_with_question_mark(text)),
        ("_exclamative", text.endswith("!")),
        ("_matrix", matrix_subject_and_verb(tree(), F.col("_facts.plural_nouns"))),
        ("matrix_verb", F.col("_matrix.verb")),
        ("matrix_subject", F.col("_matrix.subj")),
        ("subj_verb_inversion", inversion(tree(), text, F.col("matrix_verb"), F.col("matrix_subject"), spaced_est_ce)),
        ("has_tag_question", tag_question(tree(), text, F.col("ends_with_question_mark"),
                                          F.col("subj_verb_inversion"))),
    ]
    is_q = F.col("ends_with_question_mark") & ~F.col("has_tag_question")
    ctx = F.struct(F.col("_facts.root_i").alias("root_i"), is_q.alias("is_q"),
                   F.col("matrix_verb").alias("mv"), F.col("ends_with_question_mark").alias("qm"),
                   F.col("_exclamative").alias("excl"), F.exists(tc, lambda t: t["pqw"]).alias("has_qw"),
                   F.col("_facts.plural_nouns").alias("plural_nouns"))
    steps.append(("_ctx", ctx))

    def word_facts(c):
        # lih, notq, relc, mnc, pre and fr read other tokens' earlier-stage fields only
        # (and pre/fr this token's own), so one pass computes them all.
        trw = tree()

        def per_token(t):
            # Only what the fold and the output need travels on: every stage boundary
            # serialises the whole token array.
            pre = F.when(t["pqw"], embedder_precompute(trw, t, trw.tok(c["root_i"])))
            return let(pre, lambda p: F.struct(
                *[t[f].alias(f) for f in FOLD_FIELDS],
                # only read as the embedder of a question word: skip sentences without one
                F.when(c["has_qw"] & t["emb"], likely_indirect_head(trw, t, c["is_q"], c["plural_nouns"]))
                .otherwise(F.lit(False))
                .alias("lih"),
                F.when(t["pqw"], not_a_question_word(trw, t)).otherwise(F.lit(False)).alias("notq"),
                F.when(t["pqw"], ordinary_relclause(trw, t, c["root_i"])).otherwise(F.lit(False)).alias("relc"),
                might_not_be_complementizer(trw, t).alias("mnc"),
                p.alias("pre"),
                F.when(t["pqw"], fronted_precompute(trw, t, c["mv"], F.coalesce(p["ccomp_above"], F.lit(False))))
                .alias("fr")))
        return F.transform(tc, per_token)
    steps.append((tokens_col, let(F.col("_ctx"), word_facts)))

    def fold(c):
        tr6 = tree()
        # only question words get a tag: the fold runs over them alone, and appends to a short array
        init = F.array().cast("array<struct<i:int,qtype:string>>")
        tags = F.aggregate(F.filter(tc, lambda t: t["pqw"]), init, lambda done, t: F.array_append(
            done, F.struct(t["i"].alias("i"), word_tag(tr6, t, done, c["qm"], c["excl"]).alias("qtype"))))

        def slim(t, done):
            own = F.when(t["pqw"], F.get(F.filter(done, lambda d: d["i"] == t["i"]), 0)["qtype"])
            return F.struct(*[t[f].alias(f) for f in OUTPUT_FIELDS], own.alias("qtype"))
        return let(tags, lambda done: F.transform(tc, lambda t: slim(t, done)))
    steps.append((tokens_col, let(F.col("_ctx"), fold)))
    steps += list(question_columns(tokens_col))
    return tuple(steps)


# token fields kept after the word stage (read by the fold) and after the fold (output)
OUTPUT_FIELDS = ["i", "idx", "text", "ws", "lemma", "pos", "dep", "head", "morph", "clemma"]
FOLD_FIELDS = OUTPUT_FIELDS + ["children", "v_neutral", "v_compl", "pqw", "only_emb"]

RESULT_COLUMNS = ["ends_with_question_mark", "matrix_verb", "matrix_subject", "subj_verb_inversion",
                  "has_tag_question", "structure", "use", "qwords_literal", "qwords_functional"]


def fence(df: DataFrame, passthrough: list[str], results: list[str]) -> DataFrame:
    """Emit ``results`` through a one-row ``inline_outer`` generator.

    A filter on a derived column is normally pushed below the projections that define
    it by substituting their expressions; the staged token arrays are referenced many
    times per stage, so that substitution would grow the plan exponentially. Catalyst
    does not push predicates on generator outputs below a Generate (and infers no
    filter for an outer one), so filters on the results stay here, while filters on
    the pass-through columns still reach the scan. One row in, one row out.
    """
    packed = F.array(F.struct(*[F.col(c) for c in results]))
    return df.select(*passthrough, F.inline_outer(packed))


RESULT_TYPES = {"ends_with_question_mark": "boolean", "matrix_verb": "int", "matrix_subject": "int", "subj_verb_inversion": "boolean",
                "has_tag_question": "boolean", "structure": "string", "use": "string", "qwords_literal": "array<string>",
                "qwords_functional": "array<string>"}
#: What tagged lines and scores read of a token.
TAGGED_TYPE = "array<struct<i:int,idx:int,text:string,ws:string,qtype:string>>"


def classified(df: DataFrame, annotator, text_col: str = "text", language_col: str = "language", accept_upper_neg: bool = False,
               spaced_est_ce: bool = False, results: list[str] | None = None, remove_nonquestions: bool = False) -> DataFrame:
    """L0, G4 and :func:`classify_sentences`; ``results`` as there, None for all columns but the tokens. With
    ``remove_nonquestions`` rows of use ``no`` go (F3).

    A :class:`quaestio.operators.annotate.PythonAnnotator` parses in Python workers: the rules run there on the
    parse at hand (:mod:`quaestio.operators.sentence_rules`), which then neither travels nor is evaluated in whole.
    Tokens leave with the fields of TAGGED_TYPE. Any other annotator's parses are a column for the expressions."""
    from quaestio.operators import annotate
    wanted = [c for c in ("tokens", *RESULT_COLUMNS) if (c != "tokens" if results is None else c in results)]
    if not isinstance(annotator, annotate.PythonAnnotator):
        read = wanted if "use" in wanted or not remove_nonquestions else [*wanted, "use"]
        out = classify_sentences(annotator(df), "tokens", text_col, language_col, accept_upper_neg, spaced_est_ce, read)
        out = out.filter(F.col("use").isNull() | (F.col("use") != "no")) if remove_nonquestions else out
        return out.select(*df.columns, *wanted)
    from pyspark.sql import types as ST
    fields = {c: TAGGED_TYPE if c == "tokens" else RESULT_TYPES[c] for c in wanted}
    added = ST._parse_datatype_string(", ".join(f"{c} {kind}" for c, kind in fields.items()))
    work = _classified_batch(wanted, text_col, language_col, accept_upper_neg, spaced_est_ce, remove_nonquestions)
    return annotate.in_parsed_batches(df, annotator.provider_factory, ST.StructType([*df.schema.fields, *added.fields]), work)


def _classified_batch(wanted: list[str], text_col: str, language_col: str, accept_upper_neg: bool, spaced_est_ce: bool,
                      remove_nonquestions: bool):
    """A batch of texts -> their rows with the wanted results, in a Python worker."""
    def work(provider, batch):
        import pyarrow as pa

        from quaestio.operators import annotate, sentence_rules
        columns, languages, texts, parses = annotate.parsed_columns(provider, batch, text_col, language_col)
        found = [sentence_rules.classify(*x, accept_upper_neg, spaced_est_ce) for x in zip(languages, texts, parses)]
        out = pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))
        if remove_nonquestions:
            use = sentence_rules.FIELDS.index("use")
            kept = [f[use] != "no" for f in found]
            out = out.filter(pa.array(kept, pa.bool_()))
            found, parses = [f for f, k in zip(found, kept) if k], [p for p, k in zip(parses, kept) if k]
        arrays, names = list(out.columns), list(out.schema.names)
        by_name = dict(zip(sentence_rules.FIELDS, zip(*found) if found else [()] * len(sentence_rules.FIELDS)))
        types = {"boolean": pa.bool_(), "int": pa.int32(), "string": pa.string(), "array<string>": pa.list_(pa.string())}
        for c in wanted:
            arrays.append(_tagged_tokens(parses, by_name["tags"]) if c == "tokens" else pa.array(by_name[c], types[RESULT_TYPES[c]]))
        return pa.RecordBatch.from_arrays(arrays, names=[*names, *wanted])
    return work


def _tagged_tokens(parses: list, tags):
    """Token lists with their tags as one Arrow column of TAGGED_TYPE."""
    import numpy as np
    import pyarrow as pa
    flat = [t for own in parses if own is not None for t in own]
    ends = np.cumsum([0, *(len(own or ()) for own in parses)])
    qtypes: list = [None] * len(flat)
    for start, own in zip(ends, tags):
        for i, tag in own or ():
            qtypes[start + i] = tag
    fields = [(c, pa.array([t.get(c) for t in flat], kind)) for c, kind in (("i", pa.int32()), ("idx", pa.int32()), ("text", pa.string()), ("ws", pa.string()))]
    fields.append(("qtype", pa.array(qtypes, pa.string())))
    structs = pa.StructArray.from_arrays([a for _, a in fields], fields=[pa.field(c, a.type) for c, a in fields])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), structs, mask=pa.array([own is None for own in parses], pa.bool_()))


#: Languages with a vocabulary; questions in others get no class.
LANGUAGES = ("dutch", "english", "french", "italian")


def question_columns(tokens_col: str = "tokens", language_col: str = "language"):
    """L26 as (name, column) steps: structure, use, literal and functional question words.
    Structure and use are NULL without a parse or in a language without vocabulary (Q3)."""
    known = F.coalesce(F.col(tokens_col).isNotNull() & F.col(language_col).isin(*LANGUAGES), F.lit(False))
    tc = F.col(tokens_col)
    words = lambda tag: F.transform(F.filter(tc, lambda t: t["qtype"] == tag), lambda t: F.lower(t["text"]))
    fronted, insitu, indirect = words("fronted"), words("insitu"), words("indirect")
    literal = F.concat(fronted, insitu)
    inv = F.col("subj_verb_inversion")
    structure = (F.when(F.coalesce(F.col("has_tag_question"), F.lit(False)) & (F.size(literal) == 0), "tag")
                 .when(F.size(fronted) > 0, "wh")
                 .when(F.size(insitu) > 0, "insitu")
                 .when(F.col("ends_with_question_mark"),
                       F.when(inv.isNull(), "elliptic").when(inv, "polar").otherwise("risingdecl"))
                 .otherwise("decl"))
    structure = F.when(known, structure)
    use = (F.when(~known, F.lit(None).cast("string")).when(F.size(indirect) > 0, "indirect").when(F.col("structure") != "decl", "direct").otherwise("no"))
    return (("structure", structure), ("use", use), ("qwords_literal", literal),
            ("qwords_functional", F.when(F.size(indirect) > 0, indirect).otherwise(literal)))


def classify_question(df: DataFrame, tokens_col: str = "tokens", language_col: str = "language") -> DataFrame:
    """L26 on a frame whose tokens carry ``qtype``."""
    for name, column in question_columns(tokens_col, language_col):
        df = df.withColumn(name, column)
    return df


def is_rising_declarative(df: DataFrame) -> DataFrame:
    """Question mark and not inverted (NULL counts as not inverted)."""
    return df.withColumn("is_rising_declarative",
                         F.col("ends_with_question_mark") & ~F.coalesce(F.col("subj_verb_inversion"), F.lit(False)))
