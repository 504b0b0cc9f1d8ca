"""Dependency-tree helpers over a sentence's token array.

A parsed sentence is one row; ``tokens`` is ``array<struct<i, idx, text, ws, lemma,
pos, dep, head, morph>>`` with ``i`` = array position and the root pointing at itself.
Tree navigation is array indexing (``get`` returns NULL out of range) and
``filter``/``exists`` over the same array, so every rule is a per-row Catalyst
expression: no explode, no join, no shuffle. :class:`Tree` builds those expressions.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from quaestio.functions import vocab

MORPH_TYPE = ST.MapType(ST.StringType(), ST.ArrayType(ST.StringType()))
TOKEN_TYPE = ST.StructType([
    ST.StructField("i", ST.IntegerType()),
    ST.StructField("idx", ST.IntegerType()),
    ST.StructField("text", ST.StringType()),
    ST.StructField("ws", ST.StringType()),
    ST.StructField("lemma", ST.StringType()),
    ST.StructField("pos", ST.StringType()),
    ST.StructField("dep", ST.StringType()),
    ST.StructField("head", ST.IntegerType()),
    ST.StructField("morph", MORPH_TYPE),
])
TOKENS_TYPE = ST.ArrayType(TOKEN_TYPE)

# Tag groups of the rules (FIXED VALUES, as the reference defines them).
VERBLIKE_POS = ["AUX", "VERB"]
OBJECTLIKE_DEPS = ["dobj", "obj", "iobj", "obl", "obl:agent", "obl:arg"]
SUBJECTLIKE_DEPS = ["nsubj", "nsubjpass", "nsubj:pass", "csubj", "csubjpass", "expl", "expl:subj"]
MISPARSED_SUBJECT_DEPS = ["nmod:poss", "obj"]
CCOMPLIKE_DEPS = ["acl:relcl", "ccomp"]


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once per row and hand it to ``body`` as a lambda variable.

    Catalyst inlines a column referenced once into its consumer, also into a lambda body,
    where it would be re-evaluated for every array element; a one-element ``transform``
    binds it instead.
    """
    return F.get(F.transform(F.array(value), body), 0)


def morph_text_to_map(c: Column) -> Column:
    """Compact ``Number=Sing|Person=2`` text -> ``map<string, array<string>>``."""
    return F.when(c.isNull() | (c == ""), F.create_map().cast(MORPH_TYPE)).otherwise(
        F.transform_values(F.str_to_map(c, F.lit("\\|"), F.lit("=")), lambda k, v: F.split(v, ",")))


@functools.lru_cache(maxsize=None)
def _vocab_keys(categories: tuple[str, ...]) -> tuple[str, ...]:
    """``language + U+0001 + term`` of every term in any of the categories."""
    return tuple(dict.fromkeys(f"{lang}\u0001{t}" for c in categories for lang, ts in vocab.terms_by_language(c).items()
                               if lang in vocab.LANGUAGES for t in ts))


class Tree:
    """Expression builder for one sentence: ``toks`` (token array column) and ``lang``."""

    def __init__(self, toks: Column, lang: Column, accept_upper_neg: bool = False):
        self.toks = toks
        self.lang = lang
        self.n = F.size(toks)
        self.accept_upper_neg = accept_upper_neg

    # -- navigation ---------------------------------------------------------
    def tok(self, i: Column) -> Column:
        return F.get(self.toks, i)

    def head(self, t: Column) -> Column:
        return self.tok(t["head"])

    def is_child(self, c: Column, t: Column) -> Column:
        return (c["head"] == t["i"]) & (c["i"] != t["i"])

    def children(self, t: Column) -> Column:
        """Child tokens, from the ``children`` positions added by :func:`with_children`."""
        return F.transform(t["children"], lambda ci: self.tok(ci))

    def any_child(self, t: Column, pred) -> Column:
        return F.coalesce(F.exists(t["children"], lambda ci: pred(self.tok(ci))), F.lit(False))

    def all_children(self, t: Column, pred) -> Column:
        return F.coalesce(F.forall(t["children"], lambda ci: pred(self.tok(ci))), F.lit(True))

    def root(self) -> Column:
        return F.get(F.filter(self.toks, lambda c: c["head"] == c["i"]), 0)

    def before(self, i: Column) -> Column:
        """Tokens with position < i (``sentence[:i]``)."""
        return F.slice(self.toks, 1, F.greatest(i, F.lit(0)))

    # -- vocabulary and morphology -------------------------------------------
    def in_vocab(self, value: Column, category: str) -> Column:
        return self.key_in(self.vocab_key(value), category)

    def vocab_key(self, value: Column) -> Column:
        return F.concat(self.lang, F.lit("\u0001"), value)

    @staticmethod
    def key_in(key: Column, *categories: str) -> Column:
        """Is the key (:meth:`vocab_key`) one of the categories' terms? One hash lookup."""
        keys = _vocab_keys(categories)
        return F.coalesce(key.isin(*keys), F.lit(False)) if keys else F.lit(False)

    @staticmethod
    def morph(t: Column, key: str) -> Column:
        return F.coalesce(t["morph"][key], F.array().cast("array<string>"))

    @staticmethod
    def has_morph(t: Column, key: str, value: str) -> Column:
        return F.coalesce(F.array_contains(t["morph"][key], value), F.lit(False))

    # -- L1 -----------------------------------------------------------------
    def path_to_root(self, t: Column) -> Column:
        """L1: positions from ``t`` up to the root, both included (bounded by n steps)."""
        def step(acc, _x):
            last = F.try_element_at(acc, F.lit(-1))
            h = self.tok(last)["head"]
            return F.when(h.isNull() | (h == last), acc).otherwise(F.array_append(acc, h))
        return F.aggregate(F.sequence(F.lit(1), F.greatest(self.n, F.lit(1))), F.array(t["i"]), step)

    # -- per-token predicates on raw fields (L3-L6, L2) ------------------------
    def corrected_lemma(self, t: Column) -> Column:
        """L2."""
        lemma = F.lower(t["lemma"])
        prts = F.filter(self.children(t), lambda c: c["dep"] == "compound:prt")
        l1 = F.when(lemma.isin("vragen", "vraag") & (F.size(prts) > 0),
                    F.concat(F.get(prts, 0)["lemma"], F.lit("_"), lemma)).otherwise(lemma)
        l2 = F.when(l1 == "merkken", F.lit("merken")).otherwise(l1)
        has_af = F.exists(prts, lambda c: c["lemma"] == "af")
        return F.when(l2.startswith("af_") & ~has_af, F.get(F.split(l2, "_"), 1)).otherwise(l2)

    @staticmethod
    def is_verblike(t: Column) -> Column:
        """L3."""
        return t["pos"].isin("VERB", "AUX", "ADJ")

    def is_negation(self, t: Column) -> Column:
        """L6 (token): dep ``neg``, Polarity contains ``neg`` (Q8: literal lower case unless
        ``accept_upper_neg``), or a negation lemma."""
        pol = self.has_morph(t, "Polarity", "neg")
        if self.accept_upper_neg:
            pol = pol | self.has_morph(t, "Polarity", "Neg")
        return (t["dep"] == "neg") | pol | self.in_vocab(t["lemma"], "negations")


def with_children(toks: Column) -> Column:
    """Stage 0: each token gets the positions of its children, ascending.

    The (head, position) pairs are sorted with the built-in ordering, so each head's
    children form one run; a map from head to (run start, run length) then gives every
    token its children as a slice. That is O(n log n) comparisons and O(n) lambda calls
    per sentence instead of testing every pair of tokens."""
    pair_type = "array<struct<h:int,i:int>>"

    def by_runs(pairs):
        n = F.size(pairs)
        starts = F.filter(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))),
                          lambda k: (k < n) & ((k == 0) | (F.get(pairs, k)["h"] != F.get(pairs, k - 1)["h"])))

        def index(st):
            runs = F.transform(st, lambda k, j: F.struct(
                F.get(pairs, k)["h"].alias("key"),
                F.struct(k.alias("start"), (F.coalesce(F.get(st, j + 1), n) - k).alias("len")).alias("value")))
            return F.map_from_entries(runs)

        def attach(idx):
            def one(t):
                run = F.try_element_at(idx, t["i"])
                kids = F.when(run.isNull(), F.array().cast("array<int>")).otherwise(F.transform(
                    F.slice(pairs, run["start"] + 1, run["len"]), lambda p: p["i"]))
                return t.withField("children", F.filter(kids, lambda c: c != t["i"]))
            return F.transform(toks, one)
        return let(let(starts, index), attach)

    pairs = F.array_sort(F.filter(F.transform(toks, lambda t: F.struct(t["head"].alias("h"), t["i"].alias("i"))),
                                  lambda p: p["h"].isNotNull()).cast(pair_type))
    return let(pairs, by_runs)


LEMMA_CATEGORIES = {  # field -> vocabulary, tested on the raw lemma
    "exist": "personal_existentials", "imp": "impersonals", "who": "who_like", "v_neg": "negations",
    "v_perf": "perfect_auxiliaries", "v_neutral": "neutral_pronouns", "v_compl": "complementizers",
    "v_whlemma": "wh_words_all"}
CLEMMA_CATEGORIES = {  # field -> vocabulary, tested on the corrected lemma
    "v_emb": "all_embedders", "v_want": "verbs_like_want", "v_know": "verbs_like_know", "v_see": "verbs_like_see",
    "v_wonder": "verbs_like_wonder", "v_qnoun": "nouns_like_question", "v_info": "nouns_like_information",
    "v_ask": "verbs_like_ask"}


def enrich_tokens(tree: Tree) -> Column:
    """Stage 1: per-token facts from the token's own fields and its children's raw
    fields (L2-L6, L16, L18, vocabulary memberships, finite-verb flags). Vocabulary
    tests happen here once, so later rules read booleans instead of term lists."""
    def f(t):
        def with_keys(k):
            # few words are in any list: one lookup of all lists settles the others
            out = t.withField("clemma", k["cl"])
            for name, cat in LEMMA_CATEGORIES.items():
                out = out.withField(name, k["in_l"] & tree.key_in(k["l"], cat))
            for name, cat in CLEMMA_CATEGORIES.items():
                out = out.withField(name, k["in_c"] & tree.key_in(k["c"], cat))
            pol = Tree.has_morph(t, "Polarity", "neg")
            if tree.accept_upper_neg:
                pol = pol | Tree.has_morph(t, "Polarity", "Neg")
            return (out.withField("verblike", Tree.is_verblike(t))
                    .withField("neg", (t["dep"] == "neg") | pol | (k["in_l"] & tree.key_in(k["l"], "negations")))
                    .withField("adr", Tree.has_morph(t, "Person", "2"))
                    .withField("spk", Tree.has_morph(t, "Person", "1"))
                    .withField("fin", t["pos"].isin(*VERBLIKE_POS) & Tree.has_morph(t, "VerbForm", "Fin"))
                    .withField("pqw", tree.key_in(k["w"], "wh_words_all"))
                    .withField("only_emb", tree.key_in(k["w"], "wh_words_only_embedded"))
                    .withField("subj_child", tree.any_child(t, lambda c: c["dep"].isin(*SUBJECTLIKE_DEPS)))
                    .withField("cc_child", tree.any_child(t, lambda c: c["dep"] == "cc")))

        def keys(cl):
            lemma, clemma = tree.vocab_key(t["lemma"]), tree.vocab_key(cl)
            return F.struct(cl.alias("cl"), lemma.alias("l"), clemma.alias("c"), tree.vocab_key(F.lower(t["text"])).alias("w"),
                            tree.key_in(lemma, *LEMMA_CATEGORIES.values()).alias("in_l"),
                            tree.key_in(clemma, *CLEMMA_CATEGORIES.values()).alias("in_c"))
        return let(tree.corrected_lemma(t), lambda cl: let(keys(cl), with_keys))
    return F.transform(tree.toks, f)


def enrich_tokens_2(tree: Tree, root_pres: Column, any_past: Column) -> Column:
    """Stage 2: facts that read stage-1 fields of other tokens (L6-L9, L12 skip)."""
    def aux_children_pres(t):
        return tree.all_children(t, lambda c: (c["pos"] != "AUX") | Tree.has_morph(c, "Tense", "Pres"))

    def present(t):
        inf = Tree.has_morph(t, "VerbForm", "Inf")
        perfect_aux = tree.any_child(t, lambda c: (c["pos"] == "AUX") & c["v_perf"])
        return (F.when(Tree.has_morph(t, "VerbForm", "Fin") & Tree.has_morph(t, "Tense", "Pres"), True)
                .when(inf & perfect_aux, False)
                .when(inf & aux_children_pres(t), True)
                .when(t["pos"].isin("ADJ", "PROPN") & aux_children_pres(t), True)
                .when(Tree.has_morph(t, "Aspect", "Prog") & aux_children_pres(t), True)
                .when(root_pres | ~any_past, True)
                .otherwise(False))

    def f(t):
        h = tree.head(t)
        emb = t["v_emb"] | tree.any_child(t, lambda c: c["dep"] == "ccomp")
        wanted = ((t["dep"] == "xcomp") & (h["dep"] == "ROOT") & Tree.has_morph(h, "VerbForm", "Inf")
                  & h["v_want"]) | tree.any_child(t, lambda c: c["v_want"])
        skip = tree.any_child(t, lambda c: c["pos"].isin(*VERBLIKE_POS) & c["dep"].isin("aux", "cop")
                              & Tree.has_morph(c, "VerbForm", "Fin") & (c["i"] < t["i"]))
        return (t.withField("emb", emb)
                .withField("head_has_subj", F.coalesce(h["subj_child"], F.lit(False)))
                .withField("negated", tree.any_child(t, lambda c: c["neg"]))
                .withField("wanted", F.coalesce(wanted, F.lit(False)))
                .withField("skipfv", skip)
                .withField("pres", F.when(emb, present(t)).otherwise(F.lit(None).cast("boolean"))))
    return F.transform(tree.toks, f)
