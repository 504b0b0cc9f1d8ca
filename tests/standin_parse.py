"""Parses of the right shape without linguistic meaning, for tests of the annotator hook."""

from pyspark.sql import functions as F

# ----------------------------------------------------------------------------- stand-in parses
#
# No statistical parser ships with this repository. For runs over the driver tables the
# token rules get *stand-in* parses: tokens cut by a regular expression, sentences cut
# after terminator tokens, and part of speech, dependency label, head and morphology
# picked from hashes of the word. They have the D4 shape and a valid tree (every head
# points left towards the root, the root at itself), which is all the rules need to run;
# they carry no linguistic meaning, so results on them measure cost, not quality.

STANDIN_TOKEN = r"([\p{L}\p{N}_]+['’]?|-[\p{L}\p{N}_]+|[^\s\p{L}\p{N}_])(\s*)"
STANDIN_POS = ["NOUN", "VERB", "AUX", "PRON", "ADJ", "ADV", "DET", "ADP", "SCONJ", "CCONJ", "PROPN", "PART", "NOUN",
               "VERB"]
STANDIN_DEPS = ["nsubj", "obj", "advmod", "obl", "det", "amod", "mark", "cc", "conj", "ccomp", "acl:relcl", "xcomp",
                "aux", "cop", "parataxis", "nmod", "case", "compound:prt", "iobj", "advcl", "expl", "nummod", "fixed",
                "dep"]


def _pick(options: list[str], h: F.Column) -> F.Column:
    arr = F.array(*[F.lit(o) for o in options])
    return F.get(arr, F.pmod(h, F.lit(len(options))).cast("int"))


def standin_parse_single(text: F.Column, language: F.Column) -> F.Column:
    """Single-sentence mode: the whole text is one sentence."""
    return standin_parse(text, language, single_sentence=True)


def standin_parse(text: F.Column, language: F.Column, single_sentence: bool = False) -> F.Column:
    """``array<array<token>>`` for ``text`` (see the note above)."""
    from quaestio.operators.tokens import let
    words = F.regexp_extract_all(text, F.lit(STANDIN_TOKEN), F.lit(1))
    spaces = F.regexp_extract_all(text, F.lit(STANDIN_TOKEN), F.lit(2))
    lead = F.length(F.regexp_extract(text, r"^\s*", 0))
    term = r"^[.!?…]+$"
    flat_type = "array<struct<sent:int,text:string,ws:string,idx:int>>"

    def cut(ws):
        w, sp = ws["w"], ws["s"]
        n = F.size(w)

        def step(acc, k):
            word = F.get(w, k)
            tok = F.struct(acc["sent"].alias("sent"), word.alias("text"), F.get(sp, k).alias("ws"),
                           acc["pos"].alias("idx"))
            ends = word.rlike(term) & (k < n - 1) & ~F.coalesce(F.get(w, k + 1).rlike(term), F.lit(False))
            if single_sentence:
                ends = F.lit(False)
            return F.struct(F.array_append(acc["out"], tok).alias("out"),
                            (acc["pos"] + F.length(word) + F.length(F.get(sp, k))).alias("pos"),
                            (acc["sent"] + F.when(ends, 1).otherwise(0)).alias("sent"))
        init = F.struct(F.array().cast(flat_type).alias("out"), lead.alias("pos"), F.lit(0).alias("sent"))
        return F.aggregate(F.sequence(F.lit(0), n - 1), init, step, lambda acc: acc["out"])

    def group(flat):
        n_sents = F.coalesce(F.try_element_at(flat, F.lit(-1))["sent"], F.lit(-1)) + 1
        sents = F.transform(F.sequence(F.lit(0), n_sents - 1), lambda s: F.filter(flat, lambda t: t["sent"] == s))
        return F.transform(F.filter(sents, lambda s: F.size(s) > 0), _standin_tree)

    flat = F.when(F.size(words) > 0, let(F.struct(words.alias("w"), spaces.alias("s")), cut)) \
        .otherwise(F.array().cast(flat_type))
    return let(flat, group)


def _standin_tree(sent: F.Column) -> F.Column:
    from quaestio.operators.tokens import let

    def base(t, k):
        low = F.lower(t["text"])
        punct = t["text"].rlike(r"^[^\p{L}\p{N}_]$")
        h = F.xxhash64(low)
        pos = F.when(punct, F.lit("PUNCT")).otherwise(_pick(STANDIN_POS, h))
        return F.struct(k.alias("i"), t["idx"].alias("idx"), t["text"].alias("text"), t["ws"].alias("ws"),
                        low.alias("lemma"), pos.alias("pos"), F.xxhash64(low, F.lit("d")).alias("hd"),
                        F.xxhash64(low, F.lit("m")).alias("hm"))

    def finish(t, root):
        is_root = t["i"] == root
        head = (F.when(is_root, t["i"]).when(t["i"] < root, root)
                .when(F.pmod(t["hd"], F.lit(3)) == 0, t["i"] - 1).otherwise(root))
        dep = (F.when(is_root, F.lit("ROOT")).when(t["pos"] == "PUNCT", F.lit("punct"))
               .otherwise(_pick(STANDIN_DEPS, t["hd"])))
        hm = t["hm"]
        verbal = F.create_map(F.lit("VerbForm"), F.array(_pick(["Fin", "Fin", "Inf"], hm)),
                              F.lit("Tense"), F.array(_pick(["Pres", "Past"], F.shiftright(hm, 3))))
        pron = F.create_map(F.lit("Person"), F.array(_pick(["1", "2", "3"], hm)),
                            F.lit("Number"), F.array(_pick(["Sing", "Plur"], F.shiftright(hm, 3))))
        nominal = F.create_map(F.lit("Number"), F.array(_pick(["Sing", "Plur"], hm)))
        morph = (F.when(t["pos"].isin("VERB", "AUX"), verbal).when(t["pos"] == "PRON", pron)
                 .when(t["pos"] == "NOUN", nominal)
                 .otherwise(F.create_map().cast("map<string,array<string>>")))
        return F.struct(t["i"].cast("int").alias("i"), t["idx"].cast("int").alias("idx"), t["text"].alias("text"),
                        t["ws"].alias("ws"), t["lemma"].alias("lemma"), t["pos"].alias("pos"), dep.alias("dep"),
                        head.cast("int").alias("head"), morph.alias("morph"))

    def with_root(toks):
        root = F.coalesce(F.get(F.filter(toks, lambda t: t["pos"].isin("VERB", "AUX")), 0)["i"], F.lit(0))
        return let(root, lambda r: F.transform(toks, lambda t: finish(t, r)))

    return let(F.transform(sent, base), with_root)
