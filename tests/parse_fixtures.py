"""Hand-written parses (D4) for rule tests: ``(text, lemma, pos, dep, head, morph)``."""

from pyspark.sql import types as ST

from quaestio.operators.tokens import TOKENS_TYPE

SENT_SCHEMA = ST.StructType([
    ST.StructField("sent_id", ST.StringType()),
    ST.StructField("language", ST.StringType()),
    ST.StructField("text", ST.StringType()),
    ST.StructField("tokens", TOKENS_TYPE),
])


def morph(m):
    out = {}
    for kv in filter(None, (m or "").split("|")):
        k, v = kv.split("=")
        out[k] = v.split(",")
    return out


def tokens(text, spec):
    pos_in_text = 0
    out = []
    for i, row in enumerate(spec):
        word, lemma, pos, dep, head = row[:5]
        m = row[5] if len(row) > 5 else ""
        start = text.index(word, pos_in_text)
        end = start + len(word)
        j = end
        while j < len(text) and text[j] == " ":
            j += 1
        out.append((i, start, word, text[end:j], lemma, pos, dep, head, morph(m)))
        pos_in_text = end
    return out


# English ------------------------------------------------------------------
DO_THEY_KNOW = ("Do they know why?", [
    ("Do", "do", "AUX", "aux", 2, "VerbForm=Fin|Tense=Pres"),
    ("they", "they", "PRON", "nsubj", 2, "Person=3|Number=Plur"),
    ("know", "know", "VERB", "ROOT", 2, "VerbForm=Inf"),
    ("why", "why", "SCONJ", "advmod", 2),
    ("?", "?", "PUNCT", "punct", 2)])

WHAT_DO_YOU_WANT = ("What do you want?", [
    ("What", "what", "PRON", "obj", 3),
    ("do", "do", "AUX", "aux", 3, "VerbForm=Fin|Tense=Pres"),
    ("you", "you", "PRON", "nsubj", 3, "Person=2"),
    ("want", "want", "VERB", "ROOT", 3, "VerbForm=Inf"),
    ("?", "?", "PUNCT", "punct", 3)])

I_WONDER_WHY = ("I wonder why he left.", [
    ("I", "I", "PRON", "nsubj", 1, "Person=1|Number=Sing"),
    ("wonder", "wonder", "VERB", "ROOT", 1, "VerbForm=Fin|Tense=Pres"),
    ("why", "why", "SCONJ", "advmod", 4),
    ("he", "he", "PRON", "nsubj", 4, "Person=3"),
    ("left", "leave", "VERB", "ccomp", 1, "VerbForm=Fin|Tense=Past"),
    (".", ".", "PUNCT", "punct", 1)])

YOU_CAME_DIDNT_YOU = ("You came, didn't you?", [
    ("You", "you", "PRON", "nsubj", 1, "Person=2"),
    ("came", "come", "VERB", "ROOT", 1, "VerbForm=Fin|Tense=Past"),
    (",", ",", "PUNCT", "punct", 1),
    ("did", "do", "AUX", "parataxis", 1, "VerbForm=Fin|Tense=Past"),
    ("n't", "not", "PART", "neg", 3),
    ("you", "you", "PRON", "nsubj", 3, "Person=2"),
    ("?", "?", "PUNCT", "punct", 1)])

TOMORROW = ("Tomorrow?", [
    ("Tomorrow", "tomorrow", "NOUN", "ROOT", 0, "Number=Sing"),
    ("?", "?", "PUNCT", "punct", 0)])

YOU_ARE_COMING = ("You are coming?", [
    ("You", "you", "PRON", "nsubj", 2, "Person=2"),
    ("are", "be", "AUX", "aux", 2, "VerbForm=Fin|Tense=Pres"),
    ("coming", "come", "VERB", "ROOT", 2, "VerbForm=Part|Aspect=Prog"),
    ("?", "?", "PUNCT", "punct", 2)])

# Dutch --------------------------------------------------------------------
WAT_EEN_ROMMEL = ("Wat een rommel is dat!", [
    ("Wat", "wat", "DET", "det", 2),
    ("een", "een", "DET", "det", 2),
    ("rommel", "rommel", "NOUN", "nsubj", 4, "Number=Sing"),
    ("is", "zijn", "AUX", "cop", 4, "VerbForm=Fin|Tense=Pres"),
    ("dat", "dat", "PRON", "ROOT", 4),
    ("!", "!", "PUNCT", "punct", 4)])

IK_VRAAG_ME_AF = ("Ik vraag me af wie er komt.", [
    ("Ik", "ik", "PRON", "nsubj", 1, "Person=1|Number=Sing"),
    ("vraag", "vragen", "VERB", "ROOT", 1, "VerbForm=Fin|Tense=Pres"),
    ("me", "me", "PRON", "obj", 1, "Person=1"),
    ("af", "af", "ADP", "compound:prt", 1),
    ("wie", "wie", "PRON", "nsubj", 6),
    ("er", "er", "ADV", "advmod", 6),
    ("komt", "komen", "VERB", "ccomp", 1, "VerbForm=Fin|Tense=Pres"),
    (".", ".", "PUNCT", "punct", 1)])

# French -------------------------------------------------------------------
EST_CE_QUE = ("Est-ce que tu viens ?", [
    ("Est", "être", "AUX", "aux", 4, "VerbForm=Fin|Tense=Pres"),
    ("-ce", "ce", "PRON", "expl", 0),
    ("que", "que", "SCONJ", "mark", 4),
    ("tu", "tu", "PRON", "nsubj", 4, "Person=2"),
    ("viens", "venir", "VERB", "ROOT", 4, "VerbForm=Fin|Tense=Pres"),
    ("?", "?", "PUNCT", "punct", 4)])

SUCRE_OU_CITRON = ("Vous le prenez sucre ou citron ?", [
    ("Vous", "vous", "PRON", "nsubj", 2, "Person=2"),
    ("le", "le", "PRON", "obj", 2),
    ("prenez", "prendre", "VERB", "ROOT", 2, "VerbForm=Fin|Tense=Pres"),
    ("sucre", "sucre", "NOUN", "obj", 2),
    ("ou", "ou", "CCONJ", "cc", 5),
    ("citron", "citron", "NOUN", "conj", 3),
    ("?", "?", "PUNCT", "punct", 2)])


def frame(spark, rows):
    """rows: (sent_id, language, (text, spec))."""
    data = [(sid, lang, text, tokens(text, spec)) for sid, lang, (text, spec) in rows]
    return spark.createDataFrame(data, SENT_SCHEMA)
