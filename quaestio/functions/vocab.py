"""Per-language vocabularies used by the keyword flags and the token rules.

The tables are plain data. ``vocab_frame`` turns them into a
``(category, language, term)`` DataFrame; ``terms_by_language`` is what the
column builders use to produce per-language literals (they are small and fixed,
so they travel inside the plan as constants instead of being joined).
"""

from __future__ import annotations

LANGUAGES = ("dutch", "italian", "french", "english")

# ---------------------------------------------------------------------------
# FIXED VALUES — these word lists must equal the reference's vocabularies for
# the features and classifications to come out the same. Order as given there.
# Terms used for text search are regex fragments (not escaped).
# ---------------------------------------------------------------------------
disinfo_hashtags = {
    "english": ["hoax", "plandemic"],
    "french": ["hoax"],
    "italian": ["hoax"],
    "dutch": ["hoax", "plandemie"],
}

disinfo_keywords = disinfo_hashtags

pronouns_other = {
    "english": ["he", "him", "she", "her", "they", "them"],
    "french": ["tu", "toi", "il", "elle", "lui", "ils", "elles"],
    "italian": ["io", "tu", "lui", "lei"],
    "dutch": ["hij", "hem", "zij", "haar", "zij", "hen", "hun", "ze"],
}

pronouns_group = {
    "english": ["we", "you", "they", "people", "us"],
    "french": ["on", "nous", "vous"],
    "italian": ["voi", "noi", "loro"],
    "dutch": ["wij", "jullie", "zij", "ze", "men", "ons", "onze"],
}

conjunctions = {
    "english": ["and", "or"],
    "french": ["et", "ou"],
    "italian": ["e", "o", "oppure", "o forse"],
    "dutch": ["en", "of"],
}

levelers = {
    "english": ["everyone", "always", "everything", "never", "no one", "nobody", "nothing"],
    "french": ["tout le monde", "toujours", "tout", "jamais", "rien", "personne"],
    "italian": ["tutti", "sempre", "tutto", "mai", "nessuno", "niente"],
    "dutch": ["iedereen", "altijd", "alles", "nooit", "niemand", "niets", "niks"],
}

negations = {
    "english": ["not", "n't", "no"],
    "french": ["non", "pas"],
    "italian": ["no", "non"],
    "dutch": ["niet", "geen"],
}

wh_words = {
    "english": ["who", "what", "how", "why", "which", "when", "where"],
    "french": ["que", "quel", "qu'", "quoi", "qui", "quand", "comment", "combien", "pourquoi", "où", "ou",
               "pkoi", "qd", "quels", "quelles"],
    "italian": ["cosa", "chi", "come", "quanto", "perché"],
    "dutch": ["wie", "wat", "hoe", "hoezo", "waarom", "welke", "wanneer", "hoeveel", "waar", "hoezeer", "waaraan",
              "waartoe", "waarnaar", "waarnaartoe", "waarvan", "vanwaar"],
}

wh_words_only_embedded = {
    "english": ["if", "whether"],
    "french": ["si"],
    "italian": ["se"],
    "dutch": ["of"],
}

who_like = {
    "english": ["who"],
    "french": ["qui"],
    "italian": ["chi"],
    "dutch": ["wie"],
}

personal_existentials = {
    "english": ["anyone", "someone"],
    "french": ["quelqu'un", "quelqu'une"],
    "italian": ["qualcuna", "qualcuno", "chiunque"],
    "dutch": ["iemand"],
}

impersonals = {
    "english": ["one", "you", "people"],
    "french": ["il", "gens"],
    "italian": ["gente"],
    "dutch": ["men", "je", "mensen"],
}

neutral_pronouns = {
    "english": ["it", "that"],
    "french": ["le", "la", "ça", "l'", "ceux", "celui"],
    "italian": ["l'", "lo", "la"],
    "dutch": ["het", "dat", "dit"],
}

verbs_like_wonder = {
    "english": ["wonder", "question", "doubt", "unsure", "uncertain", "curious"],
    "french": ["questionner", "demander", "douter", "incertain", "curieux", "demande", "questionne"],
    "italian": ["chierdersi", "dubitare", "incerto", "incerta"],
    "dutch": ["af_vragen", "onzeker", "benieuwd", "nieuwsgierig"],
}

nouns_like_question = {
    "english": ["mystery", "question", "puzzle"],
    "french": ["mystère", "question", "casse-tête"],
    "italian": ["mistero", "domanda", "enigma"],
    "dutch": ["vraag", "mysterie", "raadsel"],
}

nouns_like_information = {
    "english": ["info", "information"],
    "french": [],
    "italian": [],
    "dutch": ["info", "informatie"],
}

verbs_like_ask = {
    "english": ["ask", "request"],
    "french": ["demander", "demande"],
    "italian": ["richiedere", "chiedere", "domandare"],
    "dutch": ["vragen"],
}

verbs_like_know = {
    "english": ["know", "say", "tell", "understand", "certain", "sure", "see", "remember", "imagine", "calculate"],
    "french": ["dire", "savoir", "comprendre", "certain", "voir"],
    "italian": ["sapere", "dire", "raccontare", "capire", "certo", "sicuro", "vedere"],
    "dutch": ["weten", "vertellen", "zeggen", "begrijpen", "kennen", "zeker", "zien", "inzien", "herinneren",
              "voor_stellen", "uitrekenen", "weet"],
}

verbs_like_see = {
    "english": ["notice", "see", "hear", "feel", "discover", "find_out", "read"],
    "french": ["remarquer", "voir", "entendre", "sentir", "découvrir", "trouver", "lire"],
    "italian": ["notare", "vedere", "sentire", "sentire", "scoprire", "leggere"],
    "dutch": ["merken", "zien", "horen", "voelen", "ontdekken", "opnemen", "lezen", "hoorde", "merkte"],
}

verbs_like_want = {
    "english": ["want", "like", "desire"],
    "french": ["vouloir", "veux", "désirer", "voudrais"],
    "italian": ["voler", "desiderare"],
    "dutch": ["willen", "wensen"],
}

some_other_embedders = {
    "english": ["crazy", "weird", "strange", "suspicious", "funny"],
    "french": ["bizarre", "étrange", "suspect", "suspecte"],
    "italian": ["strano", "sospettoso", "pazza", "strana", "sospettosa"],
    "dutch": ["gek", "raar", "vreemd", "verdacht", "grappig"],
}

perfect_auxiliaries = {
    "english": ["have"],
    "french": ["être", "avoir"],
    "italian": ["avere", "essere"],
    "dutch": ["hebben", "zijn"],
}

tag_questions = {
    "english": ["right"],
    "italian": ["vero", "giusto", "no", "eh"],
    "french": ["non", "n’est -ce pas", "n'est -ce pas"],
    "dutch": ["toch", "niet waar"],
}

own_complementizers = {
    "english": ["that", "to", "for"],
    "italian": [],
    "french": ["que", "à"],
    "dutch": ["dat", "om", "te"],
}

french_il_drop_verbs = ["faut", "veut"]
# --------------------------- end of fixed values ---------------------------

# Derived tables (concatenations, as the reference defines them).
wh_words_all = {lang: wh_words[lang] + wh_words_only_embedded[lang] for lang in wh_words}

all_embedders = {
    lang: (verbs_like_see[lang] + verbs_like_know[lang] + verbs_like_wonder[lang] + verbs_like_ask[lang]
           + nouns_like_question[lang] + nouns_like_information[lang] + some_other_embedders[lang])
    for lang in verbs_like_see
}

complementizers = {lang: own_complementizers[lang] + wh_words_all[lang] for lang in own_complementizers}

CATEGORIES = {
    "disinfo_hashtags": disinfo_hashtags,
    "disinfo_keywords": disinfo_keywords,
    "pronouns_other": pronouns_other,
    "pronouns_group": pronouns_group,
    "conjunctions": conjunctions,
    "levelers": levelers,
    "negations": negations,
    "wh_words": wh_words,
    "wh_words_only_embedded": wh_words_only_embedded,
    "wh_words_all": wh_words_all,
    "who_like": who_like,
    "personal_existentials": personal_existentials,
    "impersonals": impersonals,
    "neutral_pronouns": neutral_pronouns,
    "verbs_like_wonder": verbs_like_wonder,
    "nouns_like_question": nouns_like_question,
    "nouns_like_information": nouns_like_information,
    "verbs_like_ask": verbs_like_ask,
    "verbs_like_know": verbs_like_know,
    "verbs_like_see": verbs_like_see,
    "verbs_like_want": verbs_like_want,
    "some_other_embedders": some_other_embedders,
    "all_embedders": all_embedders,
    "perfect_auxiliaries": perfect_auxiliaries,
    "tag_questions": tag_questions,
    "complementizers": complementizers,
}


def terms_by_language(category: str) -> dict[str, list[str]]:
    """Return ``{language: [terms]}`` for a named category."""
    return CATEGORIES[category]


def vocab_rows():
    """Yield ``(category, language, position, term)`` for every table entry."""
    for cat, table in CATEGORIES.items():
        for lang, terms in table.items():
            for pos, term in enumerate(terms):
                yield cat, lang, pos, term
    for pos, term in enumerate(french_il_drop_verbs):
        yield "french_il_drop_verbs", "french", pos, term


def vocab_frame(spark):
    """The vocabulary as a small DataFrame ``(category, language, position, term)``."""
    return spark.createDataFrame(
        list(vocab_rows()), "category STRING, language STRING, position INT, term STRING")
