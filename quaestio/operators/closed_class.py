"""A shallow parser by closed-class words: the annotator that ships with the library.

It knows function words (pronouns, auxiliaries, determiners, prepositions, conjunctions,
negations, question words) and the embedding words of :mod:`quaestio.functions.vocab`, and
attaches every word by position: verbs to the verb before them, subjects and auxiliaries
to the verb after them, objects to the verb before them. It is no replacement for a
statistical parser, but its parses are of the text: the same words always get the same
analysis, every token has a head, and every path of heads ends at the root. Use it through
:func:`quaestio.operators.annotate.annotate_with_python`, one call per batch and language.

``LEXICON_ROWS`` is data that the DuckDB twin reads as well; the attachment rules are written
out a second time there (:mod:`quaestio.plans.parse_oracle`).
"""

from __future__ import annotations

import functools
import re

from quaestio.functions import vocab
from quaestio.operators.annotate import ParseProvider

WS = "\\t\\n\\x0b\\f\\r\\x1c-\\x1f\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000 "
#: A token: a word (with a hyphen before it and an apostrophe behind it), or any other
#: character that is not white space.
TOKEN = re.compile(f"(-?\\w+['’]?|[^\\w{WS}])([{WS}]*)")
TERMINATORS = ".!?…"

#: form: (lemma, part of speech, morphology), by language.
_FORMS = {
    "english": {
        "PRON": "i=i:Person=1 me=i:Person=1 we=we:Person=1|Number=Plur us=we:Person=1|Number=Plur you=you:Person=2 "
                "he=he:Person=3 she=she:Person=3 it=it:Person=3 they=they:Person=3|Number=Plur them=they:Person=3|Number=Plur "
                "him=he:Person=3 her=she:Person=3 who=who:Number=Sing what=what which=which anyone=anyone:Number=Sing "
                "someone=someone:Number=Sing people=people:Number=Plur one=one:Number=Sing",
        "AUX": "do=do:VerbForm=Fin|Tense=Pres does=do:VerbForm=Fin|Tense=Pres did=do:VerbForm=Fin|Tense=Past "
               "is=be:VerbForm=Fin|Tense=Pres|Number=Sing are=be:VerbForm=Fin|Tense=Pres|Number=Plur "
               "was=be:VerbForm=Fin|Tense=Past|Number=Sing have=have:VerbForm=Fin|Tense=Pres has=have:VerbForm=Fin|Tense=Pres "
               "will=will:VerbForm=Fin|Tense=Pres",
        "VERB": "know=know:VerbForm=Inf knows=know:VerbForm=Fin|Tense=Pres said=say:VerbForm=Fin|Tense=Past "
                "wonder=wonder:VerbForm=Fin|Tense=Pres asked=ask:VerbForm=Fin|Tense=Past want=want:VerbForm=Fin|Tense=Pres "
                "seen=see:VerbForm=Part knew=know:VerbForm=Fin|Tense=Past see=see:VerbForm=Inf left=leave:VerbForm=Fin|Tense=Past",
        "DET": "the=the a=a no=no:Polarity=neg", "ADP": "in=in on=on about=about at=at with=with"},
    "french": {
        "PRON": "je=je:Person=1 j'=je:Person=1 nous=nous:Person=1|Number=Plur tu=tu:Person=2 -tu=tu:Person=2 vous=vous:Person=2 "
                "il=il:Person=3 elle=elle:Person=3 on=on:Person=3 -il=il:Person=3 -ce=ce:Person=3 ce=ce:Person=3 lui=lui:Person=3 "
                "c'=ce:Person=3 qui=qui:PronType=Rel quoi=quoi quel=quel que=que qu'=que rien=rien",
        "AUX": "est=être:VerbForm=Fin|Tense=Pres|Number=Sing a=avoir:VerbForm=Fin|Tense=Pres ont=avoir:VerbForm=Fin|Tense=Pres "
               "était=être:VerbForm=Fin|Tense=Past",
        "VERB": "dit=dire:VerbForm=Fin|Tense=Pres sais=savoir:VerbForm=Fin|Tense=Pres demande=demander:VerbForm=Fin|Tense=Pres "
                "viens=venir:VerbForm=Fin|Tense=Pres faut=falloir:VerbForm=Fin|Tense=Pres veut=vouloir:VerbForm=Fin|Tense=Pres "
                "savez=savoir:VerbForm=Fin|Tense=Pres entendu=entendre:VerbForm=Part",
        "DET": "le=le la=le les=le:Number=Plur un=un une=un", "ADP": "de=de avec=avec dans=dans d'=de"},
    "italian": {
        "PRON": "io=io:Person=1 noi=noi:Person=1|Number=Plur tu=tu:Person=2 voi=voi:Person=2 lui=lui:Person=3 lei=lei:Person=3 "
                "loro=loro:Person=3|Number=Plur chi=chi cosa=cosa qualcuno=qualcuno:Number=Sing nessuno=nessuno tutti=tutto:Number=Plur",
        "AUX": "è=essere:VerbForm=Fin|Tense=Pres|Number=Sing ha=avere:VerbForm=Fin|Tense=Pres hai=avere:VerbForm=Fin|Tense=Pres "
               "era=essere:VerbForm=Fin|Tense=Past",
        "VERB": "so=sapere:VerbForm=Fin|Tense=Pres sai=sapere:VerbForm=Fin|Tense=Pres viene=venire:VerbForm=Fin|Tense=Pres "
                "dice=dire:VerbForm=Fin|Tense=Pres sentito=sentire:VerbForm=Part",
        "DET": "il=il un=un una=un i=il:Number=Plur", "ADP": "di=di con=con in=in"},
    "dutch": {
        "PRON": "ik=ik:Person=1 me=me:Person=1 mij=me:Person=1 wij=wij:Person=1|Number=Plur ons=wij:Person=1|Number=Plur "
                "jij=jij:Person=2 je=je:Person=2 u=u:Person=2 hij=hij:Person=3 zij=zij:Person=3 ze=ze:Person=3 het=het:Person=3 "
                "haar=haar:Person=3 iemand=iemand:Number=Sing niemand=niemand:Number=Sing wie=wie wat=wat men=men "
                "mensen=mensen:Number=Plur",
        "AUX": "is=zijn:VerbForm=Fin|Tense=Pres|Number=Sing was=zijn:VerbForm=Fin|Tense=Past|Number=Sing "
               "heeft=hebben:VerbForm=Fin|Tense=Pres heb=hebben:VerbForm=Fin|Tense=Pres zal=zullen:VerbForm=Fin|Tense=Pres",
        "VERB": "weet=weten:VerbForm=Fin|Tense=Pres vraag=vragen:VerbForm=Fin|Tense=Pres gelooft=geloven:VerbForm=Fin|Tense=Pres "
                "wil=willen:VerbForm=Fin|Tense=Pres hoorde=horen:VerbForm=Fin|Tense=Past gezien=zien:VerbForm=Part "
                "weten=weten:VerbForm=Inf",
        "DET": "de=de een=een geen=geen", "ADP": "van=van in=in met=met af=af"},
}
#: Vocabularies whose one-word terms are words of one part of speech, first match first;
#: forms above come before all of them.
_CATEGORIES = [("conjunctions", "CCONJ", ""), ("wh_words_only_embedded", "SCONJ", ""), ("wh_words", "ADV", ""),
               ("complementizers", "SCONJ", ""), ("negations", "PART", ""), ("nouns_like_question", "NOUN", "Number=Sing"),
               ("nouns_like_information", "NOUN", "Number=Sing"), ("some_other_embedders", "ADJ", ""),
               ("verbs_like_know", "VERB", "VerbForm=Inf"), ("verbs_like_see", "VERB", "VerbForm=Inf"),
               ("verbs_like_wonder", "VERB", "VerbForm=Inf"), ("verbs_like_ask", "VERB", "VerbForm=Inf"),
               ("verbs_like_want", "VERB", "VerbForm=Inf")]


def _rows() -> list[tuple[str, str, str, str, str]]:
    """(language, form, lemma, part of speech, morphology), one a form."""
    out: dict[tuple[str, str], tuple[str, str, str]] = {}
    for lang, by_pos in _FORMS.items():
        for pos, entries in by_pos.items():
            for entry in entries.split():
                form, rest = entry.split("=", 1)
                lemma, _, morph = rest.partition(":")
                out.setdefault((lang, form), (lemma, pos, morph))
    for category, pos, morph in _CATEGORIES:
        for lang, terms in vocab.terms_by_language(category).items():
            for term in terms:
                if re.fullmatch(r"\w+['’]?", term):
                    out.setdefault((lang, term), (term, pos, morph))
    return sorted((*key, *value) for key, value in out.items())


LEXICON_ROWS = _rows()
_LEXICON = {(lang, form): rest for lang, form, *rest in LEXICON_ROWS}


def lookup(language: str, text: str, first: bool) -> tuple[str, str, str]:
    """(lemma, part of speech, morphology) of a word."""
    low = text.lower()
    if (found := _LEXICON.get((language, low))) is not None:
        return tuple(found)
    return low, *_unlisted(text, low, first)


def _unlisted(text: str, low: str, first: bool) -> tuple[str, str]:
    """(part of speech, morphology) of a word that is not in the lexicon."""
    start = text[1:2] if text[0] == "-" else text[0]
    if not (start.isalnum() or start == "_"):
        return "PUNCT", ""
    if text.isascii() and text.isdigit():
        return "NUM", ""
    if text[0] != low[0] and not first:
        return "PROPN", ""
    return "NOUN", "Number=Plur" if len(low) > 3 and low[-1] == "s" else "Number=Sing"


@functools.lru_cache(maxsize=None)
def _morph_map(morph: str) -> dict[str, list[str]]:
    """Morphology as a map. Words of one morphology share it: there are few, while most different words are rare."""
    return {k: v.split(",") for k, _, v in (x.partition("=") for x in morph.split("|") if x)}


@functools.lru_cache(maxsize=None)
def _entries(language: str) -> dict[str, tuple[str, str, str, dict[str, list[str]]]]:
    """What :func:`_facts` says of the listed forms of a language."""
    return {form: (form, lemma, pos, _morph_map(morph)) for lang, form, lemma, pos, morph in LEXICON_ROWS if lang == language}


def _facts(entries: dict, text: str, first: bool) -> tuple[str, str, str, dict[str, list[str]]]:
    """The word in lower case, its lemma, part of speech and morphology as a map."""
    low = text.lower()
    found = entries.get(low)
    if found is None:
        pos, morph = _unlisted(text, low, first)
        return low, low, pos, _morph_map(morph)
    return found


@functools.lru_cache(maxsize=None)
def _question_words(language: str) -> frozenset[str]:
    return frozenset(vocab.wh_words_all.get(language, ()))


def _behind(pos: list[str]) -> tuple[list[int | None], ...]:
    """Of each place, the first verb, noun, and verb or auxiliary behind it."""
    verb = noun = va = None
    n = len(pos)
    verbs, nouns, vas = [None] * n, [None] * n, [None] * n
    for i in range(n - 1, -1, -1):
        verbs[i], nouns[i], vas[i] = verb, noun, va
        p = pos[i]
        if p == "VERB":
            verb = va = i
        elif p == "AUX":
            va = i
        elif p == "NOUN" or p == "PROPN":
            noun = i
    return verbs, nouns, vas


def attach(language: str, pos: list[str], low: list[str]) -> list[tuple[str, int]]:
    """(dependency, head) of every token of a sentence."""
    wh = _question_words(language)
    next_verb, next_noun, next_va = _behind(pos)
    if "VERB" in pos:
        root = pos.index("VERB")
    elif "AUX" in pos:
        root = pos.index("AUX")
    else:
        root = next((i for i, p in enumerate(pos) if p != "PUNCT"), 0)
    # of the place, the last verb, opener of a clause, conjunction and comma before it
    pv = opener = cc = comma = None
    out = []
    for i, p in enumerate(pos):
        nv, word = next_verb[i], low[i]
        is_wh = (p == "PRON" or p == "ADV") and word in wh
        if i == root:
            found = "ROOT", i
        elif p == "PUNCT":
            found = "punct", root
        elif p == "VERB":
            found = ("ccomp" if opener is not None and opener > pv else "conj" if cc is not None and cc > pv
                     else "parataxis" if comma is not None and comma > pv else "xcomp"), pv
        elif p == "AUX":
            if nv is not None and nv - i <= 6:
                found = "aux", nv
            else:
                found = ("cop", next_noun[i]) if next_noun[i] is not None else ("aux", root)
        elif p == "CCONJ" or p == "SCONJ":
            found = "cc" if p == "CCONJ" else "mark", root if nv is None else nv
        elif is_wh:
            dep = "advmod" if p == "ADV" else "nsubj" if next_va[i] == i + 1 else "obj"
            found = dep, nv if nv is not None else pv if pv is not None else root
        elif p == "PRON":
            before = pos[i - 1] if i else ""
            if next_va[i] is not None and next_va[i] - i <= 2:
                found = "nsubj", root if nv is None else nv
            elif before == "AUX" and nv is not None:
                found = "nsubj", nv
            elif before == "VERB":
                found = ("nsubj" if i == 1 or pos[i - 2] == "PUNCT" else "obj"), pv
            else:
                found = "obl", pv if pv is not None else nv if nv is not None else root
        elif p == "DET" or p == "ADP":
            found = "det" if p == "DET" else "case", root if next_noun[i] is None else next_noun[i]
        elif p == "ADJ":
            found = ("amod", i + 1) if next_noun[i] == i + 1 else ("xcomp", root if pv is None else pv)
        else:
            above = pv if pv is not None else nv if nv is not None else root
            if p == "PART":
                found = "neg" if language == "english" else "advmod", above
            elif p == "ADV":
                found = "advmod", above
            elif i and pos[i - 1] == "ADP":
                found = "obl", above
            else:
                found = "obj" if pv is not None else "nsubj", above
        out.append(found)
        if p == "VERB":
            pv = i
        elif p == "CCONJ":
            cc = i
        elif p == "SCONJ" or is_wh:
            opener = i
        if word == ",":
            comma = i
    return out


class ClosedClassProvider(ParseProvider):
    """``parse(texts, language)``: sentences end behind runs of terminators."""

    def __init__(self, single_sentence: bool = False):
        self.single_sentence = single_sentence

    def parse(self, texts: list[str], language: str) -> list[list[list[dict]]]:
        return [self._text(t or "", language) for t in texts]

    def _text(self, text: str, language: str) -> list[list[dict]]:
        found = TOKEN.findall(text)
        if not found:
            return []
        at = TOKEN.search(text).start()  # from here on, tokens follow each other without a gap
        if self.single_sentence:
            return [self._sentence(found, at, language)]
        sentences, lo = [], 0
        for k, (word, _) in enumerate(found, 1):
            if word in TERMINATORS and k < len(found) and found[k][0] not in TERMINATORS:
                sentences.append(self._sentence(found[lo:k], at, language))
                at, lo = at + sum(len(w) + len(ws) for w, ws in found[lo:k]), k
        sentences.append(self._sentence(found[lo:] if lo else found, at, language))
        return sentences

    @staticmethod
    def _sentence(words: list[tuple[str, str]], at: int, language: str) -> list[dict]:
        entries = _entries(language)
        facts = [_facts(entries, words[0][0], True)]
        facts += [_facts(entries, w, False) for w, _ in words[1:]]
        heads = attach(language, [f[2] for f in facts], [f[0] for f in facts])
        out = []
        for (w, ws), (_, lemma, pos, morph), (dep, head) in zip(words, facts, heads):
            out.append({"i": len(out), "idx": at, "text": w, "ws": ws, "lemma": lemma, "pos": pos, "dep": dep, "head": head, "morph": morph})
            at += len(w) + len(ws)
        return out


def single_sentence() -> ClosedClassProvider:
    """The parser in single-sentence mode: a text is one sentence."""
    return ClosedClassProvider(single_sentence=True)
