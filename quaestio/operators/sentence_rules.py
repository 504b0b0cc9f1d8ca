"""The rules L2-L26 over one parsed sentence, for parses that are in a Python worker anyway.

:mod:`quaestio.operators.rules` has the same rules as Catalyst expressions over a token column;
they evaluate every fact of every token. Here a fact is found when a rule asks for it: most
sentences have few finite verbs and question words, and only these lead to other tokens. ``tests/test_sentence_rules.py``
holds both against each other on random sentences.

Positions out of the sentence stand for SQL's NULL: place ``n`` is a token that no test holds for.
"""

from __future__ import annotations

import functools
import re

from quaestio.functions import vocab
from quaestio.operators.tokens import (CCOMPLIKE_DEPS, CLEMMA_CATEGORIES, LEMMA_CATEGORIES, MISPARSED_SUBJECT_DEPS, OBJECTLIKE_DEPS,
                                       SUBJECTLIKE_DEPS, VERBLIKE_POS)

_SUBJECTLIKE, _MISPARSED, _OBJECTLIKE = frozenset(SUBJECTLIKE_DEPS), frozenset(MISPARSED_SUBJECT_DEPS), frozenset(OBJECTLIKE_DEPS)
_CCOMPLIKE, _VERBLIKE = frozenset(CCOMPLIKE_DEPS), frozenset(VERBLIKE_POS)
_OBJECT_CLAUSE = frozenset(["obj", "advcl", *CCOMPLIKE_DEPS])
_AUXLIKE, _AUX_TENSE, _ADJ_VERB = frozenset(["aux", "aux:tense", "aux:pass"]), frozenset(["aux", "aux:tense"]), frozenset(["VERB", "AUX", "ADJ"])
_EDGES = re.compile(r"^[^\w]+|[^\w]+$")
#: Languages with a vocabulary.
LANGUAGES = frozenset(("dutch", "english", "french", "italian"))


@functools.lru_cache(maxsize=None)
def _terms(language: str, category: str) -> frozenset[str]:
    return frozenset(vocab.terms_by_language(category).get(language, ())) if language in vocab.LANGUAGES else frozenset()


@functools.lru_cache(maxsize=None)
def _listed(language: str, categories: tuple[tuple[str, str], ...]) -> dict[str, tuple[str, ...]]:
    """Of each term of the categories (name, vocabulary) the names that hold."""
    out: dict[str, tuple[str, ...]] = {}
    for name, category in categories:
        for term in _terms(language, category):
            out[term] = (*out.get(term, ()), name)
    return out


_LEMMA, _CLEMMA = tuple(LEMMA_CATEGORIES.items()), tuple(CLEMMA_CATEGORIES.items())
_TEXT = (("pqw", "wh_words_all"), ("only_emb", "wh_words_only_embedded"))


class _Categories:
    """The vocabularies that a corrected lemma is in."""
    __slots__ = tuple(CLEMMA_CATEGORIES)

    def __init__(self, names: tuple[str, ...]):
        for name in CLEMMA_CATEGORIES:
            setattr(self, name, name in names)


class Word:
    """What a token says by itself: its morphology and the vocabularies it is in. Most words are in none, so
    words of one morphology share theirs."""
    __slots__ = ("kept", "fin", "inf", "pres", "past", "prog", "plur", "rel", "number", "adr", "spk", "polarity", "pqw", "only_emb",
                 "plain", *LEMMA_CATEGORIES)

    def __init__(self, morph: dict | None, lemma: tuple[str, ...] = (), clemma: tuple[str, ...] = (), text: tuple[str, ...] = (),
                 accept_upper_neg: bool = False):
        self.kept = morph  # its id is in the key under which the word is kept
        values = {k: v for k, v in (morph or {}).items() if v is not None}

        def has(key: str, value: str) -> bool:
            return value in values.get(key, ())
        self.fin, self.inf = has("VerbForm", "Fin"), has("VerbForm", "Inf")
        self.pres, self.past = has("Tense", "Pres"), has("Tense", "Past")
        self.prog, self.plur, self.rel = has("Aspect", "Prog"), has("Number", "Plur"), has("PronType", "Rel")
        self.number = list(values.get("Number", ()))
        self.adr, self.spk = has("Person", "2"), has("Person", "1")
        self.polarity = has("Polarity", "neg") or (accept_upper_neg and has("Polarity", "Neg"))
        for name, _ in _TEXT:
            setattr(self, name, name in text)
        for name in LEMMA_CATEGORIES:
            setattr(self, name, name in lemma)
        self.plain = _Categories(clemma)


_NO_WORD = Word(None)
#: Words kept in this worker, by the id of their morphology and their vocabularies.
_WORDS: dict[tuple, Word] = {}
KEPT_WORDS = 1 << 16


def _words(language: str, tokens: list[dict], accept_upper_neg: bool) -> list[Word]:
    lemmas, clemmas, texts = _listed(language, _LEMMA), _listed(language, _CLEMMA), _listed(language, _TEXT)
    none: tuple[str, ...] = ()
    out = []
    for t in tokens:
        text, lemma, morph = t["text"], t["lemma"], t.get("morph")
        if lemma is None:
            in_lemma = in_clemma = none
        else:
            low = lemma.lower()
            if low == "merkken":  # L2 without particles
                low = "merken"
            elif low.startswith("af_"):
                low = low.split("_")[1]
            in_lemma, in_clemma = lemmas.get(lemma, none), clemmas.get(low, none)
        key = id(morph), in_lemma, in_clemma, none if text is None else texts.get(text.lower(), none), accept_upper_neg
        found = _WORDS.get(key)
        if found is None:
            if len(_WORDS) >= KEPT_WORDS:
                _WORDS.clear()
            found = _WORDS[key] = Word(morph, *key[1:])
        out.append(found)
    return out


class Sentence:
    """One parsed sentence: its tokens' fields as lists with one more place for the token that is not there."""

    def __init__(self, language: str, tokens: list[dict], accept_upper_neg: bool = False):
        self.language, self.n = language, len(tokens)
        n = self.n
        self.tokens = tokens
        self.words = _words(language, tokens, accept_upper_neg)
        self.words.append(_NO_WORD)
        self.pos = [t["pos"] for t in tokens]
        self.pos.append(None)
        self.dep = [t["dep"] for t in tokens]
        self.dep.append(None)
        heads = [t["head"] for t in tokens]
        # a missing head equals none: it stands for a place of its own below zero
        self.said = [h if h is not None else -1_000_000_000 - i for i, h in enumerate(heads)]
        self.said.append(-2_000_000_000)
        self.head = [h if h is not None and 0 <= h < n else n for h in heads]
        self.head.append(n)
        self.particles = "compound:prt" in self.dep
        self._children: dict[int, list[int]] | None = None
        self._embeds: dict[int, bool] = {}

    def text(self, i: int) -> str:
        return (self.tokens[i]["text"] or "") if i < self.n else ""

    def low(self, i: int) -> str:
        return self.text(i).lower()

    def at(self, i: int) -> int:
        return i if 0 <= i < self.n else self.n

    def children(self, i: int) -> list[int]:
        if self._children is None:
            self._children = {}
            for c, h in enumerate(self.said[:-1]):
                if h != c:
                    self._children.setdefault(h, []).append(c)
        return self._children.get(i, []) if i < self.n else []

    # -- L2-L9 -----------------------------------------------------------------
    def categories(self, i: int) -> _Categories:
        """The vocabularies of the corrected lemma (L2)."""
        if not self.particles or i >= self.n:
            return self.words[i].plain
        lemma = self.tokens[i]["lemma"]
        prts = [self.tokens[c]["lemma"] for c in self.children(i) if self.dep[c] == "compound:prt"]
        if not prts or lemma is None:
            return self.words[i].plain
        low = lemma.lower()
        if low in ("vragen", "vraag"):
            low = None if prts[0] is None else f"{prts[0]}_{low}"
        if low == "merkken":
            low = "merken"
        if low is not None and low.startswith("af_") and "af" not in prts and None not in prts:
            low = low.split("_")[1]
        return _Categories(() if low is None else _listed(self.language, _CLEMMA).get(low, ()))

    def embeds(self, i: int) -> bool:
        """L8."""
        if i >= self.n:
            return False
        found = self._embeds.get(i)
        if found is None:
            found = self._embeds[i] = self.categories(i).v_emb or any(self.dep[c] == "ccomp" for c in self.children(i))
        return found

    def negative(self, i: int) -> bool:
        """L6 of a token."""
        return self.dep[i] == "neg" or self.words[i].polarity or self.words[i].v_neg

    def wanted(self, i: int) -> bool:
        """L7."""
        h = self.head[i]
        return (self.dep[i] == "xcomp" and self.dep[h] == "ROOT" and self.words[h].inf and self.categories(h).v_want) or any(
            self.categories(c).v_want for c in self.children(i))

    def present(self, i: int, root: int) -> bool:
        """L9 of an embedder."""
        w, pos = self.words[i], self.pos
        if w.fin and w.pres:
            return True
        kids = self.children(i)
        if w.inf and any(pos[c] == "AUX" and self.words[c].v_perf for c in kids):
            return False
        if (w.inf or pos[i] in ("ADJ", "PROPN") or w.prog) and all(pos[c] != "AUX" or self.words[c].pres for c in kids):
            return True
        return self.words[root].pres or not any(x.past for x in self.words)

    def has_subject_child(self, i: int) -> bool:
        return any(self.dep[c] in _SUBJECTLIKE for c in self.children(i))

    def has_conjunction_child(self, i: int) -> bool:
        return any(self.dep[c] == "cc" for c in self.children(i))

    # -- L10, L11 ----------------------------------------------------------------
    def plural_advmod(self, t: int) -> bool:
        """L10's pattern that asks nothing of the verb."""
        if self.dep[t] != "advmod" or self.pos[t] != "NOUN":
            return False
        h = self.head[t]
        return self.dep[h] == "ROOT" and t == h - 1 and self.words[t].plur and self.words[h].plur

    def is_subject(self, t: int, v: int) -> bool:
        """L10."""
        if t >= self.n:
            return False
        dep, said = self.dep, self.said
        td, vd = dep[t], dep[v]
        subjectlike = td in _SUBJECTLIKE
        if subjectlike and t == v + 1 and vd == "parataxis":
            return True
        if (subjectlike or td in _MISPARSED) and (said[t] == v or (vd in _AUXLIKE and said[t] == said[v])) and (
                subjectlike or not self.has_subject_child(self.head[t])):
            return True
        if vd == "cop" and ((t == said[v] and self.words[v].number == self.words[t].number) or (subjectlike and said[t] == said[v])):
            return True
        if self.plural_advmod(t):
            return True
        if self.language != "french":
            return False
        pronoun, text = self.pos[t] == "PRON", self.text(t)
        if (pronoun and text.startswith("-")) or text == "ce":
            if t == v + 1 or (t == v + 2 and self.text(self.at(t + 1)).startswith("-")):
                return True
        return pronoun and ((td == "ROOT" and vd == "dep" and said[v] == t) or (v == 0 and t == 1 and said[v] == said[t]))

    def near(self, v: int) -> list[int]:
        """Where L10 may find a subject of ``v``; places may be out of the sentence."""
        return [*self.children(v), *self.children(self.head[v]), self.said[v], v + 1, v + 2, 1, *self.plural_nouns]

    @functools.cached_property
    def plural_nouns(self) -> list[int]:
        return [t for t in range(self.n) if self.plural_advmod(t)]

    def subject_of(self, v: int) -> int | None:
        """L11."""
        found = [t for t in sorted({c for c in self.near(v) if 0 <= c < self.n}) if self.is_subject(t, v) and not self.words[t].rel]
        if not found:
            return None
        if len(found) > 1 and self.language == "french" and found[1] == v + 1:
            text = self.text(found[1])
            if text == "ce" or (self.pos[found[1]] == "PRON" and text.startswith("-")):
                return found[1]
        return found[0]

    # -- L12, L13 ----------------------------------------------------------------
    def finite_verbs(self, lo: int, hi: int) -> list[int]:
        """L12 on a span; a Dutch ``be…d`` root counts as well."""
        out = []
        for i in range(lo, hi):
            if self.pos[i] not in _VERBLIKE:
                continue
            finite = self.words[i].fin
            dutch = self.language == "dutch" and self.dep[i] == "ROOT" and self.pos[i] == "VERB" and self.text(i).startswith(
                "be") and self.text(i).endswith("d")
            if (finite or dutch) and not any(self.pos[c] in _VERBLIKE and self.dep[c] in ("aux", "cop") and self.words[c].fin and c < i
                                             for c in self.children(i)):
                out += [i] * (finite + dutch)
        return out

    @functools.cached_property
    def root(self) -> int:
        return next((i for i in range(self.n) if self.said[i] == i), self.n)

    def matrix(self) -> tuple[int | None, int | None]:
        """The verb and its subject."""
        n, pos, dep, said, head = self.n, self.pos, self.dep, self.said, self.head
        if dep[self.root] != "ROOT":
            return None, None
        comma = None
        if pos[0] == "SCONJ" or (n > 1 and pos[1] == "SCONJ"):
            comma = next((i for i in range(1, n - 1) if pos[i] == "PUNCT" and self.text(i) == ","), None)
        verbs = self.finite_verbs(0, n) if comma is None else self.finite_verbs(comma, n) + self.finite_verbs(0, comma)
        verb = subj = None
        for v in verbs:
            h = head[v]
            if dep[v] == "parataxis" and dep[h] == "ROOT" and self.words[h].fin and h - v < 3:
                continue
            if dep[v] in _CCOMPLIKE or (dep[v] in _AUX_TENSE and dep[h] in _CCOMPLIKE):
                continue
            if any(dep[m] == "mark" and pos[m] == "SCONJ" and (head[head[m]] == v or (said[v] == said[m] and said[m] != v)) for m in range(v)):
                continue
            found = self.subject_of(v)
            if found is not None:
                if verb is None or (dep[v] == "conj" and not self.has_conjunction_child(v)) or (
                        dep[h] == "conj" and not self.has_conjunction_child(h)):
                    verb, subj = v, found
            elif self.language == "french" and self.low(v) in vocab.french_il_drop_verbs:
                verb = v
        return verb, subj

    # -- L14, L15 ----------------------------------------------------------------
    def inversion(self, text: str, verb: int | None, subj: int | None, spaced_est_ce: bool) -> bool | None:
        """L14."""
        if self.language == "french":
            begin = text.lower()[:20]
            if "est-ce" in begin or (spaced_est_ce and "est -ce" in begin):
                return True
        if verb is None or subj is None:
            return None
        if any(self.dep[m] == "mark" and self.pos[m] == "SCONJ" and self.said[m] == verb for m in range(verb)):
            return None
        if not (verb < subj or self.words[subj].v_whlemma):
            return False
        return not (self.language == "dutch" and any(c < verb and self.dep[c] == "advmod" for c in self.children(verb)))

    def tag_question(self, text: str, ends_qm: bool, inv: bool | None) -> bool:
        """L15."""
        pos, n = self.pos, self.n
        if self.language == "english" and ((n >= 4 and pos[n - 4:n] == ["AUX", "PART", "PRON", "PUNCT"])
                                           or (n >= 3 and pos[n - 3:n] == ["AUX", "PRON", "PUNCT"])):
            return True
        french = self.language == "french"
        if not french and not ends_qm:
            return False
        stripped = _EDGES.sub("", text)
        if french and stripped.endswith(" ou non"):
            return not inv
        return ends_qm and self.language in vocab.LANGUAGES and stripped.endswith(tuple(vocab.tag_questions[self.language]))

    # -- L17, L21, L22, L24 --------------------------------------------------------
    def not_a_question_word(self, t: int) -> bool:
        """L17."""
        low, pos, n = self.low(t), self.pos, self.n
        if self.language == "dutch":
            after = self.at(t + 1)
            return ((t <= 1 and low == "wat" and self.low(after) == "een")
                    or ((pos[t] == "DET" or self.dep[t] == "det") and pos[after] == "NOUN" and self.words[after].plur)
                    or (self.text(t) == "waar" and pos[t] == "ADJ" and any(self.dep[c] == "cop" for c in self.children(t))))
        if self.language != "french":
            return False
        if t > 2 and self.low(t - 2) == "à" and self.low(t - 1) == "ce":
            return True
        if self.text(t) == "ou" and pos[t] == "CCONJ" and self.dep[t] == "cc":
            return True
        h = self.head[t]
        if low == "que" and self.dep[h] == "dep" and not any(pos[c] in _VERBLIKE for c in self.children(h)):
            return True
        before = ""
        for k in range(t - 1, -1, -1):  # only as much as the longest ending
            before = self._spelled(k) + before
            if len(before.strip()) > 7:
                break
        if before.strip().lower().endswith(("est -ce", "est ce")):
            return True
        after = ""
        for k in range(t, n):
            after += self._spelled(k)
            if len(after.strip()) > 16:
                break
        return after.strip().lower().startswith(("quand même", "quand bien même"))

    def _spelled(self, k: int) -> str:
        t = self.tokens[k]
        return t["text"] + t["ws"] if t["text"] is not None and t["ws"] is not None else ""

    def not_complementizer(self, t: int) -> bool:
        """L21."""
        above = self.dep[self.head[t]]
        return self.dep[t] in _OBJECTLIKE and above is not None and above != "ccomp"

    def ordinary_relclause(self, t: int) -> bool:
        """L22."""
        dep, pos, n = self.dep, self.pos, self.n
        td, h = dep[t], self.head[t]
        hd, hh = dep[h], self.head[h]
        if td == "ROOT" or (td == "nsubj" and hd == "ROOT"):
            return False
        if self.root < n and self.said[t] == self.root:
            kids = self.children(h)
            if any(dep[c] == "cop" or (dep[c] == "obj" and any(dep[g] == "cop" for g in self.children(c))) for c in kids):
                return True
        relative = hd == "acl:relcl"
        if td == "advmod" and relative and pos[hh] == "NOUN":
            return True
        if (td in _SUBJECTLIKE or td in _OBJECTLIKE) and relative and (
                pos[hh] == "NOUN" or (pos[hh] == "ADJ" and hh > 1 and pos[self.at(hh - 1)] == "DET")):
            return True
        if hd in ("csubj", "nsubj"):
            return True
        if relative and pos[hh] == "NOUN" and t - 1 == hh:
            return True
        if td == "mark" and (hd == "advcl" or (t > 0 and dep[t - 1] == "mark" and self.said[t] == self.said[t - 1])):
            return True
        return (self.language == "dutch" and self.tokens[t]["lemma"] == "wat" and t < n - 1 and self.tokens[t + 1]["lemma"] == "er")

    def indirect_head(self, e: int, q: bool) -> bool:
        """L24 for embedder ``e``; ``q``: a question mark and no tag question."""
        kinds = self.categories(e)
        if not (kinds.v_know or kinds.v_see or kinds.v_wonder or kinds.v_qnoun or kinds.v_info or kinds.v_ask):
            return False
        if any(self.pos[c] == "SCONJ" and c < e for c in self.children(e)):
            return False
        subjects = [self.words[t] for t in self.near(e) if 0 <= t < self.n and self.is_subject(t, e)]
        ex, imp, who = any(w.exist for w in subjects), any(w.imp for w in subjects), any(w.who for w in subjects)
        adr, none = any(w.adr for w in subjects), not subjects
        spk = none or any(w.spk for w in subjects)
        pres = self.present(e, self.root)
        return ((kinds.v_know and ((q and pres and (who or adr or ex or imp))
                                   or (not q and spk and pres and any(self.negative(c) for c in self.children(e))) or self.wanted(e)))
                or (kinds.v_see and q and not pres and (who or adr or ex))
                or (kinds.v_wonder and pres and ((not q and (spk or imp)) or (q and (ex or imp or adr))))
                or (kinds.v_qnoun and not q and pres and not self.words[e].plur)
                or (kinds.v_info and pres)
                or (kinds.v_ask and not q and (ex or spk or imp)))

    # -- L19, L20, L23, L25 ----------------------------------------------------------
    def embedder_options(self, t: int) -> tuple[int | None, int | None, str | None, int | None, bool]:
        """L19 without tags: the shortcut, the local candidate, kind and place of the first decisive
        ancestor, and whether a ``ccomp`` is above."""
        dep, pos, head, said = self.dep, self.pos, self.head, self.said
        td, h = dep[t], head[t]
        hd, hh = dep[h], head[h]
        first = next((y for y in range(t) if pos[y] == "VERB" and dep[y] in ("nsubj", "parataxis")), self.n)
        a = first if self.embeds(first) else None
        b = None
        root = self.root
        if td == "advmod" and root < t and said[t] == root and self.embeds(root):
            b = root
        elif hd == "acl:relcl" and pos[h] in _ADJ_VERB and dep[hh] == "obj" and self.embeds(head[hh]):
            b = head[hh]
        elif hd in _OBJECT_CLAUSE and pos[h] in _ADJ_VERB and self.embeds(hh):
            b = hh
        elif td in _OBJECT_CLAUSE and self.embeds(h) and hd is not None and hd not in _CCOMPLIKE:
            b = h
        elif td is not None and td in "nummod" and hd == "parataxis" and self.embeds(hh):
            b = hh
        elif hd == "ROOT" and not self.embeds(h):
            b = next((c for c in self.children(h) if dep[c] in _AUX_TENSE and self.embeds(c)), None)
        kind = place = None
        ccomp_above = False
        x, steps = t, 0
        while steps < self.n and said[x] != x and head[x] < self.n:
            x, steps = head[x], steps + 1
            ccomp_above = ccomp_above or dep[x] == "ccomp"
            if kind is not None:
                continue
            if (pos[x] in _ADJ_VERB and dep[x] is not None and dep[x] not in _CCOMPLIKE and self.embeds(x) and not self.is_subject(t, x)
                    and not (said[t] == x and (td == "mark" or td is None))):
                kind, place = "verb", x
            elif dep[x] == "obl" and (noun := next((c for c in self.children(head[x]) if dep[c] in _OBJECTLIKE and pos[c] == "NOUN"
                                                    and self.embeds(c)), None)) is not None:
                kind, place = "noun", noun
            elif dep[x] == "nmod" and self.embeds(head[x]):
                kind, place = "noun", head[x]
        return a, b, kind, place, ccomp_above

    def fronted(self, t: int, mv: int | None, ccomp_above: bool, done: list[tuple[int, str]]) -> bool:
        """L23."""
        h = self.head[t]
        hh = self.head[h]
        if mv is None:
            return not (ccomp_above or (self.dep[h] == "acl:relcl" and hh < t and self.pos[hh] in _VERBLIKE))
        if (self.dep[h] == "conj" and hh < self.n and (hh == mv or self.said[mv] == hh) and any(
                self.pos[c] == "CCONJ" and self.dep[c] == "cc" and mv < c < t for c in self.children(h))):
            return any(tag == "fronted" for _, tag in done)
        return t < mv

    def complementizer_rules(self, x: int, e: int, earlier_hit: bool) -> bool:
        """L20."""
        dep, pos, kids = self.dep, self.pos, self.children(e)
        words = self.words
        if any(words[c].v_neutral and dep[c] in _OBJECTLIKE and c != x for c in kids):
            return False
        h = self.head[x]
        if dep[x] == "mark" and self.head[h] == e and e < self.n:
            return True
        if any(dep[g] == "mark" and g != x and words[g].v_compl for c in kids for g in self.children(c)):
            return False
        if any(dep[c] == "mark" and words[c].v_compl and c != x for c in kids):
            return False
        if dep[x] == "cc" and pos[x] == "CCONJ" and (earlier_hit or dep[h] == "conj"):
            return False
        if pos[x] == "CCONJ" and dep[x] == "fixed":
            return False
        if x == 0 and (dep[x] == "xcomp" or (dep[x] == "advmod" and h == 1 and h < self.n
                                             and any(dep[c] in _OBJECTLIKE for c in self.children(h)))):
            return False
        return True

    def might_complement(self, t: int, e: int, done: list[tuple[int, str]]) -> bool:
        """L20 with its clause about earlier words."""
        hit = False
        if self.dep[t] == "cc" and self.pos[t] == "CCONJ":
            for i, tag in done:
                hit = hit or (tag == "indirect" and self.complementizer_rules(i, e, hit))
        return self.complementizer_rules(t, e, hit)

    def word_tag(self, t: int, done: list[tuple[int, str]], mv: int | None, ends_qm: bool, tag_question: bool, exclaims: bool) -> str:
        """L25 for question word ``t`` given those before it."""
        if self.not_a_question_word(t):
            return "no"
        a, b, kind, place, ccomp_above = self.embedder_options(t)
        if a is not None:
            embedder = a
        elif b is not None and self.might_complement(t, b, done):
            embedder = b
        elif kind == "verb":
            embedder = place if self.might_complement(t, place, done) else None
        else:
            embedder = place
        direct = (ends_qm and not self.words[t].only_emb and (embedder is None or self.not_complementizer(t))
                  and not self.ordinary_relclause(t))
        if direct and self.fronted(t, mv, ccomp_above, done):
            return "fronted"
        if embedder is not None and not exclaims and self.embeds(embedder) and self.indirect_head(embedder, ends_qm and not tag_question):
            return "indirect"
        return "insitu" if direct else "no"


#: What :func:`classify` returns, in order; the last are the question words' places and tags.
FIELDS = ("ends_with_question_mark", "matrix_verb", "matrix_subject", "subj_verb_inversion", "has_tag_question", "structure", "use",
          "qwords_literal", "qwords_functional", "tags")


def classify(language: str | None, text: str | None, tokens: list[dict] | None, accept_upper_neg: bool = False,
             spaced_est_ce: bool = False) -> tuple:
    """L2-L26 for one sentence. Without a parse there is no class and no question word; a language
    without vocabulary gives no class (Q3)."""
    ends_qm = None if text is None else text.strip("!").endswith("?")
    if tokens is None or language is None:
        est_ce = text is not None and language == "french" and (
            "est-ce" in (begin := text.lower()[:20]) or (spaced_est_ce and "est -ce" in begin))
        inv = True if est_ce else None
        empty = None if tokens is None else []
        tagged = text is not None and language is not None and Sentence(language, []).tag_question(text, ends_qm, inv)
        return ends_qm, None, None, inv, tagged, None, None, empty, empty, empty
    text = text or ""
    s = Sentence(language, tokens, accept_upper_neg)
    verb, subj = s.matrix()
    inv = s.inversion(text, verb, subj, spaced_est_ce)
    tag_question = s.tag_question(text, bool(ends_qm), inv)
    tags: list[tuple[int, str]] = []
    exclaims = text.endswith("!")
    for t in range(s.n):
        if s.words[t].pqw:
            tags.append((t, s.word_tag(t, tags, verb, bool(ends_qm), tag_question, exclaims)))
    words = {tag: [s.low(t) for t, x in tags if x == tag] for tag in ("fronted", "insitu", "indirect")} if tags else {}
    fronted, insitu, indirect = words.get("fronted", []), words.get("insitu", []), words.get("indirect", [])
    literal = fronted + insitu
    structure = use = None
    if language in LANGUAGES:
        if tag_question and not literal:
            structure = "tag"
        elif literal:
            structure = "wh" if fronted else "insitu"
        elif ends_qm:
            structure = "elliptic" if inv is None else "polar" if inv else "risingdecl"
        else:
            structure = "decl"
        use = "indirect" if indirect else "direct" if structure != "decl" else "no"
    return ends_qm, verb, subj, inv, tag_question, structure, use, literal, indirect or literal, tags
