"""DuckDB twins of the shallow parser and of the token rules, as relational queries.

The Spark side evaluates the rules inside each row's token array; here they are joins,
windows, group-bys and recursive steps over a token table, written from the rules'
descriptions. ``RULES`` reads only a table ``tok`` (sid, language, stext, n, i, idx, word,
ws, lemma, pos, dep, head, morph), so the tests can also feed it random trees.
"""

from __future__ import annotations

from quaestio.functions import vocab
from quaestio.operators.closed_class import LEXICON_ROWS
from quaestio.plans import oracle as O

W = r"\p{L}\p{N}_"
Z = r"\t\n\x0B\f\r\x1C-\x1F\x{85}\p{Z}"


def quoted(*values: str) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def in_vocab(value: str, category: str, lang: str = "language") -> str:
    cases = " ".join(f"WHEN '{x}' THEN {value} IN ({quoted(*terms)})" if terms else f"WHEN '{x}' THEN FALSE"
                     for x, terms in vocab.terms_by_language(category).items())
    return f"coalesce(CASE {lang} {cases} ELSE FALSE END, FALSE)"


def has(morph: str, key: str, value: str) -> str:
    """Is ``value`` among the values of ``key`` in a text like ``Person=1,2|Number=Sing``?"""
    return rf"list_contains(string_split(regexp_extract({morph}, '(^|\|){key}=([^|]*)', 2), ','), '{value}')"


def number(morph: str) -> str:
    return rf"regexp_extract({morph}, '(^|\|)Number=([^|]*)', 2)"


# ------------------------------------------------------------------ the shallow parser

_TERM = "word IN ('.', '!', '?', '…')"
_LEXICON = ", ".join(f"({quoted(*row)})" for row in LEXICON_ROWS)

#: From ``questions`` (qid, language, qtext, "offset") to ``parsed`` (one row a question: stext,
#: shift) and ``tok``.
PARSE = rf"""
lexicon(language, low, lemma, pos, morph) AS (VALUES {_LEXICON}),
cut AS MATERIALIZED (
  SELECT qid, language, qtext, unnest(words) AS word, unnest(spaces) AS ws, generate_subscripts(words, 1) AS k
  FROM (SELECT qid, language, qtext,
               regexp_extract_all(qtext, '(-?[{W}]+[''’]?|[^{W}{Z}])([{Z}]*)', 1) AS words,
               regexp_extract_all(qtext, '(-?[{W}]+[''’]?|[^{W}{Z}])([{Z}]*)', 2) AS spaces FROM questions)
),
placed AS (
  SELECT *, coalesce(sum(length(word) + length(ws)) OVER (PARTITION BY qid ORDER BY k
                       ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
            + length(regexp_extract(qtext, '^[{Z}]*', 0)) AS beg,
         coalesce(lag({_TERM}) OVER (PARTITION BY qid ORDER BY k), FALSE) AND NOT {_TERM} AS opens
  FROM cut
),
numbered AS (SELECT *, sum(CAST(opens AS INTEGER)) OVER (PARTITION BY qid ORDER BY k) AS sub FROM placed),
last_one AS (SELECT * FROM (SELECT *, max(sub) OVER (PARTITION BY qid) AS last_sub FROM numbered) WHERE sub = last_sub),
parsed AS MATERIALIZED (
  SELECT qid, CASE WHEN any_value(last_sub) > 0 THEN min(beg) ELSE 0 END AS shift, min(k) AS first_k, count(*) AS n,
         CASE WHEN any_value(last_sub) > 0
              THEN substr(any_value(qtext), CAST(min(beg) AS BIGINT) + 1, CAST(max(beg + length(word)) - min(beg) AS BIGINT))
              ELSE any_value(qtext) END AS stext
  FROM last_one GROUP BY qid
),
looked AS (
  SELECT t.qid AS sid, t.language, p.stext, p.n, t.k - p.first_k AS i, t.beg - p.shift AS idx, t.word,
         CASE WHEN t.k - p.first_k = p.n - 1 THEN '' ELSE t.ws END AS ws, lower(t.word) AS low,
         coalesce(x.lemma, lower(t.word)) AS lemma,
         CASE WHEN x.pos IS NOT NULL THEN x.pos WHEN NOT regexp_matches(t.word, '^-?[{W}]') THEN 'PUNCT'
              WHEN regexp_full_match(t.word, '[0-9]+') THEN 'NUM'
              WHEN left(t.word, 1) <> left(lower(t.word), 1) AND t.k > p.first_k THEN 'PROPN' ELSE 'NOUN' END AS pos,
         x.morph AS known
  FROM last_one AS t JOIN parsed AS p USING (qid)
       LEFT JOIN lexicon AS x ON x.language = t.language AND x.low = lower(t.word)
),
around AS (
  SELECT *, coalesce(known, CASE WHEN pos <> 'NOUN' THEN '' WHEN length(low) > 3 AND ends_with(low, 's') THEN 'Number=Plur'
                                 ELSE 'Number=Sing' END) AS morph,
         {in_vocab('low', 'wh_words_all')} AND pos IN ('PRON', 'ADV') AS is_wh,
         max(CASE WHEN pos = 'VERB' THEN i END) OVER b AS pv, min(CASE WHEN pos = 'VERB' THEN i END) OVER a AS nv,
         max(CASE WHEN pos = 'SCONJ' OR ({in_vocab('low', 'wh_words_all')} AND pos IN ('PRON', 'ADV')) THEN i END) OVER b AS po,
         max(CASE WHEN pos = 'CCONJ' THEN i END) OVER b AS pc, max(CASE WHEN low = ',' THEN i END) OVER b AS pcomma,
         min(CASE WHEN pos IN ('NOUN', 'PROPN') THEN i END) OVER a AS nn,
         min(CASE WHEN pos IN ('VERB', 'AUX') THEN i END) OVER a AS nva,
         coalesce(lag(pos) OVER o, '') AS p1, lag(pos, 2) OVER o AS p2,
         coalesce(min(CASE WHEN pos = 'VERB' THEN i END) OVER s, min(CASE WHEN pos = 'AUX' THEN i END) OVER s,
                  min(CASE WHEN pos <> 'PUNCT' THEN i END) OVER s, 0) AS root
  FROM looked
  WINDOW b AS (PARTITION BY sid ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
         a AS (PARTITION BY sid ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING),
         o AS (PARTITION BY sid ORDER BY i), s AS (PARTITION BY sid)
),
tok AS MATERIALIZED (
  SELECT sid, language, stext, n, i, idx, word, ws, lemma, pos, morph, link.dep AS dep, link.head AS head
  FROM (SELECT *, CASE
    WHEN i = root THEN {{'dep': 'ROOT', 'head': i}}
    WHEN pos = 'PUNCT' THEN {{'dep': 'punct', 'head': root}}
    WHEN pos = 'VERB' THEN {{'dep': CASE WHEN po > pv THEN 'ccomp' WHEN pc > pv THEN 'conj' WHEN pcomma > pv THEN 'parataxis'
                                       ELSE 'xcomp' END, 'head': pv}}
    WHEN pos = 'AUX' AND nv - i <= 6 THEN {{'dep': 'aux', 'head': nv}}
    WHEN pos = 'AUX' AND nn IS NOT NULL THEN {{'dep': 'cop', 'head': nn}}
    WHEN pos = 'AUX' THEN {{'dep': 'aux', 'head': root}}
    WHEN pos = 'CCONJ' THEN {{'dep': 'cc', 'head': coalesce(nv, root)}}
    WHEN pos = 'SCONJ' THEN {{'dep': 'mark', 'head': coalesce(nv, root)}}
    WHEN is_wh THEN {{'dep': CASE WHEN pos = 'ADV' THEN 'advmod' WHEN nva = i + 1 THEN 'nsubj' ELSE 'obj' END,
                     'head': coalesce(nv, pv, root)}}
    WHEN pos = 'PRON' AND nva - i <= 2 THEN {{'dep': 'nsubj', 'head': coalesce(nv, root)}}
    WHEN pos = 'PRON' AND p1 = 'AUX' AND nv IS NOT NULL THEN {{'dep': 'nsubj', 'head': nv}}
    WHEN pos = 'PRON' AND p1 = 'VERB' THEN {{'dep': CASE WHEN i = 1 OR p2 = 'PUNCT' THEN 'nsubj' ELSE 'obj' END, 'head': pv}}
    WHEN pos = 'PRON' THEN {{'dep': 'obl', 'head': coalesce(pv, nv, root)}}
    WHEN pos = 'PART' THEN {{'dep': CASE WHEN language = 'english' THEN 'neg' ELSE 'advmod' END, 'head': coalesce(pv, nv, root)}}
    WHEN pos IN ('DET', 'ADP') THEN {{'dep': CASE WHEN pos = 'DET' THEN 'det' ELSE 'case' END, 'head': coalesce(nn, root)}}
    WHEN pos = 'ADJ' AND nn = i + 1 THEN {{'dep': 'amod', 'head': i + 1}}
    WHEN pos = 'ADJ' THEN {{'dep': 'xcomp', 'head': coalesce(pv, root)}}
    WHEN pos = 'ADV' THEN {{'dep': 'advmod', 'head': coalesce(pv, nv, root)}}
    WHEN p1 = 'ADP' THEN {{'dep': 'obl', 'head': coalesce(pv, nv, root)}}
    WHEN pv IS NOT NULL THEN {{'dep': 'obj', 'head': pv}}
    ELSE {{'dep': 'nsubj', 'head': coalesce(nv, root)}} END AS link FROM around)
)"""

#: The same in single-sentence mode.
PARSE_SINGLE = PARSE.replace(f"coalesce(lag({_TERM}) OVER (PARTITION BY qid ORDER BY k), FALSE) AND NOT {_TERM} AS opens", "FALSE AS opens")

# ------------------------------------------------------------------ the token rules

V = "('AUX', 'VERB')"
OBJ = "('dobj', 'obj', 'iobj', 'obl', 'obl:agent', 'obl:arg')"
SUBJ = "('nsubj', 'nsubjpass', 'nsubj:pass', 'csubj', 'csubjpass', 'expl', 'expl:subj')"
MISPARSED = "('nmod:poss', 'obj')"
CCOMP = "('acl:relcl', 'ccomp')"

#: L2-L9, L12 (what a token and its children tell), for every token of ``tok``.
FACTS = rf"""
prt AS (SELECT sid, head AS i, arg_min(lemma, i) AS prt_lemma, bool_or(lemma = 'af') AS has_af FROM tok
        WHERE dep = 'compound:prt' AND head <> i GROUP BY sid, head),
lemmas AS (
  SELECT t.*, lower(word) AS low, prt_lemma, coalesce(has_af, FALSE) AS has_af,
         CASE WHEN lower(lemma) IN ('vragen', 'vraag') AND prt_lemma IS NOT NULL THEN prt_lemma || '_' || lower(lemma)
              WHEN lower(lemma) = 'merkken' THEN 'merken' ELSE lower(lemma) END AS joined
  FROM tok AS t LEFT JOIN prt USING (sid, i)
),
own AS MATERIALIZED (
  SELECT *, {in_vocab('lemma', 'personal_existentials')} AS exist, {in_vocab('lemma', 'impersonals')} AS imp,
         {in_vocab('lemma', 'who_like')} AS who, {in_vocab('lemma', 'perfect_auxiliaries')} AS perf,
         {in_vocab('lemma', 'neutral_pronouns')} AS neutral, {in_vocab('lemma', 'complementizers')} AS compl,
         {in_vocab('lemma', 'wh_words_all')} AS whlemma, {in_vocab('clemma', 'all_embedders')} AS embeds,
         {in_vocab('clemma', 'verbs_like_want')} AS wants, {in_vocab('clemma', 'verbs_like_know')} AS know,
         {in_vocab('clemma', 'verbs_like_see')} AS see, {in_vocab('clemma', 'verbs_like_wonder')} AS wonder,
         {in_vocab('clemma', 'nouns_like_question')} AS qnoun, {in_vocab('clemma', 'nouns_like_information')} AS info,
         {in_vocab('clemma', 'verbs_like_ask')} AS ask, pos IN ('VERB', 'AUX', 'ADJ') AS verblike,
         dep = 'neg' OR {has('morph', 'Polarity', 'neg')} OR {in_vocab('lemma', 'negations')} AS neg,
         {has('morph', 'Person', '2')} AS adr, {has('morph', 'Person', '1')} AS spk,
         pos IN {V} AND {has('morph', 'VerbForm', 'Fin')} AS fin, {in_vocab('low', 'wh_words_all')} AS pqw,
         {in_vocab('low', 'wh_words_only_embedded')} AS only_emb,
         {has('morph', 'Tense', 'Pres')} AS tense_pres, {has('morph', 'Tense', 'Past')} AS tense_past
  FROM (SELECT *, CASE WHEN starts_with(joined, 'af_') AND NOT has_af THEN split_part(joined, '_', 2) ELSE joined END AS clemma
        FROM lemmas)
),
kids AS MATERIALIZED (
  SELECT sid, head AS i, bool_or(dep IN {SUBJ}) AS subj_kid, bool_or(dep = 'cc') AS cc_kid, bool_or(dep = 'ccomp') AS ccomp_kid,
         bool_or(wants) AS want_kid, bool_or(neg) AS neg_kid, bool_or(dep = 'cop') AS cop_kid, bool_or(pos IN {V}) AS v_kid,
         bool_or(dep IN {OBJ}) AS obj_kid, bool_or(pos = 'AUX' AND NOT tense_pres) AS aux_other, bool_or(pos = 'AUX' AND perf) AS perf_kid,
         min(CASE WHEN dep = 'advmod' THEN i END) AS first_advmod, min(CASE WHEN pos = 'SCONJ' THEN i END) AS first_sconj,
         min(CASE WHEN pos IN {V} AND dep IN ('aux', 'cop') AND {has('morph', 'VerbForm', 'Fin')} THEN i END) AS first_fin_aux,
         list(i) FILTER (neutral AND dep IN {OBJ}) AS neutrals, list(i) FILTER (dep = 'mark' AND compl) AS marks,
         list(i) FILTER (dep = 'cc' AND pos = 'CCONJ') AS ccs
  FROM own WHERE head <> i GROUP BY sid, head
),
whole AS MATERIALIZED (
  SELECT sid, any_value(language) AS language, any_value(stext) AS stext, any_value(n) AS n,
         min(CASE WHEN head = i THEN i END) AS root, bool_or(tense_past) AS any_past,
         ends_with(trim(any_value(stext), '!'), '?') AS qm, ends_with(any_value(stext), '!') AS exclaims
  FROM own GROUP BY sid
),
word AS MATERIALIZED (
  SELECT t.*, s.root, s.qm, coalesce(k.subj_kid, FALSE) AS subj_kid, coalesce(k.cc_kid, FALSE) AS cc_kid,
         coalesce(k.cop_kid, FALSE) AS cop_kid, coalesce(k.v_kid, FALSE) AS v_kid, coalesce(k.obj_kid, FALSE) AS obj_kid,
         t.embeds OR coalesce(k.ccomp_kid, FALSE) AS emb, coalesce(k.neg_kid, FALSE) AS negated,
         (t.dep = 'xcomp' AND h.dep = 'ROOT' AND {has('h.morph', 'VerbForm', 'Inf')} AND h.wants) OR coalesce(k.want_kid, FALSE) AS wanted,
         coalesce(k.first_fin_aux < t.i, FALSE) AS skipped, k.first_advmod, k.first_sconj, k.neutrals, k.marks, k.ccs,
         CASE WHEN {has('t.morph', 'VerbForm', 'Fin')} AND t.tense_pres THEN TRUE
              WHEN {has('t.morph', 'VerbForm', 'Inf')} AND coalesce(k.perf_kid, FALSE) THEN FALSE
              WHEN ({has('t.morph', 'VerbForm', 'Inf')} OR t.pos IN ('ADJ', 'PROPN') OR {has('t.morph', 'Aspect', 'Prog')})
                   AND NOT coalesce(k.aux_other, FALSE) THEN TRUE
              ELSE r.tense_pres OR NOT s.any_past END AS present,
         h.pos AS hpos, h.dep AS hdep, h.head AS hhead
  FROM own AS t JOIN whole AS s USING (sid) JOIN own AS h ON h.sid = t.sid AND h.i = t.head
       JOIN own AS r ON r.sid = t.sid AND r.i = s.root LEFT JOIN kids AS k ON k.sid = t.sid AND k.i = t.i
)"""

_PRON_FR = "((t.pos = 'PRON' AND starts_with(t.word, '-')) OR t.word = 'ce')"
#: L10-L15.
MATRIX = rf"""
subj AS MATERIALIZED (
  SELECT v.sid, v.i AS v, t.i AS t FROM word AS v JOIN word AS t ON t.sid = v.sid AND t.i = v.i + 1
  WHERE v.dep = 'parataxis' AND t.dep IN {SUBJ}
  UNION SELECT v.sid, v.i, t.i FROM word AS t JOIN word AS h ON h.sid = t.sid AND h.i = t.head JOIN word AS v ON v.sid = t.sid
        WHERE t.pos = 'NOUN' AND {has('t.morph', 'Number', 'Plur')} AND t.dep = 'advmod' AND h.dep = 'ROOT' AND t.i = h.i - 1
              AND {has('h.morph', 'Number', 'Plur')}
  UNION SELECT v.sid, v.i, t.i FROM word AS t JOIN word AS v ON v.sid = t.sid AND v.i = t.head
        WHERE t.dep IN {SUBJ} OR (t.dep IN {MISPARSED} AND NOT v.subj_kid)
  UNION SELECT v.sid, v.i, t.i FROM word AS t JOIN word AS h ON h.sid = t.sid AND h.i = t.head JOIN word AS v ON v.sid = t.sid AND v.head = t.head
        WHERE v.dep IN ('aux', 'aux:tense', 'aux:pass') AND (t.dep IN {SUBJ} OR (t.dep IN {MISPARSED} AND NOT h.subj_kid))
  UNION SELECT v.sid, v.i, t.i FROM word AS v JOIN word AS t ON t.sid = v.sid AND t.i = v.head
        WHERE v.dep = 'cop' AND {number('v.morph')} = {number('t.morph')}
  UNION SELECT v.sid, v.i, t.i FROM word AS v JOIN word AS t ON t.sid = v.sid AND t.head = v.head WHERE v.dep = 'cop' AND t.dep IN {SUBJ}
  UNION SELECT v.sid, v.i, t.i FROM word AS t JOIN word AS v ON v.sid = t.sid AND v.i = t.i - 1 WHERE t.language = 'french' AND {_PRON_FR}
  UNION SELECT v.sid, v.i, t.i FROM word AS t JOIN word AS v ON v.sid = t.sid AND v.i = t.i - 2 JOIN word AS x ON x.sid = t.sid AND x.i = t.i + 1
        WHERE t.language = 'french' AND {_PRON_FR} AND starts_with(x.word, '-')
  UNION SELECT v.sid, v.i, t.i FROM word AS v JOIN word AS t ON t.sid = v.sid AND t.i = v.head
        WHERE t.language = 'french' AND t.pos = 'PRON' AND t.dep = 'ROOT' AND v.dep = 'dep'
  UNION SELECT v.sid, v.i, t.i FROM word AS v JOIN word AS t ON t.sid = v.sid AND t.i = 1
        WHERE t.language = 'french' AND v.i = 0 AND t.pos = 'PRON' AND v.head = t.head
),
first_two AS (
  SELECT s.sid, s.v, list(s.t ORDER BY s.t) AS ts FROM subj AS s JOIN word AS t ON t.sid = s.sid AND t.i = s.t
  WHERE NOT {has('t.morph', 'PronType', 'Rel')} GROUP BY s.sid, s.v
),
subject AS (
  SELECT f.sid, f.v, CASE WHEN t.language = 'french' AND t.i = f.v + 1 AND (t.word = 'ce' OR (t.pos = 'PRON' AND starts_with(t.word, '-')))
                          THEN f.ts[2] ELSE f.ts[1] END AS s
  FROM first_two AS f LEFT JOIN word AS t ON t.sid = f.sid AND t.i = f.ts[2]
),
comma AS (
  SELECT sid, min(i) AS fc FROM word AS c WHERE pos = 'PUNCT' AND word = ',' AND i >= 1 AND i <= n - 2
         AND EXISTS (SELECT 1 FROM word AS f WHERE f.sid = c.sid AND f.i <= 1 AND f.pos = 'SCONJ') GROUP BY sid
),
finite AS (
  SELECT v.*, c.fc, d.twice,
         (h.dep = 'ROOT' AND v.dep = 'parataxis' AND {has('h.morph', 'VerbForm', 'Fin')} AND h.i - v.i < 3)
         OR v.dep IN {CCOMP} OR (v.dep IN ('aux', 'aux:tense') AND h.dep IN {CCOMP})
         OR EXISTS (SELECT 1 FROM word AS m WHERE m.sid = v.sid AND m.i < v.i AND m.dep = 'mark' AND m.pos = 'SCONJ'
                    AND (m.hhead = v.i OR (v.head = m.head AND v.i <> m.head))) AS passed_over,
         (v.dep = 'conj' AND NOT v.cc_kid) OR (h.dep = 'conj' AND NOT h.cc_kid) AS overrides
  FROM word AS v JOIN word AS h ON h.sid = v.sid AND h.i = v.head LEFT JOIN comma AS c ON c.sid = v.sid,
       (VALUES (0), (1)) AS d(twice)
  WHERE NOT v.skipped AND CASE WHEN d.twice = 0 THEN v.fin
        ELSE v.language = 'dutch' AND v.dep = 'ROOT' AND v.pos = 'VERB' AND starts_with(v.word, 'be') AND ends_with(v.word, 'd') END
),
folded AS (
  SELECT f.sid, list_reduce(
           [{{'v': NULL::BIGINT, 's': NULL::BIGINT, 'o': FALSE, 'd': FALSE, 'verb': NULL::BIGINT, 'subj': NULL::BIGINT}}]
           || list({{'v': f.i, 's': s.s, 'o': f.overrides, 'd': f.language = 'french' AND f.low IN ({quoted(*vocab.french_il_drop_verbs)}),
                     'verb': NULL::BIGINT, 'subj': NULL::BIGINT}}
                   ORDER BY CASE WHEN f.fc IS NULL OR f.i >= f.fc THEN 0 ELSE 1 END, f.i, f.twice),
           lambda acc, el: {{'v': el.v, 's': el.s, 'o': el.o, 'd': el.d,
                     'verb': CASE WHEN el.s IS NOT NULL AND (acc.verb IS NULL OR el.o) THEN el.v WHEN el.s IS NULL AND el.d THEN el.v ELSE acc.verb END,
                     'subj': CASE WHEN el.s IS NOT NULL AND (acc.verb IS NULL OR el.o) THEN el.s ELSE acc.subj END}}) AS m
  FROM finite AS f LEFT JOIN subject AS s ON s.sid = f.sid AND s.v = f.i WHERE NOT f.passed_over GROUP BY f.sid
),
verb AS (
  SELECT s.*, CASE WHEN r.dep = 'ROOT' THEN f.m.verb END AS mv, CASE WHEN r.dep = 'ROOT' THEN f.m.subj END AS ms
  FROM whole AS s JOIN word AS r ON r.sid = s.sid AND r.i = s.root LEFT JOIN folded AS f ON f.sid = s.sid
),
inverted AS (
  SELECT m.*, CASE WHEN m.language = 'french' AND contains(substr(lower(m.stext), 1, 20), 'est-ce') THEN TRUE
                   WHEN m.mv IS NULL OR m.ms IS NULL THEN NULL
                   WHEN EXISTS (SELECT 1 FROM word AS x WHERE x.sid = m.sid AND x.i < m.mv AND x.dep = 'mark' AND x.pos = 'SCONJ' AND x.head = m.mv) THEN NULL
                   WHEN m.language = 'dutch' AND v.first_advmod < m.mv THEN FALSE
                   ELSE m.mv < m.ms OR s.whlemma END AS inv
  FROM verb AS m LEFT JOIN word AS v ON v.sid = m.sid AND v.i = m.mv LEFT JOIN word AS s ON s.sid = m.sid AND s.i = m.ms
),
endings AS (SELECT sid, array_to_string(list(pos ORDER BY i DESC)[1:4], ' ') AS last4, list(word || ws ORDER BY i) AS pieces FROM word GROUP BY sid),
clause AS MATERIALIZED (
  SELECT *, CASE WHEN language = 'english' AND (last4 = 'PUNCT PRON PART AUX' OR starts_with(last4 || ' ', 'PUNCT PRON AUX ')) THEN TRUE
                 WHEN language = 'french' AND ends_with(bare, ' ou non') THEN NOT coalesce(inv, FALSE)
                 WHEN qm AND ({" OR ".join(f"(language = '{x}' AND ends_with(bare, {quoted(t)}))" for x, ts in vocab.tag_questions.items() for t in ts)}) THEN TRUE
                 ELSE FALSE END AS tagq
  FROM (SELECT *, regexp_replace(stext, '^[^{W}]+|[^{W}]+$', '', 'g') AS bare FROM inverted JOIN endings USING (sid))
)"""

_REST20 = ("CASE WHEN {x}.dep = 'cc' AND {x}.pos = 'CCONJ' AND {x}.hdep = 'conj' THEN FALSE WHEN {x}.pos = 'CCONJ' AND {x}.dep = 'fixed' THEN FALSE "
           "WHEN {x}.dep = 'xcomp' AND {x}.i = 0 THEN FALSE "
           "WHEN {x}.dep = 'advmod' AND {x}.i = 0 AND {x}.head = 1 AND {x}.head_has_obj THEN FALSE ELSE TRUE END")


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^[{Z}]+|[{Z}]+$', '', 'g')"


def _hit(pairs: str) -> str:
    """Does an earlier word tagged ``indirect`` pass L20 for the same embedder?"""
    return (f"list_reduce([{{'x': -1::BIGINT, 'pre': NULL::BOOLEAN, 'cc': FALSE, 'rest': FALSE, 'hit': FALSE}}] || "
            f"list_filter(coalesce({pairs}, []), lambda el: list_contains(w.ind, el.x) AND el.x < q.i), "
            "lambda acc, el: {'x': el.x, 'pre': el.pre, 'cc': el.cc, 'rest': el.rest, "
            "'hit': acc.hit OR CASE WHEN el.pre IS NOT NULL THEN el.pre WHEN el.cc AND acc.hit THEN FALSE ELSE el.rest END}).hit")


def _passes(e: str) -> str:
    """L20 of the word in hand for its candidate ``e`` (b or w)."""
    return f"CASE WHEN q.{e}_pre IS NOT NULL THEN q.{e}_pre WHEN q.cc AND {_hit(f'q.{e}_pairs')} THEN FALSE ELSE q.rest END"


#: The tags of question words, in steps from left to right, then L26.
TAGS = rf"""
subjects AS (
  SELECT s.sid, s.v AS i, bool_or(t.exist) AS ex, bool_or(t.imp) AS imp, bool_or(t.who) AS who, bool_or(t.spk) AS spk, bool_or(t.adr) AS adr
  FROM subj AS s JOIN word AS t ON t.sid = s.sid AND t.i = s.t GROUP BY s.sid, s.v
),
heads_question AS MATERIALIZED (
  SELECT e.sid, e.i, coalesce((
      (e.know AND ((c.qm AND NOT c.tagq AND e.present AND (s.who OR s.adr OR s.ex OR s.imp))
                   OR (NOT (c.qm AND NOT c.tagq) AND (s.sid IS NULL OR s.spk) AND e.negated AND e.present) OR e.wanted))
      OR (e.see AND c.qm AND NOT c.tagq AND NOT e.present AND (s.who OR s.adr OR s.ex))
      OR (e.wonder AND ((NOT (c.qm AND NOT c.tagq) AND (s.sid IS NULL OR s.spk OR s.imp) AND e.present)
                        OR (c.qm AND NOT c.tagq AND (s.ex OR s.imp OR s.adr) AND e.present)))
      OR (e.qnoun AND NOT (c.qm AND NOT c.tagq) AND e.present AND NOT {has('e.morph', 'Number', 'Plur')})
      OR (e.info AND e.present)
      OR (e.ask AND NOT (c.qm AND NOT c.tagq) AND (s.ex OR s.sid IS NULL OR s.spk OR s.imp)))
    AND NOT coalesce(e.first_sconj < e.i, FALSE), FALSE) AS likely
  FROM word AS e JOIN clause AS c ON c.sid = e.sid LEFT JOIN subjects AS s ON s.sid = e.sid AND s.i = e.i WHERE e.emb
),
qword AS MATERIALIZED (
  SELECT t.*, row_number() OVER (PARTITION BY t.sid ORDER BY t.i) AS k, h.verblike AS hverblike, h.emb AS hemb, h.v_kid AS hvkid,
         h.cop_kid AS hcop, h.obj_kid AS head_has_obj, h.ccs AS hccs, hh.i AS hh, hh.pos AS hhpos, hh.dep AS hhdep, hh.emb AS hhemb,
         hh.head AS hhh, hhh.emb AS hhhemb, r.emb AS remb, m.head AS mvhead, c.mv, c.pieces, c.exclaims,
         p1.low AS low1, p2.low AS low2, p1.dep AS dep1, p1.head AS head1, n1.low AS nlow, n1.pos AS npos, n1.morph AS nmorph, n1.lemma AS nlemma,
         hp.pos AS before_hh
  FROM word AS t JOIN clause AS c ON c.sid = t.sid JOIN word AS h ON h.sid = t.sid AND h.i = t.head
       JOIN word AS hh ON hh.sid = t.sid AND hh.i = h.head JOIN word AS hhh ON hhh.sid = t.sid AND hhh.i = hh.head
       JOIN word AS r ON r.sid = t.sid AND r.i = t.root LEFT JOIN word AS m ON m.sid = t.sid AND m.i = c.mv
       LEFT JOIN word AS p1 ON p1.sid = t.sid AND p1.i = t.i - 1 LEFT JOIN word AS p2 ON p2.sid = t.sid AND p2.i = t.i - 2
       LEFT JOIN word AS n1 ON n1.sid = t.sid AND n1.i = t.i + 1 LEFT JOIN word AS hp ON hp.sid = t.sid AND hp.i = hh.i - 1
  WHERE t.pqw
),
way AS MATERIALIZED (
  WITH RECURSIVE up AS (
    SELECT sid, i AS t, head AS a, 1 AS d FROM qword WHERE head <> i
    UNION ALL SELECT u.sid, u.t, x.head, u.d + 1 FROM up AS u JOIN word AS x ON x.sid = u.sid AND x.i = u.a WHERE x.head <> x.i
  ) SELECT * FROM up
),
noun_kid AS (SELECT sid, head AS i, min(i) AS noun FROM word WHERE head <> i AND dep IN {OBJ} AND pos = 'NOUN' AND emb GROUP BY sid, head),
decisive AS (
  SELECT u.sid, u.t, u.d,
         CASE WHEN x.verblike AND x.emb AND s.v IS NULL AND NOT (q.head = x.i AND q.dep = 'mark') AND x.dep NOT IN {CCOMP} THEN 'verb'
              WHEN x.dep = 'obl' AND nk.noun IS NOT NULL THEN 'noun' WHEN x.dep = 'nmod' AND xh.emb THEN 'noun' END AS kind,
         CASE WHEN x.verblike AND x.emb AND s.v IS NULL AND NOT (q.head = x.i AND q.dep = 'mark') AND x.dep NOT IN {CCOMP} THEN x.i
              WHEN x.dep = 'obl' AND nk.noun IS NOT NULL THEN nk.noun WHEN x.dep = 'nmod' AND xh.emb THEN xh.i END AS e
  FROM way AS u JOIN word AS x ON x.sid = u.sid AND x.i = u.a JOIN word AS xh ON xh.sid = u.sid AND xh.i = x.head
       JOIN qword AS q ON q.sid = u.sid AND q.i = u.t LEFT JOIN subj AS s ON s.sid = u.sid AND s.v = x.i AND s.t = u.t
       LEFT JOIN noun_kid AS nk ON nk.sid = u.sid AND nk.i = x.head
),
walk AS (SELECT sid, t, arg_min(kind, d) AS walk_kind, arg_min(e, d) AS w FROM decisive WHERE kind IS NOT NULL GROUP BY sid, t),
early AS (SELECT q.sid, q.i AS t, arg_min(y.i, y.i) AS y, arg_min(y.emb, y.i) AS yemb FROM qword AS q JOIN word AS y ON y.sid = q.sid AND y.i < q.i
          WHERE y.pos = 'VERB' AND y.dep IN ('nsubj', 'parataxis') GROUP BY q.sid, q.i),
aux_emb AS (SELECT sid, head AS i, min(i) AS aux FROM word WHERE head <> i AND dep IN ('aux', 'aux:tense') AND emb GROUP BY sid, head),
above AS (SELECT u.sid, u.t, bool_or(x.dep = 'ccomp') AS ccomp_above FROM way AS u JOIN word AS x ON x.sid = u.sid AND x.i = u.a GROUP BY u.sid, u.t),
options AS MATERIALIZED (
  SELECT q.*, coalesce(ab.ccomp_above, FALSE) AS ccomp_above, CASE WHEN ea.yemb THEN ea.y END AS a, wk.walk_kind, wk.w,
         CASE WHEN q.dep = 'advmod' AND q.head = q.root AND q.remb AND q.root < q.i THEN q.root
              WHEN q.hdep = 'acl:relcl' AND q.hverblike AND q.hhdep = 'obj' AND q.hhhemb THEN q.hhh
              WHEN q.hdep IN ('obj', 'advcl', 'acl:relcl', 'ccomp') AND q.hverblike AND q.hhemb THEN q.hh
              WHEN q.dep IN ('obj', 'advcl', 'acl:relcl', 'ccomp') AND q.hemb AND q.hdep NOT IN {CCOMP} THEN q.head
              WHEN contains('nummod', q.dep) AND q.hhemb AND q.hdep = 'parataxis' THEN q.hh
              WHEN q.hdep = 'ROOT' AND NOT q.hemb THEN ax.aux END AS b,
         q.dep = 'cc' AND q.pos = 'CCONJ' AS cc, {_REST20.format(x='q')} AS rest
  FROM qword AS q LEFT JOIN early AS ea ON ea.sid = q.sid AND ea.t = q.i LEFT JOIN walk AS wk ON wk.sid = q.sid AND wk.t = q.i
       LEFT JOIN aux_emb AS ax ON ax.sid = q.sid AND ax.i = q.head LEFT JOIN above AS ab ON ab.sid = q.sid AND ab.t = q.i
),
embedder AS (SELECT DISTINCT sid, e FROM (SELECT sid, b AS e FROM options UNION ALL SELECT sid, w FROM options WHERE walk_kind = 'verb') WHERE e IS NOT NULL),
grand AS (SELECT c.sid, c.head AS e, flatten(list(c.marks)) AS grandmarks FROM word AS c WHERE c.head <> c.i AND c.marks IS NOT NULL GROUP BY c.sid, c.head),
pair AS MATERIALIZED (
  SELECT e.sid, e.e, x.i AS x, x.cc, x.rest,
         CASE WHEN len(list_filter(coalesce(w.neutrals, []), lambda c: c <> x.i)) > 0 THEN FALSE
              WHEN x.dep = 'mark' AND x.hh = e.e THEN TRUE
              WHEN len(list_filter(coalesce(g.grandmarks, []), lambda c: c <> x.i)) > 0 THEN FALSE
              WHEN len(list_filter(coalesce(w.marks, []), lambda c: c <> x.i)) > 0 THEN FALSE END AS pre
  FROM embedder AS e JOIN options AS x ON x.sid = e.sid JOIN word AS w ON w.sid = e.sid AND w.i = e.e
       LEFT JOIN grand AS g ON g.sid = e.sid AND g.e = e.e
),
pairs AS (SELECT sid, e, list({{'x': x, 'pre': pre, 'cc': cc, 'rest': rest, 'hit': FALSE}} ORDER BY x) AS ps FROM pair GROUP BY sid, e),
ready AS MATERIALIZED (
  SELECT q.sid, q.k, q.i, q.a, q.b, q.w, q.walk_kind, q.cc, q.rest, pb.pre AS b_pre, pw.pre AS w_pre,
         CASE WHEN q.cc THEN lb.ps END AS b_pairs, CASE WHEN q.cc THEN lw.ps END AS w_pairs, q.exclaims,
         coalesce(la.likely, FALSE) AS a_likely, coalesce(li.likely, FALSE) AS b_likely, coalesce(lk.likely, FALSE) AS w_likely,
         q.qm AND NOT q.only_emb AS direct, coalesce(q.dep IN {OBJ} AND q.hdep <> 'ccomp', FALSE) AS mnc,
         coalesce(CASE q.language
           WHEN 'dutch' THEN (q.i <= 1 AND q.low = 'wat' AND q.nlow = 'een')
             OR ((q.pos = 'DET' OR q.dep = 'det') AND q.npos = 'NOUN' AND {has('q.nmorph', 'Number', 'Plur')})
             OR (q.word = 'waar' AND q.pos = 'ADJ' AND q.cop_kid)
           WHEN 'french' THEN (q.i > 2 AND q.low2 = 'à' AND q.low1 = 'ce')
             OR ends_with(lower({_strip("array_to_string(q.pieces[1:q.i], '')")}), 'est -ce')
             OR ends_with(lower({_strip("array_to_string(q.pieces[1:q.i], '')")}), 'est ce')
             OR (q.word = 'ou' AND q.pos = 'CCONJ' AND q.dep = 'cc') OR (q.low = 'que' AND q.hdep = 'dep' AND NOT q.hvkid)
             OR starts_with(lower({_strip("array_to_string(q.pieces[q.i + 1:], '')")}), 'quand même')
             OR starts_with(lower({_strip("array_to_string(q.pieces[q.i + 1:], '')")}), 'quand bien même') END, FALSE) AS notq,
         coalesce(CASE WHEN q.dep = 'ROOT' THEN FALSE WHEN q.dep = 'nsubj' AND q.hdep = 'ROOT' THEN FALSE
              WHEN q.head = q.root AND (hk.cop_kid OR EXISTS (SELECT 1 FROM word AS o WHERE o.sid = q.sid AND o.head = q.head AND o.i <> q.head
                                                              AND o.dep = 'obj' AND o.cop_kid)) THEN TRUE
              WHEN q.dep = 'advmod' AND q.hdep = 'acl:relcl' AND q.hhpos = 'NOUN' THEN TRUE
              WHEN (q.dep IN {SUBJ} OR q.dep IN {OBJ}) AND q.hdep = 'acl:relcl'
                   AND (q.hhpos = 'NOUN' OR (q.hhpos = 'ADJ' AND q.hh > 1 AND q.before_hh = 'DET')) THEN TRUE
              WHEN q.hdep IN ('csubj', 'nsubj') THEN TRUE
              WHEN q.hdep = 'acl:relcl' AND q.hhpos = 'NOUN' AND q.i - 1 = q.hh THEN TRUE
              WHEN q.dep = 'mark' AND q.hdep = 'advcl' THEN TRUE
              WHEN q.dep = 'mark' AND q.dep1 = 'mark' AND q.head = q.head1 THEN TRUE
              WHEN q.language = 'dutch' AND q.lemma = 'wat' AND q.nlemma = 'er' THEN TRUE ELSE FALSE END, FALSE) AS relc,
         coalesce(q.mv IS NOT NULL AND q.hdep = 'conj' AND (q.hh = q.mv OR (q.mvhead = q.hh AND q.mv <> q.hh))
                  AND len(list_filter(coalesce(q.hccs, []), lambda c: c > q.mv AND c < q.i)) > 0, FALSE) AS conjoined,
         CASE WHEN q.mv IS NOT NULL THEN q.i < q.mv WHEN q.ccomp_above THEN FALSE
              WHEN q.hdep = 'acl:relcl' AND q.hh < q.i AND q.hhpos IN {V} THEN FALSE ELSE TRUE END AS before_verb
  FROM options AS q JOIN word AS hk ON hk.sid = q.sid AND hk.i = q.head
       LEFT JOIN pair AS pb ON pb.sid = q.sid AND pb.e = q.b AND pb.x = q.i LEFT JOIN pair AS pw ON pw.sid = q.sid AND pw.e = q.w AND pw.x = q.i
       LEFT JOIN pairs AS lb ON lb.sid = q.sid AND lb.e = q.b LEFT JOIN pairs AS lw ON lw.sid = q.sid AND lw.e = q.w
       LEFT JOIN heads_question AS la ON la.sid = q.sid AND la.i = q.a LEFT JOIN heads_question AS li ON li.sid = q.sid AND li.i = q.b
       LEFT JOIN heads_question AS lk ON lk.sid = q.sid AND lk.i = q.w
),
tagged AS MATERIALIZED (
  WITH RECURSIVE w AS (
    SELECT sid, CAST(0 AS BIGINT) AS k, CAST(-1 AS BIGINT) AS i, CAST(NULL AS VARCHAR) AS tag, CAST([] AS BIGINT[]) AS ind, FALSE AS fr
    FROM (SELECT DISTINCT sid FROM ready)
    UNION ALL
    SELECT sid, k, i, tag, CASE WHEN tag = 'indirect' THEN list_append(ind, i) ELSE ind END, fr OR tag = 'fronted'
    FROM (SELECT sid, k, i, ind, fr,
                 CASE WHEN notq THEN 'no' WHEN direct AND front AND NOT relc AND (e IS NULL OR mnc) THEN 'fronted'
                      WHEN e IS NOT NULL AND likely AND NOT exclaims THEN 'indirect'
                      WHEN direct AND NOT relc AND (e IS NULL OR mnc) THEN 'insitu' ELSE 'no' END AS tag
          FROM (SELECT *, CASE source WHEN 'a' THEN a WHEN 'b' THEN b WHEN 'w' THEN w END AS e,
                       CASE source WHEN 'a' THEN a_likely WHEN 'b' THEN b_likely WHEN 'w' THEN w_likely ELSE FALSE END AS likely
                FROM (SELECT q.*, w.ind, w.fr, CASE WHEN q.conjoined THEN w.fr ELSE q.before_verb END AS front,
                             CASE WHEN q.a IS NOT NULL THEN 'a' WHEN q.b IS NOT NULL AND {_passes('b')} THEN 'b'
                                  WHEN q.walk_kind = 'verb' AND {_passes('w')} THEN 'w' WHEN q.walk_kind = 'noun' THEN 'w' END AS source
                      FROM w JOIN ready AS q ON q.sid = w.sid AND q.k = w.k + 1)))
  ) SELECT sid, i, tag FROM w WHERE i >= 0
),
found AS (
  SELECT t.sid, list(lower(x.word) ORDER BY t.i) FILTER (tag = 'fronted') AS fronted, list(lower(x.word) ORDER BY t.i) FILTER (tag = 'insitu') AS insitu,
         list(lower(x.word) ORDER BY t.i) FILTER (tag = 'indirect') AS indirect
  FROM tagged AS t JOIN word AS x ON x.sid = t.sid AND x.i = t.i GROUP BY t.sid
),
classed AS MATERIALIZED (
  SELECT *, CASE WHEN indirect IS NOT NULL THEN 'indirect' WHEN structure <> 'decl' THEN 'direct' ELSE 'no' END AS use,
         CASE WHEN indirect IS NOT NULL THEN indirect ELSE literal END AS functional
  FROM (SELECT c.*, indirect, coalesce(fronted, []) || coalesce(insitu, []) AS literal,
               CASE WHEN tagq AND fronted IS NULL AND insitu IS NULL THEN 'tag' WHEN fronted IS NOT NULL THEN 'wh' WHEN insitu IS NOT NULL THEN 'insitu'
                    WHEN qm THEN CASE WHEN inv IS NULL THEN 'elliptic' WHEN inv THEN 'polar' ELSE 'risingdecl' END ELSE 'decl' END AS structure
        FROM clause AS c LEFT JOIN found USING (sid))
)"""

RULES = f"{FACTS}, {MATRIX}, {TAGS}"


def with_parses(select: str) -> str:
    """``select`` over the parses and classes of the question candidates."""
    return f"WITH RECURSIVE {O.posts_cte()}, {O.SENTENCES_CTE}, {PARSE}, {RULES}{select if select.startswith(',') else ' ' + select}"
