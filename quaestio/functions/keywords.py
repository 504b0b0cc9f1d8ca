"""Whole-word keyword search.

A term list becomes one case-insensitive alternation. Word boundaries are written
out explicitly instead of using ``\\b`` so that Java (Spark) and RE2 (DuckDB) agree
with Unicode-aware word semantics:

* a term edge that is a word character needs a non-word character or the text edge
  next to it: ``(?:^|[^W])`` / ``(?:$|[^W])``;
* a term edge that is *not* a word character (``qu'``) needs a word character next
  to it, because a boundary between two non-word characters does not exist.

``W`` is ``\\p{L}\\p{N}_``. The pattern consumes the neighbouring character, which
is harmless: it is only ever used as an existence test (``rlike``).
"""

from __future__ import annotations

import functools
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from quaestio.functions import vocab

WORD_CLASS = r"\p{L}\p{N}_"


def _is_word_char(ch: str) -> bool:
    return ch == "_" or unicodedata.category(ch)[0] in ("L", "N")


def _left_edge(term: str) -> str:
    return f"(?:^|[^{WORD_CLASS}])" if _is_word_char(term[0]) else f"[{WORD_CLASS}]"


def _right_edge(term: str) -> str:
    return f"(?:$|[^{WORD_CLASS}])" if _is_word_char(term[-1]) else f"[{WORD_CLASS}]"


@functools.lru_cache(maxsize=None)
def keyword_pattern(terms: tuple[str, ...], dialect: str = "spark") -> str | None:
    """Alternation of whole-word ``terms``; ``None`` for an empty list (never matches).

    ``dialect`` is ``"spark"`` (Java, flags ``(?iu)``) or ``"duckdb"`` (RE2, ``(?i)``).
    """
    if not terms:
        return None
    if dialect == "spark":  # terms of equal edges share them: an edge is tested once a place, not once a term
        edges: dict[tuple[str, str], list[str]] = {}
        for t in terms:
            edges.setdefault((_left_edge(t), _right_edge(t)), []).append(f"(?:{t})")
        return "(?iu)(?:" + "|".join(f"{left}(?:{'|'.join(ts)}){right}" for (left, right), ts in edges.items()) + ")"
    body = "|".join(f"{_left_edge(t)}(?:{t}){_right_edge(t)}" for t in terms)
    return f"(?i)(?:{body})"


def has_any_keyword(text: Column, terms) -> Column:
    """``text`` contains any of ``terms`` as a whole word."""
    pattern = keyword_pattern(tuple(terms))
    if pattern is None:
        return F.lit(False)
    return text.rlike(pattern)


def has_any_keyword_by_language(text: Column, language: Column, category: str) -> Column:
    """Per-row choice of the term list by language; unknown language -> NULL (Q3)."""
    table = vocab.terms_by_language(category)
    expr = None
    for lang in vocab.LANGUAGES:
        branch = has_any_keyword(text, table.get(lang, []))
        expr = F.when(language == lang, branch) if expr is None else expr.when(language == lang, branch)
    return expr


def has_any_tag_by_language(tags: Column, language: Column, category: str) -> Column:
    """The tag array holds any of the category's terms (exact element equality)."""
    table = vocab.terms_by_language(category)
    safe_tags = F.coalesce(tags, F.array().cast("array<string>"))
    expr = None
    for lang in vocab.LANGUAGES:
        terms = table.get(lang, [])
        branch = F.exists(safe_tags, _member_of(terms)) if terms else F.lit(False)
        expr = F.when(language == lang, branch) if expr is None else expr.when(language == lang, branch)
    return expr


def _member_of(terms):
    return lambda x: x.isin(terms)


def duckdb_keyword_case(text_sql: str, language_sql: str, category: str) -> str:
    """The DuckDB twin of :func:`has_any_keyword_by_language`, as a SQL expression."""
    table = vocab.terms_by_language(category)
    parts = []
    for lang in vocab.LANGUAGES:
        pattern = keyword_pattern(tuple(table.get(lang, [])), "duckdb")
        if pattern is None:
            cond = "FALSE"
        else:
            cond = f"regexp_matches({text_sql}, '{_sql_quote(pattern)}')"
        parts.append(f"WHEN {language_sql} = '{lang}' THEN {cond}")
    return "(CASE " + " ".join(parts) + " END)"


def duckdb_tag_case(tags_sql: str, language_sql: str, category: str) -> str:
    table = vocab.terms_by_language(category)
    parts = []
    for lang in vocab.LANGUAGES:
        terms = table.get(lang, [])
        arr = "[" + ", ".join(f"'{_sql_quote(t)}'" for t in terms) + "]::VARCHAR[]"
        parts.append(f"WHEN {language_sql} = '{lang}' THEN len(list_intersect(coalesce({tags_sql}, []::VARCHAR[]), {arr})) > 0")
    return "(CASE " + " ".join(parts) + " END)"


def _sql_quote(s: str) -> str:
    return s.replace("'", "''")
