"""Pieces of oracle SQL (DuckDB) that several oracles share."""

from __future__ import annotations

from sparrowdoc.functions.text import STOP_WORDS


def quoted(words: list[str]) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def tokens(c: str) -> str:
    cut = f"string_split(trim(regexp_replace(regexp_replace(lower({c}), '[^\\p{{L}}\\p{{N}}_\\s.\\-]', ' ', 'g'), '\\s+', ' ', 'g')), ' ')"
    kept = f"list_filter({cut}, lambda t: length(t) >= 2 OR regexp_matches(t, '^\\p{{N}}+$'))"
    return f"flatten(list_transform({kept}, lambda t: CASE WHEN contains(t, '-') AND length(t) > 3 THEN list_concat([t], string_split(t, '-')) ELSE [t] END))"


def content_terms(c: str) -> str:
    return f"list_filter({tokens(c)}, lambda t: t NOT IN ({quoted(STOP_WORDS)}))"


def clean(c: str) -> str:
    return f"trim(regexp_replace({c}, '\\s+', ' ', 'g'))"
