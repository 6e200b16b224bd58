"""SQL fragments that state in SQL what ``functions.text`` builds, from the same fixed values."""

from __future__ import annotations

from folioforge.functions import text as T


def q(s: str) -> str:
    """A SQL literal."""
    return "'" + s.replace("'", "''") + "'"


def strip(x: str) -> str:
    return f"regexp_replace({x}, {q(f'^{T.WS}+|{T.WS}+$')}, '', 'g')"


def squeeze(x: str) -> str:
    return strip(f"regexp_replace({x}, {q(f'{T.WS}+')}, ' ', 'g')")


def tokens(x: str) -> str:
    return f"list_filter(regexp_split_to_array(coalesce({x}, ''), {q(f'{T.WS}+')}), lambda t: t <> '')"


def count(x: str, pattern: str) -> str:
    return f"len(regexp_extract_all({x}, {q(pattern)}))"


def like(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, {q(pattern)})"


def sub(x: str, pattern: str, to: str = "") -> str:
    return f"regexp_replace({x}, {q(pattern)}, {q(to)}, 'g')"


def hangul(x: str) -> str:
    return f"({count(x, T.HANGUL)}::DOUBLE / greatest(length({x}), 1))"
