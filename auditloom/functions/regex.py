"""Rule patterns are written with ECMAScript meaning; Spark runs java.util.regex.

``java_pattern`` keeps that meaning: ASCII word boundaries, the wider
ECMAScript white space, ``$`` only at the very end, and no class nesting.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

WHITE_SPACE = r"\t\n\x0B\f\r \u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF"
#: The characters of that class; trimming them looks at the ends of a text only, where a pattern is tried all along it.
_BLANKS = "\t\n\x0b\f\r \u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"
_EDGE = "(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"


@lru_cache(maxsize=None)
def java_pattern(pattern: str, ignore_case: bool = False) -> str:
    out: list[str] = []
    in_class = False
    chars = iter(range(len(pattern)))
    for i in chars:
        c = pattern[i]
        if c == "\\":
            nxt = pattern[next(chars)]
            if nxt == "s":
                out.append(WHITE_SPACE if in_class else f"[{WHITE_SPACE}]")
            elif nxt == "S" and not in_class:
                out.append(f"[^{WHITE_SPACE}]")
            elif nxt == "b" and not in_class:
                out.append(_EDGE)
            else:
                out.append("\\" + nxt)
        elif in_class:
            in_class = c != "]"
            out.append("\\" + c if c in "[&" else c)
        elif c == "[":
            in_class = True
            out.append(c)
        elif c == "$":
            out.append(r"\z")
        elif c == ".":
            out.append(r"[^\n\r\u2028\u2029]")
        else:
            out.append(c)
    return ("(?i)" if ignore_case else "") + "".join(out)


def has(col: Column, pattern: str) -> Column:
    """Case-insensitive search."""
    return col.rlike(java_pattern(pattern, True))


def has_cs(col: Column, pattern: str) -> Column:
    """Case-sensitive search."""
    return col.rlike(java_pattern(pattern))


#: Characters of prose, the most frequent first; any other is rarer than these.
_COMMON = " etaonirhsudl.cpgfbwymvkxzqj"


def _literal(text: str) -> str:
    return "".join(c if c.isalnum() or c == "_" else "\\" + c for c in text)


def words_pattern(words: Iterable[str]) -> str:
    """A pattern that finds any of ``words``, each by its rarest character first.

    A search stops only at those characters, looks one way for what follows and back for the
    whole word, so one run over a text takes the place of one run for each word.
    """
    by_rarest: dict[str, list[str]] = {}
    rank = {c: n for n, c in enumerate(_COMMON)}
    never = len(_COMMON)
    for word in dict.fromkeys(words):
        at = max(range(len(word)), key=lambda i: (rank.get(word[i], never), -i))
        behind = f"(?<={_literal(word)})" if at else ""
        by_rarest.setdefault(word[at], []).append(_literal(word[at + 1 :]) + behind)
    ways = [f"{_literal(c)}(?:{'|'.join(by_rarest[c])})" for c in sorted(by_rarest, key=lambda c: rank.get(c, never))]
    return f"(?=[{''.join(map(_literal, by_rarest))}])(?:{'|'.join(ways)})"


def strip(col: Column) -> Column:
    """Trim every kind of white space, not only blanks."""
    return F.btrim(col, F.lit(_BLANKS))


def squeeze(col: Column) -> Column:
    """Trim, then collapse inner white space to one blank."""
    return F.regexp_replace(strip(col), f"[{WHITE_SPACE}]+", " ")
