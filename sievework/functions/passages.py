"""Matches in a text as it is written: spans, snippets, landmarks, garbled pages."""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections import Counter
from collections.abc import Sequence

import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .text import INFLECTING, normalize

MOST_SPANS, SNIPPET_WORDS = 500, 12
_MARKS = regex.compile(r"\p{Mn}")
_WORD = regex.compile(r"[\p{L}\p{M}\p{N}]")
# Dependent vowel signs of Bengali and Devanagari, and the letters that one follows.
VOWEL_SIGNS = r"[\x{9BE}-\x{9C4}\x{9C7}\x{9C8}\x{9CB}\x{9CC}\x{9D7}\x{9E2}\x{9E3}\x{93A}\x{93B}\x{93E}-\x{94C}\x{94E}\x{94F}\x{955}-\x{957}\x{962}\x{963}]"
CARRIERS = r"[\x{995}-\x{9B9}\x{9BC}\x{9CE}\x{9DC}\x{9DD}\x{9DF}\x{9F0}\x{9F1}\x{915}-\x{939}\x{93C}\x{958}-\x{95F}\x{979}-\x{97F}]"


class _Folds(dict):
    """What each letter, by its code point, is without case and marks; found once."""

    def __missing__(self, code: int) -> str:
        plain = normalize(chr(code))
        self[code] = plain if 0x0900 <= code <= 0x0DFF else _MARKS.sub("", unicodedata.normalize("NFD", plain.lower()))
        return self[code]


_FOLDS = _Folds()


def _folded(text: str) -> str:
    """Text without case, marks and invisible letters."""
    return text.translate(_FOLDS)


def _origin(text: str) -> Sequence[int]:
    """Where each letter of the folded text stands in the text."""
    if all(len(_FOLDS[ord(letter)]) == 1 for letter in set(text)):
        return range(len(text))
    return [at for at, letter in enumerate(text) for _ in _FOLDS[ord(letter)]]


def spans(word: str, text: str, hay: str | None = None) -> list[tuple[int, int]]:
    """Whole words that match, whatever their case and accents; in inflecting scripts the word that the match begins. hay:
    the folded text, where it is known."""
    needle, hay = _folded(word), _folded(text) if hay is None else hay
    if not needle or needle not in hay:
        return []
    origin, extends, found = _origin(text), bool(re.search(INFLECTING, word)), []
    at = hay.find(needle)
    while at >= 0 and len(found) < MOST_SPANS:
        start, end = origin[at], origin[at + len(needle) - 1] + 1
        while end < len(text) and unicodedata.combining(text[end]):
            end += 1
        begins = start == 0 or not _WORD.match(text[start - 1])
        ends = end == len(text) or not _WORD.match(text[end])
        if begins and extends:
            while end < len(text) and _WORD.match(text[end]):
                end += 1
        if begins and (ends or extends) and (not found or start >= found[-1][1]):
            found.append((start, end))
        at = hay.find(needle, at + len(needle))
    return found


def _best_window(places: list[tuple[int, int]], width: int) -> int:
    """The place at which the first window of `width` words begins that holds most different terms. places: (word, term) in
    the order of the text."""
    held, best, end = Counter(), (0, 0), 0
    for word, term in places:
        while end < len(places) and places[end][0] < word + width:
            held[places[end][1]] += 1
            end += 1
        best = max(best, (len(held), -word))
        held[term] -= 1
        if not held[term]:
            del held[term]
    return -best[1]


def snippet(text: str, terms: list[str], words: int = SNIPPET_WORDS) -> str | None:
    """About `words` words with most different terms, matches between guillemets."""
    hay = _folded(text)
    marks = sorted((s, k) for k, t in enumerate(terms) for s in spans(t, text, hay))
    if not marks:
        return None
    tokens = [m.span() for m in re.finditer(r"\S+", text)]
    ends, places = [e for _, e in tokens], []
    for (start, _), term in marks:
        places.append((bisect_right(ends, start), term))
    marks = [s for s, _ in marks]
    first = _best_window(places, words)
    lo = max(0, first - words // 3)
    shown = tokens[lo : lo + words + 1]
    out, at = "…" if lo else "", shown[0][0]
    for s, e in marks:
        if at <= s and e <= shown[-1][1]:
            out += text[at:s] + "«" + text[s:e] + "»"
            at = e
    out += text[at : shown[-1][1]] + ("…" if lo + words + 1 < len(tokens) else "")
    return re.sub(r"\s+", " ", out).strip()


def snippet_of(text: Column, terms: list[str], words: int = SNIPPET_WORDS) -> Column:
    """`snippet` of a column: meant for the few rows that a search returns."""

    @F.pandas_udf(StringType())
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: snippet(t, terms, words), na_action="ignore")

    return run(text)


def landmark(page: int, texts: list[str], words: list[str]) -> str | None:
    """A word that is on the page (from 1), best one that no earlier page has, as the page spells it."""
    if page < 2 or len(texts) < page:
        return None
    here = [(texts[page - 1][s[0][0] : s[0][1]]) for w in words if len(w) >= 3 and (s := spans(w, texts[page - 1]))]
    before = [normalize(t).lower() for t in texts[: page - 1]]
    return next((w for w in here if not any(normalize(w).lower() in t for t in before)), here[0] if here else None)


def page_problem(text: Column) -> Column:
    """glyphOrder: Indic vowel signs ahead of their consonants; lostLetters: Arabic letters lost after an alef."""
    signs, stray = F.regexp_count(text, F.lit(VOWEL_SIGNS)), F.regexp_count(text, F.lit(f"(?<!{CARRIERS}){VOWEL_SIGNS}"))
    lost = F.regexp_count(text, F.lit(r"\x{627}[?.\x{FFFD}](?=[\x{620}-\x{64A}\x{66E}-\x{6D3}])"))
    return F.when((signs >= 10) & (stray * 20 >= signs), "glyphOrder").when(lost >= 2, "lostLetters")
