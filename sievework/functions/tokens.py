"""The keyword index's tokens: words without case and accents, stemmed (Porter's algorithm, public since 1980)."""

from __future__ import annotations

import unicodedata

import regex

#: What belongs to a token: letters, marks, numbers, private-use characters.
TOKEN = regex.compile(r"[\p{L}\p{M}\p{N}\p{Co}]+")
LONGEST, SHORTEST = 64, 3
#: Porter's suffixes and what takes their place, the first match of each step.
STEP2 = "ational:ate tional:tion enci:ence anci:ance izer:ize logi:log bli:ble alli:al entli:ent eli:e ousli:ous ization:ize ation:ate ator:ate alism:al iveness:ive fulness:ful ousness:ous aliti:al iviti:ive biliti:ble"
STEP3 = "icate:ic ative: alize:al iciti:ic ical:ic ful: ness:"
STEP4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize"


class _Suffixes:
    """A table of suffixes, looked up by their lengths, the longest first. Most words are told by their last two letters."""

    def __init__(self, pairs: list[tuple[str, str]]):
        self.swaps = dict(pairs)
        self.lengths = sorted({len(a) for a in self.swaps}, reverse=True)
        self.last = {a[-2:] for a in self.swaps}

    def of(self, word: str) -> str | None:
        """The longest suffix that has something before it."""
        if word[-2:] in self.last:
            for n in self.lengths:
                if n < len(word) and word[-n:] in self.swaps:
                    return word[-n:]
        return None


_SWAPS = [_Suffixes([(a, b) for a, _, b in (x.partition(":") for x in step.split())]) for step in (STEP2, STEP3)]
_DROPS = _Suffixes([(a, "") for a in STEP4.split()])


_PLAIN = {c: "v" if chr(c) in "aeiou" else "c" for c in range(256)}


def _shape(word: str) -> str:
    """v for vowels, c for others; a y after a consonant is a vowel."""
    if "y" not in word:
        return word.translate(_PLAIN)
    out = ""
    for letter in word:
        out += "v" if letter in "aeiou" or (letter == "y" and out.endswith("c")) else "c"
    return out


def _measure(word: str) -> int:
    """How often a vowel is followed by a consonant."""
    return _shape(word).count("vc")


def _short(word: str) -> bool:
    """Ends in consonant, vowel, consonant, the last not w, x or y."""
    return _shape(word).endswith("cvc") and word[-1] not in "wxy"


def _ends(word: str, end: str) -> bool:
    """A suffix has something before it."""
    return len(word) > len(end) and word.endswith(end)


def _past(word: str) -> str:
    if _ends(word, "eed"):
        return word[:-1] if _measure(word[:-3]) > 0 else word
    for end in ("ing", "ed"):
        if _ends(word, end) and "v" in _shape(word[: -len(end)]):
            word = word[: -len(end)]
            if any(_ends(word, e) for e in ("at", "bl", "iz")):
                return word + "e"
            if len(word) > 1 and word[-1] == word[-2] and word[-1] not in "aeioulsz":
                return word[:-1]
            return word + "e" if _measure(word) == 1 and _short(word) else word
    return word


def stem(word: str) -> str:
    """The stem of a folded word. Letters outside ASCII count as their bytes."""
    raw = word.encode()
    if not SHORTEST <= len(raw) <= LONGEST:
        return word
    return _stemmed(word) if word.isascii() else _stemmed(raw.decode("latin-1")).encode("latin-1").decode("utf-8", "ignore")


def _stemmed(word: str) -> str:
    if _ends(word, "sses") or _ends(word, "ies"):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    word = _past(word)
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    for table in _SWAPS:
        end = table.of(word)
        if end and _measure(word[: -len(end)]) > 0:
            word = word[: -len(end)] + table.swaps[end]
    end = _DROPS.of(word)
    if end and _measure(rest := word[: -len(end)]) > 1 and (end != "ion" or rest.endswith(("s", "t"))):
        word = rest
    if word.endswith("e") and (_measure(word[:-1]) > 1 or _measure(word[:-1]) == 1 and not _short(word[:-1])):
        word = word[:-1]
    return word[:-1] if word.endswith("ll") and _measure(word[:-1]) > 1 else word


def folded(word: str) -> str:
    """Lower case, without accents on Latin letters; marks of other scripts are part of the word."""
    low = word.lower()
    if low.isascii():
        return low
    out = []
    for letter in low:
        plain = unicodedata.normalize("NFD", letter)
        out.append(plain[0] if len(plain) > 1 and plain[0].isascii() else letter)
    return "".join(c for k, c in enumerate(out) if not (0x300 <= ord(c) < 0x370))


class Tokens:
    """Tokens of texts; a worker remembers the words it has seen."""

    def __init__(self, most: int = 500_000):
        self.most, self.known = most, {}

    def one(self, word: str) -> str:
        """A word's token, empty if it is cut away whole."""
        token = self.known.get(word)
        if token is None:
            if len(self.known) > self.most:
                self.known.clear()
            plain = folded(word)
            token = self.known[word] = stem(plain) if plain else ""
        return token

    def of(self, text: str | None) -> list[str]:
        return [t for t in map(self.one, TOKEN.findall(text or "")) if t]
