"""Surfaces of words: tokens with boundaries, normal spelling, lookup key, marked vowel lengths."""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass

MACRON, BREVE = "̄", "̆"
VOWELS = frozenset("aeiouy")
LIGATURES = {"æ": "ae", "œ": "oe"}
#: Boundary flags of the separators after a token; a set is the sum of its flags.
BOUNDARIES = {
    "whitespace": 1, "comma": 2, "semicolon": 4, "colon": 8, "period": 16, "question": 32, "exclamation": 64,
    "apostrophe": 128, "dash": 256, "quote": 512, "bracket": 1024, "other": 2048,
}
#: Separators between which no compound stands.
BLOCKING = sum(BOUNDARIES[k] for k in ("comma", "semicolon", "colon", "period", "question", "exclamation", "apostrophe", "dash", "other"))
#: Characters of each flag, with full-width and Arabic forms.
MARKS = {
    "comma": ",،，、", "semicolon": ";؛；", "colon": ":：", "period": ".。．", "question": "?؟？", "exclamation": "!！",
    "apostrophe": "'’ʼ", "dash": "-–—‐‑", "quote": "\"“”„«»‹›‘", "bracket": "()[]{}（）",
}
FLAG_OF = {c: BOUNDARIES[k] for k, cs in MARKS.items() for c in cs}


def boundary_flag(char: str) -> int:
    """The flag of a separator; 0 for what belongs to a word."""
    if char.isspace():
        return BOUNDARIES["whitespace"]
    if char in FLAG_OF:
        return FLAG_OF[char]
    kind = unicodedata.category(char)
    return BOUNDARIES["other"] if kind[0] in "PSZC" and kind != "Cf" else 0


@dataclass(frozen=True)
class Token:
    text: str
    begin: int
    end: int
    boundary: int


def tokenize(line: str) -> list[Token]:
    """Runs of word characters with UTF-8 byte offsets and the flags of all separators after them."""
    out, at, k, n = [], 0, 0, len(line)
    flags = [boundary_flag(c) for c in line]
    widths = [len(c.encode("utf-8", "replace")) for c in line]
    while k < n:
        if flags[k]:
            at += widths[k]
            k += 1
            continue
        first, begin = k, at
        while k < n and not flags[k]:
            at += widths[k]
            k += 1
        end, boundary, j = at, 0, k
        while j < n and flags[j]:
            boundary |= flags[j]
            j += 1
        out.append(Token(line[first:k], begin, end, boundary))
    return out


@dataclass(frozen=True)
class Surface:
    """status is ok, empty-input, unsupported-character or invalid-vowel-quantity; known and long are
    masks over the letters of lookup, which stop at 62 letters."""

    status: str
    normalized: str = ""
    orthography: str = ""
    lookup: str = ""
    known: int = 0
    long: int = 0


def lex(text: str) -> Surface:
    """The spellings of a word: marked (composed, lower case), plain letters, and the lookup key with
    j as i and v as u; and which of its vowels are marked long or short."""
    if not text:
        return Surface("empty-input")
    if text.isascii():
        if not text.isalpha():
            return Surface("unsupported-character")
        plain = text.lower()
        return Surface("ok", plain, plain, plain.translate(_FOLD))
    letters: list[str] = []
    marks: list[str] = []
    for c in unicodedata.normalize("NFD", text).lower():
        if c in LIGATURES:
            letters += LIGATURES[c]
            marks += ["", ""]
        elif c in (MACRON, BREVE):
            if not letters or letters[-1] not in VOWELS or marks[-1]:
                return Surface("invalid-vowel-quantity")
            marks[-1] = c
        elif c.isascii() and c.isalpha():
            letters.append(c)
            marks.append("")
        else:
            return Surface("unsupported-character")
    plain = "".join(letters)
    normalized = unicodedata.normalize("NFC", "".join(a + b for a, b in zip(letters, marks, strict=True)))
    known = sum(1 << k for k, m in enumerate(marks[:62]) if m)
    long = sum(1 << k for k, m in enumerate(marks[:62]) if m == MACRON)
    return Surface("ok", normalized, plain, plain.translate(_FOLD), known, long)


_FOLD = str.maketrans("jv", "iu")


def render(letters: str, known: int, long: int) -> str:
    """Letters with their known vowel lengths marked, composed."""
    out = [c + (MACRON if long >> k & 1 else BREVE) if known >> k & 1 and c in VOWELS else c for k, c in enumerate(letters)]
    return unicodedata.normalize("NFC", "".join(out))
