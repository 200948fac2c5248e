"""Letters and what they are in ASCII: one table for column expressions and for names on the driver.

Latin, Greek and Cyrillic letters with accents are as their base letters; kana and Hangul syllables are as in their
Unicode names. Letters of other scripts are not in the table and stay.
"""

from __future__ import annotations

import unicodedata

# Latin letters without a canonical decomposition.
LATIN = {
    "ß": "ss", "æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE", "ø": "o", "Ø": "O", "đ": "d", "Đ": "D",
    "ł": "l", "Ł": "L", "þ": "th", "Þ": "Th", "ð": "d", "Ð": "D", "ı": "i",
}
# Greek letters.
GREEK = {
    "α": "a", "β": "v", "γ": "g", "δ": "d", "ε": "e", "ζ": "z", "η": "i", "θ": "th", "ι": "i", "κ": "k", "λ": "l", "μ": "m",
    "ν": "n", "ξ": "x", "ο": "o", "π": "p", "ρ": "r", "σ": "s", "ς": "s", "τ": "t", "υ": "y", "φ": "f", "χ": "ch", "ψ": "ps", "ω": "o",
}
# Cyrillic letters.
CYRILLIC = {
    "а": "a", "б": "b", "в": "v", "г": "g", "д": "d", "е": "e", "ж": "zh", "з": "z", "и": "i", "к": "k", "л": "l", "м": "m", "н": "n",
    "о": "o", "п": "p", "р": "r", "с": "s", "т": "t", "у": "u", "ф": "f", "х": "kh", "ц": "ts", "ч": "ch", "ш": "sh", "щ": "shch",
    "ъ": "", "ы": "y", "ь": "", "э": "e", "ю": "yu", "я": "ya", "є": "ye", "і": "i", "ґ": "g", "ђ": "dj", "ј": "j", "љ": "lj",
    "њ": "nj", "ћ": "c", "џ": "dz", "ѕ": "dz",
}
HANGUL = ("가", "힣")
MARKS = "".join(map(chr, range(0x300, 0x370)))  # combining marks, of accents that are spelt apart


def _romanised(ch: str) -> str:
    return unicodedata.name(ch).split()[-1].lower()


def _table() -> dict[str, str]:
    known = dict(LATIN)
    for letters in (GREEK, CYRILLIC):
        for ch, name in letters.items():
            known[ch] = name
            known.setdefault(ch.upper(), name.capitalize())
    for code in [*range(0x3041, 0x3097), *range(0x30A1, 0x30FB)]:
        known[chr(code)] = _romanised(chr(code))
    for code in range(0xC0, 0x2000):
        ch = chr(code)
        base = unicodedata.normalize("NFD", ch)[0]
        if ch not in known and base != ch and (base.isascii() or base in known):
            known[ch] = known.get(base, base)
    return known | dict.fromkeys(MARKS, "")


#: Letter → ASCII text, of no, one or several characters.
TABLE = _table()

# A Hangul syllable is an initial, a vowel and a final, in this order of code points: first + 588 · i + 28 · v + f.
INITIALS, VOWELS, FINALS = 19, 21, 28
_FIRST = ord(HANGUL[0])
HANGUL_INITIALS = [_romanised(chr(_FIRST + VOWELS * FINALS * i))[:-1] for i in range(INITIALS)]
HANGUL_VOWELS = [_romanised(chr(_FIRST + FINALS * v))[1:] for v in range(VOWELS)]
HANGUL_FINALS = [_romanised(chr(_FIRST + f))[2:] for f in range(FINALS)]


def fold(text: str) -> str:
    """Text with the letters of the table in ASCII; all else stays."""
    return "".join(_romanised(ch) if HANGUL[0] <= ch <= HANGUL[1] else TABLE.get(ch, ch) for ch in text)
