"""Names and text: folding, standardising, distances."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import letters

# Legal forms cut off the end of company names.
LEGAL_SUFFIXES = (
    "inc", "incorporated", "llc", "ltd", "limited", "corp", "corporation", "co", "company", "plc",
    "gmbh", "ag", "sa", "sarl", "bv", "nv", "ab", "as", "oy", "spa", "srl", "pty", "pte", "lp", "llp",
)


def _one_to_one() -> tuple[str, str]:
    """Letters that are one ASCII letter, and those that go, which ``translate`` wants last and without a counterpart."""
    single = {ch: to for ch, to in letters.TABLE.items() if len(to) == 1}
    return "".join(single) + "".join(ch for ch, to in letters.TABLE.items() if not to), "".join(single.values())


_MARKED, _PLAIN = _one_to_one()
_LONGER = {ch: to for ch, to in letters.TABLE.items() if len(to) > 1}
REPLACED = 64  # different letters that are replaced one after the other in a text


def _spelt(letter: Column) -> Column:
    """A letter that takes several ASCII letters; any other one stays."""
    place = F.ascii(letter) - ord(letters.HANGUL[0])
    part = lambda names, at: F.get(F.array(*map(F.lit, names)), at.cast("int"))
    tail = letters.FINALS
    hangul = F.concat(part(letters.HANGUL_INITIALS, F.floor(place / (tail * letters.VOWELS))),
                      part(letters.HANGUL_VOWELS, F.floor(place / tail) % letters.VOWELS), part(letters.HANGUL_FINALS, place % tail))
    names = F.create_map(*[F.lit(x) for pair in _LONGER.items() for x in pair])
    return F.when(letter.between(*letters.HANGUL), hangul).otherwise(F.coalesce(F.try_element_at(names, letter), letter))


def _once(value: Column, use) -> Column:
    """``use(value)``, with the value worked out once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _spelt_out(text: Column) -> Column:
    """Letters that take several: each that occurs is replaced in the whole text; of texts with many, letter by letter."""
    found = F.array_distinct(F.split(F.regexp_replace(text, r"[\x00-\x7F]+", ""), ""))
    found = F.filter(found, lambda letter: letter.between(*letters.HANGUL) | letter.isin(list(_LONGER)))
    few = lambda found: F.aggregate(found, text, lambda out, letter: F.replace(out, letter, _spelt(letter)))
    many = F.array_join(F.transform(F.split(text, ""), _spelt), "")
    return _once(found, lambda found: F.when(F.size(found) <= REPLACED, few(found)).otherwise(many))


def ascii_fold(text: Column) -> Column:
    """Text with Latin, Greek, Cyrillic, kana and Hangul letters in ASCII (see ``letters``), on the JVM.

    Plain ASCII is passed on as it is, and so is what is plain once single letters are replaced. NULL stays.
    """
    plain = lambda x: F.octet_length(x) == F.char_length(x)
    out = _once(F.translate(text, _MARKED, _PLAIN), lambda x: F.when(plain(x), x).otherwise(_spelt_out(x)))
    return F.when(plain(text), text).otherwise(out)


@F.pandas_udf(T.StringType())
def ascii_fold_any(text: pd.Series) -> pd.Series:
    """Folding for other scripts: compatibility forms without marks, what stays non-ASCII dropped."""
    normal = text.str.normalize("NFKD")
    return normal.str.encode("ascii", "ignore").str.decode("ascii")


def strip_legal_suffix(name: Column) -> Column:
    ending = "|".join(LEGAL_SUFFIXES)
    return F.trim(F.regexp_replace(name, rf"(?:[\s,]+(?:{ending})\.?)+$", ""))


def standardize_name(name: Column) -> Column:
    """Folded, lower case, without legal form and punctuation."""
    folded = F.trim(F.lower(ascii_fold(name)))
    return F.regexp_replace(strip_legal_suffix(folded), r"\p{Punct}", "")


def first_token(name: Column) -> Column:
    return F.split(name, " ").getItem(0)


def normalized_levenshtein(a: Column, b: Column) -> Column:
    """Edit distance over the longer length; 0 for two empty texts, NULL when either is NULL."""
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(a.isNull() | b.isNull(), None).when(longer == 0, F.lit(0.0)).otherwise(F.levenshtein(a, b) / longer)


def path_segment(path: Column, index: int) -> Column:
    """Part ``index`` (from 0) of a slash-separated path, NULL when there is none."""
    return F.get(F.split(path, "/"), index)


def without_dashes(key: Column) -> Column:
    return F.replace(key, F.lit("-"), F.lit(""))


def present(text: Column) -> Column:
    """1 for a non-empty text, else 0."""
    return F.coalesce(text != "", F.lit(False)).cast("int")
