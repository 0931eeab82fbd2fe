"""Porter's stemmer (Program 14, 1980) and Unicode words, as one vectorised step over whole texts."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Suffixes and what stands for them, steps 2 to 4 of the published algorithm.
STEP2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous",
    "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble",
}
STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")
WORD = re.compile(r"[^\W_]+")


def _shape(stem: str) -> str:
    """c for each consonant and v for each vowel; a y after a consonant is a vowel."""
    out = ""
    for ch in stem:
        out += "v" if ch in "aeiou" or (ch == "y" and out.endswith("c")) else "c"
    return out


def _measure(stem: str) -> int:
    return len(re.findall("v+c", _shape(stem)))


def _short(stem: str) -> bool:
    """Ends consonant, vowel, consonant, the last not w, x or y."""
    return _shape(stem)[-3:] == "cvc" and stem[-1] not in "wxy"


def _longest(word: str, suffixes) -> str | None:
    return max((s for s in suffixes if word.endswith(s)), key=len, default=None)


def _ed_ing(word: str) -> str:
    for suffix in ("ed", "ing"):
        stem = word.removesuffix(suffix)
        if stem == word or "v" not in _shape(stem):
            continue
        if stem.endswith(("at", "bl", "iz")):
            return stem + "e"
        if _shape(stem)[-2:] == "cc" and stem[-1] == stem[-2] and stem[-1] not in "lsz":
            return stem[:-1]
        return stem + "e" if _measure(stem) == 1 and _short(stem) else stem
    return word


@lru_cache(maxsize=100_000)
def porter(word: str) -> str:
    """The stem of a lower-case word; words of one or two letters, and words that aren't of a to z, are their own."""
    if len(word) < 3 or not (word.isascii() and word.isalpha()):
        return word
    s = _longest(word, ("sses", "ies", "ss", "s"))
    word = word[:-2] if s in ("sses", "ies") else word[:-1] if s == "s" else word
    if word.endswith("eed"):
        word = word[:-1] if _measure(word[:-3]) else word
    else:
        word = _ed_ing(word)
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    for table in (STEP2, STEP3):
        s = _longest(word, table)
        if s and _measure(word[: -len(s)]):
            word = word[: -len(s)] + table[s]
    s = _longest(word, STEP4)
    if s and _measure(word[: -len(s)]) > 1 and (s != "ion" or word[: -len(s)].endswith(("s", "t"))):
        word = word[: -len(s)]
    if word.endswith("e"):
        stem = word[:-1]
        word = stem if _measure(stem) > 1 or (_measure(stem) == 1 and not _short(stem)) else word
    return word[:-1] if word.endswith("ll") and _measure(word[:-1]) > 1 else word


def stem_words(text: str) -> list[str]:
    """Stems of the words of a text in order: letters and digits of any script, lower-cased, without diacritics."""
    plain = text.lower()
    if not plain.isascii():
        apart = unicodedata.normalize("NFD", plain)
        marks = {ord(c): None for c in set(apart) if unicodedata.category(c) == "Mn"}
        plain = unicodedata.normalize("NFC", apart.translate(marks) if marks else apart)
    return list(map(porter, WORD.findall(plain)))


def stems(text: Column) -> Column:
    """Array of the stems of a text's words; null text has none. Select it as a column first: it isn't copied into later filters, so it runs once."""

    @F.pandas_udf("array<string>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield b.map(lambda t: stem_words(t) if t else [])

    return run.asNondeterministic()(text)
