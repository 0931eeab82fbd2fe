"""English words for full-text search: Snowball's English stemmer (Porter 2) and stop words, with their places kept."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate, chain

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .groups import SLICE
from .stems import WORD

#: The common English stop list.
STOPS = frozenset("""
i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs themselves
what which who whom this that these those am is are was were be been being have has had having do does did doing a an the and but if or because as until while
of at by for with about against between into through during before after above below to from up down in out on off over under again further then once here there
when where why how all any both each few more most other some such no nor not only own same so than too very s t can will just don should now
""".split())  # fmt: skip
#: Fixed values of the published algorithm: whole words, suffixes of steps 2 to 4 and what stands for them, doubles, and letters that may stand before li.
WHOLE = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
    **{w: w for w in "sky news howe atlas cosmos bias andes".split()},
}
KEPT = frozenset("inning outing canning herring earring proceed exceed succeed".split())
STEP2 = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate",
    "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble",
    "ogi": "og", "fulli": "ful", "lessli": "less", "li": "",
}
STEP3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion")
DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
BEFORE_LI = "cdeghkmnrt"
_VOWEL = re.compile("[aeiouy]")
_REGION = re.compile("[aeiouy][^aeiouy]")
_SHORT = re.compile("(?:^[aeiouy][^aeiouy]|[^aeiouy][aeiouy][^aeiouywxY])$")


def _after(word: str, start: int) -> int:
    """Where the region begins that follows the first consonant after a vowel."""
    found = _REGION.search(word, start)
    return found.end() if found else len(word)


def _longest(word: str, suffixes) -> str:
    return max((s for s in suffixes if word.endswith(s)), key=len, default="")


def _plural(w: str) -> str:
    if w.endswith("sses"):
        return w[:-2]
    if w.endswith(("ied", "ies")):
        return w[:-2] if len(w) > 4 else w[:-1]
    if w.endswith(("us", "ss")) or not w.endswith("s"):
        return w
    return w[:-1] if _VOWEL.search(w[:-2]) else w


def _past(w: str, r1: int) -> str:
    s = _longest(w, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    stem = w[: len(w) - len(s)]
    if s in ("eed", "eedly"):
        return stem + "ee" if len(stem) >= r1 else w
    if not s or not _VOWEL.search(stem):
        return w
    if stem.endswith(("at", "bl", "iz")):
        return stem + "e"
    if stem.endswith(DOUBLES):
        return stem[:-1]
    return stem + "e" if len(stem) <= r1 and _SHORT.search(stem) else stem


@lru_cache(maxsize=200_000)
def stem(word: str) -> str:
    """The stem of a lower-case word; words of one or two letters are their own."""
    if len(word) < 3:
        return word
    if word in WHOLE:
        return WHOLE[word]
    w = re.sub("(?<=[aeiouy])y|^y", "Y", word.removeprefix("'"))
    r1 = next((len(p) for p in ("gener", "commun", "arsen") if w.startswith(p)), None) or _after(w, 0)
    r2 = _after(w, r1)
    for s in ("'s'", "'s", "'"):
        if w.endswith(s):
            w = w[: -len(s)]
            break
    w = _plural(w)
    if w in KEPT:
        return w
    w = _past(w, r1)
    if len(w) > 2 and w[-1] in "yY" and not _VOWEL.match(w[-2]):
        w = w[:-1] + "i"
    s = _longest(w, STEP2)
    head = w[: len(w) - len(s)]
    if s and len(head) >= r1 and (s != "ogi" or head.endswith("l")) and (s != "li" or head[-1:] in tuple(BEFORE_LI)):
        w = head + STEP2[s]
    s = _longest(w, STEP3)
    head = w[: len(w) - len(s)]
    if s and len(head) >= (r2 if s == "ative" else r1):
        w = head + STEP3[s]
    s = _longest(w, STEP4)
    head = w[: len(w) - len(s)]
    if s and len(head) >= r2 and (s != "ion" or head.endswith(("s", "t"))):
        w = head
    head = w[:-1]
    if w.endswith("e") and (len(head) >= r2 or (len(head) >= r1 and not _SHORT.search(head))) or w.endswith("ll") and len(head) >= r2:
        w = head
    return w.lower()


def places(text: str) -> list[str | None]:
    """A text's words in order as stems, with nothing in the place of a stop word."""
    return [None if w in STOPS else stem(w) for w in WORD.findall(text.lower())]


def query_words(text: str) -> list[str | None]:
    """Words of a query alike, without stop words at either end; those inside a phrase keep its words apart."""
    out = places(text)
    known = [i for i, w in enumerate(out) if w is not None]
    return out[known[0] : known[-1] + 1] if known else []


def tokens(text: Column) -> Column:
    """places() of each text; null text has none. A slice of a batch is worked on at a time, and each of its words is stemmed once."""

    @F.arrow_udf("array<string>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            step = max(1, len(b) * SLICE // max(b.nbytes, SLICE))
            for lo in range(0, len(b), step):
                found = [WORD.findall(t.lower()) if t else [] for t in b.slice(lo, step).to_pylist()]
                words = pa.array(chain.from_iterable(found), pa.string()).dictionary_encode()
                stems = pa.array([None if w in STOPS else stem(w) for w in words.dictionary.to_pylist()], pa.string())
                yield pa.ListArray.from_arrays(pa.array([0, *accumulate(map(len, found))], pa.int32()), stems.take(words.indices))

    return run.asNondeterministic()(text)
