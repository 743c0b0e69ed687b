"""English stems: the published Snowball English rules, for words of a vocabulary rather than of every text."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The rules' exceptions and suffixes, and the words an English index leaves out.
EXCEPTIONS = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
    "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
UNCHANGED = ("inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed")
STEP_2 = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al",
    "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "ogi": "og", "fulli": "ful", "lessli": "less", "li": "",
}
STEP_3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
STEP_4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion")
ENGLISH_STOP = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs themselves what which who whom this that these those "
    "am is are was were be been being have has had having do does did doing a an the and but if or because as until while of at by for with about against between into through during before after above below "
    "to from up down in out on off over under again further then once here there when where why how all any both each few more most other some such no nor not only own same so than too very s t can will just don should now"
).split()
VOWELS, DOUBLES, LI_AFTER = "aeiouy", ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt"), "cdeghkmnrt"


def _region(word: str, begin: int) -> int:
    """The place after the first non-vowel that follows a vowel, from begin on."""
    for i in range(begin + 1, len(word)):
        if word[i] not in VOWELS and word[i - 1] in VOWELS:
            return i + 1
    return len(word)


def _short_end(word: str) -> bool:
    """Whether a word ends in a short syllable."""
    if len(word) == 2:
        return word[0] in VOWELS and word[1] not in VOWELS
    return len(word) > 2 and word[-3] not in VOWELS and word[-2] in VOWELS and word[-1] not in VOWELS + "wxY"


def _longest(word: str, suffixes) -> str | None:
    return max((s for s in suffixes if word.endswith(s)), key=len, default=None)


def stem(word: str) -> str:
    """The stem of a lower-case word without apostrophes."""
    if len(word) <= 2:
        return word
    if word in EXCEPTIONS:
        return EXCEPTIONS[word]
    w = "".join("Y" if c == "y" and (i == 0 or word[i - 1] in VOWELS and not (word[i - 1] == "y" and i == 1)) else c for i, c in enumerate(word))
    head = next((p for p in ("gener", "commun", "arsen") if w.startswith(p)), None)
    r1 = len(head) if head else _region(w, 0)
    r2 = _region(w, r1)
    has_vowel = lambda part: any(c in VOWELS for c in part)

    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and has_vowel(w[:-2]):
        w = w[:-1]
    if w in UNCHANGED:
        return w

    found = _longest(w, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    if found in ("eed", "eedly"):
        if len(w) - len(found) >= r1:
            w = w[: -len(found)] + "ee"
    elif found and has_vowel(w[: -len(found)]):
        w = w[: -len(found)]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif w.endswith(DOUBLES):
            w = w[:-1]
        elif r1 >= len(w) and _short_end(w):
            w += "e"
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in VOWELS:
        w = w[:-1] + "i"

    for table in (STEP_2, STEP_3):
        found = _longest(w, table)
        if found is None or len(w) - len(found) < r1:
            continue
        rest = w[: -len(found)]
        if found == "ogi" and not rest.endswith("l") or found == "li" and rest[-1:] not in tuple(LI_AFTER) or found == "ative" and len(rest) < r2:
            continue
        w = rest + table[found]
    found = _longest(w, STEP_4)
    if found and len(w) - len(found) >= r2 and (found != "ion" or w[:-3].endswith(("s", "t"))):
        w = w[: -len(found)]
    at = len(w) - 1
    if w.endswith("e") and (at >= r2 or at >= r1 and not _short_end(w[:-1])) or w.endswith("ll") and at >= r2:
        w = w[:-1]
    return w.lower()


@lru_cache(1 << 16)
def english_stem(word: str) -> str | None:
    """A word's stem, None for a stop word."""
    return None if word in ENGLISH_STOP else stem(word)


def stemmed(vocabulary: DataFrame, term: str = "term") -> DataFrame:
    """(term, stem) of a table of distinct terms, by Arrow batches; stop words are left out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"term": batch[term], "stem": [stem(t) for t in batch[term]]})

    return vocabulary.select(term).filter(F.col(term).isNotNull() & ~F.col(term).isin(*ENGLISH_STOP)).mapInPandas(run, "term string, stem string")
