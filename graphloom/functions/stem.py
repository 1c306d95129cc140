"""English stemming after the published Porter2 rules, as an Arrow UDF."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

VOWELS = "aeiouy"
DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
#: Words that the rules except, before step 1 and after step 1a.
WHOLE = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl",
    "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe",
    "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
AFTER_1A = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
#: Suffixes of steps 2, 3 and 4 with what replaces them.
STEP2 = (
    ("ization", "ize"), ("ational", "ate"), ("fulness", "ful"), ("ousness", "ous"), ("iveness", "ive"), ("tional", "tion"),
    ("biliti", "ble"), ("lessli", "less"), ("entli", "ent"), ("ation", "ate"), ("alism", "al"), ("aliti", "al"),
    ("ousli", "ous"), ("iviti", "ive"), ("fulli", "ful"), ("enci", "ence"), ("anci", "ance"), ("abli", "able"),
    ("izer", "ize"), ("ator", "ate"), ("alli", "al"), ("bli", "ble"), ("ogi", "og"), ("li", ""),
)
STEP3 = (("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("icate", "ic"), ("iciti", "ic"), ("ative", ""), ("ical", "ic"), ("ness", ""), ("ful", ""))
STEP4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion", "al", "er", "ic")
REGION = re.compile(f"[{VOWELS}][^{VOWELS}]")


def _regions(w: str) -> tuple[int, int]:
    head = next((len(p) for p in ("gener", "commun", "arsen") if w.startswith(p)), None)
    if head is None:
        m = REGION.search(w)
        head = m.end() if m else len(w)
    m = REGION.search(w, head)
    return head, m.end() if m else len(w)


def _short_end(w: str) -> bool:
    if len(w) == 2:
        return w[0] in VOWELS and w[1] not in VOWELS
    return len(w) > 2 and w[-1] not in VOWELS + "wxY" and w[-2] in VOWELS and w[-3] not in VOWELS


def porter2(word: str) -> str:
    w = word.lower().replace("’", "'")
    if len(w) <= 2:
        return w
    if w in WHOLE:
        return WHOLE[w]
    w = w.removeprefix("'")
    w = re.sub(f"(^|[{VOWELS}])y", lambda m: m[1] + "Y", w)
    r1, r2 = _regions(w)
    for end in ("'s'", "'s", "'"):
        if w.endswith(end):
            w = w[: -len(end)]
            break
    # 1a
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and any(c in VOWELS for c in w[:-2]):
        w = w[:-1]
    if w in AFTER_1A:
        return w
    # 1b
    if w.endswith(("eedly", "eed")):
        end = 5 if w.endswith("eedly") else 3
        if len(w) - end >= r1:
            w = w[:-end] + "ee"
    else:
        end = next((e for e in ("ingly", "edly", "ing", "ed") if w.endswith(e)), None)
        if end and any(c in VOWELS for c in w[: -len(end)]):
            w = w[: -len(end)]
            if w.endswith(("at", "bl", "iz")):
                w += "e"
            elif w.endswith(DOUBLES):
                w = w[:-1]
            elif r1 >= len(w) and _short_end(w):
                w += "e"
    # 1c
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in VOWELS:
        w = w[:-1] + "i"
    for end, new in STEP2:
        if w.endswith(end):
            if len(w) - len(end) >= r1 and (end != "ogi" or w[-4:-3] == "l") and (end != "li" or w[-3:-2] in tuple("cdeghkmnrt")):
                w = w[: -len(end)] + new
            break
    for end, new in STEP3:
        if w.endswith(end):
            if len(w) - len(end) >= (r2 if end == "ative" else r1):
                w = w[: -len(end)] + new
            break
    for end in STEP4:
        if w.endswith(end):
            if len(w) - len(end) >= r2 and (end != "ion" or w[-4:-3] in ("s", "t")):
                w = w[: -len(end)]
            break
    if w.endswith("e") and (len(w) - 1 >= r2 or len(w) - 1 >= r1 and not _short_end(w[:-1])) or w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.lower()


_ION = ("sion", "tion")
PORTER_2 = (
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"),
    ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"),
    ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"),
)
PORTER_3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
PORTER_4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ion", "ism", "ate", "iti", "ous", "ive", "ize", "al", "er", "ic", "ou")


def _shape(word: str) -> str:
    """The word as v (vowel) and c (consonant); y is a vowel after a consonant."""
    out = ""
    for c in word:
        out += "v" if c in "aeiou" or c == "y" and out[-1:] == "c" else "c"
    return out


def _measure(stem: str) -> int:
    """How often a vowel run meets a consonant run."""
    return _shape(stem).count("vc")


def _closed(stem: str) -> bool:
    """Ends in consonant, vowel, consonant other than w, x, y."""
    return _shape(stem)[-3:] == "cvc" and stem[-1] not in "wxy"


def _replace(w: str, rules, least: int) -> str:
    for end, new in sorted(rules, key=lambda r: -len(r[0])):
        if w.endswith(end):
            return w[: -len(end)] + new if _measure(w[: -len(end)]) > least else w
    return w


def porter(word: str) -> str:
    """The published Porter algorithm of 1980."""
    w = word.lower()
    if len(w) < 3:
        return w
    if w.endswith(("sses", "ies")):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    else:
        end = next((e for e in ("ed", "ing") if w.endswith(e)), None)
        if end and "v" in _shape(w[: -len(end)]):
            w = w[: -len(end)]
            if w.endswith(("at", "bl", "iz")):
                w += "e"
            elif len(w) > 1 and w[-1] == w[-2] and _shape(w)[-1] == "c" and w[-1] not in "lsz":
                w = w[:-1]
            elif _measure(w) == 1 and _closed(w):
                w += "e"
    if w.endswith("y") and "v" in _shape(w[:-1]):
        w = w[:-1] + "i"
    w = _replace(_replace(w, PORTER_2, 0), PORTER_3, 0)
    for end in sorted(PORTER_4, key=len, reverse=True):
        if w.endswith(end):
            if _measure(w[: -len(end)]) > 1 and (end != "ion" or w.endswith(_ION)):
                w = w[: -len(end)]
            break
    if w.endswith("e"):
        m = _measure(w[:-1])
        w = w[:-1] if m > 1 or m == 1 and not _closed(w[:-1]) else w
    return w[:-1] if w.endswith("ll") and _measure(w) > 1 else w


def check_stemmer(name: str) -> None:
    if name not in ("english", "porter", "none"):
        raise ValueError(f"Unrecognized stemmer '{name}'. Supported stemmers are: english, porter, none.")


def _stemmed(batches: Iterator[pd.Series], rule: Callable[[str], str]) -> Iterator[pd.Series]:
    known: dict[str | None, str | None] = {None: None}
    for words in batches:
        for w in words.unique():
            if w not in known:
                known[w] = rule(w)
        yield pd.Series([known[w] for w in words], dtype=object)  # Series.map would turn all known words over once a batch
        if len(known) > 500_000:
            known = {None: None}


@F.pandas_udf(T.StringType())
def _stem_english(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    yield from _stemmed(batches, porter2)


@F.pandas_udf(T.StringType())
def _stem_porter(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    yield from _stemmed(batches, porter)


def stem(word: Column, stemmer: str = "english") -> Column:
    """The word's stem; ``none`` returns it as it is."""
    check_stemmer(stemmer)
    return {"none": lambda w: w, "english": _stem_english, "porter": _stem_porter}[stemmer](word)


def stem_word(word: str, stemmer: str = "english") -> str:
    """The stem of one word, by the same rules as :func:`stem`."""
    check_stemmer(stemmer)
    return {"none": lambda w: w, "english": porter2, "porter": porter}[stemmer](word)


def tokenize(text: Column, tokenizer: str = "simple") -> Column:
    """Words between blanks; empty ones are dropped."""
    if tokenizer != "simple":
        raise ValueError(f"Tokenizer '{tokenizer}' is not available; use simple.")
    return F.filter(F.split(text, " "), lambda t: t != "")
