"""The Porter stemmer (M. F. Porter, An algorithm for suffix stripping, 1980)."""

from __future__ import annotations

import re

VOWEL = "aeiou"
# fixed values: the suffix tables of the published algorithm, tried longest first
STEP_2 = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble"}
STEP_3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP_4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def _shape(word: str) -> str:
    """v for vowels and c for consonants; y is a vowel behind a consonant."""
    out = ""
    for k, ch in enumerate(word):
        out += "v" if ch in VOWEL or ch == "y" and k and out[-1] == "c" else "c"
    return out


def _measure(word: str) -> int:
    return len(re.findall("v+c+", _shape(word)))


def _ends_cvc(word: str) -> bool:
    return _shape(word)[-3:] == "cvc" and word[-1] not in "wxy"


def _swap(word: str, table: dict[str, str]) -> str:
    for suffix in sorted(table, key=len, reverse=True):
        if word.endswith(suffix):
            rest = word[: -len(suffix)]
            return rest + table[suffix] if _measure(rest) > 0 else word
    return word


def porter(word: str) -> str:
    """The stem of a lower-case word; words of up to two letters stay."""
    if len(word) <= 2:
        return word
    for suffix, put in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
        if word.endswith(suffix):
            word = word[: -len(suffix)] + put
            break
    if word.endswith("eed"):
        if _measure(word[:-3]) > 0:
            word = word[:-1]
    else:
        cut = next((word[: -len(s)] for s in ("ed", "ing") if word.endswith(s) and "v" in _shape(word[: -len(s)])), None)
        if cut is not None:
            word = cut
            if word.endswith(("at", "bl", "iz")):
                word += "e"
            elif len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c" and word[-1] not in "lsz":
                word = word[:-1]
            elif _measure(word) == 1 and _ends_cvc(word):
                word += "e"
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    word = _swap(_swap(word, STEP_2), STEP_3)
    for suffix in sorted(STEP_4, key=len, reverse=True):
        if word.endswith(suffix):
            rest = word[: -len(suffix)]
            if _measure(rest) > 1 and (suffix != "ion" or rest[-1:] in ("s", "t")):
                word = rest
            break
    if word.endswith("e"):
        m = _measure(word[:-1])
        if m > 1 or m == 1 and not _ends_cvc(word[:-1]):
            word = word[:-1]
    if word.endswith("ll") and _measure(word) > 1:
        word = word[:-1]
    return word
