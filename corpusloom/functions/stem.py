"""The published Porter2 stemmer for English, for use over distinct terms."""

from __future__ import annotations

import re
from functools import lru_cache

_V = "[aeiouy]"
_NOT_V = "[^aeiouy]"
# Exceptions of the published algorithm.
_WORDS = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"}
_SAME = frozenset("sky news howe atlas cosmos bias andes".split())
_SAME_AFTER_1A = frozenset("inning outing canning herring earring proceed exceed succeed".split())
# Suffix tables of steps 2, 3 and 4.
_STEP2 = {"ization": "ize", "ational": "ate", "fulness": "ful", "ousness": "ous", "iveness": "ive", "tional": "tion", "biliti": "ble", "lessli": "less", "entli": "ent", "ation": "ate", "alism": "al", "aliti": "al", "ousli": "ous", "iviti": "ive", "fulli": "ful", "enci": "ence", "anci": "ance", "abli": "able", "izer": "ize", "ator": "ate", "alli": "al", "bli": "ble"}
_STEP3 = {"ational": "ate", "tional": "tion", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_STEP4 = "ement ance ence able ible ment ant ent ism ate iti ous ive ize al er ic".split()


def _regions(w: str) -> tuple[int, int]:
    m = re.match("gener|commun|arsen", w) or re.match(f".*?{_V}{_NOT_V}", w)
    r1 = m.end() if m else len(w)
    m = re.match(f".*?{_V}{_NOT_V}", w[r1:])
    return r1, r1 + m.end() if m else len(w)


def _short_end(w: str) -> bool:
    return bool(re.search(f"{_NOT_V}{_V}[^aeiouywxY]$", w) or re.fullmatch(f"{_V}{_NOT_V}", w))


@lru_cache(1 << 16)
def stem(word: str) -> str:
    if len(word) <= 2:
        return word
    w = word.lower().lstrip("'")
    if w in _WORDS:
        return _WORDS[w]
    if w in _SAME:
        return w
    w = re.sub("^y", "Y", w)
    w = re.sub("([aeiouy])y", r"\1Y", w)
    r1, r2 = _regions(w)
    w = re.sub("('s'|'s|')$", "", w)
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and re.search(f"{_V}.+s$", w):
        w = w[:-1]
    if w in _SAME_AFTER_1A:
        return w
    if w.endswith(("eed", "eedly")):
        cut = 5 if w.endswith("eedly") else 3
        if len(w) - cut >= r1:
            w = w[:-cut] + "ee"
    elif m := re.search("(ingly|edly|ing|ed)$", w):
        base = w[: m.start()]
        if re.search(_V, base):
            w = base
            if w.endswith(("at", "bl", "iz")):
                w += "e"
            elif re.search(r"(bb|dd|ff|gg|mm|nn|pp|rr|tt)$", w):
                w = w[:-1]
            elif r1 >= len(w) and _short_end(w):
                w += "e"
    if re.search(f".{_NOT_V}[yY]$", w):
        w = w[:-1] + "i"
    for s in sorted([*_STEP2, "ogi", "li"], key=len, reverse=True):
        if w.endswith(s):
            if len(w) - len(s) >= r1:
                if s == "ogi":
                    w = w[:-1] if w.endswith("logi") else w
                elif s == "li":
                    w = w[:-2] if re.search("[cdeghkmnrt]li$", w) else w
                else:
                    w = w[: -len(s)] + _STEP2[s]
            break
    for s in sorted([*_STEP3, "ative"], key=len, reverse=True):
        if w.endswith(s):
            if s == "ative":
                w = w[:-5] if len(w) - 5 >= r2 else w
            elif len(w) - len(s) >= r1:
                w = w[: -len(s)] + _STEP3[s]
            break
    for s in sorted([*_STEP4, "ion"], key=len, reverse=True):
        if w.endswith(s):
            if len(w) - len(s) >= r2 and (s != "ion" or w[-4:-3] in ("s", "t")):
                w = w[: -len(s)]
            break
    if w.endswith("e"):
        if len(w) - 1 >= r2 or (len(w) - 1 >= r1 and not _short_end(w[:-1])):
            w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.lower()
