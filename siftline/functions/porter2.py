"""The English (Porter2) stemmer, written from its published description."""

from __future__ import annotations

import re

_WHOLE = dict(zip("skis skies dying lying tying idly gently ugly early only singly sky news howe atlas cosmos bias andes".split(), "ski sky die lie tie idl gentl ugli earli onli singl sky news howe atlas cosmos bias andes".split()))
_AFTER_1A = frozenset("inning outing canning herring earring proceed exceed succeed".split())
_V = "[aeiouy]"
_C = "[^aeiouy]"
_DOUBLE = re.compile("(bb|dd|ff|gg|mm|nn|pp|rr|tt)$")
_SHORT = re.compile(rf"(?:^{_V}{_C}|{_C}{_V}[^aeiouywxY])$")
_REGION = re.compile(rf"{_V}{_C}(.*)$", re.S)
_STEP2 = {"ization": "ize", "ational": "ate", "fulness": "ful", "ousness": "ous", "iveness": "ive", "tional": "tion", "biliti": "ble", "lessli": "less", "entli": "ent", "ation": "ate", "alism": "al", "aliti": "al", "ousli": "ous", "iviti": "ive", "fulli": "ful", "enci": "ence", "anci": "ance", "abli": "able", "izer": "ize", "ator": "ate", "alli": "al", "bli": "ble"}
_STEP3 = {"ational": "ate", "tional": "tion", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_STEP4 = sorted("al ance ence er ic able ible ant ement ment ent ism ate iti ous ive ize".split(), key=len, reverse=True)
_LI = frozenset("cdeghkmnrt")


def _after_first_syllable(word: str) -> int:
    m = _REGION.search(word)
    return m.start(1) if m else len(word)


def stem(word: str) -> str:
    """The stem of one lower-case word."""
    word = word.lower().translate({0x2018: "'", 0x2019: "'", 0x201B: "'"})
    if len(word) <= 2:
        return word
    if word in _WHOLE:
        return _WHOLE[word]
    word = word.removeprefix("'")
    # y that acts as a consonant is written Y.
    word = re.sub(r"(^|[aeiouy])y", lambda m: m[1] + "Y", word)
    prefix = next((p for p in ("gener", "commun", "arsen") if word.startswith(p)), None)
    r1 = len(prefix) if prefix else _after_first_syllable(word)
    r2 = r1 + _after_first_syllable(word[r1:])

    word = re.sub(r"('s'|'s|')$", "", word)

    if word.endswith("sses"):
        word = word[:-2]
    elif word.endswith(("ied", "ies")):
        word = word[:-2] if len(word) > 4 else word[:-1]
    elif word.endswith("s") and not word.endswith(("us", "ss")) and re.search(_V, word[:-2]):
        word = word[:-1]
    if word in _AFTER_1A:
        return word

    if m := re.search("(eedly|eed)$", word):
        if m.start() >= r1:
            word = word[: m.start()] + "ee"
    elif (m := re.search("(ingly|edly|ing|ed)$", word)) and re.search(_V, word[: m.start()]):
        word = word[: m.start()]
        if word.endswith(("at", "bl", "iz")):
            word += "e"
        elif _DOUBLE.search(word):
            word = word[:-1]
        elif r1 >= len(word) and _SHORT.search(word):
            word += "e"

    if len(word) > 2 and word[-1] in "yY" and re.match(_C, word[-2]):
        word = word[:-1] + "i"

    for end, new in _STEP2.items():
        if word.endswith(end):
            if len(word) - len(end) >= r1:
                word = word[: len(word) - len(end)] + new
            break
    else:
        if word.endswith("ogi"):
            if len(word) - 3 >= r1 and word[-4:-3] == "l":
                word = word[:-1]
        elif word.endswith("li") and len(word) - 2 >= r1 and word[-3:-2] in _LI:
            word = word[:-2]

    for end, new in (*_STEP3.items(), ("ative", "")):
        if word.endswith(end):
            if len(word) - len(end) >= (r2 if end == "ative" else r1):
                word = word[: len(word) - len(end)] + new
            break

    for end in _STEP4:
        if word.endswith(end):
            if len(word) - len(end) >= r2:
                word = word[: len(word) - len(end)]
            break
    else:
        if word.endswith("ion") and len(word) - 3 >= r2 and word[-4:-3] in ("s", "t"):
            word = word[:-3]

    if word.endswith("e"):
        if len(word) - 1 >= r2 or len(word) - 1 >= r1 and not _SHORT.search(word[:-1]):
            word = word[:-1]
    elif word.endswith("ll") and len(word) - 1 >= r2:
        word = word[:-1]
    return word.replace("Y", "y")
