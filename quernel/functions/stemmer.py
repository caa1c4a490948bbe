"""The English stemmer of the Snowball project (Porter2), from its published description."""

from __future__ import annotations

import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

_V = "aeiouy"
#: Fixed values of the algorithm.
_WHOLE = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"}
_KEPT = {"sky", "news", "howe", "atlas", "cosmos", "bias", "andes"}
_KEPT_AFTER_1A = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
_DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
_STEP2 = (("ization", "ize"), ("ational", "ate"), ("fulness", "ful"), ("ousness", "ous"), ("iveness", "ive"), ("tional", "tion"), ("biliti", "ble"), ("lessli", "less"), ("entli", "ent"), ("ation", "ate"), ("alism", "al"), ("aliti", "al"), ("ousli", "ous"), ("iviti", "ive"), ("fulli", "ful"), ("enci", "ence"), ("anci", "ance"), ("abli", "able"), ("izer", "ize"), ("ator", "ate"), ("alli", "al"), ("bli", "ble"), ("ogi", "og"), ("li", ""))
_STEP3 = (("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("icate", "ic"), ("iciti", "ic"), ("ative", ""), ("ical", "ic"), ("ness", ""), ("ful", ""))
_STEP4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion", "al", "er", "ic")


def _by_last[T: (str, tuple[str, str])](ends: tuple[T, ...]) -> dict[str, list[T]]:
    """Ends in their order by their last letter, so that a word is held against few."""
    out: dict[str, list[T]] = {}
    for end in ends:
        out.setdefault((end if isinstance(end, str) else end[0])[-1], []).append(end)
    return out


_BY2, _BY3, _BY4 = _by_last(_STEP2), _by_last(_STEP3), _by_last(_STEP4)
#: Last letters of no end that is taken off or changed.
_NO_END = frozenset("abfhjkopquvwxz0123456789éèêçàâäöüßñóíáúôîûœæøå")
_VOWEL, _REGION, _Y = re.compile(f"[{_V}]"), re.compile(f"[{_V}][^{_V}]"), re.compile(f"^y|(?<=[{_V}])y")
_SHORT = re.compile(f"[^{_V}][{_V}][^{_V}wxY]$|^[{_V}][^{_V}]$")
_OWNED, _GENERAL, _EED, _ED = re.compile("('s'|'s|')$"), re.compile("gener|commun|arsen"), re.compile("(eedly|eed)$"), re.compile("(ingly|edly|ing|ed)$")


def _regions(w: str) -> tuple[int, int]:
    m = _GENERAL.match(w) or _REGION.search(w)
    r1 = m.end() if m else len(w)
    m = _REGION.search(w, r1)
    return r1, m.end() if m else len(w)


def _short_end(w: str) -> bool:
    return bool(_SHORT.search(w))


@lru_cache(maxsize=1 << 16)
def stem(word: str) -> str:
    w = word
    if len(w) <= 2:
        return w
    if w in _WHOLE:
        return _WHOLE[w]
    if w in _KEPT:
        return w
    if w[-1] in _NO_END and "'" not in w:
        return w.replace("Y", "y")
    w = w.lstrip("'")
    if "y" in w:
        w = _Y.sub("Y", w)
    r1, r2 = _regions(w)
    if "'" in w:
        w = _OWNED.sub("", w)
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and _VOWEL.search(w, 0, len(w) - 2):
        w = w[:-1]
    if w in _KEPT_AFTER_1A:
        return w
    if m := _EED.search(w):
        if m.start() >= r1:
            w = w[: m.start()] + "ee"
    elif (m := _ED.search(w)) and _VOWEL.search(w, 0, m.start()):
        w = w[: m.start()]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif w.endswith(_DOUBLES):
            w = w[:-1]
        elif r1 >= len(w) and _short_end(w):
            w += "e"
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in _V:
        w = w[:-1] + "i"
    for end, put in _BY2.get(w[-1:], ()):
        if w.endswith(end):
            at = len(w) - len(end)
            if at >= r1 and (end != "ogi" or w[at - 1 : at] == "l") and (end != "li" or w[at - 1 : at] in tuple("cdeghkmnrt")):
                w = w[:at] + put
            break
    for end, put in _BY3.get(w[-1:], ()):
        if w.endswith(end):
            at = len(w) - len(end)
            if at >= (r2 if end == "ative" else r1):
                w = w[:at] + put
            break
    for end in _BY4.get(w[-1:], ()):
        if w.endswith(end):
            at = len(w) - len(end)
            if at >= r2 and (end != "ion" or w[at - 1 : at] in ("s", "t")):
                w = w[:at]
            break
    if w.endswith("e"):
        if len(w) - 1 >= r2 or len(w) - 1 >= r1 and not _short_end(w[:-1]):
            w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.replace("Y", "y")


@F.arrow_udf(StringType())
def stem_words(words: pa.Array) -> pa.Array:
    """For a column of distinct words; join the result back."""
    return pa.array(map(stem, words.to_pylist()), pa.string())
