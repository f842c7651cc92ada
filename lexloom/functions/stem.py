"""Porter's suffix-stripping algorithm (1980), with the common extensions of later implementations as an option."""

from __future__ import annotations

from functools import lru_cache

# Irregular forms of the extended variant.
_IRREGULAR = {
    "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "news": "news", "innings": "inning", "inning": "inning",
    "outings": "outing", "outing": "outing", "cannings": "canning", "canning": "canning", "howe": "howe", "proceed": "proceed",
    "exceed": "exceed", "succeed": "succeed", "sky": "sky",
}

# The suffixes of steps 2, 3 and 4 as published, in the published order.
_STEP2 = (
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"),
    ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"),
    ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"),
)
_STEP3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
_STEP4 = (
    "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()
)


def _shape(word: str) -> str:
    """c for consonants and v for vowels; y is a vowel after a consonant."""
    out = ""
    for i, ch in enumerate(word):
        vowel = ch in "aeiou" or (ch == "y" and i > 0 and out[-1] == "c")
        out += "v" if vowel else "c"
    return out


def _measure(stem: str) -> int:
    s = _shape(stem)
    return sum(a == "v" and b == "c" for a, b in zip(s, s[1:]))


def _has_vowel(stem: str) -> bool:
    return "v" in _shape(stem)


def _double(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c"


def _short(word: str, extensions: bool) -> bool:
    """Ends consonant-vowel-consonant, the last not w, x or y."""
    shape = _shape(word)
    if shape[-3:] == "cvc" and len(word) > 2 and word[-1] not in "wxy":
        return True
    return extensions and len(word) == 2 and shape == "vc"


@lru_cache(maxsize=1 << 16)
def stem(word: str, extensions: bool = True) -> str:
    w = word.lower()
    if extensions and w in _IRREGULAR:
        return _IRREGULAR[w]
    if len(w) <= 2:
        return w
    # plurals
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith("ies"):
        w = w[:-3] + ("ie" if extensions and len(w) == 4 else "i")
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    # past forms
    if extensions and w.endswith("ied"):
        w = w[:-3] + ("ie" if len(w) == 4 else "i")
    elif w.endswith("eed"):
        if _measure(w[:-3]) > 0:
            w = w[:-1]
    else:
        for suffix in ("ed", "ing"):
            if w.endswith(suffix):
                if _has_vowel(base := w[: -len(suffix)]):
                    w = base
                    if w.endswith(("at", "bl", "iz")):
                        w += "e"
                    elif _double(w):
                        w = w if w[-1] in "lsz" else w[:-1]
                    elif _measure(w) == 1 and _short(w, extensions):
                        w += "e"
                break
    if w.endswith("y"):
        base = w[:-1]
        if (extensions and len(base) > 1 and _shape(base)[-1] == "c") or (not extensions and _has_vowel(base)):
            w = base + "i"
    step2 = _STEP2
    if extensions:
        if w.endswith("alli") and _measure(w[:-4]) > 0:
            w = w[:-2]
        step2 = tuple(("bli", "ble") if s == "abli" else (s, r) for s, r in _STEP2) + (("fulli", "ful"),)
    for suffix, put in step2:
        if w.endswith(suffix):
            if _measure(w[: -len(suffix)]) > 0:
                w = w[: -len(suffix)] + put
            break
    else:
        if extensions and w.endswith("logi") and _measure(w[:-3]) > 0:
            w = w[:-1]
    for suffix, put in _STEP3:
        if w.endswith(suffix):
            if _measure(w[: -len(suffix)]) > 0:
                w = w[: -len(suffix)] + put
            break
    for suffix in _STEP4:
        if w.endswith(suffix):
            base = w[: -len(suffix)]
            if _measure(base) > 1 and (suffix != "ion" or base[-1:] in ("s", "t")):
                w = base
            break
    if w.endswith("e"):
        base = w[:-1]
        if _measure(base) > 1 or (_measure(base) == 1 and not _short(base, extensions)):
            w = base
    if w.endswith("ll") and _measure(w[:-1]) > 1:
        w = w[:-1]
    return w
