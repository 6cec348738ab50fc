"""Porter stemmer (Porter 1980) with the common extensions of the NLTK flavour.

Used per term; a worker remembers stems (see ``operators.text.stem_bag``).
Extensions over the 1980 paper: words of one or two letters are left alone;
a small table of irregular forms; ``ies``/``ied`` on four-letter words keep
``ie``; ``y`` -> ``i`` only after a consonant that is not the first letter;
``bli`` -> ``ble``, ``alli`` -> ``al`` (then step 2 again), ``fulli`` -> ``ful``,
``logi`` -> ``log``; a two-letter vowel-consonant stem also counts as *cvc*.
"""

from __future__ import annotations

from functools import lru_cache

# Irregular forms and the stem each maps to.
IRREGULAR = {
    "skies": "sky", "sky": "sky",
    "dying": "die", "lying": "lie", "tying": "tie",
    "news": "news",
    "innings": "inning", "inning": "inning",
    "outings": "outing", "outing": "outing",
    "cannings": "canning", "canning": "canning",
    "howe": "howe", "proceed": "proceed", "exceed": "exceed", "succeed": "succeed",
}

_VOWELS = frozenset("aeiou")


def _consonant(w: str, i: int) -> bool:
    ch = w[i]
    if ch in _VOWELS:
        return False
    if ch == "y":
        return i == 0 or not _consonant(w, i - 1)
    return True


def _measure(stem: str) -> int:
    pattern = "".join("c" if _consonant(stem, i) else "v" for i in range(len(stem)))
    return pattern.count("vc")


def _has_vowel(stem: str) -> bool:
    return any(not _consonant(stem, i) for i in range(len(stem)))


def _double_consonant(w: str) -> bool:
    return len(w) >= 2 and w[-1] == w[-2] and _consonant(w, len(w) - 1)


def _cvc(w: str) -> bool:
    if len(w) >= 3:
        return (_consonant(w, len(w) - 3) and not _consonant(w, len(w) - 2)
                and _consonant(w, len(w) - 1) and w[-1] not in "wxy")
    return len(w) == 2 and not _consonant(w, 0) and _consonant(w, 1)


def _first_rule(word: str, rules) -> str:
    """Apply the first rule whose suffix matches; if its condition fails, stop."""
    for suffix, repl, cond in rules:
        if suffix == "*d":
            if _double_consonant(word):
                stem = word[:-2]
                return stem + repl if cond is None or cond(stem) else word
            continue
        if word.endswith(suffix):
            stem = word[:len(word) - len(suffix)]
            return stem + repl if cond is None or cond(stem) else word
    return word


def _m_pos(stem: str) -> bool:
    return _measure(stem) > 0


def _m_gt1(stem: str) -> bool:
    return _measure(stem) > 1


def _step1a(w: str) -> str:
    if w.endswith("ies") and len(w) == 4:
        return w[:-3] + "ie"
    return _first_rule(w, [("sses", "ss", None), ("ies", "i", None),
                           ("ss", "ss", None), ("s", "", None)])


def _step1b(w: str) -> str:
    if w.endswith("ied"):
        return w[:-3] + ("ie" if len(w) == 4 else "i")
    if w.endswith("eed"):
        stem = w[:-3]
        return stem + "ee" if _measure(stem) > 0 else w
    base = None
    for suffix in ("ed", "ing"):
        if w.endswith(suffix) and _has_vowel(w[:-len(suffix)]):
            base = w[:-len(suffix)]
            break
    if base is None:
        return w
    last = base[-1] if base else ""
    return _first_rule(base, [
        ("at", "ate", None), ("bl", "ble", None), ("iz", "ize", None),
        ("*d", last, lambda s: last not in "lsz"),
        ("", "e", lambda s: _measure(s) == 1 and _cvc(s)),
    ])


def _step1c(w: str) -> str:
    return _first_rule(w, [("y", "i", lambda s: len(s) > 1 and _consonant(s, len(s) - 1))])


def _step2(w: str) -> str:
    if w.endswith("alli") and _m_pos(w[:-4]):
        return _step2(w[:-4] + "al")
    return _first_rule(w, [
        ("ational", "ate", _m_pos), ("tional", "tion", _m_pos), ("enci", "ence", _m_pos),
        ("anci", "ance", _m_pos), ("izer", "ize", _m_pos), ("bli", "ble", _m_pos),
        ("alli", "al", _m_pos), ("entli", "ent", _m_pos), ("eli", "e", _m_pos),
        ("ousli", "ous", _m_pos), ("ization", "ize", _m_pos), ("ation", "ate", _m_pos),
        ("ator", "ate", _m_pos), ("alism", "al", _m_pos), ("iveness", "ive", _m_pos),
        ("fulness", "ful", _m_pos), ("ousness", "ous", _m_pos), ("aliti", "al", _m_pos),
        ("iviti", "ive", _m_pos), ("biliti", "ble", _m_pos), ("fulli", "ful", _m_pos),
        ("logi", "log", lambda s: _m_pos(w[:-3])),
    ])


def _step3(w: str) -> str:
    return _first_rule(w, [
        ("icate", "ic", _m_pos), ("ative", "", _m_pos), ("alize", "al", _m_pos),
        ("iciti", "ic", _m_pos), ("ical", "ic", _m_pos), ("ful", "", _m_pos),
        ("ness", "", _m_pos),
    ])


def _step4(w: str) -> str:
    return _first_rule(w, [
        ("al", "", _m_gt1), ("ance", "", _m_gt1), ("ence", "", _m_gt1), ("er", "", _m_gt1),
        ("ic", "", _m_gt1), ("able", "", _m_gt1), ("ible", "", _m_gt1), ("ant", "", _m_gt1),
        ("ement", "", _m_gt1), ("ment", "", _m_gt1), ("ent", "", _m_gt1),
        ("ion", "", lambda s: _measure(s) > 1 and s[-1:] in ("s", "t")),
        ("ou", "", _m_gt1), ("ism", "", _m_gt1), ("ate", "", _m_gt1), ("iti", "", _m_gt1),
        ("ous", "", _m_gt1), ("ive", "", _m_gt1), ("ize", "", _m_gt1),
    ])


def _step5(w: str) -> str:
    if w.endswith("e"):
        stem = w[:-1]
        m = _measure(stem)
        if m > 1 or (m == 1 and not _cvc(stem)):
            w = stem
    if w.endswith("ll") and _measure(w[:-1]) > 1:
        w = w[:-1]
    return w


@lru_cache(maxsize=200_000)
def stem_word(word: str) -> str:
    if word is None:
        return None
    w = word.lower()
    if w in IRREGULAR:
        return IRREGULAR[w]
    if len(w) <= 2:
        return w
    for step in (_step1a, _step1b, _step1c, _step2, _step3, _step4, _step5):
        w = step(w)
    return w
