"""Porter's suffix stripping (1980) for one word; run on the distinct vocabulary only."""

from __future__ import annotations

VOWELS = frozenset("aeiou")

# Suffix tables of the published algorithm.
STEP_2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "bli": "ble", "alli": "al",
    "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al",
    "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble", "logi": "log",
}
STEP_3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP_4 = (
    "al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti",
    "ous", "ive", "ize",
)


def _shape(word: str) -> str:
    """The word as consonants and vowels; y is a vowel after a consonant."""
    shape = []
    for at, ch in enumerate(word):
        vowel = ch in VOWELS or (ch == "y" and at > 0 and shape[-1] == "c")
        shape.append("v" if vowel else "c")
    return "".join(shape)


def _measure(stem: str) -> int:
    """Number of vowel-consonant sequences."""
    return _shape(stem).count("vc")


def _ends_short(stem: str) -> bool:
    """Consonant, vowel, consonant at the end, the last one not w, x or y."""
    return _shape(stem)[-3:] == "cvc" and stem[-1] not in "wxy"


def _longest(word: str, suffixes) -> str | None:
    return max((s for s in suffixes if word.endswith(s)), key=len, default=None)


def _plurals(word: str) -> str:
    if word.endswith(("sses", "ies")):
        return word[:-2]
    if word.endswith("s") and not word.endswith("ss"):
        return word[:-1]
    return word


def _past_forms(word: str) -> str:
    if word.endswith("eed"):
        return word[:-1] if _measure(word[:-3]) > 0 else word
    suffix = _longest(word, ("ed", "ing"))
    stem = word[: -len(suffix)] if suffix else ""
    if not suffix or "v" not in _shape(stem):
        return word
    if stem.endswith(("at", "bl", "iz")):
        return stem + "e"
    if len(stem) > 1 and stem[-1] == stem[-2] and _shape(stem)[-1] == "c" and stem[-1] not in "lsz":
        return stem[:-1]
    return stem + "e" if _measure(stem) == 1 and _ends_short(stem) else stem


def _swap(word: str, table: dict[str, str]) -> str:
    suffix = _longest(word, table)
    if suffix and _measure(word[: -len(suffix)]) > 0:
        return word[: -len(suffix)] + table[suffix]
    return word


def _drop_suffix(word: str) -> str:
    suffix = _longest(word, STEP_4)
    if not suffix:
        return word
    stem = word[: -len(suffix)]
    allowed = suffix != "ion" or stem.endswith(("s", "t"))
    return stem if allowed and _measure(stem) > 1 else word


def _final_letters(word: str) -> str:
    if word.endswith("e"):
        stem = word[:-1]
        if _measure(stem) > 1 or (_measure(stem) == 1 and not _ends_short(stem)):
            word = stem
    if word.endswith("ll") and _measure(word) > 1:
        word = word[:-1]
    return word


def stem(word: str) -> str:
    if len(word) < 3:
        return word
    word = _past_forms(_plurals(word))
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    return _final_letters(_drop_suffix(_swap(_swap(word, STEP_2), STEP_3)))
