"""English stems by the suffix rules of Porter's algorithm (1980), for words of letters in lower case."""

from __future__ import annotations

import re
from functools import lru_cache


# Suffixes and what stands in their place, by step, from the published algorithm.
STEP_2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al",
    "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al",
    "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble",
}
STEP_3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP_4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()


def shape(word: str) -> str:
    """The word as c for consonants and v for vowels; y is a vowel after a consonant."""
    out = ""
    for i, c in enumerate(word):
        vowel = c in "aeiou" or (c == "y" and i > 0 and out[-1] == "c")
        out += "v" if vowel else "c"
    return out


def measure(stem: str) -> int:
    """How often vowels are followed by consonants."""
    return len(re.findall("v+c+", shape(stem)))


def short_end(stem: str) -> bool:
    """Ends consonant, vowel, consonant, the last not w, x or y."""
    return shape(stem).endswith("cvc") and stem[-1] not in "wxy"


def double_end(stem: str) -> bool:
    return len(stem) > 1 and stem[-1] == stem[-2] and shape(stem)[-1] == "c"


def longest(word: str, suffixes) -> str | None:
    return max((s for s in suffixes if word.endswith(s)), key=len, default=None)


def replaced(word: str, rules: dict[str, str]) -> str:
    """The longest suffix of the rules replaced, if something with a vowel and a consonant is left before it."""
    suffix = longest(word, rules)
    return word[: -len(suffix)] + rules[suffix] if suffix and measure(word[: -len(suffix)]) > 0 else word


@lru_cache(1 << 16)
def stem(word: str) -> str:
    """The stem; words of up to two letters stay."""
    if len(word) < 3:
        return word
    plural = longest(word, ("sses", "ies", "ss", "s"))
    word = word[:-2] if plural in ("sses", "ies") else word[:-1] if plural == "s" else word
    if word.endswith("eed"):
        word = word[:-1] if measure(word[:-3]) > 0 else word
    elif (past := longest(word, ("ed", "ing"))) and "v" in shape(word[: -len(past)]):
        word = word[: -len(past)]
        if longest(word, ("at", "bl", "iz")):
            word += "e"
        elif double_end(word) and word[-1] not in "lsz":
            word = word[:-1]
        elif measure(word) == 1 and short_end(word):
            word += "e"
    if word.endswith("y") and "v" in shape(word[:-1]):
        word = word[:-1] + "i"
    word = replaced(replaced(word, STEP_2), STEP_3)
    last = longest(word, STEP_4)
    if last and measure(word[: -len(last)]) > 1 and (last != "ion" or word[-4] in "st"):
        word = word[: -len(last)]
    if word.endswith("e") and (measure(word[:-1]) > 1 or (measure(word[:-1]) == 1 and not short_end(word[:-1]))):
        word = word[:-1]
    return word[:-1] if word.endswith("ll") and measure(word) > 1 else word
