"""A search's words as one pattern each: the word, what it means in the other language, and how it may be written in the other script."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from skein.functions.text import ENDINGS

# Latin spellings and the Georgian letters each may stand for, pairs of letters first.
SPELLINGS = [
    ("dz", "ძ"), ("ts", "ცწ"), ("ch", "ჩჭ"), ("sh", "შ"), ("zh", "ჟ"), ("kh", "ხ"), ("gh", "ღ"), ("a", "ა"), ("b", "ბ"), ("g", "გღ"), ("d", "დ"), ("e", "ე"), ("v", "ვ"), ("z", "ზ"), ("t", "თტ"), ("i", "ი"), ("k", "კქ"), ("l", "ლ"),
    ("m", "მ"), ("n", "ნ"), ("o", "ო"), ("p", "პფ"), ("j", "ჯ"), ("r", "რ"), ("s", "ს"), ("u", "უ"), ("f", "ფ"), ("q", "ქყ"), ("y", "ყ"), ("x", "ხ"), ("c", "ცჩწჭ"), ("w", "წ"), ("h", "ჰ"),
]
#: Letters a transliterated word must have, and its stem.
LEAST_LETTERS, LEAST_STEM = 4, 3
_OUTSIDE = r"[^\p{L}\p{N}]"


def stem_of(word: str) -> str:
    """`functions.text.stem` of one word on the driver."""
    if re.search("[ა-ჰ]", word):
        m = re.fullmatch("(.{3,}?)(?:" + "|".join(ENDINGS) + ")", word)
        return m[1] if m else word
    return word[:-1] if len(word) > 3 and word.endswith("s") and not word.endswith("ss") else word


def transliterated(word: str) -> list[str] | None:
    """For each letter of the Georgian stem of a Latin word the letters it may be; None if it can't be one."""
    letters, at = [], 0
    while at < len(word):
        found = next(((latin, set_) for latin, set_ in SPELLINGS if word.startswith(latin, at)), None)
        if found is None:
            return None
        letters.append(found[1])
        at += len(found[0])
    stem = stem_of("".join(x[0] for x in letters))
    return letters[: len(stem)] if len(word) >= LEAST_LETTERS and len(stem) >= LEAST_STEM else None


def _bounded(body: str, length: int) -> str:
    """From four letters on anywhere, three at a word's beginning, fewer as a whole word."""
    if length >= 4:
        return body
    return f"(?:^|{_OUTSIDE}){body}" + ("" if length == 3 else f"(?:$|{_OUTSIDE})")


def word_pattern(word: str, dictionary: Mapping[str, Sequence[str]]) -> str:
    """The alternation of a word's stem, the dictionary's stems for it (either way round) and its other script."""
    stem = stem_of(word.lower())
    other = [*dictionary.get(stem, ()), *(k for k, v in dictionary.items() if stem in v)]
    parts = [(re.escape(w), len(w)) for w in dict.fromkeys([stem, *other])]
    if re.fullmatch("[a-z]+", word.lower()) and (letters := transliterated(word.lower())):
        parts.append(("".join(x if len(x) == 1 else f"[{x}]" for x in letters), len(letters)))
    return "(?:" + "|".join(_bounded(b, n) for b, n in parts) + ")"


def says_all(text: Column, query: str, dictionary: Mapping[str, Sequence[str]]) -> Column:
    """Whether a text says every word of a query in some form; true for a query without words."""
    out = F.lit(True)
    for word in re.findall(r"[^\W_]+", query):
        out = out & F.lower(text).rlike(word_pattern(word, dictionary))
    return out
