"""Freely typed place names mapped to a reference list.

Method: a trie over all names and aliases of the reference list, each in every script it
is written in, searched with a Levenshtein automaton: a row of edit distances is carried
down the trie, and a branch is left as soon as no entry below it can be near enough. The
allowed distance depends on the length. The list must be small (its size is checked); it
goes to every task, and the rows are mapped where they are, without a shuffle.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The 33 letters and their spellings, in alphabetical order.
GEORGIAN = "აბგდევზთიკლმნოპჟრსტუფქღყშჩცძწჭხჯჰ"
ROMAN = "a b g d e v z t i k l m n o p zh r s t u p k gh q sh ch ts dz ts ch kh j h".split()
CHAT = "a b g d e v z t i k l m n o p j r s t u f q g y sh ch c dz w ch x j h".split()
KEYBOARD = "a b g d e v z T i k l m n o p J r s t u f q R y S C c Z w W x j h".split()
RUSSIAN = "а б г д е в з т и к л м н о п ж р с т у п к г к ш ч ц дз ц ч х дж х".split()
SCRIPTS = {name: str.maketrans(dict(zip(GEORGIAN, letters, strict=True))) for name, letters in (("roman", ROMAN), ("chat", CHAT), ("keyboard", KEYBOARD), ("russian", RUSSIAN))}
FROM_KEYBOARD = str.maketrans({k: g for g, k in zip(GEORGIAN, KEYBOARD, strict=True)} | {"P": "პ", "A": "ა", "B": "ბ", "D": "დ", "E": "ე", "F": "ფ", "G": "გ", "H": "ჰ", "I": "ი", "K": "კ", "L": "ლ", "M": "მ", "N": "ნ", "O": "ო", "Q": "ქ", "U": "უ", "V": "ვ", "X": "ხ", "Y": "ყ"})

# Words around a name that say what it is, not which; and the country's names.
_BEFORE = r"^(?:ქ\s*\.|ქალაქი|ქალაქ|დაბა|სოფელი|სოფ\s*\.|უბანი|რაიონი|მუნიციპალიტეტი|ქ\s(?=\S)|city of|town of|village of|city|town|near|in|at|g\s*\.|гор\s*\.|город|г\s*\.|район|около)\s*"
_AFTER = r"[\s,]+(?:ახლოს|მახლობლად|რაიონი|რ-ნი|მუნიციპალიტეტი|უბანი|ქალაქი|ცენტრი|city|town|district|area|region|municipality|centre|center|район|город)$"
COUNTRY = {"საქართველო", "georgia", "sakartvelo", "грузия", "ge"}

#: Trie entries above which the list no longer counts as small.
MAX_ENTRIES = 2_000_000


def tidy(text: str) -> str:
    text = unicodedata.normalize("NFKC", text)
    text = re.sub(r"[​-‏⁠﻿­]", "", text)
    return re.sub(r"\s+", " ", text).strip(" \t\"'„“”«».,;:·•*!-–—_/")


def readings(text: str) -> list[str]:
    """What a typed text may mean: whole, without decoration, typed on the other keyboard."""
    shown = tidy(text)
    out: dict[str, None] = {}
    pieces = [shown, re.sub(r"\s*[(\[][^)\]]*[)\]]\s*", " ", shown).strip()]
    if "," in shown or "/" in shown:
        parts = [p.strip() for p in re.split(r"[,/]", pieces[1]) if p.strip() and p.strip().lower() not in COUNTRY]
        pieces += parts if len(parts) == 1 else [" ".join(parts)]
    for piece in dict.fromkeys(pieces):
        low = piece.lower()
        bare = low
        for _ in range(2):
            bare = re.sub(_AFTER, "", re.sub(_BEFORE, "", bare)).strip(" .,-")
        out |= {low: None, bare: None}
        if re.fullmatch(r"[A-Za-z .\-]+", piece) and re.search("[a-z][A-Z]", piece):
            out |= {piece.translate(FROM_KEYBOARD): None}
    return [r for r in out if r]


def forms(name: str) -> tuple[set[str], set[str]]:
    """The ways an entry's name is written: as it is and in the other scripts; and inflected."""
    low = tidy(name).lower()
    if not low:
        return set(), set()
    if not any(c in GEORGIAN for c in low):
        return {low}, set()
    stem = low[:-1] if low[-1] == "ი" else low
    inflected = {f"{stem}ში", f"{stem}თან", f"{stem}ზე", f"{stem}იდან" if low[-1] == "ი" else f"{stem}დან", f"{stem}ის" if low[-1] == "ი" else f"{stem}ს", f"{stem}ამდე" if low[-1] == "ი" else f"{stem}მდე"}
    return {low} | {low.translate(SCRIPTS[s]) for s in ("roman", "chat", "russian")}, inflected | {low.translate(SCRIPTS["keyboard"]).lower()}


def script(text: str) -> str:
    return "ka" if any(c in GEORGIAN for c in text) else "ru" if re.search("[а-яё]", text) else "en"


def limit(length: int) -> int:
    """The edit distance allowed at a length."""
    return 0 if length < 5 else 1 if length < 7 else 2


class Trie:
    """Entries by letters; `near` finds all within a distance, counting a swap of neighbours as one edit."""

    def __init__(self, entries: Sequence[tuple[str, int]]):
        self.root: dict = {}
        for name, ref in entries:
            node = self.root
            for c in name:
                node = node.setdefault(c, {})
            node.setdefault("", set()).add(ref)

    def near(self, word: str, most: int) -> dict[int, int]:
        """Reference to its smallest distance, for all within `most`."""
        found: dict[int, int] = {}
        n, far = len(word), most + 1
        stack = [(self.root, [min(j, far) for j in range(n + 1)], None, "", 0)]
        while stack:
            node, row, before, last, depth = stack.pop()
            if row[n] <= most:
                for ref in node.get("", ()):
                    found[ref] = min(row[n], found.get(ref, most))
            depth += 1
            low, high = max(1, depth - most), min(n, depth + most)
            for c, child in node.items():
                if not c:
                    continue
                new = [far] * (n + 1)
                if depth <= most:
                    new[0] = depth
                least = new[0]
                for j in range(low, high + 1):
                    d = row[j - 1] + (word[j - 1] != c)
                    d = min(d, row[j] + 1, new[j - 1] + 1)
                    if before is not None and j > 1 and word[j - 1] == last and word[j - 2] == c:
                        d = min(d, before[j - 2] + 1)
                    if d < far:
                        new[j] = d
                        least = min(least, d)
                if least <= most or (before is None or min(row) < most):
                    stack.append((child, new, row, c, depth))
        return found


class Places:
    """The reference list, ready for `find`."""

    def __init__(self, entries: Sequence[tuple[int, Sequence[str]]]):
        self.exact: dict[str, set[int]] = {}
        paths: dict[str, set[tuple[str, int]]] = {"ka": set(), "ru": set(), "en": set()}
        for ref, names in entries:
            for name in names:
                plain, inflected = forms(name or "")
                for f in plain:
                    paths[script(f)].add((f, ref))
                for f in plain | inflected:
                    self.exact.setdefault(f, set()).add(ref)
        if len(self.exact) > MAX_ENTRIES:
            raise ValueError(f"{len(self.exact)} written forms: too many to send to every task")
        self.tries = {k: Trie(sorted(v)) for k, v in paths.items()}
        self.memo: dict[str, list[tuple[int, int]]] = {}

    def all_near(self, text: str) -> list[tuple[int, int]]:
        """All (distance, reference) within the distance allowed, nearest first."""
        meant = readings(text)
        best = {ref: 0 for r in meant for ref in self.exact.get(r, ())}
        for r in meant:
            for ref, d in self.tries[script(r)].near(r, limit(len(r))).items():
                best[ref] = min(d, best.get(ref, d))
        return sorted((d, ref) for ref, d in best.items())

    def find(self, text: str | None) -> int:
        """The one nearest reference, or -1 if none is near enough or two are equally near."""
        if text is None:
            return -1
        if text not in self.memo:
            if len(self.memo) > 500_000:
                self.memo.clear()
            exact = {ref for r in readings(text) for ref in self.exact.get(r, ())}
            hits = [(0, ref) for ref in exact] or self.all_near(text)
            self.memo[text] = hits[0][1] if hits and (len(hits) == 1 or hits[0][0] < hits[1][0]) else -1
        return self.memo[text]


def map_places(rows: DataFrame, key: str, entries: str, reference: DataFrame, ref: str, names: Sequence[str], aliases: str) -> DataFrame:
    """(`key`, city_no, `ref`): one row for each element of the array `entries`, -1 where it names no entry.

    city_no is the element's position from 0; a null or empty element is -1; a null or
    empty array gives no row. A reference entry is known by each of `names` and each of
    the array `aliases`; null ones are ignored, and an empty list makes everything -1.
    Two entries equally near are no match. Rows repeat as `rows` repeats them; other
    columns are ignored. `reference` is read to the driver and checked against MAX_ENTRIES.
    """
    known = [(r[0], [*r[1:-1], *(r[-1] or [])]) for r in reference.select(ref, *names, aliases).limit(MAX_ENTRIES + 1).collect() if r[0] is not None]
    if len(known) > MAX_ENTRIES:
        raise ValueError("the reference list is too long to send to every task")
    shared = rows.sparkSession.sparkContext.broadcast(known)
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = Places(shared.value)
        for batch in batches:
            found = pa.array([places.find(t) for t in batch.column("t").to_pylist()], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("k"), batch.column("i"), found], names=["k", "i", "p"])

    long = rows.select(F.col(key).alias("k"), F.posexplode(entries).alias("i", "t"))
    return long.mapInArrow(run, f"k {kind}, i int, p int").select(F.col("k").alias(key), F.col("i").alias("city_no"), F.col("p").alias(ref))
