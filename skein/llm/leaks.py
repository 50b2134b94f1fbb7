"""Held-out items that stand in a corpus, whole or in part.

Method: latent semantic retrieval. Texts become sequences of word numbers over the items'
vocabulary (once, written to the shared folder); overlapping passages of documents and items
are weighted by TF-IDF with document frequencies counted over the whole corpus; a distributed
randomised SVD finds the corpus' main latent directions; passages are folded in, and every
document's passages are searched for those near an item's by cosine. Next to the nearest ones, all
documents that know half of an item's words are candidates too, whatever their cosine: this bounds
runs and common subsequences from above however the words are scattered and however common
they are, so nothing is lost. Candidates are read exactly: runs of consecutive words, longest
common subsequence, the item's numbers. Items are taken in blocks of bounded size, so what
goes to the driver and to every task is bounded however many items there are.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.session import cut

# Letters of other scripts that look like Latin ones.
_LOOKALIKE = str.maketrans("аеорсхуіјѕһԁԛԝкмтвнгαοερτνικυχγ", "aeopcxyijshdqwkmtbhraoeptvikuxy")
_INVISIBLE = re.compile("[­͏؜ᅟᅠ឴឵᠎​-‏‪-‮⁠-⁤⁪-⁯︀-️﻿]")
_FOREIGN = re.compile("[Ͱ-ԯ]")
_BLOCKS = "br|p|div|li|tr|td|th|h\\d|hr|ul|ol|table"
_TAG = re.compile(rf"<(?:{_BLOCKS})\b[^<>]*+>|</(?:{_BLOCKS})\s*+>", re.I)
_INLINE = re.compile(r"</?[a-zA-Z][^<>]*+>")
_WORD = re.compile(r"[^\W_]+")

PASSAGE, STEP = 64, 32
#: Random test vectors of the SVD, and latent directions of the corpus that are kept.
TEST_VECTORS, DIRECTIONS = 40, 32
#: Cells of passages by item passages that are held at a time.
CELLS = 4_000_000
#: Share of an item below which a document holds too little of it, and cosine from which a passage is near an item's.
LEAST, NEAR = 0.5, 0.5
#: Letters of the items taken in one block: bounds the vocabulary and all that is sent to the tasks or the driver.
BLOCK_LETTERS = 1_000_000


def _uncommented(text: str) -> str:
    """The text without markup comments; what only looks like the start of one stays."""
    parts, at = [], 0
    while (a := text.find("<!--", at)) >= 0 and (b := text.find("-->", a + 4)) >= 0:
        parts += [text[at:a], " "]
        at = b + 3
    return "".join([*parts, text[at:]]) if parts else text


def words(text: str) -> list[str]:
    """The words of a text without regard to case, punctuation, markup, invisible characters and look-alike letters."""
    if "<" in text:
        text = _INLINE.sub("", _TAG.sub(" ", _uncommented(text)))
    if "&" in text:
        text = html.unescape(text)
    if not text.isascii():
        if _INVISIBLE.search(text):
            text = _INVISIBLE.sub("", text)
        text = unicodedata.normalize("NFKC", text).lower()
        if _FOREIGN.search(text):
            text = text.translate(_LOOKALIKE)
    else:
        text = text.lower()
    return _WORD.findall(text)


class Items:
    """The held-out items by word number."""

    def __init__(self, rows: Sequence[tuple[int, str]]):
        texts = [(i, words(t)) for i, t in sorted(rows) if t]
        self.ids = [i for i, w in texts if w]
        self.vocabulary: dict[str, int] = {}
        self.seqs = [[self.vocabulary.setdefault(x, len(self.vocabulary)) for x in w] for _, w in texts if w]
        self.numeric = {n for x, n in self.vocabulary.items() if x.isdigit()}

        starts = [range(0, max(1, len(q) - PASSAGE + STEP), STEP) for q in self.seqs]
        #: The items' passages (their distinct words), and where each item's begin.
        self.passages = [np.unique(q[a : a + PASSAGE]) for q, at in zip(self.seqs, starts, strict=True) for a in at]
        self.firsts = np.cumsum([0, *map(len, starts)])[:-1]
        self.lengths = np.array([len(q) for q in self.seqs])
        said = [np.unique(q, return_counts=True) for q in self.seqs]
        word = np.concatenate([w for w, _ in said]) if said else np.zeros(0, np.int64)
        owner, times = np.repeat(np.arange(len(said)), [len(w) for w, _ in said]), np.concatenate([n for _, n in said]) if said else word
        order = np.argsort(word, kind="stable")
        #: The inverted index: by word, the items that have it and how often.
        self.post_item, self.post_times = owner[order], times[order].astype(np.float32)
        self.post_from = np.searchsorted(word[order], np.arange(len(self.vocabulary) + 1))

    def known(self, owner: np.ndarray, word: np.ndarray, docs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, item, how many words of the item the document knows) of distinct (document, word) pairs."""
        n = self.post_from[word + 1] - self.post_from[word]
        at = np.repeat(self.post_from[word] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        key = np.repeat(owner, n) * len(self.ids) + self.post_item[at]
        if docs * len(self.ids) <= CELLS:
            total = np.bincount(key, self.post_times[at], docs * len(self.ids))
            found = np.flatnonzero(total)
            return found // len(self.ids), found % len(self.ids), total[found]
        found, back = np.unique(key, return_inverse=True)
        return found // len(self.ids), found % len(self.ids), np.bincount(back, self.post_times[at])


def _encode(texts: list[str | None], vocabulary: Mapping[str, int]) -> list[bytes]:
    get = vocabulary.get
    return [np.array([get(w, -1) for w in words(t or "")], np.int32).astype("<i4" if len(vocabulary) > 32_000 else "<i2").tobytes() for t in texts]


def _passages(seqs: list[np.ndarray], size: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks of overlapping passages: which words each holds (a dense 0/1 matrix over the words these sequences know), those words, and the sequence each passage comes from.

    A word at place p stands in the passages p // STEP and the one before.
    """
    lengths = np.array([len(s) for s in seqs], np.int64)
    slots = np.maximum(1, -(-lengths // STEP) - 1)
    base = np.cumsum(slots) - slots
    owner = np.repeat(np.arange(len(seqs)), slots)
    terms = np.concatenate([*seqs, np.zeros(0, np.int16)]).astype(np.int64)
    place = np.arange(len(terms)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    last = np.repeat(base + slots - 1, lengths)
    late = np.repeat(base, lengths) + place // STEP
    early = np.maximum(late - 1, np.repeat(base, lengths))
    known = terms >= 0
    ids, word = _numbered(terms[known], size)
    at, word = np.concatenate([np.minimum(late, last)[known], early[known]]), np.concatenate([word, word])
    rows = int(max(16, min(1024, CELLS // max(len(ids), 1))))
    order = np.argsort(at // rows, kind="stable") if len(owner) > rows else np.arange(len(at))
    at, word = at[order], word[order]
    cuts = np.searchsorted(at // rows, np.arange(0, -(-len(owner) // rows) + 1))
    for i in range(len(cuts) - 1):
        here = owner[i * rows : (i + 1) * rows]
        block = np.zeros((len(here), len(ids)), np.float32)
        block[at[cuts[i] : cuts[i + 1]] - i * rows, word[cuts[i] : cuts[i + 1]]] = 1
        yield block, ids, here


def _numbered(words: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct words, ascending, and each word's place among them."""
    there = np.zeros(size, bool)
    there[words] = True
    ids = np.flatnonzero(there)
    place = np.zeros(size, np.int64)
    place[ids] = np.arange(len(ids))
    return ids, place[words]


def _distinct(seqs: list[np.ndarray], size: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct (sequence, word) pairs, by sequence."""
    terms = np.concatenate([*seqs, np.zeros(0, np.int16)]).astype(np.int64)
    owner = np.repeat(np.arange(len(seqs)), [len(s) for s in seqs])
    ids, word = _numbered(terms[terms >= 0], size)
    there = np.zeros((len(seqs), len(ids)), bool)
    there[owner[terms >= 0], word] = True
    d, w = np.nonzero(there)
    return d, ids[w]


def _seqs(column: pa.Array, wide: bool) -> list[np.ndarray]:
    return [np.frombuffer(b.as_py(), "<i4" if wide else "<i2") for b in column]


def _sliced(batches: Iterator[pa.RecordBatch], size: int = 512) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a in range(0, batch.num_rows, size):
            yield batch.slice(a, size)


def longest_common(a: list[int], where: Mapping[int, int], n: int) -> int:
    """Length of the longest common subsequence of `a` and a sequence of length n given as bit positions by word."""
    full = (1 << n) - 1
    v = full
    for w in a:
        if u := v & where.get(w, 0):
            v = ((v + u) | (v - u)) & full
    return n - v.bit_count()


def covered(doc: list[int], item: list[int], run: int) -> np.ndarray:
    """Which words of the item stand in the document within runs of `run` or more consecutive words."""
    return _covered(doc, range(len(doc) - run + 1), _grams(item, run), len(item), run)


def _grams(item: list[int], run: int) -> dict[tuple, list[int]]:
    grams: dict[tuple, list[int]] = {}
    for j in range(len(item) - run + 1):
        grams.setdefault(tuple(item[j : j + run]), []).append(j)
    return grams


def _covered(doc: list[int], starts: Iterable[int], grams: Mapping[tuple, list[int]], n: int, run: int) -> np.ndarray:
    out = np.zeros(n, bool)
    for j in starts:
        for k in grams.get(tuple(doc[j : j + run]), ()):
            out[k : k + run] = True
    return out


class _Reader:
    """Reads one item in documents given as word numbers."""

    def __init__(self, seq: list[int], run: int):
        self.n, self.run, self.grams, self.own = len(seq), run, _grams(seq, run), np.unique(seq)
        self.places: dict[int, int] = {}
        for j, w in enumerate(seq):
            self.places[w] = self.places.get(w, 0) | 1 << j

    def shares(self, doc: np.ndarray) -> tuple[float, float]:
        """(run_share, lcs_share); words that aren't the item's can stand in no run and in no common subsequence."""
        own = np.isin(doc, self.own)
        so_far = np.concatenate([[0], np.cumsum(own)])
        starts = np.flatnonzero(so_far[self.run :] - so_far[: -self.run] == self.run)
        runs = _covered(doc.tolist(), starts.tolist(), self.grams, self.n, self.run) if len(starts) else np.zeros(self.n, bool)
        return float(runs.mean()), longest_common(doc[own].tolist(), self.places, self.n) / self.n


def leaks(docs: DataFrame, key: str, text: str, items: DataFrame, item: str, item_text: str, run: int = 8, least: float = LEAST, near: float = NEAR, block_letters: int = BLOCK_LETTERS) -> DataFrame:
    """(`key`, `item`, cosine, run_share, lcs_share, answer_share) for every document and item of which it holds `least`, in order or in runs.

    cosine: of the nearest passages of both in the latent space; run_share: the share of
    the item's words that stand in the document in runs of at least `run`; lcs_share: the
    longest common subsequence as a share of the item; answer_share: of its numbers. Candidates are
    the pairs of cosine `near` and, as the exact way for the rest, all pairs of which the document knows
    `least` of the item's words; without these words no share can reach `least`, so candidates that
    don't know them aren't read further, and none is lost. Null, empty or
    wordless texts hold nothing; copies of a document each have their rows; no items
    or no documents give none. The items are taken in blocks of about `block_letters` letters (one pass over the documents
    each; a single longer item is a block of its own or with others), and only a block is read to the driver at a time, of the corpus only sums by item word.
    """
    spark = docs.sparkSession
    told = items.where(F.col(item).isNotNull() & F.col(item_text).isNotNull())
    letters = told.agg(F.sum(F.length(item_text)).alias("n")).first()["n"] or 0
    blocks = max(1, -(-letters // block_letters))
    rows = docs.where(F.col(text).isNotNull()).select(F.col(key).alias("k"), F.col(text).alias("t"))
    kind, ikind = docs.schema[key].dataType.simpleString(), items.schema[item].dataType.simpleString()
    schema = f"k {kind}, item {ikind}, cosine double, run_share double, lcs_share double, answer_share double"
    out = spark.createDataFrame([], schema)
    for b in range(blocks):
        part = told.where(F.pmod(F.xxhash64(item), F.lit(blocks)) == b)
        known = Items([(r[0], r[1]) for r in part.select(item, item_text).distinct().collect()])
        if known.ids:
            found = _block(rows, known, run, least, near, schema)
            out = found if blocks == 1 else out.unionByName(cut(found))
    return out.select(F.col("k").alias(key), F.col("item").alias(item), "cosine", "run_share", "lcs_share", "answer_share")


def _block(rows: DataFrame, known: Items, run: int, least: float, near: float, schema: str) -> DataFrame:
    """`leaks` of one block of items in rows (k, t)."""
    spark = rows.sparkSession
    kind = rows.schema["k"].dataType.simpleString()
    shared = spark.sparkContext.broadcast(known)
    size, wide = len(known.vocabulary), len(known.vocabulary) > 32_000

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _sliced(batches, 2048):
            yield pa.RecordBatch.from_arrays([batch.column("k"), pa.array(_encode(batch.column("t").to_pylist(), shared.value.vocabulary), pa.binary())], names=["k", "w"])

    coded = cut(rows.mapInArrow(encode, f"k {kind}, w binary"))

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(size + 1, np.int64), 0
        for batch in _sliced(batches):
            for block, ids, _ in _passages(_seqs(batch.column("w"), wide), size):
                df[ids] += block.sum(axis=0).astype(np.int64)
                n += len(block)
        df[size] = n
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(df[at])], names=["term", "n"])

    count = np.zeros(size + 1)
    for r in coded.select("w").mapInArrow(frequencies, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():
        count[r["term"]] = r["n"]
    idf = np.log((count[size] + 1) / (count[:size] + 1)).astype(np.float32) + np.float32(1e-3)
    test = np.random.default_rng(7).standard_normal((size, TEST_VECTORS)).astype(np.float32)
    weights = spark.sparkContext.broadcast((idf, test))
    names = [f"x{j}" for j in range(TEST_VECTORS)]

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The partition's part of A'(A * test): one row for each item word."""
        idf, test = weights.value
        scaled = test * idf[:, None]
        out = np.zeros((size, test.shape[1]))
        for batch in _sliced(batches):
            for block, ids, _ in _passages(_seqs(batch.column("w"), wide), size):
                norm = np.maximum(block @ (idf[ids] ** 2), 1e-9)
                out[ids] += block.T @ ((block @ scaled[ids]) / norm[:, None])
        at = np.flatnonzero(np.abs(out).sum(axis=1))
        got = out[at] * idf[at, None]
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), *(pa.array(got[:, j]) for j in range(len(names)))], names=["term", *names])

    sums = coded.select("w").mapInArrow(sketch, "term int, " + ", ".join(f"{x} double" for x in names)).groupBy("term").agg(*(F.sum(x).alias(x) for x in names)).toArrow()
    y = np.zeros((size, TEST_VECTORS))
    y[sums.column("term").to_numpy()] = np.stack([sums.column(x).to_numpy() for x in names], axis=1) if sums.num_rows else 0.0
    folding = (np.linalg.svd(y, full_matrices=False)[0][:, :DIRECTIONS] * idf[:, None]).astype(np.float32)
    space = spark.sparkContext.broadcast((folding, _unit(np.stack([folding[p].sum(axis=0) for p in known.passages]))))

    def retrieve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, (folding, targets) = shared.value, space.value
        enough, readers = least * items.lengths, {}
        for batch in _sliced(batches, max(8, min(512, CELLS // len(targets)))):
            seqs = _seqs(batch.column("w"), wide)
            best = np.zeros((len(seqs), len(items.ids)), np.float32)
            for block, ids, owner in _passages(seqs, size):
                np.maximum.at(best, owner, np.maximum.reduceat(_unit(block @ folding[ids]) @ targets.T, items.firsts, axis=1))
            d, i, n = items.known(*_distinct(seqs, size), len(seqs))
            exact = n >= enough[i]
            candidate = (best[d, i] >= near) | exact
            rows = []
            for d, i in zip(d[candidate & exact].tolist(), i[candidate & exact].tolist(), strict=True):
                if i not in readers:
                    readers[i] = _Reader(items.seqs[i], run)
                runs, lcs = readers[i].shares(seqs[d])
                if max(lcs, runs) >= least:
                    said = {w for w in items.seqs[i] if w in items.numeric}
                    rows.append((d, items.ids[i], float(best[d, i]), runs, lcs, len(said & set(seqs[d].tolist())) / len(said) if said else 1.0))
            rest = [pa.array([r[j] for r in rows], pa.float64()) for j in range(2, 6)]
            ids = pa.array([r[1] for r in rows], batch_item_type)
            yield pa.RecordBatch.from_arrays([batch.column("k").take(pa.array([r[0] for r in rows], pa.int64())), ids, *rest], names=["k", "item", "cosine", "run_share", "lcs_share", "answer_share"])

    batch_item_type = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[schema.split("item ")[1].split(",")[0]]
    return coded.mapInArrow(retrieve, schema)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)

