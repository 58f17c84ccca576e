"""Toxicity by a weighted lexicon under Aho-Corasick.

Texts are folded first: lower case, homoglyphs and letters with unusual marks to their Latin
letters (the accents of Latin-1 and Extended-A stay, as they tell words apart), digit and symbol
substitutions to the letters they stand for, i/l/1 to one letter, all else to spaces.  The lexicon
holds word beginnings with weights learned from labelled texts; an automaton finds all of them in
one pass.  Exception phrases, given or learned, take back the weight of the entry they contain.
The weighted hits and their share of the text's words go through a logistic curve.

The lexicon is learned from a bounded sample: EXAMPLES labelled rows, chosen by a hash of the id, and
of those whole texts up to BYTES in all.

Edge cases: null and empty texts have no hits and get the base score; a null label is no example;
without examples of both kinds there is no lexicon and every score is 0; very long texts are scored
whole; repeated rows are scored alike; entries of equal strength go by length, then alphabet; an empty
table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

import math
import unicodedata
from collections import Counter, defaultdict
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meritlens.llm.common import fold_of, labelled_sample, slices, texts_of

#: Bounds of the sample that the lexicon is learned from: rows and bytes of text.
EXAMPLES, BYTES = 6000, 48 << 20
#: Letters of a word beginning; shorter words are entries as a whole.
LEAST, MOST = 4, 20
THRESHOLD = 0.3
LEAST_SURPRISE = 30.0
FOLDS, HELD_OUT = 4, 2
#: Benign phrases that contain words often used as insults.
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "clown fish", "pond scum", "soap scum")
#: Letters of other scripts that look like Latin ones.
HOMOGLYPHS = {
    "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t",
    "у": "y", "х": "x", "і": "i", "ї": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ѵ": "v",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t",
    "υ": "u", "χ": "x", "ϲ": "c", "ϳ": "j", "ı": "i", "ɑ": "a", "ɡ": "g", "ℓ": "l",
}
#: Digits and symbols that stand for letters.
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "|": "i"}
#: Accented letters that tell words apart in their languages; all other accents are taken off.
ACCENTED = "".join(map(chr, range(0xC0, 0x180)))
INVISIBLE = "­​‌‍⁠﻿"


class Folding(dict):
    """str.translate table that works out each character's folded form when first met."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        if c in INVISIBLE:
            found = ""
        elif c in SUBSTITUTES:
            found = SUBSTITUTES[c]
        else:
            form = "NFKC" if c in ACCENTED else "NFKD"
            plain = "".join(x for x in unicodedata.normalize(form, c).lower() if not unicodedata.combining(x))
            found = "".join(HOMOGLYPHS.get(x, x if x.isalnum() else " ") for x in plain)
            found = found.translate({ord("l"): "i"})
            if not found and not unicodedata.combining(c):
                found = " "
        self[code] = found
        return found


FOLD = Folding()


def fold(text: str) -> str:
    """Folded text with a space on either side."""
    return f" {text.translate(FOLD)} "


@dataclass(frozen=True)
class Lexicon:
    """Entries (with a leading space) and exception phrases with weights; the logistic curve."""

    weights: dict[str, float] = field(default_factory=dict)
    coefficients: tuple[float, float, float] = (-math.inf, 0.0, 0.0)

    def automaton(self):
        import ahocorasick

        found = ahocorasick.Automaton()
        for entry, weight in self.weights.items():
            found.add_word(entry, weight)
        found.make_automaton()
        return found

    def score(self, hits: np.ndarray, words: np.ndarray) -> np.ndarray:
        bias, a, b = self.coefficients
        if bias == -math.inf:
            return np.zeros(len(hits))
        hits = np.maximum(hits, 0)
        z = bias + a * np.log1p(hits) + b * np.log1p(1000 * hits / np.maximum(words, 1))
        return 1 / (1 + np.exp(-np.clip(z, -700, 700)))


def _weigh(automaton, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Weighted hits and number of words of each folded text."""
    hits = np.array([sum(w for _, w in automaton.iter(t)) for t in texts], dtype=float)
    return hits, np.array([t.count(" ") for t in texts], dtype=float)


def _beginnings(word: str) -> list[str]:
    return [word[:k] for k in range(LEAST, min(len(word), MOST) + 1)] or [f"{word} "]


def _entries(examples: list[tuple[str, int]], ratio: float, support: int) -> dict[str, float]:
    """Word beginnings that toxic texts hold far more often, with their log odds.

    ``support`` counts the different words before a beginning, so that what only the copies of one
    text share is not taken for an insult."""
    found = {0: Counter(), 1: Counter()}
    before = defaultdict(set)
    kinds = Counter(y for _, y in examples)
    for text, y in examples:
        words = text.split()
        found[y].update({b for w in set(words) for b in _beginnings(w)})
        if y:
            for a, w in zip(["", *words], words):
                for b in _beginnings(w):
                    before[b].add(a)
    weights = {
        b: math.log((n + 0.5) / (kinds[1] + 1)) - math.log((found[0][b] + 0.5) / (kinds[0] + 1))
        for b, n in found[1].items()
        if min(n, len(before[b])) >= support
    }
    strength = {
        b: _surprise(found[1][b], kinds[1], found[0][b], kinds[0]) for b, w in weights.items() if w >= math.log(ratio)
    }
    kept: set[str] = set()
    inside: set[str] = set()  # beginnings of what is kept
    for b in sorted(strength, key=lambda b: (-strength[b], -len(b), b)):
        if strength[b] < LEAST_SURPRISE:
            break
        if b not in inside and not any(b[:k] in kept for k in range(LEAST, len(b))):
            kept.add(b)
            inside.update(_beginnings(b.strip()))
    return {b: weights[b] for b in kept}


def _surprise(a: int, m: int, b: int, n: int) -> float:
    """Log-likelihood ratio (G squared) of a of m toxic against b of n other texts."""
    rate = (a + b) / (m + n)
    terms = ((a, m * rate), (m - a, m * (1 - rate)), (b, n * rate), (n - b, n * (1 - rate)))
    return 2 * sum(seen * math.log(seen / due) for seen, due in terms if seen > 0 and due > 0)


def _exceptions(examples: list[tuple[str, int]], entries: dict[str, float]) -> dict[str, float]:
    """Given and learned two-word phrases that take an entry's weight back."""
    out = {}
    starts = tuple(entries)
    for phrase in EXCEPTIONS:
        folded = fold(phrase)
        own = sum(w for e, w in entries.items() if f" {e}" in folded)
        if own:
            out[folded] = -own
    counts: dict[str, Counter] = defaultdict(Counter)
    for text, y in examples:
        words = text.split()
        for a, b in zip(words, words[1:]):
            if f"{a} ".startswith(starts) or f"{b} ".startswith(starts):
                counts[f" {a} {b} "][y] += 1
    for phrase, n in counts.items():
        if n[0] >= 5 and not n[1]:
            out[phrase] = -sum(w for e, w in entries.items() if f" {e}" in phrase)
    return out


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.01) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = x.T @ (x * (p * (1 - p))[:, None]) + ridge * np.eye(x.shape[1])
        step = np.linalg.solve(hessian, x.T @ (p - y) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(examples: list[tuple[str, int]], ratio: float = 4.0, support: int = 5) -> Lexicon:
    """Learn entries, exceptions and the curve from (text, label) examples."""
    folded = [(fold(t), int(bool(y))) for t, y in examples]
    if len({y for _, y in folded}) < 2:
        return Lexicon()
    entries = _entries(folded, ratio, support)
    weights = {f" {e}": w for e, w in entries.items()} | _exceptions(folded, entries)
    y = np.array([y for _, y in folded], dtype=float)
    if not weights:
        return Lexicon({}, (math.log(y.mean() / (1 - y.mean())), 0.0, 0.0))
    lexicon = Lexicon(weights)
    hits, words = _weigh(lexicon.automaton(), [t for t, _ in folded])
    hits = np.maximum(hits, 0)
    x = np.column_stack([np.ones(len(y)), np.log1p(hits), np.log1p(1000 * hits / np.maximum(words, 1))])
    return Lexicon(weights, tuple(_logistic(x, y)))


def learn(spark: SparkSession, docs: DataFrame, labels: DataFrame, max_rows: int = EXAMPLES) -> Lexicon:
    """Lexicon from a bounded sample of labelled documents outside the held-out fold."""
    rows = labelled_sample(spark, docs, labels, "toxic", FOLDS, HELD_OUT, max_rows, BYTES)
    return fit([(text, y) for _, text, y in rows])


@lru_cache(maxsize=2)
def _automaton(entries: tuple[tuple[str, float], ...]):
    return Lexicon(dict(entries)).automaton() if entries else None


def score(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """(doc_id, score, hits, words) of every row's whole text; hits are weighted."""
    weigh = _weigher(lexicon)

    def run(batches):
        for batch in batches:
            for start, stop in slices(batch, "text"):
                hits, words = weigh(texts_of(batch, "text", start, stop))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(start, stop - start), pa.array(lexicon.score(hits, words)), pa.array(hits), pa.array(words)],
                    names=["doc_id", "score", "hits", "words"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, score double, hits double, words double"
    )


def _weigher(lexicon: Lexicon):
    """A function from texts to weighted hits and words; each worker builds the automaton once."""
    entries = tuple(sorted(lexicon.weights.items()))

    def weigh(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        folded = [fold(t) for t in texts]
        if not entries:
            return np.zeros(len(folded)), np.array([t.count(" ") for t in folded], dtype=float)
        return _weigh(_automaton(entries), folded)

    return weigh


def clean(spark: SparkSession, docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose score stays under ``threshold``."""
    lexicon = learn(spark, docs, labels)
    weigh = _weigher(lexicon)

    def run(batches):
        for batch in batches:
            for start, stop in slices(batch, "text"):
                kept = lexicon.score(*weigh(texts_of(batch, "text", start, stop))) < threshold
                yield batch.slice(start, stop - start).filter(pa.array(kept))

    return docs.mapInArrow(run, docs.schema)


def op1(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, learn(spark, docs, labels)).select(
        "doc_id",
        (fold_of("doc_id", FOLDS) == HELD_OUT).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
        "hits",
        "words",
    )
