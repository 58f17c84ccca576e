"""Language identification by cross-parsing entropy.

For each language a suffix automaton of labelled text is built.  A document is parsed into the
fewest phrases that all occur in that text: each phrase is the longest match from where the last
one ended.  Phrases grow with the logarithm of the text they are looked up in, so the counts are
multiplied by the logarithm of the labelled letters: that is the cross entropy of the document, up to its
length, and a language with little labelled text is not at a loss.  The language of the least
product wins (ties go to the language that sorts first).

The automaton is turned into a table in which a step without a match goes on from the start and
counts a phrase.  All letters of the sample are kept: the table is dense for the DENSE most frequent
ones, the steps by others are found by binary search.  Texts are walked many at a time, one numpy step per
position, for all languages at once; a long text is walked to its end, BLOCK positions laid out at a time.

The labelled sample is bounded: LANGUAGES languages, the most frequent first (ties by name), EXAMPLES
rows shared evenly among them, chosen by a hash of the id, and of those whole texts as long as they
fit into the language's share of LETTERS letters.  Texts over that share are passed over, unless the rows
chosen of a language hold no other; then a text is cut.

Edge cases: a text that is null or has no letter gets ``und`` and score 0; without labelled
documents every other text gets ``und`` too; texts of any length are parsed whole; repeated rows get
equal results; a doc_id that occurs with several languages or texts gives one example for each; an
empty table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

import math
import unicodedata
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from meritlens.llm.common import fold_of, slices, texts_of

#: Bounds of the labelled sample: rows, languages, letters of all automata together and of one.
EXAMPLES, LANGUAGES = 2000, 1000
LETTERS, EACH = 192_000, 24_000
#: Letters with a column of their own in the table; the steps by others are listed.
DENSE = 62
FOLDS, HELD_OUT = 5, 0
BLOCK = 2048
LANES = 2048
UND = "und"


class SuffixAutomaton:
    """Suffix automaton of a sequence of small integers; state 0 is the start."""

    def __init__(self, sequence: np.ndarray):
        self.next: list[dict[int, int]] = [{}]
        link, size, last = [-1], [0], 0
        for c in sequence.tolist():
            here = len(self.next)
            self.next.append({})
            link.append(0)
            size.append(size[last] + 1)
            p = last
            while p >= 0 and c not in self.next[p]:
                self.next[p][c] = here
                p = link[p]
            if p >= 0:
                q = self.next[p][c]
                if size[p] + 1 == size[q]:
                    link[here] = q
                else:
                    copy = len(self.next)
                    self.next.append(dict(self.next[q]))
                    link.append(link[q])
                    size.append(size[p] + 1)
                    link[q] = link[here] = copy
                    while p >= 0 and self.next[p].get(c) == q:
                        self.next[p][c] = copy
                        p = link[p]
            last = here

    def table(self, width: int) -> np.ndarray:
        """Entry [state * width + letter]: twice the next state, plus 1 if a new phrase begins.

        The last state, after all of the automaton's, is that between two phrases: there a text
        begins, and a letter that the automaton lacks is a phrase of its own and leads there.  The
        last column is that of such letters; the steps by letters from there on are in :meth:`listed`."""
        start = np.full(width, 2 * len(self.next) + 1, dtype=np.int64)
        for c, s in self.next[0].items():
            if c < width - 1:
                start[c] = 2 * s + 1
        out = np.tile(start, (len(self.next) + 1, 1))
        for state, steps in enumerate(self.next):
            own = {c: s for c, s in steps.items() if c < width - 1}
            if own:
                out[state, list(own)] = 2 * np.fromiter(own.values(), dtype=np.int64)
        return out.ravel()

    def listed(self, width: int) -> list[tuple[int, int, int]]:
        """(state, letter, next state) of the letters without a column of their own."""
        return [(state, c, s) for state, steps in enumerate(self.next) for c, s in steps.items() if c >= width - 1]


@dataclass(frozen=True)
class Model:
    """Languages, the folded alphabet (code points to letters) and their stacked tables.

    ``keys`` (state * letters + letter, ascending) and ``values`` are the listed steps; ``first``
    has for each language and listed letter the step that begins a phrase; ``weights`` are the
    logarithms of the languages' labelled letters."""

    languages: tuple[str, ...]
    alphabet: dict[int, int]
    letters: int
    width: int
    table: np.ndarray
    starts: tuple[int, ...]
    keys: np.ndarray
    values: np.ndarray
    first: np.ndarray
    weights: np.ndarray


class Folder:
    """Texts to letters: lower case, one space (letter 0) for a run of other characters."""

    def __init__(self, alphabet: dict[int, int], letters: int):
        kinds = np.full(0x110000, 0, dtype=np.int32)
        self.is_letter = np.zeros(0x110000, dtype=bool)
        for code in range(0x110000):
            c = chr(code)
            if c.isalpha():
                self.is_letter[code] = True
                low = c.lower()
                kinds[code] = alphabet.get(ord(low[0]), letters - 1)
        self.kinds = kinds

    def fold(self, text: str) -> np.ndarray:
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
        if not len(codes) or not self.is_letter[codes].any():
            return np.zeros(0, dtype=np.int32)
        kinds = self.kinds[codes]
        space = kinds == 0
        return kinds[~(space & np.concatenate([[True], space[:-1]]))]


def _alphabet(texts: list[str]) -> tuple[dict[int, int], int]:
    """Letters by frequency from 1 on; 0 is the space and the last letter is any other."""
    counts: Counter = Counter()
    for t in texts:
        counts.update(c for c in unicodedata.normalize("NFC", t.lower()) if c.isalpha())
    ranked = sorted(counts, key=lambda c: (-counts[c], c))
    return {ord(c): i + 1 for i, c in enumerate(ranked)}, len(ranked) + 2


def share(languages: int) -> int:
    """Labelled letters of one language."""
    return min(EACH, max(1, LETTERS // max(1, languages)))


def fit(examples: list[tuple[str, str]], letters: int | None = None) -> Model:
    """Automata from (text, language) examples, in the order given; whole texts while they fit into ``letters``."""
    by: dict[str, list[str]] = {}
    for text, lang in examples:
        by.setdefault(lang, []).append(text)
    languages = tuple(sorted(by))
    letters = share(len(languages)) if letters is None else letters
    alphabet, size = _alphabet([t for lang in languages for t in by[lang]])
    folder = Folder(alphabet, size)
    width = min(size, DENSE + 2)
    tables, starts, weights, states = [], [], [], 0
    listed, first = [], np.zeros((len(languages), size - width), dtype=np.int64)
    for k, lang in enumerate(languages):
        parts, have = [], 0
        for own in map(folder.fold, by[lang]):
            if have + len(own) < letters:
                parts.append(np.append(own, 0))
                have += len(own) + 1
        if not parts:
            parts = [folder.fold(min(by[lang], key=lambda t: (len(t), t)))[:letters]]
        sequence = np.concatenate(parts)
        weights.append(math.log(len(sequence) + 2))
        automaton = SuffixAutomaton(sequence)
        table = automaton.table(width)
        tables.append(table + 2 * states)
        first[k] = table[-1] + 2 * states
        for state, c, s in automaton.listed(width):
            listed.append(((state + states) * size + c, 2 * (s + states)))
            if state == 0:
                first[k, c - width + 1] = 2 * (s + states) + 1
        states += len(table) // width
        starts.append(states - 1)
    table = np.concatenate(tables) if tables else np.zeros(0, np.int64)
    # pre-multiplied, so that a step is one addition and one look-up
    scaled = lambda x: ((x >> 1) * width * 2 + (x & 1)).astype(np.int32)
    steps = np.array(sorted(listed), dtype=np.int64).reshape(-1, 2)
    return Model(
        languages, alphabet, size, width, scaled(table), tuple(starts), steps[:, 0].copy(), scaled(steps[:, 1]), scaled(first), np.array(weights)
    )


class Parser:
    """Counts the phrases of many texts at once."""

    def __init__(self, model: Model):
        self.model = model
        self.folder = Folder(model.alphabet, model.letters)

    def phrases(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(texts x languages) phrase counts and the number of letters of each text."""
        folded = [self.folder.fold(t) for t in texts]
        sizes = np.array([len(f) for f in folded])
        counts = np.zeros((len(texts), len(self.model.languages)), dtype=np.int64)
        order = np.argsort(-sizes, kind="stable")
        order = order[sizes[order] > 0]
        for at in range(0, len(order), LANES):
            own = order[at : at + LANES]
            counts[own] = self._walk([folded[i] for i in own])
        return counts, sizes

    def _walk(self, own: list[np.ndarray]) -> np.ndarray:
        """Phrase counts of folded texts, the longest first."""
        table, m, last = self.model.table, len(self.model.languages), self.model.width - 1
        lengths = np.array([len(f) for f in own])
        begin = np.array(self.model.starts, dtype=np.int32) * self.model.width
        state = np.repeat(begin[:, None], len(own), axis=1)
        count = np.zeros((m, len(own)), dtype=np.int64)
        for at in range(0, lengths[0], BLOCK):
            lanes = int(np.searchsorted(-lengths, -at))
            rows = min(BLOCK, lengths[0] - at)
            steps = np.zeros((rows, lanes), dtype=np.int32)
            for k in range(lanes):
                part = own[k][at : at + BLOCK]
                steps[: len(part), k] = part
            live = np.searchsorted(-lengths, -np.arange(at + 1, at + rows + 1), side="right")
            for row, n in zip(steps, live.tolist()):
                letter = row[:n]
                step = table[state[:, :n] + np.minimum(letter, last)]
                rare = np.flatnonzero((letter >= last) & (letter < self.model.letters - 1))
                if len(rare):
                    step[:, rare] = self._listed(state[:, rare], letter[rare])
                count[:, :n] += step & 1
                state = step >> 1
        return count.T

    def _listed(self, state: np.ndarray, letter: np.ndarray) -> np.ndarray:
        """Steps by letters without a column of their own."""
        model = self.model
        begin = model.first[:, letter - model.width + 1]
        if not len(model.keys):
            return begin
        wanted = (state // model.width).astype(np.int64) * model.letters + letter
        at = np.minimum(np.searchsorted(model.keys, wanted), len(model.keys) - 1)
        return np.where(model.keys[at] == wanted, model.values[at], begin)


def predict(model: Model, phrases: np.ndarray, sizes: np.ndarray) -> tuple[list[str], np.ndarray]:
    """The language of fewest normalised phrases; the score is its share of lead over the next, from 0.5 on."""
    languages = model.languages
    if not languages:
        return [UND] * len(sizes), np.zeros(len(sizes))
    counts = phrases * (model.weights / model.weights.max())
    best = counts.argmin(axis=1)
    least = counts[np.arange(len(sizes)), best]
    if len(languages) == 1:
        score = np.ones(len(sizes))
    else:
        second = np.partition(counts, 1, axis=1)[:, 1]
        score = 1 / (1 + np.exp(-np.clip(2 * (second - least) / np.sqrt(second + 1), 0, 60)))
    names = [languages[b] if n else UND for b, n in zip(best, sizes)]
    return names, np.where(sizes > 0, score, 0.0)


def learn(spark: SparkSession, docs: DataFrame, max_rows: int = EXAMPLES) -> Model:
    """Model from a bounded sample of documents with a language outside the held-out fold."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold_of("doc_id", FOLDS) != HELD_OUT))
    found = known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES).collect()
    if not found:
        return fit([])
    names, most = sorted(r.lang for r in found), share(len(found))
    each, scale = max(1, max_rows // len(names)), 1 << 30
    # about twice the rows wanted of each language, by a hash of the id; of those the first in order
    parts = F.create_map(*(F.lit(x) for r in found for x in (r.lang, min(scale, 2 * each * scale // r["count"] + 1))))
    chosen = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(scale)) < F.coalesce(F.try_element_at(parts, F.col("lang")), F.lit(0)))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("long", "hash", "size"))
    listed = chosen.select(
        "lang", (F.length("text") > most).alias("long"), F.xxhash64("doc_id").alias("hash"), F.length("text").alias("size"),
        F.substring("text", 1, most).alias("text"),
    )
    rows = listed.withColumn("rank", rank).where(F.col("rank") <= each).collect()
    whole = {r.lang for r in rows if not r.long}
    rows = sorted((r.lang, r["rank"], r.text) for r in rows if not r.long or r.lang not in whole)
    return fit([(text, lang) for lang, _, text in rows], most)


def detect(spark: SparkSession, docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score, phrases) of every row's whole text."""
    shared = spark.sparkContext.broadcast(model)  # bounded by LETTERS

    def run(batches):
        parser = Parser(shared.value)
        for batch in batches:
            for start, stop in slices(batch, "text", 3 << 20):
                counts, sizes = parser.phrases(texts_of(batch, "text", start, stop))
                names, score = predict(parser.model, counts, sizes)
                least = counts.min(axis=1) if counts.shape[1] else np.zeros(len(sizes), np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(start, stop - start), pa.array(names, pa.string()), pa.array(score), pa.array(least)],
                    names=["doc_id", "lang_pred", "score", "phrases"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, lang_pred string, score double, phrases long"
    )


def op10(spark: SparkSession, docs: DataFrame) -> DataFrame:
    return detect(spark, docs, learn(spark, docs)).select(
        "doc_id", (fold_of("doc_id", FOLDS) == HELD_OUT).alias("held_out"), "lang_pred", "score", "phrases"
    )
