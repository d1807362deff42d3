"""Language identification of mixed-language text.

A word's script narrows the languages that it can belong to; among those it is
scored by what a bounded sample of labelled texts has of it, or, for a word that
the sample has not, of its letter trigrams.  A Viterbi pass over the words, with
a penalty for every switch, labels spans; a text's language is the one with
the most words.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from typeweave.llm.common import time_major
from typeweave.operators.fixpoint import written

# Where the blocks of some scripts begin, by code point; a block lasts until the next begins.
SCRIPT_STARTS = [
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"), (0x0700, "other"),
    (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, "gurmukhi"), (0x0A80, "gujarati"), (0x0B00, "oriya"), (0x0B80, "tamil"), (0x0C00, "telugu"),
    (0x0C80, "kannada"), (0x0D00, "malayalam"), (0x0D80, "sinhala"), (0x0E00, "thai"), (0x0E80, "lao"), (0x0F00, "tibetan"), (0x1000, "myanmar"),
    (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "ethiopic"), (0x13A0, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"),
    (0x3040, "kana"), (0x3100, "other"), (0x3400, "han"), (0xA000, "other"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "other"),
]
_STARTS = [s for s, _ in SCRIPT_STARTS]
#: Labelled texts that the model is fitted on, at most; how often they must have a word, and a trigram, for it to say something of its own.
SAMPLE, WORDS, TRIGRAMS = 20_000, 3, 2
#: Cost, in nats, of a switch of language; the most that one word says; words whose scores a worker remembers.
SWITCH, MOST, REMEMBERED = 8.0, 6.0, 200_000
#: Words that are decoded together.
CHUNK = 400_000
_STRIP = ".,;:!?\"'()[]{}<>|%&$*#@+=/\\-_–—…«»“”„’0123456789"


def script_of(word: str) -> str | None:
    """The script of a word's first letter; None without a letter."""
    for c in word:
        if c.isalpha():
            return SCRIPT_STARTS[bisect_right(_STARTS, ord(c)) - 1][1]
    return None


def _grams(word: str) -> list[str]:
    padded = f"^{word}$"
    return [padded[i : i + 3] for i in range(len(padded) - 2)] or [padded]


@dataclass
class Model:
    """Scores are log probabilities, relative to the mean over languages; row 0 of the trigrams is for unknown ones."""

    langs: list[str]
    scripts: dict[str, np.ndarray]
    words: dict[str, int]
    word_scores: np.ndarray
    grams: dict[str, int]
    gram_scores: np.ndarray

    @property
    def plain(self) -> set[str]:
        """Scripts that all languages have."""
        return {k for k, allowed in self.scripts.items() if allowed.all()}


class _Scores(dict):
    """Raw token -> row of a score matrix; row 0 is for tokens without letters.

    New tokens only get a row; `rows_of` fills in the scores of many at once.
    """

    def __init__(self, model: Model) -> None:
        self.model, self.plain = model, model.plain
        self.reset()

    def reset(self) -> None:
        self.clear()
        self.matrix = np.zeros((1, len(self.model.langs)), np.float32)
        self._fresh()

    def _fresh(self) -> None:
        self.added, self.known, self.unknown, self.flat, self.starts, self.masked = 0, [], [], [], [], []

    def __missing__(self, token: str) -> int:
        script = script_of(token)
        if script is None:
            self[token] = 0
            return 0
        row = self[token] = len(self.matrix) + self.added
        self.added += 1
        word = token.strip(_STRIP).lower()
        place = self.model.words.get(word)
        if place is not None:
            self.known.append((row, place))
        else:
            get = self.model.grams.get
            self.unknown.append(row)
            self.starts.append(len(self.flat))
            self.flat += [get(g, 0) for g in _grams(word)]
        if script not in self.plain:
            self.masked.append((row, script))
        return row

    def rows_of(self, rows: np.ndarray) -> np.ndarray:
        if self.added:
            self.matrix = np.concatenate([self.matrix, np.zeros((self.added, self.matrix.shape[1]), np.float32)])
            if self.known:
                at, place = np.array(self.known).T
                self.matrix[at] = self.model.word_scores[place]
            if self.unknown:
                self.matrix[self.unknown] = 0.5 * np.add.reduceat(self.model.gram_scores[self.flat], self.starts)
            new = self.matrix[-self.added :]
            np.clip(new, -MOST, MOST, out=new)
            for row, script in self.masked:
                allowed = self.model.scripts.get(script)
                if allowed is not None:
                    self.matrix[row][~allowed] = -4 * MOST
            self._fresh()
        return self.matrix[rows]


def viterbi(scores: np.ndarray, lengths: np.ndarray, penalty: float) -> np.ndarray:
    """The best state of every item of flat sequences of these lengths; scores has a row an item."""
    states = np.zeros(len(scores), np.int16)
    order = np.argsort(-lengths, kind="stable")
    starts = np.concatenate([[0], np.cumsum(lengths)])[:-1]
    at, begins = time_major(order, starts, lengths)
    if not len(at):
        return states
    s = scores[at]
    steps = len(begins) - 1
    best = s[: begins[1]].copy()
    stays, jumps = [], []
    for t in range(1, steps):
        n = begins[t + 1] - begins[t]
        now = best[:n]
        jump = now.argmax(axis=1)
        bar = now[np.arange(n), jump][:, None] - penalty
        stay = now >= bar
        best[:n] = np.where(stay, now, bar) + s[begins[t] : begins[t + 1]]
        stays.append(stay)
        jumps.append(jump)
    state = best.argmax(axis=1)
    for t in range(steps - 1, -1, -1):
        n = begins[t + 1] - begins[t]
        states[at[begins[t] : begins[t + 1]]] = state[:n]
        if t:
            keep = stays[t - 1][np.arange(n), state[:n]]
            state[:n] = np.where(keep, state[:n], jumps[t - 1])
    return states


def fit(docs: DataFrame, *, text: str = "text", lang: str = "lang", key: str = "doc_id", bound: int = SAMPLE) -> Model:
    """Fit on about `bound` texts with a language at most, chosen by a hash of key and text.

    Words and trigrams that the sample has a few times only are left to the
    smoothing.  Without a labelled text the model knows no language.  Null
    languages and texts teach nothing; repeated rows are taken or left together.
    """
    usable = docs.select(F.col(text).alias("text"), F.col(lang).alias("lang"), F.xxhash64(key, text).alias("h")).where("lang is not null and text is not null")
    total = usable.count()
    part = min(1.0, 0.95 * bound / max(total, 1))
    some = usable.where(F.pmod("h", F.lit(1_000_000)) < int(part * 1_000_000)).select("text", "lang")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = defaultdict(Counter)

        def out() -> Iterator[pa.RecordBatch]:
            for lang, raw in held.items():
                words, grams, scripts = Counter(), Counter(), Counter()
                for t, k in raw.items():
                    w = t.strip(_STRIP).lower()
                    script = script_of(w)
                    if script:
                        words[w] += k
                        scripts[script] += k
                        for g in _grams(w):
                            grams[g] += k
                for kind, counts in (("word", words), ("gram", grams), ("script", scripts)):
                    n = len(counts)
                    yield pa.RecordBatch.from_arrays([pa.array([kind] * n), pa.array([lang] * n), pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], ["kind", "lang", "item", "n"])
            held.clear()

        for batch in batches:
            for x, own in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                held[own].update(x.as_py().split())
                if sum(map(len, held.values())) > 100_000:
                    yield from out()
        yield from out()

    counts = some.mapInArrow(run, "kind string, lang string, item string, n long").groupBy("kind", "lang", "item").agg(F.sum("n").alias("n"))
    counts = written(counts, "language-counts")
    totals = counts.groupBy("kind", "lang").agg(F.sum("n").alias("n")).collect()
    langs = sorted({r["lang"] for r in totals})
    if not langs:
        return Model([], {}, {}, np.zeros((0, 0)), {}, np.zeros((1, 0)))
    size = {(r["kind"], r["lang"]): r["n"] for r in totals}
    own = [F.coalesce(F.sum(F.when(F.col("lang") == x, F.col("n"))), F.lit(0)).alias(f"l{i}") for i, x in enumerate(langs)]
    per_item = counts.where("item is not null").groupBy("kind", "item").agg(F.sum("n").alias("n"), *own)

    def collected(kind: str, least: int) -> tuple[list[str], np.ndarray]:
        """The items that occur often enough and their counts by language; through Arrow, which takes less memory than rows."""
        top = per_item.where((F.col("kind") == kind) & (F.col("n") >= least)).orderBy("item").toArrow()
        return top.column("item").to_pylist(), np.stack([top.column(f"l{i}").to_numpy() for i in range(len(langs))], axis=1).astype(float)

    def table(kind: str, least: int, smooth: float) -> tuple[dict[str, int], np.ndarray]:
        all_of = np.array([max(size.get((kind, x), 0), 1) for x in langs], float)
        items, rows = collected(kind, least)
        scores = np.log((np.concatenate([np.zeros((1, len(langs))), rows]) + smooth) / (all_of + smooth * (len(items) + 1)))
        scores -= scores.mean(axis=1, keepdims=True)
        scores[0] = 0
        return {x: i + 1 for i, x in enumerate(items)}, scores.astype(np.float32)

    scripts: dict[str, np.ndarray] = {}
    for script, row in zip(*collected("script", 1), strict=True):
        held = np.array([n >= 0.01 * size.get(("script", x), 1) and n > 0 for n, x in zip(row, langs, strict=True)])
        scripts[script] = held if held.any() else np.ones(len(langs), bool)
    return Model(langs, scripts, *table("word", WORDS, 0.5), *table("gram", TRIGRAMS, 0.5))


def _labelled(texts: list[str | None], scores: _Scores, penalty: float) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(place, state of each token, whether it has a letter) of each text, some texts at a time."""
    chunk, held = [], 0
    for i in np.argsort([-len(x or "") for x in texts], kind="stable").tolist() + [-1]:
        if i >= 0:
            tokens = (texts[i] or "").split()
            chunk.append((i, np.fromiter(map(scores.__getitem__, tokens), np.int64, len(tokens))))
            held += len(tokens)
        if chunk and (i < 0 or held >= CHUNK or len(scores) >= REMEMBERED):
            rows = np.concatenate([r for _, r in chunk])
            lengths = np.array([len(r) for _, r in chunk])
            states = viterbi(scores.rows_of(rows), lengths, penalty)
            ends = np.cumsum(lengths)
            for (k, _), n, end in zip(chunk, lengths, ends, strict=True):
                yield k, states[end - n : end], rows[end - n : end] > 0
            chunk, held = [], 0
            if len(scores) >= REMEMBERED:
                scores.reset()


def label_spans(docs: DataFrame, model: Model, *, text: str = "text", key: str = "doc_id", penalty: float = SWITCH) -> DataFrame:
    """(key, first_word, last_word, lang) with a row for each span of one language, in white-space words from 0.

    Spans cover all words of a text that has a letter; other texts have no row,
    nor has any if the model knows no language.
    """
    kind = dict(docs.dtypes)[key]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores, langs = _Scores(shared.value), shared.value.langs
        for batch in batches:
            keys, first, last, found = [], [], [], []
            for i, states, lettered in _labelled(batch.column(1).to_pylist(), scores, penalty) if langs else ():
                if lettered.any():
                    cuts = np.concatenate([[0], np.flatnonzero(np.diff(states)) + 1, [len(states)]])
                    keys += [i] * (len(cuts) - 1)
                    first += cuts[:-1].tolist()
                    last += (cuts[1:] - 1).tolist()
                    found += [langs[states[c]] for c in cuts[:-1]]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keys, pa.int64())), pa.array(first, pa.int64()), pa.array(last, pa.int64()), pa.array(found, pa.string())], ["own_key", "first_word", "last_word", "lang"])

    rows = docs.select(F.col(key).alias("own_key"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, f"own_key {kind}, first_word long, last_word long, lang string").withColumnRenamed("own_key", key)


def predict(docs: DataFrame, model: Model, *, text: str = "text", key: str = "doc_id", penalty: float = SWITCH) -> DataFrame:
    """(doc_id, lang_pred, score) for every document: the language with the most lettered words, and their share.

    Ties go to the language that sorts first.  A text that is null or has no
    letter is `und` with score 0, as is every text if the model knows no language.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores, langs = _Scores(shared.value), shared.value.langs
        for batch in batches:
            names, shares = ["und"] * batch.num_rows, [0.0] * batch.num_rows
            for i, states, lettered in _labelled(batch.column(1).to_pylist(), scores, penalty) if langs else ():
                if lettered.any():
                    counts = np.bincount(states[lettered], minlength=len(langs))
                    names[i], shares[i] = langs[int(counts.argmax())], float(counts.max() / counts.sum())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(shares, pa.float64())], ["doc_id", "lang_pred", "score"])

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double")
