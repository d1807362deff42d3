"""Scoring with a hidden Markov language model.

Words fall into a bounded number of classes: each frequent word is a class, rare
and unknown words share classes by their last letters.  Latent states emit
classes, a class gives its words in proportion to their counts:

    P(text) = forward(classes) * product of P(word | class)

Word counts come from all training texts.  Texts are then encoded once, as
classes of their words, and written; training and scoring read only those.
States begin as the class counts of a few texts far from each other, of those
whose hashes are least, and become what Baum-Welch passes over all training
texts make of them: expected counts are summed across partitions.  The forward
recursion is scaled step by step, so that the likelihood of a text of any length
is exact, and long texts pass in blocks.  Counts of words beyond a bounded table
of the frequent ones are joined, not broadcast.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from typeweave.llm.common import time_major, words_of
from typeweave.operators.fixpoint import written

#: Words whose counts are broadcast, at most; those that are classes of their own; classes of the others; states.
KNOWN, OWN, ENDINGS, STATES = 1 << 17, 1 << 13, 1 << 10, 6
CLASSES = OWN + ENDINGS + 1
END_CLASS = CLASSES - 1
#: Texts that the states' beginnings are picked from; passes over all training texts.
BEGINNINGS, PASSES = 64, 3
#: Added to every word's count, and the weight of the classes' own shares in each state's emissions.
ADD, PRIOR = 0.1, 50.0
#: Tokens that are recursed together (a longer text passes in blocks of so many); words that a task counts before it passes them on.
CHUNK, HELD = 300_000, 200_000
#: The end of a text, as a word: no word is empty.
END = b""


def ending_class(word: bytes) -> int:
    return OWN + zlib.crc32(word[-3:]) % ENDINGS


class Ranks(dict):
    """Word -> its place in the table of frequent words, or KNOWN + its ending's number."""

    def __missing__(self, word: bytes) -> int:
        return KNOWN + ending_class(word) - OWN


@dataclass
class Vocabulary:
    """The frequent words by falling count, and figures of all words."""

    words: list[bytes]
    counts: np.ndarray
    tokens: int
    size: int

    def ranks(self) -> Ranks:
        return Ranks((w, i) for i, w in enumerate(self.words))

    def classes(self) -> np.ndarray:
        """Class of each rank, and of each ending beyond KNOWN."""
        out = np.zeros(KNOWN + ENDINGS, np.int32)
        for i, w in enumerate(self.words):
            out[i] = END_CLASS if w == END else i if i < OWN else ending_class(w)
        out[KNOWN:] = OWN + np.arange(ENDINGS)
        return out


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, c) over all rows of (text); every text, null or empty too, has one end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.binary()), pa.array(held.values(), pa.int64())], ["word", "c"])
            held.clear()
            return batch

        for batch in batches:
            held[END] += batch.num_rows
            for x in batch.column(0):
                held.update(words_of(x.as_py()))
                if len(held) > HELD:
                    yield out()
        yield out()

    return texts.mapInArrow(run, "word binary, c long").where("c > 0").groupBy("word").agg(F.sum("c").alias("c"))


def vocabulary(counts: DataFrame, *, known: int = KNOWN) -> tuple[Vocabulary, int]:
    """The frequent words, and the count that they all exceed; as many as `known` at most."""
    step = F.floor(F.log2("c") * 64).cast("int")
    bins = counts.groupBy(step.alias("bin")).agg(F.count("*").alias("n"), F.sum("c").alias("c"), F.min("c").alias("least")).collect()
    above, taken = None, 0
    for r in sorted(bins, key=lambda r: -r["bin"]):
        if taken + r["n"] > known:
            break
        above, taken = r["least"] - 1, taken + r["n"]
    tokens, size = sum(r["c"] for r in bins), sum(r["n"] for r in bins)
    if above is None:
        above = max((r["least"] for r in bins), default=0) ** 2 + (1 << 62)
    found = counts.where(F.col("c") > above).select("word", "c").toArrow()
    words, c = found.column("word").to_pylist(), found.column("c").to_numpy()
    order = sorted(range(len(words)), key=lambda i: (-c[i], words[i]))
    return Vocabulary([words[i] for i in order], c[order].astype(np.int64), tokens, size), above


@dataclass
class Hmm:
    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray

    def forward(self, obs: np.ndarray, begins: np.ndarray, keep: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Scaled forward variables (if kept), scales, and emissions, in time-major order."""
        b = self.emit[obs]
        scale = np.empty(len(obs), b.dtype)
        alphas = np.empty_like(b) if keep else b
        alpha, ones = self.start * b[: begins[1]], np.ones(b.shape[1], b.dtype)
        for t in range(len(begins) - 1):
            lo, hi = begins[t], begins[t + 1]
            if t:
                alpha = alpha[: hi - lo] @ self.move
                alpha *= b[lo:hi]
            s = alpha @ ones
            alpha /= s[:, None]
            scale[lo:hi] = s
            if keep:
                alphas[lo:hi] = alpha
        return alphas, scale, b

    def _walk(self, b: np.ndarray, before: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """Scaled forward variables and scales of one sequence's block, given those before it."""
        alphas, scale = np.empty_like(b), np.empty(len(b), b.dtype)
        for t in range(len(b)):
            now = (self.start if before is None else before @ self.move) * b[t]
            scale[t] = now.sum()
            before = alphas[t] = now / scale[t]
        return alphas, scale

    def likelihoods(self, obs: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Natural log likelihood of each of flat sequences of these lengths, none of them empty."""
        if len(lengths) == 1 and len(obs) > CHUNK:
            alpha, total = None, 0.0
            for at in range(0, len(obs), CHUNK):
                alphas, scale = self._walk(self.emit[obs[at : at + CHUNK]], alpha)
                alpha, total = alphas[-1], total + np.log(scale).sum()
            return np.array([total])
        order = np.argsort(-lengths, kind="stable")
        at, begins = time_major(order, np.concatenate([[0], np.cumsum(lengths)])[:-1], lengths)
        _, scale, _ = self.forward(obs[at], begins, False)
        rank = np.arange(len(at)) - np.repeat(begins[:-1], np.diff(begins))
        return np.bincount(order[rank], weights=np.log(scale), minlength=len(lengths))

    def _emitted(self, seen: np.ndarray, gamma: np.ndarray) -> np.ndarray:
        return np.stack([np.bincount(seen, weights=gamma[:, k], minlength=len(self.emit)) for k in range(gamma.shape[1])], axis=1)

    def expected(self, obs: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Baum-Welch counts over flat sequences: starts, moves, and emissions by class."""
        if len(lengths) == 1 and len(obs) > CHUNK:
            return self._expected_in_blocks(obs)
        order = np.argsort(-lengths, kind="stable")
        at, begins = time_major(order, np.concatenate([[0], np.cumsum(lengths)])[:-1], lengths)
        seen = obs[at]
        alphas, scale, b = self.forward(seen, begins, True)
        b /= scale[:, None]
        steps = len(begins) - 1
        gamma, moves, after = alphas.copy(), np.zeros(self.move.shape), None
        for t in range(steps - 2, -1, -1):
            lo, hi, end = begins[t], begins[t + 1], begins[t + 2]
            n = end - hi
            pulled = b[hi:end]
            if after is not None:
                pulled[: len(after)] *= after
            after = pulled @ self.move.T
            gamma[lo : lo + n] *= after
        later = slice(begins[1], len(at))
        if steps > 1:
            sizes = np.diff(begins)
            before = np.arange(begins[1], len(at)) - np.repeat(sizes[:-1], sizes[1:])
            moves = self.move * (alphas[before].T @ b[later])
        return gamma[: begins[1]].sum(axis=0), moves, self._emitted(seen, gamma)

    def _expected_in_blocks(self, obs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same for one long sequence: forward once to each block, then block by block from the end."""
        cuts, entries, alpha = range(0, len(obs), CHUNK), [], None
        for at in cuts:
            entries.append(alpha)
            alpha = self._walk(self.emit[obs[at : at + CHUNK]], alpha)[0][-1]
        moves, emits, after = np.zeros(self.move.shape), np.zeros(self.emit.shape), None
        for at, entry in zip(reversed(cuts), reversed(entries), strict=True):
            seen = obs[at : at + CHUNK]
            b = self.emit[seen]
            alphas, scale = self._walk(b, entry)
            b /= scale[:, None]
            gamma = alphas.copy()
            for t in range(len(b) - 1, -1, -1):
                if after is not None:
                    beta = self.move @ after
                    gamma[t] *= beta
                    b[t] *= beta
                after = b[t]
            emits += self._emitted(seen, gamma)
            moves += alphas[:-1].T @ b[1:]
            if entry is not None:
                moves += np.outer(entry, b[0])
        return gamma[0], self.move * moves, emits

    def single(self) -> Hmm:
        """In single precision, which expected counts need no more than."""
        return Hmm(*(x.astype(np.float32) for x in (self.start, self.move, self.emit)))

    @classmethod
    def of_counts(cls, starts: np.ndarray, moves: np.ndarray, emits: np.ndarray, shares: np.ndarray) -> Hmm:
        start = (starts + 1.0) / (starts + 1.0).sum()
        move = (moves + 1.0) / (moves + 1.0).sum(axis=1, keepdims=True)
        raised = emits + PRIOR * shares[:, None]
        return cls(start, move, raised / raised.sum(axis=0))


def beginnings(counts: np.ndarray, shares: np.ndarray, states: int) -> Hmm:
    """States from the class counts of a few texts (a row each): the first, then always the one that those so far say least about; each gets its likest texts."""
    log_of = lambda c: np.log((c + PRIOR * shares) / (c.sum() + PRIOR))
    gain = lambda c: counts @ (log_of(c) - np.log(shares)) / np.maximum(counts.sum(axis=1), 1)
    emits = np.zeros((len(shares), states))
    if len(counts):
        gains = [gain(counts[0])]
        while len(gains) < states:
            gains.append(gain(counts[int(np.max(gains, axis=0).argmin())]))
        nearest = np.argmax(gains, axis=0)
        emits = np.stack([counts[nearest == k].sum(axis=0) for k in range(states)], axis=1)
    move = np.full((states, states), 0.05 / max(states - 1, 1))
    np.fill_diagonal(move, 0.95)
    raised = emits + PRIOR * shares[:, None]
    return Hmm(np.full(states, 1 / states), move / move.sum(axis=1, keepdims=True), raised / raised.sum(axis=0))


def _chunks(sequences: list[np.ndarray]) -> Iterator[list[int]]:
    """Places of sequences of similar length, some tokens at a time; a sequence of more is alone."""
    chunk, held = [], 0
    for i in sorted(range(len(sequences)), key=lambda i: -len(sequences[i])):
        chunk.append(i)
        held += len(sequences[i])
        if held >= CHUNK:
            yield chunk
            chunk, held = [], 0
    if chunk:
        yield chunk


def _sequences(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), np.uint16) for x in column]


@dataclass
class Model:
    vocabulary: Vocabulary
    above: int
    hmm: Hmm
    totals: np.ndarray


ENCODED = "row long, doc_id long, train boolean, hash long, n_tokens long, n_known long, frequent double, classes binary, rare array<struct<word:binary,n:long>>"


def encoded(docs: DataFrame, vocab: Vocabulary) -> DataFrame:
    """(doc_id, train, text) as classes, and what else of a text only the table of frequent words tells; written."""
    shared = docs.sparkSession.sparkContext.broadcast(vocab)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        ranks, classes = own.ranks(), own.classes().astype(np.uint16)
        logs = np.zeros(KNOWN + ENDINGS)
        logs[: len(own.counts)] = np.log10(own.counts + ADD)
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            n = batch.num_rows
            codes, rare, times, offsets = [], [], [], [0]
            tokens, known, frequent = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n)
            for i, x in enumerate(batch.column(3)):
                words = words_of(x.as_py())
                words.append(END)
                ids = np.fromiter(map(ranks.__getitem__, words), np.int32, len(words))
                beyond = np.flatnonzero(ids >= KNOWN)
                others = Counter(map(words.__getitem__, beyond))
                rare += others.keys()
                times += others.values()
                offsets.append(len(rare))
                tokens[i], known[i], frequent[i] = len(ids), len(ids) - len(beyond), logs[ids].sum()
                codes.append(classes[ids].tobytes())
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays([pa.array(rare, pa.binary()), pa.array(times, pa.int64())], ["word", "n"]))
            columns = [pa.array(row + np.arange(n), pa.int64()), *(batch.column(i) for i in range(3)), pa.array(tokens), pa.array(known), pa.array(frequent), pa.array(codes, pa.binary()), lists]
            row += n
            yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in ENCODED.split(", ")])

    rows = docs.select("doc_id", "train", F.xxhash64("text").alias("hash"), "text")
    out = written(rows.mapInArrow(run, ENCODED), "lm-encoded")
    shared.destroy()
    return out


def fit(codes: DataFrame, counts: DataFrame, vocab: Vocabulary, above: int, *, states: int = STATES, passes: int = PASSES) -> Model:
    """Train on the rows of `encoded` that are for training, of which `counts` are the word counts."""
    totals, seen = np.zeros(CLASSES), np.zeros(CLASSES)
    head = vocab.classes()[: len(vocab.words)]
    np.add.at(totals, head, vocab.counts + ADD)
    np.add.at(seen, head, vocab.counts)

    def per_class(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = np.fromiter(map(ending_class, batch.column(0).to_pylist()), np.int64, batch.num_rows)
            c = np.bincount(own, weights=batch.column(1).to_numpy(), minlength=CLASSES)
            n = np.bincount(own, minlength=CLASSES)
            yield pa.RecordBatch.from_arrays([pa.array(range(CLASSES), pa.int32()), pa.array(c), pa.array(n, pa.int64())], ["class", "c", "n"])

    tail = counts.where(F.col("c") <= above).select("word", "c")
    for r in tail.mapInArrow(per_class, "class int, c double, n long").where("n > 0").groupBy("class").agg(F.sum("c").alias("c"), F.sum("n").alias("n")).collect():
        totals[r["class"]] += r["c"] + ADD * r["n"]
        seen[r["class"]] += r["c"]
    totals[OWN : OWN + ENDINGS] += ADD  # an unknown word
    totals[totals == 0] = ADD
    shares = (seen + ADD) / (seen + ADD).sum()
    train = codes.where("train")
    hmm = beginnings(_first_counts(train), shares, states)
    for _ in range(passes):
        hmm = _trained(train, hmm, shares)
    return Model(vocab, above, hmm, totals)


def _first_counts(train: DataFrame) -> np.ndarray:
    """Class counts of the different texts with words whose hashes are least, in that order."""
    some = train.where("n_tokens > 1")
    hashes = [r["hash"] for r in some.select("hash").distinct().orderBy("hash").limit(BEGINNINGS).collect()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for h, x in zip(batch.column(0), _sequences(batch.column(1)), strict=True):
                own, n = np.unique(x, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([h.as_py()] * len(own)), pa.array(own.astype(np.int32)), pa.array(n)], ["hash", "class", "n"])

    found = some.where(F.col("hash").isin(hashes)).select("hash", "classes").mapInArrow(run, "hash long, class int, n long")
    out = np.zeros((len(hashes), CLASSES))
    place = {h: i for i, h in enumerate(hashes)}
    for r in found.groupBy("hash", "class").agg(F.max("n").alias("n")).collect() if hashes else ():
        out[place[r["hash"]], r["class"]] = r["n"]
    return out


def _trained(train: DataFrame, hmm: Hmm, shares: np.ndarray) -> Hmm:
    """One Baum-Welch round over all training texts: expected counts of each task, summed by Spark."""
    states = len(hmm.start)
    model = train.sparkSession.sparkContext.broadcast(hmm.single())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = np.zeros((CLASSES + 1 + states, states))
        for batch in batches:
            found = _sequences(batch.column(0))
            for chunk in _chunks(found):
                starts, moves, emits = model.value.expected(np.concatenate([found[i] for i in chunk]), np.array([len(found[i]) for i in chunk]))
                rows[:CLASSES] += emits
                rows[CLASSES] += starts
                rows[CLASSES + 1 :] += moves
        used = np.flatnonzero(rows.any(axis=1))
        columns = [pa.array(used, pa.int32()), *(pa.array(rows[used, k]) for k in range(states))]
        yield pa.RecordBatch.from_arrays(columns, ["item", *(f"s{k}" for k in range(states))])

    schema = "item int, " + ", ".join(f"s{k} double" for k in range(states))
    summed = train.select("classes").mapInArrow(run, schema).groupBy("item").agg(*[F.sum(f"s{k}").alias(f"s{k}") for k in range(states)]).toArrow()
    rows = np.zeros((CLASSES + 1 + states, states))
    rows[summed.column("item").to_numpy()] = np.stack([summed.column(f"s{k}").to_numpy() for k in range(states)], axis=1)
    model.destroy()
    return Hmm.of_counts(rows[CLASSES], rows[CLASSES + 1 :], rows[:CLASSES], shares)


def score_texts(codes: DataFrame, counts: DataFrame, model: Model) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score), logarithms to base 10, for every row of `encoded`."""
    shared = codes.sparkSession.sparkContext.broadcast((model.hmm, np.log10(model.totals)))
    schema = "row long, doc_id long, n_tokens long, n_known long, frequent double, inside double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hmm, inside = shared.value
        for batch in batches:
            found = _sequences(batch.column(5))
            score = np.zeros(len(found))
            for chunk in _chunks(found):
                obs = np.concatenate([found[i] for i in chunk])
                lengths = np.array([len(found[i]) for i in chunk])
                score[chunk] = hmm.likelihoods(obs, lengths) / np.log(10) - np.add.reduceat(inside[obs], np.cumsum(lengths) - lengths)
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(score)], ["row", "doc_id", "n_tokens", "n_known", "frequent", "inside"])

    passed = codes.select("row", "doc_id", "n_tokens", "n_known", "frequent", "classes").mapInArrow(run, schema)
    rare = codes.select("row", F.explode("rare").alias("w")).select("row", "w.word", "w.n")
    tail = counts.where(F.col("c") <= model.above)
    found = rare.join(tail, "word", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    sums = found.groupBy("row").agg(F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("more"), F.sum(F.col("n") * F.log10(F.col("c") + ADD)).alias("log"))
    tokens, size = model.vocabulary.tokens, model.vocabulary.size
    every = F.col("frequent") + F.coalesce("log", F.lit(0.0))
    per_token = F.log10(F.lit(float(tokens)) + ADD * (size + 1))
    return passed.join(sums, "row", "left").select(
        "doc_id",
        "n_tokens",
        (F.col("n_known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        (every - F.col("n_tokens") * per_token).alias("base_score"),
        (every + F.col("inside")).alias("score"),
    )


def train_and_score(docs: DataFrame, held_out: Column, *, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Score all documents with a model of those that are not held out (null: not).

    Null and empty texts consist of their end; keys may be null or repeated.
    Without a training text all scores are those of unknown words; no
    documents, no rows.  Other columns are ignored.  Results don't depend on
    how rows are dealt out, but for the last digits of sums.
    """
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), (~F.coalesce(held_out, F.lit(False))).alias("train"), F.col(text).cast("string").alias("text"))
    counts = written(word_counts(rows.where("train").select("text")), "word-counts")
    vocab, above = vocabulary(counts)
    codes = encoded(rows, vocab)
    return score_texts(codes, counts, fit(codes, counts, vocab, above))
