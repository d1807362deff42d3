"""Toxicity by noisy-channel deobfuscation.

A token that may be disguised (digits or signs among letters, letters repeated
three times, single letters spaced out) becomes a lattice: each sign may be
a letter that it resembles or noise; each repetition one letter or two;
each gap a gap or nothing.  Viterbi decoding under a character model of five
characters picks the word: it keeps the best reading of every context that the
model can tell apart, so it finds the best of all paths.  The model counts the
words of all documents, in hashed cells of a fixed number; no sequence is left
out.  Texts, tokens and runs are read whole, however long.
The restored words are scored by a lexicon of words and word beginnings that
toxic documents have more often than chance allows, and a logistic regression
on what a whole text has of them.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from typeweave.operators.fixpoint import written

# What letters a sign may stand for.
LOOKS = {
    "0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s",
    "!": "i", "|": "il", "+": "t", "€": "e", "*": "abcdefghijklmnopqrstuvwxyz", "#": "", "%": "", "&": "", "-": "", "_": "", ".": "", "'": "",
}
#: Labelled documents that the lexicon and the regression are fitted on, at most.
SAMPLE = 24_000
#: Costs, in nats, of reading a sign as a letter, a letter-like sign as noise, another sign as noise, a repetition.
AS_LETTER, AS_NOISE, AS_MARK, AS_REPEAT = 0.5, 10.0, 1.0, 0.5
#: Characters that a prediction looks at, itself included; cells that sequences are counted in, as a power of two; what a longer run of the sign for any letter is: a mark.
ORDER, CELL_BITS, MASK_RUN = 5, 20, 4
#: Readings of a step from which numpy takes over.
MANY = 64
START = " " * (ORDER - 1)
_LETTERS = re.compile(r"[^\W\d_]+")
_DISGUISED = re.compile(r"[^\W\d_][^\s\w]*[0-9@$!|+*€#%&_.-][^\s\w]*[^\W_]|^[0-9@$!|+*€]+[^\W\d_]|[^\W\d_][0-9@$!|+€]|([^\W\d_])\1\1")
_SPACED = re.compile(r"(?<!\S)\S(?:\s\S){2,}(?!\S)")
_REPEATED = re.compile(r"(.)\1\1")
_RUNS = re.compile(r"(.)\1*", re.DOTALL)
_EDGE = ".,;:?\"'()[]{}<>"
#: Marks around a word that never disguise it.
_MARKS = ".,;:?\"()[]{}<>"
#: Tokens that a worker remembers; names that a task counts before it passes them on.
_CACHE, HELD = 250_000, 400_000
#: Readings that a model remembers, of tokens of so many characters at most; probabilities that it remembers for each length of context.
READINGS, SHORT, LOWER = 20_000, 48, 20_000


_MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)
_WHOLE = (1 << 64) - 1
_CONTEXTS = [(1 << 16 * k) - 1 for k in range(ORDER)]


def _cell(context, c, k):
    """The cell of c after a context of k characters, 16 bits each (c is 0 for the context itself); for integers or arrays of them."""
    if isinstance(context, int):
        h = (context * _MIX[0] ^ (c + 1) * _MIX[1] ^ (k + 1) * _MIX[2]) & _WHOLE
        h = (h ^ h >> 29) * _MIX[3] & _WHOLE
        return h >> 64 - CELL_BITS
    h = context * np.uint64(_MIX[0]) ^ (c + np.uint64(1)) * np.uint64(_MIX[1]) ^ np.uint64((k + 1) * _MIX[2] & _WHOLE)
    h = (h ^ h >> np.uint64(29)) * np.uint64(_MIX[3])
    return (h >> np.uint64(64 - CELL_BITS)).astype(np.int64)


def _code(context: str) -> int:
    """The characters' lower 16 bits, side by side."""
    out = 0
    for c in context:
        out = out << 16 | ord(c) & 0xFFFF
    return out


@dataclass
class CharModel:
    """An interpolated character model of words: each context of up to four characters leans on the next shorter one.

    By cell: how often a sequence occurs, how often its context, and how many different characters follow the context.
    """

    counts: np.ndarray
    total: np.ndarray
    kinds: np.ndarray

    def __post_init__(self) -> None:
        self.views = [memoryview(np.ascontiguousarray(x, np.float32)) for x in (self.counts, self.total, self.kinds)]
        self.lower: list[dict[int, float]] = [{} for _ in range(ORDER - 1)]
        self.memo: dict[tuple[str, str], float] = {}
        self.readings: dict[str, str] = {}

    @classmethod
    def empty(cls) -> CharModel:
        return cls(*(np.zeros(1 << CELL_BITS, np.float32) for _ in range(3)))

    def at(self, context: np.ndarray, c: np.ndarray) -> np.ndarray:
        """Probability of c after context, by Witten and Bell's weights; unseen characters share the last resort.  Arrays of codes."""
        out = np.full(len(context), 1e-4)
        for k in range(ORDER):
            own = context & np.uint64(_CONTEXTS[k])
            at, of = _cell(own, c + np.uint64(1), k), _cell(own, c * np.uint64(0), k)
            lean = self.kinds[of].astype(float) + 1e-9
            out = (self.counts[at] + lean * out) / (self.total[of] + lean)
        return out

    def p(self, context: str, c: str) -> float:
        """The same for one context and character; what a shorter context says is remembered, as many share it."""
        counts, total, kinds = self.views
        code, x, out, begin = _code(context), (ord(c) & 0xFFFF) + 1, 1e-4, 0
        for k in range(ORDER - 2, -1, -1):
            known = self.lower[k].get((code & _CONTEXTS[k]) << 17 | x)
            if known is not None:
                out, begin = known, k + 1
                break
        for k in range(begin, ORDER):
            own = code & _CONTEXTS[k]
            of = _cell(own, 0, k)
            lean = kinds[of] + 1e-9
            out = (counts[_cell(own, x, k)] + lean * out) / (total[of] + lean)
            if k < ORDER - 1:
                if len(self.lower[k]) >= LOWER:
                    self.lower[k].clear()
                self.lower[k][own << 17 | x] = out
        return out

    def logp(self, context: str, c: str) -> float:
        found = self.memo.get((context, c))
        if found is None:
            if len(self.memo) > 50_000:
                self.memo.clear()
            found = self.memo[context, c] = math.log(self.p(context, c))
        return found

    def forget(self) -> None:
        """Drop what is remembered; a worker keeps its models, and later steps need the memory."""
        for known in (*self.lower, self.memo, self.readings):
            known.clear()

    def __reduce__(self):
        return CharModel, (self.counts, self.total, self.kinds)

    def score(self, text: str) -> float:
        """Log probability of whole words, separated by single spaces."""
        total, context = 0.0, START
        for c in text + " ":
            total += self.logp(context, c)
            context = START if c == " " else context[1:] + c
        return total

    def decode(self, token: str) -> str:
        """The likeliest reading of a disguised token; those of short tokens are remembered."""
        known = self.readings.get(token)
        if known is None:
            known = self._decoded(token)
            if len(token) <= SHORT:
                if len(self.readings) >= READINGS:
                    self.readings.clear()
                self.readings[token] = known
        return known

    def _decoded(self, token: str) -> str:
        best: dict[str, tuple[float, str]] = {START: (0.0, "")}
        for c, run in runs(token):
            ways = arcs(c, run)
            if len(best) == 1 and len(ways) == 1:  # all readings share this step, so its probability decides nothing
                ((context, (score, said)),) = best.items()
                best = {_after(context, ways[0][0]): (score, said + ways[0][0])}
                continue
            if len(best) * len(ways) > MANY:
                best = self._many(best, ways)
                continue
            then: dict[str, tuple[float, str]] = {}
            for context, (score, said) in best.items():
                for text, cost in ways:
                    h, s = context, score - cost
                    for x in text:
                        s += self.logp(h, x)
                        h = START if x == " " else h[1:] + x
                    if h not in then or then[h][0] < s:
                        then[h] = (s, said + text)
            best = then
        return max((s + self.logp(h, " "), said) for h, (s, said) in best.items())[1]

    def _many(self, best: dict[str, tuple[float, str]], ways: list[tuple[str, float]]) -> dict[str, tuple[float, str]]:
        """A step of many readings at once, with numpy; still the best of every context."""
        held = list(best)
        codes = np.array([_code(h) for h in held], np.uint64)
        scores = np.array([best[h][0] for h in held])
        ends, sums = [], []
        for text, cost in ways:
            h, s = codes, scores - cost
            for x in text:
                c = np.uint64(ord(x) & 0xFFFF)
                s = s + np.log(self.at(h, np.full(len(h), c)))
                h = np.full(len(h), np.uint64(_code(START))) if x == " " else h << np.uint64(16) | c
            ends.append(h)
            sums.append(s)
        end, total = np.concatenate(ends), np.concatenate(sums)
        order = np.lexsort((-total, end))
        first = order[np.concatenate([[True], end[order][1:] != end[order][:-1]])]
        out = {}
        for i, s in zip(first.tolist(), total[first].tolist(), strict=True):
            way, context = ways[i // len(held)][0], held[i % len(held)]
            h = _after(context, way)
            if h not in out or out[h][0] < s:
                out[h] = (s, best[context][1] + way)
        return out


def _after(context: str, text: str) -> str:
    """The context after text."""
    whole = START + text.rpartition(" ")[2] if " " in text else context + text
    return whole[-(ORDER - 1) :]


def runs(token: str) -> Iterator[tuple[str, int]]:
    """Runs of one character; signs come one by one, but for long runs of the sign for any letter, which are a mark."""
    for m in _RUNS.finditer(token):
        c, n = m.group(1), len(m.group())
        if c == "*" and n > MASK_RUN:
            yield "#", n
        elif c in LOOKS:
            yield from ((c, 1) for _ in range(n))
        else:
            yield c, n


def arcs(c: str, run: int) -> list[tuple[str, float]]:
    """What a run of one character may have been, and what each reading costs."""
    if c == " ":
        return [("", 0.2), (" ", 0.0)]
    if c in LOOKS:
        return [*((x, AS_LETTER) for x in LOOKS[c]), ("", AS_NOISE if LOOKS[c] else AS_MARK)]
    return [(c, 0.0)] if run == 1 else [(c, AS_REPEAT), (c * 2, 0.0 if run == 2 else AS_REPEAT)]


def restore(token: str, model: CharModel | None) -> str:
    """A lower-case token as it was meant."""
    bare = token.strip(_EDGE).rstrip("!" + _EDGE)  # at the end, marks are more often marks than letters
    if model is None or not _DISGUISED.search(bare):
        return token
    return model.decode(bare)


def words_of(token: str, model: CharModel | None) -> list[str]:
    """The words of a raw token: as restored, and as they stand where that differs."""
    low = token.lower()
    found = _LETTERS.findall(low)
    if model is not None and not (len(found) == 1 and found[0] == low):
        fixed = restore(low, model)
        if fixed != low:
            found = found + [w for w in _LETTERS.findall(fixed) if w not in found]
        return found
    return [restore(low, model)] if model is not None and _DISGUISED.search(low) else found


def spaced(text: str, model: CharModel | None) -> list[str]:
    """Words out of runs of single characters."""
    if model is None:
        return []
    out = []
    for m in _SPACED.finditer(text):
        run = m.group().lower().split()
        out += ["".join(run), *_LETTERS.findall(model.decode(" ".join(run)))]
    return out


def features_of(word: str) -> list[str]:
    """The word, and its beginnings of four to six letters."""
    return [word, *(word[:k] + "-" for k in (4, 5, 6) if len(word) > k)]


class _Scores(dict):
    """Raw token -> weight of its strongest feature, 0 if none; filled on demand and emptied when full."""

    def __init__(self, lexicon: dict[str, float], model: CharModel | None) -> None:
        self.model = model
        self.words = {f: w for f, w in lexicon.items() if not f.endswith("-")}
        self.begins = {f[:-1]: w for f, w in lexicon.items() if f.endswith("-")}
        self.heads = {f[:4] for f in (*self.words, *self.begins)}  # a word that begins otherwise has no weight

    def of_word(self, word: str) -> float:
        """The weight of the strongest of features_of(word)."""
        n, best, begins = len(word), self.words.get(word, 0.0), self.begins
        if n > 4:
            best = max(best, begins.get(word[:4], 0.0))
            if n > 5:
                best = max(best, begins.get(word[:5], 0.0))
                if n > 6:
                    best = max(best, begins.get(word[:6], 0.0))
        return best

    def __missing__(self, token: str) -> float:
        if len(self) >= _CACHE:
            self.clear()
        bare = token.lower().strip(_MARKS)
        if bare.isalpha() and not _REPEATED.search(bare):  # a plain word, as most are
            value = self.of_word(bare) if bare[:4] in self.heads else 0.0
        else:
            value = max((self.of_word(w) for w in words_of(token, self.model)), default=0.0)
        self[token] = value
        return value

    def text(self, text: str | None) -> list[float]:
        """What the regression sees of a text."""
        tokens = text.split() if text else []
        weights = np.fromiter(map(self.__getitem__, tokens), np.float64, len(tokens))
        hits = weights[weights > 0].tolist()
        ones = np.fromiter(map(len, tokens), np.int64, len(tokens)) == 1
        if (ones[2:] & ones[1:-1] & ones[:-2]).any():  # else there are no spaced runs
            hits += [x for x in map(self.of_word, spaced(text, self.model)) if x > 0]
        n = len(hits)
        return [1.0, float(n > 0), float(n > 1), min(n, 4) / 4, min(sum(hits), 24.0) / 24, max(hits, default=0.0) / 8]


@dataclass
class Model:
    chars: CharModel | None
    lexicon: dict[str, float]
    weights: np.ndarray

    def scorer(self) -> _Scores:
        return _Scores(self.lexicon, self.chars)


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    w = np.zeros(x.shape[1])
    keep = np.full(x.shape[1], ridge)
    keep[0] = 1e-6
    for _ in range(30):
        p = 1 / (1 + np.exp(-x @ w))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(keep + 1e-9), x.T @ (y - p) - keep * w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _counted(df: DataFrame, features, name: str, kind: str = "string") -> DataFrame:
    """(name, n): over texts, how many have each feature that features(text) gives."""
    arrow = pa.string() if kind == "string" else pa.binary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(held.keys(), arrow), pa.array(held.values(), pa.int64())], [name, "n"])
            held.clear()
            return batch

        for batch in batches:
            for x in batch.column(0):
                held.update(features(x.as_py()))
                if len(held) > HELD:
                    yield out()
        yield out()

    return df.select("text").mapInArrow(run, f"{name} {kind}, n long").groupBy(name).agg(F.sum("n").alias("n"))


def _sequences(words: list[str], times: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(k, context of k characters, character, times) of all sequences in words and at their ends, once each."""
    whole = "".join(f"{START}{w} " for w in words)
    codes = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) & np.uint64(0xFFFF)
    lengths = np.array([len(w) + ORDER for w in words])
    at = np.arange(len(codes)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    ends = np.flatnonzero(at >= ORDER - 1)
    n = np.repeat(times, lengths)[ends]
    out, context = [], np.zeros(len(ends), np.uint64)
    for k in range(ORDER):
        if k:
            context = context | codes[ends - k] << np.uint64(16 * (k - 1))
        order = np.lexsort((codes[ends], context))
        a, c = context[order], codes[ends][order]
        new = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (c[1:] != c[:-1])])) if len(order) else order
        out.append((np.full(len(new), k), a[new], c[new], np.add.reduceat(n[order], new) if len(new) else n))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def character_model(docs: DataFrame) -> CharModel:
    """The character model of all words of (text), counted over all rows: words, then sequences, then cells."""

    def sequences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, times = [], []
            for token, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = _LETTERS.findall(token.decode().lower())
                words += found
                times += [n] * len(found)
            k, context, c, n = _sequences(words, times)
            yield pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(context.view(np.int64)), pa.array(c.astype(np.int32)), pa.array(n, pa.int64())], ["k", "context", "c", "n"])

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k, n = batch.column(0).to_numpy(), batch.column(3).to_numpy()
            context, c = batch.column(1).to_numpy().view(np.uint64), batch.column(2).to_numpy().astype(np.uint64)
            for part in range(ORDER):
                own = k == part
                at, of = _cell(context[own], c[own] + np.uint64(1), part), _cell(context[own], c[own] * np.uint64(0), part)
                zero, one = np.zeros(len(at), np.int64), np.ones(len(at), np.int64)
                for columns in ((at, n[own], zero, zero), (of, zero, n[own], one)):
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], ["cell", "counts", "total", "kinds"])

    tokens = _counted(docs, lambda x: x.encode().split() if x else (), "token", "binary")
    grams = tokens.mapInArrow(sequences, "k int, context long, c int, n long").groupBy("k", "context", "c").agg(F.sum("n").alias("n"))
    found = grams.mapInArrow(cells, "cell long, counts long, total long, kinds long").groupBy("cell").agg(*[F.sum(x).alias(x) for x in ("counts", "total", "kinds")]).toArrow()
    out, at = CharModel.empty(), found.column("cell").to_numpy()
    for name in ("counts", "total", "kinds"):
        getattr(out, name)[at] = found.column(name).to_numpy()
    return out


def _collected(counts: DataFrame) -> dict[str, int]:
    """A bounded table of names and counts as a dictionary, by way of Arrow, which takes less memory than rows."""
    found = counts.toArrow()
    return dict(zip(found.column(0).to_pylist(), found.column("n").to_pylist(), strict=True))


def sample_of(labels: DataFrame, *, key: str, label: str, bound: int) -> DataFrame:
    """(id, toxic) of labels with a usable label, as many as the bound, give or take chance."""
    usable = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull()).groupBy(F.col(key).alias("id")).agg(F.max(label).alias("toxic"))
    total = usable.count()
    part = min(1.0, 0.95 * bound / max(total, 1))
    return usable.where(F.pmod(F.xxhash64("id", F.lit("sample")), F.lit(1_000_000)) < int(part * 1_000_000)).limit(bound)


def fit(docs: DataFrame, labels: DataFrame, *, text: str = "text", key: str = "doc_id", label: str = "toxic", bound: int = SAMPLE) -> Model:
    """Fit the character model on all documents, the lexicon and the regression on at most `bound` labelled ones; equal texts count once there.

    Without labels of both kinds the model gives the share of label 1 (0.5 if
    there are none) to all texts.  Null texts, labels and keys, and labels
    other than 0 and 1, teach nothing; of several labels of a key the greatest counts.
    """
    ids = sample_of(labels, key=key, label=label, bound=bound)
    some = docs.select(F.col(key).alias("id"), F.col(text).alias("text")).join(F.broadcast(ids), "id").select("text", "toxic")
    some = written(some.groupBy("text").agg(F.max("toxic").alias("toxic")).where("text is not null"), "toxicity-sample")
    sizes = {r["toxic"]: r["n"] for r in some.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    if not n1 or not n0:
        share = (n1 + 0.5) / (n1 + n0 + 1)
        return Model(None, {}, np.array([math.log(share / (1 - share)), 0, 0, 0, 0, 0]))
    chars = character_model(docs.select(F.col(text).cast("string").alias("text")))
    shared = docs.sparkSession.sparkContext.broadcast(chars)

    def every(x: str) -> set[str]:
        model = shared.value
        tokens = set(x.split())
        found = {w for t in tokens for w in words_of(t, model)} | set(spaced(x, model))
        return {f for w in found for f in features_of(w)}

    often = _counted(some.where("toxic = 1"), every, "feature").where(F.col("n") >= max(5, n1 // 500))
    first = _collected(often)
    wanted = docs.sparkSession.sparkContext.broadcast(frozenset(first))
    against = _collected(_counted(some.where("toxic = 0"), lambda x: every(x) & wanted.value, "feature"))
    ranked, most = [], Counter()
    for f, a in first.items():
        for k in (4, 5, 6):
            most[f[:k] + "-"] = max(most[f[:k] + "-"], a * (not f.endswith("-")))
    for f, a in first.items():
        b, n = against.get(f, 0), n1 + n0
        if f.endswith("-") and most[f] > a / 2:
            continue  # a beginning that one word accounts for says no more than the word
        z = (a / n1 - b / n0) / math.sqrt((a + b) / n * (1 - (a + b) / n) * (1 / n1 + 1 / n0) + 1e-12)
        weight = math.log((a + 0.5) / (n1 + 1)) - math.log((b + 0.5) / (n0 + 1))
        if z >= 6 and weight >= 1:
            ranked.append((-z, f, min(weight, 8.0)))
    lexicon = {f: w for _, f, w in sorted(ranked)}
    rough = docs.sparkSession.sparkContext.broadcast(Model(chars, lexicon, np.zeros(6)))

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = rough.value.scorer()
        for batch in batches:
            rows = [scorer.text(x.as_py()) for x in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.float64())), batch.column(1).cast(pa.int64())], ["x", "y"])

    points = some.select("text", "toxic").mapInArrow(seen, "x array<double>, y long").groupBy("x", "y").count().collect()
    for x in (shared, wanted, rough):
        x.destroy()
    x = np.repeat(np.array([r["x"] for r in points]), [r["count"] for r in points], axis=0)
    y = np.repeat(np.array([r["y"] for r in points], float), [r["count"] for r in points])
    return Model(chars, lexicon, _logistic(x, y))


def score_texts(docs: DataFrame, model: Model, *, text: str = "text", score: str = "score") -> DataFrame:
    """docs with a score from 0 to 1 (higher: label 1 is likelier) for every text.

    Null and empty texts get the score of a text without any sign of toxicity;
    all rows stay, and all columns but one that `score` names, which it takes the place of.  Texts are read whole.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop(score)
    place = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer, weights = shared.value.scorer(), shared.value.weights
        for batch in batches:
            x = np.array([scorer.text(t.as_py()) for t in batch.column(place)], dtype=float).reshape(batch.num_rows, 6)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(1 / (1 + np.exp(-x @ weights)))], [*batch.schema.names, score])
        if scorer.model is not None:
            scorer.model.forget()

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(score, DoubleType())]))
