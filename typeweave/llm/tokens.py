"""Token counts by batch encoding.

Texts are cut at white space, where the tokenizers of kind "words" never join
anything, so a text of any length is counted piece by piece; the pieces that a
worker has not met lately are encoded in batches of bounded bytes, and only
lengths come back.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of a batch that is encoded at once, and of the texts whose pieces are held at once.
ENCODE_BYTES, HOLD_BYTES = 1 << 20, 4 << 20
#: Pieces whose length a worker remembers; longer ones than LONG characters are not kept.
REMEMBERED, LONG = 250_000, 48


class Lengths:
    """Token counts of texts, as the library of the vocabulary file gives them."""

    def __init__(self, path: str, *, split: bool) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.split, self.known = split, {}
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.encode = lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
        else:
            from tokenizers import Tokenizer

            model = Tokenizer.from_file(path)
            model.no_truncation()
            model.no_padding()
            self.encode = lambda texts: [len(x) for x in model.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, pieces: list[str]) -> dict[str, int]:
        """Lengths of pieces, encoded in batches of similar bytes."""
        found, batch, held = {}, [], 0
        for p in pieces:
            batch.append(p)
            held += len(p) * 2 + 16
            if held >= ENCODE_BYTES:
                found.update(zip(batch, self.encode(batch), strict=True))
                batch, held = [], 0
        if batch:
            found.update(zip(batch, self.encode(batch), strict=True))
        return found

    def _parts(self, text: str) -> Iterator[list[str]]:
        """The pieces of a text, in lists that hold a bounded part of it each."""
        if not self.split:
            yield [text]
            return
        at = 0
        while at < len(text):
            end = at + HOLD_BYTES
            if end < len(text):
                cut = text.rfind(" ", at, end)
                end = cut if cut > at else (text.find(" ", end) if text.find(" ", end) > 0 else len(text))
            yield text[at:end].replace("\n", " ").replace("\t", " ").split(" ")
            at = end

    def _sums(self, lists: list[list[str]]) -> list[int]:
        new = set().union(*lists) - self.known.keys()
        if len(self.known) + len(new) > REMEMBERED:
            self.known.clear()
            new = set().union(*lists)
        fresh = self._learn(sorted(new))
        look = self.known
        look.update(fresh)
        out = [sum(map(look.__getitem__, pieces)) for pieces in lists]
        for p in fresh:
            if len(p) > LONG:
                del look[p]
        return out

    def count(self, texts: list[str | None]) -> list[int]:
        """The number of tokens of each text; null counts as empty."""
        out, owners, lists, held = [0] * len(texts), [], [], 0
        for i, text in enumerate(texts):
            for part in self._parts(text or ""):
                owners.append(i)
                lists.append(part)
                held += sum(map(len, part)) + 8
                if held >= HOLD_BYTES:
                    for k, n in zip(owners, self._sums(lists), strict=True):
                        out[k] += n
                    owners, lists, held = [], [], 0
        if lists:
            for k, n in zip(owners, self._sums(lists), strict=True):
                out[k] += n
        return out


def token_counts(docs: DataFrame, vocabulary: str, *, text: str = "text", key: str = "doc_id", limit: int = 2048, split: bool = True) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for every document.

    `vocabulary` is a file that all executors can open: .json for tokenizers,
    .model for sentencepiece.  No special tokens are added; special strings in a
    text are handled as the library does by default.  split=True cuts at white
    space, which is exact for vocabularies that drop it; others take split=False
    and are given whole texts.  Null counts as empty; keys may repeat or be null.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = Lengths(vocabulary, split=split)
        for batch in batches:
            counts = lengths.count(batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    rows = docs.select(
        F.col(key).cast("long").alias("doc_id"),
        F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long").alias("n_bytes"),
        F.col(text).cast("string").alias("text"),
    )
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
