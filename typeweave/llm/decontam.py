"""Benchmark decontamination by size-partitioned MinHash containment.

Items are partitioned by the power of two that their number of shingles reaches.
A text that contains a share t of an item's n shingles misses at most
n - ceil(t n) of them, so among the item's n - ceil(t n) + 1 shingles of lowest
hash (its MinHash sketch) at least one must be in the text.  Every partition has a bitmap
of its sketches, of bounded size; a text's shingles are looked up in those of
the partitions whose items it is long enough to contain.  What is found there is joined with
the sketches, and each candidate is verified by its exact shingle containment.
Unlike banded signatures the sketch misses nothing, however long the document;
only documents with a shingle in a bitmap are shuffled, and items never pass through the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from typeweave.operators.fixpoint import written

#: Letters, digits and everything outside ASCII make words; the rest of ASCII separates them.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_BLANK = bytes(32 if b < 128 and not (48 <= b < 58 or 65 <= b < 91 or 97 <= b < 123) else b for b in range(256))
#: Bits of a bitmap for each sketch shingle, and of a bitmap at most: there are some dozens at most (a size's power of two each), and a full one only finds more candidates.
SPARSE, MOST_BITS = 32, 1 << 25
#: Words whose hashes a task remembers.
REMEMBERED = 300_000
_STEP = 0x9E3779B97F4A7C15


def words(text: str | None) -> list[bytes]:
    return text.lower().encode().translate(_BLANK).split() if text else []


def shingles(found: list[bytes], size: int) -> list[bytes]:
    """Word n-grams; fewer words than size are one shingle, no words none."""
    if not found:
        return []
    return [b" ".join(found[i : i + size]) for i in range(max(1, len(found) - size + 1))]


class _Hashes(dict):
    """Word -> its hash."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def _keys(hashes: np.ndarray, width: int) -> np.ndarray:
    """A number for each window of words; different windows may share one, which costs a check only."""
    n = max(len(hashes) - width + 1, 0)
    out = np.zeros(n, np.uint64)
    for k in range(width):
        out = out * np.uint64(_STEP) + hashes[k : k + n]
    out ^= out >> np.uint64(29)
    return out * np.uint64(_STEP)


def _sketched(items: DataFrame, size: int, threshold: float) -> DataFrame:
    """(item, item_id, text, n, width, part, sketch) of (item_id, text): the items with words, and their lowest shingles; written."""
    columns = ["item", "item_id", "text", "n", "width", "part", "sketch"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, hashes = TaskContext.get().partitionId() << 40, _Hashes()
        for batch in batches:
            rows = []
            for ident, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = words(x)
                if not found:
                    continue
                width = min(size, len(found))
                keys = _keys(np.fromiter(map(hashes.__getitem__, found), np.uint64, len(found)), width)
                every = dict(zip(shingles(found, width), keys.tolist(), strict=True))
                n = len(every)
                sketch = np.array(sorted(every.values())[: n - _needed(n, threshold) + 1], np.uint64)
                rows.append((number, ident, x, n, width, n.bit_length(), sketch.view(np.int64)))
                number += 1
            types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], columns)

    return written(items.mapInArrow(run, "item long, item_id long, text string, n long, width int, part int, sketch array<long>"), "items")


def _needed(n: int, threshold: float) -> int:
    return math.ceil(threshold * n - 1e-9)


def _bitmaps(sketches: DataFrame, most_bits: int) -> dict[tuple[int, int], tuple[int, np.ndarray]]:
    """(width, part) -> (log2 of its bits, the bits in words of 64) of rows (width, part, key)."""
    sizes = {(r["width"], r["part"]): r["n"] for r in sketches.groupBy("width", "part").agg(F.count("*").alias("n")).collect()}
    bits = {k: min(most_bits, max(64, 1 << (SPARSE * n - 1).bit_length())).bit_length() - 1 for k, n in sizes.items()}
    if not bits:
        return {}
    shift = F.coalesce(*[F.when((F.col("width") == w) & (F.col("part") == p), 64 - b) for (w, p), b in bits.items()])
    place = sketches.select("width", "part", F.call_function("shiftrightunsigned", "key", shift).alias("place"))
    packed = place.groupBy("width", "part", F.shiftright("place", 6).alias("at")).agg(F.expr("bit_or(shiftleft(1L, cast(place & 63 AS int)))").alias("bits")).toArrow()
    out = {k: (b, np.zeros(1 << b - 6, np.uint64)) for k, b in bits.items()}
    width, part, at = (packed.column(i).to_numpy() for i in range(3))
    found = packed.column(3).to_numpy().view(np.uint64)
    for k, (_, table) in out.items():
        own = (width == k[0]) & (part == k[1])
        table[at[own]] = found[own]
    return out


def contained_items(
    docs: DataFrame,
    items: DataFrame,
    *,
    text: str = "text",
    key: str = "doc_id",
    item_text: str = "text",
    item_key: str = "item_id",
    shingle: int = 5,
    threshold: float = 0.8,
    most_bits: int = MOST_BITS,
) -> DataFrame:
    """(doc_id, item_id, n_shared, n_item, containment) for every document that contains an item.

    Texts are lower-cased (as Python does) and cut into words of letters, digits and non-ASCII
    characters; an item of fewer words than a shingle must occur as a whole.
    Null, empty or wordless texts, on either side, match nothing.  Keys may be null; repeated
    rows give repeated results; other columns are ignored.  Without documents or items: no rows.
    """
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    wanted = items.select(F.col(item_key).cast("long").alias("item_id"), F.col(item_text).cast("string").alias("text")).where("text is not null")
    wanted = _sketched(wanted, shingle, threshold)
    sketches = wanted.select("item", "width", "part", F.explode("sketch").alias("key"))
    shared = docs.sparkSession.sparkContext.broadcast(_bitmaps(sketches, most_bits))

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, hashes, maps = TaskContext.get().partitionId() << 40, _Hashes(), shared.value
        widths = sorted({w for w, _ in maps})
        for batch in batches:
            kept, found, ends = [], [], [0]
            for i, x in enumerate(batch.column(1)):
                own = words(x.as_py())
                ids = np.fromiter(map(hashes.__getitem__, own), np.uint64, len(own))
                hits = []
                for width in widths:
                    keys = _keys(ids, width)
                    for (w, part), (bits, table) in maps.items():
                        if w == width and len(keys) >= _needed(1 << part - 1, threshold):
                            place = keys >> np.uint64(64 - bits)
                            there = table[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63)) & np.uint64(1)
                            hits += [(w, part, k) for k in np.unique(keys[there == 1]).view(np.int64).tolist()]
                if hits:
                    kept.append(i)
                    found += hits
                    ends.append(len(found))
            at = pa.array(kept, pa.int64())
            parts = [pa.array([h[j] for h in found], t) for j, t in enumerate((pa.int32(), pa.int32(), pa.int64()))]
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(parts, ["width", "part", "key"]))
            yield pa.RecordBatch.from_arrays([pa.array(number + np.arange(len(kept)), pa.int64()), batch.column(0).take(at), batch.column(1).take(at), lists], ["row", "doc_id", "text", "hits"])
            number += len(kept)

    hit = written(rows.mapInArrow(look_up, "row long, doc_id long, text string, hits array<struct<width:int,part:int,key:long>>"), "hit-documents")
    met = hit.select("row", F.explode("hits").alias("h")).select("row", "h.*").join(sketches, ["width", "part", "key"]).select("row", "item").distinct()
    pairs = met.join(hit.select("row", "doc_id", "text"), "row").join(wanted.select("item", "item_id", F.col("text").alias("item_text"), "n", "width"), "item")
    pairs = pairs.select("row", "doc_id", "text", "item_id", "item_text", "n", "width")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, own = None, {}
        for batch in batches:
            out = []
            columns = [batch.column(i) for i in (0, 2, 4, 5, 6)]
            for i in range(batch.num_rows):
                row, n, width = (columns[k][i].as_py() for k in (0, 3, 4))
                if row != last:
                    last, own, found = row, {}, words(columns[1][i].as_py())
                if width not in own:
                    own[width] = set(shingles(found, width)) if len(found) >= width else set()
                count = len(own[width].intersection(shingles(words(columns[2][i].as_py()), width)))
                out.append(count if count >= _needed(n, threshold) else None)
            batch = pa.RecordBatch.from_arrays([batch.column(1), batch.column(3), pa.array(out, pa.int64()), batch.column(5)], ["doc_id", "item_id", "n_shared", "n_item"])
            yield batch.filter(batch.column(2).is_valid())

    out = pairs.mapInArrow(verify, "doc_id long, item_id long, n_shared long, n_item long")
    return out.withColumn("containment", F.col("n_shared") / F.col("n_item"))
