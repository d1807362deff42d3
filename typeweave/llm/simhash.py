"""SimHash near-duplicates by anchor-point covering.

Anchors are the words of a covering code on 64 bits: nine perfect Hamming(7,4)
codes side by side and one free bit, 2**37 anchors, covering radius 9.  Two
fingerprints within t bits have a midpoint within t/2 of both, and the anchor of
that midpoint is within radius + t/2 of both; so a fingerprint goes to the
anchors of all points within t/2 of it (28 on average at t = 2), and each
linked pair meets at an anchor.  Anchors with one fingerprint end there.  At the
others, members meet at the midpoints that belong to the anchor (65 members at
most), so a crowd of near copies costs a row for each member and midpoint, not
one for each pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from typeweave.llm.common import words_of
from typeweave.operators.components import connected_components
from typeweave.operators.fixpoint import checkpointed, written

SEED = 42
BLOCKS = 9


def shingle_hashes(text: str | None, size: int) -> np.ndarray:
    """XXH64 of a text's shingles, repeats included; fewer words than a shingle are one, no words none."""
    words = words_of(text)
    if not words:
        return np.zeros(0, np.uint64)
    digest, n, joined = xxhash.xxh64_intdigest, len(words), b" ".join(words)
    if n <= size:
        return np.array([digest(joined, SEED)], dtype=np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1)
    starts = np.concatenate([[0], ends[: n - size]]).tolist()
    stops = (ends[size - 1 :] - 1).tolist()
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, stops, strict=True)), np.uint64, n - size + 1)


def fingerprint_of(hashes: np.ndarray) -> int:
    """Bits set in over half of the values; without any: 0."""
    bits = 2 * _bit_counts(hashes) > len(hashes)
    return int((bits.astype(np.uint64) << np.arange(64, dtype=np.uint64)).sum(dtype=np.uint64))


def _bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the values have each bit set; up to 255 values are added in byte lanes at once."""
    out, lanes = np.zeros(64, np.int64), np.uint64(0x0101010101010101)
    whole = len(hashes) - len(hashes) % 255
    for bit in range(8):
        picked = (hashes >> np.uint64(bit)) & lanes
        sums = np.append(picked[:whole].reshape(-1, 255).sum(axis=1, dtype=np.uint64), picked[whole:].sum(dtype=np.uint64))
        out[bit::8] += sums.view(np.uint8).reshape(-1, 8).sum(axis=0, dtype=np.int64)
    return out


def fingerprints(docs: DataFrame, *, text: str = "text", key: str = "doc_id", shingle: int = 3) -> DataFrame:
    """(doc_id, fp): the 64-bit fingerprint, as a signed long, of every text.

    A text with fewer words than a shingle is one shingle; without words (null,
    empty, white space only) its fingerprint is 0.  Keys may be null or repeated.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint_of(shingle_hashes(x.as_py(), shingle)) for x in batch.column(1)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, fp long")


def _hamming_places() -> np.ndarray:
    """For each 7 bits, the number of the nearest word of the Hamming(7,4) code."""
    words = [w for w in range(128) if all(bin(w & mask).count("1") % 2 == 0 for mask in (0b1010101, 0b1100110, 0b1111000))]
    return np.array([min(range(16), key=lambda i: bin(words[i] ^ x).count("1")) for x in range(128)], dtype=np.int64)


_PLACES = _hamming_places()


def anchors_of(points: np.ndarray) -> np.ndarray:
    """The anchor of each 64-bit point: four bits a block and the free bit."""
    at = (points >> np.uint64(63)).astype(np.int64) << 36
    for b in range(BLOCKS):
        at |= _PLACES[((points >> np.uint64(7 * b)) & np.uint64(127)).astype(np.int64)] << (4 * b)
    return at


def _ball(points: np.ndarray) -> np.ndarray:
    """Each point and its 64 neighbours at one bit."""
    flips = np.concatenate([[0], np.uint64(1) << np.arange(64, dtype=np.uint64)]).astype(np.uint64)
    return points[:, None] ^ flips


def _pairs_of(batches: Iterator[pa.RecordBatch], *, midpoints: bool) -> Iterator[pa.RecordBatch]:
    """Of (fp): rows (anchor, fp), once each.  Of (anchor, fp): rows (anchor, midpoint, fp)."""
    for batch in batches:
        every = batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False).view(np.uint64)
        home = batch.column(0).to_numpy(zero_copy_only=False) if midpoints else None
        for at in range(0, len(every), 1 << 14):
            fps = every[at : at + (1 << 14)]
            ball = _ball(fps)
            anchors = anchors_of(ball)
            if midpoints:
                keep = anchors == home[at : at + (1 << 14), None]
                rows = np.nonzero(keep)[0]
                columns, names = [anchors[keep], ball[keep].view(np.int64), fps[rows].view(np.int64)], ["anchor", "midpoint", "fp"]
            else:
                ranked = np.sort(anchors, axis=1)
                keep = np.concatenate([np.ones((len(fps), 1), bool), ranked[:, 1:] != ranked[:, :-1]], axis=1)
                columns, names = [ranked[keep], fps[np.nonzero(keep)[0]].view(np.int64)], ["anchor", "fp"]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)


def near_links(fps: DataFrame) -> DataFrame:
    """Links (src, dst) that connect all of (fp) that are within two bits of each other.

    fps are distinct.  Not every linked pair is a row, but each is connected by
    rows whose ends are within two bits.
    """
    met = fps.mapInArrow(lambda it: _pairs_of(it, midpoints=False), "anchor long, fp long")
    shared = met.groupBy("anchor").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi")).where("lo <> hi").select("anchor")
    members = met.join(shared, "anchor", "left_semi").select("anchor", "fp")
    at_midpoint = members.mapInArrow(lambda it: _pairs_of(it, midpoints=True), "anchor long, midpoint long, fp long")
    least = F.min("fp").over(Window.partitionBy("anchor", "midpoint"))
    return at_midpoint.select(F.col("fp").alias("src"), least.alias("dst")).where("src <> dst").distinct()


def near_duplicates(docs: DataFrame, *, text: str = "text", key: str = "doc_id", shingle: int = 3) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every document.

    Fingerprints link at two or fewer differing bits; component_id is the
    smallest doc_id that can be reached, null only if no document of the group
    has one.  Texts without words share the fingerprint 0 and link like others.
    """
    prints = written(fingerprints(docs, text=text, key=key, shingle=shingle), "fingerprints")
    first = prints.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    groups = connected_components(near_links(prints.select("fp").distinct()))
    grouped = checkpointed(first.join(groups, F.col("fp") == F.col("node")).select("fp", "first_id", "component"))
    # only fingerprints with a near neighbour get here; the others keep their own first document
    merged = written(grouped.groupBy("component").agg(F.min("first_id").alias("group_id")), "groups")
    moved = grouped.join(merged, "component").select("fp", "group_id")
    ids = first.join(moved, "fp", "left").select("fp", F.coalesce("group_id", "first_id").alias("component_id"))
    ids = written(ids, "components")  # so that AQE can split the join below when copies crowd a fingerprint
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return prints.join(ids, "fp").select("doc_id", digits.alias("fingerprint"), "component_id")
