"""Near copies by exact Jaccard similarity of word shingles.

SimHash proposes links first: sets of shingles whose fingerprints are within two
bits of each other, by anchor-point covering.  An exact prefix filter proposes
the rest, so that no link is missed.  All texts order their shingles
alike, common ones last; two texts of similarity s or more share one of the
first n - ceil(s n) + 1 of the n shingles of each.  What is common is counted on
a bounded sample, which decides the order and so the time, never the result.
Equal sets are one candidate, and of shingles that the same sets share only the
first in that order counts.  The sets of a shared shingle are compared along
their sizes, each with its neighbour; those links and SimHash's are verified
and joined into components.  Then only pairs of different components are
compared, so a crowd of near copies costs a row for each member, and the sets of
a crowded shingle meet in blocks of bounded size.  Pairs are
dropped by the place of their shared shingle and by sketches, both of which
bound what two sets share from above, and where an earlier shingle has brought
them together already; the rest is compared whole.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from typeweave.llm import simhash
from typeweave.llm.common import free_name
from typeweave.operators.components import connected_components
from typeweave.operators.fixpoint import discard, written

SEED = 42
#: Texts on which common shingles are counted, about; shingles in that order table, at most; texts that make a shingle common.
ORDER_SAMPLE, ORDER_TABLE, COMMON = 8_000, 100_000, 4
#: Parts that a sketch counts shingles in; sets of a shingle that meet in a task, about.
PARTS, BLOCK = 256, 2_048
#: Sets that a task remembers, so as not to pass on copies of them.
SEEN = 200_000
#: First shingles of a set by which it is known where a pair met before; pairs that first meet later than these may come repeatedly.
FIRSTS = 32


def shingles_of(text: str | None, size: int) -> np.ndarray:
    """The shingles' XXH64 values, ascending, with repeats; a text shorter than a shingle is one, without words it has none."""
    return np.sort(simhash.shingle_hashes(text, size).view(np.int64))


def _set_id(grams: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(grams.tobytes(), SEED) - (1 << 63)


def _sketch(grams: np.ndarray) -> bytes:
    """How many shingles fall into each part, in one byte or four; the sum of two sketches' minima is no less than what the sets share."""
    found = np.bincount(grams & (PARTS - 1), minlength=PARTS)
    return found.astype(np.uint8 if found.max() < 256 else np.uint32).tobytes()


def _sketches(column: pa.Array) -> np.ndarray:
    return np.stack([np.frombuffer(x.as_buffer(), np.uint8 if len(x.as_buffer()) == PARTS else np.uint32) for x in column]).astype(np.int32)


def prefix_of(grams: np.ndarray, similarity: float, common: np.ndarray, times: np.ndarray) -> np.ndarray:
    """The first shingles in the order that all texts share: those not in `common` (ascending), then by `times` there."""
    n = len(grams)
    length = n - math.ceil(similarity * n - 1e-9) + 1
    rank = np.zeros(n, np.int64)
    if len(common):
        at = np.minimum(np.searchsorted(common, grams), len(common) - 1)
        rank = np.where(common[at] == grams, times[at], 0)
    return grams[np.lexsort((grams, rank))[:length]]


def _arrays(values: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(v) for v in values])])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(values) if values else np.zeros(0, np.int64)))


def _common(rows: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that several texts of the sample have, ascending, and how many have them."""
    part = min(1.0, ORDER_SAMPLE / max(rows.count(), 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(shingles_of(x.as_py(), size)))], ["gram"])

    few = rows.where(F.pmod(F.xxhash64("text"), F.lit(1_000_000)) < int(part * 1_000_000)).select("text")
    often = few.mapInArrow(run, "gram long").groupBy("gram").count().where(F.col("count") >= COMMON)
    found = often.orderBy(F.desc("count"), "gram").limit(ORDER_TABLE).toArrow()
    grams, times = (found.column(i).to_numpy() for i in range(2))
    order = np.argsort(grams)
    return grams[order], times[order]


def _crossing(similarity: float):
    """Of (gram, members): pairs of different components that sizes, places and sketches allow and that share no earlier shingle of their first ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for gram, row in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                inner = row.values
                order = np.argsort(inner.field(1).to_numpy(), kind="stable")
                ids, sizes, groups, places = (inner.field(i).to_numpy()[order] for i in range(4))
                sketches = _sketches(inner.field(4).take(pa.array(order)))
                firsts = inner.field(5).take(pa.array(order))
                before: dict[int, set[int]] = {}  # of a member, its first shingles that come before this one

                def earlier(i: int, gram: int = gram, firsts: pa.Array = firsts, before: dict = before) -> set[int]:
                    if i not in before:
                        found = firsts[i].as_py()
                        before[i] = set(found[: found.index(gram)] if gram in found else found)
                    return before[i]

                left = sizes - places  # at the first shingle that a pair shares, the pair shares no more than the lesser of these
                stops = np.searchsorted(sizes, sizes / similarity + 1e-9, side="right")
                for i, stop in enumerate(stops):
                    later = slice(i + 1, stop)
                    enough = np.minimum(left[i], left[later]) * (1 + similarity) >= (sizes[i] + sizes[later]) * similarity - 1e-9
                    near = i + 1 + np.flatnonzero(enough & (groups[later] != groups[i]))
                    if len(near):
                        shared = np.minimum(sketches[near], sketches[i]).sum(axis=1)
                        near = near[shared * (1 + similarity) >= (sizes[i] + sizes[near]) * similarity - 1e-9]
                        near = near[[earlier(i).isdisjoint(earlier(j)) for j in near.tolist()]] if len(near) else near
                    others = ids[near]
                    if len(others):
                        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(others, ids[i])), pa.array(np.maximum(others, ids[i]))], ["a", "b"])

    return run


def _sketched(similarity: float):
    """Of (a, b, x, y), a pair and its sketches: the pairs that the sketches allow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = _sketches(batch.column(2)), _sketches(batch.column(3))
            keep = np.minimum(x, y).sum(axis=1) * (1 + similarity) >= (x.sum(axis=1) + y.sum(axis=1)) * similarity - 1e-9
            yield batch.select([0, 1]).filter(pa.array(keep))

    return run


def near_copies(docs: DataFrame, *, text: str = "text", key: str = "doc_id", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """(doc_id, component_id) for every document.

    Texts link at a Jaccard similarity of their sets of shingles of `similarity`
    or more; component_id is the smallest doc_id that can be reached, null only
    if no document of the group has one.  Texts without words (null, empty,
    white space) are copies of each other.  Keys may be null or repeated; other
    columns are ignored; no documents, no rows.
    """
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return near_groups(rows, shingle, similarity).select("doc_id", "component_id")


def near_groups(rows: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """(doc_id, own columns, group, component_id) of rows (doc_id, text, own columns); group is never null."""
    order = rows.sparkSession.sparkContext.broadcast(_common(rows, shingle))
    own = [c for c in rows.columns if c not in ("doc_id", "text")]
    kinds = dict(rows.dtypes)
    used: list[DataFrame] = []

    def kept(df: DataFrame, name: str) -> DataFrame:
        """As `written`, until the groups are found."""
        used.append(written(df, name))
        return used[-1]

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # a set that a task has passed on needs no second prefix from it
        for batch in batches:
            ids, sizes, firsts, sketches, prints = [], [], [], [], []
            for x in batch.column(1):
                every = shingles_of(x.as_py(), shingle)
                grams = np.unique(every)
                ids.append(_set_id(grams))
                sizes.append(len(grams))
                again = ids[-1] in seen
                firsts.append(grams[:0] if again or not len(grams) else prefix_of(grams, similarity, *order.value))
                sketches.append(None if again else _sketch(grams))
                prints.append(None if again else simhash.fingerprint_of(every.view(np.uint64)))
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add(ids[-1])
            fps = pa.array([None if f is None else f - (1 << 64 if f >> 63 else 0) for f in prints], pa.int64())
            columns = [batch.column(0), *batch.columns[2:], pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), _arrays(firsts), pa.array(sketches, pa.binary()), fps]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", *own, "set_id", "n", "prefix", "sketch", "fp"])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.unique(shingles_of(x.as_py(), shingle)) for x in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(map(_set_id, found), pa.int64()), _arrays(found)], ["id", "grams"])

    schema = ", ".join(["doc_id long", *(f"{c} {kinds[c]}" for c in own), "set_id long, n long, prefix array<long>, sketch binary, fp long"])
    every = kept(rows.select("doc_id", "text", *own).mapInArrow(prefixes, schema), "prefixes")
    sets = every.groupBy(F.col("set_id").alias("id")).agg(F.min("doc_id").alias("first_id"), F.first("sketch", ignorenulls=True).alias("sketch"), F.min("fp").alias("fp"))
    sets = kept(sets, "sets")
    at = every.select(F.col("set_id").alias("id"), "n", F.posexplode("prefix").alias("place", "gram")).repartition("gram").dropDuplicates(["gram", "id"])
    by_size = Window.partitionBy("gram").orderBy("n", "id")
    members = at.select("gram", "id", "n", "place", *(f("id").over(by_size).alias(name) for f, name in ((F.lag, "other"), (F.lead, "next"))), F.lag("n").over(by_size).alias("less"))
    shared = kept(members.where("other is not null or next is not null").drop("next"), "shared")
    # of shingles that the same sets share, the first in the order of all texts brings together every pair that the others would
    of_gram = shared.groupBy("gram").agg(F.count("*").alias("sets"), F.bit_xor(F.xxhash64("id")).alias("x"), F.bit_xor(F.xxhash64("id", F.lit(SEED))).alias("y"), F.min(F.struct("id", "place")).alias("least"))
    apart = kept(of_gram.groupBy("sets", "x", "y").agg(F.min(F.struct("least.place", "gram")).alias("first")).select("first.gram"), "apart")
    members = kept(shared.join(apart, "gram", "left_semi"), "members")
    discard(shared, apart)
    beside = members.where(F.col("less") >= F.col("n") * similarity - 1e-9).select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b"))

    def allowed(pairs: DataFrame) -> DataFrame:
        """Those of (a, b) that sketches allow."""
        pairs = kept(pairs.distinct(), "pairs")
        for end, sketch in (("a", "x"), ("b", "y")):
            pairs = pairs.join(sets.select(F.col("id").alias(end), F.col("sketch").alias(sketch)), end)
        return pairs.select("a", "b", "x", "y").mapInArrow(_sketched(similarity), "a long, b long")

    def alike(pairs: DataFrame) -> DataFrame:
        """Those of (a, b) that are as similar as asked."""
        pairs = kept(pairs, "sketched")
        ids = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
        ids = kept(ids.join(sets, "id").select("id", "first_id"), "ids")
        texts = rows.join(ids.where("first_id is not null").select(F.col("first_id").alias("doc_id")).distinct(), "doc_id", "left_semi").select("text")
        texts = texts.unionByName(rows.where("doc_id is null").select("text"))
        grams = kept(texts.mapInArrow(whole, "id long, grams array<long>").join(ids.select("id"), "id", "left_semi").dropDuplicates(["id"]), "shingles")
        for end, values in (("a", "x"), ("b", "y")):
            pairs = pairs.join(grams.select(F.col("id").alias(end), F.col("grams").alias(values)), end)
        same = F.size(F.array_intersect("x", "y"))
        return kept(pairs.where(same * (1 + similarity) >= (F.size("x") + F.size("y")) * similarity - 1e-9).select("a", "b"), "alike")

    links = alike(allowed(beside.unionByName(_print_links(sets, kept))))
    groups = kept(connected_components(links, "a", "b"), "beside-groups")
    grouped = members.join(groups, F.col("id") == F.col("node"), "left").select("gram", "id", "n", F.coalesce("component", "id").alias("component"), "place")
    mixed = grouped.groupBy("gram").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("sets")).where("lo <> hi")
    mixed = kept(mixed.select(F.col("gram").alias("g"), F.ceil(F.col("sets") / BLOCK).cast("int").alias("blocks")), "mixed")
    met = kept(grouped.join(mixed, F.col("gram") == F.col("g")).drop("g"), "met")
    in_order = F.array_sort(F.collect_list(F.struct("place", "gram")))
    firsts = met.groupBy("id").agg(F.slice(in_order["gram"], 1, FIRSTS).alias("firsts")).join(sets.select("id", "sketch"), "id")
    met = met.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    met = met.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.join(kept(firsts, "first-shingles"), "id")
    met = met.groupBy("gram", F.least("block", "with").alias("low"), F.greatest("block", "with").alias("high")).agg(F.collect_list(F.struct("id", "n", "component", "place", "sketch", "firsts")).alias("members"))
    links = links.unionByName(alike(met.select("gram", "members").mapInArrow(_crossing(similarity), "a long, b long").distinct()))
    groups = kept(connected_components(links, "a", "b"), "copy-groups")
    least = kept(groups.join(sets, F.col("node") == F.col("id")).groupBy("component").agg(F.min("first_id").alias("group_id")), "copy-leasts")
    moved = groups.join(least, "component").select(F.col("node").alias("id"), F.col("component").alias("moved"), "group_id")
    found = sets.join(moved, "id", "left").select("id", F.coalesce("moved", "id").alias("group"), F.when(F.col("moved").isNull(), F.col("first_id")).otherwise(F.col("group_id")).alias("component_id"))
    found = written(every.select("doc_id", *own, F.col("set_id").alias("id")).join(kept(found, "copies"), "id").select("doc_id", *own, "group", "component_id"), "grouped")
    discard(*used)
    return found


def one_of_each(docs: DataFrame, *, text: str = "text", key: str = "doc_id", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """docs with one row of each group of near copies: that with the smallest doc_id (null last); of equal keys, that with the smallest hash of its text.

    All columns stay.  Of rows that are repeated with key and text, one stays.
    """
    mark, rank, few_id, few_mark = (free_name(n, docs.columns) for n in ("mark", "rank", "few_id", "few_mark"))
    marked = docs.withColumn(mark, F.xxhash64(F.col(text).cast("string")))
    rows = marked.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), F.col(mark).alias("mark"))
    groups = near_groups(rows, shingle, similarity)
    rows = written(groups.groupBy("group", "doc_id", "mark").agg(F.count("*").alias("times")), "marked")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark")
    first = written(rows.groupBy("group").agg(F.min(order).alias("first")).select(F.col("group").alias("g"), "first"), "firsts")
    placed = rows.join(first, F.col("group") == F.col("g")).select("doc_id", "mark", "times", (order == F.col("first")).alias("is_first"))
    # what changes is few: rows that go, and rows that are kept once of several
    few = written(placed.where("not is_first or times > 1").select(F.col("doc_id").alias(few_id), F.col("mark").alias(few_mark), "is_first"), "dropped")
    discard(groups, rows, first)
    same = F.col(key).cast("long").eqNullSafe(F.col(few_id)) & (F.col(mark) == F.col(few_mark))
    out = marked.join(few.select(few_id, few_mark), same, "left_anti").select(docs.columns)
    repeated = few.where("is_first").select(few_id, few_mark)
    if repeated.isEmpty():
        return out
    once = Window.partitionBy(key, mark).orderBy(*[F.hash(c) for c in docs.columns])
    kept = marked.join(repeated, same, "left_semi").withColumn(rank, F.row_number().over(once)).where(F.col(rank) == 1)
    return out.unionByName(kept.select(docs.columns))


def _print_links(sets: DataFrame, kept: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """(a, b) of sets whose fingerprints are equal or within two bits, through the least set of a fingerprint."""
    prints = kept(sets.groupBy("fp").agg(F.min("id").alias("least")), "prints")
    equal = sets.select("id", "fp").join(prints, "fp").where("id <> least").select("id", "least")
    near = simhash.near_links(prints.select("fp"))
    for end in ("src", "dst"):
        near = near.join(prints.select(F.col("fp").alias(end), F.col("least").alias(f"{end}_id")), end)
    both = equal.unionByName(near.select(F.col("src_id").alias("id"), F.col("dst_id").alias("least")))
    return both.select(F.least("id", "least").alias("a"), F.greatest("id", "least").alias("b"))
