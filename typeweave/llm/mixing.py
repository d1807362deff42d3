"""Mixing sources to target weights by Pareto order sampling.

Every source gets a target in words: its weight's part of `share` times all
words, but at most `cap` times what it has; what a full source leaves over goes
to the others by weight.  A document first gets the whole copies that its
source's ratio makes certain; the rest is a sample with unequal chances, which go
with what the mix favours (by default longer documents, by their size's number
of binary digits) and are set so that the words to be expected are the words
that are left; documents whose chance comes to 1 are certain as well.  The
others are ordered by random odds over inclusion odds, and cut where the
source's words come nearest its target.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from typeweave.llm.common import WORD
from typeweave.operators.fixpoint import written

#: Order keys are cut into so many bins a source, and the bin at a source's cut again; only the last bin at the cut is sorted.
BINS, LEVELS = 256, 2
#: The most that a document can be favoured, against 1.
FAVOURS = 64


def source_targets(sized: DataFrame, *, weights: tuple[int, ...], share: Fraction, cap: int) -> DataFrame:
    """(source, size) -> (source, source_size, target), one row a source.

    Weights repeat over the sources by code point, null last.  Sources are
    filled in the order of size over weight: the first whose part of what is
    left is not more than its cap gives the level for itself and all after it.
    """
    num, den = share.numerator, share.denominator
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    totals = totals.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights) + 1).cast("int")).cast("long"))
    by_ratio, every = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last()), Window.partitionBy()
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    filled = (
        totals.withColumn("place", F.row_number().over(by_ratio))
        .withColumn("left_size", num * F.sum("source_size").over(every) - den * cap * F.coalesce(F.sum("source_size").over(before), F.lit(0)))
        .withColumn("left_weight", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    )
    fits = F.col("left_size") * F.col("weight") <= den * cap * F.col("source_size") * F.col("left_weight")
    level = F.col("left_size").cast("double") / (den * F.col("left_weight")).cast("double")
    filled = filled.withColumn("first", F.min(F.when(fits, F.struct("place", level.alias("level")))).over(every))
    target = F.least((cap * F.col("source_size")).cast("double"), F.coalesce(F.col("first.level") * F.col("weight"), F.lit(0.0)))
    return filled.select("source", "source_size", target.alias("target"))


def chances(classes: DataFrame, per_source: DataFrame) -> DataFrame:
    """(source, favour, words) and `source_targets` -> (s, f, source_size, target, whole, rest, chance) for each source and favour.

    whole copies are certain; the chance of a further one goes with favour, at a level at which the words to be
    expected are what the target still lacks.  Favours that the level would lift above 1 are certain;
    rest is what remains for the others.  There are no more rows than favours for a source.
    """
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    shares = per_source.withColumn("whole", F.floor(ratio)).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    down = Window.partitionBy("source").orderBy(F.desc("favour"))
    both = classes.join(shares.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")))
    both = both.withColumn("above", F.coalesce(F.sum("words").over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    weighed = F.sum(F.col("favour") * F.col("words")).over(down.rowsBetween(0, Window.unboundedFollowing))
    both = both.withColumn("level", F.when(weighed > 0, (F.col("rest") - F.col("above")) / weighed))
    first = F.max(F.when(F.col("level") * F.col("favour") <= 1, F.struct("favour", "level", "above"))).over(Window.partitionBy("source"))
    chance = F.when(F.col("favour") > F.col("first.favour"), 1.0).otherwise(F.coalesce(F.col("first.level") * F.col("favour"), F.lit(0.0)))
    rest = F.col("rest") - F.coalesce("first.above", F.lit(0))
    return both.withColumn("first", first).select("s", F.col("favour").alias("f"), "source_size", "target", "whole", rest.alias("rest"), chance.alias("chance"))


def draw(seed: str, key: Column, text: Column) -> Column:
    """A number in (0, 1) that depends on seed, key and text only."""
    whole = F.concat_ws("|", F.lit(seed), F.coalesce(key.cast("string"), F.lit("null")), F.md5(F.coalesce(text.cast("string"), F.lit("")).cast("binary")))
    digest = F.md5(whole.cast("binary"))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(2**52)


def pareto_mix(
    docs: DataFrame,
    *,
    text: str = "text",
    key: str = "doc_id",
    source: str = "source",
    weights: tuple[int, ...] = (3, 1, 2),
    share: Fraction = Fraction(3, 2),
    cap: int = 2,
    seed: str = "mix",
    favour: Column | None = None,
) -> DataFrame:
    """(doc_id, size, source_size, target, taken) for every document.

    size counts the words of the text (null or empty: 0), taken the words that
    the mix takes, repeats counted: a whole multiple of size, at most cap times it.
    `favour`, a column of docs, is cut to whole numbers from 1 to 64, to which the chances of a
    source's documents are proportional (default: binary digits of the size); null counts as 1.
    A null source is a source of its own; null or repeated keys are drawn like
    others, apart by their texts, equal rows in any order; other columns of docs are ignored.
    Reruns agree, whatever the partitioning.  No documents: no rows.
    """
    size = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")
    liked = F.coalesce(favour.cast("int"), F.lit(1)) if favour is not None else F.length(F.bin(size))
    sized = written(
        docs.select(
            F.col(key).alias("doc_id"),
            F.col(source).cast("string").alias("source"),
            size.alias("size"),
            draw(seed, F.col(key), F.col(text)).alias("u"),
            F.least(F.greatest(liked, F.lit(1)), F.lit(FAVOURS)).alias("favour"),
        ),
        "sized",
    )
    classes = written(sized.groupBy("source", "favour").agg(F.sum("size").alias("words")), "classes")
    per_source = source_targets(classes.withColumnRenamed("words", "size"), weights=weights, share=share, cap=cap)
    shares = written(chances(classes, per_source), "shares")  # written, a small table is joined without moving the documents
    keyed = sized.join(shares, F.col("source").eqNullSafe(F.col("s")) & (F.col("favour") == F.col("f"))).drop("s", "f")
    odds = F.col("chance") / (1 - F.col("chance"))
    keyed = keyed.withColumn("order_key", F.when((F.col("chance") > 0) & (F.col("chance") < 1), F.col("u") / (1 - F.col("u")) / odds))
    keyed = keyed.withColumn("z", F.col("order_key") / (1 + F.col("order_key")))
    columns = ["doc_id", "size", "source_size", "target", ((F.col("whole") + F.col("extra")) * F.col("size")).cast("long").alias("taken")]
    out = keyed.where("z is null").withColumn("extra", F.floor("chance")).select(*columns)
    left = keyed.where("z is not null").select("doc_id", "source", "size", "source_size", "target", "whole", "rest", "z")
    for level in range(LEVELS):
        left = left.withColumn("bin", F.least(F.floor(F.col("z") * BINS), F.lit(BINS - 1))).withColumn("z", F.col("z") * BINS - F.col("bin"))
        bins = left.groupBy("source", "rest", "bin").agg(F.sum("size").alias("words"))
        upto = F.sum("words").over(Window.partitionBy("source", "rest").orderBy("bin"))
        cut = bins.withColumn("upto", upto).where("upto > rest and upto - words <= rest")
        cut = cut.select(F.col("source").alias("s"), F.col("bin").alias("cut_bin"), (F.col("upto") - F.col("words")).alias("below"))
        cut = written(cut, f"cut-{level}")
        placed = left.join(cut, F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
        clear = placed.where("cut_bin is null or bin <> cut_bin").withColumn("extra", F.when(F.col("bin") > F.col("cut_bin"), 0).otherwise(1))
        out = out.unionByName(clear.select(*columns))
        left = placed.where("bin = cut_bin").withColumn("rest", F.col("rest") - F.col("below")).drop("bin", "cut_bin", "below")
    after = F.sum("size").over(Window.partitionBy("source").orderBy("z", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0))
    nearer = 2 * F.col("after") - F.col("size") <= 2 * F.col("rest")
    edge = left.withColumn("after", after).withColumn("extra", nearer.cast("int"))
    return out.unionByName(edge.select(*columns))
