"""Mixing sources to target weights (native).

Tokens (words) per source are summed, targets are filled up by weight below a cap, and each document
is taken floor(rate) times plus one hash-seeded Bernoulli copy with probability equal to the fraction.
The draw is a projection of the document's row: only sums by source are shuffled, never a text.

Each of SEEDS shifts of the hashed number seeds a draw of its own; a source takes that whose words come nearest to
its target (one sum a source and shift, over all documents), so that a few very long documents do not decide.

Defined results: a null or empty text has size 0 and costs nothing; a null source is a source of its
own, last in order; rows that repeat an id draw the same number, so reruns and repeats agree, and so do rows with
a null id; equal sizes need no order; a text of any length counts as a whole; an empty table gives an empty result;
columns beyond the named ones, whatever their names, are carried by `mix` and ignored by `mix_plan`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import tables

#: Draws that a source chooses from, and what a shift adds to the hashed number (the golden ratio's fraction).
SEEDS, STEP = 32, 0.6180339887498949
BLANKS = " \t\n\x0b\f\r"


def word_count(text: Column) -> Column:
    """Number of runs of characters other than space and the ASCII controls 9 to 13."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(trimmed == "", F.lit(0)).otherwise(F.size(F.split(trimmed, r"[\x20\x09-\x0D]+"))).cast("long")


def uniform(seed: int, key: Column) -> Column:
    """A number in [0, 1) from 52 bits of an md5 of seed and key."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null"))))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), cap: float = 3.0) -> DataFrame:
    """(_source, _size) rows of documents -> (_source, _source_size, _target), one row a source.

    The weights go to the sources in code-point order, null last, and repeat. With r = cap * size / weight
    ascending, the sources below the water level stop at their cap; the level after capping the first k is
    (total - caps of k) / (weights of the rest), and it is highest exactly where capping ends.
    The windows without a partition run over one row a source, not over documents.
    """
    by_source = sizes.groupBy("_source").agg(F.sum("_size").alias("_source_size"))
    named = Window.orderBy(F.col("_source").asc_nulls_last())
    rank = F.row_number().over(named) - 1
    by_source = by_source.select("*", F.element_at(F.array(*map(F.lit, weights)), rank % len(weights) + 1).alias("w"))
    by_source = by_source.select("*", (F.lit(cap) * F.col("_source_size") / F.col("w")).alias("r"))
    earlier = Window.orderBy("r", F.col("_source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("_source_size").over(every) - F.lit(cap) * F.coalesce(F.sum("_source_size").over(earlier), F.lit(0))
    rest = F.sum("w").over(every) - F.coalesce(F.sum("w").over(earlier), F.lit(0))
    by_source = by_source.select("*", (left / rest).alias("level"))
    level = F.max("level").over(every)
    return by_source.select("_source", "_source_size", F.least(F.lit(cap) * F.col("_source_size"), level * F.col("w")).alias("_target"))


def _shifted(shift: Column) -> Column:
    moved = F.col("_u") + shift * F.lit(STEP)
    return moved - F.floor(moved)


def _planned(docs: DataFrame, id_col: str, text_col: str, source_col: str, weights: tuple[int, ...], cap: float, seed: int, rows: bool) -> DataFrame:
    """_id, _size, _source_size, _target and _copies of each document, and with rows its columns as the struct row."""
    told = [docs[id_col].alias("_id"), docs[source_col].alias("_of"), word_count(docs[text_col]).alias("_size"), uniform(seed, docs[id_col]).alias("_u")]
    sized = tables.saved(docs.select(*told), "mix-sizes")
    targets = tables.saved(source_targets(sized.select(F.col("_of").alias("_source"), "_size"), weights, cap), "mix-targets")
    rate = F.when(F.col("_source_size") > 0, F.col("_target") / F.col("_source_size")).otherwise(0.0)
    rates = targets.select("*", F.floor(rate).alias("_whole"), (rate - F.floor(rate)).alias("_f"))
    # the words of each draw, a row a source
    drawn = sized.join(tables.small(rates), sized["_of"].eqNullSafe(rates["_source"]))
    sums = [F.sum(F.when(_shifted(F.lit(k)) < F.col("_f"), F.col("_size")).otherwise(0)).alias(f"_{k}") for k in range(SEEDS)]
    off = lambda k: F.abs(F.col("_whole") * F.col("_source_size") + F.col(f"_{k}") - F.col("_target"))
    nearest = F.array_min(F.array(*[F.struct(off(k).alias("off"), F.lit(k).alias("k")) for k in range(SEEDS)]))["k"]
    chosen = drawn.groupBy("_source", "_source_size", "_target", "_whole", "_f").agg(*sums).withColumn("_shift", nearest).drop(*[f"_{k}" for k in range(SEEDS)])
    chosen = tables.small(tables.saved(chosen, "mix-sources"))
    held = docs.select(F.struct(*docs.columns).alias("row"), *told) if rows else sized
    joined = held.join(chosen, held["_of"].eqNullSafe(chosen["_source"]), "left")
    copies = F.col("_whole") + (_shifted(F.col("_shift")) < F.col("_f")).cast("long")
    return joined.select(*(["row"] if rows else []), "_id", "_size", "_source_size", "_target", copies.alias("_copies"))


def mix_plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (5, 2, 1), cap: float = 3.0, seed: int = 17) -> DataFrame:
    """One row per document: id, size, source_size, target, copies, taken (words with repeats)."""
    plan = _planned(docs, id_col, text_col, source_col, weights, cap, seed, False)
    return plan.select(F.col("_id").alias(id_col), F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), F.col("_copies").alias("copies"), (F.col("_size") * F.col("_copies")).alias("taken"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (5, 2, 1), cap: float = 3.0, seed: int = 17) -> DataFrame:
    """The documents of the mix, each as often as it is taken, with the columns of docs."""
    plan = _planned(docs, id_col, text_col, source_col, weights, cap, seed, True)
    again = F.explode(F.array_repeat(F.lit(0), F.col("_copies").cast("int"))).alias("_copy")
    return plan.where("_copies > 0").select("row", again).select("row.*")
