"""N-gram Jaccard join over size-banded tiles with hashed bitmap signatures.

Two texts link when the Jaccard similarity of their shingle sets is at least the threshold (a fraction of
whole numbers, tested without rounding).

1. Texts with equal sets are one class, told by two 64-bit sums over the set; one member stands for it.
2. Sizes fall into bands. In a band, two linked sets differ in at most D shingles, so of any K > D parts of
   the shingles by hash at least K - D are equal. Sets meet in a tile (band, part, hash of the part). A set
   also enters the band below if it can be the larger set of a pair there. A set that differs from its linked
   ones in at most d parts enters its first d + 1 parts that hold a shingle (all parts, empty ones too, if fewer
   do): of two linked sets, the one that stops first has an equal part among them, so no pair is lost.
3. In each tile all sets are paired with the smallest id. Sizes and the bit counts of parity bitmaps bound
   the overlap from above; pairs that pass are decided by intersecting their sorted arrays.
4. Only tiles that still hold more than one component are worked on further: blocks of such a tile are
   paired with each other under the same bounds, leaving out what is connected already.

Shuffles are deleted when what they made is written, and tables when they are read no more, so the disk holds the sets'
keys once and one shuffle of them; texts are kept for pairs alone, and where those are many they go in passes.

The members of a hot tile are dealt to several tasks, and so are the pairs of a text that leads many.

Component ids are the smallest ids that links reach. Defined results: null and empty texts have size 0 and
link with nothing; a text with fewer words than a shingle has its whole sequence as one; rows that repeat
an id are one document with the smallest of their texts; a null id leads no class and gets the component
of an equal text, or null; very long texts have as many parts as their size asks for; an empty table gives an
empty result; other columns, whatever their names, are not read, and `keep_one` carries them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import graph, tables, textbytes

#: Ratio of the ends of a size band, words of a bitmap, and sets in a block of a tile.
BAND, BITMAP_WORDS, BLOCK = 1.5, 16, 2048
#: Parts beyond those that can differ, at least.
SLACK = 2
#: Ids (one number each) up to which they are broadcast to pick texts, once counted.
WANTED_ROWS = 1_000_000
#: Texts of pairs go in a pass for each such part of all sets' shingles, and for so many at least.
PASS_PART, PASS_SHINGLES = 4, 30_000_000


class Bands:
    """Size bands and their number of parts for a threshold num / den."""

    def __init__(self, num: int, den: int) -> None:
        if not 0 < num <= den:
            raise ValueError("the threshold is above 0 and at most 1")
        self.num, self.den = num, den
        self.ratio = max(BAND, den / num)
        self.low = [1]

    def _grow(self, n: int) -> None:
        while self.low[-1] <= n:
            self.low.append(max(self.low[-1] + 1, int(np.ceil(self.low[-1] * self.ratio))))

    def largest(self, n: int) -> int:
        """The size of the largest set that links with one of size n."""
        return n * self.den // self.num

    def of(self, n: int) -> list[tuple[int, int, int]]:
        """(band, parts, differ) of the bands that a set of size n enters: its own, and those whose sets can be smaller partners.

        differ: the most parts in which it differs from a set that it links with there.
        """
        self._grow(n)
        own = int(np.searchsorted(self.low, n, "right")) - 1
        out = []
        for band in range(own, -1, -1):
            top = min(self.low[band + 1] - 1, n)  # the largest smaller set in this band
            if band < own and self.largest(top) < n:
                break
            out.append((band, self.parts(band), self._differ(top, self.largest(n) if band == own else n)))
        return out

    def parts(self, band: int) -> int:
        """More than can differ in a linked pair of the band."""
        differ = self.differing(band)
        load = self.num / (self.den - self.num) if self.num < self.den else 0.0  # shingles a part; exp(-load) of the parts are empty
        return differ + 1 + min(differ, max(SLACK, int(np.ceil(differ * min(0.1, 2 * np.exp(-load))))))

    def _differ(self, small: int, large: int) -> int:
        """The most shingles in which linked sets of these sizes differ: (1 - t) / (1 + t) of both."""
        return (self.den - self.num) * (small + large) // (self.den + self.num)

    def differing(self, band: int) -> int:
        """The most shingles in which a linked pair of the band differs."""
        while band + 1 >= len(self.low):
            self._grow(self.low[-1])
        small = self.low[band + 1] - 1
        return self._differ(small, self.largest(small))


_NO_KEYS = np.zeros(0, np.int64)


def _signature(h: np.ndarray, bands: Bands) -> tuple[int, int, bytes, np.ndarray]:
    """Two sums over a sorted set, its parity bitmap and its tile keys."""
    one = textbytes.mix(h)
    two = textbytes.mix(h ^ np.uint64(0x5851F42D4C957F2D))
    bits = BITMAP_WORDS * 64
    parity = (np.bincount((one % np.uint64(bits)).astype(np.int64), minlength=bits) & 1).astype(np.uint8)
    keys: list[np.ndarray] = []
    for band, parts, differ in bands.of(len(h)):
        if parts == 1:
            continue  # only equal sets link here
        part = ((two >> np.uint64(20)) % np.uint64(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        n = np.bincount(part, minlength=parts)
        filled = np.flatnonzero(n)
        sums = np.add.reduceat(one[order], np.concatenate(([0], np.cumsum(n[filled])[:-1])))
        each = np.zeros(parts, np.uint64)
        each[filled] = sums
        tile = textbytes.mix(each + textbytes.mix(np.arange(parts, dtype=np.uint64) + np.uint64(band << 32)))
        keys.append(tile[filled[: differ + 1]] if len(filled) > differ else tile)
    with np.errstate(over="ignore"):
        a, b = int(one.sum().view(np.int64)), int(two.sum().view(np.int64))
    return a, b, np.packbits(parity, bitorder="little").tobytes(), np.concatenate(keys).view(np.int64) if keys else _NO_KEYS


def sorted_sets(texts: pa.Array, size: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingles of each text, as 64-bit hashes."""
    for _, _, data, offsets in textbytes.slices(texts):
        starts, ends, first = textbytes.words(data, offsets)
        h, at = textbytes.shingles(textbytes.word_hashes(data, starts, ends), first, size)
        for a, b in zip(at[:-1], at[1:], strict=True):
            yield np.unique(h[a:b])


def signatures(docs: DataFrame, size: int, bands: Bands) -> DataFrame:
    """(id, n, s1, s2, bits, keys) of (id, text) rows."""
    schema = T.StructType([docs.schema[0], T.StructField("n", T.LongType()), T.StructField("s1", T.LongType()), T.StructField("s2", T.LongType()), *[T.StructField(f"b{i}", T.LongType()) for i in range(BITMAP_WORDS)], T.StructField("keys", T.ArrayType(T.LongType()))])

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 512):
                b = whole.slice(k, 512)
                sets = list(sorted_sets(b.column(1), size))
                told = [_signature(h, bands) if len(h) else (0, 0, b"\0" * (8 * BITMAP_WORDS), _NO_KEYS) for h in sets]
                keys = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum([len(x[3]) for x in told]))), pa.int32()), pa.array(np.concatenate([_NO_KEYS, *(x[3] for x in told)])))
                words = np.frombuffer(b"".join(x[2] for x in told), "<i8").reshape(-1, BITMAP_WORDS)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), pa.array([len(h) for h in sets], pa.int64()), pa.array([x[0] for x in told], pa.int64()), pa.array([x[1] for x in told], pa.int64()), *(pa.array(np.ascontiguousarray(words[:, i])) for i in range(BITMAP_WORDS)), keys],
                    names=schema.names,
                )

    return tables.map_arrow(docs, signed, schema)


def _may_link(x: str, y: str, num: int, den: int) -> Column:
    """Whether sizes and bitmaps leave room for a link: a differing bit is a differing shingle at least."""
    nx, ny = F.col(f"{x}.n"), F.col(f"{y}.n")
    differing = sum((F.bit_count(F.col(f"{x}.b{i}").bitwiseXOR(F.col(f"{y}.b{i}"))) for i in range(BITMAP_WORDS)), F.lit(0))
    return (F.least(nx, ny) * den >= F.greatest(nx, ny) * num) & (differing * (den + num) <= (nx + ny) * (den - num))


def _saved(df: DataFrame, name: str) -> DataFrame:
    """df written and read back; the shuffles that made it are deleted."""
    return tables.saved_parts([df], name)


def _verified(pairs: DataFrame, docs: DataFrame, shingles: int, size: int, num: int, den: int) -> DataFrame:
    """The pairs (a, b) of ids whose texts link, by intersecting sorted arrays; pairs has the size n of b's set, docs the texts."""
    ids = _saved(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct(), "wanted")
    texts = _saved(docs.join(tables.small(ids, WANTED_ROWS), "id", "left_semi"), "texts")
    schema = T.StructType(pairs.select("a", "b").schema.fields)
    passes = max(1, -(-(pairs.agg(F.sum("n").alias("n")).first().n or 0) // max(PASS_SHINGLES, shingles // PASS_PART)))

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 256):
                b = whole.slice(k, 256)
                keep = []
                for x, y in zip(sorted_sets(b.column(2), size), sorted_sets(b.column(3), size), strict=True):
                    common = len(np.intersect1d(x, y, assume_unique=True))
                    keep.append(common * den >= (len(x) + len(y) - common) * num)
                yield pa.RecordBatch.from_arrays(b.columns[:2], names=schema.names).filter(pa.array(keep, pa.bool_()))

    def parts() -> Iterator[DataFrame]:
        for k in range(passes):
            own = (pairs.where(F.pmod(F.xxhash64("a"), F.lit(passes)) == k) if passes > 1 else pairs).select("a", "b")
            with_b = own.join(texts.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b")
            leads = own.groupBy("a").agg(F.count(F.lit(1)).alias("m"))
            leads = _saved(texts.select(F.col("id").alias("a"), F.col("text").alias("ta")).join(leads, "a"), "lead-texts")
            yield tables.map_arrow(tables.join_hot(with_b, leads, ["a"], ["b"], "m").select("a", "b", "ta", "tb"), linked, schema)
            tables.drop(leads)

    links = tables.saved_parts(parts(), "links")
    tables.drop(ids, texts)
    return links


def ngram_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, num: int = 90, den: int = 100) -> DataFrame:
    """id, n_shingles, class_id, component_id; one row per id. Sets link at a Jaccard similarity of num / den."""
    bands = Bands(num, den)
    named = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    if named.groupBy("id").count().where("count > 1").limit(1).count():
        named = named.groupBy("id").agg(F.min("text").alias("text"))
    signed = _saved(signatures(named, size, bands), "signatures")
    told = ["n", "s1", "s2"]
    single = signed.select("id", *told)
    shingles = single.agg(F.sum("n").alias("n")).first().n or 0
    sets = "n > 0 and id is not null"
    classes = single.where(sets).groupBy(*told).agg(F.min("id").alias("head"), F.count(F.lit(1)).alias("m"))
    equal = _saved(single.where(sets).join(classes.where("m > 1"), told).where("id <> head").select("id"), "equal-sets")
    few = equal.limit(WANTED_ROWS + 1).count() <= WANTED_ROWS
    standing = signed.where(sets).select("id", "keys").join(F.broadcast(equal) if few else equal, "id", "left_anti")
    standing = standing if few else _saved(standing, "class-heads")
    bits = ["id", "n", *[f"b{i}" for i in range(BITMAP_WORDS)]]
    sketch = signed.select(*bits)

    keyed = standing.select("id", F.explode("keys").alias("key"))
    leaders = keyed.groupBy("key").agg(F.min("id").alias("lead"), F.count(F.lit(1)).alias("m")).where("m > 1")  # a set has a key once
    leaders = _saved(leaders, "leaders")
    tiles = _saved(tables.join_hot(keyed, leaders, ["key"], ["id"], "m").where("id <> lead").select("key", "id", "lead", "m"), "tiles")
    tables.drop(equal, standing, leaders)

    first = tiles.select(F.col("lead").alias("a"), F.col("id").alias("b")).distinct()
    met = first.alias("p").join(sketch.alias("x"), F.col("p.a") == F.col("x.id")).join(sketch.alias("y"), F.col("p.b") == F.col("y.id"))
    passed = _saved(met.where(_may_link("x", "y", num, den)).select("p.a", "p.b", "y.n"), "pairs")
    links = _verified(passed, named, shingles, size, num, den)
    found = _saved(graph.components(links), "components")

    # tiles with more than one component left: their members by block, without the leader
    comp = F.coalesce("component", "id")
    labelled = tiles.where("m > 2").join(found, tiles["id"] == found["node"], "left").select("key", "m", "id", comp.alias("comp"))
    mixed = labelled.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("held")).where("lo <> hi").select("key", "held")
    mixed = _saved(mixed, "mixed")
    blocks = F.ceil(F.col("m") / F.lit(BLOCK)).cast("int")
    left = tables.join_hot(labelled, mixed, ["key"], ["id"], "held").select("key", "id", "comp", blocks.alias("blocks"), F.pmod(F.xxhash64("id"), blocks).cast("int").alias("block"))
    left = _saved(left.join(sketch, "id"), "mixed-tiles")
    tables.drop(tiles, mixed)
    others = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    x = left.select("*", others.alias("other"), F.col("block").alias("own"))
    x = x.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "comp", *bits)
    meets = (F.col("x.key") == F.col("y.key")) & (F.col("x.i") == F.col("y.i")) & (F.col("x.j") == F.col("y.j"))
    apart = (F.col("x.comp") != F.col("y.comp")) & (F.col("x.id") < F.col("y.id")) & ((F.col("x.own") != F.col("y.own")) | (F.col("x.i") == F.col("x.j")))
    second = x.alias("x").join(x.alias("y"), meets & apart & _may_link("x", "y", num, den)).select(F.col("x.id").alias("a"), F.col("y.id").alias("b"), "y.n").distinct()
    second = _saved(second, "pairs")
    tables.drop(left)
    more = _verified(second, named, shingles, size, num, den)
    if more.limit(1).count():
        found = graph.components(links.unionByName(more))

    members = _saved(single.join(classes, told, "left").select("id", "n", F.coalesce("head", "id").alias("head")), "members")
    tables.drop(signed)
    return members.join(found, F.col("head") == F.col("node"), "left").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("head").alias("class_id"), F.coalesce("component", "head").alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows of docs whose id is the smallest of its component; rows with a null id stay.

    Of rows that repeat an id one stays, that with the smallest text (then the smallest other columns).
    """
    found = ngram_join(docs.select(id_col, text_col), id_col, text_col, size, num, den)
    name = tables.unused("_copy", docs.columns)
    rest = _saved(found.where(F.col("component_id") != F.col(id_col)).select(F.col(id_col).alias(name)), "copies")
    kept = docs.join(tables.small(rest, WANTED_ROWS), docs[id_col] == rest[name], "left_anti")
    again = kept.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias(name)).count().where("count > 1").select(name)
    again = _saved(again, "repeated")
    if not again.limit(1).count():
        return kept
    told = tables.small(again, WANTED_ROWS)
    once = kept.join(told, kept[id_col] == again[name], "left_anti")
    row = F.struct(F.col(text_col).alias("first"), F.struct(*docs.columns).alias("row"))
    one = kept.join(told, kept[id_col] == again[name], "left_semi").groupBy(id_col).agg(F.min(row).alias(name))
    return once.unionByName(one.select(F.col(f"{name}.row").alias(name)).select(f"{name}.*"))
