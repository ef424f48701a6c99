"""Benchmark decontamination by size-partitioned MinHash containment search.

A benchmark item is found in a document when at least the threshold share of the item's distinct shingles
stands there, however long the document is. Items fall into size partitions (doubling numbers of shingles);
the signature of an item holds its smallest shingle hashes, as many as make a miss impossible at the upper
end of its partition: with n shingles, of any floor((1 - t) * n) + 1 one at least stands in every document
that holds the threshold share. Documents are probed with all their shingles, and pairs that meet in a
signature are verified by exact containment of the item's shingle set.

Items of at most BLOCK_WORDS words in all, by a count, are sent to one pass over the documents. More are joined:
shingle hashes of items are a table, of which the driver makes no more than a bitmap of fixed size, and documents give
the hashes that pass it. Signatures meet those by a join, hot hashes dealt by cells of items and documents, and the pairs
are verified by joining the items' whole sets to the hashes of their documents. Both ways give the same rows.

Words are compared in lower case (A-Z) and without ASCII punctuation. Defined results: null and empty
documents hold nothing; null or empty items are in nothing; an item with fewer words than a shingle is one
shingle of its own length; every row of the documents is searched on its own, so repeated rows repeat;
rows that repeat an item are items of their own, so they repeat too; a document of any length is searched whole;
empty tables give an empty result; other columns, whatever their names, are not read, and `decontaminate` carries them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from . import tables, textbytes

#: Items that are sent to the tasks, by the sum of their words (of WORD_BYTES bytes on average at most).
BLOCK_WORDS, WORD_BYTES = 2_000_000, 16
#: Rows of a hash in one cell of the join, by side.
CELL_ROWS = 1_000
_TOP = np.uint64(44)  # the upper 20 bits pick a place in the filter of a block


def _hashed(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Word hashes and the first word of each row, slice by slice."""
    for _, _, data, offsets in textbytes.slices(texts):
        data, offsets = textbytes.without(data, offsets, textbytes.PUNCT)
        starts, ends, first = textbytes.words(data, offsets)
        yield textbytes.word_hashes(data, starts, ends), first


def signature_length(n: int, threshold: float) -> int:
    """How many of the smallest hashes of an item with n shingles its signature holds."""
    upper = 1 << (n - 1).bit_length()
    return min(n, upper - int(np.ceil(threshold * upper - 1e-9)) + 1)


class Block:
    """Items of a block: their shingle sets, and a sorted table of signature hashes that point at them."""

    def __init__(self, items: list[tuple[object, str | None]], size: int, threshold: float) -> None:
        self.ids = [i for i, _ in items]
        self.sets: list[np.ndarray] = []
        self.sizes: list[int] = []  # words of a shingle
        for h, first in _hashed(pa.array([t for _, t in items], pa.string())):
            g, at = textbytes.shingles(h, first, size)
            for a, b, n in zip(at[:-1], at[1:], np.diff(first), strict=True):
                self.sets.append(np.unique(g[a:b]))
                self.sizes.append(int(min(size, n)))
        keys, owners = [], []
        for k, s in enumerate(self.sets):
            if len(s):
                keys.append(s[: signature_length(len(s), threshold)])
                owners.append(np.full(len(keys[-1]), k))
        keys_, owners_ = (np.concatenate(keys), np.concatenate(owners)) if keys else (np.zeros(0, np.uint64), np.zeros(0, int))
        order = np.argsort(keys_, kind="stable")
        self.keys, self.owners, self.threshold = keys_[order], owners_[order], threshold
        self.filter = np.zeros(1 << 20, bool)
        self.filter[(self.keys >> _TOP).astype(np.int64)] = True
        self.lengths = sorted({n for n, s in zip(self.sizes, self.sets, strict=True) if len(s)})

    def search(self, texts: pa.Array) -> Iterator[tuple[int, int, int]]:
        """(row, item, shared shingles) of the pairs that pass."""
        row = 0
        for h, first in _hashed(texts):
            for length in self.lengths:
                g, at = textbytes.shingles(h, first, length, short=False)
                near = np.flatnonzero(self.filter[(g >> _TOP).astype(np.int64)])
                lo, hi = np.searchsorted(self.keys, g[near], "left"), np.searchsorted(self.keys, g[near], "right")
                rows = np.searchsorted(at, near, "right") - 1
                pairs = {(int(r), int(self.owners[k])) for r, a, b in zip(rows[hi > lo], lo[hi > lo], hi[hi > lo], strict=True) for k in range(a, b)}
                held: tuple[int, np.ndarray] = (-1, g[:0])
                for r, k in sorted(pairs):
                    if self.sizes[k] != length:
                        continue
                    if held[0] != r:
                        held = (r, np.unique(g[at[r] : at[r + 1]]))
                    own = self.sets[k]
                    shared = int((held[1][np.minimum(np.searchsorted(held[1], own), len(held[1]) - 1)] == own).sum())
                    if shared >= self.threshold * len(own) - 1e-9:
                        yield row + r, k, shared
            row += len(first) - 1


def _item_sets(items: DataFrame, item_type: pa.DataType, size: int, threshold: float) -> DataFrame:
    """_item (a number for the row), _as (the item's id), length (words of a shingle), keys (signature length) and hashes, in order."""
    numbered = items.select(F.monotonically_increasing_id().alias("_item"), "_as", "_text")
    schema = T.StructType([numbered.schema[0], numbered.schema[1], *T.StructType.fromDDL("length int, keys int, hashes array<bigint>").fields])

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, row = [], 0
            for h, first in _hashed(b.column(2)):
                g, at = textbytes.shingles(h, first, size)
                for k in np.flatnonzero(np.diff(at)):
                    own = np.unique(g[at[k] : at[k + 1]])
                    rows.append((row + int(k), min(size, int(first[k + 1] - first[k])), signature_length(len(own), threshold), own.view(np.int64)))
                row += len(first) - 1
            at = pa.array([r for r, *_ in rows], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(at), b.column(1).take(at).cast(item_type), pa.array([n for _, n, _, _ in rows], pa.int32()), pa.array([k for _, _, k, _ in rows], pa.int32()), pa.array([s for *_, s in rows], pa.list_(pa.int64()))],
                names=schema.names,
            )

    return tables.saved(tables.map_arrow(numbered, sets, schema), "decontaminate-items")


def _document_hashes(docs: DataFrame, sets: DataFrame) -> DataFrame:
    """_row (a number for the row), _of (its id) and hashes: the distinct shingle hashes that pass the bitmap of all items' hashes."""
    h = sets.select(F.explode("hashes").alias("h"))
    bit = F.expr("shiftleft(1L, cast(shiftrightunsigned(h, 38) & 63L as int))")
    places = h.groupBy(F.shiftrightunsigned("h", 44).alias("place")).agg(F.bit_or(bit).alias("bits")).toArrow()  # at most 2^20 rows
    bits = np.zeros(1 << 20, np.uint64)
    bits[places.column("place").to_numpy()] = places.column("bits").to_numpy().view(np.uint64)
    lengths = sorted(r.length for r in sets.select("length").distinct().collect())  # at most as many as a shingle has words
    held = docs.sparkSession.sparkContext.broadcast(bits)
    numbered = docs.select(F.monotonically_increasing_id().alias("_row"), "_of", "_text")
    schema = T.StructType([numbered.schema[0], numbered.schema[1], T.StructField("hashes", T.ArrayType(T.LongType()))])

    def passing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, low = held.value, np.uint64(63)
        for b in batches:
            row = 0
            for h, first in _hashed(b.column(2)):
                hashes, rows = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
                for length in lengths:
                    g, at = textbytes.shingles(h, first, length, short=False)
                    near = np.flatnonzero((bits[(g >> _TOP).astype(np.int64)] >> ((g >> np.uint64(38)) & low)) & np.uint64(1))
                    hashes.append(g[near])
                    rows.append(np.searchsorted(at, near, "right") - 1)
                g, r = np.concatenate(hashes), np.concatenate(rows)
                order = np.lexsort((g, r))
                g, r = g[order], r[order]
                new = np.ones(len(g), bool)
                new[1:] = (g[1:] != g[:-1]) | (r[1:] != r[:-1])
                g, r = g[new], r[new]
                some, n = np.unique(r, return_counts=True)
                ends = np.concatenate(([0], np.cumsum(n))).astype(np.int32)
                at = pa.array(some + row, pa.int64())
                yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.ListArray.from_arrays(pa.array(ends), pa.array(g.view(np.int64)))], names=schema.names)
                row += len(first) - 1

    return tables.saved(tables.map_arrow(numbered, passing, schema), "decontaminate-documents")


def _joined(docs: DataFrame, items: DataFrame, item_type: pa.DataType, size: int, threshold: float) -> DataFrame:
    """_of, _as, shared and item_shingles of the pairs that pass, for items of any number."""
    sets = _item_sets(items, item_type, size, threshold)
    held = _document_hashes(docs, sets)
    hits = held.select("_row", F.explode("hashes").alias("h"))
    signs = sets.select("_item", F.explode(F.slice("hashes", F.lit(1), F.col("keys"))).alias("h"))
    both = tables.saved(signs.groupBy("h").agg(F.count(F.lit(1)).alias("n_items")).join(hits.groupBy("h").agg(F.count(F.lit(1)).alias("n_rows")), "h"), "decontaminate-hashes")
    cells = lambda n: F.ceil(F.col(n) / CELL_ROWS).cast("int")
    one_of = lambda row, n: F.pmod(F.xxhash64(row), cells(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), cells(n) - 1))
    by_row = tables.join_hot(hits, both, ["h"], ["_row"], "n_rows").select("h", "_row", one_of("_row", "n_rows").alias("r"), each("n_items").alias("i"))
    by_item = tables.join_hot(signs, both, ["h"], ["_item"], "n_items").select("h", "_item", one_of("_item", "n_items").alias("i"), each("n_rows").alias("r"))
    pairs = tables.saved(by_row.join(by_item, ["h", "r", "i"]).select("_row", "_item").distinct(), "decontaminate-pairs")
    sized = tables.saved(sets.select("_item", "_as", "hashes").join(pairs.groupBy("_item").agg(F.count(F.lit(1)).alias("n_pairs")), "_item"), "decontaminate-wanted")
    wanted = tables.join_hot(pairs, sized, ["_item"], ["_row"], "n_pairs").select("_row", "_item", "_as", F.size("hashes").cast("long").alias("item_shingles"), F.explode("hashes").alias("h"))
    told = wanted.join(hits, ["_row", "h"]).groupBy("_row", "_item").agg(F.count(F.lit(1)).alias("shared"), F.any_value("_as").alias("_as"), F.any_value("item_shingles").alias("item_shingles"))
    return told.where(F.col("shared") >= threshold * F.col("item_shingles") - 1e-9).join(held.select("_row", "_of"), "_row")


def contained_items(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", size: int = 5, threshold: float = 0.8) -> DataFrame:
    """id, item, shared, item_shingles (long), containment (double); a row for each item found in a document."""
    named = docs.select(docs[id_col].alias(id_col), docs[text_col].alias("_text"))
    kind = items.schema[item_col]
    schema = T.StructType([named.schema[0], T.StructField(item_col, kind.dataType), T.StructField("shared", T.LongType()), T.StructField("item_shingles", T.LongType()), T.StructField("containment", T.DoubleType())])
    item_type = to_arrow_type(kind.dataType)

    told = items.select(F.col(item_col).alias("_as"), F.coalesce(F.col(item_text_col), F.lit("")).alias("_text"))
    n_words = F.size(F.filter(F.split("_text", r"[\x20\x09-\x0D]+"), lambda w: w != ""))
    told = told.where(n_words > 0)  # the others are in nothing
    n = told.agg(F.sum(n_words.cast("long")).alias("words"), F.sum(F.octet_length("_text").cast("long")).alias("bytes")).first()
    if (n.words or 0) > BLOCK_WORDS or (n.bytes or 0) > BLOCK_WORDS * WORD_BYTES:
        found = _joined(named.select(F.col(id_col).alias("_of"), "_text"), told, item_type, size, threshold)
        return found.select(F.col("_of").alias(id_col), F.col("_as").alias(item_col), "shared", "item_shingles", (F.col("shared") / F.col("item_shingles")).alias("containment"))
    held = docs.sparkSession.sparkContext.broadcast([(r[0], r[1]) for r in told.toLocalIterator()])

    def found_in(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Block(held.value, size, threshold)
        for b in batches:
            got = list(index.search(b.column(1)))
            n = [len(index.sets[k]) for _, k, _ in got]
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array([r for r, _, _ in got], pa.int64())), pa.array([index.ids[k] for _, k, _ in got], item_type), pa.array([s for _, _, s in got], pa.int64()), pa.array(n, pa.int64()), pa.array([s / m for (_, _, s), m in zip(got, n, strict=True)], pa.float64())],
                names=schema.names,
            )

    return tables.map_arrow(named, found_in, schema)


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", size: int = 5, threshold: float = 0.8) -> DataFrame:
    """The rows of docs that hold no item; a null id holds none by definition of the join, unless its row is found."""
    found = contained_items(docs, items, id_col, text_col, item_col, item_text_col, size, threshold)
    name = tables.unused("_held", docs.columns)
    marked = tables.saved(found.select(F.col(id_col).alias(name)).distinct(), "contaminated")
    return docs.join(tables.small(marked, 1_000_000), docs[id_col].eqNullSafe(marked[name]), "left_anti")
