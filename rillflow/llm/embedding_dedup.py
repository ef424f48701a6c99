"""Embedding near-dedup with randomised-rotation binary codes.

A random isometry takes unit vectors to more dimensions; the signs are the code, and the inner product of a
vector with its own code is stored as a correction factor. The inner product of a code with another
rotated vector, divided by the factor, is an unbiased estimate of the cosine, with a confidence bound that
shrinks with the length of the code. Pairs whose bound stays below the threshold are done with; all others
are computed exactly in double precision, so no pair below the threshold is linked.

Candidates share the bits of one of several tables of the code. A table has more bits the more vectors a
label has, and there are as many tables as keep the chance of missing a pair at the threshold below MISS.
Equal vectors of a label are one class from the start. Large buckets are cut into blocks, and blocks are
paired; a pair counts in the first table where it meets, so that counts need no list of pairs, and a tile
sends one row a vector: its number of links there and the smallest class it reaches there.

Defined results: vectors that are null, empty, zero or hold null or non-finite components, and vectors with
a null label, link with nothing; vectors of different lengths do not link; rows that repeat an id are one
vector, the smallest by label and components; a null id is a row of its own; equal cosines need no order, as links are
counted; vectors of any length are coded whole; an empty table gives an empty result; other columns, whatever their
names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import graph, tables, textbytes

#: Code bits per dimension, width of the confidence bound, chance of a miss, vectors in a bucket, rows in a block.
CODE_BITS, WIDTH, MISS, BUCKET, BLOCK = 4, 3.0, 0.005, 8, 512


def rotation(dims: int) -> np.ndarray:
    """A random isometry from dims dimensions to a multiple of 64, at least CODE_BITS times as many."""
    bits = -(-CODE_BITS * dims // 64) * 64
    q, r = np.linalg.qr(np.random.default_rng(dims).normal(size=(bits, dims)))
    return q * np.sign(np.diag(r))


def plan(n: int, threshold: float) -> tuple[int, int]:
    """(bits of a table, number of tables) for n vectors of a label."""
    bits = int(np.clip(np.ceil(np.log2(max(n, 2) / BUCKET)), 4, 30))
    same = (1 - np.arccos(np.clip(threshold, -1, 1)) / np.pi) ** bits
    return bits, max(1, int(np.ceil(np.log(MISS) / np.log1p(-min(same, 0.999)))))


def _positions(bits: int, count: int, code_bits: int) -> np.ndarray:
    """The code bits of each table: without overlap as far as the code reaches."""
    rng = np.random.default_rng(bits * 1009 + count)
    deals = -(-bits * count // (code_bits // bits * bits))
    rows = np.concatenate([rng.permutation(code_bits)[: code_bits // bits * bits].reshape(-1, bits) for _ in range(deals)])
    return rows[:count]


def _coded(heads: DataFrame, threshold: float) -> DataFrame:
    """(head, label, m, vector, n) -> head, m, vector, code, factor, keys."""
    schema = T.StructType([heads.schema["head"], heads.schema["m"], heads.schema["vector"], T.StructField("code", T.BinaryType()), T.StructField("factor", T.DoubleType()), T.StructField("keys", T.ArrayType(T.LongType()))])
    source = heads.select("head", "m", "vector", F.xxhash64("label", F.size("vector")).alias("group"), "n")

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            groups, sizes = b.column(3).to_numpy(), b.column(4).to_numpy()
            vectors = b.column(2).to_pylist()
            codes, factors, keys = [b""] * b.num_rows, np.zeros(b.num_rows), [[]] * b.num_rows
            for dims in {len(v) for v in vectors}:
                turn = rotation(dims)
                own = np.array([i for i, v in enumerate(vectors) if len(v) == dims])
                x = np.array([vectors[i] for i in own], float)
                y = (x / np.linalg.norm(x, axis=1, keepdims=True)) @ turn.T
                signs = y >= 0
                factors[own] = np.abs(y).sum(1) / np.sqrt(y.shape[1])
                packed = np.packbits(signs, axis=1)
                for n in np.unique(sizes[own]):
                    bits, count = plan(int(n), threshold)
                    at = np.flatnonzero(sizes[own] == n)
                    picked = signs[at][:, _positions(bits, count, signs.shape[1])]
                    values = picked.astype(np.uint64) @ (np.uint64(1) << np.arange(bits, dtype=np.uint64))
                    told = textbytes.mix(values + textbytes.mix(np.arange(count, dtype=np.uint64) + groups[own[at]].view(np.uint64)[:, None]))
                    for i, row in zip(own[at], told.view(np.int64).tolist(), strict=True):
                        keys[i] = row
                for i, c in zip(own, packed, strict=True):
                    codes[i] = c.tobytes()
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(codes, pa.binary()), pa.array(factors), pa.array(keys, pa.list_(pa.int64()))], names=schema.names)

    return tables.map_arrow(source, coded, schema)


def _tile_links(x: np.ndarray, signs: np.ndarray, factor: np.ndarray, turned: np.ndarray, keys: np.ndarray, table: int, own: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (i < j, as two arrays) of a tile that link and meet here first."""
    bits = signs.shape[1]
    estimate = (signs @ turned.T) / (np.sqrt(bits) * factor[:, None])
    bound = estimate + WIDTH * np.sqrt(np.maximum(1 - factor**2, 0) / factor**2 / (bits - 1))[:, None]
    maybe = np.minimum(bound, bound.T) >= threshold
    maybe &= own[:, None] != own[None, :] if own.min() != own.max() else True
    i, j = np.nonzero(np.triu(maybe, 1))
    if table and len(i):
        new = ~(keys[i, :table] == keys[j, :table]).any(1)
        i, j = i[new], j[new]
    exact = np.einsum("ij,ij->i", x[i], x[j])
    return i[exact >= threshold], j[exact >= threshold]


def _flat(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The values of a list or binary column one after another, and where each row's begin."""
    held = column.combine_chunks()
    held = pa.concat_arrays(held.chunks) if isinstance(held, pa.ChunkedArray) else held
    if isinstance(held, pa.LargeBinaryArray):
        _, offsets, data = held.buffers()
        return np.frombuffer(data or b"", np.uint8), np.frombuffer(offsets, np.int64)[held.offset : held.offset + len(held) + 1]
    return held.values.to_numpy(zero_copy_only=False), held.offsets.to_numpy()


def _lowest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The lowest row that each row reaches."""
    low = np.arange(n)
    while True:
        new = low.copy()
        np.minimum.at(new, i, low[j])
        np.minimum.at(new, j, low[i])
        new = new[new]
        if (new == low).all():
            return low
        low = new


#: Largest components of vectors whose squares can be summed as they are.
SAFE = (1e-140, 1e140)


def _linked(tiles: DataFrame, threshold: float) -> DataFrame:
    """Rows sorted by tile -> head, links, reach: one row a vector and tile where it has links."""
    schema = T.StructType([tiles.schema["head"], T.StructField("links", T.LongType()), T.StructField("reach", tiles.schema["head"].dataType)])
    source = tiles.select("key", "i", "j", "own", "table", "head", "m", "vector", "code", "factor", "keys")

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        """Batches cut so that each tile is whole."""
        left: list[pa.RecordBatch] = []
        for b in batches:
            if not b.num_rows:
                continue
            place = np.stack([b.column(k).to_numpy().astype(np.int64) for k in range(3)], 1)
            last = len(place) - int(np.argmax((place != place[-1])[::-1].any(1))) if (place != place[-1]).any() else 0
            if left and tuple(place[0]) != tuple(left[-1].column(k)[0].as_py() for k in range(3)):
                yield pa.Table.from_batches(left)
                left = []
            if last:
                yield pa.Table.from_batches([*left, b.slice(0, last)])
                left = []
            left.append(b.slice(last))
        if left:
            yield pa.Table.from_batches(left)

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turns: dict[int, np.ndarray] = {}
        for t in runs(batches):
            place = np.stack([t.column(k).to_numpy().astype(np.int64) for k in range(3)], 1)
            bounds = np.concatenate(([0], np.flatnonzero((place[1:] != place[:-1]).any(1)) + 1, [len(place)]))
            own, table, heads, m, factor = (t.column(k).to_numpy() for k in (3, 4, 5, 6, 9))
            lists, codes, keys = _flat(t.column(7)), _flat(t.column(8).cast(pa.large_binary())), _flat(t.column(10))
            out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                if b - a < 2:
                    continue
                within = np.argsort(heads[a:b], kind="stable")
                order, rows = a + within, lambda held: held[0][held[1][a] : held[1][b]].reshape(b - a, -1)[within]  # noqa: B023
                x = rows(lists).astype(float)
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                turn = turns.setdefault(x.shape[1], rotation(x.shape[1]))
                signs = np.unpackbits(rows(codes), axis=1) * 2.0 - 1
                i, j = _tile_links(x, signs, factor[order], x @ turn.T, rows(keys), int(table[a]), own[order], threshold)
                if len(i):
                    n, weight = b - a, m[order].astype(float)
                    links = np.bincount(i, weight[j], n) + np.bincount(j, weight[i], n)
                    some = np.flatnonzero(links)
                    out.append((heads[order][some], links[some].astype(np.int64), heads[order][_lowest(n, i, j)[some]]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=schema.names)

    return tables.map_arrow(source, linked, schema)


def embedding_links(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = 0.93) -> DataFrame:
    """id, n_links, component_id, kept; one row per id, for integer ids."""
    named = vectors.select(vectors[id_col].cast("long").alias("id"), vectors[label_col].alias("label"), vectors[vector_col].cast("array<double>").alias("vector"))
    if named.groupBy("id").count().where("count > 1").limit(1).count():
        named = named.groupBy("id").agg(F.min(F.struct("label", "vector")).alias("x")).select("id", "x.*")
    finite = F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    usable = F.col("id").isNotNull() & F.col("label").isNotNull() & F.coalesce(finite & F.exists("vector", lambda v: v != 0), F.lit(False))
    # squares of very large or small components leave the range of doubles: such vectors are divided by their largest
    largest = F.array_max(F.transform("vector", F.abs))
    named = named.withColumn("largest", F.when(usable, largest)).withColumn("vector", F.when(F.col("largest").between(*SAFE), F.col("vector")).when(usable, F.transform("vector", lambda v: v / F.col("largest"))).otherwise(F.col("vector"))).drop("largest")
    classes = tables.saved(named.where(usable).groupBy("label", "vector").agg(F.min("id").alias("head"), F.count(F.lit(1)).alias("m")), "vector-classes")
    sizes = tables.saved(classes.groupBy("label", F.size("vector").alias("dims")).agg(F.count(F.lit(1)).alias("n")), "label-sizes")
    sized = classes.withColumn("dims", F.size("vector")).join(tables.small(sizes), ["label", "dims"])
    coded = tables.saved(_coded(sized, threshold), "vector-codes")

    keyed = coded.select("head", F.posexplode("keys").alias("table", "key"))
    buckets = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    blocks = F.ceil(F.col("size") / F.lit(BLOCK)).cast("int")
    met = keyed.join(buckets, "key").select("key", "table", "head", blocks.alias("blocks"), F.pmod(F.xxhash64("head"), blocks).cast("int").alias("own"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    placed = met.select("key", "table", "head", "own", other).select("key", "table", "head", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    tiles = placed.join(coded, "head").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    linked = tables.saved(_linked(tiles, threshold), "vector-links")

    counts = linked.groupBy("head").agg(F.sum("links").alias("links"))
    reached = graph.components(linked.select(F.col("head").alias("a"), F.col("reach").alias("b")))
    head_of = named.where(usable).join(classes, ["label", "vector"]).select("id", "head", "m")
    told = named.select("id").join(head_of, "id", "left").join(counts, "head", "left").join(reached, F.col("head") == F.col("node"), "left")
    component = F.coalesce("component", "head", "id")
    n_links = F.coalesce(F.col("m") - 1, F.lit(0)) + F.coalesce("links", F.lit(0))
    return told.select(F.col("id").alias(id_col), n_links.cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"))
