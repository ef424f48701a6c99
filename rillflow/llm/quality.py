"""Quality by random-indexing word vectors, pooled per document, and a two-layer network.

Tokens are runs of one kind of character: letters as they are, capitals and digits by their number,
marks as they are. Each has a 64-bit hash, from which its sparse index vector is derived. One pass over
all documents sums the index vectors of the neighbours of every token (random indexing); a document's
vector is the mean of its tokens' index vectors and of their unit context vectors. A two-layer numpy network
is fit on at most TRAIN_ROWS labelled rows, and a temperature, fit on rows that the weights had not seen,
calibrates its probabilities.

The context vectors are a table of all tokens that stand at MIN_COUNT places at least (rarer ones have no context to
speak of, and count by their index vectors), which grows with the vocabulary. It is sent to the tasks if a count
proves it to be at most SENT_ROWS rows, and scoring is then one projection of a document's row. Beyond that it is
joined: to the distinct tokens of blocks of texts with the places where they stand; a block comes together again and
its texts are pooled. Sums are whole numbers (unit vectors in steps of 1/127), so they depend neither on the order of
tasks nor on the way. A text is named by two hashes.

Defined results: null and empty texts have the zero vector and its score; every row is scored on its own, so
repeated rows repeat; rows that repeat a labelled id are learnt from as one (the smallest text), and of several
labels of an id the largest counts; ties of scores need no order; without training rows of both labels every score is
the share of good rows (0.5 without rows); a text of any length is one slice of its own; an empty table gives an empty
result; other columns, whatever their names, are carried by `keep_quality` and not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import tables, textbytes

DIMS, WINDOW = 32, 2
TRAIN_ROWS, HIDDEN, EPOCHS = 20_000, 32, 30
#: Places that a token must stand at to have a context vector; vectors up to which they are sent to the tasks.
MIN_COUNT, SENT_ROWS = 5, 1_000_000
#: Bits of a hash by which tokens are told to be frequent where there are more than SENT_ROWS such.
SLOT_BITS = 26
#: Tokens whose sums a task holds before it passes them on; (text, token) pairs of a block.
HELD_ROWS, BLOCK_PAIRS = 150_000, 1_500_000

#: Kinds of bytes: 0 blanks, 1 letters, 2 capitals, 3 digits, 4 marks.
_KIND = np.full(256, 4, np.uint8)
_KIND[textbytes.LETTER] = 1
_KIND[65:91] = 2
_KIND[48:58] = 3
_KIND[textbytes.SPACE] = 0


def _index_places(h: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Place and sign of each of the four entries of the index vectors of hashes."""
    m, step = textbytes.mix(h.view(np.uint64) ^ np.uint64(11)), DIMS // 4
    for k in range(4):
        bits = (m >> np.uint64(16 * k)).astype(np.int64) & 0xFFFF
        yield k * step + (bits >> 1) % step, ((bits & 1) * 2 - 1).astype(np.int8)


def index_vectors(h: np.ndarray) -> np.ndarray:
    """Sparse ternary vectors of hashes, four ones and minus ones each."""
    out = np.zeros((len(h), DIMS), np.int8)
    for place, sign in _index_places(h):
        out[np.arange(len(h)), place] = sign
    return out


def _tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of the tokens, and the first of each row."""
    kind = _KIND[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    edge[1:-1] |= kind[1:] != kind[:-1]
    edge[[0, -1]] = True
    bounds = np.flatnonzero(edge)
    starts, ends = bounds[:-1], bounds[1:]
    kept = kind[starts] != 0 if len(starts) else np.zeros(0, bool)
    starts, ends = starts[kept], ends[kept]
    h = textbytes.word_hashes(data, starts, ends, np.arange(256, dtype=np.uint8))
    for k, most in ((2, 3), (3, 4)):
        own = kind[starts] == k
        h[own] = textbytes.mix(np.minimum(ends[own] - starts[own], most).astype(np.uint64) + np.uint64(k << 8))
    return h.view(np.int64), np.searchsorted(starts, offsets)


def _summed(keys: list[np.ndarray], sums: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys in order, and the sums of their rows."""
    key, each = np.concatenate(keys), np.concatenate(sums)
    order = np.argsort(key, kind="stable")
    own, at = np.unique(key[order], return_index=True)
    return own, np.add.reduceat(each[order], at, axis=0) if len(own) else each


def _packed(sums: np.ndarray) -> list[bytes]:
    """Each row as bytes where its numbers are small, else as 64-bit numbers."""
    little = np.abs(sums).max(1, initial=0) < 128
    return [(r.astype(np.int8) if few else r.astype(np.int64)).tobytes() for r, few in zip(sums, little, strict=True)]


def _unpacked(column: pa.Array) -> np.ndarray:
    held = column.to_pylist()
    little = np.array([len(v) == DIMS for v in held], bool)
    out = np.zeros((len(held), DIMS), np.int64)
    out[little] = np.frombuffer(b"".join(v for v in held if len(v) == DIMS), np.int8).reshape(-1, DIMS)
    out[~little] = np.frombuffer(b"".join(v for v in held if len(v) != DIMS), np.int64).reshape(-1, DIMS)
    return out


_VECTOR = T.StructType([T.StructField("h", T.LongType()), T.StructField("v", T.BinaryType())])
_SUMS = T.StructType([*_VECTOR, T.StructField("n", T.LongType())])


def _frequent(docs: DataFrame) -> DataFrame:
    """(h): the tokens that stand at MIN_COUNT places at least, counted over all rows."""
    schema = T.StructType([T.StructField("h", T.LongType()), T.StructField("n", T.LongType())])

    def told(own: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        for k in range(0, len(own), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(own[k : k + 50_000]), pa.array(n[k : k + 50_000, 0].astype(np.int64))], names=schema.names)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, held = [np.zeros(0, np.int64)], [np.zeros((0, 1), np.int64)], 0
        for b in batches:
            for _, _, data, offsets in textbytes.slices(b.column(0)):
                own, n = np.unique(_tokens(data, offsets)[0], return_counts=True)
                keys.append(own)
                counts.append(n[:, None])
                held += len(own)
                if held > 8 * HELD_ROWS:
                    own, n = _summed(keys, counts)
                    if len(own) > 4 * HELD_ROWS:
                        yield from told(own, n)
                        own, n = own[:0], n[:0]
                    keys, counts, held = [own], [n], len(own)
        yield from told(*_summed(keys, counts))

    each = tables.map_arrow(docs.select("text"), counted, schema)
    return each.groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= MIN_COUNT).select("h")


def _bitmap(frequent: DataFrame) -> np.ndarray:
    """A bit for each slot of hashes (their first SLOT_BITS bits) that holds a frequent token: 2^(SLOT_BITS - 3) bytes."""
    slot = F.shiftrightunsigned("h", 64 - SLOT_BITS)
    words = frequent.groupBy(F.shiftright(slot, 6).alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), slot.bitwiseAND(63).cast("int"))).alias("bits")).toArrow()
    bits = np.zeros(1 << (SLOT_BITS - 6), np.int64)
    bits[words["word"].to_numpy()] = words["bits"].to_numpy()
    return bits.view(np.uint64)


def _in_bitmap(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    slot = h.view(np.uint64) >> np.uint64(64 - SLOT_BITS)
    return (bits[slot >> np.uint64(6)] >> (slot & np.uint64(63)) & np.uint64(1)).astype(bool)


def _contexts(docs: DataFrame, frequent: np.ndarray | None, bits: np.ndarray | None = None) -> DataFrame:
    """(h, v, n): sums of the index vectors around each token and its places, several rows a token, over all rows.

    frequent: the tokens to sum for, where they are few enough to be sent; else those whose slot is set in bits.
    """
    sent = docs.sparkSession.sparkContext.broadcast((frequent, bits))

    def told(own: np.ndarray, sums: np.ndarray) -> Iterator[pa.RecordBatch]:
        for k in range(0, len(own), 20_000):
            part = sums[k : k + 20_000]
            yield pa.RecordBatch.from_arrays([pa.array(own[k : k + 20_000]), pa.array(_packed(part[:, :DIMS]), pa.binary()), pa.array(np.ascontiguousarray(part[:, DIMS]))], names=_SUMS.names)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, sums, n, (known, slots) = [np.zeros(0, np.int64)], [np.zeros((0, DIMS + 1), np.int64)], 0, sent.value
        held = np.zeros((0 if known is None else len(known), DIMS + 1), np.int32)
        for b in batches:
            for _, _, data, offsets in textbytes.slices(b.column(0)):
                h, first = _tokens(data, offsets)
                if not len(h):
                    continue
                own, of = np.unique(h, return_inverse=True)
                vectors, around = index_vectors(own)[of], np.zeros((len(h), DIMS + 1), np.int8)
                around[:, DIMS] = 1
                row = np.repeat(np.arange(len(first) - 1), np.diff(first))
                for step in range(1, WINDOW + 1):
                    near = (row[step:] == row[:-step])[:, None]
                    around[step:, :DIMS] += vectors[:-step] * near
                    around[:-step, :DIMS] += vectors[step:] * near
                if known is not None:  # sums in place, a row for each frequent token
                    place = np.minimum(np.searchsorted(known, own), max(len(known) - 1, 0))
                    wanted = known[place] == own if len(known) else np.zeros(len(own), bool)
                    left = np.flatnonzero(wanted[of])
                    left = left[np.argsort(of[left], kind="stable")]
                    if len(left):
                        new = np.flatnonzero(np.diff(of[left], prepend=-1))
                        held[place[of[left[new]]]] += np.add.reduceat(around[left], new, axis=0, dtype=np.int32)
                    continue
                left = np.flatnonzero(_in_bitmap(slots, own)[of])
                if not len(left):
                    continue
                left = left[np.argsort(of[left], kind="stable")]
                new = np.flatnonzero(np.diff(of[left], prepend=-1))
                keys.append(own[of[left[new]]])
                sums.append(np.add.reduceat(around[left], new, axis=0, dtype=np.int64))
                n += len(new)
                if n > 2 * HELD_ROWS:
                    own, each = _summed(keys, sums)
                    if len(own) > HELD_ROWS:
                        yield from told(own, each)
                        own, each = own[:0], each[:0]
                    keys, sums, n = [own], [each], len(own)
        yield from told(*_summed(keys, sums))
        seen = np.flatnonzero(held[:, DIMS])
        for k in range(0, len(seen), 20_000):
            yield from told(known[seen[k : k + 20_000]], held[seen[k : k + 20_000]].astype(np.int64))

    return tables.map_arrow(docs.select("text"), summed, _SUMS)


def word_vectors(docs: DataFrame) -> DataFrame:
    """(h, v): the unit context vector of every token with MIN_COUNT places, in steps of 1/127.

    The tokens are counted first: what is summed and shuffled after that are the frequent ones, and beyond SENT_ROWS of
    them those few others that share a slot of 2^SLOT_BITS with one, which are dropped when the sums are whole.
    """
    counted = tables.saved_few(_frequent(docs), "quality-tokens")
    few = counted.limit(SENT_ROWS + 1).count() <= SENT_ROWS
    frequent = np.sort(counted.toArrow()["h"].to_numpy()) if few else None

    def unit(own: np.ndarray, sums: np.ndarray) -> pa.RecordBatch:
        enough = sums[:, DIMS] >= MIN_COUNT
        own, sums = own[enough], sums[enough, :DIMS]
        length = np.linalg.norm(sums.astype(float), axis=1, keepdims=True)
        v = np.rint(sums * 127 / np.maximum(length, 1)).astype(np.int8)
        return pa.RecordBatch.from_arrays([pa.array(own), pa.array([r.tobytes() for r in v], pa.binary())], names=_VECTOR.names)

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come in the order of h; the last token of a batch can go on in the next."""
        key, sums = np.zeros(0, np.int64), np.zeros((0, DIMS + 1), np.int64)
        for b in batches:
            told = np.concatenate([_unpacked(b.column(1)), b.column(2).to_numpy()[:, None]], 1)
            key, sums = _summed([key, b.column(0).to_numpy()], [sums, told])
            if len(key) > 1:
                yield unit(key[:-1], sums[:-1])
                key, sums = key[-1:], sums[-1:]
        if len(key):
            yield unit(key, sums)

    return tables.map_arrow(_contexts(docs, frequent, None if few else _bitmap(counted)).repartition("h").sortWithinPartitions("h"), merged, _VECTOR)


def pool_texts(texts: pa.Array, known: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """The vector of each text: the means of its tokens' index and context vectors; zeros without tokens."""
    x = np.zeros((len(texts), 2 * DIMS))
    for row, end, data, offsets in textbytes.slices(texts):
        h, first = _tokens(data, offsets)
        n = np.diff(first)
        some = np.flatnonzero(n)
        if not len(some):
            continue
        own, of = np.unique(h, return_inverse=True)
        both = np.zeros((len(own), 2 * DIMS), np.int8)
        both[:, :DIMS] = index_vectors(own)
        place = np.minimum(np.searchsorted(known, own), max(len(known) - 1, 0))
        hit = known[place] == own if len(known) else np.zeros(len(own), bool)
        both[hit, DIMS:] = vectors[place[hit]]
        x[row + some] = np.add.reduceat(both[of], first[:-1][some], axis=0, dtype=np.int64) / n[some, None]
    x[:, :DIMS] /= 2
    x[:, DIMS:] /= 127
    return x.astype(np.float32)


_PLACES = np.dtype([("text", np.int32), ("count", np.int32)])
_PAIRS = "block long, h long, places binary, texts binary"
_POOLED = "k1 long, k2 long, x binary"


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, k1, k2) -> a block's tokens with their places in its texts, and one row with the names of the texts."""
    from pyspark import TaskContext

    block = TaskContext.get().partitionId() << 32
    names, texts, hashes, counts = [], [], [], []
    held = n_texts = 0

    def told() -> Iterator[pa.RecordBatch]:
        h = np.concatenate(hashes)
        order = np.argsort(h, kind="stable")
        own, at = np.unique(h[order], return_index=True)
        places = np.empty(len(h), _PLACES)
        places["text"], places["count"] = np.concatenate(texts)[order], np.concatenate(counts)[order]
        ends, data = np.append(at[1:], len(h)), places.tobytes()
        for k in range(0, len(own), 20_000):
            each = [data[a * 8 : z * 8] for a, z in zip(at[k : k + 20_000], ends[k : k + 20_000], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(each), block)), pa.array(own[k : k + 20_000]), pa.array(each, pa.binary()), pa.nulls(len(each), pa.binary())], names=["block", "h", "places", "texts"])
        named = np.concatenate(names).astype(np.int64).tobytes()
        some = textbytes.mix(np.array([block], np.uint64)).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array(some), pa.nulls(1, pa.binary()), pa.array([named], pa.binary())], names=["block", "h", "places", "texts"])

    for b in batches:
        keys = np.stack([b.column(1).to_numpy(), b.column(2).to_numpy()], 1)
        for row, end, data, offsets in textbytes.slices(b.column(0)):
            h, first = _tokens(data, offsets)
            of = np.repeat(np.arange(end - row), np.diff(first))
            order = np.lexsort((h, of))
            h, of = h[order], of[order]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (of[1:] != of[:-1])
            at = np.flatnonzero(new)
            names.append(keys[row:end])
            texts.append(of[at] + n_texts)
            hashes.append(h[at])
            counts.append(np.diff(np.append(at, len(h))))
            held, n_texts = held + len(at), n_texts + end - row
            if held > BLOCK_PAIRS or n_texts > BLOCK_PAIRS:
                yield from told()
                names, texts, hashes, counts = [], [], [], []
                held, n_texts, block = 0, 0, block + 1
    if n_texts:
        yield from told()


def _pool_block(rows: pa.Table) -> pa.Table:
    """The mean of the vectors of the tokens of each text of a block; zeros without tokens."""
    rows = rows.combine_chunks()
    named = next(v for v in rows["texts"].to_pylist() if v is not None)
    names = np.frombuffer(named, np.int64).reshape(-1, 2)
    held = rows.filter(rows["places"].is_valid())
    h, places, v = held["h"].to_numpy(), held["places"].to_pylist(), held["v"].to_pylist()
    each = np.frombuffer(b"".join(places), _PLACES)
    of = np.repeat(np.arange(len(h)), [len(p) // 8 for p in places])
    text, count = each["text"].astype(np.int64), each["count"].astype(float)
    vectors = np.frombuffer(b"".join(x or bytes(DIMS) for x in v), np.int8).reshape(-1, DIMS)
    x = np.zeros((len(names), 2 * DIMS))
    for place, sign in _index_places(h):
        x[:, :DIMS] += np.bincount(text * DIMS + place[of], count * sign[of] / 2, len(names) * DIMS).reshape(-1, DIMS)
    for d in range(DIMS):
        x[:, DIMS + d] = np.bincount(text, count * vectors[of, d], len(names)) / 127
    x = (x / np.maximum(np.bincount(text, count, len(names)), 1)[:, None]).astype(np.float32)
    return pa.table([pa.array(names[:, 0]), pa.array(names[:, 1]), pa.array([r.tobytes() for r in x], pa.binary())], names=["k1", "k2", "x"])


def pooled(docs: DataFrame, vectors: DataFrame) -> DataFrame:
    """(k1, k2, x): the vector of each distinct text of docs (text, k1, k2), as bytes of 32-bit floats."""
    pairs = tables.map_arrow(docs.select("text", "k1", "k2"), _blocks, _PAIRS)
    return pairs.join(vectors, "h", "left").groupBy("block").applyInArrow(_pool_block, _POOLED).dropDuplicates(["k1", "k2"])


class Network:
    """Two layers, and a temperature that divides the logit."""

    def __init__(self, x: np.ndarray, y: np.ndarray, seed: int = 3) -> None:
        rng = np.random.default_rng(seed)
        held = np.arange(len(x)) % 5 == 4
        if len(np.unique(y[held])) < 2 or len(np.unique(y[~held])) < 2:
            held[:] = False
        self.mean, self.scale = x[~held].mean(0), x[~held].std(0) + 1e-3
        z = (x - self.mean) / self.scale
        w = [rng.normal(0, 1 / np.sqrt(z.shape[1]), (z.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
        m, v = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w]
        rows, t = np.flatnonzero(~held), 0
        for _ in range(EPOCHS):
            rng.shuffle(rows)
            for k in range(0, len(rows), 128):
                own = rows[k : k + 128]
                a = np.tanh(z[own] @ w[0] + w[1])
                d = (1 / (1 + np.exp(-np.clip(a @ w[2] + w[3], -30, 30))) - y[own]) / len(own)
                back = d[:, None] * w[2] * (1 - a * a)
                grads, t = [z[own].T @ back, back.sum(0), a.T @ d, d.sum(keepdims=True)], t + 1
                for i, g in enumerate(grads):
                    g = g + 1e-4 * w[i]
                    m[i] = 0.9 * m[i] + 0.1 * g
                    v[i] = 0.999 * v[i] + 0.001 * g * g
                    w[i] = w[i] - 0.01 * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
        self.weights, self.temperature = w, 1.0
        if held.any():
            logit = self.logit(x[held])
            loss = {c: np.logaddexp(0, -(2 * y[held] - 1) * logit / c).mean() for c in np.geomspace(0.25, 8, 61)}
            self.temperature = float(min(loss, key=loss.get))

    def logit(self, x: np.ndarray) -> np.ndarray:
        w = self.weights
        return np.tanh((x - self.mean) / self.scale @ w[0] + w[1]) @ w[2] + w[3]

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x) / self.temperature, -30, 30)))


def _names(text_col: str) -> dict[str, Column]:
    """Two hashes that name a text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return {"k1": F.xxhash64(text), "k2": F.xxhash64(F.lit(1), text)}


def _fitted(got: list[tuple[int, bytes]]) -> tuple[Network | None, float]:
    """The network of (label, vector) rows and their share of good ones."""
    y = np.array([label for label, _ in got], float)
    x = np.frombuffer(b"".join(bytes(v) for _, v in got), np.float32).reshape(-1, 2 * DIMS).astype(float)
    order = np.random.default_rng(0).permutation(len(y))
    return (Network(x[order], y[order]) if len(np.unique(y)) == 2 else None), (float(y.mean()) if len(y) else 0.5)


def score_quality(docs: DataFrame, labels: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", carry: list[str] | None = None, score_col: str = "score") -> DataFrame:
    """The columns that carry names (id_col where it is not given) and a score (double, 0 to 1) for every row of docs.

    train: a condition on id_col for the rows to learn from.
    """
    spark, kept = docs.sparkSession, carry or [id_col]
    named = docs.select(docs[id_col].alias("_id"), docs[text_col].alias("text")).withColumns(_names("text"))
    told = labels.where(train & F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_of")).agg(F.max(label_col).cast("int").alias("label"))
    sample = tables.saved(told.orderBy(F.xxhash64(F.lit(3), "_of"), "_of").limit(TRAIN_ROWS), "quality-labels")
    seen = named.join(F.broadcast(sample), F.col("_id") == F.col("_of")).groupBy("_id").agg(F.min(F.struct("text", "label", "k1", "k2")).alias("x"))
    seen = tables.saved_few(seen.select("_id", "x.*"), "quality-training")  # at most TRAIN_ROWS documents
    vectors = tables.saved_few(word_vectors(named), "quality-vectors")
    if vectors.limit(SENT_ROWS + 1).count() > SENT_ROWS:
        return _joined_scores(docs, text_col, kept, score_col, named, seen, vectors)
    got = vectors.toArrow()
    h, v = got["h"].to_numpy(), np.frombuffer(b"".join(got["v"].to_pylist()), np.int8).reshape(-1, DIMS)
    order = np.argsort(h)
    held = spark.sparkContext.broadcast((h[order], v[order]))

    def pool(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = pool_texts(b.column(2), *held.value)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([r.tobytes() for r in x], pa.binary())], names=["_id", "label", "x"])

    rows = tables.map_arrow(seen.select("_id", "label", "text"), pool, T.StructType([seen.schema["_id"], seen.schema["label"], T.StructField("x", T.BinaryType())])).collect()
    model, share = _fitted([(r.label, r.x) for r in sorted(rows, key=lambda r: r._id)])
    sent = spark.sparkContext.broadcast(model)
    text = kept.index(text_col) if text_col in kept else len(kept)
    source = docs.select(*kept) if text < len(kept) else docs.select(*kept, docs[text_col].alias(tables.unused("_text", kept)))
    schema = T.StructType([*source.schema[: len(kept)], T.StructField(score_col, T.DoubleType())])

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = pool_texts(b.column(text), *held.value)
            p = np.full(len(x), share) if sent.value is None else sent.value(x.astype(float))
            yield pa.RecordBatch.from_arrays([*b.columns[: len(kept)], pa.array(np.asarray(p, float))], names=schema.names)

    return tables.map_arrow(source, scored, schema)


def _joined_scores(docs: DataFrame, text_col: str, kept: list[str], score_col: str, named: DataFrame, seen: DataFrame, vectors: DataFrame) -> DataFrame:
    """score_quality where the vectors are joined."""
    pools = tables.saved(pooled(named, vectors), "quality-pooled")
    rows = pools.join(F.broadcast(seen.select("k1", "k2", "_id", "label")), ["k1", "k2"]).select("_id", "label", "x").collect()  # at most TRAIN_ROWS
    model, share = _fitted([(r.label, r.x) for r in sorted(rows, key=lambda r: r._id)])
    sent = docs.sparkSession.sparkContext.broadcast(model)
    keys = [tables.unused(n, [*docs.columns, score_col]) for n in ("k1", "k2")]
    schema = T.StructType([*[T.StructField(n, T.LongType()) for n in keys], T.StructField(score_col, T.DoubleType())])

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.frombuffer(b"".join(b.column(2).to_pylist()), np.float32).reshape(-1, 2 * DIMS)
            p = np.full(len(x), share) if sent.value is None else sent.value(x.astype(float))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.asarray(p, float))], names=schema.names)

    scores = tables.small(tables.saved(tables.map_arrow(pools, scored, schema), "quality-scores"))
    return docs.select(*kept, *[c.alias(k) for k, c in zip(keys, _names(text_col).values(), strict=True)]).join(scores, keys).select(*kept, score_col)


def keep_quality(docs: DataFrame, labels: DataFrame, train: Column, least: float = 0.3, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """The rows of docs with a score of at least least."""
    name = tables.unused("_score", docs.columns)
    scored = score_quality(docs, labels, train, id_col, text_col, label_col, docs.columns, name)
    return scored.where(F.col(name) >= least).select(*docs.columns)
