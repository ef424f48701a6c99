"""Token-id output in directly addressable codes.

Ids are cut into 8-bit chunks. Level 0 holds the low chunk of every id of a document and a bitmap of the
ids that go on; level 1 holds the next chunk of those, and so on. A rank directory gives the number of set
bits before each block of 512, so token i is reached level by level, without decoding its neighbours.

The table `tokens` has one row per document in ascending id order over its part files: id, part, the start
within the part, n_tokens and the codes; the table `parts` has the ids of each part, from which starts over all
parts are summed. Both are Parquet with the codes as a binary column, so that they lie in any store that Spark
writes, task retries included. Within a document any token is read without decoding others.

Texts are encoded as the library does by itself, added tokens in them included. Defined results: null is the empty
text, which has the end id alone; null ids come first; rows that repeat an id follow one another, ordered by text;
a text of any length is one row; an empty table gives an empty result; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import itertools
import json
import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import tables

BLOCK_BITS = 512
#: A unit of text up to this many characters is remembered, and so many units at most.
UNIT_CHARS, CACHED_UNITS = 48, 1_500_000
_HEAD, _LEVEL = struct.Struct("<4sIB"), struct.Struct("<II")


def encode_codes(ids: np.ndarray) -> bytes:
    """The codes of one document's ids (each below 2**32)."""
    levels: list[bytes] = []
    rest = ids.astype("<u4")
    while True:
        more = rest > 255
        bits = np.packbits(more, bitorder="little")
        blocks = -(-len(bits) // (BLOCK_BITS // 8))
        ranks = np.zeros(blocks, "<u4")
        if blocks > 1:
            ranks[1:] = np.cumsum(np.add.reduceat(np.bitwise_count(bits), np.arange(blocks) * (BLOCK_BITS // 8), dtype=np.uint32))[:-1]
        levels += [_LEVEL.pack(len(rest), blocks), ranks.tobytes(), bits.tobytes(), rest.view(np.uint8)[::4].tobytes()]
        rest = rest[more] >> np.uint32(8)
        if not len(rest):
            return b"".join([_HEAD.pack(b"DAC1", len(ids), len(levels) // 4), *levels])


def _levels(codes: bytes) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ranks, bitmap bytes, chunks) of each level, as views."""
    magic, _, depth = _HEAD.unpack_from(codes)
    if magic != b"DAC1":
        raise ValueError("not in this format")
    out, at = [], _HEAD.size
    for _ in range(depth):
        n, blocks = _LEVEL.unpack_from(codes, at)
        at += 8
        ranks = np.frombuffer(codes, "<u4", blocks, at)
        at += 4 * blocks
        bits = np.frombuffer(codes, np.uint8, -(-n // 8), at)
        at += len(bits)
        out.append((ranks, bits, np.frombuffer(codes, np.uint8, n, at)))
        at += n
    return out


def decode_codes(codes: bytes) -> np.ndarray:
    """All ids of one document."""
    ids, at = np.zeros(0, np.uint32), None
    for k, (_, bits, chunks) in enumerate(_levels(codes)):
        if at is None:
            ids, at = chunks.astype(np.uint32), np.arange(len(chunks))
        else:
            ids[at] |= chunks.astype(np.uint32) << np.uint32(8 * k)
        at = at[np.unpackbits(bits, count=len(at), bitorder="little").astype(bool)]
    return ids


def token_of(codes: bytes, i: int) -> int:
    """Token i of one document, by one rank lookup per level."""
    value = 0
    for k, (ranks, bits, chunks) in enumerate(_levels(codes)):
        value |= int(chunks[i]) << (8 * k)
        if not bits[i >> 3] >> (i & 7) & 1:
            break
        block = i // BLOCK_BITS
        before = bits[block * BLOCK_BITS // 8 : i >> 3]
        i = int(ranks[block]) + int(np.bitwise_count(before).sum()) + int(bits[i >> 3] & ((1 << (i & 7)) - 1)).bit_count()
    return value


#: A single space between two other characters always begins a new pre-token of a byte-level BPE, so the units
#: between such spaces are encoded on their own.
_SPLIT = re.compile(r"(?<=\S) (?=\S)")
_BLANKS = [c for c in map(chr, range(0x3001)) if c.isspace() and c != " "]
_MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: The characters that a byte-level BPE writes for the bytes 128 to 255: those that print stand for themselves.
_PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE_CHARS = {b: chr(256 + k) for k, b in enumerate(x for x in range(256) if x not in _PRINTED)}
#: Units that are encoded as one text.
_RUN = 512


def _units(text: str) -> list[str]:
    """The text between single spaces; the first unit alone stands without a space in front."""
    odd = text[:1] == " " or text[-1:] == " " or "  " in text or any(c in text and (f"{c} " in text or f" {c}" in text) for c in _BLANKS)
    return _SPLIT.split(text) if odd else text.split(" ")


class Encoder:
    """A tokenizer that encodes each distinct unit of text once and remembers it, up to a bound.

    Only a plain byte-level BPE lets texts be cut into units; with any other tokenizer, and where a text holds
    the string of one of its added tokens, whole texts go to the library.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        told = json.loads(self.tokenizer.to_str())
        before, model = told.get("pre_tokenizer") or {}, told["model"]
        self.cuts = before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True) and model.get("type") == "BPE" and not any([model.get("dropout"), told.get("normalizer"), told.get("truncation"), told.get("padding")])
        self.added = [x["content"] for x in told.get("added_tokens") or []]
        vocabulary = self.tokenizer.get_vocab()
        self.spaced = np.zeros(max(vocabulary.values(), default=0) + 1, bool)  # ids that begin with a space
        self.spaced[[i for piece, i in vocabulary.items() if piece.startswith("\u0120")]] = True
        self.model = self.tokenizer.model
        if hasattr(self.model, "_resize_cache"):
            self.model._resize_cache(0)  # words are remembered here
        self.most = CACHED_UNITS
        self.known: dict[str, bytes] = {}  # ids of " " + letters, and of " " + other units
        self.marks: dict[str, bytes] = {}  # ids of marks without a space in front
        self.bare: dict[str, bytes] = {}  # ids of letters without a space in front
        self.newline = self._encode(["\n"])[0]

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(x.ids, "<u4").tobytes() for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _runs(self, units: list[str]) -> dict[str, bytes]:
        """The ids of units with a space in front: a run of them is one text, cut where an id begins with a space."""
        out: dict[str, bytes] = {}
        runs = [units[k : k + _RUN] for k in range(0, len(units), _RUN)]
        for run, got in zip(runs, self.tokenizer.encode_batch_fast([" " + " ".join(r) for r in runs], add_special_tokens=False), strict=True):
            ids = np.array(got.ids, "<u4")
            cuts = np.flatnonzero(self.spaced[ids]) * 4
            if len(cuts) != len(run):
                out.update(zip(run, self._encode([f" {u}" for u in run]), strict=True))
                continue
            data, starts = ids.tobytes(), cuts.tolist()
            out.update(zip(run, [data[a:z] for a, z in zip(starts, [*starts[1:], len(data)], strict=True)], strict=True))
        return out

    def _word(self, u: str, known: dict[str, bytes], space: str) -> bytes | None:
        """The ids of letters and marks behind them, which are pre-tokens of their own; None for other units.

        The model takes a pre-token as it is. known: what has been told with space (or nothing) in front.
        """
        core = u.rstrip(_MARKS)
        if not core.isalpha():
            return None
        ids = known.get(core)
        seen = ids is not None
        if not seen:
            piece = core if core.isascii() else core.encode().decode("latin-1").translate(_BYTE_CHARS)
            told = [x.id for x in self.model.tokenize(space + piece)]
            ids = struct.pack(f"<{len(told)}I", *told)
            if len(core) <= UNIT_CHARS:
                known[core] = ids
        if len(core) == len(u):
            return ids
        tail = u[len(core) :]
        if tail not in self.marks:
            if len(self.marks) > self.most // 8:
                self.marks.clear()
            self.marks[tail] = self._encode([tail])[0]
        ids += self.marks[tail]
        if seen and len(u) <= UNIT_CHARS:  # what comes again is likely to do so with its marks
            known[u] = ids
        return ids

    def _lines(self, u: str) -> bytes | None:
        """The ids of words with one newline between each two; None for other units."""
        parts = u.split("\n")
        if len(parts) < 2 or u.split() != parts:
            return None
        told = [self._word(parts[0], self.known, "\u0120"), *(self._word(x, self.bare, "") for x in parts[1:])]
        return None if None in told else self.newline.join(told)

    def _learn(self, units: set[str]) -> dict[str, bytes]:
        """The ids of units that are not known yet."""
        known, fresh, others, word = self.known, {}, [], self._word
        for u in units:
            ids = word(u, known, "\u0120")
            if ids is None and "\n" in u:
                ids = self._lines(u)
            if ids is None:
                others.append(u)
            else:
                fresh[u] = ids
        if others:
            told = self._runs(others)
            fresh.update(told)
            known.update([x for x in told.items() if len(x[0]) <= UNIT_CHARS])
        for held, most in ((known, self.most), (self.bare, self.most // 8)):
            if len(held) > most:
                for u in list(itertools.islice(held, len(held) // 2)):
                    del held[u]
        return fresh

    def __call__(self, texts: list[str], end: bytes = b"") -> list[np.ndarray]:
        """The ids of each text, with the ids that end holds behind them."""
        whole = [not self.cuts or any(a in t for a in self.added) for t in texts]
        parts = [[t] if w else _units(t) for t, w in zip(texts, whole, strict=True)]
        heads = self._encode([p.pop(0) for p in parts])
        flat = list(itertools.chain.from_iterable(parts))
        codes = list(map(self.known.get, flat))
        missing = [i for i, x in enumerate(codes) if x is None]
        if missing:
            fresh = self._learn({flat[i] for i in missing})
            for i in missing:
                codes[i] = fresh[flat[i]]
        out, at = [], 0
        for head, p in zip(heads, parts, strict=True):
            out.append(np.frombuffer(b"".join([head, *codes[at : at + len(p)], end]), "<u4"))
            at += len(p)
        return out


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """This process's encoder of a vocabulary file; it outlives a task."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def vocabulary(name: str) -> str:
    """The place of a public vocabulary file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def write_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", vocab: str = "byte_bpe_50k.json", end_id: int = 2, units: int = CACHED_UNITS) -> None:
    """Writes the table `tokens` of docs to path, in ascending order of ids. vocab: a name in the public set, or a path.

    units: units of text that a worker remembers; fewer take less memory and more time.
    """
    ordered = docs.select(docs[id_col].alias(id_col), F.coalesce(docs[text_col], F.lit("")).alias("_text"))
    ordered = ordered.repartitionByRange(F.col(id_col)).sortWithinPartitions(F.col(id_col), "_text")
    schema = T.StructType([ordered.schema[0], T.StructField("part", T.IntegerType()), T.StructField("local_start", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("codes", T.BinaryType())])

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocab if "/" in vocab else vocabulary(vocab))
        encode.most = units
        part, start = TaskContext.get().partitionId(), 0
        for whole in batches:
            for k in range(0, whole.num_rows, 256):
                b = whole.slice(k, 256)
                ids = encode(b.column(1).to_pylist(), np.uint32(end_id).tobytes())
                n = np.array([len(x) for x in ids], np.int64)
                starts = start + np.cumsum(n) - n
                start += int(n.sum())
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.full(len(n), part, np.int32)), pa.array(starts), pa.array(n), pa.array([encode_codes(x) for x in ids], pa.binary())], names=schema.names)

    tables.map_arrow(ordered, encoded, schema).write.parquet(f"{path}/tokens")
    counted = docs.sparkSession.read.schema(schema).parquet(f"{path}/tokens").groupBy("part").agg(F.sum("n_tokens").alias("n"))
    counted.coalesce(1).write.parquet(f"{path}/parts")


def _offsets(spark: SparkSession, path: str) -> DataFrame:
    """(part, n, offset): the ids of each part file and of all before it. The window runs over one row a part file."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return spark.read.schema("part int, n long").parquet(f"{path}/parts").select("part", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """The table of tokens at path with the start of each document among all ids."""
    stored = spark.read.parquet(f"{path}/tokens")
    return stored.join(tables.small(_offsets(spark, path).drop("n")), "part").withColumn("start", F.col("offset") + F.col("local_start")).drop("offset")


def read_tokens(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """id, start, n_tokens, ids (array of long) of every document, decoded from the files."""
    return _decoded(read_index(spark, path), id_col, T.StructField("ids", T.ArrayType(T.LongType())), lambda x: x.astype(np.int64).tolist())


def token_digests(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """id, start, n_tokens, ids_crc32 of every document, decoded from the files."""
    return _decoded(read_index(spark, path), id_col, T.StructField("ids_crc32", T.LongType()), lambda x: zlib.crc32(x.astype("<u4").tobytes()))


def _decoded(index: DataFrame, id_col: str, field: T.StructField, told) -> DataFrame:
    source = index.select(id_col, "start", "n_tokens", "codes")
    schema = T.StructType([*source.schema[:3], field])

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 512):
                b = whole.slice(k, 512)
                ids = [decode_codes(x.as_py()) for x in b.column(3)]
                if any(len(x) != n for x, n in zip(ids, b.column(2).to_pylist(), strict=True)):
                    raise ValueError("the codes of a document hold another number of ids than its row says")
                kind = pa.int64() if isinstance(field.dataType, T.LongType) else pa.list_(pa.int64())
                yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array([told(x) for x in ids], kind)], names=schema.names)

    return tables.map_arrow(source, decoded, schema)


def token_at(spark: SparkSession, path: str, position: int) -> int | None:
    """The id at a position among all ids: its part file by the small table, its document by a pushed filter, one code."""
    part = _offsets(spark, path).where((F.col("offset") <= position) & (F.col("offset") + F.col("n") > position)).first()
    if part is None:
        return None
    at = position - part.offset
    row = spark.read.parquet(f"{path}/tokens").where((F.col("part") == part.part) & (F.col("local_start") <= at) & (F.col("local_start") + F.col("n_tokens") > at)).select("local_start", "codes").first()
    return token_of(row.codes, at - row.local_start)
