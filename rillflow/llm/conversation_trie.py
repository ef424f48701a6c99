"""The prefix trie of rebuilt conversations, from composable fingerprints.

A rebuilt conversation is the head of a base conversation followed by the conversation's own later turns. A sequence of
turns has a fingerprint, the sum of x_i * r^i modulo a prime in four lanes, where x_i hashes a turn's role and text. With its length it is
an element of a monoid: F(AB) = F(A) + r^|A| * F(B). So the fingerprint of every prefix of a rebuilt conversation is put
together from the prefixes of the two stored conversations; no rebuilt text is ever made.

Each turn keeps the key of its role and text, checked to stand for one text. A node is the group of equal (depth, fingerprint);
it is verified by the turns that its members refer to: all must have the same last turn, and the same parent, which by
induction makes the sequences equal. If any check fails, all is done again with another seed.

Sums over subtrees: a node is owned by its smallest member, so the nodes of an owner are a chain, and the chains are a tree.
Totals of chains are summed by doubling pointers (rounds grow with the logarithm of that tree's height), sums along a
chain by windows over BLOCK depths. Places within conversations are counted over range partitions in order, so a
conversation with many turns is cut over many tasks; what crosses a border (at most two rows a partition) is broadcast.
The digest of the conversations that end at a node is inherently sequential: their ids are first joined into texts of CHUNK ids
in parallel, then hashed in order as a stream, without holding them.

Defined results: null role or text is empty; turns are ordered by turn (null first), ties by role and text (beyond their first
64 characters by hash); repeated rows are turns of their own; rows with a null conversation id belong to none; texts of any
length are hashed whole; an empty table has no node; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import tables

PRIME, LANES = (1 << 31) - 1, 4
#: Depths of a window along a chain; ids of a text that is hashed in one go; turns of a base at most.
BLOCK, CHUNK, HEAD = 1_024, 1_000, 8
NODE = ["depth", "fa", "fb"]


def multipliers(seed: int) -> list[int]:
    """The base r of each lane."""
    return [int.from_bytes(hashlib.sha256(f"{seed}:{k}".encode()).digest()[:8]) % (PRIME - 3) + 2 for k in range(LANES)]


def head_turns(conv_id: Column) -> Column:
    """How many turns of the base a conversation takes."""
    return (F.crc32(conv_id.cast("string").cast("binary")) % (HEAD + 1)).cast("int")


def _lanes(a: Column, b: Column) -> list[Column]:
    return [x for c in (a, b) for x in (F.shiftright(c, 31), c.bitwiseAND((1 << 31) - 1))]


def _packed(lanes: list[Column]) -> tuple[Column, Column]:
    return tuple(F.shiftleft(lanes[k], 31).bitwiseOR(lanes[k + 1]) for k in (0, 2))


def _power(r: int, n: Column) -> Column:
    """r^n modulo the prime, by the bits of n."""
    squares = F.array(*[F.lit(pow(r, 1 << k, PRIME)).cast("long") for k in range(40)])
    bits = F.filter(F.sequence(F.lit(0), F.lit(39)), lambda k: F.call_function("shiftright", n, k).bitwiseAND(1) == 1)
    return F.aggregate(bits, F.lit(1).cast("long"), lambda acc, k: acc * F.get(squares, k) % PRIME)


def _powers(r: int, n: np.ndarray) -> np.ndarray:
    out, base, n = np.ones(len(n), np.int64), r, n.copy()
    while n.any():
        out = np.where(n & 1, out * base % PRIME, out)
        base, n = base * base % PRIME, n >> 1
    return out


def _prefixes(seed: int):
    """Batches of sorted turns to their places and prefix fingerprints within this partition's share of a conversation."""
    bases = multipliers(seed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        last, at, sums = None, 0, np.zeros(LANES, np.int64)
        for batch in batches:
            conv, k1, k2 = (batch.column(c).to_numpy() for c in ("conv_id", "k1", "k2"))
            n = len(conv)
            if not n:
                continue
            new = np.r_[last is None or conv[0] != last, conv[1:] != conv[:-1]]
            first = np.maximum.accumulate(np.where(new, np.arange(n), 0))
            carried = np.cumsum(new) == 0  # goes on with the conversation of the batch before
            place = np.arange(n) - first + np.where(carried, at, 0)
            through, before = [], []
            for lane, r in enumerate(bases):
                x = (((k1, k2)[lane // 2] >> (31 * (lane % 2))) & PRIME) % PRIME + 1
                term = x * _powers(r, place) % PRIME
                total = np.cumsum(term)
                start = (total - term)[first]
                through.append((total - start + np.where(carried, sums[lane], 0)) % PRIME)
                before.append((through[-1] - term) % PRIME)
            last, at, sums = conv[-1], place[-1] + 1, np.array([t[-1] for t in through])
            packed = [x[k] << 31 | x[k + 1] for x in (through, before) for k in (0, 2)]
            yield pa.RecordBatch.from_arrays([*map(pa.array, (conv, np.full(n, part, np.int64), place.astype(np.int64), *packed, k1, k2)), batch.column("size")], ["conv_id", "part", "place", "fa", "fb", "ga", "gb", "k1", "k2", "size"])

    return run


def _keyed(turns: DataFrame, seed: int) -> DataFrame:
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    keys = F.xxhash64(F.lit(seed), role, text).alias("k1"), F.xxhash64(text, F.lit(seed + 1), role).alias("k2")
    return turns.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), text.alias("text"), *keys).where("conv_id is not null")


def prefix_table(turns: DataFrame, seed: int = 0) -> DataFrame:
    """(conv_id, at, fa, fb, ga, gb, k1, k2, size) of every turn.

    at: its place in its conversation; f and g: the fingerprints of the prefix with and without it; k: the key of its role
    and text; size: bytes of its text.
    """
    head = [F.substring(c, 1, 64).alias(f"{c}_head") for c in ("role", "text")]
    rest = F.xxhash64("role", "text").alias("rest")
    rows = _keyed(turns, seed).select("conv_id", "turn", *head, rest, F.monotonically_increasing_id().alias("row"), "k1", "k2", F.octet_length("text").cast("long").alias("size"))
    order = [F.asc("conv_id"), F.asc_nulls_first("turn"), F.asc("role_head"), F.asc("text_head"), F.asc("rest"), F.asc("row")]
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "k1", "k2", "size")
    told = tables.saved(tables.map_arrow(ranged, _prefixes(seed), "conv_id long, part long, place long, fa long, fb long, ga long, gb long, k1 long, k2 long, size long"), "places")
    # conversations that lie in several partitions: at most two rows a partition
    ends = told.groupBy("conv_id", "part").agg(F.max("place").alias("place"))
    cut = ends.groupBy("conv_id").agg(F.count(F.lit(1)).alias("parts")).where("parts > 1").select("conv_id")
    shares = told.join(ends.join(F.broadcast(tables.saved(cut, "cut")), "conv_id"), ["conv_id", "part", "place"]).select("conv_id", "part", (F.col("place") + 1).alias("n"), "fa", "fb")
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    placed = shares.withColumn("from", F.coalesce(F.sum("n").over(before), F.lit(0)))
    moved = [x * _power(r, F.col("from")) % PRIME for r, x in zip(multipliers(seed), _lanes(F.col("fa"), F.col("fb")), strict=True)]
    sums = [F.coalesce(F.sum(m).over(before) % PRIME, F.lit(0)).alias(f"sum{k}") for k, m in enumerate(moved)]
    powers = [_power(r, F.col("from")).alias(f"power{k}") for k, r in enumerate(multipliers(seed))]
    borders = tables.saved(placed.select("conv_id", "part", "from", *sums, *powers), "borders")
    joined = told.join(F.broadcast(borders), ["conv_id", "part"], "left")

    def whole(a: str, b: str) -> list[Column]:
        lanes = [(F.col(f"sum{k}") + F.col(f"power{k}") * x % PRIME) % PRIME for k, x in enumerate(_lanes(F.col(a), F.col(b)))]
        return [F.when(F.col("from").isNull(), F.col(c)).otherwise(p).alias(c) for c, p in zip((a, b), _packed(lanes), strict=True)]

    return joined.select("conv_id", (F.col("place") + F.coalesce("from", F.lit(0))).alias("at"), *whole("fa", "fb"), *whole("ga", "gb"), "k1", "k2", "size")


def keys_are_pure(turns: DataFrame, seed: int) -> bool:
    """Whether every key stands for one role and text: the least and the greatest of its texts are the same."""
    texts = _keyed(turns, seed).groupBy("k1", "k2").agg(*[f(c).alias(f"{f.__name__}_{c}") for f in (F.min, F.max) for c in ("role", "text")])
    return not texts.where("min_role <> max_role or min_text <> max_text").limit(1).count()


def rebuilt_paths(turns: DataFrame, seed: int = 0) -> DataFrame:
    """(conv_id, depth, fa, fb, ga, gb, k1, k2, size, ends): a row for each prefix of each rebuilt conversation.

    turns is a written prefix_table. f and g are the fingerprints of the prefix and of its parent.
    """
    fields = ["at", "fa", "fb", "ga", "gb", "k1", "k2", "size"]
    first = F.sort_array(F.collect_list(F.when(F.col("at") < HEAD, F.struct(*fields))))
    convs = tables.saved(turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), first.alias("head")), "conversations")
    base = convs.select(F.col("conv_id").alias("base"), F.col("head").alias("base_head"))
    h = head_turns(F.col("conv_id"))
    joined = convs.withColumns({"base": F.col("conv_id") - F.col("conv_id") % 5, "h": h}).join(base, "base", "left")
    taken = F.coalesce(F.slice("base_head", F.lit(1), F.col("h")), F.array().cast(convs.schema["head"].dataType))
    told = joined.select("conv_id", "n", "head", "h", taken.alias("taken")).withColumn("m", F.size("taken"))
    end = lambda array, n, c: F.coalesce(F.get(array, n - 1)[c], F.lit(0).cast("long"))
    skipped = F.least(F.col("h"), F.col("n")).cast("int")
    parts = [end("taken", F.col("m"), c).alias(f"base_{c}") for c in ("fa", "fb")] + [end("head", skipped, c).alias(f"skipped_{c}") for c in ("fa", "fb")]
    length = F.col("m") + F.greatest(F.col("n") - F.col("h"), F.lit(0))
    known = tables.saved(told.select("conv_id", "n", "h", "m", "taken", length.alias("length"), *parts), "rebuilt")

    def composed(a: str, b: str) -> list[Column]:
        """The base's head followed by the own turns behind the skipped ones."""
        lanes = []
        both = zip(multipliers(seed), _lanes(F.col("base_fa"), F.col("base_fb")), _lanes(F.col("skipped_fa"), F.col("skipped_fb")), _lanes(F.col(a), F.col(b)), strict=True)
        for r, front, off, x in both:
            back = F.array(*[F.lit(pow(r, -k, PRIME)).cast("long") for k in range(HEAD + 1)])
            lanes.append((front + F.get(back, F.col("h") - F.col("m")) * ((x - off + PRIME) % PRIME)) % PRIME)
        return [p.alias(c) for c, p in zip((a, b), _packed(lanes), strict=True)]

    ends = (F.col("depth") == F.col("length")).alias("ends")
    columns = ["conv_id", "depth", "fa", "fb", "ga", "gb", "k1", "k2", "size", ends]
    of_base = known.select("conv_id", "length", F.inline("taken")).withColumn("depth", F.col("at") + 1).select(*columns)
    own = tables.join_hot(turns, known.drop("taken"), ["conv_id"], ["at"], "n").where("at >= h")
    own = own.select("conv_id", "length", (F.col("at") - F.col("h") + F.col("m") + 1).alias("depth"), *composed("fa", "fb"), *composed("ga", "gb"), "k1", "k2", "size").select(*columns)
    zero = F.lit(0).cast("long")
    root = known.select("conv_id", "length", *[zero.alias(c) for c in ("depth", "fa", "fb", "ga", "gb", "k1", "k2", "size")]).select(*columns)
    return of_base.unionByName(own).unionByName(root)


def _nodes(paths: DataFrame) -> DataFrame:
    """The groups of equal prefixes, with what their members refer to."""
    referred = ["ga", "gb", "k1", "k2"]
    low, high = [F.min(c).alias(c) for c in [*referred, "size"]], [F.max(c).alias(f"max_{c}") for c in referred]
    found = paths.groupBy(*NODE).agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), *low, *high)
    same = F.lit(True)
    for c in referred:
        same &= F.col(c) == F.col(f"max_{c}")
    return found.select(*NODE, "conv_id", "n_convs", "size", "ga", "gb", same.alias("same"))


def verified(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The written paths and nodes of the first seed under which all groups hold."""
    for seed in count():
        paths = tables.saved(rebuilt_paths(tables.saved(prefix_table(turns, seed), "turns"), seed), "paths")
        nodes = tables.saved(_nodes(paths), "nodes")
        if keys_are_pure(turns, seed) and not nodes.where("not same").limit(1).count():
            return paths, nodes
    raise AssertionError


def _subtree_totals(chains: DataFrame) -> DataFrame:
    """(id, leaves, saved) summed over the subtree of each chain, from (id, parent, leaves, saved)."""
    now = tables.saved(chains.select("id", F.col("parent").alias("ahead"), "leaves", "saved"), "chains")
    while now.where("ahead is not null").limit(1).count():
        given = now.where("ahead is not null").groupBy("ahead").agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"), F.count(F.lit(1)).alias("n"))
        given = given.withColumnRenamed("ahead", "id")
        zero = F.lit(0).cast("long")
        mid = now.join(given, "id", "left").select("id", "ahead", *[(F.col(c) + F.coalesce(f"more_{c}", zero)).alias(c) for c in ("leaves", "saved")], F.coalesce("n", zero).alias("n"))
        mid = tables.saved(mid, "chains")
        hops = tables.join_hot(now.where("ahead is not null").select("id", "ahead"), mid.where("n > 0").select(F.col("id").alias("ahead"), F.col("ahead").alias("beyond"), "n"), ["ahead"], ["id"], "n")
        now = tables.saved(mid.drop("ahead", "n").join(hops.select("id", F.col("beyond").alias("ahead")), "id", "left"), "chains")
    return now.drop("ahead")


def _chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (node, conv_id) to texts of at most CHUNK joined ids of one node."""
    for batch in batches:
        keys = [batch.column(c).to_numpy() for c in (*NODE, "conv_id")]
        n = len(keys[0])
        if not n:
            continue
        new = np.r_[True, np.any([k[1:] != k[:-1] for k in keys[:-1]], axis=0)]
        first = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        starts = np.flatnonzero(new | ((np.arange(n) - first) % CHUNK == 0))
        texts = [",".join(map(str, ids.tolist())) for ids in np.split(keys[-1], starts[1:])]
        yield pa.RecordBatch.from_arrays([*[pa.array(k[starts]) for k in keys], pa.array(texts, pa.string())], [*NODE, "conv_id", "ids"])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts in order of (node, first id) to one digest a node; holds one digest and a batch."""
    node, digest = None, None

    def row(done: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*[pa.array([d[0][k] for d in done], pa.int64()) for k in range(3)], pa.array([d[1] for d in done], pa.string())], [*NODE, "ends_sha256"])

    for batch in batches:
        done = []
        for *key, ids in zip(*[batch.column(c).to_pylist() for c in (*NODE, "ids")], strict=True):
            if key == node:
                digest.update(b",")
            else:
                if node is not None:
                    done.append((node, digest.hexdigest()))
                node, digest = key, hashlib.sha256()
            digest.update(ids.encode())
        yield row(done)
    if node is not None:
        yield row([(node, digest.hexdigest())])


def end_digests(paths: DataFrame) -> DataFrame:
    """(depth, fa, fb, ends_sha256) of the nodes at which conversations end."""
    ends = paths.where("ends").select(*NODE, "conv_id")
    sorted_ends = ends.repartitionByRange(*NODE, "conv_id").sortWithinPartitions(*NODE, "conv_id")
    node = ", ".join(f"{c} long" for c in NODE)
    texts = tables.map_arrow(sorted_ends, _chunked, f"{node}, conv_id long, ids string")
    return tables.map_arrow(texts.repartition(*NODE).sortWithinPartitions(*NODE, "conv_id").select(*NODE, "ids"), _hashed, f"{node}, ends_sha256 string")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of every node."""
    paths, found = verified(conversations)
    children = found.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("ga").alias("fa"), F.col("gb").alias("fb")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = tables.saved(found.join(children, NODE, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long"))), "nodes")
    parents = nodes.where("n_children > 0").select((F.col("depth") + 1).alias("depth"), F.col("fa").alias("ga"), F.col("fb").alias("gb"), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("n"))
    below = tables.join_hot(nodes.where("depth > 0"), parents, ["depth", "ga", "gb"], ["fa", "fb"], "n").drop("n")
    leaf, save = (F.col("n_children") == 0).cast("long").alias("leaves"), ((F.col("n_convs") - 1) * F.col("size")).alias("saved")
    root = nodes.where("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("long"))
    told = below.unionByName(root).select(*NODE, "conv_id", "parent_conv_id", "n_convs", "n_children", leaf, save)
    told = tables.saved(told, "told")
    # the top of a chain hangs on a node of another owner
    top = F.col("parent_conv_id") != F.col("conv_id")
    chains = told.groupBy(F.col("conv_id").alias("id")).agg(F.max(F.when(top, F.col("parent_conv_id"))).alias("parent"), F.max(F.when(top, F.col("depth") - 1)).alias("depth"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    chains = tables.saved(chains, "chains")
    hung = chains.select("id", "parent", "depth").where("parent is not null").join(_subtree_totals(chains), "id")
    hung = hung.groupBy(F.col("parent").alias("conv_id"), "depth").agg(*[F.sum(c).alias(f"hung_{c}") for c in ("leaves", "saved")])
    zero, sums = F.lit(0).cast("long"), ["leaves", "saved"]
    own = told.join(hung, ["conv_id", "depth"], "left").select(*NODE, "conv_id", "parent_conv_id", "n_convs", "n_children", F.floor(F.col("depth") / BLOCK).alias("block"), *[(F.col(c) + F.coalesce(f"hung_{c}", zero)).alias(c) for c in sums])
    own = tables.saved(own, "chained")
    blocks = own.groupBy("conv_id", "block").agg(*[F.sum(c).alias(f"block_{c}") for c in sums])
    deeper = Window.partitionBy("conv_id").orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    behind = blocks.select("conv_id", "block", *[F.sum(f"block_{c}").over(deeper).alias(f"behind_{c}") for c in sums]).where("behind_leaves is not null")
    down = Window.partitionBy("conv_id", "block").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    summed = own.join(behind, ["conv_id", "block"], "left").select(*NODE, "conv_id", "parent_conv_id", "n_convs", "n_children", *[(F.sum(c).over(down) + F.coalesce(f"behind_{c}", zero)).alias(c) for c in sums])
    digests = end_digests(paths)
    none = F.lit(hashlib.sha256(b"").hexdigest())
    return summed.join(digests, NODE, "left").select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", none).alias("ends_sha256"))
