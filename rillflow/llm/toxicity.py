"""Toxicity by class-conditional Kneser-Ney models with shared backoff counts.

Each class has a bigram model of words (runs of letters): an absolute discount, estimated for each order from
the counts of counts, is taken from every count, and the mass goes to the lower order, which holds continuation
counts (in how many distinct histories a word stands) and backs off to the counts of all documents of the corpus.

    P(v)   = (max(c(v) r(v) r(s) - D1, 0) + D1 * V * P0(v) * r(s)) / C
    P(v|u) = (max(n(uv) r(v) r(s) r(uv) - D2, 0) + D2 * T(u) * P(v)) / n(u)

n, c, T and their sums are shared by both classes. A class enters through the ratios r, for the first STEM bytes s of
a word, the word and the pair: of its documents with the expression to those that the level below leads one to
expect. Only what goes beyond Z standard errors and a margin counts as a class's own, so a rare expression has the same
probability in both classes, or that of its stem. Plain class counts in the same formulas let chance decide: a
document has few words that tell, and hundreds that differ a little.

A document's value is the difference of the length-normalised log-likelihoods: a sum, over its words, of what
stems, words and pairs add (most add nothing). A logistic curve makes it a probability; it is fit on all training
documents, scored by models that had not seen them (two folds). Their values are gathered in cells a thousandth wide, of
which rows, toxic rows and the mean enter.

The class models count all labelled rows to learn from, and P0 counts all documents, in tables that grow with the
vocabulary. Words are 64-bit hashes. What expressions add is sent to the tasks if a count proves it to be at most
SENT_ROWS rows, and joined beyond that; it is held in whole millionths, so that both ways give the same sums. Pairs are
counted in passes, and shuffles are deleted once the table that came of them is written.

Defined results: a null text is empty; an empty text has the score of the curve at zero; every row is scored on its
own, so repeated rows repeat; rows that repeat a labelled id are learnt from as one (the smallest text), and of
several labels of an id the largest counts; without training rows of both classes every score is the share of
toxic rows (0 without rows); an empty table gives an empty result; other columns, whatever their names, are not read.
A text of any length is one slice of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import tables, textbytes

#: Standard errors that a class must deviate by, for stems, words and pairs, beyond odds that differ by a factor of
#: MARGIN (languages and topics differ a little in their toxic share, however many documents there are); what damps a ratio.
Z_STEM, Z_WORD, Z_PAIR, MARGIN, PAD, STEM = 3.0, 3.0, 4.0, 3.0, 0.5, 6
#: Power of the number of words that a sum is divided by (the noise of a sum of n words grows so), and words added to it.
POWER, LENGTH_PRIOR = 0.5, 10
#: Cells of values for a factor of e, and the value below which they are even: some 10,000 for any length of text.
CELLS, CELL_FROM = 1_000, 1e-3
#: Rows up to which what expressions add is sent to the tasks; counted rows that a task holds before it passes them on.
SENT_ROWS, HELD_ROWS = 1_000_000, 1_000_000
#: Passes over the texts that pairs are counted in, each for its share of the hashes.
PAIR_PASSES = 3
_GAPS = ~textbytes.LETTER
_STEP = np.uint64(0x9E3779B97F4A7C15)
_CLASSES = ("t0", "t1", "o0", "o1")
_LIFTS = "use int, u long, v long, lift long"


def _words(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, hash, hash of the stem) of the words of each row in order, slice by slice; a row is in one slice."""
    for row, end, data, offsets in textbytes.slices(texts):
        starts, ends, first = textbytes.words(data, offsets, _GAPS)
        h = textbytes.word_hashes(data, starts, ends)
        s = textbytes.mix(textbytes.word_hashes(data, starts, np.minimum(ends, starts + STEM)) ^ _STEP)
        yield np.repeat(np.arange(row, end), np.diff(first)), h, s


def _saved(df: DataFrame, name: str) -> DataFrame:
    """df written and read back; the shuffles that made it are deleted."""
    return tables.saved_parts([df], name)


def pair_key(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """One key of a pair of 64-bit hashes; v itself where u is 0."""
    return np.where(u == 0, v, textbytes.mix(u * _STEP + v))


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct rows of keys, and the sums of their rows of counts."""
    key, count = np.concatenate(keys), np.concatenate(counts)
    order = np.lexsort(key.T)
    key = key[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]).any(1)
    return (key[new], np.add.reduceat(count[order], np.flatnonzero(new), axis=0)) if len(key) else (key, count)


def _counted(rows: DataFrame, names: tuple[str, ...], told) -> DataFrame:
    """rows (text, group) -> sums by the first columns of names; told gives (keys, counts) of a slice of words.

    The counts of a row are shuffled in one number, a count that exceeds its bits in several rows.
    """
    n_keys = sum(n in ("s", "u", "v") for n in names)
    keys_of, counts_of = names[:n_keys], names[n_keys:]
    schema = T.StructType([T.StructField(n, T.LongType()) for n in (*keys_of, "packed")])
    bits = 63 // len(counts_of)
    most, at = (1 << bits) - 1, np.arange(len(counts_of)) * bits

    def out(keys: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        counts = counts.astype(np.int64)
        while len(keys):
            part = np.minimum(counts, most)
            packed = (part << at).sum(1)
            for k in range(0, len(keys), 50_000):
                own = keys[k : k + 50_000].view(np.int64)
                yield pa.RecordBatch.from_arrays([*[pa.array(np.ascontiguousarray(c)) for c in own.T], pa.array(packed[k : k + 50_000])], names=schema.names)
            counts = counts - part
            more = counts.any(1)
            keys, counts = keys[more], counts[more]

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = (np.zeros((0, n_keys), np.uint64), np.zeros((0, len(counts_of)), np.int32))
        keys, counts, n = [none[0]], [none[1]], 0
        for b in batches:
            group = np.array([-1 if g is None else g for g in b.column(1).to_pylist()], np.int64)
            for rows, h, s in _words(b.column(0)):
                k, c = told(rows, h, s, group)
                keys.append(k)
                counts.append(c)
                n += len(k)
                if n > 2 * HELD_ROWS:
                    own, sums = _summed(keys, counts)
                    if len(own) > HELD_ROWS:
                        yield from out(own, sums)
                        own, sums = none
                    keys, counts, n = [own], [sums], len(own)
        yield from out(*_summed(keys, counts))

    each = tables.map_arrow(rows.select("text", "group"), counted, schema).repartition(*keys_of)
    count = lambda k: F.shiftright("packed", k * bits).bitwiseAND(F.lit(most))
    return each.groupBy(*keys_of).agg(*[F.sum(count(k)).alias(n) for k, n in enumerate(counts_of)])


def _distinct(rows: np.ndarray, *keys: np.ndarray) -> np.ndarray:
    """Places of the first of equal (row, keys)."""
    order = np.lexsort((*keys, rows))
    same = np.ones(max(len(order) - 1, 0), bool)
    for x in (rows, *keys):
        same &= x[order][1:] == x[order][:-1]
    return order[np.concatenate([np.ones(min(len(order), 1), bool), ~same])]


def corpus_counts(rows: DataFrame) -> DataFrame:
    """(v, every): documents that hold the word."""

    def told(rows: np.ndarray, h: np.ndarray, s: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        own = h[_distinct(rows, h)]
        return own[:, None], np.ones((len(own), 1), np.int32)

    return _counted(rows, ("v", "every"), told)


def _by_class(rows: np.ndarray, group: np.ndarray) -> np.ndarray:
    counts = np.zeros((len(rows), 4), np.int32)
    counts[np.arange(len(rows)), group[rows]] = 1
    return counts


def stem_counts(rows: DataFrame) -> DataFrame:
    """(s, t0, t1, o0, o1): documents with the stem by class and fold."""

    def told(rows: np.ndarray, h: np.ndarray, s: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = _distinct(rows, s)
        return s[at][:, None], _by_class(rows[at], group)

    return _counted(rows, ("s", *_CLASSES), told)


def word_counts(rows: DataFrame) -> DataFrame:
    """(s, v, t0, t1, o0, o1): documents with the word by class and fold."""

    def told(rows: np.ndarray, h: np.ndarray, s: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = _distinct(rows, h)
        return np.stack([s[at], h[at]], 1), _by_class(rows[at], group)

    return _counted(rows, ("s", "v", *_CLASSES), told)


def pair_counts(rows: DataFrame) -> DataFrame:
    """(u, v, t0, t1, o0, o1, n0, n1): documents with the pair by class and fold, and its occurrences by fold; written.

    Distinct pairs are most of what is shuffled. They are counted in passes, so that the disk holds the shuffle of one.
    """
    passes = np.uint64(PAIR_PASSES)

    def told_in(part: int):
        def told(rows: np.ndarray, h: np.ndarray, s: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            next_to = np.flatnonzero(rows[1:] == rows[:-1])
            next_to = next_to[(pair_key(h[next_to], h[next_to + 1]) >> np.uint64(32)) % passes == part]
            rows, u, v = rows[next_to], h[next_to], h[next_to + 1]
            counts = np.zeros((len(rows), 6), np.int32)
            counts[np.arange(len(rows)), 4 + group[rows] % 2] = 1
            first = _distinct(rows, u, v)
            counts[first, group[rows[first]]] = 1
            return np.stack([u, v], 1), counts

        return told

    parts = (_counted(rows, ("u", "v", *_CLASSES, "n0", "n1"), told_in(k)) for k in range(PAIR_PASSES))
    return tables.saved_parts(parts, "toxic-counts")


def _ratios(z: float, share: float, below_t: Column, below_o: Column) -> tuple[Column, Column]:
    """(toxic, ordinary): documents with an expression (t, o) to those expected, beyond a margin and z standard errors.

    share: the toxic share of all such counts; below: the ratios of the level below.
    """
    chance = below_t * share / (below_t * share + below_o * (1 - share))
    pool, t = F.col("t") + F.col("o"), F.col("t")
    mean, error = pool * chance, F.sqrt(pool * chance * (1 - chance) + 0.5)
    high, low = (pool * chance * k / (chance * k + 1 - chance) for k in (MARGIN, 1 / MARGIN))
    kept = mean + F.greatest(t - high - z * error, F.lit(0.0)) - F.greatest(low - t - z * error, F.lit(0.0))
    return (kept + PAD) / (mean + PAD), (pool - kept + PAD) / (pool - mean + PAD)


def _discount(n1: float | None, n2: float | None) -> float:
    """n1 / (n1 + 2 n2), from the counts of counts; at least 0.1 and at most 0.95."""
    n1, n2 = n1 or 0.0, n2 or 0.0
    return float(np.clip(n1 / max(n1 + 2 * n2, 1.0) or 0.5, 0.1, 0.95))


_FOLDS = {0: (1,), 1: (0,), 2: (0, 1)}


def _both(name: str, use: int) -> Column:
    """The sum of a count over the folds that use learns from."""
    return reduce(lambda a, b: a + b, [F.col(f"{name}{f}") for f in _FOLDS[use]]).cast("double")


def _times(x: Column, k: int) -> Column:
    return F.sum((x == k).cast("double"))


def pair_sums(pairs: DataFrame) -> tuple[DataFrame, DataFrame, Row]:
    """Of each use k, in one pass each: (v, ck) the words before v; (u, nuk, kindsk) what follows u; the sums of all pairs."""
    has = {k: (_both("n", k) > 0).cast("double") for k in _FOLDS}
    next_to = pairs.groupBy("v").agg(*[F.sum(has[k]).alias(f"c{k}") for k in _FOLDS])
    after = pairs.groupBy("u").agg(*[x for k in _FOLDS for x in (F.sum(_both("n", k)).alias(f"nu{k}"), F.sum(has[k]).alias(f"kinds{k}"))])
    sums = [x for k in _FOLDS for x in (*[F.sum(_both(c, k) * has[k]).alias(f"{c}{k}") for c in "to"], *[_times(_both("n", k), i).alias(f"once{k}" if i == 1 else f"twice{k}") for i in (1, 2)])]
    return _saved(next_to, "toxic-continuations"), _saved(after, "toxic-after"), pairs.agg(*sums).first()


def additions(corpus: DataFrame, stems: DataFrame, words: DataFrame, pairs: DataFrame, use: int, summed: tuple[DataFrame, DataFrame, Row] | None = None) -> DataFrame:
    """(use, u, v, lift) in whole millionths: what an expression adds to log P(toxic) - log P(ordinary).

    u is 0 for stems and words. use: 0 and 1 learn from the other fold alone, 2 from both. summed: pair_sums of the pairs.
    Expressions that do not deviate have ratios of exactly 1 and add nothing, so only the others are joined.
    """
    both = lambda name: _both(name, use).alias(name)
    sh, w = stems.select("s", both("t"), both("o")), words.select("s", "v", both("t"), both("o"))
    p = pairs.select("u", "v", both("t"), both("o"), both("n")).where("n > 0")
    of = lambda t, o: (t or 0.0) / max((t or 0.0) + (o or 0.0), 1.0)
    share = lambda df: of(*df.agg(F.sum("t"), F.sum("o")).first())
    of_stem, of_word = share(sh), share(w)
    if not 0 < of_stem < 1:
        return corpus.sparkSession.createDataFrame([], _LIFTS)
    next_to, after, sums = summed or pair_sums(pairs)
    next_to = next_to.select("v", F.col(f"c{use}").alias("c")).where("c > 0")
    after = after.select("u", F.col(f"nu{use}").alias("nu"), F.col(f"kinds{use}").alias("kinds"))
    of_pair, d2 = of(sums[f"t{use}"], sums[f"o{use}"]), _discount(sums[f"once{use}"], sums[f"twice{use}"])
    every = corpus.agg(F.sum("every").alias("n"), F.count(F.lit(1)).alias("kinds")).first()
    total = next_to.agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("kinds"), _times(F.col("c"), 1).alias("once"), _times(F.col("c"), 2).alias("twice")).first()
    d1 = _discount(total.once, total.twice)
    millionths = lambda x: F.round(x * 1e6).cast("long").alias("lift")
    zero = F.lit(0).cast("long").alias("u")
    one = lambda *names: [F.coalesce(n, F.lit(1.0)).alias(n) for n in names]

    st, so = _ratios(Z_STEM, of_stem, F.lit(1.0), F.lit(1.0))
    sh = _saved(sh.where("t + o > 0").select("s", st.alias("st"), so.alias("so")).where("st <> 1 or so <> 1"), "toxic-stems")
    of_stems = sh.select(F.lit(use).alias("use"), zero, F.col("s").alias("v"), millionths(F.log(F.col("st") / F.col("so"))))

    wt, wo = _ratios(Z_WORD, of_word, F.col("st"), F.col("so"))
    w = w.where("t + o > 0").join(tables.small(sh, SENT_ROWS), "s", "left").select("v", "t", "o", *one("st", "so"))
    odd = w.select("v", "st", "so", (wt * F.col("st")).alias("rt"), (wo * F.col("so")).alias("ro")).where("st <> 1 or so <> 1 or rt <> 1 or ro <> 1")
    odd = _saved(odd, "toxic-words")

    # of the pairs, only those matter whose word or whose own documents deviate
    marked = odd.where("rt <> 1 or ro <> 1").select("v", "rt", "ro")
    r = p.join(tables.small(marked, SENT_ROWS), "v", "left").select("u", "v", "t", "o", "n", *one("rt", "ro"))
    bt, bo = _ratios(Z_PAIR, of_pair, F.col("rt"), F.col("ro"))
    r = r.select("*", bt.alias("bt"), bo.alias("bo")).where("rt <> 1 or ro <> 1 or abs(bt - 1) > 1e-9")
    r = _saved(r, "toxic-pairs")

    ratios = ("st", "so", "rt", "ro")
    known = _saved(r.select("v").distinct().join(odd, "v", "full").select("v", *one(*ratios)), "toxic-known")
    held = tables.small(known.select("v"), SENT_ROWS)
    known = known.join(next_to.join(held, "v", "left_semi"), "v", "left").join(corpus.join(held, "v", "left_semi"), "v", "left")
    p0 = (F.coalesce("every", F.lit(0)) + 1) / float((every.n or 0) + (every.kinds or 0) + 1)
    lower = lambda r, s: (F.greatest(F.coalesce("c", F.lit(0.0)) * F.col(r) - d1, F.lit(0.0)) + d1 * float(total.kinds or 1) * p0 * F.col(s)) / float(total.c or 1)
    known = known.select("v", "st", "so", lower("rt", "st").alias("pt"), lower("ro", "so").alias("po"))
    known = _saved(known.withColumn("own", F.log(F.col("pt") / F.col("po"))), "toxic-words")
    of_words = known.select(F.lit(use).alias("use"), zero, "v", millionths(F.col("own") - F.log(F.col("st") / F.col("so"))))

    heads = tables.small(r.select("u").distinct(), SENT_ROWS)
    r = r.join(after.join(heads, "u", "left_semi"), "u").join(known.select("v", "pt", "po", "own"), "v")
    higher = lambda a, b, low: (F.greatest(F.col("n") * F.col(a) * F.col(b) - d2, F.lit(0.0)) + d2 * F.col("kinds") * F.col(low)) / F.col("nu")
    more = F.log(higher("rt", "bt", "pt") / higher("ro", "bo", "po")) - F.col("own")
    of_pairs = r.select(F.lit(use).alias("use"), "u", "v", millionths(more))
    return _saved(of_stems.unionByName(of_words).unionByName(of_pairs).where("lift <> 0"), "toxic-additions")


def _values(rows: DataFrame, lifts: DataFrame, keep: list[str]) -> DataFrame:
    """rows (text, use, keep...) -> keep..., value: the length-normalised difference under the additions of use."""
    source = rows.select("text", "use", *keep)
    if lifts.limit(SENT_ROWS + 1).count() > SENT_ROWS:
        return _joined_values(source, lifts, keep)
    got = lifts.toArrow()
    use, u, v, lift = (got[n].to_numpy() for n in ("use", "u", "v", "lift"))
    keys, of_use = pair_key(u.view(np.uint64), v.view(np.uint64)), {}
    for k in np.unique(use):
        own = np.flatnonzero(use == k)
        own = own[np.argsort(keys[own])]
        of_use[int(k)] = keys[own], lift[own]
    held = rows.sparkSession.sparkContext.broadcast(of_use)
    schema = T.StructType([*source.schema[2:], T.StructField("value", T.DoubleType())])

    def valued(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near = {}  # by the upper 20 bits: whether a key can be known
        for k, (known, _) in held.value.items():
            near[k] = np.zeros(1 << 20, bool)
            near[k][(known >> np.uint64(44)).astype(np.int64)] = True
        for b in batches:
            use = np.array(b.column(1).to_pylist(), np.int64)
            total, n = np.zeros(b.num_rows), np.zeros(b.num_rows)
            for at, words, stems in _words(b.column(0)):
                n += np.bincount(at, minlength=b.num_rows)
                next_to = np.flatnonzero(at[1:] == at[:-1])
                at, key = np.concatenate([at, at, at[next_to]]), np.concatenate([words, stems, pair_key(words[next_to], words[next_to + 1])])
                for k, (known, lift) in held.value.items():
                    some = np.flatnonzero(near[k][(key >> np.uint64(44)).astype(np.int64)] & (use[at] == k))
                    place = np.minimum(np.searchsorted(known, key[some]), len(known) - 1)
                    hit = known[place] == key[some]
                    total += np.bincount(at[some[hit]], lift[place[hit]], b.num_rows)
            yield pa.RecordBatch.from_arrays([*b.columns[2:], pa.array(total / 1e6 / (n + LENGTH_PRIOR) ** POWER)], names=schema.names)

    return tables.map_arrow(source, valued, schema)


def _joined_values(source: DataFrame, lifts: DataFrame, keep: list[str]) -> DataFrame:
    """_values by joins alone: a value hangs on the text only, so texts are named by two hashes and told once."""
    text = F.coalesce(F.col("text"), F.lit(""))
    named = source.withColumns({"k1": F.xxhash64(text), "k2": F.xxhash64(F.lit(1), text)})
    schema = T.StructType([T.StructField(n, T.LongType()) for n in ("k1", "k2", "use", "u", "v", "times", "n")])

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k1, k2, use = (b.column(i).to_numpy() for i in (1, 2, 3))
            for at, words, stems in _words(b.column(0)):
                n = np.bincount(at, minlength=b.num_rows)
                next_to = np.flatnonzero(at[1:] == at[:-1])
                u = np.concatenate([np.zeros(2 * len(at), np.uint64), words[next_to]])
                v, at = np.concatenate([words, stems, words[next_to + 1]]), np.concatenate([at, at, at[next_to]])
                order = np.lexsort((v, u, at))
                at, u, v = at[order], u[order], v[order]
                new = np.ones(len(at), bool)
                new[1:] = (at[1:] != at[:-1]) | (u[1:] != u[:-1]) | (v[1:] != v[:-1])
                first = np.flatnonzero(new)
                times = np.diff(np.append(first, len(at)))
                at, u, v = at[first], u[first].view(np.int64), v[first].view(np.int64)
                for k in range(0, len(at), 50_000):
                    own = slice(k, k + 50_000)
                    cols = (k1[at[own]], k2[at[own]], use[at[own]].astype(np.int64), u[own], v[own], times[own], n[at[own]])
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=schema.names)

    texts = named.groupBy("k1", "k2", "use").agg(F.first("text").alias("text"))
    words = tables.map_arrow(texts.select("text", "k1", "k2", F.col("use").cast("long").alias("use")), told, schema)
    sums = words.join(lifts, ["use", "u", "v"], "left").groupBy("k1", "k2", "use").agg(F.sum(F.col("lift") * F.col("times")).alias("total"), F.first("n").alias("n"))
    value = F.coalesce(F.col("total"), F.lit(0)) / 1e6 / F.pow(F.coalesce(F.col("n"), F.lit(0)) + F.lit(LENGTH_PRIOR), F.lit(POWER))
    return named.join(sums, ["k1", "k2", "use"], "left").select(*keep, value.alias("value"))


def fit_curve(x: np.ndarray, y: np.ndarray, n: np.ndarray | float = 1.0) -> tuple[float, float]:
    """Slope and intercept of a logistic curve, by Newton steps with a small ridge. y of n rows at x are toxic."""
    scale = max(float(np.abs(x).max(initial=0)), 1e-9)
    a = np.stack([x / scale, np.ones(len(x))], 1)
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a.T * (n * p * (1 - p))) @ a + 1e-3 * np.eye(2), a.T @ (y - n * p) - 1e-3 * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return max(float(w[0] / scale), 0.0), float(w[1])


def _cells(values: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The mean value, toxic rows and rows of each cell of values (label, value); sums are whole, so reruns agree."""
    cell = F.round(F.signum("value") * F.asinh(F.abs("value") / CELL_FROM) * CELLS).cast("long")
    sums = [F.sum(F.round(F.col("value") * 1e9).cast("decimal(28,0)")).cast("double").alias("x"), F.sum("label").alias("y"), F.count(F.lit(1)).alias("n")]
    got = values.groupBy(cell.alias("cell")).agg(*sums).orderBy("cell").toPandas()
    n = got["n"].to_numpy(float)
    return got["x"].to_numpy(float) / 1e9 / np.maximum(n, 1), got["y"].to_numpy(float), n


def _training(named: DataFrame, told: DataFrame) -> DataFrame:
    """(_id, text, label, fold) of the rows of told (_of, label, fold) that have a text; of rows of one id the smallest text.

    Where told is small enough to be sent and no id repeats, texts are neither shuffled nor written.
    """
    sent = told.limit(tables.BROADCAST_ROWS + 1).count() <= tables.BROADCAST_ROWS
    own = F.broadcast(told) if sent else told
    seen = named.join(own, F.col("_id") == F.col("_of")).select("_id", "text", "label", "fold")
    ids = named.select("_id").join(own, F.col("_id") == F.col("_of"), "left_semi")
    again = _saved(ids.groupBy("_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("_id"), "toxic-repeated")
    if not again.limit(1).count():
        return seen if sent else _saved(seen, "toxic-training")
    again = tables.small(again)
    least = seen.join(again, "_id", "left_semi").groupBy("_id").agg(F.min(F.struct("text", "label", "fold")).alias("x")).select("_id", "x.*")
    return _saved(seen.join(again, "_id", "left_anti").unionByName(least), "toxic-training")


def score_toxicity(docs: DataFrame, labels: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """id, score (double, 0 to 1) for every row of docs. train: a condition on id_col for rows to learn from."""
    told = labels.where(train & F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_of")).agg(F.max(label_col).cast("int").alias("label"))
    told = _saved(told.withColumn("fold", F.pmod(F.xxhash64("_of"), F.lit(2)).cast("int")), "toxic-labels")
    named = docs.select(docs[id_col].alias("_id"), docs[text_col].alias("text"))
    seen = _training(docs.where(train).select(docs[id_col].alias("_id"), docs[text_col].alias("text")), told)
    group = (1 - F.col("label")) * 2 + F.col("fold")  # t0, t1, o0, o1
    share = seen.agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("t")).first()
    model = share.n and 0 < (share.t or 0) < share.n
    slope, cut = 0.0, 0.0
    if model:
        corpus = _saved(corpus_counts(named.withColumn("group", F.lit(None).cast("int"))), "toxic-corpus")
        marked = seen.select("text", group.alias("group"))
        counts = [corpus, *[_saved(f(marked), "toxic-counts") for f in (stem_counts, word_counts)], pair_counts(marked)]
        summed = pair_sums(counts[-1])
        unseen = reduce(DataFrame.unionByName, [additions(*counts, f, summed) for f in (0, 1)])
        slope, cut = fit_curve(*_cells(_values(seen.withColumn("use", F.col("fold")), unseen, ["label"])))
        lifts = additions(*counts, 2, summed)
    else:
        p = (share.t or 0) / share.n if share.n else 0.0
        cut = float(np.log(max(p, 1e-6) / max(1 - p, 1e-6)))
        lifts = docs.sparkSession.createDataFrame([], _LIFTS)
    every_row = _values(named.withColumn("use", F.lit(2)), lifts, ["_id"])
    return every_row.select(F.col("_id").alias(id_col), (1 / (1 + F.exp(-(F.col("value") * slope + cut)))).alias("score"))
