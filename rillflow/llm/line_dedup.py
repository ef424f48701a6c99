"""Line dedup over overlapping three-line windows (native).

Windows of consecutive lines are hashed, windows that stand at more than one place are found globally,
and every later occurrence is removed: the positions that its windows cover are merged and those lines go.
With a number of words as passage, every shorter run of lines that holds so many words is a window as well, so
that a long passage on one or two lines is found between different neighbours.

Windows are grouped by hash with partial sums; the places of a hot window are dealt to several tasks. The places to
remove are sent to the documents if a count proves them few, and joined by id and hash of the text beyond.

Defined results: lines are what newlines separate, compared after trimming; blank lines are in no window
and stay; a document with fewer lines than a window has all of them as one window; null is the empty
text and empty texts have no window. Order is by id (null first), then by a hash of the text, then by
position, so rows that repeat a document entirely are one document and share its fate. Every removed line
still stands at an earlier place, since the first occurrence of a window is never a later one. A document of any
length is cut as a whole; an empty table gives an empty result; other columns, whatever their names, are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import tables

#: Places up to which those to remove are sent to all documents.
SENT_PLACES = 1_000_000
_WORD = r"[^\x20\x09-\x0D]+"


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _filled(lines: Column, words: bool = False) -> Column:
    """The trimmed non-blank lines with their positions, and with their numbers of words if asked for."""
    told = F.filter(F.transform(lines, lambda x, i: F.struct(i.alias("at"), F.trim(x).alias("line"))), lambda x: x["line"] != "")
    if not words:
        return told
    return F.transform(told, lambda x: F.struct(x["at"].alias("at"), x["line"].alias("line"), F.regexp_count(x["line"], F.lit(_WORD)).alias("words")))


def _windows(filled: Column, size: int, passage: int | None = None) -> Column:
    """(j, k, h1, h2) of each window: its first place among the non-blank lines, and its lines."""
    last = F.greatest(F.size(filled) - size, F.lit(0))
    starts = F.when(F.size(filled) > 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))

    def window(j: Column, n: int) -> Column:
        each = [F.get(filled, j + k)["line"] for k in range(n)]
        return F.struct(j.alias("j"), F.lit(n).alias("k"), F.xxhash64(*each).alias("h1"), F.xxhash64(F.lit(size), *each[::-1]).alias("h2"))

    def run(n: int) -> Column:
        words = lambda j: reduce(lambda a, b: a + b, [F.get(filled, j + k)["words"] for k in range(n)])
        own = F.when(F.size(filled) >= n, F.sequence(F.lit(0), F.size(filled) - n)).otherwise(F.array().cast("array<int>"))
        return F.transform(F.filter(own, lambda j: words(j) >= passage), lambda j: window(j, n))

    whole = F.transform(starts, lambda j: window(j, size))
    return F.concat(whole, *[run(n) for n in range(1, size)]) if passage else whole


def _flags(covered: Column, n: Column) -> Column:
    """Booleans by place from the sorted distinct covered places, in one pass."""
    runs = F.transform(covered, lambda p, i: F.concat(F.array_repeat(F.lit(False), p - F.when(i > 0, F.get(covered, i - 1) + 1).otherwise(0)), F.array(F.lit(True))))
    return F.concat(F.flatten(runs), F.array_repeat(F.lit(False), n - F.element_at(covered, -1) - 1))


def repeated_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, passage: int | None = None) -> DataFrame:
    """(_id, _text, places): the places (j, k) of the windows of each document that stand earlier somewhere."""
    text = F.coalesce(docs[text_col], F.lit(""))
    named = docs.select(docs[id_col].alias("_id"), F.xxhash64(text).alias("_text"), _filled(_lines(text), passage is not None).alias("filled"))
    windows = named.select("_id", "_text", F.inline(_windows(F.col("filled"), size, passage)))
    place = F.struct("_id", "_text", "j")
    first = windows.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    later = tables.join_hot(windows, tables.saved(first, "windows"), ["h1", "h2"], ["_id", "_text", "j"], "n").where(place > F.col("first"))
    return later.groupBy("_id", "_text").agg(F.sort_array(F.collect_set(F.struct("j", "k"))).alias("places"))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, passage: int | None = None) -> DataFrame:
    """id, n_lines, n_removed, text: each document without the lines that later occurrences of windows cover."""
    found = tables.saved(repeated_windows(docs, id_col, text_col, size, passage), "places")
    if (found.agg(F.sum(F.size("places") + 4).alias("n")).first().n or 0) <= SENT_PLACES:
        found = F.broadcast(found)
    named = docs.select(docs[id_col].alias("_id"), F.coalesce(docs[text_col], F.lit("")).alias("_whole"))
    named = named.withColumn("_text", F.xxhash64("_whole"))
    joined = named.join(found, named["_id"].eqNullSafe(found["_id"]) & (named["_text"] == found["_text"]), "left").select(named["_id"], "_whole", "places")
    lines, filled = _lines(F.col("_whole")), F.col("filled")
    split = joined.select("_id", "_whole", "places", lines.alias("lines"), F.when(F.col("places").isNotNull(), _filled(lines)).alias("filled"))
    reach = F.array_distinct(F.flatten(F.transform("places", lambda w: F.filter(F.sequence(w["j"], w["j"] + w["k"] - 1), lambda x: x < F.size(filled)))))
    merged = split.select("_id", "_whole", "lines", F.transform(F.array_sort(reach), lambda k: F.get(filled, k)["at"]).alias("covered"))
    kept = F.when(F.col("covered").isNull(), F.col("_whole")).otherwise(F.array_join(F.filter(F.arrays_zip("lines", "flag"), lambda x: ~x["flag"])["lines"], "\n"))
    flagged = merged.withColumn("flag", _flags(F.col("covered"), F.size("lines")))
    return flagged.select(F.col("_id").alias(id_col), F.size("lines").cast("long").alias("n_lines"), F.coalesce(F.size("covered"), F.lit(0)).cast("long").alias("n_removed"), kept.alias(text_col))
