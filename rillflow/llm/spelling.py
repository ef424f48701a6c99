"""Spelling variant groups: one-edit neighbourhoods in a reduced alphabet, verified on the words.

Letters are hashed to a few symbols. A word generates the one-edit neighbourhood of its reduced form: the form itself (an
edit between letters of one symbol), every replacement by a larger symbol and every deletion; what else two words can
differ by is the other word's replacement or deletion, so each near pair is generated once. As an edit in one half of a
word leaves the other half as it was, the unchanged half, in its own letters, is part of the key on which the
neighbourhoods meet the reduced vocabulary; that keeps the words that share a key few. Pairs that meet are verified on the
words themselves at the place of the edit.

Each word occurs once in the vocabulary, so no frequent word makes a key hot; keys that many different words share are
split by Spark's skew join. Words of more than LONG letters, whose neighbourhoods would take work in the square of their
length, meet by their unchanged halves alone and are verified by edit distance.

Defined results: null, empty and letterless texts have no words; a null id is the empty text in the hash that picks runs to
damage; rows that repeat an id count each; of near words with the same number the smallest in code-point order is the form;
texts of any length are read whole; an empty table gives an empty result; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import zlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import tables

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LETTERS = LOWER + "".join(map(chr, range(0xC0, 0x100)))
#: Letters of a word from which on its halves alone are its keys.
LONG = 48
#: Words for each seven-letter form of the reduced alphabet that are aimed at.
FILL = 64


def words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 7, damage: int | None = 31) -> DataFrame:
    """(word, n): the runs of letters of all texts, lower-cased, with at least so many letters.

    With damage, a run whose hash with its document's id that number divides loses one letter.
    """
    runs = F.regexp_extract_all(F.coalesce(docs[text_col], F.lit("")), F.lit(f"([A-Za-z\\u00C0-\\u00FF]{{{least},}})"))
    found = docs.select(docs[id_col].cast("string").alias("id"), F.explode(runs).alias("run")).select("id", F.translate("run", UPPER, LOWER).alias("run"))
    if damage:
        h = F.crc32(F.concat(F.coalesce("id", F.lit("")), F.lit(":"), F.col("run")).cast("binary"))
        at = (h % F.length("run")).cast("int")
        cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
        found = found.select(F.when(h % damage == 0, cut).otherwise(F.col("run")).alias("run"))
    return found.where(F.length("run") >= least).groupBy(F.col("run").alias("word")).agg(F.count(F.lit(1)).alias("n"))


def symbols_for(n_words: int) -> int:
    """The symbols of the reduced alphabet: so many that FILL words come to a form of seven letters, and at least four."""
    return min(26, max(4, -(-int(1e6 * (n_words / FILL) ** (1 / 7)) // 1_000_000)))


def reduced(word: Column, symbols: int) -> Column:
    """The word in the reduced alphabet (symbols A, B, ...), each letter at its own place."""
    return F.translate(word, LETTERS, "".join(chr(65 + zlib.crc32(c.encode()) % symbols) for c in LETTERS))


def _key(form: Column, side: str, half: Column) -> Column:
    return F.xxhash64(form, F.lit(side), half)


def _head(word: Column, half: Column) -> Column:
    return F.substring(word, F.lit(1), half)


def _tail(word: Column, half: Column) -> Column:
    return F.substring(word, -half, half)


def _keys(vocabulary: DataFrame) -> DataFrame:
    """(key, word, n): under its form with its first half, and with its last half."""
    size, form = F.length("word"), F.when(F.length("word") <= LONG, F.col("form")).otherwise(F.lit(""))
    half = F.floor(size / 2).cast("int")
    own = [_key(form, "head", _head(F.col("word"), half)), _key(form, "tail", _tail(F.col("word"), size - half))]
    at_border = F.array(*[_key(F.lit(""), s, h) for s, h in (("head", _head(F.col("word"), half)), ("tail", _tail(F.col("word"), size - half)))])
    both = F.when(size == LONG, F.concat(F.array(*own), at_border)).otherwise(F.array(*own))  # a longer word asks by halves
    return vocabulary.select(F.explode(both).alias("key"), "word", "n")


def _neighbours(vocabulary: DataFrame, symbols: int) -> DataFrame:
    """(key, edit, at, word, n): the neighbourhood of each word's form. edit: 0 none, 1 a letter replaced, 2 a letter less."""
    word, form, size = F.col("word"), F.col("form"), F.length("word")
    places = F.sequence(F.lit(0), size - 1)

    def row(changed: Column, at: Column, edit: int, length: Column) -> Column:
        """The edit at a place, and the half of the word that it leaves."""
        half = F.floor(length / 2).cast("int")
        key = F.when(at >= half, _key(changed, "head", _head(word, half))).otherwise(_key(changed, "tail", _tail(word, length - half)))
        return F.struct(key.alias("key"), F.lit(edit).alias("edit"), at.alias("at"))

    def replaced(at: Column) -> Column:
        larger = F.filter(F.array(*[F.lit(chr(65 + s)) for s in range(1, symbols)]), lambda s: s > F.substring(form, at + 1, F.lit(1)))
        return F.transform(larger, lambda s: row(F.concat(F.substring(form, F.lit(1), at), s, F.substring(form, at + 2, size)), at, 1, size))

    def removed(at: Column) -> Column:
        return row(F.concat(F.substring(form, F.lit(1), at), F.substring(form, at + 2, size)), at, 2, size - 1)

    # of a run of one letter the first is removed, so that a shorter word comes once
    starts = F.filter(places, lambda i: (i == 0) | (F.substring(word, i + 1, F.lit(1)) != F.substring(word, i, F.lit(1))))
    same = F.array_distinct(F.array(row(form, F.lit(0), 0, size), row(form, size - 1, 0, size)))
    short = F.concat(same, F.flatten(F.transform(places, replaced)), F.transform(starts, removed))
    halves = [row(F.lit(""), at, 3, n) for n in (size, size - 1) for at in (F.lit(0), size - 1)]
    return vocabulary.select(F.explode(F.when(size <= LONG, short).otherwise(F.array(*halves))).alias("e"), "word", "n").select("e.*", "word", "n")


def near_pairs(vocabulary: DataFrame, symbols: int | None = None) -> DataFrame:
    """(word, n, near, near_n): every two words of (word, n) that differ by exactly one edit, once."""
    symbols = symbols or symbols_for(vocabulary.count())
    formed = vocabulary.withColumn("form", reduced(F.col("word"), symbols))
    asked = _neighbours(formed, symbols)
    held = _keys(formed).select("key", F.col("word").alias("near"), F.col("n").alias("near_n"))
    at, word, near = F.col("at"), F.col("word"), F.col("near")
    rest = F.concat(F.substring(word, F.lit(1), at), F.substring(word, at + 2, F.length(word)))
    near_rest = F.concat(F.substring(near, F.lit(1), at), F.substring(near, at + 2, F.length(near)))
    one = F.levenshtein(word, near, 1) == 1
    same_form = (word < near) & (F.length(word) == F.length(near)) & one
    # long words: two of one length once, a shorter one from the longer
    by_half = (F.length(word) > F.length(near)) & one
    held_edit = F.when(F.col("edit") == 0, same_form).when(F.col("edit") == 1, (F.length(word) == F.length(near)) & (rest == near_rest)).when(F.col("edit") == 2, near == rest).otherwise(same_form | by_half)
    met = asked.join(held, "key").where(held_edit)
    pairs = met.select("word", "n", "near", "near_n", "edit")
    # a long word can meet a near one under both halves
    return pairs.where("edit < 3").drop("edit").unionByName(pairs.where("edit = 3").drop("edit").distinct())


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) from (word, form): the last word that a word's forms lead to.

    Steps double in each round; as a form is ten times as frequent as its word, few rounds are needed.
    """
    steps = tables.saved(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        ahead = steps.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        longer = steps.join(ahead, "root", "left").select("word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved"))
        longer = tables.saved(longer, "forms")
        steps = longer.drop("moved")
        if not longer.where("moved").limit(1).count():
            return steps


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 7, damage: int | None = None, times: int = 10) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of at least so many letters that occurs twice or more.

    A word's form is its most frequent near word, if that is at least so many times as frequent; its root is the end of the
    chain of forms.
    """
    vocabulary = tables.saved(words(docs, id_col, text_col, least, damage).where("n >= 2"), "words")
    pairs = tables.saved(near_pairs(vocabulary), "near")
    both = pairs.unionByName(pairs.select(F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n")))
    best = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    told = vocabulary.join(best, "word", "left")
    taken = -F.col("best.less") >= times * F.col("n")
    told = tables.saved(told.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(taken, F.col("best.near")).alias("form"), F.when(taken, -F.col("best.less")).alias("form_n")), "variants")
    ends = roots(told.where("form is not null"))
    return told.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
