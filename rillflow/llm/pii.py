"""Personal data by candidate gradient boosting (native).

Four base patterns give spans that always stay. High-recall generators propose further, overlapping
candidates; boosted trees score them from their format and their context, and those above a calibrated
threshold of their generator are added.

The trees learn from the table itself (distant supervision): a candidate that a base span overlaps counts as
personal, and so does a spelt address that is a valid base match once its signs are put in; any other one does not.
No feature tells whether the base checks pass, so the trees learn how personal data looks and what stands around it,
from those that the base can vouch for; what they add are candidates that look like these and that the base cannot
vouch for (a card with a wrong check digit, a phone without its plus, a wider or a spelt address). A candidate is
added unless a base span covers all of it but marks at its ends; a number is not added where it touches a base span, as it
would run that one together with its neighbours, or inside a word of letters and digits. Thresholds hold the lower bound of the share of personal candidates.

Candidates are saved once, and gathered into distinct feature vectors with weights, which a hash deals into
FOLDS folds. Each is scored by trees that were fit on the others (at most TRAIN_ROWS vectors, a sample by hash), so
thresholds are calibrated on vectors that the trees had not seen, over all candidates. The trees become SQL expressions, so that
scoring is one projection of a document's row, without a shuffle. Within a text, places are sums by blocks of BLOCK matches,
and a candidate finds the base spans at its place by binary search in each kind's spans, which are in order.

Defined results: a null text is empty; offsets are code points, end exclusive; every row is scored on its
own, so repeated rows and null ids repeat; base spans of different kinds may overlap and all stay; without candidates of
both labels no span is added; texts of any length are searched whole; an empty table gives an empty result; other columns,
whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import tables

KINDS = ("email", "ip", "card", "phone")
#: The base patterns. A possessive quantifier or a start where a run begins changes no match, but keeps the
#: search linear in long texts.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_PLAIN_EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
#: What a text must hold for a pattern to be tried.
NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
#: Generators of candidates, with the kind that their spans have.
GENERATORS = {
    "mail": ("email", r"(?<![^\s@])[^\s@]++@[^\s@]{3,}+"),
    "spelt": ("email", r"(?i)(?<![a-z0-9._-])[a-z0-9._-]{2,}+ ?[\[({] ?at ?[\])}] ?[a-z0-9-]{2,}+ ?[\[({] ?dot ?[\])}] ?[a-z]{2,10}+"),
    "number": ("phone", r"\+?\(?[0-9](?:[\x20().-]{0,2}[0-9]){6,}+"),
}
FEATURES = ("generator", "length", "digits", "letters", "marks", "dots", "spaces", "plus", "longest", "groups", "cue", "open", "closed")
CUES = r"(?i)(mail|contact|write|tel|phone|call|mobile|fax|card|visa|account|ip|host|address|addr)\W{0,4}$"
TRAIN_ROWS, TREES, DEPTH = 20_000, 8, 3
#: Folds of the feature vectors, and spans of a block.
FOLDS, BLOCK = 3, 128
#: Share of personal candidates that those above a threshold must have, and the normal quantile of its lower bound.
PRECISION, QUANTILE = 0.8, 1.28


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether at most 19 digits pass the check of card numbers; zeros in front change nothing."""
    full = F.lpad(digits, 19, "0")
    plain = [F.substring(full, i, 1).cast("int") for i in range(1, 20, 2)]
    doubled = [F.substring(F.translate(full, "0123456789", "0246813579"), i, 1).cast("int") for i in range(2, 20, 2)]
    return reduce(lambda a, b: a + b, plain + doubled) % 10 == 0


def _valid(kind: str, s: Column) -> Column:
    if kind == "ip":
        return s.rlike(rf"^{_PART}\.{_PART}\.{_PART}\.{_PART}$")
    if kind == "card":
        return F.length(_digits(s)).between(13, 19) & luhn(_digits(s))
    if kind == "phone":
        return F.length(_digits(s)).between(9, 15)
    return F.lit(True)


def _found(df: DataFrame, text: str, name: str, pattern: str, needs: Column) -> DataFrame:
    """df with the column name: (from, to, hit, before, after) of the matches, leftmost and without overlap.

    The pieces between the matches give the places: a match begins where the lengths so far end. Texts that
    lack what a match needs are not searched, and only texts with a match are split.
    """
    searched = F.when(needs, F.col(text)).otherwise("")
    df = df.withColumn("hits", F.regexp_extract_all(searched, F.lit(pattern), F.lit(0)))
    some = F.size("hits") > 0
    df = df.withColumn("pieces", F.when(some, F.split(F.col(text), pattern, -1)).otherwise(F.array().cast("array<string>")))
    # where each match begins: the lengths of the blocks before its own, and those within it
    lengths = F.transform("hits", lambda h, i: F.length(F.get("pieces", i)) + F.length(h))
    total = lambda part: F.aggregate(part, F.lit(0), lambda a, x: a + x)
    blocks = F.when(some, F.sequence(F.lit(0), F.floor((F.size("hits") - 1) / BLOCK).cast("int"))).otherwise(F.array().cast("array<int>"))

    def told(h: Column, i: Column, lengths: Column, before: Column) -> Column:
        k = F.floor(i / BLOCK).cast("int")
        start = F.get(before, k) + total(F.slice(lengths, k * BLOCK + 1, i - k * BLOCK)) + F.length(F.get("pieces", i))
        after = F.left(F.get("pieces", i + 1), F.lit(1))
        fields = lambda s: F.struct(s.alias("from"), (s + F.length(h)).alias("to"), h.alias("hit"), F.right(F.get("pieces", i), F.lit(24)).alias("before"), after.alias("after"))
        return _with(start, fields)

    def placed(lengths: Column) -> Column:
        sums = F.transform(blocks, lambda k: total(F.slice(lengths, k * BLOCK + 1, BLOCK)))
        before = _with(sums, lambda sums: F.transform(sums, lambda x, k: total(F.slice(sums, F.lit(1), k))))
        return _with(before, lambda before: F.transform("hits", lambda h, i: told(h, i, lengths, before)))

    return df.withColumn(name, _with(lengths, placed)).drop("hits", "pieces")


def _with(value: Column, told: Callable[[Column], Column]) -> Column:
    """told(value), with the value computed once, also where a lambda reads it for each element."""
    return F.get(F.transform(F.array(value), told), F.lit(0))


def _searchable(spans: Column) -> Column:
    """Spans that are in order and do not overlap, with the steps of a binary search over them."""
    return F.struct(spans.alias("spans"), F.filter(F.array(*[F.lit(2**i) for i in range(28, -1, -1)]), lambda s: s <= F.size(spans)).alias("steps"))


def _last_before(kind: Column, place: Column) -> Column:
    """The last span of a kind that starts before a place; null if none does."""
    count = F.aggregate(kind["steps"], F.lit(0), lambda n, step: F.when(F.get(kind["spans"], n + step - 1)["from"] < place, n + step).otherwise(n))
    return F.get(kind["spans"], count - 1)


def _overlaps(by_kind: Column, c: Column) -> Column:
    """Whether a span of any kind overlaps a candidate."""
    return F.exists(by_kind, lambda k: F.coalesce(_last_before(k, c["to"])["to"] > c["from"], F.lit(False)))


def _covered(by_kind: Column, c: Column) -> Column:
    """Whether one span holds all of a candidate but marks at its ends."""
    start = c["to"] - F.length(F.regexp_replace(c["hit"], r"^[^\p{L}\p{N}]+", ""))
    end = c["from"] + F.length(F.regexp_replace(c["hit"], r"[^\p{L}\p{N}]++$", ""))
    return _with(F.struct(start.alias("from"), end.alias("to")), lambda m: F.exists(by_kind, lambda k: F.coalesce(_last_before(k, m["from"] + 1)["to"] >= m["to"], F.lit(False))))


def _spelt_out(hit: Column) -> Column:
    """Whether a spelt address is an address with '@' and '.' for its words."""
    at = F.regexp_replace(hit, r"(?i) ?[\[({] ?at ?[\])}] ?", "@")
    return F.regexp_replace(at, r"(?i) ?[\[({] ?dot ?[\])}] ?", ".").rlike("^" + _PLAIN_EMAIL + "$")


def _features(generator: int, c: Column) -> Column:
    """The numbers of FEATURES for one candidate, as integers within small bounds."""
    hit, digits = c["hit"], _digits(c["hit"])
    count = lambda pattern: F.length(F.regexp_replace(hit, f"[^{pattern}]", ""))
    groups = F.filter(F.split(hit, "[^0-9]+"), lambda g: g != "")
    values = [
        F.lit(generator),
        F.least(F.length(hit), F.lit(60)),
        F.least(F.length(digits), F.lit(24)),
        F.least(count("A-Za-z"), F.lit(40)),
        F.least(count("()-"), F.lit(8)),
        F.least(count("."), F.lit(8)),
        F.least(count(r"\x20"), F.lit(8)),
        hit.startswith("+").cast("int"),
        F.least(F.coalesce(F.array_max(F.transform(groups, F.length)), F.lit(0)), F.lit(20)),
        F.least(F.size(groups), F.lit(8)),
        c["before"].rlike(CUES).cast("int"),
        ((c["before"] == "") | c["before"].rlike(r"[\s\x22\x27(:=]$")).cast("int"),
        ((c["after"] == "") | c["after"].rlike(r"[\s\x22\x27),;.!?]")).cast("int"),
    ]
    return F.array(*[F.coalesce(v, F.lit(0)).cast("int") for v in values])


def _valid_spans(kind: str) -> Column:
    passing = F.filter(f"m_{kind}", lambda m: _valid(kind, m["hit"]))
    return F.transform(passing, lambda m: F.struct(F.lit(kind).alias("kind"), m["from"].alias("from"), m["to"].alias("to")))


def _of_kind(spans: Column, kind: str) -> Column:
    return F.filter(spans, lambda s: s["kind"] == kind)


def candidates(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """_id, base (kind, from, to of the base spans) and proposed (kind, from, to, x, label, covered) of each row."""
    df = docs.select(docs[id_col].alias("_id"), F.coalesce(docs[text_col], F.lit("")).alias("_text"))
    for kind, pattern in BASE.items():
        df = _found(df, "_text", f"m_{kind}", pattern, F.lit(True) if NEEDS[kind] is None else F.contains("_text", F.lit(NEEDS[kind])))
        df = df.withColumn(f"m_{kind}", _valid_spans(kind))
    base = [F.col(f"m_{k}") for k in KINDS]
    by_kind = F.filter(F.array(*[_searchable(b) for b in base]), lambda k: F.size(k["spans"]) > 0)
    df = df.select("_id", "_text", F.concat(*base).alias("base"), by_kind.alias("by_kind"))
    needs = {"mail": F.contains("_text", F.lit("@")), "spelt": F.col("_text").rlike(r"(?i)[\[({] ?at ?[\])}]"), "number": F.lit(True)}
    for name, (_, pattern) in GENERATORS.items():
        df = _found(df, "_text", f"g_{name}", pattern, needs[name])

    inside = lambda c: c["before"].rlike("[A-Za-z0-9]$") | c["after"].rlike("^[A-Za-z0-9]")  # noqa: E731  a word of letters and digits

    def proposed(i: int, name: str) -> Column:
        def one(c: Column) -> Column:
            kind = F.when(~c["hit"].startswith("+") & (F.length(_digits(c["hit"])) >= 13), "card").otherwise("phone") if name == "number" else F.lit(GENERATORS[name][0])
            label = _overlaps(F.col("by_kind"), c)
            label = label | _spelt_out(c["hit"]) if name == "spelt" else label
            covered = (lambda label: label | inside(c)) if name == "number" else (lambda label: _covered(F.col("by_kind"), c))
            fields = lambda label: F.struct(kind.alias("kind"), c["from"].alias("from"), c["to"].alias("to"), _features(i, c).alias("x"), label.alias("label"), covered(label).alias("covered"))
            return _with(label, fields)

        return F.transform(f"g_{name}", one)

    return df.select("_id", "base", F.concat(*[proposed(i, n) for i, n in enumerate(GENERATORS)]).alias("proposed"))


def _tree(node, x: Column) -> Column:
    """A learnt tree as an expression over the array x."""
    if node.getClass().getSimpleName() == "LeafNode":
        return F.lit(node.prediction())
    split = node.split()
    return F.when(F.get(x, F.lit(split.featureIndex())) <= split.threshold(), _tree(node.leftChild(), x)).otherwise(_tree(node.rightChild(), x))


def fold_of(x: Column) -> Column:
    return F.pmod(F.xxhash64(x), F.lit(FOLDS))


def fit_trees(vectors: DataFrame) -> GBTClassificationModel | None:
    """Trees over (x, label, weight) rows, a sample by hash; None without both labels."""
    fit = vectors.orderBy(F.xxhash64("x", "label"), "x", "label").limit(TRAIN_ROWS)
    if fit.select("label").distinct().count() < 2:
        return None
    named = fit.select(F.col("label").cast("double").alias("label"), "weight", *[F.get("x", F.lit(i)).cast("double").alias(n) for i, n in enumerate(FEATURES)])
    rows = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(named)
    return GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, weightCol="weight", seed=5, minInstancesPerNode=1).fit(rows)


def score_of(model: GBTClassificationModel, x: Column) -> Column:
    """The probability that the trees give to the array x, as an expression."""
    margin = reduce(lambda a, b: a + b, [F.lit(w) * _tree(t._call_java("rootNode"), x) for w, t in zip(model.treeWeights, model.trees, strict=True)])
    return 1 / (1 + F.exp(-2 * margin))


def lower_bound(good: float, n: float) -> float:
    """Wilson's lower bound of a share, so that a threshold needs as many candidates as its share's certainty asks for."""
    p, z = good / n, QUANTILE**2 / n
    return (p + z / 2 - (z * (p * (1 - p) + z / 4)) ** 0.5) / (1 + z)


def train(found: DataFrame):
    """(score of the array x, threshold by generator), or None without candidates of both labels."""
    vectors = found.select(F.explode("proposed").alias("c")).groupBy("c.x", "c.label").agg(F.count(F.lit(1)).cast("double").alias("weight"))
    vectors = tables.saved(vectors.withColumn("fold", fold_of(F.col("x"))), "pii-vectors")
    models = [fit_trees(vectors.where(F.col("fold") != k)) for k in range(FOLDS)]  # that of k has not seen fold k
    if None in models:  # a fold lacks a label: one set of trees for all
        models = [fit_trees(vectors)] * FOLDS
        if None in models:
            return None

    def score(x: Column) -> Column:
        return F.coalesce(*[F.when(fold_of(x) == k, score_of(m, x)) for k, m in enumerate(models)])

    binned = vectors.select(F.get("x", F.lit(0)).alias("generator"), F.floor(score(F.col("x")) * 100).cast("int").alias("bin"), "weight", F.when(F.col("label"), F.col("weight")).otherwise(0.0).alias("good"))
    bins = binned.groupBy("generator", "bin").agg(F.sum("weight").alias("weight"), F.sum("good").alias("good")).collect()  # at most 3 x 101 rows
    thresholds = []
    for i in range(len(GENERATORS)):
        weight = good = 0.0
        best = 2.0
        for r in sorted((r for r in bins if r.generator == i), key=lambda r: -r.bin):
            weight, good = weight + r.weight, good + r.good
            if lower_bound(good, weight) >= PRECISION:
                best = r.bin / 100
        thresholds.append(best)
    return score, thresholds


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_email, n_ip, n_card, n_phone (base spans), base and spans (all): arrays of (kind, from, to), by kind, then place."""
    found = tables.saved(candidates(docs, id_col, text_col), "pii-candidates")
    learnt = train(found)
    added = F.array().cast("array<struct<kind:string,from:int,to:int>>")
    if learnt:
        score, thresholds = learnt
        least = F.array(*map(F.lit, thresholds))
        chosen = F.filter("proposed", lambda c: ~c["covered"] & (score(c["x"]) >= F.get(least, F.get(c["x"], F.lit(0)))))
        added = F.transform(chosen, lambda c: F.struct(c["kind"].alias("kind"), c["from"].alias("from"), c["to"].alias("to")))  # those of one kind differ: only mail holds '@'
    told = found.select("_id", "base", added.alias("added"))
    every = F.concat(*[F.array_sort(_of_kind(F.concat("base", "added"), k)) for k in KINDS])
    counts = [F.size(_of_kind(F.col("base"), k)).cast("long").alias(f"n_{k}") for k in KINDS]
    return told.select(F.col("_id").alias(id_col), *counts, "base", every.alias("spans"))


def as_text(spans: Column) -> Column:
    """kind:from:to of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["from"].cast("string"), s["to"].cast("string"))), ",")


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and text, each text with the characters of its spans overwritten; ids are taken to name rows."""
    spans = find_pii(docs, id_col, text_col).select(F.col(id_col).alias("_id"), "spans").dropDuplicates(["_id"])
    joined = docs.select(docs[id_col].alias("_of"), F.coalesce(docs[text_col], F.lit("")).alias("_text")).join(spans, F.col("_of").eqNullSafe(F.col("_id")), "left")
    masked = F.aggregate("spans", F.col("_text"), lambda t, s: F.overlay(t, F.repeat(F.lit("*"), s["to"] - s["from"]), s["from"] + 1))
    return joined.select(F.col("_of").alias(id_col), masked.alias(text_col))
