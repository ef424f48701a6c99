"""Secret scans: base patterns plus sliding-window entropy over candidate strings.

Candidates are maximal runs of the characters of keys and tokens. A window slides over each; its Shannon
entropy is kept up to date from the two counts that change at a step, and windows above the threshold of
the candidate's character class make the candidate a span, unless an allow-listed form explains it. What base spans
take of a candidate is cut out, and the pieces beside them are candidates of their own. Words that mark examples count
in the part between slashes or equal signs that holds the window, not elsewhere in a path.

Defined results: a null text is empty; offsets are code points, end exclusive; an id of null is carried; every row is
scanned on its own, so repeated rows repeat; base spans of different kinds may overlap and all stay; spans that start
together are ordered by kind; of windows with the same entropy the first counts; a text of any length
is scanned whole; an empty table gives an empty result; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import tables

KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
#: Window length, and bits per character from which a window of a class is random.
WINDOW = 20
THRESHOLDS = {"hex": 3.1, "alnum": 3.7, "base64": 3.9}
#: Forms that are no secrets, however mixed they look.
ALLOWED = [
    re.compile(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}"),  # a UUID
    re.compile(r"[0-9+/_=-]+"),  # numbers, dates, rules
    re.compile(r"[A-Za-z]+([_-][A-Za-z]+)*"),  # words and identifiers without digits
    re.compile(r"(.{1,4})\1{4,}.{0,4}"),  # a short piece over and over
]
EXAMPLES = re.compile(r"(?i)example|sample|dummy|placeholder|xxxx")
_X_LOG = [0.0] + [n * math.log2(n) for n in range(1, 257)]


def char_class(s: str) -> str:
    if not s.strip("0123456789abcdef") or not s.strip("0123456789ABCDEF"):
        return "hex"
    return "alnum" if s.isalnum() else "base64"


def peak_window(s: str, window: int = WINDOW) -> tuple[float, int]:
    """The highest entropy in bits per character of any window of s, by incremental counts, and the end of the first such."""
    n = min(window, len(s))
    if not n:
        return 0.0, 0
    counts: dict[str, int] = {}
    total = 0.0  # sum of c * log2(c)
    best, end = math.inf, n
    for i, c in enumerate(s):
        k = counts.get(c, 0)
        total += _X_LOG[k + 1] - _X_LOG[k]
        counts[c] = k + 1
        if i >= n:
            k = counts[s[i - n]]
            total += _X_LOG[k - 1] - _X_LOG[k]
            counts[s[i - n]] = k - 1
        if i >= n - 1 and total < best - 1e-9:
            best, end = total, i + 1
    return math.log2(n) - best / n, end


def peak_entropy(s: str, window: int = WINDOW) -> float:
    return peak_window(s, window)[0]


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    found: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    if "=" in text or ":" in text:
        found["assign"] = [m.span() for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        found["access"] = [m.span() for m in ACCESS.finditer(text)]
    found["hex"] = [m.span() for m in HEX.finditer(text)]
    return found


def _is_secret(s: str) -> bool:
    if any(p.fullmatch(s) for p in ALLOWED):
        return False
    entropy, end = peak_window(s)
    if entropy < THRESHOLDS[char_class(s)]:
        return False
    first = max(s.rfind(c, 0, end - 1) for c in "/=") + 1
    last = min((k for c in "/=" if (k := s.find(c, end - 1)) >= 0), default=len(s))
    return not EXAMPLES.search(s, first, max(last, end))


def entropy_spans(text: str, taken: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Candidates of high entropy, and pieces of candidates that spans of taken (ascending, apart) leave."""
    out, k = [], 0
    for m in CANDIDATE.finditer(text):
        while k < len(taken) and taken[k][1] <= m.start():
            k += 1
        start, j, pieces = m.start(), k, []
        while j < len(taken) and taken[j][0] < m.end():
            pieces.append((start, taken[j][0]))
            start, j = taken[j][1], j + 1
        pieces.append((start, m.end()))
        out += [(a, b) for a, b in pieces if b - a >= WINDOW and _is_secret(text[a:b])]
    return out


def _told(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


SCHEMA = T.StructType([T.StructField("n_assign", T.LongType()), T.StructField("n_access", T.LongType()), T.StructField("n_hex", T.LongType()), T.StructField("base", T.StringType()), T.StructField("spans", T.StringType())])
_RANK = {k: i for i, k in enumerate((*KINDS, "entropy"))}


def scan_text(text: str) -> tuple[int, int, int, str, str]:
    """Counts by base kind, the base spans and all spans, each by start and then kind."""
    found = base_spans(text)
    base = sorted(((a, b, k) for k, spans in found.items() for a, b in spans), key=lambda x: (x[0], _RANK[x[2]]))
    taken: list[tuple[int, int]] = []
    for a, b, _ in base:  # overlapping base spans as one
        if taken and a < taken[-1][1]:
            taken[-1] = (taken[-1][0], max(b, taken[-1][1]))
        else:
            taken.append((a, b))
    more = [(a, b, "entropy") for a, b in entropy_spans(text, taken)]
    every = sorted(base + more, key=lambda x: (x[0], _RANK[x[2]]))
    return (*(len(found[k]) for k in KINDS), _told(base), _told(every))


def secret_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_assign, n_access, n_hex, base (base spans as text), base_sha256, spans; one row per document."""
    source = docs.select(docs[id_col].alias(id_col), docs[text_col].alias("_text"))
    schema = T.StructType([source.schema[0], *SCHEMA, T.StructField("base_sha256", T.StringType())])

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [scan_text(t or "") for t in b.column(1).to_pylist()]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
            sha = [hashlib.sha256(x.encode()).hexdigest() for x in cols[3]]
            arrays = [b.column(0), *(pa.array(c, pa.int64()) for c in cols[:3]), *(pa.array(c, pa.string()) for c in (*cols[3:], sha))]
            yield pa.RecordBatch.from_arrays(arrays, names=[f.name for f in schema])

    return tables.map_arrow(source, scanned, schema)
