"""The queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import conversation_trie, decontaminate, embedding_dedup, line_dedup, mixing, ngram_join, pii, quality, secrets, spelling, tables, token_output, toxicity, url_filter


def _id_hash(buckets: int) -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % buckets


def _judged(scores: DataFrame, held_out: Column, least: float) -> DataFrame:
    return scores.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= least).cast("int").alias("predicted"))


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(tables.read(spark, sf_dir, "documents"))
    counts = [f"n_{k}" for k in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(pii.as_text(F.col("base")), 256).alias("base_sha256"), pii.as_text(F.col("spans")).alias("spans"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contained_items(tables.read(spark, sf_dir, "documents"), tables.read(spark, sf_dir, "benchmark"))


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ngram_join.ngram_join(tables.read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_shingles", "component_id")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = tables.read(spark, sf_dir, "documents"), tables.read(spark, sf_dir, "labels")
    return _judged(quality.score_quality(docs, labels, _id_hash(5) != 0), _id_hash(5) == 0, 0.3)


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup(tables.read(spark, sf_dir, "documents"), passage=50)


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.secret_scan(tables.read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")


def op7_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tables.new_path(spark, "tokens")
    token_output.write_tokens(tables.read(spark, sf_dir, "documents"), path)
    return token_output.token_digests(spark, path)


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.embedding_links(tables.read(spark, sf_dir, "embeddings"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = tables.read(spark, sf_dir, "documents"), tables.read(spark, sf_dir, "labels")
    return _judged(toxicity.score_toxicity(docs, labels, _id_hash(3) != 1), _id_hash(3) == 1, 0.7)


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_plan(tables.read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie.prefix_trie(tables.read(spark, sf_dir, "conversations"))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(tables.read(spark, sf_dir, "documents"), damage=31)


def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = tables.read(spark, sf_dir, "pages")
    rules = spark.createDataFrame([tuple(r) for r in URL_RULES], "host string, path string, verdict string")
    unwanted = reduce(or_, [F.contains(url_filter.host(F.col("url")), F.lit(name)) for name in url_filter.UNWANTED])
    return url_filter.url_filter(pages, pages.where(unwanted).select("url"), rules)


#: Host, path and verdict of the rules of op 13: fixed values.
URL_RULES = [
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii": op1_pii,
    "op2_decontaminate": op2_decontaminate,
    "op3_ngram_join": op3_ngram_join,
    "op4_quality": op4_quality,
    "op5_line_dedup": op5_line_dedup,
    "op6_secret_scan": op6_secret_scan,
    "op7_token_output": op7_token_output,
    "op8_embedding_dedup": op8_embedding_dedup,
    "op9_toxicity": op9_toxicity,
    "op10_mix_sources": op10_mix_sources,
    "op11_conversation_trie": op11_conversation_trie,
    "op12_spelling": op12_spelling,
    "op13_url_filter": op13_url_filter,
}

_WORDS = r"'[^\x20\x09-\x0D]+'"


def _uniform(seed: int, key: str) -> str:
    return f"(('0x' || substr(md5('{seed}:' || {key}), 1, 13))::BIGINT / 4503599627370496.0)"


def _shingle_sets(table: str, key: str, size: int) -> str:
    """(key, n, g) of the distinct shingles of the texts of a table; fewer words are one shingle."""
    plain = r"regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[!-/:-@\[-`{-~]', '', 'g')"
    words = f"(SELECT {key}, regexp_extract_all({plain}, {_WORDS}) AS w FROM {table})"
    sets = f"(SELECT {key}, CASE WHEN len(w) >= {size} THEN list_distinct(list_transform(range(len(w) - {size - 1}), lambda i: array_to_string(w[i + 1:i + {size}], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM {words})"
    return f"SELECT {key}, len(s) AS n, unnest(s) AS g FROM {sets}"


#: One row with t, the table of the CRC-32 of the bytes 0 to 255.
_CRC_TABLE = "SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t"


def _crc32(text: str) -> str:
    """The unsigned CRC-32 of the UTF-8 bytes of a text, with t of _CRC_TABLE in reach."""
    data = f"list_transform(range(strlen({text})), lambda i: ('0x' || substr(hex(encode({text})), CAST(2 * i + 1 AS INT), 2))::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295, {data}), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)"


_URL_HOST = r"translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_URL_PATH = r"regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1)"

ORACLE_SQL: dict[str, str] = {
    "op2_decontaminate": f"""WITH b AS ({_shingle_sets("benchmark", "item_id", 5)}), d AS ({_shingle_sets("documents", "doc_id", 5)}),
m AS (SELECT d.doc_id, b.item_id, count(*) AS shared, max(b.n) AS item_shingles FROM d JOIN b USING (g) GROUP BY ALL)
SELECT doc_id, item_id, shared, CAST(item_shingles AS BIGINT) AS item_shingles, shared / item_shingles AS containment FROM m WHERE shared >= 0.8 * item_shingles - 1e-9""",
    "op5_line_dedup": f"""WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
f AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS j, count(*) OVER (PARTITION BY doc_id) AS m, trim(line) AS t, len(regexp_extract_all(trim(line), {_WORDS})) AS words FROM l WHERE trim(line) <> ''),
w AS (SELECT doc_id, j, m, t, words, lead(t) OVER d AS t2, lead(t, 2) OVER d AS t3, lead(words) OVER d AS words2 FROM f WINDOW d AS (PARTITION BY doc_id ORDER BY j)),
v AS (SELECT doc_id, j, 3 AS k, concat_ws(chr(10), t, t2, t3) AS x FROM w WHERE j = 1 OR j + 2 <= m
  UNION ALL SELECT doc_id, j, 1, t FROM w WHERE words >= 50
  UNION ALL SELECT doc_id, j, 2, concat_ws(chr(10), t, t2) FROM w WHERE words + words2 >= 50),
r AS (SELECT *, doc_id * 4294967296 + j AS place, min(doc_id * 4294967296 + j) OVER (PARTITION BY x) AS first FROM v),
c AS (SELECT DISTINCT f.doc_id, f.pos FROM r JOIN f ON r.doc_id = f.doc_id AND f.j BETWEEN r.j AND r.j + r.k - 1 WHERE r.place > r.first)
SELECT l.doc_id, count(*) AS n_lines, count(c.pos) AS n_removed, coalesce(string_agg(l.line, chr(10) ORDER BY l.pos) FILTER (c.pos IS NULL), '') AS text
FROM l LEFT JOIN c ON l.doc_id = c.doc_id AND l.pos = c.pos GROUP BY l.doc_id""",
    "op10_mix_sources": f"""WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), {_WORDS})) AS BIGINT) AS size, {_uniform(17, "doc_id")} AS u FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS ss FROM d GROUP BY source),
w AS (SELECT *, ([5, 2, 1])[(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w FROM s),
r AS (SELECT *, 3.0::DOUBLE * ss / w AS r FROM w),
c AS (SELECT *, (sum(ss) OVER () - 3.0::DOUBLE * coalesce(sum(ss) OVER e, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER e, 0)) AS level FROM r WINDOW e AS (ORDER BY r, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, ss, least(3.0::DOUBLE * ss, max(level) OVER () * w) AS target FROM c),
p AS (SELECT d.*, ss, target, CASE WHEN ss > 0 THEN target / ss ELSE 0 END AS rate FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
k AS (SELECT p.*, k, u + k * 0.6180339887498949::DOUBLE AS v FROM p, range({mixing.SEEDS}) AS x(k)),
b AS (SELECT *, size * (floor(rate) + CASE WHEN v - floor(v) < rate - floor(rate) THEN 1 ELSE 0 END) AS taken FROM k),
o AS (SELECT source, k, abs(sum(taken) - any_value(target)) AS away FROM b GROUP BY source, k),
m AS (SELECT source, arg_min(k, (away, k)) AS k FROM o GROUP BY source)
SELECT doc_id, size, ss AS source_size, target, CAST(taken AS BIGINT) AS taken FROM b JOIN m ON b.source IS NOT DISTINCT FROM m.source AND b.k = m.k""",
    "op11_conversation_trie": f"""WITH k AS ({_CRC_TABLE}),
t AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS pos FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)),
n AS (SELECT conv_id, conv_id - conv_id % 5 AS base, CAST(conv_id AS VARCHAR) AS c, count(*) AS n FROM t GROUP BY conv_id),
h AS (SELECT n.conv_id, n.base, n.n, {_crc32("n.c")} % 9 AS h, coalesce(b.n, 0) AS bn FROM n LEFT JOIN n b ON n.base = b.conv_id, k),
r AS (SELECT h.conv_id, pos + 1 AS depth, role, text FROM h JOIN t ON t.conv_id = h.base AND pos < h
  UNION ALL SELECT h.conv_id, pos - h + least(h, bn) + 1, role, text FROM h JOIN t ON t.conv_id = h.conv_id AND pos >= h),
p AS (SELECT conv_id, depth, list(struct_pack(role, text)) OVER (PARTITION BY conv_id ORDER BY depth) AS prefix, strlen(text) AS size FROM r
  UNION ALL SELECT conv_id, 0, [], 0 FROM h),
o AS (SELECT depth, prefix, min(conv_id) AS owner, count(*) AS n_convs, any_value(size) AS size FROM p GROUP BY depth, prefix),
q AS (SELECT p.conv_id, p.depth, o.owner, o.n_convs, o.size, lag(o.owner) OVER (PARTITION BY p.conv_id ORDER BY p.depth) AS up, max(p.depth) OVER (PARTITION BY p.conv_id) AS last FROM p JOIN o USING (depth, prefix)),
v AS (SELECT owner, depth, any_value(up) AS up, any_value(n_convs) AS n_convs, any_value(size) AS size, coalesce(string_agg(conv_id, ',' ORDER BY conv_id) FILTER (depth = last), '') AS ends FROM q GROUP BY owner, depth),
c AS (SELECT up AS owner, depth - 1 AS depth, count(*) AS n_children FROM v WHERE depth > 0 GROUP BY ALL),
w AS (SELECT v.*, coalesce(n_children, 0) AS n_children FROM v LEFT JOIN c USING (owner, depth)),
s AS (SELECT q.owner, q.depth, sum(CAST(n_children = 0 AS INT)) AS n_leaves, sum((w.n_convs - 1) * w.size) AS saved FROM w JOIN q ON q.conv_id = w.owner AND q.depth <= w.depth GROUP BY ALL)
SELECT owner AS conv_id, depth, up AS parent_conv_id, n_convs, n_children, CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(ends) AS ends_sha256 FROM w JOIN s USING (owner, depth)""",
    "op12_spelling": f"""WITH c AS ({_CRC_TABLE}),
r AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\\x{{C0}}-\\x{{FF}}]{{7,}}')) AS run FROM documents),
l AS (SELECT id || ':' || translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS m FROM r GROUP BY ALL),
h AS (SELECT run, m, {_crc32("k")} AS h FROM l, c),
d AS (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, CAST(h % length(run) AS INT)) || substr(run, CAST(h % length(run) AS INT) + 2) ELSE run END AS word, m FROM h),
w AS (SELECT word, CAST(sum(m) AS BIGINT) AS n FROM d WHERE length(word) >= 7 GROUP BY word HAVING sum(m) >= 2),
x AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w),
y AS (SELECT word, n, i, substr(word, 1, CAST(i AS INT) - 1) || substr(word, CAST(i AS INT) + 1) AS rest FROM x),
e AS (SELECT a.word AS a, a.n AS an, b.word AS b, b.n AS bn FROM y a JOIN y b USING (rest, i) WHERE a.word <> b.word AND length(a.word) = length(b.word)
  UNION SELECT a.word, a.n, b.word, b.n FROM y a JOIN w b ON a.rest = b.word UNION SELECT b.word, b.n, a.word, a.n FROM y a JOIN w b ON a.rest = b.word),
g AS (SELECT a, any_value(an) AS an, count(*) AS n_near, max(bn) AS most FROM e GROUP BY a),
f AS (SELECT g.a, n_near, CASE WHEN most >= 10 * g.an THEN min(e.b) END AS form, CASE WHEN most >= 10 * g.an THEN most END AS form_n FROM g JOIN e ON e.a = g.a AND e.bn = most GROUP BY g.a, n_near, most, g.an),
o AS (SELECT a, form, form_n, n_near FROM f),
p0 AS (SELECT w.word, w.n, o.form, o.form_n, coalesce(o.n_near, 0) AS n_near, coalesce(o.form, w.word) AS r FROM w LEFT JOIN o ON o.a = w.word),
p1 AS (SELECT x.* REPLACE (y.r AS r) FROM p0 x JOIN p0 y ON x.r = y.word),
p2 AS (SELECT x.* REPLACE (y.r AS r) FROM p1 x JOIN p1 y ON x.r = y.word),
p3 AS (SELECT x.* REPLACE (y.r AS r) FROM p2 x JOIN p2 y ON x.r = y.word)
SELECT word, form, r AS root, n, CAST(n_near AS BIGINT) AS n_near, CAST(form_n AS BIGINT) AS form_n FROM p3""",
    "op13_url_filter": rf"""WITH u AS (SELECT page_id, url, {_URL_HOST} AS host, {_URL_PATH} AS path FROM pages),
q AS (SELECT *, list_sort(list_filter(string_split(regexp_extract(coalesce(url, ''), '(?s)^.*?://[^?#]*\?([^#]*)', 1), '&'), lambda x: x <> '' AND NOT starts_with(x, 'utm_'))) AS par FROM u),
c AS (SELECT *, CASE WHEN host <> '' THEN regexp_replace(regexp_replace(host, '^www\.', ''), ':(80|443)$', '') || regexp_replace(path, '/+$', '') || CASE WHEN len(par) > 0 THEN '?' || array_to_string(par, '&') ELSE '' END END AS canon FROM q),
l AS (SELECT DISTINCT canon FROM c WHERE {" OR ".join(f"contains(host, '{x}')" for x in url_filter.UNWANTED)}),
r AS (SELECT * FROM (VALUES {", ".join(str(x) for x in URL_RULES)}) AS v(rh, rp, rv)),
k AS (SELECT c.*, (SELECT max(struct_pack(n := length(rh || rp), h := length(rh), rule := rh || rp, v := rv)) FROM r WHERE (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)) AS best FROM c)
SELECT page_id, host, path, best.rule AS rule, coalesce(best.v, CASE WHEN canon IN (SELECT canon FROM l) THEN 'block' END, 'allow') AS verdict FROM k""",
}
