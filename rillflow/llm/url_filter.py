"""URL filters: a blocked Bloom filter of listed canonical URLs and rules, and an exact hash join (native).

Listed URLs (canonical) and rules (host and path prefix) become keys of one blocked Bloom filter: a key sets one bit in
each of the eight words of one block. A page offers its canonical URL and, for every shape (labels of the host, length of
the path) that a rule has, the end of its host with the start of its path. Keys that the filter passes are joined exactly to
the entries, which removes false positives. A page's longest rule decides; without a rule, a listed URL is blocked.

The filter has at most MAX_BLOCKS blocks (32 MB as rows), so it can be broadcast whatever the list: a longer list only
lets more keys pass to the exact join, which deals hot keys to several tasks.

Defined results: a null URL, or one without "://", has empty host and path, no rule and no canonical form and is allowed. Of
rules with the same host and path, and of a rule listed twice, the one that blocks stays. A tie of length goes to the longer
host. Rows that repeat a page are all judged, alike. URLs of any length are read whole; an empty table or list gives
an empty result or allows all; other columns, whatever their names, are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import tables

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bits of the filter for a key, words of a block, and the largest number of blocks.
BITS, WORDS, MAX_BLOCKS = 12, 8, 1 << 18
#: Host parts that mark the unwanted sites of the test data, whose URLs its query lists.
UNWANTED = ("spam-farm", "cheap-pills", "casino-win")


def host(url: Column) -> Column:
    """What stands behind the first "://" up to "/", "?", "#" or the end, A-Z lower-cased; empty without one."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def path(url: Column) -> Column:
    """What follows the host up to "?", "#" or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def canonical(url: Column, url_host: Column, url_path: Column) -> Column:
    """The form in which URLs are compared; null without a host.

    Without scheme, fragment, leading "www.", default port, closing slashes and tracking parameters (utm_*), and with the
    other parameters sorted.
    """
    site = F.regexp_replace(F.regexp_replace(url_host, r"^www\.", ""), r":(80|443)$", "")
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^?#]*\?([^#]*)", 1)
    kept = F.array_sort(F.filter(F.split(query, "&", -1), lambda x: (x != "") & ~x.startswith("utm_")))
    parameters = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(F.lit(""))
    return F.when(url_host != "", F.concat(site, F.regexp_replace(url_path, r"/+$", ""), parameters))


def _place(key: Column, blocks: int) -> list[Column]:
    """The block of a key and its mask in each word."""
    bits = F.xxhash64(key, F.lit(1))
    masks = [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(bits, 6 * k).bitwiseAND(63).cast("int")) for k in range(WORDS)]
    return [F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int").alias("block"), *[m.alias(f"mask{k}") for k, m in enumerate(masks)]]


def bloom_filter(keys: DataFrame, key: str, blocks: int) -> DataFrame:
    """(block, word0 to word7) of the blocks that a key fills."""
    set_bits = keys.select(*_place(F.col(key), blocks))
    return set_bits.groupBy("block").agg(*[F.bit_or(f"mask{k}").alias(f"word{k}") for k in range(WORDS)])


def might_hold(rows: DataFrame, key: str, blooms: DataFrame, blocks: int) -> DataFrame:
    """The rows whose key the filter passes. The filter is broadcast: it has at most MAX_BLOCKS rows."""
    placed = rows.select("*", *_place(F.col(key), blocks)).join(F.broadcast(blooms), "block")
    held = [F.col(f"word{k}").bitwiseAND(F.col(f"mask{k}")) == F.col(f"mask{k}") for k in range(WORDS)]
    for each in held:
        placed = placed.where(each)
    return placed.select(*rows.columns)


def entries(listed: DataFrame, rules: DataFrame) -> DataFrame:
    """(key, rank, rule, verdict): the distinct listed URLs and rules, the longest rule with the highest rank."""
    url = listed.select(F.concat(F.lit("u:"), canonical(F.col("url"), host(F.col("url")), path(F.col("url")))).alias("key"), F.array(F.lit(0), F.lit(0)).alias("rank"), F.lit(None).cast("string").alias("rule"), F.lit("block").alias("verdict"))
    text = F.concat("host", "path")
    rule = rules.select(F.concat(F.lit("r:"), text).alias("key"), F.array(F.length(text) + 1, F.length("host")).alias("rank"), text.alias("rule"), "verdict")
    return url.unionByName(rule).where("key is not null").groupBy("key").agg(F.max("rank").alias("rank"), F.max("rule").alias("rule"), F.max("verdict").alias("verdict"))


def candidates(url: Column, url_host: Column, url_path: Column, shapes: list[tuple[int, int]]) -> Column:
    """The keys under which a URL can stand in the list: its canonical form, and an end of its host with a start of its path."""
    own = F.array(F.concat(F.lit("u:"), canonical(url, url_host, url_path)))
    fits = [F.when((F.length(url_path) >= n) & (url_host != ""), F.concat(F.lit("r:"), F.substring_index(url_host, ".", -k), F.substring(url_path, 1, n))) for k, n in shapes]
    return F.array_compact(F.concat(own, F.array(*fits)) if fits else own)


def url_filter(pages: DataFrame, listed: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """id, host, path, rule, verdict of every page.

    listed: url; rules: host, path, verdict (allow or block). A rule fits its host and all subdomains, if the path of the
    URL starts with its path. The shapes of the rules, which the driver gets, are as many as there are different pairs of
    a number of labels and a length of path.
    """
    known = tables.saved(entries(listed, rules), "entries")
    n = known.count()
    blocks = min(max(1, -(-n * BITS // (64 * WORDS))), MAX_BLOCKS)
    blooms = tables.saved(bloom_filter(known, "key", blocks), "filter")
    shapes = rules.select(F.size(F.split("host", r"\.", -1)).alias("k"), F.length("path").alias("n")).distinct().collect()
    url = F.col("url")
    rows = pages.select(pages[id_col].alias("id"), pages[url_col].alias("url"), F.spark_partition_id().alias("part"))
    rows = tables.saved(rows.select("*", host(url).alias("host"), path(url).alias("path")), "urls")
    keys = candidates(url, F.col("host"), F.col("path"), sorted((r.k, r.n) for r in shapes))
    offered = rows.select("id", "url", "part", F.explode(keys).alias("key"))
    possible = might_hold(offered, "key", blooms, blocks)
    if n <= tables.BROADCAST_ROWS:
        hits = possible.join(F.broadcast(known), "key")
    else:
        possible = tables.saved(possible, "possible")
        counted = possible.groupBy("key").agg(F.count(F.lit(1)).alias("n")).join(known, "key")
        hits = tables.join_hot(possible, tables.saved(counted, "hit"), ["key"], ["id", "url", "part"], "n")
    found = F.struct("rank", "rule", "verdict")
    every = rows.select("id", "url", "part", F.lit(1).alias("one"), F.lit(None).cast(hits.select(found).schema[0].dataType).alias("hit"))
    told = every.unionByName(hits.select("id", "url", "part", F.lit(0).alias("one"), found.alias("hit")))
    # the rows of a page in one part of the table are judged together, so that a page that fills many parts has many tasks
    judged = told.groupBy("id", "url", "part").agg(F.max("hit").alias("hit"), F.sum("one").alias("n"))
    each = judged.select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("copy"))
    return each.select(F.col("id").alias(id_col), host(url).alias("host"), path(url).alias("path"), F.col("hit.rule").alias("rule"), F.coalesce("hit.verdict", F.lit("allow")).alias("verdict"))
