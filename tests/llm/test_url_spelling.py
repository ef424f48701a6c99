"""URL filters and spelling variants, against plain versions."""

import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from rillflow.llm import spelling, tables, url_filter

PAGES = "page_id long, url string, HTML string, key string, n long"
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def pages(spark, urls):
    return spark.createDataFrame([(i, u, "x", "k", 9) for i, u in enumerate(urls)], PAGES)


def low(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t)


def split(url):
    m = re.match(r"(?s)(.*?)://([^/?#]*)([^?#]*)", url or "")
    return (low(m[2]), m[3]) if m else ("", "")


def plain_rule(url, rules):
    h, p = split(url)
    fits = [(len(rh + rp), len(rh), rh + rp, v) for rh, rp, v in rules if h and (h == rh or h.endswith("." + rh)) and p.startswith(rp)]
    return max(fits)[2:] if fits else None


def filtered(spark, urls, listed, rules=RULES):
    lists = spark.createDataFrame([(u,) for u in listed], "url string")
    ruled = spark.createDataFrame(rules, "host string, path string, verdict string")
    return url_filter.url_filter(pages(spark, urls), lists, ruled).collect()


URLS = [None, "", "no scheme", "http://net/", "https://a.NET/x", "http://.net/", "http://xnet/", "http://a.net", "http://a.net?/en/", "http://sub.example.net/en/1", "http://example.net/enx",
        "ftp://example.com/de/", "http://example.com/DE/", "http://org/fr/", "http://a.b.org/fr/x#y", "x://y://net/", "http://net:80/", "http://É.net/\n", "http://net/" + "a" * 100_000, "http://" + "a." * 5_000 + "net/", "://net/"]


def test_rules_equal_a_plain_version(spark):
    r = random.Random(3)
    parts = ["example", ".", "net", "com", "org", "/", "en/", "de/", "fr/", "?", "#", "://", "www.", "A"]
    urls = URLS + ["http://" + "".join(r.choice(parts) for _ in range(r.randint(0, 9))) for _ in range(400)]
    got = {x.page_id: x for x in filtered(spark, urls, [])}
    assert len(got) == len(urls)
    for i, u in enumerate(urls):
        want = plain_rule(u, RULES)
        assert (got[i].host, got[i].path) == split(u)
        assert (got[i].rule, got[i].verdict) == (want or (None, "allow"))


def test_listed_urls_in_other_forms_are_blocked(spark):
    listed = ["http://www.bad.example/a/?b=2&a=1&utm_source=x#top", "http://worse.example:80", None, "not a url"]
    same = ["https://BAD.example/a?a=1&b=2", "http://www.bad.example:443/a//?utm_x=1&b=2&a=1", "ftp://worse.example/"]
    other = ["http://bad.example/A?a=1&b=2", "http://bad.example/a", "http://sub.worse.example/", "http://worse.example:81/", None]
    got = {x.page_id: x.verdict for x in filtered(spark, same + other, listed)}
    assert [got[i] for i in range(8)] == ["block"] * 3 + ["allow"] * 5


def test_filter_passes_all_keys_and_few_others(spark):
    keys = spark.range(3_000).select(F.concat(F.lit("k"), "id").alias("key"))
    blocks = 3_000 * url_filter.BITS // 512 + 1
    blooms = url_filter.bloom_filter(keys, "key", blocks)
    others = spark.range(20_000).select(F.concat(F.lit("o"), "id").alias("key"))
    assert url_filter.might_hold(keys, "key", blooms, blocks).count() == 3_000
    assert url_filter.might_hold(others, "key", blooms, blocks).count() < 600


def test_a_full_filter_and_long_lists_give_the_same(spark, monkeypatch):
    urls = [f"http://h{i % 50}.example/{i % 7}" for i in range(300)] + ["http://a.net/"] * 300
    listed = [f"http://h{i}.example/{i % 7}" for i in range(40)]
    want = sorted(map(tuple, filtered(spark, urls, listed)))
    monkeypatch.setattr(url_filter, "MAX_BLOCKS", 1)
    monkeypatch.setattr(tables, "BROADCAST_ROWS", 3)
    monkeypatch.setattr(tables, "HOT_ROWS", 20)
    assert sorted(map(tuple, filtered(spark, urls, listed))) == want


def test_repeated_pages_ties_and_empty_tables(spark):
    page = spark.createDataFrame([(None, "http://a.net/")] * 5 + [(1, None)] * 2, "page_id long, url string")
    lists = spark.createDataFrame([], "url string")
    rules = spark.createDataFrame([("net", "/", "allow"), ("net", "/", "block")], "host string, path string, verdict string")
    got = Counter((x.page_id, x.rule, x.verdict) for x in url_filter.url_filter(page, lists, rules).collect())
    assert got == {(None, "net/", "block"): 5, (1, None, "allow"): 2}
    assert {x.verdict for x in url_filter.url_filter(page, lists, rules.where("false")).collect()} == {"allow"}
    assert url_filter.url_filter(page.where("false"), lists, rules).count() == 0


# spelling variants


def plain_words(docs):
    n = Counter()
    for i, t in docs:
        for run in re.findall("[A-Za-z\u00c0-\u00ff]+", t or ""):
            run = low(run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += len(run) >= 7
    return {w: k for w, k in n.items() if k >= 2}


def near(a, b):
    if len(a) < len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(a) == len(b) + 1 and any(a[:i] + a[i + 1 :] == b for i in range(len(a)))


def plain_variants(words):
    links = defaultdict(list)
    for a in words:
        for b in words:
            if a < b and near(a, b):
                links[a].append(b)
                links[b].append(a)
    form = {a: min(bs, key=lambda b: (-words[b], b)) for a, bs in links.items()}
    form = {a: b for a, b in form.items() if words[b] >= 10 * words[a]}

    def root(w):
        while w in form:
            w = form[w]
        return w

    return {(w, form.get(w), root(w), n, len(links[w]), words.get(form.get(w))) for w, n in words.items()}


def test_variants_equal_a_plain_version(spark):
    r = random.Random(5)
    stems = ["".join(r.choice("aeinrtsé\u00d7") for _ in range(r.randint(7, 12))) for _ in range(12)] + ["aaaaaaa", "aaaaaaaa", "ababababab", "b" * 47, "c" * 48, "d" * 49, "de" * 30]

    def typo(w):
        i = r.randrange(len(w))
        return r.choice([w[:i] + w[i + 1 :], w[:i] + r.choice("aetx") + w[i:], w[:i] + r.choice("aetx") + w[i + 1 :]])

    texts = []
    for _ in range(300):
        line = [r.choice(stems) for _ in range(12)]
        texts.append(" ".join(typo(typo(w)) if r.random() < 0.05 else typo(w) if r.random() < 0.2 else w.upper() if r.random() < 0.1 else w for w in line))
    docs = [(i, t) for i, t in enumerate(texts)] + [(None, texts[0]), (7, texts[0]), (7, None), (8, ""), (9, "short words 123"), (10, "chaining " * 300 + "chainingx " * 25 + "chaininxx " * 2)]
    rows = spark.createDataFrame([(i, t, "w", 1) for i, t in docs], "doc_id long, text string, word string, n int")
    got = spelling.spelling_variants(rows, damage=31).collect()
    assert len(got) == len({x.word for x in got})
    assert {tuple(x) for x in got} == plain_variants(plain_words(docs))
    assert any(x.form and x.root != x.form for x in got)


@pytest.mark.parametrize("symbols", [1, 4, 26])
def test_near_pairs_for_any_alphabet(spark, symbols):
    r = random.Random(symbols)
    words = {"".join(r.choice("ab") for _ in range(r.randint(1, 8))) for _ in range(90)} | {"x" * n for n in range(45, 53)} | {"x" * 20 + "y" + "x" * n for n in range(25, 32)}
    table = spark.createDataFrame([(w, i) for i, w in enumerate(sorted(words))], "word string, n long")
    got = [frozenset((x.word, x.near)) for x in spelling.near_pairs(table, symbols).collect()]
    assert len(got) == len(set(got))
    assert set(got) == {frozenset((a, b)) for a in words for b in words if a < b and near(a, b)}


def test_long_chains_lead_to_the_last_form(spark):
    forms = spark.createDataFrame([(f"w{i}", f"w{i + 1}") for i in range(11)], "word string, form string")
    assert {x.root for x in spelling.roots(forms).collect()} == {"w11"}


def test_variants_of_an_empty_table(spark):
    assert spelling.spelling_variants(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_more_words_take_more_symbols():
    assert spelling.symbols_for(0) == spelling.symbols_for(1_000_000) == 4 < spelling.symbols_for(10**9) <= spelling.symbols_for(10**15) == 26
