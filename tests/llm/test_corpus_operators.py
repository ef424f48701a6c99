"""Operators over whole tables, against plain versions."""

import hashlib
import random
import re
import time
from collections import defaultdict
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from rillflow import scratch
from rillflow.llm import decontaminate, embedding_dedup, graph, line_dedup, mixing, ngram_join, quality, tables

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def table(spark, texts):
    rows = [(i, t, f"s{i % 4}" if i % 9 else None, "a", 1) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, key string, n int")


def near_texts(seed, base=6, copies=12, words=80):
    """Groups of texts that differ in a few words, exact copies, and texts around a common passage."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 5)))
    passage = [word() for _ in range(60)]
    out = [None, "", "  ", "One", "one", "one two", "a b c"]
    for _ in range(base):
        text = [word() for _ in range(r.randint(8, words))]
        for _ in range(copies):
            t = list(text)
            for _ in range(r.randint(0, max(1, len(t) // 20))):
                t[r.randrange(len(t))] = word()
            out.append(" ".join(t))
        out.append(" ".join(text).upper())
    out += [" ".join([word() for _ in range(r.randint(1, 25))] + passage) for _ in range(40)]
    r.shuffle(out)
    return out


def sets_of(texts, size):
    out = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        out.append({tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set())
    return out


def roots(n, links):
    low = list(range(n))

    def find(x):
        while low[x] != x:
            x = low[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        low[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


@pytest.mark.parametrize(("size", "num", "seed"), [(3, 90, 1), (5, 80, 2), (2, 60, 3)])
def test_ngram_join(spark, monkeypatch, size, num, seed):
    monkeypatch.setattr(ngram_join, "BLOCK", 4)
    texts = near_texts(seed)
    sets = sets_of(texts, size)
    links = [(i, j) for j in range(len(sets)) for i in range(j) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j])]
    want = roots(len(texts), links)
    got = {r.doc_id: r for r in ngram_join.ngram_join(table(spark, texts), size=size, num=num).collect()}
    assert len(got) == len(texts)
    assert [got[i].n_shingles for i in range(len(texts))] == [len(s) for s in sets]
    assert [got[i].component_id for i in range(len(texts))] == want
    kept = ngram_join.keep_one(table(spark, texts), size=size, num=num)
    assert {r.doc_id for r in kept.collect()} == {i for i, c in enumerate(want) if i == c}
    assert kept.columns == table(spark, []).columns


def test_ngram_join_of_repeated_and_null_ids(spark):
    rows = spark.createDataFrame([(1, "a b c d"), (1, "a b c d"), (None, "A b c d"), (2, None), (0, "x y z")], "doc_id long, text string")
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_shingles, r.component_id) for r in ngram_join.ngram_join(rows).collect())
    assert got == [(-1, 2, 1), (0, 1, 0), (1, 2, 1), (2, 0, 2)]
    assert ngram_join.ngram_join(rows.limit(0)).count() == 0


def test_bands_give_enough_parts():
    for num in (60, 80, 90, 97):
        bands = ngram_join.Bands(num, 100)
        for n in (*range(1, 60), 500, 4001):
            entered = {b for b, _, _ in bands.of(n)}
            for m in range(1, n + 1):
                if m * 100 >= n * num:
                    common = entered & {b for b, _, _ in bands.of(m)}
                    small = int(np.searchsorted(bands.low, m, "right")) - 1
                    assert small in common
                    assert bands.parts(small) > bands.differing(small) >= (100 - num) * (n + m) // (100 + num)
                    for x in (n, m):  # no more parts differ than told
                        assert {b: d for b, _, d in bands.of(x)}[small] >= (100 - num) * (n + m) // (100 + num)


@pytest.mark.parametrize(("num", "size"), [(90, 3), (80, 5)])
def test_ngram_join_of_long_texts(spark, monkeypatch, num, size):
    """Sets of 400 to 5,000 shingles at similarities just above and below the threshold, around hot tiles."""
    monkeypatch.setattr(tables, "HOT_ROWS", 3)
    r = random.Random(num)
    texts = []
    for n in (400, 401, 640, 1000, 1700, 5000):
        text = [f"w{r.randrange(10**6)}" for _ in range(n)]
        texts.append(" ".join(text))
        differ = (100 - num) / (100 + num) * n  # shingles of each side that differ at the threshold
        for k in (0.3, 0.9, 1.0, 1.02, 1.1):
            t = list(text)
            for at in r.sample(range(n // (2 * size) - 1), int(differ * k / size)):
                t[at * 2 * size + size] += f"z{k}"
            texts += [" ".join(t), " ".join(t[: int(len(t) * (num + 1) / 100)])]
    sets = sets_of(texts, size)
    links = [(i, j) for j in range(len(sets)) for i in range(j) if 100 * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j])]
    want = roots(len(texts), links)
    got = {x.doc_id: x.component_id for x in ngram_join.ngram_join(table(spark, texts), size=size, num=num).collect()}
    assert [got[i] for i in range(len(texts))] == want and len(set(want)) > 6


@pytest.mark.parametrize("wanted", [3, 10**6])
def test_ngram_join_in_passes(spark, monkeypatch, wanted):
    """Texts of pairs in several passes, with ids broadcast and joined, give the same components."""
    texts = near_texts(4)
    plain = sorted(ngram_join.ngram_join(table(spark, texts), size=5, num=80).collect())
    monkeypatch.setattr(ngram_join, "PASS_SHINGLES", 100)
    monkeypatch.setattr(ngram_join, "WANTED_ROWS", wanted)
    monkeypatch.setattr(ngram_join, "BLOCK", 4)
    monkeypatch.setattr(tables, "HOT_ROWS", 3)
    monkeypatch.setattr(tables, "saved_parts", lambda parts, name, write=tables.saved_parts: write((passes.append(name) or df for df in parts), name))
    passes = []
    assert sorted(ngram_join.ngram_join(table(spark, texts), size=5, num=80).collect()) == plain
    assert passes.count("tiles") == 1 and passes.count("links") > 2
    assert len({r.component_id for r in plain}) < len(texts) - 40


def test_keep_one_leaves_no_keys_texts_or_shuffles(spark):
    """What the join has read no more is deleted, and so are the shuffles of sets and texts (many times the texts before)."""
    sizes = lambda: sum(Path(p).stat().st_size for p in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString(" ").split() if "/shuffle_" in p and Path(p).exists())
    r = random.Random(8)
    texts = []
    for _ in range(20):
        text = [f"w{r.randrange(10**6)}" for _ in range(2000)]
        texts += [" ".join(text[:at] + ["other"] + text[at:]) for at in (0, 700, 1400, 1400)]
    docs = table(spark, texts).localCheckpoint()
    n, before = len(scratch._WRITTEN), sizes()
    kept = ngram_join.keep_one(docs)
    assert {x.doc_id for x in kept.collect()} == set(range(0, 80, 4))
    names = {p.rsplit("/", 1)[1].rsplit("-", 1)[0] for p in scratch._WRITTEN[n:]}
    assert "copies" in names and not names & {"signatures", "class-heads", "equal-sets", "leaders", "tiles", "wanted", "texts", "lead-texts", "mixed", "mixed-tiles"}
    until = time.time() + 10
    while sizes() - before > sum(map(len, texts)) / 10 and time.time() < until:
        time.sleep(0.1)
    assert sizes() - before < sum(map(len, texts)) / 10


def test_stages_carry_columns_of_any_name(spark):
    names = ["_held", "_copy", "_score", "_quality_score", "_text", "k1", "k2", "key", "row", "score", "label", "_size", "_of", "n"]
    texts = ["one two three four five six seven", "one two three four five six seven", None, "", "other words here now and then too"]
    docs = spark.createDataFrame([(i, t, "s", *["x"] * len(names)) for i, t in enumerate(texts)], "doc_id long, text string, source string, " + ", ".join(f"{n} string" for n in names))
    items = spark.createDataFrame([(1, "other words here now and then")], "item_id long, text string")
    labels = spark.createDataFrame([(0, 1), (4, 0)], "doc_id long, quality int")
    for kept in (decontaminate.decontaminate(docs, items), ngram_join.keep_one(docs), quality.keep_quality(docs, labels, F.lit(True), 0.0), mixing.mix(docs)):
        assert kept.columns == docs.columns
        rows = kept.collect()
        assert rows and all(r["_held"] == "x" and r["n"] == "x" for r in rows)
    assert {r.doc_id for r in ngram_join.keep_one(docs).collect()} == {0, 2, 3, 4}
    assert {r.doc_id for r in decontaminate.decontaminate(docs, items).collect()} == {0, 1, 2, 3}
    assert ngram_join.keep_one(docs.unionByName(docs)).count() == 4  # rows that repeat an id
    for empty in (decontaminate.decontaminate(docs.limit(0), items), ngram_join.keep_one(docs.limit(0)), quality.keep_quality(docs.limit(0), labels, F.lit(True)), mixing.mix(docs.limit(0))):
        assert empty.count() == 0 and empty.columns == docs.columns


def test_components(spark):
    r = random.Random(4)
    links = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 460)] + [(500, 500 + i) for i in range(90)]
    want = roots(700, links)
    got = {x.node: x.component for x in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(want[n] == c for n, c in got.items())
    assert set(got) == {x for a, b in links if a != b for x in (a, b)}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize(("most", "cell"), [(2_000_000, 1000), (50, 1000), (50, 2)])  # items that are sent, joined, and joined by many cells
def test_decontaminate(spark, monkeypatch, most, cell):
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", most)
    monkeypatch.setattr(decontaminate, "CELL_ROWS", cell)
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(3))
    items = [" ".join(word() for _ in range(r.randint(5, 40))) for _ in range(30)] + ["tiny one", None, "", "..."]
    texts = [None, "", "a tiny, one!", "Tiny one"]
    for _ in range(60):
        t = [word() for _ in range(r.randint(0, 300))]
        for _ in range(r.randint(0, 3)):
            own = r.choice(items[:30]).split()
            own[r.randrange(len(own))] = r.choice([own[0], "zzz"])
            k = r.randint(0, len(t))
            t[k:k] = [w.upper() + "***" for w in own]
        texts.append(" ".join(t))
    items_df = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    plain = lambda t: re.findall(r"[^\x20\x09-\x0D]+", re.sub(r"[!-/:-@\[-`{-~]", "", (t or "").translate(LOWER)))
    want = set()
    for i, t in enumerate(texts):
        for k, item in enumerate(items):
            w, own = plain(t), plain(item)
            n = min(5, len(own))
            if not n:
                continue
            grams = lambda x, n=n: {tuple(x[a : a + n]) for a in range(len(x) - n + 1)}
            shared = len(grams(w) & grams(own))
            if shared >= 0.8 * len(grams(own)) - 1e-9:
                want.add((i, k, shared, len(grams(own))))
    docs = table(spark, texts)
    got = {(x.doc_id, x.item_id, x.shared, x.item_shingles) for x in decontaminate.contained_items(docs, items_df).collect()}
    assert got == want and len(want) > 20
    clean = decontaminate.decontaminate(docs, items_df)
    assert {x.doc_id for x in clean.collect()} == set(range(len(texts))) - {x[0] for x in want}
    assert clean.columns == docs.columns
    assert decontaminate.contained_items(docs, items_df.limit(0)).count() == 0
    assert decontaminate.contained_items(docs.limit(0), items_df).count() == 0


def test_decontaminate_joins_rows_that_repeat(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", 6)
    monkeypatch.setattr(tables, "HOT_ROWS", 4)
    monkeypatch.setattr(tables, "HOT_KEYS", 10)
    items = spark.createDataFrame([(i % 3 or None, "one two three four five six" if i % 4 else "aa bb") for i in range(20)], "item_id int, text string")
    docs = spark.createDataFrame([(d, "x One two, three four five six y" if i % 2 else "aa bb") for i, d in enumerate([None, 1, 1, 2, None, 3] * 5)], "doc_id int, text string")
    got = [tuple(x) for x in decontaminate.contained_items(docs, items).collect()]
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", 2_000_000)
    want = [tuple(x) for x in decontaminate.contained_items(docs, items).collect()]
    assert len(want) == 15 * 15 + 15 * 5 and sorted(map(str, got)) == sorted(map(str, want))
    assert decontaminate.decontaminate(docs, items).count() == 0


def test_decontaminate_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", 6)
    items = spark.createDataFrame([(i, f"w{i} x{i} y{i} z{i} q{i} r{i}") for i in range(5)], "item_id long, text string")
    docs = table(spark, [f"b w{i} x{i} y{i} z{i} q{i} r{i} e" for i in range(5)])
    assert {(x.doc_id, x.item_id) for x in decontaminate.contained_items(docs, items).collect()} == {(i, i) for i in range(5)}


def plain_line_dedup(texts):
    seen, out = set(), []
    for t in texts:
        lines = (t or "").split("\n")
        filled = [(i, x.strip(" ")) for i, x in enumerate(lines) if x.strip(" ")]
        windows = [filled[:3]] if 0 < len(filled) < 3 else [filled[k : k + 3] for k in range(len(filled) - 2)]
        gone = set()
        for w in windows:
            key = tuple(x for _, x in w)
            if key in seen:
                gone |= {i for i, _ in w}
            seen.add(key)
        out.append((len(lines), len(gone), "\n".join(x for i, x in enumerate(lines) if i not in gone)))
    return out


def test_line_dedup(spark):
    r = random.Random(6)
    texts = [None, "", "\n", "a\na\na\na\na", " x \n\ny", "x\ny", "A\nB\nC\nA\nB\nC", "z\nA\nB\nC\nD"]
    texts += ["\n".join(r.choice(["a", "b", "c", "", " d ", "long line"]) for _ in range(r.randint(0, 12))) for _ in range(120)]
    got = {x.doc_id: (x.n_lines, x.n_removed, x.text) for x in line_dedup.line_dedup(table(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == plain_line_dedup(texts)
    assert line_dedup.line_dedup(table(spark, [])).count() == 0


def test_line_dedup_of_repeated_rows(spark):
    rows = spark.createDataFrame([(1, "a\nb\nc"), (1, "a\nb\nc"), (None, "a\nb\nc"), (2, "a\nb\nc\nd")], "doc_id long, text string")
    got = sorted((x.doc_id or -1, x.text) for x in line_dedup.line_dedup(rows).collect())
    assert got == [(-1, "a\nb\nc"), (1, ""), (1, ""), (2, "d")]


def water_level(sizes, weights, cap=3):
    total, capped, target = sum(sizes), set(), [0.0] * len(sizes)
    while True:
        free = [i for i in range(len(sizes)) if i not in capped]
        level = (total - sum(cap * sizes[i] for i in capped)) / max(1, sum(weights[i] for i in free))
        over = [i for i in free if level * weights[i] > cap * sizes[i]]
        if not over:
            for i in range(len(sizes)):
                target[i] = cap * sizes[i] if i in capped else level * weights[i]
            return target
        capped |= set(over)


def test_mixing(spark):
    r = random.Random(7)
    texts = [None, "", "\t"] + [" ".join("w" for _ in range(r.choice([1, 5, 40, 300]))) for _ in range(900)]
    names = ["b", "a", "é", None, "Z", "c", "tiny"]
    rows = [(i, t, "tiny" if i < 8 else names[r.choice([0, 0, 0, 0, 1, 2, 3, 4, 5])], "x") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, taken string")
    got = mixing.mix_plan(docs).collect()
    size = defaultdict(int)
    for i, t, s, _ in rows:
        size[s] += len((t or "").split())
    order = [*sorted((s for s in size if s is not None), key=lambda s: s.encode()), None]
    target = dict(zip(order, water_level([size[s] for s in order], [(5, 2, 1)[k % 3] for k in range(len(order))]), strict=True))
    source = {i: s for i, _, s, _ in rows}
    draws = defaultdict(lambda: [0] * mixing.SEEDS)
    drawn = {}
    for x in got:
        s = source[x.doc_id]
        assert x.size == len((texts[x.doc_id] or "").split()) and x.source_size == size[s]
        assert x.target == pytest.approx(target[s]) and x.taken <= 3 * x.size
        rate = target[s] / size[s] if size[s] else 0
        u = int(hashlib.md5(f"17:{x.doc_id}".encode()).hexdigest()[:13], 16) / 2**52
        drawn[x.doc_id] = [int(rate) + ((u + k * mixing.STEP) % 1 < rate - int(rate)) for k in range(mixing.SEEDS)]
        draws[s] = [a + x.size * n for a, n in zip(draws[s], drawn[x.doc_id], strict=True)]
    best = {s: min(range(mixing.SEEDS), key=lambda k: abs(draws[s][k] - target[s])) for s in order}
    assert all(x.copies == drawn[x.doc_id][best[source[x.doc_id]]] for x in got)
    for s in order:
        assert abs(draws[s][best[s]] - target[s]) <= 0.02 * target[s] + 300 * (s == "tiny")
    again = {x.doc_id: x.taken for x in mixing.mix_plan(docs.repartition(3)).collect()}
    assert again == {x.doc_id: x.taken for x in got}
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    copies = {x.doc_id: x["count"] for x in mixed.groupBy("doc_id").count().collect()}
    assert copies == {x.doc_id: x.copies for x in got if x.copies}
    assert mixing.mix_plan(docs.limit(0)).count() == 0


def test_embedding_links(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", 16)
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(20, 32))
    vectors = np.concatenate([c + rng.normal(size=(40, 32)) * s for c, s in zip(centres, np.linspace(0.02, 0.35, 20), strict=True)]).astype(np.float32)
    vectors[50] = vectors[51] = vectors[52]
    rows = [(i, v.tolist(), int(i // 40 % 3)) for i, v in enumerate(vectors)]
    rows += [(900, None, 1), (901, [0.0] * 32, 1), (902, [float("nan")] * 32, 1), (903, [None] * 32, 1), (904, vectors[0].tolist(), None), (905, [], 1), (906, [1.0, 2.0], 1), (52, vectors[52].tolist(), rows[52][2])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {x.vec_id: x for x in embedding_dedup.embedding_links(df).collect()}
    assert len(got) == len(rows) - 1
    x = vectors.astype(float) / np.linalg.norm(vectors.astype(float), axis=1, keepdims=True)
    label = np.array([r[2] for r in rows[:800]])
    linked = (x @ x.T >= 0.93) & (label[:, None] == label[None, :])
    np.fill_diagonal(linked, False)
    want, have = linked.sum(1), np.array([got[i].n_links for i in range(800)])
    assert (have <= want).all() and have.sum() >= 0.97 * want.sum()
    low = roots(800, list(zip(*np.nonzero(linked), strict=True)))
    assert np.mean([got[i].component_id == low[i] for i in range(800)]) > 0.97
    for i in range(900, 907):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)
    assert embedding_dedup.embedding_links(df.limit(0)).count() == 0


def test_estimates_are_unbiased():
    rng = np.random.default_rng(9)
    a = rng.normal(size=64)
    b = a + rng.normal(size=64) * 0.5
    a, b = a / np.linalg.norm(a), b / np.linalg.norm(b)
    told = []
    for seed in range(200):
        q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(256, 64)))
        q = q * np.sign(np.diag(r))
        y = q @ a
        told.append(np.sign(y) @ (q @ b) / np.abs(y).sum())
    assert abs(np.mean(told) - a @ b) < 4 * np.std(told) / np.sqrt(200)


def test_pipeline_stages(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, sf)
        assert kept.columns == names, name
        ids = {r.doc_id for r in docs.select("doc_id").collect()}
        left = [r.doc_id for r in kept.select("doc_id").collect()]
        assert set(left) <= ids and left
        if name == "n-gram Jaccard join":
            texts = {r.doc_id: r.text for r in docs.collect()}
            order = sorted(texts)
            sets = sets_of([texts[i] for i in order], 5)
            links = [(i, j) for j in range(len(sets)) for i in range(j) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
            low = roots(len(order), links)
            assert set(left) == {order[i] for i, c in enumerate(low) if c == i}
        docs = kept
    out = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert out.count() == docs.count() and out.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert corpus_pipeline.run(spark, sf).count() == out.count()
    assert out.agg(F.max(F.col("start") + F.col("n_tokens")).alias("n")).first().n == out.agg(F.sum("n_tokens").alias("n")).first().n


def test_line_dedup_of_long_passages(spark):
    one, two = " ".join(f"w{i}" for i in range(60)), "\n".join(" ".join(f"{k}{i}" for i in range(30)) for k in "ab")
    texts = [f"x\n{one}\ny", f"p\n{one}\nq", f"r\n{two}\ns\nt", f"u\n{two}\nv\nz", "p\nshort line\nv", "q\nshort line\nz", one]
    kept = [x.text for x in line_dedup.line_dedup(table(spark, texts), passage=50).orderBy("doc_id").collect()]
    assert kept == [texts[0], "p\nq", texts[2], "u\nv\nz", texts[4], texts[5], ""]


def plain_passage_dedup(texts, passage):
    first, windows = {}, []
    for i, t in enumerate(texts):
        filled = [(p, x.strip(" ")) for p, x in enumerate((t or "").split("\n")) if x.strip(" ")]
        runs = [(0, len(filled))] if 0 < len(filled) < 3 else [(j, 3) for j in range(len(filled) - 2)]
        runs += [(j, k) for k in (1, 2) for j in range(len(filled) - k + 1) if sum(len(x.split()) for _, x in filled[j : j + k]) >= passage]
        for j, k in runs:
            key = tuple(x for _, x in filled[j : j + k])
            first[key] = min(first.get(key, (i, j)), (i, j))
            windows.append((i, j, key, [p for p, _ in filled[j : j + k]]))
    gone = {(i, p) for i, j, key, places in windows if (i, j) > first[key] for p in places}
    return ["\n".join(x for p, x in enumerate((t or "").split("\n")) if (i, p) not in gone) for i, t in enumerate(texts)]


def test_line_dedup_of_passages_and_hot_windows(spark, monkeypatch):
    monkeypatch.setattr(tables, "HOT_ROWS", 4)
    r = random.Random(12)
    lines = ["a b c", "one two three four five six", "x y", "p q r s", "", " u v w "]
    texts = ["\n".join(r.choice(lines) for _ in range(r.randint(0, 9))) for _ in range(80)] + ["l1\nl2\nl3\n" + str(i) for i in range(30)]
    docs = table(spark, texts)
    want = plain_passage_dedup(texts, 5)
    for most in (1_000_000, 0):  # sent, and joined
        monkeypatch.setattr(line_dedup, "SENT_PLACES", most)
        assert [x.text for x in line_dedup.line_dedup(docs, passage=5).orderBy("doc_id").collect()] == want
    clash = docs.select("doc_id", "text", *[F.lit("z").alias(n) for n in ("places", "_whole", "lines", "filled", "covered", "h1", "j")])
    assert [x.text for x in line_dedup.line_dedup(clash, passage=5).orderBy("doc_id").collect()] == want


def test_line_dedup_of_a_very_long_document(spark):
    long = "\n".join(f"line {i}" for i in range(100_000))
    got = {x.doc_id: (x.n_lines, x.n_removed) for x in line_dedup.line_dedup(table(spark, [long, long, "a"])).collect()}
    assert got == {0: (100_000, 0), 1: (100_000, 100_000), 2: (1, 0)}


def test_vectors_of_extreme_size(spark):
    rows = [(1, [1e-200, 1e-200], 0), (2, [1e-200, 1e-200], 0), (3, [1.0, 1.0], 0), (4, [2e200, 2e200], 0), (5, [5e-324, 0.0], 0), (6, [1e308, 0.0], 0), (7, [-1e308, 1e-300], 0), (8, [1e300, 1.2e300], 0)]
    got = {x.vec_id: (x.n_links, x.component_id) for x in embedding_dedup.embedding_links(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert got == {**dict.fromkeys((1, 2, 3, 4, 8), (4, 1)), 5: (1, 5), 6: (1, 5), 7: (0, 7)}


def test_item_ids_of_other_types(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g"), (2, "h i j k l m")], "doc_id int, text string")
    for kind in ("int", "short", "string", "date"):
        items = spark.sql(f"select cast({'current_date()' if kind == 'date' else '7'} as {kind}) as item_id, 'b c d e f' as text")
        found = decontaminate.contained_items(docs, items)
        assert found.schema["item_id"].dataType == items.schema["item_id"].dataType and [r.doc_id for r in found.collect()] == [1]
