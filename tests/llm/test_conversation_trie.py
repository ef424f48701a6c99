"""The prefix trie of conversations, against a plain version that rebuilds every text."""

import hashlib
import random
import zlib
from collections import defaultdict

from pyspark.sql import functions as F

from rillflow.llm import conversation_trie, tables

TURNS = "conv_id long, turn long, role string, text string, depth int, FA string, size long"
OUT = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def table(spark, turns):
    return spark.createDataFrame([(*t, 1, "x", 2) for t in turns], TURNS)


def plain(turns):
    own = defaultdict(list)
    for c, turn, role, text in turns:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in own.items()}
    members, ends = defaultdict(set), defaultdict(list)
    for c in sorted(own):
        h, base = zlib.crc32(str(c).encode()) % 9, c - (c % 5 if c >= 0 else -(-c % 5))
        path = own.get(base, [])[:h] + own[c][h:]
        for d in range(len(path) + 1):
            members[tuple(path[:d])].add(c)
        ends[tuple(path)].append(c)
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    sums = {}
    for p in sorted(members, key=len, reverse=True):
        save = (len(members[p]) - 1) * len(p[-1][1].encode()) if p else 0
        sums[p] = (sum(sums[k][0] for k in children[p]) or 1, save + sum(sums[k][1] for k in children[p]))
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else -1, len(m), len(children[p]), *sums[p], hashlib.sha256(",".join(map(str, ends[p])).encode()).hexdigest()) for p, m in members.items())


def trie(spark, turns):
    rows = conversation_trie.prefix_trie(table(spark, turns)).select(*OUT).collect()
    return sorted((r[0], r[1], -1 if r[2] is None else r[2], *r[3:]) for r in rows)


def some_turns(seed, convs, most=12, texts=3):
    r = random.Random(seed)
    turns = []
    for c in range(-7, convs):
        if r.random() < 0.1:
            continue  # a base can be absent
        for turn in range(r.randint(1, most)):
            turns.append((c * r.choice([1, 1, 1, 3]), turn, r.choice(["user", "assistant", None]), r.choice(["", None, "é", "hi", "\U0001f600", "words"][:texts])))
    return turns


def test_trie_equals_a_plain_version(spark):
    turns = some_turns(1, 90)
    assert trie(spark, turns) == plain(turns)


def test_ties_nulls_repeated_rows_and_hot_conversations(spark, monkeypatch):
    monkeypatch.setattr(tables, "HOT_ROWS", 20)
    monkeypatch.setattr(conversation_trie, "BLOCK", 7)
    monkeypatch.setattr(conversation_trie, "CHUNK", 3)
    turns = some_turns(2, 40, most=4)
    turns += [(3, i // 3 if i % 50 else None, "user", "same") for i in range(400)]  # many ranges hold it
    turns += [(None, 1, "user", "no one"), (3, None, None, None)] + [(c, 0, "user", "common") for c in range(100, 160)]
    turns += [(4, 5, "user", "x" * 200_000), (4, 5, "user", "x" * 200_001)]
    assert trie(spark, turns) == plain(turns)


def test_growing_histories_hang_on_each_other(spark):
    turns = [(100 * c, i, "user", f"t{i}") for c in range(1, 21) for i in range(c)]
    turns += [(100 * c + 5, i, "user", f"t{i}" if i < c else f"other{c}") for c in range(1, 21) for i in range(c + 9)]
    assert trie(spark, turns) == plain(turns)


def test_a_colliding_seed_is_noticed(spark, monkeypatch):
    true, asked = conversation_trie.multipliers, []

    def weak_first(seed):
        asked.append(seed)
        return [1] * conversation_trie.LANES if seed == 0 else true(seed)  # sums that do not tell orders apart

    monkeypatch.setattr(conversation_trie, "multipliers", weak_first)
    turns = [(5 * c, i, "user", "ab"[(c >> i) % 2]) for c in range(40) for i in range(6)]
    assert trie(spark, turns) == plain(turns)
    assert {0, 1} <= set(asked)


def test_impure_keys_are_noticed(spark, monkeypatch):
    turns = table(spark, [(1, 0, "a", "b"), (2, 0, "a", "c")])
    assert conversation_trie.keys_are_pure(turns, 0)
    keyed = conversation_trie._keyed
    monkeypatch.setattr(conversation_trie, "_keyed", lambda t, s: keyed(t, s).withColumns({"k1": F.lit(1).cast("long"), "k2": F.lit(1).cast("long")}))
    assert not conversation_trie.keys_are_pure(turns, 0)


def test_empty_table(spark):
    assert conversation_trie.prefix_trie(table(spark, [])).count() == 0
