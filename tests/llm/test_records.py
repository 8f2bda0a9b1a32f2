import random
import re
from collections import defaultdict
from itertools import combinations

import numpy as np
import pytest

from quern.llm import consensus
from quern.llm.consensus import Consensus
from quern.llm.formatting import Copies, CountTrie
from quern.llm.neardup import Forest, NearDuplicates, components, near_pairs

FIELDS = ["actionable", "impact", "evidence"]
SCHEMA = "row_id long, actionable string, impact string, evidence string, uid int, keep_id int, words string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, "x") for r in rows], SCHEMA).repartition(3)


def content(r):
    return tuple(sorted("".join(c for c in (x or "") if c.isalnum()).lower() for x in r[1:4]))


def records(seed, n):
    rng = random.Random(seed)
    words = ["Alpha", "beta", "GAMMA", "delta-1", "épsilon", "zeta;", "42", "中文", "common", "prefix"]
    rows = []
    for i in range(n):
        if rows and rng.random() < 0.5:
            r = list(rng.choice(rows)[1:])
            rng.shuffle(r)
            r = [x and "".join(rng.choice([c, c.upper(), c + " ", c + "!"]) for c in x) if rng.random() < 0.8 else x for x in r]
        else:
            r = [rng.choice([None, "", "same long prefix of many records " + " ".join(rng.choices(words, k=rng.randint(1, 4)))]) for _ in range(3)]
        rows.append((i, *r))
    return rows


def test_trie():
    rng = random.Random(1)
    keys = [bytes(rng.choices(b"ab", k=rng.randint(0, 40))) for _ in range(3000)]
    trie, count = CountTrie(), defaultdict(int)
    for k in keys:
        t = trie.terminal(k)
        t[1:] = [(t[1] if len(t) > 1 else 0) + 1]
        count[k] += 1
    assert {t[0]: t[1] for t in trie.terminals()} == count


@pytest.mark.parametrize("bucket_rows,partial_rows", [(16_384, 200_000), (5, 7), (1, 1)])
def test_copies(spark, bucket_rows, partial_rows):
    rows = records(3, 300) + [(1000 + i, "Hot!", None, "copy" + " " * i) for i in range(200)] + [(None, "Hot", "", "copy"), (1000, "hot", "copy", "")]
    groups = defaultdict(list)
    for r in rows:
        if r[0] is not None:
            groups[content(r)].append(r[0])
    op = Copies(frame(spark, rows), "row_id", FIELDS, bucket_rows, partial_rows)
    found = sorted((r.keep_id, r.row_id) for r in op.found().collect())
    assert found == sorted((min(g), i) for g in groups.values() for i in g if i != min(g))
    assert sorted((r.keep_id, r.n_copies) for r in op.contents().collect()) == sorted((min(g), len(g)) for g in groups.values())
    if bucket_rows == 1:
        assert op.levels > 1


def test_no_records(spark):
    empty = frame(spark, [(1, "a", "b", "c")]).limit(0)
    assert Copies(empty, "row_id", FIELDS).found().count() == 0
    op = NearDuplicates(empty, "row_id", FIELDS)
    assert op.pairs().count() == 0 and op.groups().count() == 0


def word_set(r):
    return frozenset(re.findall(r"[^\W_]+", " ".join(x or "" for x in r[1:4]).lower()))


def edited(seed, n):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(n):
        if rows and rng.random() < 0.6:
            words = " ".join(x for x in rng.choice(rows)[1:] if x).split()
            for _ in range(rng.randint(0, 6)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
        else:
            words = rng.choices(vocabulary, k=rng.randint(15, 40))
        cut = rng.randint(0, len(words))
        rows.append((i, " ".join(words[:cut]).upper(), " ".join(words[cut:]), None))
    return rows


@pytest.mark.parametrize("shard_rows,threshold", [(4096, 0.7), (8, 0.7), (64, 0.85)])
def test_near_pairs_against_brute_force(spark, shard_rows, threshold):
    rows = edited(4, 500) + [(9000 + i, None, " ", "--") for i in range(5)] + [(None, "w1 w2", None, None)]
    sets = {r[0]: word_set(r) for r in rows if r[0] is not None}
    wanted = {(a, b) for a, b in combinations(sorted(sets), 2) if sets[a] and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]) - 1e-9}
    op = NearDuplicates(frame(spark, rows), "row_id", FIELDS, threshold, shard_rows=shard_rows)
    found = [(r.row_id_a, r.row_id_b) for r in op.pairs().collect()]
    assert len(found) == len(set(found)) and set(found) <= wanted
    assert len(wanted - set(found)) <= 0.002 * len(wanted)
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in found:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    groups = {r.row_id: r for r in op.groups().collect()}
    assert {i: r.group_id for i, r in groups.items() if sets[i]} == {i: root(i) for i in sets if sets[i]}
    links = defaultdict(set)
    for a, b in found:
        if sets[a] != sets[b]:
            links[a].add(sets[b])
            links[b].add(sets[a])
    assert all(r.n_links == len(links[i]) for i, r in groups.items())


def test_forest_loses_nothing_within_the_radius():
    rng = np.random.default_rng(3)
    sketch = rng.integers(0, 1 << 63, size=(400, 2), dtype=np.uint64)
    sketch[200:] = sketch[:200] ^ (np.uint64(1) << rng.integers(0, 63, size=(200, 2)).astype(np.uint64))
    sketch[300:320] = sketch[0]
    shard = np.sort(rng.integers(0, 5, 400))
    forest = Forest(sketch, shard, 5)
    radius = rng.integers(0, 70, 400)
    got = {(int(q), int(t)) for a, b, _ in forest.search(sketch, shard, radius, block=64) for q, t in zip(a, b)}
    distance = np.bitwise_count(sketch[:, None, :] ^ sketch[None, :, :]).sum(axis=2)
    assert got == {(i, j) for i in range(400) for j in range(400) if shard[i] == shard[j] and distance[i, j] <= radius[i]}


def test_components(spark):
    rng = random.Random(9)
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 140)] + [(rng.randint(200, 300), rng.randint(200, 300)) for _ in range(60)]
    parent = list(range(400))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for e in edges for x in e if e[0] != e[1] or x in got}


def test_consensus(spark):
    rng = random.Random(8)
    care = {"good": 0.95, "fair": 0.85, "poor": 0.6, "contrary": 0.2, "yes": None, "ok": 0.8, "able": 0.9}
    truth, rows = {}, []
    for i in range(400):
        item = f"I{i}"
        truth[item] = rng.random() < 0.4
        for a in rng.sample(sorted(care), 4):
            right = truth[item] if care[a] and rng.random() < care[a] else (True if care[a] is None else not truth[item])
            rows.append((item, a, i, rng.choice([" yes", "Y", "YES"] if right else ["no ", "N", "NO"]), rng.choice(["?", None, ""])))
            if rng.random() < 0.1:
                rows.append((item, a, i - 500, "no" if right else "yes", "yes"))
                rows.append(rows[-2])
    rows += [("I0", None, 1, "yes", "yes"), (None, "good", 1, "yes", "yes"), ("blank", "good", 1, "?", " ")]
    df = spark.createDataFrame(rows, "item string, who string, at int, f string, g string")
    op = Consensus(df, "item", "who", "at", ["f", "g"])
    got = {(r.item, r.field_name): r for r in op.labels().collect()}
    assert set(got) == {(i, f) for i in [*truth, "blank"] for f in ("f", "g")}
    right = sum((got[i, "f"].label == "YES") == t for i, t in truth.items())
    majority = 0
    votes = defaultdict(dict)
    for i, a, at, f, _ in sorted((r for r in rows if r[0] in truth and r[1]), key=lambda r: r[2]):
        votes[i][a] = f.strip()[0].upper() == "Y"
    for i, t in truth.items():
        majority += (sum(votes[i].values()) * 2 > len(votes[i])) == t
    assert right / 400 > 0.78 and right > majority + 10
    assert got["blank", "f"].agreement is None and got["blank", "f"].n_answers == 0
    r = {x.who: x.reliability for x in op.reliability().collect()}
    assert r["good"] > r["ok"] > r["poor"] > r["contrary"] and r["good"] > 0.88
    assert Consensus(df.limit(0), "item", "who", "at", ["f"]).labels().count() == 0


def test_consensus_paths_agree(spark, monkeypatch):
    """Arrays by item, flat edges for large items, and flat edges for many annotators give the same labels and rates."""
    rng = random.Random(3)
    rows = [(f"I{i % 60}", f"A{a}", i, rng.choice(["yes", "no", "no"] if i % 3 else ["yes", "yes", "no"]), rng.choice(["yes", "no", "?"])) for i in range(120) for a in range(6) if rng.random() < 0.6]
    df = spark.createDataFrame(rows, "item string, who string, at int, f string, g string")
    found = []
    for most, item_rows in ((50_000, 10_000), (50_000, 3), (0, 10_000)):
        monkeypatch.setattr(consensus, "MAX_BROADCAST", most)
        op = Consensus(df, "item", "who", "at", ["f", "g"], item_rows=item_rows)
        assert op.has_flat == ((most, item_rows) != (50_000, 10_000))
        labels = {(r.item, r.field_name): (r.label, round(r.belief, 6), r.n_answers) for r in op.labels().collect()}
        found.append((labels, {r.who: round(r.reliability, 6) for r in op.reliability().collect()}))
    assert found[0] == found[1] == found[2] and len(found[0][0]) == 120
    with pytest.raises(RuntimeError, match="didn't settle"):
        Consensus(df, "item", "who", "at", ["f"], rounds=2)
