"""Neighbour search, prefix trie and spelling variants against plain definitions, and their defined edge cases."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskgrain.llm import neighbours, prefix_trie, spelling

VECTORS = "vec_id long, embedding array<double>, query_id string, score string, id string, vec string"
TURNS = "conv_id long, turn long, role string, text string, c string, depth string, n_convs string"


# 11

def plain_neighbours(rows, asked, k=10):
    """Exact nearest ids by numpy."""
    good = [(i, np.array(v, float)) for i, v in rows
            if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    found = {}
    for q, a in good:
        if asked(q):
            for i, b in good:
                if i != q and len(a) == len(b):
                    pair = found.setdefault(q, {})
                    pair[i] = min(pair.get(i, math.inf), float(np.sqrt(((a - b) ** 2).sum())))
    return {q: sorted((d, i) for i, d in hits.items())[:k] for q, hits in found.items()}


def ranked(df):
    out = defaultdict(list)
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out[r["query_id"]].append((r["score"], r["vec_id"]))
        assert r["rank"] == len(out[r["query_id"]])
    return dict(out)


def test_neighbours_recall(spark, sf):
    for folder in (sf, "/root/testdata/sf0.1"):
        table = spark.read.parquet(f"{folder}/embeddings.parquet")
        rows = [(r[0], r[1]) for r in table.select("vec_id", "embedding").collect()]
        want = plain_neighbours(rows, lambda q: q % 100 == 0)
        found = ranked(neighbours.nearest(table, F.col("vec_id") % 100 == 0))
        assert found.keys() == want.keys() and all(len(h) == 10 for h in found.values())
        exact = {(q, i): d for q in want for i, d in ((i, d) for d, i in want[q])}
        hits = [(q, i) for q in found for _, i in found[q] if (q, i) in exact]
        assert len(hits) >= 0.9 * len(exact)
        assert all(d == exact[q, i] for q in found for d, i in found[q] if (q, i) in exact)
        assert all(h == sorted(h) for h in found.values())


def odd_vectors(spark):
    rows = [
        (0, [1.0, 2.0, 3.0]), (1, [1.0, 2.0, 3.5]), (2, [1.0, 2.0, 2.5]), (2, [1.0, 2.0, 2.5]), (3, None), (4, []), (5, [0.0, 0.0, -0.0]),
        (6, [1.0, None, 3.0]), (7, [1.0, float("nan"), 3.0]), (8, [1.0, float("inf"), 3.0]), (None, [1.0, 2.0, 3.0]),
        (100, [-1.0, -2.0, -3.0]), (100, [-1.0, -2.0, -3.1]), (9, [5.0]), (200, [6.0]), (10, [-5.0]), (300, [1.0, 1.0, 1.0, 1.0, 1.0]),
        (400, [0.0, 0.0, 0.0]), (500, [1e-200, 0.0, 1e-200]), (11, [1e9, 2.0, 3.0])]
    return rows, spark.createDataFrame([(*r, "x", "x", "x", "x") for r in rows], VECTORS)


def test_neighbours_of_odd_rows(spark):
    rows, table = odd_vectors(spark)
    want = plain_neighbours(rows, lambda q: q % 100 == 0)
    assert ranked(neighbours.nearest(table, F.col("vec_id") % 100 == 0)) == want
    assert 300 not in want and 400 not in want and len(want[0]) < 10
    assert neighbours.nearest(table.limit(0), F.col("vec_id") % 100 == 0).count() == 0


def test_neighbours_in_a_hot_direction(spark, monkeypatch):
    """A third of the rows are copies or near copies of one vector; blocks of few rows and queries change nothing."""
    rng = np.random.default_rng(5)
    rows = [(i, (rng.normal(size=16) if i % 3 else np.arange(16.0) + (1e-9 * rng.normal(size=16) if i % 2 else 0)).tolist()) for i in range(1500)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want = plain_neighbours(rows, lambda q: q % 50 == 0)
    plain = ranked(neighbours.nearest(table, F.col("vec_id") % 50 == 0))
    exact = {(q, i) for q in want for _, i in want[q]}
    assert sum((q, i) in exact for q in plain for _, i in plain[q]) >= 0.9 * len(exact)
    assert all(plain[q] == want[q] for q in want if q % 3 == 0 and q % 2 == 0)
    for name, value in (("BLOCK_ROWS", 40), ("LEAST_ROWS", 40), ("BLOCK_QUERIES", 7)):
        monkeypatch.setattr(neighbours, name, value)
    assert ranked(neighbours.nearest(table, F.col("vec_id") % 50 == 0)) == plain


def test_rotations_keep_distances():
    x = np.random.default_rng(1).normal(size=(20, 24))
    turned = neighbours.rotated(x, 3, 0)
    assert turned.shape == (20, 32) and np.allclose(turned @ turned.T, x @ x.T)
    assert np.allclose(neighbours.hadamard(np.eye(4)) @ neighbours.hadamard(np.eye(4)).T, 4 * np.eye(4))


def test_wanted_buckets_are_the_nearest():
    rng = np.random.default_rng(2)
    first, second = rng.normal(size=(5, 8)), rng.normal(size=(5, 4))
    found = neighbours.wanted_buckets(first, second, 9)
    for row in range(5):
        ends = [np.stack([r, -r], 1).ravel() for r in (first[row], second[row])]
        cost = {(a * 8 + b): (ends[0].max() - ends[0][a]) ** 2 + (ends[1].max() - ends[1][b]) ** 2 for a in range(16) for b in range(8)}
        assert sorted(cost, key=cost.get)[0] in found[row] and set(found[row]) == set(sorted(cost, key=cost.get)[:9])
    assert list(neighbours.nearest_axis(np.array([[0.1, -3.0], [2.0, 1.0]]))) == [3, 0]


# 12

def plain_trie(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            said = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()
            own[c].append(((turn is not None, turn or 0), said, len(text)))
    for c in own:
        own[c].sort()
    paths = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        paths[c] = [t[1:] for t in own.get(c - int(math.fmod(c, 100)), [])[:h] + own[c][h:]]
    members = defaultdict(list)
    for c, path in paths.items():
        for d in range(len(path) + 1):
            members[tuple(path[:d])].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    saved, leaves = Counter(), Counter()
    for node, convs in members.items():
        for d in range(len(node) + 1):
            leaves[node[:d]] += node not in children
            saved[node[:d]] += (len(convs) - 1) * node[-1][1] if node else 0
    out = set()
    for node, convs in members.items():
        ends = ",".join(str(c) for c in sorted(convs) if len(paths[c]) == len(node))
        out.add((min(convs), len(node), min(members[node[:-1]]) if node else None, len(convs), len(children.get(node, ())), leaves[node],
                 saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return out


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def trie_rows(df):
    found = [tuple(r) for r in df.select(COLUMNS).collect()]
    assert len(found) == len(set(found))
    return set(found)


def odd_turns():
    """Shared beginnings, a long conversation, a common first turn, nulls, ties, repeated rows."""
    rng, rows = random.Random(3), []
    for c in [*range(0, 60), *range(95, 130), 200, 250, 12_345, 12_300, 4_095, 4_096, 90_000]:
        for turn in range(rng.choice([0, 1, 2, 5, 9])):
            rows.append((c, turn, rng.choice(["user", "assistant"]), rng.choice(["Hallo", "ok", "", "größer \U0001f600"])))
    rows += [(300, t, "user", f"turn {t % 7}") for t in range(240)]
    rows += [(c, 0, "user", "hi") for c in range(400, 480)] + [(c, 1, "user", f"{c % 5}") for c in range(400, 480)]
    rows += [(7, None, None, None), (7, None, "user", None), (7, 3, None, "x"), (7, 3, "user", "x"), (7, 3, "user", "x"), (7, 3, "user", "x")]
    rows += [(None, 1, "user", "lost"), (None, None, None, None), (500, 1, "1:a", "b"), (501, 1, "1", ":ab")]
    return rows


@pytest.mark.parametrize("small", [False, True])
def test_trie_against_plain(spark, monkeypatch, small):
    if small:
        for name, value in (("RANGE_ROWS", 50), ("CHUNK", 8), ("RUN", 8), ("HEAVY", 0.02)):
            monkeypatch.setattr(prefix_trie, name, value)
    rows = odd_turns()
    table = spark.createDataFrame([(*r, "x", "x", "x") for r in rows], TURNS)
    assert trie_rows(prefix_trie.prefix_trie(table, rest=20 if small else prefix_trie.REST)) == plain_trie(rows)


def test_trie_of_empty_and_null(spark):
    empty = spark.createDataFrame([], TURNS)
    assert prefix_trie.prefix_trie(empty).count() == 0
    nothing = spark.createDataFrame([(None, 1, "user", "a", "x", "x", "x")], TURNS)
    assert prefix_trie.prefix_trie(nothing).count() == 0
    one = [(5, None, None, None)]
    assert trie_rows(prefix_trie.prefix_trie(spark.createDataFrame([(*one[0], "x", "x", "x")], TURNS))) == plain_trie(one)


def test_list_positions(spark):
    """A list in random order with weights, contracted to sixty elements."""
    rng = random.Random(4)
    ids = [(k, k % 3) for k in range(700)]
    rng.shuffle(ids)
    weights = [rng.randrange(1, 9) for _ in ids]
    after = [*ids[1:], (None, None)]
    table = spark.createDataFrame([(*i, *a, w) for i, a, w in zip(ids, after, weights)], "c long, s long, nc long, ns long, w long")
    found = {(r["c"], r["s"]): r["position"] for r in prefix_trie.list_positions(table, 60).collect()}
    assert found == dict(zip(ids, itertools.accumulate([0, *weights])))


# 13

def plain_words(docs, least=7, times=2):
    counts = Counter()
    for doc, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(ch.lower() if "A" <= ch <= "Z" else ch for ch in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 31 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            if len(run) >= least:
                counts[run] += 1
    return {w: n for w, n in counts.items() if n >= times}


def plain_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1:] == a for k in range(len(b)))


def plain_variants(docs):
    words = plain_words(docs)
    near = {w: [v for v in words if plain_edit(w, v)] for w in words}
    form = {}
    for w in words:
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        if best is not None and words[best] >= 10 * words[w]:
            form[w] = best
    out = {}
    for w in words:
        root = w
        while root in form:
            root = form[root]
        out[w] = (form.get(w), root, words[w], len(near[w]), words[form[w]] if w in form else None)
    return out


def spelled(df):
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()}


def letter_soup():
    """Words over few letters, so that many are near; a chain of forms; long and accented words."""
    rng = random.Random(9)
    words = ["".join(rng.choice("abcé") for _ in range(rng.choice([7, 8]))) for _ in range(150)]
    chain = ["Strasses", "Strassen", "Strasser"] + ["STRASSER"] * 9 + ["strassers"] * 200
    long = "wordlines" * 4_000
    docs = [(k, " ".join(rng.choices(words, k=60)) + ". " + " ".join(rng.choices(chain, k=80))) for k in range(40)]
    docs += [(50, f"{long} {long} {long}x-{long}x {long[:-1]}y,{long[:-1]}y"), (51, None), (52, ""), (None, "Straßenbahn straßenbahn ÀÉÎÕÜß àéîõüß×÷ " * 3)]
    return docs + [(53, "kurze Worte"), (53, "kurze Worte")] + [(k, "aaaaaaa1aaaaaab2") for k in range(60, 64)]


@pytest.mark.parametrize("tile", [spelling.TILE, 16])
def test_spelling_against_plain(spark, tile):
    docs = letter_soup()
    table = spark.createDataFrame([(*d, "x", "x", "x") for d in docs], "doc_id long, text string, word string, key string, n string")
    found = spelled(spelling.variants(table, tile=tile))
    want = plain_variants(docs)
    assert found == want and sum(v[0] is not None for v in want.values()) >= 5
    assert any(len(w) > 30_000 for w in found) and any(v[0] is not None and v[1] != v[0] for v in want.values())


def test_spelling_of_documents(spark, documents):
    docs = [(r[0], r[1]) for r in documents.select("doc_id", "text").collect()]
    assert spelled(spelling.variants(documents)) == plain_variants(docs)


def test_spelling_of_messy_rows(spark, messy, empty):
    assert spelling.variants(empty).count() == 0
    docs = [(r[0], r[1]) for r in messy.select("doc_id", "text").collect()]
    assert spelled(spelling.variants(messy)) == plain_variants(docs)


def test_one_edit_of_random_words():
    rng = random.Random(2)
    words = ["".join(rng.choice("ab") for _ in range(rng.choice([7, 8, 9]))) for _ in range(300)]
    codes = spelling._numbers(np.array(words, dtype=f"U{spelling.SHORT + 1}"))
    sizes = np.array([len(w) for w in words])
    i, j = (g.ravel() for g in np.indices((300, 300)))
    found = spelling.one_edit(codes[i], codes[j], sizes[i], sizes[j])
    close = abs(sizes[i] - sizes[j]) <= 1
    assert all(found[k] == plain_edit(words[i[k]], words[j[k]]) for k in np.flatnonzero(close)[::7])
    assert all(spelling.one_edit_text(words[i[k]], words[j[k]]) == plain_edit(words[i[k]], words[j[k]]) for k in np.flatnonzero(close)[::11])
