"""Spelling groups and centroid clusters against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from lectern.llm import centroids, spelling


def one_apart(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute_groups(rows):
    n = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'null' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            n[run] += 1
    n = {w: c for w, c in n.items() if len(w) >= 6 and c >= 5}
    near = {w: [u for u in n if one_apart(w, u)] for w in n}
    form = {}
    for w in n:
        top = min(near[w], key=lambda u: (-n[u], u), default=None)
        form[w] = top if top and n[top] >= 5 * n[w] else None

    def root(w):
        return root(form[w]) if form[w] else w

    return sorted((w, form[w] or "", root(w), n[w], len(near[w]), n[form[w]] if form[w] else 0) for w in n)


def groups(df, **options):
    return sorted((r.word, r.form or "", r.root, r.n, r.n_near, r.form_n or 0) for r in spelling.spelling_groups(df, **options).collect())


@pytest.mark.parametrize("block", [spelling.BLOCK, 7])
def test_groups_are_those_of_brute_force_also_where_halves_are_crowded(spark, block):
    rng = random.Random(block)
    stems = ["prefix" + "".join(rng.choice("ab") for _ in range(rng.randint(0, 5))) for _ in range(40)]
    stems += ["".join(rng.choice("abÉé×") for _ in range(rng.randint(5, 9))) for _ in range(150)]
    weights = [5 ** rng.randint(0, 4) for _ in stems]
    rows = [(i if i % 9 else None, rng.choice([" ", "-", "1"]).join(rng.choices([*stems, "Prefixab", "PREFIXAB"], [*weights, 3, 3], k=120)))
            for i in range(150)]
    assert groups(spark.createDataFrame(rows, "doc_id long, text string"), block=block) == brute_groups(rows)


def test_words_of_odd_rows(spark, odd, none):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert groups(odd) == brute_groups(rows) and spelling.spelling_groups(none).count() == 0


def test_index_finds_every_edit():
    words = ["abcdef", "bcdefg", "abcdeg", "abcdefg", "abdefg", "aabcdef", "zabcdef", "abcdefz", "bcdefa", "abcxdef", "azcdef", "cdefab"]
    index = spelling.SlicedIndex(words)
    for w in [*words, "abcde", "xxxxxx", "", "abcdefgh"]:
        assert sorted(words[i] for i in index.near(w)) == sorted(u for u in words if one_apart(w, u)), w


def brute_clusters(rows, k=40, rounds=5):
    kept = [(i, [math.floor(256 * float(x)) for x in v]) for i, v in rows
            if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    key = lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1])
    centres = [v for _, v in sorted(kept, key=key)[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centres))

    for _ in range(rounds):
        at = [nearest(v)[1] for _, v in kept]
        for j in range(len(centres)):
            mine = [v for (_, v), a in zip(kept, at) if a == j]
            if mine:
                centres[j] = [sum(x) // len(mine) for x in zip(*mine)]
    found = [(i, *nearest(v)[::-1]) for i, v in kept]
    inertia = Counter()
    for _, c, d in found:
        inertia[c] += d
    return sorted((-1 if i is None else i, c, d, inertia[c], sum(inertia.values()),
                   hashlib.sha256(",".join(map(str, centres[c])).encode()).hexdigest()) for i, c, d in found)


def clusters(df):
    return sorted((-1 if r.vec_id is None else r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256)
                  for r in centroids.clusters(df).collect())


EMBEDDINGS = "vec_id long, embedding array<float>, cluster string, distance string, values int"


@pytest.mark.parametrize("n,spread", [(150, 1.0), (30, 0.01)])
def test_clusters_are_those_of_brute_force(spark, n, spread):
    rng = np.random.default_rng(n)
    rows = [(int(rng.integers(0, n)), np.float32(rng.normal(0, spread, 64)).tolist()) for _ in range(n)]
    rows += [(5, [0.0] * 64), (6, [0.0] * 64), (None, rows[0][1]), (1, None), (2, []), (3, [0.5] * 63), (4, [None] + [0.5] * 63),
             (5, [math.nan] + [0.5] * 63), (6, [math.inf] + [0.5] * 63), (7, [-0.0039] * 64), (7, [-0.0039] * 64), rows[1], rows[1]]
    frame = spark.createDataFrame([(i, v, "x", "y", 3) for i, v in rows], EMBEDDINGS)
    assert clusters(frame) == brute_clusters(rows)


def test_no_vectors_no_rows(spark):
    assert centroids.clusters(spark.createDataFrame([], EMBEDDINGS)).count() == 0


def test_ties_go_to_the_smaller_number_and_the_walk_stops_early():
    lists = centroids.SortedLists(np.array([[4, 0], [0, 0], [2, 2], [2, -2], [0, 0]]))
    number, distance = lists.nearest(np.array([[2, 0], [0, 0], [100, 0], [1, -1]]))
    assert number.tolist() == [0, 1, 0, 1] and distance.tolist() == [4, 0, 9216, 2]
    rng = np.random.default_rng(3)
    c = rng.integers(-5, 5, (40, 6))
    v = rng.integers(-6, 6, (500, 6))
    far = ((v[:, None] - c[None]) ** 2).sum(-1)
    number, distance = centroids.SortedLists(c).nearest(v)
    assert (number == far.argmin(1)).all() and (distance == far.min(1)).all()
