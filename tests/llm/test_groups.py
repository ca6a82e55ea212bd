"""Components, near-duplicate texts and vectors, and the pipeline, against brute force."""

import random

import numpy as np
import pytest

import corpus_pipeline
from lectern.llm import minhash, neighbours
from lectern.llm.components import components


def joined(nodes, edges):
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    return {n: root(n) for n in nodes}


def test_components_of_chains_stars_and_loops(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(100, 140)] + [(200, 200 + i) for i in range(30)] + [(7, 7), (5, 6), (6, 5)]
    edges += [(rng.randint(300, 400), rng.randint(300, 400)) for _ in range(70)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    nodes = {n for e in edges for n in e if e[0] != e[1]}
    want = joined(nodes, [e for e in edges if e[0] != e[1]])
    assert got == want
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def text(rng, n):
    return [f"w{rng.randint(0, 5000)}" for _ in range(n)]


def test_draws_agree_as_often_as_weights_overlap():
    rng = random.Random(3)
    idf = minhash.idf_table(100, np.random.default_rng(1).integers(0, 30, 1 << minhash.COUNTERS_LOG2))
    gaps = []
    for _ in range(60):
        a = text(rng, 150) + ["again and again and again and"] * 3
        b = list(a)
        for _ in range(rng.randint(0, 20)):
            b[rng.randrange(len(b))] = "other"
        a, b = (minhash.weighted(" ".join(x), idf) for x in (a, b))
        gaps.append((minhash.draws(*a, 64) == minhash.draws(*b, 64)).mean() - minhash.similarity(a, b))
    assert abs(np.mean(gaps)) < 0.02 and np.std(gaps) < 0.1


@pytest.fixture(scope="module")
def copies(spark):
    rng = random.Random(4)
    rows = {i: " ".join(text(rng, rng.randint(60, 200))) for i in range(150)}
    near = {}
    for k in range(40):
        words = rows[k].split()
        for _ in range(max(1, len(words) // 120)):
            words[rng.randrange(len(words))] = "changed"
        near[1000 + k] = k
        rows[1000 + k] = " ".join(words)
    rows |= {2000 + k: rows[60] for k in range(60)}
    base = text(rng, 300)
    for k in range(120):  # a group of near copies, some far from the leader
        words = list(base)
        for _ in range(rng.randint(0, 14)):
            words[rng.randrange(300)] = f"edit{k}"
        rows[3000 + k] = " ".join(words)
    rows |= {5000: None, 5001: "", 5002: "two words", 5003: "two words", 5004: "two word"}
    frame = spark.createDataFrame([(i, t, "x") for i, t in rows.items()] + [(None, rows[60], "x"), (0, rows[0], "x")],
                                  "doc_id long, text string, digest string")
    return rows, near, frame, minhash.near_duplicates(frame).collect()


def test_near_and_exact_copies_share_a_class_and_others_do_not(copies):
    rows, near, frame, out = copies
    assert len(out) == len(rows) + 2
    found = {r.doc_id: r.class_id for r in out if r.doc_id is not None}
    assert all(found[a] == found[b] for a, b in near.items())
    assert {found[2000 + k] for k in range(60)} == {60} and [r.class_id for r in out if r.doc_id is None] == [60]
    assert all(found[i] == i for i in range(150))
    assert found[5000] == found[5001] == 5000 and found[5002] == found[5003] == 5002 and found[5004] == 5004
    # Same classes as from all pairs by the exact similarity.
    n, counters = minhash.document_frequencies(frame.selectExpr("coalesce(text, '') text"))
    idf = minhash.idf_table(n, counters)
    group = [3000 + k for k in range(120)]
    sets = {i: minhash.weighted(rows[i], idf) for i in group}
    links = [(a, b) for a in group for b in group if a < b and minhash.similarity(sets[a], sets[b]) >= minhash.SIMILARITY]
    want = joined(group, links)
    assert np.mean([found[i] == want[i] for i in group]) >= 0.98


def test_crowded_buckets_are_cut_finer_without_losing_classes(spark, copies, monkeypatch):
    _, _, frame, out = copies
    monkeypatch.setattr(minhash, "CROWDED", 10)
    again = {r.doc_id: r.class_id for r in minhash.near_duplicates(frame).collect()}
    assert np.mean([again[r.doc_id] == r.class_id for r in out]) >= 0.98


def test_odd_rows_and_empty_tables(odd, none):
    out = minhash.near_duplicates(odd).collect()
    assert len(out) == 11 and {r.class_id for r in out if r.doc_id in (1, 7)} == {1}
    assert minhash.near_duplicates(none).count() == 0


def test_vector_links_match_all_pairs(spark):
    rng = np.random.default_rng(3)
    vectors = []
    for _ in range(4):
        base = rng.standard_normal(16)
        for noise in (0.02, 0.1, 0.25):
            vectors += [base + noise * rng.standard_normal(16) for _ in range(40)]
    vectors += [rng.standard_normal(16) for _ in range(150)] + [vectors[0]] * 30 + [2e-30 * vectors[5], 1e30 * vectors[5]]
    vectors = [[float(np.float32(x)) for x in v] for v in vectors]
    odd_ones = [None, [], [0.0] * 16, [float("nan")] * 16, [float("inf")] * 16, [1.0, None] * 8, [1.0, 2.0]]
    ids = [int(i) for i in rng.permutation(len(vectors) + len(odd_ones))]
    rows = [(i, v, i % 3) for i, v in zip(ids, vectors + odd_ones)] + [(None, vectors[0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    out = {r.vec_id: r for r in neighbours.link_vectors(df).collect()}
    assert len(out) == len(rows)
    unit = np.array(vectors) / np.abs(vectors).max(1, keepdims=True)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    links = unit @ unit.T >= 0.95
    np.fill_diagonal(links, False)
    want = joined(ids[:len(vectors)], [(ids[a], ids[b]) for a, b in zip(*np.nonzero(links)) if a < b])
    found = sum(out[i].n_links for i in ids)
    assert 0.99 * links.sum() <= found <= links.sum()
    assert all(out[i].n_links <= links[k].sum() for k, i in enumerate(ids[:len(vectors)]))
    assert np.mean([out[i].component_id == want[i] for i in want]) >= 0.99
    assert all(out[i].n_links == 0 and out[i].component_id == i and out[i].kept for i in ids[len(vectors):])
    assert out[None].n_links == 0 and not out[None].kept
    assert neighbours.link_vectors(df.limit(0)).count() == 0


def test_passes_grow_with_the_table():
    assert neighbours.passes_needed(1) == 4
    assert neighbours.passes_needed(10**9) > neighbours.passes_needed(10**5) > 10


def test_pipeline_keeps_columns_and_makes_its_decisions(spark):
    rng = random.Random(6)
    rows = []
    for i in range(60):
        rows.append((i, " ".join("".join(rng.choice(["ka", "to", "mi", "ru"]) for _ in range(3)) for _ in range(60)), "xx", f"s{i % 3}", 1))
    rows += [(100 + k, rows[k][1], "xx", "s0", 1) for k in range(5)] + [(0, rows[0][1], "xx", "s0", 1)]
    rows += [(200, "!!! 123", "xx", "s0", 1), (201, None, None, None, None),
             (202, rows[7][1] + " token = 0123456789abcdef0123456789abcdef toka", "xx", "s1", 1)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame(rows, schema)
    stages = dict(corpus_pipeline.STAGES)
    kept = corpus_pipeline.written(stages["language"](spark, docs, ""), "t")
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {r[0] for r in rows} - {200, 201}
    one = corpus_pipeline.written(stages["near_duplicates"](spark, kept, ""), "t")
    ids = sorted(r.doc_id for r in one.collect())
    assert one.columns == docs.columns and ids in (list(range(60)), [*range(60), 202])
    clean = stages["secrets"](spark, docs, "")
    assert clean.columns == docs.columns and "0123456789abcdef" not in {r.doc_id: r for r in clean.collect()}[202].text
    mixed = stages["mixture"](spark, docs, "").collect()
    total = sum(len(r[1].split()) for r in rows if r[1])
    assert abs(sum(len(r.text.split()) for r in mixed) - 1.5 * total) <= 4
    assert all(r.n_chars == len(r.text) for r in mixed if r.n_chars != 1)
    assert stages["mixture"](spark, docs, "").columns == docs.columns
    packed = stages["packing"](spark, docs, "")
    assert {r.doc_id for r in packed.collect()} == {r[0] for r in rows}
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), "").count() == 0, name
