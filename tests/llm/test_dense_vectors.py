"""Vectors in dense regions: links that a fixed number of windows would miss."""

import numpy as np
import pandas as pd

from lectern.llm import neighbours


def cone(rng, n, n_pairs, dims=48):
    """Vectors of mutual cosine near 0.8, of which some have one partner just above the threshold."""
    def unit(x):
        return x / np.linalg.norm(x, axis=-1, keepdims=True)

    base = unit(rng.standard_normal(dims))
    v = unit(np.sqrt(0.8) * base + np.sqrt(0.2) * unit(rng.standard_normal((n, dims))))
    z = rng.standard_normal((n_pairs, dims))
    z = unit(z - (z * v[:n_pairs]).sum(1, keepdims=True) * v[:n_pairs])
    return np.vstack([v, 0.952 * v[:n_pairs] + np.sqrt(1 - 0.952 ** 2) * z])


def all_links(vectors):
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    links = unit @ unit.T >= neighbours.COSINE
    np.fill_diagonal(links, False)
    return links


def test_links_in_a_dense_cone_are_found(spark, monkeypatch):
    vectors = cone(np.random.default_rng(8), 2_000, 200)
    links = all_links(vectors)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    monkeypatch.setattr(neighbours, "WHOLE_BLOCK", 500, raising=False)
    out = {r.vec_id: r.n_links for r in neighbours.link_vectors(df).collect()}
    assert links.sum() >= 400
    assert np.mean([out[i] == links[i].sum() for i in range(len(vectors))]) >= 0.999


def test_a_member_inside_a_ball_meets_a_vector_outside():
    angles = np.r_[np.linspace(0, 0.15, 101), 0.15 + 0.25]  # of the ball only the far end links with the last
    order = np.r_[0:50, 100, 50:100, 101]  # and stands inside the ball's rows
    vectors = np.stack([np.cos(angles), np.sin(angles)], 1)[order]
    pdf = pd.DataFrame({"ball": [1] * 101 + [900], "rep": np.arange(102), "dims": 2, "number": 1,
                        "key": np.arange(102, dtype=np.int64), "vector": [v.astype("<f8").tobytes() for v in vectors]})
    out = pd.concat(neighbours._met(np.cos(0.2501), 32)(iter([pdf])))
    assert out[["u", "v"]].dropna().drop_duplicates().values.tolist() == [[900, 1]]


def test_common_bits():
    a = np.array([0, 1, 1 << 63, (1 << 53) - 1, 5], np.uint64)
    b = np.array([0, 0, 0, 0, 4], np.uint64)
    assert neighbours._common_bits(a, b).tolist() == [64, 63, 0, 11, 63]


def test_vectors_that_share_an_id_keep_their_rows_and_links(spark):
    rng = np.random.default_rng(8)
    base = rng.normal(size=(12, 16))
    rows = [(int(rng.integers(1, 9)), (base[rng.integers(0, 12)] + rng.normal(0, 0.04, 16)).tolist()) for _ in range(120)]
    rows += [(1, base[0].tolist()), (1, base[5].tolist()), (1, base[0].tolist()), (9, (-base[0]).tolist()), (2, [0.0] * 16)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    unit = np.array([np.array(v) / (np.linalg.norm(v) or 1) for _, v in rows])
    link = unit @ unit.T >= 0.95
    np.fill_diagonal(link, False)
    label = list(range(len(rows)))
    for i, j in zip(*np.nonzero(link)):
        a, b = label[i], label[j]
        label = [a if x == b else x for x in label]
    least = {}
    for (i, _), x in zip(rows, label):
        least[x] = min(i, least.get(x, i))
    want = sorted((i, int(n), least[x], i == least[x]) for (i, _), n, x in zip(rows, link.sum(1), label))
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in neighbours.link_vectors(frame).collect())
    assert len(got) == len(rows)
    assert got == want
