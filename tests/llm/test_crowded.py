"""Crowded buckets: blocks have a bound, and every pair that could join components meets in one of them."""

from collections import defaultdict
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from lectern.llm import minhash


def test_no_block_grows_with_its_bucket_and_every_pair_meets_once(spark, monkeypatch):
    monkeypatch.setattr(minhash, "CROWDED", 200)
    component = {1: lambda i: i, 2: lambda i: 0 if i % 3 else i, 3: lambda i: i % 2}  # no component, a large one, a small bucket
    size = {1: 1500, 2: 1500, 3: 100}
    rows = [(b, i, component[b](i), size[b], np.full(minhash.BANDS * minhash.ROWS, b, np.uint64).tobytes())
            for b in size for i in range(size[b])]
    members = spark.createDataFrame(rows, "bucket long, rep long, component long, n long, draws binary")
    out = minhash._blocks(members)
    sizes = out.groupBy("bucket", "block").agg(F.count("*").alias("c")).collect()
    assert max(r.c for r in sizes) <= 1.4 * 200
    blocks = defaultdict(lambda: ([], []))
    for r in out.collect():
        blocks[r.bucket, str(r.block)][r.side].append(r.rep)
    met = defaultdict(int)
    for (bucket, _), (a, b) in blocks.items():
        for x, y in ([(x, y) for x in a for y in b] if b else combinations(a, 2)):
            if component[bucket](x) != component[bucket](y):
                met[bucket, min(x, y), max(x, y)] += 1
    assert set(met.values()) == {1}
    assert len(met) == sum(component[b](x) != component[b](y) for b in size for x, y in combinations(range(size[b]), 2))


def test_two_sides_give_the_links_between_them():
    idf = np.ones(1 << minhash.COUNTERS_LOG2, np.float32)
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(words), " ".join(["x y z"] * 9), " ".join([*words[:-1], "last"]), " ".join(["a b c d e f"] * 9)]
    pdf = next(minhash._sets(iter([pd.DataFrame({"rep": [7, 8, 9, 10], "text": texts})])))
    pdf = pdf.assign(component=[7, 8, 9, 10], side=[1, 1, 0, 0])
    got = minhash._across(lambda: idf, 0.8)(pdf)
    assert got.values.tolist() == [[9, 7]]
