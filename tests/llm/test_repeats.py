"""Repeated passages against a brute-force version."""

import hashlib
import random

import pytest

from lectern.llm import repeats

LAST = 1 << 63


def brute(rows, length=50):
    """Per row (n_bytes, n_removed, n_spans, kept_sha256, spans), with a table of every stretch's smallest id."""
    texts = [(LAST if i is None else i, (t or "").encode()) for i, t in rows]
    least = {}
    for i, t in texts:
        for a in range(len(t) - length + 1):
            least[t[a:a + length]] = min(i, least.get(t[a:a + length], LAST))
    out = []
    for i, t in texts:
        gone = bytearray(len(t))
        for a in range(len(t) - length + 1):
            if least[t[a:a + length]] < i:
                gone[a:a + length] = b"\1" * length
        spans, a = [], 0
        while a < len(t):
            b = a
            while b < len(t) and gone[b] == gone[a]:
                b += 1
            if gone[a]:
                spans.append((a, b))
            a = b
        kept = bytes(c for c, g in zip(t, gone) if not g)
        out.append((len(t), sum(gone), len(spans), hashlib.sha256(kept).hexdigest(), spans, kept))
    return out


def check(spark, rows, **options):
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = repeats.without_repeats(frame, **options).collect()
    mine = sorted((r.doc_id is None, r.doc_id or 0, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, [tuple(s) for s in r.spans],
                   bytes(r.kept)) for r in got)
    want = sorted((i is None, i or 0, *b) for (i, _), b in zip(rows, brute(rows, options.get("length", 50))))
    assert mine == want


def corpus(rng, n=120):
    word = lambda: "".join(rng.choice("abcé😀 ") for _ in range(rng.randint(1, 6)))
    passages = [" ".join(word() for _ in range(rng.randint(8, 60))) for _ in range(12)]
    rows = []
    for i in range(n):
        parts = []
        for _ in range(rng.randint(0, 5)):
            p = rng.choice(passages)
            a = rng.randint(0, len(p) // 2)
            parts.append(rng.choice([p, p[a:], p[:len(p) - a], " ".join(word() for _ in range(rng.randint(1, 30)))]))
        rows.append((rng.randint(0, n), "".join(parts)))
    rows += [rows[3], rows[3], (None, rows[5][1]), (None, rows[5][1]), (7, None), (8, ""), (9, "x" * 49), (10, "x" * 50), (11, "x" * 300),
             (n + 1, passages[0] * 3), (n + 2, passages[0] + passages[1]), (n + 3, (passages[0] + passages[1])[20:])]
    return rows


@pytest.mark.parametrize("seed,options", [(1, {}), (2, {"lot_bytes": 700, "bucket_names": 300}), (3, {"lot_bytes": 5_000, "length": 29}),
                                          (4, {"lot_bytes": 100, "bucket_names": 50})])
def test_bytes_go_as_in_the_brute_force_version(spark, seed, options):
    check(spark, corpus(random.Random(seed)), **options)


def test_stretches_just_long_enough_are_found_at_every_offset(spark):
    rng = random.Random(9)
    letters = "abcdefghijklmnopqrstuvwxyz"
    fresh = lambda k: "".join(rng.choice(letters) for _ in range(k))
    shared, longer = fresh(50), fresh(51)
    rows = [(1, fresh(5) + shared + fresh(9) + longer)]
    rows += [(2 + k, fresh(k) + shared + fresh(3)) for k in range(45)] + [(60 + k, fresh(k) + longer[1:] + fresh(2)) for k in range(45)]
    rows += [(200, shared[1:] + "-" + shared[:-1])]
    check(spark, rows, lot_bytes=300, bucket_names=40)


def test_odd_rows_keep_their_place(spark, odd, none):
    got = repeats.without_repeats(odd).collect()
    assert len(got) == odd.count()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    assert [r.n_removed for r in by[1]] == [0, 0]
    assert by[2][0].n_bytes == by[3][0].n_bytes == 0 and (by[7][0].n_bytes, by[7][0].n_removed) == (49, 0)
    assert by[6][0].n_removed == 0 and bytes(by[6][0].kept) == ("very long words repeat here and there " * 20_000).encode()
    assert repeats.without_repeats(none).count() == 0


def test_every_distance_is_covered():
    assert {(a - b) % repeats.V for a in repeats.COVER for b in repeats.COVER} == set(range(repeats.V))
