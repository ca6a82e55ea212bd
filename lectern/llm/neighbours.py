"""Near-duplicate vectors by sorted projection passes.

Each pass gives every vector a key of 64 random-hyperplane bits; vectors are sorted by that
key (lexicographically, the first bit first) and compared with a bounded number of
neighbours in the order. Pairs of different passes are united.

So that a dense group needs no list of all its pairs, equal vectors are one class, and
classes within half the linking angle of a pivot form a ball: by the triangle inequality
all members of a ball link with each other. A pair that a pass verifies names its two
balls, and these are then resolved as a whole: by the angles of the pivots where those
settle it, else by comparing their members in blocks. So no window and no group size limits
how many partners a vector has.

Each pass also measures, per vector, how long a common prefix its window resolved. Vectors in
regions so dense that the passes leave a miss above the bound go through more passes among
themselves, and are compared whole when they are few or further passes do not thin them out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.components import components
from lectern.operators.joins import spread_join
from lectern.session import written

COSINE = 0.95
WINDOW = 32
MISSED = 0.0001
BITS = 64
LEADERS = 32
BLOCK = 256
#: Vectors left open that are compared whole at once, and the size of the sub-blocks of that; bytes of vectors that one task of a pass holds.
WHOLE, WHOLE_BLOCK = 100_000, 4_096
TASK_BYTES = 64 << 20
MARGIN = 1e-7
BATCH = 8_192
SEED = 20240


def passes_needed(n: int, cosine: float = COSINE, window: int = WINDOW, missed: float = MISSED) -> int:
    """Passes after which a pair at the threshold is missed with probability ``missed`` at most.

    Two vectors at angle t agree in a bit with probability 1 - t / pi, and meet in the
    window if they agree in the bits that tell n vectors apart down to a window.
    """
    bits = max(0.0, math.log2(max(1, n) / window))
    met = (1 - math.acos(cosine) / math.pi) ** bits
    return max(4, math.ceil(math.log(missed) / math.log1p(-min(met, 1 - 1e-9))))


def _keys(vectors: np.ndarray, number: int) -> np.ndarray:
    planes = np.random.default_rng((SEED, number, vectors.shape[1])).standard_normal((vectors.shape[1], BITS))
    bits = np.packbits(vectors @ planes > 0, axis=1)
    return bits.view(">u8").ravel() ^ np.uint64(1 << 63)


def _unit(raw: list[bytes]) -> np.ndarray:
    """Unit vectors in double precision; all of one length. Scaled first, so no square over- or underflows."""
    vectors = np.frombuffer(b"".join(raw), "<f8").reshape(len(raw), -1)
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))


def _packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Arrays as bytes of doubles."""
    for pdf in batches:
        pdf["vector"] = [np.asarray(v, "<f8").tobytes() for v in pdf["vector"]]
        yield pdf


def _keyed(numbers: list[int]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for dims, part in pdf.groupby("dims"):
                unit = _unit(list(part["vector"]))
                for number in numbers:
                    yield part.assign(number=number, key=_keys(unit, number).view(np.int64))
    return run


def _ordered(df: DataFrame, numbers: list[int], columns: str, tasks: int = 0) -> DataFrame:
    """Rows in the order of each pass; in ``tasks`` ranges where the session's partitions would be fewer."""
    keyed = df.mapInPandas(_keyed(numbers), columns + ", number int, key long")
    order = ("number", "dims", "key", "rep")
    more = tasks > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = keyed.repartitionByRange(tasks, *order) if more else keyed.repartitionByRange(*order)
    return dealt.sortWithinPartitions(*order)


def _pivoted(radius: float):
    """Balls inside a partition: a vector joins the first of the last leaders within ``radius``, or leads."""
    least = math.cos(radius)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        dims, leaders, names, vectors, at = None, None, [], [], 0
        for pdf in batches:
            balls, pivots, cosines = [], [], []
            for d, rep, raw in zip(pdf["dims"], pdf["rep"], pdf["vector"]):
                if d != dims:
                    dims, leaders, names, vectors, at = d, np.zeros((LEADERS, d)), [None] * LEADERS, [None] * LEADERS, 0
                unit = _unit([raw])[0]
                near = leaders @ unit
                best = int(near.argmax())
                if names[best] is None or near[best] < least:
                    best = at % LEADERS
                    leaders[best], names[best], vectors[best], at = unit, rep, raw, at + 1
                    near[best] = 1.0
                balls.append(names[best])
                pivots.append(vectors[best])
                cosines.append(near[best])
            yield pdf.assign(ball=balls, pivot=pivots, angle=np.arccos(np.clip(cosines, -1, 1)))
    return run


def _common_bits(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common beginning of two arrays of 64-bit keys."""
    x = a ^ b
    high, low = ((x >> np.uint64(32)).astype(np.float64), (x & np.uint64(0xFFFFFFFF)).astype(np.float64))
    return BITS - np.where(high > 0, 32 + np.frexp(high)[1], np.frexp(low)[1])


def _walked(ball: np.ndarray, unit: np.ndarray, key: np.ndarray, cosine: float, window: int,
            border: bool) -> tuple[list[np.ndarray], np.ndarray]:
    """Linked (ball, ball) of each row and the next ``window`` rows of other balls, and the key bits a partner must share to be met.

    Rows of the own ball are passed over, so a member inside a large ball reaches the vectors
    around it. At the end of the rows nothing is left to meet, unless it is a ``border`` behind
    which the order goes on: then only what shares more bits than the last row is sure to be met.
    """
    n = len(ball)
    starts = np.flatnonzero(np.r_[True, ball[1:] != ball[:-1]])
    run_end = np.repeat(np.r_[starts[1:], n], np.diff(np.r_[starts, n]))
    hits, bits = [], np.zeros(n, np.int64)
    for lot in range(0, n, BATCH):
        row = np.arange(lot, min(n, lot + BATCH))
        at = row
        for step in range(window + 1):
            at = np.minimum(at + 1, n)
            own = (at < n) & (ball[np.minimum(at, n - 1)] == ball[row])
            at = np.where(own, run_end[np.minimum(at, n - 1)], at)
            on = np.flatnonzero(at < n)
            if step == window or not len(on):
                break
            near = np.einsum("ij,ij->i", unit[row[on]], unit[at[on]]) >= cosine
            a, b = ball[row[on[near]]], ball[at[on[near]]]
            hits.append(np.stack([np.maximum(a, b), np.minimum(a, b)], 1))
        beyond = _common_bits(key[row], key[np.minimum(at, n - 1)]) + 1
        bits[row] = np.where(at < n, beyond, beyond if border else 0)
    return hits, bits


def _met(cosine: float, window: int):
    """Ball pairs with a verified pair of members inside a window of the order, and per row the logarithm of its miss."""
    agree = 1 - math.acos(cosine) / math.pi

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [pdf for pdf in batches if len(pdf)]
        if not held:
            return
        groups = [part for _, part in pd.concat(held, ignore_index=True).groupby(["number", "dims"], sort=False)]
        for k, part in enumerate(groups):
            ball, unit = part["ball"].to_numpy(), _unit(list(part["vector"]))
            key = part["key"].to_numpy().view(np.uint64) ^ np.uint64(1 << 63)
            after, ahead = _walked(ball, unit, key, cosine, window, k == len(groups) - 1)
            before, behind = _walked(ball[::-1], unit[::-1], key[::-1], cosine, window, k == 0)
            pairs = np.unique(np.concatenate([np.empty((0, 2), np.int64), *after, *before]), axis=0)
            met = np.minimum(agree ** np.maximum(ahead, behind[::-1]), 1 - 1e-9)
            yield pd.DataFrame({"u": pairs[:, 0], "v": pairs[:, 1]}).astype("Int64").assign(rep=pd.NA, miss=None)[
                ["u", "v", "rep", "miss"]]
            yield pd.DataFrame({"u": pd.NA, "v": pd.NA, "rep": part["rep"].to_numpy(), "miss": np.log1p(-met)})
    return run


def _compared(cosine: float):
    """Linked ball pairs of one block: inside a sub-block, or between two."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ball, side, unit = pdf["ball"].to_numpy(), pdf["side"].to_numpy(), _unit(list(pdf["vector"]))
        other = side == side.max()
        out = [np.empty((0, 2), np.int64)]
        rows = np.flatnonzero(side == 0)
        for at in range(0, len(rows), 512):
            i, j = np.nonzero(unit[rows[at:at + 512]] @ unit[other].T >= cosine)
            a, b = ball[rows[at + i]], ball[other][j]
            out.append(np.unique(np.stack([np.maximum(a, b), np.minimum(a, b)], 1)[a != b], axis=0))
        return pd.DataFrame(np.unique(np.concatenate(out), axis=0), columns=["u", "v"])
    return run


def _all_pairs(dense: DataFrame, n: int, cosine: float) -> DataFrame:
    """Linked ball pairs of all vectors of a table, every pair of sub-blocks a task of its own."""
    parts = max(1, math.ceil(n / WHOLE_BLOCK))
    own = F.pmod(F.xxhash64("rep", "vector"), F.lit(parts))
    paired = dense.select("dims", "ball", "vector", own.alias("own"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("other"))
    return paired.select("dims", "ball", "vector", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"),
                         (F.col("own") > F.col("other")).cast("int").alias("side")).groupBy("dims", "a", "b").applyInPandas(
        _compared(cosine), "u long, v long")


def _met_pairs(members: DataFrame, n: int, width: int, cosine: float, window: int, missed: float) -> DataFrame:
    """(u, v), the ball pairs with a link between members: passes for all, more passes for vectors
    whose measured miss is above ``missed``, and these whole when they are few or stay many."""
    columns = "ball long, rep long, copies long, dims int, vector binary"
    passes, done, found, state, now = passes_needed(n, cosine, window, missed), 0, None, None, members
    while n:
        numbers = list(range(done + 1, done + passes + 1))
        tasks = math.ceil(n * passes * 8 * width / TASK_BYTES)
        out = written(_ordered(now, numbers, columns, tasks).mapInPandas(
            _met(cosine, window), "u long, v long, rep long, miss double"), "ball-pairs")
        pairs = out.where("u IS NOT NULL").select("u", "v")
        found = pairs if found is None else found.union(pairs)
        # A vector has one row per pass; ids that several vectors share must not count as passes.
        miss = out.where("rep IS NOT NULL").groupBy("rep").agg((F.avg("miss") * passes).alias("miss"))
        if state is not None:
            miss = miss.join(state.withColumnRenamed("miss", "earlier"), "rep").select("rep", (F.col("miss") + F.col("earlier")).alias("miss"))
        state = written(miss.where(F.col("miss") > math.log(missed)), "open-vectors")
        now, before, done = written(now.join(state.select("rep"), "rep", "left_semi").select(*now.columns), "dense"), n, done + passes
        n = now.count()
        if 0 < n and (n <= WHOLE or 2 * n > before):
            found = found.union(_all_pairs(now, n, cosine))
            break
    return found.distinct() if found is not None else members.selectExpr("ball u", "ball v").limit(0)


def _resolved(cosine: float):
    """Linked members of two blocks: each member with the number of vectors on the other side."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                links = _unit(list(r.vectors_u)) @ _unit(list(r.vectors_v)).T >= cosine
                for reps, counts in ((r.reps_u, links @ np.asarray(r.sizes_v)), (r.reps_v, np.asarray(r.sizes_u) @ links)):
                    rows += [(r.u, r.v, int(x), int(n)) for x, n in zip(reps, counts) if n]
            yield pd.DataFrame(rows, columns=["u", "v", "rep", "n"])
    return run


def link_vectors(embeddings: DataFrame, cosine: float = COSINE, window: int = WINDOW, missed: float = MISSED) -> DataFrame:
    """(vec_id, embedding) -> (vec_id, n_links, component_id, kept), a row per row.

    Vectors that are null, empty, zero or hold a null or non-finite component, and rows
    without an id, link with nothing: 0 links, a component of their own. Vectors of
    different length do not link. Repeated rows are vectors of their own and link. Other
    columns are ignored; an empty table gives an empty result.
    """
    rows = embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("vector"))
    sound = F.coalesce(
        F.col("vec_id").isNotNull() & (F.size("vector") > 0)
        & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists("vector", lambda x: x != 0), F.lit(False))
    rows = rows.withColumn("_sound", sound)
    good = rows.where("_sound").drop("_sound")
    # Different vectors may share an id, so a class has a number of its own.
    classes = written(good.groupBy("vector").agg(F.min("vec_id").alias("least_id"), F.count("*").alias("copies")).withColumn(
        "rep", F.monotonically_increasing_id()), "vector-numbers")
    class_columns = "rep long, copies long, dims int, vector binary"
    stored = written(
        classes.select("rep", "copies", F.size("vector").alias("dims"), "vector").mapInPandas(
            _packed, class_columns), "vector-classes")
    n, width = stored.agg(F.count("*"), F.coalesce(F.max("dims"), F.lit(0))).first()

    half = math.acos(cosine) / 2 - MARGIN
    members = written(
        _ordered(stored, [0], class_columns).mapInPandas(
            _pivoted(half), class_columns + ", number int, key long, ball long, pivot binary, angle double"
        ).drop("number", "key"), "vector-balls")
    # A ball is named by its least class.
    balls = written(members.groupBy("ball").agg(
        F.min("rep").alias("name"), F.sum("copies").alias("size"), F.count("*").alias("n_classes"),
        F.max("angle").alias("radius"), F.first("pivot").alias("pivot")), "balls")
    members = written(members.join(balls.select("ball", "name"), "ball").select(
        F.col("name").alias("ball"), "rep", "copies", "dims", "vector"), "ball-members")

    met = written(_met_pairs(members, n, width, cosine, window, missed), "ball-pairs")

    def side(x: str) -> DataFrame:
        return balls.select(F.col("name").alias(x), F.col("size").alias(f"size_{x}"), F.col("radius").alias(f"radius_{x}"),
                            F.col("pivot").alias(f"pivot_{x}"))

    def angles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            angle = [float(np.arccos(np.clip(_unit([a])[0] @ _unit([b])[0], -1, 1)))
                     for a, b in zip(pdf["pivot_u"], pdf["pivot_v"])]
            yield pdf.assign(angle=angle).drop(columns=["pivot_u", "pivot_v"])

    judged = written(met.join(side("u"), "u").join(side("v"), "v").select(
        "u", "v", "size_u", "size_v", "radius_u", "radius_v", "pivot_u", "pivot_v").mapInPandas(
        angles, "u long, v long, size_u long, size_v long, radius_u double, radius_v double, angle double"), "ball-angles")
    whole = F.col("angle") + F.col("radius_u") + F.col("radius_v") <= math.acos(cosine) - MARGIN
    all_linked, open_pairs = judged.where(whole), judged.where(~whole)

    place = F.pmod(F.xxhash64("rep"), F.ceil(F.col("n_classes") / BLOCK))
    blocks = members.join(balls.select(F.col("name").alias("ball"), "n_classes"), "ball").groupBy(
        "ball", place.alias("block")).agg(F.collect_list(F.struct("rep", "copies", "vector")).alias("m"))

    def blocks_of(x: str) -> DataFrame:
        return blocks.select(F.col("ball").alias(x), F.col("m.rep").alias(f"reps_{x}"), F.col("m.copies").alias(f"sizes_{x}"),
                             F.col("m.vector").alias(f"vectors_{x}"))

    resolved = written(open_pairs.select("u", "v").join(blocks_of("u"), "u").join(blocks_of("v"), "v").mapInPandas(
        _resolved(cosine), "u long, v long, rep long, n long"), "ball-links")

    edges = all_linked.select("u", "v").union(resolved.select("u", "v").distinct())
    named = components(edges)
    of_balls = all_linked.select(F.col("u").alias("ball"), F.col("size_v").alias("n")).union(
        all_linked.select(F.col("v").alias("ball"), F.col("size_u").alias("n"))).groupBy("ball").agg(F.sum("n").alias("ball_links"))
    of_members = resolved.groupBy("rep").agg(F.sum("n").alias("own_links"))
    per_class = members.join(balls.select(F.col("name").alias("ball"), "size"), "ball").join(
        of_balls, "ball", "left").join(of_members, "rep", "left").join(
        named.withColumnRenamed("node", "ball"), "ball", "left").select(
        "rep", (F.col("size") - 1 + F.coalesce("ball_links", F.lit(0)) + F.coalesce("own_links", F.lit(0))).alias("n_links"),
        F.coalesce("component", "ball").alias("component"))
    linked = written(classes.select("rep", "least_id", "vector").join(per_class, "rep"), "linked-classes")
    least = linked.groupBy("component").agg(F.min("least_id").alias("component_id"))
    named_classes = spread_join(linked.select("rep", "n_links", "component"), least, "component", ["rep"], "inner", hot_from=linked)
    result = good.join(linked.select("vector", "rep"), "vector").join(
        named_classes.select("rep", "n_links", "component_id"), "rep").select("vec_id", "n_links", "component_id")
    alone = rows.where("NOT _sound").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return result.union(alone).select(
        "*", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"))
