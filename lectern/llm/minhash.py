"""Near-duplicate texts by consistent weighted sampling over TF-IDF shingles.

Exact copies are one class, by a 128-bit digest of the text. A class's text is the weighted
set of its five-word shingles, weight = count x idf, idf = 1 + s ln(N / df) / ln N. Document
frequencies come from counters of a fixed number of hashed shingles, summed over all
documents and freed of the mean load of a counter, so the sketch that tasks get has the
same size for any corpus.

Improved consistent weighted sampling draws from each set, per hash function, an element
and a quantised weight such that two sets draw the same with probability equal to their
weighted Jaccard similarity. Bands of draws are bucket keys. Classes of a bucket are first
compared with one leader only; after the links found so far have been joined to components,
only members of a bucket that are still in different components are compared. Every link rests on the exact weighted Jaccard similarity.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.caches import claim
from lectern.llm.common import as_batch, as_lists, shipped, whole_text
from lectern.llm.components import components
from lectern.session import written

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 10, 3
IDF_STRENGTH = 0.1
COUNTERS_LOG2, BLOCKS_LOG2 = 20, 6
LEAST_AGREEMENT = 0.5
CROWDED = 2_000
KEPT_WORDS = 300_000
WEIGHT_STEPS = 32

DRAWN_SCHEMA = pa.schema([("doc_id", pa.int64()), ("digest", pa.string()), ("draws", pa.binary())])

_word_hashes: dict[bytes, int] = {}


def _word_hash(word: bytes) -> int:
    found = xxhash.xxh64_intdigest(word)
    if len(_word_hashes) < KEPT_WORDS:
        _word_hashes[word] = found
    return found


def shingles(text: str) -> np.ndarray:
    """64-bit hashes of the text's shingles, in order. Fewer than five words are one shingle; no words, none."""
    claim("shingles", _cleared)
    ws = text.encode("utf-8", "surrogatepass").split()
    known = _word_hashes.get
    hashed = np.fromiter((known(w) or _word_hash(w) for w in ws), np.uint64, len(ws))
    if len(ws) < SHINGLE:
        hashed = np.concatenate([hashed, np.zeros(SHINGLE - len(ws), np.uint64)]) if len(ws) else hashed
    n = len(hashed) - SHINGLE + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(SHINGLE):
        out = (out ^ hashed[k:k + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def _counted(text: str) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(shingles(text), return_counts=True)


def _counter_of(hashed: np.ndarray) -> np.ndarray:
    return (hashed >> np.uint64(64 - COUNTERS_LOG2)).astype(np.int64)


def document_frequencies(texts: DataFrame) -> tuple[int, np.ndarray]:
    """(number of documents with words, counters) over all rows of a table with a text.

    Every task sums its documents into the counters and hands them on in blocks; blocks are
    summed as tasks of their own. The driver gets the 2 ** 20 sums, whatever the input.
    """
    width = 1 << COUNTERS_LOG2 - BLOCKS_LOG2

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counters, docs = np.zeros(1 << COUNTERS_LOG2, np.int64), 0
        for pdf in batches:
            sets = [_counter_of(np.unique(shingles(text))) for text in pdf["text"]]
            docs += sum(len(x) > 0 for x in sets)
            if sets:
                counters += np.bincount(np.concatenate(sets), minlength=len(counters))
        if docs:
            yield pd.DataFrame({"block": range(1 << BLOCKS_LOG2), "docs": [docs] + [0] * ((1 << BLOCKS_LOG2) - 1),
                                "counts": [b.astype("<i4").tobytes() for b in counters.reshape(-1, width)]})

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(b, "<i4" if len(b) == 4 * width else "<i8").astype("<i8") for b in pdf["counts"])
        return pd.DataFrame({"block": pdf["block"][:1], "docs": [pdf["docs"].sum()], "counts": [total.tobytes()]})

    schema = "block int, docs long, counts binary"
    # Tasks are many, so blocks are first summed in sixteen lots.
    parts = texts.mapInPandas(count, schema).withColumn("lot", F.pmod(F.xxhash64("counts"), F.lit(16)))
    lots = parts.groupBy("block", "lot").applyInPandas(lambda pdf: add(pdf), schema)
    counters, docs = np.zeros((1 << BLOCKS_LOG2, width), np.int64), 0
    for row in lots.groupBy("block").applyInPandas(add, schema).toLocalIterator():
        counters[row.block] = np.frombuffer(row.counts, "<i8")
        docs += row.docs
    return docs, counters.ravel()


def idf_table(docs: int, counters: np.ndarray, strength: float = IDF_STRENGTH) -> np.ndarray:
    """The idf of each counter in single precision; the mean load of a counter is taken off its count."""
    load = counters.sum() / max(1, len(counters))
    df = np.clip(counters - load, 1, max(1, docs))
    return (1 + strength * np.log(max(1, docs) / df) / math.log(max(2, docs))).astype(np.float32)


def weighted(text: str, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted shingle hashes and their TF-IDF weights."""
    hashed, counts = _counted(text)
    return hashed, counts * idf[_counter_of(hashed)]


class _Sampler:
    """Tables for drawing: hash bits pick a quantile of c (Gamma(2, 1)), and jointly of r (Gamma(2, 1)) and beta.

    A weight enters by its logarithm, rounded to ``1 / WEIGHT_STEPS``; for each rounded weight
    that occurs, a row holds r (level - beta + 1) for all (r, beta), so a draw is two look-ups.
    """

    C_BITS, R_BITS, BETA_BITS = 16, 7, 7

    def __init__(self):
        grid = np.linspace(0, 40, 400_001)
        cdf = 1 - np.exp(-grid) * (1 + grid)

        def quantiles(bits: int) -> np.ndarray:
            return (np.arange(1 << bits) + 0.5) / (1 << bits)

        self.log_c = np.log(np.interp(quantiles(self.C_BITS), cdf, grid)).astype(np.float32)
        self.r = np.repeat(np.interp(quantiles(self.R_BITS), cdf, grid), 1 << self.BETA_BITS)
        self.beta = np.tile(quantiles(self.BETA_BITS), 1 << self.R_BITS)
        self.rows: dict[int, int] = {}
        self.steps = np.empty((0, len(self.r)), np.float32)

    def row_of(self, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rounded logarithms and their rows."""
        rounded = np.rint(np.log(weights) * WEIGHT_STEPS).astype(np.int64)
        found, back = np.unique(rounded, return_inverse=True)
        for value in found.tolist():
            if value not in self.rows:
                self.rows[value] = len(self.steps)
                level = np.floor(value / WEIGHT_STEPS / self.r + self.beta)
                self.steps = np.vstack([self.steps, (self.r * (level - self.beta + 1)).astype(np.float32)])
        return rounded, np.asarray([self.rows[v] for v in found.tolist()])[back]

    def draw(self, hashed: np.ndarray, weights: np.ndarray, n: int) -> np.ndarray:
        rounded, row = self.row_of(weights)
        salts = (np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B1) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        x = ((hashed ^ hashed >> np.uint64(32)).astype(np.uint32)[None, :] ^ salts[:, None]) * np.uint32(0x85EBCA6B)
        x ^= x >> np.uint32(15)
        x *= np.uint32(0xC2B2AE35)
        x ^= x >> np.uint32(16)
        of_c = (x & np.uint32((1 << self.C_BITS) - 1)).astype(np.intp)
        of_r = (x >> np.uint32(32 - self.R_BITS - self.BETA_BITS)).astype(np.intp)
        of_r += row * len(self.r)
        at = np.argmin(self.log_c.take(of_c) - self.steps.ravel().take(of_r), axis=1)
        pair = of_r[np.arange(n), at] % len(self.r)
        level = np.floor(rounded[at] / WEIGHT_STEPS / self.r[pair] + self.beta[pair]).astype(np.int64)
        return hashed[at] * np.uint64(0x9E3779B97F4A7C15) ^ level.view(np.uint64)


_samplers: list[_Sampler] = []


def _cleared() -> None:
    _word_hashes.clear()
    _samplers.clear()


def draws(hashed: np.ndarray, weights: np.ndarray, n: int = BANDS * ROWS) -> np.ndarray:
    """One consistent weighted sample per hash function, as 64-bit numbers (element and level)."""
    if not _samplers:
        _samplers.append(_Sampler())
    return _samplers[0].draw(hashed, weights, n)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity: the sum of least weights over the sum of greatest."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    least = np.minimum(a[1][i], b[1][j]).sum(dtype=np.float64)
    total = a[1].sum(dtype=np.float64) + b[1].sum(dtype=np.float64) - least
    return float(least / total) if total else 0.0


def _signatures(get_idf):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lists in as_lists(batches):
            made = []
            for text in lists.pop("text"):
                hashed, weights = weighted(text, get_idf())
                made.append(draws(hashed, weights).tobytes() if len(hashed) else b"")
            yield as_batch(lists | {"draws": made}, DRAWN_SCHEMA)
    return run


def _banded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A row per class and band: the bucket key."""
    for pdf in batches:
        if not len(pdf):
            continue
        rows = np.frombuffer(b"".join(pdf["draws"]), np.uint64).reshape(len(pdf), BANDS, ROWS)
        key = np.zeros((len(pdf), BANDS), np.uint64)
        for k in range(ROWS):
            key = (key ^ rows[:, :, k]) * np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(31)
        key += np.arange(BANDS, dtype=np.uint64)
        yield pd.DataFrame({"rep": np.repeat(pdf["rep"].to_numpy(), BANDS), "copies": np.repeat(pdf["copies"].to_numpy(), BANDS),
                            "bucket": key.view(np.int64).ravel()})


def _sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        sets = [_counted(text) for text in pdf["text"]]
        yield pd.DataFrame({"rep": pdf["rep"], "hashed": [h.tobytes() for h, _ in sets],
                            "counts": [c.astype("<u4").tobytes() for _, c in sets]})


def _verified(get_idf, least: float):
    def weighed(hashed: bytes, counts: bytes) -> tuple[np.ndarray, np.ndarray]:
        of = np.frombuffer(hashed, np.uint64)
        return of, np.frombuffer(counts, "<u4") * get_idf()[_counter_of(of)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            kept = [similarity(weighed(hu, cu), weighed(hv, cv)) >= least for hu, cu, hv, cv in zip(
                pdf["hashed_u"], pdf["counts_u"], pdf["hashed_v"], pdf["counts_v"])]
            yield pdf.loc[np.asarray(kept, bool), ["u", "v"]]
    return run


def _agreeing(least: int):
    """Pairs whose draws agree in ``least`` places at least."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                a, b = (np.frombuffer(b"".join(pdf[c]), np.uint64).reshape(len(pdf), -1) for c in ("draws_u", "draws_v"))
                yield pdf.loc[(a == b).sum(1) >= least, ["u", "v"]]
    return run


def _across(get_idf, least: float):
    """Links that join the components of one block.

    Every pair of different components has a member outside the block's largest one. Each
    such member is compared with all others at once: its weights are laid out over the
    block's shingles, and the others' shares in them are summed per set. Of the members of
    a component that it links with, one link is kept, so a block gives fewer links than it
    has members. In a block of two sides each member of the first is compared with all of
    the second.
    """
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("side", kind="stable")
        hashed = [np.frombuffer(h, np.uint64) for h in pdf["hashed"]]
        every = np.concatenate(hashed)
        weights = np.frombuffer(b"".join(pdf["counts"]), "<u4") * get_idf()[_counter_of(every)]
        names, place = np.unique(every, return_inverse=True)
        ends = np.cumsum([len(h) for h in hashed])
        starts = ends - [len(h) for h in hashed]
        sums = np.add.reduceat(weights, starts, dtype=np.float64)
        rep, labels = pdf["rep"].to_numpy(), pdf["component"].to_numpy().copy()
        values, sizes = np.unique(labels, return_counts=True)
        laid = np.zeros(len(names), np.float32)
        us, vs = [], []
        n_first = int((pdf["side"].to_numpy() == 0).sum())
        two = n_first < len(pdf)
        asked = range(n_first) if two else np.flatnonzero(labels != values[sizes.argmax()])
        at = n_first if two else 0
        # What is compared with: all of the block, or its second side.
        place_of, weights_of, starts_of, sums_of = place[starts[at]:], weights[starts[at]:], starts[at:] - starts[at], sums[at:]
        for i in asked:
            own = slice(starts[i], ends[i])
            laid[place[own]] = weights[own]
            shared = np.add.reduceat(np.minimum(laid[place_of], weights_of), starts_of, dtype=np.float64)
            laid[place[own]] = 0
            alike = at + np.flatnonzero((shared >= least * (sums_of + sums[i] - shared)) & (labels[at:] != labels[i]))
            for label in np.unique(labels[alike]):
                j = alike[labels[alike] == label][0]
                us.append(max(rep[i], rep[j]))
                vs.append(min(rep[i], rep[j]))
                labels[labels == label] = labels[i]
        return pd.DataFrame({"u": us, "v": vs}, dtype="int64")
    return run


def near_duplicates(docs: DataFrame, least: float = SIMILARITY, least_agreement: float = LEAST_AGREEMENT) -> DataFrame:
    """(doc_id, text) -> (doc_id, digest, class_id, copies, kept), a row per row.

    ``class_id`` is the smallest doc_id of the documents that a chain of links reaches,
    ``copies`` the number of rows with exactly this text, ``kept`` whether the row's id is
    the class's. Equal texts are one class whatever they hold; texts without a word are only
    like their exact copies; a null text is an empty one. A row without an id belongs to its
    text's class; texts of which no row has an id are only like their exact copies, with
    class_id null and every row kept. Repeated rows are judged alike; different texts under
    one id count as texts of one document. An empty table gives an empty result; other
    columns are ignored.
    """
    spark, enough = docs.sparkSession, math.ceil(least_agreement * BANDS * ROWS)
    keyed = docs.select("doc_id", whole_text().alias("text"))
    n, counters = document_frequencies(keyed.select("text"))
    get_idf = shipped(spark, idf_table(n, counters))
    rows = written(keyed.withColumn("digest", F.md5(F.col("text").cast("binary"))).mapInArrow(
        _signatures(get_idf), "doc_id long, digest string, draws binary"), "draws")
    classes = written(rows.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")), "text-classes")

    # One row per class: those of its smallest id are alike in all columns.
    signed = written(rows.where("draws <> X''").join(classes, "digest").where("doc_id = rep").groupBy(
        "digest", "rep").agg(F.max("copies").alias("copies"), F.first("draws").alias("draws")), "class-draws")
    ranked = signed.select("rep", "copies", "draws").mapInPandas(_banded, "rep long, copies long, bucket long")
    # The class with most copies leads its bucket: most likely the text that others were made from.
    shared = ranked.groupBy("bucket").agg(
        F.count("*").alias("n"), F.max(F.struct("copies", (-F.col("rep")).alias("rep"))).alias("lead")).where("n > 1").select(
        "bucket", "n", (-F.col("lead.rep")).alias("leader"))
    filed = written(ranked.select("rep", "bucket").join(shared, "bucket"), "buckets")
    wanted = filed.select("rep").distinct().join(signed.select("rep", "digest"), "rep")
    sets = written(keyed.select(F.col("doc_id").alias("rep"), F.md5(F.col("text").cast("binary")).alias("digest"), "text").join(
        wanted, ["rep", "digest"]).groupBy("rep", "digest").agg(F.first("text").alias("text")).select("rep", "text").mapInPandas(_sets, "rep long, hashed binary, counts binary"), "sets")

    def beside(pairs: DataFrame, table: DataFrame, values: list[str]) -> DataFrame:
        for x in ("u", "v"):
            pairs = pairs.join(table.select(F.col("rep").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in values]), x)
        return pairs

    def verified(pairs: DataFrame) -> DataFrame:
        close = beside(pairs.distinct(), signed, ["draws"]).mapInPandas(_agreeing(enough), "u long, v long")
        return written(beside(close, sets, ["hashed", "counts"]).mapInPandas(
            _verified(get_idf, least), "u long, v long"), "links")

    first = verified(filed.where("rep <> leader").select(
        F.greatest("rep", "leader").alias("u"), F.least("rep", "leader").alias("v")))
    placed = filed.join(components(first).withColumnRenamed("node", "rep"), "rep", "left").withColumn(
        "component", F.coalesce("component", "rep"))
    mixed = placed.groupBy("bucket").agg(F.min("component").alias("a"), F.max("component").alias("b")).where(
        "a <> b").select("bucket")
    blocks = _blocks(placed.join(mixed, "bucket"))
    second = written(blocks.join(sets, "rep").groupBy("bucket", "block").applyInPandas(
        _across(get_idf, least), "u long, v long"), "links")
    named = components(first.union(second))
    final = classes.join(named.withColumnRenamed("node", "rep"), "rep", "left").select(
        "digest", "copies", F.coalesce("component", "rep").alias("class_id"))
    return rows.select("doc_id", "digest").join(final, "digest").select(
        "doc_id", "digest", "class_id", "copies", F.col("doc_id").eqNullSafe(F.col("class_id")).alias("kept"))


def _blocks(members: DataFrame) -> DataFrame:
    """(bucket, rep, component) -> (bucket, rep, component, block, side): what one task compares.

    A bucket of up to ``CROWDED`` members is one block. A larger one is dealt by hash into
    sub-blocks of half that many, those of its largest component apart from the rest, and
    every pair of sub-blocks is a block of its own, one on either side; pairs inside the
    largest component have nothing to join. So each pair of different components meets in
    exactly one block, and no block grows with its bucket.
    """
    counted = members.groupBy("bucket", "component").agg(F.count("*").alias("n"))
    sizes = counted.groupBy("bucket").agg(
        F.sum("n").alias("n"), F.max(F.struct("n", "component")).alias("most")).select(
        "bucket", "n", F.col("most.n").alias("n_most"), F.col("most.component").alias("most"))

    def parts(n):
        return F.ceil(n * 2 / F.lit(CROWDED)).cast("long")

    rest, most = parts(F.col("n") - F.col("n_most")), parts(F.col("n_most"))
    inside = F.col("component") == F.col("most")
    part = F.pmod(F.xxhash64("rep"), F.when(inside, most).otherwise(rest))
    # Sub-blocks of the rest come first; a block is named by its two sub-blocks, the lower one from the rest.
    own = F.when(inside, rest + part).otherwise(part)
    last = F.when(inside, rest).otherwise(rest + most)
    others = F.when(F.col("n") <= CROWDED, F.array(F.lit(0).cast("long"))).otherwise(
        F.sequence(F.lit(0).cast("long"), last - 1))
    return members.select("bucket", "rep", "component").join(sizes, "bucket").select(
        "bucket", "rep", "component", F.when(F.col("n") <= CROWDED, 0).otherwise(own).alias("own"),
        F.explode(others).alias("other")).select(
        "bucket", "rep", "component", F.struct(F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b")).alias("block"),
        (F.col("own") > F.col("other")).cast("int").alias("side"))
