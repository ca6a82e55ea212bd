"""Packing token sequences into windows of fixed capacity by multiway number partitioning.

Documents are cut into pieces; pieces of full capacity fill a window alone. All other pieces
are dealt by hash into groups of a bounded number of tokens, and each group is partitioned
by Karmarkar-Karp differencing: every piece starts as a partition of k windows with one
filled, and the two partitions of largest imbalance are merged again and again, fullest
against emptiest, until one is left. Where its fullest window is above capacity, the group
is partitioned anew with one window more.
"""

from __future__ import annotations

import heapq
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm import tokens
from lectern.llm.common import as_batch, as_lists, shipped
from lectern.session import written

CAPACITY = 4096
PIECE = 512
GROUP_WINDOWS, GROUP_PIECES = 256, 16_384

PIECES = ("piece_id long, doc_id long, start long, length long, ids_crc32 long, doc_tokens long, ids binary")
PIECE_SCHEMA = pa.schema([*[(c, pa.int64()) for c in ("piece_id", "doc_id", "start", "length", "ids_crc32", "doc_tokens")],
                          ("ids", pa.binary())])
PLACED = ("piece_id long, doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
          "sequence_id long, offset long")


def cuts(n: int, capacity: int = CAPACITY, piece: int = PIECE) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: full windows first, the rest in pieces of at most ``piece``."""
    full = n // capacity * capacity
    places = [(at, capacity) for at in range(0, full, capacity)]
    return places + [(at, min(piece, n - at)) for at in range(full, n, piece)]


def partition(sizes: np.ndarray, k: int) -> np.ndarray:
    """The window (0 to k-1) of each piece by multiway differencing; ties go by position."""
    n = len(sizes)
    if k <= 1 or n <= 1:
        return np.zeros(n, np.int64)
    order = np.argsort(-sizes, kind="stable")
    # A node is a partition of k windows: its sums in ascending order less the least, the spread last.
    heap = [(-int(sizes[i]), rank, rank) for rank, i in enumerate(order)]
    heapq.heapify(heap)
    sums: dict[int, np.ndarray] = {}
    merges: list[tuple[int, int, np.ndarray]] = []

    def slots(node: int) -> np.ndarray:
        if node < n:
            own = np.zeros(k, np.int64)
            own[-1] = sizes[order[node]]
            return own
        return sums.pop(node)

    node = n
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        joined = slots(a) + slots(b)[::-1]
        by = np.argsort(joined, kind="stable")
        merged = joined[by]
        sums[node] = merged - merged[0]
        merges.append((a, b, by))
        heapq.heappush(heap, (-int(sums[node][-1]), node, node))
        node += 1
    # Walk back: the window of each slot of a node goes to the slots of what it was merged from.
    windows = {node - 1: np.arange(k)}
    placed = np.zeros(n, np.int64)
    for number in range(node - 1, n - 1, -1):
        a, b, by = merges[number - n]
        mine = np.empty(k, np.int64)
        mine[by] = windows.pop(number)
        for child, own in ((a, mine), (b, mine[::-1])):
            if child < n:
                placed[order[child]] = own[-1]
            else:
                windows[child] = own
    return placed


def balanced(sizes: np.ndarray, capacity: int = CAPACITY) -> np.ndarray:
    """Windows of near-equal sums, none above capacity; as few as differencing finds from the least number on."""
    k = max(1, -(-int(sizes.sum()) // capacity))
    while True:
        placed = partition(sizes, k)
        if len(sizes) == 0 or np.bincount(placed, sizes).max() <= capacity:
            return placed
        k += 1


def padded_length(used: Column, capacity: int = CAPACITY) -> Column:
    """A sequence is padded to capacity unless its length is a power of two."""
    power = F.pow(F.lit(2), F.round(F.log2(used))).cast("long") == used
    return F.when(power, used).otherwise(F.lit(capacity)).cast("long")


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, piece: int = PIECE,
                 end_id: int = tokens.END_ID) -> DataFrame:
    """(doc_id, text) -> stored pieces with their ids; the document's end id is its last.

    A null text is an empty one and gives the end id alone; repeated rows have pieces of
    their own; other columns are ignored.
    """
    get_spec = shipped(docs.sparkSession, tokens.spec_of(tokenizer_path))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 36
        for lists in as_lists(batches):
            out: dict[str, list] = {name: [] for name in PIECE_SCHEMA.names}
            for doc_id, ids in zip(lists["doc_id"], tokens.encoded(get_spec(), lists["text"], end_id)):
                wide = ids.astype("<u4")
                for start, length in cuts(len(ids), capacity, piece):
                    row = (number, doc_id, start, length, zlib.crc32(wide[start:start + length].tobytes()), len(ids),
                           ids[start:start + length].tobytes())
                    for column, value in zip(out.values(), row):
                        column.append(value)
                    number += 1
            yield as_batch(out, PIECE_SCHEMA)

    return written(docs.select("doc_id", "text").mapInArrow(cut, PIECES), "pieces")


def place(pieces: DataFrame, capacity: int = CAPACITY, group_windows: int = GROUP_WINDOWS,
          group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Stored pieces -> their sequence and offset there. Only lengths and ids of pieces are moved.

    The number of groups follows from the tokens and the pieces, so a group holds about
    ``group_windows`` windows and ``group_pieces`` pieces at most at every size; the hash that deals pieces to groups knows no source or key.
    """
    total, count = pieces.agg(F.sum("length"), F.count("*")).first()
    groups = max(1, round((total or 0) / (capacity * group_windows)), math.ceil(count / group_pieces))
    names = [c.split()[0] for c in PLACED.split(", ")]

    def pack(group: pa.Table) -> pa.Table:
        group = group.sort_by("piece_id")
        sizes = group["length"].to_numpy()
        full = sizes == capacity
        window = np.empty(len(sizes), np.int64)
        window[~full] = balanced(sizes[~full], capacity)
        base = window[~full].max() + 1 if (~full).any() else 0
        window[full] = base + np.arange(full.sum())
        order = np.argsort(window, kind="stable")
        before = np.cumsum(sizes[order]) - sizes[order]
        first = np.r_[True, window[order][1:] != window[order][:-1]]
        offset = np.empty(len(sizes), np.int64)
        offset[order] = before - np.maximum.accumulate(np.where(first, before, 0))
        placed = group.append_column("sequence_id", pa.array((group["_group"].to_numpy() << 24) + window))
        return placed.append_column("offset", pa.array(offset)).select(names)

    dealt = pieces.drop("ids").withColumn("_group", F.pmod(F.xxhash64("piece_id"), F.lit(groups)).cast("long"))
    return dealt.groupBy("_group").applyInArrow(pack, PLACED)


def sequences(pieces: DataFrame, placed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The training rows: sequence_id, used, padded_length and the pieces' ids, in the order of their offsets."""
    joined = pieces.select("piece_id", "ids").join(placed, "piece_id")
    rows = joined.groupBy("sequence_id").agg(
        F.sum("length").alias("used"),
        F.sort_array(F.collect_list(F.struct("offset", "doc_id", "start", "length", "ids"))).alias("pieces"))
    return rows.select("sequence_id", "used", padded_length(F.col("used"), capacity).alias("padded_length"), "pieces")


def pack(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """(doc_id, text) -> a row per piece with its place; an empty table gives no row."""
    return place(token_pieces(docs, tokenizer_path)).drop("piece_id")
