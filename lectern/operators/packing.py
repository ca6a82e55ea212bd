"""Packing of request rows into parts of limited rows and bytes, in order."""

from __future__ import annotations

import math
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.config import MAX_BYTES_PER_PART, MAX_REQUESTS_PER_PART
from lectern.operators.ordinals import dense_numbers
from lectern.session import written


def part_file(prefix: str, index: Column) -> Column:
    """Fixed format of part file names: requests, output or remote-errors."""
    return F.format_string(f"{prefix}.part-%04d.jsonl", index)


def pack_by_count(numbered: DataFrame, max_rows: int = MAX_REQUESTS_PER_PART) -> DataFrame:
    """Add part_index when only the row cap applies; ``rn`` is the dense row number."""
    return numbered.withColumn("part_index", F.floor((F.col("rn") - 1) / max_rows).cast("long") + 1)


def numbered_requests(requests: DataFrame, bucket: Column, order: list[Column]) -> DataFrame:
    return dense_numbers(requests, ["corpus_id"], bucket, order, "rn")


def _next_starts(size: np.ndarray, max_rows: int, max_bytes: int) -> np.ndarray:
    """For a part starting at each row, the row where the next part starts; a row too large for any is alone."""
    total, place = np.concatenate(([0], np.cumsum(size))), np.arange(len(size))
    by_bytes = np.searchsorted(total, total[:-1] + max_bytes, side="right") - 1
    return np.minimum(np.maximum(by_bytes, place + 1), place + max_rows)


def pack_parts(
    numbered: DataFrame,
    max_rows: int = MAX_REQUESTS_PER_PART,
    max_bytes: int = MAX_BYTES_PER_PART,
    oversize_alone: bool = False,
) -> DataFrame:
    """(corpus_id, rn, bytes, part_index): greedy packing under both caps.

    ``numbered``: corpus_id, rn (dense, from 1), bytes. The greedy rule looks
    sequential, but a part holds at most ``max_rows`` rows. So each corpus is cut
    into stretches of 2 * max_rows rows, and every stretch is walked on its own for
    each place where a part may start in it (one of its first ``max_rows`` rows),
    with the head of the following stretch at hand. That yields, per possible entry,
    the entry into the following stretch. The true entries are then found by joining
    this relation with itself, doubling the distance covered each time.
    A row larger than ``max_bytes`` is an error, or with ``oversize_alone`` a part of its own.
    """
    span = 2 * max_rows
    checked = F.col("bytes") if oversize_alone else F.when(F.col("bytes") <= max_bytes, F.col("bytes")).otherwise(
        F.raise_error(F.concat(F.lit("request larger than a part in "), F.col("corpus_id")))
    )
    rows = written(numbered.select("corpus_id", "rn", checked.cast("long").alias("bytes")), "pack-rows")
    own = F.floor((F.col("rn") - 1) / span).cast("long")
    ahead = (F.col("rn") - 1) % span < max_rows
    stretches = rows.select(
        "*", F.explode(F.when(ahead & (own > 0), F.array(own, own - 1)).otherwise(F.array(own))).alias("stretch")
    )

    def exits(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        corpus, stretch = key
        frame = frame.sort_values("rn")
        first, end = stretch * span + 1, (stretch + 1) * span
        following = frame.rn.iloc[0] + _next_starts(frame.bytes.to_numpy(), max_rows, max_bytes)
        inside = int((frame.rn <= end).sum())
        target, parts = following[:inside].copy(), np.ones(inside, dtype=np.int64)
        for i in range(inside - 1, -1, -1):
            j = target[i] - first
            if j < inside:
                target[i], parts[i] = target[j], parts[i] + parts[j]
        entries = min(max_rows if stretch else 1, inside)
        return pd.DataFrame({
            "corpus_id": corpus, "stretch": stretch,
            "entry": np.arange(first, first + entries), "target": target[:entries], "parts": parts[:entries],
        })

    steps = written(
        stretches.groupBy("corpus_id", "stretch").applyInPandas(
            exits, "corpus_id string, stretch long, entry long, target long, parts long"
        ),
        "pack-steps",
    )
    entered = steps.select("corpus_id", F.col("target").alias("entry")).distinct()
    jumps = steps.filter("stretch = 0").unionByName(
        steps.filter("stretch > 0").join(entered, ["corpus_id", "entry"], "left_semi")
    ).select("corpus_id", "entry", "target", "parts")
    # A target just past the last row marks a stretch that holds only the tail of a part.
    reached = steps.filter("stretch = 0").select(
        "corpus_id", "entry", F.lit(1).cast("long").alias("first_part")
    )
    last = steps.agg(F.max("stretch")).first()[0] or 0
    for level in range(math.ceil(math.log2(last + 1))):
        landing = jumps.select("corpus_id", "entry", F.col("target").alias("_t"), F.col("parts").alias("_p"))
        forward = reached.join(landing, ["corpus_id", "entry"]).select(
            "corpus_id", F.col("_t").alias("entry"), (F.col("first_part") + F.col("_p")).alias("first_part")
        )
        reached = written(reached.unionByName(forward), f"pack-reached-{level}")
        onward = landing.withColumnRenamed("entry", "target")
        jumps = written(
            jumps.join(onward, ["corpus_id", "target"], "left").select(
                "corpus_id",
                "entry",
                F.coalesce("_t", "target").alias("target"),
                (F.col("parts") + F.coalesce("_p", F.lit(0))).alias("parts"),
            ),
            f"pack-jumps-{level}",
        )
    entry_stretch = F.floor((F.col("entry") - 1) / span).cast("long").alias("stretch")
    entries = reached.groupBy("corpus_id", entry_stretch).agg(
        F.min(F.struct("entry", "first_part")).alias("start")
    ).select("corpus_id", "stretch", "start.*")

    def assign(key: tuple, frame: pd.DataFrame, start: pd.DataFrame) -> pd.DataFrame:
        columns = ["corpus_id", "rn", "bytes", "part_index"]
        if frame.empty:
            return pd.DataFrame(columns=columns)
        frame = frame.sort_values("rn").reset_index(drop=True)
        first = int(frame.rn.iloc[0])
        following = first + _next_starts(frame.bytes.to_numpy(), max_rows, max_bytes)
        own_rows = frame[frame.rn <= (key[1] + 1) * span]
        final = int(own_rows.rn.iloc[-1])
        starts, place = [], int(start.entry.iloc[0])
        while place <= final:
            starts.append(place)
            place = int(following[place - first])
        before = int(start.first_part.iloc[0]) - 1
        index = np.searchsorted(starts, own_rows.rn.to_numpy(), side="right") + before
        return own_rows.assign(part_index=index)[columns]

    return (
        stretches.groupBy("corpus_id", "stretch")
        .cogroup(entries.groupBy("corpus_id", "stretch"))
        .applyInPandas(assign, "corpus_id string, rn long, bytes long, part_index long")
    )


def parts_table(packed: DataFrame) -> DataFrame:
    """One row per part with its file name, rows and bytes."""
    return packed.groupBy("corpus_id", "part_index").agg(
        F.count("*").alias("request_count"), F.sum("bytes").alias("request_bytes")
    ).withColumn("request_file", part_file("requests", F.col("part_index")))
