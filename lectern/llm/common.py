"""What the corpus operators share: the word rule, input tables, held-out rows and row-local arrays."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.text import bound  # noqa: F401  used by the operators

# A word, and the white space between words.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"

HELD_OUT_PARTS, HELD_OUT_PART = 4, 2


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def whole_text(column: str = "text") -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(column), F.lit(""))


def held_out(column: str = "doc_id") -> Column:
    """Rows kept from every fit, by the check sum of the id as text; a null id is not held out."""
    part = F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(HELD_OUT_PARTS))
    return F.coalesce(part == HELD_OUT_PART, F.lit(False))


def words(text: Column) -> Column:
    """The words of a text in order; empty for a text without words."""
    trimmed = F.btrim(text, F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(
        F.split(trimmed, r"[\x20\x09-\x0D]+", -1)
    )


def shipped(spark: SparkSession, value: object) -> Callable[[], object]:
    """A fitted model or sketch of bounded size as a broadcast; call the result inside a task."""
    sent = spark.sparkContext.broadcast(pickle.dumps(value))
    cell: list[object] = []

    def get() -> object:
        if not cell:
            cell.append(pickle.loads(sent.value))
        return cell[0]

    return get


#: Bytes of text that a task turns into Python objects at a time.
LOT_BYTES = 4 << 20


def lots(batch: pa.RecordBatch, most: int = LOT_BYTES) -> Iterator[pa.RecordBatch]:
    """A batch in slices whose texts hold at most ``most`` bytes; a longer text is a slice of its own."""
    if "text" not in batch.schema.names or batch.nbytes <= most:
        yield batch
        return
    until = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at, before = 0, 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(until, before + most, side="right")))
        yield batch.slice(at, end - at)
        at, before = end, int(until[end - 1])


def as_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, list]]:
    """Batches, cut into lots, as a list per column. Whole numbers beside nulls stay whole, which they would not in pandas."""
    for batch in batches:
        for lot in lots(batch):
            yield lot.to_pydict()


def as_batch(columns: dict[str, list], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(columns, schema=schema)
