"""Token ids as length-delimited binary records, with a separate offset index.

A shard is a row of records: length (8 bytes), masked check sum of the length (4 bytes),
data, masked check sum of the data (4 bytes). All integers are little-endian; check sums
are CRC-32, turned right by 15 bits with a constant added, so that a check sum of data that
holds check sums stays sound. The data are: doc id (8 bytes), a flag byte (1: there is an
id), the width of an id in bytes (1 byte), and the token ids. Beside each shard an index
file holds the offset of every record as 8-byte integers, for reads in shuffled order.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm import files, tokens
from lectern.llm.common import as_batch, as_lists, shipped
from lectern.session import new_folder, written

# Fixed value: what record files of this kind add to a turned check sum.
MASK_DELTA = 0xA282EAD8
SHARD_BYTES = 64 << 20
HEAD, FOOT, DATA = struct.Struct("<QI"), struct.Struct("<I"), struct.Struct("<qBB")

SHARDS = "shard string, first_record long, n_records long, n_tokens long, bytes long"
SHARD_SCHEMA = pa.schema([("shard", pa.string()), *[(c, pa.int64()) for c in ("first_record", "n_records", "n_tokens", "bytes")]])
READ = "doc_id long, start long, n_tokens long, ids_crc32 long, shard string, record long"


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + MASK_DELTA) & 0xFFFFFFFF


def frame(data: bytes) -> bytes:
    size = struct.pack("<Q", len(data))
    return size + FOOT.pack(masked(size)) + data + FOOT.pack(masked(data))


def unframed(stream) -> Iterator[bytes]:
    """The records of a shard in order; raises if a check sum is wrong or the file ends inside one."""
    while head := stream.read(HEAD.size):
        if len(head) < HEAD.size:
            raise ValueError("the shard ends inside a record")
        size, crc = HEAD.unpack(head)
        if masked(head[:8]) != crc:
            raise ValueError("wrong check sum of a length")
        data, foot = stream.read(size), stream.read(FOOT.size)
        if len(data) < size or len(foot) < FOOT.size:
            raise ValueError("the shard ends inside a record")
        if masked(data) != FOOT.unpack(foot)[0]:
            raise ValueError("wrong check sum of a record")
        yield bytes(data)


def serialized(doc_id: int | None, ids: np.ndarray) -> bytes:
    return DATA.pack(0 if doc_id is None else doc_id, doc_id is not None, ids.itemsize) + ids.tobytes()


def parsed(data: bytes) -> tuple[int | None, np.ndarray]:
    doc_id, there, width = DATA.unpack_from(data)
    return doc_id if there else None, np.frombuffer(data, f"<u{width}", offset=DATA.size)


def read_at(shard: str, records: Sequence[int]) -> list[tuple[int | None, np.ndarray]]:
    """Records of a shard by number, in the order asked for, through the index."""
    with files.random_access(shard + ".idx") as f:
        offsets = np.frombuffer(f.read(), "<i8")
    found = []
    with files.random_access(shard) as f:
        for n in records:
            f.seek(int(offsets[n]))
            size, _ = HEAD.unpack(f.read(HEAD.size))
            f.seek(int(offsets[n]))
            data = f.read(HEAD.size + size + FOOT.size)
            found.append(parsed(next(unframed(_Bytes(data)))))
    return found


class _Bytes:
    """Sequential reads of bytes in memory."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def read(self, size: int) -> bytes:
        out = self.data[self.at:self.at + size]
        self.at += len(out)
        return out


def write_records(docs: DataFrame, tokenizer_path: str, folder: str | None = None,
                  shard_bytes: int = SHARD_BYTES, end_id: int = tokens.END_ID) -> DataFrame:
    """Encodes (doc_id, text) and writes shards in ascending doc_id order; returns the manifest.

    One row per shard, whose names sort like the ids they hold. A null text is an empty one;
    a null id comes first and is kept as null; repeated rows are records of their own; an
    empty table gives no shard. Other columns are ignored.
    """
    spark = docs.sparkSession
    folder = folder or new_folder(spark, "records")
    get_spec = shipped(spark, tokens.spec_of(tokenizer_path))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        rows = (row for lists in as_lists(batches)
                for row in zip(lists["doc_id"], tokens.encoded(get_spec(), lists["text"], end_id)))
        row, shard, first = next(rows, None), 0, 0
        while row is not None:
            name, offsets, at, n_tokens = f"{folder}/part-{part:06d}-{shard:05d}.rec", [], 0, 0
            with files.new_file(name) as out:
                while row is not None and at < shard_bytes:
                    record = frame(serialized(*row))
                    out.write(record)
                    offsets.append(at)
                    at, n_tokens = at + len(record), n_tokens + len(row[1])
                    row = next(rows, None)
            with files.new_file(name + ".idx") as out:
                out.write(np.asarray(offsets, "<i8").tobytes())
            yield as_batch({"shard": [name], "first_record": [first], "n_records": [len(offsets)],
                            "n_tokens": [n_tokens], "bytes": [at]}, SHARD_SCHEMA)
            shard, first = shard + 1, first + len(offsets)

    ordered = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    return written(ordered.mapInArrow(write, SHARDS), "records-manifest")


def read_records(manifest: DataFrame) -> DataFrame:
    """Reads every shard whole: one row per record with the number of ids before it in all shards.

    The shards' totals, one row per shard, are summed up first; inside a shard the sum runs
    along with the reading.
    """
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    starts = manifest.select("shard", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("start"))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for shard, start in zip(pdf["shard"], pdf["start"]):
                rows = []
                with files.stream(shard) as f:
                    for n, data in enumerate(unframed(f)):
                        doc_id, ids = parsed(data)
                        rows.append((doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), shard, n))
                        start += len(ids)
                        if len(rows) == 10_000:
                            yield _frame(rows)
                            rows = []
                yield _frame(rows)

    return files.one_task_each(starts).mapInPandas(read, READ)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    pdf = pd.DataFrame(rows, columns=["doc_id", "start", "n_tokens", "ids_crc32", "shard", "record"])
    return pdf.astype({"doc_id": "Int64"})
