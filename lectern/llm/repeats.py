"""Removes the bytes that a document repeats from documents of smaller ids, by suffixes taken bucket by bucket.

A suffix takes part with its first ``length`` bytes. A difference cover modulo V picks the sample
suffixes: of any two places in two texts, some distance below V leads to sampled places in both.
So of two equal stretches of ``length`` bytes, some ``length - V + 1`` bytes begin at a sampled
place in both, and these shorter sample strings, a quarter of all places, are ranked first.
Only a suffix that reaches a repeated sample can be repeated itself; these few are sorted in a
second pass, with the repeated samples known.

Both passes sort one bucket of suffixes at a time, each in a task of its own. Documents lie in
lots of bounded size; a lot sends a bucket its distinct strings once, as names of fixed width
(with the smallest document of each), and gets a bit back for every name, in the order sent.
What crosses the network is therefore four bytes for a sample, eight for a candidate suffix and
a bit for the answer, however often a passage is repeated; no bucket has more of a passage than
there are lots. Equality of a fixed number of bytes is all that is asked of the order, so
buckets and order go by mixed names and not by leading bytes, which a common beginning would
crowd. A sample's name may rarely agree with another's: that only adds a candidate. A
candidate's has 64 bits inside its bucket.
"""

from __future__ import annotations

import hashlib
import math
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.files import new_file, random_access
from lectern.session import new_folder, written

LENGTH = 50
# A perfect difference set, every difference modulo V once.
V, COVER = 21, (3, 6, 7, 12, 14)
LOT_BYTES = 8 << 20
#: Names that one bucket's task sorts, about; the number of buckets follows from it.
BUCKET_NAMES = 1 << 21
NO_ID = (1 << 63) - 1
#: Stretches turned into names at a time.
CHUNK = 1 << 16

NAMES = "bucket long, lot string, names binary, ids binary, runs binary"
ANSWERS = "lot string, bucket long, bits binary"
RESULT = ("doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, "
          "spans array<struct<start:long,end:long>>, kept binary")


@contextmanager
def shuffle_files_dropped(spark: SparkSession) -> Iterator[None]:
    """Inside, the shuffle files of a write go when it ends: a stored table does not need them."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def _store_lots(folder: str, least: int) -> Callable:
    """Cuts a task's documents into lots, each sorted by id in a file of the attempt's own name."""

    def stored(ids: list, texts: list) -> pa.RecordBatch:
        order = sorted(range(len(ids)), key=lambda i: NO_ID if ids[i] is None else ids[i])
        rows = pa.RecordBatch.from_pydict(
            {"id": pa.array([ids[i] for i in order], pa.int64()), "text": pa.array([texts[i] for i in order], pa.large_binary())})
        lot = uuid.uuid4().hex
        with new_file(f"{folder}/{lot}.arrow") as out:
            with pa.ipc.new_file(out, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as file:
                file.write_batch(rows)
        return pa.RecordBatch.from_pydict({"lot": [lot], "docs": [len(ids)], "bytes": [sum(map(len, texts))]})

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, size = [], [], 0
        for batch in batches:
            for row in range(batch.num_rows):
                text = batch.column(1)[row].as_py()
                ids.append(batch.column(0)[row].as_py())
                texts.append(text)
                size += len(text)
                if size >= least:
                    yield stored(ids, texts)
                    ids, texts, size = [], [], 0
        if ids:
            yield stored(ids, texts)

    return store


@dataclass
class Texts:
    """Documents end to end: their bytes, where each begins, and their ids in rising order."""

    data: np.ndarray
    begins: np.ndarray
    ids: np.ndarray

    @classmethod
    def of(cls, rows: pa.Table) -> Texts:
        ids = rows.column("id").fill_null(NO_ID).to_numpy()
        text = rows.column("text").combine_chunks()
        text = text.chunk(0) if isinstance(text, pa.ChunkedArray) else text
        begins = np.frombuffer(text.buffers()[1], np.int64)[text.offset:text.offset + len(text) + 1] if len(text) else np.zeros(1, np.int64)
        data = np.frombuffer(text.buffers()[2], np.uint8)[begins[0]:begins[-1]] if len(text) and text.buffers()[2] else np.empty(0, np.uint8)
        return cls(data, begins - begins[0], ids)

    @property
    def sizes(self) -> np.ndarray:
        return np.diff(self.begins)

    def rows_of(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.begins, places, side="right") - 1


def _read_lot(path: str) -> pa.Table:
    with random_access(path) as file:
        return pa.ipc.open_file(file).read_all()


def _mixed(data: np.ndarray, places: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit names of the ``length`` bytes at each place."""
    first, second = np.empty(len(places), np.uint64), np.empty(len(places), np.uint64)
    if not len(places):
        return first, second
    windows = np.lib.stride_tricks.sliding_window_view(data, length)
    width = -(-length // 8) * 8
    for at in range(0, len(places), CHUNK):
        here = places[at:at + CHUNK]
        padded = np.zeros((len(here), width), np.uint8)
        padded[:, :length] = windows[here]
        x, y = np.full(len(here), 0x9E3779B97F4A7C15, np.uint64), np.full(len(here), 0xC2B2AE3D27D4EB4F, np.uint64)
        for word in padded.view(np.uint64).T:
            x = (x ^ word) * np.uint64(0xFF51AFD7ED558CCD)
            x ^= x >> np.uint64(32)
            y = (y + word) * np.uint64(0xC4CEB9FE1A85EC53)
            y ^= y >> np.uint64(29)
        first[at:at + CHUNK], second[at:at + CHUNK] = x * np.uint64(0x9FB21C651E98DF25), y * np.uint64(0xA0761D6478BD642F)
    return first, second


@dataclass
class Named:
    """A lot's strings: the distinct (bucket, name) in the order they are sent, and which of them each place has."""

    bucket: np.ndarray
    name: np.ndarray
    least: np.ndarray  # the smallest row of the lot that has it
    most: np.ndarray
    of_place: np.ndarray

    @classmethod
    def of(cls, bucket: np.ndarray, name: np.ndarray, row: np.ndarray, by_row: bool) -> Named:
        order = np.argsort(name)
        order = order[np.argsort(bucket[order], kind="stable")]
        b, h, r = bucket[order], name[order], row[order]
        new = np.ones(len(b), bool)
        new[1:] = (b[1:] != b[:-1]) | (h[1:] != h[:-1])
        start = np.flatnonzero(new)
        of_place = np.empty(len(b), np.int64)
        of_place[order] = np.cumsum(new) - 1
        if not len(start):
            return cls(b, h, r, r, of_place)
        least, most = np.minimum.reduceat(r, start), np.maximum.reduceat(r, start)
        found = cls(b[start], h[start], least, most, of_place)
        if by_row:  # names of one document stand together, so that its id is sent once a bucket
            order = np.lexsort((least, found.bucket))
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            found = cls(found.bucket[order], found.name[order], least[order], most[order], place[of_place])
        return found

    def rows(self, lot: str, ids: np.ndarray | None) -> pa.RecordBatch:
        """A row per bucket; ``ids`` are the ids of the lot's rows where the answer asks for them."""
        edges = np.flatnonzero(np.r_[True, self.bucket[1:] != self.bucket[:-1], True]) if len(self.bucket) else np.zeros(1, np.int64)
        out = {"bucket": [], "lot": [], "names": [], "ids": [], "runs": []}
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
            out["bucket"].append(int(self.bucket[a]))
            out["lot"].append(lot)
            out["names"].append(self.name[a:b].tobytes())
            mine = ids[self.least[a:b]] if ids is not None else np.empty(0, np.int64)
            starts = np.flatnonzero(np.r_[True, mine[1:] != mine[:-1]]) if len(mine) else np.empty(0, np.int64)
            out["ids"].append(mine[starts].tobytes())
            out["runs"].append(np.diff(np.r_[starts, len(mine)]).astype(np.int32).tobytes() if len(mine) else b"")
        return pa.RecordBatch.from_pydict(out, schema=pa.schema([
            ("bucket", pa.int64()), ("lot", pa.string()), ("names", pa.binary()), ("ids", pa.binary()), ("runs", pa.binary())]))

    def bits(self, answers: dict[int, bytes]) -> np.ndarray:
        """The answers to all names, in their order."""
        if not len(self.bucket):
            return np.empty(0, bool)
        edges = np.flatnonzero(np.r_[True, self.bucket[1:] != self.bucket[:-1], True])
        return np.concatenate([
            np.unpackbits(np.frombuffer(answers[int(self.bucket[a])], np.uint8), count=b - a).astype(bool)
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist())])


def _answers(width: type, by_id: bool) -> Callable[[pa.Table], pa.Table]:
    """Sorts a bucket's names. A bit per name and lot: is it in another lot, or, by id, in a document of a smaller id?"""

    def answer(table: pa.Table) -> pa.Table:
        parts = [np.frombuffer(v.as_py(), width) for v in table.column("names")]
        name, sizes = np.concatenate(parts), [len(p) for p in parts]
        order = np.argsort(name)
        start = np.flatnonzero(np.r_[True, name[order][1:] != name[order][:-1]])
        times = np.diff(np.r_[start, len(name)])
        told = np.empty(len(name), bool)
        if by_id:
            ids = np.concatenate([np.repeat(np.frombuffer(i.as_py(), np.int64), np.frombuffer(r.as_py(), np.int32))
                                  for i, r in zip(table.column("ids"), table.column("runs"))])[order]
            told[order] = ids > np.repeat(np.minimum.reduceat(ids, start), times)
        else:
            told[order] = np.repeat(times > 1, times)
        bits = [np.packbits(part).tobytes() for part in np.split(told, np.cumsum(sizes)[:-1])]
        return pa.table({"lot": table.column("lot"), "bucket": table.column("bucket"), "bits": pa.array(bits, pa.binary())})

    return answer


@dataclass(frozen=True)
class Plan:
    folder: str
    length: int
    whole_buckets: int
    buckets: int

    @property
    def sample(self) -> int:
        return self.length - V + 1

    def lot(self, lot: str) -> pa.Table:
        return _read_lot(f"{self.folder}/{lot}.arrow")

    def whole(self, rows: pa.Table) -> tuple[np.ndarray, Named, Texts]:
        """(rows long enough, their whole texts by name, their texts)."""
        texts = Texts.of(rows)
        long = np.flatnonzero(texts.sizes >= self.length)
        data = memoryview(texts.data)
        digests = np.frombuffer(b"".join(
            hashlib.blake2b(data[texts.begins[i]:texts.begins[i + 1]], digest_size=16).digest() for i in long), np.uint64).reshape(-1, 2)
        bucket = (digests[:, 1] % np.uint64(self.whole_buckets)).astype(np.uint32)
        return long, Named.of(bucket, digests[:, 0], long, by_row=True), texts

    def first_copies(self, rows: pa.Table, told: dict[int, bytes]) -> tuple[np.ndarray, Texts]:
        """(row is a copy of a text of a smaller id, the texts that are none)."""
        long, named, texts = self.whole(rows)
        copy = np.zeros(len(texts.ids), bool)
        copy[long] = named.bits(told)[named.of_place] | (texts.ids[long] > texts.ids[named.least[named.of_place]])
        keep = np.zeros(len(copy), bool)
        keep[long] = ~copy[long]
        return copy, Texts.of(rows.filter(pa.array(keep)))

    def samples(self, texts: Texts) -> tuple[np.ndarray, Named]:
        """(places of the sample suffixes, their strings)."""
        within = np.arange(len(texts.data), dtype=np.int32) - np.repeat(texts.begins[:-1].astype(np.int32), texts.sizes)
        covered = np.isin(np.arange(V), COVER)[within % V]
        covered &= within <= np.repeat((texts.sizes - self.sample).astype(np.int32), texts.sizes)
        places = np.flatnonzero(covered)
        name, _ = _mixed(texts.data, places, self.sample)
        bucket = ((name & np.uint64(0xFFFFFFFF)) % np.uint64(self.buckets)).astype(np.uint32)
        return places, Named.of(bucket, (name >> np.uint64(32)).astype(np.uint32), texts.rows_of(places), by_row=False)

    def candidates(self, texts: Texts, told: dict[int, bytes]) -> tuple[np.ndarray, Named]:
        """(places of the suffixes that reach a repeated sample, their first bytes by name)."""
        places, named = self.samples(texts)
        repeated = (named.bits(told) | (named.least != named.most))[named.of_place] if len(places) else np.empty(0, bool)
        marks = np.zeros(len(texts.data) + V + 1, np.int32)
        marks[places[repeated] + 1] = 1
        before = np.cumsum(marks, dtype=np.int32)  # repeated samples before a place
        reaches = before[V:V + len(texts.data)] > before[:len(texts.data)]
        within = np.arange(len(texts.data), dtype=np.int32) - np.repeat(texts.begins[:-1].astype(np.int32), texts.sizes)
        reaches &= within <= np.repeat((texts.sizes - self.length).astype(np.int32), texts.sizes)
        found = np.flatnonzero(reaches)
        name, other = _mixed(texts.data, found, self.length)
        bucket = (other % np.uint64(self.buckets)).astype(np.uint32)
        return found, Named.of(bucket, name, texts.rows_of(found), by_row=True)

    def repeated(self, texts: Texts, samples: dict[int, bytes], windows: dict[int, bytes]) -> np.ndarray:
        """Places whose first bytes also start in a document of a smaller id, in rising order."""
        found, named = self.candidates(texts, samples)
        if not len(found):
            return found
        own = texts.ids[texts.rows_of(found)]
        return found[named.bits(windows)[named.of_place] | (own > texts.ids[named.least[named.of_place]])]


def _told(answers: pa.Table) -> dict[str, dict[int, bytes]]:
    out: dict[str, dict[int, bytes]] = {"whole": {}, "sample": {}, "window": {}}
    for row in answers.to_pylist():
        out[row["ask"]][row["bucket"]] = row["bits"]
    return out


def _removed(plan: Plan, kept_bytes: bool):
    def removed(lots: pa.Table, answers: pa.Table) -> pa.Table:
        told = _told(answers)
        rows = plan.lot(lots.column("lot")[0].as_py())
        copy, texts = plan.first_copies(rows, told["whole"])
        places = plan.repeated(texts, told["sample"], told["window"])
        row = texts.rows_of(places)
        new = np.ones(len(places), bool)
        new[1:] = (places[1:] > places[:-1] + plan.length) | (row[1:] != row[:-1])
        starts = np.flatnonzero(new)
        ends = places[np.r_[starts[1:] - 1, len(places) - 1]] + plan.length if len(places) else places
        spans: dict[int, list] = {}
        for r, a, b in zip(row[starts].tolist(), places[starts].tolist(), ends.tolist()):
            spans.setdefault(r, []).append((a - int(texts.begins[r]), b - int(texts.begins[r])))
        everything = Texts.of(rows)
        data = memoryview(everything.data)
        kept_row = 0
        out = []
        for i, (a, b, n) in enumerate(zip(everything.begins[:-1].tolist(), everything.begins[1:].tolist(), everything.sizes.tolist())):
            mine: list = []
            if copy[i]:
                mine = [(0, n)]
            elif n >= plan.length:
                mine = spans.get(kept_row, [])
                kept_row += 1
            text = data[a:b]
            if mine:
                edges = [0, *(x for span in mine for x in span), n]
                text = b"".join(text[x:y] for x, y in zip(edges[::2], edges[1::2]))
            out.append((n, sum(y - x for x, y in mine), len(mine), hashlib.sha256(text).hexdigest(),
                        [{"start": x, "end": y} for x, y in mine], bytes(text) if kept_bytes else None))
        columns = list(zip(*out))
        types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.binary()]
        return pa.table([rows.column("id").combine_chunks(), *[pa.array(c, t) for c, t in zip(columns, types)]],
                        names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept"])

    return removed


def without_repeats(documents: DataFrame, length: int = LENGTH, kept_bytes: bool = True, lot_bytes: int = LOT_BYTES,
                    bucket_names: int = BUCKET_NAMES) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans, kept), a row per row of ``documents``.

    ``documents`` has (doc_id, text); other columns are not looked at. A byte goes if a stretch of
    ``length`` bytes (at least 29) over it also starts in a document of a smaller id. ``spans`` are
    the maximal removed runs, ``kept`` the rest as bytes (null without ``kept_bytes``), which need not
    be whole characters. Null and empty texts have no bytes and keep none. Documents of one id do
    not take from each other, repeated rows included. A null id counts as greater than all others.
    An empty table gives no rows.

    ``lot_bytes`` bounds what a task holds (a longer document is a lot of its own), ``bucket_names``
    what a bucket sorts, about; raise both on larger machines.
    """
    if length - V + 1 < 9:
        raise ValueError(f"length must be at least {V + 8}")
    spark = documents.sparkSession
    folder = new_folder(spark, "repeat-lots")
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    lots = written(rows.mapInArrow(_store_lots(folder, lot_bytes), "lot string, docs long, bytes long"), "repeat-lots")
    n, docs, size = lots.agg(F.count("*"), F.sum("docs"), F.sum("bytes")).first()
    plan = Plan(folder, length, max(1, math.ceil((docs or 0) / bucket_names)),
                max(1, math.ceil((size or 0) * len(COVER) / V / bucket_names)))
    tasks = max(1, n)
    dealt = lots.select("lot").repartition(tasks, "lot")

    def asked(ask: str, names: DataFrame, buckets: int, width: type, by_id: bool) -> DataFrame:
        told = names.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(_answers(width, by_id), ANSWERS)
        with shuffle_files_dropped(spark):
            return written(told.withColumn("ask", F.lit(ask)), f"repeat-{ask}")

    def whole_names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lot in batch.column(0).to_pylist():
                _, named, texts = plan.whole(plan.lot(lot))
                yield named.rows(lot, texts.ids)

    def sample_names(mine: pa.Table, answers: pa.Table) -> pa.Table:
        lot = mine.column("lot")[0].as_py()
        _, texts = plan.first_copies(plan.lot(lot), _told(answers)["whole"])
        return pa.Table.from_batches([plan.samples(texts)[1].rows(lot, None)])

    def window_names(mine: pa.Table, answers: pa.Table) -> pa.Table:
        lot, told = mine.column("lot")[0].as_py(), _told(answers)
        _, texts = plan.first_copies(plan.lot(lot), told["whole"])
        return pa.Table.from_batches([plan.candidates(texts, told["sample"])[1].rows(lot, texts.ids)])

    def with_answers(answers: DataFrame):
        return dealt.groupBy("lot").cogroup(answers.repartition(tasks, "lot").groupBy("lot"))

    told = asked("whole", dealt.mapInArrow(whole_names, NAMES), plan.whole_buckets, np.uint64, True)
    samples = with_answers(told).applyInArrow(sample_names, NAMES)
    told = told.unionByName(asked("sample", samples, plan.buckets, np.uint32, False))
    windows = with_answers(told).applyInArrow(window_names, NAMES)
    told = told.unionByName(asked("window", windows, plan.buckets, np.uint64, True))
    return with_answers(told).applyInArrow(_removed(plan, kept_bytes), RESULT)
