"""Which terms of a list of any size occur in a text: hashes of byte windows, looked up in tables.

The terms are dealt by range into shards of bounded size, which tasks store. To match, a task
holds a lot of texts and takes one shard at a time. Sums of weighted bytes give the hash of any
window of the lot by one subtraction. A place is kept if the hash of its first 2^k bytes begins
a term of 2^k to 2^(k+1) - 1 bytes; only there are the terms' own lengths asked, and bytes are
compared where a hash is that of a term. So the work is that of the text and of what is found
in it: more terms make the tables larger, not the reading longer, up to the size of a shard. No
row is made per piece of a text, and neither the driver nor a task holds all terms.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lectern.session import new_folder, written

#: Bytes of terms in a shard, which bounds the tables a task holds.
SHARD_BYTES = 1 << 24
#: Bytes of text a task reads at a time, and bytes that are hashed at a time (more where terms are longer).
LOT_BYTES, WINDOW = 1 << 22, 1 << 17
#: Bytes of tables a worker keeps between lots.
KEPT_BYTES = 1 << 28
#: The longest beginning that is asked of every place.
BEGIN_BYTES = 32

SHARD = "low array<string>, pos array<long>, src array<string>, dst array<string>"

MASK = (1 << 64) - 1
BASE, SPREAD = 0x9E3779B97F4A7C15, np.uint64(0xD6E8FEB86659FD93)
BYTE = np.random.default_rng(20260101).integers(1, 1 << 63, 256, dtype=np.uint64)


def _powers(base: int, n: int) -> np.ndarray:
    powers = np.full(n, base, np.uint64)
    powers[:1] = 1
    return np.cumprod(powers, dtype=np.uint64)


class Hashed:
    """Bytes whose windows have hashes (equal windows have equal ones)."""

    powers, inverse = _powers(BASE, 1), _powers(pow(BASE, -1, 1 << 64), 1)

    def __init__(self, data: np.ndarray):
        if len(data) >= len(Hashed.powers):
            n = 2 * len(data) + 1
            Hashed.powers, Hashed.inverse = _powers(BASE, n), _powers(pow(BASE, -1, 1 << 64), n)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(BYTE[data] * Hashed.powers[:len(data)], out=self.sums[1:])

    def at(self, start: np.ndarray, width) -> np.ndarray:
        return (self.sums[start + width] - self.sums[start]) * Hashed.inverse[start] * SPREAD

    def everywhere(self, width: int) -> np.ndarray:
        n = max(0, len(self.sums) - width)
        return (self.sums[width:] - self.sums[:n]) * Hashed.inverse[:n] * SPREAD


def _hashes(data: np.ndarray, begin: np.ndarray, width: np.ndarray) -> np.ndarray:
    """Hashes of windows of terms that follow each other, a stretch of terms at a time."""
    out, at = np.empty(len(begin), np.uint64), 0
    while at < len(begin):
        to = max(at + 1, int(np.searchsorted(begin, begin[at] + WINDOW)))
        first, last = int(begin[at]), int(begin[to]) if to < len(begin) else len(data)
        out[at:to] = Hashed(data[first:last]).at(begin[at:to] - first, width[at:to])
        at = to
    return out


class Marks:
    """A table of flags by the leading bits of hashes; one flag in sixteen is set at most."""

    def __init__(self, hashes: np.ndarray):
        self.shift = np.uint64(64 - max(8, min(26, 4 + max(1, len(hashes) - 1).bit_length())))
        self.flags = np.zeros(1 << (64 - int(self.shift)), bool)
        self.flags[hashes >> self.shift] = True

    def of(self, hashes: np.ndarray) -> np.ndarray:
        return self.flags[hashes >> self.shift]


class Automaton:
    """The tables of one shard's terms. ``matches`` reads bytes and tells which entries occur."""

    def __init__(self, low: pa.Array, pos: np.ndarray, src: pa.Array, dst: pa.Array):
        self.low, self.pos, self.src, self.dst = low, pos, src, dst
        coded = low.dictionary_encode()
        number = np.asarray(coded.indices)
        self.entry = np.argsort(number, kind="stable")  # entries by term
        self.first_entry = np.searchsorted(number[self.entry], np.arange(len(coded.dictionary) + 1))
        terms = coded.dictionary.cast(pa.large_binary())
        begins = np.frombuffer(terms.buffers()[1], np.int64)[terms.offset:terms.offset + len(terms) + 1]
        self.data = np.frombuffer(terms.buffers()[2], np.uint8)
        self.begin, sizes = begins[:-1], np.diff(begins)
        self.longest = int(sizes.max())
        full = _hashes(self.data, self.begin, sizes)
        reach = np.minimum(BEGIN_BYTES, 1 << (np.frexp(sizes)[1] - 1))  # the greatest power of two within
        begun = _hashes(self.data, self.begin, reach)
        self.groups = []  # (bytes of the beginning, its marks, [(bytes, marks, hashes in order, their terms, most alike)])
        for first in np.unique(reach).tolist():
            lengths = []
            for size in np.unique(sizes[reach == first]).tolist():
                terms_of = np.flatnonzero(sizes == size)
                terms_of = terms_of[np.argsort(full[terms_of], kind="stable")]
                alike = int(np.unique(full[terms_of], return_counts=True)[1].max())
                lengths.append((size, Marks(full[terms_of]), full[terms_of], terms_of, alike))
            self.groups.append((first, Marks(np.unique(begun[reach == first])), lengths))

    @classmethod
    def of(cls, low: list[str], pos: list[int], src: list[str], dst: list[str]) -> Automaton:
        return cls.from_row({"low": low, "pos": pos, "src": src, "dst": dst})

    @property
    def size(self) -> int:
        flags = sum(marks.flags.nbytes + sum(m.flags.nbytes + 2 * h.nbytes for _, m, h, _, _ in lengths) for _, marks, lengths in self.groups)
        return flags + 3 * self.pos.nbytes + self.data.nbytes + self.low.nbytes + self.src.nbytes + self.dst.nbytes

    def row(self) -> dict:
        return {"low": self.low.to_pylist(), "pos": self.pos.tolist(), "src": self.src.to_pylist(), "dst": self.dst.to_pylist()}

    @classmethod
    def from_row(cls, row: dict) -> Automaton:
        text = lambda name: row[name] if isinstance(row[name], pa.Array) else pa.array(row[name], pa.string())
        return cls(text("low"), np.asarray(row["pos"], np.int64), text("src"), text("dst"))

    def _found(self, data: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(place, term) of what occurs in the bytes, across texts as well."""
        hashed = Hashed(data)
        for first, begun, lengths in self.groups:
            near = np.flatnonzero(begun.of(hashed.everywhere(first)))
            for size, marks, hashes, terms, alike in lengths:
                at = near[:np.searchsorted(near, len(data) - size, side="right")]
                own = hashed.at(at, size)
                likely = marks.of(own)
                at, own = at[likely], own[likely]
                place = np.searchsorted(hashes, own)
                for step in range(alike):
                    i = np.minimum(place + step, len(hashes) - 1)
                    hit = np.flatnonzero((hashes[i] == own) & (place + step < len(hashes)))
                    here, term = at[hit], terms[i[hit]]
                    same = np.ones(len(here), bool)
                    for k in range(size):
                        same &= data[here + k] == self.data[self.begin[term] + k]
                    yield here[same], term[same]

    def pairs(self, data: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(text, entry) of every entry that occurs in a text, each once; text i is data[begins[i]:begins[i + 1]]."""
        count = len(self.begin)
        sizes = np.diff(np.append(self.begin, len(self.data)))
        met = []
        starts, ends, _ = windows(np.array([0, len(data)]), max(WINDOW, 4 * self.longest), self.longest - 1)
        for start, end in zip(starts.tolist(), ends.tolist()):
            for here, term in self._found(data[start:end]):
                text = np.searchsorted(begins, here + start, side="right") - 1
                inside = here + start + sizes[term] <= begins[text + 1]
                met.append(np.unique(text[inside] * count + term[inside]))
        texts, terms = np.divmod(np.unique(np.concatenate(met)) if met else np.zeros(0, np.int64), count)
        many = self.first_entry[terms + 1] - self.first_entry[terms]
        offset = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        return np.repeat(texts, many), self.entry[np.repeat(self.first_entry[terms], many) + offset]

    def matches(self, data: np.ndarray, begins: np.ndarray) -> Iterator[tuple[int, int]]:
        return zip(*(x.tolist() for x in self.pairs(data, begins)))


def windows(begins: np.ndarray, width: int, overlap: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, text) of windows of at most ``width`` bytes that together hold every stretch of ``overlap`` + 1."""
    sizes = np.diff(begins)
    stride = width - overlap
    count = np.maximum(1, -(-np.maximum(sizes - overlap, 1) // stride))
    text = np.repeat(np.arange(len(sizes)), count)
    number = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    start = begins[:-1][text] + number * stride
    return start, np.minimum(start + width, begins[1:][text]), text


def _built(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The shards of a task's terms, which come in order; a shard ends when it is full."""
    names = ["low", "pos", "src", "dst"]
    held: list[pa.RecordBatch] = []
    size = 0

    def shard() -> pa.RecordBatch:
        rows = pa.Table.from_batches(held).select(names).cast(pa.schema(
            [("low", pa.string()), ("pos", pa.int64()), ("src", pa.string()), ("dst", pa.string())])).combine_chunks()
        ends = pa.array([0, rows.num_rows], pa.int32())
        return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(ends, rows.column(name).chunk(0)) for name in names], names=names)

    for batch in batches:
        sizes = np.asarray(pc.binary_length(batch.column("low")), np.int64)
        at = 0
        while at < batch.num_rows:
            n = int(np.searchsorted(np.cumsum(sizes[at:]), SHARD_BYTES - size, side="right"))
            n = n or int(not held)  # a term longer than a shard is one of its own
            if n:
                held.append(batch.slice(at, n))
                size += int(sizes[at:at + n].sum())
                at += n
            if at < batch.num_rows:
                yield shard()
                held.clear()
                size = 0
    if held:
        yield shard()


def stored_automata(terms: DataFrame) -> list[str]:
    """Stores the shards of ``terms`` (pos, src, dst, low) and names their files; a file holds few shards."""
    spark = terms.sparkSession
    terms = written(terms.select("low", "pos", "src", "dst"), "terms")  # else mined for the size, the ranges and the shards
    size = terms.agg(F.sum(F.octet_length("low"))).first()[0]
    if not size:
        return []
    parts = max(1, math.ceil(size / SHARD_BYTES))
    path = new_folder(spark, "automata")
    terms.repartitionByRange(parts, "low").sortWithinPartitions("low", "pos").mapInArrow(
        _built, SHARD).write.parquet(path)
    return sorted(spark.read.parquet(path).inputFiles())


def _rows_of(uri: str) -> Iterator[dict]:
    store, path = fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri.removeprefix("file:"))
    with pq.ParquetFile(path, filesystem=store) as file:
        for group in range(file.num_row_groups):
            table = file.read_row_group(group)
            for i in range(table.num_rows):
                yield {name: table.column(name)[i].values for name in table.column_names}


_kept: dict[str, list[Automaton]] = {}


def automata(files: list[str]) -> Iterator[Automaton]:
    """One shard after the other; a worker keeps those of the first files, up to a bound in bytes, and none of other lists."""
    for uri in _kept.keys() - set(files):
        del _kept[uri]
    for uri in files:
        if uri in _kept:
            yield from _kept[uri]
            continue
        read = []
        for row in _rows_of(uri):
            read.append(Automaton.from_row(row))
            yield read[-1]
        if sum(a.size for kept in [*_kept.values(), read] for a in kept) <= KEPT_BYTES:
            _kept[uri] = read


def _lots(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0))
    at = 0
    while at < batch.num_rows:
        full = np.searchsorted(np.cumsum(sizes[at:]), LOT_BYTES, side="right")
        n = max(1, int(full))
        yield batch.slice(at, n)
        at += n


def _taken(of: Automaton, entries: np.ndarray, shape: tuple[str, str, str]) -> pa.Array:
    """The line of every entry; that of an entry met often is made once."""
    met = np.zeros(len(of.pos), bool)
    met[entries] = True
    once = pa.array(np.flatnonzero(met))
    before, between, after = shape
    lines = pc.binary_join_element_wise(before, of.src.take(once), between, of.dst.take(once), after, "")
    return lines.take(pa.array((np.cumsum(met) - 1)[entries]))


def with_matches(rows: DataFrame, low: str, terms: DataFrame, out: str | None = None,
                 lines: Mapping[str, tuple[str, str, str, str]] | None = None) -> DataFrame:
    """Adds ``out``, the (pos, src, dst) of the terms that occur in column ``low``, by pos; column ``low`` goes.

    ``lines`` names text columns to add, each with what stands before the source, between source and target,
    after the target and between two terms; "" for no term. ``terms`` has (pos, src, dst, low), none empty.
    A null text has none.
    """
    lines = dict(lines or {})
    files = stored_automata(terms)
    kept = [c for c in rows.columns if c != low]
    entry = pa.struct([("pos", pa.int32()), ("src", pa.string()), ("dst", pa.string())])

    def matched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lot in _lots(whole, len(kept)):
                text = lot.column(len(kept)).fill_null("").cast(pa.large_binary())
                begins = np.frombuffer(text.buffers()[1], np.int64)[text.offset:text.offset + len(text) + 1]
                data = np.frombuffer(text.buffers()[2] or b"", np.uint8)[begins[0]:begins[-1]]
                texts, pos = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
                words = {name: [pa.array([], pa.string())] for name in wanted}
                for automaton in automata(files):
                    i, e = automaton.pairs(data, begins - begins[0])
                    texts.append(i)
                    pos.append(automaton.pos[e])
                    for name, taken in wanted.items():
                        words[name].append(taken(automaton, e))
                of, place = np.concatenate(texts), np.concatenate(pos)
                order = np.lexsort((place, of))
                offsets = pa.array(np.searchsorted(of[order], np.arange(len(text) + 1)), pa.int32())
                in_order = {name: pa.concat_arrays(parts).take(pa.array(order)) for name, parts in words.items()}
                found = []
                if out:
                    entries = [pa.array(place[order], pa.int32()), in_order["src"], in_order["dst"]]
                    found.append(pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(entries, fields=list(entry))))
                for name, shape in lines.items():
                    found.append(pc.binary_join(pa.ListArray.from_arrays(offsets, in_order["line " + name]), shape[3]))
                yield pa.RecordBatch.from_arrays([*lot.columns[:len(kept)], *found], names=[*kept, *added])

    wanted = {"line " + name: lambda a, e, shape=shape[:3]: _taken(a, e, shape) for name, shape in lines.items()}
    if out:
        wanted |= {"src": lambda a, e: a.src.take(pa.array(e)), "dst": lambda a, e: a.dst.take(pa.array(e))}
    added = {out: "array<struct<pos:int,src:string,dst:string>>"} if out else {}
    added |= dict.fromkeys(lines, "string")
    new = StructType.fromDDL(", ".join(f"`{name}` {kind}" for name, kind in added.items()))
    schema = StructType([*rows.select(*kept).schema.fields, *new.fields])
    return rows.select(*kept, low).mapInArrow(matched, schema)
