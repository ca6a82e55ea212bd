"""Web archives: writing pages as monolithic gzip files, normalising them, reading them back.

A monolithic archive is one gzip stream over all its records, so no record can be read
without all before it. The normaliser inflates such a stream once, in blocks, writes every
record as a gzip member of its own, and beside the archive an index of the members.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import zlib
from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm import files
from lectern.llm.common import as_batch, as_lists
from lectern.session import new_folder, written

LEVEL = 4
ARCHIVE_BYTES = 256 << 20
BLOCK = 1 << 20
DATE = "2026-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

ARCHIVES = "archive string, n_records long, bytes long"
ARCHIVE_SCHEMA = pa.schema([("archive", pa.string()), ("n_records", pa.int64()), ("bytes", pa.int64())])
PAGES = ("page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, "
         "url string, archive string, offset long, length long")


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _page_urn(page_id: int | None) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}>"


def _page_of(urn: str | None) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d+)>", urn or "")
    return int(found[1]) if found else None


def _header_safe(value: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """A response record, or a revisit record that holds the HTTP head alone."""
    http = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n").encode()
    block = http if revisit else http + payload
    heads = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {_page_urn(page_id)}", f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {_header_safe(url or '')}",
        f"WARC-Payload-Digest: sha1:{payload_digest(payload)}",
    ]
    if revisit:
        heads += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_page_urn(refers_to)}"]
    heads += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(heads).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def heads_of(raw: bytes) -> tuple[dict[str, str], bytes]:
    """The named fields of a record or HTTP message, in lower case, and what follows them."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}, rest


def inflated(blocks: Iterable[bytes]) -> Iterator[bytes]:
    """The content of a gzip file of any number of members, block by block."""
    gunzip = zlib.decompressobj(31)
    for block in blocks:
        while block:
            if gunzip.eof:
                gunzip = zlib.decompressobj(31)
            yield gunzip.decompress(block)
            block = gunzip.unused_data
    if not gunzip.eof:
        raise ValueError("the gzip stream ends early")


def split_records(content: Iterable[bytes]) -> Iterator[bytes]:
    """Whole records from a stream of blocks; holds one record and one block at a time."""
    held = bytearray()
    need = None
    for block in content:
        held += block
        while True:
            if need is None:
                end = held.find(b"\r\n\r\n")
                if end < 0:
                    break
                fields, _ = heads_of(bytes(held[:end + 4]))
                need = end + 4 + int(fields["content-length"]) + 4
            if len(held) < need:
                break
            yield bytes(held[:need])
            del held[:need]
            need = None
    if held:
        raise ValueError("the archive ends inside a record")


def _blocks(stream) -> Iterator[bytes]:
    while block := stream.read(BLOCK):
        yield block


def with_first_page(pages: DataFrame) -> DataFrame:
    """Adds ``first_page``, the smallest page_id of an equal payload, where a payload is repeated.

    Counts per digest are made before anything is shuffled, and only digests of repeated
    payloads are joined; Spark splits the side of the pages where one digest is very common.
    """
    digested = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).withColumn(
        "_digest", F.sha1(F.col("html").cast("binary")))
    repeated = digested.groupBy("_digest").agg(F.min("page_id").alias("first_page"), F.count("*").alias("_n")).where(
        F.col("_n") > 1).drop("_n")
    return digested.join(repeated, "_digest", "left").drop("_digest")


def write_archives(pages: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """(page_id, url, html, first_page) -> monolithic archives of about ``archive_bytes``; the manifest."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        rows = (row for x in as_lists(batches) for row in zip(x["page_id"], x["url"], x["html"], x["first_page"]))
        row, number = next(rows, None), 0
        while row is not None:
            name, size, n = f"{folder}/part-{part:06d}-{number:05d}.warc.gz", 0, 0
            gzip = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
            with files.new_file(name) as out:
                while row is not None and size < archive_bytes:
                    page_id, url, html, first = row
                    raw = record(page_id, url, html.encode("utf-8", "replace"), first,
                                 first is not None and first != page_id)
                    out.write(gzip.compress(raw))
                    size, n, row = size + len(raw), n + 1, next(rows, None)
                out.write(gzip.flush())
            yield as_batch({"archive": [name], "n_records": [n], "bytes": [size]}, ARCHIVE_SCHEMA)
            number += 1

    rows = pages.select("page_id", "url", "html", "first_page")
    return written(rows.mapInArrow(write, ARCHIVES), "warc-manifest")


def normalise(manifest: DataFrame, folder: str) -> DataFrame:
    """Rewrites archives record by record, each a gzip member, with an index file beside each; the new manifest."""

    def rewrite(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for source in pdf["archive"]:
                target = f"{folder}/{source.rpartition('/')[2]}"
                at, n = 0, 0
                with files.stream(source) as f, files.new_file(target) as out, files.new_file(target + ".idx") as index:
                    for raw in split_records(inflated(_blocks(f))):
                        gzip = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                        member = gzip.compress(raw) + gzip.flush()
                        out.write(member)
                        fields, _ = heads_of(raw[:raw.index(b"\r\n\r\n") + 4])
                        index.write(json.dumps({
                            "offset": at, "length": len(member), "type": fields["warc-type"],
                            "url": fields["warc-target-uri"], "digest": fields["warc-payload-digest"],
                        }).encode() + b"\n")
                        at, n = at + len(member), n + 1
                yield pd.DataFrame([(target, n, at)], columns=["archive", "n_records", "bytes"])

    return written(files.one_task_each(manifest).mapInPandas(rewrite, ARCHIVES), "warc-normal")


def page_of(member: bytes) -> tuple:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, url) of one gzip member."""
    fields, block = heads_of(zlib.decompress(member, 31))
    http, rest = heads_of(block[:int(fields["content-length"])])
    named = fields["warc-payload-digest"].removeprefix("sha1:")
    kind = fields["warc-type"]
    if kind == "response" and payload_digest(rest) != named:
        raise ValueError("a payload does not match its digest")
    size = len(rest) if kind == "response" else int(http["content-length"])
    return (_page_of(fields["warc-record-id"]), size, named, kind, _page_of(fields.get("warc-refers-to")),
            fields["warc-target-uri"])


def read_archives(manifest: DataFrame) -> DataFrame:
    """One row per record of normalised archives, read member by member at the places of the index."""
    names = [c.split()[0] for c in PAGES.split(", ")]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for archive in pdf["archive"]:
                rows = []
                with files.stream(archive + ".idx") as f:
                    entries = [json.loads(line) for line in f.read().splitlines()]
                with files.random_access(archive) as f:
                    for e in entries:
                        f.seek(e["offset"])
                        rows.append((*page_of(f.read(e["length"])), archive, e["offset"], e["length"]))
                        if len(rows) == 5_000:
                            yield _frame(rows, names)
                            rows = []
                yield _frame(rows, names)

    return files.one_task_each(manifest).mapInPandas(read, PAGES)


def _frame(rows: list[tuple], names: list[str]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=names).astype({"page_id": "Int64", "refers_to": "Int64"})


def archive_pages(pages: DataFrame) -> DataFrame:
    """(page_id, url, html) -> archives, normalised and read back: a row per page.

    A null html is an empty payload, a null url an empty one; empty payloads count as equal.
    Of equal payloads the smallest page_id is the response (all rows that share it are); rows
    without an id are revisits of it, or responses if no equal page has an id. Repeated rows
    are records of their own; an empty table gives no archive. Other columns are ignored.
    """
    folder = new_folder(pages.sparkSession, "warc")
    raw = write_archives(with_first_page(pages), f"{folder}/raw")
    return read_archives(normalise(raw, f"{folder}/normal"))
