"""Archives, packed sequences and binary records: exact round trips."""

import base64
import functools
import gzip
import hashlib
import io
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lectern.llm import common, files, packing, records, tokens, warc

WORD, BYTE = (public_tokenizers.path(f) for f in ("word_bpe_49k.json", "byte_bpe_50k.json"))
TEXTS = [
    "Plain text, with marks! And 'quotes' it's.", "two  blanks\n\n and \t tabs ", " leading", "trailing ", "\n", "",
    "ÄÖÜ straße ÇA é é İstanbul Σίσυφος", "日本語 テキスト", "<|endoftext|> x", "a <|endoftext|> b<|startoftext|>", "a <|ENDOFTEXT|> b", "<| endoftext |>", "a b c", "1234 5 67.8%%% ***",
    "\U0001F600 \U0001F1E9\U0001F1EA", "don't we'll I'm 'tis", "tab\tword\x0b\x1cx", "CAPS!! WITH!! MARKS!!",
]


@functools.cache
def tokenizer_of(path):
    return Tokenizer.from_file(path)


def reference(path, text):
    return [*tokenizer_of(path).encode(text, add_special_tokens=False).ids, 2]


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_chunked_ids_are_the_tokenizers(path):
    spec = tokens.spec_of(path)
    for kept in (0, tokens.KEPT_CHUNKS):
        own = tokens.Encoder(spec, kept)
        for text in TEXTS + [" ".join(TEXTS), "\n".join(TEXTS)]:
            assert np.frombuffer(own.encode(text), own.dtype).tolist() == reference(path, text)[:-1], text


@given(st.text(alphabet=" \n\t'.,aZé1ſİß́　", max_size=30))
@settings(max_examples=300, deadline=None)
def test_chunked_ids_of_any_text(text):
    for path in (WORD, BYTE):
        [ids] = tokens.encoded(tokens.spec_of(path), [text])
        assert ids.tolist() == reference(path, text)


def test_records_round_trip_and_index(spark, odd, none):
    manifest = records.write_records(odd, BYTE, shard_bytes=4096)
    rows = records.read_records(manifest).collect()
    texts = {r.doc_id: r.text or "" for r in odd.collect()}
    assert sorted((r.doc_id is not None, r.doc_id or 0) for r in rows) == sorted((i is not None, i or 0) for i in [*texts, 1])
    start = 0
    for r in sorted(rows, key=lambda r: (r.shard, r.record)):
        ids = reference(BYTE, texts[r.doc_id])
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.asarray(ids, "<u4").tobytes()))
        start += len(ids)
    order = [r.doc_id for r in sorted(rows, key=lambda r: (r.shard, r.record))]
    assert order == sorted(order, key=lambda i: (i is not None, i or 0))
    last = max(rows, key=lambda r: (r.shard, r.record))
    [(doc_id, ids)] = records.read_at(last.shard, [last.record])
    assert doc_id == last.doc_id and len(ids) == last.n_tokens
    assert records.read_records(records.write_records(none, BYTE)).count() == 0


def test_damaged_records_are_noticed():
    whole = records.frame(records.serialized(5, np.arange(9, dtype="<u2"))) * 2
    assert [records.parsed(d)[0] for d in records.unframed(io.BytesIO(whole))] == [5, 5]
    for bad in (whole[:-1], whole[:20] + b"x" + whole[21:], b"\x01" + whole[1:]):
        with pytest.raises(ValueError):
            list(records.unframed(io.BytesIO(bad)))


@given(st.lists(st.integers(1, 512), min_size=1, max_size=120), st.integers(1, 9))
@settings(max_examples=60, deadline=None)
def test_differencing_is_a_partition_of_small_spread(sizes, k):
    sizes = np.asarray(sizes)
    placed = packing.partition(sizes, k)
    sums = np.bincount(placed, sizes, minlength=k)
    assert placed.min() >= 0 and placed.max() < k
    assert sums.max() - sums.min() <= sizes.max()
    assert np.bincount(packing.balanced(sizes, 600), sizes).max() <= 600


def test_differencing_beats_largest_first_on_a_known_case():
    assert np.bincount(packing.partition(np.asarray([8, 7, 6, 5, 4]), 2), [8, 7, 6, 5, 4]).tolist() in ([14, 16], [16, 14])


def test_packing_covers_every_id_once(spark, odd, none):
    random.seed(3)
    docs = odd.select("doc_id", "text").union(spark.createDataFrame(
        [(100 + i, "word " * random.randint(0, 3000)) for i in range(150)], "doc_id long, text string"))
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    pieces = packing.token_pieces(docs, WORD)
    placed = packing.place(pieces, group_windows=16)
    by_doc, by_sequence = {}, {}
    for r in placed.collect():
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for doc_id, own in by_doc.items():
        ids = reference(WORD, texts[doc_id])
        times = 2 if doc_id == 1 else 1
        assert sum(r.length for r in own) == times * len(ids) == times * own[0].doc_tokens
        for r in own:
            assert r.ids_crc32 == zlib.crc32(np.asarray(ids[r.start:r.start + r.length], "<u4").tobytes())
    used = []
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        used.append(at)
    assert max(used) <= 4096 and sum(used) / (4096 * len(used)) > 0.95
    rows = packing.sequences(pieces, placed).collect()
    assert sum(r.used for r in rows) == sum(used) and all(r.padded_length >= r.used for r in rows)
    assert packing.pack(none, WORD).count() == 0


def test_tiny_pieces_make_more_groups(spark):
    rows = spark.range(3_000).select("id", F.col("id").alias("doc_id"), F.lit(0).cast("long").alias("start"), F.lit(1).cast("long").alias("length"),
                                     F.lit(7).cast("long").alias("ids_crc32"), F.lit(1).cast("long").alias("doc_tokens"))
    placed = packing.place(rows.withColumnRenamed("id", "piece_id").withColumn("ids", F.lit(b"")), group_pieces=200).collect()
    assert sorted(r.doc_id for r in placed) == list(range(3_000))
    by = {}
    for r in placed:
        by.setdefault(r.sequence_id, []).append(r.offset)
    assert len(by) == 15 and all(sorted(o) == list(range(len(o))) for o in by.values())


def test_lots_are_bounded_in_bytes_and_lose_nothing():
    texts = ["a" * n for n in (5, 0, 30, 3, 3, 3)] + [None, "é" * 9]
    batch = pa.RecordBatch.from_pydict({"text": texts, "k": list(range(8))})
    lots = list(common.lots(batch, 10))
    assert [lot.column("k").to_pylist() for lot in lots] == [[0, 1], [2], [3, 4, 5, 6], [7]]
    assert [t for lot in lots for t in lot.column("text").to_pylist()] == texts


def test_padding_stops_at_powers_of_two(spark):
    df = spark.createDataFrame([(n,) for n in (1, 3, 2048, 2049, 4096)], "used long")
    assert [r.p for r in df.select(packing.padded_length(df.used).alias("p")).collect()] == [1, 4096, 2048, 4096, 4096]


PAGES = [
    (5, "http://a/\r\nx", "<p>same</p>"), (3, None, "<p>same</p>"), (9, "u", "<p>same</p>"), (1, "u", None), (2, "u", ""),
    (4, "u", "é\r\n\r\nWARC/1.1\r\n"), (None, "u", "<p>same</p>"), (7, "u", "x" * 3_000_000), (8, "u", "only"),
]


def test_archives_come_back_as_pages(spark):
    df = spark.createDataFrame([(*p, "z") for p in PAGES], "page_id long, url string, html string, digest string")
    rows = {r.page_id: r for r in warc.archive_pages(df).collect()}
    assert len(rows) == len(PAGES)
    for page_id, _, html in PAGES:
        payload = (html or "").encode()
        r = rows[page_id]
        assert (r.payload_bytes, r.payload_digest) == (len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode())
    assert {i: rows[i].refers_to for i in (5, 9, None, 2)} == {5: 3, 9: 3, None: 3, 2: 1}
    assert all(rows[i].record_type == "response" and rows[i].refers_to is None for i in (3, 1, 4, 7, 8))
    assert warc.archive_pages(df.limit(0)).count() == 0
    with files.random_access(rows[4].archive) as f:
        f.seek(rows[4].offset)
        assert b"<urn:page:4>" in gzip.decompress(f.read(rows[4].length))


def test_the_normaliser_reads_any_members_and_refuses_a_cut_stream():
    raw = [warc.record(i, "u", b"p" * i, None, False) for i in range(5)]
    whole = gzip.compress(b"".join(raw))
    blocks = [whole[i:i + 7] for i in range(0, len(whole), 7)]
    assert list(warc.split_records(warc.inflated(blocks))) == raw
    assert list(warc.split_records(warc.inflated([b"".join(gzip.compress(r) for r in raw)]))) == raw
    with pytest.raises(ValueError):
        list(warc.split_records(warc.inflated(blocks[:-3])))


def test_chunks_in_a_row_have_the_ids_they_have_alone():
    own = tokens.Encoder(tokens.spec_of(public_tokenizers.path("byte_bpe_50k.json")), 0)
    chunks = ["word", "Zqxv&&&", "a\nb", "\nfoo", "end\n", "", "ñ\u00a0", "\u00a0x", "12ab", "'s", "日本語", "\x00", "Ġx", "\u2028"]
    asked = []
    alone = own._ids([" " + c for c in chunks])
    batch = own._ids
    own._ids = lambda texts: asked.extend(texts) or batch(texts)
    assert own._ids_in_a_row(chunks) == alone
    # Each was a text of its own before; only those that end in white space still are.
    assert sorted(asked) == sorted([" end\n", " ", " ñ\u00a0", " \u2028"])
