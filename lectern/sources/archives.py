"""Book archives as tables of entries."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

CONTAINER_PATH = "META-INF/container.xml"


def archive_entries(archives: DataFrame) -> DataFrame:
    """(corpus_id, path, content): one row per file inside each archive."""

    def unpack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for corpus, content in zip(frame.corpus_id, frame.content):
                with zipfile.ZipFile(io.BytesIO(content)) as book:
                    names = [info.filename for info in book.infolist() if not info.is_dir()]
                    yield pd.DataFrame(
                        {"corpus_id": corpus, "path": names, "content": [book.read(n) for n in names]}
                    )

    return archives.select("corpus_id", "content").mapInPandas(
        unpack, "corpus_id string, path string, content binary"
    )


def pack_rows(pages: DataFrame) -> DataFrame:
    """(corpus_id, content): one small archive per page row with container and page."""

    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            archives = []
            for container, href, html in zip(frame.container, frame.href, frame.html):
                buffer = io.BytesIO()
                with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as book:
                    book.writestr(CONTAINER_PATH, container)
                    book.writestr(href, html)
                archives.append(buffer.getvalue())
            yield pd.DataFrame({"corpus_id": frame.corpus_id, "content": archives})

    return pages.select("corpus_id", "container", "href", "html").mapInPandas(
        pack, "corpus_id string, content binary"
    )
