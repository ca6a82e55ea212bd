"""Token ids of whole texts, exactly as the tokenizer gives them, with each distinct chunk encoded once.

A text is cut where the tokenizer's own pre-tokenization always cuts, so the ids of the
text are those of its chunks in a row. Workers keep the ids of the chunks they have met,
up to a bound, from batch to batch. Texts where a cut would not be safe, and those that hold the
text of a special token (which the tokenizer gives its own id), are encoded whole.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterable, Iterator

import numpy as np
from tokenizers import Tokenizer

from lectern.llm.caches import claim

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

END_ID = 2
KEPT_CHUNKS = 800_000

#: Letters and marks after a word whose border every pre-tokenizer here cuts at.
_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
_WORD_AND_MARKS = re.compile(rf"([{_LETTERS}]+)([!-&(-/:-@\[-`{{-~]+)")
_BEFORE_SPACE = re.compile(r"\s ")
_PLAIN = re.compile(r"[^\x00-ſ]|İ")


class Encoder:
    """Encodes texts with a tokenizer given as the content of its file."""

    def __init__(self, spec: str, kept: int = KEPT_CHUNKS):
        self.tokenizer = Tokenizer.from_str(spec)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.kept = kept
        parts = json.loads(spec)
        steps = parts["pre_tokenizer"] or {}
        kinds = [n["type"] for n in (parts["normalizer"] or {}).get("normalizers", [])]
        self.byte_level = parts["normalizer"] is None and steps.get("type") == "ByteLevel" and steps["use_regex"] and (
            not steps["add_prefix_space"])
        self.word_level = kinds == ["NFC", "Replace", "Lowercase"] and (
            [s["type"] for s in steps.get("pretokenizers", [])] == ["Split", "ByteLevel"])
        # Texts that hold an added token, in any case, are left to the tokenizer as a whole.
        self.added = [t["content"].lower() for t in parts["added_tokens"]]
        starts = {a[:2] for a in self.added}
        #: What every added token begins with, where case does not matter to it: a quick look before the slow one.
        self.added_starts = sorted(starts) if all(s.upper() == s for s in starts) else [""]
        #: Ids that begin with a space; None where chunks are not encoded in a row.
        self.opens = self._opening_ids() if self.byte_level and not any(" " in a for a in self.added) else None
        self.first: dict[str, bytes] = {"": b""}
        self.later: dict[str, bytes] = {}

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [np.asarray(e.ids, self.dtype).tobytes()
                for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _opening_ids(self) -> np.ndarray:
        opens = np.zeros(self.tokenizer.get_vocab_size(), bool)
        opens[[i for token, i in self.tokenizer.get_vocab().items() if token.startswith("Ġ")]] = True
        return opens

    def _ids_in_a_row(self, chunks: list[str]) -> list[bytes]:
        """Ids of chunks that have a space before them and none in them, from one text of all.

        A text costs the tokenizer far more than a chunk in it. Where the text is cut, it is cut at its spaces, and
        only a chunk's first id begins with one. What ends in white space would not stay apart, so it is a text of its own.
        """
        apart = [c for c in chunks if not c or c[-1].isspace()]
        row = [c for c in chunks if c and not c[-1].isspace()]
        found = dict(zip(apart, self._ids([" " + c for c in apart])))
        if row:
            ids = np.asarray(self.tokenizer.encode_batch_fast([" " + " ".join(row)], add_special_tokens=False)[0].ids, self.dtype)
            begins = np.flatnonzero(self.opens[ids])
            if len(begins) == len(row) and begins[0] == 0:
                data, size = ids.tobytes(), self.dtype.itemsize
                ends = [*(begins[1:] * size).tolist(), len(data)]
                found.update(zip(row, [data[a:b] for a, b in zip((begins * size).tolist(), ends)]))
            else:
                found.update(zip(row, self._ids([" " + c for c in row])))
        return [found[c] for c in chunks]

    def _learn(self, cache: dict[str, bytes], prefix: str, chunks: Iterable[str]) -> dict[str, bytes]:
        """Ids of chunks that the cache lacks, put into the cache while there is room."""
        cut = {c: m.groups() for c in chunks if (m := _WORD_AND_MARKS.fullmatch(c))}
        single = [c for c in chunks if c not in cut]
        words = {w for w, _ in cut.values() if w not in cache}
        marks = {m for _, m in cut.values() if m not in self.first}
        wanted = list({*single, *words})
        found = dict(zip(wanted, self._ids_in_a_row(wanted) if prefix == " " and self.opens is not None
                         else self._ids([prefix + c for c in wanted])))
        if marks:
            after = list(marks)
            self.first.update(zip(after, self._ids(after)))
        for chunk, (word, mark) in cut.items():
            found[chunk] = (found.get(word) or cache[word]) + self.first[mark]
        if len(cache) + len(found) <= self.kept:
            cache.update(found)
        return found

    def _joined(self, cache: dict[str, bytes], prefix: str, chunks: list[str]) -> bytes:
        parts = list(map(cache.get, chunks))
        missing = [i for i, part in enumerate(parts) if part is None]
        if missing:
            found = self._learn(cache, prefix, {chunks[i] for i in missing})
            for i in missing:
                parts[i] = found[chunks[i]]
        return b"".join(parts)

    def _holds_added(self, text: str) -> bool:
        if not any(start in text for start in self.added_starts):
            return False
        low = text.lower()
        return any(a in low for a in self.added)

    def encode(self, text: str) -> bytes:
        """The ids as little-endian integers of ``dtype``."""
        if self._holds_added(text):
            return self._ids([text])[0]
        if self.byte_level and not _BEFORE_SPACE.search(text):
            head, *rest = text.split(" ")
            return self._joined(self.first, "", [head]) + self._joined(self.later, " ", rest)
        if self.word_level:
            if not _PLAIN.search(text):
                text = text.lower()
            return self._joined(self.first, "", text.replace("\n", " ").split(" "))
        return self._ids([text])[0]


_encoders: dict[str, Encoder] = {}


def encoder(spec: str) -> Encoder:
    """The worker's encoder for this tokenizer."""
    claim("tokens", _encoders.clear)
    key = hashlib.sha256(spec.encode()).hexdigest()
    if key not in _encoders:
        _encoders[key] = Encoder(spec)
    return _encoders[key]


def spec_of(path: str) -> str:
    """The content of a tokenizer file: a few MB, which the driver sends to the tasks."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def encoded(spec: str, texts: Iterable[str | None], end_id: int = END_ID) -> Iterator[np.ndarray]:
    """Ids of each text with the end id behind; a null text is an empty one."""
    own = encoder(spec)
    end = np.asarray([end_id], own.dtype).tobytes()
    for text in texts:
        yield np.frombuffer(own.encode(text or "") + end, own.dtype)
