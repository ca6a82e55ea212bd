"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads the UTF-8 bytes of a word from both ends, labels every position with
language probabilities, and a document's probabilities are the mean over the positions of
all its words. It is trained here, in numpy, by backpropagation through time on words of a
bounded sample of labelled documents.
"""

from __future__ import annotations

import hashlib
import pickle
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

from lectern.llm.common import held_out, lots, shipped
from lectern.llm.wordtable import table_for

UNKNOWN = "und"
#: Bounds of the sample that the network is fitted on.
SAMPLE_DOCUMENTS, SAMPLE_WORDS = 400, 64
HIDDEN, EMBEDDED = 16, 12
WINDOW = 30
EPOCHS, BATCH, RATE = 3, 256, 0.02
SEED = 5

_LETTERS = re.compile(r"[^\W\d_]+")


def letter_runs(text: str | None) -> list[str]:
    """Runs of letters in lower case; none for a null text or one without letters."""
    found = _LETTERS.findall((text or "").lower())
    return found if any(c.isalpha() for w in found for c in w) else []


def windows(word: str) -> list[bytes]:
    """The word's bytes between blanks, in windows of bounded length that cover every byte."""
    raw = b" " + word.encode("utf-8", "replace") + b" "
    return [raw[at:at + WINDOW] for at in range(0, len(raw), WINDOW)]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class ByteNetwork:
    """Two gated recurrent layers, one per direction, and a softmax at every position."""

    def __init__(self, languages: list[str], hidden: int = HIDDEN, embedded: int = EMBEDDED, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.languages, self.hidden = languages, hidden

        def start(*shape: int) -> np.ndarray:
            return (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)

        self.p = {"E": start(256, embedded) * 4, "V": start(2 * hidden, len(languages)),
                  "c": np.zeros(len(languages), np.float32)}
        for d in "fb":
            self.p |= {f"W{d}": start(embedded, 3 * hidden), f"U{d}": start(hidden, 3 * hidden),
                       f"a{d}": np.zeros(3 * hidden, np.float32)}

    def _run(self, x: np.ndarray, mask: np.ndarray, d: str, keep: list | None = None) -> np.ndarray:
        """States (T, B, H) of one direction over bytes (T, B); padding leaves a state as it is."""
        h_size, p = self.hidden, self.p
        table = p["E"] @ p[f"W{d}"] + p[f"a{d}"]
        state = np.zeros((x.shape[1], h_size), np.float32)
        out = np.empty((*x.shape, h_size), np.float32)
        for t in range(len(x)) if d == "f" else range(len(x) - 1, -1, -1):
            given, own = table[x[t]], state @ p[f"U{d}"]
            gates = _sigmoid(given[:, :2 * h_size] + own[:, :2 * h_size])
            z, r = gates[:, :h_size], gates[:, h_size:]
            n = np.tanh(given[:, 2 * h_size:] + r * own[:, 2 * h_size:])
            m = mask[t][:, None]
            new = state + m * (1 - z) * (n - state)
            if keep is not None:
                keep.append((t, state, z, r, n, own[:, 2 * h_size:], m))
            state = out[t] = new
        return out

    def positions(self, x: np.ndarray, mask: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """Language probabilities (T, B, L) of every position."""
        for d in "fb":
            if keep is not None:
                keep[d] = []
        both = np.concatenate([self._run(x, mask, d, None if keep is None else keep[d]) for d in "fb"], axis=2)
        logits = both @ self.p["V"] + self.p["c"]
        logits -= logits.max(axis=2, keepdims=True)
        e = np.exp(logits)
        if keep is not None:
            keep["both"] = both
        return e / e.sum(axis=2, keepdims=True)

    def gradients(self, x: np.ndarray, mask: np.ndarray, label: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross entropy over all positions and its gradients, by backpropagation through time."""
        keep: dict = {}
        prob = self.positions(x, mask, keep)
        p, h = self.p, self.hidden
        count = mask.sum()
        loss = -(np.log(prob[:, np.arange(len(label)), label] + 1e-9) * mask).sum() / count
        d_logits = prob.copy()
        d_logits[:, np.arange(len(label)), label] -= 1
        d_logits *= (mask / count)[:, :, None]
        flat = d_logits.reshape(-1, d_logits.shape[2])
        g = {"V": keep["both"].reshape(-1, 2 * h).T @ flat, "c": flat.sum(0), "E": np.zeros_like(p["E"])}
        d_both = d_logits @ p["V"].T
        for k, d in enumerate("fb"):
            g |= {f"W{d}": np.zeros_like(p[f"W{d}"]), f"U{d}": np.zeros_like(p[f"U{d}"]), f"a{d}": np.zeros_like(p[f"a{d}"])}
            carried = np.zeros((x.shape[1], h), np.float32)
            for t, state, z, r, n, own_n, m in reversed(keep[d]):
                d_new = carried + d_both[t][:, k * h:(k + 1) * h]
                d_n = m * d_new * (1 - z) * (1 - n * n)
                d_z = m * d_new * (state - n) * z * (1 - z)
                d_r = d_n * own_n * r * (1 - r)
                d_given = np.concatenate([d_z, d_r, d_n], axis=1)
                d_own = np.concatenate([d_z, d_r, d_n * r], axis=1)
                carried = d_new * (1 - m * (1 - z)) + d_own @ p[f"U{d}"].T
                g[f"U{d}"] += state.T @ d_own
                g[f"a{d}"] += d_given.sum(0)
                g[f"W{d}"] += p["E"][x[t]].T @ d_given
                np.add.at(g["E"], x[t], d_given @ p[f"W{d}"].T)
        return float(loss), g

    def fit(self, pieces: list[bytes], labels: np.ndarray, epochs: int = EPOCHS, batch: int = BATCH, rate: float = RATE,
            seed: int = SEED) -> None:
        """Adam over batches of words of like length."""
        rng = np.random.default_rng(seed)
        mean = {k: np.zeros_like(v) for k, v in self.p.items()}
        square = {k: np.zeros_like(v) for k, v in self.p.items()}
        steps, total = 0, epochs * max(1, -(-len(pieces) // batch))
        lengths = np.asarray([len(x) for x in pieces])
        for _ in range(epochs):
            order = rng.permutation(len(pieces))
            order = order[np.argsort(lengths[order], kind="stable")]
            lots = [order[at:at + batch] for at in range(0, len(order), batch)]
            for lot in rng.permutation(len(lots)):
                x, mask = padded([pieces[i] for i in lots[lot]])
                _, g = self.gradients(x, mask, labels[lots[lot]])
                steps += 1
                now = rate * (1 - steps / (total + 1)) + 1e-4
                for k, v in g.items():
                    v = np.clip(v, -1, 1)
                    mean[k] = 0.9 * mean[k] + 0.1 * v
                    square[k] = 0.99 * square[k] + 0.01 * v * v
                    step = (mean[k] / (1 - 0.9 ** steps)) / (np.sqrt(square[k] / (1 - 0.99 ** steps)) + 1e-8)
                    self.p[k] = (self.p[k] - now * step).astype(np.float32)

    def word_sums(self, words: list[str]) -> np.ndarray:
        """Per word the sum of its positions' probabilities, and behind them the number of positions."""
        pieces, owner = [], []
        for n, word in enumerate(words):
            for piece in windows(word):
                pieces.append(piece)
                owner.append(n)
        out = np.zeros((len(words), len(self.languages) + 1), np.float32)
        owner = np.asarray(owner)
        order = np.argsort([len(x) for x in pieces], kind="stable")
        for at in range(0, len(order), 4096):
            lot = order[at:at + 4096]
            x, mask = padded([pieces[i] for i in lot])
            sums = (self.positions(x, mask) * mask[:, :, None]).sum(0)
            np.add.at(out, owner[lot], np.concatenate([sums, mask.sum(0)[:, None]], axis=1))
        return out


def padded(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes (T, B) and the mask of those that are not padding."""
    lengths = np.asarray([len(x) for x in pieces])
    width = int(lengths.max())
    x = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(len(pieces), width).T
    return x, (np.arange(width)[:, None] < lengths).astype(np.float32)


def labelled_words(docs: DataFrame, documents: int = SAMPLE_DOCUMENTS, words: int = SAMPLE_WORDS) -> DataFrame:
    """(lang, word) of about ``documents`` documents per language, ``words`` random words of each.

    Only documents with a label and not held out. The share that is drawn per language
    follows from the counts, one row per language.
    """
    fit = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out())
    counts = {r["lang"]: r["n"] for r in fit.groupBy("lang").agg(F.count("*").alias("n")).toLocalIterator()}
    if not counts:
        return docs.sparkSession.createDataFrame([], "lang string, word string")
    steps = 1 << 40
    share = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, int(steps * min(1.0, documents / n)))])
    drawn = fit.where(F.pmod(F.xxhash64("doc_id", F.length("text")), F.lit(steps)) < share[F.col("lang")])

    def pick(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for lang, text in zip(pdf["lang"], pdf["text"]):
                found = letter_runs(text)
                rng = np.random.default_rng(len(found))
                rows += [(lang, found[i]) for i in rng.permutation(len(found))[:words]]
            yield pd.DataFrame(rows, columns=["lang", "word"])

    return drawn.select("lang", "text").mapInPandas(pick, "lang string, word string")


def fitted(docs: DataFrame, documents: int = SAMPLE_DOCUMENTS) -> ByteNetwork | None:
    """The network trained on the sample; none if there is no labelled document."""
    sample = sorted((r["lang"], r["word"]) for r in labelled_words(docs, documents).collect())
    if not sample:
        return None
    languages = sorted({lang for lang, _ in sample})
    pairs = [(piece, languages.index(lang)) for lang, word in sample for piece in windows(word)]
    network = ByteNetwork(languages)
    network.fit([piece for piece, _ in pairs], np.asarray([label for _, label in pairs]))
    return network


def predictions(network: ByteNetwork | None, texts: list[str | None], key: str) -> tuple[list[str], list[float]]:
    """The language of each text and its pooled probability."""
    words = [letter_runs(t) for t in texts]
    if network is None:
        return [UNKNOWN] * len(texts), [0.0] * len(texts)
    langs, scores = [], []
    for rows in table_for(key, network.word_sums).of(words):
        if not len(rows):
            langs.append(UNKNOWN)
            scores.append(0.0)
            continue
        sums = rows.sum(axis=0, dtype=np.float64)
        best = int(sums[:-1].argmax())
        langs.append(network.languages[best])
        scores.append(min(1.0, float(sums[best] / sums[-1])))
    return langs, scores


def with_language(docs: DataFrame, network: ByteNetwork | None, prediction: str = "lang_pred", score: str = "score") -> DataFrame:
    """All rows and columns of a table with a text, and the prediction and its score behind them.

    A null text, or one without a letter, is ``und`` with score 0; so is every text if the
    network is none. Repeated rows are judged alike. Columns that have a new column's name
    are replaced by it.
    """
    get = shipped(docs.sparkSession, network)
    key = "language:" + hashlib.sha256(pickle.dumps(network)).hexdigest()
    kept = [c for c in docs.columns if c not in (prediction, score)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lot in lots(batch):
                langs, scores = predictions(get(), lot.column("text").to_pylist(), key)
                yield pa.RecordBatch.from_arrays(
                    [*lot.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())],
                    names=[*lot.schema.names, prediction, score])

    rows = docs.select(*[F.col(f"`{c}`") for c in kept])
    schema = StructType(rows.schema.fields + [StructField(prediction, StringType()), StructField(score, DoubleType())])
    return rows.mapInArrow(run, schema)


def language_report(docs: DataFrame, documents: int = SAMPLE_DOCUMENTS) -> DataFrame:
    """(doc_id, text, lang) -> (doc_id, held_out, lang_pred, score), a row per row; other columns are ignored."""
    network = fitted(docs.select("doc_id", "text", "lang"), documents)
    judged = with_language(docs.select("doc_id", "text").withColumn("held_out", held_out()), network)
    return judged.select("doc_id", F.col("held_out").cast(BooleanType()).alias("held_out"), "lang_pred", "score")
