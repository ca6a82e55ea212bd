"""Toxicity by a support vector machine on a subsequence string kernel with Nyström landmarks.

The kernel of two strings sums, over all subsequences of a fixed length that they share,
decay to the power of the stretch each occupies; gaps and inserted characters lower it but
do not end it. Landmark strings give every string finite features by the Nyström method,
and a linear support vector machine is trained on them.

Labels are of documents. A labelled document is a bag of strings (its words, and runs of
single characters written apart). Strings that mark toxic documents in many unrelated
documents are the positive examples, together with the same strings with characters
inserted or written over; strings of clean documents are the negative ones, with those most
like a positive among them. A document's score is the calibrated margin of its worst string.
"""

from __future__ import annotations

import hashlib
import itertools
import math
import pickle
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import as_batch, as_lists, held_out, shipped
from lectern.llm.wordtable import table_for

#: Bounds of the sample that the machine is fitted on: labelled documents of each class.
SAMPLE_DOCUMENTS = 1_000
#: Distinct strings of a sampled document that are used, drawn by hash.
SAMPLE_STRINGS = 2_000
SHORTEST, LENGTH, DECAY = 3, 4, 0.6
START = "^"
ROOTS, LANDMARKS, NEGATIVES = 16, 24, 3_000
LONGEST = 24
LEAST_SUPPORT, LEAST_ODDS = 0.03, 10.0
ROOT = (4, 10)
EXAMPLES = 30
THRESHOLD = 0.3
INSERTED = "-._*1 x"
SEED = 11

SCORED_SCHEMA = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64())])
_EDGES = ".,;:!?\"'()[]{}<>|*#$%&-_=+/\\~`^"


def strings_in_place(text: str | None) -> dict[str, str]:
    """The distinct strings of a text in lower case, each with the word before its first place.

    Strings are words without marks at their ends, in overlapping windows where they are long;
    the letters alone of words that hold other characters; and runs of three or more single
    characters, joined to one.
    """
    out: dict[str, str] = {}
    run: list[str] = []
    last = ""
    for token in [*(text or "").lower().split(), ""]:
        word = token.strip(_EDGES)
        if len(word) == 1:
            run.append(word)
            continue
        if run:
            if len(run) > 2:
                _add(out, "".join(run), last)
            last, run = run[-1], []
        if word:
            _add(out, word, last)
            last = word
    return out


def _add(out: dict[str, str], word: str, last: str) -> None:
    if word in out:
        return
    for piece in _windows(word):
        out.setdefault(piece, last)
    if not word.isalpha():
        letters = "".join(filter(str.isalpha, word))
        if len(letters) >= LENGTH:
            for piece in _windows(letters):
                out.setdefault(piece, last)


def strings(text: str | None) -> list[str]:
    return list(strings_in_place(text))


def _windows(word: str) -> list[str]:
    if len(word) <= LONGEST:
        return [word]
    return [word[at:at + LONGEST] for at in range(0, len(word) - LONGEST // 2, LONGEST // 2)]


class Subsequences:
    """The kernel with a fixed set of strings.

    The kernel is an inner product over subsequences, and only those that a fixed string has
    can count. Each of these has a row, its decayed weight in every fixed string. For other
    strings all triples of places are looked up at once, and only triples that begin a longer
    subsequence of a fixed string are extended by one place more.
    """

    def __init__(self, fixed: Sequence[str], decay: float = DECAY):
        self.decay, self.n = decay, len(fixed)
        self.codes = {c: n + 1 for n, c in enumerate(sorted(set("".join(fixed))))}
        self.base = len(self.codes) + 1
        found: tuple[dict[int, np.ndarray], ...] = ({}, {})
        for m, word in enumerate(fixed):
            for rows, size in zip(found, (SHORTEST, LENGTH)):
                for places in itertools.combinations(range(len(word)), size):
                    code = 0
                    for at in places:
                        code = code * self.base + self.codes[word[at]]
                    row = rows.setdefault(code, np.zeros(self.n, np.float32))
                    row[m] += decay ** (places[-1] - places[0] + 1 - size)
        triples, longer = (sorted(rows) for rows in found)
        nothing = np.zeros((1, self.n), np.float32)
        self.triple_rows = np.vstack([nothing, *[found[0][c] for c in triples]])
        self.longer_rows = np.vstack([nothing, *[found[1][c] for c in longer]])
        self.row_of_triple = np.zeros(self.base ** SHORTEST, np.int32)
        self.row_of_triple[triples] = np.arange(1, len(triples) + 1)
        self.longer = np.asarray(longer, np.int64)
        self.begins = np.zeros(self.base ** SHORTEST, bool)
        self.begins[self.longer // self.base] = True
        self.triples_of: dict[int, tuple[np.ndarray, ...]] = {}

    def _places(self, width: int) -> tuple[np.ndarray, ...]:
        if width not in self.triples_of:
            i, j, k = np.asarray(list(itertools.combinations(range(width), SHORTEST)), np.int64).T
            self.triples_of[width] = i, j, k, (self.decay ** (k - i + 1 - SHORTEST)).astype(np.float32)
        return self.triples_of[width]

    def kernel(self, words: Sequence[str]) -> np.ndarray:
        """Kernel values (words, fixed strings); 0 where no subsequence of three characters is shared."""
        out = np.zeros((len(words), self.n), np.float32)
        by_length: dict[int, list[int]] = {}
        for n, word in enumerate(words):
            by_length.setdefault(len(word), []).append(n)
        for width, members in by_length.items():
            if width < SHORTEST:
                continue
            size = max(1, 300_000 // len(self._places(width)[0]))
            for at in range(0, len(members), size):
                lot = members[at:at + size]
                out[lot] = self._lot([words[n] for n in lot], width)
        return out

    def _lot(self, words: list[str], width: int) -> np.ndarray:
        known = self.codes
        c = np.fromiter((known.get(x, 0) for w in words for x in w), np.int64, len(words) * width).reshape(-1, width)
        i, j, k, weight = self._places(width)
        code = (c[:, i] * self.base + c[:, j]) * self.base + c[:, k]
        out = np.zeros((len(words), self.n), np.float32)
        row = self.row_of_triple[code]
        word, place = np.nonzero(row)
        _add_rows(out, word, self.triple_rows[row[word, place]] * weight[place, None])
        word, place = np.nonzero(self.begins[code])
        for last in range(SHORTEST, width) if len(self.longer) else ():
            on = k[place] < last
            w, p = word[on], place[on]
            whole = code[w, p] * self.base + c[w, last]
            hit = np.minimum(np.searchsorted(self.longer, whole), len(self.longer) - 1)
            same = self.longer[hit] == whole
            w, p, hit = w[same], p[same], hit[same]
            _add_rows(out, w, self.longer_rows[hit + 1] * (
                self.decay ** (last - i[p] + 1 - LENGTH)).astype(np.float32)[:, None])
        return out


def _add_rows(out: np.ndarray, owner: np.ndarray, rows: np.ndarray) -> None:
    """Adds rows to their owners, which come in ascending order."""
    if len(owner):
        first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        out[owner[first]] += np.add.reduceat(rows, first, axis=0)


class Machine:
    """Landmarks, the weights of the trained machine over them, and the calibration of margins."""

    def __init__(self, landmarks: list[str]):
        self.landmarks = [START + word for word in landmarks]
        self.kernel = Subsequences(self.landmarks)
        k = self.kernel.kernel(self.landmarks).astype(np.float64)
        self.scale = 1 / np.sqrt(np.maximum(np.diag(k), 1e-12))
        values, vectors = np.linalg.eigh(k * np.outer(self.scale, self.scale))
        good = values > 1e-4
        self.whiten = vectors[:, good] / np.sqrt(values[good])
        self.weights = np.zeros(int(good.sum()))
        self.bias, self.slope, self.offset = 0.0, 1.0, 0.0

    def similarities(self, words: Sequence[str]) -> np.ndarray:
        """The kernel with each landmark, scaled so that a landmark in a word counts 1 at least."""
        return self.kernel.kernel([START + w for w in words]) * self.scale[None, :] ** 2

    def features(self, words: Sequence[str]) -> np.ndarray:
        return self.similarities(words) @ self.whiten

    def margins(self, words: list[str]) -> np.ndarray:
        """(words, 1): distances from the border, kept to [-2, 2]."""
        return np.clip(self.features(words) @ self.weights + self.bias, -2, 2).astype(np.float32)[:, None]

    def fit(self, words: Sequence[str], labels: np.ndarray, cost: float = 5000.0, rounds: int = 3000) -> None:
        """The squared hinge loss with class weights, by accelerated gradient descent."""
        x = np.hstack([self.features(words), np.ones((len(words), 1))])
        y = np.where(labels > 0, 1.0, -1.0)
        share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum()))
        w = v = np.zeros(x.shape[1])
        step = 1.0 / (1.0 + 2 * cost * np.linalg.norm(x.T @ (x * share[:, None]), 2))
        ridge = np.append(np.ones(x.shape[1] - 1), 0.0)
        for n in range(rounds):
            lack = np.maximum(0, 1 - y * (x @ v))
            new = v - step * (ridge * v - 2 * cost * x.T @ (share * y * lack))
            v, w = new + n / (n + 3) * (new - w), new
        self.weights, self.bias = w[:-1], float(w[-1])

    def calibrate(self, margins: np.ndarray, labels: np.ndarray) -> None:
        """Logistic fit of the label on the worst margin, with a little smoothing of the labels."""
        t = np.where(labels > 0, (labels.sum() + 1) / (labels.sum() + 2), 1 / ((1 - labels).sum() + 2))
        a, b = 2.0, 0.0
        for _ in range(100):
            p = 1 / (1 + np.exp(-(a * margins + b)))
            g = np.array([((p - t) * margins).sum() + 1e-3 * a, (p - t).sum()])
            s = p * (1 - p) + 1e-9
            hess = np.array([[(s * margins * margins).sum() + 1e-3, (s * margins).sum()], [(s * margins).sum(), s.sum() + 1e-9]])
            move = np.linalg.solve(hess, g)
            a, b = a - np.clip(move[0], -1, 1), b - np.clip(move[1], -1, 1)
        self.slope, self.offset = float(max(a, 0.1)), float(b)

    def score(self, worst: float) -> float:
        return 1 / (1 + math.exp(-(self.slope * worst + self.offset)))


def unrelated(bags: list[list[str]]) -> list[int]:
    """A group per bag: bags that share at least half of their strings with an earlier bag join its group.

    Copies of a document would otherwise make all of its strings look typical of its label.
    """
    held: dict[str, list[int]] = {}
    groups: list[int] = []
    for n, bag in enumerate(bags):
        shared = Counter(m for s in bag for m in held.get(s, ())[:50])
        best = max(shared, key=lambda m: (shared[m], -m), default=None)
        joined = best is not None and 2 * shared[best] >= min(len(bag), len(bags[best]))
        groups.append(groups[best] if joined else n)
        for s in bag:
            held.setdefault(s, []).append(n)
    return groups


def telling_roots(bags: list[dict[str, str]], labels: Sequence[int]) -> list[str]:
    """Beginnings of words found in many unrelated toxic documents and in few clean ones, the commonest first.

    A beginning counts once per group of related documents and once per word before it: a
    passage that many toxic documents share makes none of its words telling. Of beginnings
    that extend each other the longest without a loss of support stands for all.
    """
    def beginnings(bag) -> set[str]:
        return {s[:n] for s in bag for n in range(ROOT[0], min(len(s), ROOT[1]) + 1)}

    groups = unrelated([list(bag) for bag in bags])
    n_toxic = len({g for g, label in zip(groups, labels) if label})
    n_clean = max(1, sum(1 for label in labels if not label))
    least = max(3, LEAST_SUPPORT * n_toxic)
    documents = Counter()
    for bag, label in zip(bags, labels):
        if label:
            documents.update(beginnings(bag))
    # Few beginnings are in enough documents; only for these the groups and the words before are kept.
    hits: dict[str, tuple[set, set]] = {s: (set(), set()) for s, n in documents.items() if n >= least}
    del documents
    for bag, label, group in zip(bags, labels, groups):
        if label:
            for s, last in bag.items():
                for n in range(ROOT[0], min(len(s), ROOT[1]) + 1):
                    if s[:n] in hits:
                        hits[s[:n]][0].add(group)
                        hits[s[:n]][1].add(last)
    support = {s: n for s, (in_groups, after) in hits.items() if (n := min(len(in_groups), len(after))) >= least}
    clean = Counter()
    for bag, label in zip(bags, labels):
        if not label:
            clean.update(beginnings(bag) & support.keys())
    good = {s: n for s, n in support.items()
            if (n + 0.5) / (n_toxic + 1) >= LEAST_ODDS * (clean[s] + 0.5) / (n_clean + 1)}
    shortened = {s[:-1] for s, n in good.items() if n >= 0.9 * good.get(s[:-1], 1 << 60)}
    ends = [s for s in good if s not in shortened]
    roots = [s for s in ends if not any(s != r and s.startswith(r) for r in ends)]
    return sorted(roots, key=lambda s: (-good[s], s))


def disguised(words: Sequence[str], rng: np.random.Generator, each: int = 12) -> list[str]:
    """The words with one to three characters inserted between their own, or one doubled."""
    out = []
    for word in words:
        for n in range(each):
            s = list(word)
            for _ in range(1 + n % 3):
                at = int(rng.integers(1, len(s)))
                s.insert(at, s[at - 1] if n % 4 == 1 else INSERTED[int(rng.integers(len(INSERTED)))])
            out.append("".join(s))
    return out


def trained(bags: list[dict[str, str]], labels: Sequence[int], seed: int = SEED) -> Machine | None:
    """The machine for bags of strings and their labels; none where no string tells the labels apart."""
    roots = telling_roots(bags, labels)[:ROOTS]
    if not roots:
        return None
    rng = np.random.default_rng(seed)
    toxic_words, clean_words = Counter(), Counter()
    for bag, label in zip(bags, labels):
        (toxic_words if label else clean_words).update(bag.keys())
    if not clean_words:
        return None
    positive: list[str] = []
    for root in roots:
        own = sorted((w for w in toxic_words if w.startswith(root) and w not in clean_words), key=lambda w: (-toxic_words[w], w))
        positive += [root, *own[:EXAMPLES]]
    positive = list(dict.fromkeys(positive)) + 25 * roots + disguised(roots, rng)
    clean = sorted(set(clean_words) - set(positive))
    pool = [clean[i] for i in rng.permutation(len(clean))[:20 * NEGATIVES]]
    alike = Machine(roots).similarities(pool).max(axis=1)
    near = [pool[i] for i in np.argsort(-alike, kind="stable")[:NEGATIVES // 2]]
    negative = near + [pool[i] for i in range(min(len(pool), NEGATIVES // 2))]
    short = [w for w in near if len(w) <= ROOT[1]]
    spread = short[::max(1, len(short) // (LANDMARKS - len(roots)))][:LANDMARKS - len(roots)]
    machine = Machine(list(dict.fromkeys(roots + spread)))
    machine.fit(positive + negative, np.asarray([1] * len(positive) + [0] * len(negative)))
    # Two numbers are fitted here, so every third bag is enough.
    part = [n for n in range(len(bags)) if n % 3 == 0]
    every = sorted({s for n in part for s in bags[n]})
    margin = dict(zip(every, machine.margins(every)[:, 0].tolist()))
    worst = np.asarray([max((margin[s] for s in bags[n]), default=-2.0) for n in part])
    machine.calibrate(worst, np.asarray([labels[n] for n in part], float))
    return machine


def labelled_bags(docs: DataFrame, labels: DataFrame, documents: int = SAMPLE_DOCUMENTS) -> DataFrame:
    """(doc_id, toxic, bag) of at most ``documents`` labelled documents per class, those of least id hash.

    Held-out documents are left out before the draw. The sample is bounded, so it is sent to
    the tasks that read the documents.
    """
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out()).select(
        "doc_id", F.col("toxic").cast("int").alias("toxic"))
    drawn = None
    for label in (0, 1):
        part = usable.where(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(documents)
        drawn = part if drawn is None else drawn.union(part)

    def bag(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            bags = []
            for text in pdf.pop("text"):
                found = sorted(strings_in_place(text).items())
                rng = np.random.default_rng(len(found))
                bags.append(dict(found[i] for i in rng.permutation(len(found))[:SAMPLE_STRINGS]))
            yield pdf.assign(bag=bags)

    return docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id").mapInPandas(
        bag, "doc_id long, toxic int, bag map<string,string>")


def fitted(docs: DataFrame, labels: DataFrame, documents: int = SAMPLE_DOCUMENTS) -> Machine | None:
    found = labelled_bags(docs, labels, documents).collect()
    rows = sorted(((r["doc_id"], r["toxic"], r["bag"]) for r in found), key=lambda r: (r[0], r[1], len(r[2])))
    return trained([bag for _, _, bag in rows], [toxic for _, toxic, _ in rows]) if rows else None


def toxicity_report(docs: DataFrame, labels: DataFrame, documents: int = SAMPLE_DOCUMENTS,
                    threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, text) and (doc_id, toxic) -> (doc_id, held_out, score, predicted), a row per row of ``docs``.

    Null and empty texts have no string and get the score of the lowest margin. Rows of
    ``labels`` with a null or a label other than 0 and 1 are left out of the fit. Without any
    string that tells the labels apart (an empty ``labels``, say) every score is 0. Repeated
    rows are judged alike; other columns are ignored.
    """
    machine = fitted(docs, labels, documents)
    get = shipped(docs.sparkSession, machine)
    key = "toxicity:" + hashlib.sha256(pickle.dumps(machine)).hexdigest()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lists in as_lists(batches):
            bags = [strings(t) for t in lists.pop("text")]
            own = get()
            if own is None:
                lists["score"] = [0.0] * len(bags)
            else:
                lists["score"] = [own.score(float(rows.max()) if len(rows) else -2.0)
                                  for rows in table_for(key, own.margins).of(bags)]
            yield as_batch(lists, SCORED_SCHEMA)

    rows = docs.select("doc_id", held_out().alias("held_out"), "text")
    return rows.mapInArrow(score, "doc_id long, held_out boolean, score double").select(
        "doc_id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
