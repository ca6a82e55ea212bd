"""Spelling variants: words one code point apart, found with a bit-sliced position index.

The index of a block of words has, for every (position, letter), a bitset over the block's
words that have this letter there. A word is read once against it. Four bitsets run along:
the words that agree so far without an error, and those with exactly one, by a replaced, a
missing or an added code point, the latter two reading the slices one place before and one
place ahead. Each step is a few word-parallel operations on whole bitsets.

Two words one code point apart agree in their first or in their last half, cut at half of
the shorter one's length. So a block holds the words of one half: the vocabulary is dealt by
(shorter length, side, half), and a pair that agrees in both halves is told by the first one
alone. A half that more words share than a block may hold becomes several blocks, each of
which is asked for all words of the half, so its tasks stay bounded and no pair is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.session import written

RUN = r"[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEAST_LENGTH, LEAST_COUNT, RATIO, SLIP = 6, 5, 5, 199
#: Words in a block of the index: the length of its bitsets.
BLOCK = 4_096


def observed_words(documents: DataFrame, least_length: int = LEAST_LENGTH, slip: int = SLIP) -> DataFrame:
    """(word) for every run of letters of every text that is long enough, one in ``slip`` with a code point left out."""
    runs = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(RUN), F.lit(0))
    # Shorter runs cannot become longer; those go before anything is computed of them.
    long_runs = F.filter(F.transform(runs, lambda r: F.translate(r, UPPER, LOWER)), lambda r: F.length(r) >= least_length)
    rows = documents.select("doc_id", F.explode(long_runs).alias("run"))
    own = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    rows = rows.select("run", F.crc32(F.concat(own, F.lit(":"), F.col("run")).cast("binary")).alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    return rows.select(F.when(F.col("h") % slip == 0, cut).otherwise(F.col("run")).alias("word")).where(
        F.length("word") >= least_length)


def vocabulary(documents: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT,
               slip: int = SLIP) -> DataFrame:
    """(word, n): the distinct observed words of at least ``least_count`` occurrences."""
    return observed_words(documents, least_length, slip).groupBy("word").agg(F.count("*").alias("n")).where(
        F.col("n") >= least_count)


def _halves(words: DataFrame) -> DataFrame:
    """(len, side, half, word, n): each word under both halves, as the shorter or equal and as the longer of a pair."""
    length = F.length("word")
    dealt = []
    for shorter in (length, length - 1):
        half = F.floor(shorter / 2).cast("int")
        dealt.append(F.struct(shorter.alias("len"), F.lit(0).alias("side"), F.substring("word", F.lit(1), half).alias("half")))
        dealt.append(F.struct(shorter.alias("len"), F.lit(1).alias("side"), F.substring("word", -half, half).alias("half")))
    return words.select(F.explode(F.array(*dealt)).alias("d"), "word", "n").select("d.*", "word", "n")


def _blocks(dealt: DataFrame, block: int) -> DataFrame:
    """Adds the block of the index a row belongs to, and whether it is in the index or only asked."""
    key = ["len", "side", "half"]
    sizes = dealt.groupBy(*key).agg(
        F.count("*").alias("members"), F.count(F.when(F.length("word") == F.col("len"), 1)).alias("shorter"))
    # A half without a word of the shorter length, or with one word alone, holds no pair.
    sizes = sizes.where("members > 1 AND shorter > 0").withColumn("blocks", F.ceil(F.col("members") / block).cast("int"))
    rows = dealt.join(sizes, key)
    own = F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int")
    single = F.array(F.struct(F.lit(0).alias("block"), F.lit(0).alias("role")))
    # Role 0 is in the index of its block; role 1 is asked there. In a single block every row is both.
    several = F.concat(
        F.array(F.struct(own.alias("block"), F.lit(0).alias("role"))),
        F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda b: F.struct(b.alias("block"), F.lit(1).alias("role"))))
    return rows.select(*key, "word", "n", "blocks", F.explode(F.when(F.col("blocks") == 1, single).otherwise(several)).alias("b")).select(
        *key, "word", "n", "blocks", "b.*")


class SlicedIndex:
    """Bitsets over a block's words per (position, letter), and per length."""

    def __init__(self, words: list[str]):
        self.words = words
        self.slices: dict[tuple[int, str], int] = {}
        self.lengths: dict[int, int] = {}
        for place, word in enumerate(words):
            bit = 1 << place
            for at, letter in enumerate(word):
                self.slices[at, letter] = self.slices.get((at, letter), 0) | bit
            self.lengths[len(word)] = self.lengths.get(len(word), 0) | bit
        #: Words longer than a position, which is where a replaced code point can stand.
        self.longer = [0] * (max(self.lengths, default=0) + 2)
        for at in range(len(self.longer) - 2, -1, -1):
            self.longer[at] = self.longer[at + 1] | self.lengths.get(at + 1, 0)

    def near(self, word: str) -> Iterator[int]:
        """Places of the words that differ from ``word`` by one replaced, missing or added code point."""
        get = self.slices.get
        same, replaced, missing, added = (1 << len(self.words)) - 1, 0, 0, 0
        for at, letter in enumerate(word):
            here = get((at, letter), 0)
            exists = self.longer[at] if at < len(self.longer) else 0
            # An added code point of theirs at this place: the letter stands one further. One missing: one before.
            added = (added | (same & exists)) & get((at + 1, letter), 0)
            missing = (missing & get((at - 1, letter), 0)) | same
            replaced = (replaced & here) | (same & exists & ~here)
            same &= here
            if not (same | replaced | missing | added):
                return
        length = len(word)
        found = replaced & self.lengths.get(length, 0)
        found |= missing & self.lengths.get(length - 1, 0)
        found |= (added | same) & self.lengths.get(length + 1, 0)
        while found:
            low = found & -found
            yield low.bit_length() - 1
            found ^= low


def _told_here(a: str, b: str, length: int, side: int) -> bool:
    """Is this the half under which the pair is told?"""
    return side == 0 or a[:length // 2] != b[:length // 2]


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reads rows sorted by block, those of the index first; gives each pair once."""
    schema = pa.schema([("a", pa.string()), ("a_n", pa.int64()), ("b", pa.string()), ("b_n", pa.int64())])
    now, index, found = None, None, []
    words: list[str] = []
    counts: list[int] = []

    def asked(word: str, n: int) -> None:
        length, side = now[:2]
        for place in index.near(word):
            other = index.words[place]
            # Pairs of two longer words belong to another length; each pair is told by its lesser word.
            if min(len(word), len(other)) == length and word < other and _told_here(word, other, length, side):
                found.append((word, n, other, counts[place]))

    def indexed() -> None:
        nonlocal index
        index = SlicedIndex(words)
        if now[-1] == 1:  # the only block of its half asks its own words
            for word, n in zip(words, counts):
                asked(word, n)

    for batch in batches:
        columns = batch.to_pydict()
        blocks = zip(*(columns[c] for c in ("len", "side", "half", "block", "blocks")))
        for block, role, word, n in zip(blocks, columns["role"], columns["word"], columns["n"]):
            if block != now:
                if now is not None and index is None:
                    indexed()
                now, index, words, counts = block, None, [], []
            if role == 0:
                words.append(word)
                counts.append(n)
            else:
                if index is None:
                    indexed()
                asked(word, n)
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found), schema)], schema=schema)
            found = []
    if now is not None and index is None:
        indexed()
    if found:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found), schema)], schema=schema)


def near_pairs(words: DataFrame, block: int = BLOCK) -> DataFrame:
    """(a, a_n, b, b_n): each pair of words one code point apart, once, a before b. ``words`` has distinct (word, n)."""
    dealt = _blocks(_halves(words), block)
    key = ["len", "side", "half", "block"]
    return dealt.repartition(*key).sortWithinPartitions(*key, "role").mapInArrow(
        _pairs, "a string, a_n long, b string, b_n long")


def _roots(forms: DataFrame) -> DataFrame:
    """(word, form) -> (word, root). A form's count is ``ratio`` times its word's, so chains are short and end."""
    now = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        step = written(now.alias("x").join(now.alias("y"), F.col("x.root") == F.col("y.word"), "left").select(
            F.col("x.word").alias("word"), F.coalesce("y.root", "x.root").alias("root"), F.col("y.root").isNotNull().alias("moved")), "roots")
        if not step.where("moved").take(1):
            return step.select("word", "root")
        now = step.select("word", "root")


def spelling_groups(documents: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT,
                    ratio: int = RATIO, slip: int = SLIP, block: int = BLOCK) -> DataFrame:
    """(word, n, n_near, form, form_n, root), a row per word of the vocabulary.

    ``documents`` has (doc_id, text); other columns are not looked at. Null and empty texts, and
    texts without a run of ``least_length`` letters, give no word. Rows that share an id or a text
    are counted each; a null id counts as the text ``null``. Of near words with equal counts the
    first in code-point order is the form. No documents, or no word often enough: no rows.
    """
    words = written(vocabulary(documents, least_length, least_count, slip), "vocabulary")
    pairs = written(near_pairs(words, block), "near-words")
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("near"), F.col("b_n").alias("near_n")).unionByName(
        pairs.select(F.col("b").alias("word"), F.col("a").alias("near"), F.col("a_n").alias("near_n")))
    best = both.groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("least"), F.col("near"))).alias("best"))
    joined = words.join(best, "word", "left")
    commoner = -F.col("best.least") >= ratio * F.col("n")
    told = written(joined.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(commoner, F.col("best.near")).alias("form"), F.when(commoner, -F.col("best.least")).cast("long").alias("form_n")), "forms")
    roots = _roots(told.where("form IS NOT NULL"))
    return told.join(roots, "word", "left").withColumn("root", F.coalesce("root", "word")).select(
        "word", "form", "root", "n", "n_near", "form_n")


def spelling_sql(least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, ratio: int = RATIO, slip: int = SLIP) -> str:
    """The same with a check sum made of a table, and near words by what is left without one code point."""
    # The chain of forms has at most 28 links: counts grow by the ratio at each.
    return f"""WITH RECURSIVE poly AS MATERIALIZED (SELECT list(list_reduce(list_prepend(i, range(8)),
            lambda c, k: CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END) ORDER BY i) AS t FROM range(256) b(i)),
        runs AS MATERIALIZED (SELECT coalesce(doc_id::VARCHAR, 'null') AS id, translate(r, '{UPPER}', '{LOWER}') AS run, count(*) AS times
            FROM (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]+')) AS r FROM documents)
            WHERE length(r) >= {least_length} GROUP BY ALL),
        -- Runs have code points below 256 alone, of one or two bytes.
        bytes AS (SELECT id, run, times, flatten(list_transform(string_split(id || ':' || run, ''),
            lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [195::BIGINT, unicode(c)::BIGINT - 64] END)) AS b FROM runs),
        hashed AS MATERIALIZED (SELECT run, times, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, b),
            lambda c, x: xor(c // 256, t[(xor(c, x) & 255) + 1]::BIGINT))) AS h FROM bytes, poly),
        words AS MATERIALIZED (SELECT word, sum(times)::BIGINT AS n FROM (SELECT times, CASE WHEN h % {slip} = 0
            THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM hashed)
            WHERE length(word) >= {least_length} GROUP BY word HAVING sum(times) >= {least_count}),
        cuts AS MATERIALIZED (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS rest
            FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)),
        pairs AS (SELECT a.word AS a, b.word AS b, b.n AS b_n FROM cuts a JOIN cuts b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
            UNION SELECT c.word, w.word, w.n FROM cuts c JOIN words w ON c.rest = w.word
            UNION SELECT w.word, c.word, c.n FROM cuts c JOIN words w ON c.rest = w.word),
        best AS (SELECT a, count(*) AS n_near, max(b_n) AS top, arg_min(b, (-b_n, b)) AS near FROM pairs GROUP BY a),
        told AS MATERIALIZED (SELECT word, n, coalesce(n_near, 0)::BIGINT AS n_near,
            CASE WHEN top >= {ratio} * n THEN near END AS form, CASE WHEN top >= {ratio} * n THEN top END::BIGINT AS form_n
            FROM words LEFT JOIN best ON word = a),
        chain AS (SELECT word, word AS at, form AS next FROM told
            UNION ALL SELECT c.word, t.word, t.form FROM chain c JOIN told t ON c.next = t.word)
        SELECT t.word, t.form, c.at AS root, t.n, t.n_near, t.form_n FROM told t JOIN chain c ON c.word = t.word AND c.next IS NULL"""


SPELLING_SQL = spelling_sql()
