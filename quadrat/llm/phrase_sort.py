"""Collocations: phrases of two to five words that occur often and hold together.

Method. A suffix is the position of a word with up to ``DEPTH`` words from there. Suffix pointers are
sorted by multikey three-way quicksort: a segment is parted by one word into smaller, equal and larger,
the equal part goes on to the next word, and its size is the count of the phrase read so far. A
part with fewer than ``least`` suffixes is left at once, since no phrase in it can be frequent. Before that, suffixes are
routed over all tasks by their leading words, and infrequent leading words end there: (1) words are counted;
(2) pairs of frequent words are counted by the codes of both; (3) suffixes of three words and more that begin with a
frequent pair, cut before their first infrequent pair, are routed by their first three words, so a task sees all
suffixes of a phrase of three words or more, which is sorted there.

Scale. All three steps combine equal rows within a task before anything moves. What tasks are told about frequent words
and pairs is a bitmap of at most ``2 ** BITS`` bits, whatever the corpus; codes that share a bit let through
what the sort drops again, so nothing is lost and nothing wrong is counted. A task sorts chunks of bounded size;
where the suffixes of three leading words exceed a chunk, their parts are counted without leaving any, and
summed afterwards. Scores, nesting and ranks are DataFrame operations on the frequent phrases; ranks use a limit that
Spark applies before the shuffle.

Rows. A null text is empty, a null language is ``und``. Repeated rows count each time. Very long texts are cut into
nothing: a text is read whole. Counts are longs; products are decimals, whose 38 digits hold 1000 a n as long
as a n stays under 10^35. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quadrat.storage import settle

DEPTH, LEAST, TOP = 5, 100, 2_000
#: Leading words by which suffixes are routed.
ROUTE = 3
#: Most bits of a bitmap sent to tasks (16 MB), and bits for each member where there are fewer.
BITS, SPARSE = 27, 64
#: Words looked at together, and suffixes sorted together.
SLICE, CHUNK = 150_000, 400_000
#: Stands for the end of a piece; no UTF-8 text has this byte.
END = b"\xff"
_ENDS = b".,;:!?\n\x0b\x0c\r"
_TABLE = bytes(255 if c in _ENDS else c + 32 if 65 <= c <= 90 else c for c in range(256))
_ODD = np.array([0x9E3779B97F4A7C15], np.uint64)
_U = np.uint64


def tokens(text: bytes) -> list[bytes]:
    """Words of a text, with ``END`` between pieces and at the end."""
    out = text.translate(_TABLE).replace(END, b" \xff ").split()
    out.append(END)
    return out


def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a * _ODD + b
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class Bitmap:
    """Bits at the leading digits of codes."""

    def __init__(self, bits: int, words: np.ndarray):
        self.shift, self.words = 64 - bits, words

    def __contains__(self, code: int) -> bool:
        at = code >> self.shift
        return bool(int(self.words[at >> 6]) >> (at & 63) & 1)

    def holds(self, code: np.ndarray) -> np.ndarray:
        at = code >> _U(self.shift)
        return (self.words[(at >> _U(6)).astype(np.int64)] >> (at & _U(63))) & _U(1) == 1


def bitmap(codes: DataFrame) -> Bitmap:
    """Bitmap of the column ``code``."""
    bits = min(max((SPARSE * codes.count()).bit_length(), 16), BITS)
    at = F.shiftrightunsigned("code", 64 - bits)
    rows = codes.groupBy(F.shiftrightunsigned(at, 6).alias("w")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (at % 64).cast("int"))).alias("b")).toArrow()
    words = np.zeros(1 << (bits - 6), np.uint64)
    words[rows.column("w").to_numpy()] = rows.column("b").to_numpy().view(np.uint64)
    return Bitmap(bits, words)


class WordCodes(dict):
    """Codes of one language's words, those of frequent words only; forgets when it has grown large."""

    def __init__(self, lang: bytes, frequent: Bitmap):
        self.seed, self.frequent = xxhash.xxh64_intdigest(lang, 42), frequent
        super().__init__({END: 0})

    def __missing__(self, word: bytes) -> int:
        if len(self) > 400_000:
            self.clear()
            self[END] = 0
        code = xxhash.xxh64_intdigest(word, self.seed)
        code = self[word] = code if code in self.frequent else 0
        return code


def _by_language(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[bytes]]]:
    """Tokens of several texts of one language."""
    held: dict[str, list[bytes]] = defaultdict(list)
    total = 0
    for batch in batches:
        for row in range(0, batch.num_rows, 256):
            part = batch.slice(row, 256)
            for lang, text in zip(part.column("lang").to_pylist(), part.column("text").to_pylist()):
                own = tokens(text)
                held[lang] += own
                total += len(own)
                if len(held[lang]) > SLICE:
                    total -= len(held[lang])
                    yield lang, held.pop(lang)
                elif total > 8 * SLICE:
                    yield from held.items()
                    held.clear()
                    total = 0
    yield from held.items()


def _batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 100_000) -> Iterator[pa.RecordBatch]:
    part = []
    for row in rows:
        part.append(row)
        if len(part) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part), schema)], schema=schema)
            part = []
    if part:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part), schema)], schema=schema)


_WORDS = pa.schema([("lang", pa.string()), ("word", pa.string()), ("n", pa.int64())])
_PAIRS = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64())])
_SUFFIXES = pa.schema([("lang", pa.string()), ("route", pa.int64()), ("phrase", pa.string()), ("n", pa.int64())])


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows():
        count: dict[str, Counter] = defaultdict(Counter)
        for lang, own in _by_language(batches):
            count[lang].update(own)
            if sum(map(len, count.values())) > 600_000:
                for of, c in count.items():
                    del c[END]
                    yield from ((of, w, n) for w, n in c.items())
                count.clear()
        for of, c in count.items():
            del c[END]
            yield from ((of, w, n) for w, n in c.items())
    return _batches(rows(), _WORDS)


def _coded(batches: Iterator[pa.RecordBatch], frequent: Bitmap) -> Iterator[tuple[str, list[bytes], np.ndarray]]:
    """Language, tokens, and their codes (0: infrequent word or end)."""
    codes: dict[str, WordCodes] = {}
    for lang, own in _by_language(batches):
        if lang not in codes:
            codes[lang] = WordCodes(lang.encode(), frequent)
        yield lang, own, np.fromiter(map(codes[lang].__getitem__, own), np.uint64, len(own))


def _count_pairs(frequent: Bitmap):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush():
            a, b = (np.concatenate(x) for x in zip(*held))
            _, first, n = np.unique(joined(a, b), return_index=True, return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(a[first].view(np.int64)), pa.array(b[first].view(np.int64)), pa.array(n)], schema=_PAIRS)
        for _, _, code in _coded(batches, frequent):
            both = (code[:-1] != 0) & (code[1:] != 0)
            held.append((code[:-1][both], code[1:][both]))
            size += len(held[-1][0])
            if size > 5_000_000:
                yield flush()
                held, size = [], 0
        if size:
            yield flush()
    return run


def _join_codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b = (batch.column(c).to_numpy().view(np.uint64) for c in ("a", "b"))
        yield pa.RecordBatch.from_arrays([pa.array(joined(a, b).view(np.int64))], ["code"])


class _Held:
    """Counted suffixes of a task: equal ones are merged whenever those added since the last time outnumber the rest."""

    def __init__(self):
        self.parts, self.size, self.merged = [], 0, 0

    def add(self, key, n, route, phrase) -> None:
        self.parts.append((key, n, route, phrase))
        self.size += len(key)
        if self.size > 2 * self.merged + 200_000:
            self.merge()

    def merge(self) -> None:
        key, n, *rest = (np.concatenate(c) for c in zip(*self.parts))
        key, first, of = np.unique(key, return_index=True, return_inverse=True)
        n = np.bincount(of, weights=n, minlength=len(key)).astype(np.int64)
        self.parts, self.size, self.merged = [(key, n, *(c[first] for c in rest))], len(key), len(key)

    def rows(self, lang: str) -> Iterator[tuple]:
        if self.parts:
            self.merge()
            _, n, route, phrase = self.parts[0]
            yield from zip([lang] * len(n), route.tolist(), phrase.tolist(), n.tolist())


def _cut_suffixes(frequent: Bitmap, pairs: Bitmap):
    """Counted suffixes of ``ROUTE`` words and more that begin with a frequent pair, with their route."""
    def rows(batches):
        held: dict[str, _Held] = defaultdict(_Held)
        for lang, own, code in _coded(batches, frequent):
            pair = joined(code[:-1], code[1:])
            hot = np.append((code[:-1] != 0) & (code[1:] != 0), False)
            hot[:-1] &= pairs.holds(pair)
            words = np.where(hot, 2, 1)  # words of the suffix: every pair in it is frequent
            for _ in range(DEPTH - 2):
                words = np.where(hot, np.minimum(np.append(words[1:], 1) + 1, DEPTH), 1)
            at = np.flatnonzero(words >= ROUTE)
            name = route = code[at]
            for d in range(1, DEPTH):
                more = words[at] > d
                nxt = code[np.minimum(at + d, len(code) - 1)]
                name = np.where(more, joined(name, nxt), name)
                if d < ROUTE:
                    route = joined(route, nxt)
            key, first, n = np.unique(name, return_index=True, return_counts=True)
            phrases = np.empty(len(first), object)
            phrases[:] = [b" ".join(own[i:i + m]) for i, m in zip(at[first].tolist(), words[at[first]].tolist())]
            held[lang].add(key, n, route[first].view(np.int64), phrases)
            if sum(h.size for h in held.values()) > 1_500_000:
                for of, h in held.items():
                    yield from h.rows(of)
                held.clear()
        for of, h in held.items():
            yield from h.rows(of)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _batches(rows(batches), _SUFFIXES)
    return run


def multikey_quicksort(suffixes: np.ndarray, weight: np.ndarray, least: int, shortest: int) -> Iterator[tuple[int, int, int]]:
    """A suffix, a depth and its count, of every prefix of ``shortest`` words or more with a count of at least ``least``.

    ``suffixes`` has one row per suffix, padded by -1.
    """
    todo = [(np.arange(len(suffixes)), 0)]
    while todo:
        at, depth = todo.pop()
        if weight[at].sum() < least:
            continue
        key = suffixes[at, depth]
        if (key < 0).any():  # suffixes that end here are no part of a longer phrase
            at, key = at[key >= 0], key[key >= 0]
            if not len(at):
                continue
        pivot = sorted((int(key[0]), int(key[len(key) // 2]), int(key[-1])))[1]
        equal = at[key == pivot]
        if len(equal) < len(at):
            todo.append((at[key < pivot], depth))
            todo.append((at[key > pivot], depth))
        count = int(weight[equal].sum())
        if count < least:
            continue
        if depth + 1 >= shortest:
            yield int(equal[0]), depth + 1, count
        if depth + 1 < suffixes.shape[1]:
            todo.append((equal, depth + 1))


def _sort_routed(least: int):
    """Counts of the phrases of ``ROUTE`` words and more among routed suffixes, which come in the order of their routes."""
    def rows(batches):
        held, last = [], None

        def counts(whole: bool):
            ids: dict = defaultdict(lambda: len(ids))
            split = [p.split(b" ") for _, _, p, _ in held]
            table = np.full((len(held), DEPTH + 1), -1, np.int64)
            table[:, 0] = [ids[lang] for lang, *_ in held]
            for i, words in enumerate(split):
                table[i, 1:len(words) + 1] = [ids[w] for w in words]
            weight = np.array([n for *_, n in held], np.int64)
            for i, depth, n in multikey_quicksort(table, weight, least if whole else 1, ROUTE + 1):
                yield held[i][0], b" ".join(split[i][:depth - 1]), n
        cut = False  # the held suffixes are part of a route only
        for batch in batches:
            columns = [batch.column("lang").to_pylist(), batch.column("route").to_pylist(),
                       batch.column("phrase").cast(pa.binary()).to_pylist(), batch.column("n").to_pylist()]
            for row in zip(*columns):
                if row[:2] != last:
                    if len(held) >= CHUNK or cut:
                        yield from counts(not cut)
                        held, cut = [], False
                    last, begun = row[:2], len(held)
                elif len(held) >= 2 * CHUNK:
                    if begun and not cut:
                        rest, held = held[begun:], held[:begun]
                        yield from counts(True)
                        held, begun = rest, 0
                    if len(held) >= CHUNK:
                        yield from counts(False)
                        held, cut = [], True
                held.append(row)
        if held:
            yield from counts(not cut)

    schema = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("n", pa.int64())])
    return lambda batches: _batches(rows(batches), schema)


def frequent_phrases(docs: DataFrame, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """Words per language (lang, n), and phrases of 1 to ``DEPTH`` words with f >= ``least``: lang, phrase, words, f."""
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), text.alias("text"))
    words = settle(texts.mapInArrow(_count_words, "lang string, word string, n long")
                   .groupBy("lang", "word").agg(F.sum("n").alias("f")), "words")
    total = words.groupBy("lang").agg(F.sum("f").alias("n"))
    often = words.where(F.col("f") >= least)
    frequent = bitmap(often.select(F.xxhash64("lang", "word").alias("code")))
    pairs = texts.mapInArrow(_count_pairs(frequent), "a long, b long, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))
    pairs = settle(pairs.where(F.col("n") >= least), "pairs")
    cut = texts.mapInArrow(_cut_suffixes(frequent, bitmap(pairs.mapInArrow(_join_codes, "code long"))),
                           "lang string, route long, phrase string, n long")
    known = often.select(F.xxhash64("lang", "word").alias("code"), "lang", "word")
    of = lambda c: known.select(F.col("code").alias(c), F.col("word").alias("word_" + c), *(["lang"] if c == "a" else []))
    twos = pairs.join(of("a"), "a").join(of("b"), "b").select("lang", F.concat_ws(" ", "word_a", "word_b").alias("phrase"), "n")
    long = cut.repartition("lang", "route").sortWithinPartitions("lang", "route")
    more = long.mapInArrow(_sort_routed(least), "lang string, phrase string, n long")
    found = twos.unionByName(more).groupBy("lang", "phrase").agg(F.sum("n").alias("f")).where(F.col("f") >= least)
    found = found.select("lang", "phrase", F.size(F.split("phrase", " ")).alias("words"), "f")
    ones = often.select("lang", F.col("word").alias("phrase"), F.lit(1).alias("words"), "f")
    return total, settle(found.unionByName(ones), "phrases")


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """Each language's first phrases: lang, rank, phrase, a, l, r, n, score."""
    total, phrases = frequent_phrases(docs, least)
    candidates = phrases.where("words > 1").select("lang", "phrase", "words", F.col("f").alias("a"))
    part = lambda begin, length: F.array_join(F.slice(F.split("phrase", " "), begin, length), " ")
    k = F.col("k")
    cuts = candidates.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    cuts = cuts.withColumn("left", part(F.lit(1), k)).withColumn("right", part(k + 1, F.col("words") - k))
    for side, name in (("left", "l"), ("right", "r")):
        cuts = cuts.join(phrases.select("lang", F.col("phrase").alias(side), F.col("f").alias(name)), ["lang", side])
    wide = lambda c: F.col(c).cast("decimal(20,0)")
    exact = F.expr("(1000BD * CAST(a AS DECIMAL(20,0))) * CAST(n AS DECIMAL(20,0)) DIV (CAST(l AS DECIMAL(20,0)) * CAST(r AS DECIMAL(20,0)))")
    scored = cuts.join(total, "lang").withColumn("score", exact)
    worst = scored.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("m"))
    inner = candidates.where("words > 2").withColumn("length", F.explode(F.sequence(F.lit(2), F.col("words") - 1)))
    inner = inner.withColumn("begin", F.explode(F.sequence(F.lit(1), F.col("words") - F.col("length") + 1)))
    inner = inner.groupBy("lang", part(F.col("begin"), F.col("length")).alias("phrase")).agg(F.max("a").alias("within"))
    kept = worst.join(inner, ["lang", "phrase"], "left").where(
        F.col("within").isNull() | (100 * wide("within") < 100 * wide("a")))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("m.score"), F.desc("a"), "phrase"))
    return kept.withColumn("rank", rank).where(F.col("rank") <= top).select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", F.col("m.l").alias("l"), F.col("m.r").alias("r"), "n",
        F.col("m.score").alias("score"))
