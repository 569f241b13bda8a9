"""Removal of repeated runs of words by recompression.

Method. A text is a sequence of words. A round of recompression replaces
maximal runs of one symbol, then pairs of a left and a right symbol (the side is
a bit of the symbol's name), each by a new symbol; only what stays within the
round's length is replaced, so no symbol outgrows a window. A name is a hash of
what it stands for: all tasks name alike, and equal word sequences are cut alike
inside. How far inside is known exactly: each symbol carries the stretch of words
that decided it, and only symbols decided within ``CONTEXT`` words on either side
are offered as interior symbols. A window is filed under the longest of its
interior symbols (ties: smaller name, then leftmost), which depends on the
window's words alone; a window without any, under its own hash.

Spark rounds resolve the names over the whole collection:
(1) names that only one text has fall away;
(2) a shared symbol is extended by ``SIDE`` words to the left and to the right.
A window of 50 words reaches that far on one side at least, so runs of windows
fall away whose both extensions stand in one text only;
(3) the windows left are named in full, and the smallest doc_id of a name
decides whether a window is a repeat.

Scale. Consecutive windows mostly share a symbol, so a run of them is one row
(about one row for fourteen words). Copies of a text are found by its hashes first:
only the first of them takes part, the others go as a whole. Counts of names
are combined map-side. Joins on names carry the hot ones in full; they are
ordinary sort-merge joins that adaptive execution splits. Texts are shuffled once, and
those with a run left in (3) a second time.

Rows. A null text has no words; texts under a window stay whole. Documents with equal
doc_id do not remove each other's words, repeated rows give repeated results. A null
doc_id counts as larger than all others. doc_id must be a whole number. An empty table
gives an empty result. Other columns are not read. Names are 60 to 64 bits; windows and
texts are compared by two of them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quadrat.llm.common import map_rows
from quadrat.storage import settle

WINDOW = 50
#: Most words of a symbol after each round.
LENGTHS = (2, 4, 8)
#: Words around an interior symbol that may have decided it.
CONTEXT = 8
#: Words of an extension: a window around a symbol reaches that far on one side at least.
SIDE = (WINDOW - LENGTHS[-1]) // 2
#: Words taken together, so that arrays stay in cache.
SLICE = 60_000
LAST = np.iinfo(np.int64).max
_NONE = np.iinfo(np.uint64).max
_ODD = np.array([0x9E3779B97F4A7C15], np.uint64)
_U = np.uint64


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Name of a pair."""
    return mixed(a * _ODD + b)


class WordNames(dict):
    """Names of words; forgets when it has grown large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 400_000:
            self.clear()
        name = self[word] = xxhash.xxh64_intdigest(word, 7)
        return name


class Parse:
    """Symbols of texts one after another: name, words, text, and the stretch that decided each."""

    def __init__(self, words: np.ndarray, text: np.ndarray):
        at = np.arange(len(words))
        self.name, self.size, self.text, self.low, self.high = words, np.ones(len(words), np.int64), text, at, at + 1

    def _set(self, name, size, text, low, high):
        self.name, self.size, self.text, self.low, self.high = name, size, text, low, high

    def runs(self, most: int) -> None:
        """Maximal runs of one symbol become a symbol if they have at most ``most`` words."""
        name, size, text, low, high = self.name, self.size, self.text, self.low, self.high
        if not len(name):
            return
        edge = np.ones(len(name), bool)
        edge[1:] = (name[1:] != name[:-1]) | (text[1:] != text[:-1])
        at = np.flatnonzero(edge)
        count = np.diff(np.append(at, len(name)))
        last = at + count - 1
        inner = np.append(text[at][1:] == text[at][:-1], False)  # the next run is of the same text
        outer = np.append(False, inner[:-1])
        start = np.cumsum(size) - size
        # the symbols left and right of a run; the end of a text is a place outside it
        before, after = np.maximum(at - 1, 0), np.minimum(last + 1, len(name) - 1)
        ends = start[last] + size[last]
        left = np.where(outer, low[before], start[at] - 1), np.where(outer, high[before], start[at])
        right = np.where(inner, low[after], ends), np.where(inner, high[after], ends + 1)
        total = count * size[at]
        whole = total <= most
        single = count == 1
        run = np.repeat(np.arange(len(at)), count)
        new_low, new_high = low.copy(), high.copy()
        long = np.flatnonzero((~whole & ~single)[run])
        if len(long):
            # a member of a longer run is decided by as many members as exceed ``most``: from itself on, or the last ones
            need, of = most // size[long] + 1, run[long]
            from_ = np.minimum(long, last[of] - need + 1)
            for step in range(int(need.max())):
                place = from_ + np.minimum(step, need - 1)
                new_low[long] = np.minimum(new_low[long], low[place])
                new_high[long] = np.maximum(new_high[long], high[place])
            for some, (lo, hi) in ((from_ < long, right), (long == at[of], left)):
                new_low[long[some]] = np.minimum(new_low[long[some]], lo[of[some]])
                new_high[long[some]] = np.maximum(new_high[long[some]], hi[of[some]])
        alone = whole | single
        taken = np.where(alone, 1, count)
        merged = np.repeat(alone, taken)
        keep = np.ones(len(name), bool)
        keep[1:] = ~((run[1:] == run[:-1]) & alone[run[1:]])
        out_name, out_size = name[keep], size[keep]
        out_low, out_high = new_low[keep].copy(), new_high[keep].copy()
        runs_low = np.minimum(np.minimum.reduceat(low, at), np.minimum(left[0], right[0]))
        runs_high = np.maximum(np.maximum.reduceat(high, at), np.maximum(left[1], right[1]))
        of = run[keep]
        out_low[merged], out_high[merged] = runs_low[of[merged]], runs_high[of[merged]]
        many = merged & (count[of] > 1)
        out_name[many] = mixed(joined(name[at[of[many]]], count[of[many]].astype(np.uint64)))
        out_size[many] = total[of[many]]
        self._set(out_name, out_size, text[keep], out_low, out_high)

    def pairs(self, most: int, round_: int) -> None:
        """A left symbol and the right symbol after it become one if they have at most ``most`` words."""
        name, size, text, low, high = self.name, self.size, self.text, self.low, self.high
        if not len(name):
            return
        left = (mixed(name + _U(7919 * round_ + 1)) >> _U(63)) == 0
        same = np.append(text[1:] == text[:-1], False)
        end = np.cumsum(size)
        # a left symbol is decided by the next one, a right symbol by the one before
        new_low, new_high = low.copy(), high.copy()
        l, r = np.flatnonzero(left & same), np.flatnonzero(~left & np.append(False, same[:-1]))
        new_low[l] = np.minimum(low[l], low[l + 1])
        new_high[l] = np.maximum(high[l], high[l + 1])
        new_low[r] = np.minimum(low[r], low[r - 1])
        new_high[r] = np.maximum(high[r], high[r - 1])
        l, r = np.flatnonzero(left & ~same), np.flatnonzero(~left & ~np.append(False, same[:-1]))
        new_high[l] = end[l] + 1
        new_low[r] = end[r] - size[r] - 1
        go = left & same
        go[:-1] &= ~left[1:] & (size[:-1] + size[1:] <= most)
        go = np.flatnonzero(go)
        name, size = name.copy(), size.copy()
        name[go] = joined(name[go], name[go + 1])
        size[go] += size[go + 1]
        new_low[go] = np.minimum(new_low[go], new_low[go + 1])
        new_high[go] = np.maximum(new_high[go], new_high[go + 1])
        keep = np.ones(len(name), bool)
        keep[go + 1] = False
        self._set(name[keep], size[keep], text[keep], new_low[keep], new_high[keep])


def recompress(words: np.ndarray, text: np.ndarray) -> Parse:
    parse = Parse(words, text)
    for round_, most in enumerate(LENGTHS):
        parse.runs(most)
        parse.pairs(most, round_)
    return parse


def powers(words: np.ndarray, size: int) -> np.ndarray:
    """A hash of every ``size`` consecutive words, put together from stretches of powers of two."""
    out, done, part, width, factor = None, 0, words, 1, _ODD
    while True:
        if size & width:
            if out is None:
                out, done = part, width
            else:
                n = max(len(words) - done - width + 1, 0)
                out = out[:n] * factor + part[done:done + n]
                done += width
        if 2 * width > size:
            return mixed(out[:max(len(words) - size + 1, 0)])
        part = part[:-width] * factor + part[width:]
        factor = factor * factor
        width *= 2


def least_at(key: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Smallest of every ``size`` consecutive values, and the leftmost place it stands at."""
    at, width, n = np.arange(len(key), dtype=np.int32), 1, len(key) - size + 1
    while 2 * width <= size:
        other = key[width:] < key[:-width]
        at = np.where(other, at[width:], at[:-width])
        key = np.where(other, key[width:], key[:-width])
        width *= 2
    shift = size - width
    other = key[shift:shift + n] < key[:n]
    return np.where(other, key[shift:shift + n], key[:n]), np.where(other, at[shift:shift + n], at[:n])


def filed(words: np.ndarray, text: np.ndarray):
    """Runs of windows under one symbol: text, first window, windows, name, name extended left, right.

    Places count from the start of all words; an extension that the text does not hold is 0.
    """
    n = len(words)
    if n < WINDOW:
        none = np.empty(0, np.int64)
        return (none,) * 3 + (np.empty(0, np.uint64),) * 3
    parse = recompress(words, text)
    start = np.cumsum(parse.size) - parse.size
    ok = (start - parse.low <= CONTEXT) & (parse.high - start - parse.size <= CONTEXT)
    at, size = start[ok], parse.size[ok]
    key = np.full(n, _NONE)
    key[at] = ((_U(LENGTHS[-1]) - size.astype(np.uint64)) << _U(60)) | (mixed(parse.name[ok]) >> _U(4))
    length = np.zeros(n, np.int64)
    length[at] = size
    best, place = least_at(key[CONTEXT:], WINDOW - 2 * CONTEXT - LENGTHS[-1] + 1)
    windows = n - WINDOW + 1
    best, place = best[:windows].copy(), place[:windows].astype(np.int64) + CONTEXT
    valid = text[WINDOW - 1:] == text[:windows]
    bare = np.flatnonzero((best == _NONE) & valid)
    side = powers(words, SIDE) | _U(1)
    before, after = place - SIDE, place + length[place]
    # a side is inside the window's text if both its ends are
    ends = np.minimum(after + SIDE - 1, n - 1)
    lefts = np.where((before >= 0) & (text[np.maximum(before, 0)] == text[:windows]), side[np.clip(before, 0, len(side) - 1)], _U(0))
    rights = np.where((after + SIDE <= n) & (text[ends] == text[:windows]), side[np.clip(after, 0, len(side) - 1)], _U(0))
    if len(bare):
        own = powers(words, WINDOW)[bare]
        best[bare], lefts[bare], rights[bare] = own | (_U(15) << _U(60)), own | _U(1), _U(0)
    edge = np.ones(windows, bool)
    edge[1:] = ((best[1:] != best[:-1]) | (lefts[1:] != lefts[:-1]) | (rights[1:] != rights[:-1])
                | (text[1:windows] != text[:windows - 1]) | (valid[1:] != valid[:-1]))
    first = np.flatnonzero(edge)
    count = np.diff(np.append(first, windows))
    held = valid[first]
    first, count = first[held], count[held]
    return text[first], first, count, best[first], lefts[first], rights[first]


_RUN = T.StructType([T.StructField(n, t) for n, t in [
    ("key", T.LongType()), ("left", T.IntegerType()), ("right", T.IntegerType()), ("at", T.IntegerType()), ("windows", T.IntegerType())]])


def _slices(texts: list[bytes]) -> Iterator[tuple[int, list[list[bytes]]]]:
    """Split texts, some at a time: index of the first, words of each."""
    at, held, size = 0, [], 0
    for text in texts:
        held.append(text.split())
        size += len(held[-1])
        if size >= SLICE:
            yield at, held
            at, held, size = at + len(held), [], 0
    if held:
        yield at, held


def _names(names: WordNames, split: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Names of all words, the text of each, and where each text starts."""
    length = np.fromiter(map(len, split), np.int64, len(split))
    words = np.fromiter(map(names.__getitem__, chain.from_iterable(split)), np.uint64, int(length.sum()))
    return words, np.repeat(np.arange(len(split)), length), np.cumsum(length) - length


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Word count, hash of all words, and filed runs of every text."""
    names = WordNames()
    run = pa.struct([("key", pa.int64()), ("left", pa.int32()), ("right", pa.int32()), ("at", pa.int32()), ("windows", pa.int32())])
    for batch in batches:
        for row in range(0, batch.num_rows, 256):
            part = batch.slice(row, 256)
            at = 0
            for at, split in _slices(part.column("text").to_pylist()):
                words, text, start = _names(names, split)
                of, first, count, key, left, right = filed(words, text)
                short = lambda x: (x & _U(0xFFFFFFFF)).astype(np.uint32).view(np.int32)
                runs = pa.StructArray.from_arrays(
                    [pa.array(key.view(np.int64)), pa.array(short(left)), pa.array(short(right)),
                     pa.array((first - start[of]).astype(np.int32)), pa.array(count.astype(np.int32))], fields=list(run))
                offsets = np.searchsorted(of, np.arange(len(split) + 1)).astype(np.int32)
                own = part.slice(at, len(split))
                yield pa.RecordBatch.from_arrays(
                    [own.column("doc"), own.column("h1"), own.column("h2"),
                     pa.array(np.fromiter(map(len, split), np.int64, len(split))),
                     pa.array([hashlib.sha256(b" ".join(s)).hexdigest() for s in split]),
                     pa.ListArray.from_arrays(pa.array(offsets), runs)],
                    ["doc", "h1", "h2", "n_words", "whole_sha256", "runs"])


def _window_names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for every window of the runs that are left: its symbol, its own name, its place."""
    names = WordNames()
    for batch in batches:
        for row in range(0, batch.num_rows, 64):
            part = batch.slice(row, 64)
            split = [t.split() for t in part.column("text").to_pylist()]
            words, _, start = _names(names, split)
            hashes = powers(words, WINDOW)
            for i, runs in enumerate(part.column("found").to_pylist()):
                at = np.concatenate([np.arange(r["at"], r["at"] + r["windows"]) for r in runs])
                key = np.repeat(np.array([r["key"] for r in runs], np.int64), [r["windows"] for r in runs])
                name = hashes[start[i] + at].view(np.int64)
                same = lambda c: pa.array(np.full(len(at), part.column(c)[i].as_py(), np.int64))
                yield pa.RecordBatch.from_arrays([same("doc"), same("h1"), pa.array(key), pa.array(name), pa.array(at.astype(np.int32))],
                                                 ["doc", "h1", "key", "name", "at"])


def kept_words(words: list[bytes], starts: list[int]) -> list[bytes]:
    """Words that no window starting at ``starts`` covers."""
    cover = np.zeros(len(words) + 1, np.int64)
    at = np.array(starts, np.int64)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + WINDOW, -1)
    gone = np.cumsum(cover[:-1]) > 0
    return [w for w, g in zip(words, gone.tolist()) if not g]


def _shared(rows: DataFrame, *by: str) -> DataFrame:
    """Values of the columns that more than one text has."""
    return rows.groupBy(*by).agg(F.min("h1").alias("_a"), F.max("h1").alias("_b")).where("_a <> _b").select(*by)


def repeats(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All documents parsed, and the windows to remove of first texts: doc, h1, text, starts."""
    doc = F.coalesce(F.col("doc_id").cast("long"), F.lit(int(LAST)))
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    texts = docs.select(doc.alias("doc"), F.xxhash64(text).alias("h1"), F.xxhash64(F.lit("words"), text).alias("h2"), text.alias("text"))
    parsed = settle(texts.mapInArrow(_parse, T.StructType([
        *texts.drop("text").schema.fields, T.StructField("n_words", T.LongType()), T.StructField("whole_sha256", T.StringType()),
        T.StructField("runs", T.ArrayType(_RUN))])), "parsed")
    runs = parsed.select("doc", "h1", F.inline("runs"))
    names = settle(_shared(runs, "key"), "names")
    shared = runs.join(names, "key")
    first = parsed.groupBy("h1", "h2").agg(F.min("doc").alias("doc")).select("doc", "h1")
    shared = settle(shared.join(first, ["doc", "h1"], "left_semi").distinct(), "shared")
    sides = shared.select("h1", "key", F.explode(F.array(
        F.struct(F.lit(0).alias("side"), F.col("left").alias("of")), F.struct(F.lit(1).alias("side"), F.col("right").alias("of")))).alias("s"))
    sides = settle(_shared(sides.select("h1", "key", "s.side", "s.of").where("of <> 0"), "key", "side", "of"), "sides")
    either = [shared.join(sides.where(F.col("side") == i).select("key", F.col("of").alias(c)), ["key", c], "left_semi").select(shared.columns)
              for i, c in enumerate(("left", "right"))]
    found = either[0].unionByName(either[1]).distinct()
    found = found.groupBy("doc", "h1").agg(F.collect_list(F.struct("key", "at", "windows")).alias("found"))
    active = settle(texts.join(found, ["doc", "h1"]).drop("h2"), "active")
    windows = settle(active.mapInArrow(_window_names, "doc long, h1 long, key long, name long, at int"), "windows")
    # written first: then both sides of the join arrive by a shuffle of their own, and adaptive execution can split a hot window
    least = windows.groupBy("key", "name").agg(F.min("doc").alias("least"), F.max("doc").alias("most")).where("least < most")
    least = settle(least.drop("most"), "least")
    marks = (windows.join(least, ["key", "name"]).where("least < doc")
             .groupBy("doc", "h1").agg(F.collect_set("at").alias("starts")))
    return parsed.drop("runs"), active.drop("found").join(marks, ["doc", "h1"])


def remove_repeated_words(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every document."""
    parsed, marked = repeats(docs)

    def make():
        def rows(batch):
            for doc, h1, text, starts in zip(*(batch[c] for c in ("doc", "h1", "text", "starts"))):
                kept = kept_words(text.split(), starts)
                yield doc, h1, len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()
        return rows

    cut = map_rows(marked, T.StructType().add("doc", "long").add("h1", "long").add("n_kept", "long").add("cut_sha256", "string"), make)
    cut = settle(cut.distinct(), "cut")
    first = parsed.groupBy("h1", "h2").agg(F.min("doc").alias("first"))
    all_ = parsed.join(first, ["h1", "h2"]).join(cut, ["doc", "h1"], "left")
    copy = (F.col("first") < F.col("doc")) & (F.col("n_words") >= WINDOW)
    none = hashlib.sha256(b"").hexdigest()
    doc_id = F.when(F.col("doc") != int(LAST), F.col("doc")).cast(docs.schema["doc_id"].dataType)
    return all_.select(
        doc_id.alias("doc_id"), "n_words",
        F.when(copy, F.col("n_words")).otherwise(F.col("n_words") - F.coalesce("n_kept", "n_words")).alias("n_removed"),
        F.when(copy, F.lit(none)).otherwise(F.coalesce("cut_sha256", "whole_sha256")).alias("kept_sha256"))
