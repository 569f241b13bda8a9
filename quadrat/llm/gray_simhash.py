"""SimHash near-duplicates over an index ordered by Gray rank.

Method. Equal fingerprints are one entry. Two fingerprints that differ in at
most ``d`` bits agree on one of ``d + 1`` bit blocks, so every entry is dealt
to its ``d + 1`` masked patterns. Where one pattern holds too many entries,
the same argument is applied to its free bits, so no task is unbounded and no
link is lost. Inside a task the entries are sorted by Gray rank (neighbours
in that order differ in few bits), runs of eight share a node that holds the
bits they have in common, and nodes are grouped again up to a root. A search
of the tree against itself goes down pairs of nodes: each level adds the
differences on bits that became common there to what the pair has
accumulated, and a pair above ``d`` is dropped with everything under it.
Tasks give only a spanning forest of their links, never pairs of a group;
components are contracted in Spark.

Rows. A null or wordless text has fingerprint 0 and is linked like any other.
Repeated rows share a fingerprint. An empty table gives an empty result. A
null doc_id is no component id unless all of its component are null. Other
columns of the table are not read, but ``one_of_each_group`` returns them. It keeps a row with the
group's smallest doc_id; where several rows have it, the one with the smallest fingerprint, then the
smallest hash of all columns.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quadrat.llm.common import (components, join_labels, map_rows, partitions_for, schema_of, texts, words)
from quadrat.storage import settle

FULL = (1 << 64) - 1
#: Entries of one masked pattern beyond which its free bits are split again.
SPLIT_AT = 8_000
FAN = 8
_PAIRS_AT_ONCE = 8_192


def shingle_hashes(tokens: list[bytes], size: int) -> np.ndarray:
    """XXH64 (seed 42) of every ``size``-word shingle; the whole sequence if it is shorter."""
    n = len(tokens)
    if not n:
        return np.empty(0, np.uint64)
    line = b" ".join(tokens)
    if n <= size:
        return np.array([xxhash.xxh64_intdigest(line, 42)], np.uint64)
    length = np.fromiter(map(len, tokens), np.int64, n)
    end = np.cumsum(length + 1) - 1
    spans = zip((end - length)[: n - size + 1].tolist(), end[size - 1:].tolist())
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(line[s:e], 42) for s, e in spans), np.uint64, n - size + 1)


def majority_bits(hashes: np.ndarray) -> int:
    """Bits set in over half of the hashes."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 16_384):
        part = hashes[at:at + 16_384].astype("<u8")
        counts += np.unpackbits(part.view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.int64)
    over = (2 * counts > len(hashes)).astype(np.uint8)
    return int(np.packbits(over, bitorder="little").view("<u8")[0])


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, shingle_words: int = 3) -> DataFrame:
    """doc_id, fp (64 bits as a long) of whole texts."""
    def make():
        def rows(batch):
            for doc, text in zip(batch["doc_id"], batch["text"]):
                yield doc, signed(majority_bits(shingle_hashes(words(text), shingle_words)))
        return rows
    return map_rows(texts(docs), schema_of(docs, "doc_id", fp=T.LongType()), make)


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Position of each code word in the reflected Gray sequence."""
    x = x.copy()
    for s in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(s)
    return x


class GrayTree:
    """Entries in Gray order under nodes that hold the bits all entries below have in common."""

    def __init__(self, codes: np.ndarray, key: int):
        key = np.uint64(key)
        order = np.lexsort((gray_rank(codes), codes & key))
        self.order, self.key = order, key
        codes = codes[order]
        self.pattern, self.mask = [codes], [np.full(len(codes), FULL, np.uint64)]
        every, some = codes, codes
        while len(every) > 1:
            starts = np.arange(0, len(every), FAN)
            every, some = np.bitwise_and.reduceat(every, starts), np.bitwise_or.reduceat(some, starts)
            self.pattern.append(every)
            self.mask.append(~(every ^ some))

    def close(self, distance: int):
        """Yield index arrays (a, b) of different entries that agree on the key and differ in at most ``distance`` bits."""
        top = len(self.pattern) - 1
        zero = np.zeros(1, np.int64)
        todo = [(top, zero, zero, np.zeros(1, np.int64), np.zeros(1, np.uint64))]
        step = np.arange(FAN)
        while todo:
            level, a, b, acc, known = todo.pop()
            if level == 0:
                yield self.order[a], self.order[b]
                continue
            if len(a) > _PAIRS_AT_ONCE:
                for at in range(0, len(a), _PAIRS_AT_ONCE):
                    cut = slice(at, at + _PAIRS_AT_ONCE)
                    todo.append((level, a[cut], b[cut], acc[cut], known[cut]))
                continue
            level -= 1
            pattern, mask, n = self.pattern[level], self.mask[level], len(self.pattern[level])
            x = np.repeat((a[:, None] * FAN + step), FAN, axis=1).ravel()
            y = np.tile((b[:, None] * FAN + step), (1, FAN)).ravel()
            acc, known = np.repeat(acc, FAN * FAN), np.repeat(known, FAN * FAN)
            ok = (x < n) & (y < n) & ((x < y) if level == 0 else (x <= y))
            x, y, acc, known = x[ok], y[ok], acc[ok], known[ok]
            common = mask[x] & mask[y]
            differ = (pattern[x] ^ pattern[y]) & common
            acc = acc + np.bitwise_count(differ & ~known)
            ok = (acc <= distance) & ((differ & self.key) == 0)
            if ok.any():
                todo.append((level, x[ok], y[ok], acc[ok], common[ok]))


def blocks(free: int, pieces: int) -> list[int]:
    """The set bits of ``free`` in ``pieces`` masks of nearly equal size."""
    bits = [1 << i for i in range(64) if free >> i & 1]
    cut = [len(bits) * i // pieces for i in range(pieces + 1)]
    return [sum(bits[x:y]) for x, y in zip(cut, cut[1:])]


def forest(entries: DataFrame, distance: int, split_at: int = SPLIT_AT) -> DataFrame:
    """Spanning edges a, b (codes) of the graph that links codes within ``distance`` bits.

    ``entries`` has one row ``fp`` per different code.
    """
    def dealt(df, masks):
        pairs = F.array(*[F.lit(signed(m)) for m in masks])
        return df.select("fp", F.explode(pairs).alias("mask")).withColumn(
            "pattern", F.col("fp").bitwiseAND(F.col("mask")))

    masks = blocks(FULL, distance + 1)
    level = settle(dealt(entries, masks), "dealt")
    done = None
    while True:
        sizes = level.groupBy("mask", "pattern").count()
        hot = settle(sizes.where(F.col("count") > split_at).select("mask", "pattern"), "hot")
        masks = [m for m in masks if (FULL ^ m).bit_count() > distance]
        if not masks or hot.isEmpty():
            break
        cool = level.join(hot, ["mask", "pattern"], "left_anti")
        done = cool if done is None else done.unionByName(cool)
        finer = {m: [m | s for s in blocks(FULL ^ m, distance + 1)] for m in masks}
        parts = F.create_map(*[x for m, fs in finer.items()
                               for x in (F.lit(signed(m)), F.array(*[F.lit(signed(f)) for f in fs]))])
        level = settle(level.join(hot, ["mask", "pattern"], "left_semi").select(
            "fp", F.explode(parts[F.col("mask")]).alias("mask")).withColumn(
            "pattern", F.col("fp").bitwiseAND(F.col("mask"))), "split")
        masks = sorted({f for fs in finer.values() for f in fs})
    level = level if done is None else done.unionByName(level)
    level = level.select("fp", "mask", "pattern")

    def search(batches):
        got = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
        if not got:
            return
        code = np.concatenate([x for x, _ in got]).view(np.uint64)
        mask = np.concatenate([y for _, y in got]).view(np.uint64)
        for m in np.unique(mask):
            own = np.unique(code[mask == m])
            labels = np.arange(len(own))
            for a, b in GrayTree(own, int(m)).close(distance):
                labels = join_labels(labels, a, b)
            moved = np.flatnonzero(labels != np.arange(len(own)))
            if len(moved):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(own[moved].view(np.int64)), pa.array(own[labels[moved]].view(np.int64))], ["a", "b"])

    parts = partitions_for(level, 60_000)
    return level.repartition(parts, "mask", "pattern").mapInArrow(search, "a long, b long").distinct()


def _grouped(prints: DataFrame, distance: int, split_at: int) -> DataFrame:
    """fp, its smallest doc_id ``first``, and ``code``: the smallest fp of its component."""
    first = prints.groupBy("fp").agg(F.min("doc_id").alias("first"))
    edges = settle(forest(first.select("fp"), distance, split_at), "links")
    code = components(edges).select(F.col("node").alias("fp"), F.col("component").alias("code"))
    return first.join(code, "fp", "left").withColumn("code", F.coalesce("code", "fp"))


def near_duplicates(docs: DataFrame, shingle_words: int = 3, distance: int = 2, split_at: int = SPLIT_AT) -> DataFrame:
    """doc_id, fp, component_id: the smallest doc_id reachable over links of at most ``distance`` bits."""
    prints = settle(fingerprints(docs, shingle_words), "prints")
    grouped = _grouped(prints, distance, split_at)
    least = grouped.groupBy("code").agg(F.min("first").alias("component_id"))
    of = grouped.join(least, "code").select("fp", "component_id")
    return prints.join(of, "fp").select("doc_id", "fp", "component_id")


def one_of_each_group(docs: DataFrame, shingle_words: int = 3, distance: int = 2, split_at: int = SPLIT_AT) -> DataFrame:
    """The rows of ``docs`` that stay when one row of each component is kept.

    Texts move once, to meet the ids that stay. Rows whose doc_id is not unique are fingerprinted
    again next to all their columns, and equal ones are combined before they move.
    """
    prints = settle(fingerprints(docs, shingle_words), "prints")
    order = F.struct(F.col("first").isNull().alias("none"), "first", "fp")
    stays = _grouped(prints, distance, split_at).groupBy("code").agg(F.min(order).alias("o")).select(
        F.col("o.first").alias("_id"), F.col("o.fp").alias("_fp"))
    often = prints.groupBy(F.col("doc_id").alias("_id")).agg((F.count(F.lit(1)) > 1).alias("_often"))
    stays = settle(stays.join(often, stays["_id"].eqNullSafe(often["_id"])).select(stays["_id"], "_fp", "_often"), "stays")
    single = stays.where("NOT _often").select("_id")
    kept = docs.join(single, docs["doc_id"].eqNullSafe(single["_id"]), "left_semi")
    many = stays.where("_often").select("_id").distinct()
    rows = docs.join(many, docs["doc_id"].eqNullSafe(many["_id"]), "left_semi").select(
        "doc_id", "text", F.struct(*[F.col(c) for c in docs.columns]).alias("_row"))

    def make():
        def out(batch):
            for text, row in zip(batch["text"], batch["_row"]):
                yield row, signed(majority_bits(shingle_hashes(words(text), shingle_words)))
        return out

    printed = map_rows(texts(rows, "_row"), schema_of(rows, "_row", _fp=T.LongType()), make)
    printed = printed.groupBy(F.col("_row.doc_id").alias("_doc"), F.col("_fp").alias("_print")).agg(
        F.min_by("_row", F.struct(*[F.xxhash64(F.lit(i), "_row") for i in range(2)])).alias("_row"))
    printed = printed.join(stays, printed["_doc"].eqNullSafe(stays["_id"]) & (printed["_print"] == stays["_fp"]), "left_semi")
    return kept.unionByName(printed.select("_row.*"))
