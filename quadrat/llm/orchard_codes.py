"""Vector codes by part codebooks, with the nearest entry found by Orchard search.

Method. Components become integers floor(256 x); a vector is cut into ``PARTS``
consecutive parts. Each part position has a codebook, which starts as that part of the
vectors with the smallest vec_ids and is moved ``rounds`` times to the floored means of
the parts that chose it. The nearest entry is found by Orchard's rule: for every entry
all others are listed by their distance to it. A search holds the best entry so far,
walks down that entry's list, marks each entry it visits and jumps to the list of any
that is better (nearer, or as near with a lower index). It stops where the list
is beyond twice the current distance: by the triangle inequality nothing further can be
better. All distances are squared integers, so ties and the stop are exact. The searches of
a batch take their steps together in numpy.

Scale. Each round is one scan; a task sends one row per part, entry and component
that it met, so sums are combined before they move and their number does not grow with
the rows. The driver holds the codebooks only (``PARTS`` x ``ENTRIES`` entries). Summed
errors of equal labels come back by a join whose size Catalyst knows.

Rows. A null vector, or one with a null or non-finite component, is dropped. Vectors are
compared only with others of their length: those whose length differs from that of the first kept vector
are dropped, too. Where the length is no multiple of ``PARTS``, parts differ by one component. A
null vec_id comes last; equal vec_ids are taken in the order of their vectors. Fewer vectors than
``ENTRIES`` give as many entries. Components of any size are exact (values that do not fit in a
long fall back to Python's integers); an error beyond a long is null. Equal rows give equal rows. An
empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from fractions import Fraction
from math import floor

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quadrat.storage import settle

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Integers below this in absolute value keep squared distances of up to 2^12 components in a long.
_SMALL = 1 << 24
_LIMB = 32
_LONG = (1 << 63) - 1


def whole(vectors: list) -> np.ndarray:
    """floor(256 x) of every component; Python's integers where a long could overflow."""
    x = np.array(vectors, np.float64).reshape(len(vectors), -1)
    if not x.size or np.abs(x).max() < _SMALL / SCALE:
        return np.floor(x * SCALE).astype(np.int64)
    return np.array([[floor(Fraction(c) * SCALE) for c in row] for row in x.tolist()], object)


def cuts(length: int) -> list[int]:
    """Where the parts of a vector begin and end."""
    return [length * p // PARTS for p in range(PARTS + 1)]


def squares(diff: np.ndarray) -> np.ndarray:
    return (diff * diff).sum(axis=-1)


class Orchard:
    """One part's codebook with the neighbour list of every entry."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        far = squares(entries[:, None, :] - entries[None, :, :])
        self.list = np.array([sorted(range(len(entries)), key=lambda j: (row[j], j)) for row in far], np.int64).reshape(far.shape)
        self.far = np.take_along_axis(far, self.list, axis=1)

    def nearest(self, parts: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest entry of each part, and the squared distance; ``start`` is where the searches begin."""
        best, count = start.copy(), len(self.entries)
        error = squares(parts - self.entries[best])
        seen = np.zeros((len(parts), count), bool)
        seen[np.arange(len(parts)), best] = True
        at = np.zeros(len(parts), np.int64)
        live = np.arange(len(parts))
        while len(live):
            held, place = best[live], at[live]
            go = place < count
            go[go] = self.far[held[go], place[go]] <= 4 * error[live[go]]
            live, held, place = live[go], held[go], place[go]
            other = self.list[held, place]
            at[live] += 1
            new = ~seen[live, other]
            who, other = live[new], other[new]
            seen[who, other] = True
            found = squares(parts[who] - self.entries[other])
            better = (found < error[who]) | ((found == error[who]) & (other < best[who]))
            who = who[better]
            best[who], error[who], at[who] = other[better], found[better], 0
        return best, error


def assign(vectors: np.ndarray, books: list[Orchard]) -> tuple[np.ndarray, np.ndarray]:
    """Codes (row, part) and summed squared distances. Searches start at the entry with the nearest sum of components."""
    edge = cuts(vectors.shape[1])
    codes = np.zeros((len(vectors), PARTS), np.int64)
    error = np.zeros(len(vectors), vectors.dtype)
    for p, book in enumerate(books):
        own = vectors[:, edge[p]:edge[p + 1]]
        sums = book.entries.sum(axis=1)
        order = np.array(sorted(range(len(sums)), key=lambda i: (sums[i], i)), np.int64)
        near = np.searchsorted(sums[order], own.sum(axis=1))
        codes[:, p], e = book.nearest(own, order[np.minimum(near, len(sums) - 1)])
        error = error + e
    return codes, error


def limbs(value: int) -> list[int]:
    """Digits of a whole number to the base 2^32, the last one with the sign."""
    out = []
    while not -(1 << _LIMB - 1) <= value < 1 << _LIMB - 1:
        out.append(value & ((1 << _LIMB) - 1))
        value >>= _LIMB
    return [*out, value]


def _sums(books: list[Orchard]):
    """A task's sums: a row per part, entry, component and limb; component -1 counts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int, int], int] = {}
        for vectors in _whole_batches(batches):
            codes, _ = assign(vectors[1], books)
            edge = cuts(vectors[1].shape[1])
            for p in range(PARTS):
                own, code = vectors[1][:, edge[p]:edge[p + 1]], codes[:, p]
                order = np.argsort(code, kind="stable")
                entry, at, count = np.unique(code[order], return_index=True, return_counts=True)
                added = np.add.reduceat(own[order], at, axis=0) if own.shape[1] else own[:len(at)]
                for e, c, row in zip(entry.tolist(), count.tolist(), added.tolist()):
                    for j, v in enumerate([c, *row]):
                        total[p, e, j - 1] = total.get((p, e, j - 1), 0) + int(v)
        rows = [(*k, i, v) for k, x in total.items() for i, v in enumerate(limbs(x))]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(
                zip(*rows), (pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64()))], ["part", "entry", "component", "limb", "value"])
    return run


def _whole_batches(batches: Iterator[pa.RecordBatch], rows: int = 4_096) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            part = batch.slice(at, rows)
            yield part, whole(part.column("vector").to_pylist())


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, label and vector of the rows that are compared."""
    found = vectors.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("vector"))
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    found = found.where(F.col("vector").isNotNull() & F.forall("vector", finite))
    first = found.orderBy(F.col("vec_id").asc_nulls_last(), "vector").select(F.size("vector")).head()
    return found.where(F.size("vector") == (first[0] if first else 0))


def codebooks(found: DataFrame, rounds: int = ROUNDS) -> list[Orchard]:
    """The codebooks after ``rounds`` moves; none for an empty table."""
    first = found.orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(ENTRIES).select("vector").collect()
    if not first:
        return []
    start = whole([r.vector for r in first])
    edge = cuts(start.shape[1])
    books = [Orchard(start[:, edge[p]:edge[p + 1]]) for p in range(PARTS)]
    for _ in range(rounds):
        sums = found.select("vector").mapInArrow(_sums(books), "part int, entry int, component int, limb int, value long")
        rows = sums.groupBy("part", "entry", "component", "limb").agg(F.sum("value").alias("value")).collect()
        total: dict[tuple[int, int, int], int] = {}
        for r in rows:
            at = (r.part, r.entry, r.component)
            total[at] = total.get(at, 0) + (r.value << (_LIMB * r.limb))
        moved = []
        for p, book in enumerate(books):
            entries = [[total[p, e, j] // total[p, e, -1] for j in range(book.entries.shape[1])] if (p, e, -1) in total
                       else book.entries[e].tolist() for e in range(len(book.entries))]
            small = all(abs(v) < _SMALL for row in entries for v in row)
            moved.append(Orchard(np.array(entries, np.int64 if small else object).reshape(book.entries.shape)))
        books = moved
    return books


def books_sha256(books: list[Orchard]) -> str:
    """Hash of all entries' components by part, entry and position."""
    return hashlib.sha256(",".join(str(v) for b in books for row in b.entries.tolist() for v in row).encode()).hexdigest()


def encode(vectors: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of every usable row."""
    found = usable(vectors)
    books = codebooks(found, rounds)
    schema = T.StructType([found.schema["vec_id"], found.schema["label"], T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, own in _whole_batches(batches):
            codes, error = assign(own, books)
            text = [bytes(row).hex() for row in codes.astype(np.uint8).tolist()]
            error = [v if v <= _LONG else None for v in error.tolist()]
            yield pa.RecordBatch.from_arrays([part.column("vec_id"), part.column("label"), pa.array(text), pa.array(error, pa.int64())],
                                             ["vec_id", "label", "code", "error"])

    coded = settle(found.mapInArrow(run, schema), "codes")
    summed = settle(coded.groupBy(F.col("label").alias("_label")).agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("_sum")), "labels")
    long = F.when(F.col("_sum") <= F.lit(_LONG).cast("decimal(38,0)"), F.col("_sum").cast("long"))
    return coded.join(summed, F.col("label").eqNullSafe(F.col("_label"))).select(
        "vec_id", "code", "error", long.alias("label_error"), F.lit(books_sha256(books)).alias("codebooks_sha256"))
