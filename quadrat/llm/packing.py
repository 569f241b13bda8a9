"""Best-fit packing of documents into sequences by linear grouping.

Method. Only lengths decide a packing, and there are at most as many as a
sequence has tokens, so the plan is made from the histogram: the longer
lengths are sorted and cut into groups of equal cardinality, each rounded up to
its largest; for these few sizes, configurations (multisets that fit one
sequence) are chosen by filling behind the largest size left as exactly as
possible, each used as often as its sizes last; the documents' own lengths
replace the rounded ones, and short documents go, longest first, where least
room is left. Several numbers of groups are tried and the plan with the fewest
sequences is kept. Spark counts, ranks the pieces of each length and looks
each rank up in the plan, which is a bounded table of runs.

Rows. A null or empty text is a document of one token, the end. Repeated rows
are packed each. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quadrat.llm.bpe import as_text, codec, vocabulary
from quadrat.llm.common import map_rows, schema_of, texts
from quadrat.storage import settle

#: Numbers of groups tried for the longer lengths.
GROUPS = (48, 192, 768)
#: Lengths up to this share of a sequence are the short ones.
SHORT = 1 / 16


def cut(n: int, room: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens; only the first may be shorter than ``room``."""
    if n <= room:
        return [(0, n)]
    first = n % room
    return [(0, first)] * bool(first) + [(s, room) for s in range(first, n, room)]


def pieces(docs: DataFrame, path: str, pattern: str, end_id: int, room: int) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32; (task, place): number of the task, and of the piece among its length there."""
    data = vocabulary(docs.sparkSession, path)
    end = np.array([end_id], "<u4").tobytes()

    def make():
        known, count, task = codec(data.value, pattern)[1], Counter(), TaskContext.get().partitionId()

        def rows(batch):
            for doc, packed in zip(batch["doc_id"], known.encode_all(map(as_text, batch["text"]))):
                packed += end
                for i, (start, n) in enumerate(cut(len(packed) // 4, room)):
                    yield doc, i, start, n, zlib.crc32(packed[4 * start:4 * (start + n)]), task, count[n]
                    count[n] += 1
        return rows
    return map_rows(texts(docs), schema_of(
        docs, "doc_id", piece=T.IntegerType(), start=T.LongType(), length=T.LongType(), ids_crc32=T.LongType(),
        task=T.IntegerType(), place=T.LongType()), make)


# ---- the plan ------------------------------------------------------------------

def grouped(hist: dict[int, int], groups: int) -> list[tuple[int, list[tuple[int, int, int]]]]:
    """Longest first: (rounded length, [(length, first rank, number)]) of groups of equal cardinality."""
    size = max(1, -(-sum(hist.values()) // groups))
    out: list[tuple[int, list]] = []
    room = 0
    for length in sorted(hist, reverse=True):
        at, left = 0, hist[length]
        while left:
            if not room:
                out.append((length, []))
                room = size
            n = min(room, left)
            out[-1][1].append((length, at, n))
            at, left, room = at + n, left - n, room - n
    return out


def fill(room: int, demand: dict[int, int]) -> list[int]:
    """Sizes (within demand) whose sum is the largest that fits, larger ones preferred."""
    sizes = sorted(s for s, d in demand.items() if d and s <= room)
    reach, steps, limit = 1, [1], (1 << (room + 1)) - 1
    for s in sizes:
        for _ in range(min(demand[s], room // s)):
            more = (reach | reach << s) & limit
            if more == reach:
                break
            reach = more
        steps.append(reach)
    at, out = reach.bit_length() - 1, []
    for i in range(len(sizes) - 1, -1, -1):
        s = sizes[i]
        for n in range(min(demand[s], at // s), -1, -1):
            if steps[i] >> (at - n * s) & 1:
                out += [s] * n
                at -= n * s
                break
    return out


def configurations(demand: dict[int, int], room: int) -> list[tuple[int, list[int]]]:
    """(times, sizes): sequences for all of the demand."""
    demand, out = dict(demand), []
    while demand:
        first = max(demand)
        rest = demand | {first: demand[first] - 1}
        uses = Counter([first] + fill(room - first, rest))
        times = min(demand[s] // n for s, n in uses.items())
        out.append((times, sorted(uses.elements(), reverse=True)))
        for s, n in uses.items():
            demand[s] -= times * n
            if not demand[s]:
                del demand[s]
    return out


def plan(hist: dict[int, int], room: int, groups: int) -> tuple[int, list[tuple[int, int, int, int, int]]]:
    """Number of sequences, and runs (length, first rank, number, first sequence, slot).

    Piece ``first rank + i`` of a length is in sequence ``first sequence + i``.
    """
    runs, bins = [], 0
    longer = {x: n for x, n in hist.items() if x > room * SHORT}
    stock: dict[int, list[tuple[int, int, int]]] = defaultdict(list)  # rounded length: runs of own lengths
    for size, own in grouped(longer, groups):
        stock[size] += own
    demand = {s: sum(n for *_, n in own) for s, own in stock.items()}
    open_bins: dict[int, list[tuple[int, int, int]]] = defaultdict(list)  # room: (first sequence, number, slots used)
    rooms: list[int] = []

    def keep(space, first, n, slots):
        if space:
            if not open_bins[space]:
                insort(rooms, space)
            open_bins[space].append((first, n, slots))

    for times, sizes in configurations(demand, room):
        while times:  # own lengths are equal along a run
            n = times
            for s, k in Counter(sizes).items():
                n = min(n, max(1, stock[s][-1][2] // k))
            used = 0
            for slot, s in enumerate(sizes):
                length, first, count = stock[s].pop()
                if count > n:
                    stock[s].append((length, first + n, count - n))
                runs.append((length, first, n, bins, slot))
                used += length
            keep(room - used, bins, n, len(sizes))
            bins += n
            times -= n
    for length in sorted((x for x in hist if x <= room * SHORT), reverse=True):
        rank, left = 0, hist[length]
        while left:
            at = bisect_left(rooms, length)
            if at == len(rooms):
                per = room // length
                n, each = (left // per, per) if left >= per else (1, left)
                for slot in range(each):
                    runs.append((length, rank + slot * n, n, bins, slot))
                keep(room - each * length, bins, n, each)
                bins, rank, left = bins + n, rank + n * each, left - n * each
                continue
            space = rooms[at]
            first, count, slots = open_bins[space].pop()
            if not open_bins[space]:
                rooms.pop(at)
            n = min(left, count)
            if count > n:
                keep(space, first + n, count - n, slots)
            runs.append((length, rank, n, first, slots))
            keep(space - length, first, n, slots + 1)
            rank, left = rank + n, left - n
    return bins, runs


def best_plan(hist: dict[int, int], room: int) -> tuple[int, list[tuple[int, int, int, int, int]]]:
    return min((plan(hist, room, g) for g in GROUPS), key=lambda p: p[0])


def pack(docs: DataFrame, path: str, pattern: str, end_id: int = 2, room: int = 1024) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: every piece in its sequence."""
    spark = docs.sparkSession
    cuts = settle(pieces(docs, path, pattern, end_id, room), "pieces")
    counts = cuts.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    counts = settle(counts.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))), "bases")
    hist = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # room rows at most
    runs = np.array(sorted(best_plan(hist, room)[1]), np.int64).reshape(-1, 5)
    table = spark.sparkContext.broadcast(runs)
    ranked = cuts.join(counts.select("task", "length", "base"), ["task", "length"]).withColumn(
        "rank", F.col("base") + F.col("place"))

    def look_up(batches):
        plan_runs = table.value
        key = plan_runs[:, 0] << 44 | plan_runs[:, 1]
        for batch in batches:
            length = batch.column("length").to_numpy(zero_copy_only=False)
            rank = batch.column("rank").to_numpy(zero_copy_only=False)
            run = plan_runs[np.searchsorted(key, length << 44 | rank, side="right") - 1]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in names], pa.array(run[:, 3] + rank - run[:, 1]), pa.array(run[:, 4])],
                [*names, "sequence_id", "slot"])

    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    schema = T.StructType([cuts.schema[c] for c in names] + [
        T.StructField("sequence_id", T.LongType()), T.StructField("slot", T.LongType())])
    placed = ranked.select(*names, "rank").mapInArrow(look_up, schema)
    inside = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(inside), F.lit(0))).drop("slot")
