"""Class-based bigram language model: exchange clustering, class transitions, word emissions.

Method. Words of the learning texts are counted exactly, over all of them. The
most frequent words are symbols of their own; every other word starts from the
symbol of its ending (a hash of its last bytes). Spark counts pairs of
neighbouring symbols; the table has a fixed size. Exchange clustering then moves
one symbol at a time to the class that raises the likelihood of the class
bigrams most, until nothing moves. After that every other learning word, however
rare, makes an exchange step of its own: all its neighbours in all learning
texts are counted, and it goes to the class that fits them best, with all other
words where the first clustering put them. Only words that no learning text has,
which have no neighbours to go by, keep the class of their ending. Transitions
and sums are then counted anew over the final classes of all tokens.
The probability of a token is P(class | class before) * P(word | class), the
transitions smoothed towards the class's own share and the emissions by half a
count for every word of the class and for one unseen word. A text ends with
one end token, which is also what stands before its first word.

Scale. Word counts never meet in one task or the driver: a task cuts what it
reads into buckets of bounded size, whose texts become numbers of their different words.
Those words, with a count and a neighbour list per bucket, are sorted by word,
where a run of rows, one a bucket, is added up and gets its class; a bucket's
classes and documents meet in one task again. To the driver go the symbols (at
most ``HEAD``), the bounded pair tables and sums per class.

Rows. A null text is empty and consists of its end. Repeated rows count each
and score the same. Without learning rows every count is 0. An empty table
gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quadrat.llm.common import map_rows, schema_of, words
from quadrat.storage import settle

#: Words that are symbols of their own; symbols for endings; classes.
HEAD, ENDINGS, CLASSES = 1_024, 192, 64
ENDING_BYTES = 3
#: Bytes of text per bucket.
BUCKET_BYTES = 24_000_000
#: What is packed of a word in a bucket, before and after its class is found; rows that are packed together.
ENTRY = np.dtype([("bucket", "<i8"), ("id", "<i4"), ("n", "<i4"), ("own", "u1")])
CLASSED = np.dtype([("id", "<i4"), ("c", "<i8"), ("cls", "u1")])
PACKED = 200_000
ROUNDS = 8
REMEMBERED = 300_000


def x_log_x(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def exchange(pairs: np.ndarray, classes: int, rounds: int = ROUNDS) -> np.ndarray:
    """Class of every symbol; symbol 0 (the end) keeps class 0 alone."""
    n = len(pairs)
    weight = pairs.sum(0) + pairs.sum(1)
    order = [s for s in np.argsort(-weight, kind="stable") if s]
    of = np.zeros(n, np.int64)
    for i, s in enumerate(order):
        of[s] = 1 + (i if i < classes - 1 else i % (classes - 1))
    pairs = pairs.astype(np.float64)
    member = np.zeros((n, classes))
    member[np.arange(n), of] = 1
    table = member.T @ pairs @ member
    for _ in range(rounds):
        moved = 0
        for s in order:
            if not weight[s]:
                continue
            old, own = of[s], pairs[s, s]
            ahead = np.bincount(of, pairs[s], classes)
            behind = np.bincount(of, pairs[:, s], classes)
            ahead[old] -= own
            behind[old] -= own
            table[old] -= ahead
            table[:, old] -= behind
            table[old, old] -= own
            row, col, diag = table.sum(1), table.sum(0), table.diagonal()
            gain = (x_log_x(table + ahead).sum(1) - x_log_x(table).sum(1)
                    + x_log_x(table + behind[:, None]).sum(0) - x_log_x(table).sum(0)
                    + x_log_x(diag + ahead + behind + own) - x_log_x(diag + ahead) - x_log_x(diag + behind)
                    + x_log_x(diag)
                    - x_log_x(row + ahead.sum() + own) + x_log_x(row)
                    - x_log_x(col + behind.sum() + own) + x_log_x(col))
            gain[0] = -np.inf
            new = int(np.argmax(gain))
            if gain[new] <= gain[old] + 1e-9:
                new = old
            moved += new != old
            of[s] = new
            table[new] += ahead
            table[:, new] += behind
            table[new, new] += own
        if not moved:
            break
    return of


def ending(word: bytes) -> int:
    return zlib.crc32(word[-ENDING_BYTES:]) % ENDINGS


def top_words(docs: DataFrame, learn: Column) -> list[bytes]:
    """The ``HEAD`` most frequent words of the learning texts, by exact counts."""
    def count(batches):
        found = Counter()

        def out():
            every = list(found)
            for at in range(0, len(every), 50_000):
                part = every[at:at + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.binary()), pa.array([found[w] for w in part], pa.int64())],
                                                 ["word", "n"])
            found.clear()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                for text in batch.column(0).slice(at, 256).to_pylist():
                    found.update(words(text))
                if len(found) >= REMEMBERED:
                    yield from out()
        yield from out()

    text = docs.where(learn).select(F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    counts = text.mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("c"))
    return [bytes(r.word) for r in counts.orderBy(F.desc("c"), "word").limit(HEAD).select("word").collect()]  # HEAD rows


def symbol_pairs(docs: DataFrame, learn: Column, head: dict[bytes, int]) -> np.ndarray:
    """Counts of neighbouring symbols over all learning texts."""
    symbols = 1 + HEAD + ENDINGS

    def count(batches):
        class Symbols(dict):
            def __missing__(self, word):
                s = head.get(word)
                s = 1 + HEAD + ending(word) if s is None else s
                if len(self) >= REMEMBERED:
                    self.clear()
                self[word] = s
                return s
        symbol, total = Symbols(), np.zeros(symbols * symbols, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                flat = [0]
                for text in batch.column(0).slice(at, 512).to_pylist():
                    flat += map(symbol.__getitem__, words(text))
                    flat.append(0)
                flat = np.array(flat, np.int64)
                total += np.bincount(flat[:-1] * symbols + flat[1:], minlength=len(total))
        code = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(total[code])], ["code", "n"])

    text = docs.where(learn).select(F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    cells = text.mapInArrow(count, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).toArrow()
    pairs = np.zeros(symbols * symbols, np.int64)
    pairs[cells.column("code").to_numpy()] = cells.column("n").to_numpy()
    return pairs.reshape(symbols, symbols)


def read_buckets(docs: DataFrame, learn: Column, start: dict[bytes, int], by_ending: list[int]) -> DataFrame:
    """Of every bucket its different words (word, entry) and its texts as numbers of them (doc_id, learn, ids).

    An entry packs ``ENTRY`` and then, for every learning occurrence, the starting classes before and after it, a byte
    each; none for words in ``start``. Ids are written plane by plane, as their upper bytes are mostly zero.
    """
    rows = docs.select("doc_id", F.coalesce(learn, F.lit(False)).alias("learn"),
                       F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    schema = T.StructType([
        T.StructField("bucket", T.LongType()), T.StructField("word", T.BinaryType()), T.StructField("entry", T.BinaryType()),
        T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("learn", T.BooleanType()),
        T.StructField("ids", T.BinaryType())])

    def read(batches):
        from pyspark.sql.pandas.types import to_arrow_schema
        out = to_arrow_schema(schema)

        def batch_of(size, **columns):
            return pa.RecordBatch.from_arrays(
                [pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(size, f.type) for f in out], schema=out)

        def close(bucket, number, ids, learns, names):
            every = list(number)
            own = np.array([start.get(w, -1) for w in every] + [0], np.int64)
            chosen = own < 0  # their class is looked for
            for i in np.flatnonzero(chosen):
                own[i] = by_ending[ending(every[i])]
            end = np.array([len(every)], np.int32)
            flat = np.concatenate([end] + [x for i, learn in zip(ids, learns) if learn for x in (i, end)])
            classes = own.astype(np.uint8)[flat]
            n = np.bincount(flat, minlength=len(own))[:-1]
            at_words = np.flatnonzero(chosen[flat])
            order = at_words[np.argsort(flat[at_words], kind="stable")]
            near = np.stack([classes[order - 1], classes[order + 1]], axis=1)
            seen = np.where(chosen[:-1], n, 0)
            upto = np.concatenate([[0], np.cumsum(seen)])
            for at in range(0, len(every), 50_000):
                to = min(at + 50_000, len(every))
                head = np.zeros(to - at, ENTRY)
                head["bucket"], head["id"], head["n"], head["own"] = bucket, np.arange(at, to), n[at:to], own[at:to]
                begin = np.arange(to - at) * ENTRY.itemsize + 2 * (upto[at:to] - upto[at])
                packed = np.empty((to - at) * ENTRY.itemsize + 2 * (upto[to] - upto[at]), np.uint8)
                place = (begin[:, None] + np.arange(ENTRY.itemsize)).ravel()
                rest = np.ones(len(packed), bool)
                rest[place] = False
                packed[place], packed[rest] = head.view(np.uint8), near[upto[at]:upto[to]].ravel()
                entry = pa.Array.from_buffers(pa.binary(), to - at, [
                    None, pa.py_buffer(np.append(begin, len(packed)).astype(np.int32)), pa.py_buffer(packed)])
                yield batch_of(to - at, bucket=np.full(to - at, bucket), word=every[at:to], entry=entry)
            for at in range(0, len(ids), 512):
                part = [planes(i) for i in ids[at:at + 512]]
                yield batch_of(len(part), bucket=np.full(len(part), bucket), doc_id=names[at:at + 512],
                               learn=learns[at:at + 512], ids=part)

        bucket, size, number, ids, learns, names = TaskContext.get().partitionId() << 20, 0, defaultdict(count().__next__), [], [], []
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                for doc, learn, text in zip(*batch.slice(at, 256).to_pydict().values()):
                    ids.append(np.fromiter(map(number.__getitem__, words(text)), np.int32))
                    learns.append(learn)
                    names.append(doc)
                    size += len(text)
                if size >= BUCKET_BYTES:
                    yield from close(bucket, number, ids, learns, names)
                    bucket, size, number, ids, learns, names = bucket + 1, 0, defaultdict(count().__next__), [], [], []
        if ids:
            yield from close(bucket, number, ids, learns, names)

    return rows.mapInArrow(read, schema)


def planes(ids: np.ndarray) -> bytes:
    """All lowest bytes, then all next ones, and so on."""
    return ids.view(np.uint8).reshape(-1, 4).T.tobytes()


def from_planes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view(np.int32).ravel()


def best_classes(before: np.ndarray, after: np.ndarray, own: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The class each word fits best, from how often each class stands before and after it.

    One exchange step of all words at once: likelihood of the class bigrams with all other words where they are;
    in its own class a word's occurrences are taken out of the table first.
    """
    share = (table.sum(0) + 0.5) / (table.sum() + 0.5 * len(table))
    cells, size = table + share, table.sum(0) + 1
    into, out = np.log(cells) - np.log(size), np.log(cells) - np.log(size)[:, None]
    gain = before @ into + after @ out.T
    c = before.sum(1)
    left = np.maximum(size[own] - c, 1)
    gain[np.arange(len(own)), own] = (
        (before * np.log(np.maximum(cells[:, own].T - before, share[own][:, None]))).sum(1)
        + (after * np.log(np.maximum(cells[own] - after, share))).sum(1) - 2 * c * np.log(left))
    gain[:, 0] = -np.inf
    best = np.argmax(gain, axis=1)
    return np.where((c > 0) & (gain[np.arange(len(own)), best] > gain[np.arange(len(own)), own] + 1e-9), best, own)


def classed_words(read: DataFrame, parts: int, table: np.ndarray) -> DataFrame:
    """bucket, classed (packed ``CLASSED``: number, count in all learning texts and class) of every bucket, in many rows;
    and cls, n, v: learning tokens and different words of classes, in rows without a bucket that add up.
    """
    classes = len(table)

    def assign(batches):
        held = None  # the word that may go on in the next batch: its rows, count and contexts
        waiting, size = [], 0
        sums = np.zeros((2, classes), np.int64)

        def done(head, run, c, before, after):
            first = np.diff(run, prepend=-1) > 0
            cls = best_classes(before, after, head["own"][first].astype(np.int64), table)
            sums[0] += np.bincount(cls, c, classes).astype(np.int64)
            sums[1] += np.bincount(cls[c > 0], minlength=classes)
            found = np.zeros(len(run), CLASSED)
            found["id"], found["c"], found["cls"] = head["id"], c[run], cls[run]
            waiting.append((head["bucket"], found))

        def packed():
            bucket, found = (np.concatenate(x) for x in zip(*waiting))
            waiting.clear()
            order = np.argsort(bucket, kind="stable")
            bucket, found = bucket[order], found[order]
            begin = np.flatnonzero(np.diff(bucket, prepend=-1))
            data = [part.tobytes() for part in np.split(found, begin[1:])]
            none = pa.nulls(len(begin), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(bucket[begin]), pa.array(data, pa.binary()), none, none, none],
                                              ["bucket", "classed", "cls", "n", "v"])

        def last_word():
            head, c, before, after = held[1:]
            done(head, np.zeros(len(head), np.int64), np.array([c]), before[None], after[None])
        for batch in batches:
            if not batch.num_rows:
                continue
            word, rows = batch.column("word"), batch.num_rows
            entries = batch.column("entry").to_pylist()
            head = np.frombuffer(b"".join([e[:ENTRY.itemsize] for e in entries]), ENTRY)
            near = np.frombuffer(b"".join([e[ENTRY.itemsize:] for e in entries]), np.uint8).reshape(-1, 2)
            new = np.ones(rows, bool)
            new[1:] = pc.not_equal(word.slice(1), word.slice(0, rows - 1)).to_numpy(zero_copy_only=False)
            run = np.cumsum(new) - 1
            runs = run[-1] + 1
            of = np.repeat(run, [(len(e) - ENTRY.itemsize) // 2 for e in entries]) * classes
            before, after = (np.bincount(of + near[:, k], minlength=runs * classes).reshape(runs, classes).astype(float)
                             for k in (0, 1))
            c = np.bincount(run, head["n"], runs).astype(np.int64)
            if held is not None and held[0] == word[0].as_py():
                head = np.concatenate([held[1], head])
                run = np.concatenate([np.zeros(len(held[1]), run.dtype), run])
                c[0] += held[2]
                before[0] += held[3]
                after[0] += held[4]
            elif held is not None:
                last_word()
            last = np.searchsorted(run, runs - 1)
            held = word[-1].as_py(), head[last:], c[-1], before[-1], after[-1]
            if last:
                done(head[:last], run[:last], c[:-1], before[:-1], after[:-1])
            size += rows
            if size >= PACKED and waiting:
                yield packed()
                size = 0
        if held is not None:
            last_word()
            yield packed()
            none = pa.nulls(classes)
            yield pa.RecordBatch.from_arrays([none.cast(pa.int64()), none.cast(pa.binary()), pa.array(np.arange(classes)),
                                              *map(pa.array, sums)], ["bucket", "classed", "cls", "n", "v"])

    every = read.where("word is not null").select("word", "entry")
    return every.repartition(parts, "word").sortWithinPartitions("word").mapInArrow(
        assign, "bucket long, classed binary, cls long, n long, v long")


def class_paths(read: DataFrame, classed: DataFrame, parts: int, base: float, log_spread: np.ndarray) -> DataFrame:
    """doc_id, learn, n, n_known, base, emit, path of every text, its end left out; path has the classes, a byte each."""
    nothing = F.lit(None)
    joint = classed.where("bucket is not null").select(
        "bucket", "classed", nothing.cast(read.schema["doc_id"].dataType).alias("doc_id"),
        nothing.cast("boolean").alias("learn"), nothing.cast("binary").alias("ids")).unionByName(
        read.where("ids is not null").select("bucket", nothing.cast("binary").alias("classed"), "doc_id", "learn", "ids"))
    schema = schema_of(read, "doc_id", learn=T.BooleanType(), n=T.LongType(), n_known=T.LongType(), base=T.DoubleType(),
                       emit=T.DoubleType(), path=T.BinaryType())

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema
        out = to_arrow_schema(schema)
        bucket, found, c, cls, log_c, emit = None, [], None, None, None, None
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                made = []
                for b, packed, doc, learn, ids in zip(*batch.slice(at, 512).to_pydict().values()):
                    if b != bucket:
                        bucket, found, c = b, [], None
                    if packed is not None:
                        found.append(packed)
                        continue
                    if c is None:  # a bucket's words come before its texts
                        own = np.frombuffer(b"".join(found), CLASSED)
                        own = own[np.argsort(own["id"])]
                        c, cls, found = own["c"], own["cls"], []
                        log_c = np.log10(c + 0.5)
                        emit = log_c - log_spread[cls]
                    i = from_planes(ids)
                    made.append((doc, learn, len(i), int((c[i] > 0).sum()), float(log_c[i].sum() - base * len(i)),
                                 float(emit[i].sum()), cls[i].tobytes()))
                if made:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*made), out)], schema=out)

    return joint.repartition(parts, "bucket").sortWithinPartitions("bucket", F.col("classed").isNull()).mapInArrow(run, schema)


def class_pairs(paths: DataFrame) -> np.ndarray:
    """Counts of neighbouring classes over the learning texts."""
    def count(batches):
        total = np.zeros(CLASSES * CLASSES, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                flat = np.frombuffer(b"\0" + b"\0".join([*batch.column(0).slice(at, 512).to_pylist(), b""]), np.uint8)
                flat = flat.astype(np.int64)
                total += np.bincount(flat[:-1] * CLASSES + flat[1:], minlength=len(total))
        code = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(total[code])], ["code", "n"])

    cells = paths.where("learn").select("path").mapInArrow(count, "code long, n long").groupBy("code").agg(
        F.sum("n").alias("n")).toArrow()  # CLASSES * CLASSES rows
    pairs = np.zeros(CLASSES * CLASSES, np.int64)
    pairs[cells.column("code").to_numpy()] = cells.column("n").to_numpy()
    return pairs.reshape(CLASSES, CLASSES)


def score(docs: DataFrame, learn: Column) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every text.

    ``learn`` is the condition for learning rows.
    """
    ends = docs.where(learn).count()
    head = {w: i + 1 for i, w in enumerate(top_words(docs, learn))}
    pairs = symbol_pairs(docs, learn, head)
    of = exchange(pairs, CLASSES)
    member = np.zeros((len(of), CLASSES))
    member[np.arange(len(of)), of] = 1

    start = {w: int(of[i]) for w, i in head.items()}
    read = settle(read_buckets(docs, learn, start, of[1 + HEAD:].tolist()), "read")
    least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(least, 3 * read.select("bucket").distinct().count())  # few buckets share a task
    classed = settle(classed_words(read, parts, member.T @ pairs @ member), "words")
    sums = {r.cls: (r.n, r.v) for r in classed.where("cls is not null").groupBy("cls").agg(
        F.sum("n").alias("n"), F.sum("v").alias("v")).collect()}  # CLASSES rows
    tokens, types = sum(n for n, _ in sums.values()) + ends, sum(v for _, v in sums.values()) + (ends > 0)
    sums[0] = (ends, 1)
    log_spread = np.log10([sums.get(c, (0, 0))[0] + 0.5 * (sums.get(c, (0, 0))[1] + 1) for c in range(CLASSES)])
    base = float(np.log10(tokens + 0.5 * (types + 1)))
    end_base, end_score = float(np.log10(ends + 0.5)) - base, float(np.log10(ends + 0.5) - log_spread[0])

    paths = settle(class_paths(read, classed, parts, base, log_spread), "paths")
    table = class_pairs(paths)
    share = (table.sum(0) + 0.5) / (table.sum() + 0.5 * CLASSES)
    step = np.log10((table + share) / (table.sum(1, keepdims=True) + 1))
    schema = schema_of(docs, "doc_id", held_out=T.BooleanType(), n_tokens=T.LongType(), n_known=T.LongType(),
                       train_tokens=T.LongType(), base_score=T.DoubleType(), score=T.DoubleType())

    def make():
        def total(batch):
            for doc, learns, n, known, by_base, emit, path in zip(*batch.values()):
                path = np.frombuffer(b"\0" + path + b"\0", np.uint8)
                yield (doc, not learns, n + 1, known + (ends > 0), tokens, by_base + end_base,
                       emit + end_score + float(step[path[:-1], path[1:]].sum()))
        return total
    return map_rows(paths, schema, make)
