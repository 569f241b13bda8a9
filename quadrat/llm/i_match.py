"""I-Match document fingerprints over randomised lexicon subsets.

Method. The lexicon is every term whose document frequency lies within a
band of shares of all documents, that is, whose inverse document frequency is
neither small nor large. It is thinned to random subsets at several rates: a
term is in subset i of a rate if its hash, keyed by rate and i, is under the
rate. A text is its set of lexicon terms; for every subset the hashes of the terms
in it are summed and cut to 32 bits; no term at all gives the empty code. The same
codes of all its terms, in the lexicon or not, follow. The
fingerprint is the concatenation. Small changes leave the subsets they do not
touch as they are, and the sparse rates serve long texts, the dense ones short.

Likeness of two fingerprints: per rate, the share of subsets with equal codes
among those where either is not empty; the best rate with enough such subsets
counts. Where one of the two texts has no lexicon term (texts of common or very
rare words, copies that make up more of the documents than the upper share), the
codes of all terms are compared. Texts without a word have the hash of their text
instead and are alike only if equal.

Scale. A document has a bounded number of terms on average, so at most
(mean terms) / (lower share) terms are that frequent: the lexicon stays below
that however many documents there are. Tasks get eight bytes a term. Terms are
counted with pre-aggregation in tasks.

Rows. A null text is empty. Equal texts have equal fingerprints. Repeated
rows have one each. A null doc_id has no place in the order: such rows have a
fingerprint, and nulls for the edited text and both likenesses. An empty table
gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quadrat.llm.common import map_rows, schema_of, texts, words
from quadrat.storage import settle

#: Shares of documents between which a term's document frequency must lie.
LOW, HIGH = 0.0005, 0.1
#: Sampling rates of the lexicon, and subsets per rate.
RATES = (1 / 2, 1 / 8, 1 / 32, 1 / 128, 1 / 512, 1 / 2048)
SUBSETS = 16
#: Subsets that must not be empty for a rate to count.
ENOUGH = 4
EMPTY = "-" * 8
_COUNTED_AT_ONCE = 400_000
#: Terms whose membership a task remembers.
_REMEMBERED = 200_000


def document_frequencies(docs: DataFrame) -> DataFrame:
    """term, n_docs over all documents."""
    def count(batches):
        found: Counter = Counter()

        def give():
            keys = list(found)
            for at in range(0, len(keys), 50_000):
                part = keys[at:at + 50_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(part, pa.binary()), pa.array([found[k] for k in part], pa.int64())], ["term", "n"])
            found.clear()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                for text in batch.column(0).slice(at, 256).to_pylist():
                    found.update(set(words(text)))
            if len(found) > _COUNTED_AT_ONCE:
                yield from give()
        yield from give()
    return texts(docs).select("text").mapInArrow(count, "term binary, n long").groupBy("term").agg(
        F.sum("n").alias("n_docs"))


def lexicon(docs: DataFrame, low: float = LOW, high: float = HIGH) -> list[bytes]:
    """Terms within the band; at least two documents must have a term."""
    total = docs.count()
    counts = settle(document_frequencies(docs).where(F.col("n_docs") >= max(2, int(low * total))), "terms")
    band = counts.where((F.col("n_docs") >= max(2, low * total)) & (F.col("n_docs") <= max(2, high * total)))
    return [bytes(r.term) for r in band.select("term").orderBy("term").toLocalIterator()]


class Fingerprinter:
    def __init__(self, lexicon: np.ndarray):
        self.lexicon = lexicon  # ascending hashes of its terms
        self.salt = np.array([zlib.crc32(f"subset {i}".encode()) for i in range(len(RATES) * SUBSETS)], np.uint64) << np.uint64(20)
        self.under = np.repeat(np.array([int(r * (1 << 24)) for r in RATES], np.uint64), SUBSETS)
        self.forget(_REMEMBERED)

    def forget(self, room: int) -> None:
        self.number: dict[bytes, int] = {}
        self.code, self.known = np.empty(room, np.uint64), np.empty(room, bool)
        self.packed = np.empty((room, len(self.salt) // 8), np.uint8)  # membership in every subset, one bit each

    def learn(self, terms: list[bytes]) -> None:
        for at in range(0, len(terms), 4_096):
            part = terms[at:at + 4_096]
            n = len(self.number)
            rows = slice(n, n + len(part))
            self.number.update(zip(part, range(n, n + len(part))))
            code = np.fromiter(map(xxhash.xxh64_intdigest, part), np.uint64, len(part))
            x = (code[:, None] ^ self.salt) * np.uint64(0xBF58476D1CE4E5B9)
            x ^= x >> np.uint64(31)
            x *= np.uint64(0x94D049BB133111EB)
            self.packed[rows] = np.packbits((x >> np.uint64(40)) < self.under, axis=1)
            self.code[rows] = code
            place = np.searchsorted(self.lexicon, code)
            self.known[rows] = self.lexicon[np.minimum(place, len(self.lexicon) - 1)] == code if len(self.lexicon) else False

    def of(self, text: bytes) -> str:
        terms = set(words(text))
        if not terms:
            return hashlib.md5(text).hexdigest()[:8]
        new = [t for t in terms if t not in self.number]
        if len(self.number) + len(new) > len(self.code):
            self.forget(max(_REMEMBERED, len(terms)))
            new = list(terms)
        self.learn(new)
        found = np.fromiter(map(self.number.__getitem__, terms), np.int64, len(terms))
        known = self.known[found]
        return self.codes(found[known]) + self.codes(found)

    def codes(self, found: np.ndarray) -> str:
        total, some = np.zeros(len(self.salt), np.uint64), np.zeros(len(self.salt), bool)
        for at in range(0, len(found), 4_096):
            part = found[at:at + 4_096]
            bits = np.unpackbits(self.packed[part], axis=1)
            total += self.code[part] @ bits.astype(np.uint64)
            some |= bits.any(0)
        text = np.frombuffer((total >> np.uint64(32)).astype(">u4").tobytes().hex().encode(), np.uint8).reshape(-1, 8)
        return np.where(some[:, None], text, np.uint8(ord("-"))).tobytes().decode()


def likeness(a: str, b: str) -> float:
    """0 to 1; 1 for equal fingerprints."""
    if a == b:
        return 1.0
    if len(a) != len(b) or len(a) == 8:
        return 0.0
    best = 0.0
    width, half = 8 * SUBSETS, len(a) // 2
    none = EMPTY * (len(RATES) * SUBSETS)
    first = half if none in (a[:half], b[:half]) else 0
    for at in range(first, first + half, width):
        pairs = [(x, y) for i in range(at, at + width, 8) if (x := a[i:i + 8]) != EMPTY or b[i:i + 8] != EMPTY
                 for y in [b[i:i + 8]]]
        if len(pairs) >= ENOUGH:
            best = max(best, sum(x == y for x, y in pairs) / len(pairs))
    return best


@lru_cache(maxsize=1)
def _fingerprinter(codes: bytes) -> Fingerprinter:
    return Fingerprinter(np.frombuffer(codes, np.uint64))


def send(docs: DataFrame, terms: list[bytes]):
    """The lexicon (bounded, see above) for all tasks, as ascending hashes."""
    codes = np.sort(np.fromiter(map(xxhash.xxh64_intdigest, terms), np.uint64, len(terms)))
    return docs.sparkSession.sparkContext.broadcast(codes.tobytes())


def fingerprints(docs: DataFrame, terms: list[bytes]) -> DataFrame:
    """doc_id, fingerprint."""
    sent = send(docs, terms)

    def make():
        prints = _fingerprinter(sent.value)
        return lambda batch: ((d, prints.of(t)) for d, t in zip(batch["doc_id"], batch["text"]))
    return map_rows(texts(docs), schema_of(docs, "doc_id", fingerprint=T.StringType()), make)


def with_next(docs: DataFrame, rows_per_range: int = 20_000) -> DataFrame:
    """doc_id, text, range, lent: documents dealt to ranges of ascending doc_id (a number).

    The first document of each range is lent to the range before (of the first, to the last),
    so that every document meets the one that follows it. Ranges have about equal numbers of rows.
    """
    docs = docs.where("doc_id IS NOT NULL")
    pieces = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-docs.count() // rows_per_range))
    cuts = docs.agg(F.percentile_approx("doc_id", [i / pieces for i in range(pieces)], 20 * pieces)).first()[0]
    inner = sorted({float(c) for c in cuts or []})
    rows = texts(docs).withColumn("_at", F.col("doc_id").cast("double"))
    if not inner:
        return rows.drop("_at").withColumns({"range": F.lit(0), "lent": F.lit(False)})
    ranges = Bucketizer(splits=[-math.inf, *inner, math.inf], inputCol="_at", outputCol="range")
    rows = ranges.transform(rows).withColumn("range", F.col("range").cast("int")).drop("_at")
    firsts = sorted(tuple(r) for r in rows.groupBy("range").agg(F.min("doc_id").alias("first")).select(
        "first", "range").collect())  # one per range
    before = {first: firsts[i - 1][1] for i, (first, _) in enumerate(firsts)}
    lend = F.create_map(*[x for k, v in before.items() for x in (F.lit(k), F.lit(v))])
    # of several documents with the first id, the first by text is lent
    lent = rows.where(F.col("doc_id").isin(list(before))).groupBy("doc_id").agg(F.min("text").alias("text"))
    lent = lent.select("doc_id", "text", F.element_at(lend, F.col("doc_id")).alias("range"), F.lit(True).alias("lent"))
    return rows.withColumn("lent", F.lit(False)).unionByName(lent)


def edited_pairs(docs: DataFrame, terms: list[bytes], share: int = 4) -> DataFrame:
    """Fingerprints of every document, of its edited text, and their likenesses.

    The edited text has its last floor(n / share) code points replaced by as many first ones of
    the next document. Rows with a null doc_id have no place in the order and no edited text;
    documents of one doc_id follow each other in the order of their texts.
    """
    sent = send(docs, terms)
    schema = schema_of(docs, "doc_id", n_chars=T.LongType(), edited_sha256=T.StringType(), fingerprint=T.StringType(),
                       edited_fingerprint=T.StringType(), near_edited=T.DoubleType(), near_next=T.DoubleType())

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema
        out, prints = to_arrow_schema(schema), _fingerprinter(sent.value)
        made, last = [], None  # last: range, doc_id, text, fingerprint
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                for doc, data, part_of, lent in zip(*[part.column(i).to_pylist() for i in range(4)]):
                    own = prints.of(data)
                    text = data.decode("utf-8", "replace")
                    if last and last[0] == part_of:
                        before, n = last[2], len(last[2])
                        cut = n // share
                        new = (before[:n - cut] + text[:cut]).encode()
                        code = prints.of(new)
                        made.append((last[1], n, hashlib.sha256(new).hexdigest(), last[3], code,
                                     likeness(last[3], code), likeness(last[3], own)))
                    last = (part_of, doc, text, own)
                if made:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*made), out)], schema=out)
                    made = []

    dealt = with_next(docs)
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-docs.count() // 20_000))
    placed = dealt.select("doc_id", "text", "range", "lent").repartition(parts, "range").sortWithinPartitions(
        "range", "lent", "doc_id", "text").mapInArrow(run, schema)

    def make():
        prints = _fingerprinter(sent.value)
        return lambda batch: ((d, len(t.decode("utf-8", "replace")), None, prints.of(t), None, None, None)
                              for d, t in zip(batch["doc_id"], batch["text"]))
    return placed.unionByName(map_rows(texts(docs.where("doc_id IS NULL")), schema, make))
