"""Helpers shared by the text operators: rows in Arrow batches, ids, graph components."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quadrat.storage import settle

#: A-Z to a-z, every other byte as it is.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))

#: What separates words: space, tab, line feed, vertical tab, form feed, carriage return.
#: ``bytes.split()`` splits at exactly these.
SPACE_CLASS = r"[\x20\x09-\x0D]"


def words(text: bytes) -> list[bytes]:
    """Words of a lower-cased (A-Z) text."""
    return text.translate(LOWER).split()


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id and the text as bytes (null: empty), and the named further columns."""
    return docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"), *more)


def schema_of(docs: DataFrame, *columns: str, **new: T.DataType) -> T.StructType:
    """The named columns of ``docs`` followed by new ones."""
    kept = [T.StructField(c, docs.schema[c].dataType) for c in columns]
    return T.StructType(kept + [T.StructField(k, v) for k, v in new.items()])


def map_rows(df: DataFrame, schema: T.StructType,
             make: Callable[[], Callable[[dict[str, list]], Iterable[tuple]]], rows: int = 512) -> DataFrame:
    """Run ``make()`` once per task; it maps the columns of a slice of a batch to output rows.

    Batches are cut to ``rows`` rows, so what Python holds at once stays small.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    out = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                got = list(fn({n: c.to_pylist() for n, c in zip(part.schema.names, part.columns)}))
                if got:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t.type) for c, t in zip(zip(*got), out)], schema=out)

    return df.mapInArrow(run, schema)


def partitions_for(df: DataFrame, rows: int, least: int | None = None) -> int:
    """Partitions so that each holds about ``rows`` rows of a written table."""
    spark = df.sparkSession
    least = int(spark.conf.get("spark.sql.shuffle.partitions")) if least is None else least
    return max(least, -(-df.count() // rows))


def join_labels(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Union of the sets that hold a[i] and b[i]; labels[i] is the smallest index of i's set."""
    while True:
        x, y = labels[a], labels[b]
        apart = x != y
        if not apart.any():
            return labels
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(labels, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = labels[labels]
            if np.array_equal(up, labels):
                break
            labels = up


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of an edge table: node, component (the smallest node reachable).

    Alternating large-star and small-star contraction: every round is two
    aggregations to minima with map-side combine and two equi-joins, rounds
    grow with the logarithm of the longest chain, and the edge table never
    grows. State is written each round, so a lost executor costs one round.
    Nodes without an edge are not returned; nulls and loops are ignored.
    """
    edges = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    edges = settle(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    seen = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = settle(large.distinct(), "large")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            low.select("u", F.col("m").alias("v")))
        edges = settle(small.distinct(), "small")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return roots.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
