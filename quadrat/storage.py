"""Where intermediate tables live, and how a long plan is cut.

Iterative operators (clustering, ordination, dereplication) write their state
as a Parquet table in the folder the cluster names in ``spark.checkpoint.dir``.
A written table survives the loss of executors, ends the lineage, and carries
its true size, so Catalyst can decide on a broadcast from a checked number.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"


def scratch_root(spark: SparkSession) -> str:
    """The shared scratch folder of this session."""
    root = spark.conf.get(_SETTING, None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {_SETTING} to a folder that all executors can reach")
    root = tempfile.mkdtemp(prefix="quadrat-")
    atexit.register(shutil.rmtree, root, ignore_errors=True)  # only what was made here
    spark.conf.set(_SETTING, root)
    return root


def scratch_path(spark: SparkSession, label: str) -> str:
    """A path under the scratch folder that nothing else uses."""
    return f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"


def settle(df: DataFrame, label: str = "table") -> DataFrame:
    """Write ``df`` once and return a frame that reads the written table."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
