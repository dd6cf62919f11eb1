"""Spark helpers shared by the operators: tables, stored steps, filters, components."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logloom.session import ensure_checkpoint_dir


#: Bytes of rows sent to a Python worker at once, unless the session says otherwise.
BATCH = "4m"
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def bound_batches(spark: SparkSession) -> None:
    """Arrow batches of whole texts are bounded by bytes: Spark's default holds tens
    of megabytes a task several times over (writer, reader and results)."""
    if spark.conf.get(_BATCH, None) is None:
        spark.conf.set(_BATCH, BATCH)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str = "step") -> DataFrame:
    """Write ``df`` as Parquet into the shared checkpoint folder and read it back.

    This cuts the lineage: an executor lost later costs no recomputation.
    """
    spark = df.sparkSession
    bound_batches(spark)
    path = f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def map_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str | T.StructType) -> DataFrame:
    """``mapInArrow`` for a function of one batch. Python workers live on from stage
    to stage: what Arrow holds without use goes back when the rows end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield from fn(b)
        pa.default_memory_pool().release_unused()

    return df.mapInArrow(run, schema)


def ragged(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column whose rows take ``counts`` values each."""
    off = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=off[1:])
    return pa.ListArray.from_arrays(pa.array(off), pa.array(values, kind))


class BitFilter:
    """A one-hash Bloom filter of a fixed size over the values of a column.

    It only keeps rows out of a shuffle that a following exact join would drop
    anyway. Its size never grows (``2**log2`` bits), so it may be broadcast;
    when it fills up at scale it lets more rows through and results stay the same.
    """

    def __init__(self, df: DataFrame, column: str, log2: int):
        self.log2 = log2
        spot = self.spot(F.col(column))
        words = (
            df.select(F.shiftright(spot, 6).alias("w"), spot.bitwiseAND(F.lit(63)).cast("int").alias("b"))
            .groupBy("w")
            .agg(F.expr("bit_or(shiftleft(1L, b))").alias("v"))
            .toArrow()
        )
        bits = np.zeros(1 << (log2 - 6), np.int64)
        bits[words["w"].to_numpy()] = words["v"].to_numpy()
        self.shared = df.sparkSession.sparkContext.broadcast(bits)

    def spot(self, column):
        return F.shiftrightunsigned(F.xxhash64(column), 64 - self.log2)

    def holds(self, column: str):
        """Whether the filter lets the column's value through."""
        shared = self.shared

        @F.pandas_udf("boolean")
        def member(spot: pd.Series) -> pd.Series:
            s = spot.to_numpy(np.int64)
            return pd.Series((shared.value[s >> 6] >> (s & 63)) & 1 == 1)

        return member(self.spot(F.col(column)))

    def keep(self, df: DataFrame, column: str) -> DataFrame:
        return df.where(self.holds(column))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of an undirected graph: the smallest node reachable.

    Every round each node takes the smallest label around it, then the label of
    its label; rounds end when nothing changes. Aggregates combine map-side, so
    a node with very many edges is no hot task. Each round's labels are stored.
    """
    both = stored(
        edges.select(F.col(a).alias("x"), F.col(b).alias("y"))
        .unionByName(edges.select(F.col(b).alias("x"), F.col(a).alias("y")))
        .where("x <> y")
        .distinct(),
        "edges",
    )
    labels = stored(both.groupBy("x").agg(F.least(F.col("x"), F.min("y")).alias("c")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("x", "y"), "y").groupBy("x").agg(F.min("c").alias("m"))
        low = labels.join(near, "x").select("x", "c", F.least("c", "m").alias("l"))
        jump = labels.select(F.col("x").alias("l"), F.col("c").alias("j"))
        new = stored(
            low.join(jump, "l", "left").select("x", "c", F.least("l", F.coalesce("j", "l")).alias("n")), "labels"
        )
        if not new.where("c <> n").limit(1).count():
            return new.select(F.col("x").alias("node"), F.col("n").alias("component"))
        labels = new.select("x", F.col("n").alias("c"))
