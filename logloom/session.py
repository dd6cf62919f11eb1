"""Session helpers.

Library code never creates its own session; it takes the caller's. These
helpers exist for tests, bench.py and command-line use.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark import StorageLevel
from pyspark.errors import AnalysisException
from pyspark.sql import SparkSession


# Iterative jobs build long plans; their explain text (for listeners and the
# event log) is display only and is capped so that it cannot exhaust the heap.
PLAN_STRING_CAP = 1 << 20
_PLAN_STRING = "spark.sql.maxPlanStringLength"


def cap_plan_strings(spark: SparkSession) -> None:
    """Cap plan text length when the session still has Spark's unlimited default."""
    current = spark.conf.get(_PLAN_STRING, None)
    try:
        unlimited = current is None or int(str(current).rstrip("bB")) > PLAN_STRING_CAP * 64
    except ValueError:
        unlimited = False
    if unlimited:
        spark.conf.set(_PLAN_STRING, str(PLAN_STRING_CAP))


def local_session(cores: int = 8, shuffle_partitions: int | None = None,
                  app: str = "logloom") -> SparkSession:
    """A local session with the settings the library assumes (AQE on, UTC, no UI)."""
    parts = shuffle_partitions or cores
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.autoBroadcastJoinThreshold", str(32 * 1024 * 1024))
        .config("spark.sql.maxPlanStringLength", str(PLAN_STRING_CAP))
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder, setting a scratch one only when unset.

    On a cluster the operator names a shared folder in ``spark.checkpoint.dir``;
    we read it from the session and never override it. Only when nothing is set
    on a local master (tests) do we create a fresh scratch folder.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    if conf_dir:
        sc.setCheckpointDir(conf_dir)
        return sc.getCheckpointDir() or conf_dir
    if sc.master != "local" and not sc.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    scratch = tempfile.mkdtemp(prefix="logloom-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(scratch)
    return sc.getCheckpointDir() or scratch


_CONSTRAINTS = "spark.sql.constraintPropagation.enabled"


def cut_lineage(df, eager: bool = True):
    """Reliable checkpoint into the shared checkpoint folder (never localCheckpoint).

    Constraint propagation is paused for the call: checkpointing a union of
    already-checkpointed frames otherwise fails while Spark rewrites the
    union's constraints for the new plan root.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    prev = spark.conf.get(_CONSTRAINTS, "true")
    spark.conf.set(_CONSTRAINTS, "false")
    try:
        # computed once: the checkpoint write reads the persisted blocks
        df.persist(StorageLevel.MEMORY_AND_DISK)
        out = df.checkpoint(eager=eager)
        if eager:
            df.unpersist()
        return out
    finally:
        spark.conf.set(_CONSTRAINTS, prev)


def written(df, name: str = "step"):
    """Write ``df`` as Parquet under the checkpoint folder and read it back.

    Like :func:`cut_lineage`, but later reads take only the columns they use,
    and nothing is held in the executors' memory meanwhile.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def read_if_any(spark: SparkSession, path: str, schema):
    """The Parquet table at ``path``, or an empty one when nothing was written there."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def materialize(df):
    """Persist and compute once; for intermediates used several times within
    one step of an iterative job (state carried across steps uses
    :func:`cut_lineage`)."""
    out = df.persist(StorageLevel.MEMORY_AND_DISK)
    out.count()
    return out


class Stepper:
    """Materialise the state of an iterative job.

    Every step is persisted (so the next step reads it instead of recomputing
    the chain); every ``every``-th step is a reliable checkpoint into the
    shared checkpoint folder, which bounds both lineage depth and the work an
    executor loss can cost. The previous persisted step is released.
    """

    def __init__(self, every: int = 4):
        self.every = every
        self.n = 0
        self.prev = None
        self.rows = None

    def step(self, df):
        """Materialise ``df``; ``self.rows`` holds its row count afterwards."""
        self.n += 1
        if self.n % self.every == 0:
            out = cut_lineage(df)
            self.rows = out.count()
        else:
            out = df.persist(StorageLevel.MEMORY_AND_DISK)
            self.rows = out.count()
        if self.prev is not None and self.prev is not out:
            self.prev.unpersist()
        self.prev = out
        return out
