"""Structured Streaming parse (ST1) and first-seen key state (ST2).

ST2 keeps every ``(system, masked)`` key in ``applyInPandasWithState`` state and
emits it in the batch in which it first appears, with that batch's earliest
message — the streaming form of the reference's matching table.

ST1 parses a stream of log messages with ``foreachBatch``: each micro-batch
is reduced to distinct masked keys, resolved against the catalog of the batches
before it (exact key, literal rule, wildcard walk, similar template, then
labelling of what is left), and its rows are written with their template ids
under ``<output>/parsed/batch_id=<id>``. What a batch adds to the state — its
catalog, new entries of the matching table, new slot values — goes to folders
of its own, and last a row to ``<output>/commits``. A batch begins from the
state of the commits before it, on a restart too; a replayed batch that was
committed does nothing, and one that was not overwrites what it left behind. No
event-time semantics are involved: the reference has none.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ..functions.text import correct_message, mask_message
from ..operators.labelling import truth_labeller
from ..operators.matching import resolve_templates
from ..plans.catalog_parse import CatalogState, distinct_keys, generalised, resolve_keys
from ..session import read_if_any, written

FIRST_SEEN_OUT = StructType([
    StructField("system", StringType()), StructField("masked", StringType()),
    StructField("seq", LongType()), StructField("msg", StringType())])
FIRST_SEEN_STATE = StructType([StructField("seq", LongType()), StructField("msg", StringType())])


def _first_seen(key, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Emit the key once, with its earliest message; remember it in state."""
    best = None
    for pdf in pdfs:
        i = pdf["seq"].idxmin()
        row = (int(pdf.at[i, "seq"]), pdf.at[i, "msg"])
        if best is None or row[0] < best[0]:
            best = row
    if state.exists:
        return
    if best is not None:
        state.update(best)
        yield pd.DataFrame({"system": [key[0]], "masked": [key[1]], "seq": [best[0]], "msg": [best[1]]})


def _earliest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The earliest row of each key in every batch of rows, so that a frequent key is no hot group."""
    for b in batches:
        if not b.num_rows:
            continue
        t = pa.Table.from_batches([b]).append_column("at", pa.array(range(b.num_rows), pa.int64()))
        t = t.select(["system", "masked", "at"]).take(pc.sort_indices(b, [("seq", "ascending")]))  # stable, nulls last
        first = t.group_by(["system", "masked"], use_threads=False).aggregate([("at", "first")])
        yield b.take(first["at_first"].combine_chunks())


def first_seen_keys(messages: DataFrame) -> DataFrame:
    """ST2 over a streaming frame ``system, seq, Content``: one output row per
    new masked key (the earliest message of the batch in which it appears)."""
    keyed = messages.select("system", "seq", correct_message("Content").alias("msg"))
    keyed = keyed.withColumn("masked", mask_message("msg"))
    keyed = keyed.mapInArrow(_earliest, keyed.schema)
    return keyed.groupBy("system", "masked").applyInPandasWithState(
        _first_seen, FIRST_SEEN_OUT, FIRST_SEEN_STATE, "append", GroupStateTimeout.NoTimeout)


_COMMITS = "batch bigint, next_round int"
_UNITS = "system string, round int, seq bigint, li int, label string, pos int, value string"
_MATCHING = "system string, masked string, template_id bigint"


class StreamState:
    """The state of a streaming parse, as committed under a folder.

    ``commits``: a row per committed batch (the seed is -1); ``catalog/batch=<id>``
    the catalog after a batch; ``matching/batch=<id>`` and ``units/batch=<id>`` what
    the batch added. Folders of batches without a commit are not read.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def commits(self) -> dict[int, int]:
        """Committed batches and the number of the next round after each; one small row a batch."""
        rows = read_if_any(self.spark, f"{self.folder}/commits", _COMMITS).collect()
        return {r.batch: r.next_round for r in rows}

    def before(self, batch: int) -> CatalogState:
        """The state that ``batch`` begins from."""
        done = {b: r for b, r in self.commits().items() if b < batch}
        if not done:
            raise RuntimeError(f"no committed state under {self.folder}")
        last = max(done)
        parts = {t: self.spark.read.schema(s).parquet(*(f"{self.folder}/{t}/batch={b}" for b in sorted(done)))
                 for t, s in (("matching", _MATCHING), ("units", _UNITS))}
        catalog = self.spark.read.parquet(f"{self.folder}/catalog/batch={last}")
        return CatalogState(catalog, parts["matching"], parts["units"], done[last])

    def commit(self, batch: int, catalog: DataFrame, matching: DataFrame, units: DataFrame, next_round: int) -> None:
        for name, df in (("catalog", catalog), ("matching", matching), ("units", units)):
            df.write.mode("overwrite").parquet(f"{self.folder}/{name}/batch={batch}")
        self.spark.createDataFrame([(batch, next_round)], _COMMITS).coalesce(1).write.mode("append").parquet(f"{self.folder}/commits")

    def templates(self) -> DataFrame:
        """``system, template_id, parsed``: the templates after the last commit."""
        return self.before(1 << 62).catalog.select("system", "template_id", F.col("final_template").alias("parsed"))

    def parsed(self) -> DataFrame:
        """``system, seq, parsed`` of the rows of all committed batches."""
        done = [b for b in sorted(self.commits()) if b >= 0]
        rows = [f"{self.folder}/parsed/batch_id={b}" for b in done]
        if not rows:
            return self.spark.createDataFrame([], "system string, seq bigint, parsed string")
        return resolve_templates(self.spark.read.parquet(*rows), self.before(1 << 62).catalog).select("system", "seq", "parsed")


def parse_batch(df: DataFrame, batch_id: int, folder: StreamState, words: DataFrame,
                labeller: Callable[[DataFrame], DataFrame] = truth_labeller) -> None:
    """One micro-batch of ST1 (also to be called by other drivers of batches)."""
    if batch_id in folder.commits():
        return
    truth = correct_message("EventTemplate") if "EventTemplate" in df.columns else F.lit(None).cast("string")
    rows = written(df.select("system", "seq", correct_message("Content").alias("Content"), truth.alias("EventTemplate"))
                   .withColumn("masked", mask_message("Content")), "batch")
    keys = written(distinct_keys(rows.drop("masked"), words), "keys")
    done = resolve_keys(keys, folder.before(batch_id), words, labeller)
    catalog, unknown = generalised(done)
    (rows.select("system", "seq", "masked").join(done.keys, ["system", "masked"], "left")
     .write.mode("overwrite").parquet(f"{folder.folder}/parsed/batch_id={batch_id}"))
    folder.commit(batch_id, catalog, done.matching, done.units.unionByName(unknown), done.next_round)


def start_parse_stream(messages: DataFrame, state: CatalogState, words: DataFrame, output: str,
                       checkpoint: str, labeller: Callable[[DataFrame], DataFrame] = truth_labeller,
                       trigger: dict | None = None):
    """ST1: start the streaming parse; returns the ``StreamingQuery``.

    ``messages``: streaming ``system, seq, Content[, EventTemplate]``;
    ``state``: seeded catalog (see :func:`logloom.plans.catalog_parse.seed_state`),
    taken when nothing is committed under ``output`` yet; ``output`` and
    ``checkpoint`` must be shared folders on a cluster. Read the results with
    :class:`StreamState`.
    """
    folder = StreamState(messages.sparkSession, output)
    if not folder.commits():
        folder.commit(-1, state.catalog, state.matching, state.units, state.next_round)
    words = written(words.select("word"), "words")

    def batch(df: DataFrame, batch_id: int) -> None:
        parse_batch(df, batch_id, folder, words, labeller)

    writer = messages.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()
