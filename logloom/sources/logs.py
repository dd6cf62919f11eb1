"""Readers and writers for log tables.

Every log table is ``system string, seq bigint, Content string,
EventTemplate string``; ``seq`` is arrival order within a system.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import correct_message

CSV_OPTIONS = {"header": "true", "escape": '"', "quote": '"', "mode": "PERMISSIVE", "enforceSchema": "false"}


def _with_seq(df: DataFrame, system: str | None) -> DataFrame:
    """Arrival order: rows count from 0 in each system, by path of the list, file
    and place in the file.

    Spark packs file splits into tasks by size, so row ids alone don't follow the
    files. Ids do grow within a split: each split's smallest id and size are
    counted (one row a split), and a running sum over the splits places them.
    """
    sys_col = F.lit(system) if system else F.regexp_extract("_file", r"([^/]+?)(_[^/]*)?\.csv$", 1)
    rows = df.withColumn("system", sys_col).withColumn("_id", F.monotonically_increasing_id())
    split = ["system", "_path", "_file", "_start"]
    before = Window.partitionBy("system").orderBy(*split[1:]).rowsBetween(Window.unboundedPreceding, -1)
    splits = rows.groupBy(*split).agg(F.min("_id").alias("_low"), F.count(F.lit(1)).alias("_n")).select(
        *split, "_low", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return rows.join(splits, split).select(
        "system", (F.col("_before") + F.col("_id") - F.col("_low")).alias("seq"), "Content", "EventTemplate")


def read_structured_logs(spark: SparkSession, path: str | list[str], system: str | None = None,
                         normalise: bool = True, multiline: bool = False) -> DataFrame:
    """A structured log CSV (header; only ``Content`` and ``EventTemplate``
    are kept, other columns are pruned), both normalised with F1.

    Each path of a list is read by its own header; files of one path must share
    theirs (Spark raises an error where they don't). ``seq`` follows the list, then
    the file names, then the rows of a file.
    """
    paths = [path] if isinstance(path, str) else list(path)
    reader = spark.read.options(**CSV_OPTIONS).option("multiLine", str(multiline).lower())
    frames = [reader.csv(p).select(
        "Content", "EventTemplate", F.lit(i).alias("_path"), F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_start")) for i, p in enumerate(paths)]
    df = _with_seq(reduce(DataFrame.unionByName, frames), system)
    if normalise:
        df = df.withColumn("Content", correct_message("Content")).withColumn(
            "EventTemplate", correct_message("EventTemplate"))
    return df


def read_examples(spark: SparkSession, path: str, system: str | None = None) -> DataFrame:
    """Labelled example CSV (``Content``, ``EventTemplate`` with ``{label}``
    slots), not normalised."""
    return read_structured_logs(spark, path, system, normalise=False)


def write_samples(samples: DataFrame, path: str) -> None:
    """Sampled examples as CSV per system, normalised with F1, in pick order."""
    out = samples.select("system", correct_message("Content").alias("Content"),
                         correct_message("EventTemplate").alias("EventTemplate"),
                         F.col("pick") if "pick" in samples.columns else F.col("seq").alias("pick"))
    (out.repartition("system").sortWithinPartitions("system", "pick").drop("pick")
     .write.mode("overwrite").partitionBy("system").options(**CSV_OPTIONS).csv(path))


def write_parsed(parsed: DataFrame, path: str) -> None:
    """Parsed pairs as parquet partitioned by system."""
    parsed.write.mode("overwrite").partitionBy("system").parquet(path)


def append_results(rows: DataFrame, path: str) -> None:
    """Append result rows (Q10) as CSV with a header; times and counts with
    two decimals, accuracies with four, as the reference formats them."""
    fmt2 = ["parse_time", "invoc_time", "invoc_num", "invoc_token"]
    fmt4 = ["GA", "PA", "FGA", "PTA", "RTA", "FTA"]
    out = rows.select(
        "Dataset", *[F.format_string("%.2f", F.col(c).cast("double")).alias(c) for c in fmt2],
        F.col("identified_templates").cast("string").alias("identified_templates"),
        F.col("ground_templates").cast("string").alias("ground_templates"),
        *[F.format_string("%.4f", F.col(c).cast("double")).alias(c) for c in fmt4])
    out.coalesce(1).write.mode("append").options(**CSV_OPTIONS).csv(path)
