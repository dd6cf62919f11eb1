"""Prefix sampling, head, contribution scores and diversified sampling
(S3, S7, A6, A7, A8).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import written
from .cluster import leader_cluster
from .dedup import candidate_groups, distinct_uncommon


def prefix_sample(logs: DataFrame, fraction: float = 0.2, partition: str = "system", order: str = "seq",
                  bucket_width: int = 1 << 16) -> DataFrame:
    """S3: the first ``floor(fraction * n)`` rows of every partition by ``order``.

    No window ever spans a whole system: rows are counted per
    ``(system, order div bucket_width)`` bucket (at most ``bucket_width`` rows
    each, since ``order`` is unique per system), a running sum over the small
    bucket table finds the cut, and only the one bucket containing the cut is
    ranked row by row.
    """
    b = F.floor(F.col(order) / F.lit(bucket_width)).cast("bigint")
    rows = logs.withColumn("_b", b)
    counts = rows.groupBy(partition, "_b").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(partition).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    tot = Window.partitionBy(partition)
    cum = counts.select(partition, "_b", "_n",
                        F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_before"),
                        F.floor(F.lit(fraction).cast("double") * F.sum("_n").over(tot)).cast("bigint").alias("_k"))
    tagged = rows.join(cum, [partition, "_b"])
    whole = tagged.where(F.col("_before") + F.col("_n") <= F.col("_k"))
    edge = tagged.where((F.col("_before") < F.col("_k")) & (F.col("_before") + F.col("_n") > F.col("_k")))
    rn = F.row_number().over(Window.partitionBy(partition, "_b").orderBy(order))
    edge = edge.withColumn("_rn", rn).where(F.col("_before") + F.col("_rn") <= F.col("_k")).drop("_rn")
    return whole.unionByName(edge).drop("_b", "_n", "_before", "_k")


def head_per_system(df: DataFrame, n: int, partition: str = "system", order: str = "seq") -> DataFrame:
    """First ``n`` rows per system by ``order`` (planned as a group limit,
    so each partition ships at most ``n`` rows per system before the shuffle)."""
    w = Window.partitionBy(partition).orderBy(order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def _occurrences(groups: DataFrame, clusters: DataFrame) -> DataFrame:
    """(system, seq, token, position of first occurrence, leader) per uncommon token occurrence."""
    occ = groups.select("system", "seq", "tokens", F.explode("uncommon").alias("token"))
    occ = occ.select("system", "seq", "token", (F.array_position("tokens", F.col("token")) - 1).alias("pos"))
    return occ.join(clusters.select("system", "token", "leader"), ["system", "token"])


def cluster_positions(groups: DataFrame, clusters: DataFrame) -> DataFrame:
    """Distinct first-occurrence positions of a cluster's tokens over the logs."""
    return (_occurrences(groups, clusters).groupBy("system", "leader")
            .agg(F.count_distinct("pos").alias("n_positions")))


def contribution_weights(groups: DataFrame, clusters: DataFrame) -> DataFrame:
    """Per (log, cluster): cluster weight times the log's token occurrences in it."""
    occ = _occurrences(groups, clusters)
    pos = cluster_positions(groups, clusters)
    return (occ.join(pos, ["system", "leader"])
            .groupBy("system", "seq", "leader").agg(F.sum("n_positions").alias("w")))


def contribution_scores(groups: DataFrame, clusters: DataFrame) -> DataFrame:
    """Per log, the sum over its uncommon tokens (duplicates count) of cluster weights."""
    w = contribution_weights(groups, clusters).groupBy("system", "seq").agg(F.sum("w").alias("score"))
    return (groups.select("system", "seq").join(w, ["system", "seq"], "left")
            .select("system", "seq", F.coalesce("score", F.lit(0)).cast("bigint").alias("score")))


def token_clusters(groups: DataFrame, threshold: float = 0.8) -> DataFrame:
    """A4 + A5: leader clusters over the distinct uncommon tokens of each system."""
    return leader_cluster(distinct_uncommon(groups), "token", threshold=threshold)


def diversified_sample(groups: DataFrame, clusters: DataFrame, max_shot: int = 32) -> DataFrame:
    """Greedy diversified sampling, all systems in one job per round.

    Round r picks, per system, the unpicked log with the largest gain (ties to
    the smallest ``seq``); a log's gain counts only clusters no picked log
    covers. A round reads only the weights of clusters that are still uncovered
    and stores those that stay so, so the table shrinks with every pick. When
    nothing is left to gain in a system, its remaining picks are its first
    unpicked logs: they are taken together, without further rounds. The
    per-round picks (one row per system) are the only data brought to the driver.
    """
    spark = groups.sparkSession
    left = written(contribution_weights(groups, clusters), "weights")
    picks: list[tuple[str, int, int]] = []
    schema = "system string, seq bigint, pick int"
    for r in range(max_shot):
        gains = left.groupBy("system", "seq").agg(F.sum("w").alias("gain")).where("gain > 0")
        rows = gains.groupBy("system").agg(F.max_by("seq", F.struct(F.col("gain"), -F.col("seq"))).alias("seq")).collect()
        if not rows:
            break
        new = [(row["system"], row["seq"], r) for row in rows]
        picks.extend(new)
        # at most one row per system
        covered = left.join(F.broadcast(spark.createDataFrame(new, schema)), ["system", "seq"], "left_semi")
        left = written(left.join(covered.select("system", "leader").distinct(), ["system", "leader"], "left_anti"), "weights")
    # at most max_shot rows per system
    picked = spark.createDataFrame(picks, schema)
    done = picked.groupBy("system").agg(F.count(F.lit(1)).alias("_done"))
    rest = groups.select("system", "seq").join(F.broadcast(picked), ["system", "seq"], "left_anti")
    rest = head_per_system(rest, max_shot).join(F.broadcast(done), "system", "left")
    place = F.row_number().over(Window.partitionBy("system").orderBy("seq")) - 1 + F.coalesce("_done", F.lit(0))
    fill = rest.select("system", "seq", place.cast("int").alias("pick")).where(F.col("pick") < max_shot)
    return groups.join(F.broadcast(picked.unionByName(fill)), ["system", "seq"])


def sample_examples(logs: DataFrame, words: DataFrame, max_shot: int = 32, fraction: float = 0.2) -> DataFrame:
    """Entry B: prefix -> candidate groups -> clusters -> diversified sample."""
    prefix = prefix_sample(logs, fraction)
    groups = written(candidate_groups(prefix, words), "groups")
    clusters = written(token_clusters(groups), "clusters")
    return diversified_sample(groups, clusters, max_shot)
