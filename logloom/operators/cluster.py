"""Leader clustering (A5, A10) as a set-similarity join plus a fixpoint.

First-fit leader clustering in a fixed order — each item joins the first
existing leader whose character-set Jaccard is at least ``threshold``, else
becomes a leader — equals the *lexicographically first maximal independent
set* of the similarity graph in that order, with each other item attached to
its earliest similar leader. We compute it without ever comparing all pairs:

1. Items collapse to character-set signatures (equal sets have similarity 1,
   so only the first item of a signature can lead, and all items of a
   signature land in the same cluster).
2. Similar signature pairs come from exact equi-join blocking: small sets
   meet on their intersection through deletion neighbourhoods (a set with
   Jaccard >= t to another loses at most ``floor(|x|(1-t)/t)`` elements to
   reach the intersection), and sizes decide; large sets meet on ``l`` shared
   characters of their prefixes (rare first, ``|x| - ceil(t|x|) + l``), within
   the length band ``t|x| <= |y| <= |x|/t``, and then pass the exact check.
   Signatures go by a number.
3. Rounds decide nodes: one with an earlier leader neighbour becomes a member;
   one whose earlier neighbours are all members becomes a leader. The status
   table and the edges of what is undecided are stored every round.

The threshold is compared exactly as ``5*inter >= 4*union`` for 0.8, using a
rational form of ``threshold``.
"""

from __future__ import annotations

from fractions import Fraction
from itertools import combinations

import pandas as pd

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from ..functions.similarity import characters
from ..session import written


def _ratio(threshold: float) -> tuple[int, int]:
    fr = Fraction(threshold).limit_denominator(1000)
    return fr.numerator, fr.denominator


def signatures(items: DataFrame, partition: list[str], item: str, order: str) -> DataFrame:
    """One row per (partition, character set): size, chars, first item by ``order``."""
    sig = F.array_sort(F.array_distinct(characters(item)))
    return (items.select(*partition, item, order, sig.alias("sig"))
            .groupBy(*partition, "sig")
            .agg(F.min_by(F.struct(F.col(order).alias("o"), F.col(item).alias("first")), F.col(order)).alias("f"))
            .select(*partition, "sig", F.size("sig").alias("n"), F.col("f.o").alias("o"), F.col("f.first").alias("first")))


SMALL_SET = 12

#: Larger sets by the size of a pair's larger one: (over, up to, characters that its keys hold).
LARGE_SETS = ((SMALL_SET, 40, 4), (40, 200, 2), (200, None, 1))


@F.pandas_udf(ArrayType(StringType()))
def _deletion_keys(sig: pd.Series, k: pd.Series) -> pd.Series:
    """All subsets of a sorted character set missing at most ``k`` characters,
    each as a ``\u0001``-joined string (small sets only; <= 299 keys at 12)."""
    out = []
    for chars, kk in zip(sig, k):
        chars = list(chars)
        n = len(chars)
        keys = []
        for j in range(int(kk) + 1):
            for drop in combinations(range(n), j):
                keys.append("\u0001".join(c for i, c in enumerate(chars) if i not in drop))
        out.append(keys)
    return pd.Series(out)


@F.pandas_udf(ArrayType(StringType()))
def _prefix_keys(ranks: pd.Series, size: pd.Series) -> pd.Series:
    """All ``size``-subsets of a prefix of ranked characters."""
    return pd.Series([[",".join(map(str, c)) for c in combinations(list(r), int(k))] for r, k in zip(ranks, size)])


def _prefix_candidates(sigs: DataFrame, partition: list[str], num: int, den: int) -> DataFrame:
    """Keys of large sets: ``(*partition, key, id, n, over)``.

    A pair with Jaccard >= t has ``c >= t * n`` characters in common, n the size
    of either set. The first l of these in any fixed order (rare characters
    first) lie among the first ``n - ceil(t n) + l`` of both sets, so the pair
    shares an l-subset of these prefixes. l goes by the class of the larger set;
    a set has keys for each class that it can be in a pair of.
    """
    chars = sigs.select(*partition, "id", "n", F.explode("sig").alias("ch"))
    freq = chars.groupBy(*partition, "ch").agg(F.count(F.lit(1)).alias("df"))
    rank = freq.withColumn("rk", F.row_number().over(Window.partitionBy(*partition).orderBy("df", "ch")))
    ranked = (chars.join(rank.select(*partition, "ch", "rk"), [*partition, "ch"])
              .groupBy(*partition, "id", "n").agg(F.array_sort(F.collect_list("rk")).alias("rc")))
    classes = []
    for over, to, size in LARGE_SETS:
        least = -(-(over + 1) * num // den)
        fits = (F.col("n") >= least) & (F.col("n") <= to if to else F.lit(True))
        classes.append(F.when(fits, F.struct(F.lit(over).alias("over"), F.lit(min(size, least)).alias("size"))))
    kinds = F.explode(F.filter(F.array(*classes), lambda x: x.isNotNull()))
    ranked = ranked.select(*partition, "id", "n", "rc", kinds.alias("c")).select(*partition, "id", "n", "rc", "c.over", "c.size")
    length = F.col("n") - F.floor((F.col("n") * num + den - 1) / den).cast("int") + F.col("size")
    return ranked.select(*partition, "id", "n", "over", F.explode(
        _prefix_keys(F.slice("rc", F.lit(1), length), F.col("size"))).alias("key"))


def similar_signature_pairs(sigs: DataFrame, partition: list[str], threshold: float = 0.8) -> DataFrame:
    """Edges (a -> b), a earlier than b, between signatures with Jaccard >= threshold.

    Exact blocking in two parts. Two sets with Jaccard >= t each lose at most
    ``floor(|x|(1-t))`` elements to reach their intersection, so small sets
    (<= ``SMALL_SET`` characters) emit their deletion neighbourhood and pairs
    meet on the intersection as an equi-join key. The key is part of the
    intersection, so a pair that is alike by a key's size is alike, and one that
    is alike meets at its intersection: sizes decide. Pairs with a larger
    set (both then have >= ``t*(SMALL_SET+1)`` characters) meet on some
    characters of their prefixes, and what meets is compared. ``sigs`` are
    numbered (``id``) and stored, else that is done first.
    """
    num, den = _ratio(threshold)
    if "id" not in sigs.columns:
        sigs = numbered(sigs)
    k = F.floor(F.col("n") * (den - num) / den).cast("int")
    small = sigs.where(F.col("n") <= SMALL_SET)
    small_keys = small.select(*partition, "id", "n", F.explode(_deletion_keys("sig", k)).alias("key"))
    small_keys = small_keys.withColumn("m", F.size(F.split("key", "\u0001")))
    large_keys = _prefix_candidates(sigs.where(F.col("n") >= -(-(SMALL_SET + 1) * num // den)), partition, num, den)

    def met(keys: DataFrame, own: list[str]) -> DataFrame:
        a = keys.select(*partition, *own, F.col("id").alias("a"), F.col("n").alias("na"))
        b = keys.select(*partition, *own, F.col("id").alias("b"), F.col("n").alias("nb"))
        # exploded sides look smaller to the planner than they are: no broadcast here
        return a.hint("merge").join(b.hint("merge"), [*partition, *own]).where(
            (F.col("a") < F.col("b")) & (F.col("nb") * den >= F.col("na") * num) & (F.col("na") * den >= F.col("nb") * num))

    alike = met(small_keys, ["key", "m"]).where(F.col("m") * den >= (F.col("na") + F.col("nb") - F.col("m")) * num)
    large = met(large_keys, ["key", "over"]).where(F.greatest("na", "nb") > F.col("over")).select("a", "b").distinct()
    sets = sigs.where(F.col("n") >= -(-(SMALL_SET + 1) * num // den))
    large = (large.join(sets.select(F.col("id").alias("a"), F.col("sig").alias("sa")), "a")
             .join(sets.select(F.col("id").alias("b"), F.col("sig").alias("sb")), "b"))
    inter = F.size(F.array_intersect("sa", "sb"))
    union = F.size("sa") + F.size("sb") - inter
    large = large.where((union > 0) & (inter * den >= union * num))
    # a pair of small sets may meet at several keys, a pair of large ones in one class only
    both = alike.select("a", "b").distinct().unionByName(large.select("a", "b"))
    place = sigs.select(*partition, "id", "o")
    ends = (both.join(place.select(F.col("id").alias("a"), *partition, F.col("o").alias("x")), "a")
            .join(place.select(F.col("id").alias("b"), F.col("o").alias("y")), "b"))
    first = F.col("x") < F.col("y")
    return ends.where(first | (F.col("y") < F.col("x"))).select(
        *partition, F.when(first, F.col("x")).otherwise(F.col("y")).alias("oa"),
        F.when(first, F.col("y")).otherwise(F.col("x")).alias("ob"),
        F.when(first, F.col("a")).otherwise(F.col("b")).alias("a"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("b"))


def numbered(sigs: DataFrame) -> DataFrame:
    """Stored signatures with a number ``id`` each."""
    return written(sigs.withColumn("id", F.monotonically_increasing_id()), "signatures")


def _decided(src: DataFrame, item: str, partition: list[str], threshold: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Signatures of distinct items ``src`` (order in ``_o``) and their edges, both stored, and who leads
    (``id, st``: L or M)."""
    sigs = numbered(signatures(src, partition, item, "_o"))
    edges = written(similar_signature_pairs(sigs, partition, threshold).select("a", "b", "oa"), "edges")
    edges_of = edges.select("a", "b")
    status = written(sigs.select("id", F.lit("U").alias("st")), "status")
    while not status.where(F.col("st") == "U").isEmpty():
        # only edges of undecided nodes go on: one from a member says nothing, one to a decided node is done
        waits = status.where(F.col("st") == "U").select(F.col("id").alias("b"))
        live = edges_of.join(waits, "b", "left_semi").join(
            status.where(F.col("st") != "M").select(F.col("id").alias("a"), F.col("st").alias("sa")), "a")
        edges_of = written(live, "live")
        inn = edges_of.groupBy(F.col("b").alias("id")).agg(F.max(F.col("sa") == "L").alias("led"))
        edges_of = edges_of.select("a", "b")
        status = written(status.join(inn, "id", "left").select(
            "id", F.when(F.col("st") != "U", F.col("st")).when(F.col("led"), F.lit("M"))
            .when(F.col("led").isNull(), F.lit("L")).otherwise(F.lit("U")).alias("st")), "status")
    return sigs, edges, status


def _distinct_items(items: DataFrame, item: str, order: str | None, partition: list[str]) -> DataFrame:
    if order is None:
        return items.select(*partition, item).distinct().withColumn("_o", F.col(item))
    return items.select(*partition, item, F.col(order).alias("_o")).dropDuplicates([*partition, item])


def cluster_leaders(items: DataFrame, item: str, order: str | None = None, partition: list[str] | None = None,
                    threshold: float = 0.8) -> DataFrame:
    """A5/A10: the leaders of :func:`leader_cluster` only, as ``(*partition, o, leader)``
    with their place ``o`` in the order. A leader is the first item of its
    signature, so the other items are read once and joined to nothing."""
    partition = partition or ["system"]
    sigs, _, status = _decided(_distinct_items(items, item, order, partition), item, partition, threshold)
    known = sigs.where(" AND ".join(f"{c} IS NOT NULL" for c in [*partition, "sig"]))
    return (known.select(*partition, "id", "o", F.col("first").alias("leader"))
            .join(status.where(F.col("st") == "L").select("id"), "id").drop("id"))


def leader_cluster(items: DataFrame, item: str, order: str | None = None, partition: list[str] | None = None,
                   threshold: float = 0.8) -> DataFrame:
    """A5/A10: ``(*partition, item, leader, is_leader)`` for first-fit leader clustering.

    ``order`` (default: the item itself, binary order) decides who comes first.
    ``items`` should hold distinct items per partition (first occurrence order).
    """
    partition = partition or ["system"]
    src = written(_distinct_items(items, item, order, partition), "items")
    sigs, edges, status = _decided(src, item, partition, threshold)
    leaders = status.where(F.col("st") == "L").select(F.col("id").alias("a"))
    member_of = edges.join(leaders, "a").groupBy(F.col("b").alias("id")).agg(F.min(F.struct("oa", "a")).alias("l"))
    first = sigs.select("id", F.col("first").alias("leader"))
    assign = (status.join(member_of, "id", "left")
              .select("id", F.when(F.col("st") == "L", F.col("id")).otherwise(F.col("l.a")).alias("to"),
                      (F.col("st") == "L").alias("is_leader"))
              .join(first.withColumnRenamed("id", "to"), "to").select("id", "leader", "is_leader"))
    led = sigs.select(*partition, F.array_join("sig", "").alias("_sig"), "id").join(assign, "id").drop("id")
    sig_of = F.array_join(F.array_sort(F.array_distinct(characters(item))), "")
    return (src.select(*partition, item, sig_of.alias("_sig")).join(led, [*partition, "_sig"])
            .select(*partition, item, "leader",
                    (F.col("is_leader") & (F.col(item) == F.col("leader"))).alias("is_leader")))
