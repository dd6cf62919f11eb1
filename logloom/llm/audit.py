"""Audit of how filters interact: what each removes, given the ones before it.

Rows go by ``(part, id)`` to sorted id ranges; in a range each filter has the
sorted list of the rows that fail it. Unions of the lists and what is left of a
list without a union are found by merges that gallop: a list whose head is
behind jumps ahead by doubling steps and a search in the last one, so a stretch
that no other list touches costs its logarithm. The sizes add up over the
ranges. The filters stay apart from the order in which they are applied: what a
filter removes depends only on the set of filters before it, so the orders read
the sums of those sets.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Rows of an id range.
RANGE = 1 << 16
_SUMS = ["rows", "after", "fails", "gone", "alone", "good", "toxic"]
_SCHEMA = "part string, f int, before int, " + ", ".join(f"{c} long" for c in _SUMS)


def gallop(ids: list[int], x: int, lo: int) -> int:
    """The first place from ``lo`` on whose id is at least ``x``."""
    step, hi, n = 1, lo, len(ids)
    while hi < n and ids[hi] < x:
        lo, hi, step = hi + 1, hi + step, step * 2
    return bisect_left(ids, x, lo, min(hi, n))


def union_size(lists: list[list[int]]) -> int:
    """Number of different ids in sorted lists (a k-way merge that counts stretches)."""
    heads = [(l, 0) for l in lists if l]
    total = 0
    while len(heads) > 1:
        heads.sort(key=lambda h: h[0][h[1]])
        (ids, at), x = heads[0], heads[1][0][heads[1][1]]
        to = gallop(ids, x, at)
        total += to - at
        if to < len(ids) and ids[to] == x:
            to += 1  # the other list counts it
        heads[0] = (ids, to)
        if to == len(ids):
            heads.pop(0)
    return total + sum(len(ids) - at for ids, at in heads)


def without_size(ids: list[int], others: list[list[int]]) -> int:
    """Number of ids of a sorted list that are in none of the other sorted lists."""
    heads = [(l, 0) for l in others if l]
    total, at, n = 0, 0, len(ids)
    while at < n and heads:
        x, ahead = ids[at], []
        for l, k in heads:
            k = gallop(l, x, k)
            if k < len(l):
                ahead.append((l, k))
        heads = ahead
        if not heads:
            break
        near = min(l[k] for l, k in heads)
        if near == x:
            at += 1
        else:
            to = gallop(ids, near, at)
            total += to - at
            at = to
    return total + n - at


def both(a: list[int], b: list[int]) -> list[int]:
    """Ids in both sorted lists."""
    out, i, j = [], 0, 0
    while i < len(a) and j < len(b):
        if a[i] == b[j]:
            out.append(a[i])
            i, j = i + 1, j + 1
        elif a[i] < b[j]:
            i = gallop(a, b[j], i)
        else:
            j = gallop(b, a[i], j)
    return out


def _range_sums(k: int, fails: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """Per (filter, set before it): the sizes of ``_SUMS`` in one range."""
    lists = [np.flatnonzero(fails >> f & 1).tolist() for f in range(k)]
    marked = [[both(l, np.flatnonzero(marks >> m & 1).tolist()) for l in lists] for m in range(2)]
    united = [union_size([lists[f] for f in range(k) if s >> f & 1]) for s in range(1 << k)]
    out = []
    for f, s in sets(k):
        others = [lists[g] for g in range(k) if s >> g & 1]
        rest = [lists[g] for g in range(k) if g != f]
        out.append((len(fails), len(fails) - united[s | 1 << f], len(lists[f]), without_size(lists[f], others),
                    without_size(lists[f], rest), *(without_size(m[f], others) for m in marked)))
    return np.array(out, np.int64)


def sets(k: int) -> list[tuple[int, int]]:
    """Every filter with every set of other filters, as (place, bits)."""
    return [(f, s) for f in range(k) for s in range(1 << k) if not s >> f & 1]


def _sums(k: int):
    """Sums of the parts of a partition that is sorted by part and id."""
    pairs = sets(k)

    def rows(part: str, sums: np.ndarray) -> pa.RecordBatch:
        cols = [pa.array([part] * len(pairs)), pa.array([f for f, _ in pairs], pa.int32()), pa.array([s for _, s in pairs], pa.int32())]
        return pa.RecordBatch.from_arrays([*cols, *(pa.array(sums[:, i]) for i in range(len(_SUMS)))],
                                          names=["part", "f", "before", *_SUMS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, sums, held, n = None, None, [], 0

        def close():
            nonlocal held, n, sums
            if n:
                fails, marks = (np.concatenate([h[i] for h in held]) for i in range(2))
                for a in range(0, n, RANGE):
                    sums = sums + _range_sums(k, fails[a : a + RANGE], marks[a : a + RANGE])
            held, n = [], 0

        for b in batches:
            names = b.column("part").to_numpy(zero_copy_only=False)
            fails, marks = b.column("fails").to_numpy(), b.column("marks").to_numpy()
            edges = np.flatnonzero(np.append(True, names[1:] != names[:-1])).tolist() if len(names) else []
            for a, z in zip(edges, [*edges[1:], len(names)]):
                if names[a] != part:
                    close()
                    if part is not None:
                        yield rows(part, sums)
                    part, sums = names[a], np.zeros((len(pairs), len(_SUMS)), np.int64)
                held.append((fails[a:z], marks[a:z]))
                n += z - a
                if n >= RANGE:
                    close()
        close()
        if part is not None:
            yield rows(part, sums)

    return run


def audit(failing: DataFrame, names: str = "ABCDE") -> DataFrame:
    """Interaction of filters over rows ``part, id, fails, marks``.

    Bit f of ``fails`` says that the row fails the f-th filter of ``names``;
    bits 0 and 1 of ``marks`` are good and toxic rows. Returns per part, order
    of the filters and step: ``kept`` after the step, ``removed`` by it,
    ``redundant`` (failing the filter, removed before), ``unique_fails`` (failing
    this filter only), ``good_lost`` and ``toxic_lost`` (removed here and so
    marked), and ``shapley`` (the filter's removed rows, summed over all orders).

    A null part is the empty string. A row counts whatever its id, also when
    ids are null or repeated. Parts and ids that hold most rows are split over
    tasks by range. Other columns are not read. No rows give no result.
    """
    k = len(names)
    rows = failing.select(F.coalesce("part", F.lit("")).alias("part"), "id",
                          F.col("fails").cast("int").alias("fails"), F.col("marks").cast("int").alias("marks"))
    # equal ids are told apart by a random number, so no id is too many for one range; it is stored, so a task
    # that runs again finds the same one
    rows = stored(rows.withColumn("tie", F.rand()), "failing").repartitionByRange("part", "id", "tie").sortWithinPartitions("part", "id")
    sums = rows.select("part", "fails", "marks").mapInArrow(_sums(k), _SCHEMA)
    sums = sums.groupBy("part", "f", "before").agg(*(F.sum(c).alias(c) for c in _SUMS))
    ways = F.element_at(F.array(*[F.lit(factorial(i) * factorial(k - 1 - i)) for i in range(k)]),
                        (F.bit_count("before") + 1).cast("int"))
    sums = stored(sums, "filter_sums")
    shapley = sums.groupBy("part", "f").agg(F.sum(F.col("gone") * ways).alias("shapley"))
    orders = [("".join(names[f] for f in p), i + 1, f, sum(1 << g for g in p[:i]))
              for p in permutations(range(k)) for i, f in enumerate(p)]
    steps = failing.sparkSession.createDataFrame(orders, "filter_order string, step int, f int, before int")
    # k * k! rows, whatever the input
    return sums.join(F.broadcast(steps), ["f", "before"]).join(shapley, ["part", "f"]).select(
        "part", "filter_order", "step", F.col("after").alias("kept"), F.col("gone").alias("removed"),
        (F.col("fails") - F.col("gone")).alias("redundant"), F.col("alone").alias("unique_fails"),
        F.col("good").alias("good_lost"), F.col("toxic").alias("toxic_lost"), "shapley")


#: Keys of more than this share of the rows are joined apart; there are at most as many as its inverse.
HOT = 1 / 1024


def copies(docs: DataFrame) -> DataFrame:
    """``docs`` (with ``doc_id`` and ``hash``) and ``copy``: whether a row with a
    smaller ``doc_id`` has the same hash. Ids that are null are no copies."""
    groups = stored(docs.groupBy("hash").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1"), "copies")
    limit = max(1, int(docs.count() * HOT))
    hot = groups.where(F.col("n") > limit).select("hash", F.col("least").alias("hot"))
    other = groups.where(F.col("n") <= limit).select("hash", F.col("least").alias("other"))
    # the hot rows don't meet in a task: their few hashes are sent to them, and they leave the join by a null key
    marked = docs.join(F.broadcast(hot), "hash", "left")
    few = marked.where("hot IS NULL").join(other, "hash", "left").withColumn("least", F.col("other")).drop("hot", "other")
    many = marked.where("hot IS NOT NULL").withColumn("least", F.col("hot")).drop("hot")
    return few.unionByName(many).withColumn("copy", F.coalesce(F.col("doc_id") > F.col("least"), F.lit(False))).drop("least")


def failing(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``part, id, fails, marks`` of every document for five filters, by source.

    A: under 200 words. B: fewer than half of the words are different. C: more
    than 2 percent capitals. D: holds one of ``#$%&*|``. E: the text of a
    smaller ``doc_id``. Words are runs without ASCII white space. ``labels`` marks
    good (``quality`` 1) and toxic (``toxic`` 1) documents; a document with
    several rows there has each mark that one of them gives. A null text is
    empty, a null source the empty string; a null ``doc_id`` has no mark and is
    no copy. Texts are read whole; other columns are not read.
    """
    text = F.coalesce("text", F.lit(""))
    seen = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), text.alias("text"),
                       F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "").alias("w"))
    n, low = F.size("w"), F.length("text")
    fails = [n < 200, 100 * F.size(F.array_distinct("w")) < 50 * n,
             100 * F.length(F.regexp_replace("text", "[^A-Z]+", "")) > 2 * low, F.col("text").rlike("[#$%&*|]")]
    bits = sum((F.when(c, 1 << i).otherwise(0) for i, c in enumerate(fails)), F.lit(0))
    rows = stored(seen.select("doc_id", "part", bits.alias("bits"), F.unhex(F.sha2("text", 256)).alias("hash")), "filtered")
    marks = (labels.where("doc_id IS NOT NULL").groupBy("doc_id")
             .agg(F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"),
                  F.max(F.when(F.col("toxic") == 1, 2).otherwise(0)).alias("toxic")))
    rows = copies(rows)
    # rows without an id have no marks and stay out of the join; one row a label, so a frequent id is split by AQE
    known = rows.where("doc_id IS NOT NULL").join(marks, "doc_id", "left")
    lost = rows.where("doc_id IS NULL").withColumns({"good": F.lit(None).cast("int"), "toxic": F.lit(None).cast("int")})
    return known.unionByName(lost).select(
        "part", F.col("doc_id").alias("id"), (F.col("bits") + F.when(F.col("copy"), 16).otherwise(0)).alias("fails"),
        (F.coalesce("good", F.lit(0)) + F.coalesce("toxic", F.lit(0))).alias("marks"))
