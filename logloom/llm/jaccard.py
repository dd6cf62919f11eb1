"""Exact n-gram Jaccard self-join of documents, as link components.

A document is the set of its n-word shingles; two documents link when their
sets' Jaccard similarity reaches num/den. Equal sets are one class from the
start; classes are then linked by prefix filtering:

1. Shingles get one global order, rare ones first. Rarity is counted over all
   documents; a document brings the eighth of its shingles that its content
   picks. The most frequent ones (at most MAX_HOT) come last, by count, all
   others first, by hash. Any order gives the same links.
2. A class brings its prefix: its first n - ceil(t n) + 1 shingles. Two classes
   that link share one. Prefix shingles of a single class are dropped.
3. In each shingle's bucket all classes meet one of them (the hub: the one that
   holds the shingle earliest): as many rows as members. Pairs pass the length
   filter, the positional filter (if the bucket's shingle is the first that both
   hold, enough must be able to follow), the suffix filter (sixteen hash ranges
   must not differ in size by more than the sets may) and the count of shingles
   that the prefixes share, and are verified once, on whole texts. Components
   follow. Buckets that still hold several components do so again with eight hubs.
4. Classes of one bucket that are in different components then meet each other
   directly, with the same filters; so no link between components is lost.

Rows: null text is empty; texts without words have no shingles and link with
nothing. Rows without doc_id take part, but a component's id is its smallest
doc_id. Repeated rows are one class.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BitFilter, components, map_arrow, ragged, stored
from .text import mix, parts, powers, shingle_sets, word_hashes

_U = np.uint64
SLOTS = 8
#: Shingles seen so often in the eighths count as frequent.
HOT_COUNT = 4
#: Bound of the broadcast list of frequent shingles.
MAX_HOT = 1 << 18
_RANGES = 16
#: Bytes of sets that a verifying task remembers.
_HELD = 1 << 22
#: Hubs of a bucket in each round; afterwards what is left meets directly.
HUBS = (1, 8)


def _key(x: np.ndarray) -> int:
    """Content hash of a set, as a signed long."""
    return int(mix(x ^ _U(0xA5A5A5A55A5A5A5A)).sum(dtype=_U).astype(np.int64))


def _shingles(data: np.ndarray, off: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all full shingles of a slice, their rows, and a content hash per row."""
    h, counts = word_hashes(data, off)
    ends = np.cumsum(counts)
    sums = np.concatenate([np.zeros(1, _U), np.cumsum(h)])
    rows = mix(sums[ends] - sums[ends - counts])
    if len(h) < n:
        return np.zeros(0, _U), np.zeros(0, np.int64), rows
    x = h[: len(h) - n + 1].copy()
    for k in range(1, n):
        x *= powers(2)[0][1]
        x += h[k : len(h) - n + 1 + k]
    row = np.repeat(np.arange(len(counts)), counts)
    on = row[: len(x)] == row[n - 1 :]
    return mix(x[on] + _U(n)), row[: len(x)][on], rows


def frequent(docs: DataFrame, n: int) -> np.ndarray:
    """The most frequent shingles, rarest first (at most MAX_HOT)."""

    def count(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for _, data, off in parts(b.column("text")):
            x, row, rows = _shingles(data, off, n)
            u, c = np.unique(x[(x & _U(SLOTS - 1)) == (rows[row] & _U(SLOTS - 1))], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(c.astype(np.int64))], ["s", "c"])

    hot = (
        map_arrow(docs.select("text"), count, "s long, c long")
        .groupBy("s")
        .agg(F.sum("c").alias("c"))
        .where(F.col("c") >= HOT_COUNT)
        .orderBy(F.desc("c"), "s")
        .limit(MAX_HOT)
        .toArrow()
    )
    return hot["s"].to_numpy().view(_U)[::-1]


class Order:
    """The global order: shingles that aren't frequent by hash, then the frequent by rank."""

    def __init__(self, hot: np.ndarray):
        self.rank = np.argsort(hot)
        self.hot = hot[self.rank]
        self.maybe = np.zeros(1 << 16, bool)
        self.maybe[(hot >> _U(48)).astype(np.int64)] = True

    def prefix(self, x: np.ndarray, size: int) -> np.ndarray:
        """The first ``size`` of a sorted set."""
        at = np.flatnonzero(self.maybe[(x >> _U(48)).astype(np.int64)])
        if len(at):
            spot = np.minimum(np.searchsorted(self.hot, x[at]), len(self.hot) - 1)
            on = self.hot[spot] == x[at]
            at, spot = at[on], spot[on]
        if not len(at):
            return x[:size]
        cold = np.delete(x, at)
        if len(cold) >= size:
            return cold[:size]
        late = x[at][np.argsort(self.rank[spot])]
        return np.concatenate([cold, late[: size - len(cold)]])


def classes(docs: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """Per row: doc_id, t (hash of the text), n (set size), k (content hash of the set), range sizes and prefix."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent(docs, n))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = Order(shared.value)
        for b in batches:
            ids = b.column("doc_id")
            for i, data, off in parts(b.column("text")):
                sizes, keys, ranges, prefixes = [], [], [], []
                for x in shingle_sets(data, off, n):
                    m = len(x)
                    sizes.append(m)
                    keys.append(_key(x))
                    ranges.append(np.bincount((x >> _U(60)).astype(np.int64), minlength=_RANGES))
                    prefixes.append(order.prefix(x, m - -(-num * m // den) + 1) if m else x)
                flat = np.concatenate([np.zeros(0, _U), *prefixes]).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(i, len(sizes)),
                        b.column("t").slice(i, len(sizes)),
                        pa.array(sizes, pa.int64()),
                        pa.array(keys, pa.int64()),
                        ragged(np.concatenate(ranges).astype(np.int32), np.full(len(sizes), _RANGES), pa.int32()),
                        ragged(flat, np.array([len(p) for p in prefixes]), pa.int64()),
                    ],
                    ["doc_id", "t", "n", "k", "ranges", "prefix"],
                )

    return docs.select("doc_id", "text", F.xxhash64("text").alias("t")).mapInArrow(
        run, "doc_id long, t long, n long, k long, ranges array<int>, prefix array<long>"
    )


def _filtered(pairs: DataFrame, one: DataFrame, num: int, den: int) -> DataFrame:
    """Of pairs (a, b) those that may link by their classes' prefixes and ranges."""
    need = F.expr(f"{num + den} * shared >= {num} * (na + nb)")

    def end(x: str) -> DataFrame:
        return one.select(F.col("k").alias(x), *(F.col(c).alias(f"{c}{x}") for c in ("n", "ranges", "prefix")))

    # |A| + |B| - 2 shared >= what the ranges differ by
    apart = F.aggregate(F.zip_with("rangesa", "rangesb", lambda x, y: F.abs(x - y)), F.lit(0), lambda s, x: s + x)
    # up to the end of the prefix that ends first, shared shingles are in both
    both = F.size(F.array_intersect("prefixa", "prefixb")) + F.expr("greatest(na - size(prefixa), nb - size(prefixb))")
    return (
        pairs.select("a", "b")
        .distinct()
        .join(end("a"), "a")
        .join(end("b"), "b")
        .withColumn("shared", F.expr("na + nb") / 2 - apart / 2)
        .where(need)
        .withColumn("shared", both)
        .where(need)
        .select("a", "b")
    )


def _texts(docs: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """(k, text) of the wanted classes (k, doc_id: of one of its documents)."""
    near = BitFilter(wanted, "doc_id", 23).keep(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), "doc_id")

    def run(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for i, data, off in parts(b.column("text")):
            keys = [_key(x) for x in shingle_sets(data, off, n)]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), b.column("text").slice(i, len(keys))], ["k", "text"])

    return stored(map_arrow(near.select("text"), run, "k long, text string"), "texts")


def _verified(pairs: DataFrame, docs: DataFrame, one: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """The pairs of classes (a, b) whose sets reach the threshold."""
    pairs = stored(pairs, "pairs")
    ends = pairs.select(F.explode(F.array("a", "b")).alias("k")).distinct()
    texts = _texts(docs, one.select("k", "doc_id").join(ends, "k"), n)
    first = texts.select(F.col("k").alias("a"), F.col("text").alias("ta"))
    second = texts.select(F.col("k").alias("b"), F.col("text").alias("tb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        size = 0

        def sets(keys: pa.Array, texts: pa.Array) -> Iterator[np.ndarray]:
            nonlocal size
            for k, t in zip(keys.to_pylist(), texts):
                if k not in held:
                    if size > _HELD:
                        held.clear()
                        size = 0
                    data = np.frombuffer(t.as_py().encode(), np.uint8)
                    held[k] = next(shingle_sets(data, np.array([0, len(data)]), n))
                    size += held[k].nbytes
                yield held[k]

        for b in batches:
            on = []
            for x, y in zip(sets(b.column("a"), b.column("ta")), sets(b.column("b"), b.column("tb"))):
                same = len(x) + len(y) - len(np.union1d(x, y))
                on.append(den * same >= num * (len(x) + len(y) - same))
            yield b.select(["a", "b"]).filter(pa.array(on, pa.bool_()))

    return stored(
        pairs.join(first, "a").join(second, "b").select("a", "ta", "b", "tb").mapInArrow(run, "a long, b long").distinct(),
        "links",
    )


def _members(docs: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """Per row of (doc_id, text): doc_id, t (hash of the text), n (set size) and g (component; null without shingles)."""
    rows = stored(classes(docs, n, num, den), "sets")
    one = stored(rows.where("n > 0").dropDuplicates(["k"]), "classes")
    spread = one.select("k", "n", F.posexplode("prefix").alias("pos", "s"))
    shared = spread.groupBy("s").count().where("count > 1")
    near = BitFilter(shared, "s", 25).keep(spread, "s")
    met = near.groupBy("s").agg(F.count("*").alias("c")).where("c > 1")
    bucket = stored(near.join(met.select("s"), "s"), "buckets")

    def side(df: DataFrame, x: str) -> DataFrame:
        return df.select("s", F.col("k").alias(x), *(F.col(c).alias(f"{c}{x}") for c in ("n", "pos", "g")))

    # sizes fit, and enough may follow if s is the first shingle that both hold;
    # a pair that links meets this in the bucket of its first
    fits = F.expr(
        f"{den} * least(na, nb) >= {num} * greatest(na, nb) and ga <> gb"
        f" and {num + den} * least(na - posa, nb - posb) >= {num} * (na + nb)"
    )

    def linked_pairs(left: DataFrame, right: DataFrame, cond: str) -> DataFrame:
        both = side(left, "a").join(side(right, "b"), "s").where(fits & F.expr(cond))
        return _verified(_filtered(both, one, num, den), docs, one, n, num, den)

    links, final = None, None
    for turn in range(len(HUBS) + 1):
        if final is None:
            placed = bucket.withColumn("g", F.col("k"))
        else:
            placed = bucket.join(final.withColumnRenamed("node", "k"), "k", "left").withColumn("g", F.coalesce("component", "k"))
        last = turn == len(HUBS)
        # the first hub holds the shingle earliest: few shingles set it apart from the others
        draws = [] if last else [F.struct("pos", F.xxhash64("k", F.lit(turn)))]
        draws += [] if last else [F.struct(F.xxhash64("k", F.lit(100 * turn + i))) for i in range(1, HUBS[turn])]
        lowest = [F.min(d).alias(f"hub{i}") for i, d in enumerate(draws)]
        open_ = placed.groupBy("s").agg(F.min("g").alias("lo"), F.max("g").alias("hi"), F.min("n").alias("least"), *lowest)
        # places too late for even the bucket's smallest set meet nothing here
        early = F.expr(f"{num + den} * (n - pos) >= {num} * (n + least)")
        rest = stored(
            placed.select("s", "k", "n", "pos", "g")
            .join(open_.where("lo <> hi").drop("lo", "hi"), "s")
            .where(early)
            .drop("least"),
            "open",
        )
        if last:
            found = linked_pairs(rest, rest, "a < b")
        else:
            is_hub = reduce(or_, [d == F.col(f"hub{i}") for i, d in enumerate(draws)])
            hubs, others = rest.where(is_hub), rest.where(~is_hub)
            found = linked_pairs(hubs, others.unionByName(hubs) if HUBS[turn] > 1 else others, "a <> b")
            bucket = others.select("s", "k", "n", "pos")  # a hub has met all of its bucket
        links = found if links is None else links.unionByName(found)
        final = components(links)
    return (
        rows.select("doc_id", "t", "n", "k")
        .join(final, rows.k == final.node, "left")
        .select("doc_id", "t", "n", F.when(F.col("n") > 0, F.coalesce("component", "k")).alias("g"))
    )


def linked(docs: DataFrame, n: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """Per row of (doc_id, text): doc_id, n_shingles and component_id, the smallest
    doc_id that links of Jaccard similarity >= num/den between n-word shingle sets reach."""
    member = _members(docs, n, num, den)
    lowest = member.where("g is not null").groupBy("g").agg(F.min("doc_id").alias("low"))
    return member.join(lowest, "g", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("low", "doc_id").alias("component_id")
    )


def distinct_documents(docs: DataFrame, n: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """``docs`` (all columns) without near duplicates: of each component the smallest
    row by doc_id (null ones last) and text hash stays, repeated rows once."""
    row = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "t")
    member = stored(_members(docs, n, num, den).where("g is not null").select("g", row.alias("row")).distinct(), "members")
    first = member.groupBy("g").agg(F.min("row").alias("first"))
    gone = member.join(first, "g").where("row <> first").select(F.col("row.doc_id").alias("_id"), F.col("row.t").alias("_t")).distinct()
    rows = docs.withColumn("_text", F.xxhash64("text"))
    kept = rows.join(gone, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_text") == F.col("_t")), "left_anti")
    return kept.dropDuplicates(["doc_id", "_text"]).select(docs.columns)
