"""Exact top-k inner-product search by MaxScore.

A vector is a document whose terms are its dimensions; a query's term is worth
at most its weight times the extreme value of that dimension. Terms are split
by these bounds: the low ones whose bounds together cannot reach the k-th best
score so far are non-essential, so only the postings of the others bring
candidates. Candidates are scored term by term and leave as soon as the bounds
of what is left cannot lift them to that score.

Vectors and queries are dealt into blocks of bounded size; every query block
meets every vector block once, and the shards' lists are merged. Blocks are
copied for that, by a plan that Spark takes for as small as the vectors, so the
join is told to shuffle: broadcast, all copies would meet in the driver. Vectors that are null or hold null or non-finite components, or that
have no id, take no part. Rows sharing an id count as one (the smallest
vector). Shorter vectors count as padded with zeros. Components are expected
to keep scores within a long.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_arrow

VECTOR_BLOCK, QUERY_BLOCK = 4096, 4096
_STEP = 8


class Shard:
    """Vectors with impact-ordered postings per dimension."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.x = ids[order], x[order]
        self.low, self.high = self.x.min(0), self.x.max(0)
        self.posts = [None] * self.x.shape[1]

    def postings(self, t: int) -> np.ndarray:
        """Rows with a non-zero value in dimension t, by value."""
        if self.posts[t] is None:
            rows = np.flatnonzero(self.x[:, t])
            self.posts[t] = rows[np.argsort(self.x[rows, t], kind="stable")]
        return self.posts[t]

    def search(self, own: int, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best rows whose id is not ``own``."""
        terms = np.flatnonzero(q)
        bound = np.maximum(np.maximum(q[terms] * self.low[terms], q[terms] * self.high[terms]), 0)
        terms = terms[np.argsort(-bound, kind="stable")]
        bound = np.sort(bound)[::-1]
        left = np.concatenate([np.cumsum(bound[::-1])[::-1], np.zeros(1, bound.dtype)])
        floor = self._floor(own, q, terms, k)
        if floor is None or not len(terms) or floor <= 0:
            rows, first = np.arange(len(self.ids)), 0  # rows in no essential posting may still be among the best
        else:
            first = int(np.searchsorted(-left, -floor, "right"))  # left[first:] < floor: non-essential
            hit = np.zeros(len(self.ids), bool)
            for t in terms[:first]:
                hit[self.postings(t)] = True
            rows = np.flatnonzero(hit)
        got = np.zeros(len(rows), q.dtype)
        for a in range(0, len(terms), _STEP):
            pick = terms[a : a + _STEP]
            got = got + self.x[np.ix_(rows, pick)] @ q[pick]
            if floor is not None:
                on = got + left[min(a + _STEP, len(terms))] >= floor
                if not on.all():
                    rows, got = rows[on], got[on]
        on = self.ids[rows] != own
        rows, got = rows[on], got[on]
        best = np.lexsort((self.ids[rows], -got))[:k]
        return self.ids[rows[best]], got[best]

    def _floor(self, own: int, q: np.ndarray, terms: np.ndarray, k: int):
        """The k-th best score among the strongest postings of the top terms; None if there are too few."""
        rows = []
        for t in terms[:4]:
            p = self.postings(t)
            rows.append(p[-4 * k :] if q[t] > 0 else p[: 4 * k])
        rows = np.unique(np.concatenate(rows)) if rows else np.zeros(0, np.int64)
        rows = rows[self.ids[rows] != own]
        if len(rows) < k:
            return None
        return np.sort(self.x[rows] @ q)[-k]


def _matrix(values: bytes, n: int) -> np.ndarray:
    return np.frombuffer(values, np.float64).reshape(n, -1) if n else np.zeros((0, 0))


def _pack(vectors: DataFrame, size: int, total: int) -> DataFrame:
    """Rows (block, ids, values): blocks of about ``size`` vectors each."""
    n = max(1, -(-total // size))

    def pack(t: pa.Table) -> pa.Table:
        ids = t["vec_id"].to_numpy()
        rows = t["v"].combine_chunks()
        counts = np.diff(rows.offsets.to_numpy())
        flat = np.floor(256.0 * rows.flatten().to_numpy().astype(np.float64))
        wide = np.zeros((len(ids), int(counts.max(initial=0))))
        wide[np.arange(wide.shape[1]) < counts[:, None]] = flat
        return pa.table(
            {
                "block": pa.array([t["block"][0].as_py()], pa.int64()),
                "n": pa.array([len(ids)], pa.int64()),
                "ids": pa.array([ids.astype(np.int64).tobytes()], pa.binary()),
                "vals": pa.array([wide.tobytes()], pa.binary()),
            }
        )

    return (
        vectors.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(n)))
        .groupBy("block")
        .applyInArrow(pack, "block long, n long, ids binary, vals binary")
    )


def top_k(vectors: DataFrame, k: int = 5, every: int = 50) -> DataFrame:
    """(query_id, rank, vec_id, score): for each vector of (vec_id, embedding) whose
    id is divisible by ``every``, the k others with the largest inner product of
    floor(256 * component)."""
    fine = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    rows = (
        vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
        .where(F.col("vec_id").isNotNull() & F.col("v").isNotNull())
        .where(fine)
        .groupBy("vec_id")
        .agg(F.min("v").alias("v"))
    )
    asked = rows.where(F.pmod("vec_id", F.lit(every)) == 0)
    n, m = rows.count(), asked.count()
    left = _pack(rows, VECTOR_BLOCK, n)
    right = _pack(asked, QUERY_BLOCK, m)
    n_left, n_right = max(1, -(-n // VECTOR_BLOCK)), max(1, -(-m // QUERY_BLOCK))
    left = left.withColumn("q_block", F.explode(F.sequence(F.lit(0), F.lit(n_right - 1)).cast("array<long>")))
    right = right.select(
        F.col("block").alias("q_block"),
        F.col("n").alias("q_n"),
        F.col("ids").alias("q_ids"),
        F.col("vals").alias("q_vals"),
        F.explode(F.sequence(F.lit(0), F.lit(n_left - 1)).cast("array<long>")).alias("block"),
    )

    def search(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for r in b.to_pylist():
            ids, x = np.frombuffer(r["ids"], np.int64), _matrix(r["vals"], r["n"])
            own, q = np.frombuffer(r["q_ids"], np.int64), _matrix(r["q_vals"], r["q_n"])
            d = min(x.shape[1], q.shape[1])
            x, q = x[:, :d], q[:, :d]
            if d and np.abs(x).max(initial=0) * np.abs(q).max(initial=0) * d >= 2**53:
                x, q = x.astype(np.int64), q.astype(np.int64)
            shard = Shard(ids, x)
            found = [shard.search(int(i), v, k) for i, v in zip(own, q)]
            yield pa.RecordBatch.from_pydict(
                {
                    "query_id": pa.array(np.repeat(own, [len(f[0]) for f in found])),
                    "vec_id": pa.array(np.concatenate([np.zeros(0, np.int64), *(f[0] for f in found)])),
                    "score": pa.array(np.concatenate([np.zeros(0), *(f[1] for f in found)]).astype(np.int64)),
                }
            )

    pairs = left.hint("merge").join(right.hint("merge"), ["block", "q_block"])
    found = map_arrow(pairs, search, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
    )
