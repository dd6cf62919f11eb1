"""Toxicity scores from a factorization machine over hashed terms.

A text's terms are its distinct lower-cased words and their prefixes, hashed
into ``2**BITS`` buckets. Linear weights add up single terms; a short factor
vector per term adds a weight for every pair of terms in a text, so that two
terms which are harmless alone can count together.

Terms enter the model in two looks at the training rows: those that differ
between the classes, and those that differ among rows holding a strongly toxic
term (the other halves of telling pairs). Both looks are Spark aggregates.

Rows: null text counts as empty; an empty text scores the model's base rate;
repeated rows score alike; without usable labels every score is 0.5.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, ragged, stored

BITS = 20
PREFIXES = (3, 4, 5, 6)
#: At most so many labelled rows are fitted, those with the smallest hash of doc_id.
MAX_TRAIN = 20_000
#: At most so many terms enter the model, the most telling first.
MAX_TERMS = 4_096
Z_TERM, Z_STRONG = 4.5, 8.0
_WORD = re.compile(r"[^\W_]+")
#: Words whose terms a task remembers.
_CACHE = 100_000


def terms(word: str) -> list[int]:
    """Buckets of a word and of its proper prefixes."""
    raw = [word] + [f"{word[:k]}*" for k in PREFIXES if len(word) > k]
    return [zlib.crc32(t.encode()) >> (32 - BITS) for t in raw]


def words(text: str | None) -> set[str]:
    return set(_WORD.findall(text.lower())) if text else set()


@dataclass
class Model:
    """Bias, linear weights and factors of the terms by bucket."""

    bias: float
    buckets: np.ndarray
    weight: np.ndarray
    factor: np.ndarray

    def scores(self, rows: list[np.ndarray]) -> np.ndarray:
        """Probability for each row, given as distinct positions into ``buckets``."""
        counts = np.array([len(r) for r in rows], np.int64)
        at = np.repeat(np.arange(len(rows)), counts)
        idx = np.concatenate([np.zeros(0, np.int64), *rows]).astype(np.int64)
        return 1 / (1 + np.exp(-_raw(self, at, idx, len(rows))))


def _raw(m: Model, at: np.ndarray, idx: np.ndarray, n: int) -> np.ndarray:
    v = m.factor[idx]
    pair = sum(
        np.bincount(at, v[:, f], n) ** 2 - np.bincount(at, v[:, f] ** 2, n) for f in range(m.factor.shape[1])
    )
    return np.clip(m.bias + np.bincount(at, m.weight[idx], n) + 0.5 * pair, -40, 40)


def fit(
    rows: list[np.ndarray],
    label: np.ndarray,
    buckets: np.ndarray,
    rank: int = 4,
    epochs: int = 30,
    rate: float = 0.15,
    decay: float = 1e-4,
    seed: int = 7,
) -> Model:
    """Fit by mini-batch AdaGrad on logistic loss; rows hold positions into ``buckets``."""
    rng, n, k = np.random.default_rng(seed), len(rows), len(buckets)
    prior = (label.sum() + 1) / (n + 2)
    m = Model(float(np.log(prior / (1 - prior))), buckets, np.zeros(k), rng.normal(0, 0.05, (k, rank)))
    if not n or not 0 < label.sum() < n:
        m.factor[:] = 0
        return m
    gw, gv, gb = np.full(k, 1e-2), np.full((k, rank), 1e-2), 1e-2
    for _ in range(epochs):
        for pick in np.array_split(rng.permutation(n), max(1, n // 256)):
            batch = [rows[i] for i in pick]
            at = np.repeat(np.arange(len(batch)), [len(r) for r in batch])
            idx = np.concatenate([np.zeros(0, np.int64), *batch]).astype(np.int64)
            err = (1 / (1 + np.exp(-_raw(m, at, idx, len(batch)))) - label[pick]) / len(batch)
            gb += err.sum() ** 2
            m.bias -= rate * err.sum() / np.sqrt(gb)
            if not len(idx):
                continue
            sums = np.stack([np.bincount(at, m.factor[idx, f], len(batch)) for f in range(rank)], 1)
            e = err[at]
            uniq, inv = np.unique(idx, return_inverse=True)
            dw = np.bincount(inv, e) + decay * m.weight[uniq]
            dv = (
                np.stack([np.bincount(inv, e * (sums[at, f] - m.factor[idx, f])) for f in range(rank)], 1)
                + decay * m.factor[uniq]
            )
            gw[uniq] += dw**2
            gv[uniq] += dv**2
            m.weight[uniq] -= rate * dw / np.sqrt(gw[uniq])
            m.factor[uniq] -= rate * dv / np.sqrt(gv[uniq])
    return m


def _z(pos: np.ndarray, neg: np.ndarray, n_pos: int, n_neg: int) -> np.ndarray:
    """How far a term's rate differs between the classes, in standard errors."""
    n, both = n_pos + n_neg, pos + neg
    p = both / max(n, 1)
    err = np.sqrt(np.maximum(p * (1 - p), 1e-9) * (1 / max(n_pos, 1) + 1 / max(n_neg, 1)))
    return (pos / max(n_pos, 1) - neg / max(n_neg, 1)) / err


def _rates(rows: DataFrame, strong: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """z of every bucket over the training rows that hold a strong bucket (all, if none is given)."""

    def count(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        y = b.column("toxic").to_numpy(zero_copy_only=False)
        flat, off = b.column("terms").flatten().to_numpy(), np.diff(b.column("terms").offsets.to_numpy())
        at = np.repeat(np.arange(len(y)), off)
        use = np.bincount(at[np.isin(flat, strong)], minlength=len(y)) > 0 if len(strong) else np.ones(len(y), bool)
        u, inv = np.unique(flat[use[at]], return_inverse=True)
        pos = np.bincount(inv, y[at][use[at]], len(u))
        all_ = np.bincount(inv, minlength=len(u))
        key = np.concatenate([u, [-1]])
        yield pa.RecordBatch.from_pydict(
            {
                "bucket": pa.array(key, pa.int64()),
                "pos": pa.array(np.concatenate([pos, [y[use].sum()]]).astype(np.int64)),
                "n": pa.array(np.concatenate([all_, [use.sum()]]).astype(np.int64)),
            }
        )

    got = (
        map_arrow(rows, count, "bucket long, pos long, n long")
        .groupBy("bucket")
        .agg(F.sum("pos").alias("pos"), F.sum("n").alias("n"))
        .where("bucket < 0 or n >= 5")
        .toArrow()
    )
    key, pos, n = (got[c].to_numpy() for c in ("bucket", "pos", "n"))
    if not (key < 0).any():
        return np.zeros(0, np.int64), np.zeros(0)
    n_pos, n_all = int(pos[key < 0][0]), int(n[key < 0][0])
    on = key >= 0
    return key[on], _z(pos[on], n[on] - pos[on], n_pos, n_all - n_pos)


def train(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, max_terms: int = MAX_TERMS) -> Model:
    """Fit on documents with a label (doc_id, toxic): the ``max_train`` with the smallest hash."""
    chosen = (
        labels.where("doc_id is not null and toxic is not null")
        .groupBy("doc_id")
        .agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(max_train)
    )

    def take(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[int, ...]] = {}
        found = []
        for x in b.column("text"):
            hits: set[int] = set()
            for w in words(x.as_py()):
                got = known.get(w)
                if got is None:
                    if len(known) > _CACHE:
                        known.clear()
                    got = known[w] = tuple(terms(w))
                hits.update(got)
            found.append(np.array(sorted(hits), np.int32))
        flat = np.concatenate([np.zeros(0, np.int32), *found])
        yield pa.RecordBatch.from_pydict(
            {
                "doc_id": b.column("doc_id"),
                "toxic": b.column("toxic"),
                "terms": ragged(flat, np.array([len(x) for x in found], np.int64), pa.int32()),
            }
        )

    # the sample's size is bounded by max_train, so it may be broadcast
    rows = stored(
        map_arrow(
            docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id"),
            take,
            "doc_id long, toxic int, terms array<int>",
        ),
        "toxic-train",
    )
    key, z = _rates(rows, np.zeros(0, np.int64))
    strong = key[z >= Z_STRONG]
    telling = dict(zip(key.tolist(), np.abs(z).tolist()))
    if len(strong):
        key2, z2 = _rates(rows, strong)
        for b, v in zip(key2.tolist(), np.abs(z2).tolist()):
            telling[b] = max(v, telling.get(b, 0))
    picked = sorted((b for b, v in telling.items() if v >= Z_TERM), key=lambda b: (-telling[b], b))[:max_terms]
    buckets = np.array(sorted(picked), np.int64)

    def shrink(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        flat, off = b.column("terms").flatten().to_numpy(), b.column("terms").offsets.to_numpy()
        on = np.isin(flat, buckets)
        counts = np.diff(np.concatenate([[0], np.cumsum(on)])[off])
        at = np.searchsorted(buckets, flat[on])
        yield pa.RecordBatch.from_pydict(
            {"doc_id": b.column("doc_id"), "toxic": b.column("toxic"), "terms": ragged(at, counts, pa.int32())}
        )

    # at most max_train rows of at most max_terms numbers
    small = map_arrow(rows, shrink, "doc_id long, toxic int, terms array<int>").toArrow().sort_by("doc_id")
    found = [np.asarray(x, np.int64) for x in small["terms"].to_pylist()]
    return fit(found, small["toxic"].to_numpy().astype(float), buckets)


def score(docs: DataFrame, model: Model, into: str = "score") -> DataFrame:
    """All columns of ``docs`` with the score in column ``into`` (replaced, if there); reads ``text``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = docs.drop(into)
    schema = kept.withColumn(into, F.lit(0.0)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        place = {int(b): i for i, b in enumerate(m.buckets)}
        cache: dict[str, tuple[int, ...]] = {}
        for b in batches:
            rows = []
            for x in b.column("text"):
                hits: set[int] = set()
                for w in words(x.as_py()):
                    got = cache.get(w)
                    if got is None:
                        if len(cache) > _CACHE:
                            cache.clear()
                        got = cache[w] = tuple(place[t] for t in terms(w) if t in place)
                    if got:
                        hits.update(got)
                rows.append(np.array(sorted(hits), np.int64))
            yield b.append_column(pa.field(into, pa.float64()), pa.array(m.scores(rows)))

    return kept.mapInArrow(run, schema)
