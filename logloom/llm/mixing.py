"""Mixing documents so that domains' expected token totals meet target weights.

A classifier learnt from a labelled table says how much of each document belongs
to each domain: the mean over its words of P(domain | word) (hashed words, add-one
counts, equal priors). Projected-gradient least squares then fits nonnegative
document rates r, from rates of 1 on, that minimise

    1/2 (total(r) - target)' W (total(r) - target),  total(r) = sum_d n_d/N r_d p_d

with n_d words and posterior p_d of document d, N words in all, and W the inverse of
sum_d n_d/N p_d p_d' (plus RIDGE), which makes 1 the right step length and a rare
domain's miss count as much as a common one's. A step adds p_d . push to every rate
and sets negative ones to 0; the push, -W (total - target), is one number per domain.
Steps carry momentum, dropped whenever the value rises.

The corpus sends totals per domain. Rates are not kept between steps: a rate follows
from the posterior and the list of pushes, so a lost executor costs only its own rows.
Steps go on until the totals are within ``CLOSE`` of the targets; targets that no
rates meet are neared until steps gain next to nothing (``PATIENCE``, ``GAIN``),
``Mix.residual`` says by how much they are missed, and a warning is given.

Rows: null or empty texts have no words, rate 1 and even posteriors; repeated
rows count each. Without labelled rows there is one domain, "".
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, stored
from .text import parts, word_hashes

BITS = 17
#: At most so many labelled rows are learnt from, those with the smallest hash of doc_id.
MAX_TRAIN = 20_000
#: CLOSE is of the share of tokens; RIDGE is for domains that no document tells apart.
RIDGE, STEPS, CLOSE = 1e-6, 200, 2e-3
#: Fitting ends if this many steps lower the value by less than this share.
PATIENCE, GAIN = 10, 1e-2


@dataclass
class Mix:
    """Classifier and fitted rates."""

    domains: list[str]
    share: np.ndarray  # P(domain | word bucket), a row per bucket
    target: np.ndarray = field(default_factory=lambda: np.zeros(0))  # of the tokens, sums to 1
    #: Steps taken: the push of each domain, then the momentum that follows.
    steps: list[tuple[np.ndarray, float]] = field(default_factory=list)
    residual: float = 0.0  # largest difference of expected and target share

    def posteriors(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(words, posterior) of each text of a slice."""
        h, n = word_hashes(data, off)
        k = len(self.domains)
        row = np.repeat(np.arange(len(n)), n)
        bucket = (h >> np.uint64(64 - BITS)).astype(np.int64)
        p = np.stack([np.bincount(row, self.share[bucket, d], len(n)) for d in range(k)], 1)
        return n, np.where(n[:, None] > 0, p / np.maximum(n, 1)[:, None], 1 / k)

    def walked(self, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rates of documents by their posteriors, and where the next step starts."""
        rate = start = np.ones(len(p))
        for push, momentum in self.steps:
            new = np.maximum(start + p @ push, 0)
            start = new + momentum * (new - rate)
            rate = new
        return rate, start

    def rates(self, p: np.ndarray) -> np.ndarray:
        return self.walked(p)[0]


def classifier(docs: DataFrame, labelled: DataFrame, max_train: int = MAX_TRAIN) -> Mix:
    """From texts of docs (doc_id, text) whose doc_id has a domain in labelled (doc_id, domain)."""
    chosen = (
        labelled.where("doc_id is not null and domain is not null")
        .groupBy("doc_id")
        .agg(F.min(F.col("domain").cast("string")).alias("domain"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(max_train)
    )

    def run(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        names = np.array(b.column("domain").to_pylist(), object)
        for i, data, off in parts(b.column("text")):
            h, n = word_hashes(data, off)
            row = np.repeat(np.arange(len(n)), n)
            bucket = (h >> np.uint64(64 - BITS)).astype(np.int64)
            for name in np.unique(names[i : i + len(n)]):
                u, c = np.unique(bucket[(names[i : i + len(n)] == name)[row]], return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(u), pa.string()), pa.array(u, pa.int64()), pa.array(c.astype(np.int64))], ["domain", "b", "c"]
                )

    # both bounded: max_train ids are broadcast, one row per domain and bucket is collected
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("domain", "text")
    got = map_arrow(rows, run, "domain string, b long, c long").groupBy("domain", "b").agg(F.sum("c").alias("c")).toArrow()
    names = sorted(set(got["domain"].to_pylist())) or [""]
    counts = np.ones((1 << BITS, len(names)))
    at = np.array([names.index(d) for d in got["domain"].to_pylist()], np.int64)
    np.add.at(counts, (got["b"].to_numpy(), at), got["c"].to_numpy())
    share = counts / counts.sum(0)
    return Mix(names, share / share.sum(1, keepdims=True))


def fit(docs: DataFrame, labelled: DataFrame, weights: dict[str, float] | None = None) -> Mix:
    """Classify, then fit rates to the weights of the domains (even, if none are given)."""
    m = classifier(docs, labelled)
    want = np.array([1.0 if weights is None else weights.get(d, 0.0) for d in m.domains])
    m.target = want / want.sum()
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(m)
    k = len(m.domains)

    def narrow(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for _, data, off in parts(b.column("text")):
            n, p = shared.value.posteriors(data, off)
            yield pa.RecordBatch.from_arrays(
                [pa.array(n), *(pa.array(p[:, d].astype(np.float32)) for d in range(k))], ["n", *(f"p{d}" for d in range(k))]
            )

    schema = "n long, " + ", ".join(f"p{d} float" for d in range(k))
    table = stored(map_arrow(docs.select("text"), narrow, schema), "posteriors")

    def summed(make) -> np.ndarray:
        """Sums over all rows of what make(words, posteriors) gives."""

        def totals(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            p = np.stack([b.column(f"p{d}").to_numpy() for d in range(k)], 1).astype(float)
            v = make(b.column("n").to_numpy().astype(float), p)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(v))), pa.array(v)], ["i", "v"])

        got = map_arrow(table, totals, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).orderBy("i").toArrow()
        return got["v"].to_numpy()

    first = summed(lambda n, p: np.concatenate([[n.sum()], p.T @ n, (p.T @ (p * n[:, None])).ravel()]))
    if not len(first) or not first[0]:
        return m
    words = first[0]
    metric = np.linalg.inv(first[1 + k :].reshape(k, k) / words + RIDGE * np.eye(k))
    total = start = first[1 : 1 + k] / words  # of the rates, and of where the next step starts
    run, values = 0, [(total - m.target) @ metric @ (total - m.target)]
    while np.abs(total - m.target).max() >= CLOSE and len(m.steps) < STEPS:
        m.steps.append((-metric @ (start - m.target), run / (run + 3)))
        sent = spark.sparkContext.broadcast(m)

        def both(n: np.ndarray, p: np.ndarray) -> np.ndarray:
            rate, begin = sent.value.walked(p)
            return np.concatenate([p.T @ (n * rate), p.T @ (n * begin)])

        total, start = summed(both).reshape(2, k) / words
        values.append((total - m.target) @ metric @ (total - m.target))
        run += 1
        if values[-1] > values[-2]:  # momentum leads astray: the next step starts from the rates themselves
            m.steps[-1] = (m.steps[-1][0], 0.0)
            run, start = 0, total
        if len(values) > PATIENCE and min(values[-PATIENCE:]) > (1 - GAIN) * min(values[:-PATIENCE]):
            break  # nothing is nearer
    m.residual = float(np.abs(total - m.target).max())
    if m.residual >= CLOSE:
        got = ", ".join(f"{d} {x:.3f} of {t:.3f}" for d, x, t in zip(m.domains, total, m.target))
        warnings.warn(f"no rates meet the target shares: {got}", stacklevel=2)
    return m


def rated(docs: DataFrame, m: Mix) -> DataFrame:
    """(all columns of docs, n_words, posterior, rate, copies): copies is the rate
    rounded up or down by a hash of doc_id and text, so it has the rate as its mean."""
    names = docs.columns
    shared = docs.sparkSession.sparkContext.broadcast(m)
    kept = ["_n_words", "_posterior", "_rate"]

    def run(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for i, data, off in parts(b.column("text")):
            n, p = shared.value.posteriors(data, off)
            rate = shared.value.rates(p.astype(np.float32).astype(float))
            rate[n == 0] = 1.0
            part = b.slice(i, len(n))
            yield pa.RecordBatch.from_arrays(
                [*part.columns, pa.array(n), pa.array(p.tolist(), pa.list_(pa.float64())), pa.array(rate)], [*names, *kept]
            )

    schema = docs.withColumns({"_n_words": F.lit(0).cast("long"), "_posterior": F.array().cast("array<double>"), "_rate": F.lit(0.0)}).schema
    draw = F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 11) / F.lit(float(1 << 53))
    return map_arrow(docs, run, schema).withColumn("_copies", F.floor(F.col("_rate") + draw).cast("long"))


def mixed(docs: DataFrame, m: Mix) -> DataFrame:
    """``docs`` (all columns) with every row as often as its rate says."""
    again = F.explode(F.expr("array_repeat(1, cast(_copies as int))"))
    return rated(docs, m).withColumn("_again", again).select(docs.columns)
