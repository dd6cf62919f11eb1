"""Packing documents into token sequences along a space-filling curve.

A document's words are hashed; their signs project it to ``DIMS`` numbers, its
place on a Hilbert curve over them is its key. Documents are range-sorted by
key, so each partition holds a stretch of the curve, and their ids are laid end
to end and cut every ``SIZE``. What is left of a partition is cut into powers of
two, so that no sequence needs padding.

Rows: null text is empty; an empty text has the end id alone; equal keys are
ordered by doc_id and text, repeated rows follow one another and are packed each.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import mix, parts, word_hashes
from .tokens import Encoder

SIZE = 1024
END = 0
DIMS, BITS = 4, 10
_U = np.uint64


def places(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """A row of DIMS numbers in [0, 2**BITS) for each text."""
    h, counts = word_hashes(data, off)
    out = np.zeros((len(counts), DIMS))
    row = np.repeat(np.arange(len(counts)), counts)
    for d in range(DIMS):
        sign = ((h >> _U(11 + 13 * d)) & _U(1)).astype(np.float64) * 2 - 1
        out[:, d] = np.bincount(row, sign, len(counts))
    out /= np.sqrt(np.maximum(counts, 1))[:, None]
    # about normal: spread evenly by the logistic approximation of its distribution
    return np.minimum((1 << BITS) / (1 + np.exp(-1.702 * out)), (1 << BITS) - 1).astype(np.int64)


def hilbert(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Index along the Hilbert curve of rows of integers of ``bits`` bits
    (Skilling's transposition: undo excess work, then Gray-code, then interleave)."""
    x = points.T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            on = (x[i] & q) > 0
            swap = np.where(on, 0, (x[0] ^ x[i]) & p)
            x[0] ^= np.where(on, p, 0) ^ swap
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t ^= np.where((x[n - 1] & q) > 0, q - 1, 0)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def along_curve(docs: DataFrame, partitions: int) -> DataFrame:
    """(doc_id, text) of all rows, range-partitioned and sorted by place on the curve."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = [hilbert(places(data, off)) for _, data, off in parts(b.column("text"))]
            if keys:
                yield b.append_column("curve", pa.array(np.concatenate(keys)))

    keyed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(
        run, "doc_id long, text string, curve long"
    )
    order = ["curve", "doc_id", "h"]
    return (
        keyed.withColumn("h", F.xxhash64("text"))
        .repartitionByRange(partitions, *order)
        .sortWithinPartitions(*order)
        .select("doc_id", "text")
    )


class Sequences:
    """Cuts a stream of documents' ids into sequences, with numbers from ``first`` on."""

    def __init__(self, first: int):
        self.number, self.held, self.open = first, 0, []

    def _row(self, doc_id, start: int, ids: np.ndarray, total: int, offset: int) -> tuple:
        return (doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), total, self.number, offset, ids)

    def add(self, doc_id, ids: np.ndarray) -> Iterator[tuple]:
        """Rows of the sequences that this document fills."""
        at = 0
        while at < len(ids):
            piece = ids[at : at + SIZE - self.held]
            self.open.append((doc_id, at, piece, len(ids)))
            at += len(piece)
            self.held += len(piece)
            if self.held == SIZE:
                yield from self._cut(SIZE)

    def _cut(self, size: int) -> Iterator[tuple]:
        """The first ``size`` open ids as one sequence."""
        offset = 0
        while offset < size:
            doc_id, start, ids, total = self.open.pop(0)
            now = ids[: size - offset]
            if len(now) < len(ids):
                self.open.insert(0, (doc_id, start + len(now), ids[len(now) :], total))
            yield self._row(doc_id, start, now, total, offset)
            offset += len(now)
        self.held -= size
        self.number += 1

    def rest(self) -> Iterator[tuple]:
        """What is open, in sequences of powers of two."""
        while self.held:
            yield from self._cut(1 << (self.held.bit_length() - 1))


def pack(docs: DataFrame, path: str | None = None, partitions: int | None = None, ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id,
    offset and, if asked for, its ids. ``path``: the vocabulary (byte-level BPE)."""
    spark = docs.sparkSession
    partitions = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]
    schema = ", ".join(f"{n} long" for n in names[:7]) + ", ids array<int>"
    kinds = [pa.int64()] * 7
    if not ids:
        names, schema = names[:7], schema.removesuffix(", ids array<int>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path)
        out = Sequences(TaskContext.get().partitionId() << 33)
        rows: list[tuple] = []

        def batch() -> pa.RecordBatch:
            cols = list(zip(*rows))
            arrays = [pa.array(c, k) for c, k in zip(cols, kinds)]
            if ids:
                arrays.append(pa.array([x.tolist() for x in cols[7]], pa.list_(pa.int32())))
            rows.clear()
            return pa.RecordBatch.from_arrays(arrays, names)

        for b in batches:
            for doc_id, found in zip(b.column("doc_id").to_pylist(), encoder.texts(b.column("text"))):
                rows.extend(out.add(doc_id, np.append(found, np.int32(END))))
                if len(rows) > 4000:
                    yield batch()
        rows.extend(out.rest())
        if rows:
            yield batch()

    return along_curve(docs, partitions).mapInArrow(run, schema)
