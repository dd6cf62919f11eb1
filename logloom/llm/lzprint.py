"""Document fingerprints from Lempel-Ziv phrases.

A text is parsed into dictionary phrases (each the longest known phrase plus
one byte), the phrases' hashes form a set, and the ``K`` smallest make the
fingerprint. The likeness of two fingerprints is the share of common hashes
among the smallest of their union: an estimate of the phrase sets' Jaccard
similarity, high for texts that would compress each other well. With at most
``K`` phrases in the union it is exact; two empty texts are alike (1.0).

``edited_prints`` also fingerprints each document's edited text, made from it
and from the next document by (doc_id, hash of the text); null ids come first,
null texts are empty, repeated rows follow one another. After the last row
comes the first.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import mix

K = 64
#: Code points whose fingerprints are computed together.
FLUSH = 500_000
_U = np.uint64


class Phrases:
    """A Lempel-Ziv parse in progress."""

    def __init__(self) -> None:
        self.known: dict[int, int] = {}
        self.node = 0

    def copy(self) -> Phrases:
        new = Phrases()
        new.known, new.node = self.known.copy(), self.node
        return new

    def feed(self, data: bytes) -> None:
        """Go on parsing; keys are (phrase so far, byte), values the longer phrase."""
        known, node = self.known, self.node
        get, new = known.get, (len(known) + 1) << 8
        for c in data:
            node |= c
            longer = get(node)
            if longer is None:
                known[node] = new
                new += 256
                node = 0
            else:
                node = longer
        self.node = node

    def keys(self) -> np.ndarray:
        return np.fromiter(self.known, np.int64, len(self.known))


def smallest(parses: list[np.ndarray]) -> list[np.ndarray]:
    """For each parse (the keys of its phrases): the K smallest distinct hashes
    of the phrases' bytes. A phrase begun at a text's end is known already."""
    counts = np.array([len(p) for p in parses], np.int64)
    if not counts.sum():
        return [np.zeros(0, _U) for _ in parses]
    keys = np.concatenate(parses)
    doc = np.repeat(np.arange(len(parses)), counts)
    base = np.repeat(np.cumsum(counts) - counts, counts)
    parent, byte = keys >> 8, (keys & 255).astype(_U) + _U(1)
    up = np.where(parent > 0, base + parent - 1, len(keys))
    hashes = np.zeros(len(keys) + 1, _U)
    hashes[-1] = _U(0x243F6A8885A308D3)
    done = np.zeros(len(keys) + 1, bool)
    done[-1] = True
    todo = np.arange(len(keys))
    while len(todo):
        now = done[up[todo]]
        at = todo[now]
        hashes[at] = mix(hashes[up[at]] * _U(0x9E3779B97F4A7C15) + byte[at])
        done[at] = True
        todo = todo[~now]
    ranked = np.unique((doc.astype(_U) << _U(32)) | (hashes[:-1] >> _U(32)))
    bounds = np.searchsorted(ranked >> _U(32), np.arange(len(parses) + 1).astype(_U))
    low = ranked & _U(0xFFFFFFFF)
    return [low[i : min(i + K, j)] for i, j in zip(bounds[:-1], bounds[1:])]


class Print:
    """A fingerprint that is computed together with others (see ``settle``)."""

    def __init__(self, parse: Phrases):
        self.parse, self.low = parse.keys(), np.zeros(0, _U)


def settle(waiting: list[Print]) -> None:
    for p, low in zip(waiting, smallest([p.parse for p in waiting])):
        p.low, p.parse = low, np.zeros(0, np.int64)
    waiting.clear()


def fingerprint(data: bytes) -> np.ndarray:
    p = Phrases()
    p.feed(data)
    return smallest([p.keys()])[0]


def text_of(print_: np.ndarray) -> str:
    return "".join(f"{int(v):08x}" for v in print_)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    both = np.union1d(a, b)[:K]
    if not len(both):
        return 1.0
    return float(np.isin(both, np.intersect1d(a, b, True)).mean())


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint) of every row of (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            prints = [text_of(fingerprint((x.as_py() or "").encode())) for x in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(prints, pa.string())], ["doc_id", "fingerprint"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fingerprint string")


def in_order(docs: DataFrame, parts: int) -> DataFrame:
    """Rows (b, o, doc_id, text) dealt so that each b holds a range of documents,
    sorted, and, as its last row (o > 0), the document after that range."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    ids = rows.select("doc_id").where("doc_id is not null")
    cuts = sorted({int(c) for c in ids.approxQuantile("doc_id", [i / parts for i in range(1, parts)], 0.2 / parts)}) if parts > 1 else []
    # b: how many cuts are at or below the id
    cut = F.array(*[F.lit(c) for c in cuts]) if cuts else F.array().cast("array<long>")
    b = F.coalesce(F.size(F.filter(cut, lambda c: c <= F.col("doc_id"))), F.lit(0)).cast("long")
    keyed = rows.withColumn("b", b).withColumn("h", F.xxhash64("text"))
    # one row for each range, so at most ``parts`` rows reach the driver and are broadcast
    firsts = (
        keyed.groupBy("b")
        .agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("set"), "doc_id", "h")).alias("f"))
        .select("b", "f.doc_id", "f.h")
        .orderBy("b")
        .collect()
    )
    # the first document of each range goes to the range before as well, the very first to the last
    peeks = [(r.b, r.doc_id, r.h, firsts[i - 1].b) for i, r in enumerate(firsts)]
    peek = docs.sparkSession.createDataFrame(peeks, "b long, p long, h long, before long")
    same = (keyed.b == peek.b) & keyed.doc_id.eqNullSafe(peek.p) & (keyed.h == peek.h)
    again = keyed.join(F.broadcast(peek), same).select(peek.before.alias("b"), F.lit(1).alias("o"), "doc_id", "text", keyed.h)
    return keyed.select("b", F.lit(0).alias("o"), "doc_id", "text", "h").unionByName(again)


def edited_prints(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """Per document of (doc_id, text): n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited and near_next. The edited text has the last
    floor(n_chars / 2) code points replaced by the first as many (or all) of the next."""
    spark = docs.sparkSession
    parts = parts or 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = min(parts, 4096)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # (b, doc_id, n_chars, print, text before the edit, its parse) of the row before
        waiting: list[Print] = []
        records: list[tuple] = []

        def flush() -> Iterator[pa.RecordBatch]:
            settle(waiting)
            rows = [
                (own, n, sha, text_of(a.low), text_of(e.low), likeness(a.low, e.low), likeness(a.low, x.low))
                for own, n, sha, a, e, x in records
            ]
            records.clear()
            if rows:
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

        held = 0
        for batch in batches:
            for b, o, doc_id, text in zip(*(batch.column(c) for c in ("b", "o", "doc_id", "text"))):
                b, o, doc_id, text = b.as_py(), o.as_py(), doc_id.as_py(), text.as_py()
                after = last is not None and last[0] == b
                if o and not after:
                    continue
                n = len(text)
                keep = text[: n - n // 2]
                half = Phrases()
                half.feed(keep.encode())
                full = half.copy()
                full.feed(text[n - n // 2 :].encode())
                now = (b, doc_id, n, Print(full), keep, half)
                waiting.append(now[3])
                if after:
                    _, own, m, print_, kept, parse = last
                    tail = text[: m // 2].encode()
                    parse.feed(tail)
                    edited = Print(parse)
                    waiting.append(edited)
                    records.append((own, m, hashlib.sha256(kept.encode() + tail).hexdigest(), print_, edited, now[3]))
                last = None if o else now
                held += n
                if held > FLUSH:
                    yield from flush()
                    held = 0
        yield from flush()

    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = ("long", "long", "string", "string", "string", "double", "double")
    rows = in_order(docs, parts)
    dealt = rows.repartition(parts, "b").sortWithinPartitions("b", "o", F.asc_nulls_first("doc_id"), "h")
    return dealt.select("b", "o", "doc_id", "text").mapInArrow(run, ", ".join(f"{n} {k}" for n, k in zip(names, kinds)))
