"""Removal of long repeated byte strings, found with suffix arrays.

Every byte covered by a string of ``LENGTH`` bytes that also starts anywhere
else (any text, or the same one) goes. Strings are judged on the input.

1. Anchors: a position whose 16-byte hash is the smallest of some window of 128
   positions (leftmost on ties). A string's anchor is the first one 127 or more
   bytes into it; whether a position there is an anchor depends on the string
   alone, so equal strings have equal anchors at equal places. All strings of
   one anchor hold the 273 bytes around it: its key. Strings whose key occurs
   once are unique; most of the corpus leaves here.
2. An anchor's unit is all bytes its strings cover. A unit that occurs twice is
   repeated as a whole. Else its strings are compared with the other units of
   the same key: the key shrinks to one symbol, the bytes left and right of it
   to the stretches between which the key's units part ways, so that every
   string becomes a fixed number of symbols. A suffix array of the units of
   many keys (``suffixsort``) brings equal strings next to each other.
   Keys with more than ``MAX_UNITS`` different units would make hot tasks; their
   strings are hashed and counted instead, which gives the same.

Rows: null text is empty; texts under LENGTH bytes lose nothing; repeated rows
repeat each other's strings.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BitFilter, map_arrow, ragged, stored
from .suffixsort import suffix_array
from .text import Rolling, mix, parts

LENGTH = 400
_GRAM, _WINDOW = 16, 128
_BEFORE, _AFTER = _WINDOW - 1, LENGTH - 2 * _WINDOW + 2  # of an anchor, in all of its strings
_SLACK = LENGTH - _BEFORE - _AFTER  # bytes of a string outside the key
MAX_UNITS = 128
#: Symbols sorted at once.
SORT = 200_000
_U = np.uint64


def anchors(data: np.ndarray, off: np.ndarray, rolling: Rolling) -> np.ndarray:
    """Positions of the anchors of the texts of a slice, ascending."""
    n = len(data) - _GRAM + 1
    if n < _WINDOW:
        return np.zeros(0, np.int64)
    at = np.arange(n)
    order = (rolling.of(at, at + _GRAM) >> _U(32) << _U(32)) | at.astype(_U)
    whole = -(-n // _WINDOW) * _WINDOW
    blocks = np.full(whole, np.iinfo(_U).max, _U)
    blocks[:n] = order
    blocks = blocks.reshape(-1, _WINDOW)
    left = np.minimum.accumulate(blocks, axis=1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    low = np.minimum(right[: n - _WINDOW + 1], left[_WINDOW - 1 : n])
    row = np.searchsorted(off, at[: n - _WINDOW + 1], "right")
    inside = at[: n - _WINDOW + 1] + _WINDOW + _GRAM - 1 <= off[np.minimum(row, len(off) - 1)]
    picked = low[inside] & _U(0xFFFFFFFF)
    if not len(picked):
        return np.zeros(0, np.int64)
    return picked[np.concatenate([[True], picked[1:] != picked[:-1]])].astype(np.int64)


def units(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, ...]:
    """Per anchor with strings: its row, place, first and last string start (from the row's start), key and unit hash."""
    rolling = Rolling(data)
    p = anchors(data, off, rolling)
    row = np.searchsorted(off, p, "right") - 1
    first, stop = off[row], off[row + 1]
    prev = np.concatenate([[-1], p[:-1]])
    lo = np.where(prev >= first, prev - _BEFORE + 1, first)
    lo = np.maximum(lo, first)
    hi = np.minimum(p - _BEFORE, stop - LENGTH)
    on = hi >= lo
    p, row, first, lo, hi = p[on], row[on], first[on], lo[on], hi[on]
    key = rolling.of(p - _BEFORE, p + _AFTER)
    unit = mix(rolling.of(lo, hi + LENGTH) + (p - lo).astype(_U))
    return row, p - first, lo - first, hi - first, key, unit


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", text.alias("text"), F.xxhash64("doc_id", text).alias("r"))


def _units(docs: DataFrame) -> DataFrame:
    """Per text row (r): its anchors' places, strings, keys and unit hashes."""

    def run(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for i, data, off in parts(b.column("text")):
            row, p, lo, hi, key, unit = units(data, off)
            counts = np.bincount(row, minlength=len(off) - 1)
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("r").slice(i, len(counts)),
                    *(ragged(x, counts, pa.int32()) for x in (p, lo, hi)),
                    *(ragged(x.view(np.int64), counts, pa.int64()) for x in (key, unit)),
                ],
                ["r", "p", "lo", "hi", "key", "unit"],
            )

    rows = map_arrow(
        docs.select("r", "text"),
        run,
        "r long, p array<int>, lo array<int>, hi array<int>, key array<long>, unit array<long>",
    )
    return rows.where(F.size("p") > 0)


def _lcp(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    lo, hi = 0, min(len(a), len(b))
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid - 1
    return lo


class Batch:
    """Units of many keys, written as symbols; one suffix array finds the repeated strings."""

    def __init__(self) -> None:
        self.text: list[int] = []
        self.starts: list[tuple[int, int, int, int, int]] = []  # symbol place, symbols, unit number, o from, o to
        self.symbols: dict[tuple, int] = {}
        self.n_units = 0

    def add(self, sides: list[tuple[bytes, bytes]]) -> None:
        """All units of one key: the bytes left and right of it."""
        lefts = [a[::-1] for a, _ in sides]
        rights = [b for _, b in sides]
        cuts = {0}
        for half, cut in ((lefts, lambda d: d + 1), (rights, lambda d: _SLACK - d)):
            ranked = sorted(half)
            cuts.update(cut(_lcp(x, y)) for x, y in zip(ranked, ranked[1:]))
        cuts.update(_SLACK - len(b) for b in rights)
        at = sorted(c for c in cuts if 0 <= c <= _SLACK)
        key, k = self.n_units, len(at)
        ids = self.symbols

        def symbol(part) -> int:
            return ids.setdefault(part, len(ids) + 2)

        for a, b in zip(lefts, rights):
            begin = len(self.text)
            # string i: left stretches i..1, the key, right stretches k-1..i
            self.text += [symbol(a[at[i - 1] : at[i]]) for i in range(k - 1, 0, -1)]
            self.text.append(symbol(key))
            ends = [_SLACK - c for c in at]
            self.text.append(symbol(b[: ends[k - 1]]))
            self.text += [symbol(b[ends[i + 1] : ends[i]]) for i in range(k - 2, -1, -1)]
            self.text.append(1)
            low, high = _SLACK - len(b), len(a)
            for i in range(k):
                o, upto = max(at[i], low), min(at[i + 1] - 1 if i + 1 < k else _SLACK, high)
                if o <= upto and o == max(at[i], low) and at[i] >= low:
                    self.starts.append((begin + k - 1 - i, k + 1, self.n_units, o, upto))
            self.n_units += 1

    def repeated(self) -> list[tuple[int, int, int]]:
        """(unit number, o from, o to): strings starting o bytes left of the key that occur again."""
        if not self.starts:
            return []
        text = self.text + [0]
        order = np.array(suffix_array(text))
        size = np.zeros(len(text), np.int64)
        info = np.full(len(text), -1, np.int64)
        for j, (begin, length, _, _, _) in enumerate(self.starts):
            size[begin], info[begin] = length, j
        values = mix(np.array(text, _U) + _U(1))
        # equal runs of symbols have equal sums of positioned values
        up = np.full(len(text) + 1, 0x9E3779B97F4A7C15, _U)
        up[0] = 1
        up = np.cumprod(up, dtype=_U)
        sums = np.concatenate([np.zeros(1, _U), np.cumsum(values * up[:-1])])
        down = np.full(len(text) + 1, pow(0x9E3779B97F4A7C15, -1, 1 << 64), _U)
        down[0] = 1
        down = np.cumprod(down, dtype=_U)
        order = order[info[order] >= 0]
        run = (sums[order + size[order]] - sums[order]) * down[order]
        same = np.concatenate([[False], (run[1:] == run[:-1]) & (size[order][1:] == size[order][:-1]), [False]])
        return [self.starts[info[s]][2:] for s in order[same[1:] | same[:-1]]]


def _edges(b: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, unit, twice, left, right), a key's rows together -> (key, unit, a, z)."""
    batch, held, names, current, group = Batch(), 0, [], None, []

    def out(rows: list[tuple[int, int, int, int]]) -> Iterator[pa.RecordBatch]:
        if rows:
            cols = list(zip(*rows))
            yield pa.RecordBatch.from_arrays(
                [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.int32())],
                ["key", "unit", "a", "z"],
            )

    def close() -> list[tuple[int, int, int, int]]:
        rows = [(current, u, _SLACK - len(r), len(l)) for u, twice, l, r in group if twice]
        if len(group) > 1:
            batch.add([(l, r) for _, _, l, r in group])
            names.extend((current, u) for u, _, _, _ in group)
        group.clear()
        return rows

    rows: list[tuple[int, int, int, int]] = []
    for record in b:
        for key, unit, twice, left, right in zip(*(record.column(i).to_pylist() for i in range(5))):
            if key != current:
                rows += close()
                current = key
                if len(batch.text) > SORT:
                    rows += [(*names[u], a, z) for u, a, z in batch.repeated()]
                    batch, names = Batch(), []
            group.append((unit, twice, left, right))
        yield from out(rows)
        rows = []
    rows += close()
    rows += [(*names[u], a, z) for u, a, z in batch.repeated()]
    yield from out(rows)


def _strings(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Every string of the units of hot keys: (key, unit, o, hash)."""
    for i in range(0, b.num_rows, 256):
        part = b.slice(i, 256)
        cols: list[list] = [[], [], [], []]
        lefts, rights = part.column("left").to_pylist(), part.column("right").to_pylist()
        for key, unit, left, right in zip(part.column("key").to_pylist(), part.column("unit").to_pylist(), lefts, rights):
            both = np.frombuffer(left + right, np.uint8)
            o = np.arange(_SLACK - len(right), len(left) + 1)
            hashes = Rolling(both).of(len(left) - o, len(left) - o + _SLACK)
            cols[0].append(np.full(len(o), key))
            cols[1].append(np.full(len(o), unit))
            cols[2].append(o)
            cols[3].append(hashes.view(np.int64))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate(c), t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int64()))],
            ["key", "unit", "o", "w"],
        )


def repeats(docs: DataFrame) -> DataFrame:
    """(r, spans) of the text rows that lose something: spans of bytes, not merged."""
    docs = _keyed(docs)
    rows = stored(_units(docs), "units")
    single = rows.select("r", F.explode(F.arrays_zip("p", "lo", "hi", "key", "unit")).alias("x")).select("r", "x.*")
    shared = single.groupBy("key").count().where("count > 1")
    near = BitFilter(shared, "key", 25).keep(single, "key")
    keys = near.groupBy("key").agg(F.count("*").alias("c"), (F.min("unit") != F.max("unit")).alias("many")).where("c > 1")
    met = stored(near.join(keys.drop("c"), "key"), "met")
    whole = met.where("not many").select("r", F.col("lo").alias("s"), (F.col("hi") + LENGTH).alias("e"))

    some = met.where("many")
    kinds = stored(
        some.groupBy("key", "unit").agg(F.count("*").alias("c"), F.min(F.struct("r", "p", "lo", "hi")).alias("x")), "kinds"
    )
    many = kinds.groupBy("key").agg(F.count("*").alias("units"))
    wanted = (
        kinds.join(many, "key")
        .select("key", "unit", (F.col("c") > 1).alias("twice"), (F.col("units") > MAX_UNITS).alias("hot"), "x.*")
        .groupBy("r")
        .agg(F.collect_list(F.struct("key", "unit", "twice", "hot", "p", "lo", "hi")).alias("u"))
    )

    def sides(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for i in range(0, b.num_rows, 64):
            out = []
            for text, us in zip(b.column("text").slice(i, 64), b.column("u").slice(i, 64).to_pylist()):
                raw = text.as_py().encode()
                for u in us:
                    p = u["p"]
                    out.append(
                        (u["key"], u["unit"], u["twice"], raw[u["lo"] : p - _BEFORE], raw[p + _AFTER : u["hi"] + LENGTH], u["hot"])
                    )
            kinds_ = (pa.int64(), pa.int64(), pa.bool_(), pa.binary(), pa.binary(), pa.bool_())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*out), kinds_)], ["key", "unit", "twice", "left", "right", "hot"]
            )

    texts = BitFilter(wanted.select("r"), "r", 23).keep(docs, "r").dropDuplicates(["r"])
    cut = stored(
        map_arrow(
            texts.join(wanted, "r").select("text", "u"),
            sides,
            "key long, unit long, twice boolean, left binary, right binary, hot boolean",
        ),
        "sides",
    )
    names = ("key", "unit", "twice", "left", "right")
    parts_ = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = (
        cut.where("not hot").select(*names).repartition(parts_, "key").sortWithinPartitions("key").mapInArrow(_edges, "key long, unit long, a int, z int")
    )
    hot = map_arrow(cut.where("hot").select(*names), _strings, "key long, unit long, o int, w long")
    again = hot.groupBy("key", "o", "w").count().where("count > 1").drop("count")
    # a unit that occurs more than once repeats all of its strings
    counted = hot.join(again, ["key", "o", "w"]).select("key", "unit", F.col("o").alias("a"), F.col("o").alias("z"))
    twice = cut.where("hot and twice").select(
        "key", "unit", (_SLACK - F.length("right")).alias("a"), F.length("left").alias("z")
    )
    found = stored(sorted_.unionByName(counted).unionByName(twice).groupBy("key", "unit").agg(F.collect_set(F.struct("a", "z")).alias("w")), "found")
    partly = (
        some.join(found, ["key", "unit"])
        .select("r", "p", F.explode("w").alias("w"))
        .select("r", (F.col("p") - _BEFORE - F.col("w.z")).alias("s"), (F.col("p") - _BEFORE - F.col("w.a") + LENGTH).alias("e"))
    )
    return whole.unionByName(partly).distinct().groupBy("r").agg(F.collect_list(F.struct("s", "e")).alias("spans"))


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs covered by the spans."""
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def without_repeats(docs: DataFrame) -> DataFrame:
    """Per row of (doc_id, text): n_bytes, n_removed, n_spans, the kept bytes and
    their SHA-256. The kept bytes need not be valid UTF-8."""

    def run(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for i in range(0, b.num_rows, 64):
            out = []
            ids, texts, spans = (b.column(c).slice(i, 64) for c in ("doc_id", "text", "spans"))
            for doc_id, text, found in zip(ids.to_pylist(), texts, spans.to_pylist()):
                raw = text.as_py().encode()
                gone = merged([(x["s"], x["e"]) for x in found or ()])
                at, kept = 0, []
                for s, e in gone:
                    kept.append(raw[at:s])
                    at = e
                rest = b"".join([*kept, raw[at:]])
                out.append((doc_id, len(raw), len(raw) - len(rest), len(gone), rest, hashlib.sha256(rest).hexdigest()))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names)

    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"]
    rows = _keyed(docs).join(repeats(docs).hint("shuffle_hash"), "r", "left").select("doc_id", "text", "spans")
    return map_arrow(rows, run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string")
