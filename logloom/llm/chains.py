"""Fuzzy passages shared by documents: seeds, collinear chains, alignment.

1. Seeds: of every 16 consecutive 5-word shingles the one with the smallest hash
   (words lower-cased, A-Z). Two texts with 20 equal words in a row share a seed.
2. All documents with a seed meet the one of them with the smallest row hash (the
   seed's hub): its i-th place meets the hub's i-th and first, so a seed gives two
   matches per place at most, however frequent it is.
3. Matches of a document and a hub are chained: in both texts ascending, each
   worth its words, less a cost per word of gap. The best way to continue is a
   prefix maximum in a Fenwick tree over the hub's places.
4. Chains are aligned on the texts' words: gaps are matched by longest common
   subsequence and ends extended while they agree. Passages of at least
   ``MIN_WORDS`` words on both sides, ``MIN_MATCH`` of them equal, are kept.
5. A passage may lie between two documents whose seeds met different hubs. Every
   string of MIN_WORDS words has an anchor: its first seed that 15 shingles of it
   precede, with the 35 words around it that all strings of the anchor hold. Of
   anchors that no passage covers, and those with the same 35 words, all strings
   are hashed; a string of two documents is a passage, and each document's chains
   with the string's hub are aligned as before. So of equal stretches of
   MIN_WORDS words or more no word is missed.
6. Seeds that are still not covered meet again by pairs of seeds at most ``NEAR``
   words apart, however many lie between, each pair with a hub of its own, drawn anew.

Passages with edits are found if their documents share two seeds with a hub that
has them alike, too: the seed's, or a seed pair's. Documents of one seed pair meet
its hub, not each other.

Rows: null text is empty; texts of under 5 words have no seeds; repeated rows
(same doc_id and text) are one document, reported for each; rows without doc_id
take part. Very long texts are worked on whole, one text per row of a task. Only
doc_id and text are read, so other columns' names cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BitFilter, map_arrow, ragged, stored
from .text import mix, parts, powers, word_hashes

WORDS, WINDOW = 5, 16
MIN_WORDS, MIN_MATCH = 50, 0.8
#: Cost of a word of gap (in either text).
GAP_COST = 0.04
#: Words by words that are aligned in one table; larger gaps are halved first.
CELLS = 200 * 200
#: Shingles before an anchor in each of its strings, and words from the anchor on.
_BEFORE, _AFTER = WINDOW - 1, MIN_WORDS - 2 * (WINDOW - 1)
#: Words between the beginnings of two seeds of a pair, at most.
NEAR = 64
#: Rows of a seed that meet its hub in one task.
SALT = 4096
_U = np.uint64


def seeds(h: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(seeds, word places, seeds per text) of the word hashes of texts."""
    if len(h) < WORDS:
        return np.zeros(0, _U), np.zeros(0, np.int64), np.zeros(len(counts), np.int64)
    x = h[: len(h) - WORDS + 1].copy()
    for k in range(1, WORDS):
        x *= powers(2)[0][1]
        x += h[k : len(h) - WORDS + 1 + k]
    x = mix(x)
    ends = np.cumsum(counts)
    row = np.repeat(np.arange(len(counts)), counts)[: len(x)]
    at = np.arange(len(x))
    last = ends[row] - WORDS  # last shingle of the text
    order = (x >> _U(32) << _U(32)) | at.astype(_U)
    order[at > last] = np.iinfo(_U).max
    whole = -(-(len(x) + WINDOW) // WINDOW) * WINDOW
    blocks = np.full(whole, np.iinfo(_U).max, _U)
    blocks[: len(x)] = order
    blocks = blocks.reshape(-1, WINDOW)
    left = np.minimum.accumulate(blocks, axis=1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    low = np.minimum(right[: len(x)], left[WINDOW - 1 : len(x) + WINDOW - 1])
    first = ends[row] - counts[row]
    # a window lies in its text, or holds all of a short one
    use = (at <= last) & ((at + WINDOW - 1 <= last) | (at == first))
    short = use & (at + WINDOW - 1 > last)
    picked = low[use & ~short] & _U(0xFFFFFFFF)
    for i in np.flatnonzero(short).tolist():
        picked = np.append(picked, order[i : int(last[i]) + 1].min() & _U(0xFFFFFFFF))
    picked = np.unique(picked).astype(np.int64)
    return x[picked], picked - first[picked], np.bincount(row[picked], minlength=len(counts))


def stretches(h: np.ndarray, start: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the ``size`` words from each start on."""
    up, down = powers(len(h) + 1)
    sums = np.zeros(len(h) + 1, _U)
    np.cumsum(h * up[:-1], out=sums[1:])
    return mix((sums[start + size] - sums[start]) * down[start])


def anchored(h: np.ndarray, counts: np.ndarray, at: np.ndarray, per: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of each seed the first and last string that it anchors (none: last before
    first) and the hash of the words that they share."""
    row = np.repeat(np.arange(len(counts)), per)
    before = np.concatenate([[-1], at[:-1]])[: len(at)]
    before = np.where(np.concatenate([[True], row[1:] != row[:-1]])[: len(at)], -1, before)
    lo = np.maximum(np.where(before < 0, 0, before - _BEFORE + 1), 0)
    hi = np.minimum(at - _BEFORE, counts[row] - MIN_WORDS)
    on = hi >= lo
    key = np.zeros(len(at), _U)
    first = (np.cumsum(counts) - counts)[row]
    key[on] = stretches(h, (first + at - _BEFORE)[on], _BEFORE + _AFTER)
    return lo, hi, key


def chains(x: list[int], y: list[int], least: int = 2) -> list[list[int]]:
    """Chains of at least so many matches (by x, then y descending), as lists of their numbers."""
    ranks = {v: i + 1 for i, v in enumerate(sorted(set(y)))}
    size = len(ranks)
    tree: list[tuple[float, int]] = [(-1e18, -1)] * (size + 1)
    score, back = [0.0] * len(x), [-1] * len(x)
    for i, (a, b) in enumerate(zip(x, y)):
        # places of earlier matches hold score + cost * (x + y)
        best, r = (-1e18, -1), ranks[b] - 1
        while r > 0:
            if tree[r] > best:
                best = tree[r]
            r &= r - 1
        gain, j = best[0] - GAP_COST * (a + b), best[1]
        score[i] = WORDS
        if j >= 0 and gain > 0:
            score[i] += gain - max(0, WORDS - min(a - x[j], b - y[j]))
            back[i] = j
        own, r = (score[i] + GAP_COST * (a + b), i), ranks[b]
        while r <= size:
            if own > tree[r]:
                tree[r] = own
            r += r & -r
    out, used = [], [False] * len(x)
    for i in sorted(range(len(x)), key=lambda i: (-score[i], i)):
        chain = []
        while i >= 0 and not used[i]:
            used[i] = True
            chain.append(i)
            i = back[i]
        if len(chain) >= least:
            out.append(chain[::-1])
    return out


Column = tuple[int, int, bool]


def _common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the longest common subsequence of a and each prefix of b."""
    row = np.zeros(len(b) + 1, np.int32)
    for v in a:
        row[1:] = np.maximum.accumulate(np.maximum(row[1:], row[:-1] + (b == v)))
    return row


def _halves(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """The middle of a, and the place of b that a longest common subsequence reaches there."""
    m = len(a) // 2
    return m, int(np.argmax(_common(a[:m], b) + _common(a[m:][::-1], b[::-1])[::-1]))


def _gap(a: list[int], b: list[int], x: int, y: int) -> list[Column]:
    """Columns of two stretches beginning at x and y, by longest common subsequence."""
    if len(a) == len(b):
        same = [v == w for v, w in zip(a, b)]
        if 2 * sum(same) >= len(a):
            return [(x + i, y + i, e) for i, e in enumerate(same)]
    if len(a) * len(b) > CELLS:
        if len(a) >= len(b):
            i, j = _halves(np.array(a), np.array(b))
        else:
            j, i = _halves(np.array(b), np.array(a))
        return _gap(a[:i], b[:j], x, y) + _gap(a[i:], b[j:], x + i, y + j)
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if a[i] == b[j] else max(best[i + 1][j], best[i][j + 1])
    out, i, j = [], 0, 0
    while i < len(a) or j < len(b):
        if i < len(a) and j < len(b) and a[i] == b[j]:
            out.append((x + i, y + j, True))
            i, j = i + 1, j + 1
        elif j == len(b) or i < len(a) and best[i + 1][j] >= best[i][j + 1]:
            out.append((x + i, y + j, False))
            i += 1
        else:
            out.append((x + i, y + j, False))
            j += 1
    return out


def _extend(a: np.ndarray, b: np.ndarray, drop: int = 5) -> tuple[int, int]:
    """(words, equal words) by which two texts go on agreeing, a mismatch costing one."""
    n = min(len(a), len(b))
    a, b, size, step = a[:n], b[:n], 0, 64
    best, best_at, equal_at, score, equal = 0, 0, 0, 0, 0
    while size < n:
        for same in (a[size : size + step] == b[size : size + step]).tolist():
            size += 1
            if same:
                equal += 1
                score += 1
                if score > best:
                    best, best_at, equal_at = score, size, equal
            else:
                score -= 2
                if score < best - 2 * drop:
                    return best_at, equal_at
    return best_at, equal_at


def align(a: np.ndarray, b: np.ndarray, x: list[int], y: list[int]) -> list[Column]:
    """Columns (place, place, equal) of the passage that a chain of matches spells."""
    px, py = x[0], y[0]
    n, _ = _extend(a[:px][::-1], b[:py][::-1])
    out = [(px + i, py + i, bool(a[px + i] == b[py + i])) for i in range(-n, 0)]
    for i, j in zip(x, y):
        if (i > px or j > py) and i >= px and j >= py:
            out += _gap(a[px:i].tolist(), b[py:j].tolist(), px, py)
            px, py = i, j
        ahead = min(i + WORDS - px, j + WORDS - py)
        if ahead > 0:
            out += [(px + k, py + k, e) for k, e in enumerate((a[px : px + ahead] == b[py : py + ahead]).tolist())]
            px, py = px + ahead, py + ahead
    n, _ = _extend(a[px:], b[py:])
    return out + [(px + k, py + k, e) for k, e in enumerate((a[px : px + n] == b[py : py + n]).tolist())]


def similar(columns: list[Column]) -> Iterator[tuple[int, int, int, int, int]]:
    """(start, end, start, end, equal words) of the stretches of an alignment that
    are long and alike enough: all of it, or its best-scoring parts."""

    def part(i: int, j: int) -> tuple[int, int, int, int, int]:
        (s, hs, _), (e, he, _) = columns[i], columns[j]
        return s, e + 1, hs, he + 1, sum(c[2] for c in columns[i : j + 1])

    def good(p: tuple[int, int, int, int, int]) -> bool:
        s, e, hs, he, equal = p
        return min(e - s, he - hs) >= MIN_WORDS and equal >= MIN_MATCH * max(e - s, he - hs)

    if not columns:
        return
    whole = part(0, len(columns) - 1)
    if good(whole):
        yield whole
        return
    miss = MIN_MATCH / (1 - MIN_MATCH)  # a stretch scores above zero if more than MIN_MATCH of it is equal
    i = 0
    while i < len(columns):
        if not columns[i][2]:
            i += 1
            continue
        score, best, end, j = 0.0, 0.0, i, i
        while j < len(columns) and score >= 0 and best - score <= 10 * miss:
            score += 1 if columns[j][2] else -miss
            if score > best:
                best, end = score, j
            j += 1
        found = part(i, end)
        if good(found):
            yield found
        i = end + 1


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", text.alias("text"), F.xxhash64("doc_id", text).alias("r"))


def _hashes(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """(r, w): a text's words as 32-bit hashes."""
    for i, data, off in parts(b.column("text")):
        h, counts = word_hashes(data, off)
        w = np.split((h >> _U(32)).astype(np.uint32), np.cumsum(counts)[:-1])
        yield pa.RecordBatch.from_arrays(
            [b.column("r").slice(i, len(counts)), pa.array([v.tobytes() for v in w], pa.binary())], ["r", "w"]
        )


def _runs(sides: DataFrame) -> DataFrame:
    """(r, runs): the maximal runs that the spans (r, s, e) cover. Of spans with one
    beginning the longest is gathered: at most one for each word of a text."""
    spans = sides.groupBy("r", "s").agg(F.max("e").alias("e")).groupBy("r").agg(F.sort_array(F.collect_list(F.struct("s", "e"))).alias("x"))

    def run(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        from .repeats import merged

        out = [[{"s": s, "e": e} for s, e in merged([(v["s"], v["e"]) for v in x])] for x in b.column("x").to_pylist()]
        kind = pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))
        yield pa.RecordBatch.from_arrays([b.column("r"), pa.array(out, kind)], ["r", "runs"])

    return map_arrow(spans, run, "r long, runs array<struct<s:long,e:long>>")


def _sides(found: DataFrame) -> DataFrame:
    """(r, s, e, other) of both ends of passages."""
    return found.select("r", "s", "e", F.col("hub").alias("other")).unionByName(
        found.select(F.col("hub").alias("r"), F.col("hub_s").alias("s"), F.col("hub_e").alias("e"), F.col("r").alias("other"))
    )


def _open(places: DataFrame, runs: DataFrame, start: str, end: str) -> DataFrame:
    """``places`` with ``open``: whether no run of their text holds start to end."""
    inside = F.exists("runs", lambda x: (x["s"] <= F.expr(start)) & (x["e"] >= F.expr(end)))
    return places.join(runs, "r", "left").withColumn("open", ~F.coalesce(inside, F.lit(False))).drop("runs")


def _once(rows: DataFrame, again: BitFilter) -> DataFrame:
    """``rows``, each r once; ``again`` holds the r of repeated rows. All others stay where they are."""
    rows = rows.withColumn("again", again.holds("r"))
    first = rows.where("again").dropDuplicates(["r"])
    return rows.where("not again").unionByName(first).drop("again")


def _aligned(docs: DataFrame, again: BitFilter, matches: DataFrame, least: int) -> DataFrame:
    """Passages of the matches (r, hub, at, hub_at) of documents and hubs, by chains of at least so many."""
    pairs = (
        matches.groupBy("r", "hub")
        .agg(F.collect_set(F.struct("at", (-F.col("hub_at")).alias("back"))).alias("m"))
        .where(F.size("m") >= least)
        .select("r", "hub", F.sort_array("m").alias("m"))
    )

    def chain(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        out = []
        for r, hub, m in zip(b.column("r").to_pylist(), b.column("hub").to_pylist(), b.column("m").to_pylist()):
            x, y = [v["at"] for v in m], [-v["back"] for v in m]
            for c in chains(x, y, least):
                out.append((r, hub, [x[i] for i in c], [y[i] for i in c]))
        if out:
            kinds = (pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], ["r", "hub", "x", "y"])

    linked = stored(map_arrow(pairs, chain, "r long, hub long, x array<int>, y array<int>"), "chains")
    ends = linked.select(F.explode(F.array("r", "hub")).alias("r")).distinct()
    some = BitFilter(ends, "r", 23).keep(docs.select("r", "text"), "r")
    texts = _once(stored(map_arrow(some, _hashes, "r long, w binary"), "words"), again)

    def fit(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        out = []
        cols = (b.column(c) for c in ("r", "hub", "x", "y", "wa", "wb"))
        for r, hub, x, y, wa, wb in zip(*cols):
            a, h = np.frombuffer(wa.as_buffer(), np.uint32), np.frombuffer(wb.as_buffer(), np.uint32)
            for found in similar(align(a, h, x.as_py(), y.as_py())):
                out.append((r.as_py(), hub.as_py(), *found))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names)

    names = ["r", "hub", "s", "e", "hub_s", "hub_e", "equal"]

    def side(column: str, words: str) -> DataFrame:
        own = BitFilter(linked.select(column).distinct(), column, 23)
        return own.keep(texts.select(F.col("r").alias(column), F.col("w").alias(words)), column)

    both = linked.join(side("r", "wa"), "r").join(side("hub", "wb"), "hub")
    return map_arrow(both.select("r", "hub", "x", "y", "wa", "wb"), fit, ", ".join(f"{n} long" for n in names))


def _met(docs: DataFrame) -> tuple[DataFrame, DataFrame, BitFilter]:
    """Places of seeds that several documents have, with their hub and its first place;
    the anchors among them, and a few that one document alone has; and a filter of the
    r of repeated rows. Anchors do not travel with the seeds: they meet by their key."""

    def run(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for i, data, off in parts(b.column("text")):
            h, counts = word_hashes(data, off)
            x, at, per = seeds(h, counts)
            lo, hi, key = anchored(h, counts, at, per)
            row = np.repeat(np.arange(len(per)), per)
            order = np.lexsort((at, x, row))
            new = np.ones(len(x), bool)
            new[1:] = (x[order][1:] != x[order][:-1]) | (row[order][1:] != row[order][:-1])
            nth = np.zeros(len(x), np.int64)
            nth[order] = np.arange(len(x)) - np.maximum.accumulate(np.where(new, np.arange(len(x)), 0))
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("r").slice(i, len(per)),
                    *(ragged(v, per, pa.int32()) for v in (at, nth, lo, hi)),
                    *(ragged(v.view(np.int64), per, pa.int64()) for v in (key, x)),
                ],
                ["r", *columns],
            )

    columns = ("at", "nth", "lo", "hi", "key", "seed")
    kinds = "at array<int>, nth array<int>, lo array<int>, hi array<int>, key array<long>, seed array<long>"
    rows = map_arrow(docs.select("r", "text"), run, f"r long, {kinds}")
    rows = stored(rows.where(F.size("at") > 0), "seeds")
    again = BitFilter(rows.groupBy("r").count().where("count > 1"), "r", 23)
    shared = rows.select(F.explode(F.array_distinct("seed")).alias("seed")).groupBy("seed").count().where("count > 1")
    several = BitFilter(shared, "seed", 25)

    def single(*names: str) -> DataFrame:
        return rows.select("r", F.explode(F.arrays_zip(*names)).alias("x")).select("r", "x.*")

    near = several.keep(single("at", "nth", "seed"), "seed")
    hubs = near.groupBy("seed").agg(F.count("*").alias("c"), F.min(F.struct("r", "at")).alias("first"), F.max("r").alias("last"))
    hubs = hubs.where("first.r <> last").select("seed", "c", F.col("first.r").alias("hub"), F.col("first.at").alias("hub_at"))
    anchors = several.keep(single("lo", "hi", "key", "seed").where("hi >= lo"), "seed").drop("seed")
    return stored(near.join(hubs, "seed"), "seed-hubs"), anchors, again


def _by_seeds(met: DataFrame) -> DataFrame:
    """Matches of documents with the hubs of their seeds. The hub's first place is at
    hand; only later ones meet. Those are repeated for every SALT rows of the seed, so
    that a frequent seed is many small tasks."""
    salts = F.expr(f"c div {SALT} + 1")
    later = met.where("nth > 0")
    # repeated rows share r: each of the hub's places once
    place = (
        later.where("r = hub").groupBy("seed", "hub", "nth").agg(F.min("at").alias("hub_at"), F.max("c").alias("c"))
        .withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), salts - 1))).drop("c")
    )
    others = later.where("r <> hub").withColumn("salt", F.pmod(F.xxhash64("r"), salts)).select("seed", "hub", "salt", "r", "at", "nth")
    first = met.where("r <> hub").select("r", "hub", "at", "hub_at")
    return first.unionByName(others.join(place, ["seed", "hub", "nth", "salt"]).select("r", "hub", "at", "hub_at"))


def _strings(docs: DataFrame, anchors: DataFrame, runs: DataFrame) -> DataFrame:
    """(r, at, nth, w): the strings of MIN_WORDS words, with their hashes, of anchors
    that no run covers and of all anchors alike."""
    keys = stored(_open(anchors, runs, "lo", f"hi + {MIN_WORDS}").where("open").select("key").distinct(), "keys")
    alike = stored(BitFilter(keys, "key", 25).keep(anchors, "key").join(keys, "key"), "anchors")
    many = stored(alike.groupBy("key").agg(F.min("r").alias("a"), F.max("r").alias("b")).where("a <> b").select("key"), "keys")
    wanted = stored(
        alike.join(many, "key").select("r", "lo", "hi").distinct().groupBy("r").agg(F.collect_list(F.struct("lo", "hi")).alias("u")),
        "wanted",
    )

    def run(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for i in range(b.num_rows):
            part = b.slice(i, 1)
            h, _ = word_hashes(*next(iter(parts(part.column("text"))))[1:])
            at = np.concatenate([np.arange(u["lo"], u["hi"] + 1) for u in part.column("u")[0].as_py()])
            at = np.unique(at)
            w = stretches(h, at, MIN_WORDS)
            order = np.lexsort((at, w))
            new = np.concatenate([[True], w[order][1:] != w[order][:-1]])
            nth = np.zeros(len(at), np.int64)
            nth[order] = np.arange(len(at)) - np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))
            cols = (np.full(len(at), part.column("r")[0].as_py()), at, nth, w.view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["r", "at", "nth", "w"])

    texts = BitFilter(wanted, "r", 23).keep(docs.select("r", "text"), "r").dropDuplicates(["r"])
    return stored(map_arrow(texts.join(wanted, "r"), run, "r long, at long, nth long, w long"), "strings")


def _equal(strings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Passages that strings of several documents are (the first document's places
    with the last's, all others' with the first's), and matches to align."""
    ends = strings.groupBy("w").agg(F.min(F.struct("r", "at")).alias("a"), F.max(F.struct("r", "at")).alias("b"))
    ends = stored(ends.where("a.r <> b.r"), "string-ends")
    other = F.expr("if(r = a.r, b, a)")
    both = strings.join(ends, "w").select(
        "r", F.col("at").alias("s"), "nth", other["r"].alias("hub"), other["at"].alias("hub_s"), F.expr("r <> a.r").alias("later")
    )
    both = stored(both, "equal")
    end = lambda c: (F.col(c) + MIN_WORDS).alias(c.replace("s", "e"))
    exact = both.select("r", "hub", "s", end("s"), "hub_s", end("hub_s"), F.lit(MIN_WORDS).cast("long").alias("equal"))
    # the first document's first place is at hand; only a string's later places in a document meet
    first = both.where("later and nth = 0").select("r", "hub", F.col("s").alias("at"), F.col("hub_s").alias("hub_at"))
    again = strings.where("nth > 0").join(ends.select("w", F.col("a.r").alias("hub")), "w")
    place = again.where("r = hub").select("w", "nth", "hub", F.col("at").alias("hub_at"))
    again = again.where("r <> hub").drop("hub").join(stored(place, "string-hubs"), ["w", "nth"])
    matches = first.unionByName(again.select("r", "hub", "at", "hub_at"))
    # of a diagonal the first match of each window of words
    first = matches.groupBy("r", "hub", (F.col("hub_at") - F.col("at")).alias("d"), F.expr(f"at div {MIN_WORDS}").alias("g"))
    return exact, first.agg(F.min("at").alias("at"), F.min("hub_at").alias("hub_at")).drop("d", "g")


def _pairs(met: DataFrame, runs: DataFrame) -> DataFrame:
    """(r, at, at2, nth, open, pair): pairs of seeds at most NEAR words apart that several
    documents have, if a place of one of them is not covered (open: in this document).
    nth numbers a document's places of a pair."""
    places = met.select("r", "at", "seed").join(runs, "r", "left")
    inside = F.exists("runs", lambda x: (x["s"] <= F.col("at")) & (x["e"] >= F.col("at") + WORDS))
    places = places.select("r", F.struct("at", "seed", (~F.coalesce(inside, F.lit(False))).alias("open")).alias("x"))
    lists = stored(places.groupBy("r").agg(F.sort_array(F.collect_set("x")).alias("x")), "open-seeds")
    alive = lists.select(F.explode("x").alias("x")).where("x.open").select("x.seed").distinct()
    alive = BitFilter(alive, "seed", 25)
    near = lists.select("r", F.explode("x").alias("x")).select("r", "x.*").where(alive.holds("seed"))
    # texts without such a seed have nothing to meet
    some = BitFilter(near.select("r").distinct(), "r", 23).keep(lists, "r")
    some = some.select("r", F.col("x.at").alias("at"), F.col("x.seed").alias("seed"), F.col("x.open").alias("open"))
    spots = some.select("r", "at", "seed", "open", F.transform("seed", alive.spot).alias("spot"))
    bits = alive.shared

    def run(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for i in range(0, b.num_rows, 256):
            cols = [b.column(c).slice(i, 256) for c in ("at", "seed", "open", "spot")]
            counts = np.diff(cols[0].offsets.to_numpy())
            row = np.repeat(np.arange(len(counts)), counts)
            at, seed, open_, spot = (c.flatten().to_numpy(zero_copy_only=False) for c in cols)
            on = (bits.value[spot >> 6] >> (spot & 63)) & 1 == 1
            found, d = [np.zeros((2, 0), np.int64)], 1
            while len(k := np.flatnonzero((row[d:] == row[:-d]) & (at[d:] - at[:-d] <= NEAR))):
                k = k[on[k] | on[k + d]]
                found.append(np.stack([k, k + d]))
                d += 1
            x, y = np.concatenate(found, axis=1)
            if not len(x):
                continue
            pair = mix(seed[x].view(_U) + mix(seed[y].view(_U) ^ _U(0x5EED)))
            order = np.lexsort((y, x, pair, row[x]))
            x, y, pair = x[order], y[order], pair[order]
            # of a place and another seed the nearest
            first = np.concatenate([[True], (pair[1:] != pair[:-1]) | (x[1:] != x[:-1])])
            x, y, pair = x[first], y[first], pair[first]
            new = np.concatenate([[True], (pair[1:] != pair[:-1]) | (row[x][1:] != row[x][:-1])])
            nth = np.arange(len(x)) - np.maximum.accumulate(np.where(new, np.arange(len(x)), 0))
            r = b.column("r").slice(i, 256).to_numpy()[row[x]]
            out = (r, at[x], at[y], nth, open_[x] | open_[y], pair.view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], names)

    names = ["r", "at", "at2", "nth", "open", "pair"]
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.int64())
    pairs = stored(map_arrow(spots, run, "r long, at int, at2 int, nth int, open boolean, pair long"), "seed-pairs")
    several = pairs.groupBy("pair").agg(F.min("r").alias("a"), F.max("r").alias("b"), F.max("open").alias("some"))
    several = stored(several.where("some and a <> b").select("pair"), "pairs")
    return stored(BitFilter(several, "pair", 25).keep(pairs, "pair").join(several, "pair"), "pair-places")


def _by_pairs(pairs: DataFrame) -> DataFrame:
    """Matches of seeds that no run covers, by pairs of seeds near each other: all
    documents of a pair meet one of them, drawn anew."""
    drawn = F.struct(F.xxhash64("r", F.lit(1)).alias("draw"), "r", "at", "at2", "open")
    hubs = stored(pairs.groupBy("pair").agg(F.min(drawn).alias("hub"), F.max(drawn).alias("last")), "pair-hubs")
    ends = [F.struct(F.col(c).alias("at"), F.col(f"hub.{c}").alias("hub_at")) for c in ("at", "at2")]
    # covered documents are there to be met: an open hub needs one of them
    return (
        pairs.join(hubs, "pair")
        .where("r <> hub.r and (open or hub.open and r = last.r)")
        .select("r", F.col("hub.r").alias("hub"), F.explode(F.array(*ends)).alias("m"))
        .select("r", "hub", "m.at", "m.hub_at")
    )


def passages(docs: DataFrame) -> DataFrame:
    """(r, hub, s, e, hub_s, hub_e, equal): passages in words, r and hub the hashes of two rows."""
    docs = _keyed(docs)
    met, anchors, again = _met(docs)
    found = stored(_aligned(docs, again, _by_seeds(met), 2), "passages")
    runs = stored(_runs(_sides(found)), "runs")
    exact, matches = _equal(_strings(docs, anchors, runs))
    found = found.unionByName(exact).unionByName(stored(_aligned(docs, again, matches, 1), "passages"))
    runs = stored(_runs(_sides(found)), "runs")
    return found.unionByName(_aligned(docs, again, _by_pairs(_pairs(met, runs)), 2))


def shared_words(docs: DataFrame) -> DataFrame:
    """Per row of (doc_id, text): doc_id, n_words, n_shared (words in a passage
    shared with another document), n_passages (merged runs), spans
    ("start:end" in words, comma-joined) and source_id (the smallest doc_id that
    it shares one with, as far as they met: a hub or a hub's document; null: none)."""
    found = stored(passages(docs), "passages")
    keyed = _keyed(docs)
    ids = keyed.select("r", "doc_id").distinct()
    sides = _sides(found)
    source = (
        sides.select("r", "other").distinct()
        .join(ids.select(F.col("r").alias("other"), F.col("doc_id").alias("source_id")), "other")
        .groupBy("r").agg(F.min("source_id").alias("source_id"))
    )
    size = F.aggregate("runs", F.lit(0).cast("long"), lambda n, x: n + x["e"] - x["s"])
    spelt = F.concat_ws(",", F.transform("runs", lambda x: F.concat_ws(":", x["s"], x["e"])))
    shared = _runs(sides).select("r", size.alias("n_shared"), F.size("runs").cast("long").alias("n_passages"), spelt.alias("spans"))

    def count(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        n = [c for _, data, off in parts(b.column("text")) for c in word_hashes(data, off)[1].tolist()]
        yield pa.RecordBatch.from_arrays([b.column("r"), b.column("doc_id"), pa.array(n, pa.int64())], ["r", "doc_id", "n_words"])

    rows = map_arrow(keyed.select("r", "doc_id", "text"), count, "r long, doc_id long, n_words long")
    return (
        rows.join(shared, "r", "left").join(source, "r", "left")
        .select(
            "doc_id", "n_words", F.coalesce("n_shared", F.lit(0)).alias("n_shared"),
            F.coalesce("n_passages", F.lit(0)).alias("n_passages"), F.coalesce("spans", F.lit("")).alias("spans"), "source_id",
        )
    )
