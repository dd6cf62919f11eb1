"""Fill-in-middle: texts cut at two token boundaries and put in another order.

The token boundaries of a text are kept in a set of the Roaring kind: code
points go by their high bits to containers of 65,536, each an array, a bitmap
or a list of runs, whichever is smallest, with the cardinalities summed up over
the containers. The cut behind the r-th token is ``select(r - 1)``: a search in
the cumulative cardinalities finds the container, a local select the boundary.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bound_batches
from .text import parts

#: Markers before the prefix, the suffix and the middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
_SPAN = 1 << 16
#: More values than these take less room as a bitmap of 8,192 bytes.
_ARRAY = 4096


class _Array:
    def __init__(self, low: np.ndarray):
        self.low = low.astype(np.uint16)
        self.size = len(low)

    def select(self, i: int) -> int:
        return int(self.low[i])

    def rank(self, x: int) -> int:
        return int(np.searchsorted(self.low, x, "right"))


class _Bitmap:
    def __init__(self, low: np.ndarray):
        bits = np.zeros(_SPAN, bool)
        bits[low] = True
        self.words = np.packbits(bits, bitorder="little").view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])
        self.size = len(low)

    def _bits(self, w: int) -> np.ndarray:
        return np.flatnonzero(np.unpackbits(self.words[w : w + 1].view(np.uint8), bitorder="little"))

    def select(self, i: int) -> int:
        w = int(np.searchsorted(self.before, i, "right")) - 1
        return 64 * w + int(self._bits(w)[i - self.before[w]])

    def rank(self, x: int) -> int:
        w, b = divmod(x, 64)
        return int(self.before[w]) + int(np.searchsorted(self._bits(w), b, "right"))


class _Runs:
    def __init__(self, starts: np.ndarray, lengths: np.ndarray):
        self.starts, self.before = starts, np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
        self.size = int(self.before[-1])

    def select(self, i: int) -> int:
        r = int(np.searchsorted(self.before, i, "right")) - 1
        return int(self.starts[r] + i - self.before[r])

    def rank(self, x: int) -> int:
        r = int(np.searchsorted(self.starts, x, "right")) - 1
        return 0 if r < 0 else int(min(self.before[r] + x - self.starts[r] + 1, self.before[r + 1]))


def _container(low: np.ndarray):
    first = np.flatnonzero(np.diff(low, prepend=-2) != 1)
    if 2 + 4 * len(first) < min(2 * len(low), _SPAN // 8):
        return _Runs(low[first], np.diff(first, append=len(low)))
    return _Array(low) if len(low) <= _ARRAY else _Bitmap(low)


class BoundarySet:
    """A set of positions from 0 on, made from them in ascending order."""

    def __init__(self, positions: np.ndarray):
        high = positions >> 16
        edges = np.flatnonzero(np.diff(high, prepend=-1, append=-1))
        self.keys = high[edges[:-1]]
        self.containers = [_container(positions[a:b] & (_SPAN - 1)) for a, b in zip(edges[:-1], edges[1:])]
        self.before = np.concatenate([[0], np.cumsum([c.size for c in self.containers], dtype=np.int64)])

    def __len__(self) -> int:
        return int(self.before[-1])

    def select(self, i: int) -> int:
        """The i-th smallest position, from 0."""
        if not 0 <= i < len(self):
            raise IndexError(i)
        c = int(np.searchsorted(self.before, i, "right")) - 1
        return int(self.keys[c]) * _SPAN + self.containers[c].select(i - int(self.before[c]))

    def rank(self, x: int) -> int:
        """How many positions are at most x."""
        c = int(np.searchsorted(self.keys, x >> 16))
        inside = c < len(self.keys) and self.keys[c] == x >> 16
        return int(self.before[c]) + (self.containers[c].rank(x & (_SPAN - 1)) if inside else 0)


def token_ends(data: np.ndarray) -> np.ndarray:
    """Ends, in code points, of the tokens of a UTF-8 text: words with the ASCII
    white space before them, and white space at the end."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    solid = ~((data == 32) | ((data >= 9) & (data <= 13)))
    ends = np.flatnonzero(solid & np.append(~solid[1:], True)) + 1
    if not solid[-1]:
        ends = np.append(ends, n)
    return np.cumsum((data & 0xC0) != 0x80)[ends - 1]


@F.arrow_udf(T.StructType([T.StructField(c, T.LongType()) for c in ("n", "first", "second")]))
def _cuts(text: pa.Array, one: pa.Array, two: pa.Array) -> pa.Array:
    out = []
    h1, h2 = one.to_pylist(), two.to_pylist()
    for row, data, off in parts(text):
        for i in range(len(off) - 1):
            ends = BoundarySet(token_ends(data[off[i] : off[i + 1]]))
            n = len(ends)
            r = sorted((h1[row + i] % (n + 1), h2[row + i] % (n + 1)))
            out.append((n, *(ends.select(x - 1) if x else 0 for x in r)))
    kinds = [pa.array([r[i] for r in out], pa.int64()) for i in range(3)]
    return pa.StructArray.from_arrays(kinds, names=["n", "first", "second"])


def _draws(doc_id: Column, seed: int) -> list[Column]:
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(key, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def fill_in_middle(docs: DataFrame, seed: int = 42, rate: int = 50, spm: int = 80) -> DataFrame:
    """``doc_id, text, n, form, prefix_chars, middle_chars, output`` of every document.

    ``rate`` percent of the texts are cut into prefix, middle and suffix, at
    boundaries drawn from a hash of ``doc_id``, and put into the form ``spm``
    (suffix, prefix, middle) or, the rest, ``psm``; the others stay ``plain``, as
    do empty texts and those that hold a marker. ``n`` is the number of tokens.

    A null text is empty; a null ``doc_id`` draws as an empty one; rows with the
    same ``doc_id`` draw alike. Texts are taken whole. Other columns are not
    read. An empty table gives an empty result.
    """
    bound_batches(docs.sparkSession)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    h1, h2, h3, h4 = _draws(F.col("doc_id"), seed)
    text, cut = F.col("text"), F.col("cut")
    plain = (text == "") | text.rlike("<[PSM]>") | (h3 % 100 >= rate)
    form = F.when(plain, "plain").when(h4 % 100 < spm, "spm").otherwise("psm")
    cutting = rows.select("doc_id", "text", form.alias("form"), _cuts(text, h1, h2).alias("cut"))
    first, second = cut["first"].cast("int"), cut["second"].cast("int")
    prefix = F.substring(text, F.lit(1), first)
    middle = F.substring(text, first + 1, second - first)
    suffix = F.substring(text, second + 1, F.length(text))
    output = (F.when(F.col("form") == "psm", F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle))
              .when(F.col("form") == "spm", F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle))
              .otherwise(text))
    moved = F.col("form") != "plain"
    return cutting.select(
        "doc_id", "text", cut["n"].alias("n"), "form", F.when(moved, cut["first"]).alias("prefix_chars"),
        F.when(moved, cut["second"] - cut["first"]).alias("middle_chars"), output.alias("output"))


def restored(output: Column, form: Column) -> Column:
    """The text that an output of the given form was made from."""
    p = F.split(output, "<[PSM]>", -1)
    return (F.when(form == "psm", F.concat(F.get(p, F.lit(1)), F.get(p, F.lit(3)), F.get(p, F.lit(2))))
            .when(form == "spm", F.concat(F.get(p, F.lit(2)), F.get(p, F.lit(3)), F.get(p, F.lit(1))))
            .otherwise(output))
