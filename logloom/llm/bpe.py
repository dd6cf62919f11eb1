"""Byte-level BPE ids of whole texts by overlapping chunks, and back to bytes.

A text of at most ``CHUNK`` code points is one piece. A longer one is cut into
windows that reach ``OVERLAP`` code points into the next one; the windows are
spread over the cluster and each is split into pre-tokens from its own start.
Two neighbours resynchronise where both have a boundary at the same place of
their overlap: from there on they agree, as the pattern looks only ahead. The
first window begins at a true boundary, so when all neighbours meet, every cut
is a true boundary. Windows that don't meet (a pre-token longer than the
overlap) are joined and split again, round by round, until all meet.

The pieces between the cuts are encoded on their own. A cut has a character
other than white space before it, so a piece splits as it does in the text.
Decoding looks up the bytes of each id and concatenates them.

A null text is empty and has no ids. Rows stay apart, also when ``doc_id`` is
null or repeated: equal rows give equal results, one each. Columns other than
``doc_id`` and ``text`` are not read, so their names cannot clash. A text of any
length is taken whole; a task holds windows of ``CHUNK`` code points, or one
pre-token where that is longer. An empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_arrow, stored

#: Code points of a window before its overlap, and of the overlap.
CHUNK, OVERLAP = 1 << 16, 1 << 9
#: Code points behind a pre-token on which its end may depend.
AHEAD = 2
DEFAULT = "byte_bpe_multi_50k.tiktoken"

_WINDOW = "row string, doc_id long, k int, text string, core long, last boolean"
_SPLIT = _WINDOW + ", head array<long>, tail array<long>"
_DIGEST = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


class Vocabulary:
    """Ranks of a vocabulary file (base64 token, rank) and the pattern of its pre-tokens."""

    def __init__(self, path: str, pattern: str):
        import regex
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.words = regex.compile(pattern)
        self.ids = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.bytes_of = {i: b for b, i in ranks.items()}

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


@lru_cache(maxsize=2)
def vocabulary(path: str | None = None, pattern: str | None = None) -> Vocabulary:
    """One per Python worker; by default the many-language ranks of the public tokenizers."""
    import public_tokenizers

    return Vocabulary(path or public_tokenizers.path(DEFAULT), pattern or public_tokenizers.PATTERN)


def _cut(chunk: int, overlap: int):
    def run(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for row, doc, text in zip(*(b.column(i).to_pylist() for i in range(3))):
            for k, at in enumerate(range(0, len(text), chunk)):
                last = at + chunk >= len(text)
                yield pa.RecordBatch.from_pylist(
                    [{"row": row, "doc_id": doc, "k": k, "text": text[at : at + chunk + overlap],
                      "core": min(chunk, len(text) - at), "last": last}], schema=_arrow(_WINDOW))

    return run


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(),
             "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()), "binary": pa.binary()}
    return pa.schema([(n, kinds[t]) for n, t in (c.split() for c in ddl.split(", "))])


def _split(overlap: int, path: str | None, pattern: str | None):
    """Boundaries of each window in its first and its last ``overlap`` code points."""

    def run(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        words = vocabulary(path, pattern).words
        heads, tails = [], []
        for text, core, last in zip(*(b.column(n).to_pylist() for n in ("text", "core", "last"))):
            sure = len(text) if last else len(text) - AHEAD
            ends = [m.end() for m in words.finditer(text) if not text[m.end() - 1].isspace()]
            heads.append([0] + [e for e in ends if e <= min(overlap, sure)])
            tails.append([e - core for e in ends if core <= e <= sure])
        kind = pa.list_(pa.int64())
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(heads, kind), pa.array(tails, kind)],
                                         schema=_arrow(_SPLIT))

    return run


def _cuts(split: DataFrame) -> DataFrame:
    """Where each window takes over from the one before; null where the two don't meet."""
    order = Window.partitionBy("row").orderBy("k")
    meet = F.array_min(F.array_intersect("head", F.lag("tail").over(order)))
    return split.select("row", "k", F.when(F.lag("k").over(order).isNull(), F.lit(0).cast("long")).otherwise(meet).alias("cut"))


def long_pieces(docs: DataFrame, chunk: int = CHUNK, overlap: int = OVERLAP, path: str | None = None,
                pattern: str | None = None) -> DataFrame:
    """``row, doc_id, k, text``: the stitched pieces of the texts of ``docs``, in order of ``k`` in a row."""
    if not 0 < overlap < chunk:
        raise ValueError("the overlap must be shorter than the chunk")
    rows = docs.select(F.expr("uuid()").alias("row"), "doc_id", "text")
    wins = stored(map_arrow(rows, _cut(chunk, overlap), _WINDOW), "windows")
    todo, done = wins, None
    while True:
        split = map_arrow(todo.repartition("row", "k"), _split(overlap, path, pattern), _SPLIT)
        split = stored(split if done is None else done.unionByName(split), "split")
        cuts = stored(_cuts(split), "cuts")
        if not cuts.where("cut IS NULL").limit(1).count():
            break
        # a window that doesn't meet the one before it is joined to it, and the joint window split anew
        group = F.count("cut").over(Window.partitionBy("row").orderBy("k"))
        size = F.count(F.lit(1)).over(Window.partitionBy("row", "g"))
        marked = split.join(cuts.select("row", "k", group.alias("g")).select("*", size.alias("size")), ["row", "k"])
        done = marked.where("size = 1").select(split.columns)
        part = F.struct("k", F.substring("text", F.lit(1), F.col("core").cast("int")).alias("body"),
                        F.substring("text", (F.col("core") + 1).cast("int"), F.lit(overlap)).alias("over"), "core", "last")
        joint = marked.where("size > 1").groupBy("row", "doc_id", "g").agg(F.array_sort(F.collect_list(part)).alias("p"))
        end = F.element_at("p", -1)
        todo = joint.select(
            "row", "doc_id", F.get("p", 0)["k"].alias("k"),
            F.concat(F.array_join(F.transform("p", lambda x: x["body"]), ""), end["over"]).alias("text"),
            F.aggregate("p", F.lit(0).cast("long"), lambda a, x: a + x["core"]).alias("core"), end["last"].alias("last"))
    order = Window.partitionBy("row").orderBy("k")
    spans = cuts.select("row", "k", "cut", F.lead("cut").over(order).alias("next"))
    begin, stop = F.col("cut"), F.coalesce(F.col("core") + F.col("next"), F.length("text"))
    return split.join(spans, ["row", "k"]).select(
        "row", "doc_id", "k", F.substring("text", (begin + 1).cast("int"), (stop - begin).cast("int")).alias("text"))


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))


def encode(docs: DataFrame, path: str | None = None, pattern: str | None = None, chunk: int = CHUNK,
           overlap: int = OVERLAP) -> DataFrame:
    """``row, doc_id, k, ids``: ids of the pieces of every text, in order of ``k`` in a row."""
    docs = _texts(docs)
    short = docs.where(F.length("text") <= chunk).select(F.expr("uuid()").alias("row"), "doc_id", F.lit(0).alias("k"), "text")
    long = long_pieces(docs.where(F.length("text") > chunk), chunk, overlap, path, pattern)
    return _encoded(short.unionByName(long), path, pattern)


def _encoded(pieces: DataFrame, path: str | None, pattern: str | None) -> DataFrame:
    def run(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ids = vocabulary(path, pattern).ids
        found = pa.array([ids(t) for t in b.column("text").to_pylist()], pa.list_(pa.int32()))
        yield pa.RecordBatch.from_arrays([b.column("row"), b.column("doc_id"), b.column("k"), found],
                                         names=["row", "doc_id", "k", "ids"])

    return map_arrow(pieces, run, "row string, doc_id long, k int, ids array<int>")


def decode(pieces: DataFrame, path: str | None = None) -> DataFrame:
    """``row, doc_id, k, raw``: the bytes of each piece's ids; a text is its pieces' bytes in order of ``k``."""

    def run(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        raw = pa.array([v.decode(i) for i in b.column("ids").to_pylist()], pa.binary())
        yield pa.RecordBatch.from_arrays([b.column("row"), b.column("doc_id"), b.column("k"), raw],
                                         names=["row", "doc_id", "k", "raw"])

    return map_arrow(pieces.select("row", "doc_id", "k", "ids"), run, "row string, doc_id long, k int, raw binary")


class _Digest:
    """Counts and hashes of one text's ids and of the bytes they stand for, piece by piece."""

    def __init__(self, doc):
        self.doc, self.n = doc, 0
        self.ids, self.raw = hashlib.sha256(), hashlib.sha256()

    def add(self, ids: list[int], raw: bytes) -> None:
        if ids:
            self.ids.update(("," * (self.n > 0) + ",".join(map(str, ids))).encode())
            self.raw.update(raw)
            self.n += len(ids)

    def row(self) -> tuple:
        return self.doc, self.n, self.ids.hexdigest(), self.raw.hexdigest()


def _digests(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _arrow(_DIGEST))],
                                      schema=_arrow(_DIGEST))


def digests(docs: DataFrame, path: str | None = None, pattern: str | None = None, chunk: int = CHUNK,
            overlap: int = OVERLAP) -> DataFrame:
    """Per document: number of ids, SHA-256 of the decimal ids joined by commas and of the decoded bytes.

    A text of one piece is encoded, decoded and hashed where it is read; the
    pieces of longer ones are encoded apart and stream in order through the
    hashes of their text.
    """
    docs = _texts(docs)

    def one(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        v, rows = vocabulary(path, pattern), []
        for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
            d, ids = _Digest(doc), v.ids(text)
            d.add(ids, v.decode(ids))
            rows.append(d.row())
        yield _digests(rows)

    def many(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, row, d = vocabulary(path, pattern), None, None
        for b in batches:
            rows = []
            for r, doc, ids in zip(*(b.column(n).to_pylist() for n in ("row", "doc_id", "ids"))):
                if r != row:
                    if d is not None:
                        rows.append(d.row())
                    row, d = r, _Digest(doc)
                d.add(ids, v.decode(ids))
            if rows:
                yield _digests(rows)
        if d is not None:
            yield _digests([d.row()])

    short = map_arrow(docs.where(F.length("text") <= chunk), one, _DIGEST)
    pieces = _encoded(long_pieces(docs.where(F.length("text") > chunk), chunk, overlap, path, pattern), path, pattern)
    long = pieces.repartition("row").sortWithinPartitions("row", "k").mapInArrow(many, _DIGEST)
    return short.unionByName(long)
