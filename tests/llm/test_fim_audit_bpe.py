"""Fill-in-middle, filter audit and chunked byte-level BPE against plain versions."""

import base64
import hashlib
import random
import re
from itertools import permutations

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from logloom.llm import audit, bpe, fim
from logloom.llm.fim import BoundarySet

SCHEMA = "doc_id long, text string, source string"
LONG = " ".join(f"w{i % 977}x{i % 13}" for i in range(30_000))


@pytest.mark.parametrize("kind", ["sparse", "dense", "runs", "mixed", "empty"])
def test_boundary_set(kind):
    rng = np.random.default_rng(3)
    spots = {
        "sparse": rng.integers(0, 400_000, 300), "dense": rng.integers(0, 131_072, 60_000),
        "runs": np.concatenate([np.arange(a, a + 3000) for a in (5, 65_000, 200_000)]),
        "mixed": np.concatenate([rng.integers(0, 65_536, 20_000), np.arange(70_000, 90_000), [131_072, 262_143]]),
        "empty": np.zeros(0, np.int64)}[kind]
    want = np.unique(spots).astype(np.int64)
    s = BoundarySet(want)
    assert len(s) == len(want)
    for i in [*range(0, len(want), 997), len(want) - 1]:
        if i >= 0:
            assert s.select(i) == want[i]
    for x in [0, 1, 4, 5, 65_535, 65_536, 131_072, 399_999, *rng.integers(0, 400_000, 50).tolist()]:
        assert s.rank(x) == int((want <= x).sum())
    with pytest.raises(IndexError):
        s.select(len(want))
    kinds = {type(c).__name__ for c in s.containers}
    assert kinds == {"sparse": {"_Array"}, "dense": {"_Bitmap"}, "runs": {"_Runs"},
                     "mixed": {"_Bitmap", "_Runs", "_Array"}, "empty": set()}[kind]


def plain_fim(doc_id, text):
    t = re.findall("[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    h = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in range(0, 32, 8))
    n = len(t)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(t[:a]), "".join(t[a:b]), "".join(t[b:])
    if not text or re.search("<[PSM]>", text) or h3 % 100 >= 50:
        return n, "plain", None, None, text
    if h4 % 100 < 80:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_fill_in_middle(spark):
    rng = random.Random(1)
    signs = ["a", "é", "𝄞", " ", "\t", "\r\n", "\x0b", " ", "<", "<P", "P>", "S>", "漢", "\x1c", "é"]
    texts = ["".join(rng.choices(signs, k=rng.randint(0, 60))) for _ in range(300)]
    rows = [*enumerate(texts), (900, None), (901, ""), (902, " \n "), (903, LONG), (904, "x<M>y"), (None, "no id here"), (3, texts[3]), (3, LONG)]
    df = spark.createDataFrame([(i, t, "s") for i, t in rows], SCHEMA).withColumns({"n": F.lit(1), "form": F.lit("x"), "cut": F.lit(2)})
    got = fim.fill_in_middle(df).withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
    want = sorted(map(repr, ((i, *plain_fim(i, t or "")) for i, t in rows)))
    assert sorted(repr((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output)) for r in got) == want
    assert all(r.back == r.text for r in got) and {r.form for r in got} == {"plain", "spm", "psm"}
    assert fim.fill_in_middle(df.limit(0)).count() == 0


def test_gallop():
    rng = random.Random(8)
    for _ in range(2000):
        lists = [sorted(rng.sample(range(60), rng.randint(0, rng.choice([3, 50])))) for _ in range(rng.randint(1, 5))]
        assert audit.union_size(lists) == len(set().union(*lists))
        assert audit.without_size(lists[0], lists[1:]) == len(set(lists[0]).difference(*lists[1:]))
        assert audit.both(lists[0], lists[-1]) == sorted(set(lists[0]) & set(lists[-1]))


def plain_audit(docs, labels):
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    first = {}
    for d, t, _ in docs:
        if d is not None:
            first[t or ""] = min(d, first.get(t or "", d))
    rows = []
    for d, t, s in docs:
        t = t or ""
        w = re.findall("[^\x20\x09-\x0D]+", t)
        fails = {n for n, f in zip("ABCDE", (
            len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", t)) > 2 * len(t),
            re.search("[#$%&*|]", t), d is not None and d > first[t])) if f}
        rows.append((s or "", fails, d in good, d in toxic))
    out = set()
    for part in {r[0] for r in rows}:
        mine, found, shap = [r for r in rows if r[0] == part], [], dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = mine
            for i, f in enumerate(order):
                gone = [r for r in left if f in r[1]]
                left = [r for r in left if f not in r[1]]
                shap[f] += len(gone)
                fail = sum(f in r[1] for r in mine)
                found.append((part, "".join(order), i + 1, f, len(left), len(gone), fail - len(gone),
                              sum(r[1] == {f} for r in mine), sum(r[2] for r in gone), sum(r[3] for r in gone)))
        out |= {(*r[:3], *r[4:], shap[r[3]]) for r in found}
    return out


def test_filter_audit(spark, monkeypatch):
    rng = random.Random(6)
    word = lambda: rng.choice(["alpha", "Beta", "GAMMA", "d#", "é", *(f"w{rng.randint(0, 500)}" for _ in range(9))])
    docs = []
    for i in range(400):
        n = rng.choice([0, 5, 199, 200, 260])
        few = [word() for _ in range(rng.choice([3, 500]))]
        docs.append((i, " ".join(rng.choice(few) for _ in range(n)), rng.choice(["a", "a", "a", "b", None, ""])))
    docs += [(1000 + i, docs[rng.randrange(9)][1], "a") for i in range(120)]
    docs += [(None, docs[0][1], "b"), (None, None, "c"), (7, docs[0][1], "a"), (7, docs[0][1], "a"), (2000, None, None), (2001, "", "a"), (2002, LONG, "a"), (2003, LONG, "d")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(300)] + [(5, 1, 1), (5, 0, 0), (None, 1, 1), (99_999, 1, 1)]
    df = spark.createDataFrame(docs, SCHEMA).withColumns({k: F.lit(1) for k in ("part", "hash", "fails", "w", "n", "tie")})
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("part", F.lit("x"))
    monkeypatch.setattr(audit, "RANGE", 64)
    got = audit.audit(audit.failing(df, lab))
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == plain_audit(docs, labels)
    assert audit.audit(audit.failing(df.limit(0), lab)).count() == 0


@pytest.fixture(scope="module")
def library():
    with open(public_tokenizers.path(bpe.DEFAULT), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def plain_bpe(library, text):
    ids = library.encode_ordinary(text or "")
    return len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()


@pytest.mark.parametrize("chunk, overlap", [(7, 4), (40, 12), (1 << 16, 1 << 9)])
def test_chunked_bpe(spark, library, chunk, overlap):
    rng = random.Random(4)
    signs = ["a", "the", "é", "𝄞", " ", "  ", "\n", "\r\n", "'", "'re", "'l", "12", "漢字", "!", " ", "　", "<|endoftext|>", "é"]
    texts = ["".join(rng.choices(signs, k=rng.randint(0, 90))) for _ in range(120)]
    texts += [None, "", " " * 500, "a" * 300 + "  b", "1" * 63 + " " * 65 + "\n\nx", "'" * 100 + "re", "é" * 129, texts[5], LONG if chunk > 40 else LONG[:5000]]
    rows = [*enumerate(texts), (None, texts[6]), (4, texts[9])]
    df = spark.createDataFrame([(i, t, "s") for i, t in rows], SCHEMA).withColumns({k: F.lit(1) for k in ("row", "k", "core", "ids")})
    got = sorted(repr(tuple(r)) for r in bpe.digests(df, chunk=chunk, overlap=overlap).collect())
    assert got == sorted(repr((i, *plain_bpe(library, t))) for i, t in rows)


def test_chunked_bpe_pieces(spark, library):
    df = spark.createDataFrame([(1, LONG), (2, "short one"), (3, "")], "doc_id long, text string")
    pieces = bpe.encode(df, chunk=5000, overlap=64)
    raw = bpe.decode(pieces).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("k", "raw"))).alias("p"))
    assert {r.doc_id: b"".join(bytes(p.raw) for p in r.p).decode() for r in raw.collect()} == {1: LONG, 2: "short one", 3: ""}
    assert pieces.where("doc_id = 1").count() == -(-len(LONG) // 5000)
    one = sorted(pieces.where("doc_id = 1").collect(), key=lambda r: r.k)
    assert [i for r in one for i in r.ids] == library.encode_ordinary(LONG)
    assert bpe.encode(df.limit(0)).count() == 0 and bpe.digests(df.limit(0)).count() == 0
