"""Similar signatures (A5) of small and large character sets against all pairs."""
import random

from pyspark.sql import functions as F

from logloom.operators import cluster as CL

SIGS = "system string, sig array<string>, n int, o string, first string"


def _sets(seed):
    """Sets of up to 260 characters, many of them near others, on both sides of every class's bounds."""
    rng, out = random.Random(seed), set()
    for size in [1, 3, 5, 8, 11, 12, 13, 14, 16, 20, 38, 41, 44, 52, 190, 205, 250] * 4:
        base = rng.sample([chr(0x4E00 + i) for i in range(int(size * 1.3) + 2)], size)
        for _ in range(5):
            lost = rng.randint(0, -(-size // 6))
            new = [chr(0x6E00 + rng.randrange(300)) for _ in range(rng.randint(0, -(-size // 8)))]
            out.add(frozenset(rng.sample(base, size - lost) + new))
    return sorted("".join(sorted(s)) for s in out)


def test_pairs_are_those_of_all_pairs(spark):
    items = [(s, x) for s in ("p", "q") for x in _sets(s)] + [("q", "")]
    df = spark.createDataFrame([(s, list(x), len(x), x, x) for s, x in items], SIGS)
    edges = CL.similar_signature_pairs(df, ["system"]).select("system", "oa", "ob").collect()
    want = set()
    for s, x in items:
        for t, y in items:
            a, b = set(x), set(y)
            if s == t and x < y and 5 * len(a & b) >= 4 * len(a | b):
                want.add((s, x, y))
    assert len(want) > 200 and {tuple(e) for e in edges} == want and len(edges) == len(want)


def test_large_sets_meet_on_several_characters(spark):
    """One shared character brought every pair of large sets of a system together."""
    rng = random.Random(3)
    sets = {"".join(sorted(rng.sample("abcdefghijklmnopqrstuvwxyz0123456789", 14))) for _ in range(1500)}
    df = CL.numbered(spark.createDataFrame([("p", list(x), len(x), x, x) for x in sorted(sets)], SIGS))
    keys = CL._prefix_candidates(df, ["system"], 4, 5)
    met = keys.groupBy("system", "key").count().agg(F.sum(F.expr("count * (count - 1) / 2"))).first()[0]
    assert met < len(sets) ** 2 / 20
