from pyspark.sql import functions as F

from logloom.operators import dedup as D
from logloom.operators import sampling as SM
from logloom.operators import tokens as TK
from logloom.operators.cluster import leader_cluster
from logloom.sources import fixtures as fx
from conftest import SF001


def test_leader_cluster_equals_sequential_first_fit(spark):
    conv = fx.table(spark, SF001, "conversations")
    toks = (conv.select(F.explode(F.split("text", r"\s+")).alias("token"))
            .where(F.length("token") > 0).distinct().withColumn("system", F.lit("c")))
    got = {r.token: r.leader for r in leader_cluster(toks, "token").collect()}
    items = sorted(got)
    chars = [frozenset(t) for t in items]
    near = [{j for j in range(i) if 5 * len(a & chars[j]) >= 4 * len(a | chars[j])} for i, a in enumerate(chars)]
    leaders: dict[int, int] = {}
    for i, before in enumerate(near):
        leaders[i] = min((j for j in before if leaders[j] == j), default=i)
    assert got == {items[i]: items[j] for i, j in leaders.items()}


def test_diversified_sample_matches_replay(spark):
    logs = fx.log_view(spark, SF001)
    words = TK.corpus_dictionary(logs, "Content", 50)
    groups = D.candidate_groups(SM.prefix_sample(logs, 0.2), words)
    clusters = SM.token_clusters(groups)
    got = sorted((r.system, r.pick, r.seq) for r in SM.diversified_sample(groups, clusters, 32).collect())
    g = groups.select("system", "seq", "tokens", "uncommon").collect()
    cl = {(r.system, r.token): r.leader for r in clusters.collect()}
    want = []
    for system in sorted({r.system for r in g}):
        rows = sorted((r for r in g if r.system == system), key=lambda r: r.seq)
        pos = {}
        for r in rows:
            for t in r.uncommon:
                pos.setdefault(cl[(system, t)], set()).add(list(r.tokens).index(t))
        covered, picked = set(), []
        for rnd in range(min(32, len(rows))):
            best = None
            for r in rows:
                if r.seq in picked:
                    continue
                gain = sum(len(pos[cl[(system, t)]]) for t in r.uncommon if cl[(system, t)] not in covered)
                if best is None or gain > best[0]:
                    best = (gain, r)
            picked.append(best[1].seq)
            covered |= {cl[(system, t)] for t in best[1].uncommon}
            want.append((system, rnd, best[1].seq))
    assert got == sorted(want)


def test_prefix_sample_is_first_fifth(spark):
    logs = fx.log_view(spark, SF001)
    got = sorted((r.system, r.seq) for r in SM.prefix_sample(logs, 0.2, bucket_width=64).collect())
    rows = logs.select("system", "seq").collect()
    want = []
    for system in {r.system for r in rows}:
        s = sorted(r.seq for r in rows if r.system == system)
        want += [(system, x) for x in s[: int(0.2 * len(s))]]
    assert got == sorted(want)
