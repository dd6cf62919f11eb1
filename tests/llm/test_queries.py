"""Registered queries on whole small tables, against plain restatements of their contracts."""

import hashlib
import re
import zlib

import duckdb
import numpy as np
import pytest

from logloom.llm import lzprint, queries, toxicity

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs():
    return duckdb.sql(f"select doc_id, coalesce(text, '') as text from '{SF}/documents.parquet' order by doc_id").fetchall()


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_factorization_machine_equals_pair_sums():
    rng = np.random.default_rng(1)
    m = toxicity.Model(0.3, np.arange(12), rng.normal(size=12), rng.normal(size=(12, 4)))
    rows = [np.flatnonzero(rng.random(12) < 0.4) for _ in range(50)] + [np.zeros(0, np.int64)]
    want = []
    for r in rows:
        x = m.bias + sum(m.weight[i] for i in r) + sum(m.factor[i] @ m.factor[j] for i in r for j in r if i < j)
        want.append(1 / (1 + np.exp(-x)))
    assert m.scores(rows) == pytest.approx(np.array(want), abs=1e-9)


def test_op1_holds_out_by_id(spark, docs):
    rows = queries.op1_toxicity(spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == [d for d, _ in docs]
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)


def test_op2_base_spans(spark, docs):
    assign = re.compile(r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    access, hexes = re.compile("AKIA[A-Z0-9]+"), re.compile("[0-9a-f]+")
    got = {r.doc_id: r for r in queries.op2_secrets(spark, SF).collect()}
    assert sorted(got) == [d for d, _ in docs]
    for i, text in docs:
        found = [(m.start(), 0, m.end(), "assign") for m in assign.finditer(text) if len(m[1]) >= 6]
        found += [(m.start(), 1, m.end(), "access") for m in access.finditer(text) if len(m[0]) >= 20]
        found += [(m.start(), 2, m.end(), "hex") for m in hexes.finditer(text) if len(m[0]) >= 24]
        base = [f"{k}:{s}:{e}" for s, _, e, k in sorted(found)]
        kinds = [f[3] for f in found]
        r = got[i]
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(kinds.count(k) for k in ("assign", "access", "hex"))
        assert r.base_sha256 == sha(",".join(base)) and set(base) <= set(r.spans.split(","))


def test_op8_edits_and_prints(spark, docs):
    got = {r.doc_id: r for r in queries.op8_lz_fingerprint(spark, SF).collect()}
    assert sorted(got) == [d for d, _ in docs]
    prints = {}
    for k, (i, text) in enumerate(docs):
        r, after = got[i], docs[(k + 1) % len(docs)]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[1][:half]
        assert r.n_chars == len(text) and r.edited_sha256 == sha(edited)
        own, new = lzprint.fingerprint(text.encode()), lzprint.fingerprint(edited.encode())
        assert (r.fingerprint, r.edited_fingerprint) == (lzprint.text_of(own), lzprint.text_of(new))
        assert prints.setdefault(text, r.fingerprint) == r.fingerprint
        assert r.near_edited == pytest.approx(lzprint.likeness(own, new))
        assert r.near_next == pytest.approx(lzprint.likeness(own, lzprint.fingerprint(after[1].encode())))


def test_op4_shares_and_op7_rows(spark, docs):
    rows = queries.op4_mixing(spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == [d for d, _ in docs]
    assert all(r.rate >= 0 and abs(r.copies - r.rate) < 1 for r in rows)
    pages = duckdb.sql(f"select page_id, url from '{SF}/pages.parquet'").fetchall()
    got = queries.op7_template_text(spark, SF).collect()
    assert sorted((r.page_id, r.url) for r in got) == sorted(pages)
    assert all(r.n_chars == len(r.text) and r.text == "\n".join(" ".join(x.split()) for x in r.text.split("\n")) for r in got)
