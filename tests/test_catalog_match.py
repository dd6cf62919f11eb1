"""Slots, value merges and similarity joins against plain versions and hand-worked cases."""

import random
import re

from pyspark.sql import functions as F

from logloom.operators import catalog as CT
from logloom.operators import matching as MT


def plain_slots(msg, template):
    labels = re.findall(r"\{(.*?)\}", template)
    if not labels or len(labels) > 30:
        return []
    lits = re.split(r"\{.*?\}", template)
    m = re.match(r"([\s\S]*)".join(re.escape(x) for x in lits), msg)
    if not m:
        return []
    spans, at = [], 0
    for t in msg.split():
        spans.append((at, at + len(t)))
        at += len(t) + 1
    out = []
    for i, label in enumerate(labels):
        s, e = m.start(i + 1), m.end(i + 1)
        hit = [k for k, (a, b) in enumerate(spans) if s <= b and e >= a]
        out.append((label, m.group(i + 1), s, hit))
    return out


def test_slots_equal_a_greedy_regex(spark):
    rng = random.Random(9)
    rows = [("s", -1, "", ""), ("s", -2, "a\nb", "{x}"), ("s", -3, "  a  b ", "{x}  {y}"), ("s", -4, "aaa", "a{x}a"),
            ("s", -5, "x.y", "{a}.{b}"), ("s", -6, "x y", "z{a}"), ("s", -7, " ".join("abc" * 40), "{a}" * 31), ("s", -8, "abab", "{a}b{c}ab{d}")]
    for i in range(1500):
        msg = "".join(rng.choices(["a", "b", ".", " ", "é", "\\E", "1", "  "], k=rng.randint(0, 14)))
        template = "".join(rng.choices(["a", "b", ".", " ", "{x}", "{y}", "{}", "\\E", "1"], k=rng.randint(0, 8)))
        if rng.random() < 0.5 and len(msg) > 3:
            a, b = sorted(rng.sample(range(len(msg) + 1), 2))
            template = msg[:a] + "{v}" + msg[b:]
        rows.append(("s", i, msg, template))
    df = spark.createDataFrame(rows, "system string, seq bigint, msg string, response string")
    got = {r.seq: [(c.label, c.value, c.start, list(range(c.first, c.last + 1))) for c in r.caps] for r in CT.extract_slots(df).collect()}
    assert got == {seq: plain_slots(msg, t) for _, seq, msg, t in rows}


LABELLED = "system string, seq bigint, msg string, response string"


def test_an_existing_template_merges_known_labels_only(spark):
    words = spark.createDataFrame([("qq",)], "word string")
    one = spark.createDataFrame([("s", 1, "open f1", "open {file}"), ("s", 2, "open f2", "open {path}"), ("s", 3, "open f3", "open {file}")], LABELLED)
    cat, _, units = CT.upsert_catalog(None, one, words, 0)
    assert sorted((r.seq, r.label, r.value) for r in units.collect()) == [(1, "file", "f1"), (3, "file", "f3")]
    two = spark.createDataFrame([("s", 4, "open f4", "open {path}"), ("s", 5, "shut f5", "shut {path}"), ("s", 6, "open f6", "open {file}"),
                                 ("s", 7, "open f7", "open {path}")], LABELLED)
    cat, _, more = CT.upsert_catalog(cat, two, words, 1, units=units)
    assert cat.count() == 2
    assert sorted((r.seq, r.label, r.value) for r in more.collect()) == [(5, "path", "f5"), (6, "file", "f6"), (7, "path", "f7")]


def test_generalisation_merges_values_and_names_new_labels(spark):
    cat = spark.createDataFrame(
        [("s", 0, "open <*> as root", {"file": [1]}), ("s", 1, "shut <*> now", {}), ("s", 2, "x y", {"unknown_4": [0]})],
        "system string, template_id bigint, final_template string, label_positions map<string,array<int>>")
    hits = spark.createDataFrame(
        [("s", 0, 10, "open f9 as admin"), ("s", 0, 11, "open F9 as guest"), ("s", 0, 12, "open f1 as root"),
         ("s", 1, 9, "shut b now"), ("s", 1, 13, "shut c d now"), ("s", 2, 14, "z y")],
        "system string, template_id bigint, seq bigint, msg string")
    diff = CT.positional_diff(hits, cat).cache()
    merged = {(r.label, r.value) for r in CT.merged_values(diff, 3).collect()}
    assert merged == {("file", "f9"), ("file", "F9"), ("file", "f1"), ("unknown_4", "z")}
    new = CT.unknown_labels(diff, cat).cache()
    assert {(r.template_id, r.pos, r.label, r.seq, r.own, r.token) for r in new.collect()} == {
        (1, 1, "unknown_5", 9, "<*>", "b"), (0, 3, "unknown_6", 10, "root", "admin")}
    values = {(r.label, r.value) for r in CT.unknown_values(diff, new, 3).collect()}
    assert values == {("unknown_5", "<*>"), ("unknown_5", "b"), ("unknown_6", "root"), ("unknown_6", "admin"), ("unknown_6", "guest")}
    out = {r.template_id: (r.final_template, r.label_positions) for r in CT.generalise_templates(hits, cat, new).collect()}
    assert out == {0: ("open <*> as <*>", {"file": [1], "unknown_6": [3]}), 1: ("shut <*> now", {"unknown_5": [1]}), 2: ("x y", {"unknown_4": [0]})}


def test_similar_match_equals_all_pairs(spark):
    rng = random.Random(2)
    word = lambda: rng.choice(["ab", "b", "ccc", "d", "<*>", "eeee", "f", "gg"])
    templates = {tuple(word() for _ in range(rng.randint(1, 8))) for _ in range(60)} | {("<*>",)}
    cat = [("s", i, list(t), True, " ".join(x.replace("<*>", "12 z") for x in t),
            {l: sorted(rng.sample(range(len(t)), min(len(t), n))) for l, n in (("lab", 1), ("unknown_1", 2)) if rng.random() < 0.5})
           for i, t in enumerate(sorted(templates))]
    keys = []
    for i in range(200):
        base = list(rng.choice(cat)[2])
        msg = [rng.choice(["ab", "q", "d"]) if x == "<*>" or rng.random() < 0.15 else x for x in base]
        own = rng.choice(cat)[2] if rng.random() < 0.3 else base
        keys.append(("s", f"k{i}", " ".join(msg) if i % 9 else "34 z", msg if i % 9 else ["34", "z"], list(own[: rng.randint(0, 2)]) if rng.random() < 0.5 else []))
    catalog = spark.createDataFrame(cat, "system string, template_id bigint, tokens array<string>, indexed boolean, example string, label_positions map<string,array<int>>")
    failed = spark.createDataFrame(keys, "system string, masked string, msg string, tokens array<string>, fail_node array<string>")
    got = {r.masked: r.template_id for r in MT.match_similar(failed, catalog).collect()}

    def edit(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a):
            new = [i + 1]
            for j, y in enumerate(b):
                new.append(min(row[j + 1] + 1, new[j] + 1, row[j] + (x != y)))
            row = new
        return 1 - row[-1] / max(len(a), len(b), 1)

    born = {}
    for _, i, t, *_ in cat:
        for d in range(1, len(t) + 1):
            born.setdefault(tuple(t[:d]), i)
    want = {}
    for _, k, msg, tk, node in keys:
        found = []
        for _, i, t, _, ex, labels in cat:
            if t[: len(node)] != node:
                continue
            if tk[0] == t[0]:
                gate = True
            elif len(t) == 1:
                gate = t[0] == "<*>" and edit(re.sub(r"\d", "*", msg), re.sub(r"\d", "*", ex)) >= 0.8
            else:
                gate = len(tk) > 1 and tk[1] == t[1]
            spots = {p for l, ps in labels.items() if not l.startswith("unknown") for p in ps}
            m = {"<*>" if j in spots else x for j, x in enumerate(tk)}
            if gate and 5 * len(m & set(t)) >= 4 * len(m | set(t)):
                found.append(([born[tuple(t[:d])] for d in range(1, len(t) + 1)], i))
        if found:
            want[k] = min(found)[1]
    assert got == want and len(want) > 20


def test_relevant_variables_equal_all_pairs(spark):
    rng = random.Random(7)
    text = lambda: "".join(rng.choices("abcdef12é", k=rng.randint(0, 7)))
    units = [("s", l, [text() for _ in range(rng.randint(1, 6))], i) for i, l in enumerate(["zeta", "alpha", "unknown_0", "mid"])]
    keys = [("s", f"k{i}", [text() or "x" for _ in range(rng.randint(0, 5))]) for i in range(150)]
    u = spark.createDataFrame(units, "system string, label string, symbols array<string>, first_use int")
    k = spark.createDataFrame(keys, "system string, masked string, uncommon array<string>")
    got = {r.masked: {h.label: h.symbol for h in r.hints} for r in MT.relevant_variables(k, u).collect()}
    want = {}
    for _, name, toks in keys:
        hints = {}
        for t in toks:
            best = None
            for _, label, symbols, _ in units:
                for s in symbols:
                    if label.startswith("unknown") or not s:
                        continue
                    a, b = set(t), set(re.sub(r"\d", "*", s))
                    score = len(a & b) / len(a | b)
                    if best is None or score > best[0]:
                        best = score, label, s
            if best and best[0] >= 0.5:
                hints[best[1]] = best[2]
        if hints:
            want[name] = hints
    assert got == want and len(want) > 30
