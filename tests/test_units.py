"""Slot values and symbols (A9, A10) and corrected slots (E3) at many values and rows."""
import glob
import random

from logloom.operators import catalog as CT
from logloom.operators.cluster import cluster_leaders, leader_cluster
from logloom.session import ensure_checkpoint_dir

UNITS = "system string, round int, seq long, li int, label string, pos int, value string"


def test_values_are_counted_in_rows(spark):
    """A label's values are never gathered into one array."""
    rows = [("a", 0, i, 0, "id", 0, f"{'V' if i % 2 else 'v'}{i // 2}") for i in range(400)] + [("a", 0, 5, 1, "other", 0, "x"), ("a", 0, 5, 1, "id", 1, None)]
    units = CT.variable_units(spark.createDataFrame(rows, UNITS))
    got = {r.label: r for r in units.collect()}
    assert got["id"].n_values == 200 and got["other"].n_values == 1 and got["other"].symbols == ["x"]
    assert tuple(got["id"].first_use) == (0, 0, 0) and got["id"].symbols[0] == "v0"
    assert "collect_set" not in units._jdf.queryExecution().optimizedPlan().toString()


def test_leaders_are_those_of_the_clusters(spark):
    rng = random.Random(4)
    items = {("a", "l", "".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, 7)))) for _ in range(150)} | {("a", "l", None)}
    df = spark.createDataFrame([(*x, i) for i, x in enumerate(sorted(items, key=str))], "system string, label string, value string, o int")
    want = leader_cluster(df, "value", order="o", partition=["system", "label"]).where("is_leader")
    got = cluster_leaders(df, "value", order="o", partition=["system", "label"])
    assert sorted(r.leader for r in got.collect()) == sorted(r.value for r in want.collect())


def test_corrected_slots_are_stored_once(spark):
    """The captures are the one table that is as long as the messages; positions are worked out only when they are read."""
    rows = [("a", 1, "User 7 saw  7 of\t9", "User {uid} saw {n} of {k}"), ("a", 2, "User was up", "User {state} up"), ("a", 3, "plain", "plain"), ("a", 4, None, "x {y}")]
    words = spark.createDataFrame([("up",)], "word string")
    before = set(glob.glob(f"{ensure_checkpoint_dir(spark).removeprefix('file:')}/*"))
    t = CT.template_from_response(spark.createDataFrame(rows, "system string, seq long, msg string, response string"), words)
    new = {x.rpartition("/")[2].partition("-")[0] for x in set(glob.glob(f"{ensure_checkpoint_dir(spark).removeprefix('file:')}/*")) - before}
    assert new == {"captures", "words", "common"}
    assert "sequence(" not in t.select("seq", "labelled", "template")._jdf.queryExecution().optimizedPlan().toString()
    got = {r.seq: r for r in t.collect()}
    assert got[1].template == "User <*> saw <*> of <*>" and got[3].template == "plain"
    assert got[2].labelled == "User {state} up" and got[2].label_positions == {"state": [1]}


def test_nine_words_are_too_long_for_a_slot(spark):
    rows = [("a", n, "x " + " ".join("abcdefghij"[:n]), "x {y}") for n in (8, 9)] + [("a", 1, "x " + "long" * 9, "x {y}")]
    words = spark.createDataFrame([("up",)], "word string")
    got = {r.seq: len(r.label_vars) for r in CT.correct_slots(spark.createDataFrame(rows, "system string, seq long, msg string, response string"), words).collect()}
    assert got == {8: 1, 9: 0, 1: 1}
