"""Work that a query does once: each row parsed once, each expression evaluated once,
masked texts joined once. Odd rows: null, empty, repeated."""

import io
from contextlib import redirect_stdout

from pyspark.sql import functions as F

from logloom.functions import similarity as S
from logloom.functions import text as T
from logloom.operators import catalog as CT
from logloom.operators import matching as MT
from logloom.operators import metrics as Q
from logloom.plans.rule_parse import rule_pairs, rule_parse


def _plan(df, mode="simple"):
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain(mode)
    return out.getvalue()


def _parsed(spark):
    seen = spark.sparkContext.accumulator(0)

    def parse(text):
        seen.add(1)
        return text

    rows = [("s", i, ["a <*>", "b", None, ""][i % 4], ["a <*>", "b c", "x", None][i % 4 if i % 7 else 1]) for i in range(40)]
    df = spark.createDataFrame(rows, "system string, seq int, truth string, parsed string")
    return seen, df.withColumn("parsed", F.udf(parse)("parsed"))


def test_metrics_parse_each_row_once(spark):
    for metric in (Q.grouping_accuracy, Q.template_accuracy):
        seen, df = _parsed(spark)
        metric(df).collect()
        assert seen.value == 30  # rows with a truth


def test_counted_pairs_score_as_their_rows(spark):
    _, df = _parsed(spark)
    pairs = Q.template_pairs(df)
    stratum = df.where("truth is not null").select("system", F.col("truth").alias("template")).distinct()
    for metric in (Q.grouping_accuracy, Q.template_accuracy, Q.parsing_accuracy):
        assert metric(pairs).collect() == metric(df).collect()
        assert metric(pairs, stratum=stratum).collect() == metric(df, stratum=stratum).collect()
    assert Q.evaluate(pairs, canonical=False).collect() == Q.evaluate(df, canonical=False).collect()


def test_rule_pairs_are_the_pairs_of_the_rule_parse(spark):
    rows = [("s", i, [None, "", "a 1 b", "a 2  b", "u=7 x"][i % 5], ["a <*> b", " a  <*> b.", None, "u {x}"][i % 4]) for i in range(40)]
    logs = spark.createDataFrame(rows, "system string, seq int, Content string, EventTemplate string")
    key = lambda df: sorted(map(str, df.select("system", "truth", "parsed", "n").collect()))
    assert key(rule_pairs(logs)) == key(Q.template_pairs(rule_parse(logs)))


def test_expressions_stand_once_in_the_plan(spark):
    df = spark.createDataFrame([("a", "b")], "c string, d string")
    assert _plan(df.select(T.tokens("c").alias("x"))).count("split(") == 1
    assert _plan(df.select(T.scoring_tokens("c").alias("x"))).count("regexp_extract_all(") == 1
    assert _plan(df.select(S.jaccard(T.tokens("c"), T.tokens("d")).alias("x"))).count("split(") == 2
    assert _plan(df.select(T.repair_response("c", "d").alias("x"))).count("{number}") == 1


def test_a_pass_is_skipped_only_without_a_match(spark):
    texts = ["", "a", "x@y", "u@", "aa:bb:cc:dd:ee:ff", "1:2", "00", "0xg", "1.2.3.4", "= a", "a== b", "==", "/p", "p/", "x-1", "x+",
             "a.com", "٣٤", "Mon", "a {b} <*>", "<*> <*>", "...", "a...b", None]
    df = spark.createDataFrame([(t,) for t in texts], "c string")
    for patterns, needs in ((T.MASK_PATTERNS, T.MASK_NEEDS), ([p for p, _ in T.TEMPLATE_RULES], T.RULE_NEEDS)):
        assert len(patterns) == len(needs)
        for p, n in zip(patterns, needs):
            got = df.select(T._replaced("c", "(?U)" + p, "_", n).alias("a"), F.regexp_replace("c", "(?U)" + p, "_").alias("b"))
            assert all(r.a == r.b for r in got.collect()), p


def _catalog(spark):
    rows = [("s", 1, "<*>", "open <*> now", "open {f} now", ["open", "<*>", "now"], {"f": [1]}, True),
            ("s", 2, "<*>", "close it", "close it", ["close", "it"], {}, True)]
    return spark.createDataFrame(rows, "system string, template_id bigint, template string, example string, labelled string,"
                                 " tokens array<string>, label_positions map<string,array<int>>, indexed boolean")


def test_masked_texts_are_not_repeated_by_token(spark):
    rows = [("s", "open it now", 1, "open it now", ["open", "it", "now"]), ("s", "", 2, "", [""]),
            ("t", "open it now", 1, "open it now", ["open", "it", "now"]), ("s", None, 3, None, None)]
    keys = spark.createDataFrame(rows, "system string, masked string, seq bigint, msg string, tokens array<string>")
    cat = _catalog(spark)
    failed = keys.withColumn("key", F.col("seq")).withColumn("fail_node", F.array().cast("array<string>"))
    assert MT.similar_candidates(failed, cat).columns == ["system", "key", "template_id"]
    ref = {(r.system, r.masked): r.reference for r in MT.reference_example(keys, cat).collect()}
    assert ref == {("s", "open it now"): "open {f} now", ("s", ""): "open {f} now", ("s", None): "open {f} now",
                   ("t", "open it now"): MT.DEFAULT_REFERENCE}
    walk = MT.match_wildcard(keys.where("masked is not null"), cat, "msg").collect()
    assert {(r.system, r.masked): (r.msg, r.template_id) for r in walk} == {
        ("s", "open it now"): ("open it now", 1), ("s", ""): ("", None), ("t", "open it now"): ("open it now", None)}


def test_slot_values_move_no_rows_while_few_are_common(spark):
    rows = [("s", 1, "open a.txt now", "open {file} now"), ("s", 2, "open user now", "open {name} now"),
            ("s", 3, None, None), ("s", 4, "", "{x}")]
    df = spark.createDataFrame(rows, "system string, seq bigint, msg string, response string")
    words = spark.createDataFrame([("user",), ("user",)], "word string").groupBy("word").agg(F.count("*").alias("n"))
    got = CT.correct_slots(df, words)
    assert "SortMergeJoin" not in _plan(got)
    assert {r.seq: r.corrected for r in got.collect()}[2] == "open user now"
    assert {r.seq: r.corrected for r in got.collect()}[1] == "open {file} now"


def _tables(spark, folder):
    """Small tables with a few repeated and null values under ``folder``."""
    kinds = ["view", "signup", "error", "click", "buy", None]
    frames = {
        "events": ([(i, i % 5, kinds[i % 6], i / 3) for i in range(60)], "event_id bigint, user_id bigint, event_type string, value double"),
        "orders": ([(i, i % 7, "OFP"[i % 3], f"{i % 4}-P") for i in range(60)],
                   "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_orderpriority string"),
        "lineitem": ([(i // 3, i % 3, i, i % 4, i / 2, "RAN"[i % 3], "OF"[i % 2]) for i in range(180)],
                     "l_orderkey bigint, l_linenumber int, l_partkey bigint, l_suppkey bigint, l_extendedprice double,"
                     " l_returnflag string, l_linestatus string"),
    }
    for name, (rows, schema) in frames.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_logs_are_read_once_for_words_groups_and_clusters(spark, tmp_path):
    from logloom.plans.registry import queries

    sf = _tables(spark, tmp_path)
    for name in ("uncommon_tokens", "distinct_uncommon_tokens", "cluster_positions", "contribution_scores"):
        df = queries()[name](spark, sf)
        # what is left to run reads stored steps, none of the log tables
        assert not any("lineitem" in f for f in df.inputFiles()), name
        assert df.count() > 0


def test_fold_keeps_rows_whose_later_tokens_are_common(spark):
    from logloom.operators.tokens import uncommon_tokens

    rows = [(1, ["a", "b", "x", "b"]), (2, ["x", "a"]), (3, ["a", "b"]), (4, []), (5, None), (6, ["x", None, "x"])]
    df = spark.createDataFrame(rows, "k int, tokens array<string>")
    words = spark.createDataFrame([("a",), ("b",), ("b",)], "word string")
    got = uncommon_tokens(df, ["k"], "tokens", words)
    assert {r.k: (r.tokens, r.uncommon) for r in got.collect()} == {
        1: (rows[0][1], ["x"]), 2: (rows[1][1], ["x"]), 3: (rows[2][1], []), 4: ([], []), 5: (None, []), 6: (rows[5][1], ["x", "x"])}
    # common later tokens go before rows are exchanged for the fold
    assert any("Filter" in line and "isnull(_common" in line for line in _plan(got).splitlines())


def test_earliest_of_a_batch_stays_in_arrow():
    import pyarrow as pa

    from logloom.streaming.parse_stream import _earliest

    rows = {"system": ["a", "a", "b", None, None, "a"], "seq": [3, 1, None, 5, 2, 1], "msg": list("uvwxyz"), "masked": ["m", "m", "m", None, None, "m"]}
    empty = pa.record_batch(rows).slice(0, 0)
    got = [r for b in _earliest(iter([empty, pa.record_batch(rows)])) for r in b.to_pylist()]
    assert [(r["system"], r["masked"], r["seq"], r["msg"]) for r in got] == [
        ("a", "m", 1, "v"), (None, None, 2, "y"), ("b", "m", None, "w")]
