"""Plan checks: similarity and matching joins are blocked equi-joins."""
from pyspark.sql import functions as F

from logloom.functions import text as T
from logloom.operators import catalog as CT
from logloom.operators import matching as MT
from logloom.operators import tokens as TK
from logloom.operators.cluster import signatures, similar_signature_pairs
from logloom.plans.catalog_parse import distinct_keys
from logloom.sources import fixtures as fx
from conftest import SF001

BAD = ("CartesianProduct", "BroadcastNestedLoopJoin")


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_unblocked_joins(spark):
    logs = fx.log_view(spark, SF001)
    words = TK.corpus_dictionary(logs, "Content", 50)
    ex = fx.labelled_examples(spark, SF001).select(
        "system", "seq", F.col("Content").alias("msg"), F.col("EventTemplate").alias("response"))
    cat, _, units = CT.upsert_catalog(None, ex, words, 0, indexed=True)
    keys = distinct_keys(logs.select("system", "seq", T.correct_message("Content").alias("Content"),
                                     "EventTemplate"), words)
    toks = keys.select("system", F.explode("tokens").alias("token")).distinct()
    sigs = signatures(toks.withColumn("_o", F.col("token")), ["system"], "token", "_o")
    failed = keys.select("system", "masked", "msg", "tokens", F.array().cast("array<string>").alias("fail_node"))
    frames = {
        "A5 edges": similar_signature_pairs(sigs, ["system"]),
        "J4": MT.match_similar(failed, cat),
        "J6": MT.reference_example(keys, cat),
        "J5": MT.relevant_variables(keys, CT.variable_units(units)),
    }
    for name, df in frames.items():
        plan = _plan(df)
        assert not any(b in plan for b in BAD), name


def test_scan_prunes_columns(spark):
    from logloom.plans.rule_parse import rule_parse_metrics
    plan = _plan(rule_parse_metrics(fx.log_view(spark, SF001)))
    # the events scan reads only the four columns the messages use
    assert "struct<event_id:bigint,user_id:bigint,event_type:string,value:double>" in plan
