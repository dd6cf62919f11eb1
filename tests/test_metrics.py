from pyspark.sql import functions as F

from logloom.operators import metrics as Q
from logloom.plans.rule_parse import rule_parse_metrics
from logloom.sources import fixtures as fx
from conftest import SF01


def test_golden_rule_parse_sf001(spark):
    rows = {r.system: r for r in rule_parse_metrics(fx.log_view(spark, SF01)).collect()}
    assert rows["events"].rows == 10000
    assert round(rows["events"].GA, 4) == 0.7994
    assert round(rows["events"].PGA, 4) == 0.5714 and round(rows["events"].RGA, 4) == 0.8
    assert round(rows["events"].FGA, 4) == 0.6667 and round(rows["events"].FTA, 4) == 0.6667
    assert rows["orders"].GA == 0.0 and rows["orders"].identified_templates == 6
    assert rows["shipping"].GA == 1.0 and rows["shipping"].PA == 1.0


def test_perfect_parse_gives_ones(spark):
    df = spark.createDataFrame([("s", i, f"t{i % 3}", f"t{i % 3}") for i in range(30)],
                               "system string, seq int, truth string, parsed string")
    r = Q.evaluate(df, canonical=False).collect()[0]
    assert (r.GA, r.PA, r.FGA, r.PTA, r.RTA, r.FTA) == (1.0, 1.0, 1.0, 1.0, 1.0, 1.0)


def test_metrics_invariant_under_repartition(spark):
    df = spark.createDataFrame([("s", i, f"t{i % 4}", f"p{i % 3}") for i in range(50)],
                               "system string, seq int, truth string, parsed string")
    a = Q.evaluate(df, canonical=False).collect()
    b = Q.evaluate(df.repartition(7).orderBy(F.rand(3)), canonical=False).collect()
    assert a == b


def test_null_truth_dropped_for_grouping(spark):
    df = spark.createDataFrame([("s", 1, None, "a"), ("s", 2, "a", "a")],
                               "system string, seq int, truth string, parsed string")
    r = Q.grouping_accuracy(df).collect()[0]
    assert r.GA == 1.0 and r.rows == 1
    assert Q.parsing_accuracy(df).collect()[0].PA == 0.5


def test_pairs_weigh_as_their_rows(spark):
    rows = [("s", i, ["a b <*>", "a c", "", None][i % 4], ["a b c", "a c", "", "x"][i % 4 if i % 5 else 1]) for i in range(60)]
    df = spark.createDataFrame(rows, "system string, seq int, truth string, parsed string")
    each = df.agg(F.avg(Q.template_similarity("truth", "parsed")).alias("s"), F.avg(F.expr("cast(truth <=> parsed as double)")).alias("p")).first()
    assert abs(Q.similarity_accuracy(df).first().SA - each.s) < 1e-6
    assert abs(Q.parsing_accuracy(df).first().PA - each.p) < 1e-6
    none = spark.createDataFrame([("s", 1, "", ""), ("s", 2, None, "a")], df.schema)
    want = none.agg(F.avg(Q.template_similarity("truth", "parsed")).alias("s")).first().s
    assert Q.similarity_accuracy(none).first().SA == want
    assert Q.similarity_accuracy(df.limit(0)).count() == Q.parsing_accuracy(df.limit(0), folded=True).count() == 0
