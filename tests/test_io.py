import tempfile

from pyspark.sql import functions as F

from logloom.operators import metrics as Q
from logloom.plans.rule_parse import rule_parse
from logloom.sources import fixtures as fx
from logloom.sources import logs as L
from conftest import SF001


def test_csv_round_trip_and_outputs(spark):
    out = tempfile.mkdtemp(prefix="logloom-io-")
    lv = fx.log_view(spark, SF001).where(F.col("system") == "events")
    (lv.orderBy("seq").select("Content", "EventTemplate", F.lit("x").alias("Level"))
     .coalesce(1).write.options(**L.CSV_OPTIONS).csv(f"{out}/events_full.log_structured.csv"))
    back = L.read_structured_logs(spark, f"{out}/events_full.log_structured.csv", system="events")
    assert back.count() == lv.count()
    first = back.orderBy("seq").first()
    assert first.Content == lv.orderBy("seq").first().Content
    parsed = rule_parse(lv)
    L.write_parsed(parsed, f"{out}/parsed")
    assert spark.read.parquet(f"{out}/parsed").count() == lv.count()
    L.append_results(Q.result_rows(Q.evaluate(parsed, canonical=False)), f"{out}/result")
    L.append_results(Q.result_rows(Q.evaluate(parsed, canonical=False)), f"{out}/result")
    res = spark.read.options(**L.CSV_OPTIONS).csv(f"{out}/result")
    assert res.count() == 2 and res.first().GA == "0.7900"
