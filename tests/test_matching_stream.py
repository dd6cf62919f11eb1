from pyspark.sql import functions as F

import __spark_entry__ as entry
from logloom.functions import text as T
from logloom.operators import catalog as CT
from logloom.operators import matching as MT
from logloom.operators import tokens as TK
from logloom.plans.catalog_parse import distinct_keys
from logloom.sources import fixtures as fx
from conftest import SF001


#: Message and the template it must reach: 1 a <*> b, 2 <*> z, 3 c <*>, 4 c <*> d.
WALKS = {
    "a x b": 1, "a x x x x x x b": 1, "a x x x x x x x b": None, "x z": 2, "x y z": None,
    "c x": 3, "c x x x x x x": 3, "c x x x x x x x": None, "c x d": 4, "q": None,
}


def test_wildcard_walk(spark):
    cat = spark.createDataFrame(
        [("s", 1, ["a", "<*>", "b"], True), ("s", 2, ["<*>", "z"], True), ("s", 3, ["c", "<*>"], True),
         ("s", 4, ["c", "<*>", "d"], True)], "system string, template_id bigint, tokens array<string>, indexed boolean")
    keys = spark.createDataFrame([("s", m, m.split()) for m in WALKS], "system string, masked string, tokens array<string>")
    got = {r.masked: r.template_id if r.ok else None for r in MT.match_wildcard(keys, cat).collect()}
    assert got == WALKS


def test_ids_stay_apart_for_large_seq(spark):
    words = spark.createDataFrame([("zz",)], "word string")
    rows = "system string, seq bigint, msg string, response string"
    one = spark.createDataFrame([("s", (1 << 44) + 5, "open alpha", "open alpha"), ("s", 7, "shut beta", "shut beta")], rows)
    two = spark.createDataFrame([("s", 5, "move gamma", "move gamma")], rows)
    cat, _, _ = CT.upsert_catalog(None, one, words, 1)
    cat, _, _ = CT.upsert_catalog(cat, two, words, 2)
    got = {r.template: r.template_id for r in cat.collect()}
    assert got == {"shut beta": 0, "open alpha": 1, "move gamma": 2}


def test_stream_first_seen_equals_batch_keys(spark):
    got = sorted(tuple(r) for r in entry.queries()["stream_first_seen"](spark, SF001).collect())
    lv = fx.log_view(spark, SF001)
    want = sorted(tuple(r) for r in lv.select(
        "system", T.mask_message(T.correct_message("Content")).alias("masked")).distinct().collect())
    assert got == want


def test_stream_first_messages_of_the_whole_log_view(spark):
    got = sorted(tuple(r) for r in entry.queries()["stream_first_messages"](spark, SF001).collect())
    msgs = fx.log_view(spark, SF001).select("system", "seq", T.correct_message("Content").alias("msg"))
    want = sorted(tuple(r) for r in msgs.groupBy("system", T.mask_message("msg").alias("masked")).agg(
        F.min("seq").alias("seq"), F.min_by("msg", "seq").alias("msg")).collect())
    assert got == want and {r[0] for r in got} == {"events", "orders", "shipping"}


def test_slots_of_every_row_and_keys_of_all_tables(spark):
    rows = fx.labelled_log_view(spark, SF001)
    with_slots = rows.where(F.col("Labelled").contains("{")).count()
    got = entry.queries()["slot_capture"](spark, SF001).select("system", "seq").distinct().count()
    assert got == with_slots
    assert entry.queries()["slot_correction"](spark, SF001).count() == rows.count()
    keys = {r.system: r["count"] for r in entry.queries()["reference_example"](spark, SF001).groupBy("system").count().collect()}
    texts = fx.text_view(spark, SF001).select("system", T.mask_message(T.correct_message("Content")).alias("m")).distinct()
    assert {"events", "orders", "shipping"} < set(keys)
    assert {r.system: r["count"] for r in texts.groupBy("system").count().collect()}.items() <= keys.items()


def test_entry_contract(spark):
    df = entry.entry(spark)
    assert df.count() == 3
    assert set(entry.oracle_sql()) <= set(entry.queries())
