"""Log tables that are built once (labelling prompts, relevant variables, catalog parse) on rows made here."""
import pytest
from pyspark.sql import functions as F

from logloom.functions import text as T
from logloom.operators import tokens as TK
from logloom.operators.metrics import template_pairs
from logloom.plans import registry as R
from logloom.plans.catalog_parse import distinct_keys, masked_keys, parse_logs, parse_pairs
from logloom.sources import fixtures as fx

KINDS = ("view", "signup", "error", "click", "buy")
LOGS = "system string, seq long, Content string, EventTemplate string"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("tables"))
    made = {
        "events": ([(i, i % 7, KINDS[i % 5], i * 1.5) for i in range(300)], "event_id long, user_id long, event_type string, value double"),
        "orders": ([(i, i % 9, "OFP"[i % 3], "1-URGENT") for i in range(120)], "o_orderkey long, o_custkey long, o_orderstatus string, o_orderpriority string"),
        "lineitem": ([(i // 3, i % 3, i % 11, i % 5, float(i), "RAN"[i % 3], "OF"[i % 2]) for i in range(360)],
                     "l_orderkey long, l_linenumber long, l_partkey long, l_suppkey long, l_extendedprice double, l_returnflag string, l_linestatus string"),
        "documents": ([(i, f"Some words  number {i} about file{i % 3}...") for i in range(20)], "doc_id long, text string"),
        "conversations": ([(i, 0, f"hello {i}") for i in range(10)] + [(11, 0, None)], "conv_id long, turn long, text string"),
        "pages": ([(i, f"<p>page {i}</p>") for i in range(10)], "page_id long, html string"),
    }
    for name, (rows, schema) in made.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{d}/{name}.parquet")
    return d


def _rows(df):
    return sorted(map(str, df.collect()))


def test_views_of_stored_logs(spark, tables):
    logs = fx.stored_logs(spark, tables)
    assert _rows(logs.log_view()) == _rows(fx.log_view(spark, tables))
    assert _rows(logs.labelled_examples()) == _rows(fx.labelled_examples(spark, tables))


@pytest.mark.parametrize("name", ["relevant_variables", "labelling_prompts", "catalog_parse_metrics"])
def test_log_tables_are_built_once(spark, tables, monkeypatch, name):
    read, table = [], fx.table
    monkeypatch.setattr(fx, "table", lambda s, d, t: read.append(t) or table(s, d, t))
    assert R.queries()[name](spark, tables).count() > 0
    assert read.count("lineitem") == 1


def test_raw_messages_give_the_same_keys(spark):
    texts = ["a 1 b", "a 2 b", "a  3   b", "a 4\tb...", " a 5 b.", "x... 10.0.0.1 y", "x... 20.1.2.3 y", "logname uid 7", "logname  uid 8", "", None,
             "Mon 12:30 /p/1", "Mon 11:59 /p/22", "٣ a1", "٤ a2", "a 1 b"]
    raw = spark.createDataFrame([("s", i, t, t and f"t {t}") for i, t in enumerate(texts)], LOGS)
    normal = raw.select("system", "seq", T.correct_message("Content").alias("Content"), T.correct_message("EventTemplate").alias("EventTemplate"))
    assert _rows(masked_keys(raw, raw=True)) == _rows(masked_keys(normal))
    words = spark.createDataFrame([("b",)], "word string")
    want = distinct_keys(normal, words).select("system", "masked", "uncommon")
    assert _rows(distinct_keys(raw, words, raw=True, carry=())) == _rows(want)


def test_pairs_are_the_counted_rows(spark, tables):
    logs = fx.log_view(spark, tables).unionByName(spark.createDataFrame(
        [("events", 9000 + i, t, None if i == 2 else "odd  <*>") for i, t in enumerate(["odd 1", "odd  2...", "odd 3", "0x1 odd"])], LOGS)).cache()
    examples, words = fx.labelled_examples(spark, tables), TK.corpus_dictionary(fx.log_view(spark, tables), "Content", 50)
    rows, _, stats = parse_logs(logs, examples, words)
    pairs, _, counted = parse_pairs(logs, examples, words)
    assert _rows(pairs) == _rows(template_pairs(rows).select(*pairs.columns))
    keep = ["system", "invoc_num", "invoc_token"]
    assert _rows(stats.select(keep)) == _rows(counted.select(keep))
    assert pairs.select(F.sum("n")).first()[0] == logs.count()
    logs.unpersist()
